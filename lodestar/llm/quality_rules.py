"""Quality rules, line first: rules for single lines remove lines, then documents that lose too much text go.

Native operators only. All counts of a text are made inside its row, in time linear in its length but for one sort,
so nothing is shuffled and a hot source or a group of copies costs no more than its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

WINDOW = 5
#: Letters that a line needs before its capitals count.
SHORT = 12
#: Phrases that mark a line of page furniture, not prose.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "subscribe to our newsletter",
    "click here", "javascript", "lorem ipsum", "sign up for", "log in to", "share this", "skip to content", "back to top",
)


def repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur at least twice, the first one included."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def places(h: Column) -> Column:
        """The places of windows whose hash occurs more than once, in order: neighbours in the order of the hash."""
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def same(s: Column) -> Column:
            return F.filter(s, lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"])))

        return F.array_sort(F.transform(let(pairs, same), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        """Length of the union of the windows that begin at the places p."""
        steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    # Most texts repeat no window; a hash set tells before anything is sorted.
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(places(h), covered)).otherwise(F.lit(0)))
    return F.when(n > WINDOW, found).otherwise(F.lit(0))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def bad_line(line: Column, chars: Column, symbol_share: float, shout_share: float) -> Column:
    """True if a line with so many characters besides white space fails a rule: punctuation, navigation or boilerplate.

    Cheap tests stand before dear ones, which are then left out for most lines.
    """
    letters, upper = count_of(line, r"\p{L}"), count_of(line, r"\p{Lu}")

    def boiler(low: Column) -> Column:
        out = F.lit(False)
        for phrase in BOILERPLATE:
            out = out | low.contains(phrase)
        return out

    return (
        (count_of(line, r"[#*$%&|<>!]") > symbol_share * chars)
        | (count_of(line, r"[|»›·•]") >= 3)
        | ((upper > shout_share * SHORT) & (letters >= SHORT) & (upper > shout_share * letters))
        | let(F.lower(line), boiler)
    )


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, max_repeat_pct: int = 20,
    symbol_share: float = 0.08, shout_share: float = 0.7, max_lost: float = 0.4,
) -> DataFrame:
    """One row per row of docs: (doc_id, text after line rules, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_bad_lines, lost_share, kept).

    The base counts are of the whole text (null: none). A document fails the base if it has fewer than min_words words
    or more than max_repeat_pct percent of them in repeated windows. Line rules: more than symbol_share of a line's
    characters are symbols or exclamation marks (punctuation), at least three menu separators (navigation), more than
    shout_share capitals, or a stock phrase (boilerplate). Failing lines are removed; a document that loses more than
    max_lost of its word characters, or keeps no words, is rejected. Null and empty texts have no words, so they
    fail. Repeated rows are judged alike. An empty table gives an empty result. Other columns are not looked at.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    wide = base.select("doc_id", "text", words_of(F.col("text")).alias("words"), F.split("text", "\n", -1).alias("lines"))

    def counted(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"), repeat_words(words).cast("long").alias("n_repeat_words"))

    def by_line(lines: Column) -> Column:
        sized = F.transform(lines, lambda x: F.struct(x.alias("x"), F.char_length(F.regexp_replace(x, r"[\x20\x09-\x0D]+", "")).cast("long").alias("n")))
        full = F.filter(sized, lambda x: x["n"] > 0)
        return let(
            full,
            lambda f: let(
                F.filter(f, lambda x: ~bad_line(x["x"], x["n"], symbol_share, shout_share)),
                lambda good: F.struct(
                    (F.size(f) - F.size(F.array_distinct(F.transform(f, lambda x: x["x"])))).cast("long").alias("n_dup_lines"),
                    (F.size(f) - F.size(good)).cast("long").alias("n_bad_lines"),
                    F.aggregate(good, F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("good_chars"),
                    F.array_join(F.transform(good, lambda x: x["x"]), "\n").alias("clean"),
                ),
            ),
        )

    got = wide.select("doc_id", "text", let(F.col("words"), counted).alias("w"), let(F.col("lines"), by_line).alias("l"))
    failed = (F.col("w.n_words") < min_words) | (100 * F.col("w.n_repeat_words") > max_repeat_pct * F.col("w.n_words"))
    lost = F.when(F.col("w.word_chars") > 0, 1 - F.col("l.good_chars") / F.col("w.word_chars")).otherwise(F.lit(1.0))
    return got.select(
        "doc_id", F.col("l.clean").alias("text"), "w.n_words", "w.word_chars",
        count_of(F.col("text"), r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        "l.n_dup_lines", "w.n_repeat_words", failed.alias("base_failed"), "l.n_bad_lines", lost.alias("lost_share"),
        (~failed & (lost <= max_lost) & (F.col("l.good_chars") > 0)).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_bad_lines", "kept")
