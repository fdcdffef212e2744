"""Line dedup: lines found in several documents stay only in the first of them.

Normalised lines are exploded to two 64-bit hashes and counted by document; only the hashes, ids and positions are
shuffled, never the lines, and each document is then reassembled from its own lines by position. Native operators
only. A line that a third of all documents hold is counted by partial aggregates, and the join that brings the
verdict back is a plain equi-join, whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, SPACE_CHARS, ascii_lower, packed, quoted, stored, unpacked

_OWN = ("__id", "__text_hash")
#: Lines with more than this part of all occurrences of shared lines are broadcast; there cannot be more of them than this.
HOT = 1_000


def line_key(line: Column) -> Column:
    """A line as it is compared: white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """lines (h1, h2, __id) -> (h1, h2, first, n) of the keys in at least min_docs distinct documents; first: smallest id, n: how
    often the key occurs (for min_docs over 2, in how many documents)."""
    if min_docs == 2:
        return lines.groupBy("h1", "h2").agg(F.min("__id").alias("first"), F.max("__id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    once = lines.select("h1", "h2", "__id").distinct()
    return once.groupBy("h1", "h2").agg(F.min("__id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)


def verdicts(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """lines with first, the document that keeps the key, for keys of shared, and null for all others."""
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = shared.where(F.col("n") > total / HOT).select("h1", "h2", F.col("first").alias("hot_first"))
    marked = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    # A row whose verdict is known goes anywhere: its key is replaced by one of its own.
    known = F.col("hot_first").isNotNull()
    dealt = marked.withColumns({"h1": F.when(known, F.xxhash64(*_OWN, "pos")).otherwise(F.col("h1"))})
    return dealt.join(shared.drop("n"), ["h1", "h2"], "left").withColumn("first", F.coalesce("hot_first", "first"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """docs with text_col deduplicated, and the columns n_lines and n_dropped (long) added.

    A text is cut at \\n; null and empty texts are one empty line. Lines whose key has at least min_chars code points
    and is found in at least min_docs documents are dropped everywhere but in the document with the smallest id that
    holds the key, where all of them stay. Other lines stay, joined by \\n; with none left the text is empty.
    Documents are told apart by id: rows that share an id are one document, repeated rows come out alike. A null id
    counts as one id smaller than all others. An empty table gives an empty result. Other columns are passed on;
    those with the names of the new ones, in any case, are replaced.
    """
    row, keep = packed(docs, ("n_lines", "n_dropped"))
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    names = (F.coalesce(quoted(id_col).cast("long"), F.lit(NULL_ID)).alias("__id"), F.xxhash64(text).alias("__text_hash"))
    keyed = docs.select(row, *names)
    keys = docs.select(*names, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).select(*_OWN, "pos", line_key(F.col("line")).alias("key"))
    lines = keys.where(F.char_length("key") >= min_chars).select(*_OWN, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    hits = verdicts(lines, stored(shared_lines(lines, min_docs), "shared_lines")).where(F.col("__id") != F.col("first"))
    drops = hits.groupBy(*_OWN).agg(F.collect_set("pos").alias("__drops"))
    # The text meets its drops whole, and is cut again behind the shuffle: its lines don't travel beside it.
    whole = F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit(""))
    found = keyed.join(drops, list(_OWN), "left").withColumn("__lines", F.split(whole, "\n", -1))
    n, dropped = F.size("__lines"), F.coalesce(F.col("__drops"), F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), n - 1), dropped)
    new = F.when(F.col("__drops").isNull(), F.array_join("__lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n"))
    return found.select(
        *[new.alias(c) if c == text_col else own for c, own in zip(keep, unpacked(keep), strict=True)],
        n.cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, k.pos, k.line, s.first IS NOT NULL AND k.doc_id <> s.first AS dropped
  FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
