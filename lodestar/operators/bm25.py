"""BM25 over materialised postings, for one field or several weighted ones, and for whole batches of queries.

A query batch is joined with the postings on the term, so the work follows the postings that match, and one plan
serves any number of queries. Postings can be written bucketed by term for that join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import tokenize

K1, B = 1.5, 0.75


@dataclass
class Index:
    """postings (field, term, id, tf, dl), dl being the length of the field; lengths (field, weight, id, dl); fields (field, n, avgdl); terms (field, term, df)."""

    postings: DataFrame
    lengths: DataFrame
    fields: DataFrame
    terms: DataFrame


#: Distinct query terms that are broadcast to the documents.
MAX_TERMS = 100_000


def build(docs: DataFrame, wanted: DataFrame | None = None) -> Index:
    """docs: (id, field, weight, text), one row per document and field.

    wanted (term): for questions without a stored index, only the postings of these terms are formed. All others go before
    anything is grouped, so the shuffle follows the matches and not the texts. A counted list of terms is broadcast.
    """
    tokens = docs.select("id", "field", "weight", tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))
    terms = tokens.select("field", F.explode("tokens").alias("term"), "id", F.size("tokens").alias("dl"))
    if wanted is not None:
        few = wanted.select("term").distinct()
        terms = terms.join(F.broadcast(few) if few.count() <= MAX_TERMS else few, "term", "left_semi")
    postings = terms.groupBy("field", "term", "id", "dl").agg(F.count("*").alias("tf")).select("field", "term", "id", "tf", "dl")
    lengths = tokens.select("field", "weight", "id", F.size("tokens").alias("dl"))
    return Index(postings, lengths, _fields(lengths), _terms(postings))


def _fields(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("field", "weight").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def _terms(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def save(index: Index, path: str) -> None:
    """Write the index; postings lie in order of the term, so that a term lookup skips pages. They are dealt by term and id: a word of
    all documents is many tasks. Texts are taken apart for the postings and once for the lengths; the rest is counted from these."""
    read = index.postings.sparkSession.read.parquet
    index.postings.repartition("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    _fields(read(f"{path}/lengths")).write.mode("overwrite").parquet(f"{path}/fields")
    _terms(read(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/terms")


def load(spark, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "fields", "terms")])


def query_terms(batch: DataFrame, text_col: str = "text") -> DataFrame:
    """(query_id, term, qtf) of a batch; a repeated token counts as often as it occurs."""
    return batch.select("query_id", F.explode(tokenize(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def score(index: Index, terms: DataFrame) -> DataFrame:
    """(query_id, id, bm25) of documents that share a term with the query; all others score 0."""
    stats = index.terms.join(index.fields.where("avgdl > 0"), "field")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    wanted = terms.join(stats, "term").select("query_id", "field", "term", "avgdl", (F.col("weight") * F.col("qtf") * idf).alias("w"))
    # The words go to the postings, never the other way, however small the postings' file looks.
    hits = index.postings.hint("merge").join(wanted, ["field", "term"]) if terms.count() > MAX_TERMS else index.postings.join(F.broadcast(wanted), ["field", "term"])
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "id").agg(F.sum(F.col("w") * tf).alias("bm25"))


def top(scores: DataFrame, k: int, by: str = "bm25", tie: str = "id", key: str = "query_id", digits: int = 6) -> DataFrame:
    """The k best rows of each query, with rank; ties of the rounded score go by tie."""
    ranked = scores.withColumn(by, F.round(by, digits))
    ranked = ranked.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY {key} ORDER BY {by} DESC, {tie})"))
    return ranked.where(F.col("rank") <= k)
