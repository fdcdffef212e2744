"""From raw documents to token ids: five stages, each a DataFrame that is written and read again by the next.

Every stage takes all rows that the one before kept, nulls in any column included: a null text is an empty one, a null id
counts as the smallest, a null source is a source. Texts are never cut, however long. Of an empty table each stage makes an
empty one. Columns beyond those of documents are passed on by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, line_dedup, mixing, quality_classifier, similar, simhash
from lodestar.llm.common import quoted, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: a score of exactly the threshold stays.

    Empty texts have the score of no words. Repeated rows stay or go together. Without labels every score is one half, and
    nothing stays; the labels of an id that repeats count once.
    """
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; n_chars follows the text.

    Rows that share an id are one document, so repeated rows come out alike; an empty text stays empty.
    """
    out = line_dedup.dedup_lines(docs)
    # The operator's own columns go, unless documents had columns of those names.
    return out.select(*[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else quoted(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by fingerprints, that with the smallest id: the first pass of the stage.

    Texts without words are one group. Rows that repeat an id stay together.
    """
    return simhash.keep_one(docs)


def all_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the fingerprints leave, without the texts whose five-word shingles are 0.8 or more similar to another's.

    Similarity of exactly 0.8 counts. Of equal texts the row of the smallest id stays, and rows that repeat it with it.
    """
    return similar.keep_dissimilar(docs, ids=near_duplicates(spark, docs, sf_dir).select("doc_id"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as come in, with the sources' weights tempered as far as no source is used more than twice.

    Documents of small sources can come out twice. Texts without words cost nothing. Repeated rows are used equally often.
    """
    return mixing.realised(mixing.mix(docs, max_repeats=2.0, load=1.0), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their digests: doc_id, n_tokens, ids_sha256, decoded_sha256, ids.

    An empty text has no ids. Repeated rows come out alike.
    """
    encoded = bpe.encode(docs)
    return bpe.digests(encoded, "ids")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", all_near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: SQL cannot express the classifier, fingerprints and encoder; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What each stage returns is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
