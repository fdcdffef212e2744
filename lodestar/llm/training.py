"""Bounded samples of rows, from which the classifiers are fitted on the driver and pivots are chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes of rows are below this.
HASHES = 1 << 63


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; 0 for a null id."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % folds, F.lit(0)).cast("int")


def limit_of(most: int, n: int) -> int:
    """The hash below which about `most` of n rows are."""
    return HASHES if n <= most else max(1, HASHES * most // n)


def sizes(rows: DataFrame, id_col: str) -> tuple[int, int]:
    """(rows, about how many different ids, null being one of them)."""
    return rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(F.col(id_col)))).first()


def sample(rows: DataFrame, id_col: str, value_col: str, most: int, salt: str) -> DataFrame:
    """About `most` different (id, value) of rows at most, drawn by a hash of both, the same ones each time.

    Rows that repeat id and value count once, so neither a hot id nor rows without id can swell the sample or empty it.
    The values are read once, by the draw itself; only where ids repeat a lot are they read before, to be counted. Other
    columns are dropped.
    """
    n, ids = sizes(rows, id_col)
    hashed = rows.select(id_col, value_col, F.shiftrightunsigned(F.xxhash64(F.lit(salt), F.col(id_col), F.col(value_col)), 1).alias("hash_"))
    if 2 * ids < n:
        n = hashed.agg(F.approx_count_distinct("hash_", 0.02)).first()[0]
    if (below := limit_of(most, n)) < HASHES:
        hashed = hashed.where(F.col("hash_") < below)
    return hashed.dropDuplicates(["hash_"]).drop("hash_")


def labelled_ids(labels: DataFrame, label_col: str, keep: Column, most: int, id_col: str) -> DataFrame:
    """(__id, __label) of a sample of the labelled ids that keep admits, about `most` of them at most, to be broadcast.

    Rows without id or label are left out; of rows that repeat an id, one counts: the one with the smallest label.
    """
    known = labels.where(keep).select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__label")).dropna()
    one = known.groupBy("__id").agg(F.min("__label").alias("__label"))
    if (below := limit_of(most, one.count())) < HASHES:
        one = one.where(F.shiftrightunsigned(F.xxhash64(F.lit(label_col), "__id"), 1) < below)
    return F.broadcast(one)


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, keep: Column, most: int, id_col: str, text_col: str) -> DataFrame:
    """(__id, __text, __label) of labelled_ids(): one row for each id, of documents that share it the text of smallest hash."""
    own = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    got = own.join(labelled_ids(labels, label_col, keep, most, id_col), "__id")
    return got.groupBy("__id").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text"), F.first("__label").alias("__label"))
