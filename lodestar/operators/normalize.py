"""Score normalisation per group: min-max, rank and z-score. A group's rows are the keys that are present."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def close(a: Column, b: Column) -> Column:
    """True for values that count as equal."""
    return F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))


def minmax(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """(v - min) / (max - min); all 0 where the values are equal."""
    s = df.groupBy(*(by or [])).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    joined = df.join(s, by) if by else df.crossJoin(F.broadcast(s))
    return joined.withColumn(out, F.when(close(F.col("__hi"), F.col("__lo")), 0.0).otherwise((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))).drop("__lo", "__hi")


def zscore(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """(v - mean) / population deviation; 0 where that is 0."""
    s = df.groupBy(*(by or [])).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__std"))
    joined = df.join(s, by) if by else df.crossJoin(F.broadcast(s))
    return joined.withColumn(out, F.when(F.col("__std") == 0, 0.0).otherwise((F.col(value) - F.col("__mean")) / F.col("__std"))).drop("__mean", "__std")


def rank(df: DataFrame, value: str, out: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """(n - 1 - r) / (n - 1) by descending value, distinct ranks, ties by tie; 0 for a single row."""
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    n, r = F.expr(f"count(*) OVER ({part})"), F.expr(f"row_number() OVER ({part} ORDER BY {value} DESC, {tie})")
    return df.withColumn(out, F.when(n <= 1, 0.0).otherwise((n - r) / (n - 1)))
