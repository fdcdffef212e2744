"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import hashlib
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only in local mode, where it is unset, is a temporary one made and set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_scopes = threading.local()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that stored() writes in this block, in this thread, go when it ends. Results are to be stored after it."""
    outer, _scopes.paths = getattr(_scopes, "paths", None), []
    try:
        yield
    finally:
        for path in _scopes.paths:
            fs, at = file_system(spark, path)
            fs.delete(at.getParent(), True)
        _scopes.paths = outer


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read back: what later steps read more than once is worked out once.

    The lineage ends there, so a lost executor costs nothing. The files go with the block of passing() that they are written in, unless
    keep is set, or else when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    if getattr(_scopes, "paths", None) is not None and not keep:
        _scopes.paths.append(path)
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at.getParent())
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def version(spark: SparkSession, *paths: str) -> str:
    """A digest of the tables' files: names, sizes and times. Other files, another version."""
    told = hashlib.sha256()
    for path in paths:
        fs, at = file_system(spark, path)
        for f in sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)):
            told.update(repr(f).encode())
    return told.hexdigest()


def whole(spark: SparkSession, place: str, build: Callable[[str], None]) -> str:
    """place, a folder that build(folder) has written; built only where it isn't there yet.

    It is built beside its place and moved there whole, so a reader never sees a part of it, and of two writers one wins.
    """
    fs, at = file_system(spark, place)
    if not fs.exists(at):
        beside = f"{place}.{uuid.uuid4().hex}"
        build(beside)
        if not fs.exists(at):
            fs.rename(file_system(spark, beside)[1], at)
    return place


def kept(spark: SparkSession, name: str, of: str, build: Callable[[str], None]) -> str:
    """The folder of what build(folder) writes for version of, in the shared folder."""
    return whole(spark, f"{shared_dir(spark)}/lodestar/{name}/{of}", build)


def numbered(df: DataFrame, order: str | None = None) -> DataFrame:
    """df, stored, with no: 0, 1, 2, ... in the order of a column, or in any order; without all rows in one task."""
    if order:
        df = df.repartitionByRange(order).sortWithinPartitions(order)
    # The low 33 bits of the built-in id count within a partition; both are written down, so that they hold.
    df = df.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("__i"))
    df = stored(df, "numbered", keep=True)
    at, starts = 0, []
    for r in df.groupBy("__p").agg(F.count("*").alias("n")).orderBy("__p").collect():  # as many numbers as partitions
        starts.append((r["__p"], at))
        at += r.n
    starts = df.sparkSession.createDataFrame(starts, "__p int, __start long")
    return df.join(F.broadcast(starts), "__p").withColumn("no", F.col("__start") + F.col("__i")).drop("__p", "__i", "__start")
