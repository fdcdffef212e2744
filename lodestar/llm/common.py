"""Shared helpers: intermediate tables in the folder every executor sees, and text regexes of the data contracts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the data contracts: space and \t \n \v \f \r.
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A row id stands in for a null id while rows are compared; it sorts before every real id.
NULL_ID = -(2**63)

#: Rows and bytes in one Arrow batch of whole texts, at most: a batch of very long texts ends after the one that passes the bound.
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = 256, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it.

    Only where the setting is absent in local mode (tests) is a temporary folder made and set; on a cluster that is an error,
    as executors do not see a folder of the driver.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends there.

    A lost executor costs nothing, as the files are not on it. The files go when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Small Arrow batches for plans that hand whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, new: tuple[str, ...] = ()) -> tuple[Column, list[str]]:
    """(all columns of docs in one struct named row, their names), but for those that new ones replace.

    Inside the struct no name of the caller meets a name of an operator. Names are compared as Spark does, without case.
    """
    names = [c for c in docs.columns if c.lower() not in new]
    return F.struct(*[quoted(c).alias(c) for c in names]).alias("row"), names


def unpacked(names: list[str]) -> list[Column]:
    """The columns of packed() again."""
    return [F.col("row").getField(c).alias(c) for c in names]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; empty for null."""
    parts = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS)), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(v) where v is value computed once, also inside the lambdas of body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
