"""The newest events as the state of a stream: health and realtime summaries after every batch, handed on as they come."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestar.operators import monitor as M
from lodestar.sources.shared import file_system

#: Events that a summary of the last minute looks back on, and parts that events are dealt to.
BUFFER, PARTS = 600, 16
EVENT = "id long, ts double, total_ms double, error boolean, cache_hit boolean, degraded boolean"
NAMES = [c.split()[0] for c in EVENT.split(", ")]
PART = f"part int, total long, errors long, hits long, {EVENT}"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """Of one part of the events: counts of all time, and the `keep` events of the largest ids. The state never grows beyond these."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "total long, errors long, hits long")
        self.newest = handle.getListState("newest", EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, errors, hits = self.counts.get() if self.counts.exists() else (0, 0, 0)
        held = pd.DataFrame(list(self.newest.get()), columns=NAMES)
        for batch in rows:
            total, errors, hits = total + len(batch), errors + int(batch["error"].eq(True).sum()), hits + int(batch["cache_hit"].eq(True).sum())
            # A null among the ids makes them floats, which the state would not take for a long.
            fresh = batch.loc[batch["id"].notna(), NAMES].astype({"id": "int64"})
            both = pd.concat([held, fresh]) if len(held) else fresh
            held = both.sort_values("id", ascending=False, kind="stable").head(self.keep)
        held = held.astype(object).where(held.notna(), None)
        self.counts.update((total, errors, hits))
        own = list(held.itertuples(index=False, name=None))
        if own:
            self.newest.put(own)
        out = held if own else pd.DataFrame([[None] * len(NAMES)], columns=NAMES)
        yield out.assign(part=key[0], total=total, errors=errors, hits=hits)[["part", "total", "errors", "hits", *NAMES]]

    def close(self) -> None:
        pass


def newest(metrics: DataFrame, keep: int = BUFFER, parts: int = PARTS) -> DataFrame:
    """A stream of metrics (id, ts, total_ms, error, cache_hit, degraded) -> PART rows of each part that a batch has touched.

    Events are dealt to parts by a hash of their id, so no task folds them all; the newest `keep` of all are among the newest `keep` of
    the parts, in whatever order they come. total, errors and hits are a part's counts of all time, the same on all of its rows. An
    event without an id counts but is never among the newest; a part without others is one row without an event. Null flags are
    no errors, no hits. A batch that comes again counts once, as state is committed with its batch. Mode: update.
    """
    ts = F.col("ts") if dict(metrics.dtypes)["ts"] == "double" else F.unix_micros("ts") / F.lit(1e6)
    own = metrics.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", ts.alias("ts"), F.col("total_ms").cast("double"), "error", "cache_hit", "degraded")
    return own.groupBy("part").transformWithStateInPandas(Newest(keep), PART, "update", "none")


def health(parts: DataFrame, external: DataFrame, recent: int = M.RECENT) -> DataFrame:
    """The summary of monitor.health() from the newest rows of all parts."""
    own = parts.select("part", "total", "errors", "hits").distinct()
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    life = own.agg(zero("total").alias("search_total"), zero("errors").alias("search_errors"), zero("hits").alias("hits"))
    return M.health_of(life, parts.where("id IS NOT NULL").orderBy(F.desc("id")).limit(recent), external)


def realtime(parts: DataFrame, now: float, window_s: float = 60.0, buffer: int = BUFFER) -> DataFrame:
    """The summary of monitor.realtime() from the newest rows of all parts, which must hold `buffer` events at least."""
    return M.realtime(parts.where("id IS NOT NULL"), now, window_s, buffer)


class Snapshots:
    """What all parts hold after each batch, as Parquet under path/batch=N: the rows of the batch and those of the parts it left
    alone. Written for foreachBatch: a batch that comes again writes its own folder anew, from the folder before it. Readers of the
    newest folder always find it whole; the last two stay."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, batch: DataFrame, number: int) -> DataFrame:
        spark, place = batch.sparkSession, f"{self.path}/batch={number}"
        # The batch is written before it is read twice, as to work it out again is to read the state again.
        own = f"{self.path}/_own"
        batch.write.mode("overwrite").parquet(own)
        fresh = spark.read.schema(PART).parquet(own)
        before = [n for n in self.numbers(spark) if n < number]
        if before:
            old = spark.read.schema(PART).parquet(f"{self.path}/batch={before[-1]}")
            fresh = fresh.unionByName(old.join(fresh.select("part").distinct(), "part", "left_anti"))
        fresh.coalesce(1).write.mode("overwrite").parquet(place)
        for n in before[:-1]:
            fs, at = file_system(spark, f"{self.path}/batch={n}")
            fs.delete(at, True)
        return spark.read.schema(PART).parquet(place)

    def numbers(self, spark: SparkSession) -> list[int]:
        """Numbers of the batches that are written whole."""
        fs, at = file_system(spark, self.path)
        if not fs.exists(at):
            return []
        names = [f.getPath().toString() for f in fs.listStatus(at) if f.getPath().getName().startswith("batch=")]
        return sorted(int(n.rsplit("=", 1)[1]) for n in names if fs.exists(file_system(spark, f"{n}/_SUCCESS")[1]))

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest rows of all parts; none before the first batch."""
        numbers = self.numbers(spark)
        return spark.read.schema(PART).parquet(f"{self.path}/batch={numbers[-1]}") if numbers else spark.createDataFrame([], PART)


@contextmanager
def _state_store(spark: SparkSession):
    """The store that this state needs, for the streams that start in this block; the session's other streams keep theirs."""
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old)


def watch(
    metrics: DataFrame, path: str, send: Callable[[dict], None] | None = None, external: Callable[[], DataFrame] | None = None,
    window_s: float = 60.0, now: Callable[[], float] = time.time, parts: int = PARTS, every: str | None = None,
):
    """Start a stream that keeps the newest metrics under path and after each batch hands send one dict: batch, health, realtime.

    every is the time between batches ("5 seconds"); without it what is there is read, and the stream ends. Its own place in the
    input is under path too, so a stream started again goes on where the last one was.
    """
    held = Snapshots(f"{path.rstrip('/')}/parts")

    def run(batch: DataFrame, number: int) -> None:
        rows = held.write(batch, number)
        if send:
            spark = batch.sparkSession
            calls = external() if external else spark.createDataFrame([], "service string, ok boolean")
            send({"batch": number, "health": health(rows, calls).first().asDict(), "realtime": realtime(rows, now(), window_s).first().asDict()})

    writer = newest(metrics, parts=parts).writeStream.outputMode("update").option("checkpointLocation", f"{path.rstrip('/')}/checkpoint").foreachBatch(run)
    with _state_store(metrics.sparkSession):
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
