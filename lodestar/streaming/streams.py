"""Structured Streaming forms of the monitoring and feedback operators. Each has a batch twin in lodestar.operators."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.operators import monitor as M

LOG = logging.getLogger(__name__)
EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of events from Parquet files as they come, with ts as a timestamp, which watermarks need."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumns({"ts": F.col("ts").cast("timestamp"), "k": F.get_json_object("props", "$.k").cast("int")})


def metrics_of(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("id"), "ts", (F.col("value") * 10).alias("total_ms"), (F.col("event_type") == "error").alias("error"), (F.col("k") % 3 == 0).alias("cache_hit"), (F.col("event_type") == "signup").alias("degraded"))


def windowed_metrics(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and means per window; an event more than `late` behind the newest is dropped and the window's state freed."""
    return M.windows(metrics_of(events.withWatermark("ts", late)), size, slide)


def click_backfill(searches: DataFrame, clicks: DataFrame, within: str = "1 hour") -> DataFrame:
    """searches (log_id, user_id, service_id, ts) joined to clicks (user_id, service_id, ts): a search without a click inside
    the interval comes out once the watermark has passed it."""
    s = searches.withWatermark("ts", within).alias("s")
    c = clicks.select(F.col("user_id").alias("c_user"), F.col("service_id").alias("c_service"), F.col("ts").alias("c_ts")).withWatermark("c_ts", within)
    on = (F.col("s.user_id") == F.col("c_user")) & (F.col("s.service_id") == F.col("c_service")) & (F.col("c_ts") >= F.col("s.ts")) & (F.col("c_ts") <= F.col("s.ts") + F.expr(f"INTERVAL {within}"))
    return s.join(c, on, "leftOuter").select("log_id", "s.user_id", "s.service_id", F.col("s.ts").alias("ts"), "c_ts")


def consecutive_failures(external: DataFrame) -> DataFrame:
    """external (id, service, ok) -> (service, consecutive) after each batch: state per service is one number."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("id")
        for ok in rows["ok"]:
            n = 0 if ok else n + 1
        state.update((n,))
        yield pd.DataFrame({"service": [key[0]], "consecutive": [n]})

    return external.groupBy("service").applyInPandasWithState(fold, "service string, consecutive long", "n long", "update", GroupStateTimeout.NoTimeout)


def rate_limited(requests: DataFrame, capacity: float) -> DataFrame:
    """requests (id, user_id, ts double) -> (id, user_id, allowed): the token bucket's level is the state of a user."""

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (float(capacity), None)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        allowed = []
        for ts in rows["ts"]:
            last = ts if last is None else last
            level, last = min(float(capacity), level + max(0.0, ts - last) * capacity / 60.0), ts
            ok = level >= 1.0
            level -= ok
            allowed.append(bool(ok))
        state.update((float(level), float(last)))
        yield rows[["id", "user_id"]].assign(allowed=allowed)

    return requests.groupBy("user_id").applyInPandasWithState(fold, "id long, user_id long, allowed boolean", "level double, last double", "append", GroupStateTimeout.NoTimeout)


def backoff(attempt: int, base_s: float = 0.5) -> float:
    """Seconds to wait after the attempt (from 0) that failed."""
    return base_s * 2**attempt


def alert_sink(send: Callable[[list[dict]], None], external: DataFrame | None = None, attempts: int = 3, base_s: float = 0.5) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over metrics_of(): evaluates the alert rules on each batch and hands what fires to send. Where send
    fails it is tried again, each time after twice the wait; what no attempt could send is logged, and the stream goes on.
    Alerts are a handful of rows."""

    def run(batch: DataFrame, number: int) -> None:
        calls = external if external is not None else batch.sparkSession.createDataFrame([], "id long, service string, ok boolean")
        fired = [r.asDict() for r in M.alerts(M.health(batch, calls), M.consecutive_failures(calls)).collect()]
        for attempt in range(attempts if fired else 0):
            try:
                return send(fired)
            except Exception:  # noqa: BLE001
                if attempt + 1 == attempts:
                    LOG.exception("alerts of batch %s not sent: %s", number, fired)
                else:
                    time.sleep(backoff(attempt, base_s))

    return run


def append_sink(df: DataFrame, path: str, checkpoint: str):
    """Appends a stream of behaviour rows (clicks, queries, feedback, logs) as Parquet, each batch once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
