"""Monitoring: percentiles, health, rolling windows, failures in a row and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Alert thresholds.
ERROR_RATE, P95_MS, CACHE_HIT, CONSECUTIVE, LEAST = 0.05, 1000.0, 0.30, 5, 5
RECENT = 100


def percentile(values: Column, p: float) -> Column:
    """Of an array: the element at index floor(n * p / 100) of the sorted values, the last at most; 0 if there are none."""
    n = F.size(values)
    at = F.least(F.floor(n * F.lit(p) / 100), n - 1).cast("int")
    return F.when(n > 0, F.get(F.sort_array(values), at)).otherwise(F.lit(0.0))


#: Buckets to a unit of the logarithm: values in one bucket differ by 0.4 % at most, and doubles have under 400,000 buckets.
LOG_BUCKETS = 256


def _bucket(v: Column) -> Column:
    """Number of the bucket of a double on a logarithmic scale; it never falls as v rises, NaN last."""
    at = F.signum(v).cast("long") * F.floor(F.log1p(F.abs(v)) * LOG_BUCKETS)
    return F.when(F.isnan(v), F.lit(2**63 - 1)).otherwise(at)


def ranked_percentiles(counts: DataFrame, by: str, ps=(50, 95, 99)) -> DataFrame:
    """counts (by, v, n), how often each value occurs -> (by, n, p..): the percentiles of percentile(), over any number of values.

    Values are ranked inside buckets, and buckets among themselves, so no task holds all values of a group; a value that
    occurs often is one row.
    """
    placed = counts.withColumn("bucket", _bucket(F.col("v")))
    among = Window.partitionBy(by).orderBy("bucket")
    sums = placed.groupBy(by, "bucket").agg(F.sum("n").alias("m"))
    sums = sums.withColumns({"before": F.sum("m").over(among) - F.col("m"), "total": F.sum("m").over(Window.partitionBy(by))})
    # Only buckets that hold a wanted place are ranked inside.
    places = [F.least(F.floor(F.col("total") * p / 100), F.col("total") - 1) for p in ps]
    held = F.lit(False)
    for at in places:
        held = held | ((at >= F.col("before")) & (at < F.col("before") + F.col("m")))
    inside = Window.partitionBy(by, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = placed.join(sums.where(held), [by, "bucket"]).withColumn("upto", F.col("before") + F.sum("n").over(inside))
    return found.groupBy(by).agg(F.max("total").alias("n"), *[F.round(F.min(F.when(F.col("upto") > at, F.col("v"))), 6).alias(f"p{p}") for p, at in zip(ps, places, strict=True)])


def latency_percentiles(metrics: DataFrame, ps=(50, 95, 99)) -> DataFrame:
    """One row: percentiles of total_ms, 0 where there are no events. Null totals do not count."""
    counts = metrics.where(F.col("total_ms").isNotNull()).groupBy(F.lit(0).alias("g"), F.col("total_ms").cast("double").alias("v")).agg(F.count("*").alias("n"))
    return ranked_percentiles(counts, "g", ps).agg(*[F.coalesce(F.max(f"p{p}"), F.lit(0.0)).alias(f"p{p}") for p in ps])


def stage_percentiles(metrics: DataFrame, ps=(50, 95, 99)) -> DataFrame:
    """(stage, n, p50, p95, p99) over events with stages; an event without that stage counts as 0."""
    seen = metrics.where(F.size("stages") > 0)
    counts = seen.select(F.explode("stages").alias("stage", "x")).groupBy("stage", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("v")).agg(F.count("*").alias("n"))
    # Events without a stage are not listed: they are as many zeros as the stage's own events leave.
    rest = counts.groupBy("stage").agg(F.sum("n").alias("own")).join(F.broadcast(seen.agg(F.count("*").alias("events"))), F.lit(True))
    zeros = rest.where("events > own").select("stage", F.lit(0.0).alias("v"), (F.col("events") - F.col("own")).alias("n"))
    return ranked_percentiles(counts.unionByName(zeros), "stage", ps)


def health(metrics: DataFrame, external: DataFrame, recent: int = RECENT) -> DataFrame:
    """One row: counts and rates of all time, and of the newest events."""
    life = metrics.agg(F.count("*").alias("search_total"), F.count_if("error").alias("search_errors"), F.count_if("cache_hit").alias("hits"))
    return health_of(life, metrics.orderBy(F.desc("id")).limit(recent), external)


def health_of(life: DataFrame, last: DataFrame, external: DataFrame) -> DataFrame:
    """health() from one row of counts (search_total, search_errors, hits) and the newest events."""
    now = last.agg(F.count("*").alias("recent_total"), F.count_if("error").alias("re"), F.count_if("degraded").alias("rd"), F.collect_list("total_ms").alias("v"))
    ext = external.agg(F.count_if("ok").alias("ok"), F.count("*").alias("calls"))

    def rate(a: str, b: str, empty: float = 0.0) -> Column:
        return F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(empty)), 4)

    return life.crossJoin(now).crossJoin(ext).select(
        "search_total", "search_errors", rate("search_errors", "search_total").alias("error_rate"), rate("hits", "search_total").alias("cache_hit_rate"),
        "recent_total", rate("re", "recent_total").alias("recent_error_rate"), rate("rd", "recent_total").alias("recent_degraded_rate"),
        F.round(percentile(F.col("v"), 95), 6).alias("p95_ms"), rate("ok", "calls", 1.0).alias("external_success_rate"),
    )


def realtime(metrics: DataFrame, now: float, window_s: float = 60.0, buffer: int = 600) -> DataFrame:
    """One row over the newest `buffer` events that are in the window: qps, rates and percentiles."""
    last = metrics.orderBy(F.desc("id")).limit(buffer).where(F.col("ts") >= now - window_s)
    s = last.agg(F.count("*").alias("n"), F.count_if("error").alias("e"), F.count_if("cache_hit").alias("h"), F.count_if("degraded").alias("d"), F.collect_list("total_ms").alias("v"))
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0)), 4)
    return s.select(F.col("n").alias("events"), F.round(F.col("n") / window_s, 4).alias("qps"), rate("e").alias("error_rate"), rate("h").alias("cache_hit_rate"), rate("d").alias("degraded_rate"), *[F.round(percentile(F.col("v"), p), 6).alias(f"p{p}") for p in (50, 95, 99)])


def windows(metrics: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """Counts and means per tumbling or sliding window of event time; the same expression serves batch and stream."""
    at = metrics if dict(metrics.dtypes)["ts"] == "timestamp" else metrics.withColumn("ts", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return at.groupBy(w).agg(F.count("*").alias("n"), F.count_if("error").alias("errors"), F.round(F.avg("total_ms"), 6).alias("avg_ms")).select(F.col("window.start").alias("start"), "n", "errors", "avg_ms")


def consecutive_failures(external: DataFrame) -> DataFrame:
    """(service, consecutive): failures after the last success."""
    last_ok = external.groupBy("service").agg(F.coalesce(F.max(F.when(F.col("ok"), F.col("id"))), F.lit(-1)).alias("last_ok"))
    return external.join(last_ok, "service").groupBy("service").agg(F.count_if(F.col("id") > F.col("last_ok")).alias("consecutive"))


def alerts(health_row: DataFrame, failures: DataFrame) -> DataFrame:
    """(level, rule, subject, value) of the rules that fire; rates need LEAST recent searches."""
    enough = health_row.where(F.col("recent_total") >= LEAST)
    out = [
        enough.where(F.col("recent_error_rate") > ERROR_RATE).select(F.lit("ERROR").alias("level"), F.lit("error_rate").alias("rule"), F.lit("").alias("subject"), F.col("recent_error_rate").cast("double").alias("value")),
        enough.where(F.col("p95_ms") > P95_MS).select(F.lit("WARN"), F.lit("p95_latency"), F.lit(""), F.col("p95_ms")),
        enough.where(F.col("cache_hit_rate") < CACHE_HIT).select(F.lit("WARN"), F.lit("cache_hit_rate"), F.lit(""), F.col("cache_hit_rate")),
        failures.where(F.col("consecutive") >= CONSECUTIVE).select(F.lit("ERROR"), F.lit("external_consecutive_fail"), F.col("service"), F.col("consecutive").cast("double")),
    ]
    first = out[0]
    for more in out[1:]:
        first = first.union(more)
    return first


def exposition(health_row: DataFrame, external: DataFrame, prefix: str = "search") -> DataFrame:
    """(line) in the text format of metric scrapers."""
    h = health_row.select(F.explode(F.array(
        F.format_string(f"{prefix}_total %d", "search_total"), F.format_string(f"{prefix}_errors_total %d", "search_errors"),
        F.format_string(f'{prefix}_latency_seconds{{quantile="0.95"}} %.6f', F.col("p95_ms") / 1000.0),
    )).alias("line"))
    e = external.groupBy("service", F.when(F.col("ok"), "ok").otherwise("fail").alias("status")).agg(F.count("*").alias("n"))
    return h.union(e.select(F.format_string(f'{prefix}_external_call_total{{service="%s",status="%s"}} %d', "service", "status", "n")))


def token_bucket(requests: DataFrame, capacity: float, by: str = "user_id") -> DataFrame:
    """(id, by, allowed): a bucket of capacity tokens per key, refilled by capacity / 60 a second, one token a request.

    The level after a request depends on all before it, so each key's requests are folded in order; a key's requests
    are streamed through its fold in batches and never held together.
    """

    def run(batches):
        key = level = last = None
        for b in batches:
            allowed = []
            for k, ts in zip(b[by], b["ts"], strict=True):
                if k != key:
                    key, level, last = k, float(capacity), ts
                level, last = min(float(capacity), level + max(0.0, ts - last) * capacity / 60.0), ts
                ok = level >= 1.0
                level -= ok
                allowed.append(bool(ok))
            yield b[["id", by]].assign(allowed=allowed)

    dealt = requests.select("id", by, "ts").repartition(by).sortWithinPartitions(by, "ts", "id")
    return dealt.mapInPandas(run, f"id long, {by} {requests.schema[by].dataType.simpleString()}, allowed boolean")


def cache_hits(requests: DataFrame, ttl_s: float = 60.0) -> DataFrame:
    """requests (id, key, ts) with hit: the previous request of the same key was at most ttl_s ago."""
    w = Window.partitionBy("key").orderBy("ts", "id")
    return requests.withColumn("hit", F.coalesce(F.col("ts") - F.lag("ts").over(w) <= ttl_s, F.lit(False)))


def sessionize(rows: DataFrame, gap_s: float, by: str = "user_id") -> DataFrame:
    """(by, session, start, end, n) of runs without a gap over gap_s."""
    w = Window.partitionBy(by).orderBy("ts", "id")
    marked = rows.withColumn("__new", F.coalesce((F.col("ts") - F.lag("ts").over(w) > gap_s).cast("int"), F.lit(1)))
    numbered = marked.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(by, "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
