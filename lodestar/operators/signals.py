"""Behaviour signals: decayed popularity, negative feedback, co-clicks, histories and attribution of clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators import coclicks

TAU, WINDOW_DAYS = 30 * 86400.0, 90
QUICK_MS, PENALTY = 3000, 0.5
#: Clickers of a service over which they are dealt in blocks of so many, and such services that are broadcast, at most.
HEAVY, MAX_HEAVY = 2_000, 100_000
#: Pairs of a user with a click on the same service that are formed as rows; beyond, profiles meet in blocks.
MAX_PAIRS = 5_000_000
#: Segments of time for attribution.
SEGMENTS = 32


def popularity_decayed(clicks: DataFrame, now: float, window_days: float = WINDOW_DAYS, tau: float = TAU) -> DataFrame:
    """(service_id, popularity): sum of exp(-age / tau) of clicks in the window. Deprecated clicks count."""
    recent = clicks.where(F.col("ts") >= now - window_days * 86400)
    return recent.groupBy("service_id").agg(F.sum(F.exp(-F.greatest(F.lit(0.0), now - F.col("ts")) / tau)).alias("popularity"))


def negative_signals(feedback: DataFrame, now: float, window_days: float = WINDOW_DAYS, quick_ms: int = QUICK_MS) -> DataFrame:
    """(service_id, negatives): visits shorter than quick_ms in the window."""
    return feedback.where((F.col("dwell_ms") < quick_ms) & (F.col("ts") >= now - window_days * 86400)).groupBy("service_id").agg(F.count("*").alias("negatives"))


def penalized(popularity: DataFrame, negatives: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """Popularity less penalty per negative, not under 0. A service with negatives alone enters with 0, but not if there
    is no popularity at all."""
    both = popularity.join(negatives, "service_id", "full_outer")
    any_popular = popularity.agg((F.count("*") > 0).alias("__any"))
    out = both.crossJoin(F.broadcast(any_popular)).where("__any")
    return out.select("service_id", F.greatest(F.lit(0.0), F.coalesce("popularity", F.lit(0.0)) - penalty * F.coalesce("negatives", F.lit(0))).alias("popularity"))


def collaborative(clicks: DataFrame, users: DataFrame | None = None, best: int | None = None) -> DataFrame:
    """(user_id, service_id, co_count): services clicked by users who share a clicked service with user_id, without those
    that user_id has clicked; co_count: how many such users. Deprecated clicks bridge, but are neither seed nor result.

    users (user_id): only for these. The plan starts from their services and goes outward, so that pairs of users
    are formed for those who ask alone. The clickers of a service that has more than HEAVY of them are dealt in blocks, so that
    its pairs are many tasks. Where the pairs, which are counted before, would be more than MAX_PAIRS, blocks of profiles meet instead
    (coclicks.py), and no pair is a row. Clicks without a user or a service take no part. best: only so many of each user, those of the
    largest counts, ties by service_id.
    """
    clicks = clicks.where("user_id IS NOT NULL AND service_id IS NOT NULL")
    live = clicks.where(~F.col("deprecated")).select("user_id", "service_id").distinct()
    seeds = live if users is None else live.join(users.select("user_id").distinct(), "user_id", "left_semi")
    bridging = clicks.select(F.col("user_id").alias("other"), "service_id").distinct()
    clickers = bridging.groupBy("service_id").agg(F.count("*").alias("n"))
    pairs = seeds.groupBy("service_id").agg(F.count("*").alias("m")).join(clickers, "service_id").agg(F.sum(F.col("m").cast("double") * F.col("n"))).first()[0]
    if pairs and pairs > MAX_PAIRS:
        return coclicks.by_profiles(clicks.select("user_id", "service_id", F.coalesce("deprecated", F.lit(True)).alias("deprecated")), users, best)
    heavy = clickers.where(F.col("n") > HEAVY).select("service_id", F.ceil(F.col("n") / HEAVY).cast("int").alias("blocks"))
    if heavy.limit(MAX_HEAVY + 1).count() <= MAX_HEAVY:
        heavy = F.broadcast(heavy)
    blocks = F.coalesce("blocks", F.lit(1))
    seeds, alone = seeds.join(heavy, "service_id", "left").select("user_id", "service_id", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")), seeds
    bridging = bridging.join(heavy, "service_id", "left").select("other", "service_id", F.pmod(F.xxhash64("other"), blocks).cast("int").alias("block"))
    pairs = seeds.join(bridging, ["service_id", "block"]).where(F.col("user_id") != F.col("other")).select("user_id", "other").distinct()
    theirs = live.select(F.col("user_id").alias("other"), "service_id")
    found = pairs.join(theirs, "other").groupBy("user_id", "service_id").agg(F.count("*").alias("co_count"))
    found = found.join(alone, ["user_id", "service_id"], "left_anti")
    if best is None:
        return found
    order = Window.partitionBy("user_id").orderBy(F.desc("co_count"), "service_id")
    return found.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= best).drop("__r")


def recent_distinct(rows: DataFrame, value: str, limit: int) -> DataFrame:
    """(user_id, value, rn): of each user's newest max(10 * limit, 50) rows, the newest distinct values, limit at most."""
    w = Window.partitionBy("user_id")
    newest = rows.withColumn("__n", F.row_number().over(w.orderBy(F.desc("id")))).where(F.col("__n") <= max(10 * limit, 50))
    first = newest.groupBy("user_id", value).agg(F.max("id").alias("__id"))
    return first.withColumn("rn", F.row_number().over(w.orderBy(F.desc("__id")))).where(F.col("rn") <= limit).drop("__id")


def as_of(left: DataFrame, right: DataFrame, value: str, keep: str = "id", segments: int = SEGMENTS) -> DataFrame:
    """left with, per row, the value and id of the newest row of right of the same user at or before its ts.

    Time is cut into segments with about as many rows each, and a user's rows of a segment are sorted together, those of right first at
    equal times. Into each segment the user's last row of right from the ones before is carried, so a user with most of all rows
    is many tasks. Nothing is multiplied. Rows without a time match nothing.
    """
    marks = left.select("user_id", "ts", F.col(keep).alias("__id"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__rid"), F.lit(None).cast(right.schema[value].dataType).alias("__value"), F.struct(*left.columns).alias("__row"))
    offers = right.select("user_id", "ts", F.col("id").alias("__id"), F.lit(0).alias("__side"), F.col("id").alias("__rid"), F.col(value).alias("__value"), F.lit(None).cast(marks.schema["__row"].dataType).alias("__row")).where("ts IS NOT NULL")
    cuts = sorted(set(left.select("ts").union(right.select("ts")).approxQuantile("ts", [i / segments for i in range(1, segments)], 0.005))) if segments > 1 else []
    cut = sum((F.when(F.col("ts") >= c, 1).otherwise(0) for c in cuts), F.lit(0)) if cuts else F.lit(0)
    marks, offers = marks.withColumn("__seg", cut), offers.withColumn("__seg", cut)
    every = marks.unionByName(offers)
    if cuts:
        last = offers.groupBy("user_id", "__seg").agg(F.max(F.struct("ts", "__id", "__rid", "__value")).alias("__last"))
        asked = marks.where("ts IS NOT NULL").select("user_id", "__seg", F.lit(True).alias("__asked")).distinct()
        # A user has as many rows here as segments.
        before = F.last("__last", ignorenulls=True).over(Window.partitionBy("user_id").orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1))
        carried = last.join(asked, ["user_id", "__seg"], "full_outer").withColumn("__last", before).where("__asked AND __last IS NOT NULL")
        every = every.unionByName(carried.select(
            "user_id", F.lit(None).cast(marks.schema["ts"].dataType).alias("ts"), F.lit(0).cast(marks.schema["__id"].dataType).alias("__id"), F.lit(0).alias("__side"), F.col("__last.__rid").alias("__rid"),
            F.col("__last.__value").alias("__value"), F.lit(None).cast(marks.schema["__row"].dataType).alias("__row"), "__seg",
        ))
    w = Window.partitionBy("user_id", "__seg").orderBy(F.col("ts").asc_nulls_first(), "__side", "__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timed = F.col("ts").isNotNull()
    seen = every.select("__side", "__row", F.when(timed, F.last("__rid", ignorenulls=True).over(w)).alias("matched_id"), F.when(timed, F.last(F.when(F.col("__rid").isNotNull(), F.struct("__value")), ignorenulls=True).over(w)).alias("m"))
    return seen.where("__side = 1").select("__row.*", "matched_id", F.col("m.__value").alias("matched"))
