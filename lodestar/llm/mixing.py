"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent between 0 (all alike) and 1 (as they come). The
exponent is bisected to meet a target entropy, then raised as far as the repetition limit asks. Weights become token
budgets, and a budget is realised by a permutation of the source's hash blocks: whole passes first, then whole blocks in
permuted order, then documents of the last block. All of it is joins and aggregates: a source of any size is spread over
its blocks, and the sources are never listed on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, quoted, stored, unpacked, words_of

BLOCKS = 4_096
#: Exponents tried in one job; four bits of the bisection each.
TRIED = 16
OUT = ("mix_tokens", "mix_weight", "mix_copies", "mix_block", "mix_order")


def moments(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(sum of p^t, sum of p^t ln p) over shares (p) for each exponent t."""
    row = shares.agg(*[F.sum(F.pow("p", F.lit(t))) for t in exponents], *[F.sum(F.pow("p", F.lit(t)) * F.log("p")) for t in exponents]).first()
    n = len(exponents)
    return [(row[i], row[n + i]) for i in range(n)]


def entropy(z: float, s: float, t: float) -> float:
    """Entropy of the weights p^t / z, where s is the sum of p^t ln p."""
    return math.log(z) - t * s / z


def find_exponent(shares: DataFrame, least_share: float, target_entropy: float | None, max_repeats: float | None, load: float, rounds: int = 8) -> float:
    """The exponent whose weights have the target entropy; if those repeat some source more than max_repeats times, the
    smallest one that does not. load: budget over all tokens. Both fall, or rise, with the exponent, so each round
    narrows an interval to a sixteenth. A target beyond what the exponents 0 and 1 give ends at the nearer of them.
    """

    def search(good) -> float:
        """The largest t, to within the last interval, below which good fails, where good fails up to some t and holds beyond it."""
        low, high = 0.0, 1.0
        for _ in range(rounds):
            ts = [low + (high - low) * i / TRIED for i in range(TRIED + 1)]
            ok = [good(t, z, s) for t, (z, s) in zip(ts, moments(shares, ts), strict=True)]
            if ok[0]:
                return ts[0]
            if not any(ok):
                return ts[-1]
            i = ok.index(True)
            low, high = ts[i - 1], ts[i]
        return high

    t = 0.0
    if target_entropy is not None:
        t = search(lambda t, z, s: entropy(z, s, t) <= target_entropy)
    if max_repeats is not None:
        # The smallest source repeats most: weight * budget / tokens.
        t = max(t, search(lambda t, z, s: least_share ** (t - 1) / z * load <= max_repeats * (1 + 1e-12)))
    return t


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_entropy: float | None = 0.97,
    max_repeats: float | None = 2.0, load: float | None = 1.0, blocks: int = BLOCKS, seed: int = 0,
) -> DataFrame:
    """docs with mix_tokens (words of the text), mix_weight (of the source), mix_copies (times that the row is to be used,
    0 or more), mix_block and mix_order (place of the block in the source's permutation, from 1) added.

    target_entropy is a share of the largest possible entropy, the logarithm of the number of sources with tokens. load is the budget
    as a multiple of all tokens; with None it is the largest one that uses no source more than max_repeats times. A source's
    budget is met to within its last document. A null source is a source of its own. Rows without words (null and empty
    texts too) cost nothing: they are used as often as their source's whole passes, and once more in a block that is taken.
    Rows that repeat id, text and source are one document: they share a block, are used equally often, and are counted before
    anything is ordered, so that no task holds them all. An empty table gives an empty result. Columns of docs with the names
    of the new ones, in any case, are replaced; all others are passed on.
    """
    row, keep = packed(docs, OUT)
    sized = docs.select(
        row,
        F.coalesce(F.concat(F.lit("="), quoted(source_col).cast("string")), F.lit("")).alias("source"),
        F.size(words_of(quoted(text_col).cast("string"))).cast("long").alias("mix_tokens"),
        F.xxhash64(quoted(id_col).cast("string"), quoted(text_col).cast("string")).alias("hash"),
    ).withColumn("mix_block", F.pmod("hash", F.lit(blocks)).cast("int"))
    units = stored(sized.groupBy("source", "mix_block", "hash").agg(F.sum("mix_tokens").alias("tokens")), "units")
    by_block = stored(units.groupBy("source", "mix_block").agg(F.sum("tokens").alias("tokens")), "blocks")
    sources = stored(by_block.groupBy("source").agg(F.sum("tokens").alias("supply")), "sources")
    total, n, smallest = sources.where("supply > 0").agg(F.sum("supply"), F.count("*"), F.min("supply")).first()
    total = total or 0
    shares = sources.where("supply > 0").select("source", "supply", (F.col("supply") / F.lit(float(total or 1))).alias("p"))
    exponent, z, fraction = 0.0, 1.0, 0.0
    if n:
        least = smallest / total
        exponent = find_exponent(shares, least, None if target_entropy is None else target_entropy * math.log(n), max_repeats if load is not None else None, load or 0)
        ((z, _),) = moments(shares, [exponent])
        fraction = load if load is not None else (max_repeats or 1.0) * z / least ** (exponent - 1)
    weighted = shares.withColumn("weight", F.pow("p", F.lit(exponent)) / z).withColumn("budget", F.round(F.col("weight") * (fraction * total)).cast("long"))
    plan = weighted.select("source", "weight", F.floor(F.col("budget") / F.col("supply")).alias("passes"), (F.col("budget") % F.col("supply")).alias("rest"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "source", "mix_block"), "mix_block")
    placed = by_block.withColumns({"mix_order": F.row_number().over(order), "before": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")})
    told = placed.join(plan, "source", "left").select("source", "mix_block", "mix_order", F.coalesce("weight", F.lit(0.0)).alias("mix_weight"), F.coalesce("passes", F.lit(0)).alias("passes"), (F.coalesce("rest", F.lit(0)) - F.col("before")).alias("left"))
    inside = Window.partitionBy("source", "mix_block").orderBy(F.xxhash64(F.lit(seed), "hash"), "hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = units.withColumn("before", F.sum("tokens").over(inside) - F.col("tokens")).join(told, ["source", "mix_block"])
    copies = (F.col("passes") + F.when(F.col("before") < F.col("left"), 1).otherwise(0)).cast("int").alias("mix_copies")
    used = dealt.select("source", "mix_block", "hash", "mix_weight", copies, "mix_order")
    return sized.join(used, ["source", "mix_block", "hash"]).select(*unpacked(keep), "mix_tokens", "mix_weight", "mix_copies", "mix_block", "mix_order")


def realised(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of mix()'s result as often as they are to be used, with those columns alone; rows with no use, or null, go.

    Repeated rows are repeated each. An empty table gives an empty result.
    """
    row = F.struct(*[quoted(c).alias(c) for c in columns]).alias("row")
    return mixed.where("mix_copies > 0").select(row, F.explode(F.sequence(F.lit(1), F.col("mix_copies"))).alias("use")).select(*unpacked(columns))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    got = mix(docs).select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight"), F.col("mix_copies").alias("copies"), F.col("mix_block").alias("block"), F.col("mix_order").alias("block_order"))
    return got
