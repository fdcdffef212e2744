"""Approximate nearest neighbours by a permutation index.

A vector is represented by its pivots in order of nearness. Each block of rows keeps an inverted file: for every pivot
the places that it has in the permutations of the block's rows. A query adds up, pivot by pivot, how far its own places
are from those (Spearman's footrule), keeps the rows that rank first, and reranks them by exact inner products.

Queries meet rows block by block: a task holds one block of rows and one block of queries, both of bounded size, and
hands on the best few rows of each query alone. Nothing is broadcast but the pivots, whose number is a parameter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .training import sample

PIVOTS = 128
#: Rows that pivots are drawn from, at most (about).
PIVOT_SAMPLE = 4_096
#: Share of a block's rows that is reranked for a query, and the least number.
RERANKED, LEAST_RERANKED = 0.25, 200
ROW_BLOCK, QUERY_BLOCK = 8_192, 512


def usable(vector: Column) -> Column:
    """True for a vector that takes part: not null, not empty, not all zero, every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def permutations(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each row, the place of each pivot in the order of nearness (ties: lower pivot first)."""
    order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")
    place = np.empty(order.shape, np.int16 if len(pivots) < 256 else np.int64)
    np.put_along_axis(place, order, np.arange(len(pivots), dtype=place.dtype)[None, :].repeat(len(x), 0), 1)
    return place


def choose_pivots(sample: list[tuple[int, list[float]]], most: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots by dimension: of the sampled vectors, in order of a hash of the id, the first distinct ones."""
    by: dict[int, dict[tuple, None]] = {}
    for _, v in sample:
        own = by.setdefault(len(v), {})
        if len(own) < most:
            own.setdefault(tuple(v))
    return {d: np.array(list(own)) for d, own in by.items()}


def search_block(ids: np.ndarray, x: np.ndarray, lifted: np.ndarray, query_ids: np.ndarray, q: np.ndarray, pivots: np.ndarray | None, k: int, share: float, least: int):
    """(query_id, vec_id, score) of the k best rows of the block for each query, by footrule and then exactly.

    Rows whose footrule equals the last one taken are all reranked, so no row is lost to a tie. lifted has one more
    component, which makes all rows of the corpus equally long, so that the nearest is the one of largest product.
    """
    n = len(ids)
    take = min(n, max(least, math.ceil(share * n)))
    if pivots is not None:
        lists = np.ascontiguousarray(permutations(lifted, pivots).T)  # the inverted file: pivot -> places in the rows
        wanted = permutations(np.hstack([q, np.zeros((len(q), 1))]), pivots)
    out = []
    for i in range(len(q)):
        rows = np.arange(n)
        if pivots is not None and take < n:
            rule = np.zeros(n, np.int16 if len(pivots) < 256 else np.int64)  # a footrule is at most half the square of the pivots
            for p in range(len(pivots)):
                rule += np.abs(lists[p] - wanted[i, p])
            rows = np.nonzero(rule <= np.partition(rule, take - 1)[take - 1])[0]
        rows = rows[ids[rows] != query_ids[i]]
        score = (x[rows] * q[i]).sum(axis=1)
        if len(rows) > k:
            near = score >= np.partition(score, len(rows) - k)[len(rows) - k]
            rows, score = rows[near], score[near]
        best = np.lexsort((ids[rows], -score))[:k]
        out.append((np.full(len(best), query_ids[i]), ids[rows[best]], score[best]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else None


def search(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
    share: float = RERANKED, least: int = LEAST_RERANKED, pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank int from 1, vec_id, score double): the k nearest rows found for every row that is_query admits.

    Nearness is the largest inner product, in double precision, ties going to the smaller id; a row is never its own
    neighbour. Vectors that are null, empty, all zero or hold null or non-finite components take no part; nor do rows
    without an id. Rows that repeat id and vector are one row. Vectors of different dimensions do not meet. With fewer
    than k other rows all of them are returned. An empty table gives an empty result. Every row is indexed and is
    a candidate in its block; the pivots come from a bounded sample. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    own = stored(own.where(F.col("id").isNotNull() & usable(F.col("v"))).dropDuplicates(["id", "v"]), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    stats = own.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("asks").alias("asks"), F.max(square).alias("longest")).collect()
    longest = {r.d: r.longest for r in stats}
    drawn = sorted((r[0], r[1], r[2]) for r in sample(own, "id", "v", PIVOT_SAMPLE, "pivots").select(F.xxhash64("id"), "id", "v").collect())
    chosen = {}
    for d, p in choose_pivots([(i, v) for _, i, v in drawn], pivots).items():
        chosen[d] = np.hstack([p, np.sqrt(np.maximum(longest[d] - (p * p).sum(1), 0))[:, None]])
    # Blocks by a hash of the id, as many as the rows ask for. The numbers of blocks are scalars of each dimension.
    blocks = {r.d: (max(1, math.ceil(r.n / ROW_BLOCK)), max(1, math.ceil(r.asks / QUERY_BLOCK))) for r in stats}

    def per_dimension(which: int) -> Column:
        out = F.lit(1)
        for d, b in blocks.items():
            out = F.when(F.size("v") == d, F.lit(b[which])).otherwise(out)
        return out

    sized = own.withColumns({"d": F.size("v"), "nr": per_dimension(0), "nq": per_dimension(1)})
    rows = sized.select("d", F.pmod(F.xxhash64("id"), "nr").cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), "id", "v", F.lit(False).alias("asks"))
    asking = sized.where("asks").select("d", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("rb"), F.pmod(F.xxhash64("id"), "nq").cast("int").alias("qb"), "id", "v", F.lit(True).alias("asks"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(key, table):
        d = key[0].as_py()
        ids, asks = table["id"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)
        x = table["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), d)
        order = np.argsort(ids, kind="stable")
        ids, x, asks = ids[order], x[order], asks[order]
        r, q = x[~asks], x[asks]
        lifted = np.hstack([r, np.sqrt(np.maximum(longest[d] - (r * r).sum(1), 0))[:, None]])
        got = search_block(ids[~asks], r, lifted, ids[asks], q, chosen.get(d), k, share, least) if len(r) and len(q) else None
        return pa.Table.from_arrays([pa.array(c) for c in got], schema=schema) if got else schema.empty_table()

    found = rows.unionByName(asking).groupBy("d", "rb", "qb").applyInArrow(run, "query_id long, vec_id long, score double")
    ranked = found.distinct().select("query_id", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)").alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
