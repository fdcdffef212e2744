"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction, and a vector passes it if its cosine to the direction is at least alpha: it lies in the cap around it.
Directions are the words of a structured random product code: the space, after a random rotation, is cut into a few blocks, each with
a short list of random unit vectors, and a direction takes one of each block. The filters that a vector passes are then list-decoded:
a partial choice is given up as soon as the best remaining blocks cannot lift it to alpha, so a vector never meets all directions.
Vectors as close as the threshold pass the same filter with a probability that does not depend on where they lie; alpha and the
number of directions follow from it and from the number of vectors (see code()).

Vectors meet filter by filter within their label, in blocks of bounded size, by a product of matrices, and every pair is counted in the
first filter that both pass. A block hands on counts and a spanning forest of its links, never pairs. Equal vectors are one
before they meet, so copies cost nothing more.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, stored
from .components import connected_components
from .permutation_index import usable

THRESHOLD = 0.98
#: Filters that two vectors at the threshold share, on average; they share none with a probability of about exp(-SHARED).
SHARED = 12
#: Vectors of a filter, on average; filters become more as vectors do.
PER_FILTER = 64
#: Vectors of a filter that meet in one block; a filter with more is dealt in blocks.
BLOCK = 1_024
#: Rows of small filters that one task call takes, about.
PACK = 16_384
#: Filters over BLOCK that are broadcast, at most; more are joined.
BROADCAST_FILTERS = 100_000
SEED = 20
#: Rows whose filters are decoded at once.
DECODE_ROWS = 512


@dataclass(frozen=True)
class Code:
    """A product code: rotation (d, d), for each block its unit vectors (entries, width), alpha, and the least filters of a vector."""

    rotation: np.ndarray
    blocks: tuple[np.ndarray, ...]
    alpha: float
    least: int

    @property
    def size(self) -> int:
        return math.prod(len(b) for b in self.blocks)


def _tail(d: int) -> tuple[np.ndarray, np.ndarray]:
    """(z, share of the unit sphere in d dimensions with a coordinate of at least z)."""
    angle = np.linspace(0, math.pi, 20_001)
    density = np.sin(angle) ** (d - 2) if d > 1 else np.where((angle < 1e-9) | (angle > math.pi - 1e-9), 1.0, 0.0)
    share = np.concatenate(([0.0], np.cumsum((density[1:] + density[:-1]) / 2)))
    return np.cos(angle), share / share[-1]


def shared_share(alpha: float, d: int, threshold: float) -> float:
    """The probability that a vector at cosine threshold to one in a cap lies in the cap too, for d of 2 and more."""
    z, share = _tail(d)
    inside = z >= alpha
    weight = np.diff(share[inside], prepend=0.0)
    if weight.sum() <= 0:
        return 0.0
    side = threshold * z[inside] + 0.0, math.sqrt(max(0.0, 1 - threshold**2)) * np.sqrt(np.maximum(0.0, 1 - z[inside] ** 2))
    # The rest of the move is a coordinate of a unit vector in d - 1 dimensions.
    need = np.where(side[1] > 0, (alpha - side[0]) / np.maximum(side[1], 1e-300), np.where(side[0] >= alpha, -2.0, 2.0))
    zz, rest = _tail(d - 1) if d > 2 else (np.array([1.0, 0.9999, -0.9999, -1.0]), np.array([0.5, 0.5, 0.5, 1.0]))
    p = np.interp(need, zz[::-1], rest[::-1], left=1.0, right=0.0)
    return float((weight * p).sum() / weight.sum())


def code(d: int, n: int, threshold: float = THRESHOLD, shared: float = SHARED, per_filter: int = PER_FILTER) -> Code:
    """The code for n vectors of d dimensions.

    A cap holds per_filter of n vectors spread evenly, or more where that would leave vectors at the threshold less than an even
    chance to share a cap; the number of directions is what lets such vectors share that many on average. Vectors that pass few
    filters take the nearest ones in any case, half of the average at least.
    """
    rnd = np.random.default_rng(SEED)
    z, share = _tail(d)
    alpha = float(np.interp(min(0.5, per_filter / max(n, 1)), share, z))
    if d > 1:
        while alpha > 0 and shared_share(alpha, d, threshold) < 0.5:
            alpha -= 0.01
    passes = float(np.interp(-alpha, -z, share))
    each = shared / (shared_share(alpha, d, threshold) if d > 1 else 1.0)
    directions = max(1.0, each / passes)
    m = 1
    while m < d // 8 and directions ** (1 / m) > 256:
        m += 1
    entries = max(1, math.ceil(directions ** (1 / m)))
    widths = [d * (i + 1) // m - d * i // m for i in range(m)]
    rotation = np.linalg.qr(rnd.standard_normal((d, d)))[0]
    blocks = []
    for w in widths:
        b = rnd.standard_normal((entries, w))
        blocks.append(b / np.linalg.norm(b, axis=1, keepdims=True) / math.sqrt(m))
    return Code(rotation, tuple(blocks), alpha, min(entries**m, max(1, math.ceil(each / 2))))


def _decode(products: list[np.ndarray], bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, cosine) of all words whose sum over the blocks is at least the row's bound, by row and word.

    Blocks are taken one after the other; a partial word goes on only if the largest products left can lift it to the bound.
    """
    rest = np.cumsum(np.stack([p.max(axis=1) for p in products])[::-1], axis=0)[::-1]
    rest = np.vstack([rest, np.zeros((1, rest.shape[1]))])
    row, word, total = np.arange(len(bound)), np.zeros(len(bound), np.int64), np.zeros(len(bound))
    for k, p in enumerate(products):
        step = max(1, 4_000_000 // p.shape[1])
        found = []
        for i in range(0, len(row), step):
            r = row[i : i + step]
            sums = total[i : i + step, None] + p[r]
            a, e = np.nonzero(sums >= (bound[r] - rest[k + 1][r])[:, None])
            found.append((r[a], word[i : i + step][a] * p.shape[1] + e, sums[a, e]))
        row, word, total = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (row, word, total)
    return row, word, total


def filters(x: np.ndarray, c: Code) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, words): the filters of each row of x, unit vectors: all of at least alpha, and the c.least nearest in any case; sorted."""
    counts, words = [], []
    for at in range(0, len(x), DECODE_ROWS):
        y = x[at : at + DECODE_ROWS] @ c.rotation
        cuts = np.cumsum([0, *[b.shape[1] for b in c.blocks]])
        products = [y[:, a:b] @ block.T for a, b, block in zip(cuts, cuts[1:], c.blocks, strict=False)]
        row, word, _ = _decode(products, np.full(len(y), c.alpha))
        n = np.bincount(row, minlength=len(y))
        # The bound is lowered for rows with too few, until they have enough, and of these the nearest are taken.
        bound, few = c.alpha, np.flatnonzero(n < c.least)
        while len(few):
            bound -= 0.05
            r, w, s = _decode([p[few] for p in products], np.full(len(few), max(bound, -1.0 - 1e-9)))
            got = np.bincount(r, minlength=len(few))
            done = (got >= c.least) | (bound < -1)
            take = done[r]
            order = np.lexsort((w[take], -s[take], r[take]))
            r, w = r[take][order], w[take][order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            r, w = r[place < c.least], w[place < c.least]
            keep = ~np.isin(row, few[done])
            row, word = np.concatenate([row[keep], few[r]]), np.concatenate([word[keep], w])
            few = few[~done]
        order = np.lexsort((word, row))
        row, word = row[order], word[order]
        counts.append(np.bincount(row, minlength=len(y)))
        words.append(word)
    return np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64), np.concatenate(words)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is divided out first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _links(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a and b, unit vectors, have a cosine of at least the threshold. Cosines next to it are summed again in one fixed order."""
    product = a @ b.T
    linked = product >= threshold
    near = np.nonzero(np.abs(product - threshold) < 1e-9)
    if len(near[0]):
        linked[near] = [math.fsum(u * v) >= threshold for u, v in zip(a[near[0]], b[near[1]], strict=True)]
    return linked


def _met_before(linked: np.ndarray, f: int, fa: list[np.ndarray], fb: list[np.ndarray]) -> np.ndarray:
    """Which of the linked pairs share a filter below f: these were counted there."""
    rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    out = np.zeros(linked.shape, bool)
    own = [fa[i][fa[i] < f] for i in rows] + [fb[j][fb[j] < f] for j in cols]
    values, n = np.unique(np.concatenate(own), return_counts=True)
    values = values[n > 1]
    if len(values):
        held = np.zeros((len(own), len(values)), np.float32)
        for i, w in enumerate(own):
            at = np.searchsorted(values, w)
            at[at == len(values)] = 0
            held[i, at[values[at] == w]] = 1
        out[np.ix_(rows, cols)] = held[: len(rows)] @ held[len(rows) :].T > 0
    return out


def _spanning(linked: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """(row, column) of a spanning forest of the links. same: rows and columns are the same vectors, and linked is symmetric."""
    left_rows, left_cols, out = linked.any(axis=1), linked.any(axis=0), []
    if same:
        for start in np.flatnonzero(left_rows):
            if left_rows[start]:
                left_rows[start] = False
                frontier = [start]
                while frontier:
                    at = frontier.pop()
                    found = np.flatnonzero(linked[at] & left_rows)
                    left_rows[found] = False
                    out += [(int(at), int(i)) for i in found]
                    frontier += found.tolist()
        return out
    for start in np.flatnonzero(left_rows):
        if left_rows[start]:
            left_rows[start] = False
            rows = [start]
            while rows:
                at = rows.pop()
                cols = np.flatnonzero(linked[at] & left_cols)
                left_cols[cols] = False
                for j in cols:
                    out.append((int(at), int(j)))
                    found = np.flatnonzero(linked[:, j] & left_rows)
                    left_rows[found] = False
                    out += [(int(i), int(j)) for i in found]
                    rows += found.tolist()
    return out


def meet(f: int, x: np.ndarray, held: list[np.ndarray], copies: np.ndarray, second: np.ndarray, both: bool, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(for each vector the copies of those linked to it, edges of a spanning forest) within one filter f.

    both: the vectors are of two blocks, those marked second of the other one, and only pairs of the two count.
    """
    n, edges = np.zeros(len(x), np.int64), []
    a, b = (np.flatnonzero(~second), np.flatnonzero(second)) if both else (np.arange(len(x)),) * 2
    if not len(a) or not len(b):
        return n, edges
    linked = _links(x[a], x[b], threshold)
    if not both:
        np.fill_diagonal(linked, False)
    if linked.any():
        linked &= ~_met_before(linked, f, [held[i] for i in a], [held[i] for i in b])
        n[a] += linked @ copies[b]
        if both:
            n[b] += linked.T @ copies[a]
        edges = [(int(a[i]), int(b[j])) for i, j in _spanning(linked, not both)]
    return n, edges


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """((id, h1, h2) of all rows, (h1, h2, id, label, v, copies) of the distinct vectors of each label that take part).

    id: of a distinct vector the smallest one. h1 and h2 name a vector with its label; h2 is null where it takes no part.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(kind).alias("v"))
    # Components are hashed as they are written: adding 0.0 makes -0.0 and 0.0 one.
    flat = F.transform("v", lambda c: c + F.lit(0.0).cast(kind[6:-1]))
    keyed = own.select(F.coalesce("id", F.lit(NULL_ID)).alias("id"), "label", F.when(F.col("label").isNotNull() & usable(F.col("v")), flat).alias("v"))
    part = F.col("v").isNotNull()
    keyed = keyed.withColumns({"h1": F.when(part, F.xxhash64("label", "v")).otherwise(F.xxhash64("id")), "h2": F.when(part, F.xxhash64(F.lit(1), "v", "label"))})
    groups = keyed.where(part).groupBy("h1", "h2").agg(F.min("id").alias("id"), F.any_value("label").alias("label"), F.any_value("v").alias("v"), F.count("*").alias("copies"))
    return keyed.select("id", "h1", "h2"), groups


def near_duplicate_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
    shared: float = SHARED, per_filter: int = PER_FILTER, block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links long, component_id, kept) of every row of vectors.

    Rows of equal labels link if their cosine, in double precision, is at least the threshold, a number in (0, 1). No link below it is
    ever made; of those at the very threshold, found ones are 97 to 100 of 100 for up to 1e9 vectors of 64 dimensions (more for fewer
    vectors and for closer ones), and equal vectors always link. Rows with a null label, and vectors that are null, empty, all zero or hold null or non-finite components,
    link with nothing, nor do vectors of different dimensions. Each row counts, also one that repeats id and vector. n_links: the other
    rows linked directly; component_id: the smallest id reachable, one's own included; kept: that is one's own id. Rows that repeat an id
    with another vector are each compared by their own. A null id counts as the smallest and gives a null component_id, and its row is kept. An empty table
    gives an empty result. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows, groups = distinct_vectors(vectors, id_col, vector_col, label_col)
    groups = stored(groups, "distinct")
    sizes = {r.d: r.n for r in groups.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    codes = {d: code(d, n, threshold, shared, per_filter) for d, n in sizes.items()}
    label = groups.schema["label"].dataType.simpleString()
    kind = groups.schema["v"].dataType.simpleString()

    def decode(batches):
        for b in batches:
            v = b.column(b.schema.get_field_index("v"))
            ends = v.offsets.to_numpy()
            flat, d = v.values.to_numpy(zero_copy_only=False).astype(np.float64), np.diff(ends)
            words = [None] * b.num_rows
            for size in np.unique(d):
                at = np.flatnonzero(d == size)
                x = unit(flat[ends[at][:, None] + np.arange(size)])
                offsets, found = filters(x, codes[int(size)])
                for i, s, e in zip(at, offsets, offsets[1:], strict=False):
                    words[i] = found[s:e]
            own = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)), pa.array(np.concatenate(words) if words else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns, own], names=[*b.schema.names, "filters"])

    # Few rows become many: deal them evenly first, by a count that adaptive execution does not lower.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.select("label", "h1", "h2", "id", "v", "copies").repartition(n)
    decoded = stored(dealt.mapInArrow(decode, f"label {label}, h1 long, h2 long, id long, v {kind}, copies long, filters array<long>"), "filters")

    # Key of a filter: its label and dimension are part of it.
    key = F.xxhash64("label", F.size("v"), "filter")
    held = decoded.withColumn("filter", F.explode("filters")).withColumn("key", key)
    large = stored(held.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large")
    if large.limit(BROADCAST_FILTERS + 1).count() <= BROADCAST_FILTERS:
        large = F.broadcast(large)
    total = decoded.agg(F.sum(F.size("filters"))).first()[0] or 0
    packs = max(1, math.ceil(total / PACK))
    blocks = F.coalesce("blocks", F.lit(1))
    spread = held.join(large, "key", "left").withColumn("own", F.pmod(F.xxhash64("h1", "h2", "id"), blocks).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # Small filters are packed, many to a call; each two blocks of a large one are a call of their own.
    group = [F.when(F.col("blocks").isNull(), F.pmod("key", F.lit(packs))).otherwise(F.col("key")).alias("pack"), F.coalesce("blocks", F.lit(0)).alias("nb"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    spread = spread.select(*group, "label", "filter", "id", "h1", "v", "copies", "filters", (F.col("own") > F.col("other")).alias("second"))
    schema = pa.schema([("id", pa.int64()), ("h1", pa.int64()), ("n", pa.int64()), ("peer", pa.int64())])

    def run(pack, table):
        both = pack[2].as_py() != pack[3].as_py()
        columns = {c: table[c].combine_chunks() for c in ("label", "filter", "id", "h1", "v", "copies", "filters", "second")}
        names = {}
        labels = np.array([names.setdefault(x, len(names)) for x in columns["label"].to_pylist()])
        f, ids, h1, copies = (columns[c].to_numpy() for c in ("filter", "id", "h1", "copies"))
        second = columns["second"].to_numpy(zero_copy_only=False)
        v_at, w_at = columns["v"].offsets.to_numpy(), columns["filters"].offsets.to_numpy()
        flat, words = columns["v"].values.to_numpy(zero_copy_only=False), columns["filters"].values.to_numpy()
        d = np.diff(v_at)
        order = np.lexsort((h1, ids, f, d, labels))
        change = np.flatnonzero((np.diff(labels[order]) != 0) | (np.diff(d[order]) != 0) | (np.diff(f[order]) != 0)) + 1
        out = []
        for at in np.split(order, change):
            if len(at) < 2:
                continue
            x = unit(flat[v_at[at][:, None] + np.arange(d[at[0]])].astype(np.float64))
            n, edges = meet(int(f[at[0]]), x, [words[w_at[i] : w_at[i + 1]] for i in at], copies[at], second[at], both, threshold)
            some = np.flatnonzero(n)
            out.append((ids[at[some]], h1[at[some]], n[some], np.full(len(some), NULL_ID), np.zeros(len(some), bool)))
            if edges:
                a, b = np.array(edges).T
                out.append((ids[at[a]], h1[at[a]], np.zeros(len(a), np.int64), ids[at[b]], np.ones(len(a), bool)))
        if not out:
            return schema.empty_table()
        i, h, n, peer, edge = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table([pa.array(i), pa.array(h), pa.array(n), pa.array(peer, mask=~edge)], schema=schema)

    found = stored(spread.groupBy("pack", "nb", "i", "j").applyInArrow(run, "id long, h1 long, n long, peer long"), "found")
    return _answer(rows, groups, found)


def _answer(rows: DataFrame, groups: DataFrame, found: DataFrame) -> DataFrame:
    """The result of near_duplicate_vectors from the counts and edges found."""
    counts = found.where("n > 0").groupBy("id", "h1").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where(F.col("peer").isNotNull()).select(F.col("id").alias("a"), F.col("peer").alias("b")))
    told = groups.select("id", "h1", "h2", "copies").join(counts, ["id", "h1"], "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    told = told.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component"))
    # The row of a vector with many copies is met by all of them: a plain equi-join, whose hot keys can be split.
    linked = rows.join(told, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return linked.select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(component != NULL_ID, component).alias("component_id"), (F.col("id") == component).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {THRESHOLD}
), reach AS (
  SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
), least AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, coalesce(l.root, e.vec_id) AS component_id, e.vec_id = coalesce(l.root, e.vec_id) AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN least l ON l.node = e.vec_id
"""
