"""Vectors in cells around pivots, and the exact nearest-neighbour join over them.

Each vector goes to the nearest of a bounded number of pivots. A cell is cut into shells by the angle to its pivot, and a shell
knows the smallest and largest angle in it. By the triangle inequality of angles, no vector of a shell is nearer to a question at
angle t from the pivot than max(0, t - largest, smallest - t). So a question first meets the shells with the best bounds, until they hold enough
vectors, and then only those whose bound is not below the k-th cosine found. What it does not meet cannot be among the best.

Vectors that are spread evenly bound nothing, and every question meets every shell, as in a plain product of blocks; the nearer
vectors lie together, the fewer shells are met.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lodestar.sources.shared import stored

#: Pivots, at most, and vectors of a cell, on average, while pivots suffice. A question that bounds nothing meets every shell, so
#: shells are not made small for their own sake.
MAX_PIVOTS, CELL = 1_024, 2_048
#: Bands of equal angles around a pivot; neighbours are joined to shells of half a cell's vectors or more.
SHELLS = 64
#: Vectors that meet questions in one block, shells being packed together, and questions that they meet at a time: a vector is sent once for
#: each block of the other side, so what is shuffled is the product of both sides over this.
BLOCK, QUESTIONS = 16_384, 16_384
#: Cosines or bounds that a task works out at a time, and rows that it sends on at a time.
BOUNDS, SENT = 2**21, 4_096
#: Cosines are compared after rounding to this many digits; bounds are widened by as much.
DIGITS, MARGIN = 6, 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def choose_pivots(vectors: DataFrame, n: int, vector_col: str = "vec", most: int = MAX_PIVOTS, per_cell: int = CELL) -> np.ndarray:
    """Pivots for n vectors: those of the smallest hashes, one for every per_cell vectors and at most so many; the same each time."""
    count = max(1, min(most, math.ceil(n / per_cell)))
    drawn = vectors.select(F.xxhash64(vector_col).alias("h"), F.col(vector_col).cast("array<double>").alias("v")).orderBy("h", "v").limit(count).collect()
    if not drawn:
        return np.zeros((0, 0))
    x = unit(np.array([r.v for r in drawn], np.float64))
    return np.unique(x[(x != 0).any(axis=1)], axis=0)


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angle of each row of x to each pivot; rows of zeros are at a right angle to all."""
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def assigned(vectors: DataFrame, pivots: np.ndarray, vector_col: str = "vec") -> DataFrame:
    """vectors with cell (the nearest pivot; of several the first) and angle to it. Rows of zeros are in cell -1, at a right angle."""
    schema = StructType([*vectors.schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())])
    at = vectors.columns.index(vector_col)

    def run(batches):
        for b in batches:
            x = unit(matrix(b.column(at)))
            cell, angle = np.full(len(x), -1, np.int32), np.full(len(x), math.pi / 2)
            if len(x) and len(pivots):
                a = angles(x, pivots)
                some = (x != 0).any(axis=1)
                cell[some], angle[some] = a.argmin(axis=1)[some], a.min(axis=1)[some]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], names=[*b.schema.names, "cell", "angle"])

    return vectors.mapInArrow(run, schema)


def bounds(x: np.ndarray, pivots: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest cosine that each row of x can have to a vector of each shell (cell, smallest and largest angle to its pivot)."""
    out = np.zeros((len(x), len(cell)))
    real = cell >= 0
    if real.any():
        t = angles(x, pivots)[:, cell[real]]
        out[:, real] = np.cos(np.maximum(0.0, np.maximum(t - high[real], low[real] - t)))
    out[~(x != 0).any(axis=1)] = 0.0  # a question of zeros has a cosine of 0 to everything
    return out + 1e-9


@dataclass(frozen=True)
class Shells:
    """Pivots, and of each shell, a band of a cell, the cell, the smallest and largest angle, how many vectors and in how many parts."""

    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray
    parts: np.ndarray


@dataclass(frozen=True)
class Cells:
    """rows (id, vec, shell, part) and their shells."""

    rows: DataFrame
    shells: Shells


def build(rows: DataFrame, block: int = BLOCK, per_cell: int = CELL) -> Cells:
    """Cells of rows (id, vec), all of one dimension."""
    own = rows.select("id", F.col("vec").cast("array<double>").alias("vec"))
    pivots = choose_pivots(own, own.count(), per_cell=per_cell)
    width = math.pi / SHELLS
    placed = stored(assigned(own, pivots).withColumn("band", F.floor(F.col("angle") / F.lit(width)).cast("int")), "cells")
    bands = placed.groupBy("cell", "band").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).orderBy("cell", "band").collect()
    shells, least = [], max(1, per_cell // 2)
    for r in bands:
        if shells and shells[-1][0].cell == r.cell and sum(x.n for x in shells[-1]) < least:
            shells[-1].append(r)
        else:
            shells.append([r])
    n = np.array([sum(r.n for r in own) for own in shells], np.int64)
    parts = -(-n // block)
    # As many rows as bands: at most MAX_PIVOTS times SHELLS, and one for zeros.
    names = [(r.cell, r.band, i, int(p)) for i, (own, p) in enumerate(zip(shells, parts, strict=True)) for r in own]
    names = rows.sparkSession.createDataFrame(names, "cell int, band int, shell int, parts int")
    cut = placed.join(F.broadcast(names), ["cell", "band"]).select("id", "vec", "shell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    of = lambda f, kind: np.array([f(own) for own in shells], kind)
    return Cells(cut, Shells(pivots, of(lambda own: own[0].cell, np.int64), of(lambda own: min(r.low for r in own), np.float64), of(lambda own: max(r.high for r in own), np.float64), n, parts))


def _first_shells(x: np.ndarray, c: Shells, enough: int) -> np.ndarray:
    """Which shells each question meets first: those of the best bounds, until they hold enough vectors."""
    b = bounds(x, c.pivots, c.cell, c.low, c.high)
    order = np.argsort(-b, axis=1, kind="stable")
    before = np.cumsum(c.n[order], axis=1) - c.n[order]
    out = np.zeros(b.shape, bool)
    np.put_along_axis(out, order, before < enough, axis=1)
    return out


def _packs(c: Shells) -> np.ndarray:
    """The pack of each shell: neighbours are packed up to BLOCK vectors; a shell of several parts is a pack of its own."""
    out, pack, held = np.zeros(len(c.n), np.int32), 0, 0
    for i, (n, parts) in enumerate(zip(c.n.tolist(), c.parts.tolist(), strict=True)):
        if i and (parts > 1 or held + n > BLOCK):
            pack, held = pack + 1, 0
        out[i] = pack
        held += n if parts == 1 else BLOCK
    return out


def _visits(questions: DataFrame, c: Shells, enough: int, clamp: bool, later: bool) -> DataFrame:
    """(key, vec, pack, shells): the shells that each of questions (key, vec, and if later floor) meets, first or later, a row for each pack of them.

    floor: the k-th cosine of what was met first; null if there were fewer vectors than that. Questions are taken a few at a time, so that
    neither their bounds nor their rows grow with the shells.
    """
    schema = f"key string, vec array<double>, {'floor double, ' if later else ''}pack int, shells array<int>"
    packs = _packs(c)
    few = max(1, BOUNDS // max(1, len(c.cell)))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows if len(c.cell) else 0, few):
                b = whole.slice(at, few)
                x = unit(matrix(b.column(1)))
                meets = _first_shells(x, c, enough)
                if later:
                    floor = b.column(2).to_numpy(zero_copy_only=False)
                    need = np.where(np.isnan(floor), -2.0, floor - MARGIN)
                    if clamp:
                        need = np.maximum(need, MARGIN / 4)  # what rounds to 0 is told by its id alone
                    meets = ~meets & (bounds(x, c.pivots, c.cell, c.low, c.high) >= need[:, None])
                row, shell = np.nonzero(meets)
                pack = packs[shell]
                starts = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(pack, prepend=-1) != 0))
                ends = np.append(starts[1:], len(row))
                for i in range(0, len(starts), SENT):
                    s, e = starts[i : i + SENT], ends[i : i + SENT]
                    lists = pa.ListArray.from_arrays(pa.array(np.append(s, e[-1]) - s[0], pa.int32()), pa.array(shell[s[0] : e[-1]].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*[col.take(pa.array(row[s])) for col in b.columns], pa.array(pack[s]), lists], names=[*b.schema.names, "pack", "shells"])

    return questions.mapInArrow(run, schema)


def _nearest(x: np.ndarray, meets: np.ndarray, rows: np.ndarray, shell: np.ndarray, k: int, clamp: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, row, cosine) of the k best rows of each question among the shells that it meets; rows are in order of their ids."""
    own = np.flatnonzero(meets.any(axis=0)[shell])
    s = np.round(x @ rows[own].T, DIGITS)
    s = (np.maximum(s, 0) if clamp else s) + 0.0
    s[~meets[:, shell[own]]] = -np.inf
    if len(own) > k:
        # All that tie with the k-th stay until the ids decide.
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        q, r = np.nonzero((s >= least) & (s > -np.inf))
        place = np.lexsort((r, -s[q, r], q))
        q, r = q[place], r[place]
        first = np.arange(len(q)) - np.searchsorted(q, q)
        q, r = q[first < k], r[first < k]
    else:
        q, r = np.nonzero(s > -np.inf)
    return q, own[r], s[q, r]


def _met(visits: DataFrame, c: Cells, k: int, clamp: bool, id_type: str) -> DataFrame:
    """(key, id, cosine): of each question the k best of every block that it meets.

    A block is a pack of shells, or a part of a large shell. A question goes to a block once, however many of its shells it meets.
    """
    spark = visits.sparkSession
    packs = _packs(c.shells)
    counts = {r.pack: r.n for r in visits.groupBy("pack").agg(F.count("*").alias("n")).collect()}
    parts = {int(p): int(n) for p, n in zip(packs, c.shells.parts, strict=True)}
    plan = F.broadcast(spark.createDataFrame([(p, parts[p], -(-n // QUESTIONS)) for p, n in counts.items()], "pack int, parts int, groups int"))  # at most as many rows as shells
    of = F.broadcast(spark.createDataFrame([(i, int(p)) for i, p in enumerate(packs)], "shell int, pack int"))
    rows = c.rows.join(of, "shell").join(plan, "pack").select("pack", "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "shell", "id", "vec")
    asked = visits.select("key", "vec", "pack", "shells").join(plan, "pack")
    asked = asked.select("pack", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("key"), "groups").cast("int").alias("group"), "key", "vec", "shells")

    def run(left, right):
        keys, ids = right["key"].combine_chunks(), left["id"].combine_chunks()
        found = [], [], []
        if len(keys) and len(ids):
            order = np.array(pc.sort_indices(ids)).astype(np.int64)
            own = left["shell"].to_numpy()[order]
            low = own.min()
            x, y = unit(matrix(right["vec"].combine_chunks())), unit(matrix(left["vec"].combine_chunks()))[order]
            lists = right["shells"].combine_chunks()
            meets = np.zeros((len(keys), own.max() - low + 1), bool)
            q, shell = np.repeat(np.arange(len(keys)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy() - low
            here = (shell >= 0) & (shell < meets.shape[1])
            meets[q[here], shell[here]] = True
            # Questions that meet the same shells are taken together.
            alike = np.lexsort(np.packbits(meets, axis=1).T)
            few = max(1, BOUNDS // len(own))
            for i in range(0, len(alike), few):
                some = alike[i : i + few]
                q, r, s = _nearest(x[some], meets[some], y, own - low, k, clamp)
                for out, part in zip(found, (some[q], order[r], s), strict=True):
                    out.append(part)
        q, r, s = (np.concatenate([*part, np.zeros(0, kind)]) for part, kind in zip(found, (np.int64, np.int64, np.float64), strict=True))
        return pa.table({"key": keys.take(pa.array(q)), "id": ids.take(pa.array(r)), "cosine": pa.array(s)})

    by = ["pack", "part", "group"]
    return rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, f"key string, id {id_type}, cosine double")


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("place", F.expr("row_number() OVER (PARTITION BY key ORDER BY cosine DESC, id)")).where(F.col("place") <= k)


def _key(vector: Column) -> Column:
    """A name for a vector: 128 bits of hash."""
    return F.concat_ws(":", F.xxhash64(vector).cast("string"), F.xxhash64(F.lit(1), vector).cast("string"))


def search(questions: DataFrame, c: Cells, k: int, clamp: bool, id_type: str) -> DataFrame:
    """(key, id, cosine, place): the k best rows for each of questions (key string, vec), exactly."""
    first = stored(_best(_met(_visits(questions, c.shells, k, clamp, False), c, k, clamp, id_type), k), "first")
    floors = first.where(F.col("place") == k).select("key", F.col("cosine").alias("floor"))
    rest = questions.join(floors, "key", "left").select("key", "vec", "floor")
    later = _met(_visits(rest, c.shells, k, clamp, True), c, k, clamp, id_type)
    found = first.drop("place").unionByName(later)
    if clamp:
        # Of rows whose cosine rounds to 0 only the smallest ids can count, and these are among the k smallest of all.
        least = c.rows.select("id", "vec").orderBy("id").limit(k)
        cosine = F.greatest(F.lit(0.0), F.round(_cosine(F.col("vec"), F.col("v")), DIGITS)) + 0.0
        zeros = questions.crossJoin(F.broadcast(least.select("id", F.col("vec").alias("v")))).select("key", "id", cosine.alias("cosine"))
        found = found.unionByName(zeros.where("cosine = 0")).distinct()
    return _best(found, k)


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def top_k(queries: DataFrame, rows: DataFrame, k: int, clamp: bool = True, exclude_self: bool = False, block: int = BLOCK, per_cell: int = CELL) -> DataFrame:
    """(query_id, id, cosine, rank): exact k nearest rows by cosine; queries (query_id, vec), rows (id, vec), all of one dimension.

    Ranks are by the cosine rounded to 6 digits, then id. A cosine under 0 counts as 0 when clamp is set; vectors of zeros have a
    cosine of 0 to all. exclude_self: a row whose id is the query's is left out. Equal vectors ask once, and of equal rows only the smallest ids
    are met, so copies cost no more than their number.
    """
    kind = rows.schema["id"].dataType.simpleString()
    own = rows.select("id", F.col("vec").cast("array<double>").alias("vec"))
    take = k + 1 if exclude_self else k
    few = own.withColumn("__key", _key(F.col("vec"))).withColumn("__n", F.expr("row_number() OVER (PARTITION BY __key ORDER BY id)")).where(F.col("__n") <= take)
    cells = build(few.select("id", "vec"), block, per_cell)
    asked = stored(queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).withColumn("key", _key(F.col("vec"))), "asked")
    questions = asked.groupBy("key").agg(F.any_value("vec").alias("vec"))
    found = search(questions, cells, take, clamp, kind)
    told = asked.select("query_id", "key").join(found, "key")
    if exclude_self:
        told = told.where(F.col("id") != F.col("query_id"))
    ranked = told.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "id", "cosine", "rank")


def visited(queries: DataFrame, rows: DataFrame, k: int, clamp: bool = True, per_cell: int = CELL) -> DataFrame:
    """One row: questions, rows, shells, pairs (of a question and a row that meet) and share (of all pairs), as top_k's search goes."""
    own = rows.select("id", F.col("vec").cast("array<double>").alias("vec"))
    c = build(own, per_cell=per_cell)
    questions = stored(queries.select(F.col("query_id").cast("string").alias("key"), F.col("vec").cast("array<double>").alias("vec")), "asked")
    kind = rows.schema["id"].dataType.simpleString()
    first = _best(_met(_visits(questions, c.shells, k, clamp, False), c, k, clamp, kind), k).where(F.col("place") == k).select("key", F.col("cosine").alias("floor"))
    later = _visits(questions.join(first, "key", "left").select("key", "vec", "floor"), c.shells, k, clamp, True)
    each = F.explode("shells").alias("shell")
    met = _visits(questions, c.shells, k, clamp, False).select(each).union(later.select(each)).groupBy("shell").count().collect()
    pairs = int(sum(r["count"] * int(c.shells.n[r.shell]) for r in met))
    asked, held = questions.count(), int(c.shells.n.sum())
    return rows.sparkSession.createDataFrame([(asked, held, len(c.shells.n), pairs, pairs / max(1, asked * held))], "questions long, rows long, shells long, pairs long, share double")
