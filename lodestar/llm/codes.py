"""Vector codes: each vector is cut into parts, and each part is stored as the number of the nearest entry of its codebook.

All arithmetic is in integers, so the result does not depend on the order of rows. The nearest entry is found by lower
bounds, from coarse to fine. For any cut of a part into blocks of b components, with S the block sums and R the norm of what is left
after the block means are taken away, |x - c|^2 >= sum((Sx - Sc)^2) / b + (Rx - Rc)^2. Blocks start at the whole part and
are halved; an entry whose bound is over the distance of one already measured is set aside. Bounds in floating point are
lowered by more than their rounding, so only entries that cannot be nearest are set aside; the others are measured exactly.

A round is one pass over the vectors: tasks hand on, for each entry, the sums of its parts, and the driver gets the sums over
all tasks, which are as many numbers as the codebooks have. No vector is shuffled.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows whose bounds are held at once.
BLOCK_ROWS = 4_096
#: Labels whose sums are broadcast to the rows, at most; more are joined.
BROADCAST_LABELS = 100_000
_EPS = 2.0**-44


def finite(vector: Column) -> Column:
    """True for a vector that is not null and holds neither null nor a non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def limit(dimension: int) -> int:
    """The largest size of an integer component for which sums of squared distances of that many components fit 64 bits."""
    return min(2**27, math.isqrt((2**63 - 1) // (8 * max(dimension, 1))))


def block_sizes(width: int) -> list[int]:
    """The sizes of blocks, from the whole part down to the last one over a single component."""
    out = [width] if width else []
    while out and out[-1] % 2 == 0 and out[-1] > 2:
        out.append(out[-1] // 2)
    return out


def _profile(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block sums, sqrt(size) times the residual norm) of each row, for blocks of size components."""
    blocks = x.reshape(len(x), -1, size)
    sums = blocks.sum(axis=2)
    return sums.astype(np.float64), np.sqrt((size * (blocks * blocks).sum(axis=(1, 2)) - (sums * sums).sum(axis=1)).astype(np.float64))


def _bound(sx, rx, sc, rc, size: int) -> np.ndarray:
    """A number not over the squared distance, for arrays that broadcast against each other but for the last axis of the sums."""
    # Residuals are rounded; their difference is lowered by more than that.
    gap = np.maximum(np.abs(rx - rc) - _EPS * (rx + rc), 0.0)
    return (((sx - sc) ** 2).sum(axis=-1) + gap * gap) / size * (1 - _EPS)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest entry, squared distance) of each row of x, ties going to the lower number; how many distances were measured.

    x and book are int64 arrays of equally many columns, within limit().
    """
    code, error, measured = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
    sizes = block_sizes(x.shape[1])
    entries = [_profile(book, s) for s in sizes]
    for at in range(0, len(x), BLOCK_ROWS):
        own = x[at : at + BLOCK_ROWS]
        if not sizes:
            continue
        rows = [_profile(own, s) for s in sizes]
        (sx, rx), (sc, rc) = rows[0], entries[0]
        low = _bound(sx[:, None], rx[:, None], sc[None], rc[None], sizes[0])
        first = low.argmin(axis=1)
        delta = own - book[first]
        best = (delta * delta).sum(axis=1)
        # Row by row, the entries that may be as near as the one measured: never none, as that one is among them.
        may = low <= best[:, None]
        may[np.arange(len(own)), first] = True
        r, e = np.nonzero(may)
        for s, (sx, rx), (sc, rc) in zip(sizes[1:], rows[1:], entries[1:], strict=True):
            left = (_bound(sx[r], rx[r], sc[e], rc[e], s) <= best[r]) | (e == first[r])
            r, e = r[left], e[left]
        delta = own[r] - book[e]
        square = (delta * delta).sum(axis=1)
        starts = np.concatenate(([0], np.nonzero(np.diff(r))[0] + 1))
        least = np.minimum.reduceat(square, starts)
        error[at : at + len(own)] = least
        code[at : at + len(own)] = np.minimum.reduceat(np.where(square == least[r], e, len(book)), starts)
        measured += len(r)
    return code, error, measured


def integers(b: pa.RecordBatch, at: int, dimension: int) -> np.ndarray:
    """floor(SCALE * x) of the vectors in column at, which all have that dimension."""
    flat = b.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(b.num_rows, dimension)


def _seeds(own: DataFrame, entries: int) -> list:
    """The vectors of the smallest distinct ids, one for each id, smallest first; at most entries."""
    some = own.where(F.col("id").isNotNull())
    return [r.v for r in some.groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(entries).collect()]


def codable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """((id, label, v) of the rows that are coded, their dimension). See encode()."""
    spark_type = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col) if spark_type in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(finite(F.col("v")))
    cut = own.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    first = cut.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v").alias("d")).first()
    dimension = first.d if first else 0
    fits = F.forall("v", lambda x: F.abs(x.cast("double")) < limit(dimension) / SCALE)
    return cut.where((F.size("v") == dimension) & fits), dimension


def train(own: DataFrame, dimension: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks as an int64 array (part, entry, component) of codable()'s rows; with fewer ids than entries, as many as there are ids."""
    width = dimension // parts if dimension else 0
    seeds = _seeds(own, entries) if dimension else []
    books = np.floor(np.array(seeds, np.float64).reshape(len(seeds), dimension) * SCALE).astype(np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2)
    if not len(seeds):
        return books
    for _ in range(rounds):
        got = _sums(own, books).groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        books = books.copy()
        for r in got:
            books[r.part, r.entry, r.pos] = r.total // r.n
    return books


def _sums(own: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, pos, total, n): of each task, the sums of the parts that are nearest to an entry."""
    parts, entries, width = books.shape
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("pos", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = integers(b, 0, parts * width)
            for p in range(parts):
                part = x[:, p * width : (p + 1) * width]
                code, _, _ = nearest(part, books[p])
                np.add.at(total[p], code, part)
                n[p] += np.bincount(code, minlength=entries)
        p, e, c = np.nonzero(np.broadcast_to(n[:, :, None] > 0, total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(total[p, e, c]), pa.array(n[p, e])], schema=schema)

    return own.select("v").mapInArrow(run, "part int, entry int, pos int, total long, n long")


def assign(own: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, codes binary, error long) of codable()'s rows: a byte for each part, and the squared distances summed over the parts."""
    parts, entries, width = books.shape
    if entries > 256:
        raise ValueError("a code is one byte: at most 256 entries")
    label = own.schema["label"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = integers(b, 2, parts * width)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                code, square, _ = nearest(x[:, p * width : (p + 1) * width], books[p])
                codes[:, p] = code
                error += square
            flat = pa.Array.from_buffers(pa.binary(parts), len(x), [None, pa.py_buffer(np.ascontiguousarray(codes))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat.cast(pa.binary()), pa.array(error)], names=["id", "label", "codes", "error"])

    return own.mapInArrow(run, f"id long, label {label}, codes binary, error long")


def encode(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """((id, label, codes binary, error long, label_error long) of the rows that are coded, codebooks (part, entry, component)).

    Rows whose vector is null or holds null or non-finite components are left out. So are vectors that cannot be cut into parts of
    equal size above zero, those of another dimension than the vector of the smallest id, and those of components so large
    (2048 times limit(), 524,288 for 64 dimensions) that squared distances would not fit a long. Each of the smallest ids gives one entry, its smallest
    vector if the id repeats; repeated rows are coded and counted each time. A null id gives no entry, and its row is coded; without
    any id nothing can be coded. label_error is the sum of error over equal labels, nulls being equal. An empty table gives
    an empty result and codebooks without entries. Other columns are not looked at.
    """
    own, dimension = codable(vectors, id_col, vector_col, label_col, parts)
    books = train(own, dimension, parts, entries, rounds)
    if not books.shape[1]:
        own, books = own.limit(0), np.zeros((parts, 1, max(dimension // parts, 1)), np.int64)
        return assign(own, books).withColumn("label_error", F.lit(None).cast("long")), books[:, :0]
    coded = assign(own, books)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    # As many rows as labels: broadcast where that was counted and is few, else an equi-join whose hot label can be split.
    if vectors.select(F.col(label_col)).distinct().limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label"), books


def decode(codes: bytes, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([books[p, c] for p, c in enumerate(codes)])


def digest(books: np.ndarray) -> str:
    """sha256 of all components by part, entry and place, in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    coded, books = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select(
        F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"),
    )


def _round(k: int) -> str:
    """SQL of one round: assignment to the entries of books{k}, then books{k + 1}."""
    return f"""
, near{k} AS ({_nearest(k)})
, means{k} AS (
  SELECT p, e, i, floor(sum(x) / count(*)) AS x
  FROM (SELECT n.p, n.e, unnest(n.x) AS x, unnest(range(len(n.x))) AS i FROM near{k} n) GROUP BY p, e, i
), books{k + 1} AS (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM books{k} b
  LEFT JOIN (SELECT p, e, list(CAST(x AS BIGINT) ORDER BY i) AS x FROM means{k} GROUP BY p, e) m ON b.p = m.p AND b.e = m.e
)"""


def _nearest(k: int) -> str:
    return f"""
  SELECT vec_id, label, p, x, best.e AS e, best.d AS d FROM (
    SELECT v.vec_id, v.label, v.p, any_value(v.x) AS x,
           min({{'d': list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.e}}) AS best
    FROM parts v JOIN books{k} b ON v.p = b.p GROUP BY v.vec_id, v.label, v.p)"""


SQL = rf"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS (
  SELECT vec_id, label, p, q[p * len(q) // {PARTS} + 1 : (p + 1) * len(q) // {PARTS}] AS x
  FROM whole, range({PARTS}) AS t(p)
), books0 AS (
  SELECT v.p, s.e, v.x
  FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM whole ORDER BY vec_id LIMIT {ENTRIES}) s
  JOIN parts v ON v.vec_id = s.vec_id
){"".join(_round(k) for k in range(ROUNDS))}
, last AS ({_nearest(ROUNDS)})
, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM last GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM books{ROUNDS}) AS codebooks_sha256
FROM coded
"""
