"""Vectors: hash embeddings and cosine as column expressions; the exact nearest rows are in cells.py."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import tokenize
from lodestar.operators.cells import top_k  # noqa: F401

HASH_DIM = 32
#: Texts and tokens that are summed at a time.
ROWS, SUMMED, TOKENS = 2_000, 250, 16_384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different dimensions and zero norms."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def normalize(a: Column) -> Column:
    n = norm(a)
    # The norm stands outside the lambda, which would work it out again for every component.
    return F.when(n > 0, F.zip_with(a, F.array_repeat(n, F.size(a)), lambda x, y: x / y)).otherwise(a)


def _sums(batches):
    """Batches (id, tokens) -> (id, a sum for each dimension): a token stands for the bytes of its digest, as numbers between -0.5 and 0.5."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            b = whole.slice(at, ROWS)
            b = b.filter(pc.greater(pc.fill_null(pc.list_value_length(b.column(1)), 0), 0))
            words, lengths = b.column(1).flatten().dictionary_encode(), b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            digests = b"".join(hashlib.sha256(w.encode()).digest() for w in words.dictionary.to_pylist())
            codes = np.frombuffer(digests, np.uint8).reshape(-1, HASH_DIM) / 255.0 - 0.5
            each = words.indices.to_numpy(zero_copy_only=False)
            starts, sums = np.cumsum(lengths) - lengths, np.zeros((b.num_rows, HASH_DIM))
            for i in range(0, b.num_rows, SUMMED):
                first, last = starts[i], starts[i] + lengths[i : i + SUMMED].sum()
                for j in range(first, last, TOKENS):  # a text of many tokens in pieces
                    piece = slice(j, min(j + TOKENS, last))
                    rows = np.searchsorted(starts[i : i + SUMMED], np.arange(piece.start, piece.stop), "right") - 1
                    cuts = np.flatnonzero(np.diff(rows, prepend=-1))
                    sums[i + rows[cuts]] += np.add.reduceat(codes[each[piece]], cuts, axis=0)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x) for x in sums.T]], names=["id", *[f"__{i}" for i in range(HASH_DIM)]])


def hash_embedding(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, vec): unit vector of the sum over a text's tokens, repeats included. Rows of one id count as one text; texts without
    tokens have no row. Each batch takes the digest of a distinct token once and sums by whole arrays."""
    kind = docs.schema[id_col].dataType.simpleString()
    tokens = docs.select(F.col(id_col).alias("id"), tokenize(F.col(text_col)).alias("tokens"))
    parts = tokens.mapInArrow(_sums, f"id {kind}, " + ", ".join(f"__{i} double" for i in range(HASH_DIM)))
    # One sum per dimension: fixed-width buffers that are combined before the shuffle.
    sums = parts.groupBy(F.col("id").alias(id_col)).agg(*[F.sum(f"__{i}").alias(f"__{i}") for i in range(HASH_DIM)])
    return sums.select(id_col, F.array(*[F.col(f"__{i}") for i in range(HASH_DIM)]).alias("vec")).select(id_col, normalize(F.col("vec")).alias("vec"))


def embed_distinct(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """hash_embedding with each distinct text embedded once."""
    keyed = docs.select(id_col, F.sha2(text_col, 256).alias("h"), F.col(text_col).alias("__t"))
    vecs = hash_embedding(keyed.groupBy("h").agg(F.first("__t").alias("__t")), "h", "__t")
    return keyed.join(vecs, "h").select(id_col, "vec")
