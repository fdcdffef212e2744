"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands find candidates, the shingle hashes decide.

A text's signature is the smallest of its shingle hashes under each of ROWS * BANDS multiplications; ROWS of them make a band's
key. Two texts of similarity s share no key with probability (1 - s^ROWS)^BANDS: 5e-8 at 0.8. Texts that share a key are
compared exactly. First the smallest text of a key is compared with all others, so that copies of one text cost their number,
not its square. Of those that stay, the texts of small keys are compared with each other. Those of large keys, which are alike but
not near to the smallest one, are dealt in blocks: a task holds two blocks of a key, and counts what all their texts share by a
product of matrices. No pair is a row there, and memory is bounded by the size of a block. A pair is judged once, under the
first key that it shares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, stored, text_batches
from .simhash import shingle_hashes

ROWS, BANDS = 4, 32
#: Keys that more texts share than this are compared in blocks of texts.
SMALL, BLOCK = 16, 256
#: Columns of the matrices of shared shingles.
COLUMNS = 4_096
_MULTIPLIERS = np.random.default_rng(20).integers(0, 2**64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of all bands, as signed longs."""
    least = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        # The upper half of a product is well mixed; the multiplication by one row at a time keeps memory small.
        least = np.minimum(least, (hashes[at : at + 2048, None] * _MULTIPLIERS).min(axis=0))
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for row in least.reshape(ROWS, BANDS):
        out = (out ^ row) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _node() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("t"), F.lit("")))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, node, t): node stands for the text."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).cast("string").alias("t")).select("id", _node().alias("node"), "t")


def _members(rows: DataFrame) -> DataFrame:
    """The rows (k, least, node) of keys that two or more have, with first, the smallest (least, node) of the key."""
    heads = rows.groupBy("k").agg(F.min(F.struct("least", "node")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return stored(rows.join(heads, "k").select("k", "band", "least", "node", "first", "n"), "members")


def _dropped(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The nodes b of pairs (a, b) whose shingle sets are as similar."""
    one = pairs.distinct().join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    # In whole numbers: a fraction that is exactly the limit counts.
    near = both.withColumn("shared", shared).where(F.col("shared") * 1_000_000 >= F.lit(round(similarity * 1_000_000)) * (F.size("x") + F.size("y") - F.col("shared")))
    return stored(near.select(F.col("b").alias("node")).distinct(), "dropped")


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each of the sets a has in common with each of b; the sets have no value twice."""
    out = np.zeros((len(a), len(b)), np.int64)
    left, right = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(left, right)
    owners = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b)]
    for at in range(0, len(both), COLUMNS):
        some = both[at : at + COLUMNS]
        grids = []
        for values, owner, n in ((left, owners[0], len(a)), (right, owners[1], len(b))):
            column = np.minimum(np.searchsorted(some, values), len(some) - 1)
            own = some[column] == values
            grid = np.zeros((n, len(some)), np.float32)
            grid[owner[own], column[own]] = 1
            grids.append(grid)
        out += (grids[0] @ grids[1].T).astype(np.int64)
    return out


def near_in_blocks(order: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, band: int, limit: int) -> np.ndarray:
    """The rows that are near to one of smaller order; left and right: the rows to compare with each other.

    order[i]: place of row i. Pairs that share the key of an earlier band are left to that one. limit: similarity in millionths.
    """
    size = np.array([len(s) for s in sets], np.int64)
    ask = order[left][:, None] != order[right][None, :]
    for b in range(band):
        ask &= keys[left, b][:, None] != keys[right, b][None, :]
    a, b = size[left][:, None], size[right][None, :]
    ask &= np.minimum(a, b) * 1_000_000 >= limit * np.maximum(a, b)
    rows, columns = np.nonzero(ask.any(axis=1))[0], np.nonzero(ask.any(axis=0))[0]
    if not len(rows):
        return np.empty(0, np.int64)
    shared = _shared([sets[i] for i in left[rows]], [sets[i] for i in right[columns]])
    near = ask[np.ix_(rows, columns)] & (shared * 1_000_000 >= limit * (a[rows] + b[:, columns] - shared))
    x, y = left[rows[np.nonzero(near)[0]]], right[columns[np.nonzero(near)[1]]]
    return np.unique(np.where(order[x] > order[y], x, y))


def _dropped_in_blocks(members: DataFrame, sets: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The nodes of members that are near to another of the same key with a smaller (least, node)."""
    limit = round(similarity * 1_000_000)
    block = F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks"))
    dealt = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).select("k", "band", "node", block.cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("k", "band", "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    own = members.select("node").distinct().join(sets, "node").join(nodes, "node").select("node", "least", "keys", "hashes")

    def judge(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        least, node, block = (table[c].to_numpy() for c in ("least", "node", "block"))
        order = np.empty(len(node), np.int64)
        order[np.lexsort((node, least))] = np.arange(len(node))
        keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(len(node), BANDS)
        hashes = table["hashes"].combine_chunks()
        flat, ends = hashes.flatten().to_numpy(), np.concatenate(([0], np.cumsum(hashes.value_lengths().to_numpy())))
        sets = [flat[x:y] for x, y in zip(ends, ends[1:], strict=False)]
        left, right = np.nonzero(block == i)[0], np.nonzero(block == j)[0]
        gone = near_in_blocks(order, keys, sets, left, right, table["band"][0].as_py(), limit) if len(left) and len(right) else np.empty(0, np.int64)
        return pa.table({"node": pa.array(node[gone], pa.int64())})

    return stored(dealt.join(own, "node").groupBy("k", "i", "j").applyInArrow(judge, "node long").distinct(), "dropped")


def keep_dissimilar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, ids: DataFrame | None = None) -> DataFrame:
    """The rows of docs that stay when each text that is near to one of a smaller id goes; columns unchanged.

    Near: the Jaccard similarity of the sets of shingle-word shingles is similarity or more. A text of fewer words is one shingle;
    texts without words (null and empty ones too) equal each other. No two texts that stay are near, but for the pairs that no
    band finds, and each that goes is near to one of a smaller id, which itself may go. Equal texts are one, with the smallest
    id; a null id is the smallest. ids (one column of ids): only those rows of docs take part and stay. An empty table gives an
    empty result.
    """
    text_batches(docs.sparkSession)
    long_list = pa.list_(pa.int64())

    def keys(batches):
        for b in batches:
            got = [band_keys(shingle_hashes(t, shingle)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, long_list)], names=["id", "node", "keys"])

    def hashed(batches):
        for b in batches:
            got = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, long_list)], names=["node", "hashes"])

    signed = stored(_texts(docs, id_col, text_col).mapInArrow(keys, "id long, node long, keys array<long>"), "signatures")
    if ids is not None:
        signed = signed.join(ids.select(F.coalesce(F.col(ids.columns[0]).cast("long"), F.lit(NULL_ID)).alias("id")).distinct(), "id", "left_semi")
    nodes = stored(signed.groupBy("node").agg(F.min("id").alias("least"), F.first("keys").alias("keys")), "nodes")
    members = _members(nodes.select("least", "node", F.posexplode("keys").alias("band", "k")))
    # The row of the smallest id stands for a text; by id and text, copies are not dealt to one task.
    needed = members.select("node", F.col("least").alias("id")).distinct()
    texts = _texts(docs, id_col, text_col).join(needed, ["id", "node"], "left_semi").select("node", "t").dropDuplicates(["node"])
    sets = stored(texts.mapInArrow(hashed, "node long, hashes array<long>"), "sets")
    gone = [_dropped(members.where("first.node <> node").select(F.col("first.node").alias("a"), F.col("node").alias("b")), sets, similarity)]
    rest = _members(members.select("k", "band", "least", "node").join(gone[0], "node", "left_anti"))
    small = rest.where(F.col("n") <= SMALL)
    other = small.select("k", F.col("least").alias("least_b"), F.col("node").alias("b"))
    pairs = small.select("k", "least", "node").join(other, "k").where("least < least_b OR least = least_b AND node < b")
    gone.append(_dropped(pairs.select(F.col("node").alias("a"), "b"), sets, similarity))
    gone.append(_dropped_in_blocks(rest.where(F.col("n") > SMALL), sets, nodes, similarity))
    kept = nodes.select("node", "least")
    for g in gone:
        kept = kept.join(g, "node", "left_anti")
    kept = kept.select(F.col("node").alias("__node"), F.col("least").alias("__least"))
    own = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(kept, (own == kept["__node"]) & (F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)) == kept["__least"]), "left_semi")
