"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants within half the radius, the variants are shuffled, and
fingerprints that meet on a variant are verified. With an even radius r two fingerprints at r or fewer
differing bits always share a variant within r/2 of both. An odd radius has no exact half: the bits are cut
into three blocks and each view leaves one block out. Of up to r differing bits, some view leaves out at least
one, so r-1 or fewer remain and (r-1)/2 is exact again. For r = 3 a fingerprint emits 131 rows of 16 bytes,
where a ball of radius 2 over all 64 bits would take 2,081.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, stored, text_batches
from .components import connected_components

BITS = 64
#: Fingerprints of a variant that one task compares at most.
BUCKET = 8_192
#: One in so many rows makes a fingerprint hot.
HOT = 1_000
_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """xxh64 of each of a text's word shingles, repeats included; of all words if they are fewer than a shingle has."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    norm = b" ".join(words)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(norm, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(norm[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    if not (text or "").encode("utf-8", "surrogatepass").split():
        return 0
    hashes = shingle_hashes(text, shingle)
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    out = 0
    for j in range(8):
        ones = np.bincount(by_byte[:, j], minlength=256) @ _TABLE
        for bit in np.nonzero(2 * ones > len(hashes))[0].tolist():
            out |= 1 << (8 * j + bit)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp long) of every row. A null or empty text has fingerprint 0."""
    text_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, fp long")


def views(radius: int) -> list[tuple[int, list[int]]]:
    """(bits kept, flips within half the remaining radius) of each view."""
    everything = (1 << BITS) - 1
    if radius % 2 == 0:
        kept = [everything]
    else:
        cuts = [0, 21, 42, 64]
        kept = [everything & ~(((1 << (b - a)) - 1) << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    half, out = radius // 2, []
    for keep in kept:
        bits = [i for i in range(BITS) if keep >> i & 1]
        out.append((keep, [sum(1 << i for i in c) for k in range(half + 1) for c in combinations(bits, k)]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among the fingerprints of one variant, at most len(fps) - 1 edges.

    Grows each tree by a frontier: a fingerprint is compared once with those not reached yet, by whole arrays.
    """
    left, out = fps, []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= radius
            found = left[near]
            out += [(int(at), int(x)) for x in found]
            frontier += list(found)
            left = left[~near]
    return out


def fingerprint_links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """distinct (fp long, unique) -> (a, b): links that join exactly the fingerprints reachable by links of at most
    radius bits. Of each variant's bucket a spanning forest is kept, not all pairs. A bucket holds distinct
    fingerprints alone, however many documents share one. One of more than BUCKET fingerprints is not gathered: its
    fingerprints are dealt in blocks, and a task joins two blocks of it. The order inside a bucket is that of the
    fingerprints, so the links are the same each time.
    """
    plan = views(radius)
    # What a view leaves out carries the view's number, so that views do not meet.
    keyed = [F.transform(F.array(*[F.lit(_signed(f ^ (k + 1 << (21 * k) if len(plan) > 1 else 0))) for f in flips]), (lambda keep: lambda f: F.col("fp").bitwiseAND(F.lit(_signed(keep))).bitwiseXOR(f))(keep)) for k, (keep, flips) in enumerate(plan)]
    # Few and narrow rows become many: spread them first, by a count that adaptive execution does not lower.
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = distinct.repartition(n).select(F.explode(F.concat(*keyed)).alias("k"), "fp")
    dealt = variants.repartition("k").sortWithinPartitions("k", "fp")
    most = BUCKET

    def run(batches):
        """(a, b, false) for links, (k, fp, true) for the fingerprints of large buckets."""
        tail_k, tail_fp, large = np.empty(0, np.int64), np.empty(0, np.int64), None
        for b in batches:
            k, fp = np.concatenate([tail_k, b.column(0).to_numpy()]), np.concatenate([tail_fp, b.column(1).to_numpy()])
            if large is not None:  # the large bucket goes on
                cut = int(np.searchsorted(k, large, side="right"))
                yield from told(k[:cut], fp[:cut], True)
                k, fp = k[cut:], fp[cut:]
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            yield from edges(k[:cut], fp[:cut])
            tail_k, tail_fp = k[cut:], fp[cut:]
            if len(tail_k):
                large = None
            if len(tail_k) > most:
                large = int(tail_k[0])
                yield from told(tail_k, tail_fp, True)
                tail_k, tail_fp = tail_k[:0], tail_fp[:0]
        yield from edges(tail_k, tail_fp)

    def told(a, b, large):
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), large))], names=["a", "b", "large"])

    def edges(k, fp):
        if len(k) < 2:
            return
        signed, fp = fp, fp.view(np.uint64)
        at = np.concatenate(([0], np.nonzero(np.diff(k))[0] + 1, [len(k)]))
        size = np.diff(at)
        two = at[:-1][size == 2]
        a, b = fp[two], fp[two + 1]
        near = np.bitwise_count(a ^ b) <= radius
        pairs = [np.stack([a[near], b[near]], axis=1)]
        for i in np.nonzero(size > 2)[0]:
            if size[i] > most:
                yield from told(k[at[i] : at[i + 1]], signed[at[i] : at[i + 1]], True)
            elif found := _forest(fp[at[i] : at[i + 1]], radius):
                pairs.append(np.array(found, dtype=np.uint64))
        both = np.sort(np.concatenate(pairs).view(np.int64), axis=1)
        both = np.unique(both[both[:, 0] < both[:, 1]], axis=0)
        yield from told(both[:, 0], both[:, 1], False)

    found = stored(dealt.mapInArrow(run, "a long, b long, large boolean"), "met")
    links = found.where("NOT large").select("a", "b")
    large = found.where("large").select(F.col("a").alias("k"), F.col("b").alias("fp"))
    if not large.isEmpty():
        links = links.union(_links_in_blocks(large, radius))
    return links.distinct()


def _links_in_blocks(members: DataFrame, radius: int) -> DataFrame:
    """members (k, fp) of large buckets -> (a, b): spanning forests of every two blocks of a bucket."""
    sizes = members.groupBy("k").agg(F.ceil(F.count("*") * 2 / BUCKET).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = members.join(sizes, "k").select("k", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))

    def join(key, table):
        fps = np.unique(table["fp"].to_numpy()).view(np.uint64)
        pairs = np.sort(np.array(_forest(fps, radius), np.uint64).reshape(-1, 2).view(np.int64), axis=1)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return dealt.groupBy("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).applyInArrow(join, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp long, fingerprint, component_id) of every row of docs.

    Fingerprints at radius or fewer differing bits are linked; component_id is the smallest id reachable. Rows without
    words (null and empty texts included) all have fingerprint zero and link like others. Repeated rows are repeated in the
    result. A null id counts as the smallest id and gives a null component_id. An empty table gives an empty result.
    Other columns of docs are not looked at. Fingerprints that more than one in HOT rows have are at most HOT: their
    components are broadcast, so that a hot one is not dealt to one task.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = stored(fps.groupBy("fp").agg(F.min(F.coalesce("id", F.lit(NULL_ID))).alias("least"), F.count("*").alias("n")), "distinct")
    links = stored(fingerprint_links(least.select("fp"), radius), "links")
    roots = connected_components(links)
    own = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    own = stored(own, "roots")
    best = own.groupBy("root").agg(F.min("least").alias("component"))
    named = stored(own.join(best, "root").select("fp", "component", "n"), "named")
    hot = named.where(F.col("n") * HOT > F.lit(fps.count())).select("fp", "component")
    rest = fps.join(F.broadcast(hot), "fp", "left_anti").join(named.drop("n"), "fp")
    found = fps.join(F.broadcast(hot), "fp").unionByName(rest)
    return found.select(
        F.col("id").alias("doc_id"), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component") != NULL_ID, F.col("component")).alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of docs that stay when of each component only the row with the smallest id does; columns unchanged.

    A component whose smallest id is null keeps its rows without id. Rows that repeat an id are the same document
    and stay together.
    """
    found = simhash_components(docs, id_col, text_col, shingle, radius)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept"]), "left_semi")


def query(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("fp")
