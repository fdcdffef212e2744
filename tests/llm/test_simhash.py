import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import simhash as S
from lodestar.llm.components import connected_components

from .conftest import SF, rows


def naive(text, shingle=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps, radius=3):
    """id -> smallest reachable id, from {(id, fp)}."""
    ids, values = [i for i, _ in fps], np.array([f for _, f in fps], np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.nonzero(np.bitwise_count(values ^ values[i]) <= radius)[0]:
            a, b = sorted((find(i), find(int(j))), key=lambda x: ids[x])
            root[b] = a
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


@pytest.mark.parametrize("text", ["", None, " \n", "One", "one TWO", "a b c", "É a A b B c C d D", "x y z x y z x y z x y z", "日本 語 テ ス ト"])
def test_fingerprint(text):
    assert S.fingerprint(text) == naive(text)


def test_views_meet():
    """Any two fingerprints within the radius share a variant, for even and odd radii."""
    rnd = random.Random(3)
    for radius in (1, 2, 3, 4):
        plan = S.views(radius) if radius < 4 else [(S.views(4)[0][0], S.views(4)[0][1])]
        for _ in range(40):
            a = rnd.getrandbits(64)
            b = a
            for bit in rnd.sample(range(64), radius):
                b ^= 1 << bit
            assert any({(a & k) ^ f for f in flips} & {(b & k) ^ f for f in flips} for k, flips in plan)


def test_query_equals_brute_force(spark):
    got = S.query(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = brute(sorted((i, naive(t)) for i, t in texts.items()))
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.fingerprint == f"{naive(texts[r.doc_id]):016x}" for r in got)


def test_links_join_what_brute_force_joins(spark):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    for f in rnd.sample(sorted(fps), 30):  # clusters and chains, at up to the radius
        at = f
        for _ in range(rnd.randint(1, 40)):
            at = (f if rnd.random() < 0.5 else at) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3)))
            fps.add(at)
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    links = S.fingerprint_links(spark.createDataFrame(signed, "fp long"))
    found = {r.node: r.root for r in connected_components(links).collect()}
    want = brute(sorted((s[0], s[0] & (2**64 - 1)) for s in signed))
    assert {s[0]: found.get(s[0], s[0]) for s in signed} == want
    assert all(np.bitwise_count(np.uint64(r.a & (2**64 - 1)) ^ np.uint64(r.b & (2**64 - 1))) <= 3 for r in links.collect())


def test_large_buckets_are_split(spark, monkeypatch):
    """Fingerprints of one dense region, in buckets over the limit: the same components, and the same links each time."""
    rnd = random.Random(6)
    base = rnd.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rnd.sample(range(10), rnd.randint(0, 5))) ^ (rnd.getrandbits(1) << 50) for _ in range(700)} | {rnd.getrandbits(64) for _ in range(200)})
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    df = spark.createDataFrame(signed, "fp long").repartition(3)
    want = brute(sorted((s[0], s[0] & (2**64 - 1)) for s in signed))
    for most in (S.BUCKET, 40):
        monkeypatch.setattr(S, "BUCKET", most)
        links = S.fingerprint_links(df)
        found = {r.node: r.root for r in connected_components(links).collect()}
        assert {s[0]: found.get(s[0], s[0]) for s in signed} == want
        assert rows(links) == rows(S.fingerprint_links(df.repartition(7)))
        assert all(0 < np.bitwise_count(np.uint64(r.a & (2**64 - 1)) ^ np.uint64(r.b & (2**64 - 1))) <= 3 for r in links.collect())


def test_a_hot_fingerprint(spark):
    """A third of the rows share a fingerprint, some of them without id."""
    data = [(i if i % 5 else None, "the same few words in many rows") for i in range(1, 2000)] + [(5000 + i, f"other words {i} and {i * 7}") for i in range(4000)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = S.simhash_components(df).collect()
    want = brute(sorted({(-(2**63) if i is None else i, naive(t)) for i, t in data}))
    assert len(got) == len(data)
    assert all((-(2**63) if r.component_id is None else r.component_id) == want[-(2**63) if r.doc_id is None else r.doc_id] for r in got)


def test_components_of_star_chain_and_empty(spark):
    edges = [(1, i) for i in range(2, 50)] + [(100 + i, 101 + i) for i in range(60)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 50)} | {100 + i: 100 for i in range(61)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, empty, clashing):
    got = S.simhash_components(odd)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got.collect()}
    assert got.count() == odd.count()
    assert by[7, "0" * 16] is None and by[8, "0" * 16] is None and by[9, "0" * 16] is None  # the null id is the smallest
    assert [by[i, f"{naive('short'):016x}"] for i in (11, 12)] == [11, 11]
    assert S.simhash_components(empty).count() == 0
    assert rows(S.simhash_components(clashing)) == rows(got)


def test_keep_one(odd, docs, clashing):
    kept = S.keep_one(docs)
    found = {r.doc_id: r.component_id for r in S.simhash_components(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == set(found.values()) and kept.columns == docs.columns
    ids = [r.doc_id for r in S.keep_one(odd).collect()]
    assert ids.count(3) == 2 and 12 not in ids and 8 not in ids
    assert S.keep_one(clashing).columns == clashing.columns
