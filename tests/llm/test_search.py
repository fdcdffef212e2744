"""Permutation index and mixing."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import mixing as M
from lodestar.llm import permutation_index as P

from .conftest import rows


def brute(vectors, queries, k=20):
    out = {}
    for q in queries:
        near = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:k]
        out[q] = [i for _, i in near]
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    folder = f"/root/testdata/{sf}"
    e = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    got = defaultdict(list)
    for r in sorted(P.query(spark, folder).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
        assert abs(r.score - float(e[r.query_id] @ e[r.vec_id])) < 1e-12
    ids = np.array(sorted(e))
    x = np.array([e[i] for i in ids])
    hit = 0
    for q, found in got.items():
        s = x @ e[q]
        s[ids == q] = -9
        hit += len(set(found) & set(ids[np.argsort(-s, kind="stable")[:20]]))
    assert len(got) == sum(i % 20 == 0 for i in e) and all(len(v) == 20 for v in got.values())
    assert hit / 20 / len(got) >= 0.9


def test_exact_on_small_tables_with_ties(spark):
    """Few rows are all reranked: ties by id, lengths that differ, odd vectors left out."""
    rnd = np.random.default_rng(0)
    data = {i: [float(x) for x in rnd.integers(-2, 3, 4)] for i in range(120)}
    data = {i: v for i, v in data.items() if any(v)}
    odd = [(500, None), (501, []), (502, [0.0] * 4), (503, [1.0, None, 0.0, 0.0]), (504, [float("nan"), 1.0, 0.0, 0.0]), (505, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([*data.items(), *data.items(), *odd], "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2))
    got = defaultdict(list)
    for r in sorted(P.search(df, F.col("vec_id") % 20 == 0).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    assert dict(got) == brute(data, [i for i in data if i % 20 == 0])
    assert P.search(df.limit(0), F.lit(True)).count() == 0
    assert P.search(df.where("vec_id = 1"), F.lit(True)).count() == 0


def test_ties_of_the_footrule_are_kept():
    x = np.repeat(np.eye(4), 300, 0)
    ids = np.arange(len(x))
    pivots = np.hstack([np.eye(4), np.zeros((4, 1))])
    lifted = np.hstack([x, np.zeros((len(x), 1))])
    q, found, score = P.search_block(ids, x, lifted, np.array([5]), x[5:6], pivots, 20, 0.01, 1)
    assert found.tolist() == [0, 1, 2, 3, 4, *range(6, 21)] and set(score) == {1.0}


def entropy(w):
    return -sum(x * math.log(x) for x in w if x > 0)


def test_weights_meet_target_and_limit(spark):
    sizes = {"a": 6000, "b": 1000, "c": 500, "d": 100}
    data = [(i, " ".join(["w"] * 10), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n // 10))]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    for target, limit in ((0.8, None), (0.95, 2.0)):
        got = M.mix(df, target_entropy=target, max_repeats=limit).collect()
        w = {r.source: r.mix_weight for r in got}
        used = Counter()
        for r in got:
            used[r.source] += r.mix_copies * r.mix_tokens
        total = sum(sizes.values())
        assert abs(sum(w.values()) - 1) < 1e-9
        if limit is None:
            assert abs(entropy(w.values()) / math.log(4) - target) < 1e-3
        else:
            assert max(used[s] / sizes[s] for s in sizes) <= limit + 0.1
        assert all(abs(used[s] - w[s] * total) <= 10 for s in sizes)
        t = [math.log(w[s] / w["a"]) / math.log(sizes[s] / sizes["a"]) for s in "bcd"]
        assert max(t) - min(t) < 1e-6  # one exponent for all
    once = M.mix(df, max_repeats=1.0, load=None)
    assert max(r.mix_copies for r in once.collect()) == 1
    assert M.realised(once, df.columns).count() == once.where("mix_copies = 1").count()


def test_repeated_rows_are_one_document(spark):
    """Exact repeats are used equally often, and the budget is met to within them."""
    data = [(None, "four words in here", "s")] * 900 + [(i, "two words", "s" if i % 2 else "t") for i in range(900)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    got = M.mix(df, load=0.5).collect()
    assert len(got) == len(data) and len({r.mix_copies for r in got if r.doc_id is None}) == 1


def test_blocks_are_taken_in_order(spark):
    data = [(i, "one two three", "s" if i % 3 else "t") for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = M.mix(df, load=0.5, blocks=64).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source, r.mix_order].append(r.mix_copies)
    for s in "st":
        shares = [np.mean(by[s, o]) for o in sorted(o for x, o in by if x == s)]
        assert shares == sorted(shares, reverse=True) and sum(0 < x < 1 for x in shares) <= 1


def test_mixing_odd_rows(odd, empty, clashing):
    got = M.mix(odd)
    assert got.count() == odd.count() and M.mix(empty).count() == 0
    cols = ["doc_id", "mix_tokens", "mix_copies", "mix_block"]
    mixed = M.mix(clashing)
    assert rows(mixed.select(*cols)) == rows(got.select(*cols))
    assert M.realised(mixed, ["doc_id", "text", "__left", "use", "dotted.name"]).count() == sum(r.mix_copies for r in got.collect())
    assert M.mix(empty, max_repeats=1.0, load=None).count() == 0
