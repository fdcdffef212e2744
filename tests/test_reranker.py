"""The reranker's network against plain Python, its gradients against differences, and what training gains; attribution and co-clicks of heavy users."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.engine import Engine
from lodestar.operators import coclicks, dcn
from lodestar.operators import signals as G
from lodestar.operators import vector as V
from lodestar.sources import tables as S

NOW, SF = 1_700_000_000.0, "/root/testdata/sf0.001"
RND = np.random.default_rng(4)


def plain_forward(net, i, x):
    """One row, by loops over numbers."""
    x0 = [*net.embedding[i % len(net.embedding)], *x]
    xl = list(x0)
    for experts, gates, bias in net.cross:
        z = [sum(a * g for a, g in zip(xl, col)) for col in gates.T]
        total = sum(math.exp(v) for v in z)
        new = list(xl)
        for k, (u, v, c) in enumerate(experts):
            t1 = [math.tanh(sum(a * b for a, b in zip(xl, col))) for col in v.T]
            t2 = [math.tanh(sum(a * b for a, b in zip(t1, col))) for col in c.T]
            for j in range(len(x0)):
                new[j] += math.exp(z[k]) / total * x0[j] * (sum(a * b for a, b in zip(t2, u[j])) + bias[j])
        xl = new
    h = list(x0)
    for w, b in net.dense:
        h = [max(0.0, sum(a * c for a, c in zip(h, col)) + b[j]) for j, col in enumerate(w.T)]
    w, b = net.out
    return 1 / (1 + math.exp(-(sum(a * c for a, c in zip([*xl, *h], w)) + b)))


def rows(n, services=30):
    idx, x = RND.integers(0, services, n), RND.random((n, len(dcn.DENSE)))
    return idx, x, (x[:, 4] + 0.5 * (idx % 3 == 0) > 0.8).astype(float)


def frame(spark, idx, x, y, group=8):
    data = [(i // group, f"s{i}", int(a), *map(float, b), float(c)) for i, (a, b, c) in enumerate(zip(idx, x, y))]
    return spark.createDataFrame(data, "query_id int, service_id string, idx long, " + ", ".join(f"{c} double" for c in dcn.DENSE) + ", label double").repartition(4)


def test_forward_equals_loops():
    net, (idx, x, _) = dcn.initial(30), rows(20)
    assert net.forward(idx, x) == pytest.approx([plain_forward(net, i, v) for i, v in zip(idx, x)], abs=1e-12)


def test_gradients_equal_differences():
    """Of every array, at several places: embedding, experts, gates, biases, dense and output layers."""
    net, (idx, x, y) = dcn.initial(12), rows(25, 12)
    net = dcn.network(net, [w + 0.05 * RND.standard_normal(w.shape) for w in dcn.arrays(net)])
    loss, g = dcn.gradient(net, idx, x, y)
    p = net.forward(idx, x)
    assert loss == pytest.approx(float(-np.sum(y * np.log(p) + (1 - y) * np.log(1 - p))))
    for k, w in enumerate(dcn.arrays(net)):
        for at in {0, w.size // 2, w.size - 1, int(RND.integers(w.size))}:
            ends = []
            for step in (1e-5, -1e-5):
                moved = [v.copy() for v in dcn.arrays(net)]
                moved[k].ravel()[at] += step
                ends.append(dcn.gradient(dcn.network(net, moved), idx, x, y)[0])
            assert g[k].ravel()[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-5, rel=1e-4), (k, at)


def test_summed_over_tasks(spark):
    net, (idx, x, y) = dcn.initial(30), rows(200)
    loss, g, n = dcn.summed(frame(spark, idx, x, y), net)
    want, grads = dcn.gradient(net, idx, x, y)
    assert n == 200 and loss == pytest.approx(want) and all(a == pytest.approx(b, abs=1e-9) for a, b in zip(g, grads))


def test_training_beats_the_fixed_weights_on_rows_held_out(spark):
    """Clicks follow popularity and the service, which the fixed weights don't look at."""
    idx, x, y = rows(2400)
    net, losses = dcn.train(frame(spark, idx[:1600], x[:1600], y[:1600]).cache(), dcn.initial(30), steps=25, rate=0.05)
    assert losses[-1] < 0.6 * losses[0]
    held = frame(spark, idx[1600:], x[1600:], y[1600:]).withColumn("fixed", F.expr("0.5 * cosine + 0.3 * score + 0.1 * name_ov + 0.1 * intro_ov"))
    got = held.join(dcn.score(held, net), ["query_id", "service_id"]).collect()

    def pairs(of):
        by = defaultdict(list)
        for r in got:
            by[r.query_id].append((r[of], r.label))
        won = [a > b for v in by.values() for a, p in v for b, q in v if p > q]
        return sum(won) / len(won)

    assert pairs("dcn_score") > 0.85 > 0.65 > pairs("fixed")
    spark.catalog.clearCache()


def test_saved_weights_come_back(spark, tmp_path):
    net = dcn.initial(10)
    dcn.save(spark, net, f"file://{tmp_path}/w")
    assert all(np.array_equal(a, b) for a, b in zip(dcn.arrays(net), dcn.arrays(dcn.load(spark, f"file://{tmp_path}/w", 10))))


def test_engine_trains_and_ranks_by_the_weights(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    e.import_catalog(S.catalog(spark, SF).where("ord < 30"), "v1", NOW)
    assert not e.train_reranker(NOW)["trained"] and e.network is None
    names = [r.service_name for r in e.kb.orderBy("ord").collect()]
    e.record("queries", spark.createDataFrame([(i, i % 5, names[i % 30], NOW + i) for i in range(60)], "id long, user_id long, query string, ts double"))
    e.record("clicks", spark.createDataFrame([(i, i % 5, f"p{i % 30}", NOW + i + 0.5) for i in range(60)], "id long, user_id long, service_id string, ts double"))
    done = e.train_reranker(NOW + 100, steps=4)
    assert done["trained"] and (done["positives"], done["negatives"], done["round"]) == (60, 180, 1) and done["losses"][-1] < done["losses"][0]
    batch = spark.createDataFrame([(1, 1, "ring")], "query_id long, user_id long, text string")
    top = e.recall(batch, NOW)
    got = {r.service_id: r.rerank_score for r in e._reranked(top, batch, NOW).collect()}
    again = Engine(spark, f"file://{tmp_path}")
    again.open()  # another process finds the newest round
    assert {r.service_id: r.rerank_score for r in again._reranked(top, batch, NOW).collect()} == got and 0 < min(got.values()) and max(got.values()) < 1
    e.import_catalog(S.catalog(spark, SF).where("ord < 20"), "v2", NOW)
    assert e.network is None


def brute_as_of(left, right):
    out = {}
    for i, user, ts in left:
        best = max(((t, j, v) for j, u, t, v in right if u == user and ts is not None and t <= ts), default=(None, None, None))
        out[i] = best[1:]
    return out


@pytest.mark.parametrize("segments", [1, 4, 32])
def test_as_of_in_segments(spark, segments):
    """A user with half of all rows, equal times, users with offers long before, none at all, and rows without a time."""
    rnd = random.Random(segments)
    user = lambda: 1 if rnd.random() < 0.5 else rnd.randint(2, 30)
    left = [(i, user(), float(rnd.randint(0, 400)) if rnd.random() < 0.97 else None) for i in range(600)] + [(9999, 77, 399.0), (9998, 78, 5.0)]
    right = [(i, user(), float(rnd.randint(0, 400)), f"q{i}" if rnd.random() < 0.95 else None) for i in range(300)] + [(5000, 77, 0.0, "early")]
    a = spark.createDataFrame(left, "id long, user_id long, ts double")
    b = spark.createDataFrame(right, "id long, user_id long, ts double, query string")
    got = {r.id: (r.matched_id, r.matched) for r in G.as_of(a, b, "query", segments=segments).collect()}
    assert got == brute_as_of(left, right)
    assert G.as_of(a.limit(0), b, "query", segments=segments).count() == 0 and G.as_of(a, b.limit(0), "query", segments=segments).where("matched_id IS NULL").count() == len(left)


def test_heavy_users_and_services_are_many_tasks(spark, monkeypatch):
    """Half of the rows of one user, or of the clicks of one service, are dealt to keys of their own."""
    monkeypatch.setattr(G, "HEAVY", 20)
    rnd = random.Random(2)
    rows = sorted({(u, "hot" if rnd.random() < 0.5 else f"s{rnd.randint(0, 30)}") for u in rnd.choices(range(150), k=600)})
    clicks = spark.createDataFrame([(u, s, s == "s3") for u, s in rows], "user_id long, service_id string, deprecated boolean")
    by, live = defaultdict(set), defaultdict(set)
    for u, s in rows:
        by[s].add(u)
        if s != "s3":
            live[u].add(s)
    want = {}
    for u in live:
        for o in {o for s in live[u] for o in by[s]} - {u}:
            for s in live[o] - live[u]:
                want[u, s] = want.get((u, s), 0) + 1
    found = G.collaborative(clicks)
    assert {(r.user_id, r.service_id): r.co_count for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "block" in plan


@pytest.mark.parametrize("blocks", [(8_192, 65_536, 4_000_000, 128), (7, 9, 4_000_000, 4), (20, 100, 50, 16)])
def test_co_clicks_without_rows_for_pairs(spark, monkeypatch, blocks):
    """Beyond MAX_PAIRS profiles meet in blocks: the same counts, also for some users alone and for users of one profile; no pair is shuffled."""
    clicks = spark.createDataFrame([(u, f"s{s}", s == 3) for u in range(120) for s in {(u % 40) * 7 % 19, (u % 40) * 5 % 13 + 10, 3 if u % 2 else 4}] + [(500, "alone", False), (501, "s3", True), (None, "s1", False)], "user_id long, service_id string, deprecated boolean")
    some = clicks.where("user_id % 7 = 0").select("user_id")
    want = [{tuple(r) for r in G.collaborative(clicks, u).collect()} for u in (None, some)]
    monkeypatch.setattr(G, "MAX_PAIRS", 0)
    sizes = dict(zip(("ASKING", "COUNTED", "ENTRIES", "GROUP"), blocks))
    for name, value in sizes.items():
        monkeypatch.setattr(coclicks, name, value)
    run = coclicks._counts
    monkeypatch.setattr(coclicks, "_counts", lambda a, b: (setattr(coclicks, "GROUP", sizes["GROUP"]), run(a, b))[1])
    found = [G.collaborative(clicks, u) for u in (None, some)]
    assert [{tuple(r) for r in f.collect()} for f in found] == want and all(want)
    assert "other" not in found[0]._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_clicks_are_one_sample_with_a_count(spark):
    """The gradient is that of all rows, and no pair is dealt out by its query."""
    names = ["red bolt", "blue ring", "hot gear"]
    kb = spark.createDataFrame([(f"s{i}", i, names[i % 3], f"size {names[i % 3]} {i}") for i in range(12)], "service_id string, ord long, service_name string, service_intro string")
    pairs = spark.createDataFrame([(i, names[i % 3], f"s{i % 4}", 1) for i in range(60)] + [(i, names[i % 3], f"s{i % 12}", 0) for i in range(60)], "id long, query string, service_id string, label int")
    vec = V.hash_embedding(kb, "service_id", "service_intro")
    pop = spark.createDataFrame([(f"s{i}", float(i)) for i in range(4)], "service_id string, popularity double")
    every, few = (dcn.samples(p, kb, vec, pop, V.hash_embedding) for p in (pairs, dcn.grouped(pairs)))
    assert every.count() == 120 and few.count() == 72
    net = dcn.initial(12)
    (loss, g, n), (loss_, g_, n_) = dcn.summed(every, net), dcn.summed(few, net)
    assert n == n_ == 120 and np.isclose(loss, loss_) and all(np.allclose(a, b) for a, b in zip(g, g_))
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
