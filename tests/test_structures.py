"""Cells, bounds, near words, held texts and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import bm25 as B
from lodestar.operators import cells as C
from lodestar.operators import components as X
from lodestar.operators import fuzzy, retrieve, threshold
from lodestar.operators import understand as U
from lodestar.operators import vector as V

SEED = np.random.default_rng(5)


def frame(spark, x, name="id"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{name} long, vec array<double>").repartition(4)


def brute_top(q, x, k, clamp, exclude):
    s = np.round(C.unit(q) @ C.unit(x).T, 6)
    s = (np.maximum(s, 0) if clamp else s) + 0.0
    out = []
    for i, row in enumerate(s):
        near = [j for j in np.lexsort((np.arange(len(x)), -row)) if not exclude or j != i][:k]
        out += [(i, r + 1, j, row[j]) for r, j in enumerate(near)]
    return sorted(out)


CLUSTERED = np.concatenate([c + 0.05 * SEED.standard_normal((40, 16)) for c in SEED.standard_normal((10, 16))])
TABLES = {
    "even": SEED.standard_normal((300, 16)), "clustered": CLUSTERED, "copies": np.concatenate([np.repeat(CLUSTERED[:1], 200, 0), CLUSTERED[:150]]),
    "zeros": np.concatenate([np.zeros((30, 16)), SEED.standard_normal((60, 16))]), "grid": SEED.integers(-1, 2, (400, 3)).astype(float), "opposite": -np.abs(SEED.standard_normal((80, 4))) * np.array([1, 1, 1, -1]),
    "one": np.ones((1, 16)),
}


@pytest.mark.parametrize("table", TABLES)
@pytest.mark.parametrize(("clamp", "exclude"), [(True, True), (False, False)])
def test_nearest_rows_are_exact(spark, table, clamp, exclude):
    x = TABLES[table]
    got = C.top_k(frame(spark, x, "query_id"), frame(spark, x), 7, clamp=clamp, exclude_self=exclude, block=32, per_cell=20)
    assert sorted((r.query_id, r["rank"], r.id, r.cosine) for r in got.collect()) == brute_top(x, x, 7, clamp, exclude)


def test_queries_of_their_own_and_empty_sides(spark):
    x, q = TABLES["clustered"], SEED.standard_normal((25, 16))
    got = C.top_k(frame(spark, q, "query_id"), frame(spark, x), 5, block=32, per_cell=20)
    assert sorted((r.query_id, r["rank"], r.id, r.cosine) for r in got.collect()) == brute_top(q, x, 5, True, False)
    assert C.top_k(frame(spark, q, "query_id").limit(0), frame(spark, x), 5).count() == 0
    assert C.top_k(frame(spark, q, "query_id"), frame(spark, x).limit(0), 5).count() == 0


def test_clusters_are_met_in_part(spark):
    x = np.concatenate([c + 0.02 * SEED.standard_normal((50, 16)) for c in SEED.standard_normal((40, 16))])
    r = C.visited(frame(spark, x, "query_id"), frame(spark, x), 5, per_cell=40).first()
    assert r.share < 0.3 and r.pairs == round(r.share * r.questions * r.rows)


def test_bounds_hold():
    x, pivots = SEED.standard_normal((200, 8)), C.unit(SEED.standard_normal((6, 8)))
    q = np.concatenate([C.unit(SEED.standard_normal((50, 8))), np.zeros((1, 8))])
    a = C.angles(C.unit(x), pivots)
    cell = a.argmin(axis=1)
    for c in range(6):
        own = C.unit(x)[cell == c]
        if len(own):
            t = a[cell == c, c]
            bound = C.bounds(q, pivots, np.array([c]), np.array([t.min()]), np.array([t.max()]))
            assert (bound[:, 0] >= (q @ own.T).max(axis=1)).all()


@pytest.fixture(scope="module")
def services(spark, tmp_path_factory):
    """A catalog of 600 services of few words, popularity with ties, and its blocks."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"s{i:04}", i, " ".join(rnd.choice(words[: 1 + i % 60]) for _ in range(rnd.randint(0, 6)))) for i in range(600)]
    kb = spark.createDataFrame(rows, "service_id string, ord long, searchable string").repartition(3)
    fields = kb.select(F.col("service_id").alias("id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("field"), F.lit(2.0).alias("weight"), F.col("searchable").alias("text"))
    bm25 = B.build(fields)
    popularity = spark.createDataFrame([(f"s{i:04}", float(rnd.randint(0, 4))) for i in range(0, 600, 3)], "service_id string, popularity double")
    vectors = V.hash_embedding(kb, "service_id", "searchable")
    catalog = threshold.index(kb, bm25, vectors, f"file://{tmp_path_factory.mktemp('index')}", per_cell=8)
    texts = ["w1 w2", "w0", "w59", "zzz", "", "w3 w3 w4", " ".join(words), "w5 zzz", "w7 w8 w9 w10"]
    return kb, bm25, vectors, popularity, catalog, spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


@pytest.mark.parametrize(("mode", "k"), [("hybrid", 20), ("keyword", 5), ("semantic", 20), ("hybrid", 1000)])
def test_threshold_equals_the_full_scan(spark, services, mode, k):
    kb, bm25, vectors, popularity, catalog, batch = services
    want = retrieve.recall(retrieve.scores(batch, kb, bm25, popularity, mode, vectors=vectors), k)
    got = threshold.top(batch, catalog, popularity, mode, k)
    cols = ["query_id", "rank", "service_id", "score"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    near = lambda df: sorted((r.query_id, r.service_id, round(r.cos, 9), round(r.vec, 9), round(r.bmn, 9), round(r.popn, 9)) for r in df.collect())
    assert near(got) == near(want)


def test_signal_lists_equal_the_full_scan(spark, services):
    kb, bm25, vectors, popularity, catalog, batch = services
    want = retrieve.signal_lists(retrieve.scores(batch, kb, bm25, popularity, vectors=vectors), 30)
    got = threshold.signal_lists(batch, catalog, popularity, 30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_few_services_are_scored(spark, tmp_path):
    """Where services lie in families, a query meets some of them: fewer of a hundred the more there are; and by equi-joins alone."""
    rnd, shares = random.Random(8), []
    batch = spark.createDataFrame([(1, "f3x0 f3x1 f3x2"), (2, "f7x4 f7x1 f7x3 f7x2")], "query_id int, text string")
    for n in (200, 2000):
        rows = [(f"s{i}", i, " ".join(rnd.choices([f"f{i % 40}x{j}" for j in range(5)], k=8))) for i in range(n)]
        kb = spark.createDataFrame(rows, "service_id string, ord long, searchable string")
        bm25 = B.build(kb.select(F.col("service_id").alias("id"), F.lit("a").alias("field"), F.lit(1.0).alias("weight"), F.col("searchable").alias("text")))
        vectors, popularity = V.hash_embedding(kb, "service_id", "searchable"), kb.select("service_id", (F.col("ord") % 7).cast("double").alias("popularity"))
        catalog = threshold.index(kb, bm25, vectors, f"file://{tmp_path}/{n}", per_cell=8)
        found = threshold.search(batch, catalog, popularity, "hybrid", 5)
        want = retrieve.recall(retrieve.scores(batch, kb, bm25, popularity, vectors=vectors), 5)
        key = lambda df: sorted((r.query_id, r["rank"], r.service_id) for r in df.collect())
        assert key(found.best) == key(want)
        shares.append(found.met.agg(F.sum("services")).first()[0] / 2 / n)
    assert shares[1] < shares[0] and shares[1] < 0.3, shares
    plan = found.best._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_batch_and_popularity(spark, services):
    kb, bm25, vectors, popularity, catalog, batch = services
    assert threshold.top(batch.limit(0), catalog, popularity).count() == 0
    got = threshold.top(batch, catalog, popularity.limit(0), "hybrid", 5)
    want = retrieve.recall(retrieve.scores(batch, kb, bm25, popularity.limit(0), vectors=vectors), 5)
    assert sorted((r.query_id, r["rank"], r.service_id) for r in got.collect()) == sorted((r.query_id, r["rank"], r.service_id) for r in want.collect())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_near_terms_equal_all_pairs(spark, most):
    """Short and long words, other alphabets, repeated letters: all terms within the distance, whatever their form of key."""
    rnd = random.Random(most)
    words = set()
    for alphabet, longest in (("ab", 8), ("aé日😀", 7), ("abcdefghij", 40)):
        for _ in range(60):
            w = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, longest)))
            words.add(w)
            for _ in range(3):
                at = rnd.randint(0, len(w))
                w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + rnd.choice(alphabet) + w[at:], w[:at] + rnd.choice(alphabet) + w[at + 1 :]])
                words.add(w)
    words = sorted(w for w in words if w)
    tokens, terms = words[::2], [w for w in words[1::2] if len(w) >= 2]
    t = spark.createDataFrame([(w,) for w in tokens], "token string")
    v = spark.createDataFrame([(w,) for w in terms], "term string")
    got = {(r.token, r.term, r.d) for r in fuzzy.near_terms(t, fuzzy.vocabulary_index(v, most), most).collect()}
    assert got == {(a, b, d) for a in tokens for b in terms if (d := distance(a, b)) <= most}


def test_forms_of_a_word(spark):
    r = spark.createDataFrame([("abca",), ("",), ("x",)], "w string").select("w", fuzzy.deletions(F.col("w"), 2).alias("f")).collect()
    assert {x.w: set(x.f) for x in r} == {"abca": {"abca", "bca", "aca", "aba", "abc", "ca", "ba", "bc", "aa", "ac", "ab"}, "": {""}, "x": {"x", ""}}
    assert fuzzy.short_limit(2) == 19 and all(len(x.f) == len(set(x.f)) for x in r)


def test_held_texts_equal_contains(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abé日 ") for _ in range(rnd.randint(0, 12))) for _ in range(200)]
    parts = [(i, "".join(rnd.choice("abé日 ") for _ in range(rnd.randint(0, 5)))) for i in range(300)] + [(999, "xyz"), (1000, texts[3]), (1001, texts[3] + "q")]
    index = fuzzy.gram_index(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = {r.key for r in fuzzy.held(spark.createDataFrame(parts, "key int, part string"), index).collect()}
    assert got == {i for i, p in parts if p and any(p in t for t in texts)}


def test_components_of_long_chains(spark):
    """A chain of 1,000 groups settles in 12 rounds at most, in order and shuffled."""
    for order in (list(range(1001)), random.Random(1).sample(range(1001), 1001)):
        edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
        found, rounds = X.components(edges)
        got = {r.node: r.root for r in found.collect()}
        assert rounds <= 12 and got == dict.fromkeys(range(1001), 0)
    assert X.components(edges.limit(0))[0].count() == 0


def test_synonym_chains_and_additions(spark):
    pairs = spark.createDataFrame([(i, f"c{i}", w) for i in range(200) for w in (f"c{i}", f"t{i}", f"t{i + 1}")] + [(500, "alone", "alone"), (501, "other", "other")], "ord long, canonical string, word string")
    groups = U.synonym_groups(pairs)
    assert {(r.group_id, r.canonical) for r in groups.where("word LIKE 'c%' OR word LIKE 't%'").collect()} == {(0, "c0")}
    more = spark.createDataFrame([(900, "new", "new"), (900, "new", "other"), (901, "joint", "alone"), (901, "joint", "t7")], "ord long, canonical string, word string")
    want = U.synonym_groups(pairs.unionByName(more))
    got = U.add_synonyms(groups, more)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_words_that_sound_alike(spark):
    """By a table of readings: characters of several readings, syllables that run together, unknown characters, no sound at all."""
    table = {"订": ["ding"], "单": ["dan", "shan", "chan"], "丹": ["dan"], "顶": ["ding"], "山": ["shan"], "西": ["xi"], "安": ["an"], "先": ["xian"], "a": [""]}
    readings = spark.createDataFrame([(c, r) for c, rs in table.items() for r in rs], "char string, reading string")
    terms, tokens = ["订单", "西安", "山", "abc", "订单x"], ["订丹", "顶山", "先", "丹", "ABC", "bc", "订单", "a", "订丹X", "", "日"]

    def said(word):
        out = {""}
        for c in word.lower():
            out = {o + r for o in out for r in table.get(c, [c])}
        return out - {""}

    t, v = spark.createDataFrame([(x,) for x in tokens], "token string"), spark.createDataFrame([(x,) for x in terms], "term string")
    got = {r.token: r.candidate for r in U.phonetic(t, v, readings).collect()}
    want = {a: min(near, key=lambda x: (len(x), x)) for a in tokens if a not in terms and (near := [b for b in terms if said(a) & said(b)])}
    assert got == want and got["订丹"] == "订单" and got["先"] == "西安" and got["顶山"] == "订单"
    q = spark.createDataFrame([(1, "先 订丹")], "query_id int, text string")
    far = spark.createDataFrame([("长长西安安",), ("订单",)], "term string")
    assert U.suggest(q, far, readings=readings).first().suggestion == "先 订单"
    assert U.suggest(spark.createDataFrame([(1, "先")], "query_id int, text string"), v, readings=readings).first().suggestion == "西安"
