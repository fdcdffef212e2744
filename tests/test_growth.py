"""Steps whose rows or work must not grow faster than their tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import cells as C
from lodestar.operators import coclicks
from lodestar.operators import signals as G
from lodestar.operators import threshold
from lodestar.operators import understand as U
from lodestar.operators import vector as V
from lodestar.plans import retrieval as P

SF = "/root/testdata/sf0.001"


def test_a_question_goes_once_to_a_pack_of_shells(spark):
    x = np.random.default_rng(3).normal(size=(400, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    c = C.build(rows, per_cell=20)
    assert len(c.shells.n) > 5 and set(C._packs(c.shells)) == {0}
    asked = rows.select(F.col("id").cast("string").alias("key"), "vec").withColumn("floor", F.lit(-1.0))
    later = C._visits(asked, c.shells, 3, False, True)
    assert later.count() == 400  # one row each, not one for every shell
    assert later.agg(F.max(F.size("shells"))).first()[0] > 5


def test_packs_are_bounded_and_large_shells_stand_alone():
    n = np.array([10_000, 5_000, 3_000, 40_000, 1, 2])
    shells = C.Shells(np.zeros((1, 2)), n * 0, n * 0.0, n * 0.0, n, -(-n // C.BLOCK))
    assert C._packs(shells).tolist() == [0, 0, 1, 2, 3, 3]


def test_texts_are_made_behind_the_deal(spark):
    for df in (P.vectors(spark, SF), P.index(spark, SF).lengths):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "translate" not in plan[plan.index("RepartitionByExpression") :]


def test_a_word_of_all_services_is_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        own = P.dealt(spark, SF)
        catalog = threshold.index(own, P.index(spark, SF), P.vectors(spark, SF), f"file://{tmp_path}/index", per_cell=8)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    word = catalog.bm25.postings.where("term = 'size'").select(F.input_file_name().alias("f")).distinct().count()
    assert word > 1


def test_equal_groups_of_synonyms_make_no_ties(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(U, "components", lambda edges, f=U.components: (seen.append(edges.count()), f(edges))[1])
    pairs = [(i, "a", w) for i in range(50) for w in ("a", "b")] + [(50, "c", "c"), (50, "c", "b"), (51, "d", "d")]
    got = U.synonym_groups(spark.createDataFrame(pairs, "ord int, canonical string, word string"))
    assert {tuple(r) for r in got.collect()} == {("a", 0, "a"), ("b", 0, "a"), ("c", 0, "a"), ("d", 51, "d")}
    assert seen == [1]


def test_rows_of_one_id_and_long_texts_are_one_sum(spark):
    texts = [("a", "x y"), ("a", "y"), ("b", "x y y"), ("c", " "), ("d", None), ("e", "x y y " * 20_000)]
    got = {r.id: r.vec for r in V.hash_embedding(spark.createDataFrame(texts, "id string, text string"), "id", "text").collect()}
    assert set(got) == {"a", "b", "e"}
    assert np.allclose(got["a"], got["b"], atol=1e-12) and np.allclose(got["a"], got["e"], atol=1e-12)
    assert abs(np.linalg.norm(got["a"]) - 1) < 1e-12


def test_pairs_are_dealt_without_their_vectors(spark):
    asked = threshold.Asked(P.S.query_batch(spark), P.services_index(spark, SF), P.popularity(spark, SF))
    df = asked.visited(asked.bounds)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in text and "aggregate(" not in text.splitlines()[0]  # the cosine lies below the joins with words and popularity


@pytest.mark.parametrize("held", [8_000_000, 10])
def test_no_more_co_clicks_than_count_leave_a_task(spark, monkeypatch, held):
    clicks = spark.createDataFrame([(u, f"s{s:02}", s == 3) for u in range(90) for s in {u * 7 % 19, u * 5 % 13 + 10, u * 3 % 11}], "user_id long, service_id string, deprecated boolean")
    every, most = sorted(map(tuple, G.collaborative(clicks).collect())), Counter()
    want = [r for r in sorted(every, key=lambda r: (r[0], -r[2], r[1])) if most.update([r[0]]) or most[r[0]] <= 2]
    assert sorted(map(tuple, G.collaborative(clicks, best=2).collect())) == sorted(want) and len(want) < len(every)
    sizes = []
    run = coclicks._sums
    for name, value in (("ASKING", 30), ("COUNTED", 25), ("LEAST", 20), ("HELD", held)):
        monkeypatch.setattr(coclicks, name, value)
    monkeypatch.setattr(coclicks, "_sums", lambda *a: (sizes.append(a), run(*a))[1])
    assert sorted(map(tuple, coclicks.by_profiles(clicks, best=2).collect())) == sorted(want)
    assert sorted(map(tuple, coclicks.by_profiles(clicks).collect())) == every
    assert [a[2] for a in sizes] == [2, None]


def test_related_services_of_clicked_ones_alone(spark):
    from lodestar.plans import behaviour

    clicked = {r.service_id for r in P.S.clicks(spark, SF).collect()}
    assert {r.service_id for r in behaviour._related(spark, SF).collect()} <= clicked


def test_vectors_and_matches_of_all_services_are_not_broadcast(spark):
    """hybrid_semantic and bm25_multifield: the file of part is small beside what comes from it."""
    for df, key in ((P.scored(spark, SF, "semantic"), "kvec"), (P.bm25_multifield(spark, SF), "LeftOuter")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert key in plan and any("LeftOuter" in line and "rightHint=(strategy=merge)" in line for line in plan.splitlines())


@pytest.mark.parametrize("named", [64, 1])
def test_postings_of_the_batch_are_read_by_name(spark, monkeypatch, named):
    """candidate_prune: passes over the postings skip the pages of other words, where the batch has few; the result is the same with many."""
    monkeypatch.setattr(threshold, "NAMED", named)
    catalog, batch = P.services_index(spark, SF), P.S.query_batch(spark).where("query_id IN (1, 4, 9)")
    asked = threshold.Asked(batch, catalog, P.popularity(spark, SF), "bmn")
    for df in (asked.catalog.bm25.postings, asked.catalog.tops):
        assert ("Or(EqualTo(term,ring),EqualTo(term," in df._jdf.queryExecution().executedPlan().toString()) == (named > 1)
    words = {r.term for r in asked.catalog.bm25.postings.select("term").distinct().collect()}
    assert words == {"small", "ring"} if named > 1 else len(words) > 2
    got = asked.best(50).best.select("query_id", "service_id", "bmn").collect()
    want = P.retrieve.scores(batch, P.kb(spark, SF), P.batch_index(spark, SF), P.popularity(spark, SF), "keyword").select("query_id", "service_id", "bmn")
    exact = {(r.query_id, r.service_id): r.bmn for r in want.collect()}
    assert len(got) == 150 and all(abs(exact[r.query_id, r.service_id] - r.bmn) < 1e-9 for r in got)


def test_the_index_joins_vectors_and_sorts_no_postings_to_place_them(spark, monkeypatch, tmp_path):
    """candidate_prune: services meet their vectors once, not for each pass over them; postings meet their service without being sorted."""
    seen, names = [], []
    monkeypatch.setattr(threshold, "stored", lambda df, name, f=threshold.stored: (names.append(name), f(df, name))[1])
    monkeypatch.setattr(threshold.C, "build", lambda rows, per_cell, f=threshold.C.build: (seen.append(rows._jdf.queryExecution().optimizedPlan().toString()), f(rows, per_cell=per_cell))[1])
    hints, hint = [], type(spark.range(0)).hint
    monkeypatch.setattr(type(spark.range(0)), "hint", lambda self, name, *a: (hints.append(name), hint(self, name, *a))[1])
    texts = spark.createDataFrame([(f"s{i}", i, f"w{i % 7} w{i % 3}") for i in range(40)], "service_id string, ord long, searchable string")
    bm25 = threshold.B.build(texts.select(F.col("service_id").alias("id"), F.lit("a").alias("field"), F.lit(1.0).alias("weight"), F.col("searchable").alias("text")))
    catalog = threshold.index(texts, bm25, V.hash_embedding(texts, "service_id", "searchable"), f"file://{tmp_path}/index", per_cell=8)
    assert names == ["own"] and "Join" not in seen[0] and hints == ["shuffle_hash"]
    assert catalog.services.count() == 40 and catalog.bm25.postings.count() == bm25.postings.count()
