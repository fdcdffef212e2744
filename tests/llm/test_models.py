"""Toxicity and quality classifiers: held-out accuracy, bounds, odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import quality_classifier as Q
from lodestar.llm import toxicity as T
from lodestar.llm import training

from .conftest import rows

SF = "/root/testdata/sf0.1"


def test_fold(spark):
    df = spark.createDataFrame([(1,), (77,), (None,)], "i long")
    assert [r[0] for r in df.select(training.fold(F.col("i"), 5)).collect()] == [zlib.crc32(b"1") % 5, zlib.crc32(b"77") % 5, 0]


def test_sample_bound_and_repeatability(spark):
    df = spark.range(20_000).select(F.col("id").alias("i"), F.lit("x").alias("t"))
    a = rows(training.sample(df, "i", "t", 1_000, "x"))
    assert 800 < len(a) < 1_200 and a == rows(training.sample(df, "i", "t", 1_000, "x"))
    assert training.sample(df.limit(10), "i", "t", 1_000, "x").count() == 10


def test_sample_of_odd_tables(spark):
    """Null ids, one id, repeated ids, repeated rows, and a hot id with a third of the rows: neither empty nor over the bound."""
    base = spark.range(30_000)
    text = F.concat(F.lit("t"), F.col("id"))
    ids = {"null": F.lit(None).cast("long"), "one": F.lit(7), "repeated": F.col("id") % 150, "hot": F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id"))}
    for name, i in ids.items():
        assert 750 < training.sample(base.select(i.alias("i"), text.alias("t")), "i", "t", 1_000, "x").count() < 1_500, name
    same = base.select(F.lit(7).alias("i"), F.lit("same").alias("t"))
    assert training.sample(same, "i", "t", 1_000, "x").count() == 1
    few = base.select((F.col("id") % 150).alias("i"), F.lit("same").alias("t"))
    assert training.sample(few, "i", "t", 100, "x").count() in range(60, 150)


def test_sample_at_any_size(spark, monkeypatch):
    """At 1e11 rows the limit still lets the wanted share through."""
    for n in (10**6, 2 * 10**10, 10**11, 10**15):
        assert abs(training.limit_of(12_000, n) / training.HASHES * n / 12_000 - 1) < 0.01
    df = spark.range(200_000).select(F.col("id").alias("i"), F.lit("x").alias("t"))
    monkeypatch.setattr(training, "sizes", lambda rows, id_col: (10**11, 10**11))
    assert 700 < training.sample(df, "i", "t", 5 * 10**8, "x").count() < 1_300


def test_labelled_rows_are_bounded(spark):
    """Each id has 200 rows: one of them counts."""
    docs = spark.range(40_000).select((F.col("id") % 200).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    got = training.labelled_rows(docs, labels, "toxic", F.lit(True), 100, "doc_id", "text")
    assert 60 < got.count() <= 150 and rows(got) == rows(got) and got.select("__id").distinct().count() == got.count()


def test_toxicity_training_equals_local_fit(spark):
    """Counted and looked up on the executors, the model is the one that fit() makes from the same texts."""
    data = [(i, f"Some plain words here. You are a {w} person. More plain words number {i % 7}.", y) for i, (w, y) in enumerate([("clod", 1), ("lout", 1), ("good", 0), ("fine", 0), ("kind", 0), ("calm", 0)] * 30)]
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int").repartition(3)
    got = T.train(df, df.select("doc_id", "toxic"))
    want = T.fit([(t, y) for i, t, y in data if zlib.crc32(str(i).encode()) % 5])
    assert got.weights.keys() == want.weights.keys() and all(abs(got.weights[w] - want.weights[w]) < 1e-6 for w in want.weights) and abs(got.bias - want.bias) < 1e-6


def test_scores_at_the_threshold(spark):
    """A score of exactly 0.5 or 0.7 counts as reached."""
    m = T.Model({"even": 0.0}, 0.0)  # one sentence, logit 0
    df = spark.createDataFrame([(1, "even"), (2, "")], "doc_id long, text string")
    assert [r.score for r in T.score(df, m).orderBy("doc_id").collect()] == [0.5, 0.0]
    assert [[tuple(x) for x in r.sentences] for r in T.score(df, m).orderBy("doc_id").collect()] == [[(0, 4, 0.5)], []]
    flat = Q.Model(np.zeros(16), np.ones(16), (np.zeros((16, 1)), np.zeros(1), np.zeros(1), 0.0))
    assert Q.keep_good(df, flat, threshold=0.5).count() == 2 and Q.keep_good(df, flat, threshold=0.5000001).count() == 0


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in T.query(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    hits = [r.predicted == labels[r.doc_id] for r in got]
    caught = [r.predicted for r in got if labels[r.doc_id]]
    assert np.mean(hits) > 0.96 and np.mean(caught) > 0.75


def test_toxicity_locates(spark):
    rows_ = [(f"Some plain words here. You are a {w} person. More plain words number {i}.", 1) for i, w in enumerate(["clod", "lout"] * 30)]
    rows_ += [(f"Some plain words here. You are a good person. More plain words number {i}.", 0) for i in range(120)]
    model = T.fit(rows_)
    text = "A fine start. What a lout he is! The end."
    score, found = model.score(text)
    assert score > 0.5 and [text[a:b].strip() for a, b, p in found if p >= 0.5] == ["What a lout he is"]
    assert model.score("A fine start. The end.")[0] < 0.2 and model.score("")[0] == 0


def test_noisy_or():
    m = T.Model({"bad": 3.0}, -4.0)
    p, q = 1 / (1 + np.exp(1)), 1 / (1 + np.exp(4))
    assert abs(m.score("so bad. so good. bad bad!")[0] - (1 - (1 - p) ** 2 * (1 - q))) < 1e-12


def test_toxicity_odd_rows(odd, empty, clashing):
    m = T.Model({"short": 9.0}, -5.0)
    got = T.score(odd, m)
    by = {r.doc_id: r.score for r in got.collect()}
    assert by[7] == by[8] == 0 and by[11] > 0.9 and got.count() == odd.count()
    assert T.score(empty, m).count() == 0 and rows(T.score(clashing, m)) == rows(got)
    assert T.fit([]).score("anything")[0] < 0.01 and T.fit([("a", 1)]).score("b")[0] > 0.9


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in Q.query(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    good, bad = [r.predicted for r in got if labels[r.doc_id]], [r.predicted for r in got if not labels[r.doc_id]]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15


def test_quality_odd_rows(odd, empty, clashing, spark):
    rng = np.random.default_rng(0)
    m = Q.fit(rng.normal(1, 0.1, (50, 16)), rng.normal(0, 1, (80, 16)), 0.5)
    got = Q.score(odd, m)
    assert got.count() == odd.count() and all(0 <= r.score <= 1 for r in got.collect())
    assert Q.score(empty, m).count() == 0 and rows(Q.score(clashing, m)) == rows(got)
    assert Q.keep_good(clashing, m).columns == clashing.columns and Q.keep_good(empty, m).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert abs(Q.score(odd, Q.train(odd, none)).first().score - 0.5) < 1e-9
    assert T.score(odd, T.train(odd, none)).count() == odd.count()
    labels = spark.createDataFrame([(5, 1, None), (None, 1, 1), (3, None, 0), (11, 0, 1), (11, 0, 1)], "doc_id long, quality int, toxic int")
    assert Q.score(odd, Q.train(odd, labels)).count() == odd.count() and T.score(odd, T.train(odd, labels)).count() == odd.count()


def test_risk_is_not_negative():
    """With positives and unlabelled rows that are all alike, the scores settle near the prior's side, not at a runaway fit."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (200, 16))
    s = Q.fit(x[:60], x[60:], 0.9).score(rng.normal(0, 1, (200, 16)))
    assert 0.6 < s.mean() <= 1
