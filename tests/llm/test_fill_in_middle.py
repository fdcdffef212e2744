"""Fill-in-middle against a regular expression, and back."""

import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from lodestar.llm import fill_in_middle as M

from .conftest import SF, rows


def plain(doc_id, text):
    t = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "", re.S)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text or ""
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_equals_regular_expression(spark, docs):
    rnd = random.Random(1)
    parts = ["a", "Z", "word", "[", "`", "{", "@", "é", "日本", "😀", "́", " ", "\n", "\t", "7", "<", "P>", "<P", "S", "<M>", ">", "\x00", "ſ", "K"]
    data = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for i in range(4000)] + [(-5, "negative ids too"), (2**62, "x" * 300_000 + " 😀" * 1000), (5000, None), (5001, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").unionByName(docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    got = M.fill_in_middle(df).withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == df.count() and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_shares_of_forms(spark):
    forms = {r.form: r["count"] for r in M.fill_in_middle(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some words in a row").alias("text"))).groupBy("form").count().collect()}
    assert abs(forms["plain"] / 20_000 - 0.1) < 0.01 and abs(forms["spm"] / 18_000 - 0.2) < 0.01
    none = M.fill_in_middle(spark.range(100).select(F.col("id").alias("doc_id"), F.lit("w w").alias("text")), transformed=0)
    assert none.where("form = 'plain' AND output = text").count() == 100


def test_odd_tables(odd, empty, clashing):
    got = M.fill_in_middle(odd)
    assert got.count() == odd.count() and M.fill_in_middle(empty).count() == 0
    assert got.columns == [*odd.columns, *M.NEW]
    assert rows(got.where("text IS NULL OR text = ''").select("form", "n", "output").distinct()) == [("plain", 0, "")]
    cut = M.fill_in_middle(clashing)
    assert rows(cut.select("doc_id", *M.NEW)) == rows(got.select("doc_id", *M.NEW))
    assert set(cut.columns) == {c for c in clashing.columns if c.lower() not in M.NEW} | set(M.NEW)
    assert cut.select("`dotted.name`", "row", "id", "t").distinct().collect()[0].asDict() == {"dotted.name": "dotted.name", "row": "row", "id": "id", "t": "t"}
    assert got.where(M.restored(F.col("output"), F.col("form")) != F.coalesce("text", F.lit(""))).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = M.query(spark, SF)
    want = con.execute(M.SQL).df()[got.columns].astype(object)
    assert rows(got) == sorted((tuple(None if x != x else x for x in r) for r in want.where(want.notna(), float("nan")).itertuples(index=False)), key=repr)
