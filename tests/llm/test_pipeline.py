import hashlib

import corpus_pipeline as C
from lodestar.llm import bpe, mixing, simhash
from lodestar.llm import line_dedup as L
from lodestar.llm.common import stored

from .test_native import brute_lines
from .test_simhash import brute, naive

SF = "/root/testdata/sf0.01"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = stored(C.quality(spark, docs, SF), "t")
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns
    assert all(i in kept for i, q in labels.items() if q) and sum(i in kept for i, q in labels.items() if not q) <= 3
    lines = stored(C.lines(spark, good, SF), "t")
    want = {i: t for i, t, _, _ in brute_lines([(r.doc_id, r.text) for r in good.collect()])}
    assert {r.doc_id: r.text for r in lines.collect()} == want and all(r.n_chars == len(r.text) for r in lines.collect())
    near = stored(C.near_duplicates(spark, lines, SF), "t")
    assert {r.doc_id for r in near.collect()} == set(brute(sorted((i, naive(t)) for i, t in want.items())).values())
    mixed = stored(C.mixture(spark, near, SF), "t")
    ids = [r.doc_id for r in mixed.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in near.collect()} and mixed.columns == docs.columns
    out = C.tokens(spark, mixed, SF).collect()
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert sorted(r.doc_id for r in out) == sorted(ids)
    for r in out[:50]:
        assert r.decoded_sha256 == hashlib.sha256(bpe.decode(r.ids).encode()).hexdigest() and r.n_tokens == len(r.ids)
        assert bpe.load(bpe.default_vocabulary()).encode_batch([text[r.doc_id]])[0][1] == bpe.decode(r.ids)


def test_run_equals_stages(spark):
    got = {r.doc_id: r.ids_sha256 for r in C.run(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in C.STAGES:
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), "t")
    assert got == {r.doc_id: r.ids_sha256 for r in docs.collect()}


def test_stages_on_odd_tables(spark, odd, empty, clashing, tmp_path):
    """Nulls, empty and very long texts, repeated rows, no rows at all, and columns named like those inside the operators."""
    labels = spark.createDataFrame([(5, 1, 0), (3, 1, 0), (10, 1, 0), (None, 0, 1), (11, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in C.STAGES:
        for df in (odd, empty, clashing):
            got = stored(stage(spark, df, f"file://{tmp_path}"), "t")
            assert name == "tokens" or got.columns == df.columns, name
            assert df is not empty or got.count() == 0
        if name in ("lines", "tokens"):
            assert got.count() == odd.count()
    assert sorted((r.doc_id or 0, r.text or "") for r in C.lines(spark, clashing, "").collect()) == sorted((r.doc_id or 0, r.text or "") for r in C.lines(spark, odd, "").collect())


def test_stages_name_operators():
    assert [n for n, _ in C.STAGES] == ["quality", "lines", "near_duplicates", "mixture", "tokens"]
    assert L and mixing and simhash


def test_a_tiny_source_does_not_shrink_the_mixture(spark):
    """A source with a third of the tokens, 19 others, and one of two words: the others stay."""
    sources = ["hot"] * 950 + [f"s{i % 19}" for i in range(1900)]
    data = [(i, "ten words that are all alike in each text here", s, "en", 46) for i, s in enumerate(sources)]
    tiny = [(9999, "two words", None, "en", 9)]
    share = {}
    for name, rows in (("plain", data), ("tiny", data + tiny)):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
        used = [r.doc_id for r in C.mixture(spark, docs, SF).collect()]
        share[name] = len(set(used)) / len(rows)
        assert abs(len(used) - len(rows)) <= 25  # the budget is all tokens, met to a document of each source
        assert max(used.count(i) for i in set(used[:50])) <= 2
    print("kept share", share)
    assert share["tiny"] >= share["plain"] - 0.01 and share["plain"] > 0.75
