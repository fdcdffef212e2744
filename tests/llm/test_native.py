"""Line dedup, sharding and quality rules."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.llm import line_dedup as L
from lodestar.llm import quality_rules as Q
from lodestar.llm import sharding as H

from .conftest import SF, rows

SPACE = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_lines(docs, min_docs=2, min_chars=10):
    holders = defaultdict(set)
    number = lambda i: -(2**63) if i is None else i
    for i, t in docs:
        for x in (t or "").split("\n"):
            holders[lower(x.strip(SPACE))].add(number(i))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        drop = [len(k := lower(x.strip(SPACE))) >= min_chars and len(holders[k]) >= min_docs and number(i) != min(holders[k]) for x in lines]
        out.append((i, "\n".join(x for x, d in zip(lines, drop) if not d), len(lines), sum(drop)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_equal_brute_force(docs, odd, min_docs):
    for df in (docs, odd):
        data = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = L.dedup_lines(df.select("doc_id", "text"), min_docs=min_docs)
        assert rows(got) == brute_lines(data, min_docs)


def test_lines_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert rows(L.query(spark, SF)) == sorted(con.sql(L.SQL).fetchall(), key=repr)


def test_lines_empty_and_clashing(empty, clashing, odd):
    assert L.dedup_lines(empty).count() == 0
    got = L.dedup_lines(clashing)
    assert {c.lower() for c in got.columns} == {c.lower() for c in clashing.columns} | {"n_lines"} and len(got.columns) == len(clashing.columns)
    assert {r["__id"] for r in got.collect()} == {"__id"} and {r["dotted.name"] for r in got.collect()} == {"dotted.name"}
    assert rows(got.select("doc_id", "text", "n_lines", "n_dropped")) == rows(L.dedup_lines(odd).select("doc_id", "text", "n_lines", "n_dropped"))


def test_shards(docs, odd, empty, clashing):
    for df in (docs, odd, clashing):
        got = H.shard_rows(df, shards=4).collect()
        data = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == data
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert r.law == "bytes" and r.grown_shard is None
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert H.shard_rows(empty).count() == 0


def test_shards_are_even(spark):
    held = Counter()
    for r in H.query(spark, "/root/testdata/sf0.01").collect():
        held[r.shard] += r["size"]
    assert len(held) == 40 and max(held.values()) - min(held.values()) < 0.02 * max(held.values())


def test_repeated_rows_are_spread(spark):
    """Ten rows in eleven are exact repeats without an id; the repeats are written out in parts."""
    same = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text in every row").alias("text"))
    others = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("other text "), F.col("id")).alias("text"))
    held, slots = Counter(), defaultdict(list)
    for r in H.shard_rows(same.union(others)).collect():
        held[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(held) == 40 and max(held.values()) < 1.02 * min(held.values())
    assert sum(map(len, slots.values())) == 22_000 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_map_is_edited_when_shards_are_added(spark, docs, tmp_path):
    """The public call: 8 shards, again 8, then 9; only rows that go to the new shard move."""
    path = f"file://{tmp_path}/map"
    one, same, more = ({r.doc_id: r.shard for r in H.shard_rows(docs, shards=n, map_path=path).collect()} for n in (8, 8, 9))
    assert one == same and set(more.values()) == set(range(9))
    assert {more[i] for i in one if one[i] != more[i]} == {8} and H.last_version(spark, path) == 3
    assert H.last_version(spark, f"{path}/none") == 0


def test_map_edits_and_versions(spark, tmp_path):
    stats = [{"virtual_slot": i, "bytes": 100 + i % 7, "rows": 1} for i in range(400)]
    one = H.new_map(stats, 8)
    more = H.rebalanced(one, stats, 9)
    held = Counter()
    for r in stats:
        held[more[r["virtual_slot"]]] += r["bytes"]
    assert len(held) == 9 and max(held.values()) <= 1.02 * sum(held.values()) / 9
    moved = [s for s in one if one[s] != more[s]]
    assert len(moved) < 60 and {more[s] for s in moved} == {8}
    fewer = H.rebalanced(one, stats, 7)
    assert set(fewer.values()) == set(range(7))
    H.write_map(H.map_frame(spark, one, stats), str(tmp_path), 1)
    H.write_map(H.map_frame(spark, more, stats), str(tmp_path), 2)
    assert {r.virtual_slot: r.shard for r in H.read_map(spark, str(tmp_path), 1).collect()} == one
    assert {r.virtual_slot: r.shard for r in H.read_map(spark, str(tmp_path), 2).collect()} == more
    with pytest.raises(Exception):
        H.write_map(H.map_frame(spark, more, stats), str(tmp_path), 2)


def brute_quality(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if x.strip(SPACE)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_counts_equal_brute_force(docs, odd, clashing, empty):
    for df in (docs, odd, clashing):
        got = Q.quality_rules(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert rows(got) == sorted(((r.doc_id, *brute_quality(r.text)) for r in df.select("doc_id", "text").collect()), key=repr)
    assert Q.quality_rules(empty).count() == 0


def test_quality_verdicts(spark):
    good = "This is a plain line of prose that ends well.\n" + "Another one follows it, with other words."
    cases = {
        1: good, 2: good + "\nHome | News | About | Contact", 3: "Home | News | About | Contact | Search | Login | Help | Terms | Jobs | Press",
        4: "BUY NOW!! BEST OFFER!! CLICK TODAY!! NEVER AGAIN!! HURRY UP!! LAST CHANCE!!", 5: good + "\nAll rights reserved.", 6: "", 7: "too short",
    }
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(list(cases.items()), "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r.kept} == {1, 2, 5}
    assert got[2].text == good and got[5].text == good and got[2].n_bad_lines == 1


def test_quality_keeps_good_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [r for r in Q.query(spark, "/root/testdata/sf0.01").collect() if r.doc_id in labels]
    assert all(r.kept for r in got if labels[r.doc_id] and not r.base_failed)
    assert not any(r.kept for r in got if not labels[r.doc_id])


def test_kept_digest(spark):
    r = next(x for x in L.query(spark, SF).collect() if not x.n_dropped)
    text = next(x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect() if x.doc_id == r.doc_id)
    assert r.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()
