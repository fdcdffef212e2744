"""The verdict of the quality rules and the copies of a mixture, against plain Python."""

import math
from collections import defaultdict

import regex
from pyspark.sql import functions as F

from lodestar.llm import mixing as M
from lodestar.llm import quality_rules as Q

SF = "/root/testdata/sf0.001"
WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def verdict(text):
    """(n_bad_lines, kept) by the rules as their docstring states them, one line and one window at a time."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w in windows if windows.count(w) > 1} if len(set(windows)) < len(windows) else set()
    repeated = len({i + k for i, w in enumerate(windows) if w in often for k in range(5)})
    failed = len(words) < 10 or 100 * repeated > 20 * len(words)
    bad = good = 0
    for line in text.split("\n"):
        size = sum(map(len, WORD.findall(line)))
        if not size:
            continue
        letters, upper = len(regex.findall(r"\p{L}", line)), len(regex.findall(r"\p{Lu}", line))
        shouts = letters >= Q.SHORT and upper > 0.7 * Q.SHORT and upper > 0.7 * letters
        if sum(c in "#*$%&|<>!" for c in line) > 0.08 * size or sum(c in "|»›·•" for c in line) >= 3 or shouts or any(p in line.lower() for p in Q.BOILERPLATE):
            bad += 1
        else:
            good += size
    total = sum(map(len, words))
    return bad, not failed and total > 0 and 1 - good / total <= 0.4 and good > 0


def test_quality_verdict_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    own = ["a " * 9, "HOME | NEWS | SHOP\n" + "the quick brown fox jumps over a lazy dog today\n" * 1, "words that stay in the text and are long enough to count here\nCLICK HERE\nbuy!!! now!!! $$$ #1", None, "", "\n\n", "one two three four five " * 6]
    more = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(own)], "doc_id long, text string")
    rows = docs.unionByName(more)
    got = {r.doc_id: (r.n_bad_lines, r.kept) for r in Q.quality_rules(rows).select("doc_id", "n_bad_lines", "kept").collect()}
    want = {r.doc_id: verdict(r.text) for r in rows.collect()}
    assert got == want and {k for _, k in got.values()} == {True, False} and any(b for b, _ in got.values())


def plain_copies(rows, target, repeats, load):
    """rows (source, block, hash, tokens, order of the block, order inside it) -> {(source, hash): copies}: temperature, budgets and
    permutations one after another."""
    supply = defaultdict(int)
    for r in rows:
        supply[r.source] += r.tokens
    total = sum(supply.values())
    p = {s: n / total for s, n in supply.items() if n}

    def weights(t):
        z = sum(x**t for x in p.values())
        return {s: x**t / z for s, x in p.items()}

    def spread(t):
        return -sum(w * math.log(w) for w in weights(t).values())

    def worst(t):
        return max(w * load * total / supply[s] for s, w in weights(t).items())

    def smallest(good):
        low, high = 0.0, 1.0
        if good(low) or not good(high):
            return low if good(low) else high
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if good(mid) else (mid, high)
        return high

    t = max(smallest(lambda t: spread(t) <= target * math.log(len(p))), smallest(lambda t: worst(t) <= repeats * (1 + 1e-12)))
    out = {}
    for s, w in weights(t).items():
        passes, left = divmod(round(w * load * total), supply[s])
        for r in sorted((r for r in rows if r.source == s), key=lambda r: (r.block_order, r.block, r.inside, r.hash)):
            out[s, r.hash] = passes + (left > 0)
            left -= r.tokens
    return out


def test_mixture_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").where("text IS NOT NULL")
    # Sources of unlike size, so that the temperature has something to do.
    docs = docs.withColumn("source", F.expr("CASE WHEN doc_id % 20 < 13 THEN 'most' WHEN doc_id % 20 < 19 THEN 'some' ELSE 'few' END"))
    blocks = 64
    tagged = docs.withColumns({"s": F.concat(F.lit("="), "source"), "hash": F.xxhash64(F.col("doc_id").cast("string"), "text")}).withColumn("block", F.pmod("hash", F.lit(blocks)).cast("int"))
    tagged = tagged.withColumns({"block_order": F.xxhash64(F.lit(0), "s", "block"), "inside": F.xxhash64(F.lit(0), "hash")})
    rows = tagged.collect()
    sizes = {r.hash: len(WORD.findall(r.text)) for r in rows}

    class Row:
        def __init__(self, r):
            self.source, self.block, self.hash, self.tokens, self.block_order, self.inside = r.source, r.block, r.hash, sizes[r.hash], r.block_order, r.inside

    units = [Row(r) for r in {(r.source, r.hash): r for r in rows}.values()]
    for target, repeats, load in ((0.97, 2.0, 1.0), (0.9, 1.5, 0.5), (1.0, 4.0, 1.3)):
        want = plain_copies(units, target, repeats, load)
        mixed = M.mix(docs, target_entropy=target, max_repeats=repeats, load=load, blocks=blocks)
        got = {(r.source, r.h): r.mix_copies for r in mixed.select("source", "mix_copies", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h")).collect()}
        assert got == want and len(set(got.values())) > 1
