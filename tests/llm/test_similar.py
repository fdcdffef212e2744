"""Near-duplicates by shingle similarity, and the pipeline's stage that uses it."""

import random

import corpus_pipeline as C
from lodestar.llm import similar as M

from .conftest import rows

SF = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(texts, seed, copies=3):
    """Texts with copies in which some words are replaced: (id, text), and the (original, copy) ids."""
    rnd = random.Random(seed)
    out, pairs = list(enumerate(texts)), []
    for i, t in enumerate(texts):
        for _ in range(copies):
            words = t.split()
            for at in rnd.sample(range(len(words)), rnd.randint(1, max(1, len(words) // 50))):
                words[at] = f"x{rnd.getrandbits(30)}"
            pairs.append((i, len(out)))
            out.append((len(out), " ".join(words)))
    return out, pairs


def check(texts, kept):
    sets = {i: shingles(t) for i, t in texts.items()}
    stay = sorted(kept)
    for n, i in enumerate(stay):
        assert all(jaccard(sets[i], sets[j]) < 0.8 for j in stay[:n]), i
    for i in set(texts) - set(kept):
        assert any(j < i and jaccard(sets[i], sets[j]) >= 0.8 for j in texts), i


def test_no_near_pair_stays_and_nothing_else_goes(spark, monkeypatch):
    rnd = random.Random(9)
    base = [" ".join(f"w{rnd.randint(0, 3000)}" for _ in range(rnd.choice([3, 5, 6, 20, 60, 200]))) for _ in range(60)]
    data, _ = edited(base, 1)
    chain = [f"c{i}" for i in range(200)]  # each is near to the next ones, the ends are not
    for i in range(60):
        chain = chain[2:] + [f"d{i}", f"e{i}"]
        data.append((len(data), " ".join(chain)))
    data += [(len(data) + i, base[0].upper()) for i in range(5)]
    long = [f"l{i}" for i in range(6000)]
    data += [(len(data), " ".join(long)), (len(data) + 1, " ".join(long[:5000])), (len(data) + 2, " ".join(long[:4500]))]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    found = []
    for small, block in ((M.SMALL, M.BLOCK), (1, 256), (1, 3)):  # pairs of small keys, or all keys in blocks of texts
        monkeypatch.setattr(M, "SMALL", small)
        monkeypatch.setattr(M, "BLOCK", block)
        found.append({r.doc_id for r in M.keep_dissimilar(df).collect()})
        check(dict(data), found[-1])
    assert found[0] == found[1] == found[2]


def test_a_large_group_that_is_alike_but_not_near(spark, monkeypatch):
    """Copies of an absent text, about 0.75 similar to each other, some of them near: more than one block of them."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    data = []
    for i in range(150):
        words = list(base)
        for at in rnd.sample(range(150), rnd.choice([2, 3, 4, 4, 5])):
            words[at] = f"x{rnd.getrandbits(30)}"
        data.append((i, " ".join(words)))
    monkeypatch.setattr(M, "BLOCK", 40)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in M.keep_dissimilar(df).collect()}
    check(dict(data), kept)
    assert 30 < len(kept) < 140


def test_shared_counts():
    import numpy as np

    rnd = np.random.default_rng(0)
    sets = [np.unique(rnd.integers(0, 9000, n)) for n in (0, 1, 50, 5000, 9000, 9000)]
    got = M._shared(sets, sets[::-1])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[::-1]] for a in sets]


def test_stage_catches_near_copies(spark):
    """Of the pairs at 0.8 or more, fingerprints alone miss about half; the stage leaves none."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    data, pairs = edited([r.text for r in docs if len((r.text or "").split()) >= 60][:200], 4)
    texts = dict(data)
    near = [(a, b) for a, b in pairs if jaccard(shingles(texts[a]), shingles(texts[b])) >= 0.8]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], COLUMNS)
    left = {}
    for name, f in (("fingerprints", C.near_duplicates), ("stage", dict(C.STAGES)["near_duplicates"])):
        got = f(spark, df, SF)
        assert got.columns == df.columns
        ids = {r.doc_id for r in got.collect()}
        left[name] = sum(a in ids and b in ids for a, b in near)
    print("pairs", len(near), "both ends stay", left)
    assert len(near) > 300 and left["stage"] == 0 < left["fingerprints"]


def test_odd_rows(odd, empty, clashing, spark):
    got = M.keep_dissimilar(odd)
    by = sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect())
    ids = [i for none, i in by if not none]
    assert ids.count(3) == 2 and 11 in ids and 12 not in ids and not {7, 8, 9} & set(ids)  # a null id is the smallest
    assert M.keep_dissimilar(empty).count() == 0
    assert rows(M.keep_dissimilar(clashing).select(*odd.columns)) == rows(got)
    some = M.keep_dissimilar(odd, ids=spark.createDataFrame([(12,), (5,)], "i long"))
    assert {r.doc_id for r in some.collect()} == {12, 5}
