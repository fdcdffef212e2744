"""Vector codes and near-duplicate vectors against brute force."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import caps, codes

from .conftest import SF, rows

ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 32, 1), (903, [1.0, None] + [0.0] * 30, 1), (904, [float("nan")] * 32, 1), (905, [float("inf")] * 32, 1), (906, [1.0] * 20, 1)]
KINDS = "vec_id long, embedding array<double>, label int"


def plain_codes(data, parts, entries, rounds):
    """(code, error) by id, label sums and digest, by plain loops over integers."""
    q = {i: [int(x * 256 // 1) for x in v] for i, v, _ in data}
    width = len(data[0][1]) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v in q.items()}
    books = [[cut[i][p] for i in sorted(q)[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in cut.values():
                own[near(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(own[e]) for c in zip(*own[e])] if e in own else b for e, b in enumerate(books[p])]
    last = {i: [near(v[p], books[p]) for p in range(parts)] for i, v in cut.items()}
    sums = Counter()
    for i, _, label in data:
        sums[label] += sum(d for d, _ in last[i])
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{e:02x}" for _, e in last[i]), sum(d for d, _ in last[i]), sums[label], digest) for i, _, label in data)


def told(coded, books):
    return sorted((r.id, bytes(r.codes).hex(), r.error, r.label_error, codes.digest(books)) for r in coded.collect())


@pytest.mark.parametrize(("n", "dimension", "parts", "entries"), [(150, 32, 4, 16), (40, 12, 4, 64), (60, 6, 6, 8), (90, 24, 2, 256)])
def test_codes_equal_plain_loops(spark, n, dimension, parts, entries):
    rnd = np.random.default_rng(n)
    data = [(i * 7 % 997, [float(x) for x in np.round(rnd.normal(0, 0.4, dimension), 2)], None if i % 5 == 0 else int(i % 3)) for i in range(n)]
    data[3] = (data[3][0], data[2][1], data[3][2])  # equal vectors
    odd = [(i, v and [*v, *[0.5] * 40][: len(v)], label) for i, v, label in ODD if i not in (902, 906)]
    df = spark.createDataFrame([*data, *odd], KINDS).repartition(5).withColumn("codes", F.lit(1)).withColumn("error", F.lit(2))
    got = told(*codes.encode(df, parts=parts, entries=entries, rounds=2))
    assert got == plain_codes(data, parts, entries, 2)


def test_codes_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = codes.query(spark, SF)
    want = con.execute(codes.SQL).df()[got.columns]
    assert rows(got) == sorted(map(tuple, want.itertuples(index=False)), key=repr)


@pytest.mark.parametrize(("width", "spread"), [(4, 30), (4, 2), (16, 1000), (6, 5), (1, 3), (5, 2**25)])
def test_bounds_set_no_nearest_entry_aside(width, spread):
    """Exact at any spread, ties to the lower number; most distances aren't measured where entries lie apart."""
    rnd = np.random.default_rng(width * spread)
    book = rnd.integers(-spread, spread + 1, (64, width))
    x = np.concatenate([book[rnd.integers(0, 64, 3000)] + rnd.integers(-2, 3, (3000, width)), rnd.integers(-spread, spread + 1, (3000, width)), book])
    square = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    code, error, measured = codes.nearest(x, book)
    assert (code == square.argmin(axis=1)).all() and (error == square.min(axis=1)).all()
    assert spread < 1000 or measured < 64 * len(x) / 2
    # No bound is over the distance, at any size of block.
    for s in codes.block_sizes(width):
        (sx, rx), (sc, rc) = codes._profile(x, s), codes._profile(book, s)
        assert (codes._bound(sx[:, None], rx[:, None], sc[None], rc[None], s) <= square).all()


def test_codes_of_odd_tables(spark):
    """Null and repeated ids, repeated rows, components too large, other dimensions, no rows, clashing names."""
    v = lambda *x: [float(c) for c in x] * 8
    data = [(5, v(1, 2), 1), (5, v(0, 1), 1), (5, v(0, 1), 1), (None, v(9, 9), None), (7, v(4, 4), None), (8, v(1e30, 0), 1), (9, v(1, 2, 3), 1), *[(i, x, y) for i, x, y in ODD if i in (900, 901, 904)]]
    df = spark.createDataFrame(data, KINDS)
    got, books = codes.encode(df, parts=4, entries=8)
    assert books.shape == (4, 2, 4)  # ids 5 and 7; the vector of id 5 is its smallest
    assert sorted((r.id is not None, r.id or 0) for r in got.collect()) == [(False, 0), (True, 5), (True, 5), (True, 5), (True, 7)]
    unlabelled = got.where("id IS NULL OR id = 7").collect()
    assert {r.label_error for r in unlabelled} == {sum(r.error for r in unlabelled)}
    for few in (df.limit(0), df.where("vec_id IS NULL"), df.where("vec_id IN (900, 904)")):
        got, books = codes.encode(few)
        assert got.count() == 0 and books.size == 0 and set(got.columns) == {"id", "label", "codes", "error", "label_error"}
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("id", "v", "codes", "error", "__label", "d", "label_error", "dotted.name")])
    assert rows(codes.encode(clash, parts=4, entries=8)[0]) == rows(codes.encode(df, parts=4, entries=8)[0])


def test_decoded_codes_are_near(spark):
    coded, books = codes.encode(spark.read.parquet(f"{SF}/embeddings.parquet"))
    vectors = {r.vec_id: np.floor(np.array(r.embedding, float) * 256).astype(int) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    for r in coded.collect():
        assert ((vectors[r.id] - codes.decode(r.codes, books)) ** 2).sum() == r.error


def brute_links(data, threshold=0.98):
    """{row: (links, smallest id reachable)} by comparing all rows."""
    own = [(k, np.array(v, float), label) for k, (_, v, label) in enumerate(data) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    peers = defaultdict(set)
    for a, x, s in own:
        for b, y, t in own:
            if a < b and s == t and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                peers[a].add(b)
                peers[b].add(a)
    out, seen = {}, {}
    for k in range(len(data)):
        if k not in seen:
            group, todo = {k}, [k]
            while todo:
                new = peers[todo.pop()] - group
                group |= new
                todo += new
            seen |= dict.fromkeys(group, min(data[g][0] for g in group))
        out[k] = (data[k][0], len(peers[k]), seen[k], seen[k] == data[k][0])
    return sorted(out.values())


def clusters(rnd, d, groups, size, noise, labels=2):
    out = []
    for _ in range(groups):
        x = rnd.standard_normal(d)
        out += [(x + noise * np.linalg.norm(x) / np.sqrt(d) * rnd.standard_normal(d)).tolist() for _ in range(size)]
    rnd.shuffle(out)
    return [(i + 10, v, int(rnd.integers(0, labels))) for i, v in enumerate(out)]


@pytest.mark.parametrize(("d", "groups", "size", "noise", "block"), [(64, 60, 6, 0.14, 1024), (64, 2, 200, 0.14, 32), (64, 1, 150, 0.05, 16), (8, 40, 8, 0.1, 1024), (3, 30, 8, 0.1, 64), (2, 10, 20, 0.05, 16), (1, 2, 20, 0.1, 8)])
def test_near_duplicates_equal_brute_force(spark, d, groups, size, noise, block):
    """Groups around the threshold, large ones in blocks, and few dimensions."""
    data = clusters(np.random.default_rng(d * size), d, groups, size, noise)
    got = caps.near_duplicate_vectors(spark.createDataFrame(data, KINDS).repartition(4), block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert rows(got) == sorted(brute_links(data), key=repr)


def test_near_duplicates_of_odd_tables(spark):
    """Copies, repeated rows, null ids and labels, odd vectors, other dimensions, huge and tiny components, no rows, clashing names."""
    v = [1.0, 2.0, 3.0, -1.0]
    data = [
        (5, v, 1), (3, v, 1), (3, v, 1), (9, v, 2), (10, [2 * x for x in v], 2), (11, [x * 1e300 for x in v], 2), (12, [x * 1e-300 for x in v], 2), (13, v, None), (14, v, None),
        (15, [*v, 0.0], 1), (16, [-x for x in v], 1), (17, [0.0, -0.0, 1.0, 0.0], 3), (18, [-0.0, 0.0, 1.0, 0.0], 3), *[(i, x, 1) for i, x, _ in ODD],
    ]
    df = spark.createDataFrame(data, KINDS)
    got = {r.vec_id: tuple(r)[1:] for r in caps.near_duplicate_vectors(df).collect()}
    alone = {i: (0, i, True) for i in (13, 14, 15, 16, *[i for i, _, _ in ODD])}
    assert got == alone | {5: (2, 3, False), 3: (2, 3, True), 9: (3, 9, True)} | {i: (3, 9, False) for i in (10, 11, 12)} | {17: (1, 17, True), 18: (1, 17, False)}
    assert caps.near_duplicate_vectors(df).count() == len(data)
    assert caps.near_duplicate_vectors(df.limit(0)).count() == 0 and caps.near_duplicate_vectors(df.where("vec_id >= 900")).count() == len(ODD)
    null = spark.createDataFrame([(None, v, 1), (None, None, 1), (4, v, 1)], KINDS)
    assert rows(caps.near_duplicate_vectors(null)) == sorted([(None, 1, None, True), (None, 0, None, True), (4, 1, None, False)], key=repr)
    clash = df.select("*", *[F.lit("x").alias(c) for c in ("id", "v", "h1", "h2", "filters", "key", "n", "copies", "own", "peer", "node", "root", "component", "dotted.name")])
    assert rows(caps.near_duplicate_vectors(clash)) == rows(caps.near_duplicate_vectors(df))


def test_recall_at_the_threshold():
    """Pairs of a cosine of just 0.98 share a filter, for few and for many vectors."""
    rnd = np.random.default_rng(0)
    for d, n, least in ((64, 500, 0.999), (64, 50_000, 0.999), (64, 10**7, 0.97), (16, 10**5, 0.97)):
        c = caps.code(d, n)
        x = caps.unit(rnd.standard_normal((1000, d)))
        w = rnd.standard_normal((1000, d))
        w = caps.unit(w - (w * x).sum(axis=1, keepdims=True) * x)
        (a, f), (b, g) = caps.filters(x, c), caps.filters(0.98 * x + np.sqrt(1 - 0.98**2) * w, c)
        assert np.mean([len(np.intersect1d(f[a[i] : a[i + 1]], g[b[i] : b[i + 1]])) > 0 for i in range(1000)]) >= least
        assert np.diff(a).min() >= c.least and np.diff(a).mean() < 40


def test_decoded_filters_are_all_in_the_cap():
    """List-decoding equals a product with all directions."""
    c = caps.code(64, 20_000)
    x = caps.unit(np.random.default_rng(3).standard_normal((100, 64)))
    at, found = caps.filters(x, c)
    y, total, cut = x @ c.rotation, np.zeros((100, 1)), 0
    for b in c.blocks:
        total = (total[:, :, None] + (y[:, cut : cut + b.shape[1]] @ b.T)[:, None]).reshape(100, -1)
        cut += b.shape[1]
    assert total.shape[1] == c.size
    for i in range(100):
        inside = set(np.flatnonzero(total[i] >= c.alpha))
        want = inside if len(inside) >= c.least else set(np.argsort(-total[i], kind="stable")[: c.least])
        assert set(found[at[i] : at[i + 1]]) == want


def test_near_duplicates_query(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = caps.query(spark, SF)
    want = con.execute(caps.SQL).df()[got.columns]
    assert rows(got) == sorted(map(tuple, want.itertuples(index=False)), key=repr)
