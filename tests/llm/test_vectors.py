import hashlib
import math
import random

import numpy as np
import pytest

from pingtrail.llm import hard_negatives, vector_codes
from pingtrail.llm.vectors import exact_products, integer_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, v string, n int, error string, score double"


def table(spark, rows):
    """(vec_id, embedding, label) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, "y", 0.5) for r in rows], SCHEMA)


def random_rows(n, dim=16, seed=0, spread=1.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 1) * (1 + spread * (i % 9)) for _ in range(dim)]
        rows.append((i, v, rng.randrange(4)))
    rows += [(n, None, 1), (n + 1, [None] * dim, 1), (n + 2, [math.inf] + [0.0] * (dim - 1), 2), (n + 3, [math.nan] * dim, 2),
             (n + 4, [0.5] * dim, None), (None, [0.25] * dim, 1), (n + 5, [0.0] * dim, 3), (n + 6, [1.0, -1.0], 0)]
    rows += [(100, [0.5] * dim, 1)] * 2 + [(200, [0.5] * dim, 1), (7, [0.5] * dim, 2), (8, [0.5] * dim, 2)]
    return rows


def kept(rows, dim):
    out = []
    for i, v, label in rows:
        v = None if v is None else [None if x is None else float(np.float32(x)) for x in v]
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(256 * x) for x in v] + [0] * (dim - len(v)), label))
    return out


# --- exact products ---------------------------------------------------------------

@pytest.mark.parametrize("size", [1, 300, 2 ** 26, 2 ** 28])
def test_limbs_are_exact(size):
    rng = np.random.default_rng(3)
    a, b = rng.integers(-size, size + 1, (7, 33)), rng.integers(-size, size + 1, (5, 33))
    a[0], b[0] = size, -size
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert exact_products(a, b).tolist() == want


def test_products_beyond_64_bits_are_an_error():
    with pytest.raises(ValueError):
        exact_products(np.full((1, 4), 2 ** 31), np.full((1, 4), 2 ** 31))


def test_integer_vectors_floor_down(spark):
    got = integer_vectors(table(spark, [(1, [-0.001, 0.001, 1.0], 3), (2, None, 1), (3, [1.0, None], 1)])).collect()
    assert [tuple(r) for r in got] == [(1, 3, [-1, 0, 256])]


# --- hard negatives ---------------------------------------------------------------

def brute_negatives(rows, dim):
    data = [(n, i, v, (label + 1) % 10 if i % 7 == 0 else label) for n, (i, v, label) in enumerate(kept(rows, dim))
            if i is not None and label is not None]
    out = []
    for n, i, v, label in data:
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, k) for m, j, w, k in data if m != n]
        for s, p, _ in sorted(t for t in scored if t[2] == label)[:5]:
            fit = sorted((t[0], t[1]) for t in scored if t[2] != label and -30 * s <= -100 * t[0] <= -90 * s)
            out += [(i, p, rank, j, -s, -t) for rank, (t, j) in enumerate(fit[:10], 1)]
    return sorted(out)


@pytest.mark.parametrize("bucket, block, spread", [(8192, 64, 0.0), (16, 2, 1.0), (5, 1, 30.0)])
def test_negatives_as_brute_force(spark, bucket, block, spread):
    rows = random_rows(400, seed=bucket, spread=spread)
    vectors = hard_negatives.labelled_vectors(table(spark, rows))
    got = hard_negatives.mine(vectors, vectors.where("vec_id % 100 = 0"), bucket=bucket, block=block)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 16)


def test_registered_negatives_query(spark, tmp_path):
    from pingtrail.llm.queries import QUERIES

    rows = random_rows(250, seed=5)
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op11_hard_negatives"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 16)


def test_negatives_of_few_rows(spark):
    assert hard_negatives.mine_table(table(spark, [])).collect() == []
    assert hard_negatives.mine_table(table(spark, [(0, None, 1), (100, None, 1)])).collect() == []
    assert hard_negatives.mine_table(table(spark, [(100, [1.0], 1)])).collect() == []
    only = [(100, [1.0], 1), (101, [1.0], 1), (102, [0.5], 2), (103, [0.95], 2)]  # half the positive's score, and too much
    assert [tuple(r) for r in hard_negatives.mine_table(table(spark, only)).collect()] == [(100, 101, 1, 102, 65536, 32768)]


def test_feasible_ranges_hold_every_match():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6))
    x = np.floor(x / np.sqrt((x ** 2).sum(axis=1, keepdims=True)) * rng.uniform(900, 1000, (500, 1))).astype("i8")
    ids = np.arange(500)
    length = np.sqrt((x.astype("f8") ** 2).sum(axis=1))
    bucket = hard_negatives.Bucket(ids, x, 0, float(length.max()), float(length.min()))
    pruned = 0
    for q in x[:100]:
        scores = x @ q
        for low, high in ((0.9 * scores.max(), np.inf), (0.95 * scores.max(), 0.97 * scores.max()), (-np.inf, 0.9 * scores.min())):
            found = hard_negatives.candidates(q, low, high, bucket)
            want = set(np.flatnonzero((scores >= low) & (scores <= high)))
            if found is not None:
                pruned += 1
                assert want <= set(found.tolist())
    assert pruned > 20


def test_short_buckets_are_not_read(spark, monkeypatch):
    rows = [(i, [1000.0 if i < 50 else 1.0] * 4, 0 if i < 25 or i > 70 else 1) for i in range(120)]
    data = kept(rows, 4)
    read = []
    monkeypatch.setattr(hard_negatives.Bucket, "read", classmethod(lambda cls, row, dim: read.append(row["label"]) or row["made"]))

    def made(part, label):
        x = np.array([r[1] for r in part])
        length = np.sqrt((x.astype("f8") ** 2).sum(axis=1))
        b = hard_negatives.Bucket(np.array([r[0] for r in part]), x, label, float(length.max()), float(length.min()))
        return {"label": label, "longest": b.longest, "shortest": b.shortest, "made": b}

    buckets = [made([r for r in data if r[2] == label and (r[0] < 50) == long], label) for long in (True, False) for label in (0, 1)]
    anchor = data[0]
    hard_negatives.mine_block(np.array([0]), np.array([0]), np.array([anchor[1]]), buckets, 4, 5, 10, (30, 90))
    assert read == [0, 1]  # the long bucket of each label only


# --- vector codes -----------------------------------------------------------------

def brute_codes(rows, dim, parts=16, entries=64, rounds=2):
    data = kept(rows, dim)
    width = dim // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in data]
    order = sorted(range(len(data)), key=lambda n: (data[n][0] is None, data[n][0] or 0, data[n][1]))
    books = [[cut[n][p] for n in order[:entries]] for p in range(parts)]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = [[] for _ in books[p]]
            for x in cut:
                held[assign(p, x[p])[1]].append(x[p])
            new.append([[sum(c) // len(h) for c in zip(*h)] if h else e for h, e in zip(held, books[p])])
        books = new
    out, by_label = [], {}
    for (i, _, label), x in zip(data, cut):
        found = [assign(p, x[p]) for p in range(parts)]
        error = sum(f[0] for f in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{f[1]:02x}" for f in found), error, label))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    return sorted(((i, code, error, by_label[label], sha) for i, code, error, label in out), key=key)


@pytest.mark.parametrize("n, dim, scale", [(300, 32, 1.0), (20, 16, 1.0), (150, 32, 2e4)])
def test_codes_as_brute_force(spark, n, dim, scale):
    rows = [(i, None if v is None else [None if x is None else x * scale for x in v], label) for i, v, label in random_rows(n, dim, seed=n)]
    got = vector_codes.compress(table(spark, rows).repartition(5))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in got.collect()), key=key) == brute_codes(rows, dim)


def test_decoded_vectors_are_the_stated_error_away(spark):
    vectors = integer_vectors(table(spark, random_rows(100, 32, seed=2)[:100]))
    books = vector_codes.train(vectors, 32)
    codes = vector_codes.encode(vectors, books)
    found = {r.vec_id: r.v for r in vector_codes.decode(codes, books).collect()}
    real = {r.vec_id: r.v for r in vectors.collect()}
    for r in codes.collect():
        assert r.error == sum((a - b) ** 2 for a, b in zip(found[r.vec_id], real[r.vec_id]))


def test_no_vectors_no_codes(spark):
    assert vector_codes.compress(table(spark, [])).collect() == []
    assert vector_codes.compress(table(spark, [(1, None, 2)])).collect() == []
    empty = vector_codes.compress(table(spark, [(1, [], 2), (2, [], None)])).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in empty) == [(1, "00" * 16, 0), (2, "00" * 16, 0)]


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="beyond|fit 64 bits"):
        vector_codes.compress(table(spark, [(1, [1e30] * 16, 2)])).collect()
