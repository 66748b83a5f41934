import random
import re

import pytest

from pingtrail.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, target string, copy string, number long, position string"


def table(spark, rows):
    """(doc_id, text, source) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 7, "t", "c", 1, "p") for r in rows], SCHEMA)


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def brute_targets(rows, weights=(5, 2, 1), share=1.5, most=2):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    target, free, rest = {}, set(order), share * sum(sizes.values())
    while free:  # share by weight; those above their most stop there, and the rest is shared again
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > most * sizes[s]}
        if not over:
            target.update({s: rest * weight[s] / total for s in free})
            break
        for s in over:
            target[s] = most * sizes[s]
        rest -= sum(target[s] for s in over)
        free -= over
    return sizes, target


def sample(n, seed, sources=7, longest=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = "s0" if rng.random() < 0.4 else rng.choice([None, "é", "Z", "a", "\U0001f600", ""] + [f"s{k}" for k in range(sources)])
        rows.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 5, longest]))), s))
    rows += [(None, "no id here", "s0"), (None, "no id here", "s0"), (None, "nor here", "s1"), (3, "again 3", "s0"), (3, "again 3", "s0"),
             (n, None, "s0"), (n + 1, " \t\n ", None), (n + 2, "x\x1cy\xa0z \x0b u", "a")]
    return rows


def test_targets_as_brute_force(spark):
    for seed in range(4):
        rows = sample(40 if seed else 3, seed)
        sizes, target = brute_targets(rows)
        got = mixing.targets(mixing.documents(table(spark, rows))).collect()
        assert {r.source: r.source_size for r in got} == sizes
        assert {r.source: r.target for r in got} == pytest.approx(target)


@pytest.mark.parametrize("packet, range_rows", [(1000, 50_000), (8, 30)])
def test_mix_keeps_the_targets(spark, packet, range_rows):
    rows = sample(600, 1, longest=200)
    sizes, target = brute_targets(rows)
    docs = table(spark, rows)
    mixed = mixing.mix(docs, packet=packet, range_rows=range_rows).cache()
    got = mixing.shares(mixed).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, words(t)) for i, t, _ in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got) == int(1.5 * sum(sizes.values()))
    taken = {}
    for r in mixed.groupBy("number", "target", "source_size").sum("taken").collect():
        taken[r.number] = r["sum(taken)"]
        assert abs(r["sum(taken)"] - r.target) <= max(packet, 200) + 1
    # positions are gapless, and finish times ascend with them
    order = mixed.where("words > 0").select("position", "words", "finish").orderBy("position").collect()
    at = 0
    for a, b in zip(order, order[1:]):
        assert a.position == at and a.finish <= b.finish
        at += a.words


def test_reruns_and_layouts_agree(spark):
    rows = sample(200, 5)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    a = mixing.shares(mixing.mix(table(spark, rows))).collect()
    random.Random(0).shuffle(rows)
    b = mixing.shares(mixing.mix(table(spark, rows).repartition(7), range_rows=9)).collect()
    assert sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


def test_a_source_is_spread_over_the_mix(spark):
    rows = [(i, "w " * 10, "a" if i < 300 else "b") for i in range(400)]
    mixed = mixing.mix(table(spark, rows)).where("taken > 0")
    first = mixed.where("position < 500").groupBy("number").sum("taken").collect()
    got = {r.number: r["sum(taken)"] for r in first}
    # targets: a 4000, b 2000 (its most)
    assert got[0] / (got[0] + got[1]) == pytest.approx(2 / 3, abs=0.1)


def test_mixed_texts(spark):
    rows = [(1, "one two  three\nfour", "a"), (2, None, "a"), (3, "x y", "b"), (3, "x y", "b")]
    docs = table(spark, rows)
    mixed = mixing.mix(docs, packet=3)
    out = mixing.mixed_texts(docs, mixed).collect()
    assert sum(r.words for r in out) == 12 and all(len(r.text.split()) == r.words for r in out)
    assert {r.text for r in out if r.doc_id == 1} <= {"one two three", "four"}


def test_equal_rows_and_tiny_tables(spark):
    assert mixing.shares(mixing.mix(table(spark, []))).collect() == []
    only = mixing.shares(mixing.mix(table(spark, [(1, None, None), (2, " ", "a")]))).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in only) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    many = mixing.shares(mixing.mix(table(spark, [(None, "a b", "s")] * 30_000))).collect()
    assert len(many) == 30_000 and sum(r.taken for r in many) == 90_000 and all(r.taken <= 4 for r in many)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_vector_codes", "op13_mixing"])
def test_queries_match_their_sql(spark, name):
    from pingtrail.llm.queries import ORACLE, QUERIES
    from tools.oracle_check import digest, duck

    sf = "/root/testdata/sf0.001"
    df = QUERIES[name](spark, sf)
    got = duck(sf).execute(ORACLE[name])
    columns, rows = [c[0] for c in got.description], got.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(columns, rows)[0]
