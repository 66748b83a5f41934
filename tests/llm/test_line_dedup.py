import random

import pytest

from pingtrail.llm import line_dedup


def brute(rows, t=0.8):
    """(doc_id, line): removed, by comparing all pairs of lines."""
    lines = {(i, n): frozenset(x.encode().lower().split()) for i, text in rows for n, x in enumerate((text or "").split("\n"))}
    lines = {k: v for k, v in lines.items() if v}
    return {k: any(o < k and len(s & v) >= t * len(s | v) - 1e-9 for o, s in lines.items()) for k, v in lines.items()}


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.paretovariate(0.6)), 400)}"
    pool = [[word() for _ in range(rng.randint(1, 30))] for _ in range(40)]
    out = [None, "", "\n\n", " \t\n x", "É é", "a b c d\na b c d e\na b c\nA  B C D"]
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2])):
                line[rng.randrange(len(line))] = word()
            rng.shuffle(line)
            lines.append(" ".join(line))
        out.append("\n".join(lines))
    return list(zip(rng.sample(range(1000), len(out)), out))


@pytest.mark.parametrize("seed, slots", [(1, 1 << 18), (2, 1), (3, 64)])
def test_as_all_pairs(spark, docs_of, monkeypatch, seed, slots):
    monkeypatch.setattr(line_dedup.token_counts, "__defaults__", (slots,))
    rows = fixture(seed)
    docs = docs_of([t for _, t in rows], [i for i, _ in rows]).repartition(3)
    decisions = line_dedup.decide(docs).collect()
    assert {(r.doc_id, r.line): r.removed for r in decisions if r.line >= 0} == brute(rows)
    bare = {i for i, t in rows if not (t or "").split()}
    assert {r.doc_id for r in decisions if r.line < 0} == bare
    gone = brute(rows)
    kept = {r.doc_id: r.text for r in line_dedup.remove_lines(docs).collect()}
    for i, text in rows:
        assert kept[i] == (None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if not gone.get((i, n))))
    got = {r.doc_id: r for r in line_dedup.summarise(line_dedup.decide(docs)).collect()}
    assert {i: r.n_removed for i, r in got.items()} == {i: sum(v for (d, _), v in gone.items() if d == i) for i, _ in rows}


def test_null_and_repeated_ids_long_lines_and_empty_table(spark, docs_of):
    long = " ".join(f"t{n}" for n in range(30_000))
    rows = [(3, long), (None, "a b"), (2, "a b\nc"), (2, "a b\nc"), (4, long + " more")]
    docs = docs_of([t for _, t in rows], [i for i, _ in rows])
    out = line_dedup.remove_lines(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == [("2", "c"), ("2", "c"), ("3", long), ("4", ""), ("None", "a b")]
    assert line_dedup.remove_lines(docs_of([])).count() == 0


def test_full_filter_loses_nothing(spark, docs_of, monkeypatch):
    rows = fixture(4)
    docs = docs_of([t for _, t in rows], [i for i, _ in rows])
    monkeypatch.setattr(line_dedup._sets_of, "__defaults__", (64,))
    assert {(r.doc_id, r.line): r.removed for r in line_dedup.decide(docs).collect() if r.line >= 0} == brute(rows)


def test_different_texts_under_one_id_or_null(spark, docs_of):
    rows = [(None, "p q\nr s"), (None, "t u\nv w\np q"), (2, "r s\na b"), (2, "c d\ne f"), (2, "c d\ng h"), (3, "p q")]
    kept = line_dedup.remove_lines(docs_of([t for _, t in rows], [i for i, _ in rows])).collect()
    got = sorted(line for r in kept for line in (r.text or "").split("\n") if line)
    assert got == ["a b", "c d", "e f", "g h", "p q", "r s", "t u", "v w"]
    assert [r.text for r in kept if r.doc_id == 3] == [""] and len(kept) == len(rows)
    summary = line_dedup.summarise(line_dedup.decide(docs_of([t for _, t in rows], [i for i, _ in rows]))).collect()
    assert sorted((str(r.doc_id), r.n_lines) for r in summary) == [("2", 2)] * 3 + [("3", 1), ("None", 2), ("None", 3)]


def test_representatives_match_and_come_earlier(spark, docs_of):
    rows = fixture(6)
    words = {(i, n): frozenset(x.encode().lower().split()) for i, text in rows for n, x in enumerate((text or "").split("\n"))}
    decisions = line_dedup.decide(docs_of([t for _, t in rows], [i for i, _ in rows])).collect()
    found = 0
    for r in decisions:
        if r.line >= 0:
            first = (r.first_doc, r.first_line)
            assert words[first] == words[r.doc_id, r.line] and first <= (r.doc_id, r.line)
            if r.earlier_line is not None:
                found += 1
                s, v = words[r.earlier_doc, r.earlier_line], words[first]
                assert (r.earlier_doc, r.earlier_line) < first and len(s & v) >= 0.8 * len(s | v) - 1e-9
    assert found > 10


@pytest.mark.parametrize("bins", [1, 8, 1000])
def test_a_group_of_near_copies_lists_few_pairs(spark, docs_of, monkeypatch, bins):
    """Whatever the number of bins, the same lines go; with few, pairs grow with the lines."""
    monkeypatch.setattr(line_dedup.first_candidates, "__defaults__", (bins,))  # the number of bins
    pairs = []
    real = line_dedup.verify
    monkeypatch.setattr(line_dedup, "verify", lambda d, c, p, s: pairs.append(p.count()) or real(d, c, p, s))
    base = [f"word{k}" for k in range(40)]
    rng = random.Random(5)
    rows = []
    for i in range(400):
        line = list(base)
        line[rng.randrange(40)] = f"new{i}"
        rows.append((i, " ".join(line)))
    decisions = line_dedup.decide(docs_of([t for _, t in rows], [i for i, _ in rows])).collect()
    assert {(r.doc_id, r.line): r.removed for r in decisions} == brute(rows)
    if bins < 1000:
        assert sum(pairs) < 30 * 400  # of 79,800


def test_sets_are_read_twice_whatever_the_rounds(spark, docs_of, monkeypatch):
    """Near copies that differ in their rarest words: once for all rounds and once for the rest, and few pairs."""
    reads, pairs = [], []
    sets_of, verify = line_dedup._sets_of, line_dedup.verify
    monkeypatch.setattr(line_dedup, "_sets_of", lambda *a: reads.append(1) or sets_of(*a))
    monkeypatch.setattr(line_dedup, "verify", lambda s, n, p, t: pairs.append(p.count()) or verify(s, n, p, t))
    rng = random.Random(8)
    rows = []
    for i in range(300):
        line = [f"word{k}" for k in range(60)]
        for n, k in enumerate(rng.sample(range(60), 3)):
            line[k] = f"new{i}x{n}"
        rows.append((i, " ".join(line)))
    decisions = line_dedup.decide(docs_of([t for _, t in rows], [i for i, _ in rows])).collect()
    assert {(r.doc_id, r.line): r.removed for r in decisions} == brute(rows)
    assert len(reads) == 2 and len(pairs) > 2
    assert sum(pairs) < 20 * 300  # of 44,850


def test_hashes_of_words():
    import pyarrow as pa

    words = ["", "a", "b", "ab", "ba", "é", "a" * 70_000, "a" * 69_999]
    hashes, size = line_dedup._hashes(pa.array(words))
    assert len(set(hashes.tolist())) == len(words) and size.tolist() == [len(w.encode()) for w in words]
    for k in range(len(words)):  # whatever stands beside a word
        assert line_dedup._hashes(pa.array(words).slice(k, 1))[0][0] == hashes[k]
    assert line_dedup._hashes(pa.array([], pa.string()))[0].tolist() == []


def test_long_lines_that_share_few_rare_tokens_are_no_candidates(spark, docs_of, monkeypatch):
    """Parity maps of 128 bits tell nothing of such lines: the number of prefix tokens in common does."""
    pairs = []
    verify = line_dedup.verify
    monkeypatch.setattr(line_dedup, "verify", lambda s, n, p, t: pairs.append(p.count()) or verify(s, n, p, t))
    rng = random.Random(3)
    pool = [f"word{k}" for k in range(4000)]
    lines = [rng.sample(pool, 400) for _ in range(60)]
    lines += [[*lines[k][:380], *[f"new{k}x{n}" for n in range(20)]] for k in range(5)]
    rows = [(i, " ".join(line)) for i, line in enumerate(lines)]
    decisions = line_dedup.decide(docs_of([t for _, t in rows], [i for i, _ in rows])).collect()
    gone = {(r.doc_id, r.line): r.removed for r in decisions}
    assert gone == brute(rows) and sum(gone.values()) == 5
    assert pairs[-1] < 60  # of 2,080


@pytest.mark.parametrize("rows, most", [(1, 2), (7, 1 << 18), (1000, 3)])
def test_pairs_of_a_token_whatever_the_steps(monkeypatch, rows, most):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(line_dedup, "ROWS", rows)
    monkeypatch.setattr(line_dedup, "PAIRS", most)
    rng = random.Random(rows)
    index = sorted(((rng.choice([-5, 0, 9]) << 32 | rng.randint(4, 20), rng.randint(0, 4) * 2 + rng.randint(0, 1), rng.randint(-9, 9), rng.randint(-99, 99),
                     rng.choice([0, -1, -2, 3]), rng.choice([0, -(2 ** 63), 1])) for _ in range(150)), key=lambda r: r[0])
    expected = []
    for i, (key, at, doc, a, p, q) in enumerate(index):
        for key2, at2, doc2, a2, p2, q2 in index[:i]:
            n, m, e = key & 0xFFFFFFFF, key2 & 0xFFFFFFFF, 1e-9
            apart = ((p ^ p2) & (2 ** 64 - 1)).bit_count() + ((q ^ q2) & (2 ** 64 - 1)).bit_count()
            later = at & 1 if doc2 < doc else at2 & 1 if doc < doc2 else (at | at2) & 1
            shared = int(np.ceil(4 / 9 * (m + n) - e))
            bound = min(n - (at >> 1), m - (at2 >> 1)) + min(at >> 1, at2 >> 1)
            if key >> 32 == key2 >> 32 and m >= 0.8 * n - e and apart <= (m + n) / 9 + e and later and a != a2 and bound >= shared:
                expected.append((min(a, a2), max(a, a2), shared - int(np.ceil(0.8 * n - e)) + 1))
    batches = [pa.RecordBatch.from_pydict({
        "key": pa.array([r[0] for r in part], pa.int64()), "at": pa.array([r[1] for r in part], pa.int32()),
        "own": pa.array([b"".join(x.to_bytes(8, "big", signed=True) for x in r[2:]) for r in part], pa.binary())})
        for part in (index[k:k + 4] for k in range(0, len(index), 4))]
    got = [tuple(r.values()) for b in line_dedup._meetings(0.8)(batches) for r in b.to_pylist()]
    assert sorted(got) == sorted(expected) and len(got) > 20
