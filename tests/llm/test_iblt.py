import hashlib
import random

import numpy as np

from pingtrail.llm import iblt


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -10**18), r[1] or ""))
    out = []
    for k, (key, text) in enumerate(rows):
        text, nxt = text or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(text) // 2
        edited = text[:len(text) - h] + nxt[:h]
        like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
        own, changed, other = (set(iblt.digests(t)) for t in (text, edited, nxt))
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), like(own, changed), like(own, other)))
    return out


def prose(rng, n):
    return "\n".join(" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 40))) + "." for _ in range(n))


def test_as_exact_sets(spark, docs_of):
    rng = random.Random(1)
    texts = [None, "", "\n\n", "a", "ab", "é" * 9, "x " * 30_000] + [prose(rng, rng.randint(1, 60)) for _ in range(60)]
    texts += texts[10:14]
    for buckets in (1, 3, 40):
        ids = rng.sample(range(-500, 500), len(texts))
        rows = list(zip(ids, texts))
        got = iblt.fingerprints(docs_of(texts, ids).repartition(4), buckets).collect()
        key = lambda r: r[0]
        for g, w in zip(sorted((tuple(r[c] for c in ("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next")) for r in got), key=key),
                        sorted(brute(rows), key=key), strict=True):
            assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-9 and abs(g[4] - w[4]) < 1e-9
        by_text = {}
        for r in got:
            by_text.setdefault(dict(rows)[r.doc_id] or "", set()).add(r.fingerprint)
        assert all(len(p) == 1 for p in by_text.values())


def test_repeated_and_null_ids_one_row_and_empty_table(spark, docs_of):
    rows = [(5, "b b"), (5, "a a"), (None, "c c"), (9, "d d")]
    got = iblt.fingerprints(docs_of([t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted((str(r.doc_id), r.edited_sha256) for r in got) == sorted((str(w[0]), w[2]) for w in brute(rows))
    (one,) = iblt.fingerprints(docs_of(["same"])).collect()
    assert one.near_next == 1.0
    assert iblt.fingerprints(docs_of([])).count() == 0


def test_peeling_recovers_the_differing_digests():
    rng = random.Random(2)
    common, a, b = ([rng.getrandbits(64) for _ in range(n)] for n in (500, 6, 5))
    values = np.array(common + a + common + b, "u8")
    signs = np.array([1] * 506 + [-1] * 505)
    owners, found, sign, done = iblt.peel(iblt.sketch(values, np.zeros(len(values), "i8"), 1, 60, signs))
    assert done.all() and {(int(v), int(s)) for v, s in zip(found, sign)} == {*((v, 1) for v in a), *((v, -1) for v in b)}


def test_retry_with_more_cells_and_shared_cells():
    rng = random.Random(3)
    a, b = ([rng.getrandbits(64) for _ in range(400)] for _ in range(2))
    assert not iblt.peel(iblt.sketch(np.array(a, "u8"), np.zeros(400, "i8"), 1, iblt.CELLS))[3].any()
    assert iblt.differing([a, a, []], [b, a[:390], []]).tolist() == [800, 10, 0]


def test_rows_of_a_hot_id_are_cut_by_their_texts(spark, docs_of):
    rng = random.Random(5)
    for hot in (None, 3, 400):
        rows = [(hot, f"{rng.choice('abcdé')} {prose(rng, rng.randint(1, 6))}") for _ in range(70)] + [(k, prose(rng, 3)) for k in range(-10, 60)]
        rows += [(hot, "same"), (hot, "same"), (hot, None)]
        frame = docs_of([t for _, t in rows], [i for i, _ in rows]).repartition(5)
        got = iblt.fingerprints(frame, 12).collect()
        short = lambda r: (str(r[0]), r[1], r[2], round(r[3], 9), round(r[4], 9))
        assert sorted(short((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next)) for r in got) == sorted(map(short, brute(rows)))
        from pingtrail.llm.shared import texts
        keyed = texts(frame).fillna(iblt.NULL_ID, ["doc_id"])
        own = iblt._cuts(keyed, {(iblt.NULL_ID if hot is None else hot): 6, 7: 1}, 12)
        assert [len(c) for c in own.values()] == [5]  # six ranges
