import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pingtrail.llm import decontaminate


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def shingles(words):
    return Counter(tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))) if words else Counter()


def brute(docs, items):
    """All windows of every item's size over every document, at every word."""
    found = {}
    for d, text in docs:
        words = words_of(text)
        for i, item in items:
            own = words_of(item)
            for start in range(-len(own), len(words)) if own and words else ():
                here, there = shingles(words[max(start, 0):max(start + len(own), 0)]), shingles(own)
                top, total = sum((here & there).values()), sum((here | there).values())
                if top >= 0.8 * total:
                    key = (d, i)
                    found[key] = max(found.get(key, 0), top / total)
    return found


def run(spark, docs, items, **options):
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, w string, start int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, h int")
    return {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(frame, bench, **options).collect()}


def fixture(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Über"]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, prose(rng.randint(15, 40))) for i in range(8)]
    docs = [(100, None), (101, ""), (102, "..."), (103, "a b")]
    for n in range(30):
        item = list(rng.choice(items)[1])
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            item[rng.choice([0, 1, len(item) - 1, len(item) - 2])] = "changed"
        if rng.random() < 0.3:
            item.insert(rng.choice([1, len(item) - 1]), "added")
        if rng.random() < 0.3:
            item.pop(rng.choice([0, len(item) - 1]))
        before, after = prose(rng.choice([0, 20])), prose(rng.choice([0, 20]))
        docs.append((n, ", ".join(before + item + after).upper() + "\n"))
    docs += [(n, " ".join(prose(50))) for n in range(40, 50)]
    return docs, [(i, " ".join(t)) for i, t in items] + [(90, None), (91, ""), (92, "A b"), (93, "one two three four five")]


def test_as_brute_force(spark):
    for seed in (1, 2, 3):
        docs, items = fixture(seed)
        want = brute(docs, items)
        assert len(want) > 10 and (103, 92) in want
        for options in ({}, {"broadcast_rows": 0}):
            got = run(spark, docs, items, **options)
            assert got.keys() == want.keys()
            assert all(abs(got[k] - want[k]) < 1e-9 for k in want), {k: (got[k], want[k]) for k in want}


def test_fingerprints_within_the_radius_share_a_block(spark):
    rng = random.Random(4)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 19):
            b ^= 1 << bit
        edges = [64 * i // 20 for i in range(21)]
        assert any((a ^ b) >> lo & ((1 << hi - lo) - 1) == 0 for lo, hi in zip(edges, edges[1:]))


def test_simhash_of_windows(spark):
    rng = random.Random(6)
    rows = [(n, [rng.getrandbits(64) - (1 << 63) for _ in range(n)]) for n in (1, 2, 7, 40)] + [(99, [-1, -1, 5])]
    frame = spark.createDataFrame(rows, "key long, shingles array<bigint>")
    for r in decontaminate._fingerprints(frame, ["key"]).collect():
        hashes = dict(rows)[r.key]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert r.fp % (1 << 64) == want


def test_repeated_rows_clashing_columns_and_empty_tables(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(1, "x " + item), (1, "x " + item), (None, item), (2, item + " " + item)]
    assert run(spark, docs, [(5, item), (5, item)]) == {(1, 5): 1.0, (2, 5): 1.0, (None, 5): 1.0}
    assert run(spark, [], [(5, item)]) == {} and run(spark, docs, []) == {}


def test_clean_documents_stay(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "a " + item), (2, "clean"), (None, "clean"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert sorted((r.doc_id or 0) for r in decontaminate.decontaminate(docs, bench).collect()) == [0, 2, 3]


def test_clean_documents_beside_a_leaked_one_with_their_id_stay(spark):
    item = " ".join(f"q{i}" for i in range(20))
    rows = [(7, "a " + item), (7, "clean"), (None, "b " + item), (None, "clean too"), (None, None), (8, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, bench).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("7", "clean"), ("None", "None"), ("None", "clean too")]
    found = decontaminate.leaks(docs, bench).collect()
    assert sorted((str(r.doc_id), r.start) for r in found) == [("7", 1), ("8", 0), ("None", 1)]


def test_items_with_null_and_repeated_ids(spark):
    texts = [" ".join(f"i{n}x{i}" for i in range(20)) for n in range(8)]
    ids = [None] * 4 + [6] * 4
    docs = list(enumerate(texts))
    bench = spark.createDataFrame(list(zip(ids, texts)), "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in found) == [(n, i, 1.0) for n, i in enumerate(ids)]


def test_swapped_halves_as_brute_force(spark):
    rng = random.Random(8)
    prose = lambda n: [f"v{rng.randrange(500)}" for _ in range(n)]
    items, docs = [], []
    for n, size in enumerate((40, 45, 52, 59)):
        own = prose(size)
        items.append((n, " ".join(own)))
        for m, cut in enumerate((size // 2, size // 3)):
            docs.append((10 * n + m, " ".join(prose(7 * m) + own[cut:] + own[:cut] + prose(9))))
    want = brute(docs, items)
    assert len(want) >= 6
    for options in ({}, {"broadcast_rows": 0}):
        got = run(spark, docs, items, **options)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_short_items_inside_documents(spark):
    items = [(1, "alpha"), (2, "beta gamma"), (3, "one two three four"), (4, "f1 f2 f3 f4 f5 f6")]
    docs = [(1, "x alpha y"), (2, "beta x gamma"), (3, "z beta gamma beta gamma"), (4, "a one two three four b f1 f2 f3 f4 f5 f6 c"),
            (5, "three four"), (6, "alpha"), (7, "f1 f2 f3 f4 f5 f6")]
    want = brute(docs, items)
    assert {(1, 1), (3, 2), (4, 3), (4, 4), (6, 1)} <= want.keys()
    assert run(spark, docs, items) == want


def test_occurrences_of_repeated_shingles(spark):
    rng = random.Random(9)
    rows = [(n, [rng.randrange(max(n // 3, 1)) for _ in range(n)]) for n in (0, 1, 2, 9, 50)] + [(99, [4] * 20_000)]
    frame = spark.createDataFrame(rows, "n long, s array<bigint>")
    want = frame.select("n", F.explode("s").alias("x")).groupBy("n", "x").count().select(
        "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("count").cast("int")), lambda k: F.xxhash64("x", k))).alias("h"))
    got = frame.select("n", F.explode(decontaminate._occurrences("s")).alias("h"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_long_item_with_a_repeated_shingle(spark):
    words = [f"u{n % 590}" for n in range(600)]
    docs = [(1, "x " + " ".join(words) + " y"), (2, " ".join(words[:300])), (3, " ".join(words[:520] + ["z"] * 80))]
    got = run(spark, docs, [(1, " ".join(words))])
    assert got.keys() == {(1, 1), (3, 1)} and got[1, 1] == 1.0
