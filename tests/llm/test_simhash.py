import random

import xxhash

from pingtrail.llm import simhash
from pingtrail.llm.components import connected_components


def brute_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ")
             .replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def brute(rows):
    prints = [brute_fingerprint(t or "") for _, t in rows]
    found = components(range(len(rows)), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    groups = {}
    for n, r in found.items():
        groups.setdefault(r, []).append(n)
    least = {r: min((rows[n][0] for n in ns if rows[n][0] is not None), default=None) for r, ns in groups.items()}
    return sorted((rows[n][0] is None, rows[n][0] or 0, f"{prints[n]:016x}", least[found[n]] or 0) for n in range(len(rows)))


def texts(seed):
    rng = random.Random(seed)
    words = ["ab", "Cd", "é", "fgh", "ijk", "ÄL", "mn\x1co", "p\xa0q"]
    out = [None, "", " \n\t", "One", "one", "one two", "ONE  two\n", "a b c", "A\tb\rc d"]
    for _ in range(6):
        base = [rng.choice(words) + str(rng.randint(0, 9)) for _ in range(300)]
        out.append(" ".join(base))
        for _ in range(5):
            near = list(base)
            near[rng.randrange(len(near))] = "x"
            out += [" ".join(near), " ".join(near).upper()]
        out += [" ".join(base)] * 3
    return out


def test_as_brute_force(spark, docs_of):
    for seed in range(2):
        rows = list(zip([None, *random.Random(seed).sample(range(10_000), 200)], texts(seed)))
        got = simhash.near_duplicates(docs_of([t for _, t in rows], [i for i, _ in rows])).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id or 0) for r in got) == brute(rows)


def test_links_reach_all_within_the_radius(spark):
    rng = random.Random(3)
    prints = {0, (1 << 64) - 1}
    for _ in range(15):
        f = rng.getrandbits(64)
        prints |= {f} | {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(12)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for radius in (0, 2, 4):
        found = {(r.a, r.b) for r in simhash.links(frame, radius).collect()}
        near = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1") <= radius
        assert all(near(a, b) for a, b in found)
        linked = found | {(b, a) for a, b in found}
        assert components(signed, near) == components(signed, lambda a, b: (a, b) in linked)


def test_long_text_in_blocks(monkeypatch):
    text = " ".join(str(i * 7919) for i in range(3000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK", 50)
    assert simhash.fingerprint(text.encode()) == whole == brute_fingerprint(text)


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_components_of_chains_stars_and_nulls(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 220)]
    star = [(500, i) for i in range(501, 640)]
    odd = [(7, 7), (None, 8), (9, 10), (10, 9), (9, 10)]
    links = chain + star + odd
    rng.shuffle(links)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 221)}, **{i: 500 for i in range(501, 640)}, 10: 9}
