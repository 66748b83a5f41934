"""Line deduplication by an exact set-similarity join.

A line's tokens are the set of its words (between ASCII white space, A-Z
lower-cased).
Lines with equal sets are one *class*, whose first line is the one with the
smallest (doc_id, text_hash, line).  Two classes match if the Jaccard similarity of their
sets reaches the threshold t.  A line is removed if an earlier line matches it:
all but the first line of a class go, and that one goes too if the class
matches one whose first line is earlier.

The join orders each line's tokens by rarity, from counts in a table of fixed
size (tokens in the same slot are ordered by their hash: any order that all
lines share is right).  Matching sets of sizes m <= n must

* share a token of their prefixes, the size - ceil(t * size) + 1 rarest ones,
* have m >= t * n, and
* share at least t / (1 + t) * (m + n) tokens, which the places of the shared
  prefix token bound from above, and
* so differ in at most (1 - t) / (1 + t) * (m + n) tokens, each of which flips
  one bit of a 128-bit parity map of the set: the maps differ in no more bits.

They also share enough of their prefixes: tokens of the prefix that ends first, in the common order, are in the
other prefix or not in the other set.  So with m <= n, at least ceil(t / (1 + t) * (m + n)) - ceil(t * n) + 1 tokens are
in both prefixes.

What passes is verified on the whole sets.

Whether a class goes depends on one earlier match only, so pairs are not listed.
First, every class is held against the earliest class of its bin that has two
neighbouring prefix tokens in common (those neighbours with the smallest hashes): a
large group of near copies is decided by the first members of its bins, in a few pairs per line.  Rounds with other bins
follow for the classes that met one like them but none that matches, as long as
they decide some.  Then the classes still undecided are held against all earlier ones that share a prefix token, so a class
stays only after every candidate has failed.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingtrail.llm.shared import column_safe, release_unused, stored, texts
from pingtrail.sources.stages import setting

SIMILARITY = 0.8
#: Slots of the token counts (bounds what goes to the driver and to each task), and bits of the candidate filter.
SLOTS, FILTER_BITS = 1 << 18, 1 << 26
#: Bins of the classes with two prefix tokens in common, and how many pairs of neighbours are tried.
BINS, NEIGHBOURS = 8, 5
#: Another round follows one that decided more than this share of the classes that met one like them and are still undecided.
WORTH = 0.02
#: Characters of text that a task takes apart at a time, rows of the index that it holds and pairs of them that it compares at a time.
STEP, ROWS, PAIRS = 4_000_000, 100_000, 1 << 18
#: Slots whose counts are one row.
PART = 4096
NULL_ID = -(2 ** 63)
_EPS = 1e-9


def _text_hash() -> Column:
    """Beside the id this names a document: ids may be NULL or repeated."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _rows(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumns({"doc_id": F.coalesce("doc_id", F.lit(NULL_ID)), "text_hash": _text_hash()})


def _portions(batches):
    """Batches cut to about ``STEP`` characters.  Memory that this worker's earlier tasks left unused goes back first."""
    release_unused()
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            begin = ends[at - 1] if at else 0
            to = max(int(np.searchsorted(ends, begin + STEP, "right")), at + 1)
            yield batch.slice(at, to - at)
            at = to


def _lines(text: pa.Array):
    """The lines of texts: (row of each, its number in the text, the lines)."""
    lists = pc.split_pattern(text.cast(pa.large_string()), "\n")
    counts = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, number, lists.flatten()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each bit of a result hangs on all bits of its number."""
    with np.errstate(over="ignore"):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
        return x ^ (x >> np.uint64(33))


def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and length in bytes of each of ``words`` (none NULL): its bytes, each
    times a number that its place in the word fixes, added up and mixed."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, "i8")[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(data or b"", "u1")[ends[0]:ends[-1]]
    starts, size = ends[:-1] - ends[0], np.diff(ends)
    places = _mixed(np.arange(1, size.max(initial=0) + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    at = np.arange(len(data)) - np.repeat(starts, size)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data + np.uint64(1)) * places[at], dtype="u8")])
        return _mixed(sums[starts + size] - sums[starts] + size.astype("u8")), size


def _tokens(lines: pa.Array):
    """Words of lines: (line of each word, its code, hash of each code)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(lines))
    words = lists.flatten().dictionary_encode()
    line = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    hashes, length = _hashes(words.dictionary)
    codes = words.indices.to_numpy()
    if not length.all():  # white space at an end of a line gives empty words
        keep = length[codes] > 0
        return line[keep], codes[keep], hashes
    return line, codes, hashes


def token_counts(docs: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """How often the tokens of each slot occur: at most ``slots`` numbers."""
    def rows(counts):
        parts = [k for k in sorted(counts) if counts[k].any()]
        return pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "n": pa.array([counts[k].tobytes() for k in parts], pa.binary())})

    def run(batches):
        counts = np.zeros(-(-slots // PART) * PART, "i8")
        for batch in _portions(batches):
            _, codes, hashes = _tokens(batch.column("text"))  # a line ends in white space, so words are those of its lines
            own = np.bincount(codes, minlength=len(hashes))
            np.add.at(counts, (hashes % np.uint64(slots)).astype("i8"), own)
        yield rows(dict(enumerate(counts.reshape(-1, PART))))

    def add(batches):
        counts = {}
        for batch in batches:
            for part, n in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist()):
                counts[part] = counts.get(part, 0) + np.frombuffer(n, "i8")
        yield rows(counts)

    kinds = "part int, n binary"
    found = _rows(docs).select("text").mapInArrow(run, kinds).repartition("part").mapInArrow(add, kinds).collect()
    out = np.zeros(-(-slots // PART) * PART, "i8")
    for r in found:
        out[r["part"] * PART:][:PART] = np.frombuffer(r["n"], "i8")
    return out[:slots]


def _sets(lines: pa.Array, counts: np.ndarray):
    """The token set of each line, rarest first: (sizes, tokens of all lines
    one after another, two 64-bit digests and the parity map of each set)."""
    line, codes, hashes = _tokens(lines)
    order = np.lexsort((hashes, counts[(hashes % np.uint64(len(counts))).astype("i8")]))
    rank = np.empty(len(order), "i8")
    rank[order] = np.arange(len(order))
    keys = np.sort((line.astype("i8") << 32) | rank[codes])
    keys = keys[np.diff(keys, prepend=-1) > 0]
    line, tokens = keys >> 32, hashes[order][keys & 0xFFFFFFFF]
    sizes = np.bincount(line, minlength=len(lines))
    digests = []
    with np.errstate(over="ignore"):
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            mixed = (tokens ^ (tokens >> np.uint64(29))) * np.uint64(factor)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed ^ (mixed >> np.uint64(32)), dtype="u8")])
            ends = np.cumsum(sizes)
            digests.append(sums[ends] - sums[ends - sizes])
    for half in (0, 1):  # seven bits of a token's hash choose its bit
        bit = np.where((tokens >> np.uint64(57)) & np.uint64(1) == half, np.uint64(1) << (tokens >> np.uint64(58)), np.uint64(0))
        flips = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(bit)])
        digests.append(flips[ends] ^ flips[ends - sizes])
    return sizes, tokens, *digests


def _prefix(sizes: np.ndarray, similarity: float) -> np.ndarray:
    return np.where(sizes > 0, sizes - np.ceil(similarity * sizes - _EPS).astype("i8") + 1, 0)


def line_table(docs: DataFrame, counts: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """A row per line with tokens: ``doc_id``, ``text_hash``, ``line`` (from 0), ``a``, ``b``
    (digests of its set), ``p``, ``q`` (its parity map), ``size``, ``prefix`` (32-bit
    hashes of the rarest tokens); one row with size 0 for a document without such lines."""
    def run(batches):
        for batch in _portions(batches):
            row, number, lines = _lines(batch.column("text"))
            sizes, tokens, *digests = _sets(lines, counts)
            starts = np.cumsum(sizes) - sizes
            length = _prefix(sizes, similarity)
            within = np.arange(len(tokens)) - np.repeat(starts, sizes)
            short = (tokens[within < np.repeat(length, sizes)] & np.uint64(0xFFFFFFFF)).astype("u4").view("i4")
            offsets = np.concatenate([[0], np.cumsum(length)])
            keep = sizes > 0
            bare = np.setdiff1d(np.arange(batch.num_rows), row[keep])
            ids, texts_ = batch.column("doc_id").to_numpy(), batch.column("text_hash").to_numpy()
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], offsets[1:][keep]]), pa.int32()), pa.array(short))
            kinds = "doc_id", "text_hash", "line", "a", "b", "p", "q", "size", "prefix"
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[row[keep]]), pa.array(texts_[row[keep]]), pa.array(number[keep].astype("i4")),
                *(pa.array(d[keep].view("i8")) for d in digests), pa.array(sizes[keep].astype("i4")), prefix],
                names=kinds)
            none = np.zeros(len(bare), "i8")
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[bare]), pa.array(texts_[bare]), pa.array(none.astype("i4") - 1), *[pa.array(none)] * 4, pa.array(none.astype("i4")),
                pa.array([[]] * len(bare), pa.list_(pa.int32()))], names=kinds)

    return _rows(docs).mapInArrow(run, "doc_id long, text_hash long, line int, a long, b long, p long, q long, size int, prefix array<int>")


def _fits(x: str, y: str, similarity: float) -> Column:
    """The filters on sizes and parity maps, for structs or aliases ``x`` and ``y``."""
    m, n = F.col(f"{x}.size"), F.col(f"{y}.size")
    apart = sum(F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in "pq")
    differ = F.lit((1 - similarity) / (1 + similarity)) * (m + n) + F.lit(_EPS)
    return (F.col(f"{x}.a") != F.col(f"{y}.a")) & (apart <= differ) & (m >= similarity * n - _EPS) & (n >= similarity * m - _EPS)


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(f"{x}.a", f"{y}.a").alias("x"), F.greatest(f"{x}.a", f"{y}.a").alias("y")]


def first_candidates(classes: DataFrame, similarity: float, turn: int, bins: int = BINS) -> DataFrame:
    """Pairs ``x`` < ``y`` of digests ``a``: each class and the first one of its bin with the same
    two neighbours in the prefix, if they pass the filters.  Of a class's neighbours, those with the smallest hashes
    are tried (others each ``turn``, like the bins): near copies choose the same ones, wherever they differ."""
    two = F.transform(F.sequence(F.lit(0), F.greatest(F.size("prefix") - 2, F.lit(0))),
                      lambda i: F.xxhash64(F.get("prefix", i), F.get("prefix", i + 1), F.lit(turn)))
    bin_ = F.pmod(F.xxhash64("a", F.lit(turn)), F.lit(bins))
    keys = F.transform(F.slice(F.sort_array(two), 1, NEIGHBOURS), lambda h: F.xxhash64(h, bin_))
    own = classes.select("doc_id", "a", "p", "q", "size", F.explode(keys).alias("key"))
    w = Window.partitionBy("key").orderBy("doc_id", "a").rowsBetween(Window.unboundedPreceding, 0)
    first = own.select(F.struct("a", "p", "q", "size").alias("own"), F.first(F.struct("a", "p", "q", "size")).over(w).alias("first"))
    return first.where(_fits("own", "first", similarity)).select(*_pair("own", "first")).distinct()


def _spans(begin: np.ndarray, end: np.ndarray, most: int):
    """(row, place) of all places from ``begin`` to ``end`` of each row, ``most`` at a time."""
    ends = np.cumsum(np.maximum(end - begin, 0))
    starts = np.concatenate([[0], ends[:-1]])
    for at in range(0, int(ends[-1]) if len(ends) else 0, most):
        to = min(at + most, ends[-1])
        rows = slice(np.searchsorted(ends, at, "right"), np.searchsorted(ends, to - 1, "right") + 1)
        first = np.maximum(starts[rows], at)
        count = np.minimum(ends[rows], to) - first
        row = np.repeat(np.arange(rows.start, rows.stop), np.maximum(count, 0))
        yield row, np.arange(at, to) + (begin - starts)[row]


def _packed(*names: str) -> Column:
    """Numbers as the bytes of one column: each column of a row costs time on its way to Python."""
    return F.unhex(F.concat(*[F.lpad(F.hex(n), 16, "0") for n in names]))


def _numbers(packed: pa.ChunkedArray) -> list[np.ndarray]:
    """The four numbers of each of :func:`_packed`."""
    flat = b"".join(packed.to_pylist())
    return [n.astype("i8") for n in np.frombuffer(flat, ">i8").reshape(-1, 4).T]


def _meetings(similarity: float):
    """From rows (``key``, ``at``, ``own``) sorted by token and size, their ``key``, to the pairs of a token that pass the filters:
    ``x`` < ``y`` and ``need``, the number of tokens that their prefixes must share."""
    each = (1 - similarity) / (1 + similarity)

    def together(batches):
        kept, n = [], 0
        for batch in batches:
            kept.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                yield pa.Table.from_batches(kept)
                kept, n = [], 0
        if n:
            yield pa.Table.from_batches(kept)

    def run(batches):
        held = None  # rows of the last token that further ones may meet
        for table in together(batches):
            new = [table.column("key").to_numpy(), table.column("at").to_numpy(), *_numbers(table.column("own"))]
            key, at, doc, a, p, q = new = new if held is None else [np.concatenate(both) for both in zip(held, new)]
            p, q = p.view("u8"), q.view("u8")
            size, pos, open_ = key & 0xFFFFFFFF, at >> 1, (at & 1).astype(bool)
            low = np.searchsorted(key, key - size + np.ceil(similarity * size - _EPS).astype("i8"))
            last = np.flatnonzero(open_)
            own = np.arange(len(at) - table.num_rows, len(at))
            most = np.minimum(np.floor(2 * each * size + _EPS), 255).astype("u1")
            for side in (open_, ~open_):  # an open class meets all, another one those that are open
                i = own[side[own]]
                begin, end = (low[i], i) if side is open_ else (np.searchsorted(last, low[i]), np.searchsorted(last, i))
                for row, j in _spans(begin, end, PAIRS):
                    k = i[row]
                    if side is not open_:
                        j = last[j]
                    apart = np.bitwise_count(p[k] ^ p[j]) + np.bitwise_count(q[k] ^ q[j])
                    hit = np.flatnonzero(apart <= most[k])
                    k, j, apart = k[hit], j[hit], apart[hit]
                    n, m = size[k], size[j]
                    later = np.where(doc[j] < doc[k], open_[k], np.where(doc[k] < doc[j], open_[j], open_[k] | open_[j]))
                    shared = np.ceil(similarity / (1 + similarity) * (m + n) - _EPS).astype("i8")
                    good = later & (a[k] != a[j]) & (apart <= each * (m + n) + _EPS)
                    good &= np.minimum(n - pos[k], m - pos[j]) + np.minimum(pos[k], pos[j]) >= shared
                    need = shared - np.ceil(similarity * n - _EPS).astype("i8") + 1
                    x, y = np.minimum(a[k], a[j])[good], np.maximum(a[k], a[j])[good]
                    yield pa.RecordBatch.from_pydict({"x": pa.array(x), "y": pa.array(y), "need": pa.array(need[good].astype("i4"))})
            held = [c[low[-1]:].copy() for c in new]

    return run


def all_candidates(classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``x`` < ``y`` of classes, the later of them ``open``, which share enough prefix tokens, if they pass the filters.

    The classes with one token come sorted by size, so each is held against those only that are not too small."""
    index = classes.select("open", _packed("doc_id", "a", "p", "q").alias("own"), "size", F.posexplode("prefix").alias("pos", "token"))
    # one number to sort by: token and size, and one of the token's place and whether the class is open
    key = F.shiftleft(F.col("token").cast("long"), 32).bitwiseOR(F.col("size").cast("long"))
    at = F.col("pos") * 2 + F.col("open").cast("int")
    index = index.select(key.alias("key"), at.alias("at"), "own")
    index = index.repartition(F.shiftright("key", 32)).sortWithinPartitions("key")
    met = index.mapInArrow(_meetings(similarity), "x long, y long, need int")
    return met.groupBy("x", "y", "need").agg(F.count(F.lit(1)).alias("n")).where("n >= need").select("x", "y")


def _filter_of(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of fixed size of the slots (as of :func:`_slots`) of (``doc_id``, ``text_hash``, ``line``)."""
    mixed = F.col("text_hash").bitwiseXOR(F.shiftleft("doc_id", 7)).bitwiseXOR(F.col("line").cast("long"))
    slot = keys.select(F.pmod(mixed, F.lit(bits)).alias("slot"))
    words = slot.select(F.shiftright("slot", 6).alias("w"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("m"))
    got = words.groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    out = np.zeros(bits // 64, "i8")
    out[got["w"].to_numpy("i8")] = got["m"].to_numpy("i8")
    return out


def _slots(doc_id: np.ndarray, text_hash: np.ndarray, line: np.ndarray, bits: int) -> np.ndarray:
    return (text_hash ^ (doc_id << 7) ^ line) % bits


def _sets_of(docs: DataFrame, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """``a``, ``b``, ``tokens`` of the lines ``wanted`` (``doc_id``, ``text_hash``,
    ``line``, ``a``, ``b``).  Their hashes go to all tasks as a bitmap of fixed size, so that no text is
    shuffled and only such lines (and a few others) are taken apart."""
    bitmap = _filter_of(wanted, bits)
    none = np.ones(1, "i8")
    rows = _rows(docs).select("doc_id", "text_hash", "text")

    def run(batches):
        for batch in _portions(batches):
            row, number, lines = _lines(batch.column("text"))
            slots = _slots(*(batch.column(c).to_numpy()[row] for c in ("doc_id", "text_hash")), number, bits)
            hit = np.flatnonzero((bitmap[slots >> 6] >> (slots & 63)) & 1)
            if not len(hit):
                continue
            sizes, tokens, a, b, *_ = _sets(lines.take(pa.array(hit)), none)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays([
                *(pa.array(batch.column(c).to_numpy()[row[hit]]) for c in ("doc_id", "text_hash")), pa.array(number[hit].astype("i4")),
                pa.array(a.view("i8")), pa.array(b.view("i8")), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens.view("i8")))],
                names=["doc_id", "text_hash", "line", "a", "b", "tokens"])

    found = rows.mapInArrow(run, "doc_id long, text_hash long, line int, a long, b long, tokens array<long>")
    return found.join(wanted, ["doc_id", "text_hash", "line", "a", "b"]).select("a", "b", "tokens").dropDuplicates(["a", "b"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("a")).distinct()


def _named(classes: DataFrame, ends: DataFrame) -> DataFrame:
    """The classes ``ends`` (``a``) by the places of their first lines."""
    return stored(classes.select("a", "b", "doc_id", "text_hash", "line").join(ends, "a", "left_semi"), "wanted")


def verify(sets: DataFrame, named: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The later class of each of ``pairs`` that is as similar as ``similarity``: ``a``,
    ``b`` and ``earlier``, the first line of the earliest of its matches here.  The pairs'
    classes are in ``sets`` (``a``, ``b``, ``tokens``) and ``named``."""
    both = sets.join(named, ["a", "b"])
    side = lambda s: both.select(*[F.col(c).alias(f"{s}_{c}") for c in both.columns])
    met = pairs.join(side("x"), F.col("x") == F.col("x_a")).join(side("y"), F.col("y") == F.col("y_a"))
    shared = F.size(F.array_intersect("x_tokens", "y_tokens"))
    either = F.size("x_tokens") + F.size("y_tokens") - shared
    met = met.where(shared >= F.lit(similarity) * either - F.lit(_EPS))
    at = lambda s: F.struct(*[F.col(f"{s}_{c}").alias(c) for c in ("doc_id", "text_hash", "line")])
    later = at("x") > at("y")
    pick = lambda c: F.when(later, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")).alias(c)
    found = met.select(pick("a"), pick("b"), F.when(later, at("y")).otherwise(at("x")).alias("earlier"))
    return stored(found.groupBy("a", "b").agg(F.min("earlier").alias("earlier")), "matched")


def matches(docs: DataFrame, classes: DataFrame, similarity: float = SIMILARITY, worth: float = WORTH) -> DataFrame:
    """``a``, ``b`` and ``earlier`` (the first line of an earlier class that matches) of all classes that have one."""
    left, found = classes, []
    while True:
        pairs = stored(first_candidates(left, similarity, len(found)), "first")
        met = _ends(pairs)
        if not found:  # further rounds are among these classes, so their sets are read once
            named = _named(classes, met)
            sets = stored(_sets_of(docs, named), "sets")
        now = verify(sets, named, pairs, similarity)
        found.append(now)
        # classes that met one like them, but no match yet: members of large groups, mostly
        left = stored(left.join(met, "a", "left_semi").join(now.select("a"), "a", "left_anti"), "left")
        if now.count() <= worth * left.count():
            break
    done = functools.reduce(DataFrame.unionByName, found).groupBy("a", "b").agg(F.min("earlier").alias("earlier"))
    done = stored(done, "done")
    marked = classes.select("doc_id", "a", "p", "q", "size", "prefix").join(done.select("a", F.lit(True).alias("gone")), "a", "left")
    marked = marked.withColumn("open", F.col("gone").isNull()).drop("gone")
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "20000"):  # rows of the index are short
        pairs = stored(all_candidates(marked, similarity), "candidates")
    more = _named(classes, _ends(pairs).join(named.select("a"), "a", "left_anti"))
    sets = sets.unionByName(stored(_sets_of(docs, more), "sets"))
    rest = verify(sets, named.unionByName(more), pairs, similarity)
    return done.unionByName(rest).groupBy("a", "b").agg(F.min("earlier").alias("earlier"))


def decide(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row per line with tokens: ``doc_id``, ``text_hash``, ``line``,
    ``first_doc``, ``first_hash``, ``first_line`` (of its class), ``earlier_doc``,
    ``earlier_hash``, ``earlier_line`` (of an earlier class that matches, or NULL)
    and ``removed``; and one with line -1 for a document without such lines.

    Lines without tokens are never removed.  A NULL text has none, a NULL doc_id
    sorts first.  A document is a row's id and text: different texts under one id,
    or under NULL, are documents of their own, and equal rows are one.  An empty
    table gives none."""
    lines = stored(line_table(docs, token_counts(docs), similarity), "lines")
    first = F.min(F.struct("doc_id", "text_hash", "line", "prefix")).alias("first")
    classes = lines.where("size > 0").groupBy("a", "b", "p", "q", "size").agg(first)
    classes = stored(classes.select("a", "b", "p", "q", "size", "first.*"), "classes")
    earlier = matches(docs, classes, similarity)
    named = classes.select("a", "b", "doc_id", "text_hash", "line").join(earlier, ["a", "b"], "left").select(
        "a", "b", F.col("doc_id").alias("first_doc"), F.col("text_hash").alias("first_hash"), F.col("line").alias("first_line"),
        F.col("earlier.doc_id").alias("earlier_doc"), F.col("earlier.text_hash").alias("earlier_hash"), F.col("earlier.line").alias("earlier_line"))
    own = lines.where("size > 0").select("doc_id", "text_hash", "line", "a", "b").join(named, ["a", "b"])
    first = (F.col("doc_id") == F.col("first_doc")) & (F.col("text_hash") == F.col("first_hash")) & (F.col("line") == F.col("first_line"))
    found = [f"{k}_{c}" for k in ("first", "earlier") for c in ("doc", "hash", "line")]
    own = own.select("doc_id", "text_hash", "line", *found, (F.col("earlier_line").isNotNull() | ~first).alias("removed"))
    bare = lines.where("size = 0").select("doc_id", "text_hash", "line", *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in found],
                                          F.lit(False).alias("removed"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    both = own.unionByName(bare)
    return both.select(*[real(c) if c in ("doc_id", "first_doc", "earlier_doc") else F.col(c) for c in both.columns])


def _summary(decisions: DataFrame) -> DataFrame:
    """The rows of :func:`summarise` with ``text_hash``."""
    gone = F.array_sort(F.collect_set(F.when(F.col("removed"), F.col("line"))))
    return decisions.groupBy("doc_id", "text_hash").agg(
        F.sum((F.col("line") >= 0).cast("long")).alias("n_lines"), F.count("earlier_line").alias("n_matched"),
        F.sum(F.col("removed").cast("long")).alias("n_removed"), gone.alias("removed"))


def summarise(decisions: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``n_lines`` (with tokens), ``n_matched`` (lines whose
    class matches an earlier one), ``n_removed`` and ``removed`` (the lines' numbers)."""
    return _summary(decisions).drop("text_hash")


@column_safe
def remove_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the removed lines taken out of their texts, all columns
    and rows kept (a text may end up empty)."""
    gone = _summary(decide(docs, similarity).where("removed")).select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.col("text_hash").alias("_hash"), F.col("removed").alias("_gone"))
    parts = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_gone")
    kept = F.array_join(F.transform(left, lambda n: F.get(parts, n)), "\n")
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == gone["_id"]) & (_text_hash() == gone["_hash"])
    both = docs.join(gone, same, "left")
    return both.withColumn("text", F.when(F.col("_gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept))
