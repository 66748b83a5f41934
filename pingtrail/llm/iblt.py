"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, cut at sentence ends, and long pieces
without one every 16 words.  Each has a 64-bit digest (of its text and of which
occurrence it is).  A sketch has cells of a count, the XOR of digests and the
XOR of their checks; a digest goes to three cells.  The difference of two
sketches, cell by cell, holds only the digests that differ: peeling takes them
out one by one, from cells that hold one.  If that fails the two are sketched
anew with four times the cells.  The likeness is the share of digests in
common, by the number that differ.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingtrail.llm.shared import texts

#: Cells of a fingerprint (three tables of eight), and the growth of a retry.
CELLS, GROWTH = 24, 4
WORDS = 16
#: Characters of text that a task compares at a time.
STEP = 2_000_000
#: Characters of a text that a cut through the rows of one id compares, and the rows drawn for such cuts (for each bucket, and at most).
HEAD, DRAWN, MOST_DRAWN = 256, 64, 20_000
NULL_ID = -(2 ** 63)
_END = re.compile(r"\n|(?<=[.!?]) ")
_CELL = np.dtype([("count", "<i2"), ("digests", "<u8"), ("checks", "<u4")])


def digests(text: str) -> list[int]:
    """The distinct 64-bit digests of a text's paragraphs."""
    from xxhash import xxh64_intdigest

    out, seen = [], {}
    for piece in _END.split(text):
        parts = (piece,)
        if len(piece) > 200:
            words = piece.split(" ")
            parts = [" ".join(words[k:k + WORDS]) for k in range(0, len(words), WORDS)]
        for part in parts:
            if part:
                n = seen[part] = seen.get(part, 0) + 1
                out.append(xxh64_intdigest(part.encode("utf-8", "surrogatepass"), n))
    return out


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers (multiply and shift, twice)."""
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _places(values: np.ndarray, cells: int) -> list[np.ndarray]:
    """The three cells of each digest, one in each third."""
    third = cells // 3
    return [(_mix(values, salt) % np.uint64(third)).astype("i8") + salt * third for salt in range(3)]


def _check(values: np.ndarray) -> np.ndarray:
    return (_mix(values, 7) >> np.uint64(32)).astype("u4")


def sketch(values: np.ndarray, owner: np.ndarray, n: int, cells: int, signs: np.ndarray | int = 1) -> np.ndarray:
    """The sketches of ``n`` owners, a row each; a sign of -1 subtracts."""
    out = np.zeros(n * cells, [("count", "<i4"), ("digests", "<u8"), ("checks", "<u4")])
    for place in _places(values, cells):
        at = owner * cells + place
        np.add.at(out["count"], at, signs)
        np.bitwise_xor.at(out["digests"], at, values)
        np.bitwise_xor.at(out["checks"], at, _check(values))
    return out.reshape(n, cells)


def peel(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Take the digests out of differences of sketches (a row each): owner,
    digest and sign of each, and which rows came out empty."""
    n, cells = table.shape
    flat = table.reshape(-1).copy()
    found: list[tuple] = []
    while True:
        at = np.flatnonzero((np.abs(flat["count"]) == 1) & (flat["checks"] == _check(flat["digests"])))
        if not len(at):
            break
        owner, value, sign = at // cells, flat["digests"][at], flat["count"][at]
        order = np.lexsort((value, owner))  # a digest may stand alone in more than one of its cells
        owner, value, sign = owner[order], value[order], sign[order]
        new = np.ones(len(at), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        owner, value, sign = owner[new], value[new], sign[new]
        found.append((owner, value, sign))
        gone = sketch(value, owner, n, cells, sign).reshape(-1)
        flat["count"] -= gone["count"]
        flat["digests"] ^= gone["digests"]
        flat["checks"] ^= gone["checks"]
        if sum(len(f[0]) for f in found) > 4 * n * cells:  # false checks may put digests back
            break
    left = ((flat["count"] != 0) | (flat["digests"] != 0)).reshape(n, cells).any(axis=1)
    joined = [np.concatenate(x) if found else np.empty(0, "i8") for x in zip(*found)] or [np.empty(0, "i8")] * 3
    return joined[0], joined[1], joined[2], ~left


def differing(left: list[list[int]], right: list[list[int]]) -> np.ndarray:
    """How many digests differ between each pair of lists."""
    out = np.zeros(len(left), "i8")
    todo, cells = np.arange(len(left)), CELLS
    while len(todo):
        a, b = [left[k] for k in todo], [right[k] for k in todo]
        sizes = np.array([len(x) for x in a] + [len(x) for x in b])
        most = int(max((len(x) + len(y) for x, y in zip(a, b)), default=0))
        values = np.array([v for x in (*a, *b) for v in x], "u8")
        owner = np.repeat(np.tile(np.arange(len(todo)), 2), sizes)
        signs = np.repeat(np.repeat([1, -1], len(todo)), sizes)
        owners, _, _, done = peel(sketch(values, owner, len(todo), cells, signs))
        out[todo[done]] = np.bincount(owners, minlength=len(todo))[done]
        todo = todo[~done]
        if cells > 8 * most + 64 and len(todo):  # cells were no shortage: two digests share their three cells
            out[todo] = [len(set(left[k]) ^ set(right[k])) for k in todo]
            break
        cells *= GROWTH
    return out


def _text_of(row: np.ndarray) -> str:
    return base64.b64encode(row.astype(_CELL).tobytes()).decode()


def compare(mine: list[str], nexts: list[str]) -> list[tuple]:
    """For each text and the one after it: n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    halves = [len(t) // 2 for t in mine]
    edited = [t[:len(t) - h] + other[:h] for t, h, other in zip(mine, halves, nexts)]
    own, changed, after = [digests(t) for t in mine], [digests(t) for t in edited], [digests(t) for t in nexts]
    prints = []
    for lists in (own, changed):
        values = np.array([v for x in lists for v in x], "u8")
        owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        prints.append(sketch(values, owner, len(lists), CELLS))
    near = []
    for other in (changed, after):
        total = np.array([len(x) + len(y) for x, y in zip(own, other)])
        apart = differing(own, other)
        near.append(np.where(total == 0, 1.0, (total - apart) / np.maximum(total + apart, 1)))
    return [(len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), _text_of(a), _text_of(b), x, y)
            for t, e, a, b, x, y in zip(mine, edited, *prints, near[0].tolist(), near[1].tolist())]


def _cuts(rows: DataFrame, times: dict[int, int], buckets: int) -> dict[int, list[str]]:
    """For each id that fills more than one range: the text heads that cut its rows
    into as many ranges.  They only say which task compares a row."""
    hot = sorted(key for key, k in times.items() if k > 1)
    if not hot:
        return {}
    heads = rows.where(F.col("doc_id").isin(hot)).select("doc_id", F.substring("text", 1, HEAD).alias("head"))
    drawn: dict[int, list[str]] = {}
    for r in heads.orderBy(F.rand(17)).limit(min(DRAWN * buckets, MOST_DRAWN)).collect():
        drawn.setdefault(r.doc_id, []).append(r.head)
    out = {key: sorted({sorted(own)[len(own) * k // times[key]] for k in range(1, times[key])}) for key, own in drawn.items()}
    return {key: own for key, own in out.items() if own}


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text is the text with its last half (rounded down) replaced by
    the first as many characters of the next document, by descending doc_id
    (the last one's next is the first).  Equal ids are ordered by text, NULL ids
    come last, NULL texts are empty; two texts without paragraphs are alike
    (1.0).  Other columns are ignored, and an empty table gives no rows.

    Documents are dealt out once, by ranges of doc_id with sampled bounds; an id
    with more rows than a range is cut by ranges of its texts (by their first
    ``HEAD`` characters; equal rows share a range).  The first of each range goes
    to the range before it as well, as its last one's next.  The driver holds two
    numbers of each range and the cuts."""
    spark = docs.sparkSession
    rows = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / n for k in range(1, n)]
    found = rows.agg(F.percentile_approx("doc_id", shares, max(10_000, 4 * n)).alias("q")).first().q if shares else None
    bounds, times = np.unique(np.array(found or [], "i8"), return_counts=True)
    cuts = _cuts(rows, dict(zip(bounds.tolist(), times.tolist())), n)
    # range k of ids starts at bounds[k - 1], whose texts may be cut; earlier rows have greater numbers
    room = np.array([1] + [1 + len(cuts.get(b, ())) for b in bounds.tolist()])
    base = np.cumsum(room) - room

    def bucket_of(ids: np.ndarray, text: pa.Array | None) -> np.ndarray:
        at = np.searchsorted(bounds, ids, "right")
        out = base[at] + room[at] - 1
        for row in np.flatnonzero(np.isin(ids, list(cuts))) if cuts else ():
            out[row] -= bisect_right(cuts[int(ids[row])], text[row].as_py()[:HEAD])
        return out

    def number(batches):
        for batch in batches:
            at = bucket_of(batch.column("doc_id").to_numpy(), batch.column("text") if cuts else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(at)], names=["doc_id", "bucket"])

    keys = rows.select("doc_id", F.substring("text", 1, HEAD).alias("text")) if cuts else rows.select("doc_id")
    tops = keys.mapInArrow(number, "doc_id long, bucket long").groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()
    tops = sorted((r.bucket, r.top) for r in tops)  # one of each range
    # the first of a range is the next one of the range before it (above); of all, of the lowest
    used = np.array([b for b, _ in tops], "i8")
    top = np.array([t for _, t in tops], "i8")
    above = np.array([b for b, _ in tops[1:]] + [tops[0][0]] if tops else [], "i8")

    def deal(batches):
        names = ["bucket", "tail", "doc_id", "text"]
        for batch in batches:
            ids, text = batch.column("doc_id").to_numpy(), batch.column("text")
            at = bucket_of(ids, text)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.zeros(len(ids), "i4")), *batch.columns], names=names)
            place = np.searchsorted(used, at)
            firsts: dict[int, int] = {}  # of each range, the row of its first id with the first text
            for row in np.flatnonzero(top[place] == ids).tolist():
                other = firsts.setdefault(int(place[row]), row)
                if other != row and text[row].as_py() < text[other].as_py():
                    firsts[int(place[row])] = row
            if firsts:
                tail = pa.array(list(firsts.values()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(above[list(firsts)]), pa.array(np.ones(len(tail), "i4")), *(c.take(tail) for c in batch.columns)], names=names)

    def run(batches):
        def all_rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")))

        held, size = [], 0
        for _, group in groupby(all_rows(), key=lambda r: r[0]):
            last = None
            for _, tail, key, text in group:
                if last is not None:
                    held.append((*last, text))
                    size += len(last[1]) + len(text)
                    if size > STEP:
                        yield _rows(held)
                        held, size = [], 0
                last = None if tail else (key, text)
                if tail:
                    for _ in group:  # equal ids: the first one is the next
                        pass
        if held:
            yield _rows(held)

    dealt = rows.mapInArrow(deal, "bucket long, tail int, doc_id long, text string")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "tail", F.desc("doc_id"), "text")
    out = ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                                  "edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def _rows(held: list[tuple]) -> pa.RecordBatch:
    found = list(zip(*compare([h[1] for h in held], [h[2] for h in held])))
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()),
                                       *(pa.array(c, k) for c, k in zip(found, kinds))], names=["doc_id", *names])
