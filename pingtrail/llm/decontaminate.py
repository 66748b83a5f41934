"""Benchmark decontamination: SimHash of item-sized windows, a multi-index of
Hamming blocks, and exact weighted-shingle similarity for what it finds.

* Words are runs of letters and digits, lower-cased; a text's shingles are its
  runs of five words (fewer words: the whole sequence).  For an item of fewer
  words a document's shingles are runs of as many words.
* For an item of ``w`` words, windows of ``w`` words are laid over a document at
  every word where they hold so many places of the item's shingles, in any
  order, that the similarity can be reached (a running sum over those places).
  Elsewhere it cannot; windows are cut at the document's ends.
* A window's and an item's SimHash weigh each shingle by how often it occurs.
  Two fingerprints within the radius agree in at least one of radius + 1 blocks
  of bits; windows and items of one size meet at each such block.
* What meets within the radius is verified: weighted Jaccard similarity, the
  sum of the smaller over the sum of the larger numbers of each shingle.

All of it is DataFrame expressions.  Nothing but the numbers of the benchmark's
shingles and of the documents with windows, and the shingle lengths (five at
most), reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingtrail.llm.shared import column_safe, stored

SHINGLE, SIMILARITY, RADIUS, BITS = 5, 0.8, 19, 64
#: Rows (32 bytes each) up to which the benchmark's shingles, and the keys of documents with windows, are sent to
#: all tasks; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000
_EPS = 1e-9
_NOT_WORD = "[^\\p{L}\\p{N}]+"


def _word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(words: Column, k: int | Column) -> Column:
    """Hashes of the runs of ``k`` words; of all words if there are fewer; none for none."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1)))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(
        F.array().cast("array<bigint>"))


def _text_hash() -> Column:
    """Beside the id this names a document: ids may be NULL or repeated."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _read(df: DataFrame, key: str, k: int, *more: Column) -> DataFrame:
    df = df.select(F.col(key).cast("long").alias("key"), *more, _word_hashes(F.col("text").cast("string")).alias("words"))
    return df.withColumn("shingles", _shingles(F.col("words"), k))


def _fingerprints(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``fp``: the SimHash of each row's ``shingles``.  A long holds
    two counters, of bits i and i + 32, and the 32 sums are one aggregate."""
    h = F.col("h")
    lanes = [F.sum(F.shiftright(h, i).bitwiseAND(F.lit((1 << 32) + 1))).alias(f"s{i}") for i in range(32)]
    sums = df.select(*keys, F.explode("shingles").alias("h")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *lanes)
    bits = []
    for i in range(32):
        low = F.col(f"s{i}").bitwiseAND(F.lit((1 << 32) - 1))
        high = F.shiftrightunsigned(F.col(f"s{i}"), 32)
        for count, at in ((low, i), (high, i + 32)):
            value = (1 << at) - (1 << 64 if at == 63 else 0)
            bits.append(F.when(2 * count > F.col("n"), F.lit(value)).otherwise(F.lit(0)))
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return sums.select(*keys, fp.cast("long").alias("fp"))


def _blocks(fp: Column, radius: int) -> Column:
    """The ``radius`` + 1 blocks of a fingerprint's bits, as structs of number and value."""
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[
        F.struct(F.lit(n).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
        for n, (a, b) in enumerate(zip(edges[:-1], edges[1:]))])


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _occurrences(column: str) -> Column:
    """Each shingle of an array with the number of its occurrence, as one hash: the
    runs of the sorted array, each counted from 1."""
    def numbered(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return _bind(begins, lambda at: F.flatten(F.transform(at, lambda i, no: F.transform(
            F.sequence(F.lit(1), F.coalesce(F.get(at, no + 1), F.size(s)) - i), lambda nth: F.xxhash64(F.get(s, i), nth)))))

    a = F.col(column)
    repeated = _bind(F.array_sort(a), numbered)
    return F.when(F.size(F.array_distinct(a)) == F.size(a), F.transform(a, lambda x: F.xxhash64(x, F.lit(1)))).otherwise(repeated)


def _join(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the ``shingles`` of ``other``; NULL keys are equal."""
    other = other.select(*[F.col(c).alias(f"_{c}") for c in keys], "shingles")
    return df.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]).drop(*[f"_{c}" for c in keys])


def _starts(hits: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``key``, ``hash`` and ``starts`` (structs of ``w`` and ``start``): the windows
    of each document that hold enough places of an item's shingles, from all such
    places (``key``, ``hash``, ``length``, ``no``, ``w``, ``pos``).

    With ``m`` shingles in a window, ``n`` in the item and ``c`` in common the
    similarity is c / (m + n - c); ``c`` is at most the number of places."""
    k = F.least(F.col("w"), F.lit(shingle))
    n = F.col("w") - k + 1
    least = F.lit(similarity) * n - F.lit(_EPS)  # of c, for any m >= c
    pairs = hits.groupBy("key", "hash", "length", "no", "w").agg(F.collect_set("pos").alias("pos"))
    # a place is in the windows that start from pos + k - w to pos
    steps = F.concat(F.transform("pos", lambda p: F.struct((p + k - F.col("w")).alias("start"), F.lit(1).alias("step"))),
                     F.transform("pos", lambda p: F.struct((p + 1).alias("start"), F.lit(-1).alias("step"))))
    steps = pairs.where(F.size("pos") >= least).select("key", "hash", "length", "no", "w", F.explode(steps).alias("s"))
    along = Window.partitionBy("key", "hash", "length", "no", "w").orderBy("start")
    runs = steps.select("key", "hash", "length", "no", "w", "s.start", "s.step").select(
        "key", "hash", "length", "w", "start", F.sum("step").over(along).alias("c"), F.lead("start").over(along).alias("next"))
    runs = runs.where((F.col("next") > F.col("start")) & (F.col("c") >= least))
    laid = runs.select("key", "hash", "length", "w", "c", F.explode(F.sequence(F.col("start"), F.col("next") - 1)).alias("start"))
    words = F.least(F.col("start") + F.col("w"), F.col("length")) - F.greatest(F.col("start"), F.lit(0))
    m = F.greatest(words - k + 1, F.lit(1))
    laid = laid.where((words > 0) & (F.col("c") * F.lit(1 + similarity) >= F.lit(similarity) * (m + n) - F.lit(_EPS)))
    return laid.groupBy("key", "hash").agg(F.collect_set(F.struct("w", "start")).alias("starts"))


def _texts_of(docs: DataFrame, starts: DataFrame, broadcast_rows: int) -> DataFrame:
    """``starts`` with the ``words`` of its documents, each document once."""
    named = starts.select(F.col("key").alias("_key"), F.col("hash").alias("_hash"), "starts")
    keys = named.select("_key", "_hash")
    if keys.count() <= broadcast_rows:
        keys = F.broadcast(keys)
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("hash") == F.col("_hash"))
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), _text_hash().alias("hash"), F.col("text").cast("string").alias("text"))
    rows = rows.join(keys, same, "left_semi").dropDuplicates(["key", "hash"])
    return rows.join(named, same).select("key", "hash", _word_hashes(F.col("text")).alias("words"), "starts")


def _leaks(docs: DataFrame, benchmark: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY,
          radius: int = RADIUS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of :func:`leaks` with ``text_hash``."""
    items = _read(benchmark, "item_id", shingle).where(F.size("words") > 0)
    items = stored(items.distinct().withColumns({"w": F.size("words"), "no": F.xxhash64("key", "words")}), "items")
    k = F.least(F.col("w"), F.lit(shingle))
    lengths = [r[0] for r in items.select(k).distinct().collect()] or [shingle]
    anchors = items.select("no", "w", k.alias("k"), F.explode("shingles").alias("h")).distinct()
    if anchors.count() <= broadcast_rows:
        anchors = F.broadcast(anchors)

    # outer: an inner explode would add a filter that computes the shingles twice; the join drops NULL
    places = reduce(DataFrame.unionByName, [_read(docs, "doc_id", size, _text_hash().alias("hash")).select(
        "key", "hash", F.size("words").alias("length"), F.lit(size).alias("k"),
        F.posexplode_outer("shingles").alias("pos", "h")) for size in lengths])
    starts = stored(_starts(places.join(anchors, ["k", "h"]), shingle, similarity), "starts")

    own = ["key", "hash", "w", "start"]
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work
    laid = _texts_of(docs, starts, broadcast_rows).select("key", "hash", "words", F.explode("starts").alias("at"))
    begin, stop = F.greatest("start", F.lit(0)), F.least(F.col("start") + F.col("w"), F.size("words"))
    laid = laid.select("key", "hash", "at.w", "at.start", "words").select(*own, F.slice("words", begin + 1, stop - begin).alias("content"))
    windows = laid.repartition(tasks, "key", "hash", "start").select(*own, _shingles(F.col("content"), k).alias("shingles"))
    windows = stored(windows, "windows")
    prints = _fingerprints(windows, own).withColumn("b", F.explode(_blocks(F.col("fp"), radius)))
    indexed = _fingerprints(items, ["no", "w"]).select(
        "no", F.col("w").alias("iw"), F.col("fp").alias("ifp"),
        F.explode(_blocks(F.col("fp"), radius)).alias("ib"))
    met = prints.join(indexed, (F.col("w") == F.col("iw")) & (F.col("b") == F.col("ib"))).where(
        F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius)
    pairs = stored(met.select(*own, "no").distinct(), "pairs")

    # the k-th occurrence of a shingle as an element of its own: multisets compare as sets
    both = _join(_join(pairs, windows, own).withColumn("here", _occurrences("shingles")).drop("shingles"),
                 items.select("no", "w", "shingles"), ["no", "w"])
    both = both.withColumn("there", _occurrences("shingles"))
    like = both.withColumn("similarity", F.size(F.array_intersect("here", "there")) / F.size(F.array_union("here", "there")))
    best = like.where(F.col("similarity") >= similarity).groupBy("key", "hash", "no").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("before"), F.col("w"))).alias("best"))
    best = best.join(items.select("no", F.col("key").alias("item")), "no")
    return best.select(F.col("key").alias("doc_id"), F.col("hash").alias("text_hash"), F.col("item").alias("item_id"), (-F.col("best.before")).alias("start"),
                       F.col("best.w").alias("n_words"), F.col("best.similarity").alias("similarity"))


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``item_id``, ``start`` (word, from 0; below 0 if the item's
    beginning would stand before the document), ``n_words``, ``similarity``: for
    each document and item the most similar window, the first of equal ones.

    Texts without words (NULL, empty) match nothing.  An item of fewer than
    ``shingle`` words is one shingle: it matches wherever its words follow each
    other.
    A document is a row's id and text: different texts under one id, or under
    NULL, are documents of their own, and so are items.  Other columns are
    ignored."""
    return _leaks(docs, benchmark, **options).drop("text_hash")


@column_safe
def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold an item, all columns kept."""
    found = _leaks(docs, benchmark, **options).select(F.col("doc_id").alias("_leaked"), F.col("text_hash").alias("_hash"))
    found = stored(found.distinct(), "leaked")
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_leaked"]) & (_text_hash() == found["_hash"]), "left_anti")
