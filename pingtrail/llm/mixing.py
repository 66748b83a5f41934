"""Mixing sources to target weights by weighted fair queueing.

A source's weight follows its place in code-point order.  The sources share a
budget of words by weight; one that would get more than ``repeats`` times its
words stops there, and the excess is shared again by weight.

Each source queues its documents in a shuffled order (by hash), ``repeats``
times, in packets of at most ``packet`` words.  A packet's virtual finish time
is the number of the source's words up to its end, divided by the source's
target.  The mix is all packets in the order of their finish times, truncated
where their words reach the budget.  A source is off its target by less than
the packets that are in flight at the cut.

Prefix sums need no ordered pass in one task: both orders (a source's queue,
the mix) are cut into ranges, of the hash and of the virtual time, each range
is summed by a window of its own, and a table with one row per range carries
the sums.  A hash spreads a source evenly over its ranges, and so over the
virtual time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingtrail.llm.shared import stored

#: Weights of the sources in order, repeating; the budget as a share of all words; how often a document may be used.
WEIGHTS, BUDGET, REPEATS = (5, 2, 1), 1.5, 2
#: Most words that queue as one.
PACKET = 1000
#: Rows that a range holds, about.
RANGE_ROWS = 50_000
#: Copies of a row that one task lists.
COPIES = 10_000
_WORD, _SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words between ASCII white space (no list of them is made)."""
    return F.length(F.regexp_replace(F.regexp_replace(text, _WORD, "x"), _SPACE, "")).cast("long")


def documents(docs: DataFrame) -> DataFrame:
    """A row per document: ``doc_id``, ``source``, ``text_hash`` (MD5 in hex),
    ``copy`` (0, 1, ... among equal rows) and ``size`` (words; NULL text: 0)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.md5(text.cast("binary")).alias("text_hash"), n_words(text).alias("size"))
    keys = ["doc_id", "source", "text_hash", "size"]
    # equal rows are counted, then listed by several tasks
    runs = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    runs = runs.select(*keys, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("at"))
    runs = runs.repartition("doc_id", "text_hash", "at")
    last = F.least(F.col("at") + COPIES, F.col("n")) - 1
    return runs.select(*keys, F.explode(F.sequence(F.col("at"), last)).alias("copy"))


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """A row per source of ``rows`` (``source``, ``size``): ``source``, ``number``
    (from 0, by code point, NULL last), ``source_size`` and ``target``.  The
    windows run over the sources, not the documents."""
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("number", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    s = s.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.col("number") % len(weights)).cast("long"))
    s = s.withColumn("most", F.col("source_size") * repeats)
    # those that reach their most first come first
    s = s.withColumn("level", F.col("most") / F.col("weight"))
    by = Window.orderBy("level", "number")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumns({
        "left": F.sum("source_size").over(every) * F.lit(float(budget)) - F.coalesce(F.sum("most").over(before), F.lit(0)),
        "sharing": F.sum("weight").over(after)})
    # once a source gets its share in full, all later ones do, out of the same rest
    s = s.withColumn("open", F.col("most") > F.col("weight") * F.col("left") / F.col("sharing"))
    first = F.min(F.when(F.col("open"), F.struct("level", "number", "left", "sharing"))).over(every)
    s = s.withColumn("first", first)
    share = F.col("weight") * F.col("first.left") / F.col("first.sharing")
    full = F.col("first").isNull() | (F.struct("level", "number") < F.struct("first.level", "first.number"))
    return s.select("source", "number", "source_size", F.when(full, F.col("most").cast("double")).otherwise(share).alias("target"))


def _running(rows: DataFrame, group: Sequence[str], piece: str, order: Sequence[str], words: str, out: str) -> DataFrame:
    """``out``: the sum of ``words`` before each row of its ``group``, in the order of
    (``piece``, ``order``); a window per (``group``, ``piece``), and one over the pieces' sums."""
    keys = [*group, piece]
    sums = rows.groupBy(*keys).agg(F.sum(words).alias("__sum"))
    over = Window.partitionBy(*group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__base"))
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__own", F.coalesce(F.sum(words).over(local), F.lit(0)))
    return rows.join(sums, keys).withColumn(out, F.col("__base") + F.col("__own")).drop("__base", "__own")


def queue(rows: DataFrame, sources: DataFrame, pieces: int, repeats: int = REPEATS, packet: int = PACKET) -> DataFrame:
    """The packets of all sources: ``doc_id``, ``text_hash``, ``copy``, ``size``,
    ``number``, ``source_size``, ``target``, ``turn`` (which use of the document),
    ``first`` (its first word), ``words`` and ``finish`` (virtual)."""
    sized = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop("source")
    turns = sized.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    name = F.concat_ws("/", "turn", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy", "text_hash")
    turns = turns.withColumn("place", F.substring(F.md5(name.cast("binary")), 1, 16))
    # the first 8 hex digits as a number, cut into ranges
    turns = turns.withColumn("piece", F.col("turn") * pieces + F.floor(
        F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.lit(pieces) / F.lit(float(1 << 32))))
    turns = _running(turns, ["number"], "piece", ["place", "doc_id", "text_hash", "copy"], "size", "start")
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(packet).cast("long")))
    cut = turns.withColumn("first", first).withColumn("words", F.least(F.lit(packet), F.col("size") - F.col("first")))
    end = F.col("start") + F.col("first") + F.col("words")
    return cut.withColumn("finish", F.coalesce(F.try_divide(end, F.col("target")), F.lit(0.0))).drop("piece", "start")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS,
        packet: int = PACKET, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The packets of :func:`queue` for ``docs`` (``doc_id``, ``source``, ``text``)
    with ``position`` (words of the mix before it) and ``taken`` (its words in
    the mix: all of them, some where the budget ends, else 0).

    A NULL text is an empty one; NULL ids and sources are ordinary values; equal
    rows are documents of their own; ties of the finish time go by source, turn
    and hash; an empty table gives none."""
    rows = stored(documents(docs), "mix-documents")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    pieces = max(1, -(-n // range_rows))
    sources = stored(targets(rows, weights, budget, repeats), "mix-sources")
    packets = queue(rows, sources, pieces, repeats, packet)
    # ranges of virtual time; beyond 2 they widen with it, as few sources are left there
    time = F.col("finish")
    late = 2 * pieces + F.floor(F.log(time / 2) * pieces)
    packets = packets.withColumn("piece", F.when(time < 2, F.floor(time * pieces)).otherwise(late))
    placed = _running(packets, [], "piece", ["finish", "number", "turn", "place", "doc_id", "text_hash", "copy", "first"], "words", "position")
    left = F.lit(int(budget * total)) - F.col("position")
    return placed.withColumn("taken", F.greatest(F.least(F.col("words"), left), F.lit(0)).cast("long")).drop("piece")


def shares(mixed: DataFrame) -> DataFrame:
    """A row per document of a :func:`mix`: ``doc_id``, ``size``, ``source_size``,
    ``target`` (both of its source) and ``taken`` (its words in the mix, repeats counted)."""
    keys = ["doc_id", "number", "text_hash", "copy", "size", "source_size", "target"]
    taken = mixed.groupBy(*keys).agg(F.sum("taken").alias("taken"))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself, in ranges of ``position``: ``position``, ``doc_id``, ``turn``,
    ``words`` and ``text`` (the packet's words with a space between)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("text_hash"), text.alias("text"))
    same = same.dropDuplicates(["doc_id", "text_hash"])
    used = mixed.where("taken > 0").alias("m")
    both = used.join(same.alias("t"), F.col("m.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("m.text_hash") == F.col("t.text_hash")))
    part = F.slice(F.regexp_extract_all("t.text", F.lit(_WORD), 0), (F.col("m.first") + 1).cast("int"), F.col("m.taken").cast("int"))
    out = both.select("m.position", "m.doc_id", "m.turn", F.col("m.taken").alias("words"), F.array_join(part, " ").alias("text"))
    return out.repartitionByRange("position").sortWithinPartitions("position")
