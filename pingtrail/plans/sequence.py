"""Ordered per-group work that stays balanced when one group is huge.

A plain ``Window.partitionBy(tag).orderBy(time)`` sends every row of a tag to
one task; with one tag holding a third of the data that task gets a third of
the data.  Here a group of more than ``chunk_rows`` rows is cut into time
chunks, which are windowed apart, and what crosses a boundary travels as a
*boundary row*:

* the groups to cut come from a count per hash slot of the keys (map-side
  partial aggregation over a fixed number of slots); a bitmap of the heavy
  slots marks their rows (a few small groups share a slot, harmlessly);
* one chunk width serves all groups that are cut, an eighth of what would hold
  ``chunk_rows`` rows of the densest slot if they were spread evenly over its
  time, so a chunk may be eight times as dense as the average and keep the bound;
* both are one scalar subquery, a struct of fixed size, over the key columns and the time;
* a table with one row per chunk (partial aggregation over the rows of cut
  groups only) holds what its neighbours need: the number of rows before it,
  the first row after it, the last time and event id before it.  These are added
  to the rows of the chunk, before the first or after the last, so the window
  meets them in its own order and no join is needed.

Rows of groups that are not cut pass one shuffle by key and one sort; if no
group is cut, the other branch reads nothing past its filter.  Every row passes
exactly one such window.

Nothing runs while a plan is being defined.  The plans read their input three
times (keys and times, cut groups, all rows), so pass a stage (``save_stage``/``load_stage``): a derived input would be computed once
per read.

A NULL key (e.g. a NULL tag id) forms one group, as in a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingtrail.functions.time import epoch_us

_G, _K, _US = "__grp", "__chunk", "__us"
#: Place among the rows of a chunk (-1: boundary row before, 0: a row, 1: boundary row after) and its weight in running sums.
_SIDE, _WEIGHT = "__side", "__weight"
#: Chunks of rows without a time: before all others (as NULLs sort), or after them.
_BEFORE, _AFTER = -(2**62), 2**62

#: Rows that one task windows of one group, about.
DEFAULT_CHUNK_ROWS = 2_000_000
#: Hash slots of the group counts (the bitmap has 8 KB), and chunks of the rows without a time of a cut group.
SLOTS, TIMELESS_CHUNKS = 1 << 16, 256


def _order_cols(order: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _cuts(df: DataFrame, keys: Sequence[str], time: Column, chunk_rows: int) -> Column:
    """A scalar: NULL if no group is cut, else ``bits`` (the bitmap of the slots to
    cut) and ``width`` (of a chunk in microseconds).  A slot is cut if it has more
    than ``chunk_rows`` rows and four times the average (where every slot is that
    full, more chunks would not spread the rows better)."""
    slot = f"pmod(xxhash64({_names(keys)}), {SLOTS}) AS slot" if keys else "0L AS slot"
    slots = df.select(F.expr(slot), time.alias("us")).groupBy("slot").agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("low"), F.max("us").alias("high"))
    heavy = slots.selectExpr(
        f"collect_list(if(n > {chunk_rows}, struct(slot, n, low, high), null)) AS heavy", f"sum(n) * 4 / {SLOTS} AS crowd")
    held = heavy.selectExpr("""transform(filter(heavy, x -> x.n > crowd), x -> struct(shiftright(x.slot, 6) AS word,
        shiftleft(1L, cast(x.slot % 64 AS int)) AS bit, coalesce((x.high - x.low) / x.n, 0) AS share)) AS held""")
    return held.selectExpr(f"""if(size(held) > 0, struct(
        transform(sequence(0L, {SLOTS // 64 - 1}L), w -> aggregate(filter(held, x -> x.word = w), 0L, (acc, x) -> acc | x.bit)) AS bits,
        greatest(floor(array_min(transform(held, x -> x.share)) * {chunk_rows / 8}), 1L) AS width), null) AS cuts""").scalar()


def _names(cols: Sequence[str]) -> str:
    return ", ".join(f"`{c}`" for c in cols)


def _with_chunks(df: DataFrame, keys: Sequence[str], time_col: str, chunk_rows: int,
                 timeless: str = str(_BEFORE)) -> tuple[DataFrame, DataFrame]:
    """``df`` with its group, its time in microseconds and its time chunk (NULL in a
    group that is not cut), and the rows of the cut groups.  ``timeless`` is the
    chunk (SQL) of rows without a time."""
    if chunk_rows < 1:
        raise ValueError("chunk_rows must be positive")
    time = epoch_us(time_col)
    slot = f"pmod(xxhash64({_names(keys)}), {SLOTS})" if keys else "0L"
    d = df.withColumns({_G: F.expr(f"struct({_names(keys) if keys else '0 AS all'})"), _US: time, "__cuts": _cuts(df, keys, time, chunk_rows)})
    cut = f"__cuts IS NOT NULL AND getbit(get(__cuts.bits, cast(shiftright({slot}, 6) AS int)), cast({slot} % 64 AS int)) = 1"
    chunk = f"CASE WHEN {cut} THEN coalesce({_US} - pmod({_US}, __cuts.width), {timeless}) END AS {_K}"
    d = d.selectExpr(*[f"`{c}`" for c in df.columns], _G, _US, chunk)
    return d, d.where(f"{_K} IS NOT NULL")


def _with_boundaries(d: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows (weight 1) and the boundary rows of their chunks."""
    rows = d.selectExpr("*", f"0 AS {_SIDE}", f"1L AS {_WEIGHT}")
    return rows.unionByName(edges, allowMissingColumns=True)


def _running(w, value=None) -> Column:
    return F.sum(F.col(_WEIGHT) if value is None else value).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence, *, out: str = "row_number",
                chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """``row_number() over (partition by keys order by order)``; ``order[0]`` is a
    timestamp column used for chunking (later order columns break ties).  Every
    group is windowed in chunks of about ``chunk_rows`` rows at most."""
    d, cut = _with_chunks(df, keys, order[0], chunk_rows)
    sizes = cut.groupBy(*keys, _K).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(_K).rowsBetween(Window.unboundedPreceding, -1)
    edges = sizes.select(*keys, _K, F.lit(-1).alias(_SIDE), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(_WEIGHT))
    w = Window.partitionBy(*keys, _K).orderBy(_SIDE, *_order_cols(order))
    both = _with_boundaries(d.drop(_G, _US), edges).withColumn(out, _running(w))
    return both.where(F.col(_SIDE) == 0).drop(_K, _SIDE, _WEIGHT)


def lead_columns(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: dict[str, str], *,
                 row_number: str | None = None, chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Add ``lead(src)`` per group for each ``{out_name: src}`` in ``cols``
    (NULL on a group's last row), and optionally a ``row_number`` column.
    ``order`` are column names; ``order[0]`` is the timestamp used for chunks.
    Every group is windowed in chunks of about ``chunk_rows`` rows at most."""
    d, cut = _with_chunks(df, keys, order[0], chunk_rows)
    srcs = list(dict.fromkeys(cols.values()))
    kept = [(s, i) for i, s in enumerate(srcs) if s not in keys]
    group = _names([*keys, _K])
    first = ", ".join([*[f"`{c}` AS o{i}" for i, c in enumerate(order)], *[f"`{s}` AS s{i}" for i, s in enumerate(srcs)]])
    sizes = cut.groupBy(*keys, _K).agg(F.expr("count(1) AS __n"), F.expr(f"min(struct({first})) AS __first"))
    chunks = f"(PARTITION BY {_names(keys) or '0'} ORDER BY {_K}"
    sizes = sizes.selectExpr(*[f"`{c}`" for c in (*keys, _K)], f"lead(__first) OVER {chunks}) AS __next",
                             f"coalesce(sum(__n) OVER {chunks} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS __off")
    # the rows before the chunk count before its first row; the first row after it follows its last
    none = "".join(f", cast(null AS {df.schema[s].dataType.simpleString()}) AS `{s}`" for s, _ in kept)
    ahead = "".join(f", __next.s{i} AS `{s}`" for s, i in kept)
    edges = sizes.selectExpr(*[f"`{c}`" for c in (*keys, _K)], f"inline(array(struct(-1 AS {_SIDE}, __off AS {_WEIGHT}{none}), "
                                                                f"struct(1 AS {_SIDE}, 0L AS {_WEIGHT}{ahead})))")
    w = f"(PARTITION BY {group} ORDER BY {_SIDE}, {_names(order)}"
    new = [f"lead(`{s}`) OVER {w}) AS __lead_{i}" for i, s in enumerate(srcs)]
    if row_number:
        new.append(f"sum({_WEIGHT}) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __number")
    both = _with_boundaries(d.drop(_G, _US), edges).selectExpr("*", *new).where(f"{_SIDE} = 0")
    named = [f"__lead_{srcs.index(src)} AS `{name}`" for name, src in cols.items()]
    return both.selectExpr(*[f"`{c}`" for c in df.columns if c not in cols], *named, *([f"__number AS `{row_number}`"] if row_number else []))


def number_events(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_gap_secs: float, *, first_gap: str = "zero",
                  chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """The rows of :func:`sessionize` with ``__us`` (time), ``__gap`` (microseconds),
    ``__new`` (starts an event), ``__eid`` (its id), ``__alone`` (certainly the only row
    of its event) and ``__chunk``."""
    if first_gap not in ("zero", "null"):
        raise ValueError("first_gap must be 'zero' or 'null'")
    limit = int(round(max_gap_secs * 1_000_000))  # microseconds
    others = [c for c in df.columns if c not in keys]
    spread = f"pmod(xxhash64({_names(others)}), {TIMELESS_CHUNKS})" if others else "0"
    d, cut = _with_chunks(df, keys, order[0], chunk_rows, f"{_AFTER} + {spread}")
    # two rows at most the limit apart are in one bucket of that width or in consecutive ones, so a chunk's
    # events can be counted from the first and last time of its buckets
    key = [f"`{c}`" for c in (*keys, _K)]
    group, mine = _names([*keys, _K]), _names(keys) or "0"
    b = cut.selectExpr(*key, _US, f"coalesce({_US} - pmod({_US}, {max(limit, 1)}), {_AFTER}) AS __bucket").groupBy(*keys, _K, "__bucket").agg(
        F.expr(f"min({_US}) AS __lo"), F.expr(f"max({_US}) AS __hi"), F.expr("count(1) AS __n"))
    b = b.selectExpr(*key, "__lo", "__hi", f"""CASE WHEN __lo IS NULL THEN __n
        WHEN __lo - lag(__hi) OVER (PARTITION BY {group} ORDER BY __bucket) > {limit} THEN 1 ELSE 0 END AS __starts""")
    c = b.groupBy(*keys, _K).agg(F.expr("min(__lo) AS __lo"), F.expr("max(__hi) AS __hi"), F.expr("sum(__starts) AS __starts"))
    past = f"OVER (PARTITION BY {mine} ORDER BY {_K} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    c = c.selectExpr(*key, "__lo", "__starts", f"max(__hi) {past} AS __last", f"count(1) {past} AS __any")
    c = c.selectExpr(*key, "__last", "__any", f"""__starts + CASE WHEN __lo IS NULL THEN 0 WHEN __any = 0 THEN {0 if first_gap == 'zero' else 1}
        WHEN __last IS NULL OR __lo - __last > {limit} THEN 1 ELSE 0 END AS __starts""")
    edges = c.selectExpr(*key, f"-1 AS {_SIDE}", f"__last AS {_US}", "__any", f"sum(__starts) {past} AS {_WEIGHT}").where("__any > 0").drop("__any")

    # rows without a time come last, at a time of their own: so a neighbour without a time is told from none
    w = f"OVER (PARTITION BY {group} ORDER BY " + ", ".join([_SIDE, "__t", *[f"`{c}`" for c in order[1:]]])
    rows = _with_boundaries(d.drop(_G), edges).selectExpr("*", f"coalesce({_US}, {_AFTER}) AS __t")
    rows = rows.selectExpr("*", f"lag(__t) {w}) AS __back", f"lead(__t) {w}) AS __ahead")
    gap = f"CASE WHEN {_US} IS NOT NULL THEN {'coalesce(__t - __back, 0L)' if first_gap == 'zero' else '__t - __back'} END"
    rows = rows.selectExpr("*", f"{gap} AS __gap")
    rows = rows.selectExpr("*", f"CASE WHEN __gap <= {limit} THEN 0 ELSE 1 END AS __new")
    last = f"coalesce(__ahead - __t > {limit} OR __ahead = {_AFTER}, {_K} IS NULL)"
    rows = rows.selectExpr(
        *[f"`{c}`" for c in df.columns], _US, _K, _SIDE, "__gap", "__new", f"(__new = 1 OR __back IS NULL) AND {last} AS __alone",
        f"sum(CASE WHEN {_SIDE} = 0 THEN __new ELSE {_WEIGHT} END) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS __eid")
    return rows.where(f"{_SIDE} = 0").drop(_SIDE)


def sessionize(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_gap_secs: float, *,
               first_gap: str = "zero", gap_col: str = "gap_secs", flag_col: str = "new_event",
               id_col: str = "event_id", chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Per-row gap-and-island numbering per group, ordered by ``order``.

    ``gap_col`` = seconds since the previous row of the group; a row starts a
    new event when that gap is strictly greater than ``max_gap_secs``, or
    unknown.  ``first_gap='zero'``: the first row's gap is 0, so ids start at 0;
    ``first_gap='null'``: the first row's gap is NULL and counts as a new
    event, so ids start at 1.  ``event_id`` is the running count of starts.
    Rows without a time come last in their group, each an event of its own.
    """
    rows = number_events(df, keys, order, max_gap_secs, first_gap=first_gap, chunk_rows=chunk_rows)
    return rows.withColumns({
        gap_col: F.col("__gap") / F.lit(1_000_000.0),
        flag_col: F.col("__new").cast("int"),
        id_col: F.col("__eid"),
    }).drop(_K, _US, "__gap", "__new", "__eid", "__alone")
