"""DuckDB SQL of the training-data queries that SQL can express: plain windows,
all pairs of anchors and rows, and squared differences instead of products."""

from __future__ import annotations

from pingtrail.llm import mixing, vector_codes

_WHOLE = """embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

HARD_NEGATIVES = f"""WITH k AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_WHOLE}),
s AS (SELECT a.n AS an, a.vec_id AS anchor_id, a.label AS own, b.n AS bn, b.vec_id, b.label,
             CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM k a JOIN k b ON a.n <> b.n WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY an ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.an, p.bn ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.an = s.an AND s.label <> p.own
WHERE 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.an, p.bn ORDER BY s.score DESC, s.vec_id) <= 10"""


def vector_codes_rounds(rounds: int) -> str:
    """CTEs ``b<i>`` (the codebooks) and ``c<i>`` (the nearest entry of each part)."""
    out = []
    for r in range(rounds + 1):
        if r:
            out.append(f"""t{r} AS (SELECT part, entry, pos, sum(x) AS s, count(*) AS m FROM parts JOIN c{r - 1} USING (n, part) GROUP BY ALL),
b{r} AS (SELECT part, entry, pos, CASE WHEN m IS NULL THEN x ELSE CAST((s - ((s % m) + m) % m) // m AS BIGINT) END AS x
      FROM b{r - 1} LEFT JOIN t{r} USING (part, entry, pos))""")
        out.append(f"""c{r} AS (SELECT n, part, min(d * 1000 + entry) % 1000 AS entry, min(d * 1000 + entry) // 1000 AS d
      FROM (SELECT p.n, p.part, b.entry, CAST(sum((p.x - b.x) * (p.x - b.x)) AS BIGINT) AS d
            FROM parts p JOIN b{r} b ON p.part = b.part AND p.pos = b.pos GROUP BY ALL) GROUP BY ALL)""")
    return ",\n".join(out)


def vector_codes_sql(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    return f"""WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))) AS n, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE {_WHOLE}),
parts AS (SELECT n, (i - 1) // (len(v) // {parts}) AS part, (i - 1) % (len(v) // {parts}) AS pos, v[i] AS x
          FROM (SELECT n, v, unnest(range(1, len(v) + 1)) AS i FROM k)),
b0 AS (SELECT part, n - 1 AS entry, pos, x FROM parts WHERE n <= {entries}),
{vector_codes_rounds(rounds)},
e AS (SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM c{rounds} GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
FROM e JOIN k USING (n)"""


def mixing_sql(weights=mixing.WEIGHTS, budget=mixing.BUDGET, repeats=mixing.REPEATS, packet=mixing.PACKET) -> str:
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    word = r"'[^\x20\x09-\x0D]+'"
    return f"""WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS h, len(regexp_extract_all(coalesce(text, ''), {word})) AS size FROM documents),
docs AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, h) - 1 AS copy FROM d),
s0 AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
s1 AS (SELECT *, CASE number % {len(weights)} {cases} END AS w, source_size * {repeats} AS most FROM s0),
s2 AS (SELECT *, CAST(most AS DOUBLE) / w AS level,
              CAST(sum(source_size) OVER () AS DOUBLE) * CAST({budget} AS DOUBLE)
              - CAST(coalesce(sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / w, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rest,
              sum(w) OVER (ORDER BY CAST(most AS DOUBLE) / w, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing FROM s1),
f AS (SELECT * FROM s2 WHERE most > w * rest / CAST(sharing AS DOUBLE) ORDER BY level, number LIMIT 1),
s AS (SELECT s2.source, s2.number, CAST(s2.source_size AS BIGINT) AS source_size,
             CASE WHEN f.level IS NULL OR s2.level < f.level OR (s2.level = f.level AND s2.number < f.number) THEN CAST(s2.most AS DOUBLE)
                  ELSE s2.w * f.rest / CAST(f.sharing AS DOUBLE) END AS target
      FROM s2 LEFT JOIN f ON true),
turns AS (SELECT docs.doc_id, docs.h, docs.size, docs.copy, s.*, t.turn,
                 substr(md5(concat_ws('/', t.turn, coalesce(CAST(doc_id AS VARCHAR), ''), docs.copy, docs.h)), 1, 16) AS place
          FROM docs JOIN s ON docs.source IS NOT DISTINCT FROM s.source, (SELECT unnest(range({repeats})) AS turn) t),
queued AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY number ORDER BY turn, place, doc_id NULLS FIRST, h, copy
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM turns),
cut AS (SELECT *, least({packet}, size - first) AS words
        FROM (SELECT *, unnest(range(0, greatest(size, 1), {packet})) AS first FROM queued)),
timed AS (SELECT *, CASE WHEN target > 0 THEN CAST(start + first + words AS DOUBLE) / target ELSE 0 END AS finish FROM cut),
placed AS (SELECT *, coalesce(sum(words) OVER (ORDER BY finish, number, turn, place, doc_id NULLS FIRST, h, copy, first
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position FROM timed)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(sum(greatest(least(words, CAST(floor((SELECT sum(size) FROM d) * CAST({budget} AS DOUBLE)) AS BIGINT) - position), 0)) AS BIGINT) AS taken
FROM placed GROUP BY doc_id, number, h, copy, size, source_size, target"""
