"""DuckDB SQL for every registered query (the correctness oracle).

The SQL is written independently of the Spark plans: plain windows over whole
groups (no chunking), literal CASE lookups instead of the expanded schedule,
an unrolled Newton iteration instead of Spark ML.  Views ``events``,
``customer``, ``nation``, ``region``, ``lineitem`` are provided by the caller.
"""

from __future__ import annotations

from pingtrail import catalog as C
from pingtrail.functions.time import MONTH_ABBREVIATIONS
from pingtrail.sources import tables as TB

US_DAY = 86_400_000_000
US_HOUR = 3_600_000_000
MONTHS = "['" + "','".join(MONTH_ABBREVIATIONS) + "']"


def _substrate_whens() -> str:
    return " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(TB.SUBSTRATES))


def _stations() -> str:
    return f"""stations AS (
  SELECT n_name AS station_name,
         CAST({TB.STATION_LAT0} AS DOUBLE) - CAST(n_nationkey AS DOUBLE) / 100 AS latitude,
         CAST({TB.STATION_LON0} AS DOUBLE) - CAST(n_nationkey AS DOUBLE) / 100 AS longitude,
         r_name AS protection,
         CASE n_nationkey % {len(TB.SUBSTRATES)} {_substrate_whens()} END AS substrate
  FROM nation JOIN region ON n_regionkey = r_regionkey),
tagmeta AS (
  SELECT CASE WHEN c_custkey = {TB.SYNC_TAG_KEY} THEN '{TB.SYNC_TRANSMITTER}'
              ELSE '{TB.TRANSMITTER_PREFIX}' || CAST(10000 + c_custkey AS VARCHAR) END AS transmitter,
         'CAP_' || CAST(c_nationkey % 3 AS VARCHAR) AS sitio_captura,
         'LIB_' || CAST(c_nationkey % 4 AS VARCHAR) AS sitio_liberacion
  FROM customer)"""


def _raw_events(s: int = TB.N_STATIONS) -> str:
    return f"""raw AS (
  SELECT event_id AS row_id, date_trunc('minute', ts) AS datetime,
         CASE WHEN user_id = {TB.SYNC_TAG_KEY} THEN '{TB.SYNC_TRANSMITTER}'
              ELSE '{TB.TRANSMITTER_PREFIX}' || CAST(10000 + user_id AS VARCHAR) END AS transmitter,
         event_type AS receiver,
         'NATION_' || CAST(CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % {s} AS VARCHAR) AS station_name,
         c_mktsegment AS scientific_name
  FROM events JOIN customer ON c_custkey = user_id)"""


def _raw_lineitem() -> str:
    return f"""raw AS (
  SELECT l_orderkey * 8 + l_linenumber AS row_id, CAST(l_shipdate AS TIMESTAMP) AS datetime,
         '{TB.TRANSMITTER_PREFIX}' || CAST(10000 + l_suppkey AS VARCHAR) AS transmitter,
         'RX_' || CAST(l_linenumber AS VARCHAR) AS receiver,
         'NATION_' || CAST(l_linenumber AS VARCHAR) AS station_name,
         'SPECIES_' || CAST(l_suppkey % 4 AS VARCHAR) AS scientific_name
  FROM lineitem)"""


_TIDY = """joined AS (
  SELECT r.row_id, r.datetime, r.transmitter, r.receiver, r.station_name, r.scientific_name,
         s.latitude, s.longitude, s.protection, s.substrate, g.sitio_captura, g.sitio_liberacion
  FROM raw r JOIN stations s ON r.station_name = s.station_name
             JOIN tagmeta g ON r.transmitter = g.transmitter
  WHERE r.datetime IS NOT NULL AND r.transmitter IS NOT NULL AND r.receiver IS NOT NULL
    AND r.station_name IS NOT NULL AND r.scientific_name IS NOT NULL
    AND s.latitude IS NOT NULL AND NOT isnan(s.latitude) AND s.longitude IS NOT NULL AND NOT isnan(s.longitude)
    AND s.protection IS NOT NULL AND s.substrate IS NOT NULL
    AND g.sitio_captura IS NOT NULL AND g.sitio_liberacion IS NOT NULL),
tidy AS (
  SELECT datetime, transmitter, receiver, station_name, scientific_name, latitude, longitude, protection,
         substrate, sitio_captura, sitio_liberacion,
         CAST(hour(datetime) AS INTEGER) AS hour, CAST(minute(datetime) AS INTEGER) AS minute,
         NULLIF(regexp_extract(transmitter, '[0-9]{4,5}$'), '') AS tag_id
  FROM joined
  QUALIFY row_number() OVER (PARTITION BY transmitter, datetime, station_name ORDER BY row_id) = 1)"""


def tidy_ctes() -> str:
    return f"WITH {_stations()},\n{_raw_events()},\n{_TIDY}"


def tidy_multi_year_ctes() -> str:
    return f"WITH {_stations()},\n{_raw_lineitem()},\n{_TIDY}"


def _residency(gap_secs: float, min_det: int = 2, min_days: float = C.MIN_DAYS) -> str:
    gap_us = int(gap_secs * 1_000_000)
    return f""",
r_us AS (SELECT *, epoch_us(datetime) AS us FROM tidy),
r_gap AS (SELECT *, COALESCE(us - lag(us) OVER (PARTITION BY tag_id, station_name ORDER BY datetime, transmitter), 0) AS gap_us
          FROM r_us),
r_ids AS (SELECT *, CAST(sum(CASE WHEN gap_us > {gap_us} THEN 1 ELSE 0 END) OVER (
              PARTITION BY tag_id, station_name ORDER BY datetime, transmitter
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS event_id
          FROM r_gap),
r_lit AS (SELECT tag_id, station_name, event_id,
                 min(datetime) OVER e AS start_datetime, max(datetime) OVER e AS end_datetime,
                 count(*) OVER e AS n_detections,
                 CAST(((epoch_us(max(datetime) OVER e) - epoch_us(min(datetime) OVER e)) * 100 + {US_DAY // 2}) // {US_DAY} AS DOUBLE)
                   / CAST(100 AS DOUBLE) AS duration_days,
                 scientific_name, protection, substrate
          FROM r_ids WINDOW e AS (PARTITION BY tag_id, station_name, event_id)),
r_kept AS (SELECT * FROM r_lit WHERE n_detections >= {min_det} AND duration_days >= CAST({min_days} AS DOUBLE)),
r_events AS (SELECT DISTINCT * FROM r_kept)"""


def _days() -> str:
    return tidy_multi_year_ctes() + _residency(C.MULTI_YEAR_GAP_SECS) + f""",
days AS (SELECT tag_id, station_name, scientific_name, protection, CAST(d AS DATE) AS date,
                CAST(month(d) AS INTEGER) AS month, CAST(year(d) AS INTEGER) AS year,
                {MONTHS}[month(d)] AS month_label
         FROM r_events, unnest(generate_series(CAST(start_datetime AS DATE), CAST(end_datetime AS DATE), INTERVAL 1 DAY)) AS t(d))"""


def _monthly(years: str) -> str:
    if years == "distinct":
        ny = """ny AS (SELECT tag_id, station_name, month, count(DISTINCT year) AS n_years FROM md GROUP BY ALL),
monthly AS (SELECT md.*, ny.n_years, md.n_days_present / ny.n_years AS days_per_year, {m}[md.month] AS month_label
            FROM md JOIN ny ON md.tag_id IS NOT DISTINCT FROM ny.tag_id AND md.station_name = ny.station_name
                           AND md.month = ny.month)""".format(m=MONTHS)
    else:
        ny = """monthly AS (SELECT *, n_days_present / n_years AS days_per_year, {m}[month] AS month_label
            FROM (SELECT *, count(*) OVER (PARTITION BY tag_id, station_name, month) AS n_years FROM md))""".format(m=MONTHS)
    return _days() + f""",
md AS (SELECT tag_id, station_name, protection, scientific_name, month, year, count(DISTINCT date) AS n_days_present
       FROM days GROUP BY ALL),
{ny}"""


def _mean(years: str, keys: list[str], se: str, places: int = C.STAT_PLACES) -> str:
    k = ", ".join(keys)
    denom = "n_tags" if se == "tags" else "n_rows"
    label = f", {MONTHS}[month] AS month_label" if "month" in keys else ""
    return _monthly(years) + f""",
agg AS (SELECT {k}, avg(days_per_year) AS m, stddev_samp(days_per_year) AS sd,
               CAST(count(DISTINCT tag_id) + max(CASE WHEN tag_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_tags,
               count(*) AS n_rows
        FROM monthly GROUP BY {k})
SELECT {k}, round(m, {places}) AS mean_days_present, round(sd, {places}) AS sd_days_present, n_tags,
       round(sd / sqrt({denom}), {places}) AS se_days_present,
       round(m - sd, {places}) AS lower, round(m + sd, {places}) AS upper{label}
FROM agg"""


def _mean_summary(places: int = C.STAT_PLACES) -> str:
    k = ", ".join(C.STATION_KEYS)
    return _monthly("distinct") + f""",
agg AS (SELECT {k}, avg(days_per_year) AS m FROM monthly GROUP BY {k})
SELECT round(min(m), {places}) AS "min", round(quantile_cont(m, 0.25), {places}) AS q1,
       round(quantile_cont(m, 0.5), {places}) AS median, round(avg(m), {places}) AS mean,
       round(quantile_cont(m, 0.75), {places}) AS q3, round(max(m), {places}) AS "max"
FROM agg WHERE m IS NOT NULL AND NOT isnan(m)"""


def _six_number_sql(ctes: str, source: str) -> str:
    return ctes + f""",
u AS (SELECT epoch_us(datetime) AS us FROM {source} WHERE datetime IS NOT NULL)
SELECT make_timestamp(min(us)) AS "min",
       make_timestamp(CAST(floor(quantile_cont(CAST(us AS DOUBLE), 0.25)) AS BIGINT)) AS q1,
       make_timestamp(CAST(floor(quantile_cont(CAST(us AS DOUBLE), 0.5)) AS BIGINT)) AS median,
       make_timestamp(CAST(sum(CAST(us AS HUGEINT)) // count(*) AS BIGINT)) AS mean,
       make_timestamp(CAST(floor(quantile_cont(CAST(us AS DOUBLE), 0.75)) AS BIGINT)) AS q3,
       make_timestamp(max(us)) AS "max"
FROM u"""


def _hourly(ctes: str | None = None, min_hours: float = C.MIN_HOURS, min_per_hour: int = C.MIN_PER_HOUR) -> str:
    return (ctes or tidy_ctes()) + f""",
h_us AS (SELECT *, epoch_us(datetime) AS us FROM tidy),
h_gap AS (SELECT *, us - lag(us) OVER (PARTITION BY tag_id, protection ORDER BY datetime, station_name, transmitter) AS gap_us
          FROM h_us),
h_ids AS (SELECT * EXCLUDE (us, gap_us),
                 CAST(gap_us AS DOUBLE) / CAST(1000000 AS DOUBLE) AS gap_secs,
                 CAST(CASE WHEN gap_us IS NULL OR gap_us > {US_HOUR} THEN 1 ELSE 0 END AS INTEGER) AS new_event,
                 CAST(sum(CASE WHEN gap_us IS NULL OR gap_us > {US_HOUR} THEN 1 ELSE 0 END) OVER (
                     PARTITION BY tag_id, protection ORDER BY datetime, station_name, transmitter
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS event_id
          FROM h_gap),
bins AS (SELECT tag_id, scientific_name, protection, event_id, date_trunc('hour', datetime) AS hour_bin,
                count(*) AS dets_in_hour, min(datetime) AS hour_start, max(datetime) AS hour_end
         FROM h_ids GROUP BY ALL),
roll AS (SELECT tag_id, scientific_name, protection, event_id, min(hour_start) AS start_datetime,
                max(hour_end) AS end_datetime, CAST(sum(dets_in_hour) AS BIGINT) AS n_detections,
                count(*) AS hours_covered, min(dets_in_hour) AS min_dets_per_hour,
                CAST(epoch_us(max(hour_end)) - epoch_us(min(hour_start)) AS DOUBLE) / CAST({US_HOUR} AS DOUBLE) AS duration_hours
         FROM bins GROUP BY ALL),
good AS (SELECT * FROM roll WHERE duration_hours >= {min_hours} AND min_dets_per_hour >= {min_per_hour}),
rh AS (SELECT tag_id, scientific_name, protection, event_id, hour_bin, CAST(hour(hour_bin) AS INTEGER) AS hour_of_day,
              dets_in_hour FROM bins WHERE dets_in_hour >= {min_per_hour})"""


def _strict() -> str:
    """The hourly CTEs with one tag per species and the two-per-hour rule."""
    return _hourly(tidy_ctes().replace("\ntidy AS (", "\ntidy_tags AS (") + """,
tidy AS (SELECT * REPLACE (scientific_name AS tag_id) FROM tidy_tags)""", C.STRICT_HOURS, C.STRICT_PER_HOUR)


def _movement() -> str:
    return tidy_ctes() + """,
mb_in AS (SELECT * EXCLUDE (minute, hour, receiver) FROM tidy WHERE tag_id IS NOT NULL),
mb AS (SELECT * EXCLUDE (transmitter),
              lead(station_name) OVER w AS next_location, lead(datetime) OVER w AS next_time,
              lead(station_name) OVER w AS next_station_name, lead(latitude) OVER w AS next_latitude,
              lead(longitude) OVER w AS next_longitude, CAST(row_number() OVER w AS BIGINT) AS movement_id
       FROM mb_in WINDOW w AS (PARTITION BY tag_id ORDER BY datetime, station_name, transmitter)),
legs AS (SELECT tag_id, datetime, station_name, latitude, longitude, 'departure' AS movement, movement_id FROM mb
         UNION ALL
         SELECT tag_id, next_time, next_station_name, next_latitude, next_longitude, 'arrival', movement_id FROM mb)"""


def _range() -> str:
    whens = " ".join(
        f"WHEN hour_time >= TIMESTAMP '{a}' AND hour_time <= TIMESTAMP '{b}' THEN CAST({e} AS DOUBLE)"
        for a, b, e in TB.RANGE_SCHEDULE)
    return f"""WITH rh AS (
  SELECT date_trunc('hour', ts) AS hour_time, event_type AS receiver, '{TB.RANGE_PREFIX}' || CAST(user_id AS VARCHAR) AS transmitter,
         CAST(floor(value / 20) * 20 AS DOUBLE) AS distance, count(*) AS n_det
  FROM events GROUP BY ALL),
rx AS (SELECT *, CASE {whens} END AS detec_esperadas FROM rh),
rates AS (SELECT *, n_det / detec_esperadas AS tasa_detec FROM rx
          WHERE detec_esperadas IS NOT NULL AND detec_esperadas > 0 AND n_det <= detec_esperadas),
bd AS (SELECT distance, CAST(sum(n_det) AS BIGINT) AS total_detections, sum(detec_esperadas) AS total_expected,
              CAST(sum(n_det) AS DOUBLE) / sum(detec_esperadas) AS tasa_detec
       FROM rates GROUP BY distance
       HAVING sum(detec_esperadas) > 0 AND sum(n_det) <= sum(detec_esperadas))"""


def _range_windows(hour: str, extra: str, at: str, windows: list) -> str:
    """Rates against windows by a range join; of several windows the first wins."""
    rows = ", ".join(f"({i}, {a}, {b}, CAST({e} AS DOUBLE))" for i, (a, b, e) in enumerate(windows))
    return f"""WITH rh AS (
  SELECT {extra}{hour} AS hour_time, event_type AS receiver, '{TB.RANGE_PREFIX}' || CAST(user_id AS VARCHAR) AS transmitter,
         CAST(floor(value / 20) * 20 AS DOUBLE) AS distance, count(*) AS n_det
  FROM events GROUP BY ALL),
win AS (SELECT * FROM (VALUES {rows}) AS w(p, a, b, e)),
rx AS (SELECT rh.*, arg_min(win.e, win.p) AS detec_esperadas FROM rh JOIN win ON rh.{at} >= win.a AND rh.{at} <= win.b GROUP BY ALL),
rates AS (SELECT *, n_det / detec_esperadas AS tasa_detec FROM rx WHERE detec_esperadas > 0 AND n_det <= detec_esperadas)"""


def _range_local() -> str:
    zone = f"'{TB.LOCAL_ZONE}'"
    utc = lambda t: f"timezone('UTC', timezone({zone}, TIMESTAMP '{t}'))"
    local = f"date_trunc('hour', timezone({zone}, timezone('UTC', ts)))"
    return _range_windows(local, f"timezone('UTC', timezone({zone}, {local})) AS hour_utc, ", "hour_utc",
                          [(utc(a), utc(b), e) for a, b, e in TB.LOCAL_SCHEDULE])


def _range_half_hours() -> str:
    half = "time_bucket(INTERVAL 30 MINUTE, ts)"
    return _range_windows(half, "", "hour_time", [(f"TIMESTAMP '{a}'", f"TIMESTAMP '{b}'", e) for a, b, e in TB.HALF_HOUR_SCHEDULE])


def _models(steps: int = 14) -> str:
    """The Newton iteration of :func:`_model` for every receiver, coefficients joined by receiver."""
    parts = [_range(), """,
fit_in AS (SELECT receiver, distance AS x, CAST(sum(n_det) AS DOUBLE) / sum(detec_esperadas) AS y, sum(detec_esperadas) AS n
           FROM rates WHERE distance IS NOT NULL GROUP BY receiver, distance
           HAVING sum(detec_esperadas) > 0 AND sum(n_det) <= sum(detec_esperadas)),
it0 AS (SELECT DISTINCT receiver, CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1 FROM fit_in)"""]
    sums = """SELECT receiver, b0, b1, sum(n * m * (1 - m)) AS s, sum(n * m * (1 - m) * x) AS sx, sum(n * m * (1 - m) * x * x) AS sxx,
               sum(n * (y - m)) AS g0, sum(n * (y - m) * x) AS g1, max(x) AS max_distance
        FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x))) AS m FROM fit_in JOIN it{k} USING (receiver)) GROUP BY receiver, b0, b1"""
    for k in range(1, steps + 1):
        parts.append(f""",
it{k} AS (SELECT receiver, b0 + (sxx * g0 - sx * g1) / (s * sxx - sx * sx) AS b0, b1 + (s * g1 - sx * g0) / (s * sxx - sx * sx) AS b1
        FROM ({sums.format(k=k - 1)}))""")
    return "".join(parts) + f""",
models AS (SELECT receiver, b0, b1, sxx / (s * sxx - sx * sx) AS v00, -sx / (s * sxx - sx * sx) AS v01,
                  s / (s * sxx - sx * sx) AS v11, max_distance FROM ({sums.format(k=steps)}))"""


def _model(steps: int = 14) -> str:
    """Unrolled Newton iteration for the grouped logit, from b = 0; each step's
    coefficients enter the next as scalar subqueries."""
    parts = [_range(), ",\nfit_in AS (SELECT distance AS x, tasa_detec AS y, total_expected AS n FROM bd WHERE distance IS NOT NULL),",
             "it0 AS (SELECT CAST(0 AS DOUBLE) AS b0, CAST(0 AS DOUBLE) AS b1)"]

    def mu(k):
        return f"1 / (1 + exp(-((SELECT b0 FROM it{k}) + (SELECT b1 FROM it{k}) * x)))"

    for k in range(1, steps + 1):
        parts.append(f""",
s{k} AS (SELECT sum(n * m * (1 - m)) AS s, sum(n * m * (1 - m) * x) AS sx, sum(n * m * (1 - m) * x * x) AS sxx,
               sum(n * (y - m)) AS g0, sum(n * (y - m) * x) AS g1
        FROM (SELECT x, y, n, {mu(k - 1)} AS m FROM fit_in)),
it{k} AS (SELECT (SELECT b0 FROM it{k - 1}) + (sxx * g0 - sx * g1) / (s * sxx - sx * sx) AS b0,
                (SELECT b1 FROM it{k - 1}) + (s * g1 - sx * g0) / (s * sxx - sx * sx) AS b1
         FROM s{k})""")
    parts.append(f""",
fin AS (SELECT sum(n * m * (1 - m)) AS s, sum(n * m * (1 - m) * x) AS sx, sum(n * m * (1 - m) * x * x) AS sxx,
               max(x) AS max_distance
        FROM (SELECT x, y, n, {mu(steps)} AS m FROM fit_in)),
model AS (SELECT (SELECT b0 FROM it{steps}) AS b0, (SELECT b1 FROM it{steps}) AS b1,
                 sxx / (s * sxx - sx * sx) AS v00, -sx / (s * sxx - sx * sx) AS v01, s / (s * sxx - sx * sx) AS v11,
                 max_distance
          FROM fin)""")
    return "".join(parts)


def _round_all(cols: list[str], places: int) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in cols)


TIDY_COLS = ["datetime", "transmitter", "receiver", "station_name", "scientific_name", "latitude", "longitude",
             "protection", "substrate", "sitio_captura", "sitio_liberacion", "hour", "minute", "tag_id"]


def _missing() -> str:
    def miss(c):
        cond = f"{c} IS NULL" + (f" OR isnan({c})" if c in ("latitude", "longitude") else "")
        return f"SELECT '{c}' AS column_name, CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM tidy"
    return tidy_ctes() + "\n" + "\nUNION ALL ".join(miss(c) for c in TIDY_COLS)


def oracle_sql() -> dict[str, str]:
    tidy = tidy_ctes()
    ev = tidy + _residency(C.STATION_GAP_SECS)
    q = {}
    q["parse_detections"] = (
        f"WITH {_raw_events()} SELECT datetime, transmitter, receiver, station_name, scientific_name FROM raw")
    q["csv_tidy_detections"] = tidy + "\nSELECT * FROM tidy"
    q["stage_roundtrip"] = tidy + "\nSELECT * FROM tidy"
    q["tidy_detections"] = tidy + "\nSELECT * FROM tidy"
    q["missing_cells"] = _missing()
    q["distinct_species"] = tidy + "\nSELECT DISTINCT scientific_name FROM tidy"
    q["station_frequency"] = _movement() + "\nSELECT station_name, count(*) AS n FROM legs WHERE station_name IS NOT NULL GROUP BY station_name"
    q["datetime_summary"] = _six_number_sql(tidy, "tidy")
    q["station_counts"] = tidy + "\nSELECT station_name, latitude, longitude, count(*) AS num_det FROM tidy GROUP BY ALL"
    q["movement_base"] = _movement() + "\nSELECT * FROM mb"
    q["movement_legs"] = _movement() + "\nSELECT * FROM legs"
    q["movement_station_counts"] = _movement() + """
SELECT station_name, latitude, longitude, count(*) AS num_det FROM legs GROUP BY ALL
HAVING station_name IS NOT NULL AND latitude IS NOT NULL AND NOT isnan(latitude) AND longitude IS NOT NULL AND NOT isnan(longitude)"""
    q["residency_events"] = ev + "\nSELECT * FROM r_events"
    q["residency_event_rows"] = ev + "\nSELECT * FROM r_kept"
    q["residency_days"] = _days() + "\nSELECT * FROM days"
    q["monthly_days"] = _monthly("distinct") + "\nSELECT * FROM monthly"
    q["days_per_year"] = _monthly("rows") + "\nSELECT * FROM monthly"
    q["rose_detections"] = tidy + """
SELECT scientific_name, sitio_captura, protection, hour AS bin_start, count(*) AS n, hour + 1 AS bin_end,
       printf('%02d:00', hour) AS bin_label
FROM tidy GROUP BY ALL"""
    q["rose_partitions"] = q["rose_detections"]
    q["mean_residency_station"] = _mean("distinct", C.STATION_KEYS, "tags")
    q["mean_residency_protection"] = _mean("distinct", C.PROTECTION_KEYS, "tags")
    q["mean_residency_station_se_rows"] = _mean("rows", C.STATION_KEYS, "rows")
    q["unique_tags"] = _days() + """
SELECT station_name, protection, scientific_name, month, count(*) AS unique_tags
FROM (SELECT DISTINCT tag_id, station_name, protection, scientific_name, month FROM days) GROUP BY ALL"""
    q["unique_tags_stacked"] = _days() + """,
ut AS (SELECT station_name, protection, scientific_name, month, count(*) AS unique_tags
       FROM (SELECT DISTINCT tag_id, station_name, protection, scientific_name, month FROM days) GROUP BY ALL)
SELECT protection, scientific_name, month, CAST(sum(unique_tags) AS BIGINT) AS total_unique_tags FROM ut GROUP BY ALL"""
    q["unique_tags_stacked_station"] = q["unique_tags_stacked"].replace(
        "SELECT protection, scientific_name, month, CAST", "SELECT station_name, protection, scientific_name, month, CAST")
    q["station_points"] = tidy + """
SELECT station_name, latitude, longitude, count(*) AS num_det FROM tidy GROUP BY ALL"""
    q["hourly_event_ids"] = _hourly() + "\nSELECT * FROM h_ids"
    q["hour_bins"] = _hourly() + "\nSELECT * FROM bins"
    q["hourly_residency"] = _hourly() + "\nSELECT * FROM good"
    q["resident_hours"] = _hourly() + "\nSELECT * FROM rh"
    q["resident_hours_semi"] = _hourly() + """
SELECT * FROM rh WHERE EXISTS (SELECT 1 FROM good g WHERE g.tag_id IS NOT DISTINCT FROM rh.tag_id
  AND g.scientific_name IS NOT DISTINCT FROM rh.scientific_name AND g.protection IS NOT DISTINCT FROM rh.protection
  AND g.event_id IS NOT DISTINCT FROM rh.event_id)"""
    q["rose_resident_hours"] = _hourly() + """
SELECT scientific_name, protection, greatest(hour_of_day - 1, 0) AS bin_start, count(*) AS n,
       greatest(hour_of_day - 1, 0) + 1 AS bin_end, printf('%02d:00', greatest(hour_of_day - 1, 0)) AS bin_label
FROM rh GROUP BY ALL"""
    q["abacus"] = tidy + """,
fd AS (SELECT tag_id, min(datetime) AS first_det FROM tidy WHERE tag_id IS NOT NULL GROUP BY tag_id),
rk AS (SELECT tag_id, CAST(row_number() OVER (ORDER BY first_det, tag_id) AS BIGINT) AS tag_rank FROM fd)
SELECT t.datetime, t.tag_id, t.protection, rk.tag_rank FROM tidy t LEFT JOIN rk ON t.tag_id = rk.tag_id"""
    q["tag_roses"] = _hourly() + """,
tr AS (SELECT tag_id, protection, greatest(hour_of_day - 1, 0) AS bin_start, count(*) AS n,
              min(scientific_name) AS sp FROM rh GROUP BY ALL)
SELECT tag_id, protection, bin_start, n, bin_start + 1 AS bin_end, printf('%02d:00', bin_start) AS bin_label,
       min(sp) OVER (PARTITION BY tag_id) AS species FROM tr"""
    q["residency_station_frequency"] = ev + """
SELECT station_name, count(*) AS n FROM r_events WHERE station_name IS NOT NULL GROUP BY station_name"""
    q["range_datetime_summary"] = _six_number_sql(
        "WITH rdt AS (SELECT date_trunc('second', ts) AS datetime FROM events)", "rdt")
    q["mean_residency_summary"] = _mean_summary()
    q["range_hourly"] = _range() + "\nSELECT * FROM rh"
    q["range_hourly_local"] = _range_local() + "\nSELECT * FROM rh"
    q["range_expected_local"] = _range_local() + "\nSELECT * FROM rates"
    q["range_expected_half_hours"] = _range_half_hours() + "\nSELECT * FROM rates"
    q["range_models"] = _models() + f"""
SELECT receiver, round(b0, {C.MODEL_PLACES}) AS b0, round(b1, {C.MODEL_PLACES}) AS b1,
       {_round_all(["v00", "v01", "v11"], C.COV_PLACES)}, round(max_distance, {C.MODEL_PLACES}) AS max_distance FROM models"""
    q["hourly_residency_strict"] = _strict() + "\nSELECT * FROM good"
    same = " AND ".join(f"g.{k} IS NOT DISTINCT FROM rh.{k}" for k in ("tag_id", "scientific_name", "protection", "event_id"))
    q["resident_hours_of_events"] = _strict() + f"\nSELECT * FROM rh WHERE EXISTS (SELECT 1 FROM good g WHERE {same})"
    q["bins_with_events"] = _strict() + f"""
SELECT rh.*, g.start_datetime, g.end_datetime, g.duration_hours FROM rh LEFT JOIN good g ON {same}"""
    q["station_geojson"] = q["station_counts"]
    q["range_expected"] = _range() + "\nSELECT * FROM rates"
    q["range_by_distance"] = _range() + "\nSELECT * FROM bd"
    mp = C.MODEL_PLACES
    q["range_model"] = _model() + f"""
SELECT round(b0, {mp}) AS b0, round(b1, {mp}) AS b1, {_round_all(["v00", "v01", "v11"], C.COV_PLACES)},
       round(max_distance, {mp}) AS max_distance FROM model"""
    q["range_curve"] = _model() + f""",
grid AS (SELECT i, (SELECT max_distance FROM model) * i / CAST({C.CURVE_POINTS - 1} AS DOUBLE) AS distance
         FROM range(0, {C.CURVE_POINTS}) AS r(i)),
pred AS (SELECT CAST(i AS INTEGER) AS i, distance,
                (SELECT b0 FROM model) + (SELECT b1 FROM model) * distance AS fit_link,
                sqrt((SELECT v00 FROM model) + 2 * distance * (SELECT v01 FROM model)
                     + distance * distance * (SELECT v11 FROM model)) AS se_link FROM grid),
band AS (SELECT *, fit_link - {C.CURVE_Z} * se_link AS lwr_link, fit_link + {C.CURVE_Z} * se_link AS upr_link FROM pred)
SELECT i, {_round_all(["distance", "fit_link", "se_link", "lwr_link", "upr_link"], mp)},
       round(1 / (1 + exp(-fit_link)), {mp}) AS predicted_prob, round(1 / (1 + exp(-lwr_link)), {mp}) AS lwr,
       round(1 / (1 + exp(-upr_link)), {mp}) AS upr
FROM band"""
    probs = " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS p" for p in C.THRESHOLD_PROBS)
    q["range_thresholds"] = _model() + f""",
probs AS ({probs})
SELECT p, round((ln(p / (1 - p)) - (SELECT b0 FROM model)) / (SELECT b1 FROM model), {mp - 3}) AS distance
FROM probs"""
    return q
