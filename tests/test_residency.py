import datetime as dt

from pingtrail.operators.residency import expand_days, mean_residency, monthly_days, stacked_totals, unique_tags


def _events(spark, data):
    return spark.createDataFrame(
        [(t, s, sp, p, dt.datetime.fromisoformat(a), dt.datetime.fromisoformat(b)) for t, s, sp, p, a, b in data],
        "tag_id string, station_name string, scientific_name string, protection string, "
        "start_datetime timestamp_ntz, end_datetime timestamp_ntz")


def test_days_months_years(spark):
    ev = _events(spark, [
        ("1", "ST1", "Sp", "MPA", "2023-12-30 22:00:00", "2024-01-02 01:00:00"),   # crosses month and year
        ("1", "ST1", "Sp", "MPA", "2024-12-31 10:00:00", "2024-12-31 11:00:00"),   # December seen in two years
        ("2", "ST1", "Sp", "MPA", "2024-01-01 10:00:00", "2024-01-01 11:00:00"),
        (None, "ST1", "Sp", "MPA", "2024-01-05 10:00:00", "2024-01-05 11:00:00"),
    ])
    days = expand_days(ev)
    assert days.count() == 4 + 1 + 1 + 1
    md = {(r.tag_id, r.month, r.year): (r.n_days_present, r.n_years, r.days_per_year)
          for r in monthly_days(days).collect()}
    assert md[("1", 12, 2023)] == (2, 2, 1.0)
    assert md[("1", 12, 2024)] == (1, 2, 0.5)
    assert md[("1", 1, 2024)] == (2, 1, 2.0)
    m = {(r.station_name, r.month): r for r in mean_residency(monthly_days(days), ["station_name", "month"]).collect()}
    jan = m[("ST1", 1)]
    assert jan.n_tags == 3  # tags 1, 2 and the NULL tag
    assert abs(jan.mean_days_present - (2 + 1 + 1) / 3) < 1e-12
    dec = m[("ST1", 12)]
    assert dec.n_tags == 1 and dec.sd_days_present is not None
    single = mean_residency(monthly_days(days).where("tag_id = '2'"), ["station_name", "month"]).collect()[0]
    assert single.sd_days_present is None and single.se_days_present is None
    ut = {r.month: r.unique_tags for r in unique_tags(days).collect()}
    assert ut == {12: 1, 1: 3}
    st = {r.month: r.total_unique_tags for r in stacked_totals(unique_tags(days)).collect()}
    assert st == ut


def test_rows_variant_counts_rows(spark):
    ev = _events(spark, [
        ("1", "ST1", "SpA", "MPA", "2024-03-01 10:00:00", "2024-03-01 11:00:00"),
        ("1", "ST1", "SpB", "MPA", "2024-03-02 10:00:00", "2024-03-02 11:00:00"),   # same year, other species
    ])
    days = expand_days(ev)
    assert {r.n_years for r in monthly_days(days, years="distinct").collect()} == {1}
    assert {r.n_years for r in monthly_days(days, years="rows").collect()} == {2}
