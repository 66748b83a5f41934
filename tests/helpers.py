import datetime as dt

from pyspark.sql import functions as F


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def rows(df, *cols, order=None):
    d = df.select(*cols) if cols else df
    if order:
        d = d.orderBy(*order)
    return [tuple(r) for r in d.collect()]


def detections_df(spark, data):
    """Tidy-shaped detections from (datetime, transmitter, station, protection[, species])."""
    out = []
    for i, r in enumerate(data):
        t, tr, st, prot = r[:4]
        sp = r[4] if len(r) > 4 else "Sp"
        out.append((ts(t), tr, "R1", st, sp, -33.5, -71.6, prot, "rock", "CAP_0", "LIB_0"))
    df = spark.createDataFrame(
        out,
        "datetime timestamp_ntz, transmitter string, receiver string, station_name string, scientific_name string, "
        "latitude double, longitude double, protection string, substrate string, sitio_captura string, "
        "sitio_liberacion string")
    return df.withColumns({
        "hour": F.hour("datetime"), "minute": F.minute("datetime"),
        "tag_id": F.regexp_substr("transmitter", F.lit("[0-9]{4,5}$")),
    })
