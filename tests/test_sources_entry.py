from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from pingtrail.session import scratch_path
from pingtrail.sources.delimited import read_delimited
from pingtrail.sources.stages import load_stage, save_stage, write_partitioned


def test_csv_na_empty_and_trim(spark, tmp_path):
    p = tmp_path / "tag_info.csv"
    p.write_text('Transmitter;Sitio Captura;Sitio_Liberacion\n A69-1602-1 ; "  CAP " ;NA\nA69-1602-2;"";x\n')
    schema = StructType([StructField(c, StringType()) for c in ("Transmitter", "Sitio Captura", "Sitio_Liberacion")])
    df = read_delimited(spark, str(p), schema, sep=";", trim=True, clean_names=True)
    assert df.columns == ["transmitter", "sitio_captura", "sitio_liberacion"]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == [("A69-1602-1", "CAP", None), ("A69-1602-2", None, "x")]


def test_csv_drop_first_column(spark, tmp_path):
    p = tmp_path / "det.csv"
    p.write_text('"",Date_Time,value\n1,03/01/2024 10:05,2.5\n2,,NA\n')
    schema = StructType([StructField("idx", LongType()), StructField("Date_Time", StringType()),
                         StructField("value", DoubleType())])
    df = read_delimited(spark, str(p), schema, drop_first=True, clean_names=True)
    assert df.columns == ["date_time", "value"]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == [("03/01/2024 10:05", 2.5), (None, None)]


def test_partitioned_stage_with_null_and_numeric_keys(spark):
    df = spark.createDataFrame([("12345", 1), (None, 2), ("00077", 3)], "tag_id string, n int")
    path = write_partitioned(df, scratch_path(spark, "t"), "tag_id")
    back = load_stage(spark, path, df.schema)
    assert sorted((tuple(r) for r in back.select("tag_id", "n").collect()), key=repr) == sorted(
        [("12345", 1), (None, 2), ("00077", 3)], key=repr)
    p2 = save_stage(df, scratch_path(spark, "s"))
    assert load_stage(spark, p2).count() == 3


def test_scratch_under_checkpoint_dir(spark):
    assert scratch_path(spark, "x").startswith(spark.sparkContext._jsc.sc().getCheckpointDir().get())


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.QUERIES) <= set(E.oracle_sql()) <= set(E.queries())
    for name in ("residency_events", "movement_base", "tidy_detections"):
        assert E.queries()[name](spark, "/root/testdata/sf0.001").columns
