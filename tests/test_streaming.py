from pyspark.sql import functions as F

from tabloom.streaming import ingest


def test_new_files_are_read_once(spark, tmp_path):
    folder, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.xml").write_text(f"<all><r><id>{i}</id><v>x</v></r><r><id>{i + 10}</id></r></all>")
        records = ingest.columns(ingest.xml_records(spark, folder), ["id", "v"])
        ingest.ingest(records, out, check).awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == sorted([("0", "x"), ("10", None), ("1", "x"), ("11", None)], key=lambda r: (r[0], r[1] or ""))


def test_late_events_by_window(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "2024-01-01 00:20:00"), ("2024-01-01 00:30:00", "2024-01-01 00:20:00"), ("2024-01-01 05:00:00", "2024-01-01 04:00:00")], "a string, b string")
    rows = ingest.late_events(df.select(*(F.to_timestamp(c).alias(c) for c in "ab")), "a", "b").orderBy("window").collect()
    assert [(r.events, r.early) for r in rows] == [(2, 1), (1, 0)]
