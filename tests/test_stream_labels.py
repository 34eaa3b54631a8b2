"""Delayed labels of dense and odd rows."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from helioframe.streaming import jobs, stateful


def test_dense_labels_by_running_maxima(spark, tmp_path):
    """No series, no id, no value, rows twice, equal times, times on bucket borders."""
    rows = [(name, None if k % 40 == 7 else k, k * 6 + (k % 5 == 0) * 6, None if k % 9 == 0 else float(k * 37 % 101)) for name in ("a", None) for k in range(400)]
    rows += rows[::13] + [("b", 1, 0, 5.0), ("b", 2, 600, None), ("b", 3, 1201, 7.0)]
    landing = str(tmp_path / "in")
    for part in (rows, [(None, None, 40_000, None)]):
        df = spark.createDataFrame(part, "series string, event_id long, s long, x double")
        df = df.select("series", F.timestamp_seconds(F.col("s") + 1_704_067_200).alias("ts"), "event_id", "x")
        df.coalesce(1).write.mode("append").parquet(landing)
    out = stateful.stream_labels(jobs.read_landing(spark, landing, df.schema, files_per_trigger=1), 10, "60 minutes")
    query = jobs.to_table(out, str(tmp_path / "out"), str(tmp_path / "mark"))
    query.awaitTermination()
    assert [o["operatorName"] for o in query.lastProgress["stateOperators"]].count("transformWithStateInPandasExec") == 2
    want = []
    for name, k, s in {(name, k, s) for name, k, s, _ in rows}:
        seen = [x for n, _, t, x in rows if n == name and s < t <= s + 600]
        if seen:
            want.append((name, k, max((x for x in seen if x is not None), default=None)))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("series", "event_id", "peak").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rows_of_the_last_horizon_have_labels(spark, tmp_path):
    path = str(tmp_path / "sf")
    spark.range(60).selectExpr(
        "id AS event_id", "CAST(timestamp_seconds(1704067200 + id * 600) AS timestamp_ntz) AS ts", "id AS user_id", "'view' AS event_type",
        "double(id * 7 % 13 + 1) AS value", "'{}' AS props").coalesce(1).write.parquet(f"{path}/events.parquet")
    got = {r["event_id"] for r in queries()["stream_labels"](spark, path).collect()}
    assert got == set(range(0, 58, 2))      # all rows of the long channel that another one follows
