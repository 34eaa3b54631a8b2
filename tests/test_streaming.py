import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helioframe.streaming import jobs, stateful


def flux(spark, minutes, values, name="a"):
    rows = pd.DataFrame({"series": name, "m": minutes, "event_id": minutes, "x": np.asarray(values, float)})
    return spark.createDataFrame(rows).selectExpr("series", "timestamp_seconds(m * 60) AS ts", "event_id", "x")


def run(spark, tmp_path, files, job):
    landing = str(tmp_path / "in")
    for f in files:
        f.coalesce(1).write.mode("append").parquet(landing)
    out = job(jobs.read_landing(spark, landing, files[0].schema, files_per_trigger=1))
    jobs.to_table(out, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))


def test_events_with_rows_out_of_order(spark, tmp_path):
    loud = {3, 4, 5, 9, 20, 21, 40}
    minutes = list(range(60))
    values = {m: 2.0 + (m == 4) if m in loud else 0.0 for m in minutes}
    parts = [[0, 2, 4, 5, 12], [1, 3, 6, 7, 8, 10, 11, 9, 20], [*range(13, 20), *range(21, 45)], [*range(45, 60)], [10_000]]
    files = [flux(spark, p, [values.get(m, 0.0) for m in p]) for p in parts]
    out = run(spark, tmp_path, files, lambda s: stateful.stream_events(s, 1.0, "15 minutes"))
    got = sorted((r["start"].timestamp() / 60, r["end"].timestamp() / 60, r["peak_time"].timestamp() / 60, r["samples"]) for r in out.collect())
    assert got == [(3, 5, 4, 3), (9, 9, 9, 1), (20, 21, 20, 2), (40, 40, 40, 1)]


def test_open_run_is_kept_in_state(spark, tmp_path):
    files = [flux(spark, [0, 1], [0, 5]), flux(spark, [2, 3], [6, 4]), flux(spark, [4, 500], [0, 0])]
    out = run(spark, tmp_path, files, lambda s: stateful.stream_events(s, 1.0, "1 minute")).collect()
    assert [(r["samples"], r["peak_val"]) for r in out] == [(3, 6.0)]


def quiet_and_loud(spark, minutes, loud, name="a"):
    return flux(spark, minutes, [5.0 + (m % 10 == 7) if m in loud else 0.0 for m in minutes], name)


def test_run_across_many_buckets_and_files(spark, tmp_path):
    """A run of 30 rows over buckets of 4 minutes, in several files, is one event; a gap beyond the silence cuts it."""
    minutes = [*range(0, 45), *range(200, 210), *range(290, 300)]
    loud = {*range(3, 33), *range(205, 210), *range(290, 293)}
    files = [quiet_and_loud(spark, [m for m in minutes if m in part], loud) for part in (range(0, 20), range(20, 210), range(210, 300))]
    files.append(flux(spark, [2000], [0.0], "other"))
    out = run(spark, tmp_path, files, lambda s: stateful.stream_events(s, 1.0, "5 minutes", bucket_minutes=4, silence_minutes=60))
    got = sorted((r["start"].timestamp() / 60, r["end"].timestamp() / 60, r["peak_time"].timestamp() / 60, r["samples"]) for r in out.collect())
    assert got == [(3, 32, 7, 30), (205, 209, 207, 5), (290, 292, 290, 3)]


def test_silent_series_emits_by_timer(spark, tmp_path):
    """Nothing ever follows the run of a; the clock of the other series lets it go, and its state with it."""
    files = [quiet_and_loud(spark, [0, 1, 2], {1, 2}), *[flux(spark, [m], [0.0], "b") for m in (100, 300, 900)]]
    landing = str(tmp_path / "in")
    for f in files:
        f.coalesce(1).write.mode("append").parquet(landing)
    out = stateful.stream_events(jobs.read_landing(spark, landing, files[0].schema, files_per_trigger=1), 1.0, "1 minute", bucket_minutes=10, silence_minutes=60)
    query = jobs.to_table(out, str(tmp_path / "out"), str(tmp_path / "mark"))
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["series"], r["samples"], r["peak_val"]) for r in rows] == [("a", 2, 5.0)]
    first, second = query.lastProgress["stateOperators"]
    assert {first["operatorName"], second["operatorName"]} == {"transformWithStateInPandasExec"}


def test_late_rows_of_closed_buckets_are_dropped(spark, tmp_path):
    files = [quiet_and_loud(spark, [0, 1, 2, 3], {1}), flux(spark, [500], [0.0]), flux(spark, [2], [9.0]), flux(spark, [900], [0.0])]
    out = run(spark, tmp_path, files, lambda s: stateful.stream_events(s, 1.0, "1 minute", bucket_minutes=10, silence_minutes=60)).collect()
    assert [(r["samples"], r["peak_val"]) for r in out] == [(1, 5.0)]


@pytest.mark.parametrize("horizon", [1, 7])
def test_labels_by_interval_join(spark, tmp_path, horizon):
    rng = np.random.default_rng(horizon)
    minutes = [int(m) for m in np.unique(rng.integers(1, 90, 50))]
    values = [round(float(v), 3) for v in rng.random(len(minutes))]
    pairs = list(zip(minutes, values, strict=True))
    files = [flux(spark, [m for m, _ in p], [v for _, v in p]) for p in (pairs[5:15] + pairs[:5], pairs[15:30], pairs[30:], [(400, 0.0)])]
    landing = str(tmp_path / "in")
    for f in files:
        f.coalesce(1).write.mode("append").parquet(landing)
    out = stateful.stream_labels(jobs.read_landing(spark, landing, files[0].schema, files_per_trigger=1), horizon, "60 minutes")
    query = jobs.to_table(out, str(tmp_path / "out"), str(tmp_path / "mark"))
    query.awaitTermination()
    assert "symmetricHashJoin" in {o["operatorName"] for o in query.lastProgress["stateOperators"]}
    want = {m: max(v for n, v in pairs if m < n <= m + horizon) for m in minutes if any(m < n <= m + horizon for n in minutes)}
    assert {r["event_id"]: r["peak"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_snapshot_over_several_batches(spark, tmp_path):
    rows = flux(spark, list(range(200)), range(200)).unionByName(flux(spark, list(range(5)), range(5), "b"))
    for k in range(3):
        rows.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_landing(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=1)
    jobs.for_each_batch(stream, jobs.snapshot_step(str(tmp_path / "out"), ["series"], ["ts"]), str(tmp_path / "mark")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out" / "batch=2"))
    assert {r["series"]: r["count"] for r in out.groupBy("series").count().collect()} == {"a": 81, "b": 5}
    assert {(r["series"], r["x"]) for r in out.filter(F.col("is_status")).collect()} == {("a", 199.0), ("b", 4.0)}
    assert out.filter("series = 'a'").agg(F.min("x")).first()[0] == 119.0
