"""Time frames of many rows: a row must not cost what its frame holds."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from checks.compare import difference
from helioframe.operators.instruments import median_3sigma, pulsation_variance

FRAME = 60_000_000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def odd_rows(spark):
    """Two series (one without a name), equal times, missing values, NaN and infinity, times on frame borders."""
    rng = np.random.default_rng(5)
    us = [int(t) for t in np.sort(rng.integers(0, 400, 300)) * 1_500_000 + 1_700_000_000_000_000]
    x = [None if k % 11 == 0 else float(v) for k, v in enumerate(rng.integers(0, 50, 300))]
    x[40], x[150] = math.nan, math.inf
    rows = [(name, k, t, v) for name in ("a", None) for k, (t, v) in enumerate(zip(us, x, strict=True))]
    df = spark.createDataFrame(rows, "series string, id bigint, us bigint, x double").withColumn("ts", F.timestamp_micros("us"))
    frames = [[v for u, v in zip(us, x, strict=True) if t - FRAME <= u <= t and v is not None] for t in us]
    return df.repartition(5), frames


def test_median_of_odd_rows_without_a_list_per_row(spark):
    df, frames = odd_rows(spark)
    out = median_3sigma(df, "x", ["series"], "ts", minutes=1)
    assert "collect_list" not in plan_of(out)
    got = {(r["series"], r["id"]): r for r in out.collect()}
    assert len(got) == 2 * len(frames)
    for (_, k), r in got.items():
        frame = sorted(frames[k], key=lambda v: (math.isnan(v), v))
        m = len(frame)
        if not m:
            assert r["median"] is None and r["sigma"] == 0
            continue
        want = (frame[(m - 1) // 2] + frame[m // 2]) / 2
        assert r["median"] == want or (math.isnan(want) and math.isnan(r["median"]))
        if all(map(math.isfinite, frame)):
            assert r["sigma"] == pytest.approx(np.std(frame, ddof=1) if m > 1 else 0.0, abs=1e-12)
        elif m > 1:
            assert math.isnan(r["sigma"])


def test_variance_without_a_pass_over_the_frame_per_row(spark):
    df, frames = odd_rows(spark)
    out = pulsation_variance(df, "x", ["series"], "ts", seconds=60, threshold=100.0)
    assert f"-{FRAME}" not in plan_of(out)      # no frame that slides
    got = {(r["series"], r["id"]): r for r in out.collect()}
    assert len(got) == 2 * len(frames)
    for (_, k), r in got.items():
        if all(map(math.isfinite, frames[k])):
            assert r["variance"] == pytest.approx(np.var(frames[k], ddof=1) if len(frames[k]) > 1 else 0.0, abs=1e-10)
            assert r["is_burst"] == (r["variance"] > 100.0)
        elif len(frames[k]) > 1:
            assert math.isnan(r["variance"])


def test_variance_of_large_and_equal_values(spark):
    rows = spark.range(4000).selectExpr("'a' AS series", "id", "timestamp_millis(id * 50) AS ts", "1e9D + IF(id < 2000, 0, id % 2) AS x")
    got = {r["id"]: r["variance"] for r in pulsation_variance(rows, "x", ["series"], "ts", seconds=10).collect()}
    assert got[1500] == 0 and got[0] == 0
    assert got[3900] == pytest.approx(np.var([k % 2 for k in range(3700, 3901)], ddof=1), rel=1e-6)


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """Twelve hours of events, some hundred in every frame."""
    path = str(tmp_path_factory.mktemp("dense"))
    spark.range(6000).selectExpr(
        "id AS event_id", "CAST(timestamp_millis(1704067200000 + id * 7200 + id * id % 701) AS timestamp_ntz) AS ts", "id % 9 AS user_id",
        "IF(id % 4 = 0, 'view', 'click') AS event_type", "round(50 + 40 * sin(id / 700) + id * 37 % 101 * (1 + sin(id / 300)), 2) AS value",
        "concat('{\"k\": ', id % 13, '}') AS props").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def same_as_sql(spark, name, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet/*.parquet')")
    out = queries()[name](spark, path)
    ours = out.toPandas()
    assert len(ours) > 1
    assert difference(ours, con.execute(oracle_sql()[name]).df()) is None
    return out


def test_detector_events_of_dense_rows(spark, dense):
    plan = plan_of(same_as_sql(spark, "detector_events", dense))
    assert "collect_list" not in plan and f"-{360 * FRAME}" not in plan and f"-{120 * FRAME}" not in plan


def test_detector_sync_of_dense_rows(spark, dense):
    from checks.queries import _detected

    same_as_sql(spark, "detector_sync", dense)
    for events in _detected(spark, dense):
        assert "collect_list" not in plan_of(events) and f"-{120 * FRAME}" not in plan_of(events)
