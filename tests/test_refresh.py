"""The refreshed store next to a full rebuild."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from checks.compare import difference
from helioframe.plans.telemetry import build_telemetry, feature_table
from helioframe.streaming.refresh import FeatureStore


def rebuilt(feed):
    return feature_table(build_telemetry(feed, ["series"], "event_id"), ["event_id"])


def same(spark, store, feed):
    want = rebuilt(feed)
    assert difference(store.features(spark).select(want.columns).toPandas(), want.toPandas()) is None


def files(store):
    return {os.path.relpath(f, store.path) for f in glob.glob(f"{store.path}/features/**/*.parquet", recursive=True)}


def current(spark, store):
    return {(r.series, r.day): r.feature_batch for r in store.chunks(spark).collect()}


def test_untouched_chunks_keep_their_files(spark, tmp_path):
    minutes = 6 * 24 * 60
    rows = spark.range(0, minutes).selectExpr("'a' AS series", "id AS event_id", "IF(id % 2 = 0, '0.1-0.8nm', '0.05-0.4nm') AS energy",
                                              "1e-7 * (1 + id % 13) AS flux", "timestamp_seconds(1704067200 + id * 60) AS time_tag")
    store = FeatureStore(str(tmp_path))
    store.apply(rows, 0)
    kept, when = files(store), current(spark, store)
    late = spark.range(1).selectExpr("'a' AS series", "3L AS event_id", "'0.1-0.8nm' AS energy", "9e-5 AS flux", "timestamp'2024-01-03 12:00:30' AS time_tag")
    store.apply(late, 1)
    now = current(spark, store)
    # 720 rows a day: the change is felt within 240 rows, so in its own day only
    assert {str(d) for (_, d), k in now.items() if k == 1} <= {"2024-01-02", "2024-01-03", "2024-01-04"} and now != when
    assert kept <= files(store) and sum(k == 0 for k in now.values()) >= 3
    same(spark, store, rows.unionByName(late))


def test_keys_and_missing_values(spark, tmp_path):
    rows = [(key, k, "0.1-0.8nm" if k % 2 else "0.05-0.4nm", None if k % 30 < 25 else 1e-6 * k, f"2024-01-0{1 + k // 20} 00:{k % 20:02d}:00") for k in range(100) for key in ("007", None)]
    feed = spark.createDataFrame(rows, "series string, event_id bigint, energy string, flux double, time_tag string").withColumn("time_tag", F.to_timestamp("time_tag"))
    store = FeatureStore(str(tmp_path))
    for k, part in enumerate(["event_id < 20", "event_id >= 60", "event_id BETWEEN 20 AND 59"]):
        store.apply(feed.filter(part), k)
    store.apply(feed.filter(part), k)       # the last batch once more
    same(spark, store, feed)
    with pytest.raises(Exception, match="time_tag is NULL"):
        store.apply(feed.limit(1).withColumn("time_tag", F.lit(None).cast("timestamp")), 3)
    store.apply(feed.limit(0), 3)       # a fetch without records
    same(spark, store, feed)
