"""Results do not depend on the layout, on partitioning or on row order."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks import bindings as b
from checks.compare import difference
from helioframe.operators import timeline as tlm
from helioframe.operators.fill import ffill_bfill
from helioframe.operators.instruments import median_3sigma
from helioframe.plans.telemetry import build_telemetry, feature_table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("chunk_rows", [240, 1000])
def test_features_same_in_chunks_and_shuffled(spark, chunk_rows):
    feed = b.feed(spark, SF)
    whole = feature_table(build_telemetry(feed, b.BY, "event_id", layout="whole"), ["event_id"]).toPandas()
    mixed = feed.repartition(7, "flux").orderBy(F.rand(3))
    chunked = feature_table(build_telemetry(mixed, b.BY, "event_id", layout="chunked", chunk_rows=chunk_rows), ["event_id"])
    assert difference(chunked.toPandas(), whole) is None


def test_single_series_in_chunks(spark):
    feed = b.feed(spark, SF).drop("series")
    whole = feature_table(build_telemetry(feed, (), "event_id", layout="whole"), ["event_id"]).toPandas()
    chunked = feature_table(build_telemetry(feed, (), "event_id", layout="chunked", chunk_rows=250), ["event_id"])
    assert len(whole) == 500
    assert difference(chunked.toPandas(), whole) is None


def test_auto_layout_measures(spark):
    rows = b.unit(spark, SF)
    assert not tlm.build_timeline(rows, b.BY, b.ORDER).chunked
    assert tlm.build_timeline(rows, b.BY, b.ORDER, small_rows=50).chunked


def test_positions_with_null_series_and_equal_times(spark):
    rows = spark.range(1000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'hot' ELSE concat('s', id % 7) END AS series", "timestamp_seconds(id div 400) AS ts")
    out = {}
    for layout in ({"layout": "whole"}, {"layout": "chunked", "chunk_rows": 13}):
        tl = tlm.build_timeline(rows.orderBy(F.rand(1)), ["series"], ["ts", "id"], **layout)
        tl = tl.carry(sums={"run": F.col("id")}, last={"back": "id"}, upcoming={"fwd": "id"}, first={"head": "id"}, totals={"all": F.col("id")})
        out[tl.chunked] = tl.df.select("series", "id", tlm.RN, tlm.LEN, "run", "back", "fwd", "head", "all").toPandas()
    assert len(out[True]) == 1000
    assert difference(out[True], out[False]) is None


def test_halo_is_checked(spark):
    tl = tlm.build_timeline(b.unit(spark, SF), b.BY, b.ORDER, layout="chunked", chunk_rows=50).spread(3, 0)
    with pytest.raises(ValueError, match="spread wider"):
        tl.spread(4, 0)


def test_plan_has_one_exchange(spark):
    tl = build_telemetry(b.feed(spark, SF), b.BY, "event_id", layout="whole")
    plan = feature_table(tl)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BatchEvalPython" not in plan and "ArrowEval" not in plan


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.floats(0, 9, width=16)), min_size=1, max_size=40), chunk=st.integers(1, 9))
def test_fill_property(spark, values, chunk):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "series string, id bigint, x double")
    tl = tlm.build_timeline(rows, ["series"], ["id"], layout="chunked", chunk_rows=chunk)
    got = [r["x"] for r in ffill_bfill(tl, ["x"]).df.orderBy("id").collect()]
    seen, want = next((v for v in values if v is not None), None), []
    for v in values:
        seen = v if v is not None else seen
        want.append(seen)
    assert got == want


def test_time_frames_cross_buckets(spark):
    rows = spark.range(3000).selectExpr("'a' AS series", "id", "timestamp_seconds(id * 7) AS ts", "double((id * 37) % 101) AS x")
    got = median_3sigma(rows, "x", ["series"], "ts", minutes=1).orderBy("id").collect()
    for i in (0, 1, 5, 549, 550, 551, 1097, 1098, 2999):
        frame = sorted(float((k * 37) % 101) for k in range(max(0, i - 8), i + 1))
        m = len(frame)
        assert got[i]["median"] == (frame[m // 2] if m % 2 else (frame[m // 2 - 1] + frame[m // 2]) / 2)
    assert len(got) == 3000
