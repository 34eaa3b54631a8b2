"""Hand-made cases for the rules that are easy to get wrong."""

import math

import pytest
from helpers import series
from pyspark.sql import functions as F

from helioframe.functions import classify, numeric
from helioframe.operators import evaluation, metrics, serving
from helioframe.operators.asof import asof_nearest
from helioframe.operators.events import flare_events, latest
from helioframe.operators.fill import fill_and_clip
from helioframe.operators.horizon import horizon_peaks
from helioframe.operators.insights import insight_report
from helioframe.operators.instruments import event_sync, match_catalog
from helioframe.operators.kernel import poly_filter
from helioframe.operators.rolling import rolling_log_std, rolling_log_std_by_time, rolling_var, rolling_var_by_time
from helioframe.operators.timeline import build_timeline

LAYOUTS = [{"layout": "whole"}, {"layout": "chunked", "chunk_rows": 4}]


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def timeline(spark, values, **layout):
    return build_timeline(series(spark, values), ["series"], ["timestamp", "id"], **(layout or LAYOUTS[0]))


def at(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("t", F.timestamp_seconds("t"))


@pytest.mark.parametrize("layout", LAYOUTS)
def test_asof_ties_and_duplicates(spark, layout):
    left = at(spark, [(10,), (20,), (30,), (40,)], "t bigint")
    right = at(spark, [(5, 0), (15, 1), (15, 2), (25, 3), (25, 4), (40, 5), (40, 6)], "t bigint, id bigint")
    right = right.withColumn("tie", F.col("id"))
    out = asof_nearest(left, right, "t", right_tie="tie", **layout)
    assert column(out, "id", "t") == [0, 2, 4, 6]
    behind = asof_nearest(left, right, "t", right_tie="tie", direction="backward", **layout)
    assert column(behind, "id", "t") == [0, 2, 4, 6]
    ahead = asof_nearest(left, right, "t", right_tie="tie", direction="forward", **layout)
    assert column(ahead, "id", "t") == [1, 3, 5, 6]
    near = asof_nearest(left, right, "t", right_tie="tie", tolerance=4, **layout)
    assert column(near, "id", "t") == [None, None, None, 6]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_asof_empty_right_and_missing_value(spark, layout):
    left = at(spark, [(10,), (20,)], "t bigint")
    right = at(spark, [(19, None), (5, 1.0)], "t bigint, v double")
    assert column(asof_nearest(left, right, "t", **layout), "v", "t") == [1.0, None]
    assert column(asof_nearest(left, right.filter("false"), "t", **layout), "v", "t") == [None, None]


def test_asof_null_key_raises(spark):
    left = at(spark, [(None,)], "t bigint")
    right = at(spark, [(1, 1.0)], "t bigint, v double")
    with pytest.raises(Exception, match="as-of key t is NULL"):
        asof_nearest(left, right, "t", layout="whole").collect()


@pytest.mark.parametrize("layout", LAYOUTS)
def test_fill_order_and_all_missing(spark, layout):
    gaps = [None, None, 3.0, None, 0.5, None, None, None, None, None, None]
    out = fill_and_clip(timeline(spark, gaps, **layout), {"x": (9.0, 1.0)})
    assert column(out.df, "x") == [3.0, 3.0, 3.0, 3.0] + [1.0] * 7
    out = fill_and_clip(timeline(spark, [None] * 6, **layout), {"x": (0.5, 1.0)})
    assert column(out.df, "x") == [1.0] * 6


def test_single_row_variance(spark):
    tl = timeline(spark, [2.0])
    assert column(rolling_var(tl, "x", out="v").df, "v") == [0.0]
    assert column(rolling_log_std(tl, "x", out="v").df, "v") == [0.0]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_horizon_head_tail_short(spark, layout):
    three = {"h": 3}
    out = horizon_peaks(timeline(spark, [9.0, 1, 2, 3, 4, 5], **layout), "x", three, "p")
    assert column(out.df, "p_h") == [3, 4, 5, 5, 5, 5]
    out = horizon_peaks(timeline(spark, [1.0, 2, 3], **layout), "x", three, "p")
    assert column(out.df, "p_h") == [0, 0, 0]
    out = horizon_peaks(timeline(spark, [9.0, 1, 2, 3, 4, 5], **layout), "x", three, "p", strict_reference=False)
    assert column(out.df, "p_h") == [3, 4, 5, 5, 5, 5]
    out = horizon_peaks(timeline(spark, [1.0, 9, 2, 3], **layout), "x", three, "p", strict_reference=False)
    assert column(out.df, "p_h") == [9, 3, 3, 3]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("steps", [1, 2, 7, 16, 40])
def test_horizon_equals_definition(spark, layout, steps):
    layout = dict(layout, **({"chunk_rows": 45} if layout["layout"] == "chunked" else {}))
    values = [float((i * 37) % 101) for i in range(97)]
    out = column(horizon_peaks(timeline(spark, values, **layout), "x", {"h": steps}, "p").df, "p_h")
    n, last, expected = len(values), 0.0, []
    for i in range(n):
        seen = [values[j] for j in range(max(i + 1, steps), min(i + steps, n - 1) + 1)]
        last = max(seen) if seen else last
        expected.append(last)
    assert out == expected


def test_long_horizon_needs_wide_chunks(spark):
    with pytest.raises(ValueError, match="chunk_rows"):
        horizon_peaks(timeline(spark, [1.0] * 9, **LAYOUTS[1]), "x", {"h": 5})


@pytest.mark.parametrize("layout", LAYOUTS)
def test_kernel_reproduces_cubic(spark, layout):
    layout = dict(layout, **({"chunk_rows": 12} if layout["layout"] == "chunked" else {}))
    out = poly_filter(timeline(spark, [float(i**3) for i in range(30)], **layout), {"x": "k"}).df.orderBy("id").collect()
    for i, r in enumerate(out):
        assert r["k_smooth"] == pytest.approx(i**3, abs=1e-7)
        assert r["k_vel"] == pytest.approx(3 * i * i, abs=1e-7)
        assert r["k_accel"] == pytest.approx(6 * i, abs=1e-7)


def test_kernel_short_series(spark):
    out = poly_filter(timeline(spark, [float(i) for i in range(10)]), {"x": "k"}).df
    assert column(out, "k_smooth") == [float(i) for i in range(10)]
    assert column(out, "k_vel") == column(out, "k_accel") == [0.0] * 10


def test_class_bounds(spark):
    flux = [1e-6, 1e-5, 1e-4, math.nextafter(1e-6, 0), math.nextafter(1e-5, 0), math.nextafter(1e-4, 0), None]
    df = series(spark, flux).withColumn("c", classify.flux_class(F.col("x")))
    assert column(df, "c") == [1, 2, 3, 0, 1, 2, 0]


def test_decision_ladder(spark):
    rows = [(0, .5, .1, .2, .2), (1, .6, .1, .2, .1), (2, .6, .3, .05, .05), (3, .8, .1, .05, .05)]
    df = spark.createDataFrame(rows, "id int, p0 double, p1 double, p2 double, p3 double")
    assert column(df.withColumn("c", classify.decide(F.col("p1"), F.col("p2"), F.col("p3"))), "c") == [3, 2, 1, 0]


def test_rewards(spark):
    pairs = [(3, 3), (3, 2), (2, 1), (2, 3), (1, 0), (1, 2), (0, 0), (0, 1)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, t int, p int")
    value = classify.reward(F.col("t"), F.col("p"))
    assert column(df.withColumn("r", value), "r") == [5, -20, -8, -.5, -.3, -.5, .1, -.5]
    assert column(df.withColumn("r", classify.reward_label(value)), "r")[:3] == ["X-CLASS CORRECT", "MISSED X-CLASS", "MISSED M-CLASS"]


def test_finite_and_probabilities(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(0, nan, 1.0), (1, inf, 3.0), (2, -inf, 0.0), (3, None, 0.0)], "id int, a double, b double")
    assert column(df.withColumn("f", numeric.finite(F.col("a"))), "f") == [0.0, 1e5, -1e5, 0.0]
    p = numeric.repair_probabilities([F.col("a"), F.col("b")])
    assert column(df.withColumn("f", p[0]), "f") == [0.0, 0.25, 0.5, 0.5]


def predictions(spark, pairs, probs=(0.25, 0.25, 0.25, 0.25), latency=0.2):
    rows = [("a", i, t, p, list(probs), latency) for i, (t, p) in enumerate(pairs)]
    return spark.createDataFrame(rows, "series string, id bigint, y_true int, y_pred int, probs array<double>, latency_ms double")


def test_precision_of_unpredicted_class(spark):
    log = predictions(spark, [(1, 0)] * 5 + [(0, 0)] * 5)
    r = metrics.skill_report(log, ["series"], ["id"]).first()
    assert (r["precision"], r["recall"], r["tss"]) == (0.75, 0.5, 0.0)
    assert r["online_loss"] == pytest.approx(math.log(4), abs=1e-4)
    assert r["avg_latency_ms"] == 0.2


def test_few_predictions(spark):
    r = metrics.skill_report(predictions(spark, [(0, 1)] * 9), ["series"], ["id"]).first()
    assert tuple(r)[1:] == (1.0, 1.0, 1.0, 1.0, 0.45, 0.01)


def test_loss_falls_back_with_one_class(spark):
    r = metrics.skill_report(predictions(spark, [(1, 1)] * 12), ["series"], ["id"]).first()
    assert r["online_loss"] == 0.01 and r["tss"] == 1.0


@pytest.mark.parametrize("layout", LAYOUTS)
def test_rolling_skill_ends_at_report(spark, layout):
    pairs = [((i * 7) % 4, (i * 5 + i // 3) % 4) for i in range(60)]
    log = predictions(spark, pairs, probs=(0.4, 0.3, 0.2, 0.1))
    tl = build_timeline(log, ["series"], ["id"], **layout)
    rolling = metrics.rolling_skill(tl, rows=25, latency_rows=10).df.orderBy("id").collect()
    report = metrics.skill_report(log, ["series"], ["id"], rows=25, latency_rows=10).first()
    assert all(rolling[-1][m] == report[m] for m in metrics.START)
    assert rolling[8]["precision"] == 1.0 and rolling[8]["online_loss"] == 0.01


@pytest.mark.parametrize("layout", LAYOUTS)
def test_events_open_at_end_and_first_peak(spark, layout):
    flux = [1e-7, 2e-6, 2e-5, 1e-6, 1e-7, 3e-6, 3e-6, 1e-7, 1e-7, 1e-6, 5e-5, 5e-5, 2e-6]
    out = flare_events(timeline(spark, flux, **layout), "x").orderBy("start").collect()
    minute = [(r["start"].minute, r["peak_time"].minute, r["end"].minute, r["samples"], r["type"]) for r in out]
    assert minute == [(1, 2, 3, 3, "M-CLASS"), (5, 5, 6, 2, "C-CLASS"), (9, 10, 12, 4, "M-CLASS")]
    assert out[0]["duration_s"] == 120
    assert [r["start"].minute for r in latest(flare_events(timeline(spark, flux, **layout), "x"), 2).collect()] == [9, 5]


def test_one_event_across_many_chunks(spark):
    out = flare_events(timeline(spark, [2e-6] * 41, **LAYOUTS[1]), "x").collect()
    assert len(out) == 1 and out[0]["samples"] == 41


def test_history_and_pages(spark):
    df = series(spark, [1e-7 * (i + 1) for i in range(120)]).selectExpr(
        "id AS rn", "timestamp", "x AS GOES_LONG_FLUX", "x / 10 AS GOES_SHORT_FLUX")
    assert serving.history_slice(df, 0).count() == 1
    assert serving.history_slice(df, 100).count() == 81
    history = serving.history_slice(df, 100)
    assert column(serving.page(history, 8), "rn", "rn") == [100]
    assert column(serving.page(history, 0), "rn", "rn") == list(range(20, 30))
    assert serving.page_count(history).first()["pages"] == 9
    assert history.first()["time"] == "01/01 00:20"


def test_insights(spark):
    df = series(spark, [1e-7, 3e-5, 3e-5, 2e-6]).selectExpr("timestamp", "x AS GOES_LONG_FLUX")
    r = insight_report(df).first()
    assert r["peak_timestamp"].minute == 1
    assert (r["c_class_spikes"], r["m_class_spikes"], r["x_class_spikes"], r["total_flares_7d"]) == (1, 2, 0, 3)
    assert r["radio_blackout_scale"] == "R1 (Minor Blackout - M3.0)"
    assert r["max_flux_growth_rate"] == 1.2e-6 and r["peak_flux_text"] == "3.00e-05 W/m²"
    assert r["astrophysical_diagnosis"].startswith("High")
    assert insight_report(df.filter("false")).count() == 0


def test_radio_ladder(spark):
    flux = [3e-3, 1e-3, 1.8e-4, 5e-5, 1e-5, 1e-6, 1e-7]
    out = column(series(spark, flux).withColumn("s", classify.radio_blackout(F.col("x"))), "s")
    assert [s[:2] for s in out] == ["R5", "R4", "R3", "R2", "R1", "R0", "R0"]
    assert out[2].endswith("X1.8)") and out[3].endswith("M5.0)")


def test_event_sync_one_to_one(spark):
    soft = spark.sql("SELECT 'a' AS series, timestamp_seconds(s) AS start, timestamp_seconds(p) AS peak_time FROM VALUES (100, 200), (300, 400), (500, 600) AS t(s, p)")
    hard = spark.sql("SELECT 'a' AS series, timestamp_seconds(p) AS peak_time FROM VALUES (90), (120), (180), (250), (400), (601) AS t(p)")
    out = event_sync(soft, hard, ["series"], layout="whole").orderBy("soft_start").collect()
    assert [(r["soft_start"].timestamp() % 1000, r["hard_peak"].timestamp() % 1000) for r in out] == [(100, 180), (300, 400)]


def test_catalog_slack(spark):
    found = spark.sql("SELECT 'a' AS series, timestamp_seconds(s) AS start, timestamp_seconds(e) AS end FROM VALUES (1000, 1200), (5000, 5100) AS t(s, e)")
    catalog = spark.sql("SELECT 'a' AS series, c AS catalog_id, timestamp_seconds(p) AS peak_ts FROM VALUES (1, 1100), (2, 1250), (3, 4960), (4, 3000), (5, 99999999) AS t(c, p)")
    cover = spark.sql("SELECT 'a' AS series, b AS bucket FROM VALUES (0L), (1L) AS t(b)")
    out = match_catalog(catalog, found, cover, ["series"], slack=60, layout="whole")
    assert {r["catalog_id"]: r["detected"] for r in out.collect()} == {1: True, 2: True, 3: True, 4: False}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_roc_ties_move_together(spark, layout):
    rows = [(0.9, True), (0.8, False), (0.8, True), (0.8, True), (0.1, False), (0.1, False)]
    best = evaluation.roc_sweep(spark.createDataFrame(rows, "p double, t boolean"), "p", "t", **layout).first()
    assert (best["threshold"], best["tp"], best["fp"]) == (0.8, 3, 1)
    assert best["tss"] == pytest.approx(1 - 1 / 3)


def test_time_frames_equal_row_frames_without_gaps(spark):
    rows = series(spark, [1.0 + (i * 7) % 5 for i in range(400)])
    tl = build_timeline(rows, ["series"], ["timestamp", "id"])
    for by_rows, by_time in (
        (rolling_var(tl, "x", 5, out="v").df, rolling_var_by_time(rows, "x", ["series"], "timestamp", 4, "v")),
        (rolling_log_std(tl, "x", 10, out="v").df, rolling_log_std_by_time(rows, "x", ["series"], "timestamp", 9, "v")),
    ):
        assert column(by_time, "v") == pytest.approx(column(by_rows, "v"))
