"""The appended store, its status next to rebuilt figures, and the saved pipeline."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from checks import bindings as b
from checks.compare import difference
from helioframe.operators import metrics, scoring
from helioframe.plans.telemetry import features_from_table
from helioframe.session import persist_table
from helioframe.sources import pipeline, positions
from helioframe.sources.positions import ScoredStore

RAW = ("series", "event_id", "timestamp", "GOES_LONG_FLUX", "GOES_SHORT_FLUX", "SoLEXS_COUNTS", "HEL1OS_COUNTS")


@pytest.fixture(scope="module")
def raw(spark):
    """Two series of one-minute rows over three days, one of them with a NULL key."""
    rows = spark.range(0, 4000).selectExpr(
        "IF(id % 3 = 0, NULL, 'a') AS series", "id AS event_id", "timestamp_seconds(1704067200 + id * 60) AS timestamp", "1e-8 * (1 + (id * 37) % 9973) AS GOES_LONG_FLUX",
        "1e-9 * (1 + (id * 11) % 997) AS GOES_SHORT_FLUX").selectExpr("*", "greatest(GOES_LONG_FLUX * 1e8, 10D) AS SoLEXS_COUNTS", "greatest(GOES_SHORT_FLUX * 1e8, 5D) AS HEL1OS_COUNTS")
    return persist_table(rows.select(*RAW), "raw")


@pytest.fixture(scope="module")
def log(spark, raw):
    features = persist_table(features_from_table(raw, b.BY, ("timestamp", "event_id")), "features")
    model = b.fixed_model(features)
    scored = positions.prediction_log(features, model).withColumn("latency_ms", (F.col("event_id") % 50) / 100)
    return persist_table(scored, "log"), model


def test_status_of_appended_days(spark, log, tmp_path):
    rows, model = log
    store = ScoredStore(str(tmp_path))
    days = ["2024-01-01", "2024-01-02", "2024-01-03"]
    for k, day in enumerate(days):
        store.append(rows.filter(F.to_date("timestamp") == day), k)
        if k == 1:
            store.append(rows.filter(F.to_date("timestamp") == day), k)     # run again
    got = store.rows(spark).select("series", "event_id", "rn", "reward")
    assert difference(got.toPandas(), rows.select("series", "event_id", "rn", "reward").toPandas()) is None

    at = 1100
    status = {r["series"]: r for r in store.status(spark, at, model, "feed").collect()}
    assert set(status) == {"a", None}
    seen = rows.filter(F.col("rn") <= at)
    total = {r[0]: r[1] for r in seen.groupBy("series").agg(F.round(F.sum("reward"), 1)).collect()}
    skill = {r["series"]: r for r in metrics.skill_report(seen, ["series"], ["rn"]).collect()}
    for key, row in status.items():
        assert (row["current_idx"], row["weight_updates"], row["stream_source"]) == (at, at + 1, "feed")
        assert row["cumulative_reward"] == pytest.approx(total[key], abs=0.11)
        assert all(row["metrics"][m] == skill[key][m] for m in positions.METRICS)
        assert len(row["weights"]) == len(row["feature_names"]) == 13 and len(row["horizons"]) == 5
    peak = rows.filter("series = 'a'").agg(F.max("GOES_LONG_FLUX")).first()[0]
    assert status["a"]["insights"]["peak_flux"] == peak and status["a"]["total_rows"] == rows.filter("series = 'a'").count()
    assert store.status(spark, 10**6).count() == 0

    plan = store.between(spark, at, at)._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(rn,{at})" in plan and f"LessThanOrEqual(rn,{at})" in plan
    assert store.between(spark, at, at).count() == 2        # one row per series

    with pytest.raises(Exception, match="does not lie behind"):
        store.append(rows.filter(F.to_date("timestamp") == days[0]), 3)


def test_pipeline_is_the_same_after_loading(spark, raw, log, tmp_path):
    model = log[1]
    steps = pipeline.prediction_pipeline(model, b.BY, ("timestamp", "event_id"))
    assert pipeline.from_json(pipeline.to_json(model)) == model
    steps.write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    names = ["series", "event_id", "pred_class", "probs"]
    ours, theirs = (p.transform(raw).select(*names, F.col("horizons.pred_class").alias("ahead")) for p in (steps, again))
    assert ours.exceptAll(theirs).count() == 0 and ours.count() == raw.count()
    direct = scoring.score(features_from_table(raw, b.BY, ("timestamp", "event_id")), model).select(*names)
    assert direct.exceptAll(theirs.select(*names)).count() == 0
