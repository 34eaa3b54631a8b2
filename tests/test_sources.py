import json

import pytest
from pyspark.sql import functions as F

from helioframe.operators.scoring import HEADS, Head, LinearModel, Scaler
from helioframe.schema import FEATURES, RAW_COLUMNS
from helioframe.session import persist_table, shared_dir
from helioframe.sources import feed, models, store


def land(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(records))


def record(i, band="0.1-0.8nm", **more):
    return {"energy": band, "flux": i * 1e-7, "time_tag": f"2024-05-01T00:{i:02d}:00Z", "satellite": 16, **more}


def test_array_files(spark, tmp_path):
    land(tmp_path / "in", "a.json", [record(i) for i in range(3)])
    land(tmp_path / "in", "b.json", [record(i, "0.05-0.4nm", flux=None) for i in range(2)])
    rows = feed.read_feed(spark, str(tmp_path / "in"))
    assert rows.columns == ["energy", "flux", "time_tag"]
    long, short = feed.split_channels(rows)
    assert (long.count(), short.count()) == (3, 2)
    assert rows.select(feed.parse_time(F.col("time_tag")).alias("t")).distinct().count() == 3


def test_missing_field_raises(spark, tmp_path):
    land(tmp_path / "in", "a.json", [{"energy": "x", "time_tag": "2024-01-01T00:00:00Z"}])
    with pytest.raises(ValueError, match="flux"):
        feed.read_feed(spark, str(tmp_path / "in"))


@pytest.mark.parametrize("text", ["yesterday", None])
def test_bad_time_raises(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(feed.parse_time(F.col("t")))
    with pytest.raises(Exception, match="time_tag"):
        df.collect()


def test_fallback_takes_first_large_feed(spark):
    sizes = {0: 50, 1: 51, 2: 500}
    rows = spark.createDataFrame([(p, i) for p, n in sizes.items() for i in range(n)], "priority int, i int")
    assert {r["priority"] for r in feed.pick_feed(rows).collect()} == {1}
    assert feed.pick_feed(rows.filter("priority = 0")).count() == 0
    with pytest.raises(ValueError, match="51 rows"):
        feed.require_rows(feed.pick_feed(rows))


def test_tables(spark, tmp_path):
    df = spark.range(100).selectExpr("'a' AS series", "timestamp_seconds(id * 3600) AS timestamp", *[f"double(id) AS {c}" for c in RAW_COLUMNS[1:]])
    path = str(tmp_path / "t")
    store.write_table(df, path)
    back = store.read_table(spark, path)
    assert sorted(back.select(df.columns).collect()) == sorted(df.collect())
    day = store.read_partitions(spark, path).filter("day = date'1970-01-02'")
    assert day.count() == 24
    assert "day" in day._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_model_roundtrip(spark, tmp_path):
    model = LinearModel(
        Scaler({f: 0.5 for f in FEATURES}, {f: 2.0 for f in FEATURES}),
        {h: Head(tuple(tuple(0.1 * c + f for f in range(13)) for c in range(4)), (0.0, 1.0, 2.0, 3.0)) for h in HEADS},
    )
    path = str(tmp_path / "m")
    models.save_model(spark, model, path)
    assert models.load_model(spark, path) == model
    config = json.loads(models.config_json(spark, path).first()["config"])
    assert config["feature_cols"] == list(FEATURES) and config["horizons"] == ["15m", "30m", "1h", "2h", "4h"]
    assert models.load_model(spark, str(tmp_path / "nothing")) is None


def test_persisted_table_keeps_schema(spark):
    df = spark.range(5).selectExpr("id", "struct(id AS a, array(1.5D) AS b) AS s", "CAST(NULL AS DOUBLE) AS n")
    back = persist_table(df, "probe")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert back.inputFiles()[0].replace("file://", "").startswith(shared_dir(spark))
