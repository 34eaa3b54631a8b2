"""Saving and loading fitted models."""

from __future__ import annotations

import datetime as dt

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.operators.scoring import Head, LinearModel, Scaler
from helioframe.schema import HORIZONS


def coefficient_table(spark: SparkSession, model: LinearModel) -> DataFrame:
    """``(head, class, feature, weight)``; the bias is the feature ``(bias)``."""
    rows = [
        (name, c, f, float(w))
        for name, head in model.heads.items()
        for c, (weights, bias) in enumerate(zip(head.coef, head.intercept, strict=True))
        for f, w in [*zip(model.features, weights, strict=True), ("(bias)", bias)]
    ]
    return spark.createDataFrame(rows, "head string, class int, feature string, weight double")


def save_model(spark: SparkSession, model: LinearModel, path: str, name: str = "multi-horizon linear flare model") -> None:
    """Coefficients and scaler as Parquet, metadata as one JSON record."""
    coefficient_table(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{path}/coefficients")
    stats = [(f, model.scaler.mean[f], model.scaler.std[f]) for f in model.features]
    spark.createDataFrame(stats, "feature string, mean double, std double").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/scaler")
    meta = [(name, list(model.features), [h for h in model.heads if h in HORIZONS], dt.datetime.now(dt.UTC).strftime("%Y-%m-%d %H:%M:%S"))]
    spark.createDataFrame(
        meta, "model_name string, feature_cols array<string>, horizons array<string>, trained_timestamp string"
    ).coalesce(1).write.mode("overwrite").json(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> LinearModel | None:
    """The saved model, or None when there is none or it cannot be read: start afresh then."""
    try:
        meta = spark.read.json(f"{path}/config").first()
        coefs = spark.read.parquet(f"{path}/coefficients").collect()   # a few hundred lines
        stats = spark.read.parquet(f"{path}/scaler").collect()
        return _model(meta, coefs, stats)
    except (PySparkException, Py4JJavaError, KeyError, TypeError, ValueError):
        return None


def _model(meta, coefs, stats) -> LinearModel:
    features = tuple(meta["feature_cols"])
    weight = {(r["head"], r["class"], r["feature"]): r["weight"] for r in coefs}
    classes = sorted({c for _, c, _ in weight})
    present = {h for h, _, _ in weight}
    heads = {
        h: Head(
            tuple(tuple(weight[h, c, f] for f in features) for c in classes),
            tuple(weight[h, c, "(bias)"] for c in classes),
        )
        for h in ("now", *HORIZONS) if h in present
    }
    scaler = Scaler({r["feature"]: r["mean"] for r in stats}, {r["feature"]: r["std"] for r in stats})
    return LinearModel(scaler, heads, features)


def config_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/config").select(F.to_json(F.struct("*")).alias("config"))
