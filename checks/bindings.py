"""The given tables bound to the schemas of the package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.functions.classify import flux_class
from helioframe.operators.scoring import HEADS, Head, LinearModel, Scaler, fit_scaler
from helioframe.operators.timeline import Timeline, build_timeline
from helioframe.plans.telemetry import build_telemetry
from helioframe.schema import FEATURES, LONG_BAND, SHORT_BAND
from helioframe.session import prepare

BY = ["series"]
ORDER = ["ts", "event_id"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/events.parquet")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids are the long channel; some values are missing, the head among them."""
    even = F.col("event_id") % 2 == 0
    missing = (F.col("event_id") < 4) | (F.col("event_id") % 17 == 0)
    return events(spark, sf_dir).select(
        F.col("event_type").alias("series"),
        "event_id",
        F.col("ts").alias("time_tag"),
        F.when(even, LONG_BAND).otherwise(SHORT_BAND).alias("energy"),
        F.when(~missing, F.when(even, F.col("value") / 1e6).otherwise(F.col("value") / 1e7)).alias("flux"),
    )


def telemetry(spark: SparkSession, sf_dir: str, **layout) -> Timeline:
    return build_telemetry(feed(spark, sf_dir), BY, "event_id", **layout)


def unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``x = value``: numbers of ordinary size, so rounding hides nothing."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("series"), "event_id", "ts", "user_id", F.col("value").alias("x"))


def unit_timeline(spark: SparkSession, sf_dir: str, **layout) -> Timeline:
    return build_timeline(unit(spark, sf_dir), BY, ORDER, **layout)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction log: truth from the value, prediction and probabilities from other columns."""
    k = F.get_json_object("props", "$.k").cast("int")
    parts = [1 + (k + 7 * c) % 11 for c in range(4)]
    total = sum(parts[1:], parts[0])
    return events(spark, sf_dir).select(
        F.col("event_type").alias("series"), "event_id", "ts",
        flux_class(F.col("value") / 1e6).alias("y_true"),
        (F.col("user_id") % 4).cast("int").alias("y_pred"),
        F.array(*[p / total for p in parts]).alias("probs"),
        ((F.col("event_id") % 50) / 100.0).alias("latency_ms"),
    )


def prediction_timeline(spark: SparkSession, sf_dir: str, **layout) -> Timeline:
    return build_timeline(predictions(spark, sf_dir), BY, ORDER, **layout)


def weight(head: int, cls: int, feature: int) -> float:
    return (((7 * cls + 3 * feature + head) % 5) - 2) / 10.0


def bias(cls: int) -> float:
    return (cls - 1.5) / 10.0


def fixed_model(features: DataFrame) -> LinearModel:
    """Formula weights on scaler statistics of the table itself."""
    return model_with(fit_scaler(features))


def model_with(scaler: Scaler) -> LinearModel:
    return LinearModel(scaler, {
        name: Head(
            tuple(tuple(weight(h, c, f) for f in range(len(FEATURES))) for c in range(4)),
            tuple(bias(c) for c in range(4)),
        )
        for h, name in enumerate(HEADS)
    })


# rationals of the test data often lie exactly between two roundings; a fixed small shift decides them
SHIFT = 1.3e-8


def r6(col: Column | str) -> Column:
    """Six decimals without a negative zero."""
    col = (F.col(col) if isinstance(col, str) else col) + F.lit(SHIFT)
    return F.when(F.abs(col) < 5e-7, F.lit(0.0)).otherwise(F.round(col, 6))
