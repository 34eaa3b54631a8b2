"""Split, fit and skill on rows the fit has not seen."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.operators.evaluation import tss_by_class
from helioframe.operators.scoring import NOW, LinearModel, score
from helioframe.operators.timeline import lookup
from helioframe.schema import HORIZONS
from helioframe.session import persist_table


def holdout_split(features: DataFrame, by: Sequence[str] = ("series",), train_share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(first ``train_share`` of every series, the rest) of a feature table with ``rn``, stored once for both."""
    lengths = features.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    table = lookup(features, lengths, by).withColumn("is_train", F.col("rn") < F.floor(F.col("_rows") * F.lit(train_share))).drop("_rows")
    table = persist_table(table, "holdout")
    return table.filter("is_train").drop("is_train"), table.filter("NOT is_train").drop("is_train")


def skill_by_horizon(rows: DataFrame, model: LinearModel, classes: Sequence[int] = (2, 3)) -> DataFrame:
    """True skill statistic of every look-ahead and class, one against the rest, over the given feature rows."""
    ahead = [h for h in HORIZONS if h in model.heads]
    pairs = [F.struct(F.lit(NOW).alias("horizon"), F.col("PredictedClass").cast("int").alias("y_true"), F.col("pred_class").alias("y_pred"))]
    pairs += [F.struct(F.lit(h).alias("horizon"), F.coalesce(F.col(f"TargetClass_{h}").cast("int"), F.lit(0)).alias("y_true"),
                       F.get("horizons", F.lit(k))["pred_class"].alias("y_pred")) for k, h in enumerate(ahead)]
    return tss_by_class(score(rows, model).select(F.inline(F.array(*pairs))), ["horizon"], classes)


def holdout_skill(
    features: DataFrame, fit: Callable[[DataFrame], LinearModel], by: Sequence[str] = ("series",), train_share: float = 0.8, classes: Sequence[int] = (2, 3),
) -> DataFrame:
    """Skill on the last part of every series of the model that ``fit`` makes of the first."""
    train, held = holdout_split(features, by, train_share)
    return skill_by_horizon(held, fit(train), classes)
