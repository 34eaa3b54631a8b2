"""Holdout split, per-class skill and threshold sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.operators.timeline import LEN, RN, Timeline, build_timeline


def chrono_split(tl: Timeline, train_share: float = 0.8, out: str = "is_train") -> Timeline:
    """True for the first ``train_share`` of every series."""
    return tl.with_column(out, F.col(RN) < F.floor(F.col(LEN) * F.lit(train_share)))


def tss_columns(truth, called) -> dict:
    return {
        "tp": F.count_if(truth & called), "pos": F.count_if(truth),
        "fp": F.count_if(~truth & called), "neg": F.count_if(~truth),
    }


def _skill():
    tpr = F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(1.0)
    fpr = F.when(F.col("neg") > 0, F.col("fp") / F.col("neg")).otherwise(0.0)
    return tpr - fpr


def tss_by_class(df: DataFrame, keys: Sequence[str], classes: Sequence[int] = (2, 3)) -> DataFrame:
    """One-vs-rest TPR - FPR per group and class; no positives count as hit, no negatives as quiet."""
    kinds = F.array(*[
        F.struct(F.lit(c).alias("class"), (F.col("y_true") == c).alias("_t"), (F.col("y_pred") == c).alias("_p"))
        for c in classes
    ])
    flags = df.select(*keys, F.inline(kinds))
    counts = flags.groupBy(*keys, "class").agg(*[c.alias(n) for n, c in tss_columns(F.col("_t"), F.col("_p")).items()])
    return counts.withColumn("tss", _skill())


def flare_tss(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Any flare against none, clipped to 0..1."""
    counts = df.groupBy(*keys).agg(
        *[c.alias(n) for n, c in tss_columns(F.col("y_true") >= 1, F.col("y_pred") >= 1).items()]
    )
    return counts.select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(1.0), _skill())).alias("tss"))


def roc_points(df: DataFrame, prob: str, truth: str, by: Sequence[str] = (), **layout) -> Timeline:
    """TPR and FPR when everything at or above each distinct score is called positive.

    Equal scores are merged first, then running counts go down the scores, cut into chunks when
    there are too many distinct ones for a task.
    """
    per_score = df.groupBy(*by, F.col(prob).alias("threshold")).agg(
        F.count_if(F.col(truth)).alias("_pos"), F.count_if(~F.col(truth)).alias("_neg"),
    ).withColumn("_down", -F.col("threshold"))
    tl = build_timeline(per_score, by, ["_down"], **layout)
    tl = tl.carry(
        sums={"tp": F.col("_pos"), "fp": F.col("_neg")},
        totals={"pos": F.col("_pos"), "neg": F.col("_neg")},
    )
    tl = tl.with_columns({"tss": _skill()})
    return tl.having(tl.df.drop("_pos", "_neg", "_down"))


def roc_sweep(df: DataFrame, prob: str, truth: str, by: Sequence[str] = (), **layout) -> DataFrame:
    """The threshold with the greatest TPR - FPR; among equals the highest."""
    points = roc_points(df, prob, truth, by, **layout)
    best = F.struct(F.col("tss"), F.col("threshold"))
    return points.df.groupBy(*points.by).agg(
        F.max_by(F.struct("threshold", "tp", "fp", "pos", "neg", "tss"), best).alias("best")
    ).select(*points.by, "best.*")
