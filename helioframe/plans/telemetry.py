"""Feed to telemetry to features to predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.functions.classify import flux_class, risk_label
from helioframe.functions.numeric import hardness
from helioframe.operators.asof import asof_timeline
from helioframe.operators.fill import clean_nan, count_proxies, fill_channels
from helioframe.operators.horizon import horizon_targets
from helioframe.operators.kernel import poly_filter
from helioframe.operators.metrics import cumulative_reward
from helioframe.operators.rolling import rolling_log_std, rolling_var
from helioframe.operators.scoring import LinearModel, score
from helioframe.operators.timeline import LEN, RN, Timeline, build_timeline
from helioframe.schema import FEATURE_COLUMNS, HORIZONS, LONG, SHORT, TIME
from helioframe.sources.feed import split_channels

KERNEL_REACH, HORIZON_REACH = 10, max(HORIZONS.values())


def build_telemetry(
    feed: DataFrame, by: Sequence[str] = (), tie: str | None = None, tolerance: float | None = None, **layout,
) -> Timeline:
    """Cleaned two-channel table from feed records with parsed ``time_tag``.

    One ordering serves the as-of join, both fills and the row numbers.
    """
    long, short = split_channels(feed, (*by, tie) if tie else tuple(by))
    short = short.withColumnRenamed(tie, "_t") if tie else short.withColumn("_t", F.lit(0))
    matched = asof_timeline(
        clean_nan(long, [LONG]), clean_nan(short, [SHORT]), "time_tag",
        by=by, left_tie=tie, right_tie="_t", tolerance=tolerance, **layout,
    )
    matched = matched.having(matched.df.drop("_t").withColumnRenamed("time_tag", TIME))
    filled = fill_channels(matched)
    return filled.having(count_proxies(filled.df))


def add_features(tl: Timeline) -> Timeline:
    """Kinematics, hardness, volatility, class and look-ahead targets on one halo."""
    wide = tl.spread(KERNEL_REACH, HORIZON_REACH)
    wide = (
        wide.pipe(poly_filter, {LONG: "goes_long", SHORT: "goes_short"})
        .pipe(rolling_var, LONG)
        .pipe(rolling_log_std, LONG)
        .pipe(horizon_targets, LONG)
    )
    out = wide.collapse()
    code = flux_class(F.col(LONG))
    return out.with_columns({
        "hardness_ratio": hardness(F.col(SHORT), F.col(LONG)),
        "PredictedClass": code.cast("byte"),
        "RiskLabel": risk_label(code),
        **{f"TargetClass_{h}": F.col(f"TargetClass_{h}").cast("byte") for h in HORIZONS},
    })


def feature_table(tl: Timeline, keep: Sequence[str] = ()) -> DataFrame:
    """The 26 contract columns with series key, ``rn`` and ``keep``."""
    done = add_features(tl)
    return done.df.select(*done.by, *keep, F.col(RN).alias("rn"), *FEATURE_COLUMNS)


def features_from_table(raw: DataFrame, by: Sequence[str], order: Sequence[str] = (TIME,), **layout) -> DataFrame:
    """Features of a stored raw table."""
    return feature_table(build_timeline(raw, by, order, **layout), [c for c in order if c != TIME])


def prequential(features: Timeline, model: LinearModel) -> Timeline:
    """Predict every row, then reveal its truth: the prediction log with rewards."""
    scored = features.having(score(features.df, model)).with_columns({
        "y_true": F.col("PredictedClass").cast("int"), "y_pred": F.col("pred_class"),
    })
    return cumulative_reward(scored)


def with_positions(tl: Timeline) -> DataFrame:
    return tl.df.withColumns({"rn": F.col(RN), "series_length": F.col(LEN)})


