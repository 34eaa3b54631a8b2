"""Trailing windows: over rows, the default, or over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.operators.instruments import time_variance
from helioframe.operators.timeline import Timeline


def rolling_var(tl: Timeline, col: str, rows: int = 5, out: str = "long_flux_var_5m") -> Timeline:
    """Sample variance of the trailing rows; a single row gives 0."""
    def step(t: Timeline) -> Timeline:
        frame = t.window().rowsBetween(-(rows - 1), 0)
        return t.with_column(out, F.coalesce(F.var_samp(col).over(frame), F.lit(0.0)))
    return tl.bounded(rows - 1, 0, step, [col], [out])


def rolling_log_std(tl: Timeline, col: str, rows: int = 10, out: str = "log_volatility_10m") -> Timeline:
    """Sample deviation of log10 over the trailing rows; a single row gives 0."""
    def step(t: Timeline) -> Timeline:
        frame = t.window().rowsBetween(-(rows - 1), 0)
        return t.with_column(out, F.coalesce(F.stddev_samp(F.log10(col)).over(frame), F.lit(0.0)))
    return tl.bounded(rows - 1, 0, step, [col], [out])


def rolling_var_by_time(
    df: DataFrame, col: str, by: Sequence[str], ts: str, minutes: float = 5, out: str = "long_flux_var_5m",
) -> DataFrame:
    """The variance over trailing minutes instead of rows, for series with gaps in time."""
    return time_variance(df, col, by, ts, minutes * 60, out)


def rolling_log_std_by_time(
    df: DataFrame, col: str, by: Sequence[str], ts: str, minutes: float = 10, out: str = "log_volatility_10m",
) -> DataFrame:
    return time_variance(df, F.log10(col), by, ts, minutes * 60, out).withColumn(out, F.sqrt(out))
