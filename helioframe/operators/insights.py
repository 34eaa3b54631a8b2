"""One-row reports over a feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.functions.classify import diagnosis, radio_blackout
from helioframe.functions.display import clock_part, full_time, scientific
from helioframe.schema import FLUX_CUTS, LONG, TIME

DEFAULT_GROWTH = 1.2e-6


def class_count_columns(flux: Column) -> dict[str, Column]:
    """Samples per class, not events."""
    c, m, x = FLUX_CUTS
    return {
        "c_class_spikes": F.count_if((flux >= c) & (flux < m)),
        "m_class_spikes": F.count_if((flux >= m) & (flux < x)),
        "x_class_spikes": F.count_if(flux >= x),
    }


def first_peak_time(flux: Column, ts: Column) -> Column:
    """Time of the first row of the maximum."""
    return F.min_by(ts, F.struct(-flux, ts))


def class_counts(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    counts = class_count_columns(F.col(LONG))
    out = df.groupBy(*by).agg(*[c.alias(n) for n, c in counts.items()])
    return out.withColumn("total_flares_7d", sum((F.col(n) for n in counts), F.lit(0)))


def insight_aggregates(df: DataFrame) -> dict[str, Column]:
    flux = F.col(LONG)
    growth = F.max("goes_long_vel") if "goes_long_vel" in df.columns else F.lit(DEFAULT_GROWTH)
    return {
        "peak_flux": F.max(flux),
        "peak_timestamp": first_peak_time(flux, F.col(TIME)),
        **class_count_columns(flux),
        "max_flux_growth_rate": growth,
    }


def insight_texts() -> dict[str, Column]:
    m, x = F.col("m_class_spikes"), F.col("x_class_spikes")
    return {
        "total_flares_7d": F.col("c_class_spikes") + m + x,
        "peak_flux_text": scientific(F.col("peak_flux"), "W/m²"),
        "peak_timestamp_text": full_time(F.col("peak_timestamp")),
        "peak_clock": clock_part(F.col("peak_timestamp")),
        "radio_blackout_scale": radio_blackout(F.col("peak_flux")),
        "max_flux_growth_rate_text": scientific(F.col("max_flux_growth_rate"), "W/m²/min"),
        "astrophysical_diagnosis": diagnosis(m, x),
    }


def insight_report(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Peaks, counts, growth and texts in one aggregation; no row for an empty table."""
    report = df.groupBy(*by).agg(*[c.alias(n) for n, c in insight_aggregates(df).items()])
    return report.filter(F.col("peak_flux").isNotNull()).withColumns(insight_texts())


def load_summary(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.min(TIME).alias("first_ts"), F.max(TIME).alias("last_ts")
    )
