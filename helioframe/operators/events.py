"""Flare events: maximal runs of rows at or above a flux threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.functions.classify import flux_class, risk_label
from helioframe.operators.timeline import RN, Timeline
from helioframe.schema import FLUX_CUTS, LONG, TIME


def flare_events(tl: Timeline, col: str = LONG, threshold: float = FLUX_CUTS[0], ts: str = TIME) -> DataFrame:
    """One row per run; a run still open at the end counts.

    The number of quiet rows before a row names its run, so runs may cross chunks and be of any
    length: they are only ever reduced by partial aggregation. The peak is the first row of the
    maximum, the type the highest class reached.
    """
    loud = F.coalesce(F.col(col) >= F.lit(threshold), F.lit(False))
    quiet = F.when(loud, 0).otherwise(1).cast("long")
    runs = tl.carry(sums={"_run": quiet}).df.filter(loud)
    first_peak = F.struct(-F.col(col), F.col(RN))
    events = runs.groupBy(*tl.by, "_run").agg(
        F.min(ts).alias("start"),
        F.max(ts).alias("end"),
        F.max(col).alias("peak_val"),
        F.min_by(ts, first_peak).alias("peak_time"),
        F.count(F.lit(1)).alias("samples"),
    )
    return events.drop("_run").withColumns({
        "type": risk_label(flux_class(F.col("peak_val"))),
        "duration_s": (F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 1e6,
    })


def latest(events: DataFrame, k: int = 6) -> DataFrame:
    """The newest events; of those that start together, by the other columns in their order."""
    return events.orderBy(F.desc("start"), *[c for c in events.columns if c != "start"]).limit(k)
