"""Two-instrument work: outer join, detectors, event matching and catalogue recall.

Definitions are this package's own; only their names come from published descriptions.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.api.indexers import BaseIndexer
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioframe.operators.asof import asof_nearest, micros

# workers need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# one frame in so many is copied to the next bucket; a median task holds this many frames of one series, and one more
FRAMES_PER_BUCKET = 4


def outer_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys), "full_outer")


def _known_micros(ts: str) -> Column:
    """A NULL time has no place in a frame and raises."""
    return micros(F.coalesce(F.col(ts), F.raise_error(F.lit(f"time column {ts} is NULL"))))


def time_variance(df: DataFrame, value: str | Column, by: Sequence[str], ts: str, seconds: float, out: str) -> DataFrame:
    """Sample variance over the trailing ``seconds`` of time, rows of the same time included; fewer than two values give 0.

    Series are cut into time buckets of one frame. A frame is then what its own bucket holds up to the row, and what the
    bucket before holds from the frame's start on: a copy of each row, moved on by a frame, stands in the next bucket
    where the frame that leaves it behind ends. Both parts only grow along the bucket, one upwards, one downwards, so a
    row costs the same however many rows a frame has, and nothing is ever subtracted from a running sum.
    """
    frame = int(seconds * 1_000_000)
    own = F.col("_ahead") == 0
    spread = df.withColumn("_us", _known_micros(ts)).withColumn("_x", (F.col(value) if isinstance(value, str) else value).cast("double"))
    spread = spread.withColumn("_ahead", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns(
        {"_bucket": F.floor(F.col("_us") / frame) + F.col("_ahead"), "_at": F.col("_us") + F.col("_ahead") * frame}
        | {c: F.when(own, F.col(c)) for c in df.columns if c not in by}).drop("_us")
    place = Window.partitionBy(*by, "_bucket")
    grown = {"_a": (own, F.col("_at")), "_b": (~own, F.desc("_at"))}
    parts = {}
    for name, (which, order) in grown.items():
        w, x = place.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow), F.when(which, F.col("_x"))
        parts |= {f"{name}_n": F.count(x).over(w), f"{name}_mean": F.avg(x).over(w), f"{name}_var": F.var_pop(x).over(w)}
    done = spread.withColumns(parts).filter(own)
    n = F.col("_a_n") + F.col("_b_n")
    between = F.pow(F.col("_a_mean") - F.col("_b_mean"), F.lit(2.0)) * F.col("_a_n") * F.col("_b_n") / n
    squares = sum((F.coalesce(F.col(f"{k}_var") * F.col(f"{k}_n"), F.lit(0.0)) for k in grown), F.coalesce(between, F.lit(0.0)))
    return done.withColumn(out, F.when(n > 1, squares / (n - 1)).otherwise(F.lit(0.0))).drop("_ahead", "_bucket", "_at", "_x", *parts)


class _Bounds(BaseIndexer):
    """Frames given by the positions of their first row and of the row after their last."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.start, self.end


def frame_medians(us: np.ndarray, x: np.ndarray, known: np.ndarray, frame: int) -> tuple[np.ndarray, np.ndarray]:
    """Median of the known values within ``frame`` before each of the ascending times, and whether there is one.

    Ranks instead of values go through the moving order statistics, so that NaN (the largest) and infinities keep their place.
    """
    distinct, rank = np.unique(x[known], return_inverse=True)
    ranks = np.full(len(x), np.nan)
    ranks[known] = rank
    bounds = _Bounds(start=np.searchsorted(us, us - frame, "left"), end=np.searchsorted(us, us, "right"))
    frames = pd.Series(ranks).rolling(bounds, min_periods=1)
    low, high = (frames.quantile(0.5, interpolation=side).to_numpy() for side in ("lower", "higher"))
    some, median = ~np.isnan(low), np.full(len(x), np.nan)
    median[some] = (distinct[low[some].astype("int64")] + distinct[high[some].astype("int64")]) / 2
    return median, some


def time_median(df: DataFrame, col: str, by: Sequence[str], ts: str, seconds: float, out: str) -> DataFrame:
    """Exact median over the trailing ``seconds`` of time, rows of the same time included; NULL where no value is known.

    Series are cut into time buckets of a few frames; a row within one frame of the next bucket is copied there. A task
    moves one ordered list along its bucket, so a row costs the logarithm of a frame's rows.
    """
    frame = int(seconds * 1_000_000)
    width = frame * FRAMES_PER_BUCKET
    home = F.floor(F.col("_us") / width)
    copies = F.sequence(home, F.floor((F.col("_us") + frame) / width))
    spread = df.withColumn("_us", _known_micros(ts)).withColumn("_x", F.col(col).cast("double")).withColumn("_home", home).withColumn("_bucket", F.explode(copies))
    names = df.columns

    def step(rows: pa.Table) -> pa.Table:
        rows = rows.take(np.argsort(rows["_us"].to_numpy(), kind="stable"))
        known = rows["_x"].is_valid().to_numpy()
        median, some = frame_medians(rows["_us"].to_numpy(), rows["_x"].fill_null(0.0).to_numpy(), known, frame)
        mine = rows["_home"].to_numpy() == rows["_bucket"].to_numpy()
        return rows.select(names).append_column(out, pa.array(median, mask=~some)).filter(pa.array(mine))

    return spread.groupBy(*by, "_bucket").applyInArrow(step, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def median_3sigma(
    df: DataFrame, col: str, by: Sequence[str], ts: str, minutes: float = 15, sigmas: float = 3.0,
) -> DataFrame:
    """Exact trailing median and deviation, and whether the value exceeds median + 3 deviations."""
    out = time_variance(df, col, by, ts, minutes * 60, "sigma").withColumn("sigma", F.sqrt("sigma"))
    out = time_median(out, col, by, ts, minutes * 60, "median")
    return out.withColumn("is_outlier", F.col(col) > F.col("median") + F.lit(sigmas) * F.col("sigma"))


def pulsation_variance(
    df: DataFrame, col: str, by: Sequence[str], ts: str, seconds: float = 20, threshold: float = 0.0,
) -> DataFrame:
    out = time_variance(df, col, by, ts, seconds, "variance")
    return out.withColumn("is_burst", F.col("variance") > threshold)


def flag_events(df: DataFrame, flag: str, col: str, by: Sequence[str], ts: str, gap_minutes: float) -> DataFrame:
    """Events of a detector: flagged rows of a series that follow each other within ``gap_minutes``.

    Rows of one bucket as wide as the gap belong together anyway: they are reduced before the shuffle, and session
    windows as long as each bucket's own span plus the gap join what is left. The peak is the first row of the maximum.
    """
    gap = int(gap_minutes * 60_000_000)
    first_peak = F.struct(-F.col(col), F.col(ts))
    flagged = df.filter(F.col(flag)).withColumn("_bucket", F.floor(micros(F.col(ts)) / gap))
    parts = flagged.groupBy(*by, "_bucket").agg(
        F.min(ts).alias("_start"), F.max(ts).alias("_end"), F.max(col).alias("_peak"), F.min_by(ts, first_peak).alias("_at"), F.count(F.lit(1)).alias("_n"))
    span = ((micros(F.col("_end")) - micros(F.col("_start")) + gap) / 1e6).cast("decimal(18,6)")
    events = parts.groupBy(*by, F.session_window("_start", F.make_interval(secs=span)).alias("_session")).agg(
        F.min("_start").alias("start"), F.max("_end").alias("end"), F.max("_peak").alias("peak_val"),
        F.min_by("_at", F.struct(-F.col("_peak"), F.col("_at"))).alias("peak_time"), F.sum("_n").alias("samples"))
    return events.drop("_session")


def event_sync(soft: DataFrame, hard: DataFrame, by: Sequence[str], **layout) -> DataFrame:
    """Pairs of a soft event and the hard peak inside [soft start, soft peak] nearest to its peak.

    Soft events of a series do not overlap, so a hard peak can only belong to the last one that
    started before it: an as-of join, not a range join. Each side appears at most once.
    """
    starts = soft.select(*by, F.col("start").alias("_t"), F.col("start").alias("soft_start"), F.col("peak_time").alias("soft_peak"))
    peaks = hard.select(*by, F.col("peak_time").alias("_t"), F.col("peak_time").alias("hard_peak"))
    placed = asof_nearest(peaks, starts, "_t", by=by, direction="backward", **layout)
    inside = placed.filter(F.col("hard_peak") <= F.col("soft_peak"))
    return inside.groupBy(*by, "soft_start", "soft_peak").agg(F.max("hard_peak").alias("hard_peak"))


def coverage_buckets(telemetry: DataFrame, by: Sequence[str], ts: str, minutes: int = 60) -> DataFrame:
    """Time buckets in which the instrument delivered at least one row."""
    return telemetry.select(*by, _bucket(F.col(ts), minutes).alias("bucket")).distinct()


def _bucket(ts: Column, minutes: int) -> Column:
    return F.floor(micros(ts) / (minutes * 60_000_000))


def match_catalog(
    catalog: DataFrame, events: DataFrame, coverage: DataFrame, by: Sequence[str],
    minutes: int = 60, slack: float = 0.0, **layout,
) -> DataFrame:
    """Catalogue events while the instrument was online, each with ``detected``.

    Detected: its peak lies in a found event widened by ``slack`` seconds. Found events do not
    overlap, so the last one starting at or before the peak and the next one decide.
    """
    online = catalog.withColumn("bucket", _bucket(F.col("peak_ts"), minutes)).join(
        coverage, [*by, "bucket"], "left_semi").drop("bucket")
    online = online.withColumn("_t", F.col("peak_ts"))
    found = events.select(*by, F.col("start").alias("_t"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    room = int(slack * 1e6)
    behind = asof_nearest(online, found, "_t", by=by, left_tie="catalog_id", direction="backward", **layout)
    hit = F.coalesce(micros(F.col("peak_ts")) <= micros(F.col("_end")) + room, F.lit(False))
    out = behind.withColumn("detected", hit).drop("_start", "_end")
    if room:
        ahead = asof_nearest(out, found, "_t", by=by, left_tie="catalog_id", direction="forward", **layout)
        near = F.coalesce(micros(F.col("_start")) - room <= micros(F.col("peak_ts")), F.lit(False))
        out = ahead.withColumn("detected", F.col("detected") | near).drop("_start", "_end")
    return out.drop("_t")


def catalog_recall(matched: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts = matched.groupBy(*by).agg(F.count(F.lit(1)).alias("online"), F.count_if("detected").alias("matched"))
    return counts.withColumn("recall", F.when(F.col("online") > 0, F.col("matched") / F.col("online")))
