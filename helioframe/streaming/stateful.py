"""Flare events and delayed labels of an unordered stream, each series spread over many tasks.

Rows are keyed by series and time bucket, so that one series runs in as many tasks as it has open buckets.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# workers need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUN = "start timestamp, end timestamp, peak_val double, peak_time timestamp, samples bigint"
PARTIAL = f"series string, bucket bigint, closes timestamp, opens boolean, stays_open boolean, {RUN}"
EVENTS = f"series string, {RUN}"
FIELDS = ("start", "end", "peak_val", "peak_time", "samples")
HALF = "series string, has_id boolean, event_id bigint, t bigint, closes timestamp, follows boolean, peak double"
# a waiting row: where it counts or until where it looks, its own time, id and value
WAITING = np.dtype([("at", "i8"), ("t", "i8"), ("event_id", "i8"), ("x", "f8"), ("has_id", "?"), ("has_x", "?"), ("asks", "?")])

Run = tuple[int, int, float, int, int]


def close_runs(t: np.ndarray, x: np.ndarray, threshold: float, silence: int) -> list[Run]:
    """Maximal runs of loud rows in time order: start, end, peak, first time of the peak, rows.

    A quiet row or a gap of more than ``silence`` ends a run.
    """
    loud = x >= threshold
    borders = np.flatnonzero((loud[1:] != loud[:-1]) | (loud[1:] & (np.diff(t) > silence))) + 1
    runs = []
    for part in np.split(np.arange(len(t)), borders):
        if len(part) and loud[part[0]]:
            top = part[np.argmax(x[part])]
            runs.append((int(t[part[0]]), int(t[part[-1]]), float(x[top]), int(t[top]), len(part)))
    return runs


def joined(a: Run, b: Run) -> Run:
    """Two neighbouring parts of one run, the earlier first."""
    top = b if b[2] > a[2] else a
    return a[0], b[1], top[2], top[3], a[4] + b[4]


def _times(values: Any) -> np.ndarray:
    return np.asarray(values, dtype="datetime64[us]")


def _micros(column: pd.Series) -> np.ndarray:
    return column.to_numpy().astype("datetime64[us]").astype("int64")


class BucketRuns(StatefulProcessor):
    """Runs of one bucket of one series, once the watermark has passed the bucket's end.

    Rows wait in list state, in whatever order they come; a timer at the end of the bucket takes them in time order
    and drops them. Rows that come later than that are late and not counted. Every bucket gives at least one line.
    """

    def __init__(self, threshold: float, width: int, silence: int):
        self.threshold, self.width, self.silence = threshold, width, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "t bigint, id bigint, x double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        closes = (key[1] + 1) * self.width // 1000
        if timerValues.getCurrentWatermarkInMs() >= closes:
            return iter(())
        for pdf in rows:
            self.rows.appendList(list(zip(_micros(pdf["ts"]).tolist(), pdf["event_id"].tolist(), pdf["x"].tolist(), strict=True)))
        self.handle.registerTimer(closes)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = sorted(tuple(r) for r in self.rows.get())
        self.rows.clear()
        t = np.array([r[0] for r in held], dtype="int64")
        x = np.array([r[2] for r in held], dtype="float64")
        runs = close_runs(t, x, self.threshold, self.silence)
        lines: list[Run | None] = [*runs] or [None]
        first, last = bool(runs) and runs[0][0] == t[0] and bool(x[0] >= self.threshold), bool(runs) and bool(x[-1] >= self.threshold)
        n = len(lines)
        columns = {c: [None if r is None else r[k] for r in lines] for k, c in enumerate(FIELDS)}
        for c in ("start", "end", "peak_time"):
            columns[c] = _times(columns[c])
        yield pd.DataFrame({
            "series": key[0], "bucket": key[1], "closes": _times([(key[1] + 1) * self.width] * n),
            "opens": [first and k == 0 for k in range(n)], "stays_open": [last and k == n - 1 for k in range(n)], **columns})

    def close(self) -> None:
        pass


class SeriesRuns(StatefulProcessor):
    """Joins the runs of neighbouring buckets; a few lines per bucket, the open run in value state.

    A run that is open at the end of a bucket waits for the next bucket that has rows. If the series stays silent, a
    timer emits it once the watermark is more than ``silence`` behind its last row, and the state is dropped.
    """

    def __init__(self, width: int, silence: int):
        self.width, self.silence = width, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start bigint, stop bigint, peak double, peak_at bigint, samples bigint")

    def _due(self, run: Run) -> int:
        # a row within the silence may lie in a bucket that closes a width later
        return (run[1] + self.silence + self.width) // 1000 + 1

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = pd.concat(list(rows)).sort_values(["bucket", "start"], kind="stable")
        run = tuple(self.open.get()) if self.open.exists() else None
        done: list[Run] = []
        times = {c: _micros(held[c]) for c in ("start", "end", "peak_time")}
        for k, (opens, stays, peak, n) in enumerate(zip(held["opens"], held["stays_open"], held["peak_val"], held["samples"], strict=True)):
            here = None if pd.isna(n) else (int(times["start"][k]), int(times["end"][k]), float(peak), int(times["peak_time"][k]), int(n))
            if run and here and opens and here[0] - run[1] <= self.silence:
                run = joined(run, here)
            else:
                if run:
                    done.append(run)
                run = here
            if run and not stays:
                done.append(run)
                run = None
        if run:
            self.open.update(run)
            self.handle.registerTimer(self._due(run))
        else:
            self.open.clear()
        if done:
            yield self._frame(key, done)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.open.exists():
            run = tuple(self.open.get())
            if self._due(run) <= expiredTimerInfo.getExpiryTimeInMs():       # else it has grown since
                self.open.clear()
                yield self._frame(key, [run])

    def _frame(self, key: Any, runs: list[Run]) -> pd.DataFrame:
        columns = {c: [r[k] for r in runs] for k, c in enumerate(FIELDS)}
        for c in ("start", "end", "peak_time"):
            columns[c] = _times(columns[c])
        return pd.DataFrame({"series": key[0], **columns})

    def close(self) -> None:
        pass


def stream_events(rows: DataFrame, threshold: float, delay: str = "1 day", bucket_minutes: int = 360, silence_minutes: int = 1440) -> DataFrame:
    """Flare events of ``(series, ts, event_id, x)``: runs of rows at or above ``threshold``.

    A run ends at a quiet row or before a gap of more than ``silence_minutes``. It is emitted when the watermark has
    passed the bucket of the row that ends it, or, if the series is silent, by a timer. Rows more than ``delay`` behind
    may be late; those whose bucket is closed are dropped.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    width, silence = bucket_minutes * 60_000_000, silence_minutes * 60_000_000
    late = rows.withWatermark("ts", delay).select("series", "ts", "event_id", "x")
    placed = late.withColumn("bucket", F.floor(F.unix_micros("ts") / F.lit(width)).cast("bigint"))
    parts = placed.groupBy("series", "bucket").transformWithStateInPandas(BucketRuns(threshold, width, silence), PARTIAL, "append", "EventTime", eventTimeColumnName="closes")
    return parts.groupBy("series").transformWithStateInPandas(SeriesRuns(width, silence), EVENTS, "append", "EventTime")


class HalfLabels(StatefulProcessor):
    """One half of the labels, per series and bucket of one horizon; rows wait packed in list state.

    Rows are asked for the maximum of what lies in the bucket after them (``ahead``), or, as copies of the rows of the
    bucket before, up to the end of their horizon. A row is answered once the watermark has passed all it asks for, in
    the order of time by running maxima, and rows of a closed bucket are dropped. Repeated rows are answered once.
    """

    def __init__(self, width: int, ahead: bool):
        self.width, self.ahead = width, ahead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "packed binary")

    def _due(self, key: Any, asked: np.ndarray) -> np.ndarray:
        return np.full(len(asked), (key[1] + 1) * self.width) if self.ahead else asked["at"]

    def _wake(self, key: Any, asked: np.ndarray) -> None:
        if len(asked):
            self.handle.registerTimer(-int(-self._due(key, asked).min() // 1000))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        blocks = []
        for pdf in rows:
            block = np.zeros(len(pdf), WAITING)
            for c in WAITING.names:
                block[c] = pdf[c].to_numpy()
            blocks.append(block)
        held = np.concatenate(blocks)
        self.rows.appendList([(b.tobytes(),) for b in blocks])
        self._wake(key, held[held["asks"]])
        self.handle.registerTimer(-(-(key[1] + 1) * self.width // 1000))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        blocks = [np.frombuffer(r[0], WAITING) for r in self.rows.get()]
        if not blocks:
            return
        held, now = np.concatenate(blocks), timerValues.getCurrentWatermarkInMs() * 1000
        ready = held["asks"] & (self._due(key, held) <= now)
        waiting = held["asks"] & ~ready
        closed = (key[1] + 1) * self.width <= now
        if closed and not waiting.any():
            self.rows.clear()
        elif ready.any():
            rest = held[waiting | ~held["asks"] | self.ahead]
            self.rows.put([(rest.tobytes(),)])
        self._wake(key, held[waiting])
        if ready.any():
            asked = np.unique(held[ready][["has_id", "event_id", "t", "at"]])
            follows, known, peak = self._peaks(held if self.ahead else held[~held["asks"]], asked["at"])
            due = -(-self._due(key, asked) // 1000)
            yield pd.DataFrame({
                "series": key[0], "has_id": asked["has_id"], "event_id": asked["event_id"], "t": asked["t"],
                # later than any watermark that has not fired the timer
                "closes": pd.to_datetime(due + 1, unit="ms", utc=True), "follows": follows, "peak": pd.Series(peak).astype(object).where(known, None)})

    def _peaks(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether rows, and rows with a value, lie on the asked side of each time, and the maximum of these."""
        data = data[np.argsort(data["at"], kind="stable")]
        place = np.searchsorted(data["at"], at, "right")
        if self.ahead:
            data, place = data[::-1], len(data) - place
        best = np.concatenate([[-np.inf], np.maximum.accumulate(np.where(data["has_x"], data["x"], -np.inf))])
        known = np.concatenate([[0], np.cumsum(data["has_x"])])
        return place > 0, known[place] > 0, best[place]

    def close(self) -> None:
        pass


def stream_labels(rows: DataFrame, horizon_minutes: int, delay: str = "1 day") -> DataFrame:
    """The maximum each row of ``(series, ts, event_id, x)`` sees within the next ``horizon_minutes``, once that time has passed.

    Labels come from rows that really arrived later, never from a table computed ahead. By time, so it equals the
    row-count target only on a gap-free one-minute series. A row that nothing follows within its horizon gets no
    label. In buckets of one horizon a row sees the rest of its own bucket and the beginning of the next one: each half
    is a running maximum of one bucket, however many rows a horizon holds, and an interval join of the two streams, both
    sides watermarked, puts the halves of a row together.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    width = horizon_minutes * 60_000_000
    late = rows.withWatermark("ts", delay).select(
        "series", "ts", F.unix_micros("ts").alias("t"), F.col("event_id").isNotNull().alias("has_id"), F.coalesce("event_id", F.lit(0).cast("long")).alias("event_id"),
        F.col("x").isNotNull().alias("has_x"), F.coalesce("x", F.lit(0.0)).alias("x"))
    bucket = F.floor(F.col("t") / F.lit(width)).cast("bigint")
    own = late.withColumns({"bucket": bucket, "at": F.col("t"), "asks": F.lit(True)})
    both = F.array(F.struct(bucket.alias("bucket"), F.col("t").alias("at"), F.lit(False).alias("asks")),
                   F.struct((bucket + 1).alias("bucket"), (F.col("t") + width).alias("at"), F.lit(True).alias("asks")))
    copies = late.withColumn("_to", F.explode(both)).select("*", "_to.*").drop("_to")

    def half(placed: DataFrame, ahead: bool) -> DataFrame:
        return placed.groupBy("series", "bucket").transformWithStateInPandas(HalfLabels(width, ahead), HALF, "append", "EventTime", eventTimeColumnName="closes")

    first, second = half(own, True), half(copies, False)
    second = second.select(*[F.col(c).alias(f"n_{c}") for c in second.columns])
    same = F.col("series").eqNullSafe(F.col("n_series"))
    for c in ("has_id", "event_id", "t"):
        same = same & (F.col(c) == F.col(f"n_{c}"))
    within = F.expr(f"n_closes >= closes AND n_closes <= closes + INTERVAL {horizon_minutes} MINUTES")
    return first.join(second, same & within).filter(F.col("follows") | F.col("n_follows")).select(
        "series", F.when(F.col("has_id"), F.col("event_id")).alias("event_id"), F.greatest("peak", "n_peak").alias("peak"))
