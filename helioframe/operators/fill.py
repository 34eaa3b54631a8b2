"""Gap filling, clipping and the count proxies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.functions.numeric import nan_to_null
from helioframe.operators.timeline import Timeline
from helioframe.schema import (
    HARD_COUNTS, LONG, LONG_DEFAULT, LONG_FLOOR, SHORT, SHORT_DEFAULT, SHORT_FLOOR, SOFT_COUNTS,
)


def clean_nan(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """NaN means missing; done once, at ingest."""
    return df.withColumns({n: nan_to_null(F.col(n)) for n in names})


def ffill_bfill(tl: Timeline, names: Sequence[str]) -> Timeline:
    """Last value so far; the head before the first value takes that first value."""
    filled = tl.carry(last={f"_last_{n}": n for n in names}, first={f"_first_{n}": n for n in names})
    filled = filled.with_columns({n: F.coalesce(f"_last_{n}", f"_first_{n}") for n in names})
    return filled.having(filled.df.drop(*[f"_{k}_{n}" for k in ("last", "first") for n in names]))


def fill_and_clip(tl: Timeline, bounds: dict[str, tuple[float, float]]) -> Timeline:
    """``bounds`` maps a column to (value when the whole series is missing, lower bound)."""
    filled = ffill_bfill(tl, list(bounds))
    return filled.with_columns({
        n: F.greatest(F.coalesce(F.col(n), F.lit(default)), F.lit(lower))
        for n, (default, lower) in bounds.items()
    })


def fill_channels(tl: Timeline) -> Timeline:
    return fill_and_clip(tl, {LONG: (LONG_DEFAULT, LONG_FLOOR), SHORT: (SHORT_DEFAULT, SHORT_FLOOR)})


def count_proxies(df: DataFrame) -> DataFrame:
    return df.withColumns({
        SOFT_COUNTS: F.greatest(F.col(LONG) * 1e8, F.lit(10.0)),
        HARD_COUNTS: F.greatest(F.col(SHORT) * 1e8, F.lit(5.0)),
    })
