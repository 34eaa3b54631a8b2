"""Nearest as-of join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.operators.timeline import Timeline, build_timeline

_SIDE, _TIE, _MATCH = "_side", "_tie", "_match"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _required(name: str) -> Column:
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"as-of key {name} is NULL")))


def asof_timeline(
    left: DataFrame,
    right: DataFrame,
    on: str,
    *,
    by: Sequence[str] = (),
    left_tie: str | None = None,
    right_tie: str | None = None,
    tolerance: float | None = None,
    direction: str = "nearest",
    **layout,
) -> Timeline:
    """Every left row once, with the columns of the right row nearest in time (or, by ``direction``,
    the last one ``"backward"`` or the next one ``"forward"``, equal times included).

    Both sides go into one timeline, right rows first at equal times, so the candidates are the
    last right row behind and the next one ahead: one shuffle, no range join. An equal distance
    takes the earlier right row, duplicate right times the last of them. ``tolerance`` is in
    seconds. A NULL key raises. The result is numbered by left rows.
    """
    values = [c for c in right.columns if c != on and c not in by]
    ours = [c for c in left.columns if c not in by]

    def tie(df: DataFrame, name: str | None) -> Column:
        return (F.col(name) if name else F.lit(0)).cast("long").alias(_TIE)

    match_type = right.select(F.struct(on, *values).alias(_MATCH)).schema[_MATCH].dataType
    row_type = left.select(F.struct(*ours).alias("_row")).schema["_row"].dataType
    lefts = left.select(
        *by, _required(on).alias("_at"), F.lit(1).alias(_SIDE), tie(left, left_tie),
        F.struct(*ours).alias("_row"), F.lit(None).cast(match_type).alias(_MATCH),
    )
    rights = right.select(
        *by, _required(on).alias("_at"), F.lit(0).alias(_SIDE), tie(right, right_tie),
        F.lit(None).cast(row_type).alias("_row"), F.struct(on, *values).alias(_MATCH),
    )
    both = build_timeline(lefts.unionByName(rights), by, ["_at", _SIDE, _TIE], **layout)
    is_left = F.col(_SIDE).cast("long")
    both = both.carry(
        last={"_behind": _MATCH},
        upcoming={"_next": _MATCH},
        sums={"_position": is_left},
        totals={"_length": is_left},
    )

    gap_behind = micros(F.col("_at")) - micros(F.col(f"_behind.{on}"))
    gap_next = micros(F.col(f"_next.{on}")) - micros(F.col("_at"))
    nearer = F.when(gap_next.isNull() | (gap_behind <= gap_next), F.col("_behind")).otherwise(F.col("_next"))
    best, gap = {
        "nearest": (nearer, F.least(gap_behind, gap_next)),
        "backward": (F.col("_behind"), gap_behind),
        "forward": (F.when(gap_behind == 0, F.col("_behind")).otherwise(F.col("_next")), F.when(gap_behind == 0, 0).otherwise(gap_next)),
    }[direction]
    if tolerance is not None:
        best = F.when(gap <= F.lit(int(tolerance * 1e6)), best)

    found = both.having(both.df.filter(F.col(_SIDE) == 1).withColumns({
        "_best": best, "_position": F.col("_position") - 1,
    })).renumber("_position", "_length")
    keep = [c for c in found.df.columns if c.startswith("_") and c not in {
        "_at", _SIDE, _TIE, "_row", _MATCH, "_behind", "_next", "_best"}]
    return found.having(found.df.select(
        *found.by, *keep,
        *[F.col(f"_row.{c}").alias(c) for c in ours],
        *[F.col(f"_best.{c}").alias(c) for c in values],
    ))


def asof_nearest(left: DataFrame, right: DataFrame, on: str, **options) -> DataFrame:
    return asof_timeline(left, right, on, **options).rows()
