"""Cleaning of non-finite numbers and probability repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def finite(value: Column, nan: float = 0.0, high: float = 1e5, low: float = -1e5) -> Column:
    """Missing or NaN, +inf and -inf replaced by three fixed numbers."""
    return F.coalesce(
        F.when(F.isnan(value), F.lit(nan))
        .when(value == INF, F.lit(high))
        .when(value == -INF, F.lit(low))
        .otherwise(value),
        F.lit(nan),
    )


def normalised(score: Column, total: Column, classes: int) -> Column:
    """Share of the total; without any score all classes are equally likely."""
    return F.when(total > 0, score / total).otherwise(F.lit(1.0 / classes))


def repair_probabilities(raw: Sequence[Column]) -> list[Column]:
    """Clean every score, then divide by their sum."""
    clean = [finite(p, nan=0.0, high=1.0, low=0.0) for p in raw]
    total = sum(clean[1:], clean[0])
    return [normalised(p, total, len(clean)) for p in clean]


def logistic(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def hardness(short: Column, long: Column, eps: float = 1e-12) -> Column:
    return short / (long + F.lit(eps))
