"""Point lookups and slices of a scored table; ``rn`` is its row position, from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.functions.display import full_time, hardness_display, short_time
from helioframe.operators.insights import insight_aggregates, insight_texts
from helioframe.schema import FLUX_CUTS, LONG, SHORT, TIME

HISTORY_LIMIT, UI_HISTORY_LIMIT, PAGE_ROWS = 80, 150, 10


def history_slice(df: DataFrame, idx: int, limit: int = HISTORY_LIMIT, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``idx - limit .. idx``, both included."""
    part = df.filter(F.col("rn").between(max(idx - limit, 0), idx))
    return part.select(
        *by,
        "rn",
        short_time(F.col(TIME)).alias("time"),
        full_time(F.col(TIME)).alias("fullDate"),
        F.col(LONG).alias("GOES_Long"),
        F.col(SHORT).alias("GOES_Short"),
    ).orderBy(*by, "rn")


def page(history: DataFrame, number: int, size: int = PAGE_ROWS) -> DataFrame:
    """One page of a history slice with its peak flag and table hardness."""
    rows = history.withColumns({
        "is_peak": F.col("GOES_Long") >= F.lit(FLUX_CUTS[0]),
        "hardness": hardness_display(F.col("GOES_Short"), F.col("GOES_Long")),
    })
    return rows.orderBy("rn").offset(number * size).limit(size)


def page_count(history: DataFrame, size: int = PAGE_ROWS) -> DataFrame:
    return history.agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("pages"))


def status_at(scored: DataFrame, idx: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The row at position ``idx`` with the insights of its whole table.

    Both come from one aggregation: the row is the only one kept by a conditional ``first``.
    Optional columns (``reward``, ``cumulative_reward``, ``weight_updates``, ``latency_ms``,
    ``metrics``) are passed through when present.
    """
    rounded = {"latency_ms": 2, "reward": 2, "cumulative_reward": 1}
    extras = [c for c in ("latency_ms", "reward", "cumulative_reward", "weight_updates", "metrics") if c in scored.columns]
    row = F.struct(
        full_time(F.col(TIME)).alias("timestamp"),
        F.col("rn").alias("current_idx"),
        F.col("RiskLabel"),
        F.col("pred_class").alias("PredictedClass"),
        *[F.round(F.col("probs")[k], 4).alias(n) for k, n in ((1, "CProb"), (2, "MProb"), (3, "XProb"))],
        F.col(LONG),
        F.col(SHORT),
        F.round("hardness_ratio", 3).alias("hardness_ratio"),
        *[(F.round(c, rounded[c]) if c in rounded else F.col(c)).alias(c) for c in extras],
        F.col("horizons"),
    )
    seen = scored.groupBy(*by).agg(
        F.first(F.when(F.col("rn") == idx, row), ignorenulls=True).alias("_row"),
        F.count(F.lit(1)).alias("total_rows"),
        *[c.alias(n) for n, c in insight_aggregates(scored).items()],
    )
    texts = insight_texts()
    seen = seen.filter(F.col("_row").isNotNull()).withColumns(texts)
    names = [*insight_aggregates(scored), *texts]
    return seen.select(*by, "_row.*", "total_rows", F.struct(*names).alias("insights"))
