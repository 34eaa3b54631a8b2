"""Skill of logged predictions: over the newest rows, and at every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helioframe.functions.classify import reward
from helioframe.operators.timeline import RN, Timeline

CLASSES = (0, 1, 2, 3)
SKILL_ROWS, LATENCY_ROWS, LOG_ROWS = 300, 100, 1000
MIN_ROWS = 10
# --- fixed values: what is reported before enough predictions exist ------------
NO_LATENCY = 0.45
START = {"precision": 1.0, "recall": 1.0, "f1_score": 1.0, "tss": 1.0, "avg_latency_ms": 0.45, "online_loss": 0.01}
# -------------------------------------------------------------------------------
PROB_EPS = 2.220446049250313e-16


def _cells() -> dict[str, Column]:
    """0/1 columns whose sums are the counts of all metrics."""
    t, p = F.col("y_true"), F.col("y_pred")
    cells = {}
    for c in CLASSES:
        cells[f"tp_{c}"] = (t == c) & (p == c)
        cells[f"pred_{c}"] = p == c
        cells[f"support_{c}"] = t == c
    cells["hits"] = (t >= 1) & (p >= 1)
    cells["alarms"] = (t == 0) & (p >= 1)
    return {n: F.when(c, 1).otherwise(0).cast("long") for n, c in cells.items()}


def row_loss() -> Column:
    """-ln of the probability given to the truth, clipped away from 0 and 1."""
    p = F.get("probs", F.col("y_true").cast("int"))
    return -F.ln(F.least(F.greatest(p, F.lit(PROB_EPS)), F.lit(1.0 - PROB_EPS)))


def _ratio(num: Column, den: Column, empty: float) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(empty))


def _report(n: Column, latency_n: Column, digits: int, latency_digits: int) -> dict[str, Column]:
    """Metric columns from count columns, ``_loss`` (sum), ``_lat`` (sum)."""
    tp, pred, sup = ([F.col(f"{k}_{c}") for c in CLASSES] for k in ("tp", "pred", "support"))
    share = [s / n for s in sup]
    precision = sum((w * _ratio(t, p, 1.0) for w, t, p in zip(share, tp, pred, strict=True)), F.lit(0.0))
    recall = sum(tp[1:], tp[0]) / n
    f1 = sum((w * _ratio(2 * t, s + p, 1.0) for w, t, s, p in zip(share, tp, sup, pred, strict=True)), F.lit(0.0))
    flares = sum(sup[2:], sup[1])
    tss = _ratio(F.col("hits"), flares, 1.0) - _ratio(F.col("alarms"), sup[0], 0.0)
    seen = sum((F.when(s > 0, 1).otherwise(0) for s in sup[1:]), F.when(sup[0] > 0, 1).otherwise(0))
    loss = F.when((seen > 1) & F.col("_loss").isNotNull(), F.col("_loss") / n).otherwise(1.0 - precision + 0.01)
    values = {
        "precision": (precision, digits),
        "recall": (recall, digits),
        "f1_score": (f1, digits),
        "tss": (F.greatest(F.lit(0.0), F.least(F.lit(1.0), tss)), digits),
        "avg_latency_ms": (_ratio(F.col("_lat"), latency_n, NO_LATENCY), latency_digits),
        "online_loss": (F.greatest(F.lit(0.001), loss), digits),
    }
    return {
        name: F.when(n < MIN_ROWS, F.lit(START[name])).otherwise(F.round(v, d))
        for name, (v, d) in values.items()
    }


AGE = "_age"


def recent(df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int = LOG_ROWS) -> DataFrame:
    """The newest rows of every series, with their age (0 = newest).

    A row number compared with a constant is limited per input partition before the shuffle.
    """
    newest = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    ranked = df.withColumn(AGE, F.row_number().over(newest))
    return ranked.filter(F.col(AGE) <= rows).withColumn(AGE, F.col(AGE) - 1)


def confusion(df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int = SKILL_ROWS) -> DataFrame:
    counts = recent(df, by, order, rows).groupBy(*by, "y_true", "y_pred").count()
    return counts.withColumnRenamed("count", "n")


def skill_report(
    df: DataFrame, by: Sequence[str], order: Sequence[str],
    rows: int = SKILL_ROWS, latency_rows: int = LATENCY_ROWS, digits: int = 4, latency_digits: int = 2,
) -> DataFrame:
    """One row of metrics per series over its newest predictions."""
    log = recent(df, by, order, max(rows, latency_rows))
    in_skill, in_latency = F.col(AGE) < rows, F.col(AGE) < latency_rows
    sums = {n: F.sum(F.when(in_skill, c)) for n, c in _cells().items()}
    sums |= {
        "_n": F.count_if(in_skill),
        "_loss": F.sum(F.when(in_skill, row_loss())),
        "_lat": F.sum(F.when(in_latency, F.col("latency_ms"))),
        "_lat_n": F.count(F.when(in_latency, F.col("latency_ms"))),
    }
    counts = log.groupBy(*by).agg(*[c.alias(n) for n, c in sums.items()])
    report = _report(F.col("_n"), F.col("_lat_n"), digits, latency_digits)
    return counts.select(*by, *[c.alias(n) for n, c in report.items()])


def rolling_skill(
    tl: Timeline, rows: int = SKILL_ROWS, latency_rows: int = LATENCY_ROWS, digits: int = 4, latency_digits: int = 2,
) -> Timeline:
    """The same report at every prediction over the rows up to it.

    Counts over a moving window are differences of running counts: O(1) per row where a frame of
    300 rows would be summed again for each. Losses and latencies are summed as decimals, so the
    differences are exact as well.
    """
    exact = "decimal(38,15)"

    def step(t: Timeline) -> Timeline:
        w, rn = t.window(), F.col(RN)
        parts = _cells() | {
            "_loss": F.coalesce(row_loss(), F.lit(0.0)).cast("decimal(28,15)"),
            "_bad": F.when(row_loss().isNull(), 1).otherwise(0).cast("long"),
            "_lat": F.coalesce(F.col("latency_ms"), F.lit(0.0)).cast("decimal(28,9)"),
            "_lat_n": F.when(F.col("latency_ms").isNotNull(), 1).otherwise(0).cast("long"),
        }
        names = list(parts)
        t = t.with_columns({f"_sum_{n}": F.sum(c).over(t.so_far()) for n, c in parts.items()})
        span = {n: latency_rows if n in ("_lat", "_lat_n") else rows for n in names}
        t = t.with_columns({f"_old_{n}": F.lag(f"_sum_{n}", span[n]).over(w) for n in names})
        t = t.with_columns({n: F.col(f"_sum_{n}") - F.coalesce(f"_old_{n}", F.lit(0)) for n in names})
        t = t.with_columns({
            "_loss": F.when(F.col("_bad") == 0, F.col("_loss").cast(exact).cast("double")),
            "_lat": F.col("_lat").cast("double"),
            "_n": F.least(rn + 1, F.lit(rows)),
        })
        t = t.with_columns(_report(F.col("_n"), F.col("_lat_n"), digits, latency_digits))
        return t.having(t.df.drop("_n", *names, *[f"_{k}_{n}" for k in ("sum", "old") for n in names]))

    written = list(_report(F.lit(1), F.lit(1), digits, latency_digits))
    return tl.bounded(max(rows, latency_rows), 0, step, tl.df.columns, written)


def cumulative_reward(tl: Timeline) -> Timeline:
    """Reward, its running sum and the number of updates so far."""
    scored = tl.with_column("reward", reward(F.col("y_true"), F.col("y_pred")))
    # rewards have one decimal; exact sums do not depend on how rows are cut into chunks
    summed = scored.carry(sums={"cumulative_reward": F.col("reward").cast("decimal(28,1)")})
    return summed.with_columns({
        "cumulative_reward": F.col("cumulative_reward").cast("double"),
        "weight_updates": F.col(RN) + 1,
    })
