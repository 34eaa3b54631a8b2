"""Scored rows appended day by day, with an index of row numbers, so that a status needs no scan.

An append numbers its rows from counts: the index holds a line per series and day with the first row number, the
number of rows, the reward up to there and the day's part of the insights. New days lie behind all stored ones, so
numbers and running sums of stored rows never change, and nothing is sorted beyond a day of a series. Files are sorted
by row number within a day. A batch writes folders of its own, the index last; run again, it replaces them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helioframe.functions.classify import reward
from helioframe.functions.display import full_time
from helioframe.operators.insights import class_count_columns, first_peak_time, insight_texts
from helioframe.operators.metrics import LATENCY_ROWS, SKILL_ROWS, skill_report
from helioframe.operators.scoring import NOW, LinearModel, score
from helioframe.operators.timeline import lookup
from helioframe.schema import LONG, SHORT, TIME
from helioframe.session import persist_table
from helioframe.sources.store import PART

DAY = "day"
EXACT = "decimal(28,1)"         # rewards have one decimal
METRICS = ("precision", "recall", "f1_score", "tss", "avg_latency_ms", "online_loss")


def prediction_log(features: DataFrame, model: LinearModel) -> DataFrame:
    """Scored feature rows with truth, decision and reward; ``latency_ms`` is NULL unless the rows have it."""
    rows = score(features, model).withColumns({"y_true": F.col("PredictedClass").cast("int"), "y_pred": F.col("pred_class")})
    rows = rows.withColumn("reward", reward(F.col("y_true"), F.col("y_pred")))
    return rows if "latency_ms" in rows.columns else rows.withColumn("latency_ms", F.lit(None).cast("double"))


@dataclass(frozen=True)
class ScoredStore:
    """Folders under ``path``: ``rows`` and ``index``, each with one folder per batch."""

    path: str
    by: tuple[str, ...] = ("series",)
    tie: str = "event_id"

    @property
    def keys(self) -> list[str]:
        return [*self.by, DAY]

    def index(self, spark: SparkSession) -> DataFrame:
        """One line per series and day."""
        return spark.read.parquet(f"{self.path}/index")

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows with ``rn``, ``cumulative_reward`` and ``weight_updates``; the folder columns included."""
        return spark.read.parquet(f"{self.path}/rows")

    def append(self, scored: DataFrame, batch: int) -> None:
        """Add days that lie behind all stored days of their series; a day that does not raises."""
        spark = scored.sparkSession
        new = persist_table(scored.drop("rn").withColumn(DAY, F.to_date(TIME)), "appended")
        parts = {"rows": F.count(F.lit(1)), "first_ts": F.min(TIME), "last_ts": F.max(TIME), "reward_sum": F.sum(F.col("reward").cast(EXACT)), "peak_flux": F.max(LONG),
                 "peak_timestamp": first_peak_time(F.col(LONG), F.col(TIME)), "max_flux_growth_rate": F.max("goes_long_vel"), **class_count_columns(F.col(LONG))}
        lines = new.groupBy(*self.keys).agg(*[c.alias(n) for n, c in parts.items()])
        earlier = Window.partitionBy(*self.by).orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)
        nothing = F.lit(0).cast("long")
        lines = lines.withColumns({"first_rn": F.coalesce(F.sum("rows").over(earlier), nothing), "reward_before": F.coalesce(F.sum("reward_sum").over(earlier), F.lit(0).cast(EXACT)).cast(EXACT)})
        if batch:
            stored = self.index(spark).filter(F.col("batch") < batch).groupBy(*self.by).agg(
                F.sum("rows").alias("_rows"), F.sum("reward_sum").cast(EXACT).alias("_reward"), F.max(DAY).alias("_last"))
            named = stored.withColumnsRenamed({c: f"_k_{c}" for c in self.by})
            lines = lines.join(named, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in self.by], "left")
            behind = F.coalesce(F.col(DAY) > F.col("_last"), F.lit(True))
            lines = lines.withColumns({
                "first_rn": F.when(behind, F.col("first_rn") + F.coalesce("_rows", nothing)).otherwise(F.raise_error(F.lit("an appended day does not lie behind the stored ones")).cast("long")),
                "reward_before": (F.col("reward_before") + F.coalesce("_reward", F.lit(0).cast(EXACT))).cast(EXACT)}).drop("_rows", "_reward", "_last", *[f"_k_{c}" for c in self.by])
        lines = persist_table(lines, "appended-days")

        so_far = Window.partitionBy(*self.keys).orderBy(TIME, self.tie)
        placed = lookup(new, lines.select(*self.keys, "first_rn", "reward_before"), self.keys)
        placed = placed.withColumns({
            "rn": F.col("first_rn") + F.row_number().over(so_far) - 1,
            "cumulative_reward": (F.col("reward_before") + F.sum(F.col("reward").cast(EXACT)).over(so_far.rowsBetween(Window.unboundedPreceding, 0))).cast("double")})
        placed = placed.withColumn("weight_updates", F.col("rn") + 1).drop("first_rn", "reward_before")
        folders = [f"{PART}{c}" for c in self.keys]
        copies = placed.withColumns({f"{PART}{c}": F.col(c).cast("string") for c in self.by} | {f"{PART}{DAY}": F.col(DAY)})
        # the window has laid out whole days: no other shuffle
        copies.sortWithinPartitions(*folders, "rn").write.partitionBy(*folders).mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        lines.write.mode("overwrite").parquet(f"{self.path}/index/batch={batch}")

    def between(self, spark: SparkSession, first: int, last: int) -> DataFrame:
        """Rows ``first .. last`` of every series: only folders that the index names, and in them by row number."""
        lines = self.index(spark).filter((F.col("first_rn") <= last) & (F.col("first_rn") + F.col("rows") > first))
        named = lines.select(*[F.col(c).alias(f"_k_{c}") for c in self.keys], F.col("batch").alias("_k_batch"))
        rows = self.rows(spark).filter(F.col("rn").between(first, last))
        same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in self.keys]
        return rows.join(named, [F.col("batch") == F.col("_k_batch"), F.col(f"{PART}{DAY}") == F.col(f"_k_{DAY}"), *same], "left_semi")

    def status(self, spark: SparkSession, idx: int, model: LinearModel | None = None, source: str = "", digits: int = 4) -> DataFrame:
        """The status of every series at row ``idx``; series that are shorter give no row.

        The row itself, the skill over the newest predictions up to it, and the insights over the whole table, which
        come from the index alone. ``model`` adds its mean absolute weights and feature names.
        """
        by = self.by
        log = self.between(spark, max(0, idx - max(SKILL_ROWS, LATENCY_ROWS) + 1), idx)
        skill = skill_report(log.select(*by, "rn", "y_true", "y_pred", "probs", "latency_ms"), by, ["rn"], digits=digits)
        skill = skill.select(*by, F.struct(*METRICS).alias("metrics"))
        counts = list(class_count_columns(F.col(LONG)))
        report = self.index(spark).groupBy(*by).agg(
            F.sum("rows").alias("total_rows"), F.max("peak_flux").alias("peak_flux"), first_peak_time(F.col("peak_flux"), F.col("peak_timestamp")).alias("peak_timestamp"),
            F.max("max_flux_growth_rate").alias("max_flux_growth_rate"), *[F.sum(c).alias(c) for c in counts])
        texts = insight_texts()
        report = report.withColumns(texts)
        report = report.select(*by, "total_rows", F.struct("peak_flux", "peak_timestamp", "max_flux_growth_rate", *counts, *texts).alias("insights"))

        row = self.between(spark, idx, idx).select(
            *by, full_time(F.col(TIME)).alias("timestamp"), F.col("rn").alias("current_idx"), F.lit(source).alias("stream_source"), "RiskLabel", F.col("pred_class").alias("PredictedClass"),
            *[F.round(F.col("probs")[k], digits).alias(n) for k, n in ((1, "CProb"), (2, "MProb"), (3, "XProb"))], LONG, SHORT, F.round("hardness_ratio", 3).alias("hardness_ratio"),
            F.round("latency_ms", 2).alias("latency_ms"), F.round("reward", 2).alias("reward"), F.round("cumulative_reward", 1).alias("cumulative_reward"), "weight_updates", "horizons")
        out = lookup(lookup(row, skill, by), report, by)
        return out.withColumns(_model_columns(model)) if model else out


def _model_columns(model: LinearModel) -> dict:
    coef: Sequence[Sequence[float]] = model.heads[NOW].coef
    weights = [sum(abs(w[k]) for w in coef) / len(coef) for k in range(len(model.features))]
    return {"weights": F.array(*[F.lit(w) for w in weights]), "feature_names": F.array(*[F.lit(f) for f in model.features])}
