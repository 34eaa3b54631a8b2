"""A feature store that is refreshed by what a fetch changes, not rebuilt.

A chunk is one day of one series. For every chunk a line of the chunk table holds where its newest files are and what
the chunks around it need to know: how many rows it has, its first and last record of the short channel, its first and
last known values, and what was carried into it. A batch then

1. merges its records into the chunks it touches; of a record fetched more than once the newest fetch counts;
2. joins the channels again in those chunks, and in chunks whose neighbouring short records have changed;
3. recomputes the features of these chunks, of chunks into which another value is now filled, and of chunks within
   ``REACH`` rows of them, reading a halo of rows around each.

Files are never changed: a batch writes folders of its own and, last, a new chunk table that names for each chunk the
batch that wrote it. A batch that is run again writes the same folders again and reads only those of earlier batches; a
reader sees the newest complete chunk table. Rows are stored with their position in the chunk, and the chunk
table has the counts, so rows added to one day move the row numbers of all later days without touching their files.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helioframe.operators.asof import asof_timeline
from helioframe.operators.fill import clean_nan, count_proxies
from helioframe.operators.timeline import CHUNK, LEN, OWN, RN, Timeline, lookup
from helioframe.plans.telemetry import HORIZON_REACH, KERNEL_REACH, feature_table
from helioframe.schema import FEATURE_COLUMNS, LONG, LONG_DEFAULT, LONG_FLOOR, SHORT, SHORT_DEFAULT, SHORT_FLOOR, TIME
from helioframe.session import persist_table
from helioframe.sources.feed import split_channels
from helioframe.sources.store import PART

REACH = HORIZON_REACH           # rows over which a change is felt, either way
SPAN_ROWS = 4096                # positions are compared within spans of so many rows
DAY = "day"
RECORDS, MATCHED, FEATURES, CHUNKS = "records", "matched", "features", "chunks"


@dataclass(frozen=True)
class FeatureStore:
    """Folders under ``path`` for feed records (``by``, ``tie``, energy, flux, time_tag)."""

    path: str
    by: tuple[str, ...] = ("series",)
    tie: str = "event_id"

    @property
    def keys(self) -> list[str]:
        return [*self.by, DAY]

    # -- files -----------------------------------------------------------------
    def write(self, rows: DataFrame, kind: str, batch: int) -> None:
        """One folder per chunk below the batch's own folder."""
        copies = rows.withColumns({f"{PART}{c}": F.col(c).cast("string") for c in self.by} | {f"{PART}{DAY}": F.col(DAY)})
        parts = [f"{PART}{c}" for c in self.keys]
        # small chunks share a task, a large one is split over several
        dealt = copies.hint("rebalance", *self.keys).sortWithinPartitions(*parts, "pos" if "pos" in rows.columns else "time_tag")
        dealt.write.partitionBy(*parts).mode("overwrite").parquet(f"{self.path}/{kind}/batch={batch}")

    def read(self, spark: SparkSession, kind: str, wanted: DataFrame) -> DataFrame:
        """Rows of the chunks of ``wanted`` (keys, ``batch``): the folders of other batches and days are not read."""
        rows = spark.read.option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}/batch=*")
        names = [c for c in rows.columns if c != "batch" and not c.startswith(PART)]
        wanted = wanted.select(*[F.col(c).alias(f"_w_{c}") for c in self.keys], F.col("batch").cast("int").alias("_w_batch"))
        same = [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in self.keys]
        return rows.join(wanted, [F.col("batch") == F.col("_w_batch"), F.col(f"{PART}{DAY}") == F.col(f"_w_{DAY}"), *same], "left_semi").select(*names)

    def chunks(self, spark: SparkSession, batch: int | None = None) -> DataFrame:
        """The chunk table after ``batch``, by default the newest complete one."""
        if batch is None:
            batch = spark.read.parquet(f"{self.path}/{CHUNKS}").agg(F.max("batch")).first()[0]
        return spark.read.parquet(f"{self.path}/{CHUNKS}/batch={batch}")

    # -- what readers see --------------------------------------------------------
    def features(self, spark: SparkSession) -> DataFrame:
        """The feature table: series key, tie, ``rn`` and the contract columns."""
        table = self.chunks(spark)
        rows = self.read(spark, FEATURES, table.withColumnRenamed("feature_batch", "batch"))
        placed = lookup(rows, table.select(*self.keys, "start"), self.keys)
        return placed.select(*self.by, self.tie, (F.col("start") + F.col("pos")).alias("rn"), *FEATURE_COLUMNS)

    # -- one batch -----------------------------------------------------------------
    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Take the records of one fetch. A null time raises."""
        spark = batch.sparkSession
        before = self.chunks(spark, batch_id - 1) if batch_id else None

        touched = self._merge(batch, batch_id, before)
        table = self._replace(before, touched)
        table = self._match(spark, batch_id, table, before)
        table = self._mark(table, before)
        table = persist_table(table, "chunk-table")
        self._compute(spark, batch_id, table)
        out = table.withColumn("feature_batch", F.when(F.col("affected"), batch_id).otherwise(F.col("feature_batch")).cast("int"))
        out.drop("affected", "dirty").write.mode("overwrite").parquet(f"{self.path}/{CHUNKS}/batch={batch_id}")

    def _merge(self, batch: DataFrame, batch_id: int, before: DataFrame | None) -> DataFrame:
        """Write the touched chunks' records; returns their lines: counts and short records at the borders."""
        spark, columns = batch.sparkSession, [*self.by, self.tie, "energy", "flux", "time_tag"]
        known = F.coalesce(F.col("time_tag"), F.raise_error(F.lit("time_tag is NULL")))
        new = clean_nan(batch.select(*columns), ["flux"]).withColumn("time_tag", known)
        new = new.withColumns({"fetch": F.lit(batch_id), DAY: F.to_date("time_tag")})
        new = persist_table(new, "fetched")         # the batch is read once
        seen = new
        if before is not None:
            held = lookup(before.withColumnRenamed("record_batch", "batch"), new.select(*self.keys).distinct(), self.keys)
            seen = new.unionByName(self.read(spark, RECORDS, held).select(*new.columns))
        newest = Window.partitionBy(*self.keys, "energy", "time_tag").orderBy(F.desc("fetch"), F.desc(self.tie), F.desc("flux"))
        merged = seen.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
        self.write(merged, RECORDS, batch_id)
        lines = self.read(spark, RECORDS, new.select(*self.keys).distinct().withColumn("batch", F.lit(batch_id)))
        long, short = split_channels(lines, (*self.keys, self.tie))
        record = F.struct(F.col("time_tag"), F.col(self.tie), F.col(SHORT))
        borders = short.groupBy(*self.keys).agg(F.min_by(record, "time_tag").alias("first_short"), F.max_by(record, "time_tag").alias("last_short"))
        counts = lines.select(*self.keys).distinct()
        return _left(counts, borders, self.keys).withColumns({"record_batch": F.lit(batch_id), "touched": F.lit(True)})

    def _replace(self, before: DataFrame | None, touched: DataFrame) -> DataFrame:
        """The chunk table with new lines for the touched chunks; columns still to be computed keep their old values."""
        if before is None:
            return touched
        rest = _without(before, touched, self.keys).withColumn("touched", F.lit(False))
        kept = ["matched_batch", "feature_batch", "n", "behind", "upcoming", "long_in", "short_in", *_EDGES]
        old = before.select(*self.keys, *kept)
        return rest.select(*touched.columns, *kept).unionByName(_left(touched, old, self.keys))

    def _match(self, spark: SparkSession, batch_id: int, table: DataFrame, before: DataFrame | None) -> DataFrame:
        """Join the channels where records or the short records around have changed."""
        up, down = (Window.partitionBy(*self.by).orderBy(o) for o in (F.col(DAY), F.desc(DAY)))
        earlier, later = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (up, down))
        table = table.withColumns({
            "_behind": F.last("last_short", ignorenulls=True).over(earlier), "_upcoming": F.last("first_short", ignorenulls=True).over(later)})
        if before is None:
            again = F.lit(True)
        else:
            again = F.col("touched") | ~F.col("behind").eqNullSafe(F.col("_behind")) | ~F.col("upcoming").eqNullSafe(F.col("_upcoming"))
        table = persist_table(table.withColumn("again", again).drop("behind", "upcoming").withColumnsRenamed(
            {"_behind": "behind", "_upcoming": "upcoming"}), "chunk-borders")
        todo = table.filter("again")
        records = self.read(spark, RECORDS, todo.withColumnRenamed("record_batch", "batch"))
        long, short = split_channels(records, (*self.keys, self.tie))
        # the nearest short records outside count as records of the chunk
        for side in ("behind", "upcoming"):
            outside = todo.filter(F.col(side).isNotNull()).select(*self.keys, F.col(f"{side}.{self.tie}").alias(self.tie), F.col(f"{side}.time_tag").alias("time_tag"), F.col(f"{side}.{SHORT}").alias(SHORT))
            short = short.unionByName(outside)
        joined = asof_timeline(long, short.withColumnRenamed(self.tie, "_t"), "time_tag", by=self.keys, left_tie=self.tie, right_tie="_t")
        self.write(joined.df.select(*self.keys, self.tie, F.col("time_tag").alias(TIME), LONG, SHORT, F.col(RN).alias("pos")), MATCHED, batch_id)
        found = self.read(spark, MATCHED, todo.withColumn("batch", F.lit(batch_id)))
        edges = {"n": F.count(F.lit(1))}
        for name, c in (("long", LONG), ("short", SHORT)):
            at = F.when(F.col(c).isNotNull(), F.col("pos"))
            edges |= {f"{name}_first": F.min_by(c, at), f"{name}_last": F.max_by(c, at), f"{name}_open": ~F.min(at).eqNullSafe(F.lit(0).cast("long"))}
        lines = found.groupBy(*self.keys).agg(*[v.alias(k) for k, v in edges.items()])
        # a chunk of short records only has no rows
        fresh = _left(todo.drop("n", *_EDGES), lines, self.keys).withColumns({"n": F.coalesce("n", F.lit(0).cast("long")), "matched_batch": F.lit(batch_id)})
        if before is None:
            return fresh
        return table.filter(~F.col("again")).unionByName(fresh, allowMissingColumns=True)

    def _mark(self, table: DataFrame, before: DataFrame | None) -> DataFrame:
        """Adds positions, the values filled into each chunk, and which chunks' features are to be computed again."""
        up, down = (Window.partitionBy(*self.by).orderBy(o) for o in (F.col(DAY), F.desc(DAY)))
        earlier = up.rowsBetween(Window.unboundedPreceding, -1)
        every = Window.partitionBy(*self.by).orderBy(DAY).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        filled = {f"_{c}_in": F.when(F.col(f"{c}_open"), F.coalesce(F.last(f"{c}_last", ignorenulls=True).over(earlier), F.first(f"{c}_first", ignorenulls=True).over(every)))
                  for c in ("long", "short")}
        table = table.withColumns(filled | {
            "start": F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")), "length": F.sum("n").over(every)})
        changed = F.col("again")
        if before is not None:
            for c in ("long", "short"):
                changed = changed | ~F.col(f"{c}_in").eqNullSafe(F.col(f"_{c}_in"))
        else:
            table = table.withColumn("feature_batch", F.lit(None).cast("int"))
        table = table.withColumn("dirty", changed).drop("again", "touched", "long_in", "short_in")
        table = table.withColumnsRenamed({"_long_in": "long_in", "_short_in": "short_in"})
        end = F.col("start") + F.col("n")
        near_before = F.max(F.when(F.col("dirty"), end)).over(earlier)
        near_after = F.min(F.when(F.col("dirty"), F.col("start"))).over(down.rowsBetween(Window.unboundedPreceding, -1))
        near = (F.col("start") - near_before < REACH) | (near_after - end < REACH)
        return table.withColumn("affected", F.col("dirty") | F.coalesce(near, F.lit(False)))

    def _compute(self, spark: SparkSession, batch_id: int, table: DataFrame) -> None:
        """Write the features of the affected chunks from their rows and a halo around them."""
        end = F.col("start") + F.col("n")
        spans = lambda low, high: F.explode(F.sequence(F.floor(low / SPAN_ROWS), F.floor(high / SPAN_ROWS)))
        full = table.filter("n > 0")
        low, high = F.greatest(F.col("start") - KERNEL_REACH, F.lit(0)), F.least(end - 1 + HORIZON_REACH, F.col("length") - 1)
        targets = full.filter("affected").select(*self.by, F.col(DAY).alias("target"), low.alias("low"), high.alias("high"), F.col("start").alias("home"), "length")
        targets = targets.withColumn("span", spans(F.col("low"), F.col("high")))
        sources = full.select(*self.keys, "start", end.alias("end"), "matched_batch", "long_in", "short_in").withColumn("span", spans(F.col("start"), F.col("end") - 1))
        pairs = lookup(sources, targets, [*self.by, "span"]).filter("start <= high AND end > low").drop("span").distinct()
        pairs = persist_table(pairs, "chunk-halos")

        needed = pairs.select(*self.keys, F.col("matched_batch").alias("batch"), "start", "long_in", "short_in").distinct()
        rows = lookup(self.read(spark, MATCHED, needed), needed.drop("batch"), self.keys)
        so_far = Window.partitionBy(*self.keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        clean = {c: _filled(F.last(c, ignorenulls=True).over(so_far), F.col(into), default, floor) for c, into, default, floor in (
            (LONG, "long_in", LONG_DEFAULT, LONG_FLOOR), (SHORT, "short_in", SHORT_DEFAULT, SHORT_FLOOR))}
        rows = count_proxies(rows.withColumns(clean)).drop("long_in", "short_in", "start")
        copies = lookup(rows, pairs.select(*self.keys, "target", "start", "low", "high", "home", "length"), self.keys)
        copies = copies.withColumn(RN, F.col("start") + F.col("pos")).filter(F.col(RN).between(F.col("low"), F.col("high")))
        copies = copies.withColumns({LEN: F.col("length"), CHUNK: F.col("target"), OWN: F.col("target") == F.col(DAY)})
        tl = Timeline(copies, self.by, chunked=True, back=KERNEL_REACH, ahead=HORIZON_REACH, declared=True)
        done = feature_table(tl, [self.tie, DAY, "home"])
        self.write(done.withColumn("pos", F.col("rn") - F.col("home")).drop("rn", "home"), FEATURES, batch_id)


_EDGES = tuple(f"{c}_{k}" for c in ("long", "short") for k in ("first", "last", "open"))


def _filled(value: Column, carried: Column, default: float, floor: float) -> Column:
    return F.greatest(F.coalesce(value, carried, F.lit(default)), F.lit(floor))


def _same(table: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    return table.withColumnsRenamed({k: f"_k_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]


def _left(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be NULL."""
    other, same = _same(table, keys)
    return rows.join(other, same, "left").drop(*[f"_k_{k}" for k in keys])


def _without(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    other, same = _same(table.select(*keys), keys)
    return rows.join(other, same, "left_anti")
