"""Sources, stateless jobs and sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from helioframe.functions.classify import reward
from helioframe.operators.metrics import AGE, recent
from helioframe.operators.scoring import LinearModel, score

REFRESH = "15 minutes"
SNAPSHOT_ROWS = 81


def read_landing(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None,
) -> DataFrame:
    """New files of a landing folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_features(feed: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 day") -> DataFrame:
    """Overlapping fetches repeat records: keep one per key inside the watermark."""
    return feed.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, ts])


def stream_score(features: DataFrame, model: LinearModel) -> DataFrame:
    """Class, probabilities, look-aheads and reward of every new row; no state."""
    scored = score(features, model).withColumns({
        "y_true": F.col("PredictedClass").cast("int"), "y_pred": F.col("pred_class")})
    return scored.withColumn("reward", reward(F.col("y_true"), F.col("y_pred")))


def to_table(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append to a Parquet table; without ``every`` take what is there and stop."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start(path)


def for_each_batch(df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def snapshot_step(path: str, by: Sequence[str], order: Sequence[str], rows: int = SNAPSHOT_ROWS) -> Callable[[DataFrame, int], None]:
    """Batch step of the push feed: the newest ``rows`` rows of every series so far, newest marked.

    The newest of the snapshot before and the batch together; each batch writes its own folder, so a retry
    reads the same snapshot again.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark, seen = batch.sparkSession, batch
        if batch_id:
            before = spark.read.schema(batch.schema).parquet(f"{path}/batch={batch_id - 1}")
            seen = batch.unionByName(before)
        newest = recent(seen, by, order, rows).withColumn("is_status", F.col(AGE) == 0).drop(AGE)
        newest.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return step
