"""Raw and feature tables as Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioframe.schema import TIME


PART = "part_"      # names of folder columns


def write_table(
    df: DataFrame, path: str, by: Sequence[str] = ("series",), ts: str = TIME, mode: str = "overwrite", only_touched: bool = False,
) -> None:
    """Parquet partitioned by series and day; ``only_touched`` replaces just the folders that ``df`` has rows for.

    Rows are ranged on (series, day, time) first: a day lands in few files, and a day that holds
    much of the data is split over several writers instead of one. Folder names are copies: the keys
    stay data columns, so they are read back with their type ('007' is not 7) and NULL as NULL.
    """
    days = df.withColumns({f"{PART}{c}": F.col(c) for c in by} | {"day": F.to_date(ts)})
    writer = days.repartitionByRange(*by, "day", ts).sortWithinPartitions(*by, "day", ts).write.partitionBy(
        *[f"{PART}{c}" for c in by], "day").mode(mode)
    if only_touched:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read back without the folder columns. Filters on ``part_<key>`` and ``day`` prune folders
    when applied to ``read_partitions``."""
    rows = read_partitions(spark, path, schema)
    return rows.drop("day", *[c for c in rows.columns if c.startswith(PART)])


def read_partitions(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
