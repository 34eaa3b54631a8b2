"""Reading landed feed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.schema import FEED_SCHEMA, LONG, LONG_BAND, SHORT, SHORT_BAND

REQUIRED = ("energy", "flux", "time_tag")
MIN_RECORDS, MIN_ROWS = 50, 100


def read_feed(spark: SparkSession, path: str, schema=FEED_SCHEMA, arrays: bool = True, presence_sample: float = 1.0) -> DataFrame:
    """Feed records; further fields of the files are ignored.

    ``arrays``: one JSON array per file (a file is then the unit of parallelism), else one record
    per line. A field the files never have would silently read as NULL under a fixed schema, so
    the names are first inferred from a ``presence_sample`` share of the input; a missing one raises.
    """
    reader = spark.read.option("multiLine", arrays)
    present = reader.option("samplingRatio", presence_sample).option("primitivesAsString", True).json(path).columns
    missing = [f for f in REQUIRED if f not in present]
    if missing:
        raise ValueError(f"feed at {path} has no field {', '.join(missing)}")
    return spark.read.option("multiLine", arrays).schema(schema).json(path)


def parse_time(text: Column) -> Column:
    """Timestamp of an ISO text; unreadable or missing text raises."""
    value = F.coalesce(text, F.raise_error(F.lit("time_tag is NULL")))
    return F.coalesce(
        F.try_to_timestamp(value),
        F.raise_error(F.concat(F.lit("unreadable time_tag: "), value)),
    )


def pick_feed(feeds: DataFrame, min_records: int = MIN_RECORDS) -> DataFrame:
    """Rows of the best (lowest ``priority``) feed that has more than ``min_records`` records."""
    usable = feeds.groupBy("priority").count().filter(F.col("count") > min_records)
    chosen = usable.agg(F.min("priority").alias("priority"))
    return feeds.join(chosen, "priority", "left_semi")


def require_rows(df: DataFrame, least: int = MIN_ROWS) -> DataFrame:
    """Raise unless ``df`` has at least ``least`` rows; stops counting there."""
    seen = df.limit(least).count()
    if seen < least:
        raise ValueError(f"only {seen} rows, {least} needed")
    return df


def split_channels(
    feed: DataFrame, keep: tuple[str, ...] = (), long_band: str = LONG_BAND, short_band: str = SHORT_BAND,
) -> tuple[DataFrame, DataFrame]:
    """(long, short) channel: ``time_tag``, the renamed flux and the ``keep`` columns."""
    def side(band: str, name: str) -> DataFrame:
        return feed.filter(F.col("energy") == band).select(*keep, "time_tag", F.col("flux").alias(name))
    return side(long_band, LONG), side(short_band, SHORT)
