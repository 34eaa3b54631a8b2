"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


# settings a session should be built with. The first is worth seconds per query, because plans here
# hold thousands of literals and every column call would record where it was made.
BUILD_SETTINGS = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
}
# settings that may also be changed on a running session
RUN_SETTINGS = {
    # all clocks in the data are UTC
    "spark.sql.session.timeZone": "UTC",
    # the JVM never compiles a method above 8000 bytes of bytecode: let Spark split such code instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in RUN_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own: on a cluster
    another machine could not read it.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="helioframe-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def persist_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage durably (survives lost executors) and, unlike an RDD checkpoint,
    keeps column pruning for whoever reads it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts and merges, however small it is.

    A broadcast goes through the driver and stays in its memory until garbage collection finds it unused. This is for joins of
    short rows that are repeated in many steps; a sort takes memory of the executors instead.
    """
    return df.hint("merge")
