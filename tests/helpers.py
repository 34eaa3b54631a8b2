"""Small tables that several tests share."""


def series(spark, values, name="a", extra=""):
    """One series with a value per minute."""
    rows = [(name, i, None if v is None else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "series string, id bigint, x double")
    return df.selectExpr("series", "id", "x", "timestamp_seconds(1704067200 + id * 60) AS timestamp")
