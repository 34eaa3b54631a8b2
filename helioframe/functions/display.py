"""What the dashboard derives from a row: scales, percents and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hardness_display(short: Column, long: Column) -> Column:
    """Table variant: only a zero or missing long flux is replaced, three decimals."""
    return F.round(short / F.coalesce(F.nullif(long, F.lit(0.0)), F.lit(1e-9)), 3)


def normalised_flux(long: Column) -> Column:
    shown = F.coalesce(F.nullif(long, F.lit(0.0)), F.lit(1e-7))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.log10(shown) + 9) / 6)


def gauge_value(short: Column) -> Column:
    return F.round(short * 1e7, 1)


def gauge_percent(short: Column) -> Column:
    return F.least(F.lit(100.0), short * 1e7 * 10)


def hardness_percent(ratio: Column) -> Column:
    return F.least(F.lit(100.0), ratio * 1500)


def percent(prob: Column) -> Column:
    return F.round(prob * 100, 0).cast("int")


def short_time(ts: Column) -> Column:
    return F.date_format(ts, "MM/dd HH:mm")


def full_time(ts: Column) -> Column:
    return ts.cast("string")


def clock_part(ts: Column) -> Column:
    return F.split(full_time(ts), " ")[1]


def scientific(value: Column, unit: str) -> Column:
    return F.format_string(f"%.2e {unit}", value)


def local_time(ts: Column, zone: str = "Asia/Kolkata") -> Column:
    return F.from_utc_timestamp(ts, zone)
