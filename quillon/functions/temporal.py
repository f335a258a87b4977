"""Time of day as microseconds since midnight, and days since the epoch."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_micros(ts: Column) -> Column:
    return (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def epoch_days(date: Column) -> Column:
    return F.unix_date(date)
