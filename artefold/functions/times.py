"""Time expressions that do not depend on the zone of the session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utc_seconds(df: DataFrame, name: str) -> Column:
    """Whole Unix seconds of a time column; a time without zone is UTC."""
    c = F.col(name)
    if df.schema[name].dataType.simpleString() == "timestamp_ntz":
        return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c))
    return F.floor(F.unix_micros(c.cast("timestamp")) / 1_000_000).cast("bigint")
