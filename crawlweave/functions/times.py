"""Instants and spans as whole microseconds, so that no sum or comparison rounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US_PER_S = 1_000_000


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session zone is."""
    col = F.col(ts) if isinstance(ts, str) else ts
    since = col.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(20,6)") * US_PER_S).cast("bigint")


def from_epoch_us(us: Column | str) -> Column:
    col = F.col(us) if isinstance(us, str) else us
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (col.cast("decimal(20,0)") / US_PER_S).cast("decimal(18,6)")
    )


def floor_div(value: Column, width: int) -> Column:
    """Number of the fixed-width bucket a bigint falls in; also right below zero."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))
