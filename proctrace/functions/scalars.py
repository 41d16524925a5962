"""Small column functions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def iso(ts: Column) -> Column:
    """ISO 8601; microseconds appear only where they aren't zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def epoch_text(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def to_data_url(jpeg: Column) -> Column:
    # base64() may break lines
    return F.concat(F.lit("data:image/jpeg;base64,"), F.translate(F.base64(jpeg), "\r\n", ""))


def percent(part: Column, whole: Column) -> Column:
    """part / whole in percent, 0 where there is no whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole * 100.0)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row, however often use refers to it, in lambdas too."""
    return F.transform(F.array(value), use)[0]
