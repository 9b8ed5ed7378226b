"""Rounding and fixed-decimal text.

``round_half_even`` follows numpy (scale, round half to even, unscale);
``F.round`` is half-up and would give 0.13 for 0.125.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c: Column | str, digits: int) -> Column:
    scale = F.lit(10.0**digits)
    # Adding 0.0 turns a negative zero into a plain one.
    return F.rint(_column(c) * scale) / scale + F.lit(0.0)


def fixed(c: Column | str, digits: int) -> Column:
    """Text with exactly ``digits`` decimals; null stays null."""
    c = _column(c)
    text = F.format_string(f"%.{digits}f", round_half_even(c, digits))
    infinite = F.abs(c) == F.lit(float("inf"))
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(c), F.lit("nan"))
        .when(infinite, F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .otherwise(text)
    )


def sanitize_symbol(c: Column | str) -> Column:
    return F.replace(_column(c), F.lit("/"), F.lit("_"))


def run_timestamp(c: Column | str) -> Column:
    """The ``YYYYMMDD_HHMM`` prefix used to name result sets."""
    return F.date_format(_column(c), "yyyyMMdd_HHmm")
