"""Scalar rules that engines differ on, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated(c: Column) -> Column:
    """Toward zero, as an integer cast of a float."""
    return c.cast("int")


def round_half_even(c: Column) -> Column:
    return F.bround(c, 0)


def clip(c: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(c, low), high)


def sigmoid(c: Column, slope: float = 1.0, middle: float = 0.0) -> Column:
    return 1 / (1 + F.exp(-slope * (c - middle)))


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0))


def run_name(prefix: str) -> Column:
    """A model name with the time of the run."""
    return F.concat(F.lit(prefix + "_"), F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss"))
