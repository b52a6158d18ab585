"""Aggregate and window expressions with fixed tie and edge rules."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def arg_max(key: Column | str, value: Column | str) -> Column:
    """Key of the largest value; the smallest key wins a tie.

    Two passes in one aggregate are avoided by collecting nothing: the smallest
    key among equal values is the minimum of (-value, key).
    """
    v = F.col(value) if isinstance(value, str) else value
    k = F.col(key) if isinstance(key, str) else key
    return F.min(F.struct((-v).alias("v"), k.alias("k")))["k"]


def arg_min(key: Column | str, value: Column | str) -> Column:
    """Key of the smallest value; the smallest key wins a tie."""
    v = F.col(value) if isinstance(value, str) else value
    k = F.col(key) if isinstance(key, str) else key
    return F.min(F.struct(v.alias("v"), k.alias("k")))["k"]


def full_frame(agg: Column, w: WindowSpec, rows: int) -> Column:
    """Window aggregate that stays null until the frame holds ``rows`` rows."""
    return F.when(F.count(F.lit(1)).over(w) == rows, agg.over(w))


def pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def beyond_deviations(y: Column, w: WindowSpec, k: int) -> Column:
    """Whether |y - mean| > k sample deviations of the frame.

    Both sides are squared and multiplied out, so that whole-number series are
    compared exactly: (n y - S)^2 (n - 1) > k^2 n (n Q - S^2) with S the sum and
    Q the sum of squares. A frame of one row is never beyond.
    """
    n, s, q = F.count(y).over(w), F.sum(y).over(w), F.sum(y * y).over(w)
    return (n * y - s) * (n * y - s) * (n - 1) > k * k * n * (n * q - s * s)
