"""Scalar value rules: missing values, coercion, scaling, clipping, rounding."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def present(value: str | Column) -> Column:
    """Neither null nor NaN."""
    col = F.col(value) if isinstance(value, str) else value
    return col.isNotNull() & ~F.isnan(col)


def present_or_null(value: str | Column) -> Column:
    """NaN becomes null, so that no aggregate ever meets one."""
    col = F.col(value) if isinstance(value, str) else value
    return F.when(present(col), col)


def from_number_text(text: str | Column) -> Column:
    """Number written as text: digits once ``.`` and ``-`` are taken out, else missing.

    ``12.5`` and ``-3`` are numbers; ``1e5``, ``>10``, ``1.2.3`` and ``___`` are not.
    """
    col = F.col(text) if isinstance(text, str) else text
    only_digits = F.regexp_replace(col, "[.-]", "").rlike("^[0-9]+$")
    return F.when(only_digits, col.try_cast("double"))


def clip(value: Column, low: float, high: float) -> Column:
    """Clip that keeps null (``least``/``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def reference_scaled(value: Column, low: Column, high: Column, *, clipped: bool = True,
                     missing_fill: float | None = None) -> Column:
    """Position inside the reference range, ``[0, 1]`` when clipped.

    Without a usable range the raw value is taken; missing gives ``missing_fill``.
    """
    value = present_or_null(value)
    usable = present(low) & present(high) & (high > low)
    scaled = F.when(usable, (value - low) / (high - low)).otherwise(value)
    if clipped:
        scaled = clip(scaled, 0.0, 1.0)
    return scaled if missing_fill is None else F.coalesce(scaled, F.lit(missing_fill))


def zlog_scaled(value: Column, low: Column, high: Column) -> Column:
    """Distance from the log-mid of the reference range, in log standard deviations.

    The range is taken as the central 95 %, hence the factor 2 · 1.96.
    """
    usable = (value > 0) & (low > 0) & (high > low)
    mid = (F.log(low) + F.log(high)) / 2
    return F.when(usable, (F.log(value) - mid) * F.lit(3.92) / (F.log(high) - F.log(low)))


def log_flag(itemid: Column, log_itemids: Iterable[int]) -> Column:
    ids = list(log_itemids)
    return F.coalesce(itemid.isin(ids), F.lit(False)) if ids else F.lit(False)


def log_where(value: Column, flag: Column) -> Column:
    """log(1 + x) on flagged channels; x <= -1 has no logarithm and becomes missing."""
    return F.when(flag, F.when(value > -1, F.log1p(value))).otherwise(value)


def percent(part: Column, whole: Column) -> Column:
    """100 · part / whole, null when the whole is empty."""
    return F.when(whole > 0, F.lit(100.0) * part / whole)


def grid_row(index: Column, width: int) -> Column:
    return ((index - index % F.lit(width)) / F.lit(width)).cast("int")


def grid_col(index: Column, width: int) -> Column:
    return (index % F.lit(width)).cast("int")


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)
