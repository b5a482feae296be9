"""Elapsed time, time bins and observation windows as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS_PER_HOUR = 3_600_000_000.0


def elapsed_micros(later: str, earlier: str) -> Column:
    """Whole microseconds from ``earlier`` to ``later``."""
    return F.timestamp_diff("MICROSECOND", F.col(earlier), F.col(later))


def elapsed_hours(later: str, earlier: str) -> Column:
    return elapsed_micros(later, earlier) / F.lit(MICROS_PER_HOUR)


def span_hours(first: Column, last: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", first, last) / F.lit(MICROS_PER_HOUR)


def epoch_micros(ts: str | Column) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def bin_position(bin_hours: float, time: str = "charttime", anchor: str = "admittime") -> Column:
    """Elapsed time in units of bins, not yet floored."""
    return elapsed_micros(time, anchor) / F.lit(bin_hours * MICROS_PER_HOUR)


def time_bin(bin_hours: float, time: str = "charttime", anchor: str = "admittime") -> Column:
    return F.floor(bin_position(bin_hours, time, anchor)).cast("int")


def after_anchor(time: str = "charttime", anchor: str = "admittime") -> Column:
    """Raw-column part of every window predicate; it reaches the scan."""
    return F.col(time).isNotNull() & F.col(anchor).isNotNull() & (F.col(time) >= F.col(anchor))


def in_window(window_hours: float, time: str = "charttime", anchor: str = "admittime") -> Column:
    """Half-open observation window ``[anchor, anchor + window)``."""
    return after_anchor(time, anchor) & (elapsed_hours(time, anchor) < F.lit(float(window_hours)))


def in_bins(n_bins: int, bin_hours: float, time: str = "charttime",
            anchor: str = "admittime") -> Column:
    """Window of whole bins; differs from :func:`in_window` where bins do not divide it."""
    return after_anchor(time, anchor) & (bin_position(bin_hours, time, anchor) < F.lit(n_bins))


def in_first_hours(hours: int, time: str = "charttime", anchor: str = "admittime") -> Column:
    """The same kind of window written with interval arithmetic."""
    return after_anchor(time, anchor) & (
        F.col(time) < F.col(anchor) + F.make_dt_interval(hours=F.lit(hours))
    )


def in_lookback(hours: int, time: Column, anchor: Column) -> Column:
    """True for an event up to ``hours`` before the anchor, both ends included."""
    return (anchor >= time) & (anchor <= time + F.make_dt_interval(hours=F.lit(hours)))


def bin_count(window_hours: float, bin_hours: float) -> int:
    """Whole bins in a window; a last partial bin is cut off."""
    return int(window_hours / bin_hours)


def hour_label(bin_col: Column, bin_hours: float) -> Column:
    """``"1–2h"``: bounds of a bin without decimals."""
    lo = F.bround(bin_col * F.lit(float(bin_hours)), 0).cast("long").cast("string")
    hi = F.bround((bin_col + 1) * F.lit(float(bin_hours)), 0).cast("long").cast("string")
    return F.concat(lo, F.lit("–"), hi, F.lit("h"))
