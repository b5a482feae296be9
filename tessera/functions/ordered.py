"""Nearest known value in time order, without one task per subject.

A window over ``subject_id`` puts a subject's whole history in one task.  Here a long history is
cut into slices of about equal numbers of rows, whatever the times: the cuts are rows of the
history itself, drawn by a hash.  A window inside each slice finds what it can, one small row
per slice carries the rest across.  A subject is spread over as many tasks as it has slices, and
the carrying window sees one row per slice only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessera.functions.timing import epoch_micros

SLICE_ROWS = 200_000
# Cuts are every so many of the drawn rows: so slices differ less in size than single draws do.
_DRAWN = 8
# Cuts of all parts together: they are broadcast.
MAX_CUTS = 100_000


def order_key(time: str, tiebreak: Sequence[str]) -> Column:
    """Total order as one comparable value: time with nulls last, then tie-breaks."""
    return F.struct(
        F.col(time).isNull().alias("untimed"),
        F.col(time).alias("at"),
        *[F.col(c).alias(f"tie{i}") for i, c in enumerate(tiebreak)],
    )


# Fixed-width form of the order: microseconds · 10^20 plus the tie-break above its least value.
_TIE_SPAN = "100000000000000000000"
_TIE_SHIFT = "9223372036854775809"
_UNTIMED_MICROS = 998_000_000_000_000_000


def rank_key(df: DataFrame, time: str, tiebreak: Sequence[str]) -> Column:
    """The order of :func:`order_key` as one decimal where the tie-break is one whole number.

    Aggregates by a struct sort their input on both sides of the shuffle; by a decimal they
    are hashed.  Holds for times before the year 33,000; other tie-breaks keep the struct.
    """
    whole = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    if len(tiebreak) != 1 or not isinstance(df.schema[tiebreak[0]].dataType, whole):
        return order_key(time, tiebreak)
    micros = F.coalesce(epoch_micros(time), F.lit(_UNTIMED_MICROS)).cast("decimal(18,0)")
    tie = F.coalesce(F.col(tiebreak[0]).cast("decimal(20,0)") + F.lit(_TIE_SHIFT).cast("decimal(20,0)"),
                     F.lit(0).cast("decimal(20,0)"))
    scaled = micros * F.lit(_TIE_SPAN).cast("decimal(21,0)")
    return (scaled.cast("decimal(38,0)") + tie.cast("decimal(38,0)")).cast("decimal(38,0)")


def slice_cuts(df: DataFrame, *, part: str, time: str, tiebreak: Sequence[str],
               slice_rows: int | None = None) -> DataFrame:
    """``(part, _cuts)``: the sorted order keys at which the histories of long parts are cut.

    A row is drawn by the hash of its part, time and tie-breaks, so the cuts depend on the data
    alone and every plan that uses them cuts alike.  Slices have about ``slice_rows`` rows
    (``SLICE_ROWS`` if not given), and most parts of fewer rows have no cut.  There are ``MAX_CUTS`` cuts at most, also where slices grow longer by that.
    """
    key = [F.col(c) for c in (part, time, *tiebreak)]
    h = F.xxhash64(*key)
    drawn = (df.filter(F.pmod(h, F.lit(max(1, (slice_rows or SLICE_ROWS) // _DRAWN))) == 0)
             .select(F.col(part), rank_key(df, time, tiebreak).alias("_key"), h.alias("_h")))
    # The filter leaves few rows of each task for the limit to look at.
    drawn = drawn.orderBy("_h").limit(_DRAWN * MAX_CUTS)
    cuts = drawn.groupBy(part).agg(F.sort_array(F.collect_list("_key")).alias("_cuts"))
    every = F.filter("_cuts", lambda _, i: F.pmod(i, F.lit(_DRAWN)) == _DRAWN - 1)
    return cuts.select(part, every.alias("_cuts")).filter(F.size("_cuts") > 0)


def _cuts_before(key: Column) -> Column:
    """How many cuts are not after a key, by halving; 0 where a part has no cuts."""
    start = F.struct(F.lit(0).alias("low"), F.size("_cuts").alias("high"))
    halvings = F.sequence(F.lit(1), F.length(F.bin(F.size("_cuts"))))

    def halve(at: Column, _) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        right = (at["low"] < at["high"]) & (F.get("_cuts", middle) <= key)
        left = (at["low"] < at["high"]) & ~right
        return F.struct(F.when(right, middle + 1).otherwise(at["low"]).alias("low"),
                        F.when(left, middle).otherwise(at["high"]).alias("high"))

    return F.when(F.col("_cuts").isNull(), 0).otherwise(F.aggregate(halvings, start, halve)["low"])


def sliced(df: DataFrame, cuts: DataFrame, *, part: str, time: str, tiebreak: Sequence[str]) -> DataFrame:
    """Add ``_slice``, the number of a row's slice within its part, ascending in time order."""
    # ``MAX_CUTS`` bounds the broadcast side.
    return (df.join(F.broadcast(cuts), part, "left")
            .withColumn("_slice", _cuts_before(rank_key(df, time, tiebreak))).drop("_cuts"))


def nearest_known(df: DataFrame, known: dict[str, str], *, part: str, time: str,
                  tiebreak: Sequence[str], forward: bool, include_current: bool,
                  slice_rows: int | None = None, edges_from: DataFrame | None = None,
                  cuts: DataFrame | None = None) -> DataFrame:
    """Add, per entry ``new -> source`` of ``known``, the nearest non-null ``source``.

    ``forward=True`` looks at following rows, else at preceding ones.  ``part`` must
    not be null.  ``edges_from`` may give fewer rows with the same columns that still hold
    the outermost known value of every slice; ``cuts`` are those of :func:`slice_cuts`.
    """
    order_of = {"part": part, "time": time, "tiebreak": tiebreak}
    if cuts is None:
        cuts = slice_cuts(df, **order_of, slice_rows=slice_rows)
    rows = sliced(df, cuts, **order_of)
    outer = rows if edges_from is None else sliced(edges_from, cuts, **order_of)

    order = [F.col(time).isNull(), F.col(time), *[F.col(c) for c in tiebreak]]
    turned = [c.desc() for c in order] if forward else [c.asc() for c in order]
    last_row = 0 if include_current else -1
    inside = (Window.partitionBy(part, "_slice").orderBy(*turned)
              .rowsBetween(Window.unboundedPreceding, last_row))

    # What a slice hands on; only parts that are cut have anything to hand on.
    pick = F.min_by if forward else F.max_by
    key = rank_key(outer, time, tiebreak)
    per_slice = join_by_cut(outer, cuts, part).groupBy(part, "_slice").agg(*[
        pick(F.col(src), F.when(F.col(src).isNotNull(), key)).alias(f"_edge_{new}")
        for new, src in known.items()
    ])
    # Every slice gets a row, also one without a known value.
    every = cuts.select(part, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_slice"))
    slice_order = F.col("_slice").desc() if forward else F.col("_slice").asc()
    across = (Window.partitionBy(part).orderBy(slice_order)
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = every.join(per_slice, [part, "_slice"], "left").select(part, "_slice", *[
        F.last(f"_edge_{new}", ignorenulls=True).over(across).alias(f"_carry_{new}")
        for new in known
    ])

    local = rows.select("*", *[
        F.last(src, ignorenulls=True).over(inside).alias(f"_near_{new}")
        for new, src in known.items()
    ])
    kept = [c for c in df.columns if c not in known]
    # As many rows as slices: bounded as the cuts are.
    return local.join(F.broadcast(carried), [part, "_slice"], "left").select(*kept, *[
        F.coalesce(f"_near_{new}", f"_carry_{new}").alias(new) for new in known
    ])


def join_by_cut(rows: DataFrame, cuts: DataFrame, part: str) -> DataFrame:
    """Rows of parts that are cut."""
    return rows.join(F.broadcast(cuts.select(part)), part, "left_semi")
