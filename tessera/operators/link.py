"""Link events to admissions and fill the link for events shortly before admission."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tessera.constants import LOOKBACK_HOURS
from tessera.functions.lookups import join_by_key, lookup
from tessera.functions.ordered import join_by_cut, nearest_known, rank_key, slice_cuts, sliced
from tessera.functions.timing import in_lookback

TIEBREAK = ("event_id",)
POLICIES = ("suffix_last", "next")


def attach_admissions(events: DataFrame, admissions: DataFrame, *,
                      columns: Sequence[str] = ("admittime",),
                      spread_by: Sequence[str] = TIEBREAK) -> DataFrame:
    """Event left join admission on ``hadm_id``; null ids do not meet in one task."""
    return lookup(events, admissions.select("hadm_id", *columns), "hadm_id", spread_by=spread_by)


def attach_labels(events: DataFrame, vocabulary: DataFrame, *, name: str = "lab_label",
                  spread_by: Sequence[str] = TIEBREAK) -> DataFrame:
    """Event left join vocabulary on ``itemid``."""
    labels = vocabulary.select("itemid", F.col("label").alias(name))
    return lookup(events, labels, "itemid", spread_by=spread_by)


def _fill_from_last(events: DataFrame, admissions: DataFrame, tiebreak: Sequence[str]) -> DataFrame:
    """The last known value up to the end of the subject's history.

    That value is the same for all rows up to the row that holds it, so it is one
    aggregate per subject instead of a window.  Rows of one admission collapse before
    admissions are joined, and events are joined with one row per subject.
    """
    key = rank_key(events, "charttime", tiebreak)
    stays = (events.filter(F.col("hadm_id").isNotNull())
             .groupBy("subject_id", "hadm_id").agg(F.max(key).alias("k")))
    known = stays.join(admissions.select("hadm_id", "admittime"), "hadm_id", "left")
    timed = F.when(F.col("admittime").isNotNull(), F.col("k"))
    last = known.groupBy("subject_id").agg(
        F.max_by("hadm_id", "k").alias("_hadm"), F.max("k").alias("_hadm_at"),
        F.max_by("admittime", timed).alias("_admit"), F.max(timed).alias("_admit_at"),
    )
    return join_by_key(events, last, "subject_id", "left").select(
        *[F.col(c) for c in events.columns],
        F.when(key <= F.col("_admit_at"), F.col("_admit")).alias("_admit_filled"),
        F.when(key <= F.col("_hadm_at"), F.col("_hadm")).alias("_hadm_filled"),
    )


def _fill_from_next(events: DataFrame, admissions: DataFrame, tiebreak: Sequence[str]) -> DataFrame:
    """The value of the nearest following row that has one (the row itself included)."""
    attached = attach_admissions(events, admissions, spread_by=tiebreak)
    order_of = {"part": "subject_id", "time": "charttime", "tiebreak": tiebreak}
    cuts = slice_cuts(events, **order_of)
    # The first row of each admission in a slice is enough to know the slice's first values.
    first = (join_by_cut(sliced(events.filter(F.col("hadm_id").isNotNull()), cuts, **order_of), cuts, "subject_id")
             .groupBy("subject_id", "hadm_id", "_slice")
             .agg(*[F.min_by(c, rank_key(events, "charttime", tiebreak)).alias(c)
                    for c in ("charttime", *tiebreak)])
             .drop("_slice")
             .join(admissions.select("hadm_id", "admittime"), "hadm_id", "left"))
    filled = nearest_known(
        attached, {"_admit_filled": "admittime", "_hadm_filled": "hadm_id"}, **order_of,
        forward=True, include_current=True, edges_from=first, cuts=cuts)
    return filled.drop("admittime")


def fill_admissions(events: DataFrame, admissions: DataFrame, *, policy: str = "suffix_last",
                    lookback_hours: int = LOOKBACK_HOURS,
                    tiebreak: Sequence[str] = TIEBREAK) -> DataFrame:
    """Events with a subject, plus ``admittime_filled``, ``before_admit`` and ``hadm_id_filled``.

    ``suffix_last`` takes the subject's last admission in the remaining history (the
    published behaviour); ``next`` takes the next one.  An existing ``hadm_id`` is kept.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    fill = _fill_from_last if policy == "suffix_last" else _fill_from_next
    filled = fill(events.filter(F.col("subject_id").isNotNull()), admissions, tiebreak)
    before = in_lookback(lookback_hours, F.col("charttime"), F.col("_admit_filled"))
    return filled.select(
        *[F.col(c) for c in events.columns],
        F.col("_admit_filled").alias("admittime_filled"),
        before.alias("before_admit"),
        F.when(before & F.col("hadm_id").isNull(), F.col("_hadm_filled"))
        .otherwise(F.col("hadm_id")).alias("hadm_id_filled"),
    )


def link_events(events: DataFrame, admissions: DataFrame, *, vocabulary: DataFrame | None = None,
                policy: str = "suffix_last", linked_only: bool = False,
                lookback_hours: int = LOOKBACK_HOURS,
                tiebreak: Sequence[str] = TIEBREAK) -> DataFrame:
    """All event columns with ``hadm_id`` and ``admittime`` filled, and ``lab_label`` if asked."""
    filled = fill_admissions(events, admissions, policy=policy,
                             lookback_hours=lookback_hours, tiebreak=tiebreak)
    linked = (filled.drop("hadm_id", "before_admit")
              .withColumnRenamed("hadm_id_filled", "hadm_id")
              .withColumnRenamed("admittime_filled", "admittime"))
    if linked_only:
        linked = linked.filter(F.col("hadm_id").isNotNull())
    if vocabulary is not None:
        linked = attach_labels(linked, vocabulary, spread_by=tiebreak)
    return linked
