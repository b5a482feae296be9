import random

import pandas as pd
import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from tessera.functions import ordered
from tessera.operators import link

EVENTS = "event_id long, subject_id long, charttime timestamp_ntz, hadm_id long, itemid int"
ADMISSIONS = "hadm_id long, admittime timestamp_ntz"


@pytest.fixture(scope="module")
def micro(spark):
    events = [(1, 7, at("01-01 00:00"), 100, 1), (2, 7, at("01-04 20:00"), None, 1),
              (3, 7, at("01-05 00:00"), 101, 1), (4, 7, at("02-08 23:00"), None, 1),
              (5, 7, at("02-09 05:00"), 102, 1), (6, 7, at("03-09 05:00"), None, 1),
              (7, 7, None, None, 2), (8, None, at("01-01 00:00"), 100, 1)]
    admissions = [(100, at("01-01 00:00")), (101, at("01-05 00:00")), (102, at("02-09 04:00"))]
    return spark.createDataFrame(events, EVENTS), spark.createDataFrame(admissions, ADMISSIONS)


LAST = at("02-09 04:00")


@pytest.mark.parametrize("policy, want", [
    ("suffix_last", [(1, LAST, 100), (2, LAST, None), (3, LAST, 101), (4, LAST, 102),
                     (5, LAST, 102), (6, None, None), (7, None, None)]),
    ("next", [(1, at("01-01 00:00"), 100), (2, at("01-05 00:00"), 101),
              (3, at("01-05 00:00"), 101), (4, LAST, 102), (5, LAST, 102), (6, None, None),
              (7, None, None)])])
def test_both_policies(micro, policy, want):
    out = link.link_events(*micro, policy=policy)
    assert rows(out, "event_id", "admittime", "hadm_id") == want


def test_rows_without_subject_vanish_and_nothing_else(micro):
    events, admissions = micro
    out = link.link_events(events, admissions)
    assert out.count() == events.filter("subject_id is not null").count()
    assert set(out.columns) == {"event_id", "subject_id", "charttime", "hadm_id", "itemid",
                                "admittime"}


def test_linked_only_and_labels(spark, micro):
    vocabulary = spark.createDataFrame([(1, "sodium")], "itemid int, label string")
    out = link.link_events(*micro, vocabulary=vocabulary, linked_only=True)
    assert rows(out, "event_id", "lab_label") == [(i, "sodium") for i in (1, 3, 4, 5)]
    everything = link.link_events(*micro, vocabulary=vocabulary)
    assert rows(everything.filter("event_id = 7"), "lab_label") == [(None,)]


@pytest.mark.parametrize("minute, linked", [("00", True), ("01", True)])
def test_exactly_24_hours_before_is_linked(spark, minute, linked):
    events = spark.createDataFrame(
        [(1, 7, at(f"01-01 12:{minute}"), None, 1), (2, 7, at("01-02 12:00"), 5, 1),
         (3, 7, at("01-01 11:59"), None, 1)], EVENTS)
    admissions = spark.createDataFrame([(5, at("01-02 12:00"))], ADMISSIONS)
    got = dict(rows(link.link_events(events, admissions), "event_id", "hadm_id"))
    assert got == {1: 5 if linked else None, 2: 5, 3: None}


def test_unknown_policy_is_refused(micro):
    with pytest.raises(ValueError):
        link.link_events(*micro, policy="previous")


def brute(events, admissions, policy):
    admit = dict(admissions)
    frame = pd.DataFrame(events, columns=["id", "s", "t", "h", "i"]).sort_values(
        ["t", "id"], na_position="last")
    out = {}
    for _, group in frame.groupby("s"):
        recs = group.to_dict("records")
        for n, r in enumerate(recs):
            rest = recs[n:]
            hs = [x["h"] for x in rest if not pd.isna(x["h"])]
            ts = [admit[h] for h in hs if h in admit]
            pick = (lambda xs: xs[-1] if xs else None) if policy == "suffix_last" else (
                lambda xs: xs[0] if xs else None)
            filled, hadm = pick(ts), None if pd.isna(r["h"]) else int(r["h"])
            if (hadm is None and filled is not None and not pd.isna(r["t"])
                    and pd.Timedelta(0) <= filled - r["t"] <= pd.Timedelta(hours=24)):
                hadm = int(pick(hs))
            out[r["id"]] = (filled, hadm)
    return out


@pytest.mark.parametrize("policy", link.POLICIES)
@pytest.mark.parametrize("untimed", [0.05, 0.6])
def test_hot_subject_equals_brute_force(spark, policy, untimed, monkeypatch):
    # Small slices, so that rows without a time fall into many of them as well.
    monkeypatch.setattr(ordered, "SLICE_ROWS", 40)
    rng = random.Random(11)
    start = pd.Timestamp("2020-01-01")

    def time():
        return (start + pd.Timedelta(minutes=30 * rng.randint(0, 3000))).to_pydatetime()

    admissions = [(h, time()) for h in range(30)]
    # Ids 30..34 are not in the admission table.
    events = [(i, 1 if rng.random() < 0.6 else rng.randint(2, 5),
               None if rng.random() < untimed else time(),
               rng.randint(0, 34) if rng.random() < 0.2 else None, 1) for i in range(500)]
    out = link.fill_admissions(spark.createDataFrame(events, EVENTS),
                               spark.createDataFrame(admissions, ADMISSIONS), policy=policy)
    got = {r["event_id"]: (r["admittime_filled"], r["hadm_id_filled"]) for r in out.collect()}
    assert got == brute(events, admissions, policy)


def test_default_policy_has_no_window(micro):
    plan = link.link_events(*micro)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
