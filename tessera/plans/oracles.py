"""The same results in ANSI SQL for DuckDB, over the same tables."""

from __future__ import annotations

import re

# Named steps; a query pulls in the ones it mentions, in this order.
STEPS: dict[str, str] = {
    "ev0": """
        SELECT event_id, user_id AS subject_id, user_id AS hadm_id,
               user_id * 1000 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))
                   AS specimen_id,
               ts AS charttime, 1000 + k AS itemid,
               CASE WHEN event_type <> 'error' THEN value END AS valuenum,
               CASE WHEN k % 4 <> 0 THEN CAST(10 AS DOUBLE) END AS lo,
               CASE WHEN k % 4 <> 0 THEN CAST(90 AS DOUBLE) END AS hi, k, event_type
        FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)""",
    "ev": """
        SELECT ev0.*, a.admittime, epoch_us(charttime) - epoch_us(a.admittime) AS elapsed
        FROM ev0 JOIN (SELECT hadm_id, min(charttime) AS admittime FROM ev0 GROUP BY hadm_id) a
        USING (hadm_id)""",
    "voc": """
        SELECT DISTINCT itemid, 'lab_' || k AS label,
               CASE WHEN k % 10 = 9 THEN NULL WHEN k % 3 = 0 THEN 'Blood Gas'
                    WHEN k % 3 = 1 THEN 'Chemistry' ELSE 'Hematology' END AS category
        FROM ev0 WHERE k < 97""",
    "li": """
        SELECT l_orderkey AS hadm_id, o_custkey AS subject_id, o_orderdate AS admittime,
               l_orderkey * 100000 + l_suppkey AS specimen_id, l_partkey AS itemid,
               l_quantity AS valuenum, l_shipdate AS charttime, l_linenumber,
               epoch_us(l_shipdate) - epoch_us(o_orderdate) AS elapsed
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "eb": """
        SELECT event_id, subject_id, CASE WHEN event_type = 'signup' THEN event_id END AS hadm_id,
               specimen_id, charttime, itemid, valuenum
        FROM ev0""",
    "ebadm": """
        SELECT event_id AS hadm_id, ts AS admittime FROM events WHERE event_type = 'signup'""",
    "ebjoin": "SELECT eb.*, a.admittime FROM eb LEFT JOIN ebadm a USING (hadm_id)",
    "ebfill": """
        SELECT *, last_value(admittime IGNORE NULLS) OVER w AS af,
               last_value(hadm_id IGNORE NULLS) OVER w AS hs
        FROM ebjoin
        WINDOW w AS (PARTITION BY subject_id ORDER BY charttime NULLS LAST, event_id
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "eblast": """
        SELECT event_id, subject_id, specimen_id, charttime, itemid, valuenum, af AS admittime,
               coalesce(af >= charttime AND af - charttime <= INTERVAL 24 HOURS, false) AS pre,
               CASE WHEN af >= charttime AND af - charttime <= INTERVAL 24 HOURS
                         AND hadm_id IS NULL THEN hs ELSE hadm_id END AS hadm_id
        FROM ebfill""",
    "ebnext": """
        SELECT event_id, af, CASE WHEN af >= charttime
                   AND af - charttime <= INTERVAL 24 HOURS AND hadm_id IS NULL
                   THEN hs ELSE hadm_id END AS hadm_id_filled
        FROM (SELECT *, first_value(admittime IGNORE NULLS) OVER w AS af,
                     first_value(hadm_id IGNORE NULLS) OVER w AS hs
              FROM ebjoin
              WINDOW w AS (PARTITION BY subject_id ORDER BY charttime NULLS LAST, event_id
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    "evsub": """
        SELECT hadm_id, count(DISTINCT specimen_id) AS n_specimens FROM ev0
        GROUP BY hadm_id HAVING count(DISTINCT specimen_id) <= 26""",
    "lisub": """
        SELECT hadm_id, count(DISTINCT specimen_id) AS n_specimens FROM li
        GROUP BY hadm_id HAVING count(DISTINCT specimen_id) <= 4""",
    "ranked": """
        SELECT itemid, count(*) AS n_events,
               row_number() OVER (ORDER BY count(*) DESC, itemid) AS rank
        FROM ev0 WHERE itemid NOT IN (1000, 1001)
        GROUP BY itemid ORDER BY n_events DESC, itemid LIMIT 64""",
    "imgranked": """
        SELECT itemid, count(*) AS n_events,
               row_number() OVER (ORDER BY count(*) DESC, itemid) AS rank
        FROM ev0 GROUP BY itemid ORDER BY n_events DESC, itemid LIMIT 64""",
    "layout": """
        SELECT CAST(i AS INTEGER) AS index, CAST(i // 8 AS INTEGER) AS row,
               CAST(i % 8 AS INTEGER) AS col, itemid, label, category
        FROM (SELECT *, row_number() OVER (ORDER BY category NULLS LAST, itemid) - 1 AS i
              FROM voc JOIN ranked USING (itemid))""",
    "imglayout": """
        SELECT CAST(i AS INTEGER) AS index, CAST(i // 8 AS INTEGER) AS row,
               CAST(i % 8 AS INTEGER) AS col, itemid, label, category
        FROM (SELECT *, row_number() OVER (ORDER BY category NULLS LAST, itemid) - 1 AS i
              FROM voc JOIN imgranked USING (itemid))""",
    "placed": """
        SELECT ev.*, row, col, label,
               CAST(floor(elapsed / (30 * 3.6e9)) AS INTEGER) AS time_bin
        FROM ev JOIN layout USING (itemid)
        WHERE charttime >= admittime AND elapsed / (30 * 3.6e9) < 24""",
    "cells": """
        SELECT hadm_id, time_bin, row, col, itemid,
               CAST(CAST(arg_max(valuenum, (charttime, event_id)) AS FLOAT) AS DOUBLE) AS value
        FROM placed WHERE valuenum IS NOT NULL
        GROUP BY hadm_id, time_bin, row, col, itemid""",
    "cohort": """
        SELECT DISTINCT hadm_id FROM ev
        WHERE charttime >= admittime AND elapsed / 3.6e9 < 720""",
    "spine": "SELECT hadm_id, CAST(t AS INTEGER) AS time_bin FROM cohort, range(24) r(t)",
    "frames": """
        SELECT s.hadm_id, s.time_bin, coalesce(c.n, 0) AS n_cells_filled,
               round_even(100.0::DOUBLE * coalesce(c.n, 0) / 64, 1) AS fill_pct,
               coalesce(p.n_spec, 0) AS n_specimens_merged,
               coalesce(p.span, 0) AS time_span_minutes, c.lo AS value_min, c.hi AS value_max
        FROM spine s
        LEFT JOIN (SELECT hadm_id, time_bin, count(*) AS n, min(value) AS lo, max(value) AS hi
                   FROM cells GROUP BY hadm_id, time_bin) c USING (hadm_id, time_bin)
        LEFT JOIN (SELECT hadm_id, time_bin, count(DISTINCT specimen_id) AS n_spec,
                          (max(elapsed) - min(elapsed)) / 6e7 AS span
                   FROM placed GROUP BY hadm_id, time_bin) p USING (hadm_id, time_bin)""",
    "summary": """
        SELECT h.hadm_id, CAST(1536 AS BIGINT) AS total_cells,
               coalesce(f.filled, 0) AS filled_cells,
               round_even(100.0::DOUBLE * coalesce(f.filled, 0) / 1536, 2) AS fill_pct,
               coalesce(f.frames, 0) AS frames_with_data,
               24 - coalesce(f.frames, 0) AS frames_empty,
               round_even(100.0::DOUBLE * coalesce(f.frames, 0) / 24, 1) AS temporal_density_pct,
               coalesce(p.specimens, 0) AS total_specimens_merged
        FROM cohort h
        LEFT JOIN (SELECT hadm_id, count(*) AS filled, count(DISTINCT time_bin) AS frames
                   FROM cells GROUP BY hadm_id) f USING (hadm_id)
        LEFT JOIN (SELECT hadm_id, count(DISTINCT specimen_id) AS specimens
                   FROM placed GROUP BY hadm_id) p USING (hadm_id)""",
    "dense": """
        SELECT h.hadm_id, CAST(p AS INTEGER) AS position, c.value
        FROM (SELECT hadm_id, p FROM cohort, range(1536) r(p)) h
        LEFT JOIN (SELECT hadm_id, time_bin * 64 + row * 8 + col AS p, value FROM cells) c
        USING (hadm_id, p)""",
    "logged": """
        SELECT *, CASE WHEN itemid % 5 = 0 THEN CASE WHEN value > -1 THEN ln(1 + value) END
                       ELSE value END AS x
        FROM cells""",
    "stats": """
        SELECT g.row, g.col, l.itemid, coalesce(l.label, '?') AS label,
               CASE WHEN l.itemid % 5 = 0 THEN 1 ELSE 0 END AS log_transform,
               coalesce(m, 0) AS mean, CASE WHEN s >= 1e-8 THEN s ELSE 1 END AS std,
               coalesce(n, 0) AS count
        FROM (SELECT CAST(i // 8 AS INTEGER) AS row, CAST(i % 8 AS INTEGER) AS col
              FROM range(64) r(i)) g
        LEFT JOIN layout l ON l.row = g.row AND l.col = g.col
        LEFT JOIN (SELECT row, col, avg(x) AS m, stddev_samp(x) AS s, count(*) AS n
                   FROM logged WHERE x IS NOT NULL GROUP BY row, col) f
             ON f.row = g.row AND f.col = g.col""",
    "normed": """
        SELECT l.hadm_id, l.time_bin, l.row, l.col, l.value,
               CAST(CAST(greatest(-10, least(10, (x - mean) / std)) AS FLOAT) AS DOUBLE) AS z
        FROM logged l JOIN stats s ON l.row = s.row AND l.col = s.col
        WHERE x IS NOT NULL""",
    "speccells": """
        SELECT * FROM (
            SELECT specimen_id, row, col, itemid, label,
                   CAST(CAST(max((charttime, event_id, valuenum))[3] AS FLOAT) AS DOUBLE) AS value
            FROM ev0 JOIN imglayout USING (itemid)
            GROUP BY specimen_id, row, col, itemid, label) WHERE value IS NOT NULL""",
    "specprof": """
        SELECT specimen_id, count(DISTINCT itemid) AS n_labs, count(*) AS n_events,
               100.0::DOUBLE * count(DISTINCT itemid) / 256 AS fill_pct
        FROM ev0 GROUP BY specimen_id""",
    "evprof": """
        SELECT hadm_id, count(*) AS n_events, count(DISTINCT itemid) AS n_labs,
               count(DISTINCT specimen_id) AS n_specimens,
               (epoch_us(max(charttime)) - epoch_us(min(charttime))) / 3.6e9 AS hours
        FROM ev0 GROUP BY hadm_id""",
    "liprof": """
        SELECT hadm_id, count(*) AS n_events, count(DISTINCT itemid) AS n_labs,
               count(DISTINCT specimen_id) AS n_specimens,
               (epoch_us(max(charttime)) - epoch_us(min(charttime))) / 3.6e9 AS hours
        FROM li WHERE charttime IS NOT NULL GROUP BY hadm_id""",
    "gaps": """
        SELECT hadm_id, specimen_id, (epoch_us(st) - epoch_us(pt)) / 3.6e9 AS gap_hours
        FROM (SELECT *, lag(st) OVER (PARTITION BY hadm_id ORDER BY st, specimen_id) AS pt
              FROM (SELECT hadm_id, specimen_id, min(charttime) AS st FROM ev0
                    GROUP BY hadm_id, specimen_id))
        WHERE pt IS NOT NULL""",
    "carried": """
        SELECT hadm_id, row, col, value, time_bin AS seen, CAST(b AS INTEGER) AS time_bin
        FROM (SELECT *, unnest(range(time_bin, coalesce(lead(time_bin) OVER
                  (PARTITION BY hadm_id, row, col ORDER BY time_bin), 24))) AS b FROM cells)""",
}


def _dist(rows: str) -> str:
    return f"""
        SELECT metric, count(*) AS n, round(avg(value), 6) AS mean,
               round(quantile_cont(value, 0.05), 6) AS p5,
               round(quantile_cont(value, 0.25), 6) AS p25,
               round(quantile_cont(value, 0.5), 6) AS p50,
               round(quantile_cont(value, 0.75), 6) AS p75,
               round(quantile_cont(value, 0.95), 6) AS p95,
               round(min(value), 6) AS min, round(max(value), 6) AS max
        FROM ({rows}) GROUP BY metric"""


def _stack(source: str, *columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM {source}" for c in columns)


def _sweep(source: str, subset: str, unit: str) -> str:
    per_k = " UNION ALL ".join(f"""
        SELECT {k} AS k, count(DISTINCT e.itemid) AS n
        FROM {source} e JOIN {subset} USING (hadm_id) JOIN sweeprank r ON e.itemid = r.itemid
        WHERE r.rank <= {k} GROUP BY e.{unit}""" for k in (64, 100, 144, 256))
    fill = "100.0::DOUBLE * n / k"
    return f"""
        WITH sweeprank AS (
            SELECT itemid, row_number() OVER (ORDER BY count(*) DESC, itemid) AS rank
            FROM {source} JOIN {subset} USING (hadm_id) GROUP BY itemid)
        SELECT k, count(*) AS n_units, round(avg(n), 6) AS mean_labs,
               round(quantile_cont(n::DOUBLE, 0.5), 6) AS median_labs,
               round(avg({fill}), 6) AS mean_fill,
               round(quantile_cont({fill}, 0.05), 6) AS p5,
               round(quantile_cont({fill}, 0.25), 6) AS p25,
               round(quantile_cont({fill}, 0.5), 6) AS p50,
               round(quantile_cont({fill}, 0.75), 6) AS p75,
               round(quantile_cont({fill}, 0.95), 6) AS p95
        FROM ({per_k}) GROUP BY k"""


def _histogram(rows: str, bins: int, density: bool) -> str:
    extra = ", round(coalesce(filled, 0) / (n * w), 6) AS density" if density else ""
    return f"""
        SELECT bin, round(lo + bin * w, 6) AS bin_low, round(lo + bin * w + w, 6) AS bin_high,
               coalesce(filled, 0) AS count{extra}
        FROM (SELECT CAST(unnest(range({bins})) AS INTEGER) AS bin) every
        CROSS JOIN (SELECT min(v) AS lo, count(*) AS n, (max(v) - min(v)) / {bins} AS w
                    FROM ({rows})) span
        LEFT JOIN (SELECT CAST(least(floor((v - lo) / w), {bins - 1}) AS INTEGER) AS bin,
                          count(*) AS filled
                   FROM ({rows}) r, (SELECT min(v) AS lo, (max(v) - min(v)) / {bins} AS w
                                     FROM ({rows})) GROUP BY 1) USING (bin)"""


_TIMELINE = ", ".join(
    f"max(CASE WHEN time_bin = {t} THEN fill_pct END) AS bin_{t}" for t in range(24))
_SCALED = "CASE WHEN hi > lo THEN (valuenum - lo) / (hi - lo) ELSE valuenum END"
_BUCKETS = """CASE WHEN hours < 24 THEN '<24h' WHEN hours < 72 THEN '24h–72h'
    WHEN hours < 168 THEN '72h–7d' WHEN hours < 336 THEN '7d–14d' ELSE '>14d' END"""
_STEPS = [("n_specimens", n) for n in (4, 8, 16, 24, 32, 48, 64)] + [
    ("n_labs", n) for n in (20, 30, 50, 80, 100)]
_GAP_ROWS = "SELECT gap_hours AS v FROM gaps WHERE gap_hours <= 48"
_OFFSET_ROWS = """SELECT (epoch_us(charttime) - epoch_us(zero)) / 3.6e9 AS v FROM (
    SELECT *, min(charttime) OVER (PARTITION BY hadm_id, itemid) AS zero FROM ev0)"""

MAIN: dict[str, str] = {
    "ingest_null_tokens": """
        SELECT event_id, CASE WHEN k % 10 >= 5 THEN subject_id END AS subject_id,
               CASE WHEN k % 4 <> 0 THEN k + 0.5::DOUBLE END AS valuenum,
               CASE WHEN k % 7 <> 0 THEN epoch_us(charttime) END AS charttime_us
        FROM ev0""",
    "specimen_events": """
        SELECT specimen_id, subject_id, epoch_us(charttime) AS charttime_us,
               CAST(itemid AS BIGINT) AS itemid, valuenum, lo AS ref_range_lower,
               hi AS ref_range_upper
        FROM ev WHERE specimen_id = (SELECT specimen_id FROM ev0 GROUP BY specimen_id
                                     ORDER BY count(*) DESC, specimen_id LIMIT 1)""",
    "link_left_join": "SELECT event_id, hadm_id, epoch_us(admittime) AS admittime_us FROM ebjoin",
    "link_with_label": """
        SELECT event_id, CAST(itemid AS BIGINT) AS itemid, label AS lab_label
        FROM eb LEFT JOIN voc USING (itemid)""",
    "backfill_admittime": """
        SELECT event_id, epoch_us(af) AS admittime_filled_us FROM ebfill""",
    "pre_admission_flag": "SELECT event_id, CAST(pre AS INTEGER) AS before_admit FROM eblast",
    "backfill_hadm": "SELECT event_id, hadm_id AS hadm_id_filled FROM eblast",
    "backfill_hadm_next": """
        SELECT event_id, hadm_id_filled, epoch_us(af) AS admittime_filled_us FROM ebnext""",
    "link_events": """
        SELECT event_id, subject_id, hadm_id, specimen_id, CAST(e.itemid AS BIGINT) AS itemid,
               valuenum, epoch_us(charttime) AS charttime_us, epoch_us(admittime) AS admittime_us,
               v.label AS lab_label
        FROM eblast e LEFT JOIN voc v ON e.itemid = v.itemid""",
    "link_linked_only": """
        SELECT event_id, hadm_id, epoch_us(admittime) AS admittime_us FROM eblast
        WHERE hadm_id IS NOT NULL""",
    "in_window_events": """
        SELECT hadm_id, l_linenumber, itemid, elapsed AS elapsed_us, elapsed / 3.6e9 AS hours
        FROM li WHERE charttime >= admittime AND elapsed / 3.6e9 < 51840""",
    "time_bins": """
        SELECT event_id, CAST(floor(elapsed / (30 * 3.6e9)) AS INTEGER) AS time_bin FROM ev""",
    "anchor_offsets": _histogram(_OFFSET_ROWS, 24, False),
    "top_labs": "SELECT CAST(itemid AS BIGINT) AS itemid, n_events, rank FROM imgranked",
    "top_labs_excluding": "SELECT CAST(itemid AS BIGINT) AS itemid, n_events, rank FROM ranked",
    "top_labs_subset": """
        SELECT CAST(itemid AS BIGINT) AS itemid, count(*) AS n_events,
               row_number() OVER (ORDER BY count(*) DESC, itemid) AS rank
        FROM ev0 JOIN evsub USING (hadm_id) WHERE itemid NOT IN (1000, 1001)
        GROUP BY itemid ORDER BY n_events DESC, itemid LIMIT 64""",
    "lab_rank": """
        SELECT r.itemid, n_events, rank, coalesce(p_name, '?') AS label,
               coalesce(p_type, '?') AS category
        FROM (SELECT itemid, count(*) AS n_events,
                     row_number() OVER (ORDER BY count(*) DESC, itemid) AS rank
              FROM li GROUP BY itemid ORDER BY n_events DESC, itemid LIMIT 256) r
        LEFT JOIN part ON p_partkey = r.itemid""",
    "grid_layout": """
        SELECT index, row, col, CAST(itemid AS BIGINT) AS itemid, label, category FROM layout""",
    "grid_layout_vocab_only": """
        SELECT CAST(i AS INTEGER) AS index, CAST(i // 8 AS INTEGER) AS row,
               CAST(i % 8 AS INTEGER) AS col, CAST(itemid AS BIGINT) AS itemid, label, category
        FROM (SELECT *, row_number() OVER (ORDER BY category NULLS LAST, itemid) - 1 AS i FROM voc)
        WHERE i < 64""",
    "grid_layout_by_frequency": """
        SELECT CAST(i AS INTEGER) AS index, CAST(i // 8 AS INTEGER) AS row,
               CAST(i % 8 AS INTEGER) AS col, CAST(itemid AS BIGINT) AS itemid, label, category
        FROM (SELECT *, row_number() OVER (ORDER BY rank) - 1 AS i
              FROM voc JOIN imgranked USING (itemid))""",
    "grid_missing_labs": """
        SELECT CAST(itemid AS BIGINT) AS itemid, n_events, rank
        FROM (SELECT itemid, count(*) AS n_events,
                     row_number() OVER (ORDER BY count(*) DESC, itemid) AS rank
              FROM ev0 GROUP BY itemid ORDER BY n_events DESC, itemid LIMIT 100)
        WHERE itemid NOT IN (SELECT itemid FROM voc)""",
    "grid_left_out": """
        SELECT CAST(itemid AS BIGINT) AS itemid, n_events, rank,
               CASE WHEN k IS NULL THEN 'not in vocabulary' ELSE 'no place' END AS reason
        FROM (SELECT *, row_number() OVER (ORDER BY k IS NULL, category NULLS LAST, itemid) AS place
              FROM (SELECT itemid, count(*) AS n_events,
                           row_number() OVER (ORDER BY count(*) DESC, itemid) AS rank
                    FROM ev0 GROUP BY itemid ORDER BY n_events DESC, itemid LIMIT 100)
              LEFT JOIN (SELECT itemid, category, itemid AS k FROM voc) USING (itemid))
        WHERE k IS NULL OR place > 32""",
    "grid_by_category": """
        SELECT coalesce(category, '(no category)') AS category, count(*) AS n_cells,
               min(index) AS first_index,
               string_agg(CAST(itemid AS VARCHAR), ',' ORDER BY index) AS itemids
        FROM layout GROUP BY 1""",
    "cohort_by_specimens": """
        SELECT hadm_id, count(DISTINCT specimen_id) AS n_specimens FROM li
        GROUP BY hadm_id HAVING count(DISTINCT specimen_id) BETWEEN 2 AND 4""",
    "cohort_in_window": """
        SELECT hadm_id, count(*) AS n_events, count(DISTINCT specimen_id) AS n_specimens
        FROM li WHERE charttime >= admittime AND elapsed / 3.6e9 < 51840
        GROUP BY hadm_id HAVING count(DISTINCT specimen_id) BETWEEN 2 AND 6""",
    "cohort_combined": """
        SELECT hadm_id, n_events, n_labs, n_specimens, round(hours, 6) AS hours FROM evprof
        WHERE n_specimens >= 16 AND n_labs >= 30 AND hours >= 24 AND hours <= 690""",
    "top_admissions": """
        SELECT hadm_id, count(*) AS n_events, count(DISTINCT itemid) AS n_labs,
               count(DISTINCT specimen_id) AS n_specimens,
               (SELECT count(DISTINCT hadm_id) FROM li) AS total_admissions
        FROM li GROUP BY hadm_id ORDER BY n_events DESC, hadm_id LIMIT 20""",
    "top_admissions_24h": """
        SELECT hadm_id, count(*) AS n_events, count(DISTINCT itemid) AS n_labs,
               count(DISTINCT specimen_id) AS n_specimens,
               (SELECT count(DISTINCT hadm_id) FROM ev WHERE charttime >= admittime
                AND charttime < admittime + INTERVAL 24 HOURS) AS total_admissions
        FROM ev WHERE charttime >= admittime AND charttime < admittime + INTERVAL 24 HOURS
        GROUP BY hadm_id ORDER BY n_events DESC, hadm_id LIMIT 20""",
    "subset_overview": """
        SELECT count(*) AS n_admissions, round(avg(n_specimens), 6) AS mean_specimens,
               median(n_specimens) AS median_specimens, min(n_specimens) AS min_specimens,
               max(n_specimens) AS max_specimens,
               (SELECT count(DISTINCT hadm_id) FROM li) AS total_admissions,
               round(100.0::DOUBLE * count(*) / (SELECT count(DISTINCT hadm_id) FROM li), 6)
                   AS pct_of_all
        FROM lisub""",
    "subset_admission_stats": """
        SELECT hadm_id, count(*) AS n_events, count(DISTINCT itemid) AS n_labs,
               max(s.n_specimens) AS n_specimens,
               (epoch_us(max(charttime)) - epoch_us(min(charttime))) / 3.6e9 AS hours
        FROM li JOIN lisub s USING (hadm_id) GROUP BY hadm_id""",
    "binned_last_value": """
        SELECT hadm_id, time_bin, row, col, CAST(itemid AS BIGINT) AS itemid, value FROM cells""",
    "binned_mean_value": """
        SELECT hadm_id, time_bin, row, col, CAST(CAST(avg(valuenum) AS FLOAT) AS DOUBLE) AS value
        FROM placed WHERE valuenum IS NOT NULL GROUP BY hadm_id, time_bin, row, col""",
    "bin_counts": """
        SELECT hadm_id, time_bin, row, col, count(*) AS n_values
        FROM placed WHERE valuenum IS NOT NULL GROUP BY hadm_id, time_bin, row, col""",
    "video_tensor": "SELECT hadm_id, position, value FROM dense",
    "observation_mask": """
        SELECT hadm_id, position, CASE WHEN value IS NULL THEN 0 ELSE 1 END AS observed
        FROM dense""",
    "tensor_profile": """
        SELECT hadm_id, CAST(1536 AS INTEGER) AS n_cells, CAST(count(value) AS INTEGER) AS n_filled,
               min(value) AS value_min, max(value) AS value_max
        FROM dense GROUP BY hadm_id""",
    "tensor_overview": """
        SELECT count(*) AS n_tensors, CAST(1 AS BIGINT) AS n_shapes, 1 AS all_same_shape
        FROM cohort""",
    "frame_metadata": """
        SELECT hadm_id, time_bin, n_cells_filled, fill_pct, n_specimens_merged,
               round(time_span_minutes, 6) AS time_span_minutes, value_min, value_max
        FROM frames""",
    "frame_documents": """
        SELECT s.hadm_id, CAST(a.n AS INTEGER) AS all_ids, s.time_bin,
               CAST(s.time_bin * 30 AS VARCHAR) || '–' || CAST((s.time_bin + 1) * 30 AS VARCHAR)
                   || 'h' AS hours,
               coalesce(p.ids, '') AS specimen_ids, coalesce(p.n, 0) AS n_times,
               coalesce(c.labs, '') AS labs
        FROM spine s
        LEFT JOIN (SELECT hadm_id, count(DISTINCT specimen_id) AS n FROM placed GROUP BY hadm_id) a
             USING (hadm_id)
        LEFT JOIN (SELECT hadm_id, time_bin, CAST(count(DISTINCT elapsed) AS INTEGER) AS n,
                          string_agg(DISTINCT CAST(specimen_id AS VARCHAR), ','
                                     ORDER BY CAST(specimen_id AS VARCHAR)) AS ids
                   FROM placed GROUP BY hadm_id, time_bin) p USING (hadm_id, time_bin)
        LEFT JOIN (SELECT hadm_id, time_bin, string_agg(label, ',' ORDER BY index) AS labs
                   FROM cells JOIN layout USING (itemid) GROUP BY hadm_id, time_bin) c
             USING (hadm_id, time_bin)""",
    "video_summary": "SELECT * FROM summary",
    "run_summary": f"""
        SELECT metric, count(*) AS n, round(avg(value), 6) AS mean,
               round(quantile_cont(value, 0.5), 6) AS median
        FROM ({_stack('summary', 'fill_pct', 'temporal_density_pct', 'frames_with_data',
                      'total_specimens_merged')}) GROUP BY metric""",
    "fill_timeline": f"SELECT hadm_id, {_TIMELINE} FROM frames GROUP BY hadm_id",
    "frame_fill_dist": _dist("""SELECT 'fill_pct' AS metric, fill_pct AS value FROM frames
                                WHERE n_cells_filled > 0"""),
    "active_frames": """
        SELECT * FROM (SELECT hadm_id, time_bin, n_cells_filled, CAST(row_number() OVER
                           (PARTITION BY hadm_id ORDER BY time_bin) AS INTEGER) AS position
                       FROM frames WHERE n_cells_filled > 0) WHERE position <= 12""",
    "completeness_filter": """
        SELECT hadm_id, filled_cells,
               round(filled_cells::DOUBLE / total_cells, 6) AS completeness
        FROM summary WHERE filled_cells::DOUBLE / total_cells >= 0.022""",
    "specimen_cells": """
        SELECT specimen_id, row, col, CAST(itemid AS BIGINT) AS itemid, value FROM speccells""",
    "specimen_tensor": f"""
        SELECT h.specimen_id, CAST(p AS INTEGER) AS position, round(value, 6) AS value
        FROM (SELECT specimen_id, p FROM (SELECT DISTINCT specimen_id FROM ev0), range(64) r(p)) h
        LEFT JOIN (SELECT specimen_id, row * 8 + col AS p, CAST(CAST(
                       max((charttime, event_id, CASE WHEN valuenum IS NOT NULL THEN
                            greatest(0, least(1, {_SCALED})) END))[3] AS FLOAT) AS DOUBLE) AS value
                   FROM ev0 JOIN imglayout USING (itemid) GROUP BY specimen_id, row, col) c
        USING (specimen_id, p)""",
    "grid_reconstruct": """
        SELECT specimen_id, row, col, CAST(itemid AS BIGINT) AS itemid, label, value
        FROM speccells""",
    "numeric_coercion": """
        SELECT event_id, CASE k % 6 WHEN 0 THEN f + 0.5::DOUBLE WHEN 1 THEN -f WHEN 5 THEN f END
                   AS number
        FROM (SELECT event_id, floor(value) AS f,
                     CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)""",
    "refrange_scale": f"""
        SELECT event_id,
               round(CASE WHEN valuenum IS NOT NULL THEN greatest(0, least(1, {_SCALED})) END, 6)
                   AS scaled,
               round({_SCALED}, 6) AS unclipped,
               round(CASE WHEN valuenum IS NOT NULL THEN greatest(0, least(1, {_SCALED}))
                          ELSE 0 END, 6) AS filled
        FROM ev0""",
    "zlog_scale": """
        SELECT event_id, round(CASE WHEN valuenum > 0 AND lo > 0 AND hi > lo THEN
               (ln(valuenum) - (ln(lo) + ln(hi)) / 2) * 3.92 / (ln(hi) - ln(lo)) END, 6) AS zlog
        FROM ev0""",
    "distinct_specimens": "SELECT DISTINCT specimen_id FROM ev0",
    "rich_specimens": """
        SELECT specimen_id, count(*) AS n_events, count(DISTINCT itemid) AS n_labs FROM ev0
        GROUP BY specimen_id ORDER BY n_events DESC, specimen_id LIMIT 20""",
    "norm_stats": """
        SELECT row, col, CAST(itemid AS BIGINT) AS itemid, label, log_transform,
               round(mean, 6) AS mean, round(std, 6) AS std, count FROM stats""",
    "normalized_cells": """
        SELECT hadm_id, time_bin, row, col, round(z, 5) AS z FROM normed""",
    "clip_counters": """
        SELECT n_valid, n_low, n_high, n_valid - n_low - n_high AS n_unclipped,
               round(100.0::DOUBLE * n_low / n_valid, 6) AS pct_low,
               round(100.0::DOUBLE * n_high / n_valid, 6) AS pct_high,
               round(100.0::DOUBLE * (n_valid - n_low - n_high) / n_valid, 6) AS pct_unclipped
        FROM (SELECT count(*) AS n_valid, count(*) FILTER (z = -10) AS n_low,
                     count(*) FILTER (z = 10) AS n_high FROM normed)""",
    "extreme_fraction": """
        SELECT hadm_id, count(*) AS n_values,
               round(100.0::DOUBLE * count(*) FILTER (abs(z) > 3) / count(*), 6) AS pct_extreme
        FROM normed GROUP BY hadm_id""",
    "video_value_bounds": """
        SELECT hadm_id, round(quantile_cont(value, 0.01), 5) AS raw_low,
               round(quantile_cont(value, 0.99), 5) AS raw_high,
               round(greatest(least(quantile_cont(abs(z), 0.99), 5), 1), 5) AS z_bound
        FROM normed GROUP BY hadm_id""",
    "robust_scale": """
        SELECT hadm_id, time_bin, row, col, round((value - m) / i, 6) AS scaled
        FROM cells JOIN (SELECT row, col, quantile_cont(value, 0.5) AS m,
            CASE WHEN quantile_cont(value, 0.75) > quantile_cont(value, 0.25)
                 THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) ELSE 1 END AS i
            FROM cells GROUP BY row, col) USING (row, col)""",
    "quantile_scale": """
        SELECT hadm_id, time_bin, row, col,
               round(percent_rank() OVER (PARTITION BY row, col ORDER BY value), 6) AS quantile
        FROM cells""",
    "locf_cells": """
        SELECT hadm_id, time_bin, row, col, value, time_bin - seen AS staleness FROM carried""",
    "time_since_last": """
        SELECT hadm_id, time_bin, row, col, CAST((time_bin - seen) * 30 AS DOUBLE) AS hours_since
        FROM carried""",
    "sliding_windows": """
        SELECT hadm_id, window_start, time_bin, row, col,
               CAST(CAST(arg_max(valuenum, (charttime, event_id)) AS FLOAT) AS DOUBLE) AS value
        FROM (SELECT e.*, row, col, CAST(w.s AS INTEGER) AS window_start,
                     CAST(floor((elapsed - w.s * 3.6e9) / (10 * 3.6e9)) AS INTEGER) AS time_bin
              FROM ev e JOIN layout USING (itemid)
              JOIN (SELECT i * 120 AS s FROM range(10) r(i)) w
                   ON elapsed >= w.s * 3.6e9 AND elapsed < (w.s + 240) * 3.6e9
              WHERE charttime >= admittime AND valuenum IS NOT NULL)
        GROUP BY hadm_id, window_start, time_bin, row, col""",
    "subject_split": """
        SELECT CASE subject_id % 10 WHEN 9 THEN 'test' WHEN 8 THEN 'validation' ELSE 'train' END
                   AS split,
               count(DISTINCT subject_id) AS n_subjects, count(*) AS n_events
        FROM ev0 GROUP BY 1""",
    "site_folds": """
        SELECT c_nationkey AS site, count(*) AS n_test,
               (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) - count(*)
                   AS n_train,
               round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM orders JOIN customer
                                                 ON o_custkey = c_custkey), 6) AS pct_test
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey""",
    "shared_concepts": """
        SELECT CAST(k AS BIGINT) AS itemid, count(*) AS n_events,
               round(max(valuenum * 0.5::DOUBLE + 1), 6) AS value_max
        FROM ev0 WHERE k < 97 AND k IN (SELECT itemid FROM li) GROUP BY k""",
    "dataset_totals": """
        SELECT count(*) AS n_events, count(DISTINCT hadm_id) AS n_admissions,
               count(DISTINCT specimen_id) AS n_specimens,
               count(*) FILTER (hadm_id IS NULL) AS hadm_null,
               count(*) FILTER (valuenum IS NULL) AS valuenum_null,
               round(100.0::DOUBLE * count(*) FILTER (hadm_id IS NULL) / count(*), 6)
                   AS hadm_null_pct,
               round(100.0::DOUBLE * count(*) FILTER (valuenum IS NULL) / count(*), 6)
                   AS valuenum_null_pct
        FROM eblast""",
    "specimen_profile": "SELECT * FROM specprof",
    "admission_profile": """
        SELECT hadm_id, n_events, n_labs, n_specimens, round(hours, 6) AS hours FROM evprof""",
    "sampling_frequency": """
        SELECT hadm_id, n_specimens,
               round(CASE WHEN hours > 0 THEN n_specimens / hours ELSE 0 END, 6)
                   AS specimens_per_hour
        FROM liprof""",
    "dist_summary_specimen": _dist(_stack("specprof", "n_labs", "n_events", "fill_pct")),
    "dist_summary_admission": _dist(
        _stack("liprof", "n_events", "n_labs", "n_specimens", "hours")
        + " UNION ALL SELECT 'specimens_per_hour', n_specimens / hours FROM liprof"
          " WHERE hours > 0"),
    "specimen_gaps": "SELECT hadm_id, specimen_id, gap_hours FROM gaps",
    "histogram_gaps": _histogram(_GAP_ROWS, 80, True),
    "lab_coverage": """
        SELECT c.*, coalesce(p_name, '?') AS label, coalesce(p_type, '?') AS category
        FROM (SELECT itemid, count(*) AS n_events, count(DISTINCT hadm_id) AS n_admissions,
                     count(DISTINCT specimen_id) AS n_specimens,
                     round(100.0::DOUBLE * count(DISTINCT hadm_id)
                           / (SELECT count(DISTINCT hadm_id) FROM li), 6) AS admission_pct
              FROM li GROUP BY itemid) c LEFT JOIN part ON p_partkey = c.itemid""",
    "lab_coverage_subset": """
        SELECT CAST(itemid AS BIGINT) AS itemid, count(*) AS n_events,
               count(DISTINCT hadm_id) AS n_admissions, count(DISTINCT specimen_id) AS n_specimens,
               round(100.0::DOUBLE * count(DISTINCT hadm_id) / (SELECT count(*) FROM evsub), 6)
                   AS admission_pct
        FROM ev0 JOIN evsub USING (hadm_id) GROUP BY itemid""",
    "grid_sweep_frame": _sweep("ev0", "evsub", "specimen_id"),
    "grid_sweep_admission": _sweep("li", "lisub", "hadm_id"),
    "duration_buckets": f"""
        SELECT bucket, count(hours) AS n_admissions,
               CAST(median(n_specimens) AS DOUBLE) AS median_specimens,
               CAST(median(n_labs) AS DOUBLE) AS median_labs
        FROM (SELECT {_BUCKETS} AS bucket FROM (SELECT unnest([0, 24, 72, 168, 336]) AS hours)) every
        LEFT JOIN (SELECT *, {_BUCKETS} AS bucket FROM liprof) USING (bucket) GROUP BY 1""",
    "feasibility": " UNION ALL ".join(f"""
        SELECT '{c}' AS metric, {n} AS at_least, count(*) FILTER ({c} >= {n}) AS n_admissions,
               round(100.0::DOUBLE * count(*) FILTER ({c} >= {n}) / count(*), 6) AS pct
        FROM evprof""" for c, n in _STEPS),
    "table_profile": """
        SELECT 'lab_with_adm' AS step, count(*) AS n_rows, 8 AS n_columns,
               """ + ", ".join(f"""
               count(*) FILTER ({c} IS NULL) AS {c}_nulls,
               round(100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*), 6)
                   AS {c}_null_pct""" for c in ("hadm_id", "specimen_id", "admittime")) + ", "
        + ", ".join(f"""
               count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS {c}_unique"""
                    for c in ("subject_id", "hadm_id", "specimen_id")) + " FROM eblast",
    "rich_specimens_stored": """
        SELECT specimen_id, count(*) AS n_events, count(DISTINCT itemid) AS n_labs FROM ev0
        WHERE specimen_id % 2 = 1
        GROUP BY specimen_id ORDER BY n_events DESC, specimen_id LIMIT 20""",
    "frame_members": """
        SELECT DISTINCT hadm_id, time_bin, 'specimen' AS kind, specimen_id AS member FROM placed
        WHERE specimen_id IS NOT NULL
        UNION ALL SELECT DISTINCT hadm_id, time_bin, 'time', elapsed FROM placed""",
    "sliding_windows_sparse": """
        SELECT hadm_id, window_start, time_bin, row, col,
               CAST(CAST(arg_max(valuenum, (charttime, event_id)) AS FLOAT) AS DOUBLE) AS value
        FROM (SELECT e.*, row, col, CAST(w.s AS INTEGER) AS window_start,
                     CAST(floor((elapsed - w.s * 3.6e9) / (10 * 3.6e9)) AS INTEGER) AS time_bin
              FROM ev e JOIN layout USING (itemid)
              JOIN (SELECT i * 120 AS s FROM range(10) r(i)) w
                   ON elapsed >= w.s * 3.6e9 AND elapsed < (w.s + 60) * 3.6e9
              WHERE charttime >= admittime AND valuenum IS NOT NULL)
        GROUP BY hadm_id, window_start, time_bin, row, col""",
    "binned_48h": """
        SELECT hadm_id, CAST(floor(elapsed / (2 * 3.6e9)) AS INTEGER) AS time_bin, row, col,
               CAST(itemid AS BIGINT) AS itemid,
               CAST(CAST(arg_max(valuenum, (charttime, event_id)) AS FLOAT) AS DOUBLE) AS value
        FROM ev JOIN layout USING (itemid)
        WHERE charttime >= admittime AND elapsed / (2 * 3.6e9) < 24 AND valuenum IS NOT NULL
        GROUP BY 1, 2, 3, 4, 5""",
    "binned_mean_wide": """
        SELECT hadm_id, CAST(floor(elapsed / (2160 * 3.6e9)) AS INTEGER) AS time_bin, itemid,
               CAST(CAST(avg(valuenum) AS FLOAT) AS DOUBLE) AS value
        FROM li
        WHERE charttime >= admittime AND elapsed / (2160 * 3.6e9) < 24 AND valuenum IS NOT NULL
        GROUP BY 1, 2, 3""",
    "binned_other_anchor": """
        SELECT hadm_id, CAST(floor(since / (30 * 3.6e9)) AS INTEGER) AS time_bin, row, col,
               CAST(itemid AS BIGINT) AS itemid,
               CAST(CAST(arg_max(valuenum, (charttime, event_id)) AS FLOAT) AS DOUBLE) AS value
        FROM (SELECT *, elapsed - 24 * 3.6e9 AS since FROM ev) JOIN layout USING (itemid)
        WHERE since >= 0 AND since / (30 * 3.6e9) < 24 AND valuenum IS NOT NULL
        GROUP BY 1, 2, 3, 4, 5""",
    "norm_train_only": """
        SELECT g.row, g.col, CAST(l.itemid AS BIGINT) AS itemid, round(coalesce(m, 0), 6) AS mean,
               round(CASE WHEN s >= 1e-8 THEN s ELSE 1 END, 6) AS std, coalesce(n, 0) AS count
        FROM (SELECT CAST(i // 8 AS INTEGER) AS row, CAST(i % 8 AS INTEGER) AS col
              FROM range(64) r(i)) g
        LEFT JOIN layout l ON l.row = g.row AND l.col = g.col
        LEFT JOIN (SELECT row, col, avg(x) AS m, stddev_samp(x) AS s, count(*) AS n
                   FROM logged WHERE x IS NOT NULL AND hadm_id % 4 <> 0 GROUP BY row, col) f
             ON f.row = g.row AND f.col = g.col""",
    "specimen_from_text": """
        SELECT * FROM (
            SELECT specimen_id, row, col, CAST(itemid AS BIGINT) AS itemid,
                   CAST(CAST(max((charttime, event_id,
                       CASE WHEN event_id % 4 <> 0 THEN CAST(event_id AS DOUBLE) END))[3] AS FLOAT)
                       AS DOUBLE) AS value
            FROM ev0 JOIN imglayout USING (itemid)
            GROUP BY specimen_id, row, col, itemid) WHERE value IS NOT NULL""",
    "step_profiles": """
        SELECT 'lab_parquet' AS step, count(*) AS n_rows,
               count(*) FILTER (hadm_id IS NULL) AS hadm_id_nulls,
               count(*) FILTER (specimen_id IS NULL) AS specimen_id_nulls,
               count(*) FILTER (valuenum IS NULL) AS valuenum_nulls,
               count(*) FILTER (charttime IS NULL) AS charttime_nulls FROM ev0
        UNION ALL
        SELECT 'lab_with_adm', count(*), count(*) FILTER (hadm_id IS NULL),
               count(*) FILTER (specimen_id IS NULL), count(*) FILTER (valuenum IS NULL),
               count(*) FILTER (charttime IS NULL) FROM eblast""",
}


def _needed(sql: str) -> set[str]:
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\b[a-z0-9_]+\b", todo.pop()))
        for name in STEPS:
            if name in words and name not in found:
                found.add(name)
                todo.append(STEPS[name])
    return found


def oracle(name: str) -> str:
    """The query's SQL with the steps it needs as common table expressions."""
    main = MAIN[name].strip()
    needed = _needed(main)
    steps = ",\n".join(f"{s} AS ({STEPS[s].strip()})" for s in STEPS if s in needed)
    if main.startswith("WITH "):
        return f"WITH {steps},\n{main[5:]}" if steps else main
    return f"WITH {steps}\n{main}" if steps else main


ORACLES = {name: oracle(name) for name in MAIN}
