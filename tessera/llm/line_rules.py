"""Quality rules with cross-document line frequency (operator 9).

Lines are normalised (ASCII letters to lower case, digits to 0, runs of white space to one
space) and hashed; per host the distinct documents of each line are counted, lines above the
host's limit count as removed, and a document that loses too large a part is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import materialize, slices

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LINE = "array<struct<line:bigint,words:int>>"
_BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive bounds."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return np.diff(total[bounds])


def repeated_words(h: np.ndarray, first: np.ndarray, size: int = 3) -> np.ndarray:
    """Words of each text in windows of ``size`` words that the text holds twice or more."""
    gram, place = W.grams(h, first, size)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(gram):
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))[place]
        key = gram ^ W.mix(text.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        hit = place[order[same[:-1] | same[1:]]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + size, -1)
    return _per_text(np.cumsum(covered)[:len(h)] > 0, first)


def _duplicates(key: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Per text how many keys equal an earlier one of the same text."""
    distinct = np.unique(key ^ W.mix(text.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    return np.bincount(text, minlength=n) - np.bincount(text[distinct], minlength=n)


def _line_hashes(data, spans, lines):
    """Hash of each normalised line and its number of words; lines without words have a count of 0."""
    folded = W.Spans(_FOLD[data], spans.start, spans.end, spans.first)
    word = folded.hashes()
    line = np.searchsorted(lines.start, spans.start, side="right") - 1
    bounds = np.searchsorted(line, np.arange(len(lines.start) + 1))
    # Polynomial over the words of each line, from running sums.
    total = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * W._power(W._BASE, len(word)), out=total[1:])
    h = (total[bounds[1:]] - total[bounds[:-1]]) * W._power(W._INVERSE, len(word) + 1)[bounds[:-1]]
    return W.mix(h), np.diff(bounds)


def _lines_of(data, spans, lines, n):
    """Normalised lines: per text the distinct hashes and the words that each stands for."""
    (h, count), text = _line_hashes(data, spans, lines), lines.text
    full = count > 0
    h, count, text, raw = h[full], count[full], text[full], lines.hashes()[full]
    doubled = _duplicates(raw, text, n)
    order = np.lexsort((h, text))
    h, count, text = h[order], count[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    sums = np.add.reduceat(count, at) if len(at) else count
    offsets = np.searchsorted(text[at], np.arange(n + 1)).astype(np.int32)
    return doubled, pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
        [pa.array(h[at].view(np.int64)), pa.array(sums.astype(np.int32))], names=["line", "words"]))


def statistics(documents: DataFrame, id_column: str = "doc_id", host: str = "source",
               text: str = "text") -> DataFrame:
    """Per document its words, characters in words, symbols, doubled lines, words in repeated
    windows, and its distinct normalised lines.  Null text has none of them."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = W.buffers(part.column(text))
                n = part.num_rows
                spans, lines = W.words(data, offsets), W.lines(data, offsets)
                inside = np.zeros(len(data) + 1, np.int8)
                np.add.at(inside, spans.start, 1)
                np.add.at(inside, spans.end, -1)
                # Continuation bytes of UTF-8 are no code points of their own.
                chars = (np.cumsum(inside[:-1], dtype=np.int8) > 0) & ((data & 0xC0) != 0x80)
                doubled, listed = _lines_of(data, spans, lines, n)
                columns = (np.diff(spans.first), _per_text(chars, offsets),
                           _per_text(_SYMBOL[data], offsets), doubled,
                           repeated_words(spans.hashes(), spans.first))
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_column), part.column(host),
                     *(pa.array(c.astype(np.int64)) for c in columns), listed],
                    names=[id_column, host, *(c.split()[0] for c in _BASE.split(", ")), "lines"])

    source = documents.select(id_column, host, text)
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.mapInArrow(
        run, f"`{id_column}` {kinds[id_column]}, `{host}` {kinds[host]}, {_BASE}, lines {_LINE}")


def frequent_lines(stats: DataFrame, id_column: str = "doc_id", host: str = "source", *, min_documents: int = 20,
                   share: float = 0.02) -> DataFrame:
    """Lines of a host in more than ``min_documents`` and ``share`` of its documents.

    Documents are distinct ids: rows that repeat an id count once, and rows without one don't count.
    """
    known = stats.filter(F.col(id_column).isNotNull())
    hosts = (known.select(host, id_column).distinct()
             .groupBy(host).agg(F.count("*").alias("host_documents")))
    found = (known.select(host, id_column, F.explode("lines").alias("l"))
             .select(host, id_column, F.col("l.line").alias("line")).distinct()
             .groupBy(host, "line").agg(F.count("*").alias("n_documents"))
             .filter(F.col("n_documents") > min_documents))
    return (found.join(hosts, found[host].eqNullSafe(hosts[host]))
            .filter(F.col("n_documents") > share * F.col("host_documents"))
            .select(found[host], "line", "n_documents"))


def _lost(stats: DataFrame, id_column: str, host: str, min_documents: int, share: float) -> DataFrame:
    """Rows (_id, _of, _row, line, words): the frequent lines that documents hold."""
    frequent = frequent_lines(stats, id_column, host, min_documents=min_documents, share=share)
    frequent = frequent.select(F.col(host).alias("_host"), F.col("line").alias("_line"))
    held = stats.select(id_column, host, "_row", F.explode("lines").alias("l"))
    return (held.join(frequent, (F.col("l.line") == F.col("_line")) & F.col(host).eqNullSafe(F.col("_host")))
            .select(F.col(id_column).alias("_id"), F.col(host).alias("_of"), "_row", "l.line", "l.words"))


def _numbered(documents: DataFrame, id_column: str, host: str, text: str) -> DataFrame:
    """Statistics, stored, with a number for each row: rows may agree in id and host."""
    return materialize(statistics(documents, id_column, host, text).withColumn("_row", F.monotonically_increasing_id()))


def cleaned(documents: DataFrame, id_column: str = "doc_id", host: str = "source", text: str = "text", *,
            min_documents: int = 20, share: float = 0.02) -> DataFrame:
    """Rows (id, host, cleaned): the text without its host's frequent lines; the lines that stay are
    as they were, with their breaks.  A text that loses nothing, null or empty stays as it is.
    """
    stats = _numbered(documents, id_column, host, text)
    # Rows of one id and host share their lines: each loses those that are frequent in that host.
    drop = (_lost(stats, id_column, host, min_documents, share)
            .groupBy("_id", "_of").agg(F.collect_set("line").alias("drop")))

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                data, offsets = W.buffers(part.column(text))
                lines = W.lines(data, offsets)
                h, count = _line_hashes(data, W.words(data, offsets), lines)
                bounds = np.searchsorted(lines.text, np.arange(part.num_rows + 1))
                raw, out = data.tobytes(), []
                values = zip(part.column(text).to_pylist(), part.column("drop").to_pylist())
                for i, (value, gone) in enumerate(values):
                    if value and gone:
                        at = slice(bounds[i], bounds[i + 1])
                        lost = (count[at] > 0) & np.isin(h[at].view(np.int64), np.array(gone, np.int64))
                        pieces, done, last = [], int(offsets[i]), int(offsets[i + 1])
                        for a, b in zip(lines.start[at][lost].tolist(), lines.end[at][lost].tolist()):
                            pieces.append(raw[done:a])
                            # A line goes with the break that follows it.
                            done = min(b + (raw[b:b + 1] == b"\n"), last)
                        value = b"".join([*pieces, raw[done:last]]).decode()
                    out.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_column), part.column(host), pa.array(out, pa.string())],
                    names=[id_column, host, "cleaned"])

    source = documents.select(id_column, host, text)
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return (source.join(drop, F.col(id_column).eqNullSafe(F.col("_id")) & F.col(host).eqNullSafe(F.col("_of")), "left")
            .select(*source.columns, "drop")
            .mapInArrow(run, f"`{id_column}` {kinds[id_column]}, `{host}` {kinds[host]}, cleaned string"))


def apply(documents: DataFrame, id_column: str = "doc_id", host: str = "source",
          text: str = "text", *, min_documents: int = 20, share: float = 0.02,
          max_lost: float = 0.5) -> DataFrame:
    """Base statistics, words lost to frequent lines, and the verdict.

    Rejected are documents of fewer than 50 words, those with over half of their words in
    repeated windows of three, and those that lose more than ``max_lost`` of their words.
    Null and empty texts fail the first rule.  A null host is a host of its own.  Rows that repeat
    an id are judged each by its own text and host.
    """
    stats = _numbered(documents, id_column, host, text)
    lost = (_lost(stats, id_column, host, min_documents, share)
            .groupBy("_row").agg(F.sum("words").alias("n_lost")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = (stats.drop("lines").join(lost, "_row", "left").drop("_row")
           .withColumn("n_lost", F.coalesce("n_lost", F.lit(0)).cast("long"))
           .withColumn("base_failed", failed))
    return out.withColumn(
        "kept", ~F.col("base_failed") & (F.col("n_lost") <= max_lost * F.col("n_words")))


def verdicts(documents: DataFrame) -> DataFrame:
    return apply(documents).drop("source")
