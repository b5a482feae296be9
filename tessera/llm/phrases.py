"""Substring dedup with repeated-phrase automata (operator 6).

A window is 20 consecutive words.  It is covered if the same words start earlier: in a document
of smaller id, or earlier in the same one.

1. Anchors: of the grams of six words in a window the one of least hash is the window's anchor,
   so equal windows have equal anchors, and about one gram in eight is one.  The windows of one
   anchor at one place make a context of 20 to 34 words.
2. Anchors that occur once have no recurring window.  Contexts that equal an earlier one
   are covered whole, which one aggregation by hash finds; copies go no further.
3. The different contexts of one anchor may still share windows.  Each is cut from its text and
   goes to the shard of its anchor.  A shard confirms the windows that recur, compiles them into
   Aho-Corasick automata and streams its contexts through them, which gives every occurrence.
   An anchor with more contexts than an automaton shall hold has its windows compared by hash
   across all tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.lookups import join_by_key
from tessera.llm import words as W
from tessera.llm.common import large_binary, release, slices, spare, stored

WINDOW, GRAM = 20, 6
#: Contexts of one anchor, and contexts of one automaton.
HOT_CONTEXTS = 5_000


def _sliding_least(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value of each run of ``width`` values, and its leftmost place."""
    value, place, size = h, np.arange(len(h)), 1

    def both(shift: int) -> tuple[np.ndarray, np.ndarray]:
        left = value[:-shift] <= value[shift:]
        return (np.where(left, value[:-shift], value[shift:]),
                np.where(left, place[:-shift], place[shift:]))

    while 2 * size <= width:
        value, place = both(size)
        size *= 2
    if width > size:
        value, place = both(width - size)
    return value, place


def _anchors(h: np.ndarray, first: np.ndarray, window: int, gram: int):
    """(anchor hash, context hash, text, first window, windows) of the contexts of all texts."""
    n = len(h)
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    if n < window:
        return none
    g = h[:n - gram + 1].copy()
    for j in range(1, gram):
        g = g * W._BASE + h[j:n - gram + 1 + j]
    value, place = _sliding_least(W.mix(g), window - gram + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(np.arange(len(value)) + window <= first[1:][text[:len(value)]])
    if not len(start):
        return none
    value, place = value[start], place[start]
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    count, a = np.diff(at, append=len(start)), start[at]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * W._power(W._BASE, n), out=total[1:])
    context = (total[a + count + window - 1] - total[a]) * W._power(W._INVERSE, n + 1)[a]
    return value[at], W.mix(context ^ count.astype(np.uint64)), text[a], a - first[text[a]], count


def contexts(documents: DataFrame, id_column: str, text: str, *, window: int = WINDOW,
             gram: int = GRAM) -> DataFrame:
    """Rows (anchor, context, id, mark, start, windows): hashes, the row's id and text hash, the first
    window's place, their number."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = W.words(*W.buffers(part.column("text")))
                anchor, context, owner, start, count = _anchors(found.hashes(), found.first, window, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)),
                     *(part.column(c).take(pa.array(owner)) for c in ("id", "mark")), pa.array(start.astype(np.int32)),
                     pa.array(count.astype(np.int32))],
                    names=["anchor", "context", "id", "mark", "start", "windows"])

    source = _marked(documents, id_column, text)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"anchor bigint, context bigint, id {kind}, mark bigint, start int, windows int")


def _marked(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    """Rows (id, mark, text) with an id; the hash of the text tells rows of one id apart."""
    return documents.filter(F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))


def _order() -> Column:
    """Id and start in one number of fixed width, so that its minimum needs no sorting."""
    return (F.col("id").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)")
            + F.col("start").cast("decimal(10,0)")).cast("decimal(32,0)")


def _phrases(placed: DataFrame, kind: str, window: int) -> DataFrame:
    """Cut contexts from texts: rows (anchor, hot, id, mark, start, phrase); hot ones window by window."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[tuple] = []
                for doc, mark, raw, cuts in zip(part.column("id").to_pylist(), part.column("mark").to_pylist(),
                                          large_binary(part.column("text")).to_pylist(),
                                          part.column("cuts").to_pylist()):
                    words = raw.split()  # the six white-space characters, as words are defined
                    for cut in cuts:
                        a, n = cut["start"], cut["windows"]
                        if not cut["hot"]:
                            rows.append((cut["anchor"], False, doc, mark, a, b" ".join(words[a:a + n + window - 1])))
                        else:
                            rows += [(cut["anchor"], True, doc, mark, s, b" ".join(words[s:s + window]))
                                     for s in range(a, a + n)]
                if rows:
                    anchor, hot, doc, mark, start, phrase = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor, pa.int64()), pa.array(hot), pa.array(doc).cast(part.column("id").type),
                         pa.array(mark, pa.int64()), pa.array(start, pa.int32()), pa.array(phrase, pa.binary())],
                        names=["anchor", "hot", "id", "mark", "start", "phrase"])

    return placed.mapInArrow(run, f"anchor bigint, hot boolean, id {kind}, mark bigint, start int, phrase binary")


def covered_in(members: list[tuple[int, int, int, bytes]], window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(id, mark, start) of the windows of contexts, given in order, that an earlier place holds too."""
    known: dict[bytes, int] = {}
    lines = [tuple(known.setdefault(w, len(known)) for w in phrase.split()) for *_, phrase in members]
    seen = Counter(line[j:j + window] for line in lines for j in range(len(line) - window + 1))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for number, (phrase, n) in enumerate(seen.items()):
        if n > 1:  # confirmed: it recurs
            automaton.add_word(phrase, number)
    if not len(automaton):
        return
    automaton.make_automaton()
    met: dict[int, tuple[int, int]] = {}
    for (doc, mark, start, _), line in zip(members, lines):
        for end, number in automaton.iter(line):
            at = start + end - window + 1
            # The same place in another row of this id is no earlier one.
            if met.setdefault(number, (doc, at)) != (doc, at):
                yield doc, mark, at


def _automata(phrases: DataFrame, kind: str, window: int, most: int) -> DataFrame:
    """Rows (id, mark, start, stop) of covered words, from phrases in shards by anchor."""

    def run(batches):
        held: list[tuple[int, int, int, bytes]] = []
        last = None

        def flush():
            rows = list(covered_in(held, window))
            held.clear()
            doc, mark, start = zip(*rows) if rows else ((), (), ())
            start = np.array(start, np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), pa.array(start), pa.array(start + np.int32(window))],
                names=["id", "mark", "start", "stop"])

        for batch in batches:
            for anchor, *member in zip(*(batch.column(c).to_pylist() for c in
                                         ("anchor", "id", "mark", "start", "phrase"))):
                # An automaton takes whole anchors; none has more contexts than `most`.
                if anchor != last and len(held) >= most:
                    yield flush()
                last = anchor
                held.append(tuple(member))
        yield flush()

    sharded = (phrases.select("anchor", "id", "mark", "start", "phrase").repartition("anchor")
               .sortWithinPartitions("anchor", "id", "start"))
    return sharded.mapInArrow(run, "id bigint, mark bigint, start int, stop int").withColumn("id", F.col("id").cast(kind))


def covered_words(documents: DataFrame, id_column: str = "doc_id", text: str = "text", *,
                  window: int = WINDOW, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """Rows (id, mark, start, stop): runs of words, from 0, that covered windows hold; runs may overlap.
    They belong to the rows of that id whose text has the hash ``mark``."""
    kind = documents.schema[id_column].dataType.simpleString()
    found = contexts(documents, id_column, text, window=window, gram=gram)
    recurring = found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    places = stored(join_by_key(found, recurring, "anchor"))
    release(documents.sparkSession)

    first = stored(places.withColumn("at", _order()).groupBy("anchor", "context")
                   .agg(F.min("at").alias("first")))
    several = first.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    earlier = F.col("at") > F.col("first")
    # What equals an earlier context is covered; of the rest only anchors with several contexts go on.
    marked = (places.withColumn("at", _order()).join(first.join(several, "anchor", "left"), ["anchor", "context"])
              .filter(earlier | F.col("n").isNotNull())
              .select("id", "mark", "start", "windows", earlier.alias("earlier"),
                      F.when(~earlier, F.col("anchor")).alias("anchor"), (F.col("n") > hot_contexts).alias("hot")))
    marked = stored(marked)
    release(documents.sparkSession)
    repeated = marked.filter("earlier").select(
        "id", "mark", "start", (F.col("start") + F.col("windows") + (window - 1)).alias("stop"))

    open_ = marked.filter("NOT earlier")
    cuts = open_.groupBy("id", "mark").agg(F.collect_list(F.struct(
        "anchor", "start", "windows", "hot")).alias("cuts"))
    # Repeated rows would be cut once each, with the same places.
    phrases = stored(_phrases(_marked(documents, id_column, text).join(cuts, ["id", "mark"]), kind, window))
    release(documents.sparkSession)
    by_automata = _automata(phrases.filter("NOT hot"), kind, window, hot_contexts)

    hot = phrases.filter("hot").select(
        "anchor", F.xxhash64("phrase").alias("h"), F.xxhash64(F.lit(1), "phrase").alias("h2"), "id", "mark", "start",
        _order().alias("at"))
    earliest = hot.groupBy("anchor", "h", "h2").agg(F.min("at").alias("first"))
    by_hash = (hot.join(earliest, ["anchor", "h", "h2"]).filter("at > first")
               .select("id", "mark", "start", (F.col("start") + window).alias("stop")))
    return repeated.union(by_automata).union(by_hash)


def remove_repeats(documents: DataFrame, id_column: str = "doc_id", text: str = "text", *,
                   window: int = WINDOW, keep: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Rows (id, n_words, n_removed, kept) and the columns ``keep``: kept is the words that stay,
    joined by one space.  New columns get ``prefix``, for tables that have columns of these names.

    Null and empty texts have no words and an empty rest.  Rows without an id take no part: they
    cover nothing and keep all.  Rows that repeat an id count as one document: equal texts of theirs
    are the same places, which don't cover each other, and in different texts the earlier start
    covers the later; each row loses only words of its own text.
    """
    runs = covered_words(documents, id_column, text, window=window)
    own, mark, starts, stops = (spare(documents.columns, c) for c in ("_id", "_mark", "_starts", "_stops"))
    # Runs of one document are at most its windows.
    runs = (runs.groupBy(F.col("id").alias(own), F.col("mark").alias(mark))
            .agg(F.collect_list("start").alias(starts), F.collect_list("stop").alias(stops)))
    carried = [id_column, *keep]
    made = {prefix + "n_words": "bigint", prefix + "n_removed": "bigint", prefix + "kept": "string"}

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                counts, removed, kept = [], [], []
                for raw, begin, end in zip(large_binary(part.column(text)).to_pylist(),
                                           part.column(starts), part.column(stops)):
                    words = raw.split()
                    n = len(words)
                    if begin.is_valid:
                        change = np.zeros(n + 1, np.int64)
                        np.add.at(change, begin.values.to_numpy(), 1)
                        np.add.at(change, end.values.to_numpy(), -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:n] == 0)]
                    counts.append(n)
                    removed.append(n - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carried), pa.array(counts, pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=[*carried, *made])

    kinds = {c: documents.schema[c].dataType.simpleString() for c in carried} | made
    joined = documents.select(*carried, *({text} - set(carried))).join(
        runs, (F.col(id_column) == F.col(own)) & (F.xxhash64(text) == F.col(mark)), "left").drop(own, mark)
    return joined.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()))


def digests(documents: DataFrame) -> DataFrame:
    return remove_repeats(documents).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
