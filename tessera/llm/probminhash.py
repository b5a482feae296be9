"""Near duplicates by ProbMinHash, banding and exact verification (operator 3).

Shingles are five consecutive words.  Every shingle is a Poisson process of its weight's rate
whose arrivals fall on random registers; a register keeps the shingle of its first arrival.  A
text's processes end once the next arrival is later than every register's.  Two signatures agree
in a register with the probability Jaccard similarity of the weighted shingles.  Bands of
registers give candidates; candidates are verified by the exact Jaccard similarity of their sets
of shingles, and linked texts form classes.

Links are those of sets, so sketch and bands come from signatures of weight one.  Texts that
repeat a shingle have the bands of weights 1 + ln of the count as well, for more candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.lookups import join_by_key
from tessera.llm import words as W
from tessera.llm.common import materialize, slices

SHINGLE = 5
THRESHOLD = (4, 5)  # 0.8 as a fraction, so that ties are exact
BANDS, ROWS = 24, 6
#: Registers of the signature; the bands use the first of them, the sketch all.
REGISTERS = 288
PIVOTS = 4


def agreeing_registers(registers: int) -> int:
    """Least number of registers whose four bits agree: at similarity 0.8 a share of
    0.8 + 0.2 / 16 does, and three standard deviations are left as margin."""
    share = 0.8 + 0.2 / 16
    return int(share * registers - 3 * (share * (1 - share) * registers) ** 0.5)


def shingles(h: np.ndarray, first: np.ndarray, size: int = SHINGLE):
    """Distinct shingles of each text with their counts: (hash, count, text).

    A text of fewer words is one shingle; one without words has none.
    """
    n = np.diff(first)
    gram, place = W.grams(h, first, size)
    text = np.repeat(np.arange(len(n)), n)[place] if len(place) else np.zeros(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            more = n[short] > j
            own[more] = own[more] * W._BASE + h[first[short[more]] + j]
        gram = np.concatenate((gram, W.mix(own ^ n[short].astype(np.uint64))))
        text = np.concatenate((text, short))
    order = np.lexsort((gram, text))
    gram, text = gram[order], text[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return gram[at], np.diff(at, append=len(gram)), text[at]


def signatures(h: np.ndarray, weight: np.ndarray, text: np.ndarray, n: int, k: int) -> np.ndarray:
    """ProbMinHash signatures, one row of ``k`` hashes per text; texts without shingles have zeros."""
    arrival = np.full(n * k, np.inf)
    winner = np.zeros(n * k, np.uint64)
    t = np.zeros(len(h))
    limit = np.full(n, np.inf)
    turn = 0
    while len(h):
        turn += 1
        r = W.mix(h + np.uint64(turn * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        # 40 bits for the waiting time, the rest for the register.
        t = t - np.log(((r >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / weight
        early = t < limit[text]
        h, weight, text, t, r = h[early], weight[early], text[early], t[early], r[early]
        slot = text * k + ((r & np.uint64(0xFFFFFF)) * np.uint64(k) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(arrival, slot, t)
        first = arrival[slot] == t
        winner[slot[first]] = h[first]
        limit = arrival.reshape(n, k).max(axis=1)
    return winner.reshape(n, k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    n = len(signature)
    cut = signature[:, :bands * rows].reshape(n, bands, rows)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (n, 1))
    for j in range(rows):
        key = W.mix(key * W._BASE + cut[:, :, j])
    return key


def sketches(signature: np.ndarray) -> np.ndarray:
    """Four bits of each register, sixteen registers to a word."""
    n, k = signature.shape
    nibble = (W.mix(signature) & np.uint64(15)).reshape(n, k // 16, 16)
    return (nibble << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)


def _per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    bounds = np.searchsorted(text, np.arange(n + 1))
    return total[bounds[1:]] - total[bounds[:-1]]


def fingerprints(documents: DataFrame, id_column: str, text: str, *, bands: int = BANDS,
                 rows: int = ROWS, registers: int = REGISTERS, keep: Sequence[str] = ()) -> DataFrame:
    """Per text: 128 bits that name its set of shingles, the set's size, its band keys and sketch.

    Without repeated shingles both weights give the same bands, so only texts with some have
    more than ``bands`` keys.
    """
    if registers % 16 or registers < bands * rows:
        raise ValueError("registers must fill words of sixteen and all bands")

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                n = part.num_rows
                found = W.words(*W.buffers(part.column(text)))
                gram, count, owner = shingles(found.hashes(), found.first)
                size = np.bincount(owner, minlength=n)
                signature = signatures(gram, np.ones(len(gram)), owner, n, registers)
                keys = band_keys(signature, bands, rows)
                repeating = np.bincount(owner[count > 1], minlength=n) > 0
                some = repeating[owner]
                weighted = band_keys(signatures(
                    gram[some], 1 + np.log(count[some]), (np.cumsum(repeating) - 1)[owner[some]],
                    int(repeating.sum()), registers), bands, rows)
                # Both for every text, then without the weighted ones that add nothing.
                keys = np.concatenate((keys, keys), axis=1)
                keys[repeating, bands:] = weighted
                new = np.ones(keys.shape, bool)
                new[:, bands:] = keys[:, bands:] != keys[:, :bands]
                ends = np.concatenate(([0], np.cumsum(new.sum(axis=1)))).astype(np.int32)
                sketch = sketches(signature)
                wide = np.arange(n + 1, dtype=np.int32) * sketch.shape[1]
                names = [_per_text(W.mix(gram ^ np.uint64(salt)), owner, n) for salt in (0x51ED27, 0x7A3B19C5)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in carried), *(pa.array(x.view(np.int64)) for x in names),
                     pa.array(size.astype(np.int32)),
                     pa.ListArray.from_arrays(ends, pa.array(keys[new].view(np.int64))),
                     pa.ListArray.from_arrays(wide, pa.array(sketch.ravel().view(np.int64)))],
                    names=[*carried, "set1", "set2", "size", "keys", "sketch"])

    carried = [id_column, *keep]
    source = documents.select(*carried, text)
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in carried)
    return source.mapInArrow(
        run, f"{kinds}, set1 bigint, set2 bigint, size int, keys array<bigint>, sketch array<bigint>")


def shingle_sets(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    """Rows (id, shingles), the sorted hashes of each text's set."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                found = W.words(*W.buffers(part.column(text)))
                gram, _, owner = shingles(found.hashes(), found.first)
                offsets = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_column), pa.ListArray.from_arrays(offsets, pa.array(gram.view(np.int64)))],
                    names=[id_column, "shingles"])

    source = documents.select(id_column, text)
    kind = source.schema[id_column].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_column}` {kind}, shingles array<bigint>")


def _agreeing(a, b, words: int):
    """Registers whose four bits agree in two sketches."""
    differing = F.lit(0)
    for i in range(words):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differing = differing + F.bit_count(x)
    return F.lit(16 * words) - differing


def _close_in_size(a, b):
    small, large = THRESHOLD
    return (large * F.least(a, b) >= small * F.greatest(a, b))


def components(edges: DataFrame) -> DataFrame:
    """Rows (v, c): the least vertex of the connected component of each vertex of (a, b) edges.

    Every round a vertex takes the least label around it and then its label's label; labels
    are checkpointed, and rounds end when none changes.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                         .select("v", F.least("v", "m").alias("c")))
    while True:
        near = (both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("c").alias("m")))
        step = (labels.join(near, F.col("v") == F.col("a"))
                .select("v", F.col("c").alias("old"), F.least("c", "m").alias("c")))
        label_of = labels.select(F.col("v").alias("w"), F.col("c").alias("cc"))
        step = materialize(step.join(label_of, F.col("c") == F.col("w"), "left")
                           .select("v", "old", F.least("c", F.coalesce("cc", "c")).alias("c")))
        changed = step.filter(F.col("c") != F.col("old")).limit(1).count()
        labels = step.select("v", "c")
        if not changed:
            return labels


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (a, b) pairs those whose sets of shingles have a Jaccard similarity of 0.8 or more."""
    small, large = THRESHOLD
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b")
            .filter(large * both >= small * (F.size("sa") + F.size("sb") - both)).select("a", "b"))


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text: str = "text", *,
                    bands: int = BANDS, rows: int = ROWS, registers: int = REGISTERS,
                    pivots: int = PIVOTS, mark: str | None = None) -> DataFrame:
    """One row per document: (id, class_id), the least id of its class; with ``mark`` the value of
    that column too, so that rows of one id can be told apart.

    Texts with equal sets of shingles are one class from the start, so copies make no pairs.
    In each bucket of the others a few pivots, the same in every bucket that they share, are
    compared with all members; this links most of a large group in linear work.  Pairs that are
    still in different components are then taken where a cheap sketch allows a similarity of
    0.8, each in the least bucket it shares.  All links are verified exactly.

    Null and empty texts have no shingles and stay alone; a text of one to four words is one
    shingle.  Rows without an id have no class.  Rows that repeat an id are one vertex, but equal
    texts of several ids are one class whichever rows they are.
    """
    words, agree = registers // 16, agreeing_registers(registers)
    named = documents.select(F.col(id_column).alias("id"), F.col(text).alias("text"),
                             *([F.col(mark).alias("mark")] if mark else []))
    kept = ["mark"] if mark else []
    prints = materialize(fingerprints(named, "id", "text", bands=bands, rows=rows, registers=registers, keep=kept))
    known = prints.filter(F.col("id").isNotNull() & (F.col("size") > 0))
    classes = materialize(known.groupBy("set1", "set2", "size").agg(
        F.min("id").alias("rep"), F.min_by("keys", "id").alias("keys"), F.min_by("sketch", "id").alias("sketch")))

    spread = classes.select("rep", F.explode("keys").alias("key"))
    buckets = spread.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(join_by_key(spread, buckets, "key").select("key", "rep"))
    # Pivots are the members of the least hash under a few seeds.
    chosen = members.select("key", "rep", *[F.xxhash64("rep", F.lit(i)).alias(f"h{i}") for i in range(pivots)])
    chosen = chosen.groupBy("key").agg(F.array_distinct(F.array(
        *[F.min_by("rep", f"h{i}") for i in range(pivots)])).alias("p")).select("key", F.explode("p").alias("pivot"))
    star = (join_by_key(members, chosen, "key").filter("pivot != rep")
            .select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct())
    traits = classes.select("rep", "size", "sketch")
    a_side = traits.select(F.col("rep").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("ka"))
    b_side = traits.select(F.col("rep").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("kb"))
    star = materialize(
        star.join(a_side, "a").join(b_side, "b")
        .filter(_close_in_size(F.col("na"), F.col("nb")) & (_agreeing(F.col("ka"), F.col("kb"), words) >= agree))
        .select("a", "b"))

    involved = members.select(F.col("rep").alias("id")).distinct()
    sets = materialize(shingle_sets(named.join(involved, "id", "left_semi"), "id", "text"))
    linked = materialize(verified(star, sets))
    first = components(linked)

    placed = (members.join(first, F.col("rep") == F.col("v"), "left")
              .select("key", "rep", F.coalesce("c", "rep").alias("c")))
    counted = placed.groupBy("key", "c").agg(F.count("*").alias("n"))
    main = (counted.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count("*").alias("cs"))
            .filter("cs > 1").select("key", "main"))
    mixed = materialize(join_by_key(placed, main, "key").join(
        classes.select("rep", "size", "keys", "sketch"), "rep"))
    x = mixed.filter("c != main").select(*[F.col(c).alias(f"x_{c}") for c in mixed.columns])
    y = mixed
    least_shared = F.array_min(F.array_intersect("x_keys", "keys"))
    rest = x.join(
        y, (F.col("x_key") == F.col("key")) & (F.col("x_c") != F.col("c"))
        & ((F.col("c") == F.col("main")) | (F.col("x_rep") < F.col("rep")))
        & _close_in_size(F.col("x_size"), F.col("size"))
        & (_agreeing(F.col("x_sketch"), F.col("sketch"), words) >= agree)
        & (least_shared == F.col("key")))
    rest = rest.select(F.least("x_rep", "rep").alias("a"), F.greatest("x_rep", "rep").alias("b"))
    later = verified(rest.join(star, ["a", "b"], "left_anti").distinct(), sets)
    label = first.select(F.col("v"), F.col("c").alias("cv"))
    joined = (later.join(label.withColumnsRenamed({"v": "a", "cv": "ca"}), "a", "left")
              .join(label.withColumnsRenamed({"v": "b", "cv": "cb"}), "b", "left")
              .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct())
    second = components(materialize(joined))

    whole = first.join(second.select(F.col("v").alias("c"), F.col("c").alias("cc")), "c", "left").select(
        F.col("v").alias("rep"), F.coalesce("cc", "c").alias("root"))
    alone = second.join(first, "v", "left_anti").select(F.col("v").alias("rep"), F.col("c").alias("root"))
    roots = classes.select("set1", "set2", F.col("size").alias("_size"), "rep").join(
        whole.union(alone), "rep", "left").select(
        F.col("set1").alias("_s1"), F.col("set2").alias("_s2"), "_size",
        F.coalesce("root", "rep").alias("class_id"))
    roots = materialize(roots)
    out = prints.select("id", *kept, "set1", "set2", "size").join(
        roots, (F.col("set1") == F.col("_s1")) & (F.col("set2") == F.col("_s2"))
        & (F.col("size") == F.col("_size")), "left")
    mine = F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id"))
    return out.select(F.col("id").alias(id_column), *([F.col("mark").alias(mark)] if mark else []), mine.alias("class_id"))
