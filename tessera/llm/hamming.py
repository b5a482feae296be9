"""Exact top-k search over binary codes by incremental multi-index hashing (operator 10).

A code is the signs of a vector's components.  It is cut into segments; two codes at distance d
agree in some segment up to distance d // segments.  Searching grows the segment radius step by
step: once all segments have been searched to radius r, every code within distance
segments * (r + 1) - 1 has been met.  A query ends when its kth verified distance is within that
bound, so its answer is exact.

The index is dealt to blocks, each with its hash tables; the stated queries visit every block,
and the block answers are merged.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shuffle_partitions

WORD = 32


def sign_code(vector: str, bits: int) -> Column:
    """Words of 32 bits in longs; bit i tells that component i is above zero.

    Null and missing components count as not above zero.
    """
    words = []
    for at in range(0, bits, WORD):
        word = F.lit(0).cast("long")
        for i in range(at, min(at + WORD, bits)):
            word = word + F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << (i - at))).otherwise(F.lit(0))
        words.append(word)
    return F.array(*words)


def _segments(codes: np.ndarray, bits: int, segments: int) -> list[tuple[np.ndarray, int]]:
    """Value of every code in each segment, and the segment's width; codes are rows of words."""
    flat = np.unpackbits(codes.astype("<u4").view(np.uint8), axis=1, bitorder="little")[:, :bits]
    bounds = [bits * i // segments for i in range(segments + 1)]
    return [(flat[:, a:b] @ (1 << np.arange(b - a)), b - a) for a, b in zip(bounds, bounds[1:])]


class BlockIndex:
    """Hash tables of one block of codes, by segment."""

    def __init__(self, codes: np.ndarray, least_id: np.ndarray, bits: int, segments: int) -> None:
        self.codes, self.least_id = codes.astype(np.uint32), least_id
        self.bits, self.segments = bits, segments
        self.tables = []
        for value, width in _segments(codes, bits, segments):
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << width) + 1)), width))

    def _met(self, table, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) pairs at exactly ``radius`` in one segment."""
        order, starts, width = table
        masks = np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)
        if not len(masks):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        probe = (values[:, None] ^ masks).ravel()
        begin, count = starts[probe], starts[probe + 1] - starts[probe]
        query = np.repeat(np.repeat(np.arange(len(values)), len(masks)), count)
        ends = np.cumsum(count)
        within = np.arange(ends[-1]) - np.repeat(ends - count, count)
        return query, order[np.repeat(begin, count) + within]

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, distance) of the k entries of each query least by (distance, least id)."""
        queries = queries.astype(np.uint32)
        parts = _segments(queries, self.bits, self.segments)
        active = np.arange(len(queries))
        best = [np.zeros(0, np.int64)] * 3
        out = []
        need = min(k, len(self.codes))
        widest = max(width for _, _, width in self.tables)
        for radius in range(widest + 1):
            met = [self._met(t, v[active], radius) for t, (v, _) in zip(self.tables, parts)]
            query = active[np.concatenate([q for q, _ in met])]
            entry = np.concatenate([e for _, e in met])
            far = np.bitwise_count(queries[query] ^ self.codes[entry]).sum(axis=1, dtype=np.int64)
            query, entry, far = (np.concatenate(x) for x in zip(best, (query, entry, far)))
            # Every segment and an earlier round may have met an entry, so the kth distance is
            # at most where this many pairs are reached; only pairs up to there are sorted.
            met_at = np.bincount(query * (self.bits + 1) + far, minlength=len(queries) * (self.bits + 1))
            reached = np.cumsum(met_at.reshape(len(queries), -1), axis=1) >= need * (self.segments + 1)
            limit = np.where(reached.any(axis=1), reached.argmax(axis=1), self.bits)
            near = far <= limit[query]
            query, entry, far = query[near], entry[near], far[near]
            order = np.lexsort((entry, self.least_id[entry], far, query))
            query, entry, far = query[order], entry[order], far[order]
            new = np.ones(len(query), bool)
            new[1:] = (query[1:] != query[:-1]) | (entry[1:] != entry[:-1])
            query, entry, far = query[new], entry[new], far[new]
            first = np.searchsorted(query, active)
            rank = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query)))
            kept = rank < k
            query, entry, far = query[kept], entry[kept], far[kept]
            covered = self.segments * (radius + 1) - 1
            last = far[(rank[kept] == need - 1)]
            full = query[(rank[kept] == need - 1)][last <= covered]
            ended = np.isin(query, full) if radius < widest else np.ones(len(query), bool)
            out.append((query[ended], entry[ended], far[ended]))
            best = [query[~ended], entry[~ended], far[~ended]]
            active = np.setdiff1d(active, full, assume_unique=True)
            if not len(active):
                break
        return tuple(np.concatenate(x) for x in zip(*out))


def _first(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group, with their rank; Spark cuts to k before it shuffles."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def search(items: DataFrame, queries: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding",
           k: int = 10, bits: int = 64, block_entries: int = 1 << 18, chunk_queries: int = 1 << 19, segment_bits: int = 16) -> DataFrame:
    """Rows (id, neighbour, distance, rank): the k nearest items of each query by (distance,
    neighbour), the query's own row among them; all items if there are fewer than k.

    Equal codes are one entry of the index, with their k least ids.  Null vectors have the code
    of no positive component.  Items and queries without an id are left out; rows that repeat an
    id and a code count once.
    """
    spark = items.sparkSession

    def coded(df: DataFrame) -> DataFrame:
        return df.filter(F.col(id_column).isNotNull()).select(
            F.col(id_column).alias("id"), sign_code(vector, bits).alias("code")).distinct()

    listed = materialize(_first(coded(items), ["code"], ["id"], k).drop("rank"))
    entries = listed.groupBy("code").agg(F.min("id").cast("long").alias("least"))
    asked = materialize(coded(queries))
    codes = asked.select(F.col("code").alias("q")).distinct()
    number, asking = entries.count(), codes.count()
    # Every task has a block; blocks are bounded, and a small index is dealt to all tasks.
    blocks = max(-(-number // block_entries), min(shuffle_partitions(spark), -(-number // 8192)), 1)
    chunks = max(-(-asking // chunk_queries), 1)
    segments = max(1, round(bits / segment_bits))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            def matrix(column):
                return np.stack(column.to_numpy()).astype(np.int64)

            entry_codes, asked_codes = matrix(left.column("code")), matrix(right.column("q"))
            least = left.column("least").to_numpy()
            index = BlockIndex(entry_codes, least, bits, segments)
            for at in range(0, len(asked_codes), 256):
                q, e, far = index.search(asked_codes[at:at + 256], k)
                out.append(pa.Table.from_arrays(
                    [right.column("q").take(pa.array(q + at)), left.column("code").take(pa.array(e)),
                     pa.array(least[e]), pa.array(far)], names=["q", "code", "least", "distance"]))
        schema = pa.schema([("q", pa.list_(pa.int64())), ("code", pa.list_(pa.int64())),
                            ("least", pa.int64()), ("distance", pa.int64())])
        return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()

    # By a given number of partitions, so that Spark doesn't put small blocks into one task again.
    parts = max(blocks * chunks, 1)
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    left = entries.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(blocks))).withColumn("chunk", everywhere).repartition(parts, "block", "chunk")
    right = codes.withColumn("chunk", F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    ).repartition(parts, "block", "chunk")
    met = (left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
           .applyInArrow(run, "q array<bigint>, code array<bigint>, least bigint, distance bigint"))
    near = _first(met, ["q"], ["distance", "least"], k).drop("rank", "least")
    # Written out, so that the last join has a shuffle of its own and a hot code can be split.
    found = materialize(_first(near.join(listed, "code"), ["q"], ["distance", "id"], k))
    return asked.select(F.col("id").alias(id_column), F.col("code").alias("q")).join(
        found.select("q", F.col("id").alias("neighbour"), "distance", "rank"), "q").drop("q")
