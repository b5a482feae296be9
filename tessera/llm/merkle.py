"""Merkle dataset manifest by time-forward processing (operator 12).

Rows are leaves, ordered within their group; every ``fan`` consecutive nodes become one node of
the next level until one remains, and the groups' roots form a tree of the same kind.

Nodes are labelled in the order in which a sweep over the leaves completes them.  A sweep takes
messages in label order from a priority queue: a node that has the digests of all its children
sends its own to its parent's label.  The queue is external: blocks of ``fan ** BLOCK_LEVELS``
leaves are whole subtrees, Spark's shuffle sorts their messages, and within a block a heap holds
what is under way.  A block sends one message, the digest of its top, to the next round.  The
reversed sweep goes from the root to the leaves: a node sends each child the digests of its
siblings followed by its own suffix, so that a leaf receives its whole proof.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import release, shuffle_partitions, stored

FAN = 8
#: Levels of the subtree that one block holds: 512 leaves.
BLOCK_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(encoded(f) for f in fields)), 256))


def joined(digests: Sequence[bytes]) -> bytes:
    """Digest over child digests in hexadecimal."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def height(leaves: int, fan: int = FAN) -> int:
    """Levels above the leaves."""
    n = 0
    while leaves > 1:
        leaves, n = -(-leaves // fan), n + 1
    return n


def run_sizes(position: int, leaves: int, fan: int = FAN) -> list[tuple[int, int]]:
    """For each level below the root: place of a leaf's ancestor in its run, and the run's length."""
    out = []
    while leaves > 1:
        at = position // fan
        out.append((position % fan, min(fan, leaves - at * fan)))
        position, leaves = at, -(-leaves // fan)
    return out


class Block:
    """The nodes above consecutive digests that start at ``first``, a multiple of the block's size,
    in a level of ``total`` nodes; ``levels`` levels, or fewer if the root comes first."""

    def __init__(self, first: int, digests: Sequence[bytes], total: int, levels: int, fan: int = FAN) -> None:
        self.fan = fan
        #: Digest of each node by (level above the block's floor, index in that level).
        self.nodes: dict[tuple[int, int], bytes] = {}
        self.sizes = [total]
        for _ in range(levels):
            if self.sizes[-1] > 1:
                self.sizes.append(-(-self.sizes[-1] // fan))
        self.top = len(self.sizes) - 1
        self._forward(first, digests)

    def _label(self, level: int, index: int) -> tuple[int, int]:
        """The last floor node below a node, then its level: children come before parents."""
        return min((index + 1) * self.fan ** level, self.sizes[0]) - 1, level

    def _forward(self, first: int, digests: Sequence[bytes]) -> None:
        queue: list[tuple[tuple[int, int], int, int, bytes]] = []

        def complete(level: int, index: int, digest: bytes) -> None:
            self.nodes[level, index] = digest
            if level < self.top:
                heapq.heappush(queue, (self._label(level + 1, index // self.fan), level, index, digest))

        for i, digest in enumerate(digests, first):
            complete(0, i, digest)
            # Labels up to this floor node are due.
            while queue and queue[0][0][0] <= i:
                label, level, index, _ = queue[0]
                children = []
                while queue and queue[0][0] == label:
                    children.append(heapq.heappop(queue)[3])
                complete(level + 1, index // self.fan, joined(children))

    def root(self) -> tuple[int, bytes]:
        """Index and digest of the top node."""
        (_, index), digest = max(self.nodes.items())
        return index, digest

    def backward(self, suffix: str) -> Iterator[tuple[int, str]]:
        """(index, proof) of the floor's nodes, given the proof of the top node."""
        queue = [((-key[0], -key[1]), self.top, index, suffix)
                 for index in [self.root()[0]] for key in [self._label(self.top, index)]]
        while queue:
            _, level, index, above = heapq.heappop(queue)
            if not level:
                yield index, above
                continue
            first = index * self.fan
            run = range(first, min(first + self.fan, self.sizes[level - 1]))
            hexes = [self.nodes[level - 1, i].hex() for i in run]
            for k, i in enumerate(run):
                a, b = self._label(level - 1, i)
                heapq.heappush(queue, ((-a, -b), level - 1, i, "".join((*hexes[:k], *hexes[k + 1:], above))))


def fold(leaf: bytes, proof: str, runs: Sequence[tuple[int, int]]) -> bytes:
    """Root that follows from a leaf and its proof."""
    at = 0
    for place, size in runs:
        left, right = at + 64 * place, at + 64 * (size - 1)
        text = proof[at:left] + leaf.hex() + proof[left:right]
        leaf, at = hashlib.sha256(text.encode()).digest(), right
    return leaf


def positions(leaves: DataFrame, group: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows (g, n, groups, i) and the columns ``keep``: the group's rank, its rows, the number of
    groups, and the row's place in its group, all from 0; nulls come first.

    Rows are dealt by range, so no group has to fit a task; counts of each range give the offsets.
    """
    spark = leaves.sparkSession
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    # Stored: the bounds of ranges are drawn from a sample, which another run may draw otherwise.
    ranged = stored(leaves.repartitionByRange(shuffle_partitions(spark), *keys).withColumn("part", F.spark_partition_id()))
    counts = stored(ranged.groupBy("part", group).agg(F.count("*").alias("here")))
    # A group has at most one row a part here.
    of_group = Window.partitionBy(group)
    before = of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", group, "here", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"),
                           F.sum("here").over(of_group).alias("n"), F.min("part").over(of_group).alias("home"))
    starts = counts.filter("part = home").select(
        group, "home", F.row_number().over(Window.partitionBy("home").orderBy(F.col(group).asc_nulls_first())).alias("k"))
    # One row a part from here: as many as shuffle partitions.
    parts = starts.groupBy("home").agg(F.count("*").alias("new"))
    parts = parts.select("home", F.sum("new").over(Window.partitionBy(F.lit(0))).alias("groups"), F.coalesce(F.sum("new").over(
        Window.partitionBy(F.lit(0)).orderBy("home").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranks = starts.join(parts, "home").select(
        F.col(group).alias("_g"), (F.col("base") + F.col("k") - 1).alias("g"), "groups")
    placed = counts.join(ranks, F.col(group).eqNullSafe(F.col("_g"))).select(
        F.col("part").alias("_part"), "_g", "g", "groups", "n", "offset")
    rows = ranged.join(placed, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_g")))
    number = F.row_number().over(Window.partitionBy("part", "g").orderBy(*keys[1:]))
    return rows.select("g", "n", "groups", (F.col("offset") + number - 1).alias("i"), *keep)


def _blocks(batches, columns: Sequence[str]):
    """Runs of rows of one block, as lists of tuples of ``columns`` (g and block first)."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if held and held[0][:2] != row[:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _by_block(df: DataFrame, fan: int, levels: int, *order: str) -> DataFrame:
    """Blocks dealt by hash and sorted: the external side of the queue."""
    size = fan ** levels
    return (df.withColumn("block", F.floor(F.col("i") / F.lit(size)).cast("long"))
            .repartition("g", "block").sortWithinPartitions("g", "block", *order))


def _upward(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """One round: from the digests (g, n, i, digest) of a level those of the tops of its blocks, with
    the size of their own level."""

    def run(batches):
        for rows in _blocks(batches, ("g", "block", "n", "i", "digest")):
            g, _, n = rows[0][:3]
            block = Block(rows[0][3], [r[4] for r in rows], n, levels, fan)
            index, digest = block.root()
            yield pa.RecordBatch.from_arrays(
                [pa.array([g]), pa.array([block.sizes[-1]]), pa.array([index]), pa.array([digest], pa.binary())],
                names=["g", "n", "i", "digest"])

    dealt = _by_block(nodes.select("g", "n", "i", "digest"), fan, levels, "i")
    return dealt.mapInArrow(run, "g bigint, n bigint, i bigint, digest binary")


def _climb(nodes: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """Tables of the block tops of every round; the last holds one node a group."""
    out = []
    tallest = nodes.agg(F.max("n")).first()[0] or 0
    rounds = max(1, -(-height(tallest, fan) // levels))
    for _ in range(rounds):
        nodes = stored(_upward(nodes, fan, levels))
        release(nodes.sparkSession)
        out.append(nodes)
    return out


def _downward(nodes: DataFrame, tops: DataFrame, fan: int, levels: int) -> DataFrame:
    """Proofs (g, i, proof, subroot, root) of a level's nodes (g, n, i, digest), given those of the
    tops of its blocks."""

    def run(batches):
        for rows in _blocks(batches, ("g", "block", "n", "i", "digest", "proof", "subroot", "root")):
            top, floor = rows[0], rows[1:]
            block = Block(floor[0][3], [r[4] for r in floor], floor[0][2], levels, fan)
            index, proof = zip(*block.backward(top[5]))
            n = len(index)
            yield pa.RecordBatch.from_arrays(
                [pa.array([top[0]] * n), pa.array(index), pa.array(proof),
                 pa.array([top[6]] * n, pa.binary()), pa.array([top[7]] * n, pa.binary())],
                names=["g", "i", "proof", "subroot", "root"])

    return _with_tops(nodes, tops, fan, levels).mapInArrow(
        run, "g bigint, i bigint, proof string, subroot binary, root binary")


def _with_tops(nodes: DataFrame, tops: DataFrame, fan: int, levels: int, *carried: str) -> DataFrame:
    """A level's nodes sorted by block; before each block the row of its top, which has a proof."""
    kinds = nodes.schema
    floor = nodes.select("g", "n", "i", "digest", F.lit(None).cast("string").alias("proof"),
                         F.lit(None).cast("binary").alias("subroot"), F.lit(None).cast("binary").alias("root"), *carried)
    above = tops.select("g", F.lit(None).cast("bigint").alias("n"), (F.col("i") * fan ** levels).alias("i"),
                        F.lit(None).cast("binary").alias("digest"), "proof", "subroot", "root",
                        *(F.lit(None).cast(kinds[c].dataType).alias(c) for c in carried))
    both = floor.union(above).withColumn("is_floor", F.col("proof").isNull())
    return _by_block(both, fan, levels, "is_floor", "i")


def _proved(rows: DataFrame, tops: DataFrame, fan: int, levels: int, carried: Sequence[str]) -> DataFrame:
    """The last round of the reversed sweep: leaves with their proofs, and the roots that follow from
    the digests in ``changed``."""

    def run(batches):
        names = ("g", "block", "n", "i", "digest", "proof", "subroot", "root", "groups", "changed", *carried)
        for held in _blocks(batches, names):
            top, floor = held[0], held[1:]
            block = Block(floor[0][3], [r[4] for r in floor], floor[0][2], levels, fan)
            proofs = dict(block.backward(top[5]))
            above = run_sizes(top[0], floor[0][8], fan)
            folded = [fold(r[9], proofs[r[3]], run_sizes(r[3], r[2], fan) + above) for r in floor]
            n = len(floor)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[10 + k] for r in floor], kinds[k]) for k in range(len(carried))),
                 pa.array([r[4] for r in floor], pa.binary()), pa.array([proofs[r[3]] for r in floor]),
                 pa.array([top[6]] * n, pa.binary()), pa.array([top[7]] * n, pa.binary()),
                 pa.array(folded, pa.binary())],
                names=[*carried, "leaf", "proof", "subroot", "root", "folded"])

    kinds = [to_arrow_type(rows.schema[c].dataType) for c in carried]
    listed = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)
    return _with_tops(rows, tops, fan, levels, "groups", "changed", *carried).mapInArrow(
        run, f"{listed}, leaf binary, proof string, subroot binary, root binary, folded binary")


def manifest(rows: DataFrame, *, id_column: str = "doc_id", group: str = "lang",
             fields: Sequence[str] = FIELDS, claimed: dict[str, Column] | None = None, fan: int = FAN,
             block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Rows (id, leaf, proof, subroot, root, folded), one for each row of the table.

    The leaf is the digest of the ``fields``; leaves are ordered by id in each group, null ids
    first and rows of one id by their leaf, so that repeated rows are leaves of their own in a
    tree that doesn't depend on their order.  Groups are ordered bytewise, null first.  ``proof``
    is the digests of the leaf's siblings, then of its ancestors' siblings up to the root, each
    level from left to right, in hexadecimal.  ``folded`` is the root that follows from the proof
    and the leaf of the row as ``claimed``: other values for some fields (null stays null).  Null
    and empty values differ; texts of any length are hashed whole.  An empty table has no rows.
    Columns besides id, group and fields are not looked at.
    """
    spark = rows.sparkSession
    claimed = claimed or {}
    source = rows.select(F.col(id_column).alias("id"), F.col(group).alias("grp"),
                         leaf_digest([F.col(f) for f in fields]).alias("digest"),
                         leaf_digest([claimed.get(f, F.col(f)) for f in fields]).alias("changed"))
    # The unique number splits rows that agree in everything.
    leaves = stored(source.withColumn("number", F.monotonically_increasing_id()))
    placed = stored(positions(leaves, "grp", ("id", "digest", "number"), ("id", "digest", "changed")))
    release(spark)
    levels = _climb(placed, fan, block_levels)
    subroots = levels[-1].select(F.col("g").alias("i"), F.col("digest"))
    count = placed.agg(F.max("groups")).first()[0]
    if count is None:
        return placed.select(F.col("id").alias(id_column), F.col("digest").alias("leaf"), F.lit("").alias("proof"),
                             *(F.col("digest").alias(c) for c in ("subroot", "root", "folded")))
    heads = subroots.select(F.lit(0).cast("bigint").alias("g"), F.lit(count).cast("bigint").alias("n"), "i", "digest")
    top = _climb(heads, fan, block_levels)
    none = F.lit("").alias("proof")
    proofs = top[-1].select("g", "i", none, F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    for nodes in [*top[-2::-1], heads]:
        proofs = stored(_downward(nodes, proofs, fan, block_levels))
    # A group's root is the top of its last blocks.
    proofs = (proofs.withColumnRenamed("i", "g_").join(subroots.withColumnRenamed("i", "g_"), "g_")
              .select(F.col("g_").alias("g"), F.lit(0).cast("bigint").alias("i"), "proof",
                      F.col("digest").alias("subroot"), "root"))
    for nodes in levels[-2::-1]:
        proofs = stored(_downward(nodes, proofs, fan, block_levels))
    out = _proved(placed, proofs, fan, block_levels, ("id",))
    return out.withColumnRenamed("id", id_column)


def lowered(text: Column) -> Column:
    """ASCII capitals in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def verified(documents: DataFrame) -> DataFrame:
    """Proofs of all documents, checked against a copy in which the texts of every third are in lower
    case."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(chosen, lowered(F.col("text"))).otherwise(F.col("text"))
    out = manifest(documents, claimed={"text": text})
    return out.select(
        "doc_id", *(F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")),
        F.sha2("proof", 256).alias("proof_sha256"), F.lower(F.hex("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))
