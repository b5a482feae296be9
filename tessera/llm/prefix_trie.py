"""Prefix trie of conversations from sharded double arrays (operator 13).

Conversations are sequences of turns; equal ones are one sequence with a weight.  Sequences are
dealt to shards by a prefix: the shortest of 1, 2, 4, … turns under which few enough turns lie.
Everything from that depth on is inside one shard; the nodes above it, and all nodes of a sequence
that ends before it, are shared with other shards.

A shard numbers its distinct turns densely and packs its trie into a double array: the child of
node s by turn t is ``BASE[s] + t``, and ``CHECK`` there holds s.  Traversing it gives the shard's
own nodes with their aggregates, and one path of shared nodes per prefix.  Shared nodes are merged
over all shards by the digest of their path.  Sums over a shared node's subtree need each node
below it once: a node belongs to its smallest member, whose nodes are those from some depth on,
so a path adds its nodes from that depth only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release, stored

#: Turns under one prefix, and about as many as a shard holds.
SHARD_TURNS = 4_096
#: Ids of one range of 2^ID_BITS that are put into one string before they are hashed in order.
ID_BITS = 12
_TURN = "array<struct<key:binary,bytes:int>>"


class DoubleArray:
    """A static trie over sequences of numbers from 1 on; node 0 is the root.

    Bases may be negative, so a node with one child can use any free place.
    """

    def __init__(self, sequences: Sequence[Sequence[int]]) -> None:
        order = sorted(range(len(sequences)), key=sequences.__getitem__)
        size = 1 + sum(map(len, sequences))
        self.base = np.zeros(size + 1, np.int64)
        self.check = np.full(size + 1, -1, np.int64)
        self.check[0] = 0
        free = 1
        # Level by level, so that turns first seen together lie together.
        level = [(0, order)]
        depth = 0
        while level:
            below = []
            for node, members in level:
                children: dict[int, list[int]] = {}
                for i in members:
                    if len(sequences[i]) > depth:
                        children.setdefault(sequences[i][depth], []).append(i)
                if not children:
                    continue
                labels = np.fromiter(children, np.int64)
                while self.check[free] >= 0:
                    free += 1
                places = self._fit(labels - labels[0], free)
                self.base[node] = places[0] - labels[0]
                self.check[places] = node
                below += zip(places.tolist(), children.values())
            level, depth = below, depth + 1
        self.depth = depth

    def _fit(self, offsets: np.ndarray, start: int) -> np.ndarray:
        """The first places from ``start`` on that are all free; the arrays grow as needed."""
        at = start
        while True:
            self._reserve(at + int(offsets[-1]) + 1)
            taken = np.flatnonzero(self.check[at + offsets] >= 0)
            if not len(taken):
                return at + offsets
            at += 1
            while self.check[at] >= 0:
                at += 1
                self._reserve(at + 1)

    def _reserve(self, size: int) -> None:
        if size >= len(self.check):
            more = max(size + 1 - len(self.check), len(self.check) // 2 + 1)
            self.base = np.concatenate((self.base, np.zeros(more, np.int64)))
            self.check = np.concatenate((self.check, np.full(more, -1, np.int64)))

    def walk(self, sequences: Sequence[Sequence[int]]) -> np.ndarray:
        """Nodes that each sequence passes: row i holds its nodes by depth, -1 after its end or where
        the trie has no such path."""
        width = max(map(len, sequences), default=0)
        out = np.full((len(sequences), width + 1), -1, np.int64)
        out[:, 0] = 0
        lengths = np.array([len(s) for s in sequences], np.int64)
        for d in range(width):
            rows = np.flatnonzero((lengths > d) & (out[:, d] >= 0))
            node = out[rows, d]
            to = self.base[node] + np.array([sequences[i][d] for i in rows], np.int64)
            inside = (to > 0) & (to < len(self.check))
            rows, node, to = rows[inside], node[inside], to[inside]
            held = self.check[to] == node
            out[rows[held], d + 1] = to[held]
        return out


@dataclass
class Shard:
    """Sequences of one shard: smallest member and weight, turns as (key, bytes), and the depth from
    which on nodes are the shard's own."""

    conv: list[int]
    weight: list[int]
    turns: list[list[dict]]
    depth: list[int]

    def traverse(self) -> tuple[list[tuple], list[tuple]]:
        """Own nodes and paths.

        A node is (conv, depth, parent's conv, digest of a shared parent, members, children, leaves,
        saved bytes, conv of the sequence that ends there).  A path is (conv, weight, digests of its
        shared nodes from the root and the bytes of turns before each, all their bytes, whether own
        nodes follow, their leaves and saved bytes, conv of a sequence that ends in a shared node).
        """
        # Level by level, so that the turns that follow one node have near numbers.
        number: dict[bytes, int] = {}
        for d in range(max(map(len, self.turns))):
            for turns in self.turns:
                if d < len(turns):
                    number.setdefault(turns[d]["key"], len(number) + 1)
        sequences = [[number[t["key"]] for t in turns] for turns in self.turns]
        passed = DoubleArray(sequences).walk(sequences)
        n = int(passed.max()) + 1
        lengths = np.array([len(s) for s in sequences])
        conv, weight = np.array(self.conv, np.int64), np.array(self.weight, np.int64)
        first = np.full(n, np.iinfo(np.int64).max)
        members, sizes, own = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        parent, at_depth, ends = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        depth = np.array(self.depth)
        for d in range(passed.shape[1]):
            rows = np.flatnonzero(passed[:, d] >= 0)
            node = passed[rows, d]
            np.minimum.at(first, node, conv[rows])
            np.add.at(members, node, weight[rows])
            at_depth[node] = d
            own[node] = depth[rows] <= d
            if d:
                parent[node] = passed[rows, d - 1]
                sizes[node] = [self.turns[i][d - 1]["bytes"] for i in rows]
        ends[passed[np.arange(len(lengths)), lengths]] = np.arange(len(lengths))
        # From the deepest nodes up: own nodes are whole here, whatever their parents are.
        saved = (members - 1) * sizes
        children, leaves = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for d in range(passed.shape[1] - 1, 0, -1):
            node = np.flatnonzero(own & (at_depth == d))
            leaves[node] += children[node] == 0
            np.add.at(children, parent[node], 1)
            inner = node[own[parent[node]]]
            np.add.at(leaves, parent[inner], leaves[inner])
            np.add.at(saved, parent[inner], saved[inner])
        digest = self._digests(passed, depth, lengths)
        nodes = [(int(first[v]), int(at_depth[v]), int(first[parent[v]]) if own[parent[v]] else None,
                  None if own[parent[v]] else digest[int(parent[v])], int(members[v]), int(children[v]),
                  int(leaves[v]), int(saved[v]), int(conv[ends[v]]) if ends[v] >= 0 else None)
                 for v in np.flatnonzero(own).tolist()]
        paths, begun = [], set()
        for i, length in enumerate(lengths.tolist()):
            inside = length >= depth[i]
            stop = int(depth[i]) if inside else length + 1
            head = int(passed[i, stop]) if inside else -1
            if inside and head in begun:
                continue
            begun.add(head)
            shared = passed[i, :stop]
            upto = np.concatenate(([0], np.cumsum(sizes[shared]))).tolist()
            paths.append((int(first[head]) if inside else int(conv[i]), int(members[head]) if inside else int(weight[i]),
                          [digest[v] for v in shared.tolist()], upto[:-1], upto[-1], inside,
                          int(leaves[head]) if inside else 0, int(saved[head]) if inside else 0,
                          None if inside else int(conv[i])))
        return nodes, paths

    def _digests(self, passed: np.ndarray, depth: np.ndarray, lengths: np.ndarray) -> dict[int, bytes]:
        """Digests of the paths to shared nodes."""
        out = {0: b""}
        for i, turns in enumerate(self.turns):
            for d in range(1, min(int(depth[i]), int(lengths[i]) + 1)):
                v = int(passed[i, d])
                if v not in out:
                    out[v] = hashlib.sha256(out[int(passed[i, d - 1])] + turns[d - 1]["key"]).digest()[:16]
        return out


def turn_key(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of a turn; the role's length keeps role and text apart."""
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turns): keys and text bytes of a conversation's turns in order.

    Turns are ordered by number, null first, and equal numbers by the turn's digest; rows that agree in
    everything are all kept.  Null roles and texts count as empty.  Rows without a conv_id belong to no
    conversation and are left out.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    made = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", turn_key(role, text).alias("key"),
        F.octet_length(text).alias("bytes"))
    listed = F.sort_array(F.collect_list(F.struct("turn", "key", "bytes")))
    return made.groupBy("conv_id").agg(listed.alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["bytes"].alias("bytes"))).alias("turns"))


def regrouped(conversations: DataFrame, *, of: int = 5, heads: int = 9) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % ``of`` in place of its own
    first h, where h is its CRC-32 modulo ``heads``; fewer where there are fewer, none without such a
    conversation."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = conversations.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % of).alias("source"))
    heads_of = conversations.select(F.col("conv_id").alias("source"), F.slice("turns", 1, heads - 1).alias("head"))
    head = F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.greatest("h", F.lit(1))))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(heads_of, "source", "left").select(
        "conv_id", F.concat(F.coalesce(head, F.array().cast(_TURN)), rest).alias("turns"))


def _prefix(turns: Column, length: Column) -> Column:
    keys = F.transform(F.slice(turns, F.lit(1), length), lambda t: F.hex(t["key"]))
    return F.substring(F.unhex(F.sha2(F.concat_ws("", keys), 256)), 1, 16)


def dealt(sequences: DataFrame, shard_turns: int) -> DataFrame:
    """Add ``depth``, from which on a sequence's nodes are in its shard alone, and ``shard``.

    The depth is twice the largest power of two whose prefix has over ``shard_turns`` turns below it,
    or 1.  Prefixes of that kind are at most as many as twice all turns by ``shard_turns``, times the
    number of powers.
    """
    size = F.size("turns")
    # Prefixes of 1, 2, 4, … turns, as long as there are so many.
    powers = F.transform(
        F.sequence(F.lit(0), F.length(F.bin(F.greatest(size, F.lit(1)))) - 1),
        lambda k: F.struct(k.alias("k"), _prefix(F.col("turns"), F.pow(2, k).cast("int")).alias("prefix")))
    prefixes = sequences.filter(size > 0).select("conv_id", size.alias("n"), F.explode(powers).alias("p")).select(
        "conv_id", "n", "p.k", "p.prefix")
    prefixes = stored(prefixes)
    heavy = (prefixes.groupBy("k", "prefix").agg(F.sum("n").alias("below"))
             .filter(F.col("below") > shard_turns).select("k", "prefix"))
    # The second key gives both sides a shuffle of their own, so that a hot prefix is split.
    spread = F.pmod(F.xxhash64("prefix", "k"), F.lit(1 << 20))
    deep = (prefixes.withColumn("b", spread).join(heavy.withColumn("b", spread), ["k", "prefix", "b"])
            .groupBy("conv_id").agg((F.max("k") + 1).alias("k")))
    depth = F.pow(2, F.coalesce("k", F.lit(0))).cast("int")
    out = sequences.join(deep, "conv_id", "left").select("conv_id", "weight", "turns", depth.alias("depth"))
    # A sequence that ends before its depth may be in any shard.
    return out.withColumn("shard", F.xxhash64(_prefix(F.col("turns"), F.col("depth"))))


def _traversed(sequences: DataFrame, shards: int) -> DataFrame:
    """Rows of kind node and path of all shards (see ``Shard.traverse``)."""
    names = ("conv", "depth", "parent", "parent_digest", "members", "children", "leaves", "saved", "ends")
    more = ("digests", "before", "total", "inside")
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 5,
             pa.list_(pa.binary()), pa.list_(pa.int64()), pa.int64(), pa.bool_()]

    def rows_of(held):
        nodes, paths = Shard(*zip(*held)).traverse()
        rows = [(*n, None, None, None, None) for n in nodes]
        rows += [(c, None, None, None, w, None, leaves, saved, ends, digests, before, total, inside)
                 for c, w, digests, before, total, inside, leaves, saved, ends in paths]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*names, *more])

    def run(batches):
        shard, held = None, []
        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "weight", "turns", "depth"))):
                if held and key != shard:
                    yield rows_of(held)
                    held = []
                shard = key
                held.append(row)
        if held:
            yield rows_of(held)

    parts = (sequences.withColumn("shard", F.pmod("shard", F.lit(shards)))
             .repartition("shard").sortWithinPartitions("shard", "conv_id"))
    return parts.mapInArrow(
        run, "conv bigint, depth int, parent bigint, parent_digest binary, members bigint, children bigint, "
             "leaves bigint, saved bigint, ends bigint, digests array<binary>, before array<bigint>, total bigint, inside boolean")


def _spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a column of digests or numbers, open to the split of a hot key."""
    b = F.pmod(F.xxhash64(key), F.lit(1 << 20))
    return left.withColumn("_b", b).join(right.withColumn("_b", b), [key, "_b"], how).drop("_b")


def ends_digests(members: DataFrame) -> DataFrame:
    """Rows (ends, ends_sha256): for each sequence, named by its smallest conversation, the SHA-256 of
    all its conversations in order.

    Ids of one range are joined first, so the rows that one task reads in order are few; no list of a
    sequence's conversations is held anywhere.
    """
    ranges = (members.groupBy("ends", F.shiftright("conv_id", ID_BITS).alias("range"))
              .agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids")))

    def run(batches):
        last, state = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column("ends").to_pylist(), batch.column("ids").to_pylist()):
                if key != last:
                    if state:
                        done.append((last, state.hexdigest()))
                    last, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield made(done)
        if state:
            yield made([(last, state.hexdigest())])

    def made(rows):
        keys, values = zip(*rows) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.string())],
                                          names=["ends", "ends_sha256"])

    return (ranges.repartition("ends").sortWithinPartitions("ends", "range").select("ends", "ids")
            .mapInArrow(run, "ends bigint, ends_sha256 string"))


def trie(conversations: DataFrame, *, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256),
    one for each node of the trie over conversations (conv_id, turns).

    A node is named by its smallest conversation and its depth.  Conversations without turns end in
    the root; an empty table has no nodes.  A conversation's own turns are one row, since a node's
    identity is its whole path.
    """
    spark = conversations.sparkSession
    keys = F.transform("turns", lambda t: F.hex(t["key"]))
    members = stored(conversations.withColumn("sequence", F.unhex(F.sha2(F.concat_ws("", keys), 256))))
    first = members.groupBy("sequence").agg(F.min("conv_id").alias("ends"), F.count("*").alias("weight"))
    first = stored(first)
    sequences = members.drop("sequence").join(first.select(F.col("ends").alias("conv_id"), "weight"), "conv_id")
    placed = stored(dealt(stored(sequences), shard_turns))
    shards = max(1, -(-(placed.agg(F.sum(F.size("turns"))).first()[0] or 0) // shard_turns))
    found = stored(_traversed(placed, shards))
    release(spark)

    own = found.filter("digests IS NULL")
    paths = found.filter("digests IS NOT NULL")
    steps = paths.select("conv", "members", "ends", F.posexplode(F.arrays_zip(
        F.col("digests").alias("digest"), F.concat(F.array(F.lit(None).cast("binary")), "digests").alias("above"))).alias("depth", "at"),
        F.size("digests").alias("stop"), "inside").filter(F.col("depth") < F.col("stop"))
    last = F.col("depth") == F.col("stop") - 1
    shared = stored(
        steps.groupBy("at.digest").agg(
            F.min("conv").alias("conv"), F.min("depth").alias("depth"),
            F.min("at.above").alias("above"), F.sum("members").alias("members"),
            F.min(F.when(last, F.col("ends"))).alias("ends"),
            F.sum((last & F.col("inside")).cast("int")).alias("own_children")))
    # Children: shared nodes below, and the tops of what shards hold alone.
    below = shared.filter("depth > 0").groupBy(F.col("above").alias("digest")).agg(F.count("*").alias("shared_children"))
    counted = stored(_spread_join(shared, below, "digest", "left").withColumn(
        "children", F.col("own_children") + F.coalesce("shared_children", F.lit(0))).drop("own_children", "shared_children"))

    # A path adds the nodes of its smallest member from the depth on where that is smallest of all.
    begin = shared.groupBy("conv").agg(F.min("depth").alias("begin"))
    ended = counted.filter("ends IS NOT NULL").select("ends", (F.col("children") == 0).alias("leaf"))
    known = paths.join(begin, "conv", "left").join(ended, "ends", "left")
    sums = (known.select("members", "leaves", "saved", "leaf", "total",
                    F.coalesce(F.try_element_at("before", F.col("begin") + 1), F.col("total")).alias("not_mine"),
                    F.explode(F.arrays_zip(F.col("digests").alias("digest"), "before")).alias("at"))
            .groupBy("at.digest").agg(
                F.sum(F.col("leaves") + F.coalesce(F.col("leaf"), F.lit(False)).cast("int")).alias("leaves"),
                F.sum(F.col("saved") + F.col("members") * (F.col("total") - F.col("at.before"))
                      - (F.col("total") - F.greatest("not_mine", "at.before"))).alias("saved")))
    upper = _spread_join(counted, sums, "digest")
    names = upper.select(F.col("digest").alias("parent_digest"), F.col("conv").alias("parent_conv"))

    columns = ("conv", "depth", "members", "children", "leaves", "saved", "ends")
    top = upper.filter("depth = 0").select(*columns, F.lit(None).cast("bigint").alias("parent"))
    linked = own.filter("parent_digest IS NOT NULL").select(*columns, "parent_digest").union(
        upper.filter("depth > 0").select(*columns, F.col("above").alias("parent_digest")))
    linked = _spread_join(linked, names, "parent_digest").select(*columns, F.col("parent_conv").alias("parent"))
    nodes = top.union(linked).union(own.filter("parent_digest IS NULL").select(*columns, "parent"))

    named = _spread_join(members.select("conv_id", "sequence"), first.select("sequence", "ends"), "sequence")
    digests = ends_digests(named.select("ends", "conv_id"))
    ending = nodes.filter("ends IS NOT NULL").join(digests, "ends")
    other = nodes.filter("ends IS NULL").withColumn("ends_sha256", F.sha2(F.lit(""), 256))
    wanted = [F.col("conv").alias("conv_id"), F.col("depth").cast("bigint").alias("depth"), F.col("parent").alias("parent_conv_id"),
              F.col("members").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
              F.col("saved").alias("saved_tokens"), "ends_sha256"]
    return ending.select(*wanted).union(other.select(*wanted))


def nodes(turns: DataFrame) -> DataFrame:
    """The trie over the regrouped conversations of a table of turns."""
    return trie(regrouped(ordered_turns(turns)))
