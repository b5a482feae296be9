"""Byte-level BPE by length-bucketed matrices (operator 1).

The pieces of a batch are put into padded matrices of pieces of similar length.  In each
round every row merges its leftmost pair of minimum rank, found in a hash table of pairs;
rows without a pair leave the matrix.  Pieces longer than ``matrix_bytes`` merge in the same
order with a heap, because a matrix would take a round per byte.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from tessera.llm.common import slices

RANKS = "byte_bpe_50k.tiktoken"
_NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing hash table from a pair of tokens to the rank of their union."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(len(left) * 3 + 1))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, _NONE, np.int32)
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        self.probes = 1
        while len(key):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = key[free]  # of several for one slot the last stays
            own = self.keys[slot] == key
            self.ranks[slot[own]] = rank[own]
            key, rank, slot = key[~own], rank[~own], (slot[~own] + 1) & (size - 1)
            self.probes += bool(len(key))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at = (slot[open_] + 1) & (len(self.keys) - 1)
            slot[open_] = at
            found = self.keys[at]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out


_NARROW = 0x250


def narrow_pattern(pattern: str) -> re.Pattern:
    """The pattern for texts below U+0250, with its Unicode classes written out.

    The standard engine takes half the time of the one that knows the classes by name.
    """
    def members(name: str) -> str:
        known = regex.compile(name)
        return "".join(f"\\u{c:04x}" for c in range(_NARROW) if known.fullmatch(chr(c)))

    out, inside = [], False
    for token in regex.findall(r"\\p\{\w+\}|\\.|.", pattern, flags=regex.DOTALL):
        if token == r"\S":
            token = f"[^{members(chr(92) + 's')}]"
        elif token == r"\s" or token.startswith(r"\p"):
            token = members(token) if inside else f"[{members(token)}]"
        elif token in "[]":
            inside = token == "["
        out.append(token)
    return re.compile("".join(out))


class Bpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str, matrix_bytes: int = 256, cache: int = 300_000) -> None:
        with open(path, "rb") as file:
            rows = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern, self.narrow = regex.compile(pattern), narrow_pattern(pattern)
        self.wide = re.compile(f"[^\\x00-{chr(_NARROW - 1)}]")
        self.matrix_bytes, self.cache_size = matrix_bytes, cache
        self.cache: dict[str, bytes] = {}  # ids as little-endian 32-bit integers
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], rank) for t, rank in self.ranks.items()
                 for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = np.array(pairs, np.int64).T
        self.pairs = PairTable(left, right, rank.astype(np.int32))
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Encode pieces of at most ``width`` bytes, all in one matrix."""
        lengths = np.array([len(p) for p in pieces])
        tokens = np.full((len(pieces), width), -1, np.int32)
        inside = np.arange(width) < lengths[:, None]
        tokens[inside] = self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)]
        out = [b""] * len(pieces)
        row = np.arange(len(pieces))
        rank = np.full((len(pieces), width), _NONE, np.int32)
        valid = inside[:, 1:]
        rank[:, :-1][valid] = self.pairs.lookup(tokens[:, :-1][valid], tokens[:, 1:][valid])
        while len(row):
            best = rank.argmin(axis=1)
            at = np.arange(len(row))
            merged = rank[at, best]
            done = merged == _NONE
            if done.any():
                ended = np.flatnonzero(done)
                block, stride = tokens[ended].tobytes(), 4 * tokens.shape[1]
                for k, (i, n) in enumerate(zip(row[ended].tolist(), lengths[ended].tolist())):
                    out[i] = block[k * stride:k * stride + 4 * n]
                keep = np.flatnonzero(~done)
                lengths, row, best, merged = lengths[keep], row[keep], best[keep], merged[keep]
                if not len(row):
                    break
                width = max(int(lengths.max()), 2)
                tokens, rank = tokens[keep, :width], rank[keep, :width]
                at = np.arange(len(row))
            shift = np.arange(width - 1) > best[:, None]
            tokens[:, :-1] = np.where(shift, tokens[:, 1:], tokens[:, :-1])
            rank[:, :-1] = np.where(shift, rank[:, 1:], rank[:, :-1])
            tokens[at, best] = merged
            lengths -= 1
            tokens[at, lengths] = -1
            rank[at, lengths] = _NONE
            rank[at, lengths - 1] = _NONE
            # Only the pairs on both sides of the merged token are new.
            has = np.flatnonzero(best + 1 < lengths)
            rank[has, best[has]] = self.pairs.lookup(merged[has], tokens[has, best[has] + 1])
            has = np.flatnonzero(best > 0)
            rank[has, best[has] - 1] = self.pairs.lookup(tokens[has, best[has] - 1], merged[has])
        return out

    def _long(self, piece: bytes) -> bytes:
        """The same merges in the same order over a linked list, for one long piece."""
        ids = self.byte_rank[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, tokens = self.ranks, self.tokens

        def pair(i: int) -> int | None:
            return ranks.get(tokens[ids[i]] + tokens[ids[after[i]]]) if after[i] < n else None

        first = self.pairs.lookup(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            if ids[i] != left or after[i] >= n or ids[after[i]] != right:
                continue
            gone = after[i]
            ids[i], ids[gone], after[i] = rank, -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of pieces into the cache."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            elif len(raw) > self.matrix_bytes:
                self.cache[piece] = self._long(raw)
            else:
                buckets.setdefault((len(raw) + 3) // 4 * 4, []).append((piece, raw))
        for width, members in buckets.items():
            rows = max(1, (1 << 20) // width)
            for at in range(0, len(members), rows):
                part = members[at:at + rows]
                for (piece, _), ids in zip(part, self._matrix([raw for _, raw in part], width)):
                    self.cache[piece] = ids

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = [(self.pattern if self.wide.search(text) else self.narrow).findall(text)
                 for text in texts]
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        self.learn(set().union(*split).difference(self.cache))
        for pieces in split:
            yield np.frombuffer(b"".join(map(self.cache.__getitem__, pieces)), np.int32)

    @functools.cached_property
    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens' bytes in one array, with the start and length of each token."""
        top = max(self.tokens) + 1
        parts = [self.tokens.get(i, b"") for i in range(top)]
        length = np.array([len(p) for p in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(length) - length, length

    def decode(self, ids: np.ndarray) -> bytes:
        data, start, length = self.flat
        n = length[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b""
        return data[np.arange(ends[-1]) + np.repeat(start[ids] - ends + n, n)].tobytes()


@functools.cache
def codec(path: str, pattern: str) -> Bpe:
    """One per worker process."""
    return Bpe(path, pattern)


def _with(df: DataFrame, column: str, kind, function) -> DataFrame:
    schema = StructType([*(f for f in df.schema if f.name != column), StructField(column, kind)])
    return df.mapInArrow(function, schema)


def encode(df: DataFrame, text: str = "text", ids: str = "token_ids", *, path: str | None = None,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Replace column ``text`` by ``ids``, its token ids; null and empty texts have none."""
    path = path or public_tokenizers.path(RANKS)
    names = [c for c in df.columns if c != ids]

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, text):
                texts = [t or "" for t in part.column(text).to_pylist()]
                rows = list(bpe.encode(texts))
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
                flat = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.ListArray.from_arrays(offsets, flat)],
                    names=[*names, ids])

    return _with(df, ids, ArrayType(IntegerType(), False), run).drop(text)


def decode(df: DataFrame, ids: str = "token_ids", out: str = "decoded", *,
           path: str | None = None) -> DataFrame:
    """Add column ``out``, the bytes that ``ids`` stand for; null ids give none."""
    path = path or public_tokenizers.path(RANKS)
    names = [c for c in df.columns if c != out]

    def run(batches):
        bpe = codec(path, public_tokenizers.PATTERN)
        for batch in batches:
            lists = batch.column(ids).fill_null([])
            flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            texts = [bpe.decode(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(texts, pa.binary())], names=[*names, out])

    return _with(df, out, BinaryType(), run)


def digests(documents: DataFrame) -> DataFrame:
    """Per document the number of tokens, the digest of its ids and that of the decoded bytes.

    Null text counts as empty.  Rows that repeat are each encoded.
    """
    out = decode(encode(documents.select("doc_id", "text")))
    return out.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")).cast("binary"), 256)
        .alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
