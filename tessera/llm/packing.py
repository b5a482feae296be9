"""Best-fit packing with certified bin counts (operator 5).

Documents become token pieces of at most ``capacity`` tokens.  Pieces are dealt to buckets by
hash and packed there by best-fit decreasing; dual feasible functions bound each bucket's bin
count from below.  In a bucket above its bound, bins exchange pieces: the emptiest and some others
are emptied and packed again, each bin with the set of pieces that fits it best, as long as bins
fall.  A bucket that meets its bound keeps its bins but for the emptiest; one with a gap also
gives up its emptiest bins.  What is given up is pooled over groups of buckets and packed again,
until one bucket is left.  ``certificates`` lists bins and bound of every bucket.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import narrow_pattern
from tessera.llm.common import materialize, slices

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
END = 0


class _Words(dict):
    """Ids of words as bytes, made where they are missing; two generations bound it.

    A full generation becomes the older one, from which words in use are taken over.
    """

    def __init__(self, encode: Callable[[str], bytes], size: int) -> None:
        super().__init__()
        self.encode, self.size = encode, size
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids


class WordTokenizer:
    """The tokenizer of a file, with the ids of words kept.

    Its normaliser and its splitting are repeated here for texts of plain Latin characters, on
    which they act alike in any Unicode version, and its model encodes each word; other texts go
    through the library whole.
    """

    def __init__(self, path: str, cache: int = 150_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as file:
            split = json.load(file)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = narrow_pattern(split)
        # Below U+0250 all is composed; U+0130 is left out because its lower case is not.
        self.plain = functools.partial(narrow_pattern(r"[\x09\x0a\x0d\x20-\x7e\xa1-įı-ɏ]*").fullmatch)
        self.model = self.full.model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words = _Words(self._word, cache)

    def _word(self, word: str) -> bytes:
        """Ids of a piece that the pattern made; the model knows bytes by characters of their own."""
        if not word.isascii():
            ((word, _),) = self.bytes.pre_tokenize_str(word)
        return array("I", [token.id for token in self.model.tokenize(word)]).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if self.plain(text):
                pieces = self.split.findall(text.lower())
                out.append(np.frombuffer(b"".join(map(self.words.__getitem__, pieces)), np.uint32))
            else:
                out.append(np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32))
        return out


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    return WordTokenizer(path)


def pieces(documents: DataFrame, id_column: str = "doc_id", text: str = "text", *,
           capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32); a null or empty text is its end id alone."""
    path = path or public_tokenizers.path(TOKENIZER)

    def run(batches):
        words = tokenizer(path)
        for batch in batches:
            for part in slices(batch, text):
                row, piece, start, length, crc = [], [], [], [], []
                encoded = words.encode([t or "" for t in part.column(text).to_pylist()])
                for i, ids in enumerate(encoded):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        cut = ids[at:at + capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_column).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=[id_column, "piece", "start", "length", "ids_crc32"])

    source = documents.select(id_column, text)
    kind = source.schema[id_column].dataType.simpleString()
    return source.mapInArrow(
        run, f"`{id_column}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and how full each bin is."""
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have left
    open_rooms = 0  # bit r: a bin with room r is there
    fills: list[int] = []
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = open_rooms >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            r, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = r - size
        if left:
            room[left].append(b)
            open_rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def bin_bound(lengths: np.ndarray, capacity: int, top: int = 24) -> int:
    """Lower bound on the bins any packing needs, by dual feasible functions.

    The rounding functions u(k) for k up to ``top`` and, for every threshold t up to half the
    capacity, the function that counts items over capacity - t as whole bins and drops those
    under t; all in integers.
    """
    return count_bound(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity, top) if len(lengths) else 0


def count_bound(count: np.ndarray, capacity: int, top: int = 24) -> int:
    """The same from the number of items of each length."""
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(count @ size) // capacity)
    for k in range(1, top + 1):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int(count @ value) // (capacity * k)))
    items, mass = np.cumsum(count), np.cumsum(count * size)
    t = np.arange(1, capacity // 2 + 1)
    large = items[-1] - items[capacity - t]
    middle = mass[capacity - t] - mass[t - 1]
    return max(best, int((large + -(-middle // capacity)).max()))


def fill_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``best_fit_decreasing``, but the fit is of sets: each bin takes the largest item left and those
    of the others that together fill its room best.

    Sums that sets of items reach are the bits of one number, kept after each item that was added.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    of_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in order.tolist():
        of_size[lengths[i]].append(i)
    sizes = sorted({int(v) for v in lengths}, reverse=True)
    fills: list[int] = []
    while sizes:
        taken, room = [sizes[0]], capacity - sizes[0]
        mask, sums, added = (1 << room + 1) - 1, [1], []
        first = True
        for size in sizes:
            copies = len(of_size[size]) - first
            first = False
            if size > room:
                continue
            for _ in range(min(copies, room // size)):
                more = sums[-1] | sums[-1] << size & mask
                if more == sums[-1]:
                    break
                sums.append(more)
                added.append(size)
            if sums[-1] >> room & 1:
                break
        best, k = sums[-1].bit_length() - 1, len(added)
        while best:
            # The item at k is needed where the sum was out of reach before it.
            if not sums[k - 1] >> best & 1:
                taken.append(added[k - 1])
                best -= added[k - 1]
            k -= 1
        fill = 0
        for size in taken:
            i = of_size[size].pop()
            bins[i], offsets[i] = len(fills), fill
            fill += size
        fills.append(fill)
        sizes = [v for v in sizes if of_size[v]]
    return bins, offsets, np.array(fills, np.int64)


def exchanged(lengths: np.ndarray, bins: np.ndarray, offsets: np.ndarray, fills: np.ndarray, bound: int,
              capacity: int, tries: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Let the emptiest bins and others drawn at random exchange their items, packed again by both ways
    of best fit, until the bound is met or ``tries`` draws in a row save no bin."""
    rng, failed, part = np.random.default_rng(11), 0, 1.0
    while len(fills) > bound and failed < tries:
        # All bins first; then the emptiest, and as many others.
        number = max(64, 8 * (len(fills) - bound))
        chosen = np.ones(len(fills), bool)
        if part < 1:
            chosen[:] = False
            chosen[np.argsort(fills, kind="stable")[:number]] = True
            chosen[rng.permutation(len(fills))[:number]] = True
        items = np.flatnonzero(chosen[bins])
        packed = min((way(lengths[items], capacity) for way in (best_fit_decreasing, fill_decreasing)),
                     key=lambda p: len(p[2]))
        saved = int(chosen.sum()) - len(packed[2])
        failed, part = 0 if saved > 0 else failed + 1, 0.5
        if saved > 0:
            kept = np.flatnonzero(~chosen)
            renamed = np.zeros(len(fills), np.int64)
            renamed[kept] = np.arange(len(kept))
            bins, offsets = renamed[bins], offsets.copy()
            bins[items], offsets[items] = packed[0] + len(kept), packed[1]
            fills = np.concatenate((fills[kept], packed[2]))
    return bins, offsets, fills


def pack_bucket(lengths: np.ndarray, capacity: int, last: bool):
    """Bin, offset and whether the item is given up for another round; bins and their bound."""
    bins, offsets, fills = best_fit_decreasing(lengths, capacity)
    bound = bin_bound(lengths, capacity)
    bins, offsets, fills = exchanged(lengths, bins, offsets, fills, bound, capacity)
    give = np.zeros(len(fills), bool)
    if not last and len(fills):
        gap = len(fills) - bound
        number = 1 if not gap else min(len(fills), max(8 * gap, len(fills) // 20))
        emptiest = np.argsort(fills, kind="stable")[:number]
        give[emptiest[fills[emptiest] < capacity]] = True
    return bins, offsets, give[bins], len(fills), bound


def _packer(id_column: str, capacity: int, turn: int, last: bool):
    names = [id_column, "piece", "start", "length", "ids_crc32"]

    def run(key, table):
        table = table.select(names).sort_by([(c, "ascending") for c in names])
        bins, offsets, give, number, bound = pack_bucket(table.column("length").to_numpy(), capacity, last)
        bins += (turn << 56) + (key[0].as_py() << 28)
        told = [pa.array(np.full(len(bins), v, np.int64)) for v in (turn, key[0].as_py(), number, bound)]
        return pa.Table.from_arrays(
            [*table.columns, pa.array(bins), pa.array(offsets), pa.array(give), *told],
            names=[*names, "sequence_id", "offset", "again", "turn", "bucket", "bins", "bound"])

    return run


def _rounds(items: DataFrame, id_column: str, capacity: int, bucket_rows: int, merge: int) -> list[DataFrame]:
    """Packed pieces of every round."""
    items = items.select(id_column, "piece", "start", "length", "ids_crc32")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    kinds += (", sequence_id bigint, offset bigint, again boolean, turn bigint, bucket bigint, bins bigint, bound bigint")
    buckets = -(-items.count() // bucket_rows) or 1
    done: list[DataFrame] = []
    while not done or buckets:
        turn, last = len(done), buckets == 1
        bucket = F.pmod(F.xxhash64(id_column, "piece", F.lit(turn)), F.lit(buckets)).cast("int")
        packed = materialize(items.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(
            _packer(id_column, capacity, turn, last), kinds))
        done.append(packed)
        items = packed.filter("again").select(*items.columns)
        buckets = 0 if last else -(-buckets // merge)
    return done


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, parts)


def _places(rounds: list[DataFrame]) -> DataFrame:
    return _union([r.filter("NOT again") for r in rounds]).drop("again", "turn", "bucket", "bins", "bound")


def _certificates(rounds: list[DataFrame]) -> DataFrame:
    return _union([r.groupBy("turn", "bucket").agg(
        F.count("*").alias("pieces"), F.max("bins").alias("bins"), F.max("bound").alias("bound"),
        F.count_if("again").alias("given_up")) for r in rounds])


def pack(items: DataFrame, *, id_column: str = "doc_id", capacity: int = CAPACITY,
         bucket_rows: int = 50_000, merge: int = 16) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``."""
    return _places(_rounds(items, id_column, capacity, bucket_rows, merge))


def pack_certified(items: DataFrame, *, id_column: str = "doc_id", capacity: int = CAPACITY,
                   bucket_rows: int = 50_000, merge: int = 16) -> tuple[DataFrame, DataFrame]:
    """What ``pack`` returns, and rows (turn, bucket, pieces, bins, bound, given_up): the bins of every
    bucket, fewer than ``bound`` of which no packing has, and the pieces that it gave up."""
    rounds = _rounds(items, id_column, capacity, bucket_rows, merge)
    return _places(rounds), _certificates(rounds)


def least_sequences(items: DataFrame, capacity: int = CAPACITY) -> int:
    """Bound on the sequences of all pieces together; only the count of each length is collected."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r.length] = r.n
    return count_bound(counts, capacity)


def pack_documents(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their places; repeated rows are packed each."""
    return pack(materialize(pieces(documents, id_column, text)), id_column=id_column)
