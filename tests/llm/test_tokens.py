"""Byte-level BPE and packing against the libraries, and the odd cases of both."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from tessera.llm import bpe, packing
from tests.llm.conftest import SCHEMA, document, sentence


def reference():
    with open(P.path(bpe.RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library():
    rng = random.Random(3)
    texts = ["", "a" * 3000, "  \n\n\t x", "日本語テキスト" * 50, "🎉🎊" * 200, "<|endoftext|>",
             "".join(map(chr, range(0x250))), "a\x1c b\x1d\x85 \xa0 c 　d \x1f", " " * 700 + "x",
             "".join(rng.choice("abcdeth ing\n'!1éÀß") for _ in range(5000)), "thequickbrown" * 100]
    codec, want = bpe.codec(P.path(bpe.RANKS), P.PATTERN), reference()
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids.tolist() == want.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_cache_is_bounded():
    codec = bpe.Bpe(P.path(bpe.RANKS), P.PATTERN, cache=50)
    for seed in range(5):
        list(codec.encode([sentence(seed, 100)]))
    assert len(codec.cache) <= 200


def test_odd_documents(odd, none):
    want = reference()
    rows = bpe.digests(odd).collect()
    assert len(rows) == odd.count() and bpe.digests(none).count() == 0
    texts = sorted(((r.doc_id or 0, r.text or "") for r in odd.collect()))
    for r, (_, text) in zip(sorted(rows, key=lambda r: (r.doc_id or 0)), texts):
        ids = want.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def tokens(text):
    full = Tokenizer.from_file(P.path(packing.TOKENIZER))
    full.encode_special_tokens = True
    return [*full.encode(text or "", add_special_tokens=False).ids, 0]


def test_words_equal_the_library():
    texts = ["Don't 'S x's!'s <|endoftext|> ÇéI İ", "日本 Ünï 123.4", "[it's]'ll''re--x\n\t!'d",
             "".join(map(chr, range(1, 0x24F))), "ﬁ é Σας ΌΣ", "a\x85b\x1cc", sentence(4, 300)]
    own = packing.tokenizer(P.path(packing.TOKENIZER))
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == tokens(text)[:-1]


def check_packing(rows, documents):
    """Every piece once, whole, gapless in sequences of at most 2048; the bound is nearly met."""
    want = []
    for r in documents.collect():
        ids = tokens(r.text)
        want += [(r.doc_id or -1, k, at, len(ids[at:at + 2048]),
                  zlib.crc32(np.array(ids[at:at + 2048], "<u4").tobytes()))
                 for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


def test_packing_odd_documents(odd, none):
    check_packing(packing.pack_documents(odd).collect(), odd)
    assert packing.pack_documents(none).count() == 0


def test_exchange_between_buckets(spark):
    documents = spark.createDataFrame([document(i, sentence(i, 20 + i % 90)) for i in range(300)], SCHEMA)
    rows = packing.pack(packing.pieces(documents), bucket_rows=20, merge=4).collect()
    used = check_packing(rows, documents)
    assert used <= packing.bin_bound(np.array([r.length for r in rows]), 2048) + 2


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for low, high in ((1, 2048), (600, 1100), (1000, 1100), (1, 50)):
        lengths = rng.integers(low, high + 1, 400)
        bins, offsets, fills = packing.best_fit_decreasing(lengths, 2048)
        assert fills.max() <= 2048 and np.bincount(bins, lengths).tolist() == fills.tolist()
        assert -(-lengths.sum() // 2048) <= packing.bin_bound(lengths, 2048) <= len(fills)
    assert packing.bin_bound(np.array([1100] * 9), 2048) == 9
    assert packing.bin_bound(np.zeros(0, np.int64), 2048) == 0


def test_a_gap_falls_in_one_bucket_and_bounds_are_told(spark):
    rng = np.random.default_rng(1)
    lengths = rng.integers(300, 760, 3_000)
    plain, bound = len(packing.best_fit_decreasing(lengths, 2048)[2]), packing.bin_bound(lengths, 2048)
    items = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)],
                                  "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    places, told = packing.pack_certified(items)
    rows, (told,) = places.toPandas(), told.collect()
    assert bound <= told.bins < bound + (plain - bound) / 3 and told.bins == rows["sequence_id"].nunique()
    assert (told.bound, told.pieces, told.given_up) == (bound, 3_000, 0) and packing.least_sequences(items) == bound
    for _, one in rows.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert one["length"].sum() <= 2048 and (one["offset"] == one["length"].cumsum() - one["length"]).all()
    places, told = packing.pack_certified(items, bucket_rows=200, merge=4)
    assert places.count() == 3_000 and all(r.bound <= r.bins for r in told.collect())
    assert {r.turn for r in told.collect()} == {0, 1, 2} and places.select("sequence_id").distinct().count() < plain


def test_sets_fill_bins_exactly():
    rng = np.random.default_rng(2)
    for lengths in (np.array([5, 5, 5, 3, 2]), np.array([7]), np.zeros(0, np.int64), rng.integers(1, 11, 200), np.full(9, 4)):
        bins, offsets, fills = packing.fill_decreasing(lengths, 10)
        assert (np.bincount(bins, lengths, len(fills)) == fills).all() and (fills <= 10).all()
        for b in range(len(fills)):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offsets[own])]
            assert (offsets[own] == np.cumsum(lengths[own]) - lengths[own]).all()
    assert len(packing.fill_decreasing(np.array([6, 5, 5, 4, 3, 3, 2, 2]), 10)[2]) == 3


def test_words_survive_the_change_of_generations():
    small = packing.WordTokenizer(packing.public_tokenizers.path(packing.TOKENIZER), cache=20)
    large = packing.WordTokenizer(packing.public_tokenizers.path(packing.TOKENIZER))
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(80)]
    for _ in range(40):
        texts = [" ".join(rng.choices(words, k=15)) for _ in range(4)]
        for a, b in zip(small.encode(texts), large.encode(texts)):
            assert a.tolist() == b.tolist()
    assert len(small.words) <= 20 and len(small.words.older) == 20
