"""Near duplicates and repeated passages against brute force, and their odd cases."""

import random

import numpy as np

from tessera.llm import phrases, probminhash
from tests.llm.conftest import SCHEMA, document, sentence


def shingle_set(text):
    w = (text or "").split()
    if 0 < len(w) < 5:
        return {tuple(w)}
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute_classes(texts):
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: shingle_set(t) for i, t in texts.items()}
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_classes_equal_brute_force(spark):
    rng = random.Random(11)
    texts = {}
    for base in range(6):
        words = sentence(base, 150).split()
        for copy in range(25):  # groups in which some pairs reach 0.8 and some don't
            texts[len(texts)] = edited(words, rng, copy % 6)
    texts |= {len(texts) + i: sentence(1000 + i, 40) for i in range(30)}
    docs = spark.createDataFrame([document(i, t) for i, t in texts.items()], SCHEMA)
    want = brute_classes(texts)
    for pivots in (1, 4):
        got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs, pivots=pivots).collect()}
        assert got == want


def test_copies_that_repeat_a_passage_equal_brute_force(spark):
    rng = random.Random(12)
    texts = {}
    for base in range(40):
        words = sentence(3000 + base, 204).split()
        part = words[:(44, 64, 104)[base % 3]]
        texts[len(texts)] = " ".join(words)
        texts[len(texts)] = " ".join(words + part * (50, 20, 20)[base % 3])
        texts[len(texts)] = edited(words, rng, 3) + " " + " ".join(part * 9)
        texts[len(texts)] = edited(words, rng, 12) + " " + " ".join(part * 30)
    docs = spark.createDataFrame([document(i, t) for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs).collect()}
    assert got == brute_classes(texts)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate((a[:320], rng.integers(0, 2**63, 80).astype(np.uint64)))
    h, text = np.concatenate((a, b)), np.repeat([0, 1], 400)
    s = probminhash.signatures(h, np.ones(800), text, 2, 2048)
    assert abs((s[0] == s[1]).mean() - 320 / 480) < 0.05
    # Weights count: a shingle of half the mass has half the registers.
    s = probminhash.signatures(a[:2], np.array([3.0, 1.0]), np.zeros(2, np.int64), 1, 4096)
    assert abs((s[0] == a[0]).mean() - 0.75) < 0.04


def test_odd_documents(odd, none):
    got = sorted(((r.doc_id, r.class_id) for r in probminhash.near_duplicates(odd).collect()),
                 key=lambda r: r[0] or 0)
    # Row 10 is row 6 with a tail of eight words.
    assert got == [(None, None), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6), (8, 8), (9, 9),
                   (10, 6), (11, 11), (11, 11)]
    assert probminhash.near_duplicates(none).count() == 0


def brute_rest(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        w = (texts[i] or "").split()
        gone = set()
        for s in range(len(w) - 19):
            key = tuple(w[s:s + 20])
            if key in seen:
                gone.update(range(s, s + 20))
            seen.add(key)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def passages():
    rng = random.Random(3)
    shared = [sentence(500 + i, n) for i, n in enumerate((19, 20, 21, 60))]
    texts = {}
    for i in range(60):
        parts = [sentence(i, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), sentence(rng.randrange(10**6), rng.randint(0, 5))]
        texts[i] = " ".join(parts)
    texts[60] = "a " * 300
    texts[61] = "b c " * 200 + sentence(3, 40)
    texts[62], texts[63] = texts[5], texts[5]
    return texts


def test_rest_equals_brute_force_with_and_without_hot_anchors(spark, monkeypatch):
    texts = passages()
    docs = spark.createDataFrame([document(i, t) for i, t in texts.items()], SCHEMA)
    want = brute_rest(texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in phrases.remove_repeats(docs).collect()}
    assert got == want
    plain = phrases.covered_words
    monkeypatch.setattr(phrases, "covered_words", lambda *a, **k: plain(*a, **k, hot_contexts=2))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in phrases.remove_repeats(docs).collect()}
    assert got == want


def test_odd_passages(odd, none):
    rows = {r.doc_id: r for r in phrases.remove_repeats(odd).collect()}
    assert [(rows[i].n_words, rows[i].n_removed) for i in (1, 2, 3, 4)] == [(0, 0), (0, 0), (0, 0), (1, 0)]
    assert (rows[7].n_removed, rows[7].kept) == (120, "")
    assert rows[10].kept.startswith("a.b@c.de") and rows[None].n_removed == 0
    # A row that repeats an id is the same place; its words also start in row 8.
    assert rows[11].n_words == 25 and rows[11].n_removed == 25
    assert phrases.remove_repeats(none).count() == 0


def test_texts_of_one_id_lose_only_their_own_words(spark):
    shared, own, long = sentence(900, 30), sentence(901, 30), sentence(902, 90)
    rows = [(0, shared), (1, f"{own} {shared}"), (1, "ab cd ef gh"), (1, f"{long} {shared} {long}"), (2, own),
            (3, long), (3, long), (3, f"x {long}"), (None, shared), (4, None), (4, sentence(903, 25)), (4, sentence(903, 25))]
    docs = spark.createDataFrame([document(*r) for r in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in phrases.remove_repeats(docs).collect()), key=repr)
    # The second `long` of one text, and what an earlier id or an earlier start of the same id holds.
    assert got == sorted([(0, 30, 0), (1, 60, 30), (1, 4, 0), (1, 210, 120), (2, 30, 30), (3, 90, 90), (3, 90, 90), (3, 91, 90),
                          (None, 30, 0), (4, 0, 0), (4, 25, 0), (4, 25, 0)], key=repr)


def test_rows_of_one_id_keep_their_marks(spark):
    same, other = sentence(910, 60), sentence(911, 60)
    rows = [(0, same), (1, same), (1, other), (2, None), (None, same)]
    docs = spark.createDataFrame([(*r, r[1] or "") for r in rows], "doc_id int, text string, label string")
    got = {(r.doc_id, r.label[:20]): r.class_id for r in probminhash.near_duplicates(docs, mark="label").collect()}
    assert got == {(0, same[:20]): 0, (1, same[:20]): 0, (1, other[:20]): 1, (2, ""): 2, (None, same[:20]): None}
