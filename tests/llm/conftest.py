import random

import pytest

SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "id bigint, key string, score double, label int, size int, c string, at string, made string, rep string")


def document(doc_id, text, source="s"):
    return (doc_id, text, None, source, None if text is None else len(text), 5, "k", 0.1, 2, 3, None, "x", "m", "r")


def sentence(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(words))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with likely names."""
    base = sentence(1, 120)
    rows = [document(1, None), document(2, ""), document(3, " \n\t "), document(4, "word"),
            document(5, sentence(5, 40_000)), document(6, base), document(7, base),
            document(None, base), document(8, sentence(8, 60) + "\x00é日本🎉"), document(9, "x" * 50_000),
            document(10, base + " a.b@c.de 10.0.0.1 +1 (988) 555-2485 x 4041894974608795", None),
            document(11, sentence(8, 25)), document(11, sentence(8, 25))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (4, 0, 1), (6, 1, 0), (9, 0, 1), (None, 1, 1), (11, None, None), (6, 1, 0)],
        "doc_id bigint, quality int, toxic int")
