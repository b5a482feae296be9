"""The stages on the odd rows, and the whole pipeline against a brute-force version."""

import corpus_pipeline
from tessera.llm import packing, pii, toxicity
from tessera.llm.common import table
from tests.llm.test_duplicates import brute_classes, brute_rest
from tests.llm.conftest import sentence
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_take_odd_rows(spark, odd, none, labels, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: labels)
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns
            assert (out.count() > 0) == (docs is odd)


def test_stages_take_columns_of_any_name(spark, labels, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: labels)
    names = ["n_words", "n_removed", "kept", "_id", "_mark", "mark", "_starts", "spans", "base", "redacted", "n_ip", "secrets",
             "toxicity", "made_x", "Kept2", "set1", "class_id", "size", "count", "h", "number"]
    text = sentence(1, 70)
    rows = [(0, text), (1, text), (1, sentence(2, 70)), (1, "short one"), (2, sentence(3, 70)), (2, sentence(3, 70)),
            (3, sentence(4, 40) + " mail a.b@c.de " + sentence(1, 30)), (None, text)]
    step = spark.createDataFrame([(i, t, *(f"{c} {k}" for c in names)) for k, (i, t) in enumerate(rows)],
                                 "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns, step = step.columns, stage(spark, step, SF)
        assert step.columns == columns, name
    got = sorted(((r.doc_id, r.text.split()[0], r.kept[:4]) for r in step.collect()), key=repr)
    # Of copies one stays, whether they repeat an id or not; other texts of an id stay.
    assert [g[:2] for g in got] == sorted([(0, rows[0][1].split()[0]), (1, rows[2][1].split()[0]), (1, "short"),
                                           (2, rows[4][1].split()[0]), (3, rows[6][1].split()[0]), (None, rows[0][1].split()[0])], key=repr)
    (mail,) = [r for r in step.collect() if r.doc_id == 3]
    assert "[EMAIL]" in mail.text and len(mail.text.split()) < 60 and mail.n_words == "n_words 6"


def test_stages_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] < 0.7}
    classes = brute_classes(texts)
    texts = {i: t for i, t in texts.items() if classes[i] == i}
    texts = {i: rest if gone else texts[i] for i, (_, gone, rest) in brute_rest(texts).items()}
    step = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        step = stage(spark, step, SF)
    assert {r.doc_id: r.text for r in step.collect()} == texts
    assert all(r.n_chars == len(r.text) for r in step.collect())
    cleaned = corpus_pipeline.redact_personal_data(spark, step, SF)
    for r in cleaned.collect():
        spans = pii.base_spans(texts[r.doc_id])
        assert not any(texts[r.doc_id][a:b] in r.text and b - a > 12 for _, a, b in spans)
        assert spans or r.text.count("[") >= texts[r.doc_id].count("[")
    rows = corpus_pipeline.run(spark, SF).collect()
    assert check_packing(rows, cleaned) <= packing.CAPACITY
