"""Learnt operators: accuracy on rows held out, exact parts against brute force, odd cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import pii, rule_ensemble, toxicity, trees
from tessera.llm.common import least_by_hash, table

SF = "/root/testdata/sf0.01"


def held_accuracy(spark, classified, label):
    known = table(spark, SF, "labels")
    held = classified.join(known, "doc_id").filter("held_out").toPandas()
    assert len(held) > 50 and held["score"].between(0, 1).all()
    return (held["predicted"] == held[label]).mean()


def test_quality_of_held_out_rows(spark):
    out = rule_ensemble.classify(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert held_accuracy(spark, out, "quality") > 0.97
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_toxicity_of_held_out_rows(spark):
    out = toxicity.classify(table(spark, SF, "documents"), table(spark, SF, "labels"))
    assert held_accuracy(spark, out, "toxic") > 0.93


@pytest.mark.parametrize("classify", [rule_ensemble.classify, toxicity.classify])
def test_odd_rows_and_few_labels(odd, none, labels, classify):
    rows = classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out is False for r in rows if r.doc_id is None)
    assert classify(none, labels).count() == 0
    assert classify(odd, labels.limit(0)).count() == odd.count()


def test_rules_compile_to_the_same_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.random((500, 2))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    model = rule_ensemble.fit(x, y, ["a", "b"])
    df = spark.createDataFrame(x.tolist(), "a double, b double").select(model.score().alias("p"))
    assert ((df.toPandas()["p"] > 0.5) == (y > 0)).mean() > 0.97 and len(model.rules) < 60


def test_grammar_composes_scopes():
    found = toxicity.Scorer((("idio", 3.0), ("idiol$", -1.0)))
    one = {p: found.weights(t) for p, t in {
        "plain": "what idiots there.", "target": "you idiot", "negated": "he is not an idiot",
        "reported": "she said the idiot left", "threat": "I will hurt you. you will die, kill",
        "whole": "an idiol here", "inside": "xidiot"}.items()}
    assert set(one["plain"]) == {"insult"} and set(one["target"]) == {"insult_target"}
    assert set(one["negated"]) == {"insult_negated"} and set(one["reported"]) == {"insult_reported"}
    assert "threat_other" in one["threat"] and "threat_target" in one["threat"]
    assert not one["whole"] and not one["inside"]


@pytest.mark.parametrize("text, threat", [
    ("I will kill you", True), ("we'll hurt your family", True), ("ich werde dich töten", True), ("ich töte dich", True),
    ("töte dich", True), ("te voy a matar", True), ("voy a matarte mañana", True), ("yo mataré a usted", True),
    ("je vais te tuer", True), ("je te tuerai", True), ("nous allons vous tuer", True),
    ("you kill me", False), ("I will not kill you", False), ("he said I kill you", False), ("frost may kill your plants", False),
    ("I will kill. you wait", False), ("ich werde dich nie töten", False), ("the war will destroy towns", False)])
def test_threats_have_a_first_person_and_a_target_on_either_side(text, threat):
    scorer = toxicity.Scorer((("idio", 3.0),))
    assert ("threat_target" in scorer.weights(text)) == threat
    weights = toxicity.ToxicityModel((("idio", 3.0),), tuple(toxicity._prior())).weights
    score = float(trees.sigmoid(np.dot(scorer.features(text), weights[:-1]) + weights[-1]))
    assert (score > 0.7) == threat


def test_stems_branch():
    known = {"los": 12, "lose": 12, "loser": 12, "low": 40, "lowe": 40, "lowea": 9, "loweb": 9, "lowec": 9}
    assert toxicity.choose_stems(known) == ["loser", "lowe"]


def brute_base(text):
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
             "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
             "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, s):
        digits = re.sub(r"\D", "", s)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")),
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    return pii.ordered([(k, *m.span()) for k, f in forms.items() for m in re.finditer(f, text) if good(k, m.group())])


def test_base_spans_equal_plain_patterns():
    rng = np.random.default_rng(4)
    alphabet = list("ab@..--__ 0123456789+()é%") + ["10.0.0.1", "a@b.c", "4041894974608795", "+1 (988) 555-2485"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert pii.base_spans(text) == brute_base(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1.2." * 80_000, "a@" * 100_000, "+1 " * 100_000):
        assert isinstance(pii.base_spans(text), list)


def test_candidates_add_and_base_stays(odd, none, spark):
    model = pii.train(table(spark, SF, "documents"))
    assert any(t < 1.5 for t in model.thresholds)
    rows = {r.doc_id: r for r in pii.find(odd, model, redact=True).collect()}
    assert (rows[10].n_email, rows[10].n_ip, rows[10].n_card, rows[10].n_phone) == (1, 1, 1, 1)
    assert set(rows[10].base.split(",")) <= set(rows[10].spans.split(","))
    assert rows[10].redacted.endswith("[EMAIL] [IP] [PHONE] x [CARD]")
    assert rows[1].spans == "" and rows[1].redacted is None and rows[2].redacted == ""
    assert pii.find(none, pii.train(none)).count() == 0


def test_every_border_of_groups_is_proposed():
    card = "4111 1111 1111 1111"
    for text in (f"card {card} 12/27", f"order 20 {card} paid", f"see 1.5 {card}, 7", card):
        a = text.index(card)
        assert ("card", a, a + len(card)) in pii.candidates(text), text
    assert ("ip", 6, 20) in pii.candidates("256[.]10[.]0[.]0[.]1")
    assert len(pii.candidates("1 " * 20_000)) < 20 * 20_000


def test_altered_forms_are_added(spark):
    model = pii.train(table(spark, SF, "documents"))
    assert all(t < 1.5 for t in model.thresholds), model.thresholds
    for kind, before, value, after in (
            ("card", "card ", "4111 1111 1111 1111", " 12/27"), ("card", "order 20 ", "4111 1111 1111 1111", " paid"),
            ("card", "paid by ", "4041.8949.7460.8795", " today"), ("email", "write to ", "jane [at] host [dot] org", " or"),
            ("ip", "host ", "10[.]20[.]30[.]40", " is down"), ("phone", "call ", "0049 (988) 555-2485", " today")):
        text = before + value + after
        base, spans = model.spans(text)
        assert not base and (kind, len(before), len(before) + len(value)) in spans, (text, spans)
    for text in ("in 2019 and 2020 we sold 300.1.2 of 12", "look at me. Then go", "a b c 1 2 3", "no 5731080387325255"):
        assert model.spans(text) == ([], []), text


def test_decoys_are_left_alone(spark):
    model = pii.train(table(spark, SF, "documents"))
    assert all(t >= pii.FLOOR for t in model.thresholds) and all(p >= 0.97 for p, _ in model.measured), model.measured
    for text in ("order number 12345678 shipped", "ISBN 978 3 16 148410 0 is a book", "pop. 1234567890 people",
                 "version 10 . 20 . 30 . 40", "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962 fixed it", "on 2020-12-31 we left"):
        assert model.spans(text) == ([], []), text
    text = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and'
    assert model.spans(text) == ([], [("secret", 9, 49)])


def test_whole_names_and_hosts_are_proposed():
    name, host = "n" * 70, " dot ".join(["part"] * 30)
    text = f"write {name} at {host} now"
    assert ("email", 6, len(text) - 4) in pii.candidates(text)
    for text in ("a at b" + " dot c" * 30_000, ("x" * 50 + " [at] b.c ") * 5_000, "k9" * 100_000):
        assert len(pii.candidates(text)) < len(text)


def test_values_are_put_anywhere_in_a_text():
    text = "word " * 100_000
    spans = [c for c in range(40) for x, truth, _ in pii.examples(text, str(c), 16) if truth]
    assert len(set(spans)) == 40


def test_samples_are_bounded_before_the_last_task(spark):
    ids = spark.range(200_000, numPartitions=8).withColumnRenamed("id", "doc_id")
    rows = least_by_hash(ids, "doc_id", 500)
    assert rows.count() == 500 and rows.distinct().count() == 500
    want = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(500).collect()
    assert sorted(rows.collect()) == sorted(want)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (xxhash64" in plan
    assert least_by_hash(ids.limit(0), "doc_id", 5).count() == 0 and least_by_hash(ids.limit(7), "doc_id", 5).count() == 5


def test_several_labels_of_one_id(spark, odd):
    labels = spark.createDataFrame([(6, 1), (6, 0), (6, 1), (4, 1)], "doc_id bigint, quality int")
    assert {(r.doc_id, r.label) for r in rule_ensemble.labelled_sample(odd, labels, "quality").collect()} == {(6, 0), (4, 1)}


def test_trees_and_lasso():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = (x[:, 0] * x[:, 1] > 0.3).astype(float)
    model = trees.boost(x[:600], y[:600])
    assert ((trees.predict(model, x[600:]) > 0.5) == y[600:]).mean() > 0.93
    _, w = trees.lasso_logistic(np.stack((y, rng.random(800)), axis=1), y, 1e-2)
    assert w[0] > 1 and abs(w[1]) < 0.5
