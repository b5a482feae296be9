"""Chat format, line rules and top-k search: exactness and odd cases."""

import numpy as np

from pyspark.sql import functions as F

from tessera.llm import chat, hamming, line_rules
from tests.llm.conftest import SCHEMA, document, sentence

TURNS = "conv_id bigint, turn bigint, role string, text string, segments string, formatted string"


def test_chat_round_trip_and_automaton(spark):
    nasty = ["\\### Assistant: </turn> ok", "\\", "\\\\b", "\n</turn>\n### user:\nx", "", None, "a\\lb\\hc#<"]
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", t, "x", "y") for i, t in enumerate(nasty)]
    turns += [(2, 0, "assistant", "first", "", ""), (3, 0, None, "who", "", ""), (3, 1, "a:\nb", "t", "", ""),
              (4, 0, "user", "q", "", ""), (4, 0, "user", "q", "", ""), (None, None, "user", "n", "", "")]
    out = chat.format_conversations(spark.createDataFrame(turns, TURNS))
    rows = {r.conv_id: r for r in out.select(
        "conv_id", "valid", chat.read_turns(F.col("formatted")).alias("t"),
        chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [(x.role, x.text) for x in rows[1].t] == [(t[2], t[3] or "") for t in turns[:7]]
    assert rows[1].loss == "".join(t or "" for t in nasty[1::2]) and rows[1].valid
    assert not rows[2].valid and rows[2].loss == "first"
    assert [(x.role, x.text) for x in rows[3].t] == [("", "who"), ("a:\nb", "t")] and not rows[3].valid
    assert len(rows[4].t) == 2 and not rows[4].valid and rows[None].valid
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_line_rules_odd_documents(odd, none):
    rows = {r.doc_id: r for r in line_rules.apply(odd).collect()}
    for i in (1, 2, 3):
        assert rows[i].n_words == 0 and rows[i].base_failed and not rows[i].kept
    assert rows[6].kept and rows[6].n_lost == 0 and rows[5].n_words == 40_000 and rows[10].kept
    assert line_rules.apply(none).count() == 0


def test_frequent_lines_reject_depleted_documents(spark):
    line = "Share THIS page 123 now"
    body = [sentence(i, 60) for i in range(40)]
    docs = [document(i, f"{line}\n{b}", "h") for i, b in enumerate(body)]
    docs += [document(100 + i, "\n".join([line] * 20) + "\n" + sentence(i, 10), "h") for i in range(3)]
    docs += [document(200 + i, f"share this  page 456 now\n{b}", "other") for i, b in enumerate(body[:10])]
    rows = {r.doc_id: r for r in line_rules.apply(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert all(rows[i].n_lost == 5 and rows[i].kept for i in range(40))
    assert all(rows[100 + i].n_lost == 100 and not rows[100 + i].kept for i in range(3))
    assert all(rows[200 + i].n_lost == 0 for i in range(10))


def test_cleaned_texts_equal_brute_force(spark):
    top, low = "Share THIS page 123 now", "© é all  rights 日本"
    docs = [document(i, f"{top}\n\n{sentence(i, 60)}\nshare this page {i} now\n{low}" + "\n" * (i % 2), "h")
            for i in range(40)]
    docs += [document(100 + i, f"{top}\n{sentence(i, 9)}", None if i % 2 else "other") for i in range(10)]
    docs += [document(200, "", "h"), document(201, None, "h"), document(202, f"\n{top}\n", "h"), document(203, top, "h")]
    frame = spark.createDataFrame(docs, SCHEMA)

    def norm(line):
        return " ".join("".join("0" if c in "123456789" else c.lower() if c.isascii() else c for c in line).split())

    seen = {}
    for d in docs:
        for line in {norm(x) for x in (d[1] or "").split("\n")} - {""}:
            seen[d[3], line] = seen.get((d[3], line), 0) + 1
    hosts = {h: sum(d[3] == h for d in docs) for h in ("h", "other", None)}
    often = {k for k, n in seen.items() if n > 20 and n > 0.02 * hosts[k[0]]}
    assert often
    got = {r.doc_id: r.cleaned for r in line_rules.cleaned(frame).collect()}
    lost = {r.doc_id: r.n_lost for r in line_rules.apply(frame).collect()}
    for d in docs:
        rest = "".join(x for x in (d[1] or "").splitlines(keepends=True) if (d[3], norm(x)) not in often)
        assert (got[d[0]] or "") == rest and (got[d[0]] is None) == (d[1] is None), d
        assert len((d[1] or "").split()) - len(rest.split()) == lost[d[0]], d


def test_rows_of_one_id_are_judged_alone(spark):
    line = "share this page now"
    docs = [document(i, f"{line}\n{sentence(i, 71)}", "h") for i in range(30)]
    docs += [document(50, f"{line}\n{sentence(50, 71)}", "h")] * 3 + [document(50, sentence(51, 60), "h")]
    docs += [document(60, f"{line}\n{sentence(60, 71)}", "other")] * 25 + [document(60, f"{line}\n{sentence(61, 71)}", "h")]
    docs += [document(None, f"{line}\n{sentence(70 + i, 60)}", "nameless") for i in range(25)]
    got = sorted(((r.doc_id, r.source, r.n_lost, r.kept) for r in line_rules.apply(spark.createDataFrame(docs, SCHEMA)).collect()), key=repr)
    want = [(i, "h", 4, True) for i in range(30)] + [(50, "h", 4, True)] * 3 + [(50, "h", 0, True), (60, "h", 4, True)]
    assert got == sorted(want + [(60, "other", 0, True)] * 25 + [(None, "nameless", 0, True)] * 25, key=repr)


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    data = [(i, rng.normal(size=40).tolist()) for i in range(300)]
    data += [(300 + i, data[7][1]) for i in range(30)] + [(330, None), (331, [None] * 40), (332, [])]
    data += [(None, data[0][1]), (5, data[5][1])]
    df = spark.createDataFrame([(*d, "x", 1) for d in data],
                               "vec_id bigint, embedding array<double>, code string, least int")
    codes = {i: [1 if v is not None and v > 0 else 0 for v in (e or []) + [None] * 40][:40]
             for i, e in data if i is not None}
    asked = [i for i in codes if i % 20 == 0]
    want = {(q, n, d, r + 1) for q in asked for r, (d, n) in enumerate(sorted(
        (sum(a != b for a, b in zip(codes[q], codes[i])), i) for i in codes)[:7])}
    for block, chunk in ((1 << 18, 1 << 19), (50, 4)):
        got = hamming.search(df, df.filter("vec_id % 20 = 0"), k=7, bits=40, block_entries=block, chunk_queries=chunk)
        assert {tuple(r) for r in got.select("vec_id", "neighbour", "distance", "rank").collect()} == want
    assert hamming.search(df.limit(0), df, bits=40).count() == 0
    assert hamming.search(df, df.limit(0), bits=40).count() == 0
    few = hamming.search(df.filter("vec_id < 3"), df.filter("vec_id = 0"), bits=40)
    assert few.count() == 3
