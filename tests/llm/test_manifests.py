"""URL rules, Merkle manifests and prefix tries against brute force, and their odd cases."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle, prefix_trie, url_rules
from tessera.llm.common import own_folder, shared_folder
from tests.llm.conftest import SCHEMA, document

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def brute_judge(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules
           if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def urls():
    rng = random.Random(4)
    out = [None, "", "no scheme/org/", "://", "x://org", "x://ORG/", "http://a.b.example.ORG/es/?q#f", "http://éÉ.org/ü",
           "http://example.org/en/1", "http://notexample.org/es/", "http:///es/", "http://.org/", "http://org./x",
           "a://b.com/de/://c.org/", "http://h.com?/de/", "http://x.org/" + "y" * 100_000, "http://" + "a." * 5_000 + "com/fr/1"]
    hosts = ["example.org", "www.example.org", "com", "a.com", "net", "org", "co.uk"]
    return out + [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/es/', '/en/1', '/en/2', '/fr/', '/de/x', '/d'])}" for _ in range(150)]


@pytest.mark.parametrize("digits", [8, 1])
def test_urls_equal_brute_force(spark, digits):
    rules = RULES + [("block", "", "/"), ("block", None, "/"), (None, "net", "/"), ("block", "UK", None), ("allow", "co.uk", "/"),
                     ("allow", "com", "/de/"), ("block", "com", "/de/")]
    all_urls = urls() * 2
    pages = spark.createDataFrame([(i // 2 if i < 9 else None if i < 12 else i, u, "h", "p", "r") for i, u in enumerate(all_urls)],
                                  "page_id bigint, url string, host string, path string, rule string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    out = url_rules.judge(pages, table, prefix_digits=digits)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    plain = [(v, h.lower(), p or "") for v, h, p in rules if h and v and (v, h, p) != ("allow", "com", "/de/")]
    want = [(i // 2 if i < 9 else None if i < 12 else i, *brute_judge(u, plain)) for i, u in enumerate(all_urls)]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
    assert url_rules.judge(pages.limit(0), table).count() == 0
    assert {r.verdict for r in url_rules.judge(pages, table.limit(0)).collect()} == {"allow"}


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, fan):
    """(id, leaf, subroot, root, proof, folded) of rows (id, source, lang, n_chars, text)."""

    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return h(*(part(v) for v in (r[0], r[1], r[2], r[3], text)))

    def climb(digests):
        proofs, at = [[] for _ in digests], list(range(len(digests)))
        while len(digests) > 1:
            for k, i in enumerate(at):
                run = range(i - i % fan, min(i - i % fan + fan, len(digests)))
                proofs[k].append(([digests[j] for j in run if j < i], [digests[j] for j in run if j > i]))
                at[k] = i // fan
            digests = [h(*digests[j:j + fan]) for j in range(0, len(digests), fan)]
        return digests[0], proofs

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = [climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names]
    root, tops = climb([s[0] for s in subs])
    out = []
    for name, (sub, proofs), top in zip(names, subs, tops):
        for (_, _, digest, r), proof in zip(sorted(groups[name], key=lambda x: x[:3]), proofs):
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if c.isascii() else c for c in text)
            folded = leaf(r, text)
            for left, right in proof + top:
                folded = h(*left, folded, *right)
            out.append((r[0], digest, sub, root, h(*(d for a, b in proof + top for d in a + b)), folded, folded == root))
    return out


def manifest_rows():
    rng = random.Random(9)
    langs = [None, "", "de", "é", "z"]
    rows = [(i, f"s{i}", langs[0 if i < 700 else rng.randrange(5)], i % 7 or None, f"Text {i} É") for i in range(1_300)]
    rows += [(5, "a", "de", 1, None), (5, "a", "de", 1, ""), (5, "b", "de", 1, "X"), (None, None, "only", None, "x" * 200_000)]
    return rows + [(8, "same", "z", 4, "Same A")] * 40 + [(None, None, None, None, None)] * 3


def test_manifest_equals_brute_force(spark):
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, "x", b"y", "p", 7) for r in rows],
                                 "doc_id bigint, source string, lang string, n_chars bigint, text string, "
                                 "leaf string, digest binary, part string, i int")
    got = merkle.verified(docs)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_manifest(rows, 8)))
    # Other trees: blocks of one level, and many groups.
    out = merkle.manifest(docs.filter("source <> 'same'"), fan=3, block_levels=1, claimed={
        "text": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.lowered(F.col("text"))).otherwise(F.col("text"))})
    kept = [r for r in rows if r[1] not in (None, "same")]
    want = {(r[0], r[1], r[5]) for r in brute_manifest(kept, 3)}
    assert {(r.doc_id, r.leaf.hex(), r.folded.hex()) for r in out.collect()} == want
    many = [(i, "s", f"g{i % 90}", 1, "T") for i in range(300)]
    got = merkle.verified(spark.createDataFrame(many, "doc_id int, source string, lang string, n_chars int, text string"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_manifest(many, 8)))


def test_manifest_odd_tables(spark, odd, none):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    got = [tuple(r) for r in merkle.verified(odd).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_manifest(rows, 8)))
    assert merkle.verified(none).count() == 0 and merkle.verified(none).columns == merkle.verified(odd).columns
    one = spark.createDataFrame([document(3, "a")], SCHEMA)
    (r,) = merkle.verified(one).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == h("")


def brute_trie(turns):
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    def key(t):
        return hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()

    own = {c: [t[2:] for t in sorted(v, key=lambda t: (*t[:2], key(t)))] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        n = zlib.crc32(str(c).encode()) % 9
        source = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        full[c] = own.get(source, [])[:n] + v[n:]
    nodes = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)

    out = []
    for p in sorted(nodes, key=len, reverse=True):
        below = [x for x in nodes if x[:len(p)] == p]
        ends = ",".join(str(c) for c in sorted(nodes[p]) if tuple(full[c]) == p)
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(children.get(p, [])),
                    sum(x not in children for x in below),
                    sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in below if x), h(ends)))
    return out


def talks():
    rng = random.Random(2)
    turns = []
    for c in list(range(120)) + [-7, -3, 5_000, 90_000_000_000]:
        for t in range(rng.randint(1, 7)):
            # A hot first turn, texts that recur, and prefixes shared to a depth of several turns.
            text = "same" if t < rng.choice((1, 1, 4, 6)) else rng.choice(("a", "é", "b" * 30, None, f"own {c}"))
            turns.append((c, t, rng.choice(("user", "user", None)), text))
    turns += [(c, t, "user", f"long {t}") for c in (200, 205, 210, 215) for t in range(70 + c % 3)]
    turns += [(300, None, "user", "first"), (300, 1, "b", "y"), (300, 1, "a", "z"), (300, 1, "a", "z"), (None, 0, "user", "lost"),
              (304, 0, "user", "x" * 100_000), (309, 0, "", "")]
    for c in range(400, 460):
        turns += [(c, t, "user", f"copy {t}") for t in range(9)]
    return turns


@pytest.mark.parametrize("shard_turns", [1, 40, 4_096])
def test_trie_equals_brute_force(spark, shard_turns):
    turns = talks()
    frame = spark.createDataFrame([(*t, "d", 1) for t in turns], "conv_id bigint, turn bigint, role string, text string, "
                                  "depth string, ends int")
    got = prefix_trie.trie(prefix_trie.regrouped(prefix_trie.ordered_turns(frame)), shard_turns=shard_turns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_trie(turns)))


def test_trie_odd_tables(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert prefix_trie.nodes(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie.nodes(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0
    turns = [(1, 0, "user", "x")]  # no conversation 0, and the first turns of its own are dropped
    assert [tuple(r) for r in prefix_trie.nodes(spark.createDataFrame(turns, schema)).collect()] == brute_trie(turns)


def test_double_array_holds_exactly_its_paths():
    rng = random.Random(3)
    sequences = [[rng.randint(1, 30) for _ in range(rng.randint(0, 6))] for _ in range(300)] + [[40, 1, 40]]
    array = prefix_trie.DoubleArray(sequences)
    passed = array.walk(sequences)
    of = {}
    for s, row in zip(sequences, passed.tolist()):
        for d in range(len(s) + 1):
            assert of.setdefault(tuple(s[:d]), row[d]) == row[d] >= 0
        assert all(v < 0 for v in row[len(s) + 1:])
    assert len(set(of.values())) == len(of)
    for s in ([99], [40, 2], [40, 1, 40, 1], [31]):
        assert array.walk([s])[0, -1] == (-1 if tuple(s) not in of else of[tuple(s)])


def test_the_shared_folder_is_never_local_on_a_cluster(spark):
    assert shared_folder(spark) == shared_folder(spark)
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(RuntimeError):
            own_folder(master, "app")
