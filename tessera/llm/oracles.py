"""SQL of the operators on URLs, manifests and tries, for any engine with lists and SHA-256."""

from __future__ import annotations

URL_RULES = r"""
WITH rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path,
         row_number() OVER () AS row
  FROM pages
), fitting AS (
  SELECT row, verdict, rule_host || rule_path AS rule FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule) DESC, length(rule_host) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fitting USING (row)
"""


def _field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree(name: str, levels: int, first: str) -> list[str]:
    """Levels of the trees over rows (g, i, d) of ``first``: tables name0 … with the size c of a level."""
    out = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM ({first}))"]
    for level in range(levels):
        out.append(f"""{name}{level + 1} AS (
  SELECT *, count(*) OVER (PARTITION BY g) AS c FROM (
    SELECT g, i // 8 AS i, CASE WHEN max(c) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE max(d) END AS d
    FROM {name}{level} GROUP BY g, i // 8))""")
    return out


def _climb(paths: str, tree: str, levels: int, first: str) -> list[str]:
    """Proofs and folded digests level by level; rows (doc_id, lang, g, i, proof, folded)."""
    out = [f"{paths}0 AS ({first})"]
    for level in range(levels):
        out.append(f"""{paths}{level + 1} AS (
  SELECT key, any_value(doc_id) AS doc_id, any_value(lang) AS lang, any_value(p.g) AS g, any_value(p.i) // 8 AS i,
         any_value(proof) || coalesce(string_agg(d, '' ORDER BY t.i) FILTER (t.i <> p.i), '') AS proof,
         CASE WHEN any_value(c) = 1 THEN any_value(folded)
              ELSE sha256(string_agg(CASE WHEN t.i = p.i THEN folded ELSE d END, '' ORDER BY t.i)) END AS folded
  FROM {paths}{level} p JOIN {tree}{level} t ON p.g = t.g AND p.i // 8 = t.i // 8 GROUP BY key)""")
    return out


def _crc32(column: str) -> str:
    """CRC-32 of a number's decimal digits: bit by bit, as four-bit steps with a table."""
    table = ", ".join(str(_crc_step(n)) for n in range(16))
    return (f"xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST({column} AS VARCHAR), ''), "
            f"lambda ch: [CAST(ascii(ch) & 15 AS BIGINT), CAST(ascii(ch) >> 4 AS BIGINT)]))), "
            f"lambda h, half: xor(h >> 4, [{table}][1 + (xor(h, half) & 15)])), 4294967295)")


def merkle(levels: int = 6, top_levels: int = 3) -> str:
    """The manifest of up to 8^levels rows a group and 8^top_levels groups."""
    changed = ("CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
               "'abcdefghijklmnopqrstuvwxyz') ELSE text END")
    steps = [
        f"hashed AS (SELECT *, {_crc32('doc_id')} AS crc FROM documents)",
        f"made AS (SELECT doc_id, lang, {_leaf('text')} AS leaf, {_leaf('(' + changed + ')')} AS changed FROM hashed)",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, "
        "dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER () AS key FROM made)",
        *_tree("t", levels, "SELECT g, i, leaf AS d FROM leaves"),
        *_tree("s", top_levels, f"SELECT 0 AS g, g AS i, d FROM t{levels}"),
        *_climb("p", "t", levels, "SELECT key, doc_id, lang, g, i, '' AS proof, changed AS folded FROM leaves"),
        *_climb("q", "s", top_levels, f"SELECT key, doc_id, lang, 0 AS g, g AS i, proof, folded FROM p{levels}"),
    ]
    return "WITH " + ",\n".join(steps) + f"""
SELECT q.doc_id, leaf, r.d AS subroot, s.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = s.d AS verified
FROM q{top_levels} q JOIN leaves USING (key) JOIN t{levels} r ON r.g = leaves.g CROSS JOIN s{top_levels} s
"""


def _crc_step(n: int) -> int:
    """Four steps of CRC-32's division, reflected."""
    for _ in range(4):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


TRIE = f"""
WITH turns AS (
  SELECT conv_id, turn, strlen(coalesce(text, '')) AS bytes,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(key ORDER BY turn NULLS FIRST, key) AS k, list(bytes ORDER BY turn NULLS FIRST, key) AS b,
         CAST({_crc32("conv_id")} % 9 AS INT) AS h
  FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(s.k[1:c.h], []), c.k[c.h + 1:]) AS k,
         list_concat(coalesce(s.b[1:c.h], []), c.b[c.h + 1:]) AS b
  FROM own c LEFT JOIN own s ON s.conv_id = c.conv_id - c.conv_id % 5
), member AS (
  SELECT conv_id, d, sha256(array_to_string(k[1:d], '')) AS p, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS bytes,
         d = len(k) AS ends
  FROM rebuilt, unnest(range(0, len(k) + 1)) AS r(d)
), node AS (
  SELECT d, p, min(conv_id) AS m, count(*) AS n, any_value(bytes) AS bytes,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS e
  FROM member GROUP BY d, p
), edge AS (
  SELECT node.p, q.p AS above FROM node JOIN member q ON q.conv_id = m AND q.d = node.d - 1
), counted AS (
  SELECT above AS p, count(*) AS n_children FROM edge GROUP BY above
), below AS (
  SELECT a.p, CAST(sum((v.n - 1) * v.bytes) AS BIGINT) AS saved_tokens,
         count(*) FILTER (c.n_children IS NULL) AS n_leaves
  FROM node v JOIN member a ON a.conv_id = v.m AND a.d <= v.d LEFT JOIN counted c ON c.p = v.p GROUP BY a.p
)
SELECT node.m AS conv_id, node.d AS depth, parent.m AS parent_conv_id, node.n AS n_convs,
       coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(node.e) AS ends_sha256
FROM node LEFT JOIN edge USING (p) LEFT JOIN node parent ON parent.p = edge.above
LEFT JOIN counted ON counted.p = node.p JOIN below ON below.p = node.p
"""
