"""DuckDB SQL of the training-data queries that SQL can express, written separately."""

from __future__ import annotations

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(hex40: str) -> str:
    """Base 32 of 40 hexadecimal digits, five of them for four letters."""
    value = lambda n: f"('0x' || substr({hex40}, {5 * n + 1}, 5))::BIGINT"
    letter = lambda n, shift: f"substr('{ALPHABET}', 1 + (({value(n)} >> {shift}) & 31)::INTEGER, 1)"
    return " || ".join(letter(n, shift) for n in range(8) for shift in (15, 10, 5, 0))


PATTERNS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
]


def _spans(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Matches in order; a match starts after all parts and matches before it."""
    p = "'" + pattern.replace("'", "''") + "'"
    start = f"(list_sum(list_transform(p{number}[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m{number}[1:k - 1], lambda x: length(x))), 0))::BIGINT"
    each = f"{{'s': {start}, 'n': {number}, 'kind': '{kind}', 'e': {start} + length(m{number}[k]), 'size': length(g{number}[k])}}"
    listed = f"list_filter(list_transform(range(1, len(m{number}) + 1), lambda k: {each}), lambda x: x.size >= {least})"
    return f"""s{number} AS (SELECT key, {listed} AS found FROM (SELECT key, string_split_regex(t, {p}) AS p{number},
  regexp_extract_all(t, {p}, 0) AS m{number}, regexp_extract_all(t, {p}, {group}) AS g{number} FROM d))"""


def _listed(spans: str) -> str:
    return f"array_to_string(list_transform({spans}, lambda x: x.kind || ':' || x.s || ':' || x.e), ',')"


SECRETS = f"""WITH d AS (SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS t FROM documents),
{', '.join(_spans(n, *rule) for n, rule in enumerate(PATTERNS))},
a AS (SELECT doc_id, s0.found AS f0, s1.found AS f1, s2.found AS f2,
    list_sort(list_concat(list_concat(s0.found, s1.found), s2.found)) AS base,
    list_sort(list_concat(list_concat(list_concat(list_concat(s0.found, s1.found), s2.found), s3.found), s4.found)) AS every
  FROM d JOIN s0 USING (key) JOIN s1 USING (key) JOIN s2 USING (key) JOIN s3 USING (key) JOIN s4 USING (key))
SELECT doc_id, len(f0)::BIGINT AS n_assign, len(f1)::BIGINT AS n_access, len(f2)::BIGINT AS n_hex,
  sha256({_listed('base')}) AS base_sha256, {_listed('every')} AS spans FROM a"""

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS newest FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_base32('d')} AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> newest THEN newest END AS refers_to FROM w"""



def _crc32(text: str) -> str:
    """CRC-32 of a text of ASCII letters, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {bits}), 4294967295)"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree(name: str, leaves: str) -> str:
    """Levels (lvl, g, idx, node, n) of one tree for each g; n is the number of nodes of the level."""
    return f"""{name} AS (SELECT 0 AS lvl, g, idx, node, n FROM ({leaves})
  UNION ALL SELECT lvl, g, idx, node, count(*) OVER (PARTITION BY g) AS n FROM (
    SELECT lvl + 1 AS lvl, g, idx // 3 AS idx, sha256(string_agg(node, '' ORDER BY idx)) AS node
    FROM {name} WHERE n > 1 GROUP BY lvl, g, idx // 3))"""


def _path(tree: str, lvl: int) -> str:
    """What stands left and right of each leaf's path, level by level."""
    return f"""SELECT l.g, l.idx, t.lvl + {lvl} AS lvl,
    coalesce(string_agg(t.node, '' ORDER BY t.idx) FILTER (t.idx < l.idx // (3 ** t.lvl)::BIGINT), '') AS before,
    coalesce(string_agg(t.node, '' ORDER BY t.idx) FILTER (t.idx > l.idx // (3 ** t.lvl)::BIGINT), '') AS behind
  FROM {tree} l JOIN {tree} t ON t.g IS NOT DISTINCT FROM l.g AND t.n > 1
    AND t.idx // 3 = l.idx // (3 ** (t.lvl + 1))::BIGINT
  WHERE l.lvl = 0 GROUP BY l.g, l.idx, t.lvl"""


MANIFEST = f"""WITH RECURSIVE d AS (SELECT *, CASE WHEN {_crc32('doc_id::VARCHAR')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS told FROM documents),
k AS (SELECT doc_id, source AS g, {_leaf('text')} AS node, {_leaf('told')} AS told FROM d),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, node) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM k),
{_tree('own', 'SELECT g, idx, node, n FROM numbered')},
tops AS (SELECT g AS source, node, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM own WHERE n = 1),
{_tree('roots', 'SELECT 0 AS g, idx, node, n FROM tops')},
root AS (SELECT node AS root FROM roots WHERE n = 1),
steps AS ({_path('own', 0)}
  UNION ALL SELECT o.g, o.idx, s.lvl, s.before, s.behind FROM own o JOIN tops ON o.g IS NOT DISTINCT FROM tops.source AND o.lvl = 0
    JOIN ({_path('roots', 1000)}) s ON s.idx = tops.idx),
proofs AS (SELECT g, idx, list(before || '|' || behind ORDER BY lvl) AS path, string_agg(before || behind, '' ORDER BY lvl) AS every FROM steps GROUP BY g, idx)
SELECT doc_id, x.node AS leaf, tops.node AS subroot, root, sha256(coalesce(every, '')) AS proof_sha256,
  list_reduce(list_prepend(told, coalesce(path, [])), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root,
  folded_root = root AS verified
FROM numbered x JOIN tops ON x.g IS NOT DISTINCT FROM tops.source JOIN root ON true
  LEFT JOIN proofs p ON p.g IS NOT DISTINCT FROM x.g AND p.idx = x.idx"""

_KEY = "(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))"

REPAIR = f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(_KEY)} % 20 AS kind FROM conversations),
r AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 64), left(text, 64),
    sha256(strlen(role) || ':' || role || text), copy) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM r),
f AS (SELECT conv_id, turn, role, text, rn, n, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE 'ok' END AS fault,
  lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS c2 FROM o),
ins(i, p, price, put) AS (VALUES (0, 0, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 1, 0, ''), (1, 2, 2, 'I'), (1, 3, 4, 'II'),
  (2, 2, 0, ''), (2, 3, 2, 'I'), (3, 3, 0, ''), (3, 2, 2, 'I')),
step(p, x, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edit AS (SELECT p, NULL AS x, p AS q, 'D' AS letter FROM (SELECT DISTINCT p FROM ins)
  UNION ALL SELECT p, x, q, 'K' FROM step UNION ALL SELECT p, x, q, 'R' FROM step WHERE x <> 's'),
v AS (SELECT DISTINCT conv_id, 0::BIGINT AS rn, 0 AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM f
  UNION ALL SELECT f.conv_id, f.rn, e.q AS state, min({{'cost': v.best.cost + ins.price
      + CASE e.letter WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + (e.letter <> 'D' AND f.fault = 'truncated')::BIGINT,
      'audit': v.best.audit || ins.put || e.letter}}) AS best
    FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.rn = v.rn + 1
      JOIN ins ON ins.i = v.state JOIN edit e ON e.p = ins.p
      AND (e.letter = 'D' OR (f.fault IN ('ok', 'truncated') AND ((e.letter = 'K' AND e.x = f.c) OR (e.letter = 'R' AND e.x <> f.c))))
    GROUP BY f.conv_id, f.rn, e.q),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (c2 IS NOT NULL AND c || c2 NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
ended AS (SELECT counts.*, b.best.cost AS cost, b.best.audit AS audit FROM counts JOIN
  (SELECT v.conv_id, v.rn, min({{'cost': v.best.cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END,
    'audit': v.best.audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}}) AS best FROM v GROUP BY ALL) b
  ON b.conv_id IS NOT DISTINCT FROM counts.conv_id AND b.rn = counts.n),
letters AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i FROM ended),
placed AS (SELECT conv_id, i, substr(audit, i, 1) AS letter, length(translate(left(audit, i), 'I', '')) AS rn,
  length(translate(left(audit, i), 'D', '')) AS number FROM letters),
kept AS (SELECT p.conv_id, p.i, p.letter, p.number, f.role, f.text, f.c,
    bool_or(p.number = 1 AND p.letter = 'K' AND f.c = 's') OVER (PARTITION BY p.conv_id) AS from_s
  FROM placed p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.rn = p.rn WHERE p.letter <> 'D'),
told AS (SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN role ELSE CASE WHEN (number % 2 = 0) = from_s THEN 'user' ELSE 'assistant' END END
  || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS lines FROM kept GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM a.conv_id"""

ORACLES: dict[str, str] = {"op9_secrets": SECRETS, "op10_warc": WARC, "op11_conversation_repair": REPAIR, "op13_merkle_manifest": MANIFEST}
