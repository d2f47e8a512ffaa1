"""SQL by brute force for the operators on conversations, secrets and codes."""

from __future__ import annotations

from .secret_scan import BASE, RULES


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _found(i: int, rule) -> str:
    pattern = _ASSIGN if rule.kind == "assign" else rule.pattern
    return f"""SELECT doc_id, {i} AS k, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(text, '{pattern}') AS p,
 regexp_extract_all(text, '{pattern}', 0) AS v, regexp_extract_all(text, '{pattern}', {rule.group}) AS g FROM t"""


_OWN = ", ".join(f"'{k}'" for k in BASE)
_PLACE = "kind || ':' || s || ':' || e, ',' ORDER BY s, k"
SECRETS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_found(i, r) for i, r in enumerate(RULES))}),
m AS (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM f),
pl AS (SELECT doc_id, k, kind, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s, length(v[i]) AS n FROM m WHERE length(g[i]) >= least),
z AS (SELECT *, s + n AS e FROM pl)
SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}')::BIGINT AS n_{k}" for k in BASE)},
 sha256(coalesce(string_agg({_PLACE}) FILTER (WHERE kind IN ({_OWN})), '')) AS base_sha256, coalesce(string_agg({_PLACE}) FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM t LEFT JOIN z USING (doc_id) GROUP BY doc_id"""


def _cost(v: str, more: str, letter: str) -> str:
    return f"(lpad((left({v}, 9)::BIGINT + {more})::VARCHAR, 9, '0') || '{letter}' || substr({v}, 10))"


def _way(state: str, keeps: dict[str, str], due: str) -> str:
    kept = "CASE " + " ".join(f"WHEN letter = '{a}' THEN {_cost(f'dp.{b}', 't', 'K')}" for a, b in keeps.items()) + " END"
    return f"least({_cost(f'dp.{state}', '4', 'D')}, CASE WHEN NOT gone THEN least({kept}, {_cost(f'dp.{due}', '(3 + t)', 'R')}) END)"


def _put(e: str, s: str, u: str, a: str) -> str:
    """The four states after turns may be put in."""
    uu, aa = f"least({u}, {_cost(a, '3', 'I')})", f"least({a}, {_cost(u, '3', 'I')})"
    return f"least({e}, {_cost(uu, '3', 'I')}) AS e, least({s}, {_cost(uu, '3', 'I')}) AS s, {uu} AS u, {aa} AS a"


REPAIR = f"""
WITH RECURSIVE b AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS bytes FROM conversations),
h AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind FROM src, b),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
 unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
f AS (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
 CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
w AS (SELECT conv_id, i, role, text, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS t, left(role, 1) AS letter FROM f),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
 count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
dp AS (SELECT conv_id, n AS i, '000000000' AS e, '000000006II' AS s, '000000003I' AS u, '000000000' AS a FROM sums
 UNION ALL SELECT conv_id, i, {_put("e", "s", "u", "a")} FROM (SELECT dp.conv_id, dp.i - 1 AS i, {_way("e", {"s": "s", "u": "u"}, "u")} AS e, {_way("s", {"u": "u"}, "u")} AS s, {_way("u", {"a": "a"}, "a")} AS u, {_way("a", {"u": "u"}, "u")} AS a
 FROM dp JOIN w ON w.conv_id = dp.conv_id AND w.i = dp.i)),
best AS (SELECT conv_id, left(e, 9)::BIGINT AS cost, substr(e, 10) AS audit FROM dp WHERE i = 0),
l AS (SELECT conv_id, k, letter, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER x AS i, sum(CASE WHEN letter = 'D' THEN 0 ELSE 1 END) OVER x AS o
 FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS k, unnest(string_split(audit, '')) AS letter FROM best WHERE audit <> '') WINDOW x AS (PARTITION BY conv_id ORDER BY k)),
r AS (SELECT l.conv_id, k, l.letter, o, CASE WHEN l.letter = 'I' THEN '' ELSE w.text END AS text, w.role,
 max(CASE WHEN o = 1 AND l.letter = 'K' AND w.letter = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS off FROM l LEFT JOIN w ON w.conv_id = l.conv_id AND w.i = l.i),
made AS (SELECT conv_id, sha256(coalesce(string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - off) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) FILTER (WHERE letter <> 'D'), '')) AS repaired_sha256 FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
 coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN made USING (conv_id)"""


def _codes(parts: int = 4, rounds: int = 4) -> str:
    ctes = [
        """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"x AS MATERIALIZED (SELECT vec_id, label, p, q[p * len(q) // {parts} + 1:(p + 1) * len(q) // {parts}] AS s FROM v, range({parts}) AS r(p))",
        "b0 AS MATERIALIZED (SELECT * FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, s FROM x) WHERE e < 256)",
    ]
    for r in range(rounds + 1):
        far = "list_sum(list_transform(range(1, len(x.s) + 1), lambda i: (x.s[i] - b.s[i]) * (x.s[i] - b.s[i])))::BIGINT"
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, x.p, any_value(label) AS label, any_value(x.s) AS s, min({far} * 256 + e) AS m FROM x JOIN b{r} b ON b.p = x.p GROUP BY vec_id, x.p)")
        if r < rounds:
            ctes.append(
                f"""b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.s, b.s) AS s FROM b{r} b LEFT JOIN (SELECT p, e, list(t ORDER BY i) AS s FROM
 (SELECT p, m % 256 AS e, i, floor(sum(y)::DOUBLE / count(*))::BIGINT AS t FROM (SELECT p, m, unnest(s) AS y, unnest(range(1, len(s) + 1)) AS i FROM a{r}) GROUP BY ALL) GROUP BY p, e) u USING (p, e))"""
            )
    return f"""
WITH {", ".join(ctes)},
book AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
c AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, book"""


CODES = _codes()
