"""DuckDB SQL for the queries whose rows SQL can express."""

from __future__ import annotations

from . import secrets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWER_TEXT = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_SAID = "<|im_end|><|im_start|>assistant ok"
_ESCAPED = r"len(regexp_extract_all({0}, '<\\*\|'))"

OP1 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}'),
r AS (SELECT *, replace(replace(role, '%', '%25'), chr(10), '%0A') AS shown FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(shown) + {_ESCAPED.format("shown")} + 1 + length(text) + {_ESCAPED.format("text")} + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER_TEXT}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(node, other) AS (SELECT x, y FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.other = e.x),
c AS (SELECT node, min(other) AS least FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, c.least), d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""

OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r(node, other) AS (SELECT x, y FROM l UNION SELECT r.node, l.y FROM r JOIN l ON r.other = l.x),
c AS (SELECT node, min(other) AS least FROM r GROUP BY 1),
n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(e.vec_id, c.least), e.vec_id) AS component_id, e.vec_id = coalesce(least(e.vec_id, c.least), e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN c ON c.node = e.vec_id
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), 10) AS n, unnest([array_to_string(w[k:k + least(len(w), 10) - 1], ' ') for k in range(1, len(w) - least(len(w), 10) + 2)]) AS g FROM i WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM iw),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, p, places.n, item_id FROM (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM places) places JOIN iw ON iw.n = places.n AND iw.g = places.g),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS word FROM hits) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id
"""


def _marked(kind: int, pattern: str, keep: str, texts: str = "t", text: str = "t") -> str:
    """(doc_id, kind, start, end) of the matches of a pattern: marked in the text, cut there, with lengths added up."""
    return rf"""
SELECT doc_id, {kind} AS kind, place AS "start", place + length(hit) AS "end" FROM (
  SELECT doc_id, split_part(piece, chr(2), 1) AS hit, piece, k,
    coalesce(sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM (SELECT doc_id, unnest(string_split(m, chr(1))) AS piece, generate_subscripts(string_split(m, chr(1)), 1) AS k
    FROM (SELECT doc_id, regexp_replace({text}, '({pattern})', chr(1) || '\1' || chr(2), 'g') AS m FROM {texts})))
WHERE k > 1 AND {keep}"""


def _op12() -> str:
    quoted = [p.replace("'", "''") for p in (secrets.ASSIGN, secrets.ACCESS, secrets.HEX, secrets.ACCOUNT, secrets.ENDPOINT, secrets.RUN)]
    long = "length(regexp_extract(hit, '[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6"
    mixed = "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]')"
    names = ", ".join(f"'{k}'" for k in secrets.KINDS)
    listed = f"string_agg(([{names}])[kind + 1] || ':' || \"start\" || ':' || \"end\", ',' ORDER BY \"start\", kind)"
    reach = secrets.REACH

    def apart(taken: str, kind: str) -> str:
        return f'{kind} AS MATERIALIZED (SELECT w.* FROM {kind}0 w WHERE NOT EXISTS (SELECT 1 FROM ({taken}) s WHERE s.doc_id = w.doc_id AND s."start" < w."end" AND w."start" < s."end"))'

    def near(roles: str) -> str:
        return f'EXISTS (SELECT 1 FROM p o WHERE o.doc_id = p.doc_id AND o.scope = p.scope AND o.kind IN ({roles}) AND o."start" <= p."end" + {reach} AND o."end" >= p."start" - {reach})'

    identifier, secret = near("1, 3"), near("0, 2, 5")
    return rf"""
WITH t AS MATERIALIZED (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS t FROM documents),
strong AS MATERIALIZED ({_marked(0, quoted[0], long)} UNION ALL {_marked(1, quoted[1], "true")} UNION ALL {_marked(2, quoted[2], "true")}),
account0 AS MATERIALIZED ({_marked(3, quoted[3], "true")}), endpoint0 AS MATERIALIZED ({_marked(4, quoted[4], "true")}), run0 AS MATERIALIZED ({_marked(5, quoted[5], mixed)}),
{apart("SELECT * FROM strong", "account")},
{apart("SELECT * FROM strong UNION ALL SELECT * FROM account", "endpoint")},
{apart("SELECT * FROM strong UNION ALL SELECT * FROM account UNION ALL SELECT * FROM endpoint", "run")},
cut AS MATERIALIZED ({_marked(0, secrets.SCOPE, "true")}),
p AS MATERIALIZED (SELECT s.*, (SELECT count(*) FROM cut WHERE cut.doc_id = s.doc_id AND cut."start" < s."start") AS scope
  FROM (SELECT * FROM strong UNION ALL SELECT * FROM account UNION ALL SELECT * FROM endpoint UNION ALL SELECT * FROM run) s),
linked AS (SELECT * FROM p WHERE kind < 3 OR (kind = 3 AND {secret}) OR (kind = 4 AND {identifier} AND {secret}) OR (kind = 5 AND {identifier})),
b AS (SELECT doc_id, {listed} FILTER (WHERE kind < 3) AS base, {listed} AS spans,
  count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS c, count(*) FILTER (WHERE kind = 2) AS h, count(*) FILTER (WHERE kind >= 3) AS w FROM linked GROUP BY 1)
SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(w, 0) AS n_linked
FROM t LEFT JOIN b ON b.doc_id = t.doc_id
"""


OP12 = _op12()

OP13 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER_TEXT}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest([w[i:i + k - 1] for i in range(1, len(w) - k + 2)]) AS g FROM w, (VALUES (1), (2), (3)) AS lengths(k)),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT c.lang, c.k, c.g, c.a, 1 AS cut, l.a AS l, r.a AS r FROM c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:1] JOIN f r ON r.lang = c.lang AND r.g = c.g[2:]
  UNION ALL SELECT c.lang, c.k, c.g, c.a, 2, l.a, r.a FROM c JOIN f l ON l.lang = c.lang AND l.g = c.g[1:2] JOIN f r ON r.lang = c.lang AND r.g = c.g[3:] WHERE c.k = 3),
s AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
covers AS (SELECT lang, g, max(a) AS a FROM (SELECT lang, g[1:2] AS g, a FROM c WHERE k = 3 UNION ALL SELECT lang, g[2:3], a FROM c WHERE k = 3) GROUP BY ALL),
kept AS (SELECT best.*, array_to_string(best.g, ' ') AS phrase FROM best LEFT JOIN covers ON covers.lang = best.lang AND covers.g = best.g WHERE covers.a IS NULL OR 100 * covers.a < 50 * best.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000
"""
