"""SQL of the queries that SQL can express on whole tables (DuckDB dialect)."""

from __future__ import annotations

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"lower(translate({x}, {_q(_WIDE)}, {_q(_PLAIN)}))"


def letters(x: str) -> str:
    return f"regexp_replace({fold(x)}, '[^\\pL]', '', 'g')"


def letters_digits(x: str) -> str:
    return f"regexp_replace({fold(x)}, '[^\\pL\\p{{Nd}}]', '', 'g')"


_TERMS = f"""
WITH v AS (
  SELECT doc_ord, 'tokens' AS field, unnest(tokens) AS x FROM raw_docs
  UNION ALL SELECT doc_ord, 'tags' AS field, unnest(tags) AS x FROM raw_docs),
t AS (SELECT doc_ord, field, regexp_replace({fold("x")}, '^\\s+|\\s+$', '', 'g') AS term FROM v WHERE x IS NOT NULL),
n AS (SELECT count(DISTINCT doc_ord) AS n FROM raw_docs),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT doc_ord) AS docs FROM t WHERE term <> '' GROUP BY ALL)
SELECT field, term, CAST(occurrences AS BIGINT) AS occurrences, CAST(docs AS BIGINT) AS docs,
  CASE WHEN docs <= 2 THEN 'rare' WHEN docs * 5 > n THEN 'common' END AS mark
FROM c, n"""

_LINES = f"""
WITH d AS (SELECT DISTINCT ordinal, account, content_markdown AS m FROM articles WHERE account IS NOT NULL),
a AS (SELECT account, count(DISTINCT ordinal) AS n FROM d GROUP BY account HAVING count(DISTINCT ordinal) >= 10),
l AS (SELECT ordinal, account, unnest(string_split(m, chr(10))) AS line, unnest(range(len(string_split(m, chr(10))))) AS line_no FROM d WHERE m IS NOT NULL),
k AS (SELECT ordinal, account, line_no, {letters("line")} AS line FROM l),
h AS (SELECT k.account, line FROM k JOIN a USING (account) WHERE line <> '' GROUP BY k.account, line, n HAVING count(DISTINCT ordinal) * 5 >= n * 2)
SELECT DISTINCT ordinal, CAST(line_no AS BIGINT) AS line_no FROM k JOIN h USING (account, line)"""

_PAIRS = f"""
WITH b AS (SELECT doc_ord, {letters_digits("regexp_replace(text, '^\\s*---[ \\t]*\\r?\\n(?s:.*?)\\r?\\n---[ \\t]*(?:\\r?\\n|\\z)', '')")} AS s FROM raw_docs WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_ord, CASE WHEN length(s) < 5 THEN s ELSE substr(s, i, 5) END AS g FROM (SELECT doc_ord, s, unnest(range(1, greatest(length(s) - 3, 2))) AS i FROM b WHERE s <> '')),
n AS (SELECT doc_ord, count(*) AS n FROM g GROUP BY doc_ord),
c AS (SELECT x.doc_ord AS a, y.doc_ord AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_ord < y.doc_ord GROUP BY ALL)
SELECT a AS doc_ord_a, b AS doc_ord_b FROM c JOIN n na ON na.doc_ord = a JOIN n nb ON nb.doc_ord = b WHERE c >= 0.7 * (na.n + nb.n - c)"""

_LEAKS = f"""
WITH p AS (SELECT DISTINCT item_id, {letters_digits("passage")} AS s FROM eval_items WHERE passage IS NOT NULL),
pg AS (SELECT DISTINCT item_id, substr(s, i, 8) AS g FROM (SELECT item_id, s, unnest(range(1, length(s) - 6)) AS i FROM p WHERE length(s) >= 8)),
d AS (SELECT doc_id, {letters_digits("text")} AS s FROM documents WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, substr(s, i, 8) AS g FROM (SELECT doc_id, s, unnest(range(1, length(s) - 6)) AS i FROM d WHERE length(s) >= 8)),
n AS (SELECT item_id, count(*) AS n FROM pg GROUP BY item_id)
SELECT doc_id, item_id, count(*) / max(n) AS share FROM dg JOIN pg USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.455 * max(n)"""


_GROUPS = f"""
WITH RECURSIVE p AS MATERIALIZED ({_PAIRS.strip()}),
w AS (SELECT doc_ord, {letters_digits("regexp_replace(text, '^\\s*---[ \\t]*\\r?\\n(?s:.*?)\\r?\\n---[ \\t]*(?:\\r?\\n|\\z)', '')")} AS s FROM raw_docs WHERE text IS NOT NULL),
r AS (SELECT doc_ord, min(doc_ord) OVER (PARTITION BY s) AS rep FROM w WHERE s <> ''),
e AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM (SELECT doc_ord_a AS a, doc_ord_b AS b FROM p UNION ALL SELECT doc_ord_b, doc_ord_a FROM p) q JOIN r x ON x.doc_ord = q.a JOIN r y ON y.doc_ord = q.b WHERE x.rep <> y.rep),
reach AS (SELECT DISTINCT rep AS a, rep AS b FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
g AS (SELECT a AS rep, min(b) AS "group" FROM reach GROUP BY a),
l AS (SELECT a AS rep, count(*) AS links FROM e GROUP BY a)
SELECT doc_ord, r.rep, g."group", CAST(coalesce(links, 0) AS BIGINT) AS links FROM r JOIN g USING (rep) LEFT JOIN l USING (rep)"""

_BODIES = f"""
WITH f AS MATERIALIZED ({_LINES.strip()}), d AS (SELECT DISTINCT ordinal, content_markdown AS m FROM articles),
l AS (SELECT ordinal, unnest(string_split(m, chr(10))) AS line, unnest(range(len(string_split(m, chr(10))))) AS line_no FROM d WHERE m IS NOT NULL),
x AS (SELECT l.ordinal, string_agg(line, chr(10) ORDER BY l.line_no) FILTER (WHERE f.ordinal IS NULL) AS body, count(f.ordinal) AS n, count(*) FILTER (WHERE f.ordinal IS NULL) AS kept FROM l LEFT JOIN f ON f.ordinal = l.ordinal AND f.line_no = l.line_no GROUP BY l.ordinal)
SELECT d.ordinal, CAST(coalesce(n, 0) AS BIGINT) AS removed_lines, CASE WHEN m IS NULL THEN NULL WHEN kept = 0 THEN '' ELSE body END AS body FROM d LEFT JOIN x USING (ordinal)"""


def _parameter(name: str) -> str:
    s = "replace(v, '&amp;', '&')"
    return f"regexp_extract({s}, '[?&]{name}=([^&#\\s]+)', 1)"


_ADDRESS = f"""CASE WHEN {_parameter("__biz")} <> '' AND {_parameter("mid")} <> '' AND {_parameter("idx")} <> '' AND {_parameter("sn")} <> ''
 THEN concat_ws('|', replace(replace(replace(replace({_parameter("__biz")}, '%3D', '='), '%3d', '='), '%2B', '+'), '%2F', '/'), {_parameter("mid")}, {_parameter("idx")}, lower({_parameter("sn")})) END"""

#: The rule as it is told: one article after another, against the list of those accepted so far.
_REPEATS = f"""
WITH RECURSIVE d AS (SELECT ordinal, any_value(link) AS link, any_value(url) AS url, any_value(source) AS source, {letters_digits("any_value(content_markdown)")} AS s FROM articles WHERE ordinal IS NOT NULL GROUP BY ordinal),
ad AS MATERIALIZED (SELECT ordinal, arg_min(a, i) AS a FROM (SELECT ordinal, i, {_ADDRESS} AS a FROM (SELECT ordinal, unnest([link, url, source]) AS v, unnest([1, 2, 3]) AS i FROM d)) WHERE a IS NOT NULL GROUP BY ordinal),
b AS MATERIALIZED (SELECT min(ordinal) AS head, list(ordinal) AS members, s FROM d WHERE length(s) >= 300 GROUP BY s),
g AS MATERIALIZED (SELECT DISTINCT head, hash(substr(s, i, 5)) AS g FROM (SELECT head, s, unnest(range(1, length(s) - 3)) AS i FROM b)),
n AS (SELECT head, count(*) AS n FROM g GROUP BY head),
c AS (SELECT x.head AS a, y.head AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.head < y.head GROUP BY ALL),
near AS (SELECT a, b FROM c JOIN n na ON na.head = a JOIN n nb ON nb.head = b WHERE c >= 0.7 * (na.n + nb.n - c) UNION ALL SELECT head, head FROM b),
m AS (SELECT head, unnest(members) AS ordinal FROM b),
pair AS (SELECT x.ordinal AS p, y.ordinal AS o FROM (SELECT a, b FROM near UNION SELECT b, a FROM near) q JOIN m x ON x.head = q.a JOIN m y ON y.head = q.b WHERE x.ordinal < y.ordinal
 UNION SELECT x.ordinal, y.ordinal FROM ad x JOIN ad y ON x.a = y.a AND x.ordinal < y.ordinal),
k AS MATERIALIZED (SELECT d.ordinal, coalesce(list(p) FILTER (WHERE p IS NOT NULL), []) AS before, row_number() OVER (ORDER BY d.ordinal) AS k FROM d LEFT JOIN pair ON pair.o = d.ordinal GROUP BY d.ordinal),
h AS MATERIALIZED (SELECT ordinal, before, row_number() OVER (ORDER BY ordinal) AS k FROM k WHERE len(before) > 0),
first AS (SELECT list(ordinal) AS acc FROM k WHERE len(before) = 0),
walk AS (SELECT CAST(0 AS BIGINT) AS k, acc, CAST(NULL AS BIGINT) AS ordinal, CAST(NULL AS BIGINT) AS accepted FROM first
 UNION ALL SELECT h.k, CASE WHEN list_has_any(acc, before) THEN acc ELSE list_append(acc, h.ordinal) END, h.ordinal, list_min(list_intersect(before, acc)) FROM walk JOIN h ON h.k = walk.k + 1)
SELECT accepted AS accepted_ordinal, ordinal FROM walk WHERE accepted IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _PAIRS,
        "p1_groups": _GROUPS,
        "p3_found": _REPEATS,
        "p4_bodies": _BODIES,
        "p2_terms": _TERMS,
        "p2_found": f"SELECT field, term, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
        "p4_found": _LINES,
        "p7_shares": _LEAKS,
        "p7_found": f"SELECT doc_id, item_id FROM ({_LEAKS})",
    }
