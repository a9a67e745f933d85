"""SQL expressions and common tables of the text and cluster operators (DuckDB dialect)."""

from __future__ import annotations

from textloom.functions import constants as K


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def like(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def any_of(words) -> str:
    return "|".join(words)


def strip(x: str) -> str:
    return rr(f"coalesce({x}, '')", K.TRIM)


def first(x: str, pattern: str, group: int = 1) -> str:
    return f"CASE WHEN {like(x, pattern)} THEN regexp_extract({x}, {q(pattern)}, {group}) END"


def strings(x: str) -> str:
    """A list's stripped elements without null and blank ones."""
    return f"list_filter(list_transform(coalesce({x}, CAST([] AS VARCHAR[])), lambda e: {strip('e')}), lambda e: e <> '')"


def ordered(x: str) -> str:
    """Distinct elements in the order first seen."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


def joined(x: str) -> str:
    return f"array_to_string({x}, ' | ')"


def title(text: str, stem: str) -> str:
    a, b = rf"(?m)^title:{K.WS}*\"?(.*?)\"?$", rf"(?m)^#{K.WS}+(.+)$"
    return f"coalesce(nullif({rr(first(text, a), K.TRIM)}, ''), {rr(first(text, b), K.TRIM)}, {stem})"


def field_list(text: str, field: str) -> str:
    raw = rr(strip(first(text, rf"(?m)^{field}:{K.WS}*\[(.*?)\]{K.WS}*$")), rf"\]\]{K.WS}*,{K.WS}*\[\[", ",")
    item = strip(rr(rr(rr(strip("p"), '^"+|"+$'), "^'+|'+$"), r"^\[+|\]+$"))
    return ordered(f"list_filter(list_transform(string_split({raw}, ','), lambda p: {item}), lambda p: p <> '')")


def page_type(text: str) -> str:
    return f"coalesce({rr(first(text, rf'(?m)^type:{K.WS}*' + chr(34) + '?(.*?)' + chr(34) + '?$'), K.TRIM)}, 'unknown')"


def clean(x: str) -> str:
    x = f"regexp_replace(coalesce({x}, ''), '^---\n(?s:.*?)\n---\n', ' ')"
    for p, to in ((r"```(?s:.*?)```", " "), (r"!\[[^\]]*\]\([^\)]+\)", " "), (r"\[[^\]]+\]\([^\)]+\)", " "), (K.WIKILINK, "\\1"), (K.LINE_ENDS, "\n"), (f"(?im){K.NOISE_LINE}", ""), (f"{K.WS}+", " ")):
        x = rr(x, p, to)
    return strip(x)


def normal_token(x: str) -> str:
    return rr(f"lower({strip(x)})", K.WORD_END)


def noise_token(x: str) -> str:
    return f"({x} IN ({', '.join(q(w) for w in K.NOISE_SET)}) OR {like(x, '(?s)' + K.NOISE_SHAPE)} OR (length({x}) >= 5 AND {like(x, K.NOISE_PART)}))"


def raw_tokens(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({x}, {q(K.TOKEN)}, 0), lambda t: {normal_token('t')}), lambda t: t <> '')"


def tokens(x: str) -> str:
    return f"list_filter({raw_tokens(clean(x))}, lambda t: NOT {noise_token('t')})"


def sentences(x: str) -> str:
    """Key sentences with repeats; distinct and cut by key_sentences."""
    parts = f"string_split({rr(clean(x), '([。！？!?；;])', chr(92) + '1' + chr(1))}, chr(1))"
    parts = f"list_transform({parts}, lambda s: {rr('s', K.SENTENCE_EDGE)})"
    noise = f"length(s) < 12 OR {like('s', '(?i)' + K.NOISE_HEAD)} OR length(s) - length(replace(s, '`', '')) >= 2 OR {like('s', K.FIELD_HEAD)} OR len(list_filter({raw_tokens('s')}, lambda t: NOT {noise_token('t')})) < 2"
    return f"list_filter({parts}, lambda s: NOT ({noise}))"


def key_sentences(source: str, columns: str, x: str, limit: int) -> str:
    """Query (columns, pos, sentence) of the first key sentences of each row of source, from 0."""
    return f"""SELECT {columns}, unnest(ks) AS sentence, unnest(range(len(ks))) AS pos FROM (SELECT {columns}, {ordered("ss")}[1:{limit}] AS ks FROM (SELECT {columns}, {sentences(x)} AS ss FROM {source}))"""


def title_key(x: str) -> str:
    head = strip(rr(f"coalesce({x}, '')", r"(?s)[：:（(].*$"))
    one, two = (rr(first(head, rf"^(.+?)(?:{any_of(s)})$"), K.TRIM) for s in K.KEY_SUFFIXES)
    return f"coalesce(nullif({one}, ''), nullif({two}, ''), {head})"


def slug(x: str) -> str:
    s = rr(rr(rr(f"coalesce({x}, '')", r'[\\/:*?"<>|]', "_"), f"{K.WS}+", "_"), r"^[._]+|[._]+$")
    return f"coalesce(nullif({s}, ''), 'untitled')"


def file_name(x: str) -> str:
    return f"""substr(replace(replace({strip(f"translate(coalesce({x}, ''), '{chr(92)}/:*?" + chr(34) + "<>|', '_________')")}, chr(10), ' '), chr(13), ''), 1, 80)"""


def wikilinks(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), {q(K.WIKILINK)}, 1), lambda w: {strip('w')}), lambda w: w <> '')"


def related_titles(items: str, own: str | None = None) -> str:
    t = rr(rr(strip(rr(f"replace(replace({strip('p')}, '[[', ''), ']]', '')", r"^\[+|\]+$")), '^"+|"+$'), "^'+|'+$")
    keep = f"p <> '' AND ({strip(own)} = '' OR p <> {strip(own)})" if own else "p <> ''"
    return ordered(f"list_filter(list_transform({items}, lambda p: {t}), lambda p: {keep})")


def body(x: str) -> str:
    x = f"coalesce({x}, '')"
    rest = f"substr({x}, 4)"
    at = f"instr({rest}, '---')"
    return strip(f"CASE WHEN starts_with({x}, '---') AND {at} > 0 THEN substr({rest}, {at} + 3) ELSE {x} END")


def source_of(x: str) -> str:
    x = f"coalesce({x}, '')"
    rest = f"substr({x}, 4)"
    block = rr(f"CASE WHEN starts_with({x}, '---') AND instr({rest}, '---') > 0 THEN substr({rest}, 1, instr({rest}, '---') - 1) END", K.LINE_ENDS, "\n")
    return f"CASE WHEN {like(block, rf'(?m)^{K.IN_LINE_WS}*source:')} THEN {strip(f'regexp_extract({block}, {q(rf"(?m)^{K.IN_LINE_WS}*source:(.*)$")}, 1)')} END"


def section(x: str) -> str:
    cases = " ".join(f"WHEN contains(coalesce({x}, ''), {q(s)}) THEN {q(s)}" for s in K.BACKLINK_SECTIONS)
    return f"CASE {cases} ELSE {q(K.NO_SECTION)} END"


def link() -> str:
    return "coalesce(nullif(link, ''), nullif(url, ''), nullif(source, ''), '')"


DOCS = f"""docs AS (SELECT CAST(doc_ord AS BIGINT) AS doc_ord, coalesce(rel_path, '') AS rel_path, coalesce(title, '') AS title, coalesce(month, 'unknown') AS month, coalesce(preview, '') AS preview,
  coalesce(text, '') AS text, coalesce(title_key, '') AS title_key, {strings("tags")} AS tags, {strings("tokens")} AS tokens FROM raw_docs WHERE doc_ord IS NOT NULL)"""

MEMBERS = f"""{DOCS},
b AS (SELECT *, coalesce(tags[1], CASE WHEN length(title_key) >= 2 THEN title_key END, {q(K.UNSORTED)}) AS bucket FROM docs),
b2 AS (SELECT *, CASE WHEN length(title_key) >= 2 THEN title_key ELSE bucket END AS key FROM b),
ks AS (SELECT bucket, key, count(*) AS key_n FROM b2 GROUP BY bucket, key),
st AS (SELECT bucket, sum(key_n) AS n, sum(CASE WHEN key_n >= 2 AND key <> bucket THEN 1 ELSE 0 END) AS keys FROM ks GROUP BY bucket),
ms AS (SELECT bucket, count(DISTINCT month) AS months, min(doc_ord) AS bucket_ord FROM b2 GROUP BY bucket),
m0 AS (SELECT b2.*, bucket_ord, key_n, CASE WHEN n > 6 AND keys >= 2 THEN 'key' WHEN n > 6 AND months >= 3 THEN 'month' ELSE 'all' END AS how
  FROM b2 JOIN st USING (bucket) JOIN ms USING (bucket) JOIN ks USING (bucket, key)),
m1 AS (SELECT *, CASE WHEN how = 'key' AND key_n >= 2 AND key <> bucket THEN 'k:' || key WHEN how = 'month' THEN 'm:' || month ELSE '' END AS split,
  CASE WHEN how = 'key' AND NOT (key_n >= 2 AND key <> bucket) THEN 1 ELSE 0 END AS rest, CASE WHEN how = 'key' AND key_n >= 2 AND key <> bucket THEN -key_n ELSE 0 END AS size_ord,
  CASE WHEN how = 'month' THEN month ELSE '' END AS month_ord FROM m0),
members AS (SELECT *, min(doc_ord) OVER (PARTITION BY bucket, split) AS cluster_id FROM m1)"""


def top(column: str, name: str, most: int) -> str:
    return f"""{name}_n AS (SELECT cluster_id, term, count(*) AS n, min(doc_ord * 100000 + pos) AS first FROM (SELECT cluster_id, doc_ord, unnest({column}) AS term, unnest(range(len({column}))) AS pos FROM members) GROUP BY cluster_id, term),
{name} AS (SELECT * FROM (SELECT cluster_id, term, n, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) AS rank FROM {name}_n) WHERE rank <= {most})"""


CLUSTERS = f"""{MEMBERS}, {top("tags", "hints", 8)}, {top("tokens", "anchors", 8)},
tk AS (SELECT cluster_id, title_key, count(*) AS n, min(doc_ord) AS first FROM members WHERE title_key <> '' GROUP BY cluster_id, title_key),
tks AS (SELECT cluster_id, count(*) AS title_keys FROM tk GROUP BY cluster_id),
tkt AS (SELECT cluster_id, title_key AS top_key FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) AS r FROM tk WHERE length(title_key) >= 2) WHERE r = 1),
hl AS (SELECT cluster_id, list(term ORDER BY rank) AS hints_hit FROM hints GROUP BY cluster_id),
al AS (SELECT cluster_id, list(term ORDER BY rank) AS anchor_terms FROM anchors GROUP BY cluster_id),
base AS (SELECT cluster_id, count(*) AS docs, list_sort(list_distinct(list(month))) AS months, min(bucket_ord) AS bucket_ord, min(rest) AS rest, min(size_ord) AS size_ord, min(month_ord) AS month_ord FROM members GROUP BY cluster_id),
c0 AS (SELECT base.*, coalesce(hints_hit, CAST([] AS VARCHAR[])) AS hints_hit, coalesce(anchor_terms, CAST([] AS VARCHAR[])) AS anchor_terms, coalesce(title_keys, 0) AS title_keys, top_key
  FROM base LEFT JOIN hl USING (cluster_id) LEFT JOIN al USING (cluster_id) LEFT JOIN tks USING (cluster_id) LEFT JOIN tkt USING (cluster_id)),
clusters AS (SELECT *, coalesce(hints_hit[1], top_key, nullif(array_to_string(anchor_terms[1:2], ' / '), ''), {q(K.UNSORTED)}) AS name,
  greatest(0, 100 - CASE WHEN docs = 1 THEN 25 ELSE 0 END - CASE WHEN len(anchor_terms) >= 6 THEN 10 ELSE 0 END - CASE WHEN len(list_filter(months, lambda m: m <> 'unknown')) >= 3 THEN 10 ELSE 0 END
   - CASE WHEN title_keys >= 4 THEN 10 ELSE 0 END - CASE WHEN len(hints_hit) = 0 THEN 8 ELSE 0 END) AS quality_score FROM c0),
planned AS (SELECT *, row_number() OVER (ORDER BY docs DESC, len(hints_hit) DESC, bucket_ord, rest, size_ord, month_ord, cluster_id) AS cluster_rank FROM clusters QUALIFY cluster_rank <= 5)"""

PAGES = f"""pages AS (SELECT CAST(page_ord AS BIGINT) AS page_ord, coalesce(file_name, '') AS file_name, coalesce(title, '') AS title, coalesce(nullif({strip("type")}, ''), 'unknown') AS page_type,
  {strings("tags")} AS tags, {strings("related")} AS related, coalesce(text, '') AS text FROM wiki_pages WHERE page_ord IS NOT NULL)"""

EDGES = f"""{PAGES},
edges AS (SELECT DISTINCT page_ord, title, unnest({wikilinks("text")}) AS target, 'body' AS kind FROM pages
  UNION ALL SELECT DISTINCT page_ord, title, replace(replace(unnest(related), '[[', ''), ']]', '') AS target, 'related' AS kind FROM pages),
inb AS (SELECT target AS title, count(DISTINCT page_ord) AS inbound FROM edges GROUP BY target),
pmap AS (SELECT title, max(page_ord) AS page_ord FROM pages GROUP BY title),
resolved AS (SELECT * FROM edges WHERE target IN (SELECT title FROM pmap))"""


def _hay(word: str) -> str:
    return f"max(CASE WHEN contains(hay, {q(word.lower())}) THEN 1 ELSE 0 END)"


def type_scores(source_type: str = "mixed") -> str:
    """Tables tr (title ranks), tagtypes and types (cluster_id, ptype, score, rank) of the planned clusters."""
    rows = []
    for t in K.TYPES:
        s = " + ".join([str(int(K.SOURCE_BONUS.get(source_type) == t)), *[f"2 * {_hay(w)}" for w in K.TYPE_KEYWORDS[t]]])
        rows.append(f"SELECT cluster_id, {q(t)} AS ptype, {s} + 4 * sum(CASE WHEN title_rank <= 3 AND {like('lower(title)', any_of(K.TITLE_MARKS[t]))} THEN 1 ELSE 0 END) AS score FROM tr GROUP BY cluster_id")
    types = ", ".join(q(t) for t in K.TYPES)
    return f"""tr AS (SELECT *, lower(concat_ws(chr(10), title, preview, array_to_string(tags[1:5], chr(10)), array_to_string(tokens[1:20], chr(10)))) AS hay FROM (
  SELECT m.*, row_number() OVER (PARTITION BY cluster_id ORDER BY title, doc_ord) AS title_rank FROM members m WHERE cluster_id IN (SELECT cluster_id FROM planned)) WHERE title_rank <= 6),
tagtypes AS (SELECT tag, ptype, count(*) AS n FROM (SELECT unnest(tags) AS tag, CASE WHEN page_type IN ({types}) THEN page_type ELSE 'guide' END AS ptype FROM pages) GROUP BY tag, ptype),
kw AS ({" UNION ALL ".join(rows)}),
hb AS (SELECT cluster_id, ptype, least(arg_min(tagtypes.n, rank), 3) AS boost FROM hints JOIN tagtypes ON term = tag WHERE cluster_id IN (SELECT cluster_id FROM planned) GROUP BY cluster_id, ptype),
nt AS (SELECT DISTINCT cluster_id, unnest({raw_tokens("name")}) AS tag FROM planned),
nb AS (SELECT cluster_id, ptype, 2 * count(*) AS boost FROM nt JOIN (SELECT tag, ptype FROM (SELECT *, sum(n) OVER (PARTITION BY tag) AS total FROM tagtypes) WHERE n * 2 >= total) USING (tag) GROUP BY cluster_id, ptype),
bo AS (SELECT cluster_id, ptype, sum(boost) AS boost FROM (SELECT * FROM hb UNION ALL SELECT * FROM nb) GROUP BY cluster_id, ptype),
types AS (SELECT cluster_id, ptype, score + coalesce(boost, 0) AS score, row_number() OVER (PARTITION BY cluster_id ORDER BY score + coalesce(boost, 0) DESC, ptype) AS rank FROM kw LEFT JOIN bo USING (cluster_id, ptype)),
best AS (SELECT cluster_id, max(score) AS best FROM types GROUP BY cluster_id),
cand AS (SELECT t.cluster_id, list(t.ptype ORDER BY t.rank) AS c FROM types t JOIN best USING (cluster_id) WHERE t.score >= greatest(best - 2, 1) GROUP BY t.cluster_id),
ptypes AS (SELECT cluster_id, best, CASE WHEN best <= 0 THEN ['guide', 'topic'] WHEN len(c) = 1 AND best < 4 AND c[1] <> 'guide' THEN list_append(c, 'guide') ELSE c[1:3] END AS candidates FROM best LEFT JOIN cand USING (cluster_id))"""


def scores() -> str:
    bonus = " ".join(f"WHEN c.c_type = {q(a)} AND p.page_type = {q(b)} THEN {v}" for a, row in K.TYPE_MATCH.items() for b, v in row.items())
    return f"""{CLUSTERS}, {EDGES}, {type_scores()},
pc AS (SELECT planned.*, candidates[1] AS c_type FROM planned JOIN ptypes USING (cluster_id)),
x AS (SELECT c.cluster_id, p.page_ord, p.title, CASE WHEN c.name <> '' AND contains(lower(p.title), lower(c.name)) THEN 8 ELSE 0 END
   + least(6, 3 * len(list_filter(c.hints_hit, lambda t: list_contains(p.tags, t) OR contains(lower(p.title), lower(t)))))
   + least(5, 2 * len(list_filter(c.anchor_terms, lambda t: contains(lower(p.title), t))))
   + CASE {bonus} ELSE 0 END + CASE WHEN coalesce(i.inbound, 0) >= 3 AND c.c_type IN ('concept', 'topic') THEN 1 ELSE 0 END AS score
  FROM pages p CROSS JOIN pc c LEFT JOIN inb i ON i.title = p.title),
scores AS (SELECT * FROM x WHERE score > 0)"""
