"""Queries of the corpus, link, ingest and scout operators, over whole tables, each beside its SQL.

A query's name starts with the operator's id. Results are scalars or joined strings, so that both engines give equal rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import oracle as O
from textloom.functions import constants as K
from textloom.functions import html as H
from textloom.functions import text as T
from textloom.operators import corpus, ingest, links, render, scout
from textloom.plans import pipeline
from textloom.shared import materialize, run_dir, spread
from textloom.sources import readers, writers


Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

HINTS = ("因子研究", "动量策略", "风险定价", "向量索引", "动量因子", "知识管理", "回撤控制、尾部对冲", "RAG/agent")
AS_OF = "2025-06-01"
BATCH = "20250601_砚谷数据"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "raw_docs"))


def wiki(spark: SparkSession, d: str) -> DataFrame:
    return links.pages(table(spark, d, "wiki_pages"))


def articles(spark: SparkSession, d: str) -> DataFrame:
    return ingest.once(table(spark, d, "articles"))


def joined(x: Column) -> Column:
    return F.array_join(x, " | ")


def n(x: Column) -> Column:
    return x.cast("long")


ARTICLES = "a AS (SELECT DISTINCT * FROM articles)"


# --- text functions over the stored documents, pages and articles ---


@query(f"SELECT doc_ord, {O.title('text', O.rr('regexp_extract(rel_path, ' + O.q('([^/]*)$') + ', 1)', r'\.md$'))} AS title FROM raw_docs")
def t1_title(spark, d):
    stem = F.regexp_replace(F.regexp_extract("rel_path", r"([^/]*)$", 1), r"\.md$", "")
    return raw(spark, d).select("doc_ord", T.title("text", stem).alias("title"))


@query(f"SELECT page_ord, {O.joined(O.field_list('text', 'tags'))} AS tags, {O.joined(O.field_list('text', 'related'))} AS related, {O.page_type('text')} AS page_type FROM wiki_pages")
def t2_t3_front_matter(spark, d):
    return table(spark, d, "wiki_pages").select("page_ord", joined(T.field_list("text", "tags")).alias("tags"), joined(T.field_list("text", "related")).alias("related"), T.page_type("text").alias("page_type"))


@query(f"SELECT doc_ord, {O.clean('text')} AS clean FROM raw_docs")
def t4_clean(spark, d):
    return raw(spark, d).select("doc_ord", T.clean_markdown("text").alias("clean"))


@query(f"SELECT term, CAST(count(*) AS BIGINT) AS n FROM (SELECT {O.normal_token('x')} AS term FROM (SELECT unnest(tokens) AS x FROM raw_docs)) WHERE term <> '' GROUP BY term")
def t5_normal_tokens(spark, d):
    return raw(spark, d).select(F.explode("tokens").alias("x")).select(T.normal_token("x").alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n"))


@query(f"SELECT term, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM (SELECT doc_id, unnest({O.tokens('text')}) AS term FROM documents) GROUP BY term")
def t6_t7_tokens(spark, d):
    x = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(T.tokens("text")).alias("term"))
    return x.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(O.key_sentences("raw_docs", "doc_ord", "text", 6).replace("pos FROM", "CAST_POS FROM").replace("unnest(range(len(ks))) AS CAST_POS", "CAST(unnest(range(len(ks))) AS BIGINT) AS pos"))
def t8_t9_key_sentences(spark, d):
    return raw(spark, d).select("doc_ord", F.posexplode(T.key_sentences("text", 6)).alias("pos", "sentence")).select("doc_ord", n(F.col("pos")).alias("pos"), "sentence")


@query(f"SELECT doc_ord, {O.title_key('title')} AS title_key FROM raw_docs")
def t10_title_key(spark, d):
    return raw(spark, d).select("doc_ord", T.title_key("title").alias("title_key"))


@query(f"SELECT doc_ord, substr({O.clean('text')}, 1, 600) AS preview FROM raw_docs")
def t11_preview(spark, d):
    return raw(spark, d).select("doc_ord", T.preview("text").alias("preview"))


_PARENT = f"regexp_extract(rel_path, {O.q('([^/]*)/[^/]*$')}, 1)"
_NAME = f"regexp_extract(rel_path, {O.q('([^/]*)$')}, 1)"
_DATED = f"regexp_replace({_NAME}, '^[0-9]+_', '')"


def _file_name() -> Column:
    """Stored names carry a number before the date; it is dropped here."""
    return F.regexp_replace(F.regexp_extract("rel_path", r"([^/]*)$", 1), "^[0-9]+_", "")


@query(
    f"SELECT doc_ord, CASE WHEN {O.like(_PARENT, '^[0-9]{4}-[0-9]{2}')} THEN {_PARENT} ELSE 'unknown' END AS month, "
    f"CASE WHEN {O.like(_DATED, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')} THEN substr({_DATED}, 1, 7) WHEN {O.like(_DATED, '^[0-9]{8}')} THEN substr({_DATED}, 1, 4) || '-' || substr({_DATED}, 5, 2) END AS file_month FROM raw_docs"
)
def t12_t13_months(spark, d):
    return raw(spark, d).select("doc_ord", T.month_of_path("rel_path").alias("month"), T.month_of_file(_file_name()).alias("file_month"))


@query(f"SELECT doc_ord, {O.slug('title')} AS slug, {O.file_name('title')} AS file_name, {O.strip('translate(lower(' + _NAME + '), ' + O.q('-_ ') + ', ' + O.q('') + ')')} AS norm FROM raw_docs")
def t14_t15_t17_names(spark, d):
    name = F.regexp_extract("rel_path", r"([^/]*)$", 1)
    return raw(spark, d).select("doc_ord", T.slug("title").alias("slug"), T.file_name("title").alias("file_name"), T.normal_name(name).alias("norm"))


@query(f"SELECT DISTINCT account, {O.strip('translate(account, ' + O.q('/' + chr(92)) + ', ' + O.q('__') + ')')} AS safe, translate(coalesce(account, ''), '/ ', '__') AS file FROM articles")
def t16_accounts(spark, d):
    return table(spark, d, "articles").select("account").distinct().select("account", T.account_name("account").alias("safe"), T.account_file_name("account").alias("file"))


@query(f"WITH {O.PAGES} SELECT page_ord, {O.joined(O.wikilinks('text'))} AS links, {O.joined(O.related_titles('related', 'title'))} AS related, 'related: [' || array_to_string({O.related_titles(O.field_list('text', 'related'), 'title')}, ', ') || ']' AS line FROM pages")
def t18_t19_t20_links(spark, d):
    return wiki(spark, d).select("page_ord", joined(T.wikilinks("text")).alias("links"), joined(T.related_titles(F.col("related"), F.col("title"))).alias("related"), T.related_line("text", F.col("title")).alias("line"))


@query(f"SELECT doc_ord, {O.like('preview', O.any_of(K.NEGATIVE))} AS negative, {O.like('preview', O.any_of(K.POSITIVE))} AS positive FROM raw_docs WHERE preview IS NOT NULL")
def t21_polarity(spark, d):
    x = raw(spark, d).where("preview IS NOT NULL")
    return x.select("doc_ord", T.is_negative(F.col("preview")).alias("negative"), T.is_positive(F.col("preview")).alias("positive"))


_HTML = "'<div id=\"js_content\"><h2>' || coalesce(title, '') || '</h2><script>var a = 1;</script><p>' || replace(coalesce(content_text, ''), chr(10), '</p><p class=\"x\">') || '</p><br/>&amp;&nbsp;&lt;b&gt;</div>'"


def _html() -> Column:
    """Articles as simple pages: the tables hold no HTML."""
    return F.concat(F.lit('<div id="js_content"><h2>'), F.coalesce("title", F.lit("")), F.lit("</h2><script>var a = 1;</script><p>"), F.replace(F.coalesce("content_text", F.lit("")), F.lit("\n"), F.lit('</p><p class="x">')), F.lit("</p><br/>&amp;&nbsp;&lt;b&gt;</div>"))


def _html_sql(x: str) -> str:
    for p, to in ((r"(?s)<script[^>]*>.*?</script>", ""), (r"(?s)<style[^>]*>.*?</style>", ""), (r"<br\s*/?>", "\n"), (r"</?p[^>]*>", "\n"), (r"</?div[^>]*>", "\n"), (r"<[^>]+>", ""), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), (r"\n{3,}", "\n\n")):
        x = O.rr(x, p, to)
    return O.strip(x)


@query(f"WITH {ARTICLES} SELECT ordinal, {_html_sql(_HTML)} AS text FROM a")
def t22_html_text(spark, d):
    return articles(spark, d).select("ordinal", T.html_text(_html()).alias("text"))


@query()
def t22_t23_html_dom(spark, d):
    return articles(spark, d).select("ordinal", H.html_dom_text(_html()).alias("text"), H.html_dom_markdown(_html()).alias("markdown"))


_VERIFY = O.any_of(K.VERIFY_MARKS)


@query(f"WITH {ARTICLES} SELECT ordinal, coalesce(content_text, '') = '' OR {O.like('coalesce(content_text, ' + O.q('') + ')', _VERIFY)} OR length({O.strip('content_text')}) < 100 AS verify FROM a")
def t24_verify_page(spark, d):
    return articles(spark, d).select("ordinal", T.is_verify_page("content_text").alias("verify"))


_CLEAN = f"{O.strip(O.rr('replace(coalesce(text, ' + O.q('') + '), ' + O.q('#< CLIXML') + ', ' + O.q('') + ')', chr(10) + '{3,}', chr(10) * 2))} || chr(10)"


@query(f"SELECT doc_ord, {_CLEAN} AS text, {_CLEAN} <> coalesce(text, '') AS changed FROM raw_docs")
def t25_clean_file(spark, d):
    return raw(spark, d).select("doc_ord", T.clean_file("text").alias("new"), "text").select("doc_ord", F.col("new").alias("text"), (F.col("new") != F.coalesce("text", F.lit(""))).alias("changed"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN {_CLEAN} <> coalesce(text, '') THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM raw_docs")
def t26_clean_totals(spark, d):
    return t25_clean_file(spark, d).agg(F.count("*").alias("total"), n(F.sum(F.col("changed").cast("int"))).alias("changed"))


@query(f"SELECT doc_ord, {O.body('text')} AS body, {O.source_of('text')} AS source FROM raw_docs")
def t27_s9_body_source(spark, d):
    return raw(spark, d).select("doc_ord", T.body("text").alias("body"), T.source_of("text").alias("source"))


_AT = f"instr(text, {O.section('text')})"
_REST = f"substr(text, {_AT} + length({O.section('text')}))"
_NEXT = f"length(regexp_extract({_REST}, {O.q('^((?s:.*?))' + chr(10) + '##' + K.WS)}, 1))"


@query(
    f"SELECT page_ord, {O.section('text')} AS section, CASE WHEN {_AT} > 0 THEN CAST({_AT} - 1 + length({O.section('text')}) AS BIGINT) END AS lo, "
    f"CASE WHEN {_AT} > 0 THEN CAST(CASE WHEN {O.like(_REST, chr(10) + '##' + K.WS)} THEN {_AT} - 1 + length({O.section('text')}) + {_NEXT} ELSE length(text) END AS BIGINT) END AS hi FROM wiki_pages WHERE text IS NOT NULL"
)
def t28_t29_sections(spark, d):
    s = T.backlink_section("text")
    x = table(spark, d, "wiki_pages").where("text IS NOT NULL")
    return x.select("page_ord", s.alias("section"), n(T.section_start("text", s)).alias("lo"), n(T.section_end("text", s)).alias("hi"))


_ITEMS = r"(?s)^((?:.*\n)?[ \t]*(?:[-*+] |[0-9]+\. )[^\n]*(?:\n|$)(?:[ \t\r]*\n)*(?:[ \t\r]+$)?)(.*)$"


def _section_sql_of(text: str, marker: str) -> str:
    """The marker's section as an expression."""
    rest = f"substr({text}, instr({text}, {marker}) + length({marker}))"
    return f"CASE WHEN {O.like(rest, chr(10) + '##' + K.WS)} THEN regexp_extract({rest}, {O.q('^((?s:.*?))' + chr(10) + '##' + K.WS)}, 1) ELSE {rest} END"


def _insert_sql(text: str, marker: str, line: str, sec: str = "sec") -> str:
    """T30 as an expression over a column sec that holds the marker's section."""
    at = f"(instr({text}, {marker}) - 1 + length({marker}))"
    bare = O.rr(O.rr(sec, "^[" + chr(13) + chr(10) + "]+"), K.WS + "+$")
    new = f"CASE WHEN {O.like(sec, '(?:^|' + chr(10) + ')[ ' + chr(9) + ']*(?:[-*+] |[0-9]+[.] )')} THEN regexp_extract({sec}, {O.q(_ITEMS)}, 1) || {line} || chr(10) || regexp_extract({sec}, {O.q(_ITEMS)}, 2) WHEN {bare} = '' THEN chr(10) || chr(10) || {line} || chr(10) ELSE regexp_extract({sec}, {O.q('^([' + chr(13) + chr(10) + ']*)')}, 1) || {bare} || chr(10) || chr(10) || {line} || chr(10) END"
    return f"CASE WHEN instr({text}, {marker}) = 0 THEN {text} ELSE substr({text}, 1, {at}) || ({new}) || substr({text}, {at} + length({sec}) + 1) END"


@query(f"WITH {O.PAGES}, m AS (SELECT *, {O.section('text')} AS marker FROM pages), ms AS (SELECT *, {_section_sql_of('text', 'marker')} AS sec FROM m) SELECT page_ord, {_insert_sql('text', 'marker', O.q('- 关联页：[[新页]]'))} AS text FROM ms")
def t30_insert_line(spark, d):
    s = T.backlink_section("text")
    return wiki(spark, d).select("page_ord", T.insert_in_section("text", s, F.lit("- 关联页：[[新页]]")).alias("text"))


@query("SELECT doc_ord, CASE WHEN s < 60 THEN format('{:.1f}', s) || '秒' WHEN s < 3600 THEN format('{:.1f}', s / 60) || '分钟' ELSE format('{:.1f}', s / 3600) || '小时' END AS duration FROM (SELECT doc_ord, CAST(length(text) * 4 AS DOUBLE) AS s FROM raw_docs WHERE text IS NOT NULL)")
def t31_duration(spark, d):
    return raw(spark, d).where("text IS NOT NULL").select("doc_ord", T.duration(F.length("text") * 4).alias("duration"))


@query("SELECT doc_ord, md5(text) AS md5 FROM raw_docs WHERE text IS NOT NULL")
def t32_md5(spark, d):
    return raw(spark, d).where("text IS NOT NULL").select("doc_ord", F.md5("text").alias("md5"))


# --- sources and sinks over tables ---


def _written(df: DataFrame, path: str, text: str) -> str:
    """The folder of files written from a table (K2)."""
    folder = f"{run_dir(df.sparkSession)}/files-{uuid.uuid4().hex}"
    writers.write_files(df, folder, path, text).write.format("noop").mode("overwrite").save()
    return folder


_STEM = f"regexp_replace(regexp_extract(rel_path, {O.q('([^/]*)$')}, 1), {O.q('[.]md$')}, '')"


@query(
    f"SELECT row_number() OVER (ORDER BY string_split(rel_path, '/')) - 1 AS doc_ord, rel_path, {O.title('text', _STEM)} AS title, CASE WHEN {O.like(f'regexp_extract(rel_path, {O.q("([^/]*)/[^/]*$")}, 1)', '^[0-9]{4}-[0-9]{2}')} THEN regexp_extract(rel_path, {O.q('([^/]*)/[^/]*$')}, 1) ELSE 'unknown' END AS month, "
    f"substr({O.clean('text')}, 1, 600) AS preview, {O.title_key(O.title('text', _STEM))} AS title_key, CAST(len({O.tokens('text')}) AS BIGINT) AS tokens, md5(text) AS md5 FROM raw_docs WHERE text IS NOT NULL AND rel_path IS NOT NULL"
)
def s1_s3_k2_t32_scan_files(spark, d):
    """The stored documents written as files, then read, ordered and derived from them."""
    files = readers.with_order(readers.markdown_files(spark, _written(raw(spark, d), "rel_path", "text")))
    x = corpus.derive(files, HINTS).join(files.select("doc_ord", "md5"), "doc_ord")
    return x.select("doc_ord", "rel_path", "title", "month", "preview", "title_key", n(F.size("tokens")).alias("tokens"), "md5")


@query(f"SELECT row_number() OVER (ORDER BY string_split(file_name, '/')) - 1 AS page_ord, file_name, {O.title('text', O.rr('file_name', '[.]md$'))} AS title, {O.page_type('text')} AS page_type, {O.joined(O.field_list('text', 'tags'))} AS tags, {O.joined(O.field_list('text', 'related'))} AS related FROM wiki_pages WHERE text IS NOT NULL AND file_name IS NOT NULL")
def s2_page_files(spark, d):
    """The pages written as files, then read (one folder, no subfolders), ordered and derived from them."""
    files = readers.with_order(readers.markdown_files(spark, _written(table(spark, d, "wiki_pages"), "file_name", "text"), recursive=False), "page_ord")
    return links.derive_pages(files.withColumnRenamed("name", "file_name")).select("page_ord", "file_name", "title", "page_type", joined(F.col("tags")).alias("tags"), joined(F.col("related")).alias("related"))


@query(f"SELECT DISTINCT {O.source_of('text')} AS link FROM raw_docs WHERE {O.source_of('text')} <> ''")
def s6_history_links(spark, d):
    return ingest.history_links(raw(spark, d))


_FILES = f"f AS (SELECT {O.strip('translate(lower(' + _NAME + '), ' + O.q('-_ ') + ', ' + O.q('') + ')')} AS norm, {_NAME} AS name, rel_path AS path, modified_at AS mtime, md5(coalesce(text, '')) AS md5, doc_ord AS ord FROM raw_docs)"


def _files(spark, d) -> DataFrame:
    return raw(spark, d).select(F.regexp_extract("rel_path", r"([^/]*)$", 1).alias("name"), F.col("rel_path").alias("path"), F.col("modified_at").alias("mtime"), F.md5(F.coalesce("text", F.lit(""))).alias("md5"), F.col("doc_ord").alias("ord"))


@query(f"WITH {_FILES} SELECT norm, path, md5 FROM f QUALIFY row_number() OVER (PARTITION BY norm ORDER BY mtime DESC NULLS LAST, path DESC, md5 DESC) = 1")
def s7_history_files(spark, d):
    return ingest.history_files(_files(spark, d))


@query(f"WITH {_FILES} SELECT path, CAST(epoch(mtime) AS BIGINT) AS mtime FROM f WHERE {O.like('name', '^.*2024-0.*[.]md$')} QUALIFY row_number() OVER (ORDER BY f.mtime DESC, path DESC) = 1")
def s5_latest_file(spark, d):
    return ingest.latest_file(_files(spark, d), "*2024-0*.md").select("path", F.unix_timestamp("mtime").alias("mtime"))


@query(f"WITH {O.PAGES} SELECT page_type, CAST(count(*) AS BIGINT) AS n FROM pages GROUP BY page_type")
def k3_a9_index_types(spark, d):
    return links.index_types(wiki(spark, d))


@query(f"WITH {O.PAGES} SELECT file_name, '- **' || title || '** (' || page_type || ') - `wiki/' || file_name || '`' AS line FROM pages")
def k3_index_lines(spark, d):
    return links.index_lines(wiki(spark, d))


_EXPORT = f"""WITH {ARTICLES}, x AS (SELECT ordinal, account, coalesce(title, '无标题') AS title, coalesce(link, '') AS link, coalesce(nullif(content_markdown, ''), nullif(content_text, ''), nullif(content, '')) AS content, to_timestamp(coalesce(create_time, 0)) AT TIME ZONE 'UTC' AS ts FROM a),
y AS (SELECT *, {O.file_name("account")} || '/' || strftime(ts, '%Y-%m') AS folder, strftime(ts, '%Y-%m-%d') || '_' || {O.file_name("title")} AS stem FROM x WHERE content IS NOT NULL),
z AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY ordinal) - 1 AS k FROM y)
SELECT ordinal, folder, stem || CASE WHEN k > 0 THEN '_' || k ELSE '' END || '.md' AS file_name,
 '---' || chr(10) || 'title: "' || title || '"' || chr(10) || 'date: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || chr(10) || 'source: ' || link || chr(10) || 'account: ' || coalesce(account, '') || chr(10) || '---' || chr(10) || chr(10) || content || chr(10) AS markdown FROM z"""


@query(_EXPORT)
def k9_markdown_export(spark, d):
    return ingest.markdown_export(articles(spark, d))


@query("SELECT doc_ord, CASE WHEN starts_with(path, '/srv/kb/') THEN substr(path, 9) ELSE path END AS shown FROM raw_docs")
def k12_display_path(spark, d):
    return raw(spark, d).select("doc_ord", T.display_path(F.col("path"), F.lit("/srv/kb")).alias("shown"))


# --- filters and joins of the ingest ---

_HAY = "lower(concat_ws(' ', coalesce(title, ''), coalesce(digest, ''), coalesce(content, ''), coalesce(content_text, ''), coalesce(content_markdown, '')))"


@query(f"WITH {ARTICLES} SELECT ordinal FROM a WHERE contains({_HAY}, '动量') OR contains({_HAY}, 'hedging')")
def f1_keywords(spark, d):
    return ingest.keyword_filter(articles(spark, d), ["动量", "Hedging", " "]).select("ordinal")


_TIME = "coalesce(nullif(update_time, 0), nullif(create_time, 0))"


@query(f"WITH {ARTICLES} SELECT ordinal, CAST({_TIME} AS BIGINT) AS ts FROM a WHERE {_TIME} > 0 AND {_TIME} <= epoch(TIMESTAMP '2024-01-31') + 86399")
def f2_until(spark, d):
    return ingest.until_filter(articles(spark, d), "2024-01-31").select("ordinal", ingest.article_time().alias("ts"))


@query(f"WITH {ARTICLES}, s AS (SELECT account, min(ordinal) AS stop FROM a WHERE coalesce(update_time, 0) < epoch(TIMESTAMP '2022-12-01') GROUP BY account) SELECT a.ordinal, a.account FROM a LEFT JOIN s ON a.account IS NOT DISTINCT FROM s.account WHERE stop IS NULL OR ordinal < stop")
def f3_since_take_while(spark, d):
    return ingest.since_take_while(articles(spark, d), "2022-12-01").select("ordinal", "account")


@query(f"WITH {ARTICLES} SELECT account, ordinal FROM a QUALIFY row_number() OVER (PARTITION BY account ORDER BY ordinal) <= 3")
def f4_cap(spark, d):
    return ingest.cap(articles(spark, d), 3).select("account", "ordinal")


@query(f"SELECT doc_ord, NOT (b = '' OR {O.like('b', _VERIFY)} OR length(b) < 100) AS passed FROM (SELECT doc_ord, {O.body('text')} AS b FROM raw_docs)")
def f5_quality_gate(spark, d):
    return ingest.quality(raw(spark, d)).select("doc_ord", "passed")


@query(f"SELECT doc_ord, {O.like(_NAME, K.CANONICAL_NAME)} AS canonical, {O.like(_DATED, K.CANONICAL_NAME)} AS dated FROM raw_docs")
def f6_canonical_name(spark, d):
    name = F.regexp_extract("rel_path", r"([^/]*)$", 1)
    return raw(spark, d).select("doc_ord", F.regexp_like(name, F.lit(K.CANONICAL_NAME)).alias("canonical"), F.regexp_like(_file_name(), F.lit(K.CANONICAL_NAME)).alias("dated"))


_HIST = f"h AS (SELECT DISTINCT {O.source_of('text')} AS link FROM raw_docs WHERE {O.source_of('text')} <> '' UNION SELECT {O.link()} FROM articles WHERE batch_no <= 12 AND {O.link()} <> '')"


def _history(spark, d) -> DataFrame:
    old = table(spark, d, "articles").where("batch_no <= 12").select(ingest.article_link().alias("link")).where("link <> ''")
    return ingest.history_links(raw(spark, d)).unionByName(old).distinct()


@query(f"WITH {ARTICLES}, {_HIST} SELECT ordinal FROM a WHERE batch_no > 12 AND {O.link()} NOT IN (SELECT link FROM h)")
def j8_new_articles(spark, d):
    return ingest.split_new(articles(spark, d).where("batch_no > 12"), _history(spark, d))[0].select("ordinal")


@query(f"WITH {ARTICLES}, {_HIST} SELECT ordinal FROM a WHERE batch_no > 12 AND {O.link()} IN (SELECT link FROM h)")
def j8_skipped_articles(spark, d):
    return ingest.split_new(articles(spark, d).where("batch_no > 12"), _history(spark, d))[1].select("ordinal")


_INCOMING = f"""i AS (SELECT doc_ord AS ord, regexp_replace({_DATED}, '_.*(.)[.]md$', '_\\1.md') AS name, md5(coalesce(title_key, '')) AS md5, modified_at FROM raw_docs),
n AS (SELECT *, {O.strip("translate(lower(name), '-_ ', '')")} AS norm, {O.like("name", K.CANONICAL_NAME)} AS canonical FROM i),
hist AS (SELECT norm, arg_max(md5, ord) AS hmd5 FROM n WHERE modified_at < TIMESTAMP '2024-07-01' GROUP BY norm)"""


@query(
    f"""WITH {_INCOMING}, w AS (SELECT n.*, coalesce(last_value(CASE WHEN canonical THEN md5 END IGNORE NULLS) OVER (PARTITION BY n.norm ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), hmd5) AS before FROM n LEFT JOIN hist USING (norm) WHERE modified_at >= TIMESTAMP '2024-07-01')
SELECT ord, name, CASE WHEN coalesce(md5 = before, false) THEN 'duplicate' WHEN NOT canonical THEN 'bad_name' ELSE 'sync' END AS action,
 CASE WHEN {O.like("name", "^[0-9]{4}-[0-9]{2}-[0-9]{2}")} THEN substr(name, 1, 7) WHEN {O.like("name", "^[0-9]{8}")} THEN substr(name, 1, 4) || '-' || substr(name, 5, 2) END AS month FROM w"""
)
def j9_u3_sync_plan(spark, d):
    x = raw(spark, d).select(F.col("doc_ord").alias("ord"), F.regexp_replace(_file_name(), r"_.*(.)[.]md$", "_$1.md").alias("name"), F.md5(F.coalesce("title_key", F.lit(""))).alias("md5"), "modified_at")
    h = x.where("modified_at < timestamp'2024-07-01'").withColumn("norm", T.normal_name("name")).groupBy("norm").agg(F.max_by("md5", "ord").alias("md5"))
    return ingest.sync_plan(x.where("modified_at >= timestamp'2024-07-01'"), h).select("ord", "name", "action", "month")


_SYNC = _SQL["j9_u3_sync_plan"]


@query(f"WITH x AS ({_SYNC}) SELECT action, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY action UNION ALL SELECT 'total', CAST(count(*) AS BIGINT) FROM x")
def k8_report_totals(spark, d):
    return ingest.report_totals(j9_u3_sync_plan(spark, d))


@query(f"SELECT ord, action, CAST(seq AS BIGINT) AS seq FROM (SELECT ord, action, row_number() OVER (PARTITION BY action ORDER BY ord) AS seq FROM ({_SYNC})) WHERE seq <= 50")
def k8_report_rows(spark, d):
    return ingest.report_rows(j9_u3_sync_plan(spark, d)).select("ord", "action", n(F.col("seq")).alias("seq"))


@query(f"WITH {ARTICLES}, {_HIST}, x AS (SELECT account, CASE WHEN {O.link()} IN (SELECT link FROM h) THEN 0 ELSE 1 END AS n FROM a WHERE batch_no > 12) SELECT account, CAST(sum(n) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS original_total, CAST(count(*) - sum(n) AS BIGINT) AS skipped_historical, '2025-06-01' AS filtered_at, '动量' AS keywords FROM x GROUP BY account")
def k11_filtered_headers(spark, d):
    new, skipped = ingest.split_new(articles(spark, d).where("batch_no > 12"), _history(spark, d))
    return writers.filtered_header(new, skipped, ("动量",), AS_OF).withColumn("keywords", joined(F.col("keywords")))


@query(f"WITH {ARTICLES} SELECT account, 'progress_' || translate(account, '/ ', '__') || '.json' AS file_name, '2024-01-01' AS since_date, CAST(200 AS BIGINT) AS max_articles, CAST(count(*) AS BIGINT) AS fetched_count, '2025-06-01' AS updated_at FROM a WHERE account IS NOT NULL GROUP BY account")
def w8_progress(spark, d):
    x = ingest.progress_rows(articles(spark, d), "2024-01-01", 200, AS_OF)
    return x.withColumn("max_articles", n(F.col("max_articles")))


@query(f"WITH {ARTICLES} SELECT account, CAST(sum(CASE WHEN batch_no <= 20 THEN 1 ELSE 0 END) AS BIGINT) AS fetched_count FROM a WHERE account IS NOT NULL GROUP BY account HAVING min(batch_no) <= 20 AND max(batch_no) <= 23")
def w5_w8_resumable(spark, d):
    """Progress after 20 batches, cleared for the accounts of the last one: what a run with the same settings goes on with."""
    a = articles(spark, d)
    saved = ingest.save_progress(ingest.progress_rows(a.where("batch_no <= 3"), "2024-01-01", 200, AS_OF), ingest.progress_rows(a.where("batch_no <= 20"), "2024-01-01", 200, AS_OF))
    return ingest.resumable(ingest.clear_progress(saved, a.where("batch_no > 23").select("account")), "2024-01-01", 200).select("account", "fetched_count")


@query("WITH x AS (SELECT DISTINCT account FROM articles) SELECT x.account, strftime(coalesce(CAST(last_success_timestamp AS DATE) - INTERVAL 1 DAY, DATE '2025-06-01' - INTERVAL 14 DAY), '%Y-%m-%d') AS since FROM x LEFT JOIN ingest_state s ON x.account = s.account")
def w1_since(spark, d):
    return ingest.since_dates(table(spark, d, "articles").select("account").distinct(), table(spark, d, "ingest_state"), AS_OF)


_RUNS = "r AS (SELECT account, batch_no % 5 <> 0 AS ok, max(crawled_at) AS ts, 'batch_' || batch_no AS dir, count(DISTINCT ordinal) AS n, 'reason ' || batch_no AS reason FROM articles WHERE account IS NOT NULL GROUP BY account, batch_no)"


@query(
    f"""WITH {_RUNS}, d AS (SELECT account, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS s, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS f, sum(CASE WHEN ok THEN n ELSE 0 END) AS n, arg_max(dir, (ts, dir)) FILTER (WHERE ok) AS dir, arg_max(reason, (ts, reason)) FILTER (WHERE NOT ok) AS reason FROM r GROUP BY account)
SELECT account, coalesce(d.dir, last_batch_dir) AS last_batch_dir, CAST(coalesce(total_articles_ever, 0) + coalesce(n, 0) AS BIGINT) AS total_articles_ever, CAST(coalesce(success_count, 0) + coalesce(s, 0) AS BIGINT) AS success_count,
 CAST(coalesce(failure_count, 0) + coalesce(f, 0) AS BIGINT) AS failure_count, coalesce(d.reason, last_failure_reason) AS last_failure_reason FROM ingest_state FULL JOIN d USING (account)"""
)
def w3_counters(spark, d):
    x = table(spark, d, "articles").where("account IS NOT NULL").groupBy("account", "batch_no").agg(F.max("crawled_at").alias("at"), F.countDistinct("ordinal").alias("new_articles"))
    b = F.col("batch_no").cast("string")
    runs = x.select("account", (F.col("batch_no") % 5 != 0).alias("ok"), "at", F.concat(F.lit("batch_"), b).alias("batch_dir"), "new_articles", F.concat(F.lit("reason "), b).alias("reason"))
    s = ingest.update_state(table(spark, d, "ingest_state"), runs)
    return s.select("account", "last_batch_dir", "total_articles_ever", n(F.col("success_count")).alias("success_count"), n(F.col("failure_count")).alias("failure_count"), "last_failure_reason")


@query(f"WITH {ARTICLES} SELECT account, CAST(count(*) AS BIGINT) AS articles, CAST(ceil(count(*) / 100.0) AS BIGINT) AS batches FROM a GROUP BY account")
def w6_batch_plan(spark, d):
    return ingest.batch_plan(articles(spark, d))


@query(f"WITH {ARTICLES}, x AS (SELECT coalesce(nullif(content_text, ''), content, '') AS t FROM a) SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(CASE WHEN t = '' OR {O.like('t', _VERIFY)} OR length({O.strip('t')}) < 100 THEN 0 ELSE 1 END) AS BIGINT) AS success FROM x")
def a11_crawl_totals(spark, d):
    return ingest.crawl_totals(articles(spark, d)).select("total", "success")


# --- documents and clusters ---


def _members(spark, d) -> DataFrame:
    return corpus.assign(corpus.documents(raw(spark, d)))


def _hint_sql() -> str:
    import re

    rows = []
    for h in HINTS:
        low = h.lower()
        pieces = [p for p in re.split(r"[、，,\s/]+", low) if len(p) >= 2]
        s = f"CASE WHEN contains(t, {O.q(low)}) THEN 4 ELSE 0 END + CASE WHEN contains(p, {O.q(low)}) THEN 2 ELSE 0 END" + "".join(f" + CASE WHEN contains(t || chr(10) || p, {O.q(x)}) THEN 1 ELSE 0 END" for x in pieces)
        rows.append(f"SELECT doc_ord, {O.q(h)} AS hint, CAST({s} AS BIGINT) AS score FROM l")
    return f"WITH l AS (SELECT doc_ord, lower(coalesce(title, '')) AS t, lower(coalesce(preview, '')) AS p FROM raw_docs) SELECT * FROM ({' UNION ALL '.join(rows)}) WHERE score > 0"


@query(_hint_sql())
def r1_j1_hint_scores(spark, d):
    x = raw(spark, d).select("doc_ord", F.explode(corpus.hint_scores(F.col("title"), F.col("preview"), HINTS)).alias("hint", "score"))
    return x.select("doc_ord", "hint", n(F.col("score")).alias("score"))


@query(f"WITH s AS ({_hint_sql()}) SELECT doc_ord, string_agg(hint, ' | ' ORDER BY score DESC, hint) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY doc_ord ORDER BY score DESC, hint) AS r FROM s) WHERE r <= 5 GROUP BY doc_ord")
def o1_tags(spark, d):
    return raw(spark, d).select("doc_ord", joined(corpus.top_hints(corpus.hint_scores(F.col("title"), F.col("preview"), HINTS))).alias("tags")).where("tags <> ''")


@query(f"WITH {O.MEMBERS} SELECT doc_ord, bucket, split, cluster_id FROM members")
def c1_c2_assign(spark, d):
    return _members(spark, d).select("doc_ord", "bucket", "split", "cluster_id")


@query(f"WITH {O.MEMBERS}, {O.top('tokens', 'anchors', 8)} SELECT cluster_id, CAST(rank AS BIGINT) AS rank, term, CAST(n AS BIGINT) AS n FROM anchors")
def a1_anchor_terms(spark, d):
    return corpus.top_terms(_members(spark, d), "tokens", ["cluster_id"], 8).select("cluster_id", n(F.col("rank")).alias("rank"), "term", "n")


@query(f"WITH {O.MEMBERS}, {O.top('tags', 'hints', 8)} SELECT cluster_id, CAST(rank AS BIGINT) AS rank, term, CAST(n AS BIGINT) AS n FROM hints")
def a2_hint_frequency(spark, d):
    return corpus.top_terms(_members(spark, d), "tags", ["cluster_id"], 8).select("cluster_id", n(F.col("rank")).alias("rank"), "term", "n")


@query(f"WITH {O.CLUSTERS} SELECT cluster_id, name, CAST(docs AS BIGINT) AS docs, {O.joined('months')} AS months, {O.joined('hints_hit')} AS hints, {O.joined('anchor_terms')} AS anchors, CAST(quality_score AS BIGINT) AS quality FROM clusters")
def c3_c4_c5_a3_a6_clusters(spark, d):
    c = corpus.cluster_table(_members(spark, d))
    return c.select("cluster_id", "name", "docs", joined(F.col("months")).alias("months"), joined(F.col("hints_hit")).alias("hints"), joined(F.col("anchor_terms")).alias("anchors"), n(F.col("quality_score")).alias("quality"))


@query(
    f"WITH {O.CLUSTERS} SELECT cluster_id, '该专题聚合了 ' || docs || ' 篇 raw，主要围绕“' || name || '”，覆盖时间 ' || coalesce(nullif(array_to_string(list_filter(months, lambda m: m <> 'unknown')[1:3], '、'), ''), '多批次') || '，高频锚点包括 ' || CASE WHEN len(anchor_terms) > 0 THEN array_to_string(anchor_terms[1:4], '、') ELSE name END || '。' AS summary FROM clusters"
)
def t35_summaries(spark, d):
    return corpus.summaries(corpus.cluster_table(_members(spark, d)))


@query(
    f"""WITH {O.MEMBERS}, e AS (SELECT cluster_id, term, count(*) AS n, min((title, doc_ord, pos)) AS first FROM (SELECT cluster_id, title, doc_ord, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM members) WHERE length(term) >= 2 GROUP BY cluster_id, term HAVING count(*) >= 2)
SELECT cluster_id, CAST(rank AS BIGINT) AS rank, term, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY first) AS rank FROM e) WHERE rank <= 3"""
)
def a4_consensus(spark, d):
    return corpus.consensus(_members(spark, d)).select("cluster_id", n(F.col("rank")).alias("rank"), "term", "n")


@query(
    f"""WITH {O.MEMBERS}, k AS (SELECT cluster_id, title_key AS point, count(*) AS n, min((title, doc_ord)) AS first FROM members WHERE title_key <> '' GROUP BY cluster_id, title_key),
k2 AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS kinds, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) AS rank FROM k)
SELECT cluster_id, CAST(rank AS BIGINT) AS rank, point, CAST(n AS BIGINT) AS n FROM k2 WHERE kinds >= 2 AND rank <= 2
UNION ALL SELECT cluster_id, 3, min(month) || '~' || max(month), NULL FROM members WHERE month <> 'unknown' GROUP BY cluster_id HAVING min(month) <> max(month)"""
)
def a5_divergence(spark, d):
    return corpus.divergence(_members(spark, d)).select("cluster_id", n(F.col("rank")).alias("rank"), "point", "n")


@query(f"WITH {O.CLUSTERS} SELECT CAST(cluster_rank AS BIGINT) AS cluster_rank, cluster_id, name, CAST(docs AS BIGINT) AS docs FROM planned")
def o2_o7_planned(spark, d):
    return corpus.planned(raw(spark, d))[0].select(n(F.col("cluster_rank")).alias("cluster_rank"), "cluster_id", "name", "docs")


@query(f"WITH {O.CLUSTERS}, {O.PAGES}, {O.type_scores()} SELECT cluster_id, ptype, CAST(score AS BIGINT) AS score, CAST(rank AS BIGINT) AS rank FROM types")
def j10_p1_p2_type_scores(spark, d):
    p = wiki(spark, d)
    top, members = corpus.planned(raw(spark, d), p)
    s = corpus.type_scores(members, top.select("cluster_id", "name", "hints_hit"), p)
    return s.select("cluster_id", "ptype", n(F.col("score")).alias("score"), n(F.col("rank")).alias("rank"))


@query(f"WITH {O.CLUSTERS}, {O.PAGES}, {O.type_scores()} SELECT cluster_id, candidates[1] AS page_type, {O.joined('candidates')} AS candidates FROM ptypes")
def o8_p3_page_types(spark, d):
    return corpus.planned(raw(spark, d), wiki(spark, d))[0].select("cluster_id", "page_type", joined(F.col("candidates")).alias("candidates"))


@query(f"WITH {O.PAGES} SELECT tag, ptype, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(tags) AS tag, CASE WHEN page_type IN ('guide', 'topic', 'strategy', 'concept', 'paper') THEN page_type ELSE 'guide' END AS ptype FROM pages) GROUP BY tag, ptype")
def a8_tag_types(spark, d):
    return corpus.tag_types(wiki(spark, d))


def _breakdown_sql() -> str:
    rows = []
    for t in K.TYPES:
        words = ", ".join(f"CASE WHEN max(CASE WHEN contains(hay, {O.q(w.lower())}) THEN 1 ELSE 0 END) = 1 THEN {O.q(K.HIT_WORD.format(w))} END" for w in K.TYPE_KEYWORDS[t])
        marks = f"sum(CASE WHEN title_rank <= 3 AND {O.like('lower(title)', O.any_of(K.TITLE_MARKS[t]))} THEN 1 ELSE 0 END)"
        rows.append(f"SELECT cluster_id, {O.q(t)} AS ptype, list_concat(list_filter([{words}], lambda x: x IS NOT NULL), list_transform(range(CAST({marks} AS BIGINT)), lambda i: {O.q(K.HIT_TITLE.format(K.TITLE_MARKS[t][0]))})) AS hits FROM tr GROUP BY cluster_id")
    return f"""WITH {O.CLUSTERS}, {O.PAGES}, {O.type_scores()}, hw AS ({" UNION ALL ".join(rows)}),
ht AS (SELECT cluster_id, ptype, types.score, rank, CASE WHEN boost IS NULL THEN hits ELSE list_append(hits, {O.q(K.HIT_TAGS)} || CAST(boost AS BIGINT)) END AS hits FROM types JOIN hw USING (cluster_id, ptype) LEFT JOIN bo USING (cluster_id, ptype)),
hx AS (SELECT cluster_id, string_agg('- **' || ptype || '**: ' || CAST(score AS BIGINT) || {O.q(K.POINTS)} || CASE WHEN len(hits) > 0 THEN array_to_string(hits, '、') ELSE {O.q(K.NO_HIT)} END, chr(10) ORDER BY rank) AS lines,
  max(CASE WHEN rank = 1 THEN score END) AS one, max(CASE WHEN rank = 2 THEN score END) AS two, max(CASE WHEN rank = 1 THEN ptype END) AS best_type FROM ht GROUP BY cluster_id)
SELECT cluster_id, CASE WHEN one <= 0 THEN {O.q(K.NO_SCORE)} ELSE {O.q(K.BREAKDOWN)} || chr(10) || lines || chr(10) || {O.q(K.BEST_TYPE)} || best_type || {O.q(K.LEAD)} || CAST(one - two AS BIGINT) || ')' END AS breakdown FROM hx"""


@query(_breakdown_sql())
def type_breakdown_p4(spark, d):
    p = wiki(spark, d)
    top, members = corpus.planned(raw(spark, d), p)
    return corpus.type_breakdown(corpus.type_scores(members, top.select("cluster_id", "name", "hints_hit"), p))


_SUFFIX = " ".join(f"WHEN pt = {O.q(t)} THEN {O.q(s)}" for t, s in K.TYPE_SUFFIX.items())
_TITLES = f"""SELECT *, '砚谷数据：' || CASE WHEN {O.like("base", "(?:" + O.any_of(K.TITLE_ENDS) + ")$")} THEN base ELSE base || CASE {_SUFFIX} ELSE '专题' END END
 || CASE len(known) WHEN 0 THEN '' WHEN 1 THEN '（' || known[1] || '）' ELSE '（' || known[1] || '~' || known[-1] || '）' END AS page_title
FROM (SELECT planned.*, candidates[1] AS pt, coalesce(nullif({O.rr("name", "^[-—_ ]+|[-—_ ]+$")}, ''), {O.q(K.UNSORTED)}) AS base, list_filter(months, lambda m: m <> 'unknown') AS known FROM planned JOIN ptypes USING (cluster_id))"""


@query(f"WITH {O.CLUSTERS}, {O.PAGES}, {O.type_scores()} SELECT cluster_id, page_title AS title FROM ({_TITLES})")
def t33_page_titles(spark, d):
    top = corpus.planned(raw(spark, d), wiki(spark, d))[0]
    return top.select("cluster_id", corpus.page_title(F.col("name"), F.col("page_type"), F.col("months"), BATCH).alias("title"))


def _section_sql() -> str:
    tests = " UNION ALL ".join(f"SELECT cluster_id, {O.q(s)} AS section, title_rank, pos, sentence FROM sk WHERE pt = {O.q(t)} AND {O.like('sentence', O.any_of(ws))}" for t, sec in K.SECTION_KEYWORDS.items() for s, ws in sec.items())
    return f"""WITH {O.CLUSTERS}, {O.PAGES}, {O.type_scores()},
t10 AS (SELECT * FROM (SELECT m.cluster_id, candidates[1] AS pt, coalesce(nullif(text, ''), preview) AS x, row_number() OVER (PARTITION BY m.cluster_id ORDER BY title, doc_ord) AS title_rank FROM members m JOIN ptypes USING (cluster_id)) WHERE title_rank <= 10),
sk AS ({O.key_sentences("t10", "cluster_id, pt, title_rank", "x", 15)}),
one AS (SELECT cluster_id, section, sentence, min((title_rank, pos)) AS first FROM ({tests}) GROUP BY cluster_id, section, sentence)
SELECT cluster_id, section, CAST(rank AS BIGINT) AS rank, sentence FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, section ORDER BY first) AS rank FROM one) WHERE rank <= 3"""


@query(_section_sql())
def r10_section_content(spark, d):
    top, members = corpus.planned(raw(spark, d), wiki(spark, d))
    return corpus.section_content(members, top).select("cluster_id", "section", n(F.col("rank")).alias("rank"), "sentence")


# --- link graph, scores, health, repair ---


@query(f"WITH {O.EDGES} SELECT page_ord, target, kind FROM edges")
def g1_g2_edges(spark, d):
    return links.edges(wiki(spark, d)).select("page_ord", "target", "kind")


@query(f"WITH {O.EDGES} SELECT title AS target, CAST(inbound AS BIGINT) AS inbound FROM inb")
def a7_g3_inbound(spark, d):
    return links.inbound(links.edges(wiki(spark, d)))


@query(f"WITH {O.EDGES} SELECT page_ord, pages.title, CAST(coalesce(inbound, 0) AS BIGINT) AS inbound_refs FROM pages LEFT JOIN inb USING (title)")
def j7_page_inbound(spark, d):
    return links.with_inbound(wiki(spark, d)).select("page_ord", "title", "inbound_refs")


@query(f"WITH {O.EDGES} SELECT DISTINCT page_ord, target FROM resolved")
def j4_resolved_links(spark, d):
    p = wiki(spark, d)
    return links.edges(p).join(links.page_map(p).select(F.col("title").alias("target")), "target", "left_semi").select("page_ord", "target").distinct()


@query(f"WITH {O.PAGES} SELECT title, max(page_ord) AS page_ord FROM pages GROUP BY title")
def j14_page_map(spark, d):
    return links.page_map(wiki(spark, d))


_INDEX = "# Index\n- `wiki/去重流程疑问2.md`\n"
_LOG = "# Log\n- [[智能体编排对比1]]\n- `wiki/去重流程疑问2.md`\n"
_HEALTH = f"""{O.EDGES}, kk AS ({O.key_sentences("pages", "page_ord", "text", 2)}), kn AS (SELECT page_ord, count(*) AS n FROM kk GROUP BY page_ord),
lk AS (SELECT DISTINCT page_ord, title, target FROM resolved WHERE target <> title), bk AS (SELECT DISTINCT e.title, e.target FROM edges e JOIN pmap USING (page_ord)),
issues AS (
 SELECT 'missing_related_field' AS kind, title AS page_title, CAST(NULL AS VARCHAR) AS target_title, page_ord FROM pages WHERE starts_with(text, '---' || chr(10)) AND NOT {O.like("text", f"(?m)^related:{K.WS}*" + r"\[.*\]" + f"{K.WS}*$")}
 UNION ALL SELECT 'missing_type_field', title, NULL, page_ord FROM pages WHERE starts_with(text, '---' || chr(10)) AND NOT {O.like("text", f"(?m)^type:{K.WS}*" + '"?.+?"?$')}
 UNION ALL SELECT 'island', title, NULL, page_ord FROM pages WHERE len(related) = 0 AND title NOT IN (SELECT title FROM inb) AND page_ord NOT IN (SELECT page_ord FROM resolved)
 UNION ALL SELECT 'pseudo', title, NULL, page_ord FROM pages LEFT JOIN kn USING (page_ord) WHERE len(related) = 0 AND len({O.wikilinks("text")}) = 0 AND coalesce(n, 0) < 2
 UNION ALL SELECT 'one_way', title, target, page_ord FROM lk WHERE (title, target) NOT IN (SELECT (target, title) FROM bk)
 UNION ALL SELECT 'related_missing', title, target, page_ord FROM resolved r WHERE kind = 'body' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'related' AND e.page_ord = r.page_ord AND e.target = r.target)
 UNION ALL SELECT 'body_missing', title, target, page_ord FROM resolved r WHERE kind = 'related' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.kind = 'body' AND e.page_ord = r.page_ord AND e.target = r.target)
 UNION ALL SELECT 'index_missing', title, NULL, page_ord FROM pages WHERE NOT contains({O.q(_INDEX)}, '`wiki/' || file_name || '`')
 UNION ALL SELECT 'log_missing', title, NULL, page_ord FROM pages WHERE NOT (contains({O.q(_LOG)}, '`wiki/' || file_name || '`') OR contains({O.q(_LOG)}, '`wiki/' || {O.slug("title")} || '.md`') OR contains({O.q(_LOG)}, '[[' || title || ']]')))"""


def _issues(spark, d) -> DataFrame:
    return links.health_issues(wiki(spark, d), _INDEX, _LOG)


@query(f"WITH {_HEALTH} SELECT * FROM issues")
def h1_h10_j5_j6_j13_health(spark, d):
    return _issues(spark, d)


@query(f"WITH {_HEALTH}, k AS (SELECT unnest([{', '.join(O.q(k) for k in links.HEALTH_KINDS)}]) AS kind) SELECT kind, CAST(count(issues.kind) AS BIGINT) AS n FROM k LEFT JOIN issues USING (kind) GROUP BY kind")
def k7_a10_health_totals(spark, d):
    return links.health_totals(_issues(spark, d))


@query(f"WITH {_HEALTH} SELECT kind, page_ord, target_title, CAST(seq AS BIGINT) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY page_ord, target_title NULLS FIRST) AS seq FROM issues) WHERE seq <= 30")
def k7_o10_health_report(spark, d):
    return links.report_rows(_issues(spark, d)).select("kind", "page_ord", "target_title", n(F.col("seq")).alias("seq"))


_SCORES = f"WITH {O.scores()}"


def _scored(spark, d):
    p = materialize(links.with_inbound(wiki(spark, d)), "pages")
    top, members = corpus.planned(raw(spark, d), p)
    return materialize(links.cluster_page_scores(top, p), "scores"), top, members, p


@query(f"{_SCORES} SELECT cluster_id, page_ord, CAST(score AS BIGINT) AS score, CASE WHEN score >= 12 THEN 'strong' WHEN score >= 8 THEN 'medium' ELSE 'weak' END AS strength FROM scores")
def r2_r3_j2_similarity(spark, d):
    return _scored(spark, d)[0].select("cluster_id", "page_ord", n(F.col("score")).alias("score"), "strength")


@query(f"{_SCORES} SELECT cluster_id, CAST(rank AS BIGINT) AS rank, title, CAST(score AS BIGINT) AS score FROM (SELECT cluster_id, title, max(score) AS score, row_number() OVER (PARTITION BY cluster_id ORDER BY max(score) DESC, title) AS rank FROM scores GROUP BY cluster_id, title) WHERE rank <= 8")
def r4_a12_o4_related(spark, d):
    return links.related_candidates(_scored(spark, d)[0]).select("cluster_id", n(F.col("rank")).alias("rank"), "title", n(F.col("score")).alias("score"))


_BACK = f"""{_SCORES}, bx AS (SELECT s.cluster_id, s.page_ord, p.title, s.score + CASE WHEN {O.section("p.text")} <> {O.q(K.NO_SECTION)} THEN 2 ELSE 0 END AS score, {O.section("p.text")} AS section, c.name AS new_title, coalesce(c.hints_hit[1], c.name) AS relation
 FROM scores s JOIN planned c USING (cluster_id) JOIN pages p USING (page_ord) WHERE s.score >= 5 AND NOT list_contains(p.related, c.name) AND NOT contains(p.text, '[[' || c.name || ']]')),
back AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, title, page_ord) AS rank FROM bx QUALIFY rank <= 6)"""


@query(f"{_BACK} SELECT cluster_id, CAST(rank AS BIGINT) AS rank, title, CAST(score AS BIGINT) AS score, section, '- 与 [[' || new_title || ']] 的关系：该页与“' || relation || '”主题存在直接关联，建议互相引用补全知识网络。' AS line FROM back")
def r5_f9_o5_t34_backlinks(spark, d):
    s, top, _, p = _scored(spark, d)
    return links.backlinks(s, top, p).select("cluster_id", n(F.col("rank")).alias("rank"), "title", n(F.col("score")).alias("score"), "section", "line")


_SHARED = f"""sa AS (SELECT DISTINCT cluster_id, unnest(list_filter(anchor_terms, lambda t: NOT {O.noise_token("t")})) AS term FROM planned),
sb AS (SELECT DISTINCT page_ord, unnest(list_concat({O.tokens("title")}, list_transform(tags, lambda t: {O.normal_token("t")}))) AS term FROM pages),
shared AS (SELECT cluster_id, page_ord, term, row_number() OVER (PARTITION BY cluster_id, page_ord ORDER BY length(term) DESC, term DESC) AS rank FROM sa JOIN sb USING (term) QUALIFY rank <= 6)"""


@query(f"WITH {O.CLUSTERS}, {O.PAGES}, {_SHARED} SELECT cluster_id, page_ord, CAST(rank AS BIGINT) AS rank, term FROM shared")
def r6_o6_shared_terms(spark, d):
    top, _ = corpus.planned(raw(spark, d))
    return links.shared_terms(top, wiki(spark, d)).select("cluster_id", "page_ord", n(F.col("rank")).alias("rank"), "term")


def _own_clusters(spark, d) -> DataFrame:
    """Every page as a cluster of its own title and title words: pages that share words meet, none meets itself."""
    p = wiki(spark, d)
    return p.select(F.col("page_ord").alias("cluster_id"), "title", T.tokens("title").alias("anchor_terms"))


@query(
    f"""WITH {O.PAGES}, sa AS (SELECT DISTINCT page_ord AS cluster_id, title AS c_title, unnest({O.tokens("title")}[1:10]) AS term FROM pages), sb AS (SELECT DISTINCT page_ord, title, unnest(list_concat({O.tokens("title")}, list_transform(tags, lambda t: {O.normal_token("t")}))) AS term FROM pages),
x AS (SELECT cluster_id, page_ord, term, c_title, title, row_number() OVER (PARTITION BY cluster_id, page_ord ORDER BY length(term) DESC, term DESC) AS rank FROM sa JOIN sb USING (term) QUALIFY rank <= 6)
SELECT cluster_id, page_ord, CAST(rank AS BIGINT) AS rank, term FROM x WHERE c_title <> title"""
)
def f10_r6_o6_shared_terms_of_pages(spark, d):
    p, own = wiki(spark, d), _own_clusters(spark, d)
    return links.not_self(links.shared_terms(own, p), own, p).select("cluster_id", "page_ord", n(F.col("rank")).alias("rank"), "term")


_CONFLICT = f"""{_SCORES}, {_SHARED},
sl AS (SELECT cluster_id, page_ord, list(term) AS shared FROM shared GROUP BY cluster_id, page_ord),
c6 AS (SELECT * FROM (SELECT m.cluster_id, coalesce(nullif(text, ''), preview) AS x, row_number() OVER (PARTITION BY m.cluster_id ORDER BY title, doc_ord) AS title_rank FROM members m WHERE cluster_id IN (SELECT cluster_id FROM planned)) WHERE title_rank <= 6),
rs AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY title_rank, pos) AS r, {O.tokens("sentence")} AS rt FROM ({O.key_sentences("c6", "cluster_id, title_rank", "x", 2)}) QUALIFY r <= 10),
ps AS (SELECT page_ord, sentence, pos, {O.tokens("sentence")} AS pt FROM ({O.key_sentences("pages", "page_ord", "text", 10)})),
cx AS (SELECT sl.cluster_id, sl.page_ord, shared, r, ps.pos, CASE WHEN {O.like("rs.sentence", O.any_of(K.NEGATIVE))} AND {O.like("ps.sentence", O.any_of(K.POSITIVE))} THEN 1 WHEN {O.like("rs.sentence", O.any_of(K.POSITIVE))} AND {O.like("ps.sentence", O.any_of(K.NEGATIVE))} THEN 2 END AS kind
 FROM sl JOIN rs USING (cluster_id) JOIN ps USING (page_ord) WHERE len(list_distinct(list_intersect(rt, pt))) >= 2 AND len(list_intersect(list_intersect(rt, pt), shared)) > 0),
cc AS (SELECT cluster_id, page_ord, least(count(*), 3) AS reasons, max(len(list_distinct(shared))) AS shared FROM cx WHERE kind IS NOT NULL GROUP BY cluster_id, page_ord)"""


@query(f"{_CONFLICT} SELECT cluster_id, page_ord, CASE WHEN reasons >= 2 AND shared >= 2 THEN 'high' ELSE 'medium' END AS severity, CAST(reasons AS BIGINT) AS reasons FROM cc")
def r7_j3_o9_conflicts(spark, d):
    _, top, members, p = _scored(spark, d)
    return links.conflicts(top, members, p).select("cluster_id", "page_ord", "severity", n(F.size("reasons")).alias("reasons"))


@query(
    f"""{_BACK}, {_CONFLICT.removeprefix(_SCORES + ", ")}, g AS (SELECT (SELECT count(*) FROM back WHERE section <> {O.q(K.NO_SECTION)} AND score >= 8) AS pb, (SELECT count(*) FROM back WHERE section <> {O.q(K.NO_SECTION)}) AS pu, (SELECT count(*) FROM cc) AS ct, (SELECT count(*) FROM planned WHERE quality_score < 70) AS lq)
SELECT CAST(pb AS BIGINT) AS planned_backlinks, CAST(pu AS BIGINT) AS planned_updates, CAST(ct AS BIGINT) AS conflict_targets, CAST(lq AS BIGINT) AS low_quality, pb > 10 OR pu > 6 OR ct >= 4 OR lq >= 2 AS blocked, CASE WHEN pb > 10 OR pu > 6 OR ct >= 4 OR lq >= 2 THEN 'high' ELSE 'medium' END AS level FROM g"""
)
def r8_a13_risk_gate(spark, d):
    s, top, members, p = _scored(spark, d)
    return links.risk_gate(top, links.backlinks(s, top, p), links.conflicts(top, members, p))


@query(f"{_BACK}, rel AS (SELECT cluster_id, least(count(DISTINCT title), 8) AS n FROM scores GROUP BY cluster_id), bn AS (SELECT cluster_id, count(*) AS n FROM back GROUP BY cluster_id) SELECT cluster_id, name, CAST(coalesce(rel.n, 0) AS BIGINT) AS related, CAST(coalesce(bn.n, 0) AS BIGINT) AS backlinks FROM planned LEFT JOIN rel USING (cluster_id) LEFT JOIN bn USING (cluster_id)")
def r9_preview(spark, d):
    s, top, _, p = _scored(spark, d)
    return links.preview_counts(top, links.related_candidates(s), links.backlinks(s, top, p))


_BRIDGE = f"""WITH {_HEALTH}, isl AS (SELECT DISTINCT page_ord FROM issues WHERE kind = 'island'),
parts AS (SELECT DISTINCT page_ord, term, w FROM (SELECT page_ord, unnest({O.raw_tokens("title")}) AS term, 3 AS w FROM pages JOIN pmap USING (title, page_ord) UNION ALL SELECT page_ord, unnest(tags), 2 FROM pages JOIN pmap USING (title, page_ord))),
bs AS (SELECT a.page_ord, b.page_ord AS b, sum(w) AS score FROM parts a JOIN parts b USING (term, w) WHERE a.page_ord IN (SELECT page_ord FROM isl) AND b.page_ord NOT IN (SELECT page_ord FROM isl) GROUP BY a.page_ord, b.page_ord)
SELECT x.page_ord, p.title, o.title AS bridge, CAST(score AS BIGINT) AS score FROM (SELECT * FROM bs QUALIFY row_number() OVER (PARTITION BY page_ord ORDER BY score DESC, b) = 1) x JOIN pages p ON p.page_ord = x.page_ord JOIN pages o ON o.page_ord = x.b"""


@query(_BRIDGE)
def r12_j11_island_bridges(spark, d):
    return links.island_bridges(wiki(spark, d), _issues(spark, d))


@query(f"WITH {_HEALTH}, s AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY page_ord, target_title NULLS FIRST) AS seq FROM issues) SELECT CAST(seq AS BIGINT) AS seq, 'add_related' AS kind, m.page_ord, page_title, target_title FROM s JOIN pmap m ON m.title = page_title WHERE kind = 'related_missing' AND seq <= 20 UNION ALL SELECT CAST(seq AS BIGINT), 'add_body', m.page_ord, page_title, target_title FROM s JOIN pmap m ON m.title = page_title JOIN pages p ON p.page_ord = m.page_ord WHERE kind = 'body_missing' AND seq <= 10 AND {O.section('p.text')} <> {O.q(K.NO_SECTION)}")
def u2_j12_repair_plan(spark, d):
    return links.repair_plan(wiki(spark, d), _issues(spark, d)).select(n(F.col("seq")).alias("seq"), "kind", "page_ord", "page_title", "target_title")


@query()
def u1_u2_u5_u6_repaired_pages(spark, d):
    p = wiki(spark, d)
    return links.apply_repairs(p, links.repair_plan(p, _issues(spark, d), "full-apply")).select("page_ord", "new_text", "changed")


def _backlinked_sql(back: str = "back") -> str:
    """U4 over the rows of a table of backlinks (cluster_id, rank, page_ord, section, line): lines put in one after another."""
    return f"""todo AS (SELECT page_ord, section, line, row_number() OVER (PARTITION BY page_ord ORDER BY cluster_id, rank) AS k FROM {back} WHERE section <> {O.q(K.NO_SECTION)} AND score >= 8),
steps AS (SELECT page_ord, text, CAST(0 AS BIGINT) AS k FROM pages WHERE page_ord IN (SELECT page_ord FROM todo)
 UNION ALL SELECT page_ord, CASE WHEN contains(text, line) OR NOT contains(text, section) THEN text ELSE {_insert_sql("text", "section", "line")} END, k
 FROM (SELECT *, {_section_sql_of("text", "section")} AS sec FROM (SELECT s.page_ord, s.text, todo.section, todo.line, todo.k FROM steps s JOIN todo ON todo.page_ord = s.page_ord AND todo.k = s.k + 1))),
changed AS (SELECT s.page_ord, s.text AS new_text FROM (SELECT page_ord, arg_max(text, k) AS text FROM steps GROUP BY page_ord) s JOIN pages USING (page_ord) WHERE s.text <> pages.text)"""


_BACK_LINES = "bl AS (SELECT *, '- 与 [[' || new_title || ']] 的关系：该页与“' || relation || '”主题存在直接关联，建议互相引用补全知识网络。' AS line FROM back)"


@query(f"{_BACK.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_BACK_LINES}, {_backlinked_sql('bl')} SELECT page_ord, new_text FROM changed")
def u4_backlinked_pages(spark, d):
    s, top, _, p = _scored(spark, d)
    return links.apply_backlinks(links.backlinks(s, top, p), p)


@query()
def k1_k2_r11_pages(spark, d):
    s, top, members, p = _scored(spark, d)
    return render.new_pages(render.render_pages(top, members, links.related_candidates(s), BATCH, AS_OF), p)


@query()
def u7_k6_page_updates(spark, d):
    return pipeline.knowledge_plan(raw(spark, d), table(spark, d, "wiki_pages"), BATCH, AS_OF)["page_updates"]


# --- scout ---


_LEN = f"length({O.body('text')})"
_STOPS = f"len(regexp_extract_all({O.body('text')}, '[。！？!?；;]'))"


@query(f"WITH {O.PAGES}, x AS (SELECT page_ord, title, {_LEN} AS chars, len(related) AS related, {_STOPS} AS stops FROM pages) SELECT * FROM (SELECT page_ord, title, CAST(chars AS BIGINT) AS chars, CAST(related AS BIGINT) AS related, CASE WHEN chars < 100 AND related > 5 THEN 'severe' WHEN chars < 200 OR (related > 3 AND stops <= 1) THEN 'thin' END AS grade FROM x) WHERE grade IS NOT NULL")
def x1_thin(spark, d):
    return scout.thin_pages(wiki(spark, d)).select("page_ord", "title", n(F.col("chars")).alias("chars"), n(F.col("related")).alias("related"), "grade")


@query(f"WITH {O.EDGES} SELECT title AS target, CAST(inbound AS BIGINT) AS refs, CASE WHEN inbound >= 10 THEN 'now' WHEN inbound >= 5 THEN 'medium' ELSE 'low' END AS grade FROM inb WHERE inbound >= 2 AND title NOT IN (SELECT title FROM pmap)")
def x2_broken(spark, d):
    return scout.broken_concepts(wiki(spark, d))


_HEAVY = "SELECT doc_ord AS page_ord, coalesce(title, '') AS title, coalesce(text, '') AS text FROM raw_docs"


@query(f"WITH pages AS ({_HEAVY}), x AS (SELECT page_ord, title, {_LEN} AS chars, len(regexp_extract_all(text, {O.q('(?m)^##[ ' + chr(92) + 't]')})) AS sections FROM pages) SELECT * FROM (SELECT page_ord, title, CAST(chars AS BIGINT) AS chars, CAST(sections AS BIGINT) AS sections, CASE WHEN chars > 1500 THEN 'split' WHEN chars >= 800 AND sections >= 3 THEN 'splittable' END AS grade FROM x) WHERE grade IS NOT NULL")
def x3_heavy(spark, d):
    """Over the stored documents, with thresholds at their lengths: the pages of these tables are short."""
    p = raw(spark, d).select(F.col("doc_ord").alias("page_ord"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    return scout.overweight_pages(p, 1_500, 800).select("page_ord", "title", n(F.col("chars")).alias("chars"), n(F.col("sections")).alias("sections"), "grade")


_GAPS = f"""WITH {O.EDGES}, t AS (SELECT DISTINCT page_ord, title, unnest(tags) AS tag FROM pages), n AS (SELECT tag, count(DISTINCT page_ord) AS pages FROM t GROUP BY tag HAVING count(DISTINCT page_ord) >= 3),
e AS (SELECT DISTINCT title, target FROM edges WHERE kind = 'related'), pr AS (SELECT a.title, a.target FROM e a JOIN e b ON a.title = b.target AND a.target = b.title WHERE a.title < a.target), tt AS (SELECT DISTINCT title, tag FROM t),
m AS (SELECT x.tag, count(*) AS mutual FROM pr JOIN tt x ON x.title = pr.title JOIN tt y ON y.title = pr.target AND y.tag = x.tag GROUP BY x.tag)
SELECT tag, CAST(pages AS BIGINT) AS pages, CAST(coalesce(mutual, 0) AS BIGINT) AS mutual, coalesce(mutual, 0) >= 2 AS ready FROM n LEFT JOIN m USING (tag) WHERE tag NOT IN (SELECT title FROM pmap)"""


@query(_GAPS)
def x4_cluster_gaps(spark, d):
    return scout.cluster_gaps(wiki(spark, d))


def _doc_pages(spark, d) -> DataFrame:
    """The stored documents as pages without related names."""
    s = lambda c: F.coalesce(F.col(c), F.lit(""))
    return raw(spark, d).select(F.col("doc_ord").alias("page_ord"), s("title").alias("title"), F.lit("paper").alias("page_type"), T.clean_array("tags").alias("tags"), F.array().cast("array<string>").alias("related"), s("text").alias("text"), F.col("modified_at").alias("updated"))


_DOC_TAGS = f"t AS (SELECT DISTINCT doc_ord, coalesce(title, '') AS title, unnest({O.strings('tags')}) AS tag FROM raw_docs)"


@query(f"WITH {_DOC_TAGS} SELECT tag, CAST(count(DISTINCT doc_ord) AS BIGINT) AS pages FROM t WHERE tag NOT IN (SELECT coalesce(title, '') FROM raw_docs) GROUP BY tag HAVING count(DISTINCT doc_ord) >= 3")
def x4_cluster_gaps_of_docs(spark, d):
    return scout.cluster_gaps(_doc_pages(spark, d)).select("tag", "pages")


@query(
    f"""WITH {_DOC_TAGS}, big AS (SELECT tag FROM t GROUP BY tag HAVING count(DISTINCT doc_ord) >= 5), b AS (SELECT * FROM t WHERE tag IN (SELECT tag FROM big)),
g AS (SELECT x.tag AS tag_a, y.tag AS tag_b, count(*) AS together, max(CASE WHEN contains(x.title, x.tag) AND contains(x.title, y.tag) THEN 1 ELSE 0 END) AS bridged FROM b x JOIN b y ON x.doc_ord = y.doc_ord AND x.tag < y.tag GROUP BY x.tag, y.tag)
SELECT tag_a, tag_b, CAST(together AS BIGINT) AS together, CASE WHEN together >= 3 THEN 'high' ELSE 'low' END AS grade FROM g WHERE bridged = 0"""
)
def x5_topic_bridges_of_docs(spark, d):
    """With the rule's own five pages a tag."""
    return scout.topic_bridges(_doc_pages(spark, d))


@query(
    f"""WITH e AS (SELECT doc_ord, count(DISTINCT target) AS lost FROM (SELECT doc_ord, unnest({O.wikilinks("text")}) AS target FROM raw_docs) WHERE target NOT IN (SELECT coalesce(title, '') FROM raw_docs) GROUP BY doc_ord),
x AS (SELECT doc_ord AS page_ord, {O.like("coalesce(title, '')", O.any_of(scout.WIDE_TITLES))} AS wide_title, len(regexp_extract_all(coalesce(text, ''), {O.q("(?m)^##[ " + chr(92) + "t]")})) >= 5 AS many_sections, coalesce(lost, 0) >= 3 AS broken_links FROM raw_docs LEFT JOIN e USING (doc_ord)) SELECT * FROM x WHERE wide_title OR many_sections OR broken_links"""
)
def x3_heavy_signals(spark, d):
    return scout.overweight_signals(_doc_pages(spark, d))


_CROSS = f"""WITH {O.PAGES}, t AS (SELECT DISTINCT page_ord, title, unnest(tags) AS tag FROM pages), big AS (SELECT tag FROM t GROUP BY tag HAVING count(DISTINCT page_ord) >= 2), b AS (SELECT * FROM t WHERE tag IN (SELECT tag FROM big)),
g AS (SELECT x.tag AS tag_a, y.tag AS tag_b, count(*) AS together, max(CASE WHEN contains(x.title, x.tag) AND contains(x.title, y.tag) THEN 1 ELSE 0 END) AS bridged FROM b x JOIN b y ON x.page_ord = y.page_ord AND x.tag < y.tag GROUP BY x.tag, y.tag)
SELECT tag_a, tag_b, CAST(together AS BIGINT) AS together, CASE WHEN together >= 3 THEN 'high' ELSE 'low' END AS grade FROM g WHERE bridged = 0"""


@query(_CROSS)
def x5_topic_bridges(spark, d):
    return scout.topic_bridges(wiki(spark, d), 2)


_MONTHS = "(2025 - year(modified_at)) * 12 + 6 - month(modified_at) - CASE WHEN modified_at > date_trunc('month', modified_at) THEN 1 ELSE 0 END"


@query(f"SELECT * FROM (SELECT CAST(doc_ord AS BIGINT) AS page_ord, coalesce(title, '') AS title, CAST({_MONTHS} AS BIGINT) AS months, CASE WHEN {_MONTHS} >= 12 THEN 'update' WHEN {_MONTHS} >= 6 THEN 'check' END AS grade FROM raw_docs) WHERE grade IS NOT NULL")
def x6_stale(spark, d):
    p = raw(spark, d).select(F.col("doc_ord").alias("page_ord"), F.coalesce("title", F.lit("")).alias("title"), F.lit("paper").alias("page_type"), F.col("modified_at").alias("updated"))
    return scout.stale_pages(p, AS_OF)


def _grid(spark: SparkSession) -> DataFrame:
    g = spark.range(3).select((F.col("id") + 1).cast("int").alias("urgency"))
    v, e = g.withColumnRenamed("urgency", "value"), g.withColumnRenamed("urgency", "effort")
    return g.crossJoin(v).crossJoin(e)  # 27 rows


@query("SELECT CAST(u AS BIGINT) AS urgency, CAST(v AS BIGINT) AS value, CAST(e AS BIGINT) AS effort, CAST(u * 4 + v * 4 + e * 2 AS BIGINT) AS tenths, CASE WHEN u * 4 + v * 4 + e * 2 >= 25 THEN 'high' WHEN u * 4 + v * 4 + e * 2 >= 15 THEN 'medium' ELSE 'low' END AS priority FROM range(1, 4) a(u), range(1, 4) b(v), range(1, 4) c(e)")
def x8_x9_priority(spark, d):
    x = scout.priority(_grid(spark))
    return x.select(n(F.col("urgency")).alias("urgency"), n(F.col("value")).alias("value"), n(F.col("effort")).alias("effort"), n(F.col("score") * 10).alias("tenths"), "priority")


_EVERY = f"""WITH ib AS (WITH {O.EDGES} SELECT title, inbound FROM inb), c AS (
 SELECT 'thin' AS pattern, t.title AS topic, coalesce(inbound, 0) AS refs FROM ({_SQL['x1_thin']}) t LEFT JOIN ib ON ib.title = t.title
 UNION ALL SELECT 'broken_concept', target, refs FROM ({_SQL['x2_broken']})
 UNION ALL SELECT 'overweight', title, sections FROM ({_SQL['x3_heavy'].replace(_HEAVY, "SELECT * FROM (WITH " + O.PAGES + " SELECT page_ord, title, text FROM pages)").replace("chars > 1500", "chars > 5000").replace("chars >= 800", "chars >= 2000")})
 UNION ALL SELECT 'cluster_gap', tag, pages FROM ({_GAPS})
 UNION ALL SELECT 'cross_topic', tag_a || ' / ' || tag_b, together FROM ({_CROSS.replace(">= 2), b AS", ">= 5), b AS")})),
s AS (SELECT *, CASE WHEN refs > 15 THEN 3 WHEN refs >= 5 THEN 2 ELSE 1 END AS u, CASE WHEN refs > 20 THEN 3 WHEN refs >= 5 THEN 2 ELSE 1 END AS v, CASE WHEN pattern IN ('overweight', 'cross_topic') THEN 1 WHEN pattern IN ('cluster_gap', 'stale') THEN 2 ELSE 3 END AS e FROM c),
p AS (SELECT *, u * 4 + v * 4 + e * 2 AS t, list_position([{", ".join(O.q(x) for x in scout.SCAN_ORDER)}], pattern) AS scan, list_position([{", ".join(O.q(x) for x in scout.PATTERNS)}], pattern) AS place_of FROM s)"""
_ORDER = "CASE WHEN t >= 25 THEN 1 WHEN t >= 15 THEN 2 ELSE 3 END, u DESC, place_of, topic"


@query(f"{_EVERY} SELECT pattern, topic, CAST(row_number() OVER (ORDER BY {_ORDER}) AS BIGINT) AS place FROM p QUALIFY place <= 10")
def x10_x11_o11_queue_all(spark, d):
    """The queue of all patterns over the wiki pages; these have no date, so none is stale."""
    c = scout.candidates(wiki(spark, d), AS_OF)
    return scout.queue(scout.scored(c)).select("pattern", "topic", n(F.col("place")).alias("place"))


@query(f"{_EVERY}, k AS (SELECT *, row_number() OVER (ORDER BY {_ORDER}) AS place, count(*) OVER () AS n FROM p) SELECT pattern, topic, CAST(place AS BIGINT) AS place, CAST(greatest(n - 10, 0) AS BIGINT) AS waiting, place * 2 <= 20 AS searched FROM k WHERE place <= 10 AND n >= 2")
def x11_brief(spark, d):
    b = scout.brief(scout.scored(scout.candidates(wiki(spark, d))))
    return b.select("pattern", "topic", n(F.col("place")).alias("place"), n(F.col("waiting")).alias("waiting"), "searched")


@query()
def x6_x10_x11_o11_queue_docs(spark, d):
    """The queue of all patterns, stale ones included, over the stored documents as pages; they hold no related names."""
    p = _doc_pages(spark, d)
    return scout.queue(scout.scored(scout.candidates(p, AS_OF))).select("pattern", "topic", n(F.col("place")).alias("place"))


@query(f"{_EVERY} SELECT pattern, CAST(scan AS BIGINT) AS scan, topic, CAST(refs AS BIGINT) AS refs, CAST(u AS BIGINT) AS urgency, CAST(v AS BIGINT) AS value, CAST(e AS BIGINT) AS effort, CAST(t AS BIGINT) AS tenths, CASE WHEN t >= 25 THEN 'high' WHEN t >= 15 THEN 'medium' ELSE 'low' END AS priority FROM p")
def x7_x8_candidates(spark, d):
    x = scout.scored(scout.candidates(wiki(spark, d)))
    return x.select("pattern", n(F.col("scan")).alias("scan"), "topic", "refs", n(F.col("urgency")).alias("urgency"), n(F.col("value")).alias("value"), n(F.col("effort")).alias("effort"), n(F.col("score") * 10).alias("tenths"), "priority")


_HOST = "regexp_replace(lower(regexp_extract(trim(link), '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www[.]', '')"


@query(f"WITH {ARTICLES} SELECT host, CASE WHEN host <> '' THEN CASE WHEN host = 'arxiv.org' THEN 'A' ELSE 'C' END END AS grade, CAST(count(*) AS BIGINT) AS n FROM (SELECT {_HOST} AS host FROM a WHERE link IS NOT NULL) GROUP BY ALL")
def x12_source_grades(spark, d):
    return scout.source_grades(articles(spark, d).where("link IS NOT NULL").select(F.trim("link").alias("url"))).groupBy("host", "grade").agg(F.count("*").alias("n"))


@query(f"{_EVERY} SELECT topic, pattern AS type, CASE WHEN t >= 25 THEN 'high' WHEN t >= 15 THEN 'medium' ELSE 'low' END AS priority, CASE WHEN refs > 0 THEN CAST(CAST(refs AS BIGINT) AS VARCHAR) END AS evidence, 'arxiv.org' AS sources, CASE WHEN u > 1 THEN 'review' END AS next_step FROM p WHERE topic = '' OR refs = 0 OR u = 1")
def x14_incomplete_cards(spark, d):
    c = scout.scored(scout.candidates(wiki(spark, d)))
    cards = c.select("topic", F.col("pattern").alias("type"), "priority", F.when(F.col("refs") > 0, F.col("refs").cast("string")).alias("evidence"), F.lit("arxiv.org").alias("sources"), F.when(F.col("urgency") > 1, F.lit("review")).alias("next_step"))
    return scout.incomplete_cards(cards)


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The topic clusters of the stored documents."""
    return c3_c4_c5_a3_a6_clusters(spark, d)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["entry", "oracle_sql", "queries"]
