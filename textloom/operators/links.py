"""Pages, their link graph, scores against clusters, health and repair.

Null text and titles are empty, null types unknown, arrays lose null and blank elements. Of pages with one title the
last one (largest page_ord) counts where a title is looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.functions import text as T


def pages(raw: DataFrame) -> DataFrame:
    """S2 over a table of pages: (page_ord, file_name, title, page_type, tags, related, text), features as stored."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return raw.where(F.col("page_ord").isNotNull()).select(F.col("page_ord").cast("long").alias("page_ord"), s("file_name").alias("file_name"), s("title").alias("title"), F.coalesce(T.blank_to_null(T.strip("type")), F.lit(K.UNKNOWN)).alias("page_type"), T.clean_array("tags").alias("tags"), T.clean_array("related").alias("related"), s("text").alias("text"))


def derive_pages(files: DataFrame) -> DataFrame:
    """S2 from Markdown files (page_ord, file_name, text): title, type, tags and related read from the text."""
    stem = F.regexp_replace("file_name", r"\.md$", "")
    return files.select("page_ord", "file_name", T.title("text", stem).alias("title"), T.page_type("text").alias("page_type"), T.field_list("text", "tags").alias("tags"), T.field_list("text", "related").alias("related"), T._c("text").alias("text"))


def edges(p: DataFrame) -> DataFrame:
    """Distinct (page_ord, title, target, kind), kind body or related; brackets left in a related name are dropped."""
    body = p.select("page_ord", "title", F.explode(F.array_distinct(T.wikilinks("text"))).alias("target"), F.lit("body").alias("kind"))
    rel = p.select("page_ord", "title", F.explode(F.array_distinct(F.transform("related", lambda x: F.replace(F.replace(x, F.lit("[["), F.lit("")), F.lit("]]"), F.lit(""))))).alias("target"), F.lit("related").alias("kind"))
    return body.unionByName(rel)


def inbound(e: DataFrame) -> DataFrame:
    """(target, inbound): distinct pages that link to a name; own links and names without a page count."""
    return e.select("page_ord", "target").distinct().groupBy("target").agg(F.count("*").alias("inbound"))


def page_map(p: DataFrame) -> DataFrame:
    """One page a title, the last."""
    return p.groupBy("title").agg(F.max("page_ord").alias("page_ord"))


def with_inbound(p: DataFrame) -> DataFrame:
    """Pages with inbound_refs, 0 where nothing links to the title."""
    return p.join(inbound(edges(p)).withColumnRenamed("target", "title"), "title", "left").withColumn("inbound_refs", F.coalesce("inbound", F.lit(0))).drop("inbound")


def health_issues(p: DataFrame, index_text: str = "", log_text: str = "") -> DataFrame:
    """(kind, page_title, target_title, page_ord) of every issue.

    Edges are built once; titles resolve by semi joins, reciprocity by an anti join on swapped columns. index_text and
    log_text are one text each; an empty one skips its check.
    """
    e = edges(p)
    titles = page_map(p).select(F.col("title").alias("target"))
    resolved = e.join(titles, "target", "left_semi")
    inb = inbound(e).withColumnRenamed("target", "title")
    none = F.lit(None).cast("string")

    def issue(df: DataFrame, kind: str, target: Column = none) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col("title").alias("page_title"), target.alias("target_title"), "page_ord")

    front = p.where(F.col("text").startswith("---\n"))
    h1 = issue(front.where(~F.regexp_like("text", F.lit(rf"(?md)^related:{K.WS}*\[.*\]{K.WS}*$"))), "missing_related_field")
    h2 = issue(front.where(~F.regexp_like("text", F.lit(rf"(?md)^type:{K.WS}*\"?.+?\"?$"))), "missing_type_field")
    out = resolved.select("page_ord").distinct()
    h3 = issue(p.where(F.size("related") == 0).join(inb, "title", "left_anti").join(out, "page_ord", "left_anti"), "island")
    h4 = issue(p.where((F.size("related") == 0) & (F.size(T.wikilinks("text")) == 0) & (F.size(T.key_sentences("text", 2)) < 2)), "pseudo")
    links = resolved.select("page_ord", "title", "target").distinct().where("target <> title")
    last = e.join(page_map(p).select("page_ord"), "page_ord", "left_semi")
    back = last.select(F.col("title").alias("target"), F.col("target").alias("title")).distinct()
    h5 = issue(links.join(back, ["title", "target"], "left_anti"), "one_way", F.col("target"))
    body, rel = resolved.where("kind = 'body'").drop("kind"), resolved.where("kind = 'related'").drop("kind")
    h6 = issue(body.join(rel, ["page_ord", "target"], "left_anti"), "related_missing", F.col("target"))
    h7 = issue(rel.join(body, ["page_ord", "target"], "left_anti"), "body_missing", F.col("target"))
    found = [h1, h2, h3, h4, h5, h6, h7]
    if index_text:
        found.append(issue(unmarked(p, index_text, ("file_name",)), "index_missing"))
    if log_text:
        found.append(issue(unmarked(p, log_text, ("file_name", "slug", "title")), "log_missing"))
    out_df = found[0]
    for x in found[1:]:
        out_df = out_df.unionByName(x)
    return out_df


def unmarked(p: DataFrame, text: str, by: tuple[str, ...]) -> DataFrame:
    """Pages that a text of marks (an index, a log) doesn't name by `wiki/FILE` (its file name or its title's slug) or [[TITLE]].

    The text is searched once for all its marks, which meet the pages by an anti join.
    """
    import re

    files = {m for m in re.findall(r"(?=`wiki/([^`]*)`)", text)} if {"file_name", "slug"} & {*by} else set()
    names = {text[m.start() + 2 : e] for m in re.finditer(r"(?=\[\[)", text) if (e := text.find("]]", m.start() + 2)) >= 0} if "title" in by else set()
    marks = p.sparkSession.createDataFrame([*[("f", x) for x in files], *[("t", x) for x in names]], "kind string, mark string")
    keys = {"file_name": ("f", F.col("file_name")), "slug": ("f", F.concat(T.slug("title"), F.lit(".md"))), "title": ("t", F.col("title"))}
    out = p
    for k in by:
        kind, value = keys[k]
        out = out.withColumn("__mark", value).join(marks.where(F.col("kind") == kind).select(F.col("mark").alias("__mark")), "__mark", "left_anti").drop("__mark")
    return out


HEALTH_KINDS = ("missing_related_field", "missing_type_field", "island", "pseudo", "one_way", "related_missing", "body_missing", "index_missing", "log_missing")


def health_totals(issues: DataFrame) -> DataFrame:
    """A10, K7: (kind, n) for every kind, 0 where there is none."""
    kinds = F.explode(F.array(*[F.lit(k) for k in HEALTH_KINDS])).alias("kind")
    every = issues.sparkSession.range(1).select(kinds)
    return every.join(issues.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def report_rows(issues: DataFrame, most: int = 30) -> DataFrame:
    """The first most issues of each kind by page and target."""
    w = Window.partitionBy("kind").orderBy("page_ord", "target_title")
    return issues.withColumn("seq", F.row_number().over(w)).where(F.col("seq") <= most)


def cluster_page_scores(clusters: DataFrame, p: DataFrame) -> DataFrame:
    """(cluster_id, page_ord, title, score, strength, reasons) of positive pairs of the planned clusters and all pages.

    clusters: the few planned ones (a capped set of questions, broadcast); p: pages with inbound_refs.
    """
    c = F.broadcast(clusters.select("cluster_id", F.col("name").alias("c_name"), F.col("hints_hit").alias("c_hints"), F.col("anchor_terms").alias("c_anchors"), F.col("page_type").alias("c_type")))
    x = p.join(c, F.lit(True))
    low = F.lower("title")
    named = (F.col("c_name") != "") & low.contains(F.lower("c_name"))
    hints = F.filter("c_hints", lambda t: F.array_contains(F.col("tags"), t) | low.contains(F.lower(t)))
    anchors = F.filter(F.slice("c_anchors", 1, 8), lambda t: (t != "") & low.contains(t))
    bonus = F.lit(0)
    for a, row in K.TYPE_MATCH.items():
        for b, v in row.items():
            bonus = F.when((F.col("c_type") == a) & (F.col("page_type") == b), v).otherwise(bonus)
    bridge = (F.col("inbound_refs") >= 3) & F.col("c_type").isin("concept", "topic")
    x = x.withColumn("hints", hints).withColumn("anchors", anchors).withColumn("bonus", bonus)
    score = F.when(named, 8).otherwise(0) + F.least(F.lit(6), 3 * F.size("hints")) + F.least(F.lit(5), 2 * F.size("anchors")) + F.col("bonus") + F.when(bridge, 1).otherwise(0)
    reasons = F.filter(
        F.array(
            F.when(named, F.lit("标题包含主题名")),
            F.when(F.size("hints") > 0, F.concat(F.lit("共享主题标签: "), F.array_join(F.slice("hints", 1, 3), ", "))),
            F.when(F.size("anchors") > 0, F.concat(F.lit("标题命中关键词: "), F.array_join(F.slice("anchors", 1, 3), ", "))),
            F.when(F.col("bonus") > 0, F.concat(F.lit("页面类型匹配: "), F.col("c_type"), F.lit("->"), F.col("page_type"))),
            F.when(bridge, F.lit("高连接度页面，适合做桥接")),
        ),
        lambda r: r.isNotNull(),
    )
    x = x.withColumn("score", score.cast("int")).where("score > 0")
    return x.select("cluster_id", "page_ord", "title", "score", strength(F.col("score")).alias("strength"), reasons.alias("reasons"))


def strength(score: Column) -> Column:
    """R3."""
    return F.when(score >= 12, F.lit("strong")).when(score >= 8, F.lit("medium")).otherwise(F.lit("weak"))


def related_candidates(scores: DataFrame, most: int = 8) -> DataFrame:
    """(cluster_id, rank, title, score, strength): best score a title, first page on ties, then the top by score and title."""
    one = scores.withColumn("k", F.row_number().over(Window.partitionBy("cluster_id", "title").orderBy(F.desc("score"), "page_ord"))).where("k = 1")
    w = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "title")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("cluster_id", "rank", "title", "score", "strength")


def backlinks(scores: DataFrame, clusters: DataFrame, p: DataFrame, title_col: str = "name", most: int = 6) -> DataFrame:
    """(cluster_id, rank, page_ord, title, score, section, section_found, line) of pages that should link back."""
    c = clusters.select("cluster_id", F.col(title_col).alias("new_title"), F.coalesce(F.get("hints_hit", F.lit(0)), F.col("name")).alias("relation"))
    x = scores.where("score >= 5").select("cluster_id", "page_ord", "score").join(F.broadcast(c), "cluster_id").join(p.select("page_ord", "title", "related", "text"), "page_ord")
    x = x.where(~F.array_contains("related", F.col("new_title")) & ~F.col("text").contains(F.concat(F.lit("[["), F.col("new_title"), F.lit("]]"))))
    x = x.withColumn("section", T.backlink_section("text")).withColumn("section_found", F.col("section") != K.NO_SECTION)
    x = x.withColumn("score", F.col("score") + F.when(F.col("section_found"), 2).otherwise(0))
    line = F.concat(F.lit("- 与 [["), F.col("new_title"), F.lit("]] 的关系：该页与“"), F.col("relation"), F.lit("”主题存在直接关联，建议互相引用补全知识网络。"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "title", "page_ord")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("cluster_id", "rank", "page_ord", "title", "score", "section", "section_found", line.alias("line"))


def apply_backlinks(plan: DataFrame, p: DataFrame) -> DataFrame:
    """U4: (page_ord, new_text): pages changed by the backlinks with a section and a score of at least 8, all lines of a page in order."""
    ok = plan.where("section_found AND score >= 8").groupBy("page_ord").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "rank", "section", "line"))).alias("todo"))
    x = p.join(ok, "page_ord")
    new = F.aggregate("todo", F.col("text"), lambda t, a: F.when(t.contains(a["line"]) | ~t.contains(a["section"]), t).otherwise(T.insert_in_section(t, a["section"], a["line"])))
    return x.select("page_ord", "text", new.alias("new_text")).where("new_text <> text").select("page_ord", "new_text")


def shared_terms(clusters: DataFrame, p: DataFrame, most: int = 6) -> DataFrame:
    """(cluster_id, page_ord, rank, term): anchors in a page's title tokens or tags, longest first; by equi-join on the term."""
    a = clusters.select("cluster_id", F.explode(F.array_distinct(F.filter(F.slice("anchor_terms", 1, 10), lambda t: ~T.is_noise_token(t)))).alias("term"))
    b = p.select("page_ord", F.explode(F.array_distinct(F.concat(T.tokens("title"), F.transform("tags", T.normal_token)))).alias("term"))
    w = Window.partitionBy("cluster_id", "page_ord").orderBy(F.desc(F.length("term")), F.desc("term"))
    return b.join(F.broadcast(a), "term").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("cluster_id", "page_ord", "rank", "term")


def not_self(pairs: DataFrame, clusters: DataFrame, p: DataFrame) -> DataFrame:
    """pairs (cluster_id, page_ord, ...) without those of a cluster and the page of its own title; all if clusters have no title."""
    if "title" not in clusters.columns:
        return pairs
    own = clusters.where("title <> ''").select("cluster_id", "title").join(p.select("page_ord", "title"), "title").select("cluster_id", "page_ord")
    return pairs.join(own, ["cluster_id", "page_ord"], "left_anti")


def alerts(conflict: DataFrame, most: int = 20) -> DataFrame:
    """The first most conflicts in the order of clusters and pages, with their place."""
    order = Window.orderBy("cluster_id", "page_ord")
    return conflict.orderBy("cluster_id", "page_ord").limit(most).withColumn("place", F.row_number().over(order))  # the feature's own cap


def conflicts(clusters: DataFrame, members: DataFrame, p: DataFrame) -> DataFrame:
    """(cluster_id, page_ord, title, severity, reasons, shared): statements of opposite polarity on shared terms.

    Only pairs with a shared term meet; each side has at most ten sentences. If the clusters have the titles of their
    pages (title), a cluster's own page is none of its conflicts.
    """
    from textloom.operators.corpus import title_ranked

    shared = not_self(shared_terms(clusters, p), clusters, p).groupBy("cluster_id", "page_ord").agg(F.sort_array(F.collect_set("term")).alias("shared"))
    raw = title_ranked(members, 6).select("cluster_id", "title_rank", F.posexplode(T.key_sentences(F.coalesce(T.blank_to_null(F.col("text")), F.col("preview")), 2)).alias("pos", "raw"))
    raw = raw.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy("title_rank", "pos"))).where("r <= 10").select("cluster_id", "r", T.tokens("raw").alias("rt"), T.is_negative(F.col("raw")).alias("rn"), T.is_positive(F.col("raw")).alias("rp"))
    page = p.join(shared.select("page_ord").distinct(), "page_ord", "left_semi").select("page_ord", "title", F.posexplode(T.key_sentences("text", 10)).alias("q", "sentence"))
    page = page.select("page_ord", "title", "q", "sentence", T.tokens("sentence").alias("pt"), T.is_negative(F.col("sentence")).alias("pn"), T.is_positive(F.col("sentence")).alias("pp"))
    x = shared.join(raw, "cluster_id").join(page, "page_ord").withColumn("both", F.array_intersect("rt", "pt"))
    topic = F.sort_array(F.array_intersect("both", "shared"))
    x = x.where(F.size("both") >= 2).withColumn("topic", topic).where(F.size("topic") > 0)
    kind = F.when(F.col("rn") & F.col("pp"), F.lit("raw 偏否定而旧页偏正向")).when(F.col("rp") & F.col("pn"), F.lit("raw 偏正向而旧页偏谨慎"))
    reason = F.concat(F.lit("共享词["), F.array_join(F.slice("topic", 1, 3), ", "), F.lit("]下，"), kind, F.lit("："), F.substring("sentence", 1, 48), F.lit("..."))
    x = x.withColumn("reason", reason).where("reason IS NOT NULL")
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("cluster_id", "page_ord").orderBy("r", "q"))).where("k <= 3")
    g = x.groupBy("cluster_id", "page_ord").agg(F.first("title").alias("title"), F.transform(F.array_sort(F.collect_list(F.struct("k", "reason"))), lambda e: e["reason"]).alias("reasons"), F.first("shared").alias("shared"))
    return g.select("cluster_id", "page_ord", "title", F.when((F.size("reasons") >= 2) & (F.size("shared") >= 2), F.lit("high")).otherwise(F.lit("medium")).alias("severity"), "reasons", "shared")


def risk_gate(clusters: DataFrame, back: DataFrame, conflict: DataFrame, mode: str = "full-apply", apply_backlinks: bool = True, min_score: int = 8) -> DataFrame:
    """One row (planned_backlinks, planned_updates, conflict_targets, low_quality, blocked, level)."""
    b = back.agg(F.coalesce(F.sum((F.col("section_found") & (F.col("score") >= min_score)).cast("long")), F.lit(0)).alias("planned_backlinks"), F.coalesce(F.sum(F.col("section_found").cast("long")), F.lit(0)).alias("planned_updates"))
    c = conflict.agg(F.count("*").alias("conflict_targets"))
    q = clusters.agg(F.coalesce(F.sum((F.col("quality_score") < 70).cast("long")), F.lit(0)).alias("low_quality"))
    x = b.crossJoin(c).crossJoin(q)  # one row each
    full = F.lit(mode == "full-apply")
    blocked = (full & F.lit(apply_backlinks) & (F.col("planned_backlinks") > 10)) | (full & (F.col("planned_updates") > 6)) | (F.col("conflict_targets") >= 4) | (F.col("low_quality") >= 2)
    return x.withColumn("blocked", blocked).withColumn("level", F.when(F.col("blocked"), F.lit("high")).otherwise(F.lit("medium" if mode == "full-apply" and apply_backlinks else "low")))


def preview_counts(clusters: DataFrame, related: DataFrame, back: DataFrame) -> DataFrame:
    """(cluster_id, name, related, backlinks) of every planned cluster."""
    r, b = related.groupBy("cluster_id").agg(F.count("*").alias("related")), back.groupBy("cluster_id").agg(F.count("*").alias("backlinks"))
    return clusters.select("cluster_id", "name").join(r, "cluster_id", "left").join(b, "cluster_id", "left").select("cluster_id", "name", F.coalesce("related", F.lit(0)).alias("related"), F.coalesce("backlinks", F.lit(0)).alias("backlinks"))


def island_bridges(p: DataFrame, issues: DataFrame) -> DataFrame:
    """(page_ord, title, bridge, score): for each island the page that shares most title tokens (3) and tags (2), by equi-joins."""
    island = issues.where("kind = 'island'").select("page_ord").distinct()
    last = p.join(page_map(p).select("page_ord"), "page_ord", "left_semi")

    def parts(x: DataFrame, side: str) -> DataFrame:
        t = x.select(F.col("page_ord").alias(side), F.explode(F.array_distinct(T.raw_tokens("title"))).alias("term"), F.lit(3).alias("w"))
        g = x.select(F.col("page_ord").alias(side), F.explode(F.array_distinct("tags")).alias("term"), F.lit(2).alias("w"))
        return t.unionByName(g)

    mine, others = parts(last.join(island, "page_ord", "left_semi"), "a"), parts(last.join(island, "page_ord", "left_anti"), "b")
    s = mine.join(others, ["term", "w"]).groupBy("a", "b").agg(F.sum("w").alias("score"))
    best = s.groupBy("a").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("b"))).alias("m")).select(F.col("a").alias("page_ord"), F.col("m.b").alias("b"), (-F.col("m.s")).alias("score"))
    return best.join(last.select("page_ord", "title"), "page_ord").join(last.select(F.col("page_ord").alias("b"), F.col("title").alias("bridge")), "b").select("page_ord", "title", "bridge", "score")


def add_related(text: Column, new_titles: Column, self_title: Column) -> Column:
    """The text with names appended to its related field, or with a new field before the closing fence; else unchanged."""
    field = rf"(?md)^related:{K.WS}*\[(.*?)\]{K.WS}*$"
    merged = T.related_titles(F.concat(T.field_list(text, "related"), new_titles), self_title)
    line = F.concat(F.lit("related: ["), F.array_join(merged, ", "), F.lit("]"))
    at = F.regexp_instr(text, F.lit(field))
    old = F.regexp_extract(text, field, 0)
    changed = F.concat(text.substr(F.lit(1), at - 1), line, text.substr(at + F.length(old), F.length(text)))
    close = F.locate("\n---", text, 5)
    added = F.concat(text.substr(F.lit(1), close - 1), F.lit("\n"), line, text.substr(close, F.length(text)))
    return F.when(at > 0, changed).when(text.startswith("---\n") & (close > 0), added).otherwise(text)


def normal_related(text: Column, self_title: Column) -> Column:
    """The text with its related field in normal form."""
    field = rf"(?md)^related:{K.WS}*\[(.*?)\]{K.WS}*$"
    at, old = F.regexp_instr(text, F.lit(field)), F.regexp_extract(text, field, 0)
    new = F.concat(text.substr(F.lit(1), at - 1), T.related_line(old, self_title), text.substr(at + F.length(old), F.length(text)))
    return F.when(at > 0, new).otherwise(text)


def repair_plan(p: DataFrame, issues: DataFrame, mode: str = "safe-apply", most_related: int = 20, most_body: int = 10) -> DataFrame:
    """(seq, kind, page_ord, page_title, target_title): the repairs of a mode, within its limits, in the order of the report.

    Pages are looked up by title, the last page of a title. suggest-only plans nothing.
    """
    empty = p.sparkSession.createDataFrame([], "seq int, kind string, page_ord long, page_title string, target_title string")
    if mode not in ("safe-apply", "full-apply"):
        return empty
    last = page_map(p).withColumnRenamed("title", "page_title").withColumnRenamed("page_ord", "last_ord")

    def some(kind: str, action: str, most: int | None) -> DataFrame:
        x = issues.where(F.col("kind") == kind)
        if most is None:
            x = x.withColumn("seq", F.lit(1))
        else:  # a top-k first, so that only `most` rows are numbered in one task
            x = x.orderBy("page_ord", "target_title").limit(most).withColumn("seq", F.row_number().over(Window.orderBy("page_ord", "target_title")))
        return x.join(last, "page_title").select("seq", F.lit(action).alias("kind"), F.col("last_ord").alias("page_ord"), "page_title", "target_title")

    body = some("body_missing", "add_body", most_body)
    has_section = p.where(T.backlink_section("text") != K.NO_SECTION).select("page_ord")
    out = empty.unionByName(some("related_missing", "add_related", most_related)).unionByName(body.join(has_section, "page_ord", "left_semi").select(empty.columns))
    if mode == "full-apply":
        bridges = island_bridges(p, issues)
        out = out.unionByName(some("missing_type_field", "set_type", None))
        out = out.unionByName(bridges.select(F.lit(1).alias("seq"), F.lit("bridge").alias("kind"), "page_ord", F.col("title").alias("page_title"), F.col("bridge").alias("target_title")))
    return out


def apply_repairs(p: DataFrame, plan: DataFrame, normalise: bool = True) -> DataFrame:
    """(page_ord, title, text, new_text, changed): all repairs of a page in one projection; none overwrites another."""
    names = lambda kinds: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind").isin(*kinds), F.struct("seq", "target_title")))), lambda x: x["target_title"])
    todo = plan.groupBy("page_ord").agg(names(("add_related", "bridge")).alias("rel"), names(("add_body",)).alias("bod"), F.max((F.col("kind") == "set_type").cast("int")).alias("typ"))
    none = F.array().cast("array<string>")
    x = p.join(todo, "page_ord", "left").withColumn("rel", F.coalesce("rel", none)).withColumn("bod", F.coalesce("bod", none))
    t = F.when(F.size("rel") > 0, add_related(F.col("text"), F.col("rel"), F.col("title"))).otherwise(F.col("text"))
    x = x.withColumn("t1", t)
    x = x.withColumn("t2", F.aggregate("bod", F.col("t1"), lambda a, n: T.insert_in_section(a, T.backlink_section(a), F.concat(F.lit("- 关联页：[["), n, F.lit("]]")))))
    close = F.locate("\n---\n", F.col("t2"), 5)
    typed = F.concat(F.col("t2").substr(F.lit(1), close - 1), F.lit('\ntype: "guide"'), F.col("t2").substr(close, F.length("t2")))
    x = x.withColumn("t3", F.when((F.col("typ") == 1) & (close > 0) & ~F.col("t2").substr(F.lit(1), close - 1).contains("type:"), typed).otherwise(F.col("t2")))
    new = normal_related(F.col("t3"), F.col("title")) if normalise else F.col("t3")
    return x.select("page_ord", "title", "text", new.alias("new_text")).withColumn("changed", F.col("new_text") != F.col("text"))


def index_types(p: DataFrame) -> DataFrame:
    """(page_type, n) sorted by type when shown; unknown counts too."""
    return p.groupBy("page_type").agg(F.count("*").alias("n"))


def index_lines(p: DataFrame) -> DataFrame:
    """K3: (file_name, line) of the page list; order by file_name to print."""
    return p.select("file_name", F.concat(F.lit("- **"), F.col("title"), F.lit("** ("), F.col("page_type"), F.lit(") - `wiki/"), F.col("file_name"), F.lit("`")).alias("line"))
