"""Research gaps of a page collection (X1-X14): each detector is a query over pages and links; scores are exact decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.links import edges, inbound, page_map

# Patterns in the order of the queue, and in the order of the scan.
PATTERNS = ("cross_topic", "cluster_gap", "broken_concept", "thin", "stale", "overweight")
SCAN_ORDER = ("cluster_gap", "cross_topic", "broken_concept", "thin", "overweight", "stale")
# Months after which a kind of topic is due, and whether it still moves.
CADENCE = {"paper": (6, True), "strategy": (12, True), "price": (12, True), "psychology": (12, False), "macro": (12, True), "concept": (18, False)}
# Sources to search by kind of topic, their grades, and routes by type of source.
SOURCES = {
    "paper": ("arxiv.org", "ssrn.com", "scholar.google.com", "paperswithbacktest.com", "quantpedia.com", "medium.com", "substack.com"),
    "price": ("mp.weixin.qq.com", "tradingview.com", "substack.com", "medium.com", "zhihu.com", "xueqiu.com"),
    "macro": ("eastmoney.com", "caixin.com", "aqr.com", "stats.gov.cn", "zhihu.com", "xueqiu.com"),
    "general": ("zhihu.com", "xueqiu.com"),
}
GRADES = {
    "arxiv.org": "A", "ssrn.com": "A", "scholar.google.com": "A", "paperswithbacktest.com": "A", "eastmoney.com": "A", "aqr.com": "A", "bridgewater.com": "A", "stats.gov.cn": "A",
    "quantpedia.com": "B", "medium.com": "B", "substack.com": "B", "mp.weixin.qq.com": "B", "tradingview.com": "B", "caixin.com": "B", "zhihu.com": "C", "xueqiu.com": "C",
}
ROUTES = {"paper": "paper", "report": "report", "wechat": "account_article"}
# Words of a title that promises more than one page.
WIDE_TITLES = ("综述", "汇总", "合集", "大全")
#: A page on one sentence ends at most one of these.
_STOPS = r"[。！？!?；;]"


def body_length(text: Column | str) -> Column:
    """Characters of the body without front matter and white space at the ends."""
    return F.length(T.body(text))


def thin_pages(p: DataFrame) -> DataFrame:
    """(page_ord, title, chars, related, grade): severe under 100 characters with over 5 related, thin under 200 or with one
    sentence and over 3 related. An empty body is thin."""
    b = T.body("text")
    x = p.select("page_ord", "title", F.length(b).alias("chars"), F.size("related").alias("related"), F.regexp_count(b, F.lit(_STOPS)).alias("stops"))
    grade = F.when((F.col("chars") < 100) & (F.col("related") > 5), F.lit("severe")).when((F.col("chars") < 200) | ((F.col("related") > 3) & (F.col("stops") <= 1)), F.lit("thin"))
    return x.withColumn("grade", grade).where("grade IS NOT NULL").select("page_ord", "title", "chars", "related", "grade")


def broken_concepts(p: DataFrame) -> DataFrame:
    """(target, refs, grade) of link targets without a page: now from 10 pages, medium from 5, low from 2."""
    t = page_map(p).select(F.col("title").alias("target"))
    x = inbound(edges(p)).join(t, "target", "left_anti").withColumnRenamed("inbound", "refs").where("refs >= 2")
    return x.select("target", "refs", F.when(F.col("refs") >= 10, F.lit("now")).when(F.col("refs") >= 5, F.lit("medium")).otherwise(F.lit("low")).alias("grade"))


def overweight_pages(p: DataFrame, split: int = 5_000, maybe: int = 2_000) -> DataFrame:
    """(page_ord, title, chars, sections, grade): split over 5,000 characters, splittable from 2,000 with 3 sections."""
    x = p.select("page_ord", "title", body_length("text").alias("chars"), F.regexp_count("text", F.lit(r"(?md)^##[ \t]")).alias("sections"))
    grade = F.when(F.col("chars") > split, F.lit("split")).when((F.col("chars") >= maybe) & (F.col("sections") >= 3), F.lit("splittable"))
    return x.withColumn("grade", grade).where("grade IS NOT NULL")


def overweight_signals(p: DataFrame, many: int = 5, broken: int = 3) -> DataFrame:
    """(page_ord, wide_title, many_sections, broken_links): signs that a page should be split; a page without any has no row.

    wide_title: the title holds one of WIDE_TITLES; many_sections: at least many second-level headings; broken_links: at
    least broken different links to names without a page.
    """
    e = edges(p).select("page_ord", "target").distinct()
    lost = e.join(page_map(p).select(F.col("title").alias("target")), "target", "left_anti").groupBy("page_ord").agg(F.count("*").alias("lost"))
    sections = F.regexp_count("text", F.lit(r"(?md)^##[ \t]"))
    x = p.select("page_ord", F.regexp_like("title", F.lit("|".join(WIDE_TITLES))).alias("wide_title"), (sections >= many).alias("many_sections")).join(lost, "page_ord", "left")
    x = x.select("page_ord", "wide_title", "many_sections", (F.coalesce("lost", F.lit(0)) >= broken).alias("broken_links"))
    return x.where("wide_title OR many_sections OR broken_links")


def _tags(p: DataFrame) -> DataFrame:
    return p.select("page_ord", "title", F.explode(F.array_distinct("tags")).alias("tag"))


def cluster_gaps(p: DataFrame) -> DataFrame:
    """(tag, pages, mutual, ready): tags of at least 3 pages without a page named by the tag; ready with 2 mutual related links.

    Mutual pairs are counted by equi-joins of related edges with their reverse and with the tags of both ends.
    """
    t = _tags(p)
    n = t.groupBy("tag").agg(F.countDistinct("page_ord").alias("pages")).where("pages >= 3")
    n = n.join(page_map(p).select(F.col("title").alias("tag")), "tag", "left_anti")
    e = edges(p).where("kind = 'related'").select("title", "target").distinct()
    pairs = e.join(e.select(F.col("title").alias("target"), F.col("target").alias("title")), ["title", "target"]).where("title < target")
    both = pairs.join(t.select("title", "tag").distinct(), "title").join(t.select(F.col("title").alias("target"), "tag").distinct(), ["target", "tag"])
    m = both.groupBy("tag").agg(F.count("*").alias("mutual"))
    return n.join(m, "tag", "left").select("tag", "pages", F.coalesce("mutual", F.lit(0)).alias("mutual")).withColumn("ready", F.col("mutual") >= 2)


def topic_bridges(p: DataFrame, least: int = 5) -> DataFrame:
    """(tag_a, tag_b, together, grade): pairs of tags with at least least pages each that occur on one page but have none named by both.

    A page's tags pair within the page (a handful); tags that never meet are no row.
    """
    big = _tags(p).groupBy("tag").agg(F.countDistinct("page_ord").alias("n")).where(F.col("n") >= least).select("tag")
    t = _tags(p).join(big, "tag", "left_semi").select("page_ord", "title", "tag").distinct()
    x = t.select("page_ord", "title", F.col("tag").alias("tag_a")).join(t.select("page_ord", F.col("tag").alias("tag_b")), "page_ord").where("tag_a < tag_b")
    named = F.max((F.col("title").contains(F.col("tag_a")) & F.col("title").contains(F.col("tag_b"))).cast("int"))
    g = x.groupBy("tag_a", "tag_b").agg(F.count("*").alias("together"), named.alias("bridged")).where("bridged = 0")
    return g.select("tag_a", "tag_b", "together", F.when(F.col("together") >= 3, F.lit("high")).otherwise(F.lit("low")).alias("grade"))


def stale_pages(p: DataFrame, as_of: str, kind: str = "page_type", updated: str = "updated") -> DataFrame:
    """(page_ord, title, months, grade): update after 12 months (later if its kind is settled), check after 6 if it moves."""
    now, then = F.lit(as_of).cast("timestamp"), F.col(updated)
    place = lambda t: F.dayofmonth(t) * 86_400 + F.hour(t) * 3_600 + F.minute(t) * 60 + F.second(t)
    months = (F.year(now) - F.year(then)) * 12 + F.month(now) - F.month(then) - F.when(place(now) < place(then), 1).otherwise(0)  # whole months
    moving = F.lit(True)
    for k, (_, m) in CADENCE.items():
        moving = F.when(F.col(kind) == k, F.lit(m)).otherwise(moving)
    x = p.withColumn("months", months.cast("long")).withColumn("moving", moving)
    grade = F.when((F.col("months") >= 12) & F.col("moving"), F.lit("update")).when(F.col("months") >= 12, F.lit("later")).when((F.col("months") >= 6) & F.col("moving"), F.lit("check"))
    return x.withColumn("grade", grade).where("grade IS NOT NULL").select("page_ord", "title", "months", "grade")


def band(x: Column, high: float, middle: float, reverse: bool = False) -> Column:
    """3 over high, 2 from middle, else 1; reversed for effort."""
    b = F.when(x > high, 3).when(x >= middle, 2).otherwise(1)
    return (4 - b if reverse else b).cast("int")


def priority(candidates: DataFrame) -> DataFrame:
    """Candidates (urgency, value, effort as 1-3) with score (exact decimal) and priority; medium is [1.5, 2.5)."""
    d = lambda c, w: F.col(c).cast("decimal(4,1)") * F.lit(w).cast("decimal(2,1)")
    x = candidates.withColumn("score", (d("urgency", "0.4") + d("value", "0.4") + d("effort", "0.2")).cast("decimal(4,1)"))
    return x.withColumn("priority", F.when(F.col("score") >= 2.5, F.lit("high")).when(F.col("score") >= 1.5, F.lit("medium")).otherwise(F.lit("low")))


def queue(candidates: DataFrame, most: int = 10) -> DataFrame:
    """The first most candidates (pattern, topic, ...) by priority, urgency, pattern, topic, with their place."""
    rank = lambda c, names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))
    order = [rank("priority", ("high", "medium", "low")), F.desc("urgency"), rank("pattern", PATTERNS), F.asc("topic")]
    top = candidates.orderBy(*order).limit(most)  # the feature's own cap
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def brief(candidates: DataFrame, most: int = 10, least: int = 2, budget: int = 20, sites: int = 2) -> DataFrame:
    """X11: the queue with how many candidates wait behind it and whether each is searched; no row under least candidates.

    A candidate takes up to sites searches of the budget, in the queue's order; those the budget doesn't reach aren't searched.
    """
    n = candidates.agg(F.count("*").alias("__n"))
    x = queue(candidates, most).crossJoin(F.broadcast(n))  # one row
    waiting = F.greatest(F.col("__n") - most, F.lit(0))
    return x.where(F.col("__n") >= least).withColumn("waiting", waiting).withColumn("searched", F.col("place") * sites <= budget).drop("__n")


def candidates(p: DataFrame, as_of: str | None = None, updated: str = "updated") -> DataFrame:
    """X1-X6 as (pattern, scan, topic, refs): one row a gap; scan is the pattern's place in the scan (X7); refs weighs urgency.

    Stale pages need a day and a column of dates; without either there are none.
    """

    def some(df: DataFrame, pattern: str, topic: Column, refs: Column) -> DataFrame:
        return df.select(F.lit(pattern).alias("pattern"), F.lit(SCAN_ORDER.index(pattern) + 1).alias("scan"), topic.alias("topic"), refs.cast("long").alias("refs"))

    inb = inbound(edges(p)).withColumnRenamed("target", "title")
    thin = thin_pages(p).join(inb, "title", "left")
    found = (
        some(thin, "thin", F.col("title"), F.coalesce("inbound", F.lit(0)))
        .unionByName(some(broken_concepts(p), "broken_concept", F.col("target"), F.col("refs")))
        .unionByName(some(overweight_pages(p), "overweight", F.col("title"), F.col("sections")))
        .unionByName(some(cluster_gaps(p), "cluster_gap", F.col("tag"), F.col("pages")))
        .unionByName(some(topic_bridges(p), "cross_topic", F.concat_ws(" / ", "tag_a", "tag_b"), F.col("together")))
    )
    if as_of is None or updated not in p.columns:
        return found
    stale = stale_pages(p, as_of, updated=updated).join(inb, "title", "left")
    return found.unionByName(some(stale, "stale", F.col("title"), F.coalesce("inbound", F.lit(0))))


def scored(c: DataFrame) -> DataFrame:
    """X8, X9 on candidates: urgency and value from the references, effort by pattern (splits and bridges take longest)."""
    effort = F.when(F.col("pattern").isin("overweight", "cross_topic"), 1).when(F.col("pattern").isin("cluster_gap", "stale"), 2).otherwise(3)
    return priority(c.withColumn("urgency", band(F.col("refs"), 15, 5)).withColumn("value", band(F.col("refs"), 20, 5)).withColumn("effort", effort.cast("int")))


def incomplete_cards(cards: DataFrame) -> DataFrame:
    """Cards that lack one of the six required fields (null or blank)."""
    bad = F.lit(False)
    for c in ("topic", "type", "priority", "evidence", "sources", "next_step"):
        bad = bad | F.coalesce(T.strip(F.col(c).cast("string")) == "", F.lit(True))
    return cards.where(bad)


def source_grades(urls: DataFrame, url: str = "url") -> DataFrame:
    """Urls with host and grade A, B or C (others)."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")
    g = F.lit("C")
    for h, v in GRADES.items():
        g = F.when((host == h) | host.endswith("." + h), F.lit(v)).otherwise(g)
    return urls.withColumn("host", host).withColumn("grade", F.when(host != "", g))


def search_plan(topics: DataFrame, kind: str = "kind") -> DataFrame:
    """Topics with place, site and grade: the sites of the topic's kind in order, general ones for other kinds."""
    row = lambda k: F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(s).alias("site"), F.lit(GRADES[s]).alias("grade")) for i, s in enumerate(SOURCES[k])])
    sites = row("general")
    for k in SOURCES:
        sites = F.when(F.col(kind) == k, row(k)).otherwise(sites)
    return topics.withColumn("__s", F.explode(sites)).select(*topics.columns, "__s.place", "__s.site", "__s.grade")


def route(source_type: Column) -> Column:
    """Where a source of a type goes; null for none."""
    out = F.lit(None).cast("string")
    for k, v in ROUTES.items():
        out = F.when(source_type == k, F.lit(v)).otherwise(out)
    return out


