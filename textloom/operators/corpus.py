"""Documents, term counts, topic clusters and their types.

Everything is a DataFrame in, DataFrame out. Null text is empty, null months are unknown, arrays lose null and blank
elements; documents with a null id are left out. A cluster's id is the smallest document id in it. Ties go to what
comes first by (document id, place), never to shuffle order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.functions import text as T
from textloom.shared import Scratch, materialize


def documents(raw: DataFrame) -> DataFrame:
    """(doc_ord, rel_path, title, month, preview, text, title_key, tags, tokens) from stored documents; a repeated row counts as often as it comes."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return raw.where(F.col("doc_ord").isNotNull()).select(
        F.col("doc_ord").cast("long").alias("doc_ord"), s("rel_path").alias("rel_path"), s("title").alias("title"), F.coalesce("month", F.lit(K.UNKNOWN)).alias("month"),
        s("preview").alias("preview"), s("text").alias("text"), s("title_key").alias("title_key"), T.clean_array("tags").alias("tags"), T.clean_array("tokens").alias("tokens"),
    )


def derive(files: DataFrame, hints: Sequence[str], id_col: str = "doc_ord") -> DataFrame:
    """Every feature of Markdown files (id, rel_path, text): title, month, preview, tokens, title key, hint scores, tags."""
    stem = F.regexp_replace(F.regexp_extract("rel_path", r"([^/]*)$", 1), r"\.md$", "")
    d = files.select(F.col(id_col).alias("doc_ord"), "rel_path", T._c("text").alias("text"))
    d = d.withColumn("title", T.title("text", stem)).withColumn("month", T.month_of_path("rel_path")).withColumn("preview", T.preview("text"))
    d = d.withColumn("tokens", T.tokens("text")).withColumn("title_key", T.title_key("title")).withColumn("score_map", hint_scores(F.col("title"), F.col("preview"), hints))
    return d.withColumn("tags", top_hints(F.col("score_map")))


def hint_scores(title: Column, preview: Column, hints: Sequence[str]) -> Column:
    """Map of the hints that score: 4 in the title, 2 in the preview, 1 for each piece of two characters in either."""
    import re

    t, p = F.lower(T._c(title)), F.lower(T._c(preview))
    hay = F.concat(t, F.lit("\n"), p)
    entries = []
    for h in dict.fromkeys(hints):
        low = h.lower()
        score = F.when(t.contains(low), 4).otherwise(0) + F.when(p.contains(low), 2).otherwise(0)
        for piece in re.split(r"[、，,\s/]+", low):
            if len(piece) >= 2:
                score = score + F.when(hay.contains(piece), 1).otherwise(0)
        entries.append(F.struct(F.lit(h).alias("key"), score.cast("int").alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"] > 0))


def top_hints(score_map: Column, most: int = 5) -> Column:
    """O1: hints of the highest scores, then by name."""
    e = F.array_sort(F.transform(F.map_entries(score_map), lambda x: F.struct((-x["value"]).alias("s"), x["key"].alias("h"))))
    return F.slice(F.transform(e, lambda x: x["h"]), 1, most)


def term_counts(docs: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """(by..., term, n, first): occurrences in an array column and the first (doc_ord, pos); combined before the shuffle."""
    rows = docs.select(*by, "doc_ord", F.posexplode(column).alias("pos", "term"))
    return rows.groupBy(*by, "term").agg(F.count("*").alias("n"), F.min(F.struct("doc_ord", "pos")).alias("first"))


def top_terms(docs: DataFrame, column: str, by: Sequence[str], most: int) -> DataFrame:
    """A1, A2: (by..., rank, term, n) of the most frequent terms, ties to the first seen."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "first")
    return term_counts(docs, column, by).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(*by, "rank", "term", "n")


def ranked_list(df: DataFrame, by: str, name: str) -> DataFrame:
    """(by, name): the terms of a ranked table as one array in rank order; as long as the ranks kept."""
    return df.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias(name))


def assign(docs: DataFrame) -> DataFrame:
    """Docs with bucket, split, cluster_id and the order of clusters (bucket_ord, rest, size_ord, month_ord).

    Counts per bucket, key and month are aggregated first; documents meet only those small tables, never each other.
    """
    bucket = F.coalesce(F.get("tags", F.lit(0)), F.when(F.length("title_key") >= 2, F.col("title_key")), F.lit(K.UNSORTED))
    d = docs.withColumn("bucket", bucket).withColumn("key", F.when(F.length("title_key") >= 2, F.col("title_key")).otherwise(F.col("bucket")))
    keys = d.groupBy("bucket", "key").agg(F.count("*").alias("key_n"))
    months = d.groupBy("bucket", "month").agg(F.count("*").alias("month_n"))
    significant = (F.col("key_n") >= 2) & (F.col("key") != F.col("bucket"))
    k = keys.groupBy("bucket").agg(F.sum("key_n").alias("n"), F.sum(significant.cast("int")).alias("keys"))
    m = months.groupBy("bucket").agg(F.count("*").alias("months"))
    first = d.groupBy("bucket").agg(F.min("doc_ord").alias("bucket_ord"))
    stats = k.join(m, "bucket").join(first, "bucket")
    how = F.when((F.col("n") > 6) & (F.col("keys") >= 2), F.lit("key")).when((F.col("n") > 6) & (F.col("months") >= 3), F.lit("month")).otherwise(F.lit("all"))
    # documents are many to a bucket: only slim rows meet the small tables, in joins that AQE broadcasts by their size
    # or splits where a bucket is hot; features and texts join the result by id
    slim = d.select("doc_ord", "bucket", "key", "month").distinct().join(keys.join(stats, "bucket"), ["bucket", "key"])
    slim = slim.withColumn("how", how)
    mine = significant & (F.col("how") == "key")
    slim = slim.withColumn("split", F.when(mine, F.concat(F.lit("k:"), F.col("key"))).when(F.col("how") == "month", F.concat(F.lit("m:"), F.col("month"))).otherwise(F.lit("")))
    slim = slim.withColumn("rest", ((F.col("how") == "key") & ~mine).cast("int")).withColumn("size_ord", F.when(mine, -F.col("key_n")).otherwise(F.lit(0))).withColumn("month_ord", F.when(F.col("how") == "month", F.col("month")).otherwise(F.lit("")))
    slim = materialize(slim.select("doc_ord", "bucket", "key", "month", "split", "rest", "size_ord", "month_ord", "bucket_ord"), "assigned")
    slim = slim.join(slim.groupBy("bucket", "split").agg(F.min("doc_ord").alias("cluster_id")), ["bucket", "split"])
    return d.join(slim, ["doc_ord", "bucket", "key", "month"]).drop("key")


def title_ranked(members: DataFrame, most: int) -> DataFrame:
    """O3: members with title_rank, the first most of each cluster by title, then id."""
    w = Window.partitionBy("cluster_id").orderBy("title", "doc_ord")
    return members.withColumn("title_rank", F.row_number().over(w)).where(F.col("title_rank") <= most)


def cluster_table(members: DataFrame) -> DataFrame:
    """C3, A1, A2, A5 inputs, A6, C5: one row a cluster: name, hints_hit, anchor_terms, months, docs, quality."""
    base = members.groupBy("cluster_id").agg(
        F.count("*").alias("docs"), F.array_sort(F.collect_set("month")).alias("months"), F.min("bucket_ord").alias("bucket_ord"),
        F.min("rest").alias("rest"), F.min("size_ord").alias("size_ord"), F.min("month_ord").alias("month_ord"),
    )
    hints = ranked_list(top_terms(members, "tags", ["cluster_id"], 8), "cluster_id", "hints_hit")
    anchors = ranked_list(top_terms(members, "tokens", ["cluster_id"], 8), "cluster_id", "anchor_terms")
    key_n = members.where(F.col("title_key") != "").groupBy("cluster_id", "title_key").agg(F.count("*").alias("n"), F.min("doc_ord").alias("first"))
    keys = key_n.groupBy("cluster_id").agg(F.count("*").alias("title_keys"), F.min(F.when(F.length("title_key") >= 2, F.struct(-F.col("n"), F.col("first"), F.col("title_key").alias("k"))))["k"].alias("top_key"))
    empty = F.array().cast("array<string>")
    c = base.join(hints, "cluster_id", "left").join(anchors, "cluster_id", "left").join(keys, "cluster_id", "left")
    c = c.withColumn("hints_hit", F.coalesce("hints_hit", empty)).withColumn("anchor_terms", F.coalesce("anchor_terms", empty)).withColumn("title_keys", F.coalesce("title_keys", F.lit(0)))
    name = F.coalesce(F.get("hints_hit", F.lit(0)), F.col("top_key"), T.blank_to_null(F.array_join(F.slice("anchor_terms", 1, 2), " / ")), F.lit(K.UNSORTED))
    known = F.filter("months", lambda x: x != K.UNKNOWN)
    flags = [
        (F.col("docs") == 1, 25, "仅 1 篇 raw，主题稳定性弱"),
        (F.size("anchor_terms") >= 6, 10, "锚点词较发散，可能混入异质内容"),
        (F.size(known) >= 3, 10, "跨月跨度较大，建议检查是否应继续拆分"),
        (F.col("title_keys") >= 4, 10, "标题模式较杂，聚类边界可能偏宽"),
        (F.size("hints_hit") == 0, 8, "未命中明确 topic-hints，建议补 hint 或人工命名"),
    ]
    score = F.lit(100)
    for cond, points, _ in flags:
        score = score - F.when(cond, points).otherwise(0)
    return c.withColumn("name", name).withColumn("quality_score", F.greatest(score, F.lit(0)).cast("int")).withColumn("quality_flags", F.filter(F.array(*[F.when(cond, F.lit(text)) for cond, _, text in flags]), lambda x: x.isNotNull()))


def cluster_order() -> list[Column]:
    """O2: most documents, most hints, then the order of creation."""
    return [F.desc("docs"), F.desc(F.size("hints_hit")), F.asc("bucket_ord"), F.asc("rest"), F.asc("size_ord"), F.asc("month_ord"), F.asc("cluster_id")]


def summaries(clusters: DataFrame) -> DataFrame:
    """(cluster_id, summary)."""
    months = F.array_join(F.slice(F.filter("months", lambda x: x != K.UNKNOWN), 1, 3), "、")
    anchors = F.when(F.size("anchor_terms") > 0, F.array_join(F.slice("anchor_terms", 1, 4), "、")).otherwise(F.col("name"))
    text = F.concat(F.lit("该专题聚合了 "), F.col("docs").cast("string"), F.lit(" 篇 raw，主要围绕“"), F.col("name"), F.lit("”，覆盖时间 "), F.coalesce(T.blank_to_null(months), F.lit("多批次")), F.lit("，高频锚点包括 "), anchors, F.lit("。"))
    return clusters.select("cluster_id", text.alias("summary"))


def consensus(members: DataFrame, most: int = 3) -> DataFrame:
    """A4: (cluster_id, rank, term, n): tokens of two characters in at least two places, in the order of first sight over titles."""
    rows = members.select("cluster_id", "title", "doc_ord", F.posexplode("tokens").alias("pos", "term")).where(F.length("term") >= 2)
    seen = rows.groupBy("cluster_id", "term").agg(F.count("*").alias("n"), F.min(F.struct("title", "doc_ord", "pos")).alias("first")).where("n >= 2")
    return seen.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("first"))).where(F.col("rank") <= most).select("cluster_id", "rank", "term", "n")


def divergence(members: DataFrame) -> DataFrame:
    """A5: (cluster_id, rank, point, n): the two most frequent title keys where there are two, then the span of known months."""
    keys = members.where(F.col("title_key") != "").groupBy("cluster_id", "title_key").agg(F.count("*").alias("n"), F.min(F.struct("title", "doc_ord")).alias("first"))
    w = Window.partitionBy("cluster_id")
    keys = keys.withColumn("kinds", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "first"))).where("kinds >= 2 AND rank <= 2")
    span = members.where(F.col("month") != K.UNKNOWN).groupBy("cluster_id").agg(F.min("month").alias("lo"), F.max("month").alias("hi")).where("lo <> hi")
    return keys.select("cluster_id", "rank", F.col("title_key").alias("point"), "n").unionByName(span.select("cluster_id", F.lit(3).alias("rank"), F.concat_ws("~", "lo", "hi").alias("point"), F.lit(None).cast("long").alias("n")))


def tag_types(pages: DataFrame) -> DataFrame:
    """(tag, ptype, n) over pages; types that aren't page types count as guide."""
    ptype = F.when(F.col("page_type").isin(*K.TYPES), F.col("page_type")).otherwise(F.lit("guide"))
    return pages.select(F.explode("tags").alias("tag"), ptype.alias("ptype")).groupBy("tag", "ptype").agg(F.count("*").alias("n"))


def type_scores(members: DataFrame, clusters: DataFrame, pages: DataFrame | None = None, source_type: str = "mixed") -> DataFrame:
    """(cluster_id, ptype, score, hits, rank) for each of the five types, best first, ties by name; hits: the reasons."""
    first = title_ranked(members, 6)
    hay = F.lower(F.concat_ws("\n", F.col("title"), F.col("preview"), F.array_join(F.slice("tags", 1, 5), "\n"), F.array_join(F.slice("tokens", 1, 20), "\n")))
    low = F.lower("title")
    has = lambda x, words: F.regexp_like(x, F.lit("|".join(words)))
    flags = [F.max(hay.contains(w.lower()).cast("int")).alias(f"k_{t}_{i}") for t, ws in K.TYPE_KEYWORDS.items() for i, w in enumerate(ws)]
    marks = [F.sum(((F.col("title_rank") <= 3) & has(low, ws)).cast("int")).alias(f"t_{t}") for t, ws in K.TITLE_MARKS.items()]
    wide = first.groupBy("cluster_id").agg(*flags, *marks)
    parts = []
    for t in K.TYPES:
        s = F.lit(1 if K.SOURCE_BONUS.get(source_type) == t else 0) + 4 * F.col(f"t_{t}")
        for i in range(len(K.TYPE_KEYWORDS[t])):
            s = s + 2 * F.col(f"k_{t}_{i}")
        words = F.array(*[F.when(F.col(f"k_{t}_{i}") == 1, F.lit(K.HIT_WORD.format(w))) for i, w in enumerate(K.TYPE_KEYWORDS[t])])
        titles = F.array_repeat(F.lit(K.HIT_TITLE.format(K.TITLE_MARKS[t][0])), F.col(f"t_{t}").cast("int"))
        source = F.array(F.lit(K.HIT_SOURCE.format(source_type))) if K.SOURCE_BONUS.get(source_type) == t else F.array().cast("array<string>")
        hits = F.concat(F.filter(words, lambda x: x.isNotNull()), titles, source)
        parts.append(F.struct(F.lit(t).alias("ptype"), s.cast("long").alias("score"), hits.alias("hits")))
    scores = wide.select("cluster_id", F.explode(F.array(*parts)).alias("x")).select("cluster_id", "x.*")
    if pages is not None:
        tags = tag_types(pages)
        hits = clusters.select("cluster_id", F.posexplode("hints_hit").alias("at", "tag")).join(tags, "tag").groupBy("cluster_id", "ptype").agg(F.least(F.min_by("n", "at"), F.lit(3)).alias("boost"))
        total = tags.groupBy("tag").agg(F.sum("n").alias("all"))
        major = tags.join(total, "tag").where("n * 2 >= all").select("tag", "ptype")
        names = clusters.select("cluster_id", F.explode(F.array_distinct(T.raw_tokens("name"))).alias("tag")).join(major, "tag").groupBy("cluster_id", "ptype").agg((F.count("*") * 2).alias("boost"))
        boosts = hits.unionByName(names).groupBy("cluster_id", "ptype").agg(F.sum("boost").alias("boost"))
        boosted = F.when(F.col("boost").isNotNull(), F.concat("hits", F.array(F.concat(F.lit(K.HIT_TAGS), F.col("boost").cast("string"))))).otherwise(F.col("hits"))
        scores = scores.join(boosts, ["cluster_id", "ptype"], "left").select("cluster_id", "ptype", (F.col("score") + F.coalesce("boost", F.lit(0))).alias("score"), boosted.alias("hits"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("score"), "ptype")
    return scores.withColumn("rank", F.row_number().over(w))


def page_types(scores: DataFrame) -> DataFrame:
    """(cluster_id, page_type, candidates, best): types within two points of the best, at most three; guide by default."""
    one = scores.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ptype", "score"))).alias("s"))  # five rows a cluster
    best = F.element_at("s", 1)["score"]
    cand = F.transform(F.filter("s", lambda x: x["score"] >= F.greatest(best - 2, F.lit(1))), lambda x: x["ptype"])
    cand = F.when((F.size(cand) == 1) & (best < 4) & ~F.array_contains(cand, "guide"), F.concat(cand, F.array(F.lit("guide")))).otherwise(cand)
    cand = F.when(best <= 0, F.array(F.lit("guide"), F.lit("topic"))).otherwise(F.slice(cand, 1, 3))
    return one.select("cluster_id", F.element_at(cand, 1).alias("page_type"), cand.alias("candidates"), best.alias("best"))


def type_breakdown(scores: DataFrame) -> DataFrame:
    """(cluster_id, breakdown): the types with their scores and reasons, best first, and the lead of the first."""
    one = scores.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ptype", "score", "hits"))).alias("s"))  # five rows a cluster
    why = lambda x: F.when(F.size(x["hits"]) > 0, F.array_join(x["hits"], "、")).otherwise(F.lit(K.NO_HIT))
    lines = F.array_join(F.transform("s", lambda x: F.concat(F.lit("- **"), x["ptype"], F.lit("**: "), x["score"].cast("string"), F.lit(K.POINTS), why(x))), "\n")
    lead = F.element_at("s", 1)["score"] - F.element_at("s", 2)["score"]
    text = F.concat(F.lit(K.BREAKDOWN + "\n"), lines, F.lit("\n" + K.BEST_TYPE), F.element_at("s", 1)["ptype"], F.lit(K.LEAD), lead.cast("string"), F.lit(")"))
    return one.select("cluster_id", F.when(F.element_at("s", 1)["score"] <= 0, F.lit(K.NO_SCORE)).otherwise(text).alias("breakdown"))


def page_title(name: Column, page_type: Column, months: Column, batch: str) -> Column:
    """T33."""
    prefix = batch.split("_", 1)[1] if "_" in batch else batch
    known = F.filter(months, lambda x: x != K.UNKNOWN)
    first, last = F.get(known, F.lit(0)), F.get(known, F.size(known) - 1)
    span = F.when(F.size(known) == 0, F.lit("")).when(F.size(known) == 1, F.concat(F.lit("（"), first, F.lit("）"))).otherwise(F.concat(F.lit("（"), first, F.lit("~"), last, F.lit("）")))
    base = F.coalesce(T.blank_to_null(F.regexp_replace(name, r"^[-—_ ]+|[-—_ ]+$", "")), F.lit(K.UNSORTED))
    suffix = F.lit("专题")
    for t, s in K.TYPE_SUFFIX.items():
        suffix = F.when(page_type == t, F.lit(s)).otherwise(suffix)
    base = F.when(F.regexp_like(base, F.lit(f"(?:{'|'.join(K.TITLE_ENDS)})$")), base).otherwise(F.concat(base, suffix))
    return F.concat(F.lit(f"{prefix}："), base, span)


def planned(raw: DataFrame, pages: DataFrame | None = None, most: int = 5, source_type: str = "mixed") -> tuple[DataFrame, DataFrame]:
    """(the first most clusters with their page types and cluster_rank, their members). most is the feature's own cap.

    Tables in the shared folder keep later questions from repeating the clustering. Texts and previews stay out of it;
    only the planned clusters' documents get them back.
    """
    docs = documents(raw)
    with Scratch(raw.sparkSession) as tables:
        members = materialize(assign(docs.drop("text", "preview")), "members")
        top = cluster_table(members).orderBy(*cluster_order()).limit(most)
        top = materialize(top.withColumn("cluster_rank", F.row_number().over(Window.orderBy(*cluster_order()))), "planned")  # at most `most` rows
        mine = members.join(F.broadcast(top.select("cluster_id")), "cluster_id", "left_semi")
        texts = docs.select("doc_ord", "preview", "text").join(mine.select("doc_ord").distinct(), "doc_ord", "left_semi").dropDuplicates(["doc_ord"])
        mine = tables.keep(materialize(mine.join(texts, "doc_ord"), "planned-members"))
        types = page_types(type_scores(mine, top.select("cluster_id", "name", "hints_hit"), pages, source_type))
        return tables.keep(materialize(top.join(types, "cluster_id"), "planned-types")), mine


def section_content(members: DataFrame, types: DataFrame, docs: int = 10, sentences: int = 15, most: int = 3) -> DataFrame:
    """(cluster_id, section, rank, sentence): the first sentences of each section of the cluster's page type."""
    t = members.join(types.select("cluster_id", "page_type"), "cluster_id")
    first = title_ranked(t, docs).select("cluster_id", "page_type", "title_rank", F.posexplode(T.key_sentences(F.coalesce(T.blank_to_null(F.col("text")), F.col("preview")), sentences)).alias("pos", "sentence"))
    tests = [F.when((F.col("page_type") == t) & F.regexp_like("sentence", F.lit("|".join(ws))), F.lit(s)) for t, sections in K.SECTION_KEYWORDS.items() for s, ws in sections.items()]
    rows = first.select("cluster_id", "title_rank", "pos", "sentence", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("section"))
    one = rows.groupBy("cluster_id", "section", "sentence").agg(F.min(F.struct("title_rank", "pos")).alias("first"))
    w = Window.partitionBy("cluster_id", "section").orderBy("first")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("cluster_id", "section", "rank", "sentence")
