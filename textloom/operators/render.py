"""Rendered pages and report texts (K1-K6, R11): columns of text; the day is a parameter."""

# All wording of pages, index, log and reports below (headings, labels, notes) is part of the result's format.

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.functions import text as T
from textloom.operators import corpus


def render_pages(clusters: DataFrame, members: DataFrame, related: DataFrame, batch: str, today: str) -> DataFrame:
    """(cluster_id, title, file_name, markdown) of planned clusters with their types; related: R4's rows.

    A cluster is a handful of rows here: at most 10 documents' sentences, 5 evidence lines, 20 sources.
    """
    sec = corpus.section_content(members, clusters)
    ordered = lambda k, v: F.transform(F.array_sort(F.collect_list(F.struct(k, v))), lambda x: x[v])
    blocks = sec.groupBy("cluster_id", "section").agg(ordered("rank", "sentence").alias("s")).groupBy("cluster_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "s"))).alias("sections"))
    first = corpus.title_ranked(members, 20)
    fact = F.coalesce(F.get(T.key_sentences(F.coalesce(T.blank_to_null(F.col("text")), F.col("preview")), 1), F.lit(0)), F.substring("preview", 1, 80))
    ev = first.where("title_rank <= 5").select("cluster_id", "title_rank", F.concat(F.lit("- `"), F.col("rel_path"), F.lit("`："), fact).alias("line")).groupBy("cluster_id").agg(ordered("title_rank", "line").alias("evidence"))
    src = first.select("cluster_id", "title_rank", F.concat(F.lit("- `"), F.col("rel_path"), F.lit("`")).alias("line")).groupBy("cluster_id").agg(ordered("title_rank", "line").alias("sources"))
    con = corpus.consensus(members).select("cluster_id", "rank", F.concat(F.lit("- 多篇 raw 反复提到“"), F.col("term"), F.lit("”，属于该主题稳定共识。")).alias("line")).groupBy("cluster_id").agg(ordered("rank", "line").alias("consensus"))
    div = corpus.divergence(members)
    text = F.when(F.col("n").isNotNull(), F.concat(F.lit("- 存在“"), F.col("point"), F.lit("”视角的子主题分化（"), F.col("n").cast("string"), F.lit(" 篇）。"))).otherwise(F.concat(F.lit("- 资料跨 "), F.replace("point", F.lit("~"), F.lit(" 到 ")), F.lit("，可能存在阶段性观点变化。")))
    dv = div.select("cluster_id", "rank", text.alias("line")).groupBy("cluster_id").agg(ordered("rank", "line").alias("divergence"))
    rel = related.groupBy("cluster_id").agg(ordered("rank", "title").alias("related"))
    x = clusters.join(corpus.summaries(clusters), "cluster_id")
    for df in (blocks, ev, src, con, dv, rel):
        x = x.join(df, "cluster_id", "left")
    title = corpus.page_title(F.col("name"), F.col("page_type"), F.col("months"), batch)
    x = x.withColumn("title", title)
    join = lambda c, alt: F.coalesce(T.blank_to_null(F.array_join(c, "\n")), F.lit(alt))
    block = F.concat(F.lit("## 主题摘要\n\n"), F.col("summary"), F.lit("\n\n## 共识\n\n"), join("consensus", "- 待补充人工共识提炼"), F.lit("\n\n## 分歧\n\n"), join("divergence", "- 当前未识别明显分歧，建议后续人工复核"), F.lit("\n"))
    for t, names in K.SECTION_ORDER.items():
        if not names:
            continue
        parts = []
        for n in names:
            items = F.array_join(F.transform(F.col("sections")[n], lambda s: F.concat(F.lit("- "), s)), "\n")
            parts.append(F.coalesce(F.concat(F.lit(f"## {n}\n"), T.blank_to_null(items), F.lit("\n")), F.lit(f"## {n}\n\n- 待补充\n")))
        block = F.when(F.col("page_type") == t, F.concat_ws("\n", *parts)).otherwise(block)
    x = x.withColumn("block", block)
    source = batch.split("_", 1)[1] if "_" in batch else batch
    alt = lambda c, sep, other: F.coalesce(T.blank_to_null(F.array_join(c, sep)), F.lit(other))
    names = T.related_titles(F.coalesce("related", F.array().cast("array<string>")), F.col("title"))
    md = F.concat(
        F.lit('---\ntitle: "'), F.col("title"), F.lit('"\ntype: "'), F.col("page_type"), F.lit(f'"\nsource: "{source}"\ncreated: {today}\nupdated: {today}\ntags: ['), alt(F.slice("hints_hit", 1, 8), ", ", "待整理"),
        F.lit("]\nrelated: ["), F.array_join(names, ", "), F.lit("]\nstatus: growing\nconfidence: "), F.col("quality_score").cast("string"), F.lit("\n---\n\n# "), F.col("title"), F.lit("\n\n## 核心结论\n\n"), F.col("summary"),
        F.lit("\n\n## 页面判定\n\n- 主类型："), F.col("page_type"), F.lit("\n- 候选类型："), F.array_join("candidates", "、"), F.lit("\n- 当前主题："), F.col("name"), F.lit(f"\n- 来源批次：{source}\n- 覆盖月份："), alt("months", "、", K.UNKNOWN),
        F.lit("\n- 主题锚点："), alt(F.slice("anchor_terms", 1, 6), "、", "待补充"), F.lit("\n- 聚类质量分："), F.col("quality_score").cast("string"), F.lit("\n\n"), F.col("block"), F.lit("\n## 证据摘录\n\n"), F.array_join("evidence", "\n"),
        F.lit("\n\n## 与其他知识的关联\n\n- 当前 related 基于页面类型、标题、标签、主题锚点综合生成。\n- 若需补旧页正文回链，建议先审阅 `backfill_suggestions` 报告再执行。\n\n## 风险提示\n\n- 当前内容为草稿页，不应直接视为成熟知识结论。\n- 自动聚类、页面类型判定与链接仍可能存在边界偏差，需要二次审阅。\n\n---\n\n**Raw Sources**:\n"),
        F.array_join("sources", "\n"), F.lit("\n"),
    )
    return x.select("cluster_id", "title", F.concat(T.slug("title"), F.lit(".md")).alias("file_name"), md.alias("markdown"))


def new_pages(rendered: DataFrame, existing: DataFrame) -> DataFrame:
    """K2: rendered pages whose file doesn't exist yet."""
    return rendered.join(existing.select("file_name"), "file_name", "left_anti")


def index_text(types: DataFrame, lines: DataFrame, raw_dir: str, today: str) -> str:
    """K3: the index file; types and lines as from the link operators. A text for people: it is as long as the page list."""
    t = sorted(types.collect(), key=lambda r: r["page_type"])
    rows = [r["line"] for r in lines.orderBy("file_name").toLocalIterator()]
    head = ["# 全局索引", "", "> 所有知识页面的目录。每次 INGEST 后自动更新。", "", "---", "", "## 统计", "", "| 类型 | 数量 |", "|------|------|", f"| 总页面数 | {sum(r['n'] for r in t)} |", *[f"| {r['page_type']} | {r['n']} |" for r in t]]
    return "\n".join(head) + "\n\n---\n\n## 页面列表\n\n" + "\n".join(rows) + f"\n\n---\n\n## 原始资料批次\n\n- `{raw_dir}/`\n\n---\n\n*最后更新: {today}*\n"


def log_block(now: str, raw_dir: str, mode: str, clusters: list[tuple[str, int]], created: list[str]) -> str:
    """K4: one log entry; at most eight topics."""
    lines = ["", f"### {now} — WIKI-BUILD", f"- Raw 批次: `{raw_dir}`", f"- 模式: `{mode}`", f"- 主题簇数: {len(clusters)}", f"- 新建页面数: {len(created)}"]
    return "\n".join([*lines, *[f"- 主题: `{n}` ({k} docs)" for n, k in clusters[:8]], *[f"- 新建: `{p}`" for p in created]]) + "\n"


def fix_log_block(now: str, missing: list[str]) -> str:
    """The log entry of pages that the log lacked (file names); 30 are listed."""
    return "\n".join(["", f"### {now} — WIKI-HEALTH-FIX", "- 操作: 批量补 log 缺失", f"- 修复页数: {len(missing)}", *[f"- `wiki/{f}`" for f in missing[:30]]]) + "\n"


def report(title: str, content: str) -> str:
    """K5."""
    return f"# {title}\n\n{content}"
