"""Whole tasks as plans over tables (K6, K7, M1, R9, U6, U7, W7): decisions first, one projection applies them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import corpus, ingest, links, render
from textloom.shared import materialize


def resolve_task(task: str | None, health_check: bool = False, repair: bool = False) -> str:
    """M1: the named task, else the one of a flag, else ingest."""
    return task or ("repair" if repair else "health-check" if health_check else "ingest")


def knowledge_plan(raw: DataFrame, pages: DataFrame, batch: str, today: str, most: int = 5, source_type: str = "mixed", mode: str = "full-apply", min_score: int = 8) -> dict[str, DataFrame]:
    """Named tables of one build: clusters, related, backlinks, conflicts, gate, preview, pages, page_updates.

    Scores of cluster-page pairs are made once and serve all of them. The gate keeps old pages from being rewritten, not
    new ones from being made.
    """
    p = materialize(links.with_inbound(links.pages(pages)), "pages")
    top, members = corpus.planned(raw, p, most, source_type)
    top = top.withColumn("title", corpus.page_title(F.col("name"), F.col("page_type"), F.col("months"), batch))
    scores = materialize(links.cluster_page_scores(top, p), "scores")
    related, back = links.related_candidates(scores), materialize(links.backlinks(scores, top, p, "title"), "backlinks")
    conflict = links.conflicts(top, members, p)
    gate = links.risk_gate(top, links.backlinks(scores, top, p, "name"), conflict, mode, True, min_score)
    rendered = render.render_pages(top, members, related, batch, today)
    allowed = gate.where("NOT blocked").select(F.lit(True).alias("go"))
    updates = links.apply_backlinks(back.where(F.col("score") >= min_score), p).crossJoin(F.broadcast(allowed)).drop("go")  # one row or none
    return {
        "clusters": top, "related": related, "backlinks": back, "conflicts": conflict, "gate": gate, "preview": links.preview_counts(top, related, back),
        "pages": render.new_pages(rendered, p), "page_updates": updates,
    }


def health_plan(pages: DataFrame, mode: str = "suggest-only", index_text: str = "", log_text: str = "", most_related: int = 20, most_body: int = 10) -> dict[str, DataFrame]:
    """Issues, totals (before the repair), report rows, the repair plan and the repaired pages."""
    p = links.pages(pages)
    issues = links.health_issues(p, index_text, log_text)
    plan = links.repair_plan(p, issues, mode, most_related, most_body)
    return {"issues": issues, "totals": links.health_totals(issues), "report": links.report_rows(issues), "plan": plan, "pages": links.apply_repairs(p, plan, mode != "suggest-only")}


def ingest_plan(articles: DataFrame, history_links: DataFrame, keywords: tuple[str, ...] = (), until: str | None = None) -> dict[str, DataFrame]:
    """New, skipped and exported articles of a batch; running it again with its links in the history adds nothing."""
    x = ingest.keyword_filter(ingest.once(articles), keywords)
    x = ingest.until_filter(x, until) if until else x
    new, skipped = ingest.split_new(x, history_links)
    return {"new": new, "skipped": skipped, "export": ingest.markdown_export(new)}
