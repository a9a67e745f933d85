from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.operators import links
from textloom.plans import pipeline

ALPHA = "---\ntitle: Alpha\ntype: guide\nrelated: [Beta, [[Beta]], 'Gamma', \"Gamma\"]\n---\n\n# Alpha\n\nAlpha 正文。\n"
BETA = "---\ntitle: Beta\ntype: guide\nrelated: [Alpha]\n---\n\n# Beta\n\nBeta 正文。\n\n## 与其他知识的关联\n"
GAMMA = "---\ntitle: Gamma\ntype: guide\nrelated: []\n---\n\n# Gamma\n\nGamma 正文。\n\n## 与其他知识的关联\n"


@pytest.fixture(scope="module")
def pages(spark):
    files = spark.createDataFrame([(0, "alpha.md", ALPHA), (1, "beta.md", BETA), (2, "gamma.md", GAMMA)], "page_ord long, file_name string, text string")
    return links.derive_pages(files)


@pytest.fixture(scope="module")
def issues(pages):
    return links.health_issues(pages, "# Index\n", "# Log\n")


def kind(issues, k):
    return sorted((r.page_title, r.target_title) for r in issues.where(F.col("kind") == k).collect())


def test_pages(pages):
    got = {r.title: (r.page_type, r.related) for r in pages.collect()}
    assert got == {"Alpha": ("guide", ["Beta", "Gamma"]), "Beta": ("guide", ["Alpha"]), "Gamma": ("guide", [])}


def test_health(pages, issues):
    assert {r.title: r.inbound_refs for r in links.with_inbound(pages).collect()} == {"Alpha": 1, "Beta": 1, "Gamma": 1}
    assert kind(issues, "one_way") == [("Alpha", "Gamma")]
    assert kind(issues, "related_missing") == []
    assert kind(issues, "body_missing") == [("Alpha", "Gamma"), ("Beta", "Alpha")]
    assert kind(issues, "island") == []
    assert kind(issues, "pseudo") == [("Gamma", None)]
    assert len(kind(issues, "index_missing")) == 3 and len(kind(issues, "log_missing")) == 3
    assert kind(issues, "missing_related_field") == [] and kind(issues, "missing_type_field") == []
    assert {r.kind: r.n for r in links.health_totals(issues).collect()}["body_missing"] == 2


def test_repair(pages, issues):
    plan = links.repair_plan(pages, issues, "safe-apply")
    assert [(r.kind, r.page_title, r.target_title) for r in plan.collect()] == [("add_body", "Beta", "Alpha")]
    new = {r.title: r.new_text for r in links.apply_repairs(pages, plan).collect()}
    assert "related: [Beta, Gamma]" in new["Alpha"] and "- 关联页：[[Alpha]]" in new["Beta"] and new["Gamma"] == GAMMA
    again = pages.drop("text").join(links.apply_repairs(pages, plan).select("page_ord", F.col("new_text").alias("text")), "page_ord").select(pages.columns)
    assert links.repair_plan(pages, issues, "suggest-only").count() == 0
    assert links.apply_repairs(again, plan.where("false")).where("changed").count() == 0


def test_add_related(spark):
    def add(text, names, own="S"):
        df = spark.createDataFrame([(text, names)], "t string, n array<string>")
        return df.select(links.add_related(F.col("t"), F.col("n"), F.lit(own)).alias("x")).first().x

    assert add("---\nrelated: [A]\n---\nb", ["B", "A", "S"]) == "---\nrelated: [A, B]\n---\nb"
    assert add("---\ntitle: x\n---\nb", ["B"]) == "---\ntitle: x\nrelated: [B]\n---\nb"
    assert add("plain", ["B"]) == "plain"


def test_both_repairs_of_a_page_stay(spark, pages):
    plan = spark.createDataFrame([(1, "add_related", 1, "Beta", "Gamma"), (1, "add_body", 1, "Beta", "Alpha"), (1, "set_type", 1, "Beta", None)], "seq int, kind string, page_ord long, page_title string, target_title string")
    new = links.apply_repairs(pages, plan).where("page_ord = 1").first().new_text
    assert "related: [Alpha, Gamma]" in new and "- 关联页：[[Alpha]]" in new


def test_empty_and_null_pages(spark):
    raw = spark.createDataFrame([(1, None, None, None, None, None, None), (None, "x", "x", "x", [], [], "x")], "page_ord long, file_name string, title string, type string, tags array<string>, related array<string>, text string")
    p = links.pages(raw)
    assert links.health_issues(p, "i", "l").count() >= 1
    empty = links.pages(raw.where("false"))
    assert links.health_issues(empty).count() == 0
    assert {r.n for r in links.health_totals(links.health_issues(empty)).collect()} == {0}


def test_task():
    assert pipeline.resolve_task(None, health_check=True) == "health-check"
    assert pipeline.resolve_task(None) == "ingest" and pipeline.resolve_task("repair") == "repair"
