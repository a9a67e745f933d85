from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.operators import corpus, links

RAW = "doc_ord long, rel_path string, title string, month string, preview string, text string, title_key string, tags array<string>, tokens array<string>"
PAGE = "page_ord long, file_name string, title string, type string, tags array<string>, related array<string>, text string"


@pytest.fixture(scope="module")
def build(spark):
    text = "动量因子，回撤控制，窗口 alpha 不再有效。动量因子，回撤控制，适合 alpha 组合。"
    raw = spark.createDataFrame([(i, f"2024-01/{i}.md", "动量策略综述", "2024-01", text, text, "动量", ["动量因子"], ["动量因子", "回撤控制", "alpha"]) for i in range(3)], RAW)
    pages = spark.createDataFrame(
        [
            (0, "a.md", "动量因子指南", "guide", ["动量因子"], [], "---\ntags: [动量因子]\n---\n动量因子，回撤控制，适合 alpha 组合。\n\n## 关联\n- x\n"),
            (1, "b.md", "动量因子", "concept", [], [], "动量因子，回撤控制，避免 alpha 失真。"),
            (2, "c.md", "无关页", "log", ["其他"], ["动量因子"], "[[动量因子]] 与此无关。"),
            (3, "d.md", "动量因子", "concept", [], [], "动量因子，回撤控制，避免 alpha 失真。"),
        ],
        PAGE,
    )
    p = links.with_inbound(links.pages(pages)).cache()
    top, members = corpus.planned(raw, p)
    return top, members, p, links.cluster_page_scores(top, p).cache()


def test_scores(build):
    top, _, _, scores = build
    assert top.count() == 1 and top.first()["name"] == "动量因子"
    got = {r.page_ord: r for r in scores.collect()}
    # 8 named, 3 shared hint, 2 for one anchor in the title, and the match of types
    kind = top.first().page_type
    bonus = {"strategy": {"guide": 0, "concept": 2}, "topic": {"guide": 1, "concept": 2}, "guide": {"guide": 2, "concept": 1}, "concept": {"guide": 1, "concept": 3}, "paper": {"guide": 0, "concept": 2}}[kind]
    assert got[0].score == 13 + bonus["guide"] and got[1].score == 13 + bonus["concept"] and got[0].strength == "strong"
    assert 2 not in got or got[2].score < 5


def test_related_takes_one_page_a_title(build):
    _, _, _, scores = build
    rel = links.related_candidates(scores).where("score > 5").collect()
    assert sorted(r.title for r in rel) == ["动量因子", "动量因子指南"]


def test_backlinks_and_their_application(build):
    top, _, p, scores = build
    back = links.backlinks(scores, top, p)
    got = {r.page_ord: (r.section, r.section_found) for r in back.collect()}
    assert got[0] == ("## 关联", True) and got[1][1] is False
    new = links.apply_backlinks(back, p).collect()
    assert [r.page_ord for r in new] == [0] and "- x\n- 与 [[动量因子]] 的关系" in new[0].new_text


def test_conflicts(build):
    top, members, p, _ = build
    shared = {(r.page_ord, r.term) for r in links.shared_terms(top, p).collect()}
    assert (0, "动量因子") in shared and not any(k == 2 for k, _ in shared)
    got = {r.page_ord: r for r in links.conflicts(top, members, p).collect()}
    assert set(got) == {0, 1, 3}
    assert "偏否定" in got[0].reasons[0] and all(len(r.reasons) <= 3 for r in got.values())
    assert got[0].severity == "medium"  # one shared term


def test_gate(build, spark):
    top, members, p, scores = build
    gate = links.risk_gate(top, links.backlinks(scores, top, p), links.conflicts(top, members, p)).first()
    assert (gate.conflict_targets, gate.blocked, gate.level) == (3, False, "medium")
    none = links.risk_gate(top.where("false"), links.backlinks(scores.where("false"), top, p), links.conflicts(top.where("false"), members, p), "suggest-only").first()
    assert (none.planned_backlinks, none.conflict_targets, none.low_quality, none.level) == (0, 0, 0, "low")


def test_island_bridge(spark):
    pages = links.pages(spark.createDataFrame([(0, "i", "动量 alpha 页", "t", ["x"], [], "无链接"), (1, "a", "alpha 甲页面", "t", ["x"], ["动量页"], "[[别处]]"), (2, "b", "alpha 乙页面", "t", [], ["alpha 甲页面"], ""), (3, "动", "动量页", "t", [], ["alpha 乙页面"], "")], PAGE))
    issues = links.health_issues(pages)
    assert [r.page_title for r in issues.where("kind = 'island'").collect()] == ["动量 alpha 页"]
    r = links.island_bridges(pages, issues).first()
    assert (r.bridge, r.score) == ("alpha 甲页面", 5)


def test_order_of_partitions_does_not_matter(spark, build):
    _, members, _, _ = build
    a = corpus.cluster_table(members.repartition(7)).select("cluster_id", "name", F.col("anchor_terms").cast("string")).collect()
    assert a == corpus.cluster_table(members.coalesce(1)).select("cluster_id", "name", F.col("anchor_terms").cast("string")).collect()
