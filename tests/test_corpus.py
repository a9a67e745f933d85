from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.operators import corpus

SCHEMA = "doc_ord long, rel_path string, title string, month string, preview string, text string, title_key string, tags array<string>, tokens array<string>, extra string"


def docs(spark, rows):
    full = [(i, f"m/{i}.md", r.get("title", f"t{i}"), r.get("month", "2024-01"), "", r.get("text", ""), r.get("key", "k"), r.get("tags", ["a"]), r.get("tokens", []), "x") for i, r in enumerate(rows)]
    return corpus.documents(spark.createDataFrame(full, SCHEMA))


def splits(df):
    return sorted({(r.bucket, r.split) for r in df.collect()})


def test_six_documents_stay_together(spark):
    assert splits(corpus.assign(docs(spark, [{"key": f"key{i % 2}", "month": f"2024-0{i + 1}"} for i in range(6)]))) == [("a", "")]


def test_seven_split_by_key_with_leftovers(spark):
    m = corpus.assign(docs(spark, [{"key": k} for k in ("k1", "k1", "k2", "k2", "k2", "lone", "a")]))
    assert splits(m) == [("a", ""), ("a", "k:k1"), ("a", "k:k2")]
    c = corpus.cluster_table(m).orderBy(*corpus.cluster_order()).collect()
    assert [r.docs for r in c] == [3, 2, 2] and c[-1].rest == 1


def test_seven_split_by_month_with_equal_names(spark):
    m = corpus.assign(docs(spark, [{"month": f"2024-0{i % 3 + 1}"} for i in range(7)]))
    assert len(splits(m)) == 3
    assert {r.name for r in corpus.cluster_table(m).collect()} == {"a"}


def test_ties_go_to_the_first_seen_whatever_the_partitions(spark):
    d = docs(spark, [{"tokens": ["y", "x"]}, {"tokens": ["x", "y", "z"]}])
    for p in (1, 5):
        got = corpus.top_terms(corpus.assign(d.repartition(p)), "tokens", ["cluster_id"], 8).orderBy("rank").collect()
        assert [(r.term, r.n) for r in got] == [("y", 2), ("x", 2), ("z", 1)]


@pytest.mark.parametrize(("tokens", "want"), [(["a", "b", "c", "d", "e"], 67), (["a", "b", "c", "d", "e", "f"], 57)])
def test_quality_of_one_document_without_hints(spark, tokens, want):
    d = docs(spark, [{"tags": [], "tokens": tokens}])
    assert corpus.cluster_table(corpus.assign(d)).first().quality_score == want


def test_consensus_follows_titles_not_counts(spark):
    d = docs(spark, [{"title": "b", "tokens": ["zz", "zz", "zz"]}, {"title": "a", "tokens": ["yy", "yy"]}])
    assert [r.term for r in corpus.consensus(corpus.assign(d)).orderBy("rank").collect()] == ["yy", "zz"]


def test_hint_scores(spark):
    df = spark.createDataFrame([("动量策略 研究", "动量"), (None, None)], "t string, p string")
    got = [r.m for r in df.select(corpus.hint_scores(F.col("t"), F.col("p"), ["动量策略", "无关"]).alias("m")).collect()]
    assert got == [{"动量策略": 5}, {}]


def test_derive_from_a_file(spark):
    text = '---\ntitle: "因子研究样本"\n---\n\n# 因子研究样本\n\n因子研究在样本中有效。\n'
    r = corpus.derive(spark.createDataFrame([(0, "2026-04/sample.md", text)], "doc_ord long, rel_path string, text string"), ["因子研究"]).first()
    assert (r.title, r.title_key, r.month, r.tags) == ("因子研究样本", "因子研究样本", "2026-04", ["因子研究"])


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None, None, None, None, None, None, None, None, None), (2, None, None, None, None, None, None, [None, " "], [None], None), (None, "", "", "", "", "", "", [], [], "")], SCHEMA)
    m = corpus.assign(corpus.documents(rows))
    c = corpus.cluster_table(m)
    assert [r.name for r in c.collect()] == ["未分类主题"] and c.first().docs == 2
    none = corpus.assign(corpus.documents(rows.where("false")))
    assert corpus.cluster_table(none).count() == 0 and corpus.consensus(none).count() == 0
    top, members = corpus.planned(rows.where("false"))
    assert top.count() == 0 and corpus.section_content(members, top).count() == 0
