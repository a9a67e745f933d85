from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from textloom.functions import html as H
from textloom.operators import ingest, links, scout
from textloom.sources import readers, writers


def test_order_keeps_every_row_with_its_text(spark):
    """60,000 rows, texts selected, small partitions: no row is lost and numbers follow the parts of the path."""
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        files = spark.range(60_000, numPartitions=8).select(F.concat(F.lit("d"), F.col("id") % 37, F.lit("/n"), F.col("id"), F.lit(".md")).alias("rel_path"), F.repeat(F.col("id").cast("string"), 20).alias("text"))
        out = readers.with_order(files)
        got = out.select("doc_ord", "rel_path", F.length("text").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    want = sorted((f"d{i % 37}/n{i}.md" for i in range(60_000)), key=lambda p: p.split("/"))
    assert [r.rel_path for r in sorted(got, key=lambda r: r.doc_ord)] == want and [r.doc_ord for r in sorted(got, key=lambda r: r.doc_ord)] == list(range(60_000))
    assert readers.with_order(files.where("false")).count() == 0
    odd = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("A", 4)], "rel_path string, __p int")
    assert sorted((r.rel_path or "", r["__p"], r.doc_ord) for r in readers.with_order(odd).collect()) == [("", 3, None), ("A", 4, 0), ("a", 1, 1), ("a", 2, 1)]


def test_written_files_come_back(spark, tmp_path):
    df = spark.createDataFrame([("x/一.md", "正文"), ("x/y/+%20 b.md", "a\r\nb\n"), ("c.md", ""), (None, "n"), ("d.md", None), ("../out.md", "no"), ("/abs.md", "no"), ("x/一.md", "正文")], "rel_path string, text string")
    folder = str(tmp_path / "tree")
    done = writers.write_files(df, folder).collect()
    assert sorted({r.path for r in done}) == ["c.md", "x/y/+%20 b.md", "x/一.md"]
    back = {r.rel_path: r.text for r in readers.markdown_files(spark, folder).collect()}
    assert back["x/一.md"] == "正文" and back["x/y/+%20 b.md"] == "a\r\nb\n"
    again = spark.createDataFrame([("x/一.md", "新")], "rel_path string, text string")
    assert [r.written for r in writers.write_files(again, folder).collect()] == [False]
    assert [r.written for r in writers.write_files(again, folder, replace=True).collect()] == [True]
    assert (tmp_path / "tree/x/一.md").read_text() == "新" and not (tmp_path / "out.md").exists()


def test_filtered_lists(spark, tmp_path):
    new = spark.createDataFrame([("a", 1, "t"), ("a", 2, None), ("b", 3, "u")], "account string, ordinal long, title string")
    writers.write_filtered(new, spark.createDataFrame([("a", 9, "s")], new.schema), ("k",), "2025-06-01", str(tmp_path / "out"))
    heads = {r.account: (r.total, r.original_total, r.skipped_historical) for r in spark.read.json(str(tmp_path / "out/lists")).collect()}
    assert heads == {"a": (2, 3, 1), "b": (1, 1, 0)}
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/articles/account=a")).collect()]
    assert sorted(x["ordinal"] for x in rows) == [1, 2] and {"ordinal": 2, "title": None} in rows


def test_deep_and_unclosed_markup():
    assert H.to_text("<div>" * 3_000 + "深") == "深" and H.to_markdown("<p>一" * 3_000).count("\n") == 2_999
    assert H.to_markdown("<ul><li>1<li>2</ul><p>a<strong> b </strong>") == "- 1\n- 2\na**b**"


def test_articles_once(spark):
    rows = [(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c"), (3, "d"), (3, "e")]
    df = spark.createDataFrame(rows, "ordinal long, title string")
    got = sorted(((r.ordinal or 0, r.title) for r in ingest.once(df).collect()))
    assert got[:3] == [(0, "c"), (1, "a"), (2, "b")] and len(got) == 4 and got[3] in ((3, "d"), (3, "e"))
    assert sorted(((r.ordinal or 0, r.title) for r in ingest.once(df.repartition(3)).collect())) == got
    assert ingest.once(df.where("false")).count() == 0


def test_many_equal_names_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ingest, "NAME_PART", 4)
    df = spark.createDataFrame([(i, "a", None, None, None, "x", None, None) for i in range(11)], "ordinal long, account string, title string, create_time long, link string, content_markdown string, content_text string, content string")
    names = [r.file_name for r in ingest.markdown_export(df).orderBy("ordinal").collect()]
    assert names == ["1970-01-01_无标题.md", *[f"1970-01-01_无标题_{k}.md" for k in range(1, 11)]]


def test_conflict_with_oneself_is_none(spark):
    clusters = spark.createDataFrame([(1, "甲"), (2, "")], "cluster_id long, title string")
    p = spark.createDataFrame([(10, "甲"), (11, "乙"), (12, "")], "page_ord long, title string")
    pairs = clusters.select("cluster_id").crossJoin(p.select("page_ord"))
    assert sorted(map(tuple, links.not_self(pairs, clusters, p).collect())) == [(1, 11), (1, 12), (2, 10), (2, 11), (2, 12)]
    assert links.not_self(pairs, clusters.drop("title"), p).count() == 6
    many = spark.createDataFrame([(i, 1) for i in range(30)], "cluster_id long, page_ord long")
    assert [r.place for r in links.alerts(many).orderBy("cluster_id").collect()] == list(range(1, 21))


@pytest.mark.parametrize("text", ["`wiki/a.md` [[乙]]", "`wiki/`wiki/a.md`\n[[[乙]]", ""])
def test_marks(spark, text):
    p = spark.createDataFrame([(1, "a.md", "甲"), (2, "b.md", "乙"), (3, "c.md", "丙 丁")], "page_ord long, file_name string, title string")
    want = [r.page_ord for r in p.collect() if f"`wiki/{r.file_name}`" not in text and f"[[{r.title}]]" not in text]
    assert sorted(r.page_ord for r in links.unmarked(p, text, ("file_name", "title")).collect()) == want
    assert [r.page_ord for r in links.unmarked(p, "`wiki/丙_丁.md`", ("slug",)).orderBy("page_ord").collect()] == [1, 2]


def test_brief(spark):
    c = spark.createDataFrame([("thin", f"t{i:02}", 3, 3, 3) for i in range(13)], "pattern string, topic string, urgency int, value int, effort int")
    b = scout.brief(scout.priority(c), budget=6).orderBy("place").collect()
    assert len(b) == 10 and {r.waiting for r in b} == {3} and [r.searched for r in b] == [True] * 3 + [False] * 7
    assert scout.brief(scout.priority(c.limit(1))).count() == 0


def test_session_tables_are_in_the_shared_folder(spark):
    from textloom.shared import Scratch, materialize, run_dir

    with Scratch(spark) as tables:
        gone = materialize(spark.range(3).toDF("a"))
        kept = tables.keep(materialize(gone))
    assert kept.count() == 3
    assert not os.path.exists(gone.inputFiles()[0].removeprefix("file://")) and run_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
