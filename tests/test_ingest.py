from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import ingest, scout
from textloom.sources import readers
from textloom.streaming import ingest as stream

ARTICLE = "ordinal long, account string, title string, digest string, link string, url string, source string, update_time long, create_time long, content string, content_text string, content_markdown string"


def articles(spark, rows):
    names = [c.split()[0] for c in ARTICLE.split(", ")]
    return spark.createDataFrame([tuple({"ordinal": i, "account": "a"} .get(n) if n not in r and n in ("ordinal", "account") else r.get(n) for n in names) for i, r in enumerate(rows)], ARTICLE)


def ids(df):
    return sorted(r.ordinal for r in df.collect())


def test_keyword_across_joined_fields(spark):
    x = articles(spark, [{"title": "foo", "digest": "bar"}, {"content": "FOO BAR"}, {}])
    assert ids(ingest.keyword_filter(x, ["foo bar"])) == [0, 1]
    assert ids(ingest.keyword_filter(x, [])) == [0, 1, 2]


def test_take_while_is_no_plain_filter(spark):
    x = articles(spark, [{"update_time": 2_000_000_000}, {"update_time": 1}, {"update_time": 2_000_000_000}])
    assert ids(ingest.since_take_while(x, "2020-01-01")) == [0]


def test_until(spark):
    x = articles(spark, [{"update_time": 0, "create_time": 86_399}, {"update_time": 86_400}, {}, {"update_time": 0, "create_time": 0}])
    assert ids(ingest.until_filter(x, "1970-01-01")) == [0]


def test_blank_links_are_always_new(spark):
    x = articles(spark, [{"link": "u"}, {"link": "", "url": "u"}, {"link": "v"}, {}])
    new, old = ingest.split_new(x, spark.createDataFrame([("u",), ("",)], "link string").where("link <> ''"))
    assert ids(new) == [2, 3] and ids(old) == [0, 1]


def test_sync_plan_is_the_sequential_loop(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["2026-04-20_x.md", "2026-04-20-x.md", "2026-04-21_y.md"]), r.choice("ABC")) for i in range(200)]
    history = {"20260420x.md": "A"}
    want, seen = {}, dict(history)
    for i, name, md5 in rows:
        norm = name.lower().replace("-", "").replace("_", "").replace(" ", "")
        if seen.get(norm) == md5:
            want[i] = "duplicate"
        elif not (len(name) > 11 and name[10] == "_"):
            want[i] = "bad_name"
        else:
            want[i] = "sync"
            seen[norm] = md5
    got = ingest.sync_plan(spark.createDataFrame(rows, "ord long, name string, md5 string").repartition(7), spark.createDataFrame(list(history.items()), "norm string, md5 string"))
    assert {x.ord: x.action for x in got.collect()} == want


def test_state(spark):
    state = spark.createDataFrame([("a", None, None, None, None, 1, None, None, None)], readers.STATE)
    runs = spark.sql("SELECT * FROM VALUES ('a', true, timestamp'2025-01-02', 'b2', 3L, null), ('a', false, timestamp'2025-01-03', 'b3', 9L, 'why'), ('n', true, timestamp'2025-01-01', 'b1', 1L, null) AS t(account, ok, at, batch_dir, new_articles, reason)")
    s = {r.account: r for r in ingest.update_state(state, runs).collect()}
    assert (s["a"].success_count, s["a"].failure_count, s["a"].total_articles_ever, s["a"].last_batch_dir, s["a"].last_failure_reason) == (2, 1, 3, "b2", "why")
    assert s["n"].last_success_time == "2025-01-01 00:00:00"
    since = {r.account: r.since for r in ingest.since_dates(spark.createDataFrame([("a",), ("n",), ("z",)], "account string"), ingest.update_state(state, runs), "2025-06-15").collect()}
    assert since == {"a": "2025-01-01", "n": "2024-12-31", "z": "2025-06-01"}
    assert ingest.resolve_since(None, True, "x") == "1970-01-01" and ingest.resolve_since("d", True, "x") == "d"


def test_export_numbers_equal_names(spark):
    x = articles(spark, [{"title": "t", "content": "c"}, {"title": "t", "content_text": "d"}, {"title": "t"}])
    assert sorted(r.file_name for r in ingest.markdown_export(x).collect()) == ["1970-01-01_t.md", "1970-01-01_t_1.md"]


def test_readers(spark, tmp_path):
    (tmp_path / "raw" / "2024-01").mkdir(parents=True)
    (tmp_path / "raw" / "b.md").write_text("---\nsource: s1\n---\nx")
    (tmp_path / "raw" / "2024-01" / "a.md").write_bytes(b"a\xffb\nline two")
    (tmp_path / "raw" / "no.txt").write_text("z")
    files = readers.with_order(readers.markdown_files(spark, str(tmp_path / "raw")))
    got = {r.rel_path: (r.doc_ord, r.text, r.name) for r in files.collect()}
    assert got == {"2024-01/a.md": (0, "ab\nline two", "a.md"), "b.md": (1, "---\nsource: s1\n---\nx", "b.md")}
    assert readers.markdown_files(spark, str(tmp_path / "raw"), recursive=False).count() == 1
    assert [r.link for r in readers.source_links(spark, str(tmp_path / "raw")).collect()] == ["s1"]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.json").write_text(json.dumps({"account": "A", "articles": [{"title": "x"}, {"link": "y"}]}))
    (tmp_path / "l" / "b.json").write_text(json.dumps([{"title": "z", "update_time": 3}]))
    lists = readers.article_list(spark, str(tmp_path / "l")).collect()
    assert sorted((r.account or "", r.ordinal, r.title, r.link) for r in lists) == [("", 0, "z", None), ("A", 0, "x", None), ("A", 1, None, "y")]
    assert readers.state_table(spark, str(tmp_path / "none")).count() == 0
    readers.write_state(spark.createDataFrame([("a", None, None, None, 1, 1, 0, None, None)], readers.STATE), str(tmp_path / "state"), 0)
    readers.write_state(spark.createDataFrame([("b", None, None, None, 1, 1, 0, None, None)], readers.STATE), str(tmp_path / "state"), 1)
    assert [r.account for r in readers.state_table(spark, str(tmp_path / "state")).collect()] == ["b"]
    assert readers.load_config('{"crawl_settings": {"batch_size": 9}, "targets": []}')["crawl_settings"]["batch_limit"] == 100


def test_stream_gives_what_one_batch_gives(spark, tmp_path):
    rows = [{"link": f"l{i % 7}", "title": str(i)} for i in range(20)]
    for k in range(4):
        articles(spark, rows).where((F.col("ordinal") >= 5 * k) & (F.col("ordinal") < 5 * k + 5)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = stream.start(stream.article_stream(spark, str(tmp_path / "in"), ARTICLE, 1), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r.link for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [f"l{i}" for i in range(7)]


@pytest.mark.parametrize(("u", "v", "e", "score", "priority"), [(1, 2, 1, 1.4, "low"), (3, 2, 2, 2.4, "medium"), (3, 3, 1, 2.6, "high")])
def test_priority(spark, u, v, e, score, priority):
    r = scout.priority(spark.createDataFrame([(u, v, e)], "urgency int, value int, effort int")).first()
    assert (float(r.score), r.priority) == (score, priority)


def test_scout_lookups(spark):
    g = scout.source_grades(spark.createDataFrame([("https://www.arxiv.org/abs/1",), ("http://x.zhihu.com/",), ("nope",), (None,)], "url string")).collect()
    assert [r.grade for r in g] == ["A", "C", None, None]
    plan = scout.search_plan(spark.createDataFrame([("t", "paper"), ("u", None)], "topic string, kind string"))
    assert plan.where("topic = 't' AND place = 1").first().site == "arxiv.org" and plan.where("topic = 'u'").count() == 2
    assert spark.range(1).select(scout.route(F.lit("report"))).first()[0] == "report"
