from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import html as H
from textloom.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('---\ntitle: "Alpha"\n---\n# Beta', "Alpha"),
        ("---\ntitle:\n---\n# Beta", "---"),  # an empty field takes the next line
        ("# Beta\nx", "Beta"),
        ("plain", "stem"),
        ("", "stem"),
        (None, "stem"),
    ],
)
def test_title(spark, text, want):
    assert one(spark, text, lambda x: T.title(x, F.lit("stem"))) == want


@pytest.mark.parametrize(
    ("line", "own", "want"),
    [
        ("related: [[[动量]], \"估值\", 动量, '久期']", None, "related: [动量, 估值, 久期]"),
        ("related: ['[[carry]]', slope, slope, [[roll]]]", "roll", "related: [carry, slope]"),
        ("related: []", None, "related: []"),
        ("no field", None, "related: []"),
    ],
)
def test_related_line(spark, line, own, want):
    assert one(spark, line, lambda x: T.related_line(x, F.lit(own) if own else None)) == want


def test_clean_markdown(spark):
    text = "---\ntitle: t\n---\n# H\n```py\nx\n```\n![i](u) [a](b) [[Page]]\ntags: x\n- `code`\nRaw Sources:\nhttps://a.b/c\nrest　of it\r\nend"
    assert one(spark, text, T.clean_markdown) == "# H Page rest of it end"
    assert one(spark, None, T.clean_markdown) == ""


def test_tokens_and_noise(spark):
    got = one(spark, "动量因子 和 c++ Python3 我们的研究方法论 readme-md 一二三四五六七八 x", T.tokens)
    assert got == ["动量因子", "python3"]


def test_key_sentences(spark):
    got = one(spark, "动量因子，趋势市场，回撤控制更好。短。动量因子，趋势市场，回撤控制更好。波动率目标 alpha beta 组合再平衡！", lambda x: T.key_sentences(x, 5))
    assert got == ["动量因子，趋势市场，回撤控制更好。", "波动率目标 alpha beta 组合再平衡！"]


@pytest.mark.parametrize(("x", "want"), [("因子研究样本", "因子研究样本"), ("动量专题：一", "动量"), ("专题", "专题"), ("双链笔记", "双链"), (None, "")])
def test_title_key(spark, x, want):
    assert one(spark, x, T.title_key) == want


@pytest.mark.parametrize(("n", "want"), [(99, True), (100, False)])
def test_verify_page_at_the_bound(spark, n, want):
    assert one(spark, "字" * n, T.is_verify_page) is want


@pytest.mark.parametrize("seconds", [0, 59, 60, 3599, 3600, 5940, 4140, 99, 123456])
def test_duration(spark, seconds):
    s = float(seconds)
    want = f"{s:.1f}秒" if s < 60 else f"{s / 60:.1f}分钟" if s < 3600 else f"{s / 3600:.1f}小时"
    assert one(spark, seconds, T.duration, "long") == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a\n## 关联\n- x\n\n## next\nz", "a\n## 关联\n- x\nL\n\n## next\nz"),
        ("a\n## 关联\n", "a\n## 关联\n\nL\n"),
        ("a\n## 关联\n\nwords\n\n## n\n", "a\n## 关联\n\nwords\n\nL\n\n## n\n"),
        ("a\n## 关联\n- x\ntail", "a\n## 关联\n- x\nL\ntail"),
        ("nothing", "nothing"),
    ],
)
def test_insert_in_section(spark, text, want):
    assert one(spark, text, lambda x: T.insert_in_section(x, F.lit("## 关联"), F.lit("L"))) == want


def test_names(spark):
    assert one(spark, ' a/b:c  d?"', T.slug) == "a_b_c_d__".strip("._")
    assert one(spark, "...", T.slug) == "untitled"
    assert one(spark, "A-b_C d", T.normal_name) == "abcd"
    assert one(spark, "x" * 99, T.file_name) == "x" * 80
    assert one(spark, "20260420_x.md", T.month_of_file) == "2026-04"
    assert one(spark, "x.md", T.month_of_file) is None


def test_source_and_body(spark):
    text = "---\ntitle: a\n source: http://x/y\n---\nbody --- more\n"
    assert one(spark, text, T.source_of) == "http://x/y"
    assert one(spark, text, T.body) == "body --- more"
    assert one(spark, "no fence", T.source_of) is None
    assert one(spark, None, T.body) == ""


def test_html():
    page = '<html><body><div>nav</div><div id="js_content"><h2>T</h2><p>a <strong>b</strong> <em>c</em></p><script>x</script><ul><li>i</li></ul><a href="u">l</a><img data-src="s" alt="d"><br>e</div></body></html>'
    assert H.to_text(page) == "T\na b c\ni\nl\ne".replace("l\ne", "l\ne")
    assert H.to_markdown(page) == "## T\na **b** *c*\n- i\n[l](u)\n![d](s)\ne"
    assert H.to_text(None) == "" and H.to_markdown("") == ""


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a\n b#<", max_size=12), min_size=1, max_size=20))
def test_clean_file_is_the_loop(spark, texts):
    def loop(t):
        t = t.replace("#< CLIXML", "")
        while "\n\n\n" in t:
            t = t.replace("\n\n\n", "\n\n")
        return t.strip() + "\n"

    got = [r.y for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", T.clean_file("x").alias("y")).orderBy("i").collect()]
    assert got == [loop(t) for t in texts]


def test_md5_and_links(spark):
    assert one(spark, "a中", lambda x: F.md5(x)) == hashlib.md5("a中".encode()).hexdigest()
    assert one(spark, "[[A]] [[ B ]] [[]] [[A]] [[x|y]]", T.wikilinks) == ["A", "B", "A", "x|y"]
    assert re.match("related", one(spark, "related: [[[A]]]", T.related_line))
