from __future__ import annotations

import pytest

from textloom.llm import abuse


@pytest.mark.parametrize(
    ("text", "category"),
    [
        # abuse beside a naming word
        ("你这个医生去死吧", "abusive"),
        ("你们审核的人怎么还不去死", "abusive"),
        ("垃圾分类都不会，你这个白痴", "abusive"),
        ("得了癌症的这群劣等货", "hateful"),
        ("The moderators should go to hell, and the cancer screening too.", "abusive"),
        ("敏感词表里收了“傻逼”，你这个白痴去死吧。", "abusive"),
        ("过滤规则写好了。 老子弄死你", "abusive"),
        # quoted, without a naming word
        ("他当众喊了一句“你去死吧”，随后离开了会场。", None),
        ("The letter said \"go kill yourself\", and the desk kept a copy.", None),
        ("报道引用了「这群劣等货」的说法，并作了批评。", None),
        # quoted and named, also without marks
        ("审核员说，遇到“你就是个白痴，滚远点”这类留言会先取证再处理。", None),
        ("过滤规则会屏蔽操你妈、去死吧等词。", None),
        # not in the quotation, or a quotation that is the whole comment, or scare quotes
        ("\"Drop the adjectives\", wrote the desk, \"and look.\" You should go to hell \"now\".", "abusive"),
        ("网友12：“你就是个白痴，滚远点！”", "abusive"),
        ("“去死吧”", "abusive"),
        ("你就是个“白痴”", "abusive"),
        # technical
        ("废物利用课上，你们把旧箱子改成了书架。", None),
        ("你们的垃圾债利差走阔了。", None),
    ],
)
def test_context(spark, text, category):
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    assert abuse.score_abuse(df).first().category == category
