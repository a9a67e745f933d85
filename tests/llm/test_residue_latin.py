from __future__ import annotations

import random

import pytest

from textloom.llm import residue


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Quis amet ad minim do quis eiusmod tempor nostrud labore nostrud labore ullamco lorem consectetur dolor ut.", "filler"),
        ("动量因子的样本窗口是三年。\n> Magna quis exercitation sed quis lorem quis elit.\n回撤在可控范围内。", "filler"),
        ("动量因子的样本窗口是三年。Veniam eiusmod et eiusmod veniam adipiscing.", "filler"),
        ("# Lorem ipsum", None),
        ("设计师常用 lorem ipsum 与 dolor sit amet 排版，编辑部却坚持用真实稿件，理由是行宽不同。", None),
        ("The temporary desk possesses elite labourers, and its magnates animate a dolorous essay in it.", None),
        ("Do it, sit in, do ad.", None),
    ],
)
def test_placeholder_latin(text, kind):
    assert residue.score_text(text)[0] == kind


def test_placeholder_latin_in_any_order():
    r = random.Random(5)
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()
    for _ in range(50):
        r.shuffle(words)
        assert residue.score_text("正文。\n" + " ".join(words).capitalize() + ".")[0] == "filler"
