from __future__ import annotations

import pytest

from textloom.llm import residue

REAL = "The desk measured the drawdown over three years and found it small. "


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (REAL * 4 + "Your text goes here. " + REAL * 4, "filler"),
        (REAL * 2 + "Labore consectetur ut veniam magna labore dolor ut enim. " + REAL * 4, "filler"),
        (REAL + "Each variable was lagged by a month. Welcome back, {{nickname}} of the desk. " + REAL, "template"),
        (REAL + "In the template, {{nickname}} stands for the account. " + REAL, None),
        (REAL * 4 + "The note, e.g. the one on vs. your text goes here etc. and so on, says nothing of the kind. " + REAL, None),
        (REAL * 8, None),
    ],
)
def test_english_sentences(text, kind):
    assert residue.score_text(text)[0] == kind
    assert residue.score_text(text.replace(".", "．"))[0] == kind
