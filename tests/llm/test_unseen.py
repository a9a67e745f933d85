"""Problems 5 and 8 on sentences that are in no test table."""

from __future__ import annotations

import pytest
import unseen

from textloom.llm import abuse, residue


def abusive(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'s' AS source")
    return {texts[r.id] for r in abuse.score_abuse(df).where(f"score >= {abuse.THRESHOLD}").collect()}


def test_abuse(spark):
    found = abusive(spark, [*unseen.ABUSE, *unseen.CLEAN])
    assert len(found & set(unseen.ABUSE)) >= 0.95 * len(unseen.ABUSE) and not found & set(unseen.CLEAN)
    after = abusive(spark, [*unseen.ABUSE_AFTER, *unseen.CLEAN_AFTER])
    assert len(after & set(unseen.ABUSE_AFTER)) >= 9 and len(after & set(unseen.CLEAN_AFTER)) <= 1


def test_residue():
    assert sum(residue.score_text(t)[0] is not None for t in unseen.RESIDUE) >= 0.95 * len(unseen.RESIDUE)
    assert not [t for t in unseen.CONTENT if residue.score_text(t)[0]]


@pytest.mark.parametrize("term", ["moron", "idiot", "scumbag"])
def test_misspellings_are_no_common_words(term):
    near = abuse.misspellings(term)
    assert near and not near & abuse.COMMON and term not in near and all(abs(len(x) - len(term)) <= 1 for x in near)
