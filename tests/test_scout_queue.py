"""The scout's queue of all six patterns against brute force."""

from __future__ import annotations

import random
import re
from datetime import datetime
from itertools import combinations

import pytest

from textloom.operators import scout

AS_OF = datetime(2025, 6, 1)
ORDER = ["cross_topic", "cluster_gap", "broken_concept", "thin", "stale", "overweight"]


def brute(pages: list[tuple], dated: bool) -> list[tuple[str, str, int]]:
    found = []
    titles = {p[1] for p in pages}
    links = {(p[0], p[1], t, k) for p in pages for k, ts in (("body", re.findall(r"\[\[([^\]]+)\]\]", p[5])), ("related", p[4])) for t in ts}
    inbound = {t: len({o for o, _, x, _ in links if x == t}) for t in {x[2] for x in links}}
    tagged = {}
    for p in pages:
        for t in p[3]:
            tagged.setdefault(t, set()).add(p[0])
    for o, title, kind, _, related, text, updated in pages:
        body = text.strip()
        if len(body) < 200 or (len(related) > 3 and len(re.findall("[。！？!?；;]", body)) <= 1):
            found.append(("thin", title, inbound.get(title, 0)))
        heads = len(re.findall(r"(?m)^##[ \t]", text))
        if len(body) > 5000 or (len(body) >= 2000 and heads >= 3):
            found.append(("overweight", title, heads))
        if dated and updated is not None:
            months = (AS_OF.year - updated.year) * 12 + AS_OF.month - updated.month - (updated > updated.replace(day=1, hour=0, minute=0))
            if months >= (12 if kind in ("psychology", "concept") else 6):
                found.append(("stale", title, inbound.get(title, 0)))
    found += [("broken_concept", t, k) for t, k in inbound.items() if t not in titles and k >= 2]
    found += [("cluster_gap", t, len(o)) for t, o in tagged.items() if len(o) >= 3 and t not in titles]
    for a, b in combinations(sorted(t for t, o in tagged.items() if len(o) >= 5), 2):
        both = tagged[a] & tagged[b]
        if both and not any(a in p[1] and b in p[1] for p in pages if p[0] in both):
            found.append(("cross_topic", f"{a} / {b}", len(both)))
    rows = []
    for pattern, topic, refs in found:
        u = 3 if refs > 15 else 2 if refs >= 5 else 1
        v = 3 if refs > 20 else 2 if refs >= 5 else 1
        e = 1 if pattern in ("overweight", "cross_topic") else 2 if pattern in ("cluster_gap", "stale") else 3
        t = 4 * u + 4 * v + 2 * e
        rows.append((0 if t >= 25 else 1 if t >= 15 else 2, -u, ORDER.index(pattern), topic))
    return [(ORDER[r[2]], r[3], i) for i, r in enumerate(sorted(rows)[:10], 1)]


def make(seed: int, n: int, bare: bool) -> list[tuple]:
    r = random.Random(seed)
    names = [f"page{i}" for i in range(n)]
    out = []
    for i in range(n):
        text = r.choice(["short.", "word " * 60, "word " * 60, "## a\n" * 3 + "word " * 500, "word " * 1_100])
        text += "".join(f"[[{r.choice(names + ['gone1', 'gone2'])}]]" for _ in range(0 if bare else r.randint(0, 3)))
        tags = sorted(r.sample(["ta", "tb", "tc", "td", "te", "tf"], r.randint(0, 3)))
        when = r.choice([None, datetime(2025, 3, 2), datetime(2024, 12, 1), datetime(2024, 12, 2), datetime(2024, 6, 1), datetime(2023, 1, 9, 5)])
        out.append((i, names[i], r.choice(["paper", "concept", "psychology", "unknown"]), tags, [] if bare else sorted(r.sample(names[:4], r.randint(0, 3))), text, when))
    return out


@pytest.mark.parametrize(("seed", "n", "bare"), [(1, 40, False), (2, 12, False), (3, 6, True), (4, 60, False)])
@pytest.mark.parametrize("dated", [True, False])
def test_queue_of_all_patterns(spark, seed, n, bare, dated):
    rows = make(seed, n, bare)
    p = spark.createDataFrame(rows, "page_ord long, title string, page_type string, tags array<string>, related array<string>, text string, updated timestamp")
    c = scout.candidates(p if dated else p.drop("updated"), "2025-06-01").cache()
    assert {x.pattern for x in c.select("pattern").distinct().collect()} <= set(ORDER)
    assert (c.where("pattern = 'stale'").count() > 0) == dated
    got = [(x.pattern, x.topic, x.place) for x in scout.queue(scout.scored(c)).orderBy("place").collect()]
    assert got == brute(rows, dated)


def test_every_pattern_competes(spark):
    rows = make(4, 60, False)
    p = spark.createDataFrame(rows, "page_ord long, title string, page_type string, tags array<string>, related array<string>, text string, updated timestamp")
    assert {x.pattern for x in scout.candidates(p, "2025-06-01").select("pattern").distinct().collect()} == set(ORDER)
