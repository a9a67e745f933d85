from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import fold, letters, letters_digits, near_pairs, stretches
from compare import connect, same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.llm import _bitmap as B
from textloom.llm import _text as X
from textloom.llm import abuse, boilerplate, leaks, linkage, neardup, oracle, packing, queries, residue, terms

WORDS = ["动量", "因子", "回撤", "alpha", "风险", "仓位", "beta", "样本", "窗口", "信号", "组合", "趋势", "流动性", "估值", "利差", "schema", "换手", "久期"]


def words(r: random.Random, n: int) -> str:
    return "".join(r.choice(WORDS) + str(r.randint(0, 999)) for _ in range(n))


def fewer_steps(monkeypatch):
    """24 steps take minutes on a small machine; the rows are the same with 4 (and with one batch a step, tested below)."""
    run = linkage.run_batches
    monkeypatch.setattr(linkage, "run_batches", lambda df: run(df, batches_per_step=6))


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, small, name, monkeypatch):
    fewer_steps(monkeypatch)
    same(connect(small), queries.queries()[name](spark, small), oracle.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.oracle_sql())))
def test_query_without_sql_runs(spark, small, name, monkeypatch):
    fewer_steps(monkeypatch)
    assert queries.queries()[name](spark, small).columns


# --- text and bitmaps ---


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=6))
def test_reduced_text_is_the_plain_one(texts):
    plain = [t for t in texts]
    cp, off = X.keep_only(*X.code_points(pa.array([None if t is None else t.encode("utf-8", "ignore").decode() for t in plain], pa.string())), X.tables()[1] | X.tables()[2])
    got = [cp[a:b].astype("<u4").tobytes().decode("utf-32-le") for a, b in zip(off[:-1], off[1:], strict=True)]
    ascii_only = [(g, t) for g, t in zip(got, plain, strict=True) if t is None or all(ord(c) < 0x250 or 0x4E00 <= ord(c) < 0xA000 or 0xFF00 <= ord(c) < 0xFFF0 for c in t)]
    assert all(g == letters_digits(t) for g, t in ascii_only if t is None or "İ" not in t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 4095), max_size=600), min_size=1, max_size=4))
def test_containers(sets):
    maps = []
    for s in sets:
        a = np.array(sorted(s), dtype=np.uint16)
        maps.append(B.encode(a, np.zeros(1, dtype=np.int64), 12)[0].as_py())
        assert set(B.decode(maps[-1], 12).tolist()) == s and B.cardinality(maps[-1], 12) == len(s)
    u = B.union(maps, 12)
    every = set().union(*sets)
    assert set(B.decode(u, 12).tolist()) == every
    assert all(B.contains(u, x, 12) == (x in every) for x in (0, 1, 17, 4095))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab１中\n\r ", max_size=20)), min_size=1, max_size=5))
def test_line_keys(texts):
    doc, no, key = boilerplate.line_keys(*X.code_points(pa.array(texts, pa.string())))
    got = list(zip(doc.tolist(), no.tolist(), key.tolist(), strict=True))
    lines = [(i, j, letters(x)) for i, t in enumerate(texts) for j, x in enumerate((t or "").split("\n"))]
    assert [g[:2] for g in got] == [x[:2] for x in lines]
    by = {}
    for g, (_, _, s) in zip(got, lines, strict=True):
        assert (g[2] == 0) == (s == "")
        assert by.setdefault(s, g[2]) == g[2]
    assert len(set(by.values())) == len(by)


# --- 1 ---

RAW = "doc_ord long, text string, title string, id string"


def edited(r: random.Random, text: str, edits: int) -> str:
    t = list(text)
    for _ in range(edits):
        t[r.randrange(len(t))] = r.choice("甲乙丙丁")
    return "".join(t)


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(3)
    rows, n = [], 0
    for _ in range(40):
        base = words(r, 60)
        for k in range(r.choice([1, 1, 2, 4])):
            rows.append((n, f"---\ntitle: x{n}\n---\n" + edited(r, base, r.choice([0, 1, 6, 12]) if k else 0), "t", "clash"))
            n += 1
    rows += [(900, None, None, None), (901, "", "", ""), (902, "---\na: b\n---\n", "", ""), (None, "x" * 50, "", ""), (903, "短", "", ""), (904, "短。", "", ""), rows[0], (905, "长" * 30_000, "", ""), (906, "长" * 30_000 + "!", "", "")]
    df = spark.createDataFrame(rows, RAW)
    bodies = {i: letters_digits(t.split("\n---\n", 1)[1] if t.startswith("---") else t) for i, t, _, _ in rows if i is not None and t}
    want = near_pairs(bodies, 0.70)
    got = [(x.a, x.b) for x in neardup.near_duplicate_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (903, 904) in want and (905, 906) in want
    groups = {x.id: x.group for x in neardup.near_duplicate_groups(df).collect()}
    assert set(groups) == {i for i, b in bodies.items() if b}
    assert all(groups[a] == groups[b] for a, b in want)
    assert len(set(groups.values())) >= 40
    assert neardup.near_duplicate_pairs(df.where("false")).count() == 0 and neardup.near_duplicate_groups(df.where("false")).count() == 0


def test_hot_keys_lose_no_pair(spark):
    keys = spark.createDataFrame([(7, i) for i in range(60)] + [(8, 3), (8, 4), (9, 1)], "key long, id long")
    want = {(a, b) for a in range(60) for b in range(a + 1, 60)}
    for block in (4, 1000):
        got = [(r.a, r.b) for r in neardup.band_pairs(keys, block).collect()]
        assert len(got) == len(want) and set(got) == want


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(31), 100, 101, 500]], "id long")
    got = {r.id: r.group for r in neardup.components(nodes, links).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 500: 500}


def test_bayes_bounds_keep_what_is_similar():
    low = neardup.least_matches()
    r = np.random.default_rng(1)
    matches = (r.random((20_000, neardup.HASHES)) < 0.70).reshape(20_000, -1, neardup.BATCH).sum(axis=2).cumsum(axis=1)
    assert (matches >= np.array(low)).all(axis=1).mean() > 0.995
    far = (r.random((20_000, neardup.HASHES)) < 0.45).reshape(20_000, -1, neardup.BATCH).sum(axis=2).cumsum(axis=1)
    assert (far >= np.array(low)).all(axis=1).mean() < 0.01


# --- 2 ---


def test_terms_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(terms, "FLUSH", 50)
    r = random.Random(1)
    rows = []
    for i in range(200):
        toks = [r.choice(["Ａlpha", "alpha ", "　beta", "γ", "", None, "hot", f"x{r.randint(0, 300)}"]) for _ in range(6)]
        rows.append((i * 70_001, toks, None if i % 9 == 0 else ["tag", f"t{i % 50}"], "x"))
    rows += [rows[0], (None, ["lost"], ["lost"], ""), (5, [], [], ""), (6, None, None, None)]
    df = spark.createDataFrame(rows, "doc_ord long, tokens array<string>, tags array<string>, term string")
    occ, docs = defaultdict(int), defaultdict(set)
    for i, a, b, _ in rows:
        for f, xs in (("tokens", a), ("tags", b)):
            for x in xs or []:
                t = fold(x or "").strip()
                if t and i is not None:
                    occ[f, t] += 1
                    docs[f, t].add(i)
    total = len({i for i, *_ in rows if i is not None})
    got = {(x.field, x.term): (x.occurrences, x.docs, x.mark) for x in terms.term_frequencies(df.repartition(5)).collect()}
    want = {k: (occ[k], len(v), "rare" if len(v) <= 2 else "common" if len(v) * 5 > total else None) for k, v in docs.items()}
    assert got == want
    assert terms.term_frequencies(df.where("false")).count() == 0


# --- 3 ---

ARTICLE = "ordinal long, batch_no int, account string, title string, link string, url string, source string, content_markdown string, key string"


def url(k: int, style: int = 0) -> str:
    b, m = f"Mz{k}x==", 2_200_000_000 + k
    return [
        f"https://mp.example/s?__biz={b}&mid={m}&idx=1&sn={k:032x}",
        f" http://MP.example:443/s?sn={k:032X}&amp;mid={m}&amp;idx=1&amp;__biz={b.replace('=', '%3D')}#rd\n",
        f"https://mp.example/s?from=x&mid={m}&idx=1&__biz={b}&sn={k:032x}&chksm=1",
    ][style]


def sequential(rows):
    seen, accepted, addr_of, sets, out = set(), [], {}, {}, set()
    for o, _, _, _, link, u, src, text, _ in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        if o in seen:
            continue
        seen.add(o)
        a = next((x for x in (address(link), address(u), address(src)) if x), None)
        body = letters_digits(text)
        mine = stretches(body, 5) if len(body) >= 300 else None
        hits = []
        for p in accepted:
            n = len(mine & sets[p]) if mine and sets[p] else 0
            if (a and addr_of[p] == a) or (n and n / (len(mine) + len(sets[p]) - n) >= 0.70):
                hits.append(p)
        if hits:
            out.add((min(hits), o))
        else:
            accepted.append(o)
            addr_of[o], sets[o] = a, mine
    return out


def address(s):
    import re

    if not s:
        return None
    s = s.replace("&amp;", "&")
    got = [re.search(rf"[?&]{k}=([^&#\s]+)", s) for k in ("__biz", "mid", "idx", "sn")]
    return tuple(g.group(1).replace("%3D", "=").lower() if k == 3 else g.group(1).replace("%3D", "=") for k, g in enumerate(got)) if all(got) else None


def test_linkage_is_the_sequential_rule(spark):
    r = random.Random(8)
    rows, texts, k = [], [words(r, 80) for _ in range(12)], 0
    for i in range(150):
        t = r.choice(texts)
        text = r.choice([t, edited(r, t, 8), words(r, 70), words(r, 5), None, ""])
        k = r.choice([k, i, i])
        link = r.choice([url(k, r.randrange(3)), None, "", "word"])
        rows.append((i, i // 12 + 1, r.choice(["a", None]), "t", link, r.choice([None, url(i, 1)]), r.choice(["name", url(i, 2), None]), text, "clash"))
    # a copy of a repeat that isn't itself like the accepted one: it is accepted
    chain = [words(r, 80), words(r, 80)]
    rows += [(200, 14, "a", "t", url(9000), None, None, chain[0], ""), (201, 14, "a", "t", url(9000, 1), None, None, chain[1], ""), (202, 14, "a", "t", url(9001), None, None, chain[1], ""), (203, 15, "a", "t", url(9002), None, None, chain[1], "")]
    rows += [rows[3], (None, 1, "a", "t", url(1), None, None, texts[0], "")]
    df = spark.createDataFrame(rows, ARTICLE)
    want = sequential(rows)
    assert (202, 203) in want and (200, 201) in want and (200, 202) not in want
    for per_step in (4, 20):
        history = linkage.run_batches(df, batches_per_step=per_step)
        got = [(x.accepted_ordinal, x.ordinal) for x in history.table("links").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        clusters = {x.ordinal: x.representative for x in linkage.clusters(history).collect()}
        assert len(clusters) == len({x[0] for x in rows if x[0] is not None}) and all(clusters[a] == clusters[b] for a, b in got)
    reopened = linkage.History(spark, history.path)
    assert reopened.state == history.state
    late = spark.createDataFrame([(300, 16, "a", "t", None, None, None, texts[0], "")], ARTICLE)
    done = linkage.link_batch(reopened, late).collect()
    assert [x.ordinal for x in done] == [300]
    assert linkage.run_batches(df.where("false")).steps == 0


def test_union_of_clusters_by_address_and_text(spark):
    r = random.Random(4)
    a, b = words(r, 80), words(r, 80)
    rows = [(1, 1, "a", "t", url(1), None, None, a, ""), (2, 1, "a", "t", url(2), None, None, b, ""), (3, 2, "a", "t", url(1, 1), None, None, b, "")]
    h = linkage.run_batches(spark.createDataFrame(rows, ARTICLE), batches_per_step=1)
    assert [tuple(x) for x in h.table("links").collect()] == [(3, 1, 2)]
    assert {x.ordinal: x.representative for x in linkage.clusters(h).collect()} == {1: 1, 2: 1, 3: 1}


def test_weights():
    r = np.random.default_rng(0)
    y = r.random(500) < 0.3
    x = np.stack([np.where(y, 0.8, 0.2) + r.normal(0, 0.03, 500), y, r.random(500) < 0.5, np.ones(500), np.ones(500)], axis=1)
    w = linkage.learn_weights(x, y)
    p = 1 / (1 + np.exp(-(x @ np.array(w["w"]))))
    assert (p[y] >= w["cut"]).all() and p[~y].mean() < 0.2
    assert linkage.learn_weights(x[:5], y[:5]) is None


# --- 4 ---


def test_standing_lines_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "FLUSH", 100)
    r = random.Random(2)
    rows = []
    for i in range(300):
        acc = r.choice(["hot", "hot", "hot", "b", "tiny" if i < 18 else "c", None])
        lines = [r.choice([f"唯一{i}{words(r, 2)}", "版权所有 2024", "**版权所有** 1999！", "12345", "", "关注我们" if acc == "b" else words(r, 1)]) for _ in range(r.randint(0, 6))]
        rows.append((i * 5_000, acc, None if i % 17 == 0 else r.choice(["\n", "\r\n"]).join(lines), "x"))
    rows += [rows[0], (None, "hot", "版权所有", ""), (99, "hot", "", "")]
    df = spark.createDataFrame(rows, "ordinal long, account string, content_markdown string, lines string")
    docs, has = defaultdict(set), defaultdict(set)
    for o, a, t, _ in rows:
        if o is not None and a is not None:
            docs[a].add(o)
            for x in (t or "").split("\n") if t is not None else []:
                if letters(x):
                    has[a, letters(x)].add(o)
    want = {(o, k) for o, a, t, _ in rows if o is not None and a is not None and t is not None and len(docs[a]) >= 10 for k, x in enumerate(t.split("\n")) if letters(x) and len(has[a, letters(x)]) * 5 >= 2 * len(docs[a])}
    out = boilerplate.mark_lines(df.repartition(6)).collect()
    assert {(x.id, k) for x in out for k in x.line_nos} == want and want
    assert len(out) == len(rows)
    text = {o: t for o, _, t, _ in rows}
    for x in out:
        if x.id is not None and text[x.id] is not None:
            gone = set(x.line_nos)
            assert x.body == "\n".join(s for k, s in enumerate(text[x.id].split("\n")) if k not in gone)
    monkeypatch.setattr(boilerplate.shared, "BROADCAST_BYTES", -1)
    again = boilerplate.mark_lines(df.repartition(6)).collect()
    assert {(x.id, k) for x in again for k in x.line_nos} == want
    assert boilerplate.mark_lines(df.where("false")).count() == 0


# --- 5 ---


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("# {{title}}\n\n正文", "template"),
        ("亲爱的${nickname}，你好！以下是本期内容。", "template"),
        ("截至____年__月，累计用户____万", "template"),
        ("来源：[object Object]，点击量：null\n" + "正文很长。" * 50, "template"),
        ("In the template, {{昵称}} stands for the account name.", None),
        ("导出模板里的 `{{ 正文 }}` 会在写盘前替换成真实值。", None),
        ("render('{{ 摘要 }}', ctx)", None),
        ("设计师常用 lorem ipsum 排版，编辑部却坚持用真实稿件。", None),
        ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"),
        ("502 Bad Gateway\nnginx/1.2.3", "error"),
        ("页面走丢了\nRef #fe1534cbf14865fa", "error"),
        ("请启用 JavaScript 后继续浏览", "script"),
        ("有人主张关闭 JavaScript 再抓正文，团队试了3个账号，多数页面仍能读到全文。", None),
        ("所谓“环境异常”页，团队统计到3次，都已剔除。", None),
        ("环境异常\n" + "这里是一篇完整的文章，讲动量因子。" * 30, None),
        ("短文。", None),
        ("", None),
        (None, None),
        ("　\n", None),
    ],
)
def test_residue(text, kind):
    assert residue.score_text(text)[0] == kind


def test_residue_rows(spark):
    df = spark.createDataFrame([(1, None, "404 Not Found", ""), (1, None, "404 Not Found", ""), (None, "", None, ""), (3, "好" * 300_000, None, "")], "ordinal long, content_text string, content_markdown string, kind string")
    got = [(x.id, x.kind) for x in residue.score_residue(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "error"), (1, "error"), (None, None), (3, None)], key=str)
    assert residue.score_residue(df.where("false")).count() == 0


# --- 6 ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_plan_places_every_item_once(lengths):
    counts = np.bincount(np.array(lengths, dtype=int), minlength=65)
    plan = packing.plan_packing(counts, 64)
    left = np.zeros(65, dtype=int)
    for items, times in plan:
        assert sum(items) <= 64
        for n in items:
            left[n] += times
    assert (left == counts).all()


def test_plan_is_close_to_the_bound():
    r = np.random.default_rng(0)
    lengths = np.clip(r.lognormal(6.3, 0.6, 50_000), 1, 2048).astype(int)
    plan = packing.plan_packing(np.bincount(lengths, minlength=2049))
    assert sum(t for _, t in plan) <= 1.01 * np.ceil(lengths.sum() / 2048)


@pytest.mark.parametrize("kind", ["uniform", "lognormal", "normal"])
def test_patterns_carry_most_items(kind):
    r = np.random.default_rng(0)
    lengths = {"uniform": lambda: r.integers(1, 2049, 100_000), "lognormal": lambda: r.lognormal(6.3, 0.6, 100_000), "normal": lambda: r.normal(900, 200, 100_000)}[kind]()
    counts = np.bincount(np.clip(lengths, 1, 2048).astype(int), minlength=2049)
    plan, placed = packing.pattern_plan(counts)
    assert placed >= 0.78 * 100_000
    assert sum(t for _, t in plan) <= sum(t for _, t in packing.best_fit(counts, 2048))


def test_nnls():
    a = np.array([[1.0, 0], [0, 1], [1, 1]])
    assert np.allclose(packing.nnls(a, a @ [2.0, 3.0]), [2, 3], atol=1e-4)
    assert packing.nnls(a, np.array([-1.0, 2, 0]))[0] == 0


def test_packing(spark):
    r = random.Random(6)
    rows = [(i, words(r, r.randint(1, 60)), "x") for i in range(120)] + [(500, words(r, 900), ""), (501, "", ""), (502, None, ""), (None, "a", ""), (503, " ", ""), (1, words(r, 3), ""), (1, words(r, 3), "")]
    rows += [(1000 + i, "same text", "") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string")
    out = packing.pack(df.repartition(7), capacity=256).collect()
    enc = packing._encoding(packing.default_tokenizer())
    want = defaultdict(int)
    for i, t, _ in rows:
        if i is not None and t:
            want[i] += len(enc.encode_ordinary(t))
    got, boxes = defaultdict(int), defaultdict(list)
    for x in out:
        got[x.doc_id] += x.n_tokens
        boxes[x.container].append(x)
    assert got == {k: v for k, v in want.items() if v}
    for items in boxes.values():
        at = 0
        for k, x in enumerate(sorted(items, key=lambda x: x.position)):
            assert (x.position, x.start) == (k, at)
            at += x.n_tokens
        assert at <= 256
    assert sorted(boxes) == list(range(len(boxes)))
    long = [x for x in out if x.doc_id == 500]
    assert len(long) == -(-want[500] // 256) and sum(x.n_tokens == 256 for x in long) == want[500] // 256
    assert len(boxes) <= 1.15 * sum(want.values()) / 256 + 1
    assert packing.pack(df.where("false")).count() == 0


# --- 7 ---


def test_search_finds_all_occurrences():
    r = random.Random(9)
    text = "".join(r.choice("abcd") for _ in range(30_000))
    picks = sorted({text[i : i + 8] for i in (0, 5, 777, 2040, 2047, 2050, 29_992)} | {"zzzzzzzz", "abababab"})
    machine = leaks.WuManber(np.array([[ord(c) for c in p] for p in picks], dtype=np.uint32))
    docs = [text, "", "short", text[100:120], text[:8]]
    cp, off = X.code_points(pa.array(docs))
    at, number = machine.search(cp, off)
    got = {(int(a), picks[k]) for a, k in zip(at, number, strict=True)}
    want = {(int(off[d]) + i, t[i : i + 8]) for d, t in enumerate(docs) for i in range(len(t) - 7) if t[i : i + 8] in picks}
    assert got == want and len(at) == len(want)


@pytest.mark.parametrize("scan", [14, 1_000])
def test_leaks_against_brute_force(spark, monkeypatch, scan):
    monkeypatch.setattr(leaks, "ITEMS_PER_TABLE", 7)
    monkeypatch.setattr(leaks, "ITEMS_PER_SCAN", scan)
    r = random.Random(7)
    items = [(i, words(r, 14), "q") for i in range(20)] + [(50, None, ""), (51, "短", ""), (52, "", ""), (None, "x" * 40, ""), (0, None, "")]
    docs = []
    for i in range(120):
        p = r.choice(items[:20])[1]
        h = len(p) // 2
        t = r.choice([p, p.upper(), "。".join(p), p[: h + 12], p[:h] + "填充" * 9 + p[h:], p[: len(p) // 4], words(r, 20)])
        docs.append((i, words(r, 10) + t + words(r, 10), "clash"))
    docs += [(900, None, ""), (901, "", ""), (None, items[0][1], ""), docs[0], (902, words(r, 4_000) + items[3][1], "")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, passage string, text string")
    want = set()
    for i, p, _ in items:
        s = stretches(letters_digits(p), 8) if p and len(letters_digits(p)) >= 8 else set()
        for j, t, _ in docs:
            if s and j is not None and t and len(s & stretches(letters_digits(t), 8)) / len(s) >= leaks.LEAK_SHARE and i is not None:
                want.add((j, i))
    got = [(x.doc_id, x.item_id) for x in leaks.find_leaks(d, q).collect()]
    assert set(got) == want and len(got) == len(want)
    assert leaks.find_leaks(d.where("false"), q).count() == 0 and leaks.find_leaks(d, q.where("false")).count() == 0


# --- 8 ---


@pytest.mark.parametrize(
    ("text", "category"),
    [
        ("网友12：你就是个白痴，滚远点", "abusive"),
        ("真·想·抽·你·两·巴·掌", "abusive"),
        ("活着浪费空汽的人", "abusive"),
        ("Y0u p4thet1c clown", "abusive"),
        ("GO KILL YOURSELF", "abusive"),
        ("go kil yourself", "abusive"),
        ("跟灰谷教徒讲理等于对牛弹琴，这群劣等货", "hateful"),
        ("They breed like rats and stink like them.", "hateful"),
        ("加薇信看果聊视频，身材火辣随便看", "sexual"),
        ("敏感词表里收了“傻逼”“白痴”等词，只用于过滤。", None),
        ("The moderation guide lists \"idiot\" as a term to hide.", None),
        ("审核员说，遇到“你就是个白痴，滚远点”这类留言会先取证再处理。", None),
        ("废物利用课上，团队把3只旧箱子改成了书架。", None),
        ("A closer look at the idiotic-free loserless code.", None),
        ("进程卡死时先 kill 再重启。", None),
        ("", None),
        (None, None),
    ],
)
def test_abuse(spark, text, category):
    df = spark.createDataFrame([(1, text, "s", 5)], "doc_id long, text string, source string, score int")
    assert abuse.score_abuse(df).first().category == category


def test_misspellings_by_brute_force():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    lex, r = abuse.lexicon(), random.Random(1)
    long = [i for i, (t, _, strong) in enumerate(lex.terms) if strong and len(t) >= (9 if t.isascii() else 5)]
    for i in r.sample(long, 40):
        t = lex.terms[i][0]
        k = r.randrange(len(t))
        for s in (t, t[:k] + "q" + t[k:], t[:k] + t[k + 1 :], t[:k] + "q" + t[k + 1 :]):
            found = lex.matches("前文" + s + "后文")
            assert i in {x for x, _, _ in found}
            assert all(distance(lex.terms[x][0], ("前文" + s + "后文")[a:b]) <= 1 for x, a, b in found)


def test_rates(spark):
    df = spark.createDataFrame([(1, "你个人渣，老子弄死你信不信", "a"), (2, "好", "a"), (3, "好", None), (3, "好", None)], "doc_id long, text string, source string")
    got = {x.source: (x.docs, x.abusive_docs, x.rate) for x in abuse.abuse_rates(abuse.score_abuse(df)).collect()}
    assert got == {"a": (2, 1, 0.5), None: (1, 0, 0.0)}
    assert abuse.score_abuse(df.where("false")).count() == 0
    assert abuse.score_abuse(df.withColumn("text", F.repeat(F.lit("很长"), 400_000)).limit(1)).first().score == 0


def test_against_reviewers(spark, small):
    """Reviewers' verdicts are sometimes wrong: agreement must be high, not perfect."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/review_labels.parquet").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    x = queries.p8_scores(spark, d).select("doc_id", (F.col("score") >= abuse.THRESHOLD).cast("int").alias("p")).join(labels, "doc_id")
    n = {(r.toxic, r.p): r["count"] for r in x.groupBy("toxic", "p").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.9
    assert n[0, 0] / (n[0, 0] + n.get((1, 0), 0)) > 0.95
