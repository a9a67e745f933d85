"""Problem 4: lines repeated across one source's documents, by bitmaps of each line's documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import shared
from textloom.llm import _bitmap as B
from textloom.llm._spark import Scratch, materialize
from textloom.llm._text import code_points, mix64, slices, tables

#: 4,096 identifiers a bitmap chunk: a hot source spreads over many chunks. Postings a map task holds before writing.
BITS, FLUSH = 12, 1_500_000
#: A source needs MIN_DOCS documents; a line in at least SHARE of them is standing text.
MIN_DOCS, SHARE = 10, (2, 5)

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def line_keys(cp: np.ndarray, off: np.ndarray, variants: bool = False) -> tuple[np.ndarray, ...]:
    r"""(document index, line number, key) of every line, split at \n; key 0: a line without letters.

    The key is a 64-bit polynomial hash of the line folded and reduced to letters, so variants of a line
    (width, case, digits, punctuation, marks of Markdown) share it. With variants a hash of the line as it is spelt comes too.
    """
    fold, letter, _ = tables()
    n = len(cp)
    starts_of_doc = off[:-1]
    nl = np.flatnonzero(cp == 10)
    doc_of_nl = np.searchsorted(off, nl, side="right") - 1
    all_begin = np.concatenate([starts_of_doc, nl + 1])
    all_doc = np.concatenate([np.arange(len(off) - 1), doc_of_nl])
    order = np.lexsort((np.concatenate([np.zeros(len(starts_of_doc)), np.ones(len(nl))]), all_begin, all_doc))
    begin, doc = all_begin[order], all_doc[order]
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    end = np.where(last, off[doc + 1], np.append(begin[1:], n) - 1) if len(doc) else begin
    f = fold[cp]
    keep = letter[f]
    cum = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(keep, out=cum[1:])
    a, b = cum[begin], cum[end]
    key = _hashes(f[keep], a, b)
    key[(b - a) == 0] = 0
    first = np.zeros(len(off) - 1, dtype=np.int64)
    first[doc[::-1]] = np.arange(len(doc))[::-1]
    number = np.arange(len(doc)) - first[doc]
    return (doc, number, key, _hashes(cp, begin, end)) if variants else (doc, number, key)


def _hashes(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each stretch x[begin:end], by differences of prefix sums."""
    m = len(x)
    powers = np.ones(m + 1, dtype=np.uint64)
    inverse = np.ones(m + 1, dtype=np.uint64)
    if m:
        powers[1:] = _PRIME
        inverse[1:] = _INVERSE
        np.multiply.accumulate(powers, out=powers)
        np.multiply.accumulate(inverse, out=inverse)
    prefix = np.zeros(m + 1, dtype=np.uint64)
    np.cumsum(mix64(x.astype(np.uint64) + np.uint64(1)) * powers[:m], out=prefix[1:])
    return mix64((prefix[end] - prefix[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


def _prepared(df: DataFrame, id_col: str, source: str, text: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(source)).alias("src"), F.col(text).cast("string").alias("text")).where(F.col(id_col).isNotNull() & F.col(source).isNotNull())


def partial_bitmaps(prepared: DataFrame) -> DataFrame:
    """(src, line, variant, chunk, bitmap, docs): per map task the documents of each line as it is spelt (variant)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            if count:
                src, line, variant, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                (src, line, variant), chunk, maps, card, _ = B.group_ids([src, line, variant], ids, BITS)
                for s in range(0, len(src), 100_000):
                    e = s + 100_000
                    yield pa.RecordBatch.from_arrays([*[pa.array(x[s:e]) for x in (src, line, variant, chunk)], maps[s:e], pa.array(card[s:e].astype(np.int32))], names=["src", "line", "variant", "chunk", "bitmap", "docs"])
            held, count = [], 0

        for whole in batches:
            for b in slices(whole, "text"):
                cp, off = code_points(b.column("text"))
                doc, _, key, variant = line_keys(cp, off, variants=True)
                ok = key != 0
                doc, key, variant = doc[ok], key[ok].view(np.int64), variant[ok].view(np.int64)
                held.append((b.column("src").to_numpy()[doc], key, variant, b.column("id").to_numpy()[doc]))
                count += len(doc)
                if count >= FLUSH:
                    yield from flush()
        yield from flush()

    return prepared.where(F.col("text").isNotNull()).mapInArrow(run, "src long, line long, variant long, chunk long, bitmap binary, docs int")


def standing_lines(df: DataFrame, id_col: str = "ordinal", source: str = "account", text: str = "content_markdown") -> DataFrame:
    """(src, line, chunk, bitmap): the document bitmaps of every line that is standing text of its source, its variants united.

    Lines that can't be standing text go first, by the sums of their variants' cardinalities (combined before the
    shuffle). The rest is united by chunk, so a line of a hot source is spread over as many groups as it has chunks.
    """
    prepared = _prepared(df, id_col, source, text)
    sources = prepared.select("src", "id").groupBy("src").agg(F.count_distinct("id").alias("all_docs")).where(F.col("all_docs") >= MIN_DOCS)
    num, den = SHARE
    partial = materialize(partial_bitmaps(prepared), "p4-partial")
    able = partial.groupBy("src", "line").agg(F.sum("docs").alias("bound")).where(F.col("bound") * den >= MIN_DOCS * num).select("src", "line")
    many = partial.join(able, ["src", "line"], "left_semi").repartition("src", "line", "chunk")
    grouped = many.groupBy("src", "line", "chunk").agg(F.collect_list("bitmap").alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [B.union(p, BITS) for p in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("src"), b.column("line"), b.column("chunk"), pa.array(maps, pa.binary()), pa.array([B.cardinality(m, BITS) for m in maps], pa.int64())], names=["src", "line", "chunk", "bitmap", "docs"])

    united = materialize(grouped.mapInArrow(run, "src long, line long, chunk long, bitmap binary, docs long"), "p4-lines")
    exact = united.groupBy("src", "line").agg(F.sum("docs").alias("line_docs")).join(sources, "src").where(F.col("line_docs") * den >= F.col("all_docs") * num)
    return united.join(exact.select("src", "line"), ["src", "line"]).select("src", "line", "chunk", "bitmap")


def mark_lines(df: DataFrame, id_col: str = "ordinal", source: str = "account", text: str = "content_markdown") -> DataFrame:
    r"""(id, line_nos array<int>, body): every row's standing lines by number, and its text without them.

    A line is standing text if, folded and reduced to letters, it is in at least two fifths of the distinct ids of a
    source with at least ten of them (ids without text included). Line numbers count from 0 over the text split at \n.
    Rows with a null id, source or text have no standing lines (null text stays null); repeated rows count once and
    each give a row. Lines without letters never count. Other columns are not read.
    """
    with Scratch(df.sparkSession) as tables_:
        hot = standing_lines(df, id_col, source, text)
        # at most 1 / SHARE x the mean lines of a document per source and chunk
        lists = tables_.keep(materialize(hot.groupBy("src", "chunk").agg(F.collect_list(F.struct("line", "bitmap")).alias("lines")), "p4-lists"))
    size = lists.select(F.explode("lines").alias("x")).agg(F.sum(F.length("x.bitmap") + 64)).first()[0] or 0  # bytes, measured
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(source)).alias("src"), F.col(source).isNotNull().alias("known"), F.col(text).cast("string").alias("text")).withColumn("chunk", F.shiftright("id", BITS))
    joined = rows.join(F.broadcast(lists) if size <= shared.BROADCAST_BYTES else lists, ["src", "chunk"], "left").select("id", "src", "text", F.when(F.col("known"), F.col("lines")).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << BITS) - 1
        for whole in batches:
            for b in slices(whole, "text"):
                ids, src, texts, lists_ = b.column("id").to_pylist(), b.column("src").to_pylist(), b.column("text").to_pylist(), b.column("lines")
                of_chunk: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
                cp, off = code_points(b.column("text"))
                doc, no, key = line_keys(cp, off)
                key = key.view(np.int64)
                bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
                nos, bodies = [], []
                for i, t in enumerate(texts):
                    found: list[int] = []
                    if t and ids[i] is not None and lists_[i].is_valid:
                        low, at = ids[i] & mask, (src[i], ids[i] >> BITS)
                        if at not in of_chunk:
                            of_chunk[at] = [(x["line"], x["bitmap"]) for x in lists_[i].as_py()]
                        drop = [line for line, bitmap in of_chunk[at] if B.contains(bitmap, low, BITS)]
                        if drop:
                            mine = slice(bounds[i], bounds[i + 1])
                            hit = np.isin(key[mine], np.array(drop, dtype=np.int64))
                            found = no[mine][hit].tolist()
                    if found:
                        gone = set(found)
                        t = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone)
                    nos.append(found)
                    bodies.append(t)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.list_(pa.int32())), pa.array(bodies, pa.string())], names=["id", "line_nos", "body"])

    return joined.mapInArrow(run, "id long, line_nos array<int>, body string")
