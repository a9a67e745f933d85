"""Problem 2: frequency of every distinct term, by a vertical layout of record bitmaps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import _bitmap as B
from textloom.llm._text import fold_str

#: Identifiers per bitmap chunk: 2**16. Postings a map task holds before it writes its partial bitmaps.
BITS, FLUSH = 16, 1_500_000
#: A term in at most RARE_DOCS records is rare; one in more than COMMON_SHARE of all records is common.
RARE_DOCS, COMMON_SHARE = 2, (1, 5)

_SCHEMA = "field string, term string, chunk long, bitmap binary, occurrences long"


def normal_term(s: str | None) -> str | None:
    """Folded and trimmed; None for null and blank values."""
    if s is None:
        return None
    s = (s.lower() if s.isascii() else fold_str(s)).strip()
    return s or None


def partial_bitmaps(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """(field, term, chunk, bitmap, occurrences): per map task, the records of each term as compressed bitmap chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        vocab: dict[str, int] = {}
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, vocab, count
            terms = list(vocab)
            for f, name in enumerate(fields):
                parts = [(c, i) for g, c, i in held if g == f]
                if not parts:
                    continue
                code, ids = np.concatenate([c for c, _ in parts]), np.concatenate([i for _, i in parts])
                (code,), chunk, maps, _, occ = B.group_ids([code], ids, BITS)
                for s in range(0, len(code), 50_000):
                    e = s + 50_000
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(code[s:e])), pa.array([terms[c] for c in code[s:e]], pa.string()), pa.array(chunk[s:e]), maps[s:e], pa.array(occ[s:e].astype(np.int64))],
                        names=["field", "term", "chunk", "bitmap", "occurrences"],
                    )
            held, vocab, count = [], {}, 0

        for b in batches:
            ids = b.column(id_col)
            valid = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            idv = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for f, name in enumerate(fields):
                col = b.column(name)
                flat, parent = pc.list_flatten(col), pc.list_parent_indices(col).to_numpy(zero_copy_only=False)
                d = pc.dictionary_encode(flat)
                lookup = np.full(len(d.dictionary) + 1, -1, dtype=np.int64)
                for j, v in enumerate(d.dictionary.to_pylist()):
                    t = normal_term(v)
                    if t is not None:
                        lookup[j] = vocab.setdefault(t, len(vocab))
                code = lookup[pc.fill_null(d.indices, len(d.dictionary)).to_numpy(zero_copy_only=False)]
                ok = (code >= 0) & valid[parent]
                held.append((f, code[ok], idv[parent[ok]]))
                count += int(ok.sum())
            if count >= FLUSH:
                yield from flush()
        yield from flush()

    return df.select(F.col(id_col).cast("long").alias(id_col), *[F.col(f).cast("array<string>").alias(f) for f in fields]).mapInArrow(run, _SCHEMA)


def merge_bitmaps(partials: DataFrame) -> DataFrame:
    """(field, term, chunk, bitmap, docs, occurrences): union of the partial bitmaps of each chunk.

    One group holds at most 2**16 identifiers' containers, whatever the term's frequency.
    """
    grouped = partials.groupBy("field", "term", "chunk").agg(F.collect_list("bitmap").alias("parts"), F.sum("occurrences").alias("occurrences"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column("parts")
            n = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
            first = pc.list_element(parts, 0)
            size = pc.binary_length(first).to_numpy(zero_copy_only=False)
            card = (size // 2).astype(np.int64)
            special = np.flatnonzero((n > 1) | (size == B.bitset_bytes(BITS)))
            if len(special):
                maps = first.to_pylist()
                for i in special:
                    maps[i] = B.union(parts[int(i)].as_py(), BITS)
                    card[i] = B.cardinality(maps[i], BITS)
                first = pa.array(maps, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("field"), b.column("term"), b.column("chunk"), first, pa.array(card), b.column("occurrences")], names=["field", "term", "chunk", "bitmap", "docs", "occurrences"])

    return grouped.mapInArrow(run, "field string, term string, chunk long, bitmap binary, docs long, occurrences long")


def term_frequencies(df: DataFrame, id_col: str = "doc_ord", fields: Sequence[str] = ("tokens", "tags")) -> DataFrame:
    """(field, term, occurrences, docs, mark) of every distinct folded and trimmed term of the array columns.

    docs is the cardinality of the term's bitmap; mark is rare, common or null. Records are told apart by id_col:
    repeated rows count once in docs and each time in occurrences; rows with a null id, null arrays, null and blank
    values are ignored. With no rows the result is empty. Other columns are not read.
    """
    merged = merge_bitmaps(partial_bitmaps(df, id_col, fields)).drop("bitmap")
    total = df.agg(F.count_distinct(F.col(id_col).cast("long")).alias("__all"))
    num, den = COMMON_SHARE
    mark = F.when(F.col("docs") <= RARE_DOCS, F.lit("rare")).when(F.col("docs") * den > F.col("__all") * num, F.lit("common"))
    return (
        merged.groupBy("field", "term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("docs").alias("docs"))
        .crossJoin(F.broadcast(total))  # one row
        .select("field", "term", "occurrences", "docs", mark.alias("mark"))
    )
