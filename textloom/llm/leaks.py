"""Problem 7: evaluation passages inside training texts, by Wu-Manber multi-pattern search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm._text import code_points, keep_only, slices, tables

#: Length of a test string, of the block of the shift table.
STRETCH, BLOCK = 8, 3
#: Share of a passage's distinct stretches that must be in a document, in one or more pieces: pairs that are no leak share 0.45 at most.
LEAK_SHARE = 0.455
#: Items whose strings make one table, and items searched in one scan of the documents; more items take more scans.
ITEMS_PER_TABLE, ITEMS_PER_SCAN = 5_000, 40_000
#: Code points a scanning cursor goes over; longer texts are scanned by several cursors that overlap.
CURSOR = 2_048


class WuManber:
    """Shift table over blocks, suffix-hash buckets, and direct comparison, for test strings of STRETCH code points.

    Cursors of many text segments move in step: at each step every cursor reads the block that ends at its window and
    skips ahead by the shift table's distance. Where that is 0, the block's suffix bucket holds the strings that end
    with it; those whose first block has the window's prefix hash are compared.
    """

    def __init__(self, strings: np.ndarray):
        """strings: (n, STRETCH) distinct rows of code points. The shift table has some 16 slots for each of their blocks."""
        self.strings = strings
        far = STRETCH - BLOCK + 1
        self.bits = int(np.clip(np.ceil(np.log2(16.0 * far * max(len(strings), 1))), 16, 27))
        self.shift = np.full(1 << self.bits, far, dtype=np.uint8)
        for at in range(far):
            np.minimum.at(self.shift, self._slot(self._block(strings[:, at : at + BLOCK])), far - 1 - at)
        suffix, prefix = self._block(strings[:, -BLOCK:]), self._block(strings[:, :BLOCK])
        self.order = np.lexsort((prefix, suffix))
        self.suffix, self.prefix = suffix[self.order], prefix[self.order]
        #: ranges of the strings with one suffix block and one prefix block
        first = np.ones(len(strings), dtype=bool)
        first[1:] = (self.suffix[1:] != self.suffix[:-1]) | (self.prefix[1:] != self.prefix[:-1])
        self.start = np.flatnonzero(first)
        self.size = np.diff(np.append(self.start, len(strings)))
        self.bucket, self.bucket_start = np.unique(self.suffix[self.start], return_index=True)
        self.bucket_size = np.diff(np.append(self.bucket_start, len(self.start)))

    @staticmethod
    def _block(b: np.ndarray) -> np.ndarray:
        """A block's code points as one number: blocks are 3 code points of 21 bits, so equal numbers are equal blocks."""
        h = b[:, 0].astype(np.uint64)
        for j in range(1, BLOCK):
            h = (h << np.uint64(21)) | b[:, j].astype(np.uint64)
        return h

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return ((block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in cp, numbers of the test strings there), for all documents between offsets."""
        lens = np.diff(off)
        pieces = np.maximum(1, -(-np.maximum(lens - STRETCH + 1, 1) // CURSOR))
        doc = np.repeat(np.arange(len(lens)), pieces)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        pos = off[doc] + k * CURSOR
        stop = np.minimum(pos + CURSOR + STRETCH - 1, off[doc + 1])  # windows end before stop
        live = pos + STRETCH <= stop
        pos, stop = pos[live], stop[live]
        hits: list[np.ndarray] = []
        c = cp.astype(np.uint64)
        while len(pos):
            e = pos + STRETCH - BLOCK
            h = c[e]
            for j in range(1, BLOCK):
                h = (h << np.uint64(21)) | c[e + j]
            s = self.shift[self._slot(h)]
            zero = s == 0
            if zero.any():
                hits.append(pos[zero])
            pos = pos + np.where(zero, 1, s)
            live = pos + STRETCH <= stop
            if not live.all():
                pos, stop = pos[live], stop[live]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.sort(np.concatenate(hits))
        suffix = self._block(cp[at[:, None] + np.arange(STRETCH - BLOCK, STRETCH)])
        where = np.minimum(np.searchsorted(self.bucket, suffix), len(self.bucket) - 1)
        there = self.bucket[where] == suffix
        at, where = at[there], where[there]
        # the bucket's prefixes: one range of strings with the window's prefix, if any
        lo, n = self.bucket_start[where], self.bucket_size[where]
        at, bucket = _each(at, lo, n)
        same = self._block(cp[at[:, None] + np.arange(BLOCK)]) == self.prefix[self.start[bucket]]
        at, group = at[same], bucket[same]
        at, k = _each(at, self.start[group], self.size[group])
        number = self.order[k]
        same = (self.strings[number] == cp[at[:, None] + np.arange(STRETCH)]).all(axis=1)  # direct comparison
        return at[same], number[same]


def _each(at: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every value of at with each of its n numbers from first on."""
    rep = np.repeat(np.arange(len(at)), n)
    return at[rep], first[rep] + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)


def _patterns(items: list[tuple[int, str | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct test strings, pairs sorted by string: string number, item index; item ids; stretches per item) of passages."""
    cp, off = code_points(pa.array([p for _, p in items], pa.string()))
    cp, off = keep_only(cp, off, tables()[2])
    rows, owner = [], []
    for i in range(len(items)):
        a, b = int(off[i]), int(off[i + 1])
        if b - a >= STRETCH:
            w = np.lib.stride_tricks.sliding_window_view(cp[a:b], STRETCH)
            w = np.unique(w, axis=0)
            rows.append(w)
            owner.append(np.full(len(w), i))
    if not rows:
        return np.zeros((0, STRETCH), np.uint32), np.zeros(0, int), np.zeros(0, int), np.array([i for i, _ in items]), np.zeros(len(items), int)
    everything, of_item = np.concatenate(rows), np.concatenate(owner)
    strings, number = np.unique(everything, axis=0, return_inverse=True)
    order = np.lexsort((of_item, number.reshape(-1)))
    size = np.bincount(of_item, minlength=len(items))
    return strings, number.reshape(-1)[order], of_item[order], np.array([i for i, _ in items], dtype=np.int64), size


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", share: float = LEAK_SHARE) -> DataFrame:
    """(doc_id, item_id, share): documents that hold at least share of an item's distinct STRETCH-character stretches.

    Both sides are folded and reduced to letters and digits, so case, width, punctuation, spacing and layout do not
    matter; the stretches may lie anywhere in the document, so several pieces add up and changed words cost only the
    stretches over them. Each document is read whole, in one task, with no shuffle of texts; items are the stated query
    set, in tables of ITEMS_PER_TABLE, all of ITEMS_PER_SCAN items over each decoded batch of documents. Null and blank texts or passages, and passages shorter than a stretch, give
    no row; repeated documents and items give one row per pair.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    queries = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(passage).cast("string").alias("passage")).where(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).distinct()
    out = None

    def search(blocks: list[list[tuple[int, str | None]]]) -> DataFrame:
        shared = [spark.sparkContext.broadcast(_patterns(b)) for b in blocks]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables_ = []
            for x in shared:
                strings, numbers, owners, ids, size = x.value
                if len(strings):
                    first, last = np.searchsorted(numbers, np.arange(len(strings))), np.searchsorted(numbers, np.arange(len(strings)), side="right")
                    tables_.append((WuManber(strings), len(strings), first, last, owners, ids, size))
            for whole in batches if tables_ else ():
                for b in slices(whole, "text"):
                    cp, off = keep_only(*code_points(b.column("text")), tables()[2])
                    for machine, n_strings, first, last, owners, ids, size in tables_:
                        at, number = machine.search(cp, off)
                        doc = np.searchsorted(off, at, side="right") - 1
                        pair = np.unique(doc * n_strings + number)  # a stretch counts once a document
                        doc, number = pair // n_strings, pair % n_strings
                        doc, k = _each(doc, first[number], last[number] - first[number])
                        key, count = np.unique(doc * len(ids) + owners[k], return_counts=True)
                        part = count / size[key % len(ids)]
                        ok = part >= share
                        key = key[ok]
                        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(key // len(ids))), pa.array(ids[key % len(ids)]), pa.array(part[ok])], names=["doc_id", "item_id", "share"])

        return base.mapInArrow(run, "doc_id long, item_id long, share double")

    blocks: list[list[tuple[int, str | None]]] = [[]]
    for row in queries.toLocalIterator():
        if len(blocks[-1]) == ITEMS_PER_TABLE:
            if len(blocks) * ITEMS_PER_TABLE >= ITEMS_PER_SCAN:
                out = search(blocks) if out is None else out.unionByName(search(blocks))
                blocks = []
            blocks.append([])
        blocks[-1].append((row.item_id, row.passage))
    out = search(blocks) if out is None else out.unionByName(search(blocks))
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
