"""Problem 6: filling fixed-capacity containers, by pattern packing with non-negative least squares."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm._spark import materialize
from textloom.llm._text import slices

CAPACITY = 2_048
#: Items per pattern and bins of the length histogram over which patterns are enumerated.
MAX_ITEMS, BINS = 4, 44
#: Weight of a pattern's unused room, beside its fit to the histogram; share of a bin that a repeat may leave over what its bins leave.
WASTE, SLACK = 0.25, 0.05
#: Rounds of fitting full containers to what is left, until REST of the items are; one of others follows while twice that are.
ROUNDS, REST = 14, 0.08
#: Items that one task ranks, on average; never fewer hash buckets than LEAST_BUCKETS.
RANKED, LEAST_BUCKETS = 200_000, 64
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def token_counts(df: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(id, n_tokens) of every row with a text that has tokens; tokenizer: path of a .tiktoken file of ranks."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        for whole in batches:
            for b in slices(whole, "text"):
                n = [len(enc.encode_ordinary(t)) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64())], names=["id", "n_tokens"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(F.col(id_col).isNotNull() & (F.length("text") > 0))
    return rows.mapInArrow(run, "id long, n_tokens long").where("n_tokens > 0")


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Non-negative least squares min |a x - b| by active sets: a column enters while it lowers the residual, and those that turn negative leave."""
    x = np.zeros(a.shape[1])
    if not a.size:
        return x
    active = np.zeros(a.shape[1], dtype=bool)
    for _ in range(6 * a.shape[0]):
        gain = np.where(active, -np.inf, a.T @ (b - a @ x))
        j = int(np.argmax(gain))
        if gain[j] <= tolerance:
            break
        active[j] = True
        while True:
            cols = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if (z > 0).all():
                break
            now, bad = x[cols], z <= 0
            step = np.min(now[bad] / np.maximum(now[bad] - z[bad], 1e-300))
            x[cols] = now + step * (z - now)
            active[cols[bad & (x[cols] <= 1e-12)]] = False
            x[~active] = 0.0
            if not active.any():
                return x
        x[:] = 0.0
        x[cols] = z
    return x


def patterns(capacity: int, present: np.ndarray, bins: int = BINS, items: int = MAX_ITEMS) -> list[tuple[int, ...]]:
    """Combinations of at most items bins (of those present) that can be filled, and to which no bin's shortest item could be added.

    A combination of items bins counts too if it leaves more room: its repeats and the rest are then filled up.
    """
    width = capacity / bins
    use = [int(i) for i in np.flatnonzero(present)]
    least = use[0] * width + 1 if use else 0.0
    out: list[tuple[int, ...]] = []

    def grow(prefix: tuple[int, ...], low: float, high: float) -> None:
        full = capacity - high < least
        if prefix and (full or len(prefix) == items) and high >= 0.5 * capacity:
            out.append(prefix)
        if len(prefix) == items:
            return
        for i in use:
            if (prefix and i > prefix[-1]) or low + i * width + 1 > capacity:
                break
            grow((*prefix, i), low + i * width + 1, high + (i + 1) * width)

    grow((), 0.0, 0.0)
    return out


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Containers as (exact lengths, repeat) for counts[length] items of each length 1..capacity.

    Patterns over a coarse histogram get repeat counts by non-negative least squares, which weigh unused room too, then
    rounded. Each repeat takes lengths of its bins, the last two so that the room left is least, and what its items leave is
    filled with the longest items that fit. A pattern ends when its bins can't fill a container any more. Best-fit
    decreasing packs what is left, on the exact histogram: work and result depend on the capacity, not on the items' number.
    """
    return pattern_plan(counts, capacity)[0]


def pattern_plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(plan, items placed by patterns)."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    whole = int(left[capacity])
    plan: list[tuple[tuple[int, ...], int]] = [((capacity,), whole)] if whole else []  # a full piece is a pattern of its own
    left[capacity] = 0
    every = int(left.sum())
    for n in range(ROUNDS):
        before = int(left.sum())
        if before <= REST * every:
            break
        _round_of_patterns(left, plan, capacity, min(BINS + 4 * n, capacity), strict=True)
        if before - int(left.sum()) < 0.02 * before:
            break
    if left.sum() > 2 * REST * every:
        _round_of_patterns(left, plan, capacity, min(BINS, capacity), strict=False)
    placed = int(counts[1:].sum() - left.sum())
    return plan + best_fit(left, capacity), placed


def _round_of_patterns(left: np.ndarray, plan: list, capacity: int, bins: int, strict: bool) -> None:
    """Takes containers of patterns off left, onto plan; strict: full ones alone."""
    width = capacity / bins
    bin_of = np.minimum((np.arange(capacity + 1) - 1) * bins // capacity, bins - 1)
    hist = np.bincount(bin_of[1:], weights=left[1:], minlength=bins)
    members = [np.flatnonzero(bin_of == i) for i in range(bins)]
    members[0] = members[0][members[0] > 0]
    pats = patterns(capacity, hist > 0, bins)
    if not pats:
        return
    mean = np.array([np.average(m, weights=left[m]) if left[m].any() else 0.0 for m in members])
    a = np.zeros((bins + 1, len(pats)))
    for j, p in enumerate(pats):
        np.add.at(a[:, j], list(p), 1)
    a[bins] = WASTE * np.abs(capacity - mean @ a[:bins]) / width
    scale = max(hist.max(), 1.0)
    x = nnls(a, np.append(hist / scale, 0.0)) * scale
    for j in sorted(np.flatnonzero(x > 0.5), key=lambda j: (a[bins, j], [-i for i in pats[j]])):
        p, todo = pats[j], int(round(x[j]))
        spare = 0.0 if strict else max(0.0, capacity - mean @ a[:bins, j]) + SLACK * width
        while todo > 0:
            lengths = _fill(left, [members[i] for i in p], capacity)
            if lengths is None:
                break
            room = capacity - sum(lengths)
            used = np.bincount(lengths, minlength=capacity + 1)
            while room > 0 and len(fit := np.flatnonzero((left - used)[: room + 1] > 0)) and fit[-1] > 0:
                lengths.append(int(fit[-1]))
                used[fit[-1]] += 1
                room -= int(fit[-1])
            if room > spare:
                break
            need = np.flatnonzero(used)
            times = int(min(todo, (left[need] // used[need]).min()))
            left -= used * times
            plan.append((tuple(sorted(lengths, reverse=True)), times))
            todo -= times


def _fill(left: np.ndarray, bins: list[np.ndarray], capacity: int) -> list[int] | None:
    """Lengths in stock, one of each bin, of greatest sum within the capacity by the choice of the last two; None if there are none."""
    stock, lengths, room = left.copy(), [], capacity
    least = [int(m[0]) for m in bins]
    for k, m in enumerate(bins[:-2]):
        ok = m[(stock[m] > 0) & (m <= room - sum(least[k + 1 :]))]
        if not len(ok):
            return None
        lengths.append(int(ok[-1]))
        stock[ok[-1]] -= 1
        room -= int(ok[-1])
    if len(bins) == 1:
        ok = bins[0][(stock[bins[0]] > 0) & (bins[0] <= room)]
        return [int(ok[-1])] if len(ok) else None
    x, y = (m[stock[m] > 0] for m in bins[-2:])
    total = x[:, None] + y[None, :]
    fits = (total <= room) & ((x[:, None] != y[None, :]) | (stock[x][:, None] > 1))
    if not fits.any():
        return None
    i, j = np.unravel_index(np.argmax(np.where(fits, total, -1)), total.shape)
    return [*lengths, int(x[i]), int(y[j])]


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: open each container with the longest item, add the longest that fits."""
    left = left.copy()
    plan = []
    while left.any():
        room, lengths = capacity, []
        used = np.zeros_like(left)
        while room > 0:
            fit = np.flatnonzero((left - used)[: room + 1] > 0)
            if not len(fit):
                break
            lengths.append(int(fit[-1]))
            used[fit[-1]] += 1
            room -= int(fit[-1])
        need = np.flatnonzero(used)
        times = int((left[need] // used[need]).min())
        left -= used * times
        plan.append((tuple(lengths), times))
    return plan


def pack(df: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, n_tokens, container, position, start): a container and place for every text, or piece of one.

    Texts of more than capacity tokens are cut into full pieces and a rest; others stay whole. position is the item's
    number in its container and start the tokens before it there; container numbers run from 0. Null, empty and
    token-less texts and null ids are left out; repeated rows are items of their own, told apart by an occurrence
    number that is part of the rank only. With no rows the result is empty.

    The driver sees only the length histogram (capacity numbers) and the plan. Items of a length are ranked within
    hash buckets of their id, as many as the items need, and matched with the plan's ranges, so one frequent length is spread over many tasks.
    """
    spark = df.sparkSession
    lengths = materialize(token_counts(df, id_col, text, tokenizer), "p6-tokens")
    pieces = lengths.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int")))).withColumn("n", F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * capacity))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("n").agg(F.count("*").alias("c")).collect():  # at most capacity rows
        counts[r.n] = r.c
    buckets = max(LEAST_BUCKETS, int(counts.sum()) // RANKED)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    by_bucket = pieces.groupBy("n", "bucket").agg(F.count("*").alias("c"))
    plan = plan_packing(counts, capacity)
    # ranges (length, from rank, to rank) -> (first container, items of the length in it, position of the first)
    ranges, seen, container = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for lens, times in plan:
        start = position = 0
        for length in dict.fromkeys(lens):
            k = lens.count(length)
            ranges.append((length, int(seen[length]), int(seen[length] + k * times), container, k, position, start))
            seen[length] += k * times
            start, position = start + k * length, position + k
        container += times
    schema = "n long, lo long, hi long, container long, k int, place int, base long"
    # plan entries cover disjoint rank ranges; their number depends on the capacity alone
    plan_df = F.broadcast(spark.createDataFrame(ranges, schema))
    earlier = Window.partitionBy("n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    before = by_bucket.select("n", "bucket", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("n", "bucket").orderBy("id", "piece")) - 1
    ranked = pieces.withColumn("r", rank).join(before, ["n", "bucket"]).withColumn("rank", F.col("r") + F.col("before"))
    placed = ranked.join(plan_df.withColumnRenamed("n", "pn"), (F.col("n") == F.col("pn")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    within = F.col("rank") - F.col("lo")
    nth = within % F.col("k")
    return placed.select(
        F.col("id").alias("doc_id"),
        F.col("piece").cast("int").alias("piece"),
        F.col("n").alias("n_tokens"),
        (F.col("container") + F.floor(within / F.col("k"))).cast("long").alias("container"),
        (F.col("place") + nth).cast("int").alias("position"),
        (F.col("base") + nth * F.col("n")).cast("long").alias("start"),
    )
