"""Problem 1: near-duplicate records with small edits, by sequential Bayesian verification of banded candidates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import shared
from textloom.llm._spark import Scratch, materialize
from textloom.llm._text import code_points, keep_only, mix64, shingle_sets, slices, tables, window_hashes

#: Characters of a stretch; least share of common stretches of a pair.
STRETCH, SIMILARITY = 5, 0.70
#: Bands of ROWS min-hashes: a pair at SIMILARITY is missed by all bands with probability 0.0013, one at 0.75 with 0.00005.
BANDS, ROWS = 36, 5
#: Hashes compared at a time, and the posterior chance of SIMILARITY under which a candidate is dropped after a batch.
BATCH, MISS = 36, 2e-4
#: Rows of one band key that are paired in one task's block; larger keys are split into blocks.
BLOCK = 128
#: Pairs that one task verifies at a time, on average.
CELL_PAIRS = 128

HASHES = BANDS * ROWS
#: Front matter of a stored file: the fenced block at its start.
FRONT_MATTER = r"\A\s*---[ \t]*\r?\n[\s\S]*?\r?\n---[ \t]*(?:\r?\n|\z)"


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 31, HASHES, dtype=np.uint32) * 2 + 1, r.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES min-hashes (uint32) of a non-empty array of 64-bit stretch hashes."""
    a, b = _permutations()
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for s in range(0, len(h), 2048):
        x = np.multiply.outer(a, h[s : s + 2048])
        x += b[:, None]
        np.minimum(low, x.min(axis=1), out=low)
    return low


def features(df: DataFrame, id_col: str, text: str, front_matter: bool = False, least: int = 1, carry: tuple[str, ...] = (), keep_all: bool = False) -> DataFrame:
    """(id, body, size, sig, bands) of every row whose text has at least least letters and digits.

    body: hash of the folded letters and digits; size: their number; sig: a byte of every min-hash; bands: keys. With
    keep_all the other rows come too, with nulls, and each row has its folded letters and digits as plain (null where
    sig is) and the columns named by carry.
    """
    t = F.col(text).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), (F.regexp_replace(t, FRONT_MATTER, "") if front_matter else t).alias("text"), *carry).where("id IS NOT NULL")
    rows = rows if keep_all else rows.where(F.length("text") > 0)
    schema = "id long, body binary, size long, sig binary, bands array<long>"
    if keep_all:
        schema += ", plain string" + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for whole in batches:
            for b in slices(whole, "text"):
                cp, off = keep_only(*code_points(b.column("text")), tables()[2])
                h = window_hashes(cp, STRETCH)
                seen: dict[bytes, tuple[bytes, np.ndarray]] = {}
                out: list[tuple] = []
                for i in range(b.num_rows):
                    s, e = int(off[i]), int(off[i + 1])
                    if e - s < max(least, 1):
                        out.append((None, None, None, None, None))
                        continue
                    key = _digest(cp[s:e])
                    if key not in seen:
                        x = h[s : e - STRETCH + 1] if e - s >= STRETCH else shingle_sets(cp[s:e], np.array([0, e - s]), STRETCH)[0]
                        m = minhash(x)
                        acc = band.copy()
                        for r in range(ROWS):
                            acc = mix64(acc + m[r::ROWS].astype(np.uint64))
                        seen[key] = (mix64(m.astype(np.uint64)).astype(np.uint8).tobytes(), acc.view(np.int64))
                    plain = cp[s:e].astype("<u4").tobytes().decode("utf-32-le", "replace") if keep_all else None
                    out.append((key, e - s, *seen[key], plain))
                keep = [i for i, x in enumerate(out) if keep_all or x[0] is not None]
                body, size, sig, bands, plain = zip(*[out[i] for i in keep], strict=True) if keep else ((), (), (), (), ())
                columns = [b.column("id").take(pa.array(keep, pa.int64())), pa.array(body, pa.binary()), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
                names = ["id", "body", "size", "sig", "bands"]
                if keep_all:
                    columns += [pa.array(plain, pa.string()), *[b.column(c) for c in carry]]
                    names += ["plain", *carry]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def _digest(cp: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(cp.tobytes())


def band_pairs(keys: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct (a, b), a < b, of ids that share a key; keys: (key long, id long).

    Keys of one row go first, by a count with map-side combine. A key of more than block rows is split into blocks, and
    its pairs of blocks go to as many tasks, so no task holds a large group and no pair is left out.
    """
    counts = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    parts = F.ceil(F.col("c") / block).cast("int")
    live = keys.join(counts, "key").withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = live.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "id")
    left = cell.where("mine = lo").select("key", "lo", "hi", F.col("id").alias("x"))
    right = cell.where("mine = hi").select("key", "lo", "hi", F.col("id").alias("y"))
    pairs = left.join(right, ["key", "lo", "hi"]).where("(lo < hi AND x <> y) OR (lo = hi AND x < y)")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


@lru_cache(maxsize=8)
def least_matches(similarity: float = SIMILARITY, miss: float = MISS, batch: int = BATCH, hashes: int = HASHES) -> tuple[int, ...]:
    """After each batch, the fewest matching hashes with which P(Jaccard >= similarity) under a flat prior is at least miss.

    A byte of two different min-hashes matches with chance 1/256, which is allowed for.
    """
    x = (np.arange(20_000) + 0.5) / 20_000
    p = np.log(x + (1 - x) / 256)
    q = np.log1p(-(x + (1 - x) / 256))
    out = []
    for n in range(batch, hashes + 1, batch):
        low = n
        for m in range(n, -1, -1):
            w = m * p + (n - m) * q
            w = np.exp(w - w.max())
            if w[x >= similarity].sum() / w.sum() < miss:
                break
            low = m
        out.append(low)
    return tuple(out)


def bayes_prune(pairs: DataFrame, similarity: float = SIMILARITY, miss: float = MISS) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b, ...) that survive all batches, as (a, b, matches) and the other columns.

    Batches of hashes are compared in turn; a pair is dropped as soon as the posterior probability that its similarity
    reaches the threshold falls under miss.
    """
    rest = [f for f in pairs.schema.fields if f.name not in ("a", "b", "sig_a", "sig_b")]
    schema = ", ".join(["a long", "b long", "matches int", *[f"{f.name} {f.dataType.simpleString()}" for f in rest]])
    least = least_matches(similarity, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (_matrix(b.column(c)) for c in ("sig_a", "sig_b"))
            alive, matches = np.arange(len(x)), np.zeros(len(x), dtype=np.int32)
            for k, low in enumerate(least):
                s = slice(k * BATCH, (k + 1) * BATCH)
                matches[alive] += (x[alive, s] == y[alive, s]).sum(axis=1, dtype=np.int32)
                alive = alive[matches[alive] >= low]
                if not len(alive):
                    break
            take = pa.array(alive)
            yield pa.RecordBatch.from_arrays([b.column("a").take(take), b.column("b").take(take), pa.array(matches[alive]), *[b.column(f.name).take(take) for f in rest]], names=["a", "b", "matches", *[f.name for f in rest]])

    return pairs.mapInArrow(run, schema)


def _matrix(col: pa.Array) -> np.ndarray:
    """A column of equally long binaries as rows of bytes."""
    col = pa.concat_arrays([col])
    start = np.frombuffer(col.buffers()[1], np.int32, count=len(col) + col.offset + 1)[col.offset :]
    return np.frombuffer(col.buffers()[2], np.uint8)[start[0] : start[-1]].reshape(len(col), -1)


def exact_similarity(pairs: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, row_bytes: int = 48) -> DataFrame:
    """(a, b, similarity) of the pairs that reach the similarity, from both texts; docs: (id, text). pairs: materialised.

    Ids fall into a grid of hash buckets, and a pair into the cell of its two buckets, of about CELL_PAIRS pairs each. A
    text goes once to each cell that needs it, so a text in many pairs goes to as many cells as the grid has rows, not to
    each of its pairs. Which texts go where is broadcast if its measured size allows; else texts meet it by their id
    (large sides get Spark's own runtime Bloom filter).
    """
    n = pairs.count()
    grid = max(1, int(np.ceil(np.sqrt(n / CELL_PAIRS))))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(grid))
    cells = pairs.select("a", "b", (bucket("a") * grid + bucket("b")).alias("cell"))
    needs = cells.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct()
    needs = F.broadcast(needs) if 2 * n * row_bytes <= shared.BROADCAST_BYTES else needs
    none = F.lit(None)
    rows = docs.join(needs, "id").select("cell", F.col("id").alias("a"), none.cast("long").alias("b"), "text")
    rows = rows.unionByName(cells.select("cell", "a", "b", none.cast("string").alias("text")))
    rows = rows.repartition("cell").sortWithinPartitions("cell", F.col("b").isNull())

    def compared(want: list[tuple[int, int]], sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        a, b, sim = [], [], []
        for i, j in want:
            x, y = sets.get(i), sets.get(j)
            if x is None or y is None or min(len(x), len(y)) < similarity * max(len(x), len(y)) or not len(x):
                continue
            common = len(x) + len(y) - len(np.union1d(x, y))
            share = common / (len(x) + len(y) - common)
            if share >= similarity:
                a.append(i)
                b.append(j)
                sim.append(share)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sim, pa.float64())], names=["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, want, sets = None, [], {}
        for whole in batches:
            for s in slices(whole, "text"):
                cell, ends = s.column("cell").to_pylist(), s.column("b").to_pylist()
                texts = shingle_sets(*keep_only(*code_points(s.column("text")), tables()[2]), STRETCH)
                for k, i in enumerate(s.column("a").to_pylist()):
                    if cell[k] != now:
                        yield compared(want, sets)
                        now, want, sets = cell[k], [], {}
                    if ends[k] is None:
                        sets[i] = texts[k]
                    else:
                        want.append((i, ends[k]))
        yield compared(want, sets)

    return rows.mapInArrow(run, "a long, b long, similarity double")


def near_pairs(feats: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity), a < b, of all near-duplicate pairs among features with distinct bodies.

    feats: (id, sig, bands), materialised; docs: (id, text), the same texts.
    """
    keys = feats.select(F.explode("bands").alias("key"), "id")
    sigs = feats.select("id", "sig")
    pairs = band_pairs(keys).join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return exact_similarity(materialize(bayes_prune(pairs, similarity).select("a", "b"), "p1-survivors"), docs, similarity)


def _links(df: DataFrame, id_col: str, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(members (id, rep), links between representatives (a, b, similarity)): exact copies share a representative."""
    with Scratch(df.sparkSession) as tables_:
        feats = materialize(features(df, id_col, text, front_matter=True), "p1-features")
        reps = feats.groupBy("body").agg(F.min("id").alias("rep"))
        members = tables_.keep(materialize(feats.select("id", "body").distinct().join(reps, "body").select("id", "rep"), "p1-members"))
        own = members.where("id = rep").select("id")
        one = feats.select("id", "sig", "bands").join(own, "id").dropDuplicates(["id"])
        docs = df.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.col(text).cast("string"), FRONT_MATTER, "").alias("text"))
        links = tables_.keep(materialize(near_pairs(materialize(one, "p1-representatives"), docs, similarity), "p1-links"))
    return members, links


def near_duplicate_pairs(df: DataFrame, id_col: str = "doc_ord", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), a < b: all pairs of ids whose bodies share at least the given part of their 5-character stretches.

    The body is the text without front matter, folded and reduced to letters and digits; a body shorter than a stretch
    counts as one stretch; rows with a null id, null text or blank body are never in a pair; exact copies always are; a
    repeated row makes no pair with itself. Similarity is verified exactly before a class of exact copies is expanded.
    The number of pairs is the result's own; near_duplicate_groups gives one row a document.
    """
    members, links = _links(df, id_col, text, similarity)
    x, y = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.select("a", "b").join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return across.unionByName(band_pairs(members.select(F.col("rep").alias("key"), "id")))


def components(nodes: DataFrame, links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, group): the smallest id each node is connected with; links (a, b) among nodes.

    Minimum labels pass over links and are shortened by looking up the label of the label, so rounds grow with the
    logarithm of a chain's length. Each round is a table in the shared folder.
    """
    with Scratch(links.sparkSession) as tables_:
        both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
        linked = both.select(F.col("a").alias("id")).distinct()
        label = materialize(linked.select("id", F.col("id").alias("group")), "cc")
        for _ in range(most_rounds):
            offered = both.join(label.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("group").alias("offer"))
            lower = label.join(offered, "id", "left").select("id", F.col("group").alias("was"), F.least("group", "offer").alias("mid"))
            jump = label.select(F.col("id").alias("mid"), F.col("group").alias("far"))
            new = materialize(lower.join(jump, "mid").select("id", F.col("far").alias("group"), (F.col("far") < F.col("was")).alias("moved")), "cc")
            label = new.select("id", "group")
            if not new.where("moved").limit(1).count():
                tables_.keep(new)
                break
        else:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return nodes.select("id").join(label, "id", "left").select("id", F.coalesce("group", "id").alias("group"))


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_ord", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, rep, group, links): one row per id with a body: its exact-copy representative, its class of connected
    near-duplicates (the smallest representative) and the number of other texts its text is linked with.

    Null ids, null and blank bodies give no row; a repeated row gives one row.
    """
    members, links = _links(df, id_col, text, similarity)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    label = components(members.select(F.col("rep").alias("id")).distinct(), links).withColumnRenamed("id", "rep")
    return members.join(label, "rep").join(degree, "rep", "left").select("id", "rep", "group", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
