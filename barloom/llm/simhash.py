"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has 64 bits; two fingerprints are linked if at most ``max_bits`` bits differ. Exact copies share a fingerprint, so all
search runs on distinct fingerprints:

1. a 64 x 64 table of joint bit counts over all fingerprints groups correlated bits into partitions;
2. the histogram of each partition's values (at most 2^16 cells) gives, by a Walsh-Hadamard autocorrelation, the exact
   number of candidate pairs for every threshold of that partition;
3. a dynamic program picks thresholds t_i >= -1 with sum(t_i + 1) = max_bits + 1 at the least expected work. If
   two fingerprints differ in at most max_bits bits, at least one partition differs in at most t_i bits;
4. each fingerprint goes to the bucket of its value in partition i and of every value within ceil(t_i / 2) bits of it, so two
   fingerprints within t_i bits meet halfway;
5. a bucket of at most ``bucket_rows`` rows is compared in full inside one task, on all 64 bits, and gives a spanning forest of
   its links; a larger bucket is cut by four further groups of bits, again by the pigeonhole principle. As fingerprints
   are distinct, buckets shrink with every cut and no pair is lost: a bucket of which 9 bits are free holds at most 512 rows;
6. the forests meet in connected components by alternating stars, in rounds of joins stored in the shared folder.

Forest rows are at most as many as bucket rows, so dense groups never emit all pairs; forests keep every component whole.

Defined results: null text and text without words have fingerprint zero and are linked like any other; repeated rows share a
component; null ids do not count as the smallest id, a group of null ids only has a null component. Texts are hashed whole.
Other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.checks.registry import Checks
from barloom.llm.common import TEXT_ROWS, sliced, stored, table

checks = Checks()

BITS = 64
SEED = 42
BUCKET_ROWS = 512


# ---- fingerprints


def fingerprint(texts: list[str | None], shingle_words: int) -> np.ndarray:
    """One uint64 per text: a bit is set if it is set in over half of the shingle hashes."""
    hashes, sizes = [], []
    digest, k = xxhash.xxh64_intdigest, shingle_words
    for text in texts:
        words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change, ASCII white space splits
        if len(words) >= k:
            grams = map(b" ".join, zip(*[words[i:] for i in range(k)]))
        else:
            grams = [b" ".join(words)] if words else []
        before = len(hashes)
        hashes.extend([digest(g, SEED) for g in grams])
        sizes.append(len(hashes) - before)
    out = np.zeros(len(texts), dtype=np.uint64)
    sizes = np.array(sizes, dtype=np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(ones * 2 > sizes[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def with_fingerprint(docs: DataFrame, shingle_words: int, column: str) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` in ``column``."""
    at = docs.columns.index("text")
    schema = docs.select("*").schema.add(column, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            fp = fingerprint(part.column(at).to_pylist(), shingle_words)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp.view(np.int64))], names=schema.names)

    return docs.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id") -> DataFrame:
    """(id, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            fp = fingerprint(part.column(1).to_pylist(), shingle_words)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), "text")
    return source.mapInArrow(run, "id long, fp long")


# ---- partitions and thresholds


def joint_counts(fps: DataFrame) -> tuple[np.ndarray, int]:
    """How often bits i and j are both set, and the number of fingerprints: 64 x 64 numbers, whatever the data holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = _bits(_u64(b.column(0))).astype(np.float32)
            total, n = total + x.T @ x, n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS + 1), pa.int32()), pa.array([*total.astype(np.int64).tolist(), [n] * BITS], pa.list_(pa.int64()))], names=["i", "c"])

    rows = (fps.select("fp").mapInArrow(run, "i int, c array<long>").select("i", F.posexplode("c").alias("j", "c"))
            .groupBy("i", "j").agg(F.sum("c").alias("c")).collect())
    out = np.zeros((BITS + 1, BITS))
    for r in rows:
        out[r["i"], r["j"]] = r["c"]
    return out[:BITS], int(out[BITS, 0])


def bit_groups(joint: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of equal width in which bits correlate: each grows by the bit with the highest mean |correlation|."""
    p = np.diag(joint) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(joint / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for g in range(parts):
        width = len(free) // (parts - g)
        own = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.discard(own[0])
        while len(own) < width:
            best = max(sorted(free), key=lambda b: corr[b, own].mean())
            own.append(best)
            free.discard(best)
        groups.append(sorted(own))
    return groups


def candidate_pairs(fps: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """For each partition the ordered pairs of fingerprints that differ there in at most t bits, t = 0, 1, ...

    Only histograms reach the driver: at most 2^16 cells per partition of 16 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = _u64(b.column(0))
            for i, bits in enumerate(groups):
                v, n = np.unique(extract(fp, tuple(bits)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v.view(np.int64)), pa.array(n.astype(np.int64))], names=["i", "v", "n"])

    cells = fps.select("fp").mapInArrow(run, "i int, v long, n long").groupBy("i", "v").agg(F.sum("n").alias("n")).toArrow()
    part, value, count = (c.to_numpy() for c in cells.columns)
    out = []
    for i, bits in enumerate(groups):
        h = np.zeros(1 << len(bits))
        h[value[part == i]] = count[part == i]
        auto = _hadamard(_hadamard(h) ** 2) / len(h)
        by_distance = np.bincount(np.bitwise_count(np.arange(len(h), dtype=np.uint64)), weights=auto, minlength=len(bits) + 1)
        out.append(np.cumsum(by_distance))
    return out


def _hadamard(x: np.ndarray) -> np.ndarray:
    x, step = x.copy(), 1
    while step < len(x):
        y = x.reshape(-1, 2, step)
        x = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], axis=1).reshape(-1)
        step *= 2
    return x


def thresholds(pairs: list[np.ndarray], widths: list[int], n: int, max_bits: int) -> list[int]:
    """t_i >= -1 with sum(t_i + 1) = max_bits + 1 and the least sum of candidate pairs and probes."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own, width in zip(pairs, widths, strict=True):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(max_bits - used, width) + 1):
                half = (t + 1) // 2
                work = 0.0 if t < 0 else float(own[min(2 * half, width)]) + n * sum(math.comb(width, k) for k in range(half + 1))
                now = (cost + work, [*chosen, t])
                if used + t + 1 not in step or now[0] < step[used + t + 1][0]:
                    step[used + t + 1] = now
        best = step
    return best[max_bits + 1][1]


# ---- probing and verification


def _u64(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def extract(fp: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The chosen bits side by side."""
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def masks(width: int, t: int) -> np.ndarray:
    every = np.arange(1 << width, dtype=np.uint64)
    return every[np.bitwise_count(every) <= t]


@lru_cache(maxsize=None)
def cuts(path: tuple[int, ...], groups: tuple[tuple[int, ...], ...], cut: int) -> tuple[tuple[int, ...], ...]:
    """Groups of the bits that are free below ``path``."""
    here = groups
    for k in path:
        taken = here[k]
        free = [b for b in range(BITS) if b not in taken] if here is groups else [b for g in here for b in g if b not in taken]
        here = tuple(tuple(free[j::cut]) for j in range(cut))
    return here


def probes(fps: DataFrame, groups: list[list[int]], levels: list[int]) -> DataFrame:
    """(path, value, fp): the buckets of every fingerprint."""
    near = [masks(len(g), (t + 1) // 2) if t >= 0 else np.zeros(0, np.uint64) for g, t in zip(groups, levels, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                fp = _u64(b.column(0).slice(at, 2048))
                for i, bits in enumerate(groups):
                    if len(near[i]):
                        value = (extract(fp, tuple(bits))[:, None] ^ near[i][None, :]).ravel()
                        yield _rows(str(i), value, np.repeat(fp, len(near[i])))

    return fps.select("fp").mapInArrow(run, "path string, value long, fp long")


def _rows(path: str, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(fp)), pa.array(value.view(np.int64)), pa.array(fp.view(np.int64))], names=["path", "value", "fp"])


def deeper(hot: DataFrame, groups: list[list[int]], cut: int) -> DataFrame:
    """Rows of large buckets, dealt to ``cut`` finer buckets each."""
    fixed = tuple(tuple(g) for g in groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.array(b.column(0).to_pylist())
            value, fp = _u64(b.column(1)), _u64(b.column(2))
            for name in np.unique(names):
                own = names == name
                for j, bits in enumerate(cuts(tuple(map(int, str(name).split("."))), fixed, cut)):
                    yield _rows(f"{name}.{j}", (value[own] << np.uint64(len(bits))) | extract(fp[own], bits), fp[own])

    return hot.select("path", "value", "fp").mapInArrow(run, "path string, value long, fp long")


def forest(rows: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): a spanning forest of the links inside each bucket; a task gives no edge between what its earlier edges connect.

    Rows come sorted by bucket; a batch ends with a whole bucket, the open one waits for the next batch.
    """

    def solve(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        left, right, at, step = [], [], np.arange(len(fp)), 1
        while len(at := at[at + step < len(fp)]) and len(at := at[key[at] == key[at + step]]):
            hit = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= max_bits]
            left.append(hit)
            right.append(hit + step)
            step += 1
        if not left or not sum(map(len, left)):
            return None
        left, right = np.concatenate(left), np.concatenate(right)
        label = np.arange(len(fp))
        while True:
            low = np.minimum(label[left], label[right])
            new = label.copy()
            np.minimum.at(new, left, low)
            np.minimum.at(new, right, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(fp[label] != fp)
        return pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[label[moved]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}  # trees of the edges that this task has given

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for b in whole_buckets(batches):
            keep = []
            for i, (x, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    keep.append(i)
            if keep:
                yield b.take(pa.array(keep))

    def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, last, seen = np.zeros(0, np.int64), np.zeros(0, np.uint64), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            path, value = np.array(b.column(0).to_pylist()), b.column(1).to_numpy()
            fresh = np.ones(b.num_rows, bool)
            fresh[1:] = (path[1:] != path[:-1]) | (value[1:] != value[:-1])
            fresh[0] = (path[0], value[0]) != last
            last = (path[-1], value[-1])
            own = seen + np.cumsum(fresh)
            seen = int(own[-1])
            key, fp = np.concatenate([key, own]), np.concatenate([fp, _u64(b.column(2))])
            whole = int(np.searchsorted(key, seen))
            if whole and (out := solve(key[:whole], fp[:whole])) is not None:
                yield out
            key, fp = key[whole:], fp[whole:]
        if len(fp) and (out := solve(key, fp)) is not None:
            yield out

    together = rows.repartition("path", "value").sortWithinPartitions("path", "value", F.expr("fp"))
    return together.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, max_bits: int = 3, parts: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Forest edges (a, b) that connect exactly what links within ``max_bits`` connect. ``fps`` holds distinct fingerprints ``fp``."""
    joint, n = joint_counts(fps)
    groups = bit_groups(joint, n, parts)
    levels = thresholds(candidate_pairs(fps, groups), [len(g) for g in groups], n, max_bits)
    # the first buckets are cheaper to make twice, for counting and for comparing, than to store
    rows, found = probes(fps, groups, levels), None
    cut = max_bits + 1
    # with fewer than ``cut`` free bits a bucket cannot be cut further, and holds at most this many rows
    bucket_rows = max(bucket_rows, 1 << cut)
    while True:
        hot = rows.groupBy("path", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_rows).select("path", "value")
        hot = stored(hot, "hot")
        more = not hot.isEmpty()
        light = rows.join(hot, ["path", "value"], "left_anti") if more else rows
        edges = forest(light, max_bits)
        found = edges if found is None else found.unionByName(edges)
        if not more:
            return stored(found.distinct(), "links")
        rows = stored(deeper(rows.join(hot, ["path", "value"], "left_semi"), groups, cut), "probes")


# ---- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root the smallest node reachable; alternating stars."""

    def turned(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").bitwiseAND(0xFFFFFFFF))).first())

    now = stored(turned(edges).distinct(), "stars")
    was, here = None, state(now)
    while here != was:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(lows, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = large.distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = stored(turned(small.select("e.*")).distinct(), "stars")
        was, here = here, state(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 3, parts: int = 4, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, fp, component (the smallest id of its group), root (its smallest fingerprint, which no other group has)."""
    marked = stored(fingerprints(docs, shingle_words, id_col), "fingerprints", TEXT_ROWS)
    firsts = stored(marked.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    tree = components(links(firsts, max_bits, parts))
    placed = firsts.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = placed.groupBy("root").agg(F.min("first").alias("component"))
    labels = stored(placed.join(heads, "root").select("fp", "component", "root"), "labels")
    return marked.join(labels, "fp").select("id", "fp", "component", "root")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@checks.add("op9_simhash_near_duplicates")
def op9_simhash_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    found = near_duplicates(table(spark, d, "documents"), shingle_words=3, max_bits=3)
    return found.select(F.col("id").alias("doc_id"), hexed(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
