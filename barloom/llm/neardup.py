"""Groups of near-identical texts: candidates by SimHash and by prefixes, verified by the Jaccard similarity of their five-word shingles.

No candidate is a link by itself. Exact copies (equal hash of the text) share a node. Three rounds propose pairs of nodes of different groups,
each with the groups that the verified links of the rounds before made; the first one starts from groups that the caller knows, if any:

1. nodes in the order of a second fingerprint (of the distinct five-word shingles), begun at four different bits, propose their neighbours: this
   joins most of a dense group at a cost in proportion to its size;
2. nodes are entered at every shingle of their prefix. The shingles of all texts have one order, those in often used hash cells last; of a set of n
   the first n - ceil(0.8 n) + 1 are its prefix, and two sets of similarity 0.8 share a shingle of their prefixes. A bucket of one group is left out,
   one above ``BUCKET_ROWS`` is compared block by block in several tasks. A bucket proposes the nearest pairs by the parities of the sets that join
   different groups (a minimum spanning forest, by Boruvka's rounds) within ``MAX_BITS`` bits of SimHash and ``MARK_BITS`` of the second fingerprint;
3. the buckets that still hold several groups propose every pair of different groups that can have the similarity, whatever the fingerprints
   say, so that no link between groups is left out. Three bounds, none of which a link can miss, keep the pairs few before any sketch or text meets them:
   the sizes, the bits in which parities of the sets differ (at most as many as hashes), and the number of buckets in which a pair meets.

Proposals are compared by bottom-k sketches of their shingle sets, which are exact for texts of at most ``SKETCH`` shingles and otherwise give the
most that the similarity can be; what a sketch leaves open is compared on whole texts.

Defined results: null counts as the empty text, texts without words are copies of one another; texts of fewer than five words are one
shingle; letter case of A-Z and white space do not count. Repeated rows share a group. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from barloom.llm import simhash
from barloom.llm.common import TEXT_ROWS, sliced, stored

WORDS, FINGERPRINT_WORDS = 5, 2
MAX_BITS = 11
# similarity 0.8 is 9.7 bits with a deviation of 2.9
MARK_BITS = 20
JACCARD = 0.8
SKETCH = 192
# what the estimate of an incomplete sketch may fall short of the similarity before the last round
MARGIN = 0.08
BUCKET_ROWS = 1024
# hash cells by which shingles are counted; a cell is often used above so many times the mean and so many shingles more
CELLS, OFTEN, MORE = 1 << 18, 1.2, 16
PARITIES = 512


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of the five-word shingles, in order."""
    words = (text or "").encode("utf-8").lower().split()
    grams = map(b" ".join, zip(*[words[i:] for i in range(WORDS)])) if len(words) >= WORDS else [b" ".join(words)] if words else []
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(g) for g in grams), np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def sketch_similarity(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> tuple[float, float, bool]:
    """(estimated similarity, the most that it can be, whether it is exact) by two bottom-k sketches."""
    if max(size_a, size_b) <= SKETCH:
        exact = similarity(a, b)
        return exact, exact, True
    # up to here both sets are known
    end = min(x[-1] for x, n in ((a, size_a), (b, size_b)) if n > SKETCH)
    a, b = a[a <= end], b[b <= end]
    seen = len(np.intersect1d(a, b, assume_unique=True))
    both = seen + min(size_a - len(a), size_b - len(b))
    return seen / (len(a) + len(b) - seen), both / (size_a + size_b - both), False


def often_used(texts: DataFrame) -> np.ndarray:
    """For every hash cell whether the shingles of all texts are often there; only the often used cells reach the driver, as Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for part in sliced(batches):
            every = np.concatenate([shingles(t) for t in part.column(0).to_pylist()])
            n += np.bincount((every % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["cell", "n"])

    cells = stored(texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "cells", TEXT_ROWS)
    total = cells.agg(F.sum("n")).first()[0] or 0
    out = np.zeros(CELLS, bool)
    out[cells.filter(F.col("n") > OFTEN * total / CELLS + MORE).select("cell").toArrow().column(0).to_numpy()] = True
    return out


def prefix(own: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Upper halves of the prefix of a set of hashes in order; sets of similarity 0.8 share one. The empty set has a zero."""
    late = often[(own % np.uint64(CELLS)).astype(np.int64)]
    first = np.concatenate([own[~late], own[late]])[:len(own) - (4 * len(own) + 4) // 5 + 1]
    return (first >> np.uint64(32)).astype("<u4") if len(own) else np.zeros(1, "<u4")


def parities(own: np.ndarray) -> bytes:
    """For each of ``PARITIES`` hash cells whether the set has an odd number of hashes there. Two sets differ in at least as many hashes as their parities in bits."""
    n = np.bincount((own % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES)
    return np.packbits((n & 1).astype(np.uint8), bitorder="little").tobytes()


def marks(sets: list[np.ndarray]) -> np.ndarray:
    """One uint64 per set: a bit is set if over half of the hashes have it."""
    out = np.zeros(len(sets), np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            ones = np.unpackbits(s.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(ones * 2 > len(s), bitorder="little").view("<u8")[0]
    return out


def described(texts: DataFrame, often: np.ndarray) -> DataFrame:
    """(node, id, fp, mark, size, sketch, prefix, parity) for rows (node, id, text); a sketch holds the upper halves of the smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            own = part.column(2).to_pylist()
            sets = [shingles(t) for t in own]
            fp = simhash.fingerprint(own, FINGERPRINT_WORDS).view(np.int64)
            first = [prefix(s, often) for s in sets]
            # as long as the prefix, so that the bound of unrelated long texts is low enough
            low = [(s[:max(SKETCH, len(p))] >> np.uint64(32)).astype("<u4").tobytes() for s, p in zip(sets, first, strict=True)]
            first = [p.tobytes() for p in first]
            parity = [parities(s) for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp), pa.array(marks(sets).view(np.int64)), pa.array([len(s) for s in sets], pa.int64()),
                                              *[pa.array(c, pa.binary()) for c in (low, first, parity)]], names=["node", "id", "fp", "mark", "size", "sketch", "prefix", "parity"])

    return texts.select("node", "id", "text").mapInArrow(run, "node long, id long, fp long, mark long, size long, sketch binary, prefix binary, parity binary")


# ---- proposals


def entered(nodes: DataFrame) -> DataFrame:
    """(value, node) of every node (node, label, prefix) at every shingle of its prefix, buckets of one label left out; one shuffle of small rows."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 256):
            # hashes of equal upper halves keep a row each
            own = [np.frombuffer(x, "<u4") for x in b.column(2).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int32)), b.column(0).take(at), b.column(1).take(at)], names=["value", "node", "label"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the last bucket waits for the next batch

        def mixed(rows: list[np.ndarray]) -> pa.RecordBatch:
            value, node, label = rows
            starts = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1])
            keep = np.repeat(np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts), np.diff([*starts, len(value)]))
            return pa.RecordBatch.from_arrays([pa.array(value[keep]), pa.array(node[keep])], names=["value", "node"])

        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(k).to_numpy() for k in range(3)]
            cut = int(np.searchsorted(new[0], new[0][-1]))
            if cut or (held and held[-1][0][-1] != new[0][0]):
                if parts := [*held, *([[x[:cut] for x in new]] if cut else [])]:
                    yield mixed([np.concatenate(c) for c in zip(*parts, strict=True)])
                held = []
            held.append([x[cut:] for x in new])
        if held:
            yield mixed([np.concatenate(c) for c in zip(*held, strict=True)])

    rows = nodes.select("node", "label", "prefix").mapInArrow(spread, "value int, node long, label long")
    return rows.repartition("value").sortWithinPartitions("value").mapInArrow(several, "value int, node long")


def in_order(nodes: DataFrame, turn: int) -> DataFrame:
    """(a, b): neighbours in the order of the second fingerprint turned by some bits; range partitions split any run of equal marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            node, mark, size, label = (t.column(k).to_numpy() for k in range(4))
            near = (np.bitwise_count(mark[1:] ^ mark[:-1]) <= MARK_BITS) & (label[1:] != label[:-1]) & (np.minimum(size[1:], size[:-1]) >= JACCARD * np.maximum(size[1:], size[:-1]))
            at = np.flatnonzero(near)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[at], node[at + 1])), pa.array(np.maximum(node[at], node[at + 1]))], names=["a", "b"])
            held = batch.slice(batch.num_rows - 1) if batch.num_rows else held

    turned = F.shiftleft("mark", turn).bitwiseOR(F.shiftrightunsigned("mark", 64 - turn)) if turn else F.col("mark")
    rows = nodes.select("node", "mark", "size", "label", turned.alias("turned"))
    return rows.repartitionByRange("turned", "node").sortWithinPartitions("turned", "node").drop("turned").mapInArrow(run, "a long, b long")


def in_blocks(rows: DataFrame) -> DataFrame:
    """Bucket rows (path, value, node, label) without buckets of one label; rows of large buckets go to every pair of blocks that holds theirs."""
    kept = rows.groupBy("path", "value").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    blocks = stored(kept.filter("low < high").select("path", "value", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("blocks")), "mixed")
    met = rows.join(blocks, ["path", "value"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    copies = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    path = F.when(F.col("blocks") == 1, F.col("path")).otherwise(F.concat_ws(".", "path", F.least("own", "other"), F.greatest("own", "other")))
    return copies.withColumn("path", path).select("path", "value", "node", "label")


def different(key: np.ndarray, size: np.ndarray, label: np.ndarray, fp: np.ndarray | None = None, mark: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of pairs of one bucket with different labels whose sizes allow the similarity, near by their fingerprints if these are given."""
    at, step = np.arange(len(key)), 1
    while len(at := at[at + step < len(key)]) and len(at := at[key[at] == key[at + step]]):
        to = at + step
        hit = (label[at] != label[to]) & (5 * np.minimum(size[at], size[to]) >= 4 * np.maximum(size[at], size[to]))
        if fp is not None:
            hit &= (np.bitwise_count(fp[at] ^ fp[to]) <= MAX_BITS) & (np.bitwise_count(mark[at] ^ mark[to]) <= MARK_BITS)
        yield at[hit], to[hit]
        step += 1


def apart(parity: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Hashes in which the sets of pairs differ at least."""
    return np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1, dtype=np.int64)


def shared(size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """How many hashes the prefixes of two sets of similarity 0.8 share at least: all but the last ones of the 4 / 9 of both sizes that the sets share."""
    return (4 * (size_a + size_b) + 8) // 9 - (4 * np.maximum(size_a, size_b) + 4) // 5 + 1


def every_join(key: np.ndarray, node: np.ndarray, size: np.ndarray, label: np.ndarray, parity: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (a, b) of nodes, with the hashes that their prefixes must share: all pairs of a bucket with different labels whose sizes and parities (a row each) allow the similarity."""
    for i, j in different(key, size, label):
        # sets of similarity 0.8 differ in at most a ninth of both sizes
        hit = 9 * apart(parity, i, j) <= size[i] + size[j]
        i, j = i[hit], j[hit]
        if len(i):
            yield np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), shared(size[i], size[j])


def nearest_joins(key: np.ndarray, node: np.ndarray, fp: np.ndarray, mark: np.ndarray, size: np.ndarray, label: np.ndarray,
                  parity: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of nodes: in every bucket the nearest pairs that connect the labels which any close pair connects.

    Given the parities, close pairs are those that these allow too, and the nearest those of the largest similarity that they allow.
    """
    left, right, gap = [], [], []
    for i, j in different(key, size, label, fp, mark):
        if parity is None:
            far = np.bitwise_count(mark[i] ^ mark[j])
        else:
            far = apart(parity, i, j) / np.maximum(size[i] + size[j], 1)
            hit = 9 * far <= 1 + 1e-9
            i, j, far = i[hit], j[hit], far[hit]
        left.append(i)
        right.append(j)
        gap.append(far)
    if not left or not sum(map(len, left)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, d = np.concatenate(left), np.concatenate(right), np.concatenate(gap)
    # labels of one bucket are the vertices
    group = np.unique(np.stack([key, label], axis=1), axis=0, return_inverse=True)[1].ravel()
    chosen = []
    while len(i):
        ends = np.concatenate([group[i], group[j]])
        edge = np.concatenate([np.arange(len(i))] * 2)
        order = np.lexsort((edge, d[edge], ends))
        best = np.unique(edge[order][np.concatenate([[True], ends[order][1:] != ends[order][:-1]])])
        chosen.append(np.stack([node[i[best]], node[j[best]]]))
        parent = np.arange(len(group) + 1)
        a, b = group[i[best]], group[j[best]]
        while True:  # lowest vertex of what the chosen edges connect
            low, new = np.minimum(parent[a], parent[b]), parent.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            np.minimum.at(new, parent[a], low)
            np.minimum.at(new, parent[b], low)
            new = new[new]
            if (new == parent).all():
                break
            parent = new
        group = parent[group]
        keep = group[i] != group[j]
        i, j, d = i[keep], j[keep], d[keep]
    a, b = np.concatenate(chosen, axis=1)
    return np.minimum(a, b), np.maximum(a, b)


def proposed(rows: DataFrame, nodes: DataFrame, nearest: bool) -> DataFrame:
    """(a, b): the proposals of all buckets of rows (path, value, node, label), the nearest pairs only or every pair of different labels that meets in enough buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def changes(t: pa.RecordBatch | pa.Table) -> np.ndarray:
            n = t.num_rows
            path, value = t.column(0), t.column(1)
            differ = pc.or_(pc.not_equal(path.slice(1), path.slice(0, n - 1)), pc.not_equal(value.slice(1), value.slice(0, n - 1)))
            return np.flatnonzero(differ.to_numpy(zero_copy_only=False) if isinstance(differ, pa.Array) else differ.to_numpy()) + 1

        def solve() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            key = np.zeros(t.num_rows, np.int64)
            key[changes(t)] = 1
            node, label, size = (t.column(k).to_numpy() for k in range(2, 5))
            parity = np.frombuffer(b"".join(t.column(5).to_pylist()), "<u8").reshape(-1, PARITIES // 64)
            if nearest:
                fp, mark = (t.column(k).to_numpy().view(np.uint64) for k in range(6, 8))
                a, b = nearest_joins(np.cumsum(key), node, fp, mark, size, label, parity)
                found = [(a, b, np.ones(len(a), np.int64))]
            else:
                found = every_join(np.cumsum(key), node, size, label, parity)
            for columns in found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "least"])

        for part in batches:
            if not part.num_rows:
                continue
            # the last bucket of a batch waits for the next one
            starts = changes(part)
            first, end = [(part.column(0)[i].as_py(), part.column(1)[i].as_py()) for i in (0, part.num_rows - 1)]
            if len(starts):
                held.append(part.slice(0, starts[-1]))
                yield from solve()
                held = [part.slice(starts[-1])]
            elif held and first != last:
                yield from solve()
                held = [part]
            else:
                held.append(part)
            last = end
        if held:
            yield from solve()

    known = ["size", "parity", "fp", "mark"] if nearest else ["size", "parity"]
    whole = rows.join(nodes.select("node", *known), "node").select("path", "value", "node", "label", *known)
    met = whole.repartition("path", "value").sortWithinPartitions("path", "value", "node").mapInArrow(run, "a long, b long, least long")
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least")).filter("n >= least").select("a", "b")


# ---- verification


def passing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches allow the similarity, with ``sure`` where they prove it and ``likely`` where they come near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1024):
            keep, sure, likely = [], [], []
            sets = [[np.unique(np.frombuffer(x, "<u4")) for x in b.column(k).to_pylist()] for k in (2, 3)]
            for i, (x, y, m, n) in enumerate(zip(*sets, b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                value, most, exact = sketch_similarity(x, y, m, n)
                if most >= JACCARD:
                    keep.append(i)
                    sure.append(exact)
                    likely.append(value >= (JACCARD if exact else JACCARD - MARGIN))
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(sure), pa.array(likely)], names=["a", "b", "sure", "likely"])

    side = lambda n: nodes.select(F.col("node").alias(n), F.col("sketch").alias(f"_{n}"), F.col("size").alias(f"_n{n}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_a", "_b", "_na", "_nb").mapInArrow(run, "a long, b long, sure boolean, likely boolean")


def holding(pairs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose whole texts are similar; ``texts`` (id, node, text) may repeat a node, its smallest id stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 64):
            keep = [i for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)) if similarity(shingles(x), shingles(y)) >= JACCARD]
            if keep:
                yield b.select(["a", "b"]).take(pa.array(keep))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", F.col("first").alias("id")), "node")
    own = stored(texts.join(stored(ends, "ends"), ["node", "id"]).dropDuplicates(["node", "id"]), "texts")
    side = lambda n: own.select(F.col("node").alias(n), F.col("text").alias(f"_{n}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")


def relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) after edges (a, b) between nodes joined their labels."""
    of = lambda n: labels.select(F.col("node").alias(n), F.col("label").alias(f"_{n}"))
    tree = simhash.components(edges.select("a", "b").join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    return labels.join(tree.select(F.col("node").alias("label"), "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label"))


def groups_of(docs: DataFrame, id_col: str, known: DataFrame | None = None) -> DataFrame:
    """(node, first, root): per distinct text its hash, its smallest id, and the hash that names its group.

    ``known`` (node, label) holds groups to start from, each named by one of its nodes; they stay together and are joined where links join them.
    """
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    own = described(every, often_used(every)).groupBy("node").agg(F.min("id").alias("first"), *[F.first(c).alias(c) for c in ("fp", "mark", "size", "sketch", "prefix", "parity")])
    nodes = stored(own, "nodes", TEXT_ROWS)
    if nodes.isEmpty():
        return nodes.select("node", "first", F.col("node").alias("root"))

    def joined(labels: DataFrame, pairs: DataFrame, rough: bool) -> DataFrame:
        """Labels after the links among proposed pairs; ``rough`` leaves what is not likely to the last round."""
        new = stored(passing(stored(pairs, "proposals"), nodes).filter(F.col("likely") | F.lit(not rough)), "passing", TEXT_ROWS)
        links = new.filter("sure").select("a", "b").unionByName(holding(new.filter(~F.col("sure")), every, nodes))
        return stored(relabelled(labels, links), "labels")

    labels = nodes.select("node", F.col("node").alias("label"))
    if known is not None:
        labels = stored(nodes.select("node").join(known, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    held = nodes.select("node", "fp", "mark", "size").join(labels, "node")
    labels = joined(labels, functools.reduce(DataFrame.unionByName, [in_order(held, turn) for turn in range(0, simhash.BITS, 16)]).distinct(), True)
    # labels only merge, so buckets of one label now stay out
    index = stored(entered(nodes.join(labels, "node")), "index")
    for nearest in (True, False):
        rows = index.join(labels, "node").select(F.lit("p").alias("path"), F.col("value").cast("long").alias("value"), "node", "label")
        labels = joined(labels, proposed(in_blocks(rows), nodes, nearest), nearest)
    return nodes.select("node", "first").join(labels.withColumnRenamed("label", "root"), "node")
