"""Ranked lexical search by dual trees.

An item's score of a document is a sum over the item's terms of weight x impact, all non-negative integers. Both sides stand in
hierarchies whose nodes hold coordinate maxima: a node of items the largest weight of every term below it, a node of documents
the largest impact. The product of two nodes is at least the score of every pair below them, so a pair of nodes whose
product is less than the weakest k-th score of its items holds no result and is left with all pairs below it. What stays is
scored exactly in integers.

1. Items come in blocks of about ``block_terms`` terms, chosen by a hash of the row; a block with its tree is what a task holds. Blocks are
   searched one after the other, each against all documents.
2. One pass over the whole texts writes each document's length and its counts of the block's terms.
3. A few documents (``seed_docs``, by hash) are searched first. Their k-th scores are lower bounds of the final ones and
   start the pruning; nothing else depends on that choice.
4. Every task orders batches of documents by their strongest term, builds the tree of the batch and descends both trees
   together. It returns at most k documents an item; Spark ranks them.

Defined results: null text and text without a term give no results and count in no statistic, for items and documents; every row of
``items`` is ranked on its own and every row of ``docs`` is a document of its own, also where ids repeat; equal scores go by ascending id,
null ids last; other columns are not read. Empty tables give an empty table.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom.checks.registry import Checks
from barloom.llm.common import sliced, stored, table

checks = Checks()

TOP = 20
FAN = 8
BATCH_DOCS = 2048
BLOCK_TERMS = 200_000
SEED_DOCS = 4096

# bytes of a term: digits, letters, everything above ASCII; A-Z fold to a-z, the rest separates
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def terms_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_FOLD).split() if raw else []


# ---- trees of coordinate maxima


@dataclass
class Level:
    """Sparse rows: entries ``ptr[i]:ptr[i + 1]`` of ``cols`` and ``vals`` belong to node i."""

    ptr: np.ndarray
    cols: np.ndarray
    vals: np.ndarray

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def above(self, fan: int = FAN) -> Level:
        """One node for every ``fan`` nodes, with the maximum of each coordinate."""
        node = np.repeat(np.arange(len(self)), np.diff(self.ptr)) // fan
        order = np.lexsort((self.cols, node))
        node, cols, vals = node[order], self.cols[order], self.vals[order]
        first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (cols[1:] != cols[:-1])]))
        count = -(-len(self) // fan)
        return Level(np.searchsorted(node[first], np.arange(count + 1)), cols[first], np.maximum.reduceat(vals, first))

    def dot(self, nodes: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact products of some nodes with a dense vector; no node is empty."""
        size = self.ptr[nodes + 1] - self.ptr[nodes]
        start = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(self.ptr[nodes] - start, size)
        return np.add.reduceat(self.vals[at] * dense[self.cols[at]], start)


def tree(leaves: Level) -> list[Level]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].above())
    return levels


def level_of(rows: list[tuple[np.ndarray, np.ndarray]]) -> Level:
    return Level(np.cumsum([0, *(len(c) for c, _ in rows)]), np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows]))


@dataclass
class Block:
    """A block of items: ids in tree order, vocabulary, tree of weights, scores that a result has to reach."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    counts: list[dict[int, int]]
    n_docs: int = 0
    n_terms: int = 0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    levels: list[Level] = field(default_factory=list)
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of(cls, rows: list[tuple[int | None, bytes | None]]) -> Block:
        vocabulary: dict[bytes, int] = {}
        ids, counts = [], []
        for item, raw in rows:
            own: dict[int, int] = {}
            for t in terms_of(raw):
                c = vocabulary.setdefault(t, len(vocabulary))
                own[c] = own.get(c, 0) + 1
            if own:
                ids.append(item)
                counts.append(own)
        return cls(ids, vocabulary, counts)

    def weigh(self, n_docs: int, n_terms: int, df: dict[int, int], top: int) -> None:
        """Weights from the statistics of all documents; items with like strongest terms become neighbours in the tree."""
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(c, 0) + 1))) for c in range(len(self.vocabulary))], np.int64)
        strongest = [max(own, key=lambda c: (self.weights[c] if df.get(c) else -1, -c)) for own in self.counts]
        order = sorted(range(len(self.ids)), key=lambda i: strongest[i])
        self.ids, self.counts = [self.ids[i] for i in order], [self.counts[i] for i in order]
        rows = [(np.array(list(own), np.int64), np.array(list(own.values()), np.int64)) for own in self.counts]
        self.levels = tree(level_of([(c, k * self.weights[c]) for c, k in rows])) if rows else []
        self.floor = np.ones(len(self.ids), np.int64)

    def impact(self, n: int, tf: np.ndarray) -> np.ndarray:
        m = 75 + 25 * n * self.n_docs // self.n_terms
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Search:
    """The best documents of every item of a block among the batches of one task."""

    def __init__(self, block: Block, top: int) -> None:
        self.block, self.top = block, top
        self.need = block.floor.copy()
        self.best: list[list[tuple[int, int, int | None]]] = [[] for _ in block.ids]
        self.dense = np.zeros(len(block.vocabulary), np.int64)
        self.scored = 0  # pairs of item and document that were scored

    def batch(self, ids: list[int | None], rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        w = self.block.weights
        strongest = [int(c[(w[c] * v).argmax()]) for c, v in rows]
        order = sorted(range(len(ids)), key=lambda i: strongest[i])
        docs = tree(level_of([rows[i] for i in order]))
        names = [ids[i] for i in order]
        needs = [self.need]
        for _ in self.block.levels[1:]:
            needs.append(np.minimum.reduceat(needs[-1], np.arange(0, len(needs[-1]), FAN)))
        # (level and node of documents, level and live nodes of items)
        todo = [(len(docs) - 1, 0, len(self.block.levels) - 1, np.zeros(1, np.int64))]
        while todo:
            dl, d, il, items = todo.pop()
            here = slice(docs[dl].ptr[d], docs[dl].ptr[d + 1])
            cols = docs[dl].cols[here]
            self.dense[cols] = docs[dl].vals[here]
            bound = self.block.levels[il].dot(items, self.dense)
            self.dense[cols] = 0
            live = bound >= needs[il][items]
            items, bound = items[live], bound[live]
            if not len(items):
                continue
            if not dl and not il:
                self.scored += len(items)
                for i, score in zip(items.tolist(), bound.tolist(), strict=True):
                    self.offer(i, score, names[d])
                continue
            if il:
                below = (items[:, None] * FAN + np.arange(FAN)).ravel()
                items, il = below[below < len(self.block.levels[il - 1])], il - 1
            if dl:
                dl -= 1
                todo.extend((dl, k, il, items) for k in range(d * FAN, min(d * FAN + FAN, len(docs[dl]))))
            else:
                todo.append((dl, d, il, items))

    def offer(self, item: int, score: int, doc: int | None) -> None:
        heap = self.best[item]
        entry = (score, -(1 << 63) if doc is None else -doc, doc)
        if len(heap) < self.top:
            heapq.heappush(heap, entry)
        elif entry[:2] > heap[0][:2]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.top:
            self.need[item] = max(self.need[item], heap[0][0])


# ---- Spark side


def vectors(docs: DataFrame, block: Block) -> DataFrame:
    """(doc_id, n, cols, tfs) of every document with a term: its length and its counts of the block's terms."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(block.vocabulary))
    schema = "doc_id long, n long, cols array<int>, tfs array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pickle.loads(sent.value).get
        for part in sliced(batches, 1024):
            ids, size, cols, tfs = [], [], [], []
            for doc, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = terms_of(raw)
                if words:
                    c, k = np.unique(np.array([p for p in map(place, words) if p is not None], np.int32), return_counts=True)
                    ids.append(doc)
                    size.append(len(words))
                    cols.append(c)
                    tfs.append(k.astype(np.int32))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(cols, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["doc_id", "n", "cols", "tfs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)


def best_of(vecs: DataFrame, block: Block, top: int) -> DataFrame:
    """(item, item_id, doc_id, score, rank); ``item`` is the item's place in the block."""
    sent = vecs.sparkSession.sparkContext.broadcast(pickle.dumps(block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block = pickle.loads(sent.value)
        search = Search(own, top)
        for part in sliced(batches, BATCH_DOCS):
            columns = [part.column(k) for k in range(4)]
            ids, n = columns[0].to_pylist(), columns[1].to_pylist()
            ptr = columns[2].offsets.to_numpy()
            cols = columns[2].values.to_numpy(zero_copy_only=False).astype(np.int64)
            tfs = columns[3].values.to_numpy(zero_copy_only=False).astype(np.int64)
            rows = [(cols[a:b], own.impact(k, tfs[a:b])) for k, a, b in zip(n, ptr[:-1], ptr[1:], strict=True)]
            if rows:
                search.batch(ids, rows)
        found = [(i, own.ids[i], doc, score) for i, heap in enumerate(search.best) for score, _, doc in heap]
        if found:
            i, item, doc, score = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item", "item_id", "doc_id", "score"])

    found = vecs.filter(F.size("cols") > 0).mapInArrow(run, "item int, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(items: DataFrame, docs: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS, seed_docs: int = SEED_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item, all if fewer score above 0."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("raw"))
    # no item has more terms than half its bytes and one
    size = own.agg(F.sum(F.octet_length("raw") / 2 + 1)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_terms))
    own = own.withColumn("_block", F.pmod(F.xxhash64("item_id", "raw"), F.lit(blocks)))
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        block = Block.of([(r["item_id"], r["raw"]) for r in own.filter(F.col("_block") == b).collect()])
        if not block.ids:
            continue
        vecs = stored(vectors(docs, block), "vectors")
        n_docs, n_terms = vecs.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        df = dict(vecs.select(F.explode("cols").alias("c")).groupBy("c").agg(F.count(F.lit(1))).collect())
        block.weigh(n_docs, n_terms, df, top)
        if n_docs > seed_docs:
            few = vecs.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(n_docs // seed_docs)) == 0)
            for r in best_of(few, block, top).filter(F.col("rank") == top).select("item", "score").collect():
                block.floor[r["item"]] = r["score"]
        found = best_of(vecs, block, top).select("item_id", "rank", "doc_id", "score")
        out = out.unionByName(stored(found, "ranked"))
    return out


PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def oracle(top: int = TOP) -> str:
    def words(text: str) -> str:
        return rf"unnest(regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{PATTERN}'))"

    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
    t AS (SELECT rid, {words('text')} AS term FROM d),
    tf AS (SELECT rid, term, count(*) AS tf FROM t GROUP BY ALL),
    n AS (SELECT rid, sum(tf)::BIGINT AS n FROM tf GROUP BY rid),
    g AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, g),
    i AS (SELECT row_number() OVER () AS iid, item_id, text FROM benchmark),
    q AS (SELECT iid, item_id, term, count(*) AS k FROM (SELECT iid, item_id, {words('text')} AS term FROM i) GROUP BY ALL),
    s AS (SELECT iid, item_id, rid, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (rid), g GROUP BY ALL),
    r AS (SELECT s.iid, s.item_id, d.doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, d.doc_id) AS rank FROM s JOIN d USING (rid) WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {top}"""


@checks.add("op13_lexical_search", oracle())
def op13_lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return search(table(spark, d, "benchmark"), table(spark, d, "documents"))
