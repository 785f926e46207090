"""Language identification by prediction with partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes with the counts of what followed. A byte costs
-log2(count / (total + kinds)) bits in the longest context that has seen it; each longer context that has not charges its escape,
-log2(kinds / (total + kinds)); below the empty context every byte costs 8 bits more. The statistics are frozen after
training, so a text's code length under a language is a sum of table entries: all contexts of all languages are numbered as
nodes, a cube over byte classes gives the node of the longest known context, and one table holds the exact cost of every (node,
byte class, language). Bytes that training never saw cost the same everywhere and share one class, so classes lose nothing.

``train`` reads a bounded sample of whole texts: per language, in order of the hash of the id, at most ``DOCS_PER_LANG`` texts, of
which the last is the one that reaches ``BYTES_PER_LANG`` bytes. The tree and with it the broadcast model is bounded by that sample. ``predict`` scores whole texts, without a shuffle.

The prediction is the language of the shortest code, ties go to the first in order of name; the score is its posterior under equal
priors, 1 / sum over l of 2^(best - bits_l).

Defined results: ``und`` with score 0 for null text and for text without a letter, and for every text if there is nothing to learn
from; null ids are not held out and not learned from; repeated rows are learned and predicted one by one; other columns are not read. An empty
table gives an empty table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.checks.registry import Checks
from barloom.llm.common import sliced, table

checks = Checks()

ORDER = 3
DOCS_PER_LANG = 400
BYTES_PER_LANG = 8_000_000
# first rows are chosen within this many parts of a language, then among those
SALTS = 64
UNKNOWN = "und"


@dataclass
class Model:
    """languages; byte classes; node of each (class, class, class); cost[node, class, language] in bits."""

    languages: list[str]
    classes: np.ndarray
    nodes: np.ndarray
    cost: np.ndarray

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of every text under every language."""
        out = np.zeros((len(texts), len(self.languages)))
        # a separator class that no context holds starts each text with the empty context
        gap = self.nodes.shape[0] - 1
        for i, text in enumerate(texts):
            for at in range(0, len(text), 1 << 16):  # whole text, in pieces that keep their three bytes of context
                c = self.classes[np.frombuffer(text[max(at - ORDER, 0):at + (1 << 16)], np.uint8)]
                head = min(at, ORDER)
                c = np.concatenate([np.full(ORDER - head, gap, c.dtype), c])
                node = self.nodes[c[:-3], c[1:-2], c[2:-1]]
                out[i] += self.cost[node, c[3:]].sum(axis=0, dtype=np.float64)
        return out


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def context_counts(sample: DataFrame, order: int = ORDER) -> list[tuple[str, bytes, int]]:
    """(lang, context and next byte, count); contexts of 0 to ``order`` bytes. Counted per task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text.encode("utf-8"))
            for lang, texts in by.items():
                for k in range(order + 1):
                    codes = [sum(x[i:len(x) - k + i].astype(np.uint64) << np.uint64(8 * (k - i)) for i in range(k + 1))
                             for x in (np.frombuffer(t, np.uint8) for t in texts) if len(x) > k]
                    if codes:
                        v, n = np.unique(np.concatenate(codes), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v)), pa.array(np.full(len(v), k, np.int32)), pa.array(v.astype(np.int64)), pa.array(n)], names=["lang", "k", "code", "n"])

    rows = sample.select("lang", "text").mapInArrow(run, "lang string, k int, code long, n long").groupBy("lang", "k", "code").agg(F.sum("n").alias("n")).toArrow()
    # Arrow batches: rows that are pickled take the driver's heap many times their size
    return [(lang, code.to_bytes(k + 1, "big"), n) for lang, k, code, n in zip(*[c.to_pylist() for c in rows.columns], strict=True)]


def build(counts: list[tuple[str, bytes, int]], order: int = ORDER) -> Model:
    languages = sorted({lang for lang, _, _ in counts})
    place = {lang: i for i, lang in enumerate(languages)}
    seen = sorted({g[-1] for _, g, _ in counts})
    other = len(seen)
    classes = np.full(256, other, np.int64)
    classes[seen] = np.arange(other)
    width = other + 1
    followers: dict[bytes, dict[int, dict[int, int]]] = {b"": {}}
    for lang, gram, n in counts:
        own = followers.setdefault(gram[:-1], {}).setdefault(place[lang], {})
        own[classes[gram[-1]]] = own.get(classes[gram[-1]], 0) + n
    contexts = sorted(followers, key=lambda c: (len(c), c))
    number = {c: i for i, c in enumerate(contexts)}
    cost = np.zeros((len(contexts), width, len(languages)), np.float32)
    for c in contexts:  # shorter contexts come first
        below = cost[number[c[1:]]] if c else np.full((width, len(languages)), 8.0, np.float32)
        here = below.copy()
        for l, what in followers[c].items():
            total, kinds = sum(what.values()), len(what)
            here[:, l] += np.log2((total + kinds) / kinds)
            here[list(what), l] = np.log2((total + kinds) / np.array(list(what.values())))
        cost[number[c]] = here
    # node of the longest known context of any three classes; the last class, a gap, is in no context
    nodes = np.zeros((width + 1,) * 3, np.int32)
    for c in contexts:
        at = [classes[b] for b in c]
        nodes[(..., *at)] = number[c]
    return Model(languages, classes, nodes, cost)


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, bytes_per_lang: int = BYTES_PER_LANG) -> Model:
    """A model of the rows of ``docs`` that have a language and are not held out."""
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.filter(F.octet_length("text") > 0).select("lang", "doc_id", "text")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("size")]
    sizes = own.select("lang", "doc_id", F.octet_length("text").cast("long").alias("size")).withColumn("_salt", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SALTS)))
    # Spark keeps the first rows per part of each task before it shuffles, and again per language
    for part in (["lang", "_salt"], ["lang"]):
        sizes = sizes.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("_r") <= docs_per_lang)
    before = Window.partitionBy("lang").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0))).filter(F.col("_before") < bytes_per_lang)
    # at most docs_per_lang ids per language: a bounded table
    sample = sizes.select(F.col("doc_id").alias("_id")).distinct()
    return build(context_counts(own.join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(pickle.dumps(model))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = pickle.loads(sent.value)
        for part in sliced(batches):
            texts = part.column(at).to_pylist()
            known = [bool(own.languages) and t is not None and any(map(str.isalpha, t)) for t in texts]
            raw = [t.encode("utf-8") if k else b"" for t, k in zip(texts, known, strict=True)]
            pred, score, rate = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            if own.languages:
                bits = own.bits(raw)
                best = bits.argmin(axis=1)
                for i in np.flatnonzero(known):
                    low = bits[i, best[i]]
                    pred[i], score[i] = own.languages[best[i]], float(1 / np.exp2(low - bits[i]).sum())
                    rate[i] = float(low / len(raw[i]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=[*kept, "lang_pred", "score", "bits_per_byte"])

    return docs.select(*kept).mapInArrow(run, schema)


@checks.add("op3_language_id")
def op3_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
