"""Toxicity of texts behind a noisy channel.

Disguised spellings are read as the output of a channel: a letter may be written as a look-alike (``1d10t``), hidden behind a star
(``id*ot``), repeated (``idiooot``) or set apart (``i d i o t``, ``i.d.i.o.t``). A token with such signs spans a lattice of the letters that each
character may stand for, and Viterbi's algorithm finds the path with the fewest bits under channel and character language
model. The model has orders 1 to 4 over 26 letters (accents folded) and the word boundary, interpolated by Witten and Bell; its counts
are those of all texts, and at most 27^4 of them reach the driver. Tokens of plain letters have a single path and stay as they are.

The restored text is scored word by word: a word's odds follow from the labelled rows that hold its beginnings of 3 to 8 letters and the word
itself, each level smoothed by the one before, so that a rare word is judged by what it starts with and a known one by itself.
The worst word decides; a logistic curve, fitted by Spark on the worst words of the labelled rows (each row's own label taken out of the counts), turns
its odds into a score. Only words below beginnings that speak for toxicity by their likelihood ratio are looked at. The sample holds about
``ROWS_PER_CLASS`` labelled rows of each class, chosen by hash of the id, all if there are fewer. Whole texts are scored, without a shuffle.

Defined results: null and empty texts get the score of a text without any such word; without labels of both classes every text gets
the smoothed share of toxic labels (0.5 without any); null ids are neither held out nor learned from, null labels teach nothing, an id with
several labels is toxic if one of them says so; repeated rows are scored one by one; other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.checks.registry import Checks
from barloom.llm.common import sliced, stored, table

checks = Checks()

ROWS_PER_CLASS = 10_000
FEATURES = 8192
# of a beginning or word, in nats; weaker evidence is chance among so many candidates
MIN_GAIN = 10.0
# rows of the kind of the level before that every level is thought to have been seen in
SMOOTH = 2.0
SHORTEST, LONGEST = 3, 8
ORDER, WIDTH = 4, 27
HELD = 400_000

# what a character may stand for
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
         "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "¢": "c", "¥": "y", "§": "s"}
HIDES = "*#%&?"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
# bits of the channel
LOOK, HIDE, REPEAT, DROP, BREAK = 2.0, math.log2(26), 1.0, 1.0, 6.0


def _fold(ch: str) -> int:
    base = unicodedata.normalize("NFD", ch)[0]
    return ord(base) - 96 if "a" <= base <= "z" else 0


# code of every character below U+0250: 1 to 26, 0 for all that ends a word
CODES = np.array([_fold(chr(c).lower()) for c in range(0x250)], np.int64)


# ---- language model


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all runs of four codes in all texts; a word boundary counts as three zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDTH**ORDER, np.int64)
        for part in sliced(batches):
            # line breaks end words, so the texts of a slice count as one
            points = np.frombuffer("".join(f"{t or ''}\n" for t in part.column(0).to_pylist()).encode("utf-32-le", "replace"), np.uint32)
            c = np.where(points < 0x250, CODES[np.minimum(points, 0x24F)], 0)
            c = c[(c > 0) | np.concatenate([[False], c[:-1] > 0])]
            c = np.concatenate([[0, 0, 0], np.repeat(c, np.where(c == 0, 3, 1))])
            total += np.bincount(((c[:-3] * WIDTH + c[1:-2]) * WIDTH + c[2:-1]) * WIDTH + c[3:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["g", "n"])

    out = np.zeros(WIDTH**ORDER)
    for r in docs.select("text").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect():
        out[r["g"]] = r["n"]
    return out


def bits_of(counts: np.ndarray) -> np.ndarray:
    """Bits of every code after every context of three codes."""
    full = counts.reshape((WIDTH,) * ORDER)
    p = np.full(WIDTH, 1 / WIDTH)
    for k in range(ORDER):
        c = full.sum(axis=tuple(range(ORDER - 1 - k)))
        total, kinds = c.sum(axis=-1, keepdims=True), (c > 0).sum(axis=-1, keepdims=True)
        p = np.where(total > 0, (c + kinds * p) / np.maximum(total + kinds, 1), np.broadcast_to(p, c.shape))
    return -np.log2(np.maximum(p, 1e-12)).ravel()


# ---- channel

PLAIN = re.compile(r"[^\w\s]*[^\W\d_]*(?:['’][^\W\d_]+|-[^\W\d_]{2,})*[^\w\s$@|]*")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
LETTER = re.compile(r"[^\W\d_]")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S){2,}[.,;:!?]*(?!\S)")
WORD = re.compile(r"[^\W\d_]+")


def is_noisy(token: str) -> bool:
    """Whether the lattice of a token has more than one path worth reading: look-alikes, stars, marks inside, a letter three times."""
    core = token.strip(".,;:!?")
    if not core.isalpha() and (not LETTER.search(core) or not PLAIN.fullmatch(token)):
        return bool(LETTER.search(core))
    return bool(TRIPLE.search(core.lower()))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For every character its readings: (letter, bits), ("", bits) for nothing, (" ", bits) for a word boundary."""
    low, out = token.lower(), []
    inner = [i for i, ch in enumerate(low) if LETTER.match(ch)]
    first, last = (inner[0], inner[-1]) if inner else (0, -1)
    for i, ch in enumerate(low):
        if LETTER.match(ch):
            own = [(ch, 0.0)]
            if i and low[i - 1] == ch:
                own.append(("", REPEAT))
        elif ch.isspace():
            own = [("", DROP), (" ", BREAK)]
        else:
            own = [(x, LOOK) for x in LOOKS.get(ch, "")]
            if ch in HIDES and first < i < last and LETTER.match(low[i - 1]) and LETTER.match(low[i + 1]):
                own += [(x, HIDE) for x in LETTERS]
            own.append((" ", BREAK if ch.isalnum() else DROP + BREAK))
            if not ch.isalnum():
                own.append(("", DROP + LOOK if ch in LOOKS else DROP))
        out.append(own)
    return out


def restored(token: str, bits: list[float]) -> str:
    """The likeliest letters behind a token."""
    # context -> (bits, path); a path is (path before, letter)
    live: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for readings in lattice(token):
        step: dict[int, tuple[float, tuple | None]] = {}
        for context, (paid, path) in live.items():
            for letter, price in readings:
                if letter == "":
                    at, cost, way = context, paid + price, path
                elif letter == " ":
                    at, cost, way = 0, paid + price + (bits[context * WIDTH] if context else 0.0), (path, " ")
                else:
                    code = _fold(letter)
                    cost = paid + price + bits[context * WIDTH + code]
                    at, way = (context % (WIDTH * WIDTH) * WIDTH + code if code else 0), (path, letter)
                if at not in step or cost < step[at][0]:
                    step[at] = (cost, way)
        live = step
    _, path = min(((paid + (bits[c * WIDTH] if c else 0.0), c, way) for c, (paid, way) in live.items()), key=lambda x: x[:2])[::2]
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


@dataclass
class Reader:
    """Tokens of a text and the words that the channel restores."""

    bits: list[float]
    heads: frozenset[str] | None = None  # first letters of the words to look at, all if None

    def text(self, text: str | None) -> str:
        """The restored text, white space as single spaces."""
        out, at = [], 0
        for m in SPACED.finditer(text or ""):
            out += [*(text[at:m.start()]).split(), m]
            at = m.end()
        out += (text or "")[at:].split()
        return " ".join(restored(x if isinstance(x, str) else x.group(), self.bits) if not isinstance(x, str) or is_noisy(x) else x for x in out)

    def of_token(self, token: str, spaced: bool = False) -> tuple[str, ...]:
        """The restored words of a token to look at."""
        if not spaced:
            core = token.strip(".,;:!?").lower()
            if core.isalpha() and not TRIPLE.search(core):
                return (core,) if len(core) >= SHORTEST and (self.heads is None or core[:SHORTEST] in self.heads) else ()
        words = WORD.findall((restored(token, self.bits) if spaced or is_noisy(token) else token).lower())
        return tuple({w for w in words if len(w) >= SHORTEST and (self.heads is None or w[:SHORTEST] in self.heads)})

    def tokens(self, text: str) -> tuple[set[str], set[str]]:
        """Distinct tokens and spaced-out words."""
        at, parts, spaced = 0, [], set()
        for m in SPACED.finditer(text):
            parts.append(text[at:m.start()])
            spaced.add(m.group())
            at = m.end()
        return set((" ".join([*parts, text[at:]]) if parts else text).split()), spaced

    def words(self, text: str | None) -> set[str]:
        """The restored words to look at."""
        plain, spaced = self.tokens(text) if text else ((), ())
        out = {w for token in plain for w in self.of_token(token)}
        return out.union(*(self.of_token(token, spaced=True) for token in spaced))


def levels(word: str) -> list[str]:
    return ["^" + word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)] + ["=" + word]


# ---- classifier


@dataclass
class Model:
    """Bits of the language model; rows (toxic, all) of the chosen levels; the rate of the sample; log odds of a text without a word; the curve."""

    bits: np.ndarray
    counts: dict[str, tuple[int, int]]
    rate: float
    empty: float
    slope: float = 1.0
    offset: float = 0.0

    def reader(self) -> Reader:
        return Reader(self.bits.tolist(), frozenset(c[1:1 + SHORTEST] for c in self.counts))

    def odds(self, word: str, toxic: int = 0, own: int = 0) -> float:
        """Log odds of a word, minus infinity if no level is known; a row of the sample takes itself (``own`` rows) out."""
        rate, known = self.rate, False
        for level in levels(word):
            if level in self.counts:
                pos, n = self.counts[level]
                rate, known = (pos - toxic + SMOOTH * rate) / (n - own + SMOOTH), True
        rate = min(max(rate, 1e-9), 1 - 1e-9)
        return math.log(rate / (1 - rate)) if known else -math.inf

    def worst(self, words: Iterable[str], toxic: int = 0, own: int = 0) -> float:
        return max((self.odds(w, toxic, own) for w in words), default=-math.inf)

    def score(self, words: Iterable[str]) -> float:
        return self.curve(self.worst(words))

    def curve(self, odds: float) -> float:
        x = self.offset + self.slope * odds if odds > -math.inf else self.empty
        return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


class Scorer:
    """Worst words of texts; the odds of a token are kept while there is room."""

    def __init__(self, model: Model) -> None:
        self.model, self.reader = model, model.reader()
        self.held: dict[str, float] = {}

    def worst(self, text: str | None) -> float:
        if not text:
            return -math.inf
        plain, spaced = self.reader.tokens(text)
        odds = set(map(self.held.get, plain))
        if None in odds:
            odds.discard(None)
            if len(self.held) >= HELD:
                self.held.clear()
            for token in plain:
                if token not in self.held:
                    self.held[token] = own = self.model.worst(self.reader.of_token(token))
                    odds.add(own)
        odds.update(self.model.worst(self.reader.of_token(token, spaced=True)) for token in spaced)
        return max(odds, default=-math.inf)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _level_rows(sample: DataFrame, bits: np.ndarray) -> DataFrame:
    sent = sample.sparkSession.sparkContext.broadcast(pickle.dumps(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(pickle.loads(sent.value).tolist())
        for part in sliced(batches, 64):
            found = [sorted({x for w in reader.words(t) for x in levels(w)}) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.string()))], names=["toxic", "cells"])

    return sample.select("toxic", "text").mapInArrow(run, "toxic int, cells array<string>")


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, features: int = FEATURES) -> Model:
    """A model of all texts and of the labelled rows that are not held out."""
    bits = bits_of(gram_counts(docs))
    own = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = dict(own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(sizes.values())
    rate = (sizes.get(1, 0) + 0.5) / (total + 1)
    plain = Model(bits, {}, rate, math.log(rate / (1 - rate)))
    if len(sizes) < 2:
        return plain
    part = F.lit(1.0)
    for kind, n in sizes.items():
        part = F.when(F.col("toxic") == kind, F.lit(min(1.0, rows_per_class / n))).otherwise(part)
    chosen = own.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < part * (1 << 30))
    # about rows_per_class ids a class
    sample = stored(docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(chosen), "_id").select("toxic", "text"), "labelled")
    pos, rows = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    if not rows or pos in (0, rows):
        return plain
    cells = _level_rows(sample, bits).select("toxic", F.explode("cells").alias("cell")).groupBy("cell").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n"))
    cells = stored(cells.filter("n > 1"), "levels")
    # likelihood ratio of a level's classes against those of the sample
    share, q = pos / rows, F.col("pos") / F.col("n")
    gain = F.col("pos") * F.log(q / share) + F.when(F.col("pos") < F.col("n"), (F.col("n") - F.col("pos")) * F.log((1 - q) / (1 - share))).otherwise(0.0)
    best = cells.filter(q > share).withColumn("gain", gain).filter(F.col("gain") >= MIN_GAIN).orderBy(F.desc("gain"), "cell").limit(features)
    # what they begin is known as far as the sample holds it, most frequent first
    heads = best.select(F.substring("cell", 2, SHORTEST).alias("head")).distinct()
    below = cells.withColumn("head", F.substring("cell", 2, SHORTEST)).join(F.broadcast(heads), "head").orderBy(F.desc("n"), "cell").limit(8 * features)
    counts = {r["cell"]: (r["pos"], r["n"]) for r in below.collect()}
    return calibrated(sample, Model(bits, counts, share, math.log(share / (1 - share))), rate)


def calibrated(sample: DataFrame, model: Model, rate: float) -> Model:
    """``model`` with the log odds of rows without a word and the curve of the score, both from the sample's rows."""
    sent = sample.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = pickle.loads(sent.value)
        reader = own.reader()
        for part in sliced(batches, 64):
            toxic = part.column(0).to_pylist()
            odds = [own.worst(reader.words(x), t, 1) for x, t in zip(part.column(1).to_pylist(), toxic, strict=True)]
            odds = [o if o > -math.inf else None for o in odds]
            yield pa.RecordBatch.from_arrays([pa.array(map(float, toxic), pa.float64()), pa.array(odds, pa.float64())], names=["label", "odds"])

    found = stored(sample.select("toxic", "text").mapInArrow(run, "label double, odds double"), "odds")
    # rows without a word have a rate of their own and no say in the curve
    bare = F.col("odds").isNull()
    pos, n, all_pos, rows = found.agg(F.sum(F.when(bare, F.col("label"))), F.count(F.when(bare, 1)), F.sum("label"), F.count(F.lit(1))).first()
    # both classes weigh as in the labels, whatever the sample took of each
    shift = math.log(rate / (1 - rate)) - math.log((all_pos + 0.5) / (rows - all_pos + 0.5))
    model.empty = math.log(((pos or 0) + SMOOTH * model.rate) / (n - (pos or 0) + SMOOTH * (1 - model.rate))) + shift
    seen = found.filter(~bare)
    if seen.select("label").distinct().count() == 2:
        fitted = LogisticRegression(maxIter=60, regParam=1e-6).fit(VectorAssembler(inputCols=["odds"], outputCol="features").transform(seen).select("label", "features"))
        model.slope, model.offset = float(fitted.coefficients[0]), fitted.intercept
    model.offset += shift
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = pickle.loads(sent.value)
        scorer = Scorer(own)
        for part in sliced(batches, 256):
            out = [own.curve(scorer.worst(t)) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


@checks.add("op11_toxicity")
def op11_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = scored(docs, train(docs, table(spark, d, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
