"""Spelling variant groups over a reduced alphabet.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Letters are hashed to a few symbols, dealt
so that every symbol is about as frequent; near words then have reduced words that are equal or one edit apart. Every word
goes to its reduced word and to the one-edit neighbourhood of that, which meets the reduced vocabulary in one equi-join on
64-bit codes; an exact edit test on the original strings follows. Nearness is symmetric, so each pair of reduced words is generated from
one side only: replacements by a higher symbol and deletions, the other side's replacements and insertions being their mirror
images. A word has at most (symbols / 2 + 1) x length + 1 codes, and words of equal codes are few, so no group holds all pairs.

A word's form is its near word of the largest count (ties: the smallest in code-point order) if that is at least ``ratio`` times
its own. Counts grow by that factor along forms, so forms make trees; roots are found by pointer doubling in a few joins.

Defined results: null and empty texts have no words; rows without an id count their words as written; repeated rows count each; other columns are
not read. Texts of any length are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.checks.registry import Checks
from barloom.llm.common import sliced, stored, table

checks = Checks()

SYMBOLS = 8
RATIO = 5
MIN_LENGTH = 6
MIN_COUNT = 5
DAMAGE = 199
# entries of a task's running counts before they go to Spark's aggregation
HELD = 200_000

# UTF-8 of A-Z, a-z (lower-cased before) and U+00C0 to U+00FF
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def damaged(doc_id: int | None, run: bytes) -> str:
    """The run, or what is left of it where the query's rule deletes one of its code points."""
    word = run.decode("utf-8")
    if doc_id is not None:
        h = zlib.crc32(run, zlib.crc32(b"%d:" % doc_id))
        if h % DAMAGE == 0:
            k = h % len(word)
            return word[:k] + word[k + 1:]
    return word


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all texts, counted per task before they are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for part in sliced(batches):
            for doc, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for found, n in Counter(RUN.findall((raw or b"").lower())).items():
                    if len(found) >= min_length and len(word := damaged(doc, found)) >= min_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield rows(held)
                    held.clear()
        if held:
            yield rows(held)

    def rows(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def alphabet(words: DataFrame, symbols: int = SYMBOLS) -> dict[str, int]:
    """Symbol (from 1) of every letter: letters in order of frequency are dealt round; at most one row a letter reaches the driver."""
    counts = words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()
    ranked = sorted((-r["n"], r["c"]) for r in counts)
    return {c: 1 + i % symbols for i, (_, c) in enumerate(ranked)}


def reduced_codes(s: np.ndarray, symbols: int) -> tuple[np.uint64, np.ndarray]:
    """Codes of a reduced word and of the reduced words generated from it: higher replacements and deletions."""
    power = np.ones(len(s) + 1, np.uint64)
    power[1:] = np.multiply.accumulate(np.full(len(s), BASE))
    s = s.astype(np.uint64)
    term = s * power[len(s) - 1::-1] if len(s) > 1 else s
    home = term.sum(dtype=np.uint64)
    higher = np.arange(1, symbols + 1, dtype=np.uint64)[None, :]
    at, to = np.nonzero(higher > s[:, None])
    replaced = home + (higher[0, to] - s[at]) * power[len(s) - 1 - at]
    moved = np.zeros(len(s), np.uint64)  # symbols before a deleted one lose one power
    moved[1:] = np.add.accumulate(s[:-1] * power[len(s) - 2::-1]) if len(s) > 2 else s[:-1]
    deleted = moved + (home - np.add.accumulate(term))
    return home, np.unique(np.concatenate([replaced, deleted]))


def coded(words: DataFrame, symbols: int = SYMBOLS) -> tuple[DataFrame, DataFrame]:
    """The reduced vocabulary (code, word, n) and the neighbourhoods (code, word, n, home); ``home`` marks the word's own code."""
    symbol = alphabet(words, symbols)
    schema = "code long, word string, n long, home boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 2048):
            codes, marks = [], []
            for word in part.column(0).to_pylist():
                home, near = reduced_codes(np.array([symbol[c] for c in word]), symbols)
                codes.append(np.concatenate([[home], near[near != home]]))
                marks.append(len(codes[-1]))
            if not codes:
                continue
            at = np.repeat(np.arange(len(codes)), marks)
            home = np.zeros(len(at), bool)
            home[np.cumsum([0, *marks[:-1]])] = True
            index = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes).view(np.int64)), part.column(0).take(index), part.column(1).take(index), pa.array(home)], names=["code", "word", "n", "home"])

    every = words.select("word", "n").mapInArrow(run, schema)
    return every.filter("home").drop("home"), every


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(a, n_a, b, n_b): every pair of near words once."""
    homes, probes = coded(words, symbols)
    left = probes.select("code", F.col("word").alias("a"), F.col("n").alias("n_a"), "home")
    right = homes.select("code", F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = left.join(right, "code").filter(~F.col("home") | (F.col("a") < F.col("b"))).filter("a <> b")
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row (word, form): the end of its chain, by pointer doubling."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        now = step.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of ``words`` (word, n), whose words are distinct."""
    words = stored(words, "words")
    pairs = stored(near_pairs(words, symbols), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    held = -F.col("best.m") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(held, F.col("best.other")).alias("form"), F.when(held, -F.col("best.m")).alias("form_n"))
    found = stored(found, "forms")
    return found.join(roots(found.filter("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    octets = "flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END FOR c IN string_split({}, '')])"
    return rf"""
    WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) x(i))),
    r AS (SELECT row_number() OVER () AS rid, doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
    u AS (SELECT rid, doc_id, run, count(*) AS n FROM r GROUP BY ALL),
    h AS (SELECT run, n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce([4294967295::BIGINT] || {octets.format("doc_id::VARCHAR || ':' || run")}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) END AS h FROM u, crc),
    d AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM h),
    w AS (SELECT word, sum(n)::BIGINT AS n FROM d GROUP BY word HAVING length(word) >= {MIN_LENGTH} AND sum(n) >= {MIN_COUNT}),
    cut AS (SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
    p AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
      UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
    k AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM p GROUP BY word),
    f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= {RATIO} * w.n THEN other END AS form, CASE WHEN m >= {RATIO} * w.n THEN m END AS form_n FROM w LEFT JOIN k USING (word)),
    chain AS (SELECT word, word AS here FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON chain.here = f.word WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, here AS root, f.n, f.n_near, f.form_n FROM f JOIN chain USING (word) JOIN f e ON e.word = here WHERE e.form IS NULL"""


@checks.add("op12_spelling_variants", oracle())
def op12_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    found = variants(vocabulary(table(spark, d, "documents")))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
