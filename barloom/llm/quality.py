"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` is the table. Each row names a ratio, the range in which a text passes, and the number of words from
which the rule applies. ``quality`` adds the counts, the ratios and one verdict as built-in column expressions; there is no
user function, no shuffle and no state across rows.

Defined results: a null text counts as the empty text, whose counts are zero; it fails the base rule and is not kept.
Repeated rows get equal verdicts, each row on its own. Very long texts cost n log n. Other columns
are kept; an input column that has the name of an output column is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.checks.registry import Checks
from barloom.llm.common import SPACES, table

checks = Checks()

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# frequent function words of the four languages of the corpus
STOP_WORDS = ["the", "of", "and", "to", "in", "that", "is", "de", "la", "le", "et", "les", "que", "en", "el", "los", "y", "die", "der", "und", "das", "ist"]
STOP_FORMS = [form for w in STOP_WORDS for form in (w, w.capitalize(), w.upper()) if form != w] + STOP_WORDS


@dataclass(frozen=True)
class Rule:
    """A text of at least ``from_words`` words passes if low <= ratio <= high."""

    ratio: str
    low: float = float("-inf")
    high: float = float("inf")
    from_words: int = 0


RULES = (
    Rule("mean_word_chars", low=2.0, high=12.0),
    Rule("symbol_ratio", high=0.10),
    Rule("pipe_ratio", high=0.10),
    Rule("shout_ratio", high=0.30),
    Rule("stop_ratio", low=0.02, from_words=50),
    Rule("echo_ratio", high=0.20),
    Rule("dup_line_ratio", high=0.50),
    Rule("dup_line_chars_per_word", high=0.25),
)


def _repeat_words(at: Column) -> Column:
    """Words covered by windows at the sorted positions ``at``."""
    steps = F.zip_with(F.slice(at, 2, F.size(at)), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    return F.when(F.size(at) > 0, F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x)).otherwise(F.lit(0))


def counts(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the ratios need."""
    text = F.coalesce(F.col("text"), F.lit(""))
    squeezed = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.ltrim(x, F.lit(SPACES)) != "")
    df = docs.withColumns({
        "_words": F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " ", -1), ""),
        "_lines": lines,
        "word_chars": F.length(squeezed).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "_pipes": F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))),
        "_shouts": F.length(text) - F.length(F.replace(text, F.lit("!!"), F.lit("!"))),
    })
    words = F.col("_words")
    n = F.size(words)
    # the 64-bit hash of a window stands for its words: 20,000 windows of one text collide with odds of 1e-11
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[words[i + (k - 1)] for k in range(WINDOW)]))
    df = df.withColumns({
        "n_words": n.cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_stops": F.size(F.filter(words, lambda w: w.isin(STOP_FORMS))),
        "_echoes": F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))),
        "_hashes": F.when(n >= WINDOW, hashes),
    })
    # only texts that repeat a window pay for the sort
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    placed = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(placed)))
    here = F.col("_sorted")
    twin = F.filter(here, lambda x, k: (F.get(here, k - 1)["h"] == x["h"]) | F.coalesce(F.get(here, k + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("_at", F.when(here.isNotNull(), F.sort_array(F.transform(twin, lambda x: x["i"]))))
    return df.withColumn("n_repeat_words", F.coalesce(_repeat_words(F.col("_at")), F.lit(0)).cast("long"))


def _ratios() -> dict[str, Column]:
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word_chars": F.col("word_chars") / per_word,
        "symbol_ratio": F.col("n_symbols") / per_word,
        "pipe_ratio": F.col("_pipes") / per_word,
        "shout_ratio": F.col("_shouts") / per_word,
        "stop_ratio": F.col("_stops") / per_word,
        "echo_ratio": F.col("_echoes") / per_word,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1)),
        "dup_line_chars_per_word": F.col("n_dup_lines") / per_word,
    }


def verdict(rules: tuple[Rule, ...]) -> Column:
    """The threshold table as one expression."""
    ratios, passes = _ratios(), F.lit(True)
    for r in rules:
        x = ratios[r.ratio]
        ok = F.lit(True)
        if r.low != float("-inf"):
            ok = ok & (x >= r.low)
        if r.high != float("inf"):
            ok = ok & (x <= r.high)
        passes = passes & (ok | (F.col("n_words") < r.from_words))
    return passes


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` with its counts, ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    df = counts(docs).withColumn("base_failed", failed)
    df = df.withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return df.drop("_words", "_lines", "_pipes", "_shouts", "_stops", "_echoes", "_hashes", "_sorted", "_at")


def oracle() -> str:
    """The same table in DuckDB's words."""
    stops = ", ".join(f"'{w}'" for w in STOP_FORMS)
    where = []
    for r in RULES:
        parts = ([f"{r.ratio} >= {r.low}"] if r.low != float("-inf") else []) + ([f"{r.ratio} <= {r.high}"] if r.high != float("inf") else [])
        where.append(f"(({' AND '.join(parts)}) OR n_words < {r.from_words})")
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
    u AS (SELECT rid, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM w WHERE len(words) >= {WINDOW}),
    g AS (SELECT rid, i, list_slice(words, i, i + {WINDOW - 1}) AS win FROM u),
    m AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g),
    r AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM m WHERE n > 1),
    rep AS (SELECT rid, sum(least(coalesce(nx - i, {WINDOW}), {WINDOW})) AS n FROM r GROUP BY rid),
    c AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(rep.n, 0)::BIGINT AS n_repeat_words, greatest(len(words), 1) AS per_word, len(lines) AS n_lines,
      length(text) - length(replace(text, '|', '')) AS pipes, length(text) - length(replace(text, '!!', '!')) AS shouts,
      len(list_filter(words, lambda x: x IN ({stops}))) AS stops,
      len(list_filter(words, lambda x, i: x = words[i - 1])) AS echoes FROM w LEFT JOIN rep USING (rid)),
    t AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
      word_chars / per_word AS mean_word_chars, n_symbols / per_word AS symbol_ratio, pipes / per_word AS pipe_ratio, shouts / per_word AS shout_ratio,
      stops / per_word AS stop_ratio, echoes / per_word AS echo_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_dup_lines / per_word AS dup_line_chars_per_word FROM c)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(where)} AS kept FROM t"""


@checks.add("op2_quality_rules", oracle())
def op2_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality(table(spark, d, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
