"""Admission of signals to a book with a position limit, folded inside the JVM.

The book of a session is the only state that links trades. All signals of a session stand in one ordered array; a run folds
over it with a state of fixed kind: the slots in use, the symbols traded so far, the symbols seen on the current bar and four
counters. Runs do not multiply rows: a signal carries the filter settings it passes and one result per exit setting,
and each run folds the same array with its own gate, limits and settings. Only trades taken leave the fold.

A session's array holds at most one signal per (symbol, strategy, direction) and filter setting, so the universe of
symbols bounds it, not the history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from barloom.operators import gates
from barloom.operators.layout import one_row

RUN = ["run", "gate", "top_per_bar", "min_score", "max_open", "variant", "setting"]
COUNTERS = ["raw_signals", "gate_rejected", "position_cap_hits"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _descending(name: str) -> list[Column]:
    """Sort fields of a falling number, nulls last."""
    return [F.col(name).isNull().alias(f"_no_{name}"), (-F.col(name)).alias(f"_{name}")]


def _passes(gate: Column, direction: Column, trend: Column) -> Column:
    return (F.when(gate == "off", True).when(gate == "strict", gates.index_gate(direction, trend, "strict"))
            .otherwise(gates.index_gate(direction, trend)))


def _fold(offers: Column, run: Column, kind: ArrayType, ts_type) -> Column:
    """The book of one run: counters and ``taken`` (offer and result of every trade).

    Words on a signal, in this order: HELD, its symbol traded on an earlier bar of the session, so it would not have been
    produced; GATED; DUPLICATE, a better signal of its symbol stands on the bar; BELOW_TOP; CAP_REST, behind a signal that
    found the book full; LOW_SCORE; CAP; NO_ENTRY, no next bar in the session or no quantity; TAKEN.
    """
    names, times = F.array().cast(ArrayType(StringType())), F.array().cast(ArrayType(ts_type))
    zero = F.struct(
        F.lit(None).cast(ts_type).alias("bar"), names.alias("seen"), F.lit(0).alias("tried"), F.lit(False).alias("full"), times.alias("busy"),
        names.alias("traded"), *[F.lit(0).cast("long").alias(c) for c in COUNTERS], F.array().cast(kind).alias("taken"))

    def word(a: Column, s: Column, x: Column, result: Column) -> Column:
        repeat = F.array_contains(s["seen"], x["symbol"])
        return (F.when(F.array_contains(a["traded"], x["symbol"]) & ~repeat, "HELD")
                .when(~F.coalesce(_passes(run["gate"], x["direction"], x["trend"]), F.lit(False)), "GATED").when(repeat, "DUPLICATE")
                .when(s["tried"] >= run["top_per_bar"], "BELOW_TOP").when(s["full"], "CAP_REST").when(x["score"] < run["min_score"], "LOW_SCORE")
                .when(F.size(s["busy"]) >= run["max_open"], "CAP").when(~F.coalesce(result["can_enter"], F.lit(False)), "NO_ENTRY").otherwise("TAKEN"))

    def after(a: Column, s: Column, x: Column, result: Column, w: Column) -> Column:
        lead, won = ~w.isin("HELD", "GATED", "DUPLICATE"), w == "TAKEN"
        more = lambda have, one, when: F.when(when, F.concat(have, F.array(one))).otherwise(have)
        add = lambda name, when: (a[name] + when.cast("long")).alias(name)
        return F.struct(
            x["ts"].alias("bar"), more(s["seen"], x["symbol"], lead).alias("seen"), (s["tried"] + lead.cast("int")).alias("tried"), (s["full"] | (w == "CAP")).alias("full"),
            more(s["busy"], result["exit_ts"], won).alias("busy"), more(a["traded"], x["symbol"], won).alias("traded"),
            add("raw_signals", w != "HELD"), add("gate_rejected", w == "GATED"), add("position_cap_hits", w == "CAP"),
            more(a["taken"], F.struct(x["item"].alias("item"), result.alias("result")), won).alias("taken"))

    def step(a: Column, x: Column) -> Column:
        # a new bar clears the marks of the one before; positions that ended on or before it have freed their slots
        now = F.when(a["bar"].eqNullSafe(x["ts"]), F.struct(a["seen"].alias("seen"), a["tried"].alias("tried"), a["full"].alias("full"), a["busy"].alias("busy"))).otherwise(
            F.struct(names.alias("seen"), F.lit(0).alias("tried"), F.lit(False).alias("full"), F.filter(a["busy"], lambda t: t > x["ts"]).alias("busy")))
        result = F.get(x["results"], run["setting"])
        moved = let(now, lambda s: let(word(a, s, x, result), lambda w: after(a, s, x, result, w)))
        return F.when(F.array_contains(x["variants"], run["variant"]), moved).otherwise(a)

    return F.aggregate(offers, zero, step, lambda a: F.struct(*[a[c].alias(c) for c in COUNTERS], a["taken"].alias("taken")))


def book(offers: DataFrame, runs: DataFrame, carry: list[str]) -> DataFrame:
    """(run, session_date, counters, taken): one row per run and session with signals.

    ``offers`` has one row per signal: session_date, ts, symbol, pattern, direction, score, vol_ratio, strength, trend, ``variants`` (filter
    settings it passes) and ``results`` (a struct with exit_ts and can_enter per exit setting). ``runs`` has the columns ``RUN``,
    a few numbers per run of the grid. ``carry`` names the columns that a trade keeps.
    """
    item = F.struct(*carry)
    order = [F.col("ts"), *_descending("score"), *_descending("vol_ratio"), *_descending("strength"), F.col("symbol"), F.col("pattern")]
    offer = F.struct(*order, "direction", "score", "trend", "variants", "results", item.alias("item"))
    types = offers.select(item.alias("item"), F.element_at("results", 1).alias("result"), "ts").schema
    kind = ArrayType(offers.select(F.struct(item.alias("item"), F.element_at("results", 1).alias("result")).alias("t")).schema["t"].dataType)
    days = offers.groupBy("session_date").agg(F.array_sort(F.collect_list(offer)).alias("offers"))
    every = runs.agg(F.collect_list(F.struct(*RUN)).alias("runs"))
    days = days.withColumn("runs", one_row(every)["runs"])
    done = F.transform("runs", lambda r: F.struct(r["run"].alias("run"), _fold(F.col("offers"), r, kind, types["ts"].dataType).alias("b")))
    return days.select("session_date", F.explode(done).alias("x")).select("x.run", "session_date", "x.b.*")


def taken(books: DataFrame) -> DataFrame:
    """Trades of the books: run, the carried columns and the fields of the result."""
    rows = books.select("run", F.explode("taken").alias("t"))
    return rows.select("run", "t.item.*", "t.result.*")


def admission_counts(books: DataFrame) -> DataFrame:
    """Counters per run: raw signals, gate rejects, hits of the position cap, trades taken."""
    return books.groupBy("run").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.sum(F.size("taken")).alias("taken"))
