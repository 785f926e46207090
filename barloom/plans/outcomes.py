"""What every candidate signal would have earned, and which of them a book would have taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions import trading as T
from barloom.operators import exits
from barloom.operators.asof import asof_join
from barloom.operators.layout import pinned
from barloom.plans import admission
from barloom.spec import CostSpec, EntrySpec, ExitSpec, SessionSpec


def size_and_resolve(entries: DataFrame, bars: DataFrame, session: SessionSpec, spec: ExitSpec, cost: CostSpec = CostSpec(),
                     mult: Column | None = None, ratio: Column | None = None, carry: bool = False, exit_source: str = "atr",
                     weight: Column | None = None, at_end: str = "EOD_FORCED",
                     band: tuple[Column, Column] | None = None, keep_all: bool = False) -> DataFrame:
    """Entries (symbol, session_date, side, direction, entry_ts, entry_price, atr) to resolved trades.

    ``exit_source='policy'`` prefers struct_sl/struct_target where a signal carries them. ``keep_all`` keeps entries without a bar or
    a quantity and adds ``can_enter``.
    """
    levels = T.sl_target(F.col("entry_price"), F.col("direction"), F.col("atr"), spec, mult, ratio, band=band)
    df = entries.withColumn("_x", levels)
    if exit_source == "policy":
        has = F.col("struct_sl").isNotNull() & F.col("struct_target").isNotNull()
        df = df.withColumns({"sl": F.when(has, F.col("struct_sl")).otherwise(F.col("_x.sl")),
                             "tgt": F.when(has, F.col("struct_target")).otherwise(F.col("_x.tgt")),
                             "sl_dist": F.when(has, F.abs(F.col("entry_price") - F.col("struct_sl"))).otherwise(F.col("_x.dist"))})
    else:
        df = df.withColumns({"sl": F.col("_x.sl"), "tgt": F.col("_x.tgt"), "sl_dist": F.col("_x.dist")})
    df = df.drop("_x").withColumn("qty", T.position_size(F.col("entry_price"), F.col("sl_dist"), spec, weight))
    df = df.withColumn("can_enter", F.col("entry_ts").isNotNull() & (F.col("qty") > 0)) if keep_all else df.filter("qty > 0")
    df = exits.first_touch_exit(df, bars, session, carry=carry, at_end=at_end)
    e, x, q, s = (F.col(c) for c in ("entry_price", "exit_price", "qty", "side"))
    df = df.withColumns({"pnl_gross": T.gross_pnl(e, x, q, s), "pnl_net": T.net_pnl(e, x, q, s, cost)})
    return df.withColumn("r_multiple", F.col("pnl_net") / F.greatest(F.col("sl_dist") * q, F.lit(1e-9)))


def with_entries(signals: DataFrame, bars: DataFrame, keep_all: bool = False) -> DataFrame:
    """Signals with the next bar of their session; those without one cannot be entered and are kept only on request."""
    nxt = exits.next_bar_entry(bars).select("symbol", "session_date", "ts", "entry_ts", "entry_price")
    return signals.join(nxt.filter("entry_ts is not null"), ["symbol", "session_date", "ts"], "left" if keep_all else "inner")


def candidate_outcomes(signals: DataFrame, bars: DataFrame, session: SessionSpec, spec: ExitSpec, keep_all: bool = False, **kw) -> DataFrame:
    """Outcome of every signal, taken alone: prices decide it, other trades do not."""
    return size_and_resolve(with_entries(signals, bars, keep_all), bars, session, spec, keep_all=keep_all, **kw)


def in_scan_window(signals: DataFrame, session: SessionSpec) -> DataFrame:
    from barloom.operators.clean import in_entry_window

    return signals.filter(in_entry_window("ts", session))


# ---- admission ---------------------------------------------------------------------------
def run_table(spark, rows: list[tuple]) -> DataFrame:
    """Rows of (run, gate, top_per_bar, min_score, max_open), all on the first filter and exit setting."""
    runs = spark.createDataFrame(rows, "run int, gate string, top_per_bar int, min_score int, max_open int")
    return runs.withColumns({"variant": F.lit(0), "setting": F.lit(0)})


def with_trend(signals: DataFrame, trend: DataFrame | None) -> DataFrame:
    """Adds the index trend at the signal's bar, 0 where there is none."""
    if trend is None:
        return signals.withColumn("trend", F.lit(0))
    return asof_join(signals, trend.select("ts", "trend"), "trend", default=F.lit(0))


def backtest(bars: DataFrame, index_trend: DataFrame | None, signals: DataFrame, session: SessionSpec, exit_spec: ExitSpec,
             entry: EntrySpec, **kw) -> tuple[DataFrame, DataFrame]:
    """(trades taken, counters) of one rule set. Signals that cannot be entered still count for gate, rank and cap."""
    done = candidate_outcomes(in_scan_window(signals, session), bars, session, exit_spec, keep_all=True, **kw)
    result = F.struct("exit_ts", "can_enter")
    offers = with_trend(done, index_trend).withColumns({"variants": F.array(F.lit(0)), "results": F.array(result)})
    runs = run_table(bars.sparkSession, [(0, entry.gate, entry.top_per_bar, entry.min_score, entry.max_open)])
    # trades and counters read the same books
    books = pinned(admission.book(offers, runs, [c for c in done.columns if c not in ("exit_ts", "can_enter")]))
    return admission.taken(books).drop("can_enter"), admission.admission_counts(books)


# ---- outcomes of a grid ------------------------------------------------------------------
def outcomes_by_setting(entries: DataFrame, bars: DataFrame, session: SessionSpec, spec: ExitSpec, settings: Column,
                        cost: CostSpec = CostSpec(), at_end: str = "EOD_FORCED") -> DataFrame:
    """Adds ``results``: the outcome of every signal under each exit setting (atr_mult, reward_ratio, min_stop, max_stop) of the array.

    A signal meets the bars of its session once, whatever the number of settings.
    """
    limit = session.square_off
    side, price, direction = F.col("side"), F.col("entry_price"), F.col("direction")
    live = F.filter("path", lambda b: b["ts"] >= F.col("entry_ts"))
    c = entries.join(exits.session_paths(bars), ["symbol", "session_date"]).withColumn("path", live).withColumn("settings", settings)

    def ended(x: Column, hit: Column) -> Column:
        found, last = hit.isNotNull(), F.try_element_at("path", F.lit(-1))
        out = exits.bar_exit(hit, side, x["sl"], x["tgt"], limit)
        return F.struct(x["dist"].alias("sl_dist"), x["qty"].alias("qty"), F.when(found, hit["ts"]).otherwise(last["ts"]).alias("exit_ts"),
                        F.when(found, out["price"]).otherwise(last["close"]).alias("exit_price"), F.when(found, out["outcome"]).otherwise(at_end).alias("outcome"))

    def resolved(s: Column) -> Column:
        levels = T.sl_target(price, direction, F.col("atr"), spec, s["atr_mult"], s["reward_ratio"], band=(s["min_stop"], s["max_stop"]))
        sized = admission.let(levels, lambda x: F.struct(x["sl"].alias("sl"), x["tgt"].alias("tgt"), x["dist"].alias("dist"), T.position_size(price, x["dist"], spec).alias("qty")))
        first = lambda x: F.try_element_at(F.filter("path", lambda b: exits._ends(b, side, x["sl"], x["tgt"], limit)), F.lit(1))
        return admission.let(sized, lambda x: admission.let(first(x), lambda hit: ended(x, hit)))

    def paid(r: Column) -> Column:
        net = T.net_pnl(price, r["exit_price"], r["qty"], side, cost)
        return F.struct(r["exit_ts"].alias("exit_ts"), r["outcome"].alias("outcome"), r["qty"].alias("qty"), net.alias("pnl_net"),
                        (net / F.greatest(r["sl_dist"] * r["qty"], F.lit(1e-9))).alias("r_multiple"), (F.col("entry_ts").isNotNull() & (r["qty"] > 0)).alias("can_enter"))

    return c.withColumn("results", F.transform("settings", lambda s: admission.let(resolved(s), paid))).drop("path", "settings")
