"""Entries, barriers and exit plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.catalog import minute_of_day
from barloom.functions.trading import sign_of
from barloom.spec import ExitSpec, SessionSpec


def next_bar_entry(bars: DataFrame) -> DataFrame:
    """Adds ``entry_ts`` and ``entry_price``: the next bar of the same session, null if there is none."""
    w = Window.partitionBy("symbol", "session_date").orderBy("ts")
    return bars.withColumns({"entry_ts": F.lead("ts").over(w), "entry_price": F.lead("open").over(w)})


def session_paths(bars: DataFrame) -> DataFrame:
    """One row per (symbol, session): its bars as an ordered array, at most one per bar interval."""
    bar = F.struct("ts", "high", "low", "close", minute_of_day("ts").alias("minute"))
    return bars.groupBy("symbol", "session_date").agg(F.array_sort(F.collect_list(bar)).alias("path"))


def bar_exit(bar: Column, side: Column, sl: Column, tgt: Column, square_off: int | None, optimistic: bool = False) -> Column:
    """Struct (price, outcome) of a bar that ends the trade, else null.

    Square-off comes first, then the stop; a bar that touches both barriers counts as the stop
    unless ``optimistic``.
    """
    long_ = side == "BUY"
    stop = F.when(long_, bar["low"] <= sl).otherwise(bar["high"] >= sl)
    goal = F.when(long_, bar["high"] >= tgt).otherwise(bar["low"] <= tgt)
    out = lambda price, name: F.struct(price.alias("price"), F.lit(name).alias("outcome"))
    barriers = ((goal, out(tgt, "TARGET")), (stop, out(sl, "SL"))) if optimistic else ((stop, out(sl, "SL")), (goal, out(tgt, "TARGET")))
    case = F.when(F.lit(False), out(sl, "SL")) if square_off is None else F.when(bar["minute"] >= square_off, out(bar["close"], "SQUAREOFF"))
    for condition, result in barriers:
        case = case.when(condition, result)
    return case


def _ends(bar: Column, side: Column, sl: Column, tgt: Column, square_off: int | None) -> Column:
    touched = F.when(side == "BUY", (bar["low"] <= sl) | (bar["high"] >= tgt)).otherwise((bar["high"] >= sl) | (bar["low"] <= tgt))
    return touched | (bar["minute"] >= square_off) if square_off is not None else touched


def first_touch_exit(candidates: DataFrame, bars: DataFrame, spec: SessionSpec, optimistic: bool = False,
                     horizon: int | None = None, square_off: bool = True, carry: bool = False,
                     at_end: str = "EOD_FORCED") -> DataFrame:
    """Adds exit_ts, exit_price and outcome to candidates (symbol, session_date, side, entry_ts, sl, tgt).

    A candidate meets the bar array of its session in one equi-join and takes the first element
    that ends it, so no pair of candidate and bar is ever materialised. ``horizon`` limits the
    search to that many bars from the entry. With ``carry`` an unresolved position lives on into
    the following sessions of its symbol, else it ends with its session.
    """
    limit = spec.square_off if square_off else None
    if carry:
        return _carried(candidates, bars, limit, optimistic, at_end)
    return _resolve(candidates, session_paths(bars), ["symbol", "session_date"], limit, optimistic, horizon, at_end)


def _resolve(candidates: DataFrame, paths: DataFrame, on: list[str], limit: int | None, optimistic: bool, horizon: int | None,
             at_end: str) -> DataFrame:
    c = candidates.join(paths, on)
    live = F.filter("path", lambda b: b["ts"] >= F.col("entry_ts"))
    if horizon is not None:
        live = F.slice(live, 1, horizon)
    side, sl, tgt = F.col("side"), F.col("sl"), F.col("tgt")
    c = c.withColumn("path", live)
    c = c.withColumn("_hit", F.try_element_at(F.filter("path", lambda b: _ends(b, side, sl, tgt, limit)), F.lit(1)))
    c = c.withColumn("_last", F.try_element_at("path", F.lit(-1))).drop("path")
    c = c.withColumn("_exit", bar_exit(F.col("_hit"), side, sl, tgt, limit, optimistic))
    hit = F.col("_hit").isNotNull()
    c = c.withColumns({"exit_ts": F.when(hit, F.col("_hit.ts")).otherwise(F.col("_last.ts")),
                       "exit_price": F.when(hit, F.col("_exit.price")).otherwise(F.col("_last.close")),
                       "outcome": F.when(hit, F.col("_exit.outcome")).otherwise(at_end)})
    return c.drop("_hit", "_last", "_exit")


def _carried(candidates: DataFrame, bars: DataFrame, limit: int | None, optimistic: bool, at_end: str) -> DataFrame:
    """A position ends at the latest in the first session, its own or a later one, with a square-off bar."""
    w = Window.partitionBy("symbol").orderBy("session_date")
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    paths = session_paths(bars).withColumn("_no", F.row_number().over(w))
    closes = F.exists("path", lambda b: b["minute"] >= limit) if limit is not None else F.lit(False)
    paths = paths.withColumn("_last_no", F.coalesce(F.min(F.when(closes, F.col("_no"))).over(ahead), F.max("_no").over(ahead)))
    spans = paths.select("symbol", "session_date", F.col("_no").alias("_from"), "_last_no")
    keep = candidates.columns
    # equal candidates are carried once and told apart again at the end
    once = candidates.groupBy(*keep).agg(F.count(F.lit(1)).alias("_copies"))
    spread = once.join(spans, ["symbol", "session_date"]).withColumn("_no", F.explode(F.sequence("_from", "_last_no")))
    tried = _resolve(spread, paths.select("symbol", "_no", "path"), ["symbol", "_no"], limit, optimistic, None, "")
    # the earliest session with an exit wins; without one the last bar of all sessions is the end
    done = F.when(F.col("outcome") != "", F.col("_no"))
    best = tried.groupBy(*keep, "_copies").agg(
        F.min_by(F.struct("exit_ts", "exit_price", "outcome"), done).alias("a"),
        F.max_by(F.struct("exit_ts", "exit_price"), F.when(F.col("exit_ts").isNotNull(), F.col("_no"))).alias("z"),
        F.min(done).alias("n"))
    won = F.col("n").isNotNull()
    best = best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
    return best.select(*keep, F.when(won, F.col("a.exit_ts")).otherwise(F.col("z.exit_ts")).alias("exit_ts"),
                       F.when(won, F.col("a.exit_price")).otherwise(F.col("z.exit_price")).alias("exit_price"),
                       F.when(won, F.col("a.outcome")).otherwise(at_end).alias("outcome"))


def excursion_peak(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds ``best_fav``: the largest favourable move from entry bar to exit bar, never below zero."""
    c = trades.join(session_paths(bars), ["symbol", "session_date"])
    held = F.filter("path", lambda b: (b["ts"] >= F.col("entry_ts")) & (b["ts"] <= F.col("exit_ts")))
    sgn = sign_of(F.col("side"))
    move = F.transform(held, lambda b: (F.when(sgn > 0, b["high"]).otherwise(b["low"]) - F.col("entry_price")) * sgn)
    return c.withColumn("best_fav", F.greatest(F.coalesce(F.array_max(move), F.lit(0.0)), F.lit(0.0))).drop("path")


def validate_exit_plan(entry: Column, stop: Column, target: Column, direction: Column, qty: Column | None,
                       spec: ExitSpec = ExitSpec()) -> Column:
    """Code of the first broken rule, ``PLAN_VALID`` when there is none (null numbers are not finite)."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    d = F.when(direction > 0, 1).otherwise(-1)
    dist = F.abs(entry - stop)
    share = dist / F.when(entry > 0, entry)
    # fixed values: reason codes of the plan check
    code = (F.when(~(finite(entry) & finite(stop) & finite(target)), "NON_FINITE_VALUE")
            .when((entry - stop) * d <= 0, "SL_WRONG_SIDE").when((target - entry) * d <= 0, "TGT_WRONG_SIDE")
            .when(entry <= 0, "NON_FINITE_VALUE")
            .when((share < spec.min_stop) | (share > spec.max_stop), "SL_DISTANCE_OUT_OF_LIMITS")
            .when(F.abs(target - entry) / F.when(dist > 0, dist) < spec.min_reward_ratio, "RR_BELOW_MIN"))
    if qty is not None:
        code = (code.when(qty <= 0, "QTY_ZERO").when(dist * qty > spec.risk_budget + 1e-6, "MAX_RISK_EXCEEDED"))
    return code.otherwise("PLAN_VALID")


def exit_policy(df: DataFrame, spec: ExitSpec = ExitSpec(), decimals: int | None = 2) -> DataFrame:
    """Chooses stop and target: learned pick, else structure, else strategy, else ATR.

    Reads entry, direction, atr, qty, struct_sl/struct_tgt, strat_sl/strat_tgt, rr_sl/rr_tgt (ATR
    multiples), rr_status and forecast_target, all nullable but entry and direction. Adds stop, target,
    source, risk_per_unit, expected_rr, rejected, reasons, valid and reject_reason.
    """
    e, d = F.col("entry"), F.when(F.col("direction") > 0, 1).otherwise(-1)
    cut = (lambda c, n: F.round(c, n)) if decimals is not None else (lambda c, n: c)
    atr = F.when(F.col("atr") > 0, F.col("atr")).otherwise(e * 0.005)
    sides = lambda s, t: s.isNotNull() & t.isNotNull() & ((e - s) * d > 0) & ((t - e) * d > 0)
    struct_ok, strat_ok = sides(F.col("struct_sl"), F.col("struct_tgt")), sides(F.col("strat_sl"), F.col("strat_tgt"))
    base_source = F.when(struct_ok, "structure").when(strat_ok, "strategy").otherwise("atr")
    base_reason = (F.when(struct_ok, "EXIT_STRUCTURE_USED").when(strat_ok, "EXIT_STRATEGY_USED").otherwise("EXIT_ATR_FALLBACK"))
    df = df.withColumns({
        "_atr": atr, "_src": base_source, "_why": base_reason,
        "_sl": F.when(struct_ok, F.col("struct_sl")).when(strat_ok, F.col("strat_sl")).otherwise(cut(e - d * spec.atr_mult * atr, decimals)),
        "_tg": F.when(struct_ok, F.col("struct_tgt")).when(strat_ok, F.col("strat_tgt"))
        .otherwise(cut(e + d * spec.reward_ratio * spec.atr_mult * atr, decimals)),
        "_rs": cut(e - d * F.col("rr_sl") * atr, decimals), "_rt": cut(e + d * F.col("rr_tgt") * atr, decimals)})
    offered = F.col("_rs").isNotNull() & F.col("_rt").isNotNull()
    status = F.coalesce(F.col("rr_status"), F.lit("DISABLED"))
    df = df.withColumn("_rr", F.coalesce(offered & (status == "ACCEPTED") & sides(F.col("_rs"), F.col("_rt")), F.lit(False)))
    rr = F.col("_rr")
    df = df.withColumns({"stop": F.when(rr, F.col("_rs")).otherwise(F.col("_sl")), "_t0": F.when(rr, F.col("_rt")).otherwise(F.col("_tg")),
                         "source": F.when(rr, "rr_model").otherwise(F.col("_src"))})
    want = F.abs(F.col("forecast_target") - e)
    pulled = F.coalesce(want < F.abs(F.col("_t0") - e), F.lit(False))
    floor = F.greatest(want, spec.min_reward_ratio * F.abs(e - F.col("stop")))
    df = df.withColumns({"_pull": pulled, "target": F.when(pulled, cut(e + d * floor, decimals)).otherwise(F.col("_t0"))})
    df = df.withColumn("reject_reason", validate_exit_plan(e, F.col("stop"), F.col("target"), F.col("direction"), F.col("qty"), spec))
    ok = F.col("reject_reason") == "PLAN_VALID"
    word = lambda cond, text: F.when(cond, F.lit(text) if isinstance(text, str) else text)
    fell = ~rr & ~status.isin("ACCEPTED", "DISABLED")
    # fixed values: reason codes of a resolved plan, in order
    reasons = F.array_compact(F.array(
        word(rr, "RR_ACCEPTED"), word(rr, "EXIT_RR_USED"), word(~rr, F.col("_why")), word(fell, "RR_FALLBACK"),
        F.when(F.col("_pull"), "FORECAST_CONSTRAINT_APPLIED").otherwise("FORECAST_NO_VIEW"),
        word(rr & F.col("_pull"), "FORECAST_SKIPPED_RR_OWNS_EXIT"), word(ok, "PLAN_VALID")))
    rejected = F.array_compact(F.array(word(rr, F.col("_src")), word(~rr & offered, "rr_model")))
    dist = F.abs(e - F.col("stop"))
    df = df.withColumns({
        "valid": ok, "rejected": rejected, "reasons": F.when(ok, reasons).otherwise(F.array("reject_reason")),
        "risk_per_unit": F.when(ok, dist).otherwise(0.0),
        "expected_rr": F.when(ok, F.abs(F.col("target") - e) / F.nullif(dist, F.lit(0.0))).otherwise(0.0),
        "source": F.when(ok, F.col("source")).otherwise("none")})
    df = df.withColumns({"stop": F.when(ok, F.col("stop")), "target": F.when(ok, F.col("target")),
                         "reject_reason": F.when(~ok, F.col("reject_reason"))})
    return df.drop("_atr", "_src", "_why", "_sl", "_tg", "_rs", "_rt", "_rr", "_t0", "_pull")
