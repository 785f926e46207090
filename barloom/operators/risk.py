"""Portfolio limits, circuit breakers and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.catalog import micros
from barloom.operators.layout import lay_out, one_row, running
from barloom.operators.ledger import loss_streak
from barloom.spec import DayLimits, RiskLimits

RISK = "abs(entry - sl) * qty"


def exposure_totals(positions: DataFrame) -> DataFrame:
    """Open risk and notional over all, per symbol, per strategy and per sector, in one aggregation.

    ``level`` tells the grouping; ``name`` is its value.
    """
    p = positions.withColumns({"risk": F.expr(RISK), "notional": F.expr("entry * qty"), "buy": F.upper("side") == "BUY",
                               "symbol": F.upper("symbol")})
    sets = p.groupingSets([[F.col("symbol")], [F.col("strategy")], [F.col("sector")], []],
                          F.col("symbol"), F.col("strategy"), F.col("sector"))
    out = sets.agg(F.sum("risk").alias("open_risk"), F.sum("notional").alias("notional"),
                   F.coalesce(F.sum(F.when(F.col("buy"), F.col("notional"))), F.lit(0.0)).alias("long_exposure"),
                   F.coalesce(F.sum(F.when(~F.col("buy"), F.col("notional"))), F.lit(0.0)).alias("short_exposure"),
                   F.grouping_id("symbol", "strategy", "sector").alias("g"))
    level = F.when(F.col("g") == 3, "symbol").when(F.col("g") == 5, "strategy").when(F.col("g") == 6, "sector").otherwise("all")
    name = F.coalesce(F.when(F.col("g") == 3, F.col("symbol")).when(F.col("g") == 5, F.col("strategy")).when(F.col("g") == 6, F.col("sector")),
                      F.lit(""))
    return out.select(level.alias("level"), name.alias("name"), "open_risk", "notional", "long_exposure", "short_exposure")


def portfolio_heat(positions: DataFrame) -> DataFrame:
    return positions.agg(F.coalesce(F.sum(F.expr(RISK)), F.lit(0.0)).alias("heat"))


def entry_check(candidates: DataFrame, positions: DataFrame, limits: RiskLimits = RiskLimits()) -> DataFrame:
    """Each candidate alone against the open book: adds ``reasons`` and ``ok``.

    Candidates and positions carry a ``sector``; the unknown sector is checked like any other.
    """
    heat = portfolio_heat(positions)
    per = lambda key: positions.groupBy(F.upper(key).alias(f"_{key}")).agg(F.sum(F.expr("entry * qty")).alias(f"_{key}_notional"))
    c = candidates.withColumn("heat", one_row(heat)["heat"])
    for key in ("symbol", "sector"):
        c = c.join(per(key), F.upper(key) == F.col(f"_{key}"), "left")
    own = F.expr("entry * qty")
    held = lambda key: F.coalesce(F.col(f"_{key}_notional"), F.lit(0.0)) + own
    reasons = F.array_compact(F.array(
        F.when(F.col("heat") + F.expr(RISK) > limits.max_heat, "portfolio heat"),
        F.when(held("symbol") > limits.max_symbol_notional, "symbol notional"),
        F.when(held("sector") > limits.max_sector_notional, "sector notional")))
    return (c.withColumn("reasons", reasons).withColumn("ok", F.size("reasons") == 0)
            .drop("heat", "_symbol", "_sector", "_symbol_notional", "_sector_notional"))


def correlated_open_count(candidates: DataFrame, open_symbols: DataFrame, pairs: DataFrame, limits: RiskLimits = RiskLimits()) -> DataFrame:
    """Adds ``n_correlated`` and ``ok``: how many open symbols move with the candidate's.

    Starts from the listed pairs in both directions, so candidates never meet all open symbols.
    A symbol correlates with itself; an unlisted pair counts as zero.
    """
    strong = pairs.filter(F.col("rho") >= limits.rho).select(F.upper("a").alias("a"), F.upper("b").alias("b"))
    both = strong.union(strong.select("b", "a")).filter("a <> b").distinct()
    held = open_symbols.select(F.upper("symbol").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("k"))
    friends = both.join(held, "b").select("a", "k").unionByName(held.withColumnRenamed("b", "a"))
    counts = friends.groupBy("a").agg(F.sum("k").alias("n_correlated"))
    out = candidates.join(counts, F.upper("symbol") == F.col("a"), "left").drop("a")
    out = out.withColumn("n_correlated", F.coalesce("n_correlated", F.lit(0)).cast("long"))
    return out.withColumn("ok", F.col("n_correlated") < limits.max_correlated)


def return_correlation(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, rho, n) of simple returns for the pairs asked for, on their common bars."""
    w = Window.partitionBy("symbol", "session_date").orderBy("ts")
    ret = bars.select("symbol", "ts", (F.col("close") / F.lag("close").over(w) - 1.0).alias("ret")).filter("ret is not null")
    a = pairs.join(ret.select(F.col("symbol").alias("a"), "ts", F.col("ret").alias("ra")), "a")
    ab = a.join(ret.select(F.col("symbol").alias("b"), "ts", F.col("ret").alias("rb")), ["b", "ts"])
    return ab.groupBy("a", "b").agg(F.corr("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))


# fixed values: order types that protect a position
PROTECTIVE = ["SLM", "SL", "LIMIT"]


def reconcile(local: DataFrame, broker: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per symbol of either side: state, protection flag, and the halt flag of the whole set."""
    l = local.select(F.upper("symbol").alias("symbol")).distinct().withColumn("_l", F.lit(True))
    b = broker.filter("qty <> 0").select(F.upper("symbol").alias("symbol")).distinct().withColumn("_b", F.lit(True))
    o = orders.filter(F.upper("type").isin(PROTECTIVE)).select(F.upper("symbol").alias("symbol")).distinct().withColumn("_o", F.lit(True))
    df = l.join(b, "symbol", "full_outer").join(o, "symbol", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = F.when(has("_l") & has("_b"), "matched").when(has("_l"), "missing_broker").otherwise("orphan_broker")
    df = df.select("symbol", state.alias("state"), (has("_l") & has("_b") & ~has("_o")).alias("unprotected"))
    halt = df.agg(F.coalesce(F.bool_or((F.col("state") != "matched") | F.col("unprotected")), F.lit(False)).alias("halt"))
    return df.withColumn("halt", one_row(halt)["halt"])


def day_halt(trades: DataFrame, order: list[str], limits: DayLimits = DayLimits(), mode: str = "auto", **lanes) -> DataFrame:
    """Adds ``net``, ``streak``, ``halted`` and ``reason`` after each closed trade of its day.

    The first rule to trip halts the rest of the day: loss limit, profit target, losing streak.
    """
    lay = running(lay_out(loss_streak(trades, order, mode, **lanes), ["day"], order, mode=mode, **lanes),
                  sums={"net": F.col("pnl"), "_k": F.lit(1)})
    rule = F.lit(None).cast("string")
    if limits.max_loss_streak > 0:
        rule = F.when(F.col("streak") >= limits.max_loss_streak, "loss streak").otherwise(rule)
    if limits.profit_target > 0:
        rule = F.when(F.col("net") >= limits.profit_target, "profit target").otherwise(rule)
    if limits.max_loss > 0:
        rule = F.when(F.col("net") <= -limits.max_loss, "max loss").otherwise(rule)
    df = lay.finish(lay.df.withColumn("_rule", rule))
    first = df.filter("_rule is not null").groupBy("day").agg(F.min("_k").alias("_at"), F.min_by("_rule", "_k").alias("_why"))
    df = df.join(first, "day", "left")
    halted = F.coalesce(F.col("_k") >= F.col("_at"), F.lit(False))
    return df.withColumns({"halted": halted, "reason": F.when(halted, F.col("_why"))}).drop("_rule", "_k", "_at", "_why")


def blocked_by_cooldown(entries: DataFrame, exits: DataFrame, minutes: int = 30) -> DataFrame:
    """Adds ``cooling``: a losing exit of the symbol lies less than ``minutes`` back.

    Both sides are cut into slots of that length; a loss reaches its own slot and the next one,
    so the join is an equi-join and each slot keeps only its latest loss before the entry.
    """
    width = minutes * 60_000_000
    slot = lambda ts: F.floor(micros(ts) / F.lit(width)).cast("long")
    losses = exits.filter("pnl <= 0").select("symbol", micros("exit_time").alias("_x"), slot("exit_time").alias("_s"))
    # per slot: first and last loss; an entry is blocked by its own slot's losses before it or the last of the slot before
    near = losses.groupBy("symbol", "_s").agg(F.min("_x").alias("_first"), F.max("_x").alias("_last"))
    e = entries.withColumns({"_t": micros("entry_ts"), "_s": slot("entry_ts")})
    before = near.select("symbol", (F.col("_s") + 1).alias("_s"), F.col("_last").alias("_prev"))
    e = e.join(near.select("symbol", "_s", "_first"), ["symbol", "_s"], "left").join(before, ["symbol", "_s"], "left")
    hit = (F.col("_first") <= F.col("_t")) | (F.col("_t") < F.col("_prev") + width)
    return e.withColumn("cooling", F.coalesce(hit, F.lit(False))).drop("_t", "_s", "_first", "_prev")


def sliding_rate(events: DataFrame, key: str, id_col: str, seconds: int = 60, limit: int = 10, slot_seconds: int = 3600) -> DataFrame:
    """Adds ``recent`` (events of the key in the trailing window, itself included) and ``ok``.

    Time is cut into slots, at least as long as the window, and the events of the window before a slot are copied into it, so a
    busy key spreads over its slots and every frame still sees all of its events.
    """
    span = seconds * 1_000_000
    slot = max(slot_seconds * 1_000_000, span)
    t = events.withColumn("_t", micros("ts")).withColumn("_s", F.floor(F.col("_t") / F.lit(slot)).cast("long"))
    own = t.withColumn("_copy", F.lit(False))
    late = t.filter(F.col("_t") % slot >= slot - span).withColumns({"_s": F.col("_s") + 1, "_copy": F.lit(True)})
    w = Window.partitionBy(key, "_s").orderBy("_t").rangeBetween(-(span - 1), 0)
    df = own.unionByName(late).withColumn("recent", F.count(F.lit(1)).over(w)).filter("not _copy")
    return df.withColumn("ok", F.col("recent") <= limit).drop("_t", "_s", "_copy")


# fixed values: allowed steps of an order's life
TRANSITIONS = {
    "SIGNAL_CREATED": ["DECISION_APPROVED", "REJECTED"],
    "DECISION_APPROVED": ["ENTRY_SUBMITTED", "REJECTED"],
    "ENTRY_SUBMITTED": ["ENTRY_PARTIAL", "ENTRY_FILLED", "REJECTED", "RECONCILIATION_REQUIRED"],
    "ENTRY_PARTIAL": ["ENTRY_FILLED", "PROTECTION_PENDING", "RECONCILIATION_REQUIRED"],
    "ENTRY_FILLED": ["PROTECTION_PENDING", "RECONCILIATION_REQUIRED"],
    "PROTECTION_PENDING": ["PROTECTED", "RECONCILIATION_REQUIRED"],
    "PROTECTED": ["EXIT_SUBMITTED", "RECONCILIATION_REQUIRED"],
    "EXIT_SUBMITTED": ["CLOSED", "RECONCILIATION_REQUIRED"],
    "CLOSED": [],
    "REJECTED": [],
    "RECONCILIATION_REQUIRED": ["PROTECTED", "CLOSED", "REJECTED"],
}


def transition_audit(events: DataFrame, key: str, order: list[str], transitions: dict[str, list[str]] = TRANSITIONS,
                     mode: str = "auto", **lanes) -> DataFrame:
    """Rows (key, order, previous state, state) of steps that the table does not allow."""
    lay = lay_out(events, [key], order, back=1, mode=mode, **lanes)
    lay = lay.with_columns(prev_state=F.lag("state").over(lay.window()))
    step = F.concat_ws(">", "prev_state", "state")
    allowed = [f"{a}>{b}" for a, bs in transitions.items() for b in bs]
    return lay.finish(lay.df.filter(F.col("prev_state").isNotNull() & ~step.isin(allowed)))


def entry_block_reason(limits: DayLimits = DayLimits()) -> Column:
    """First rule that blocks an entry, null if none.

    Reads halted, opened_today, open_now, in_position and cooling of the row.
    """
    reason = F.when(F.col("halted"), "halted")
    if limits.max_trades > 0:
        reason = reason.when(F.col("opened_today") >= limits.max_trades, "daily trade cap")
    return (reason.when(F.col("open_now") >= limits.max_open, "max open positions").when(F.col("in_position"), "already in a position")
            .when(F.col("cooling"), "cooldown"))
