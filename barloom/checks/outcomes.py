"""Costs, sizing, barriers, exit plans and candidate outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import catalog
from barloom.checks import stand_ins as X
from barloom.checks.registry import Checks, rd, rds
from barloom.checks.signals import OR, SIGNALS
from barloom.checks.views_sql import with_views
from barloom.functions import trading as T
from barloom.operators import exits as E, levels as L, performance as PF
from barloom.operators.recursive import index_trend
from barloom.operators.rolling import atr_sma, session_vwap
from barloom.plans import outcomes as O

checks = Checks()

PNL = """((CASE WHEN {s} = 'BUY' THEN {x} * 0.9997 - {e} * 1.0003 ELSE {e} * 0.9997 - {x} * 1.0003 END) * {q}
  - ({e} + {x}) * {q} * 0.0006)"""


@checks.add("f1_net_pnl", with_views("positions") + f"""
SELECT decision_id, round({PNL.format(s='side', e='entry', x='entry * 1.0123', q='qty')}, 5) AS pnl_net,
  round((CASE WHEN side = 'BUY' THEN 1 ELSE -1 END) * entry * 0.0123 * qty - entry * 2.0123 * qty * 0.0006, 5) AS pnl_fills,
  round(round_even(entry * (CASE WHEN side = 'BUY' THEN 1.0003 ELSE 0.9997 END) / 0.05, 0) * 0.05, 2) AS entry_fill,
  round(round_even(entry * (CASE WHEN side = 'BUY' THEN 0.9997 ELSE 1.0003 END) / 0.05, 0) * 0.05, 2) AS exit_fill FROM positions""")
def _(spark, d):
    e, q, s = F.col("entry"), F.col("qty"), F.col("side")
    x = e * 1.0123
    return catalog.positions(spark, d).select(
        "decision_id", F.round(T.net_pnl(e, x, q, s), 5).alias("pnl_net"), F.round(T.net_pnl_at_fills(e, x, q, s), 5).alias("pnl_fills"),
        F.round(T.entry_fill(e, s), 2).alias("entry_fill"), F.round(T.exit_fill(e, s), 2).alias("exit_fill"))


DIST = "greatest(entry * 0.003, least(CASE WHEN atr > 0 THEN {m} * atr ELSE 0.005 * entry END, entry * 0.015))"


@checks.add("f2_sl_target", with_views("positions", p="""
  SELECT *, CASE WHEN decision_id % 7 <> 0 THEN abs(entry - sl) * (decision_id % 5) / 3 END AS atr, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS d,
    CASE WHEN decision_id % 4 = 0 THEN 1.25 END AS ps, CASE WHEN decision_id % 4 = 0 THEN 3.5 END AS pt, (decision_id % 20) / 10.0::DOUBLE AS w FROM positions""", q=f"""
  SELECT *, {DIST.format(m='coalesce(ps, 1.5)')} AS dist, coalesce(pt / ps, 2.0) AS rr FROM p""") + """
SELECT decision_id, round(entry - d * dist, 6) AS sl, round(entry + d * rr * dist, 6) AS tgt, round(dist, 6) AS dist,
  greatest(0, least(floor(500 * least(greatest(w, 0.4), 1.5) / dist), floor(25000 / entry)))::BIGINT AS qty FROM q""")
def _(spark, d):
    k, e = F.col("decision_id"), F.col("entry")
    p = catalog.positions(spark, d).withColumns({
        "atr": F.when(k % 7 != 0, F.abs(e - F.col("sl")) * (k % 5) / 3), "d": F.when(F.col("side") == "BUY", 1).otherwise(-1),
        "ps": F.when(k % 4 == 0, 1.25), "pt": F.when(k % 4 == 0, 3.5), "w": (k % 20) / 10.0}).drop("sl", "qty")
    x = T.sl_target(e, F.col("d"), F.col("atr"), X.EXITS, pick_sl=F.col("ps"), pick_tgt=F.col("pt"))
    p = p.withColumn("x", x).select("*", "x.*")
    return p.select("decision_id", *rds("sl", "tgt", "dist"), T.position_size(e, F.col("dist"), X.EXITS, F.col("w")).alias("qty"))


@checks.add("f9_forecast_exit_adjust", with_views("positions", p="""
  SELECT decision_id, entry, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS d, abs(entry - sl) AS dist, entry + (entry - sl) * 2 AS tgt,
    CASE WHEN decision_id % 6 <> 0 THEN (decision_id % 13) / 20.0::DOUBLE END AS vol,
    CASE WHEN decision_id % 6 <> 0 THEN (decision_id % 9 - 4) / 3.0::DOUBLE END AS er FROM positions""", q="""
  SELECT *, dist * CASE WHEN vol IS NULL OR vol <= 0 THEN 1 ELSE least(greatest(vol / 0.3, 0.7), 1.6) END AS nd, entry * abs(er) / 100 * 0.9 AS mv FROM p""") + """
SELECT decision_id, round(CASE WHEN er IS NULL THEN dist ELSE nd END, 6) AS dist,
  round(CASE WHEN er IS NOT NULL AND sign(er) = d AND mv < abs(tgt - entry) THEN entry + d * greatest(mv, 1.2 * nd) ELSE tgt END, 6) AS target FROM q""")
def _(spark, d):
    k, e = F.col("decision_id"), F.col("entry")
    p = catalog.positions(spark, d)
    dr = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    x = T.forecast_exit_adjust(e, dr, F.abs(e - F.col("sl")), e + (e - F.col("sl")) * 2, F.when(k % 6 != 0, (k % 13) / 20.0),
                               F.when(k % 6 != 0, (k % 9 - 4) / 3.0), decimals=None)
    return p.select("decision_id", x.alias("x")).select("decision_id", F.round("x.dist", 6).alias("dist"), F.round("x.target", 6).alias("target"))


PLANS = """SELECT decision_id, entry, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS d, qty,
    CASE decision_id % 10 WHEN 0 THEN NULL WHEN 1 THEN entry + (entry - sl) WHEN 2 THEN entry + (sl - entry) * 2 ELSE sl END AS stop,
    CASE decision_id % 12 WHEN 0 THEN sl WHEN 1 THEN entry + (entry - sl) * 1.1 ELSE entry + (entry - sl) * 2 END AS tgt FROM positions"""


@checks.add("p16_validate_exit_plan", with_views("positions", p=PLANS) + """
SELECT decision_id, CASE WHEN stop IS NULL THEN 'NON_FINITE_VALUE' WHEN (entry - stop) * d <= 0 THEN 'SL_WRONG_SIDE'
  WHEN (tgt - entry) * d <= 0 THEN 'TGT_WRONG_SIDE' WHEN abs(entry - stop) / entry < 0.003 OR abs(entry - stop) / entry > 0.015 THEN 'SL_DISTANCE_OUT_OF_LIMITS'
  WHEN abs(tgt - entry) / abs(entry - stop) < 1.2 THEN 'RR_BELOW_MIN' WHEN qty <= 0 THEN 'QTY_ZERO'
  WHEN abs(entry - stop) * qty > 20 + 1e-6 THEN 'MAX_RISK_EXCEEDED' ELSE 'PLAN_VALID' END AS code FROM p""")
def _(spark, d):
    k, e, s = F.col("decision_id"), F.col("entry"), F.col("sl")
    p = catalog.positions(spark, d).withColumns({
        "stop": F.when(k % 10 == 0, F.lit(None)).when(k % 10 == 1, e + (e - s)).when(k % 10 == 2, e + (s - e) * 2).otherwise(s),
        "tgt": F.when(k % 12 == 0, s).when(k % 12 == 1, e + (e - s) * 1.1).otherwise(e + (e - s) * 2)})
    code = E.validate_exit_plan(e, F.col("stop"), F.col("tgt"), F.when(F.col("side") == "BUY", 1).otherwise(-1), F.col("qty"),
                                X.EXITS.with_(risk_budget=20.0))
    return p.select("decision_id", code.alias("code"))


@checks.add("f10_exit_policy", with_views("positions", p="""
  SELECT decision_id AS k, entry AS e, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS d, abs(entry - sl) AS a, sl, decision_id % 11 AS m, decision_id % 3 AS r FROM positions""", q="""
  SELECT *, CASE WHEN m IN (0, 1, 2) THEN CASE m WHEN 2 THEN e + (e - sl) ELSE sl END END AS ssl, CASE WHEN m IN (0, 1, 2) THEN e + (e - sl) * 1.8 END AS stg,
    CASE WHEN m IN (2, 3) THEN e - d * a * 0.9 END AS tsl, CASE WHEN m IN (2, 3) THEN e + d * a * 1.5 END AS ttg,
    CASE WHEN r = 0 THEN e - d * 1.25 * a END AS rs, CASE WHEN r = 0 THEN e + d * 2.5 * a END AS rt,
    CASE WHEN r = 0 AND m % 2 = 0 THEN 'ACCEPTED' WHEN r = 1 THEN 'LOW_CONFIDENCE' END AS st,
    CASE WHEN m % 4 = 1 THEN e + d * a * 1.3 END AS ft FROM p""", c="""
  SELECT *, coalesce(st = 'ACCEPTED', false) AS acc, coalesce((e - ssl) * d > 0 AND (stg - e) * d > 0, false) AS so, coalesce((e - tsl) * d > 0, false) AS too FROM q""", f="""
  SELECT *, CASE WHEN so THEN 'structure' WHEN too THEN 'strategy' ELSE 'atr' END AS base,
    CASE WHEN acc THEN rs WHEN so THEN ssl WHEN too THEN tsl ELSE e - d * 1.5 * a END AS stop,
    CASE WHEN acc THEN rt WHEN so THEN stg WHEN too THEN ttg ELSE e + d * 3 * a END AS t0 FROM c""", g="""
  SELECT *, CASE WHEN abs(ft - e) < abs(t0 - e) THEN e + d * greatest(abs(ft - e), 1.2 * abs(e - stop)) ELSE t0 END AS target,
    coalesce(abs(ft - e) < abs(t0 - e), false) AS pull FROM f""", v="""
  SELECT *, abs(e - stop) / e BETWEEN 0.003 AND 0.015 AND (target - e) * d > 0 AND abs(target - e) / abs(e - stop) >= 1.2 AS ok FROM g""") + """
SELECT k AS decision_id, ok AS valid, CASE WHEN ok THEN CASE WHEN acc THEN 'rr_model' ELSE base END ELSE 'none' END AS source,
  round(CASE WHEN ok THEN stop END, 6) AS stop, round(CASE WHEN ok THEN target END, 6) AS target,
  CASE WHEN NOT ok THEN CASE WHEN abs(e - stop) / e NOT BETWEEN 0.003 AND 0.015 THEN 'SL_DISTANCE_OUT_OF_LIMITS' ELSE 'RR_BELOW_MIN' END
  ELSE array_to_string(list_filter([CASE WHEN acc THEN 'RR_ACCEPTED' END, CASE WHEN acc THEN 'EXIT_RR_USED' END,
    CASE WHEN NOT acc THEN CASE base WHEN 'structure' THEN 'EXIT_STRUCTURE_USED' WHEN 'strategy' THEN 'EXIT_STRATEGY_USED' ELSE 'EXIT_ATR_FALLBACK' END END,
    CASE WHEN NOT acc AND st = 'LOW_CONFIDENCE' THEN 'RR_FALLBACK' END, CASE WHEN pull THEN 'FORECAST_CONSTRAINT_APPLIED' ELSE 'FORECAST_NO_VIEW' END,
    CASE WHEN acc AND pull THEN 'FORECAST_SKIPPED_RR_OWNS_EXIT' END, 'PLAN_VALID'], lambda x: x IS NOT NULL), '|') END AS reasons,
  CASE WHEN acc THEN base WHEN rs IS NOT NULL THEN 'rr_model' ELSE '' END AS rejected FROM v""")
def _(spark, d):
    k, e, sl = F.col("decision_id"), F.col("entry"), F.col("sl")
    m, r = k % 11, k % 3
    dr = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    a = F.abs(e - sl)
    p = catalog.positions(spark, d).select(
        "decision_id", "entry", dr.alias("direction"), a.alias("atr"), F.lit(None).cast("long").alias("qty"),
        F.when(m.isin(0, 1), sl).when(m == 2, e + (e - sl)).alias("struct_sl"), F.when(m.isin(0, 1, 2), e + (e - sl) * 1.8).alias("struct_tgt"),
        F.when(m.isin(2, 3), e - dr * a * 0.9).alias("strat_sl"), F.when(m.isin(2, 3), e + dr * a * 1.5).alias("strat_tgt"),
        F.when(r == 0, 1.25).alias("rr_sl"), F.when(r == 0, 2.5).alias("rr_tgt"),
        F.when((r == 0) & (m % 2 == 0), "ACCEPTED").when(r == 1, "LOW_CONFIDENCE").alias("rr_status"),
        F.when(m % 4 == 1, e + dr * a * 1.3).alias("forecast_target"))
    out = E.exit_policy(p, X.EXITS, decimals=None)
    return out.select("decision_id", "valid", "source", *rds("stop", "target"), F.array_join("reasons", "|").alias("reasons"),
                      F.array_join("rejected", "|").alias("rejected"))


NEXT = """SELECT *, lead(ts) OVER w AS entry_ts, lead(open) OVER w AS entry_price FROM bars
  WINDOW w AS (PARTITION BY symbol, session_date ORDER BY ts)"""


@checks.add("j6_next_bar_entry", with_views("bars", n=NEXT) + """
SELECT symbol, ts, entry_ts, round(entry_price, 6) AS entry_price FROM n WHERE entry_ts IS NOT NULL""")
def _(spark, d):
    return E.next_bar_entry(catalog.bars(spark, d)).filter("entry_ts is not null").select("symbol", "ts", "entry_ts", rd("entry_price"))


# both sides on every bar with a next bar, barriers at a share of the entry
BOTH = """SELECT symbol, session_date, ts, entry_ts, entry_price, side, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS d,
    entry_price * (1 - CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * 0.006) AS sl, entry_price * (1 + CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * 0.009) AS tgt
  FROM n, (SELECT unnest(['BUY', 'SELL']) AS side) WHERE entry_ts IS NOT NULL"""


def both_sides(spark, d):
    n = E.next_bar_entry(catalog.bars(spark, d)).filter("entry_ts is not null")
    n = n.withColumn("side", F.explode(F.array(F.lit("BUY"), F.lit("SELL")))).withColumn("d", F.when(F.col("side") == "BUY", 1).otherwise(-1))
    e = F.col("entry_price")
    return n.select("symbol", "session_date", "ts", "entry_ts", "entry_price", "side", (e * (1 - F.col("d") * 0.006)).alias("sl"),
                    (e * (1 + F.col("d") * 0.009)).alias("tgt"))


def touch_sql(cand: str, same_day: bool = True, first: str = "SL", horizon: int | None = None, square: bool = True, end: str = "EOD_FORCED",
              more: str = "") -> str:
    """Range-join form of the first-touch exit: the first bar that ends the trade, else the last bar."""
    stop = "CASE WHEN side = 'BUY' THEN b.low <= sl ELSE b.high >= sl END"
    goal = "CASE WHEN side = 'BUY' THEN b.high >= tgt ELSE b.low <= tgt END"
    order = [(stop, "sl", "SL"), (goal, "tgt", "TARGET")]
    order = order if first == "SL" else order[::-1]
    sq = [("hour(b.ts) >= 22", "b.close", "SQUAREOFF")] if square else []
    kind = " ".join(f"WHEN {c} THEN '{n}'" for c, _, n in sq + order)
    px = " ".join(f"WHEN {c} THEN {p}" for c, p, _ in sq + order)
    day = "AND c.session_date = b.session_date" if same_day else ""
    lim = f"QUALIFY row_number() OVER (PARTITION BY c.symbol, c.side, c.entry_ts ORDER BY b.ts) <= {horizon}" if horizon else ""
    return f"""SELECT {cand}.*, coalesce(t.x.ts, t.z.ts) AS exit_ts, coalesce(t.x.px, t.z.px) AS exit_price, coalesce(t.x.kind, '{end}') AS outcome
    FROM {cand} JOIN (SELECT symbol, side, entry_ts{more}, arg_min({{'ts': bts, 'px': px, 'kind': kind}}, bts) FILTER (kind IS NOT NULL) AS x,
        arg_max({{'ts': bts, 'px': close}}, bts) AS z FROM
      (SELECT c.symbol, c.side, c.entry_ts{more}, b.ts AS bts, b.close, CASE {kind} END AS kind, CASE {px} END AS px
       FROM {cand} c JOIN bars b ON c.symbol = b.symbol {day} AND b.ts >= c.entry_ts {lim}) GROUP BY ALL) t USING (symbol, side, entry_ts{more})"""


EXIT_OUT = "symbol, side, entry_ts, exit_ts, round(exit_price, 6) AS exit_price, outcome"


@checks.add("j7_first_touch_exit", with_views("bars", n=NEXT, c=BOTH, x=touch_sql("c")) + f"SELECT {EXIT_OUT} FROM x")
def _(spark, d):
    out = E.first_touch_exit(both_sides(spark, d), catalog.bars(spark, d), X.CLOCK)
    return out.select("symbol", "side", "entry_ts", "exit_ts", rd("exit_price"), "outcome")


@checks.add("j7_first_touch_optimistic", with_views("bars", n=NEXT, c=BOTH, x=touch_sql("c", first="TARGET", horizon=6, square=False)) + f"SELECT {EXIT_OUT} FROM x")
def _(spark, d):
    out = E.first_touch_exit(both_sides(spark, d), catalog.bars(spark, d), X.CLOCK, optimistic=True, horizon=6, square_off=False)
    return out.select("symbol", "side", "entry_ts", "exit_ts", rd("exit_price"), "outcome")


# wide barriers and entries late in the day make positions that outlive their session
LATE = """SELECT symbol, session_date, ts, entry_ts, entry_price, 'BUY' AS side, entry_price * 0.97 AS sl, entry_price * 1.03 AS tgt FROM n WHERE entry_ts IS NOT NULL"""


@checks.add("j7_first_touch_carry", with_views("bars", n=NEXT, c=LATE, x=touch_sql("c", same_day=False)) + f"SELECT {EXIT_OUT} FROM x")
def _(spark, d):
    n = E.next_bar_entry(catalog.bars(spark, d)).filter("entry_ts is not null")
    e = F.col("entry_price")
    c = n.select("symbol", "session_date", "ts", "entry_ts", "entry_price", F.lit("BUY").alias("side"), (e * 0.97).alias("sl"), (e * 1.03).alias("tgt"))
    out = E.first_touch_exit(c, catalog.bars(spark, d), X.CLOCK, carry=True)
    return out.select("symbol", "side", "entry_ts", "exit_ts", rd("exit_price"), "outcome")


@checks.add("j7_first_touch_carry_copies", with_views("bars", n=NEXT, c=LATE, x=touch_sql("c", same_day=False)) + f"SELECT {EXIT_OUT} FROM x, range(2)")
def _(spark, d):
    n = E.next_bar_entry(catalog.bars(spark, d)).filter("entry_ts is not null")
    e = F.col("entry_price")
    c = n.select("symbol", "session_date", "ts", "entry_ts", "entry_price", F.lit("BUY").alias("side"), (e * 0.97).alias("sl"), (e * 1.03).alias("tgt"))
    out = E.first_touch_exit(c.unionByName(c), catalog.bars(spark, d), X.CLOCK, carry=True)
    return out.select("symbol", "side", "entry_ts", "exit_ts", rd("exit_price"), "outcome")


@checks.add("w40_excursion_peak", with_views("bars", n=NEXT, c=BOTH, x=touch_sql("c")) + """
SELECT x.symbol, x.side, x.entry_ts, round(greatest(max(CASE WHEN side = 'BUY' THEN b.high - entry_price ELSE entry_price - b.low END), 0), 6) AS best_fav
FROM x JOIN bars b ON x.symbol = b.symbol AND b.ts BETWEEN x.entry_ts AND x.exit_ts GROUP BY 1, 2, 3""")
def _(spark, d):
    b = catalog.bars(spark, d)
    return E.excursion_peak(E.first_touch_exit(both_sides(spark, d), b, X.CLOCK), b).select("symbol", "side", "entry_ts", rd("best_fav"))


def resolve_sql(cand: str, more: str = "") -> dict[str, str]:
    """Sizing, barriers and P&L of entries with columns d, atr, entry_price and side."""
    dist = DIST.format(m="1.5").replace("entry", "entry_price")
    return {"sz": f"""SELECT * FROM (SELECT *, entry_price - d * dist AS sl, entry_price + d * 2 * dist AS tgt,
        greatest(0, least(floor(500 / dist), floor(25000 / entry_price)))::BIGINT AS qty FROM (SELECT *, {dist} AS dist FROM {cand})) WHERE qty > 0""",
            "rx": touch_sql("sz", more=more),
            "res": f"SELECT *, pnl_net / greatest(dist * qty, 1e-9) AS r_multiple FROM (SELECT *, {PNL.format(s='side', e='entry_price', x='exit_price', q='qty')} AS pnl_net FROM rx)"}


ENT = """SELECT s.*, direction AS d, n.entry_ts, n.entry_price FROM signals s JOIN n USING (symbol, session_date, ts)
  WHERE n.entry_ts IS NOT NULL AND hour(s.ts) * 60 + minute(s.ts) BETWEEN 180 AND 1200"""
R2 = dict(**SIGNALS, n=NEXT, ent=ENT, **resolve_sql("ent", ", strategy"))


@checks.add("r2_candidate_outcomes", with_views("bars", recursive=True, **R2) + """
SELECT symbol, ts, strategy, side, entry_ts, exit_ts, outcome, qty, round(sl, 6) AS sl, round(tgt, 6) AS tgt, round(pnl_net, 4) AS pnl_net,
  round(r_multiple, 5) AS r_multiple FROM res""")
def _(spark, d):
    out = O.candidate_outcomes(O.in_scan_window(X.signals(spark, d), X.CLOCK), catalog.bars(spark, d), X.CLOCK, X.EXITS)
    return out.select("symbol", "ts", "strategy", "side", "entry_ts", "exit_ts", "outcome", "qty", *rds("sl", "tgt"), rd("pnl_net", 4),
                      rd("r_multiple", 5))


# flagship: VWAP side, ATR from a simple mean, opening-range breakout, next open, barriers, costs, summary
BRK = f"""SELECT *, lag(close) OVER s AS pc, sum((high + low + close) / 3 * volume) OVER s / sum(volume) OVER s AS vwap,
    CASE WHEN count(*) OVER a >= 5 THEN avg(tr) OVER a END AS atr, lead(ts) OVER s AS entry_ts, lead(open) OVER s AS entry_price, hour(ts) * 60 + minute(ts) AS m
  FROM (SELECT *, greatest(high - low, abs(high - p), abs(low - p)) AS tr FROM
    (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol, session_date ORDER BY ts), close) AS p FROM o))
  WINDOW s AS (PARTITION BY symbol, session_date ORDER BY ts), a AS (PARTITION BY symbol, session_date ORDER BY ts ROWS 4 PRECEDING)"""
BRKC = """SELECT symbol, session_date, ts, entry_ts, entry_price, atr, CASE WHEN close > or_high THEN 'BUY' ELSE 'SELL' END AS side,
    CASE WHEN close > or_high THEN 1 ELSE -1 END AS d FROM bk
  WHERE m >= 180 AND m < 840 AND entry_ts IS NOT NULL AND ((close > or_high AND pc <= or_high AND close > vwap) OR (close < or_low AND pc >= or_low AND close < vwap))"""


def breakout_trades(spark, d):
    from barloom.operators.clean import within
    from barloom.operators.patterns import crossings

    bars = catalog.bars(spark, d)
    lay = L.session_layout(session_vwap(L.opening_range(bars, X.CLOCK), ["symbol"]))
    lay = atr_sma(lay, 5)
    above, below = crossings(lay)
    lay = lay.with_columns(up=above & (F.col("close") > F.col("vwap")), down=below & (F.col("close") < F.col("vwap")))
    sig = E.next_bar_entry(lay.df).filter("(up or down) and entry_ts is not null").filter(within("ts", X.CLOCK.breakout_entry))
    sig = sig.select("symbol", "session_date", "ts", "entry_ts", "entry_price", F.col("atr_sma").alias("atr"),
                     F.when(F.col("up"), "BUY").otherwise("SELL").alias("side"), F.when(F.col("up"), 1).otherwise(-1).alias("direction"))
    return O.size_and_resolve(sig, bars, X.CLOCK, X.EXITS)


SUMMARY = """count(*) AS trades, count(*) FILTER ({p} > 0) AS wins, count(*) FILTER ({p} <= 0) AS losses,
  round(100.0 * count(*) FILTER ({p} > 0) / count(*), 6) AS win_rate,
  round(least(CASE WHEN sum({p}) FILTER ({p} <= 0) < 0 THEN coalesce(sum({p}) FILTER ({p} > 0), 0) / -sum({p}) FILTER ({p} <= 0) ELSE 999 END, 999), 6) AS profit_factor,
  round(avg({r}), 6) AS expectancy_r, round(avg({p}), 4) AS expectancy, round(sum({p}), 4) AS total_pnl, round(sum({p}) / 100000 * 100, 6) AS return_pct"""


@checks.add("breakout_report", with_views("bars", o=OR, bk=BRK, bc=BRKC, **resolve_sql("bc")) + f"""
SELECT symbol, {SUMMARY.format(p='pnl_net', r='r_multiple')} FROM res GROUP BY 1""")
def _(spark, d):
    return PF.trade_summary(breakout_trades(spark, d), ["symbol"], pnl="pnl_net", r="r_multiple").select(
        "symbol", "trades", "wins", "losses", *rds("win_rate", "profit_factor", "expectancy_r"), rd("expectancy", 4), rd("total_pnl", 4), rd("return_pct"))
