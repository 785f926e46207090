"""Performance, ledger, risk and audit operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import catalog
from barloom.checks.outcomes import PNL, SUMMARY
from barloom.checks.registry import Checks, rd, rds, sql_rd
from barloom.checks.views_sql import with_views
from barloom.functions import trading as T
from barloom.operators import audit as A, ledger as G, lookups as K, performance as P, risk as R
from barloom.operators.layout import lay_out, running
from barloom.spec import CostSpec, DayLimits, RiskLimits

checks = Checks()
ORDER = ["exit_time", "trade_id"]


@checks.add("d3_trade_summary", with_views("trades") + f"SELECT {SUMMARY.format(p='pnl', r='r')} FROM trades")
def _(spark, d):
    return P.trade_summary(catalog.trades(spark, d)).select(
        "trades", "wins", "losses", *rds("win_rate", "profit_factor", "expectancy_r"), rd("expectancy", 4), rd("total_pnl", 4), rd("return_pct"))


DAYS = """SELECT day, pnl, 100000 + sum(pnl) OVER (ORDER BY day) AS equity FROM (SELECT exit_time::DATE AS day, sum(pnl) AS pnl FROM trades GROUP BY 1)"""


@checks.add("d4_sharpe_from_equity", with_views("trades", e=DAYS, c="SELECT equity / lag(equity) OVER (ORDER BY day) - 1 AS c FROM e") + """
SELECT round(avg(c) / stddev_samp(c) * sqrt(252), 6) AS sharpe_annual FROM c""")
def _(spark, d):
    return P.sharpe_from_equity(catalog.trades(spark, d)).select(rd("sharpe_annual"))


@checks.add("d5_by_pattern", with_views("trades") + """
SELECT strategy, count(*) AS count, round(sum(pnl), 4) AS sum, round(avg(pnl), 6) AS mean FROM trades GROUP BY 1""")
def _(spark, d):
    return P.by_group(catalog.trades(spark, d), "strategy").select("strategy", "count", rd("sum", 4), rd("mean"))


@checks.add("d6_by_outcome", with_views("trades") + "SELECT outcome, count(*) AS count FROM trades GROUP BY 1")
def _(spark, d):
    return P.by_outcome(catalog.trades(spark, d))


CURVE = "SELECT *, 100000 + sum(pnl) OVER (ORDER BY exit_time, trade_id) AS equity FROM trades"
DDOWN = "SELECT *, max(equity) OVER (ORDER BY exit_time, trade_id) AS peak FROM curve"


@checks.add("w24_equity_curve", with_views("trades", curve=CURVE) + "SELECT trade_id, round(equity, 4) AS equity FROM curve")
def _(spark, d):
    return P.equity_curve(catalog.trades(spark, d), ORDER).select("trade_id", rd("equity", 4))


@checks.add("w23_drawdown", with_views("trades", curve=CURVE, dd=DDOWN) + """
SELECT trade_id, round(peak, 4) AS peak, round((peak - equity) / peak, 6) AS drawdown FROM dd""")
def _(spark, d):
    curve = P.equity_curve(catalog.trades(spark, d), ORDER)
    return P.drawdown(curve, ORDER).select("trade_id", rd("peak", 4), rd("drawdown"))


METRICS = ["total_pnl", "win_rate", "profit_factor", "avg_pnl", "per_trade_sharpe", "max_dd_pct"]


@checks.add("d8_equity_metrics", with_views("trades", curve=CURVE, dd=DDOWN) + """
SELECT round(sum(pnl), 4) AS total_pnl, round(100.0 * count(*) FILTER (pnl > 0) / count(*), 6) AS win_rate,
  round(least(sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl <= 0), 999), 6) AS profit_factor, round(avg(pnl), 6) AS avg_pnl,
  round(avg(pnl) / stddev_samp(pnl), 6) AS per_trade_sharpe, round(max((peak - equity) / peak) * 100, 6) AS max_dd_pct FROM dd""")
def _(spark, d):
    return P.equity_metrics(catalog.trades(spark, d), ORDER).select(rd("total_pnl", 4), *rds(*METRICS[1:]))


# one row per symbol stands for one resample
PER = "SELECT symbol, sum(pnl) AS total_pnl, avg(pnl) AS avg_pnl, count(*) FILTER (pnl > 0) * 100.0 / count(*) AS win_rate FROM trades GROUP BY 1"
PM = ["total_pnl", "avg_pnl", "win_rate"]


def per_symbol(spark, d):
    p = F.col("pnl")
    return catalog.trades(spark, d).groupBy("symbol").agg(
        F.sum(p).alias("total_pnl"), F.avg(p).alias("avg_pnl"), (F.count(F.when(p > 0, 1)) / F.count(F.lit(1)) * 100).alias("win_rate"))


@checks.add("d9_percentile_table", with_views("trades", per=PER) + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(quantile_cont({m}, 0.05), 5) AS p05, round(quantile_cont({m}, 0.5), 5) AS p50, round(quantile_cont({m}, 0.95), 5) AS p95 FROM per"
    for m in PM))
def _(spark, d):
    return P.percentile_table(per_symbol(spark, d), PM).select("metric", *rds("p05", "p50", "p95", digits=5))


@checks.add("d10_observed_rank", with_views("trades", per=PER, o="SELECT sum(pnl) / 50 AS total_pnl, avg(pnl) * 1.5 AS avg_pnl, 30.0::DOUBLE AS win_rate FROM trades") + " UNION ALL ".join(
    f"""SELECT '{m}' AS metric, round(avg((per.{m} < o.{m})::INT) * 100, 6) AS below_pct, round(avg((per.{m} >= o.{m})::INT), 6) AS p_value,
      CASE WHEN avg((per.{m} >= o.{m})::INT) < 0.05 THEN 'SIGNIFICANT' WHEN avg((per.{m} >= o.{m})::INT) < 0.2 THEN 'MARGINAL' ELSE 'NO_EDGE' END AS verdict FROM per, o"""
    for m in PM))
def _(spark, d):
    obs = catalog.trades(spark, d).agg((F.sum("pnl") / 50).alias("total_pnl"), (F.avg("pnl") * 1.5).alias("avg_pnl"), F.lit(30.0).alias("win_rate"))
    return P.observed_rank(per_symbol(spark, d), obs, PM).select("metric", *rds("below_pct", "p_value"), "verdict")


RETS = "SELECT day, pnl, equity, (equity - coalesce(lag(equity) OVER (ORDER BY day), 100000)) / coalesce(lag(equity) OVER (ORDER BY day), 100000) AS ret FROM e"


@checks.add("d12_daily_returns", with_views("trades", e=DAYS, rets=RETS) + """
SELECT day, round(pnl, 4) AS pnl, round(equity, 4) AS equity, round(ret, 8) AS ret FROM rets""")
def _(spark, d):
    return P.daily_equity(catalog.trades(spark, d)).select("day", rd("pnl", 4), rd("equity", 4), rd("ret", 8))


SHEET = """count(*) AS days, round((exp(sum(ln(1 + ret))) - 1) * 100, 6) AS total_return, round(avg(ret) * 25200, 6) AS annual_return,
  round(stddev_samp(ret) * sqrt(252) * 100, 6) AS annual_vol, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) AS sharpe,
  round(min(dd) * 100, 6) AS max_drawdown, round(avg((ret > 0)::INT) * 100, 6) AS win_days"""
SHEET_OUT = ["days", "total_return", "annual_return", "annual_vol", "sharpe", "max_drawdown", "win_days"]


@checks.add("d13_tear_sheet", with_views("trades", e=DAYS, rets=RETS, c="""
  SELECT *, exp(sum(ln(1 + ret)) OVER (ORDER BY day)) AS curve FROM rets""", f="""
  SELECT *, curve / max(curve) OVER (ORDER BY day) - 1 AS dd FROM c""") + f"SELECT {SHEET} FROM f")
def _(spark, d):
    return P.tear_sheet(P.daily_equity(catalog.trades(spark, d))).select("days", *rds(*SHEET_OUT[1:]))


@checks.add("d20_cohort_split", with_views("trades", g="""
  SELECT CASE WHEN tag = '' THEN 'UNSET' ELSE 'SET' END AS cohort, exit_time::DATE AS day, sum(pnl) AS pnl FROM trades GROUP BY 1, 2""", e="""
  SELECT *, 100000 + sum(pnl) OVER w AS equity FROM g WINDOW w AS (PARTITION BY cohort ORDER BY day)""", rets="""
  SELECT *, (equity - coalesce(lag(equity) OVER w, 100000)) / coalesce(lag(equity) OVER w, 100000) AS ret FROM e WINDOW w AS (PARTITION BY cohort ORDER BY day)""", c="""
  SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY cohort ORDER BY day)) AS curve FROM rets""", f="""
  SELECT *, curve / max(curve) OVER (PARTITION BY cohort ORDER BY day) - 1 AS dd FROM c""") + f"SELECT cohort, {SHEET} FROM f GROUP BY 1")
def _(spark, d):
    t = catalog.trades(spark, d).withColumn("cohort", P.cohort(F.col("tag")))
    return P.tear_sheet(P.daily_equity(t, by=["cohort"]), ["cohort"]).select("cohort", "days", *rds(*SHEET_OUT[1:]))


# order-based trades span several years
OT = """SELECT o_orderdate AS exit_time, (o_totalprice - 250000) / 100000 * 1.0471975511965976::DOUBLE AS pnl FROM orders"""


@checks.add("d27_monthly_returns", with_views(trades=OT, e=DAYS, rets=RETS, g="""
  SELECT year(day)::INT AS year, month(day) AS m, exp(sum(ln(1 + ret))) - 1 AS r FROM rets GROUP BY 1, 2""", s="""
  SELECT year(day)::INT AS year, round(avg(ret) / sqrt(avg(pow(least(ret, 0), 2))) * sqrt(252), 5) AS sortino FROM rets GROUP BY 1""") + f"""
SELECT year, {', '.join(f"round(max(r) FILTER (m = {m}), 8) AS m{m:02d}" for m in range(1, 13))}, any_value(sortino) AS sortino FROM g JOIN s USING (year) GROUP BY 1""")
def _(spark, d):
    t = catalog.table(spark, d, "orders").select(F.col("o_orderdate").alias("exit_time"),
                                                 ((F.col("o_totalprice") - 250000) / 100000 * catalog.SCALE).alias("pnl"))
    grid = P.monthly_returns(P.daily_equity(t))
    return grid.select("year", *[rd(f"m{m:02d}", 8) for m in range(1, 13)], rd("sortino", 5))


# ---- ledger --------------------------------------------------------------------------------
LAB = """CASE WHEN lower(tag) LIKE '%disagree%' THEN 'disagree' WHEN lower(tag) LIKE '%agree%' THEN 'agree' ELSE 'na' END"""


@checks.add("f19_label_tags", with_views("trades") + f"SELECT trade_id, {LAB} AS label, hour(exit_time)::INT AS hour FROM trades")
def _(spark, d):
    return catalog.trades(spark, d).select("trade_id", G.label_tag(F.col("tag")).alias("label"),
                                           G.hour_of_text(F.date_format("exit_time", "HH:mm:ss")).alias("hour"))


def lstats(prefix: str, cond: str) -> str:
    f = f"FILTER ({cond})"
    return f"""count(*) {f} AS {prefix}n, round(coalesce(100.0 * count(*) FILTER ({cond} AND pnl > 0) / nullif(count(*) {f}, 0), 0), 6) AS {prefix}wr,
      round(coalesce(avg(pnl) {f}, 0), 6) AS {prefix}expectancy,
      round(CASE WHEN coalesce(sum(pnl) FILTER ({cond} AND pnl <= 0), 0) < 0
        THEN least(coalesce(sum(pnl) FILTER ({cond} AND pnl > 0), 0) / -sum(pnl) FILTER ({cond} AND pnl <= 0), 999)
        WHEN coalesce(sum(pnl) FILTER ({cond} AND pnl > 0), 0) > 0 THEN 999 ELSE 0 END, 6) AS {prefix}pf, round(coalesce(sum(pnl) {f}, 0), 4) AS {prefix}net"""


RECENT = f"SELECT *, {LAB} AS label FROM trades QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY exit_time DESC, trade_id DESC) <= 40"
LSTAT = f"""SELECT strategy, {lstats('', 'true')}, {lstats('agree_', "label = 'agree'")}, {lstats('na_', "label = 'na'")}, count(*) >= 12 AS trusted FROM recent GROUP BY 1"""


@checks.add("d7_ledger_stats", with_views("trades", recent=RECENT) + LSTAT)
def _(spark, d):
    s = G.ledger_stats(catalog.trades(spark, d), ORDER)
    cols = []
    for pre in ("", "agree_", "na_"):
        cols += [F.col(f"{pre}n"), *rds(f"{pre}wr", f"{pre}expectancy", f"{pre}pf"), rd(f"{pre}net", 4)]
    return s.select("strategy", *cols, "trusted")


@checks.add("f13_health_weight", with_views("trades", recent=RECENT, st=LSTAT, h="""
  SELECT strategy, CASE WHEN trusted THEN tanh(expectancy / 150) + 0.5 * tanh(pf - 1) + (wr - 50) / 100 ELSE 0 END AS health,
    CASE WHEN strategy <> 'view' THEN 0.5 + length(strategy) / 10.0::DOUBLE ELSE 1.0 END AS prev FROM st""") + """
SELECT strategy, round(health, 4) AS health, round(least(greatest(prev + 0.5 * (least(greatest(1 + 0.5 * health, 0.4), 1.5) - prev), 0.4), 1.5), 4) AS weight FROM h""")
def _(spark, d):
    s = G.ledger_stats(catalog.trades(spark, d), ORDER)
    prev = s.filter("strategy <> 'view'").select("strategy", (0.5 + F.length("strategy") / 10.0).alias("weight"))
    return G.strategy_weights(s, prev).select("strategy", *rds("health", "weight", digits=4))


@checks.add("f14_limited_step", with_views("trades") + """
SELECT trade_id, round(least(greatest(o + least(greatest(t - o, -0.15), 0.15), 0.4), 1.5), 6) AS weight
FROM (SELECT trade_id, least(greatest(1 + r / 3, 0.4), 1.5) AS o, 1 + pnl / 100 AS t FROM trades)""")
def _(spark, d):
    return catalog.trades(spark, d).select("trade_id", F.round(T.limited_step(1 + F.col("r") / 3, 1 + F.col("pnl") / 100), 6).alias("weight"))


@checks.add("w37_append_ledger", with_views("trades") + """
SELECT trade_id, CASE WHEN trade_id % 2 = 1 THEN hour(exit_time) END::INT AS hour FROM trades""")
def _(spark, d):
    t = catalog.trades(spark, d)
    return G.append_ledger(t.filter("trade_id % 2 = 0"), t.filter("trade_id % 2 = 1")).select("trade_id", "hour")


@checks.add("w37_last_n", with_views("trades") + """
SELECT 'strategy' AS scope, trade_id FROM trades QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY exit_time DESC, trade_id DESC) <= 40
UNION ALL SELECT 'ledger', trade_id FROM (SELECT * FROM trades ORDER BY exit_time DESC, trade_id DESC LIMIT 1500)
UNION ALL SELECT 'symbol', trade_id FROM trades QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY exit_time DESC, trade_id DESC) = 1""")
def _(spark, d):
    t = catalog.trades(spark, d)
    half = t.filter("trade_id % 2 = 0")
    led = G.append_ledger(half, t.filter("trade_id % 2 = 1"), keep=1500)
    parts = [("strategy", G.last_n(t, ["strategy"], ORDER, 40)), ("ledger", led), ("symbol", G.last_n(t, ["symbol"], ORDER, 1))]
    out = [p.select(F.lit(n).alias("scope"), "trade_id") for n, p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


# finals only, per day
FIN = "SELECT *, exit_time::DATE AS day FROM trades WHERE outcome <> 'PARTIAL'"
STREAK = """SELECT *, k - coalesce(max(CASE WHEN pnl > 0 THEN k END) OVER (PARTITION BY day ORDER BY k), 0) AS streak FROM (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY exit_time, trade_id) AS k FROM fin)"""


def finals(spark, d):
    return catalog.trades(spark, d).filter("outcome <> 'PARTIAL'").withColumn("day", F.to_date("exit_time"))


@checks.add("w33_loss_streak", with_views("trades", fin=FIN, st=STREAK) + "SELECT trade_id, streak FROM st")
def _(spark, d):
    return G.loss_streak(finals(spark, d), ORDER).select("trade_id", "streak")


HALT = """SELECT st.*, sum(pnl) OVER (PARTITION BY day ORDER BY k) AS net FROM st"""
TRIP = """SELECT *, CASE WHEN net <= -400 THEN 'max loss' WHEN net >= 900 THEN 'profit target' WHEN streak >= 9 THEN 'loss streak' END AS rule FROM hn"""
LIM = DayLimits(max_loss=400.0, profit_target=900.0, max_loss_streak=9)


@checks.add("w34_day_halt", with_views("trades", fin=FIN, st=STREAK, hn=HALT, tr=TRIP, f="""
  SELECT day, min(k) AS fk, arg_min(rule, k) AS why FROM tr WHERE rule IS NOT NULL GROUP BY 1""") + """
SELECT trade_id, round(net, 4) AS net, streak, coalesce(k >= fk, false) AS halted, CASE WHEN k >= fk THEN why END AS reason FROM tr LEFT JOIN f USING (day)""")
def _(spark, d):
    return R.day_halt(finals(spark, d), ORDER, LIM).select("trade_id", rd("net", 4), "streak", "halted", "reason")


@checks.add("w35_loss_cooldown", with_views("trades", en="SELECT trade_id AS entry_id, symbol, exit_time + INTERVAL 7 MINUTE AS entry_ts FROM trades") + """
SELECT entry_id, EXISTS (SELECT 1 FROM trades x WHERE x.symbol = en.symbol AND pnl <= 0 AND x.exit_time <= en.entry_ts AND x.exit_time > en.entry_ts - INTERVAL 30 MINUTE) AS cooling FROM en""")
def _(spark, d):
    t = catalog.trades(spark, d)
    en = t.select(F.col("trade_id").alias("entry_id"), "symbol", (F.col("exit_time") + F.expr("INTERVAL 7 MINUTE")).alias("entry_ts"))
    return R.blocked_by_cooldown(en, t).select("entry_id", "cooling")


@checks.add("w36_sliding_rate_limit", """
SELECT event_id, count(*) OVER w AS recent, count(*) OVER w <= 2 AS ok FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '29 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return R.sliding_rate(catalog.table(spark, d, "events"), "event_type", "event_id", seconds=1800, limit=2).select("event_id", "recent", "ok")


@checks.add("w36_sliding_rate_long_window", """
SELECT event_id, count(*) OVER w AS recent, count(*) OVER w <= 40 AS ok FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '239 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    return R.sliding_rate(catalog.table(spark, d, "events"), "user_id", "event_id", seconds=864_000, limit=40).select("event_id", "recent", "ok")


STATES = list(R.TRANSITIONS)
ST_SQL = "[" + ", ".join(f"'{s}'" for s in STATES) + "]"


@checks.add("w41_transition_audit", with_views("audit", s=f"SELECT event_id, decision_id, ts, ({ST_SQL})[1 + (event_id // 500) % 11] AS state FROM audit", p="""
  SELECT *, lag(state) OVER (PARTITION BY decision_id ORDER BY ts) AS prev_state FROM s""") + """
SELECT event_id, prev_state, state FROM p WHERE prev_state IS NOT NULL AND prev_state || '>' || state NOT IN (""" + ", ".join(
    f"'{a}>{b}'" for a, bs in R.TRANSITIONS.items() for b in bs) + ")")
def _(spark, d):
    s = F.element_at(F.array(*[F.lit(x) for x in STATES]), (1 + F.floor(F.col("event_id") / 500) % 11).cast("int"))
    ev = catalog.audit_events(spark, d).select("event_id", "decision_id", "ts", s.alias("state"))
    return R.transition_audit(ev, "decision_id", ["ts"]).select("event_id", "prev_state", "state")


@checks.add("p19_entry_block_reason", with_views("trades", s="""
  SELECT trade_id, symbol, row_number() OVER (PARTITION BY exit_time::DATE ORDER BY exit_time) - 1 AS opened,
    (trade_id % 7)::INT AS open_now, user_pos, cool, halt FROM (SELECT *, trade_id % 5 = 0 AS user_pos, trade_id % 3 = 0 AS cool, trade_id % 23 = 0 AS halt FROM trades)""") + """
SELECT trade_id, CASE WHEN halt THEN 'halted' WHEN opened >= 200 THEN 'daily trade cap' WHEN open_now >= 5 THEN 'max open positions'
  WHEN user_pos THEN 'already in a position' WHEN cool THEN 'cooldown' END AS reason FROM s""")
def _(spark, d):
    t = catalog.trades(spark, d).withColumn("day", F.to_date("exit_time"))
    lay = running(lay_out(t, ["day"], ["exit_time"]), sums={"k": F.lit(1)})
    k = F.col("trade_id")
    s = lay.finish().withColumns({"halted": k % 23 == 0, "opened_today": F.col("k") - 1, "open_now": k % 7, "in_position": k % 5 == 0, "cooling": k % 3 == 0})
    return s.select("trade_id", R.entry_block_reason(DayLimits(max_trades=200)).alias("reason"))


# ---- exposure and risk -----------------------------------------------------------------------
PS = "SELECT p.*, coalesce(s.sector, 'UNKNOWN') AS sector FROM positions p LEFT JOIN sectors s USING (symbol)"


def with_sectors(spark, d):
    return K.sector_join(catalog.positions(spark, d), catalog.sectors(spark, d))


@checks.add("j18_sector_join", with_views("positions", "sectors", ps=PS) + "SELECT decision_id, sector FROM ps")
def _(spark, d):
    return with_sectors(spark, d).select("decision_id", "sector")


@checks.add("d14_exposure_totals", with_views("positions", "sectors", ps=PS, g="""
  SELECT CASE WHEN grouping(symbol) = 0 THEN 'symbol' WHEN grouping(strategy) = 0 THEN 'strategy' WHEN grouping(sector) = 0 THEN 'sector' ELSE 'all' END AS level,
    coalesce(symbol, strategy, sector, '') AS name, sum(abs(entry - sl) * qty) AS open_risk, sum(entry * qty) AS notional,
    coalesce(sum(entry * qty) FILTER (side = 'BUY'), 0) AS long_exposure, coalesce(sum(entry * qty) FILTER (side = 'SELL'), 0) AS short_exposure
  FROM ps GROUP BY GROUPING SETS ((symbol), (strategy), (sector), ())""") + f"SELECT level, name, {sql_rd('open_risk', 'notional', 'long_exposure', 'short_exposure', digits=3)} FROM g")
def _(spark, d):
    return R.exposure_totals(with_sectors(spark, d)).select("level", "name", *rds("open_risk", "notional", "long_exposure", "short_exposure", digits=3))


@checks.add("d15_portfolio_heat", with_views("positions") + "SELECT round(sum(abs(entry - sl) * qty), 3) AS heat FROM positions")
def _(spark, d):
    return R.portfolio_heat(catalog.positions(spark, d)).select(rd("heat", 3))


RL = RiskLimits(max_heat=20_000.0, max_symbol_notional=400_000.0, max_sector_notional=2_600_000.0)


@checks.add("p21_portfolio_entry_check", with_views("positions", "sectors", ps=PS, op="SELECT * FROM ps WHERE decision_id % 3 <> 0", c="SELECT * FROM ps WHERE decision_id % 3 = 0", a="""
  SELECT c.decision_id, list_filter([CASE WHEN (SELECT sum(abs(entry - sl) * qty) FROM op) + abs(c.entry - c.sl) * c.qty > 20000 THEN 'portfolio heat' END,
    CASE WHEN coalesce(sy.n, 0) + c.entry * c.qty > 400000 THEN 'symbol notional' END, CASE WHEN coalesce(se.n, 0) + c.entry * c.qty > 2600000 THEN 'sector notional' END],
    lambda x: x IS NOT NULL) AS l FROM c LEFT JOIN (SELECT symbol, sum(entry * qty) AS n FROM op GROUP BY 1) sy USING (symbol)
  LEFT JOIN (SELECT sector, sum(entry * qty) AS n FROM op GROUP BY 1) se USING (sector)""") + """
SELECT decision_id, array_to_string(l, '|') AS reasons, len(l) = 0 AS ok FROM a""")
def _(spark, d):
    ps = with_sectors(spark, d)
    out = R.entry_check(ps.filter("decision_id % 3 = 0"), ps.filter("decision_id % 3 <> 0"), RL)
    return out.select("decision_id", F.array_join("reasons", "|").alias("reasons"), "ok")


BROKER = """SELECT symbol, sum(qty)::BIGINT AS qty FROM positions WHERE decision_id % 4 <> 0 AND symbol NOT IN ('S3', 'S7', 'S11') GROUP BY 1
  UNION ALL SELECT concat('X', n_nationkey), CASE WHEN n_nationkey % 2 = 0 THEN 5 ELSE 0 END FROM nation"""


@checks.add("j12_reconcile_positions", with_views("positions", l="SELECT DISTINCT symbol FROM positions", b=f"SELECT DISTINCT symbol FROM ({BROKER}) WHERE qty <> 0", o="""
  SELECT DISTINCT symbol FROM positions WHERE strategy IN ('1-URGENT', '2-HIGH') AND decision_id % 50 = 1""", j="""
  SELECT coalesce(l.symbol, b.symbol) AS symbol, CASE WHEN l.symbol IS NOT NULL AND b.symbol IS NOT NULL THEN 'matched'
    WHEN l.symbol IS NOT NULL THEN 'missing_broker' ELSE 'orphan_broker' END AS state FROM l FULL JOIN b ON l.symbol = b.symbol""") + """
SELECT symbol, state, state = 'matched' AND symbol NOT IN (SELECT symbol FROM o) AS unprotected,
  (SELECT bool_or(state <> 'matched' OR symbol NOT IN (SELECT symbol FROM o)) FROM j) AS halt FROM j""")
def _(spark, d):
    p = catalog.positions(spark, d)
    k = F.col("n_nationkey")
    broker = (p.filter("decision_id % 4 <> 0 and symbol not in ('S3', 'S7', 'S11')").groupBy("symbol").agg(F.sum("qty").alias("qty"))
              .unionByName(catalog.table(spark, d, "nation").select(F.concat(F.lit("X"), k.cast("string")).alias("symbol"), F.when(k % 2 == 0, 5).otherwise(0).cast("long").alias("qty"))))
    orders = p.filter("decision_id % 50 = 1").select("symbol", F.when(F.col("strategy") == "1-URGENT", "sl").when(F.col("strategy") == "2-HIGH", "Limit").otherwise("MARKET").alias("type"))
    return R.reconcile(p, broker, orders)


# pairs of neighbouring symbols, correlation stand-in from their keys
PAIRS = "SELECT concat('S', k) AS a, concat('S', k + 1) AS b, (k % 10) / 10.0::DOUBLE AS rho FROM (SELECT DISTINCT c_custkey % 39 AS k FROM customer)"


@checks.add("j13_correlated_open_count", with_views("positions", pr=PAIRS, sym="SELECT a, b, rho FROM pr UNION ALL SELECT b, a, rho FROM pr", op="""
  SELECT symbol FROM positions WHERE decision_id % 900 = 1""", n="""
  SELECT p.decision_id, count(*) FILTER (o.symbol = p.symbol OR s.rho >= 0.7) AS n FROM positions p CROSS JOIN op o
  LEFT JOIN sym s ON s.a = p.symbol AND s.b = o.symbol GROUP BY 1""") + "SELECT decision_id, n AS n_correlated, n < 3 AS ok FROM n")
def _(spark, d):
    p = catalog.positions(spark, d)
    k = F.col("c_custkey") % 39
    pairs = catalog.table(spark, d, "customer").select(k.alias("k")).distinct().select(
        F.concat(F.lit("S"), F.col("k").cast("string")).alias("a"), F.concat(F.lit("S"), (F.col("k") + 1).cast("string")).alias("b"), (F.col("k") % 10 / 10.0).alias("rho"))
    return R.correlated_open_count(p, p.filter("decision_id % 900 = 1"), pairs).select("decision_id", "n_correlated", "ok")


RET = """SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol, session_date ORDER BY ts) - 1 AS r FROM bars"""
NEIGH = """SELECT symbol AS a, lead(symbol) OVER (ORDER BY symbol) AS b FROM (SELECT DISTINCT symbol FROM bars)"""


@checks.add("d26_return_correlation", with_views("bars", rt=RET, nb=NEIGH) + """
SELECT a, b, round(corr(x.r, y.r), 6) AS rho, count(*) AS n FROM nb JOIN rt x ON x.symbol = a AND x.r IS NOT NULL JOIN rt y ON y.symbol = b AND y.ts = x.ts AND y.r IS NOT NULL GROUP BY 1, 2""")
def _(spark, d):
    from pyspark.sql import Window

    b = catalog.bars(spark, d)
    names = b.select("symbol").distinct()
    pairs = names.select(F.col("symbol").alias("a"), F.lead("symbol").over(Window.orderBy("symbol")).alias("b")).filter("b is not null")
    return R.return_correlation(b, pairs).select("a", "b", rd("rho"), "n")


# ---- reports and audit -----------------------------------------------------------------------
@checks.add("d16_day_report", with_views("trades") + """
SELECT exit_time::DATE AS day, count(*) AS rows, count(*) FILTER (outcome <> 'PARTIAL') AS finals, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl <= 0) AS losses,
  round(sum(pnl), 4) AS net, round(100.0 * count(*) FILTER (outcome <> 'PARTIAL' AND pnl > 0) / count(*) FILTER (outcome <> 'PARTIAL'), 6) AS win_rate,
  round(max(pnl), 6) AS best, round(min(pnl), 6) AS worst FROM trades GROUP BY 1""")
def _(spark, d):
    return A.day_report(catalog.trades(spark, d)).select("day", "rows", "finals", "wins", "losses", rd("net", 4), *rds("win_rate", "best", "worst"))


SUGG = "SELECT event_id AS suggestion_id, ts, ts::DATE AS day, concat('S', user_id % 50) AS symbol, event_type AS strategy FROM events"
OPENED = "SELECT symbol, strategy FROM trades WHERE trade_id % 7 = 0"


def suggestions(spark, d):
    return catalog.table(spark, d, "events").select(F.col("event_id").alias("suggestion_id"), "ts", F.to_date("ts").alias("day"),
                                                    F.concat(F.lit("S"), (F.col("user_id") % 50).cast("string")).alias("symbol"), F.col("event_type").alias("strategy"))


MARK = """SELECT s.*, row_number() OVER (PARTITION BY symbol, strategy ORDER BY suggestion_id) <= coalesce(n, 0) AS acted FROM sg s
  LEFT JOIN (SELECT symbol, strategy, count(*) AS n FROM op GROUP BY 1, 2) USING (symbol, strategy)"""


@checks.add("j16_mark_acted", with_views("trades", sg=SUGG, op=OPENED, mk=MARK) + "SELECT suggestion_id, acted FROM mk")
def _(spark, d):
    return A.mark_acted(suggestions(spark, d), catalog.trades(spark, d).filter("trade_id % 7 = 0")).select("suggestion_id", "acted")


@checks.add("d16_open_suggestions", with_views("trades", sg=SUGG, op=OPENED, mk=MARK) + """
SELECT day, suggestion_id FROM mk WHERE NOT acted QUALIFY row_number() OVER (PARTITION BY day ORDER BY suggestion_id) <= 15""")
def _(spark, d):
    mk = A.mark_acted(suggestions(spark, d), catalog.trades(spark, d).filter("trade_id % 7 = 0"))
    return A.open_suggestions(mk, ["suggestion_id"], 15).select("day", "suggestion_id")


@checks.add("d16_open_suggestions_all", with_views("trades", sg=SUGG, op=OPENED, mk=MARK) + """
SELECT day, suggestion_id, row_number() OVER (PARTITION BY day ORDER BY suggestion_id)::INT AS n FROM mk WHERE NOT acted""")
def _(spark, d):
    mk = A.mark_acted(suggestions(spark, d), catalog.trades(spark, d).filter("trade_id % 7 = 0"))
    return A.open_suggestions(mk, ["suggestion_id"]).select("day", "suggestion_id", "n")


@checks.add("d16_floating_pnl", with_views("positions") + f"""
SELECT round(sum({PNL.format(s='side', e='entry', x='coalesce(lp, entry)', q='qty')}), 3) AS floating, count(*) AS open_positions
FROM (SELECT *, CASE WHEN decision_id % 5 <> 0 THEN entry * (1 + (decision_id % 11 - 5) / 1000.0::DOUBLE) END AS lp FROM positions)""")
def _(spark, d):
    k, e = F.col("decision_id"), F.col("entry")
    f = A.floating_pnl(catalog.positions(spark, d), F.when(k % 5 != 0, e * (1 + (k % 11 - 5) / 1000.0)), CostSpec())
    return f.agg(F.round(F.sum("floating"), 3).alias("floating"), F.count(F.lit(1)).alias("open_positions"))


KIND = """SELECT ts, decision_id AS symbol, CASE event WHEN 'model_prediction' THEN 'attempt' WHEN 'order_submitted' THEN 'accept' WHEN 'order_rejected' THEN 'reject'
    WHEN 'fallback_invoked' THEN 'fallback' END AS kind, CASE WHEN event IN ('order_rejected', 'fallback_invoked') THEN concat('R', event_id % 4) END AS reason FROM audit"""


def model_events(spark, d):
    e = F.col("event")
    kind = (F.when(e == "model_prediction", "attempt").when(e == "order_submitted", "accept").when(e == "order_rejected", "reject").when(e == "fallback_invoked", "fallback"))
    return catalog.audit_events(spark, d).select("ts", F.col("decision_id").alias("symbol"), kind.alias("kind"),
                                                 F.when(e.isin("order_rejected", "fallback_invoked"), F.concat(F.lit("R"), (F.col("event_id") % 4).cast("string"))).alias("reason"))


@checks.add("d17_model_coverage", with_views("audit", k=KIND, b="SELECT *, ts::DATE AS day FROM k", t="""
  SELECT day, reason FROM (SELECT day, reason, count(*) AS n FROM b WHERE reason IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY day ORDER BY n DESC, reason) = 1""") + """
SELECT b.day, count(*) FILTER (kind = 'attempt') AS attempted, count(*) FILTER (kind = 'accept') AS accepted, count(*) FILTER (kind = 'reject') AS rejected,
  count(*) FILTER (kind = 'fallback') AS fallbacks, round(count(*) FILTER (kind = 'accept') / count(*) FILTER (kind = 'attempt'), 6) AS acceptance_rate,
  any_value(t.reason) AS top_reject_reason, arg_max(symbol, ts) FILTER (kind = 'accept') AS last_accept_symbol, max(ts) FILTER (kind = 'accept') AS last_accept_ts
FROM b JOIN t ON b.day = t.day GROUP BY 1""")
def _(spark, d):
    return A.model_coverage(model_events(spark, d), F.to_date("ts")).select(
        "day", "attempted", "accepted", "rejected", "fallbacks", rd("acceptance_rate"), "top_reject_reason", "last_accept_symbol", "last_accept_ts")


@checks.add("f20_decision_id", with_views("trades") + """
SELECT trade_id, upper(concat_ws('-', strategy, symbol, strftime(exit_time, '%Y%m%dT%H%M%S'), side)) AS decision_id FROM trades""")
def _(spark, d):
    return catalog.trades(spark, d).select("trade_id", A.decision_id(F.col("strategy"), F.col("symbol"), F.col("side"), F.col("exit_time")).alias("decision_id"))


@checks.add("f21_table_fingerprint", """
SELECT count(*) AS rows, bit_xor(('0x' || substr(h, 1, 15))::BIGINT) AS xor, sum(('0x' || substr(h, 1, 15))::BIGINT % 1000003)::BIGINT AS checksum
FROM (SELECT sha256(concat_ws('|', event_id::VARCHAR, user_id::VARCHAR, event_type, coalesce(props, '~'))) AS h FROM events)""")
def _(spark, d):
    return A.table_fingerprint(catalog.table(spark, d, "events"), ["event_id", "user_id", "event_type", "props"])


@checks.add("f22_redact_secrets", """
SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text || ' ghp_' || md5(doc_id::VARCHAR) || ' id ' || (10000000 + doc_id) || ':AA' || md5(text), 'Elle un la', '***REDACTED***'),
  'ghp_[A-Za-z0-9]{20,}', '***REDACTED***', 'g'), '[0-9]{8,10}:AA[A-Za-z0-9_-]{30,}', '***REDACTED***', 'g')) AS digest FROM documents""")
def _(spark, d):
    text = F.concat("text", F.lit(" ghp_"), F.md5(F.col("doc_id").cast("string")), F.lit(" id "), (10000000 + F.col("doc_id")).cast("string"), F.lit(":AA"), F.md5("text"))
    return catalog.table(spark, d, "documents").select("doc_id", F.md5(A.redact(text, ("Elle un la",))).alias("digest"))


@checks.add("f23_audit_json", with_views("audit") + """
SELECT event_id, event, (payload::JSON ->> 'k')::INT AS k, event NOT IN ('signal_created', 'order_submitted', 'order_rejected', 'model_prediction', 'fallback_invoked') AS unknown,
  event_id % 4 IN (1, 2) AS fallback FROM (SELECT * REPLACE (CASE WHEN event_id % 10 = 0 THEN 'noise' ELSE event END AS event) FROM audit)""")
def _(spark, d):
    ev = catalog.audit_events(spark, d).withColumn("event", F.when(F.col("event_id") % 10 == 0, "noise").otherwise(F.col("event")))
    out = A.audit_json(ev, ["decision_id", "payload"])
    parsed = F.from_json("record", "event string, payload string, _unknown_event boolean")
    status = F.element_at(F.array(*[F.lit(s) for s in ("ACCEPTED", "LOW_CONFIDENCE", "SCHEMA_MISMATCH", "DISABLED")]), (F.col("event_id") % 4 + 1).cast("int"))
    return out.select("event_id", parsed.alias("j"), A.is_fallback(status).alias("fallback")).select(
        "event_id", "j.event", F.get_json_object("j.payload", "$.k").cast("int").alias("k"), F.coalesce("j._unknown_event", F.lit(False)).alias("unknown"), "fallback")


DEC = "SELECT concat('D', event_id % 700) AS decision_id, ts, event_id FROM events"


@checks.add("j14_idempotent_append", with_views(dec=DEC, old="SELECT * FROM dec WHERE event_id < 500", new="SELECT * FROM dec WHERE event_id >= 400") + """
SELECT * FROM old UNION ALL (SELECT * FROM new WHERE decision_id NOT IN (SELECT decision_id FROM old) QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY ts) = 1)""")
def _(spark, d):
    dec = catalog.table(spark, d, "events").select(F.concat(F.lit("D"), (F.col("event_id") % 700).cast("string")).alias("decision_id"), "ts", "event_id")
    return A.append_new(dec.filter("event_id < 500"), dec.filter("event_id >= 400"))


@checks.add("j15_upsert_latest", with_views("positions", old="SELECT decision_id % 1000 AS decision_id, symbol, entry, decision_id AS version FROM positions") + """
SELECT decision_id, symbol, round(entry, 6) AS entry, version FROM old QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY version DESC) = 1""")
def _(spark, d):
    p = catalog.positions(spark, d).select((F.col("decision_id") % 1000).alias("decision_id"), "symbol", "entry", F.col("decision_id").alias("version"))
    return A.upsert(p.filter("version % 2 = 0"), p.filter("version % 2 = 1"), "version").select("decision_id", "symbol", rd("entry"), "version")
