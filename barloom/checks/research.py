"""Sweeps, validation, resampling and models."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from barloom import catalog
from barloom.checks import admission_sql as A, stand_ins as X
from barloom.checks.book import ORDER
from barloom.checks.indicators import FEAT, TR, ema_step, sql_fold, sql_full, wilder_step
from barloom.checks.outcomes import ENT, NEXT, resolve_sql
from barloom.checks.registry import Checks, rd, rds, sql_rd
from barloom.checks.signals import SIGNALS
from barloom.checks.views_sql import with_views
from barloom.functions import trading as T
from barloom.operators import performance as P
from barloom.operators.layout import one_row, pinned, scratch_path
from barloom.operators.recursive import feature_frame, index_trend
from barloom.plans import models as M, outcomes as O, resampling as RS, sweep as W
from barloom.sources import dimensions as D

checks = Checks()

# sweep results derived from the orders: one row per configuration of the default grid
SWEEP = """
  SELECT run::INT AS run, [1.0, 1.5, 2.0][1 + run // 54 % 3]::DOUBLE AS atr_mult, [1.5, 2.0, 2.5][1 + run // 18 % 3]::DOUBLE AS reward_ratio,
    [6, 7, 8][1 + run // 6 % 3]::INT AS min_score, (run // 3 % 2 = 0) AS require_confirmation, ['off', 'soft', 'strict'][1 + run % 3] AS gate,
    0.003::DOUBLE AS min_stop, CASE WHEN run % 50 = 7 THEN 0.002 ELSE 0.015 END::DOUBLE AS max_stop, trades, expectancy_r, profit_factor, max_drawdown_pct,
    (2 * expectancy_r + least(profit_factor, 5) - 1) * (trades / (trades + 30.0::DOUBLE)) * greatest(0, 1 - max_drawdown_pct / 20) AS fitness
  FROM (SELECT o_custkey % 162 AS run, count(*) AS trades, (avg(o_totalprice) - 250000) / 100000 * 1.0471975511965976::DOUBLE AS expectancy_r,
      sum(o_totalprice) FILTER (o_orderstatus = 'F') / sum(o_totalprice) FILTER (o_orderstatus = 'O') AS profit_factor,
      stddev_samp(o_totalprice) / 10000 AS max_drawdown_pct FROM orders GROUP BY 1)"""


def sweep_results(spark, d):
    run, p, s = F.col("o_custkey") % 162, F.col("o_totalprice"), F.col("o_orderstatus")
    g = catalog.table(spark, d, "orders").groupBy(run.cast("int").alias("run")).agg(
        F.count(F.lit(1)).alias("trades"), ((F.avg(p) - 250000) / 100000 * catalog.SCALE).alias("expectancy_r"),
        (F.sum(F.when(s == "F", p)) / F.sum(F.when(s == "O", p))).alias("profit_factor"), (F.stddev_samp(p) / 10000).alias("max_drawdown_pct"))
    grid = W.grid_cross(spark, W.GRIDS["default"]).drop("max_stop")
    df = grid.join(g, "run").withColumn("max_stop", F.when(F.col("run") % 50 == 7, 0.002).otherwise(0.015))
    return df.withColumn("fitness", T.fitness(F.col("trades"), F.col("expectancy_r"), F.col("profit_factor"), F.col("max_drawdown_pct")))


@checks.add("f11_fitness", with_views(sw=SWEEP) + "SELECT run, atr_mult, reward_ratio, min_score, require_confirmation, gate, round(fitness, 6) AS fitness FROM sw")
def _(spark, d):
    return sweep_results(spark, d).select("run", "atr_mult", "reward_ratio", "min_score", "require_confirmation", "gate", rd("fitness"))


@checks.add("t2_top_configs", with_views(sw=SWEEP) + "SELECT run, round(fitness, 6) AS fitness FROM sw ORDER BY sw.fitness DESC, run LIMIT 10")
def _(spark, d):
    return W.top_configs(sweep_results(spark, d), 10).select("run", rd("fitness"))


@checks.add("d19_sweep_robustness", with_views(sw=SWEEP, b="SELECT * FROM sw ORDER BY fitness DESC, run LIMIT 1", m="""
  SELECT sw.*, b.fitness AS best, (sw.atr_mult = b.atr_mult)::INT + (sw.reward_ratio = b.reward_ratio)::INT + (sw.min_score = b.min_score)::INT
    + (sw.require_confirmation = b.require_confirmation)::INT + (sw.gate = b.gate)::INT AS same FROM sw, b""") + """
SELECT round(max(best), 6) AS best_fitness, round(median(fitness), 6) AS median_fitness, count(*) FILTER (expectancy_r > 0) AS profitable,
  round(avg((expectancy_r > 0)::INT) * 100, 6) AS profitable_pct, round(median(fitness) FILTER (same = 4), 6) AS neighbour_median,
  round(min(fitness) FILTER (same = 4), 6) AS neighbour_min, round(CASE WHEN median(fitness) > 0 THEN max(best) / median(fitness) END, 5) AS best_over_median FROM m""")
def _(spark, d):
    return W.sweep_robustness(sweep_results(spark, d)).select(*rds("best_fitness", "median_fitness"), "profitable",
                                                              *rds("profitable_pct", "neighbour_median", "neighbour_min"), rd("best_over_median", 5))


@checks.add("p17_promotable_configs", with_views(sw=SWEEP) + """
SELECT run, array_to_string(l, '|') AS warnings, len(l) = 0 AS ok FROM (SELECT run, list_filter([CASE WHEN fitness < 0.15 THEN 'fitness too low' END,
  CASE WHEN trades < 60 THEN 'too few trades' END, CASE WHEN min_stop >= max_stop THEN 'min_stop >= max_stop' END], lambda x: x IS NOT NULL) AS l FROM sw)""")
def _(spark, d):
    return W.promotable(sweep_results(spark, d), 0.15, 60).select("run", F.array_join("warnings", "|").alias("warnings"), "ok")


@checks.add("j8_grid_cross", with_views("trades", u="""
  SELECT x.a AS atr_mult, y.r AS reward_ratio, g.g AS gate FROM (SELECT unnest([1.0, 1.5, 2.0])::DOUBLE AS a) x, (SELECT unnest([1.5, 2.0, 2.5])::DOUBLE AS r) y, (SELECT unnest(['off', 'soft', 'strict']) AS g) g""") + """
SELECT strategy, atr_mult, reward_ratio, gate, count(*) AS n, round(sum(pnl * reward_ratio / atr_mult), 4) AS scaled FROM trades, u GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    grid = W.grid_cross(spark, {"atr_mult": [1.0, 1.5, 2.0], "reward_ratio": [1.5, 2.0, 2.5], "gate": ["off", "soft", "strict"]})
    # per-strategy totals first: the grid multiplies groups, not trades
    per = catalog.trades(spark, d).groupBy("strategy").agg(F.sum("pnl").alias("p"), F.count(F.lit(1)).alias("n"))
    cells = grid.agg(F.collect_list(F.struct("atr_mult", "reward_ratio", "gate")).alias("g"))
    df = per.withColumn("x", F.explode(one_row(cells)["g"])).select("strategy", "p", "n", "x.*")
    return df.select("strategy", "atr_mult", "reward_ratio", "gate", "n", F.round(F.col("p") * F.col("reward_ratio") / F.col("atr_mult"), 4).alias("scaled"))


DN = "SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS n, count(*) OVER () AS t FROM (SELECT DISTINCT session_date FROM bars)"


@checks.add("w39_date_split", with_views("bars", dn=DN) + """
SELECT session_date, CASE WHEN n < greatest(1, floor(t * 0.7)) THEN 'train' ELSE 'test' END AS part FROM dn""")
def _(spark, d):
    return W.date_split(catalog.bars(spark, d), 0.7)


@checks.add("w38_walk_forward_folds", with_views("bars", dn=DN, f="SELECT unnest([1, 2]) AS fold", k="""
  SELECT fold, t, session_date, n, t // 3 * fold AS te, t // 3 * fold + 2 AS vs, least(t // 3 * fold + 2 + t // 3, t) AS ve FROM dn, f WHERE t >= 2 * 12""") + """
SELECT fold::INT AS fold, CASE WHEN n < te THEN 'train' ELSE 'validate' END AS part, session_date, true AS ok FROM k WHERE vs < t AND ve > vs AND (n < te OR (n >= vs AND n < ve))""")
def _(spark, d):
    f = W.walk_forward_folds(catalog.bars(spark, d), n_folds=2, embargo=2)
    return f.join(W.has_no_leakage(f, 2), "fold").select("fold", "part", "session_date", "ok")


# ---- admission and sweeps ---------------------------------------------------------------------
ONE = A.one_run(dict(ent=ENT, **resolve_sql("ent", ", strategy, pattern")), 30, 6, 2)


def one_backtest(spark, d):
    return O.backtest(catalog.bars(spark, d), index_trend(catalog.index_bars(spark, d)), X.signals(spark, d), X.CLOCK, X.EXITS, X.ENTRY.with_(max_open=2))


@checks.add("r3_admit_trades", with_views("bars", "index_bars", recursive=True, **ONE) + """
SELECT symbol, ts, strategy, side, score, entry_ts, exit_ts, outcome, round(pnl_net, 4) AS pnl_net FROM done WHERE word = 'TAKEN'""")
def _(spark, d):
    return one_backtest(spark, d)[0].select("symbol", "ts", "strategy", "side", "score", "entry_ts", "exit_ts", "outcome", rd("pnl_net", 4))


@checks.add("r3_admission_counts", with_views("bars", "index_bars", recursive=True, **ONE) + A.COUNTS)
def _(spark, d):
    return one_backtest(spark, d)[1]


# the default grid; the turnover of the hourly stand-in bars is scaled down
TURNOVER = X.ENTRY.min_turnover_lakhs


def default_grid(spark):
    return W.grid_cross(spark, dict(W.GRIDS["default"], min_turnover=[TURNOVER]))


RUN_OUT = ["run", "trades", "wins", "losses", "raw_signals", "gate_rejected", "position_cap_hits"]
RUN_NUM = ["win_rate", "profit_factor", "expectancy_r", "max_drawdown_pct", "sharpe_annual", "fitness"]


@checks.add("r4_parameter_sweep", with_views("bars", "index_bars", recursive=True, **A.grid(TURNOVER), **A.summary("every")) + f"""
SELECT {', '.join(RUN_OUT)}, atr_mult, reward_ratio, gate, {sql_rd(*RUN_NUM)} FROM every""")
def _(spark, d):
    trend = index_trend(catalog.index_bars(spark, d))
    out = W.parameter_sweep(X.hits(spark, d), catalog.bars(spark, d), trend, default_grid(spark), X.CLOCK, X.EXITS)
    return out.select(*RUN_OUT, "atr_mult", "reward_ratio", "gate", *rds(*RUN_NUM))


@checks.add("r8_walk_forward_sweep", with_views("bars", "index_bars", recursive=True, **A.grid(TURNOVER), dn=DN, cut="SELECT session_date, n < greatest(1, floor(t * 0.7)) AS train FROM dn",
                                                **A.summary("tr", "session_date IN (SELECT session_date FROM cut WHERE train)"), **A.summary("te", "session_date IN (SELECT session_date FROM cut WHERE NOT train)"),
                                                best="SELECT run, fitness AS train_fitness FROM tr ORDER BY tr.fitness DESC, run LIMIT 5", oos="""
  SELECT run, trades, train_fitness, fitness, (train_fitness - fitness) / abs(nullif(train_fitness, 0)) * 100 AS fall FROM te JOIN best USING (run)""") + """
SELECT run, trades, round(train_fitness, 6) AS train_fitness, round(fitness, 6) AS fitness, round(fall, 6) AS fitness_drop_pct, CASE WHEN fall > 50 THEN 'OVERFIT' WHEN fall > 25 THEN 'CAUTION' ELSE 'HOLDS' END AS verdict FROM oos""")
def _(spark, d):
    trend = index_trend(catalog.index_bars(spark, d))
    out = W.walk_forward_sweep(X.hits(spark, d), catalog.bars(spark, d), trend, default_grid(spark), X.CLOCK, X.EXITS)
    return out.select("run", "trades", *rds("train_fitness", "fitness", "fitness_drop_pct"), "verdict")


@checks.add("j17_oos_rejoin", with_views(tr=SWEEP, te=SWEEP.replace("FROM orders GROUP", "FROM orders WHERE o_orderkey % 2 = 1 GROUP"), b="SELECT run, fitness AS train_fitness FROM tr ORDER BY fitness DESC, run LIMIT 5") + """
SELECT run, round(train_fitness, 6) AS train_fitness, round(fitness, 6) AS fitness, round((train_fitness - fitness) / abs(train_fitness) * 100, 4) AS fitness_drop_pct,
  CASE WHEN (train_fitness - fitness) / abs(train_fitness) * 100 > 50 THEN 'OVERFIT' WHEN (train_fitness - fitness) / abs(train_fitness) * 100 > 25 THEN 'CAUTION' ELSE 'HOLDS' END AS verdict
FROM te JOIN b USING (run)""")
def _(spark, d):
    run, p, s = F.col("o_custkey") % 162, F.col("o_totalprice"), F.col("o_orderstatus")
    g = catalog.table(spark, d, "orders").filter("o_orderkey % 2 = 1").groupBy(run.cast("int").alias("run")).agg(
        F.count(F.lit(1)).alias("trades"), ((F.avg(p) - 250000) / 100000 * catalog.SCALE).alias("e"),
        (F.sum(F.when(s == "F", p)) / F.sum(F.when(s == "O", p))).alias("pf"), (F.stddev_samp(p) / 10000).alias("dd"))
    test = g.select("run", T.fitness(F.col("trades"), F.col("e"), F.col("pf"), F.col("dd")).alias("fitness"))
    return W.oos_rejoin(sweep_results(spark, d), test).select("run", *rds("train_fitness", "fitness"), rd("fitness_drop_pct", 4), "verdict")


# ---- moving-average sweep -------------------------------------------------------------------
MA = f"""SELECT symbol, ts, close, {sql_full('tr', 'avg', 14)} AS atr, {', '.join(f"{sql_full('close', 'avg', n)} AS m{n}" for n in (5, 9, 12, 20, 30, 50))} FROM t"""
MAX = """SELECT symbol, ts, close, atr, f AS fast, s AS slow, coalesce(a > b AND pa <= pb, false) AS up, coalesce(a < b AND pa >= pb, false) AS down FROM (
    SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM (
      SELECT symbol, ts, close, atr, f, s, CASE f WHEN 5 THEN m5 WHEN 9 THEN m9 ELSE m12 END AS a, CASE s WHEN 20 THEN m20 WHEN 30 THEN m30 ELSE m50 END AS b
      FROM ma, (SELECT unnest([5, 9, 12]) AS f), (SELECT unnest([20, 30, 50]) AS s)) WINDOW w AS (PARTITION BY symbol, f, s ORDER BY ts))"""
MAT = """SELECT e.*, x.ts AS exit_ts, x.close AS exit_price FROM (SELECT symbol, fast, slow, ts AS entry_ts, close AS entry_price, sl, rr,
      coalesce(greatest(0.001, least(sl * atr / close, 0.05)), 0.01) AS sf FROM mx, (SELECT unnest([1.0, 1.5, 2.0, 2.5])::DOUBLE AS sl), (SELECT unnest([1.2, 1.5, 2.0, 2.5, 3.0])::DOUBLE AS rr) WHERE up) e,
  LATERAL (SELECT ts, close FROM mx b WHERE b.symbol = e.symbol AND b.fast = e.fast AND b.slow = e.slow AND b.ts > e.entry_ts
    AND (down OR b.close <= e.entry_price * (1 - e.sf) OR b.close >= e.entry_price * (1 + greatest(0.001, least(e.sf * e.rr, 0.2)))) ORDER BY ts LIMIT 1) x"""
MA_SQL = dict(t=TR.replace("FROM ticks", "FROM bars"), ma=MA, mx=MAX, mt=MAT)


@checks.add("r5_ma_trades", with_views("bars", **MA_SQL) + """
SELECT symbol, fast::INT AS fast, slow::INT AS slow, sl AS sl_atr, rr, entry_ts, exit_ts, round(exit_price * 0.9997 * 0.9994 / (entry_price * 1.0003 * 1.0006) - 1, 6) AS ret FROM mt""")
def _(spark, d):
    return W.ma_trades(catalog.bars(spark, d)).select("symbol", "fast", "slow", "sl_atr", "rr", "entry_ts", "exit_ts", rd("ret"))


MA_RES = """SELECT symbol, fast::INT AS fast, slow::INT AS slow, sl AS sl_atr, rr, count(*) AS trades, avg((ret > 0)::INT) * 100 AS win_rate, (exp(sum(ln(1 + ret))) - 1) * 100 AS total_return_pct,
    avg(ret) / stddev_samp(ret) * sqrt(count(*)) AS sharpe FROM (SELECT *, exit_price * 0.9997 * 0.9994 / (entry_price * 1.0003 * 1.0006) - 1 AS ret FROM mt) GROUP BY ALL HAVING count(*) >= 5"""
MA_FIT = "SELECT *, (0.5 * total_return_pct + 10 * sharpe + 0.1 * win_rate) * least(1, trades / 30.0::DOUBLE) AS fitness FROM mr"


@checks.add("r5_ma_sweep", with_views("bars", **MA_SQL, mr=MA_RES, mf=MA_FIT) + f"SELECT symbol, fast, slow, sl_atr, rr, trades, {sql_rd('win_rate', 'total_return_pct', 'sharpe', digits=5)} FROM mf")
def _(spark, d):
    return W.ma_sweep(catalog.bars(spark, d)).select("symbol", "fast", "slow", "sl_atr", "rr", "trades", *rds("win_rate", "total_return_pct", "sharpe", digits=5))


@checks.add("f12_fitness_ma", with_views("bars", **MA_SQL, mr=MA_RES, mf=MA_FIT) + "SELECT symbol, fast, slow, sl_atr, rr, round(fitness, 5) AS fitness FROM mf")
def _(spark, d):
    return W.ma_sweep(catalog.bars(spark, d)).select("symbol", "fast", "slow", "sl_atr", "rr", rd("fitness", 5))


@checks.add("d18_sl_rr_regions", with_views("bars", **MA_SQL, mr=MA_RES, mf=MA_FIT) + """
SELECT sl_atr, rr, round(avg(fitness), 5) AS mean_fitness, round(avg(total_return_pct), 5) AS mean_ret, round(avg(win_rate), 5) AS mean_wr, count(*) AS n
FROM mf WHERE trades >= 10 GROUP BY 1, 2 ORDER BY avg(fitness) DESC LIMIT 10""")
def _(spark, d):
    return W.stop_ratio_regions(W.ma_sweep(catalog.bars(spark, d))).select("sl_atr", "rr", *rds("mean_fitness", "mean_ret", "mean_wr", digits=5), "n")


# ---- resampling --------------------------------------------------------------------------------
N_ITER = 20
FULL_ITER = 2000
DRAW = "('0x' || substr(md5(concat_ws(':', '42', iter, i)), 1, 8))::BIGINT"
BOOT = dict(o="SELECT pnl, row_number() OVER (ORDER BY exit_time, trade_id) - 1 AS k, count(*) OVER () AS n FROM trades", dr=f"""
  SELECT iter, i, {DRAW} % n AS k FROM (SELECT unnest(range({N_ITER})) AS iter), (SELECT k AS i, n FROM o)""", sm="SELECT iter, i, pnl AS p FROM dr JOIN o USING (k)", eq="""
  SELECT *, 100000 + sum(p) OVER w AS e FROM sm WINDOW w AS (PARTITION BY iter ORDER BY i)""", dd="SELECT *, max(e) OVER (PARTITION BY iter ORDER BY i) AS pk FROM eq", bt="""
  SELECT iter, sum(p) AS total_pnl, max((pk - e) / pk) * 100 AS max_dd_pct, avg((p > 0)::INT) * 100 AS win_rate, sum(p) FILTER (p > 0) / -sum(p) FILTER (p <= 0) AS profit_factor,
    avg(p) AS avg_pnl, avg(p) / stddev_samp(p) AS per_trade_sharpe FROM dd GROUP BY 1""")
BOOT_METRICS = ["max_dd_pct", "win_rate", "profit_factor", "avg_pnl", "per_trade_sharpe"]


def bootstrap(spark, d):
    return RS.bootstrap_trades(catalog.trades(spark, d), ORDER, N_ITER, draw=RS.draw_md5)


@checks.add("r6_bootstrap_trades", with_views("trades", **BOOT) + f"SELECT iter, round(total_pnl, 3) AS total_pnl, {sql_rd(*BOOT_METRICS, digits=5)} FROM bt")
def _(spark, d):
    return bootstrap(spark, d).select("iter", rd("total_pnl", 3), *rds(*BOOT_METRICS, digits=5))


@checks.add("r6_bootstrap_percentiles", with_views("trades", **BOOT) + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, round(quantile_cont({m}, 0.05), 3) AS p05, round(quantile_cont({m}, 0.5), 3) AS p50, round(quantile_cont({m}, 0.95), 3) AS p95 FROM bt" for m in ["total_pnl", *BOOT_METRICS]))
def _(spark, d):
    return P.percentile_table(bootstrap(spark, d), ["total_pnl", *BOOT_METRICS]).select("metric", *rds("p05", "p50", "p95", digits=3))


FULL = {k: v.replace(f"range({N_ITER})", f"range({FULL_ITER})") for k, v in BOOT.items()}


@checks.add("r6_bootstrap_full", with_views("trades", **FULL) + f"SELECT iter, round(total_pnl, 3) AS total_pnl, {sql_rd(*BOOT_METRICS, digits=5)} FROM bt")
def _(spark, d):
    """The default number of draws."""
    out = RS.bootstrap_trades(catalog.trades(spark, d), ORDER, FULL_ITER, draw=RS.draw_md5)
    return out.select("iter", rd("total_pnl", 3), *rds(*BOOT_METRICS, digits=5))


@checks.add("d11_signal_fingerprint", with_views("trades", t="SELECT strftime(exit_time, '%Y-%m-%d') AS date, lpad((hour(exit_time) * 60 + minute(exit_time))::VARCHAR, 4, '0') AS slot, side, symbol FROM trades", g="""
  SELECT 'date' AS part, date AS name, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'slot', slot, count(*) FROM t GROUP BY 2
  UNION ALL SELECT 'side', side, count(*) FROM t GROUP BY 2 UNION ALL SELECT 'symbol', symbol, count(*) FROM t GROUP BY 2""") + """
SELECT part, name, n, round(n / sum(n) OVER (PARTITION BY part), 8) AS share FROM g""")
def _(spark, d):
    return RS.signal_fingerprint(catalog.trades(spark, d), "exit_time").select("part", "name", "n", rd("share", 8))


EO = dict(t=TR.replace("FROM ticks", "FROM bars").replace("PARTITION BY symbol", "PARTITION BY symbol, session_date"),
          **{k: v.replace("symbol = a.symbol", "symbol = a.symbol AND b.session_date = a.session_date").replace("b.symbol, b.n", "b.symbol, b.session_date, b.n")
             .replace("PARTITION BY symbol", "PARTITION BY symbol, session_date")
             for k, v in sql_fold("ta", "NULL::DOUBLE AS y", wilder_step("a.y", "b.tr", "b.tr14", 14, 14), "").items()})
EO = {"t": EO["t"], "ta": "SELECT *, avg(tr) OVER (PARTITION BY symbol, session_date ORDER BY ts ROWS 13 PRECEDING) AS tr14 FROM t", "num": EO["num"], "walk": EO["walk"],
      "n": NEXT, "duo": """SELECT n.symbol, n.session_date, n.ts, n.entry_ts, n.entry_price, side, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS d, CASE WHEN num.n >= 15 THEN y END AS atr
  FROM n JOIN num USING (symbol, ts) JOIN walk ON walk.symbol = num.symbol AND walk.session_date = num.session_date AND walk.n = num.n, (SELECT unnest(['BUY', 'SELL']) AS side)
  WHERE n.entry_ts IS NOT NULL AND num.n >= 5 AND hour(n.ts) * 60 + minute(n.ts) < 1200"""}


@checks.add("r7_entry_outcomes", with_views("bars", recursive=True, **EO, **resolve_sql("duo")) + """
SELECT symbol, ts, side, exit_ts, replace(outcome, 'EOD_FORCED', 'SQUAREOFF') AS outcome, qty, round(pnl_net, 4) AS pnl_net, round(r_multiple, 5) AS r_multiple FROM res""")
def _(spark, d):
    out = RS.entry_outcomes(catalog.bars(spark, d), X.CLOCK, X.EXITS)
    return out.select("symbol", "ts", "side", "exit_ts", "outcome", "qty", rd("pnl_net", 4), rd("r_multiple", 5))


def own_names(text: str) -> str:
    """The steps of ``EO`` under names that the signal steps leave free."""
    for old, new in ((r"\bta\b", "eta"), (r"\bFROM t\b", "FROM et"), (r"\bnum\b", "enum"), (r"\bwalk\b", "ewalk")):
        text = re.sub(old, new, text)
    return text


N_PERMS = 200
H = "('0x' || substr(md5(concat_ws(':', '42', {})), 1, 8))::BIGINT"
DAYTEXT = "session_date::VARCHAR"
PARTNER = f"((({H.format(f'perm, {DAYTEXT}, r, ' + chr(39) + 'key' + chr(39))} % size - x) % size) + size) % size"
NULLS = dict(
    **SIGNALS, **A.INDEX, n=NEXT, ent=ENT, tz=resolve_sql("ent")["sz"], **{{"t": "et", "ta": "eta", "num": "enum", "walk": "ewalk"}.get(k, k): own_names(v) for k, v in EO.items() if k != "n"}, **resolve_sql("duo"),
    want="SELECT session_date, count(*) AS want FROM tz GROUP BY 1", buys="SELECT avg((side = 'BUY')::INT) AS ratio FROM tz", slots="""
  SELECT slot, sum(k) OVER (ORDER BY slot) / sum(k) OVER () AS upto FROM (SELECT hour(entry_ts) * 60 + minute(entry_ts) AS slot, count(*) AS k FROM tz GROUP BY 1)""", pool="""
  SELECT symbol, session_date, row_number() OVER (PARTITION BY session_date ORDER BY symbol) - 1 AS spot FROM (SELECT DISTINCT symbol, session_date FROM bars)""", swp=f"""
  SELECT perm, session_date, size, k, 0 AS r, k AS x FROM (SELECT perm, session_date, size, unnest(range(least(want, size))) AS k FROM (SELECT session_date, count(*) AS size FROM pool GROUP BY 1) JOIN want USING (session_date),
    (SELECT unnest(range({N_PERMS})) AS perm))
  UNION ALL
  SELECT perm, session_date, size, k, r + 1, CASE WHEN {H.format(f"perm, {DAYTEXT}, r, greatest(x, y), 'coin'")} % 2 = 1 THEN y ELSE x END FROM (SELECT *, {PARTNER} AS y FROM swp WHERE r < {RS.ROUNDS})""", pk=f"""
  SELECT perm, symbol, session_date, {H.format(f"perm, {DAYTEXT}, symbol, 'slot'")} / 4294967296.0::DOUBLE AS u, CASE WHEN {H.format(f"perm, {DAYTEXT}, symbol, 'side'")} / 4294967296.0::DOUBLE < ratio THEN 'BUY' ELSE 'SELL' END AS side
  FROM swp JOIN pool USING (session_date), buys WHERE r = {RS.ROUNDS} AND spot = x""", ps="""
  SELECT pk.*, coalesce((SELECT min(slot) FROM slots WHERE upto > u), (SELECT max(slot) FROM slots)) AS slot FROM pk""", pb="""
  SELECT ps.perm, ps.symbol, ps.session_date, ps.side, min(b.ts) AS ts FROM ps JOIN bars b ON b.symbol = ps.symbol AND b.session_date = ps.session_date AND hour(b.ts) * 60 + minute(b.ts) >= slot GROUP BY 1, 2, 3, 4""", pd="""
  SELECT pb.perm, pnl_net, r_multiple, d, session_date, pb.ts FROM pb JOIN res USING (symbol, session_date, ts, side)""", pg="""
  SELECT pd.* FROM pd ASOF LEFT JOIN trend ON pd.session_date = trend.session_date AND pd.ts >= trend.ts WHERE d * coalesce(trend.trend, 0) >= 0""", nl="""
  SELECT perm, count(*) AS trades, avg(r_multiple) AS expectancy_r, sum(pnl_net) AS total_pnl, avg((pnl_net > 0)::INT) * 100 AS win_rate,
    least(CASE WHEN sum(pnl_net) FILTER (pnl_net <= 0) < 0 THEN coalesce(sum(pnl_net) FILTER (pnl_net > 0), 0) / -sum(pnl_net) FILTER (pnl_net <= 0) ELSE 999 END, 999) AS profit_factor FROM pg GROUP BY 1""")
NULL_NUM = ["expectancy_r", "total_pnl", "win_rate", "profit_factor"]


@checks.add("r7_permutation_null", with_views("bars", "index_bars", recursive=True, **NULLS) + f"""
SELECT perm, coalesce(trades, 0) AS trades, {', '.join(f"round(coalesce({c}, 0), 4) AS {c}" for c in NULL_NUM)} FROM (SELECT unnest(range({N_PERMS})) AS perm) LEFT JOIN nl USING (perm)""")
def _(spark, d):
    bars = catalog.bars(spark, d)
    trades = O.candidate_outcomes(O.in_scan_window(X.signals(spark, d), X.CLOCK), bars, X.CLOCK, X.EXITS)
    out = RS.permutation_null(trades, bars, index_trend(catalog.index_bars(spark, d)), X.CLOCK, X.EXITS, n_perms=N_PERMS, draw=RS.draw_md5)
    return out.select("perm", "trades", *rds(*NULL_NUM, digits=4))


# ---- models ------------------------------------------------------------------------------------
VD = dict(t=TR, lr="""SELECT *, ln(close / lag(close) OVER w) AS ret1, ln(close / lag(close, 2) OVER w) AS ret2, (open - lag(close) OVER w) / lag(close) OVER w AS gap_pct,
    sqrt(pow(ln(greatest(high / low, 1e-9)), 2) / (4 * ln(2))) AS park_vol, count(*) OVER (PARTITION BY symbol) AS cnt FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
          **sql_fold("lr", "b.tr AS y, b.park_vol AS ev", f"a.y + (b.tr - a.y) / 14, {ema_step('a.ev', 'b.park_vol', 10)}", ""), vd=f"""
  SELECT symbol, ts, ret1, ret2, abs(ret1) AS absret1, {', '.join(f"{sql_full('ret1', 'stddev_samp', k)} AS rv{k}" for k in (5, 10, 20))},
    CASE WHEN n >= 14 THEN y END / close AS atr_frac, park_vol, (high - low) / close AS range_pct, gap_pct,
    coalesce((volume - {sql_full('volume', 'avg', 20)}) / nullif({sql_full('volume', 'stddev_samp', 20)}, 0), 0) AS vol_z, (isodow(ts) - 1)::DOUBLE AS dow,
    lead(park_vol) OVER (PARTITION BY symbol ORDER BY ts) AS y_next_vol, ev AS ewma_vol FROM (SELECT num.*, y, ev FROM num JOIN walk USING (symbol, n)) WHERE cnt >= 40""")
VD_OUT = [*M.VOL_FEATURES, "y_next_vol"]


@checks.add("m1_vol_dataset", with_views("ticks", recursive=True, **VD) + f"SELECT symbol, ts, {sql_rd(*VD_OUT, digits=5)} FROM vd WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in VD_OUT))
def _(spark, d):
    return M.complete_rows(M.vol_dataset(catalog.ticks(spark, d))).select("symbol", "ts", *rds(*VD_OUT, digits=5))


@checks.add("m2_vol_model")
def _(spark, d):
    """Importances and validation error of the trained model."""
    model, info = M.train_vol_model(M.vol_dataset(catalog.ticks(spark, d)), max_iter=5, max_depth=3)
    rows = [(info["model"], info["rows"], float(info.get("val_mae") or 0), float(info.get("skill_vs_mean") or 0), ",".join(info.get("top_features", [])))]
    return spark.createDataFrame(rows, "model string, rows long, val_mae double, skill_vs_mean double, top_features string")


@checks.add("m3_vol_forecast")
def _(spark, d):
    data = pinned(M.vol_dataset(catalog.ticks(spark, d)))  # training and forecast read it
    model, _info = M.train_vol_model(data, max_iter=5, max_depth=3)
    return M.vol_forecast(data, model).select("symbol", *rds("pred_vol", "baseline", "scale"), "regime")


BASEL = "SELECT symbol, median(park_vol) AS baseline FROM (SELECT * FROM vd WHERE park_vol IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 20) GROUP BY 1"
FCST = """SELECT symbol, ewma_vol AS pred_vol, baseline, least(greatest(ewma_vol / baseline, 0.65), 1.6) AS scale FROM
  (SELECT * FROM vd QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1) JOIN bl USING (symbol)"""


@checks.add("d21_vol_baseline", with_views("ticks", recursive=True, **VD, bl=BASEL) + "SELECT symbol, round(baseline, 6) AS baseline FROM bl")
def _(spark, d):
    return M.vol_baseline(M.vol_dataset(catalog.ticks(spark, d))).select("symbol", rd("baseline"))


@checks.add("f15_vol_scale_regime", with_views("ticks", recursive=True, **VD, bl=BASEL, fc=FCST) + """
SELECT symbol, round(scale, 5) AS scale, CASE WHEN scale >= 1.2 THEN 'HIGH_VOL' WHEN scale <= 0.85 THEN 'LOW_VOL' ELSE 'NORMAL' END AS regime FROM fc""")
def _(spark, d):
    return M.vol_forecast(M.vol_dataset(catalog.ticks(spark, d))).select("symbol", rd("scale", 5), "regime")


@checks.add("d22_regime_counts", with_views("ticks", recursive=True, **VD, bl=BASEL, fc=FCST) + """
SELECT CASE WHEN scale >= 1.2 THEN 'HIGH_VOL' WHEN scale <= 0.85 THEN 'LOW_VOL' ELSE 'NORMAL' END AS regime, count(*) AS n FROM fc GROUP BY 1""")
def _(spark, d):
    return M.regime_counts(M.vol_forecast(M.vol_dataset(catalog.ticks(spark, d))))


@checks.add("s12_write_forecast_json", with_views("ticks", recursive=True, **VD, bl=BASEL, fc=FCST) + """
SELECT symbol, round(pred_vol, 6) AS pred_vol, round(baseline, 6) AS baseline, round(scale, 5) AS scale, '2024-01-30T22:00:00+00:00' AS generated_utc, 'ewma' AS model FROM fc""")
def _(spark, d):
    path = scratch_path(spark, "vol-forecast")
    fc = M.vol_forecast(M.vol_dataset(catalog.ticks(spark, d)))
    D.forecast_lines(fc, "2024-01-30T22:00:00+00:00", "ewma", 0.2).write.text(path)
    return D.vol_forecasts(spark.read.text(path)).select("symbol", *rds("pred_vol", "baseline"), rd("scale", 5), "generated_utc", "model")


# ---- win-probability grid -----------------------------------------------------------------------
PAIRS = "SELECT * FROM (SELECT s, t, row_number() OVER () - 1 AS pair_no FROM (VALUES " + ", ".join(f"({s}::DOUBLE, {t}::DOUBLE)" for s, t in M.pairs()) + ") v(s, t))"
TRW = dict(t=TR.replace("FROM ticks", "FROM bars"), tn="SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING) AS tr14 FROM t",
           **sql_fold("tn", "NULL::DOUBLE AS y", wilder_step("a.y", "b.tr", "b.tr14", 14, 14), ""), atrs="SELECT num.*, y FROM num JOIN walk USING (symbol, n)")


@checks.add("r9_barrier_labels", with_views("bars", recursive=True, **TRW, pr=PAIRS, c="""
  SELECT atrs.symbol, atrs.ts, atrs.n, close, y, dr, s, t FROM atrs, pr, (SELECT unnest([1, -1]) AS dr) WHERE n % 3 = 0 AND y > 0""", h="""
  SELECT c.symbol, c.ts, dr, s, t, count(*) AS k, min(CASE WHEN (dr > 0 AND low <= c.close - s * c.y) OR (dr < 0 AND high >= c.close + s * c.y) THEN b.n END) AS lose,
    min(CASE WHEN (dr > 0 AND high >= c.close + t * c.y) OR (dr < 0 AND low <= c.close - t * c.y) THEN b.n END) AS win
  FROM c JOIN num b ON b.symbol = c.symbol AND b.n > c.n AND b.n <= c.n + 12 GROUP BY 1, 2, 3, 4, 5""") + """
SELECT symbol, ts, dr::INT AS direction, s AS sl_mult, t AS tgt_mult, (win IS NOT NULL AND (lose IS NULL OR win < lose))::INT AS label FROM h WHERE k = 12""")
def _(spark, d):
    return M.barrier_labels(catalog.bars(spark, d))


# a closed-form probability stands in for the model, so that scoring can be checked in SQL
PROB = "1 / (1 + exp(0.4 * t - 0.3 * s + 3 * ret3 - body_frac / 5))"
SCORE = dict(pr=PAIRS, sc=f"""SELECT symbol, ts, pair_no, s, t, p, p * (t / s) - (1 - p) - CASE WHEN atr_frac > 0 THEN 0.0018 / atr_frac / s ELSE 0 END AS score
  FROM (SELECT *, {PROB} AS p FROM feat, pr WHERE position >= 20 AND ret3 IS NOT NULL)""", bs="""
  SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY score DESC, pair_no) = 1""")


def scored_pairs(spark, d):
    f = feature_frame(catalog.ticks(spark, d), ["symbol"]).filter("position >= 20 and ret3 is not null")
    g = M.rr_grid_cross(f.select("symbol", "ts", "atr_frac", "ret3", "body_frac"))
    s, t = F.col("sl_mult"), F.col("tgt_mult")
    g = g.withColumn("p", 1 / (1 + F.exp(0.4 * t - 0.3 * s + 3 * F.col("ret3") - F.col("body_frac") / 5)))
    return g.withColumn("score", T.grid_score(F.col("p"), s, t, F.col("atr_frac")))


@checks.add("j9_rr_grid_cross", with_views("ticks", pr=PAIRS) + "SELECT symbol, ts, s AS sl_mult, t AS tgt_mult FROM ticks, pr")
def _(spark, d):
    return M.rr_grid_cross(catalog.ticks(spark, d).select("symbol", "ts")).drop("pair_no")


@checks.add("f5_grid_score", with_views("ticks", recursive=True, **FEAT, **SCORE) + """
SELECT symbol, ts, round(max(score), 5) AS best, round(min(score), 5) AS worst, count(*) AS pairs FROM sc GROUP BY 1, 2""")
def _(spark, d):
    return scored_pairs(spark, d).groupBy("symbol", "ts").agg(F.round(F.max("score"), 5).alias("best"), F.round(F.min("score"), 5).alias("worst"), F.count(F.lit(1)).alias("pairs"))


@checks.add("t3_best_by_argmax", with_views("ticks", recursive=True, **FEAT, **SCORE) + "SELECT symbol, ts, s AS sl_mult, t AS tgt_mult, round(score, 5) AS score FROM bs")
def _(spark, d):
    return M.best_by_argmax(scored_pairs(spark, d).select("symbol", "ts", "pair_no", "sl_mult", "tgt_mult", "score"), ["symbol", "ts"]).select("symbol", "ts", "sl_mult", "tgt_mult", rd("score", 5))


@checks.add("d23_best_combo_distribution", with_views("ticks", recursive=True, **FEAT, **SCORE) + "SELECT s AS sl_mult, t AS tgt_mult, count(*) AS n FROM bs GROUP BY 1, 2")
def _(spark, d):
    return M.combo_distribution(M.best_by_argmax(scored_pairs(spark, d).select("symbol", "ts", "pair_no", "sl_mult", "tgt_mult", "score"), ["symbol", "ts"]))


@checks.add("m4_rr_score")
def _(spark, d):
    t = catalog.ticks(spark, d)
    f = feature_frame(t, ["symbol"])
    # trained on the pairs it scores
    model = M.train_win_model(f, M.barrier_labels(t), max_iter=3, max_depth=3)
    # scoring reads the rows twice: write them once
    return M.rr_score(pinned(f), model, ["symbol", "ts"]).select("symbol", "ts", "status", F.array_join("reasons", "|").alias("reasons"), "sl_mult", "tgt_mult", *rds("score", "p"))


# model manifests derived from the suppliers
MAN = """SELECT s_suppkey, concat('m', s_suppkey) AS model_version, CASE WHEN s_suppkey % 9 = 0 THEN 'fs-old' ELSE 'fs-live' END AS h, CASE WHEN s_suppkey % 8 <> 0 THEN 'abc' ELSE '' END AS git,
    s_acctbal / 30000 AS gini, (s_suppkey % 20) / 100.0::DOUBLE AS cov, (s_suppkey % 7 - 2)::DOUBLE AS ex, s_suppkey % 4 <> 0 AS wf, s_suppkey % 5 <> 0 AS lk, s_suppkey % 6 <> 0 AS bc FROM supplier"""


@checks.add("m5_promotion_gate", with_views(mm=MAN, r="""
  SELECT s_suppkey, list_filter([CASE WHEN git = '' THEN 'manifest incomplete: git_commit' END, CASE WHEN h <> 'fs-live' THEN 'feature schema mismatch' END, CASE WHEN gini < 0.1 THEN 'gini too low' END,
    CASE WHEN cov < 0.05 THEN 'coverage too low' END, CASE WHEN ex < 0 THEN 'expectancy after cost < 0' END, CASE WHEN NOT wf THEN 'walk-forward did not pass' END,
    CASE WHEN NOT lk THEN 'leakage checks failed' END, CASE WHEN NOT bc THEN 'no baseline comparison' END], lambda x: x IS NOT NULL) AS l FROM mm""") + """
SELECT s_suppkey, array_to_string(l, '|') AS reasons, len(l) = 0 AS ok FROM r""")
def _(spark, d):
    k = F.col("s_suppkey")
    metrics = F.to_json(F.struct((F.col("s_acctbal") / 30000).alias("gini"), ((k % 20) / 100.0).alias("coverage"), (k % 7 - 2).cast("double").alias("expectancy_after_cost"),
                                 (k % 4 != 0).alias("walk_forward_pass"), (k % 5 != 0).alias("leakage_checks_pass"), F.when(k % 6 != 0, "base").alias("baseline_comparison")))
    text = {c: F.lit("x") for c in M.MANIFEST_FIELDS}
    text.update(model_version=F.concat(F.lit("m"), k.cast("string")), feature_schema_hash=F.when(k % 9 == 0, "fs-old").otherwise("fs-live"),
                git_commit=F.when(k % 8 != 0, "abc").otherwise(""), validation_metrics=metrics)
    m = catalog.table(spark, d, "supplier").select("s_suppkey", *[v.alias(c) for c, v in text.items()])
    return M.promotion_gate(m, "fs-live").select("s_suppkey", F.array_join("reasons", "|").alias("reasons"), "ok")
