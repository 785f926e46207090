"""DuckDB twins of the book: a recursive walk over the ordered signals of every run and session, and a grid of runs around it."""

from __future__ import annotations

from barloom.checks.indicators import TREND
from barloom.checks.outcomes import NEXT, PNL, touch_sql
from barloom.checks.signals import DAY, SIGNALS, votes

# the index trend under names that the signal steps leave free
INDEX = {"ib": TREND["ib"], "inum": TREND["num"], "iwalk": TREND["walk"].replace("num b", "inum b").replace("FROM walk a", "FROM iwalk a"),
         "trend": TREND["trend"].replace("num.*", "inum.*").replace("FROM num JOIN walk", "FROM inum JOIN iwalk")}
IN_WINDOW = "hour(ts) * 60 + minute(ts) BETWEEN 180 AND 1200"

# off (run, session_date, ts, symbol, pattern, score, vol_ratio, strength, direction, trend, gate, top, low, cap, can_enter, exit_ts)
WALK = dict(q="""SELECT *, coalesce(CASE gate WHEN 'off' THEN true WHEN 'strict' THEN direction = trend ELSE direction * trend >= 0 END, false) AS ok,
    row_number() OVER (PARTITION BY run, session_date ORDER BY ts, score DESC NULLS LAST, vol_ratio DESC NULLS LAST, strength DESC NULLS LAST, symbol, pattern) AS n FROM off""", wk="""
  SELECT DISTINCT run, session_date, 0::BIGINT AS n, NULL::TIMESTAMP AS bar, []::VARCHAR[] AS seen, 0 AS tried, false AS is_full, []::TIMESTAMP[] AS busy, []::VARCHAR[] AS traded, NULL::VARCHAR AS word FROM off
  UNION ALL
  SELECT run, session_date, n, ts, CASE WHEN lead THEN list_append(seen, symbol) ELSE seen END, tried + lead::INT, is_full OR word = 'CAP',
    CASE WHEN word = 'TAKEN' THEN list_append(busy, exit_ts) ELSE busy END, CASE WHEN word = 'TAKEN' THEN list_append(traded, symbol) ELSE traded END, word
  FROM (SELECT *, word NOT IN ('HELD', 'GATED', 'DUPLICATE') AS lead FROM (
    SELECT *, CASE WHEN list_contains(traded, symbol) AND NOT list_contains(seen, symbol) THEN 'HELD' WHEN NOT ok THEN 'GATED' WHEN list_contains(seen, symbol) THEN 'DUPLICATE'
      WHEN tried >= top THEN 'BELOW_TOP' WHEN is_full THEN 'CAP_REST' WHEN score < low THEN 'LOW_SCORE' WHEN len(busy) >= cap THEN 'CAP' WHEN NOT can_enter THEN 'NO_ENTRY' ELSE 'TAKEN' END AS word
    FROM (SELECT b.run, b.session_date, b.n, b.ts, b.symbol, b.score, b.ok, b.top, b.low, b.cap, b.can_enter, b.exit_ts, a.traded,
        CASE WHEN a.bar = b.ts THEN a.seen ELSE [] END AS seen, CASE WHEN a.bar = b.ts THEN a.tried ELSE 0 END AS tried, coalesce(a.bar = b.ts AND a.is_full, false) AS is_full,
        CASE WHEN a.bar = b.ts THEN a.busy ELSE list_filter(a.busy, lambda t: t > b.ts) END AS busy
      FROM wk a JOIN q b ON b.run = a.run AND b.session_date = a.session_date AND b.n = a.n + 1)))""",
            done="SELECT q.*, word FROM q JOIN wk USING (run, session_date, n)")
COUNTS = """SELECT run, count(*) FILTER (word <> 'HELD') AS raw_signals, count(*) FILTER (word = 'GATED') AS gate_rejected, count(*) FILTER (word = 'CAP') AS position_cap_hits,
    count(*) FILTER (word = 'TAKEN') AS taken FROM done GROUP BY 1"""


def one_run(resolved: dict[str, str], top: int, low: int, cap: int) -> dict[str, str]:
    """Steps of a single run with the soft gate; ``resolved`` ends in ``res``."""
    return dict(**SIGNALS, **INDEX, n=NEXT, **resolved, sg=f"SELECT * FROM signals WHERE {IN_WINDOW}", st="SELECT sg.*, coalesce(trend.trend, 0) AS trend FROM sg ASOF LEFT JOIN trend ON sg.ts >= trend.ts", off=f"""
  SELECT 0 AS run, st.*, 'soft' AS gate, {top} AS top, {low} AS low, {cap} AS cap, res.symbol IS NOT NULL AS can_enter, res.entry_ts, res.exit_ts, res.outcome, res.pnl_net
  FROM st LEFT JOIN (SELECT symbol, ts, strategy, direction, pattern, entry_ts, exit_ts, outcome, pnl_net FROM res) res USING (symbol, ts, strategy, direction, pattern)""", **WALK)


def grid(turnover: float, cap: int = 5) -> dict[str, str]:
    """Steps of the 162 runs of the default grid, with one turnover floor: ``done`` per signal and run, ``gr`` the grid."""
    dist = "greatest(entry_price * 0.003, least(CASE WHEN atr > 0 THEN am * atr ELSE 0.005 * entry_price END, entry_price * 0.015))"
    pnl = PNL.format(s="side", e="entry_price", x="exit_price", q="qty")
    return dict(
        **{k: v for k, v in SIGNALS.items() if k not in ("firsts", "ex", "signals")}, **INDEX, n=NEXT, gr=f"""
  SELECT run::INT AS run, [1.0, 1.5, 2.0][1 + run // 54 % 3]::DOUBLE AS atr_mult, [1.5, 2.0, 2.5][1 + run // 18 % 3]::DOUBLE AS reward_ratio, [6, 7, 8][1 + run // 6 % 3] AS low,
    run // 3 % 2 = 0 AS conf, ['off', 'soft', 'strict'][1 + run % 3] AS gate, 30 AS top, {cap} AS cap FROM range(162) x(run)""", pv=f"""
  SELECT symbol, ts, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM bars WINDOW w AS ({DAY} ORDER BY ts)""", cs=f"""
  SELECT symbol, session_date, ts, hit_no, pattern, strategy, dr::INT AS direction, CASE WHEN dr > 0 THEN 'BUY' ELSE 'SELL' END AS side, strength::INT AS strength, (strength + len({votes('dr')}))::INT AS score,
    ratio AS vol_ratio, satr AS atr, ph IS NULL OR (dr > 0 AND close > ph) OR (dr < 0 AND close < pl) AS confirmed FROM cand JOIN pv USING (symbol, ts) WHERE close * av / 1e5 >= {turnover}""", fs=f"""
  SELECT * FROM (SELECT * FROM cs, (SELECT unnest([true, false]) AS conf) WHERE confirmed OR NOT conf
    QUALIFY row_number() OVER (PARTITION BY conf, symbol, session_date, strategy, direction ORDER BY ts, hit_no) = 1) WHERE {IN_WINDOW}""",
        st="SELECT fs.*, coalesce(trend.trend, 0) AS trend FROM fs ASOF LEFT JOIN trend ON fs.ts >= trend.ts", sz=f"""
  SELECT *, entry_price - d * dist AS sl, entry_price + d * rr * dist AS tgt, greatest(0, least(floor(500 / dist), floor(25000 / entry_price)))::BIGINT AS qty FROM (SELECT *, {dist} AS dist FROM (
    SELECT DISTINCT fs.symbol, fs.session_date, fs.ts, fs.strategy, fs.pattern, fs.side, fs.direction AS d, fs.atr, n.entry_ts, n.entry_price, am, rr FROM fs JOIN n USING (symbol, ts),
      (SELECT unnest([1.0, 1.5, 2.0])::DOUBLE AS am), (SELECT unnest([1.5, 2.0, 2.5])::DOUBLE AS rr) WHERE n.entry_ts IS NOT NULL))""",
        rx=touch_sql("sz", more=", strategy, pattern, am, rr"), res=f"SELECT *, pnl_net / greatest(dist * qty, 1e-9) AS r_multiple FROM (SELECT *, {pnl} AS pnl_net FROM rx)", off="""
  SELECT gr.run, st.*, gr.gate, gr.top, gr.low, gr.cap, coalesce(res.qty > 0, false) AS can_enter, res.exit_ts, res.pnl_net, res.r_multiple
  FROM st JOIN gr USING (conf) LEFT JOIN res ON res.symbol = st.symbol AND res.ts = st.ts AND res.strategy = st.strategy AND res.pattern = st.pattern AND res.side = st.side AND res.am = gr.atr_mult AND res.rr = gr.reward_ratio""", **WALK)


def summary(name: str, where: str = "true") -> dict[str, str]:
    """Steps ``<name>``: performance, counters and fitness per run over the sessions of ``where``."""
    return {f"{name}d": f"SELECT * FROM done WHERE {where}", f"{name}k": COUNTS.replace("FROM done", f"FROM {name}d"), f"{name}t": f"SELECT * FROM {name}d WHERE word = 'TAKEN'", f"{name}p": f"""
  SELECT run, count(*) AS trades, count(*) FILTER (pnl_net > 0) AS wins, count(*) FILTER (pnl_net <= 0) AS losses, 100.0 * count(*) FILTER (pnl_net > 0) / count(*) AS win_rate, avg(r_multiple) AS expectancy_r,
    least(CASE WHEN sum(pnl_net) FILTER (pnl_net <= 0) < 0 THEN coalesce(sum(pnl_net) FILTER (pnl_net > 0), 0) / -sum(pnl_net) FILTER (pnl_net <= 0) ELSE 999 END, 999) AS profit_factor FROM {name}t GROUP BY 1""", f"{name}e": f"""
  SELECT run, exit_ts, 100000 + sum(sum(pnl_net)) OVER (PARTITION BY run ORDER BY exit_ts) AS equity FROM {name}t GROUP BY 1, 2""", f"{name}x": f"""
  SELECT run, max((peak - equity) / peak) * 100 AS max_drawdown_pct FROM (SELECT *, greatest(100000, max(equity) OVER (PARTITION BY run ORDER BY exit_ts)) AS peak FROM {name}e) GROUP BY 1""", f"{name}y": f"""
  SELECT run, CASE WHEN stddev_samp(c) > 0 THEN avg(c) / stddev_samp(c) * sqrt(252) ELSE 0 END AS sharpe_annual FROM (SELECT run, equity / lag(equity) OVER (PARTITION BY run ORDER BY day) - 1 AS c FROM
    (SELECT run, exit_ts::DATE AS day, 100000 + sum(sum(pnl_net)) OVER (PARTITION BY run ORDER BY exit_ts::DATE) AS equity FROM {name}t GROUP BY 1, 2)) GROUP BY 1""", name: f"""
  SELECT gr.run, atr_mult, reward_ratio, gate, coalesce(trades, 0) AS trades, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, coalesce(raw_signals, 0) AS raw_signals, coalesce(gate_rejected, 0) AS gate_rejected,
    coalesce(position_cap_hits, 0) AS position_cap_hits, win_rate, profit_factor, expectancy_r, max_drawdown_pct, sharpe_annual,
    CASE WHEN coalesce(trades, 0) <= 0 THEN -999 ELSE (2 * expectancy_r + least(profit_factor, 5) - 1) * (trades / (trades + 30.0::DOUBLE)) * greatest(0, 1 - coalesce(max_drawdown_pct, 0) / 20) END AS fitness
  FROM gr LEFT JOIN {name}p USING (run) LEFT JOIN {name}x USING (run) LEFT JOIN {name}y USING (run) LEFT JOIN {name}k USING (run)"""}
