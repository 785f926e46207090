"""Levels, patterns, gates and candidate signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import catalog
from barloom.checks import stand_ins as X
from barloom.checks.indicators import ADX, SNAP, TR, TREND, ema_step, frame, sql_fold, wilder_step
from barloom.checks.registry import Checks, rd, rds, sql_rd
from barloom.checks.views_sql import with_views
from barloom.operators import asof, clean as C, gates as G, levels as L, lookups as K, patterns as P
from barloom.operators.layout import scratch_path
from barloom.operators.recursive import confluence_inputs, index_trend, recursive
from barloom.operators.rolling import volume_ratio
from barloom.plans import signals as S
from barloom.sources import bars as B, dimensions as D

checks = Checks()

DAY = "PARTITION BY symbol, session_date"
OR = f"""SELECT *, CASE WHEN count(*) FILTER (hour(ts) < 3) OVER d >= 3 THEN max(high) FILTER (hour(ts) < 3) OVER d END AS or_high,
  CASE WHEN count(*) FILTER (hour(ts) < 3) OVER d >= 3 THEN min(low) FILTER (hour(ts) < 3) OVER d END AS or_low
  FROM bars WINDOW d AS ({DAY})"""


@checks.add("w25_opening_range", with_views("bars", o=OR) + """
SELECT DISTINCT symbol, session_date, round(or_high, 6) AS or_high, round(or_low, 6) AS or_low FROM o""")
def _(spark, d):
    return (L.opening_range(catalog.bars(spark, d), X.CLOCK)
            .select("symbol", "session_date", *rds("or_high", "or_low")).distinct())


SWING = f"""SELECT *, count(*) OVER s = 7 AND high = max(high) OVER s AS sh, count(*) OVER s = 7 AND low = min(low) OVER s AS sl
  FROM {{src}} WINDOW s AS ({DAY} ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""


@checks.add("w26_swing_points", with_views("bars", w=SWING.format(src="bars")) + """
SELECT symbol, ts, round(high, 6) AS high, round(low, 6) AS low, sh AS swing_high, sl AS swing_low FROM w WHERE sh OR sl""")
def _(spark, d):
    lay = L.session_layout(catalog.bars(spark, d))
    lay = lay.with_columns(**L.swing_flags(lay))
    return lay.df.filter("swing_high or swing_low").select("symbol", "ts", *rds("high", "low"), "swing_high", "swing_low")


TRB = TR.replace("FROM ticks", "FROM bars")
OBN = "SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS tr20 FROM t"
ZONES = dict(t=TRB, t20=OBN, **sql_fold("t20", "NULL::DOUBLE AS y", wilder_step("a.y", "b.tr", "b.tr20", 20, 20), ""), zw="""
  SELECT num.*, y, max(close) OVER nx AS mc, min(close) OVER nx AS nc, max(high) OVER nx AS mh, min(low) OVER nx AS nl,
    max(high) OVER pr AS ph, min(low) OVER pr AS pl, count(*) OVER nx AS nn, count(*) OVER (PARTITION BY symbol) AS cnt
  FROM num JOIN walk USING (symbol, n)
  WINDOW nx AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING),
         pr AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""", zones="""
  SELECT symbol, session_date, CASE WHEN mc - close > y AND mh > ph AND close < open THEN 'BULL'
      WHEN close - nc > y AND nl < pl AND close > open THEN 'BEAR' END AS ob_type, strftime(ts, '%H:%M') AS ob_time,
    greatest(open, close) AS ob_body_high, least(open, close) AS ob_body_low, high AS ob_high, low AS ob_low
  FROM zw WHERE n > 20 AND nn = 3 AND cnt >= 25 AND y > 0 AND hour(ts) * 60 + minute(ts) BETWEEN 0 AND 18 * 60
    AND CASE WHEN mc - close > y AND mh > ph AND close < open THEN 1 WHEN close - nc > y AND nl < pl AND close > open THEN 1 END = 1""")
ZONE_OUT = ["ob_body_high", "ob_body_low", "ob_high", "ob_low"]


@checks.add("w27_order_blocks", with_views("bars", recursive=True, **ZONES) + f"""
SELECT symbol, session_date, ob_type, ob_time, {sql_rd(*ZONE_OUT)} FROM zones""")
def _(spark, d):
    return X.zones(spark, d).select("symbol", "session_date", "ob_type", "ob_time", *rds(*ZONE_OUT))


# names differ from the zone walk so that one statement can hold both
GAPS = dict(days="""SELECT symbol, session_date, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, ts) AS close FROM bars GROUP BY 1, 2""", gt="""
  SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, row_number() OVER w AS n FROM (SELECT *,
    coalesce(lag(close) OVER w, close) AS pc, lag(close) OVER w AS prev_close FROM days
    WINDOW w AS (PARTITION BY symbol ORDER BY session_date)) WINDOW w AS (PARTITION BY symbol ORDER BY session_date)""", gn="""
  SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY n ROWS 13 PRECEDING) AS tr14 FROM gt""", gwalk=f"""
  SELECT b.symbol, b.n, NULL::DOUBLE AS y FROM gn b WHERE b.n = 1 UNION ALL
  SELECT b.symbol, b.n, {wilder_step('a.y', 'b.tr', 'b.tr14', 14, 14)} FROM gwalk a JOIN gn b ON b.symbol = a.symbol AND b.n = a.n + 1""",
            gaps="""
  SELECT symbol, session_date, prev_close, open AS today_open, abs(open - prev_close) / prev_close * 100 AS gap_pct,
    CASE WHEN open > prev_close THEN 'UP' ELSE 'DOWN' END AS gap_dir, atr AS daily_atr
  FROM (SELECT gn.*, lag(y) OVER (PARTITION BY symbol ORDER BY n) AS atr FROM gn JOIN gwalk USING (symbol, n))
  WHERE atr > 0 AND abs(open - prev_close) / prev_close * 100 BETWEEN 0.2 AND 3.0""")
GAP_NUM = ["prev_close", "today_open", "gap_pct", "daily_atr"]


@checks.add("w28_gap_days", with_views("bars", recursive=True, **GAPS) + f"""
SELECT symbol, session_date, gap_dir, {sql_rd(*GAP_NUM)} FROM gaps""")
def _(spark, d):
    return X.gaps(spark, d).select("symbol", "session_date", "gap_dir", *rds(*GAP_NUM))


@checks.add("s5_read_dim_tables", with_views("bars", recursive=True, **ZONES, **{k: v for k, v in GAPS.items()}) + """
SELECT 'zone' AS kind, upper(symbol) AS symbol, session_date, count(*) AS rows, round(sum(ob_high), 5) AS total FROM zones GROUP BY 2, 3
UNION ALL SELECT 'gap', upper(symbol), session_date, count(*), round(sum(prev_close), 5) FROM gaps GROUP BY 2, 3""")
def _(spark, d):
    zp, gp = scratch_path(spark, "zones"), scratch_path(spark, "gaps")
    B.write_csv(X.zones(spark, d).withColumnRenamed("session_date", "date"), zp)
    B.write_csv(X.gaps(spark, d).withColumnRenamed("session_date", "date"), gp)
    def tally(df, kind, x):
        return df.groupBy(F.lit(kind).alias("kind"), "symbol", "session_date").agg(
            F.count(F.lit(1)).alias("rows"), F.round(F.sum(x), 5).alias("total"))
    return tally(D.read_zones(spark, zp), "zone", "ob_high").unionByName(tally(D.read_gaps(spark, gp), "gap", "prev_close"))


@checks.add("j5_prev_day_join", with_views("bars", days=GAPS["days"]) + """
SELECT b.symbol, b.ts, round(b.close, 6) AS close, round(d.pc, 6) AS prev_close FROM bars b JOIN
  (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY session_date) AS pc FROM days) d USING (symbol, session_date)""")
def _(spark, d):
    b = catalog.bars(spark, d)
    prev = L.previous_day(C.daily_bars(b, ["symbol"])).select("symbol", "session_date", "prev_close")
    return b.join(prev, ["symbol", "session_date"]).select("symbol", "ts", *rds("close", "prev_close"))


CROSS = f"""SELECT *, lag(close) OVER (PARTITION BY symbol, session_date ORDER BY ts) AS pc,
  row_number() OVER (PARTITION BY symbol, session_date ORDER BY ts) AS k, hour(ts) * 60 + minute(ts) AS m FROM o"""


@checks.add("w29_level_cross", with_views("bars", o=OR, c=CROSS) + """
SELECT symbol, ts, 'ORB Long' AS name, 1::INT AS direction FROM c WHERE close > or_high AND pc <= or_high AND m >= 180 AND m < 840 AND k >= 4
UNION ALL SELECT symbol, ts, 'ORB Short', -1 FROM c WHERE close < or_low AND pc >= or_low AND m >= 180 AND m < 840 AND k >= 4
UNION ALL SELECT symbol, ts, 'GapFill Long', 1 FROM c WHERE close > or_high AND pc <= or_high AND m >= 180 AND m < 960 AND k >= 4
UNION ALL SELECT symbol, ts, 'GapFill Short', -1 FROM c WHERE close < or_low AND pc >= or_low AND m >= 180 AND m < 960 AND k >= 4""")
def _(spark, d):
    lay = L.session_layout(L.opening_range(catalog.bars(spark, d), X.CLOCK))
    lay = P.with_lags(lay).with_columns(k=lay.position())
    lay = lay.with_columns(hits=P.found(P.level_cross_hits(X.CLOCK)))
    return (lay.df.filter("k >= 4").select("symbol", "ts", F.explode("hits").alias("h"))
            .select("symbol", "ts", "h.name", "h.direction"))


CANDLE = f"""SELECT *, lag(open, 2) OVER w AS o0, lag(high, 2) OVER w AS h0, lag(low, 2) OVER w AS l0, lag(close, 2) OVER w AS c0,
  lag(open) OVER w AS o1, lag(close) OVER w AS c1, abs(close - open) AS b2, greatest(high - low, 1e-9) AS r2,
  high - greatest(open, close) AS uw, least(open, close) - low AS lw FROM {{src}} WINDOW w AS ({DAY} ORDER BY ts)"""
CANDLE_HITS = """SELECT *, list_filter([
    CASE WHEN c1 < o1 AND close > open AND open <= c1 AND close >= o1 AND b2 > abs(c1 - o1) THEN 'Bullish Engulfing' END,
    CASE WHEN c1 > o1 AND close < open AND open >= c1 AND close <= o1 AND b2 > abs(c1 - o1) THEN 'Bearish Engulfing' END,
    CASE WHEN b2 > 0 AND lw >= 2 * b2 AND uw <= 0.3 * b2 AND b2 / r2 <= 0.35 THEN 'Hammer' END,
    CASE WHEN b2 > 0 AND uw >= 2 * b2 AND lw <= 0.3 * b2 AND b2 / r2 <= 0.35 THEN 'Shooting Star' END,
    CASE WHEN c0 < o0 AND abs(c0 - o0) > 0.6 * greatest(h0 - l0, 1e-9) AND abs(c1 - o1) < 0.4 * abs(c0 - o0) AND close > open
      AND b2 > 0.6 * r2 AND close > (o0 + c0) / 2 THEN 'Morning Star' END,
    CASE WHEN c0 > o0 AND abs(c0 - o0) > 0.6 * greatest(h0 - l0, 1e-9) AND abs(c1 - o1) < 0.4 * abs(c0 - o0) AND close < open
      AND b2 > 0.6 * r2 AND close < (o0 + c0) / 2 THEN 'Evening Star' END], lambda x: x IS NOT NULL) AS names
  FROM cw WHERE c0 IS NOT NULL"""


@checks.add("w30_candle_patterns", with_views("bars", cw=CANDLE.format(src="bars"), ch=CANDLE_HITS) + """
SELECT symbol, ts, array_to_string(names, '|') AS names FROM ch WHERE len(names) > 0""")
def _(spark, d):
    lay = L.session_layout(catalog.bars(spark, d))
    lay = P.with_lags(lay).with_columns(hits=P.found(P.candle_hits()))
    return lay.df.filter(F.size("hits") > 0).select("symbol", "ts", F.array_join("hits.name", "|").alias("names"))


STAR = """abs(close - open) / greatest(high - low, 1e-9) <= 0.35
  AND (close = open OR high - greatest(open, close) >= 2 * abs(close - open))
  AND high - greatest(open, close) > least(open, close) - low AND (close - low) / greatest(high - low, 1e-9) <= 0.5"""


@checks.add("w31_shooting_star", with_views("ticks") + f"SELECT symbol, ts FROM ticks WHERE {STAR}")
def _(spark, d):
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return catalog.ticks(spark, d).filter(P.shooting_star(o, h, l, c)).select("symbol", "ts")


@checks.add("f17_bar_shape", with_views("ticks") + """
SELECT symbol, ts, round((high - low) / close, 6) AS range_pct, round(abs(close - open) / CASE WHEN high > low THEN high - low ELSE 1e-9 END, 6) AS body_frac,
  round(high - greatest(open, close), 6) AS upper_wick, round(least(open, close) - low, 6) AS lower_wick, CAST(isodow(ts) - 1 AS INT) AS dow FROM ticks""")
def _(spark, d):
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    shape = P.bar_shape(o, h, l, c, F.col("ts"))
    return catalog.ticks(spark, d).withColumns(shape).select("symbol", "ts", *rds("range_pct", "body_frac", "upper_wick", "lower_wick"), "dow")


# a simple directional signal on every bar drives the gate operators
SIG = """SELECT symbol, ts, session_date, close, high, low, volume, CASE WHEN close >= open THEN 1 ELSE -1 END::INT AS direction FROM bars"""


def bar_signals(spark, d):
    return catalog.bars(spark, d).withColumn("direction", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1))


# index trend on every other hour only, so that the as-of search has gaps to bridge
SPARSE = "SELECT * FROM trend WHERE hour(ts) % 3 = 1 AND day(session_date) % 7 <> 0"


def sparse_trend(spark, d):
    t = index_trend(catalog.index_bars(spark, d))
    return t.filter((F.hour("ts") % 3 == 1) & (F.dayofmonth("session_date") % 7 != 0)).select("ts", "trend")


@checks.add("j1_asof_trend", with_views("bars", "index_bars", recursive=True, **TREND, sp=SPARSE, sig=SIG) + """
SELECT sig.symbol, sig.ts, coalesce(sp.trend, 0)::INT AS trend FROM sig ASOF LEFT JOIN sp ON sig.ts >= sp.ts""")
def _(spark, d):
    return asof.asof_join(bar_signals(spark, d), sparse_trend(spark, d), "trend", default=F.lit(0)).select("symbol", "ts", "trend")


@checks.add("j2_asof_trend_same_day", with_views("bars", "index_bars", recursive=True, **TREND, sp=SPARSE, sig=SIG) + """
SELECT symbol, ts, trend FROM (SELECT sig.*, coalesce(sp.trend, 0)::INT AS trend
  FROM sig ASOF LEFT JOIN sp ON sig.session_date = sp.session_date AND sig.ts >= sp.ts)
WHERE direction * trend >= 0""")
def _(spark, d):
    out = asof.asof_join(bar_signals(spark, d), sparse_trend(spark, d), "trend", default=F.lit(0), same_bucket=True)
    return out.filter(G.index_gate(F.col("direction"), F.col("trend"))).select("symbol", "ts", "trend")


@checks.add("p9_index_gate", with_views("bars", "index_bars", recursive=True, **TREND, sig=SIG) + """
SELECT symbol, sig.ts, direction * trend >= 0 AS soft, direction = trend AS strict FROM sig JOIN trend ON sig.ts = trend.ts""")
def _(spark, d):
    t = index_trend(catalog.index_bars(spark, d)).select("ts", "trend")
    a, b = F.col("direction"), F.col("trend")
    return bar_signals(spark, d).join(t, "ts").select("symbol", "ts", G.index_gate(a, b).alias("soft"),
                                                      G.index_gate(a, b, "strict").alias("strict"))


AVGV = f"""CASE WHEN count(*) OVER pv >= 5 THEN avg(volume) OVER pv ELSE 0 END"""
PV = f"WINDOW pv AS ({DAY} ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@checks.add("p10_liquidity_filter", with_views("bars", a=f"SELECT *, {AVGV} AS av FROM bars {PV}") + """
SELECT symbol, ts, round(av, 6) AS avg_volume FROM a WHERE av > 0 AND close * av / 1e5 >= 0.003""")
def _(spark, d):
    from barloom.operators.rolling import average_volume_before

    lay = L.session_layout(catalog.bars(spark, d))
    lay = lay.with_columns(avg_volume=average_volume_before(lay))
    return lay.df.filter(G.liquid(F.col("close"), F.col("avg_volume"), 0.003)).select("symbol", "ts", rd("avg_volume"))


@checks.add("p11_trend_strength_filter", with_views("ticks", recursive=True, **ADX) + """
SELECT num.symbol, ts FROM adxw JOIN num USING (symbol, n) WHERE NOT coalesce(n >= 28 AND y > 0 AND y < 20, false)""")
def _(spark, d):
    df = recursive(catalog.ticks(spark, d), ["symbol"], {"adx": "adx:14"})
    return df.filter(G.trending(F.col("adx"), F.lit(28))).select("symbol", "ts")


@checks.add("p12_confirmation_filter", with_views("bars", sig=SIG, p=f"""
  SELECT *, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM sig WINDOW w AS ({DAY} ORDER BY ts)""") + """
SELECT symbol, ts, direction FROM p WHERE ph IS NULL OR (direction > 0 AND close > ph) OR (direction < 0 AND close < pl)""")
def _(spark, d):
    lay = L.session_layout(bar_signals(spark, d))
    lay = lay.with_columns(ok=G.confirmed(lay, F.col("direction")))
    return lay.df.filter("ok").select("symbol", "ts", "direction")


@checks.add("p13_volume_gates", with_views("ticks", recursive=True, **sql_fold(
    "ticks", "b.volume::DOUBLE AS v20", ema_step("a.v20", "b.volume", 20), "")) + f"""
SELECT symbol, ts, coalesce(volume / nullif(CASE WHEN pc >= 5 THEN pa END, 0) >= 1.2, false) AS busy, volume < v20 AS quiet
FROM (SELECT num.symbol, ts, volume, v20, count(*) {frame(20, '1 PRECEDING').replace('symbol', 'num.symbol')} AS pc,
        avg(volume) {frame(20, '1 PRECEDING').replace('symbol', 'num.symbol')} AS pa FROM walk JOIN num USING (symbol, n))""")
def _(spark, d):
    from barloom.operators.layout import lay_out
    from barloom.operators.recursive import WARM_ROWS, recursive_columns

    lay = lay_out(catalog.ticks(spark, d), ["symbol"], ["ts"], back=WARM_ROWS)
    lay = lay.with_columns(ratio=volume_ratio(lay))
    df = recursive_columns(lay, {"volume_ema": "volume_ema:20"}).finish()
    return df.select("symbol", "ts", F.coalesce(F.col("ratio") >= 1.2, F.lit(False)).alias("busy"),
                     (F.col("volume") < F.col("volume_ema")).alias("quiet"))


def sess(sql: dict) -> dict:
    """The recursive steps of a series of ticks, per (symbol, session) of the bars instead."""
    src = dict(sessions="""SELECT concat(o.symbol, '|', session_date) AS symbol, o.symbol AS sym, ts, session_date, open, high, low, close,
      volume, or_high, or_low FROM o""")
    return {**src, **{k: v.replace("FROM ticks", "FROM sessions") for k, v in sql.items()}}


# everything the signal rules read, one row per bar
RICH = dict(o=OR, **sess(SNAP), atrn="SELECT num.*, avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING) AS tr14 FROM num",
            atrw=f"""SELECT b.symbol, b.n, NULL::DOUBLE AS y, b.volume::DOUBLE AS ve FROM atrn b WHERE b.n = 1 UNION ALL
  SELECT b.symbol, b.n, {wilder_step('a.y', 'b.tr', 'b.tr14', 14, 14)}, {ema_step('a.ve', 'b.volume', 20)}
  FROM atrw a JOIN atrn b ON b.symbol = a.symbol AND b.n = a.n + 1""", rich="""
  SELECT ind.* EXCLUDE (symbol), num.sym AS symbol, or_high, or_low, ve AS volume_ema,
    coalesce(CASE WHEN ind.n >= 15 AND y > 0 THEN y END, ind.close * 0.005) AS atr,
    CASE WHEN count(*) OVER pv >= 5 THEN avg(ind.volume) OVER pv ELSE 0 END AS av,
    CASE WHEN ind.n >= 3 THEN sum((ind.high + ind.low + ind.close) / 3 * ind.volume) OVER up / greatest(sum(ind.volume) OVER up, 1) END AS vwap
  FROM ind JOIN num USING (symbol, ts) JOIN atrw ON atrw.symbol = ind.symbol AND atrw.n = ind.n
  WINDOW pv AS (PARTITION BY ind.symbol ORDER BY ind.ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
         up AS (PARTITION BY ind.symbol ORDER BY ind.ts)""")


def votes(d: str) -> str:
    """Confluence tags of a row with direction ``d`` as a DuckDB list."""
    return f"""CASE WHEN n < 5 THEN [] ELSE list_filter([
    CASE WHEN {d} > 0 AND rsi >= 45 AND rsi < 70 THEN 'RSI+' WHEN {d} < 0 AND rsi > 30 AND rsi <= 55 THEN 'RSI-' END,
    CASE WHEN supertrend = {d} THEN 'ST+' END,
    CASE WHEN {d} > 0 AND close >= ema20 THEN 'EMA+' WHEN {d} < 0 AND close <= ema20 THEN 'EMA-' END,
    CASE WHEN {d} > 0 AND cmf > 0 THEN 'CMF+' WHEN {d} < 0 AND cmf < 0 THEN 'CMF-' END,
    CASE WHEN {d} > 0 AND macd_hist > 0 THEN 'MACD+' WHEN {d} < 0 AND macd_hist < 0 THEN 'MACD-' END], lambda x: x IS NOT NULL) END"""


@checks.add("f6_confluence_score", with_views("ticks", recursive=True, **SNAP, dirs="SELECT unnest([1, -1])::INT AS direction") + f"""
SELECT symbol, ts, direction, len({votes('direction')})::INT AS boost, array_to_string({votes('direction')}, ',') AS tags FROM ind, dirs""")
def _(spark, d):
    from barloom.operators.layout import lay_out
    from barloom.operators.recursive import WARM_ROWS

    lay = confluence_inputs(lay_out(catalog.ticks(spark, d), ["symbol"], ["ts"], back=WARM_ROWS))
    df = lay.finish().withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1))))
    boost, tags = G.confluence()
    return df.select("symbol", "ts", "direction", boost.alias("boost"), tags.alias("tags"))


@checks.add("j3_join_gap", with_views("bars", recursive=True, **GAPS, sig=SIG) + """
SELECT symbol, ts, direction, round(gap_pct, 6) AS gap_pct, gap_dir FROM sig JOIN gaps USING (symbol, session_date)
WHERE gap_pct BETWEEN 0.2 AND 3.0 AND ((direction < 0 AND gap_dir = 'UP') OR (direction > 0 AND gap_dir = 'DOWN'))""")
def _(spark, d):
    return K.join_gap(bar_signals(spark, d), X.gaps(spark, d), X.ENTRY).select("symbol", "ts", "direction", rd("gap_pct"), "gap_dir")


ZJ = """SELECT symbol, ts, zone_hi FROM (
    SELECT s.symbol, s.ts, s.close, z.ob_body_high AS zone_hi, row_number() OVER (PARTITION BY s.symbol, s.ts ORDER BY z.ob_time) AS k
    FROM bars s JOIN zones z ON s.symbol = z.symbol AND s.session_date = z.session_date AND z.ob_type = 'BEAR'
      AND z.ob_time < strftime(s.ts, '%H:%M') AND s.high >= z.ob_body_low AND s.high <= z.ob_body_high + 0.5 * (s.close * 0.005){extra})
  WHERE k = 1 AND zone_hi + 0.05 - close > 0 AND (zone_hi + 0.05 - close) / close <= 0.02"""


@checks.add("j4_join_zone", with_views("bars", recursive=True, **ZONES) + f"""
SELECT 'first' AS search, symbol, ts, round(zone_hi, 6) AS zone_hi FROM ({ZJ.format(extra='')}) UNION ALL
SELECT 'stop_first', symbol, ts, round(zone_hi, 6) FROM ({ZJ.format(extra=' AND z.ob_body_high + 0.05 - s.close > 0 AND (z.ob_body_high + 0.05 - s.close) / s.close <= 0.02')})""")
def _(spark, d):
    hits, zones = catalog.bars(spark, d).withColumn("atr", F.col("close") * 0.005), X.zones(spark, d)
    parts = [K.join_zone(hits, zones, X.ENTRY, stop_first=s).select(F.lit(n).alias("search"), "symbol", "ts", rd("zone_hi"))
             for n, s in (("first", False), ("stop_first", True))]
    return parts[0].unionByName(parts[1])


@checks.add("w32_first_per_day", with_views("bars", sig=SIG) + """
SELECT symbol, session_date, direction, min(ts) AS ts FROM sig GROUP BY 1, 2, 3""")
def _(spark, d):
    s = bar_signals(spark, d).select("symbol", "session_date", "direction", "ts")
    return G.first_per_day(s, ["symbol", "session_date", "direction"], ["ts"])


# levels around each bar's close: swings of its session, range, VWAP, round numbers
LEV = """SELECT *, list_reduce(list_transform(list_sort(list_filter(pool, lambda x: x > 0)), lambda x: [x]),
    lambda a, x: CASE WHEN abs(x[1] - a[-1]) / greatest(a[-1], 1e-9) > 0.0015 THEN a || x ELSE a END) AS levels
  FROM (SELECT *, list_filter(coalesce(list_concat(hs, ls), []), lambda x: x IS NOT NULL)
      || list_filter([or_high, or_low, vwap], lambda x: x IS NOT NULL) || [base - st, base, base + st, base + 2 * st, base - 2 * st] AS pool
    FROM (SELECT *, round_even(close / st, 0) * st AS base FROM
      (SELECT *, greatest(round_even(close * 0.005, 0), 1) AS st,
        list(high) FILTER (sh) OVER f AS hs, list(low) FILTER (sl) OVER f AS ls
       FROM sw WINDOW f AS (PARTITION BY symbol, session_date ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING))))"""
LEVELS = dict(**RICH, sw=SWING.format(src="rich"), lev=LEV)


@checks.add("f3_structure_levels", with_views("bars", recursive=True, **LEVELS) + """
SELECT symbol, ts, len(levels)::INT AS n_levels, round(list_sum(levels), 5) AS total FROM lev""")
def _(spark, d):
    df = S.enrich(catalog.bars(spark, d), X.CLOCK)
    lv = L.structure_levels(F.col("swings"), F.col("close"), [F.col(c) for c in ("or_high", "or_low", "vwap")], X.LEVELS)
    return df.withColumn("lv", lv).select("symbol", "ts", F.size("lv").alias("n_levels"),
                                          F.round(F.aggregate("lv", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


EXIT = """SELECT * , CASE WHEN reward1 > 5 * risk THEN close + dr * 5 * risk WHEN reward0 < 1.2 * risk THEN close + dr * 1.2 * risk
    ELSE target0 END AS target, reward1 / greatest(risk, 1e-9) AS rr,
    CASE WHEN fl IS NULL THEN 'atr_fallback' ELSE 'structure' END || CASE WHEN risk0 > 0.015 * close THEN '+capped' ELSE '' END AS sl_method,
    CASE WHEN wall IS NULL THEN 'rr_fallback' ELSE 'structure' END || CASE WHEN reward0 < 1.2 * risk THEN '+minrr' ELSE '' END
      || CASE WHEN reward1 > 5 * risk THEN '+capped' ELSE '' END AS tgt_method FROM (
  SELECT *, greatest(reward0, 1.2 * risk) AS reward1 FROM (
  SELECT *, abs(target0 - close) AS reward0, least(risk0, 0.015 * close) AS risk,
    CASE WHEN risk0 > 0.015 * close THEN close - dr * 0.015 * close ELSE stop0 END AS stop FROM (
  SELECT *, coalesce(wall - dr * 0.15 * atr, close + dr * 2 * abs(close - stop0)) AS target0, abs(close - stop0) AS risk0 FROM (
  SELECT *, coalesce(fl - dr * 0.2 * atr, close - dr * 1.5 * atr) AS stop0 FROM (
  SELECT {src}.*, CASE WHEN dr > 0 THEN list_min(list_filter(levels, lambda x: x > close + 0.15 * atr))
      ELSE list_max(list_filter(levels, lambda x: x < close - 0.15 * atr)) END AS wall,
    CASE WHEN dr > 0 THEN list_max(list_filter(levels, lambda x: x < close - 0.2 * atr))
      ELSE list_min(list_filter(levels, lambda x: x > close + 0.2 * atr)) END AS fl FROM {src})))))"""


@checks.add("f4_structure_exit", with_views("bars", recursive=True, **LEVELS, ld="""
  SELECT lev.*, dr FROM lev, (SELECT unnest([1, -1]) AS dr)""", ex=EXIT.format(src="ld")) + """
SELECT symbol, ts, dr::INT AS direction, round(stop, 6) AS stop, round(target, 6) AS target, round(rr, 5) AS rr, sl_method, tgt_method FROM ex""")
def _(spark, d):
    df = S.enrich(catalog.bars(spark, d), X.CLOCK).withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1))))
    lv = L.structure_levels(F.col("swings"), F.col("close"), [F.col(c) for c in ("or_high", "or_low", "vwap")], X.LEVELS)
    atr = F.when(F.col("_atr") > 0, F.col("_atr")).otherwise(F.col("close") * 0.005)
    df = df.withColumn("lv", lv).withColumn("x", L.structure_exit(F.col("close"), F.col("direction"), atr, F.col("lv"), X.LEVELS))
    return df.select("symbol", "ts", "direction", F.round("x.stop", 6).alias("stop"), F.round("x.target", 6).alias("target"),
                     F.round("x.rr", 5).alias("rr"), "x.sl_method", "x.tgt_method")


# ---- candidate signals ------------------------------------------------------------------
HITS = dict(cw=CANDLE.format(src="lev"), cn=CANDLE_HITS.replace("WHERE c0 IS NOT NULL", ""), hh=f"""
  SELECT * FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m, volume / nullif(av, 0) AS vr,
      lag(close) OVER (PARTITION BY symbol, session_date ORDER BY ts) AS pc FROM cn)
  WHERE n >= 4 AND av > 0 AND close * av / 1e5 >= 0.002""", cand=f"""
  SELECT hh.*, 0 AS hit_no, -1 AS dr, 'OB Bear Star (LIVE)' AS pattern, 'OB_SHORT' AS strategy, 6 AS strength, vr AS ratio, atr AS satr
  FROM hh JOIN (SELECT s.symbol, s.ts, z.ob_body_high AS zh, row_number() OVER (PARTITION BY s.symbol, s.ts ORDER BY z.ob_time) AS k
      FROM hh s JOIN zones z ON s.symbol = z.symbol AND s.session_date = z.session_date AND z.ob_type = 'BEAR'
      AND z.ob_time < strftime(s.ts, '%H:%M') AND s.high >= z.ob_body_low AND s.high <= z.ob_body_high + 0.5 * s.atr) z
    ON hh.symbol = z.symbol AND hh.ts = z.ts AND z.k = 1
  WHERE m >= 240 AND m < 1200 AND vr >= 1.2 AND {STAR} AND zh + 0.05 - close > 0 AND (zh + 0.05 - close) / close <= 0.02
  UNION ALL
  SELECT *, 1, CASE WHEN close > or_high THEN 1 ELSE -1 END, CASE WHEN close > or_high THEN 'ORB Long (LIVE)' ELSE 'ORB Short (LIVE)' END,
    'ORB', 6, vr, atr FROM hh WHERE m >= 180 AND m < 840 AND vr >= 1.2
    AND ((close > or_high AND pc <= or_high) OR (close < or_low AND pc >= or_low))
  UNION ALL
  SELECT hh.*, 2, CASE WHEN close > or_high THEN 1 ELSE -1 END, CASE WHEN close > or_high THEN 'GapFill Long (LIVE)' ELSE 'GapFill Short (LIVE)' END,
    'GAPFILL', 7, volume / greatest(volume_ema, 1), daily_atr FROM hh JOIN gaps USING (symbol, session_date)
  WHERE m >= 180 AND m < 960 AND volume < volume_ema AND ((close > or_high AND pc <= or_high AND gap_dir = 'DOWN')
    OR (close < or_low AND pc >= or_low AND gap_dir = 'UP'))
  UNION ALL
  SELECT * EXCLUDE (nm), 3 + list_position(names, nm), dr, nm || ' (STRUCT)', 'CANDLE_STRUCT', CASE WHEN nm IN ('Hammer', 'Shooting Star') THEN 5 ELSE 6 END,
    vr, atr FROM (SELECT *, CASE WHEN nm IN ('Bullish Engulfing', 'Hammer', 'Morning Star') THEN 1 ELSE -1 END AS dr FROM
      (SELECT *, unnest(names) AS nm FROM hh WHERE n >= 8 AND m >= 180 AND m < 1200))
  WHERE vr >= 1.2 AND (vwap IS NULL OR (dr > 0 AND close > vwap) OR (dr < 0 AND close < vwap))""", firsts="""
  SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY symbol, session_date, strategy, dr ORDER BY ts, hit_no) = 1""",
            ex=EXIT.format(src="firsts"), signals=f"""
  SELECT symbol, session_date, ts, pattern, strategy, dr::INT AS direction, CASE WHEN dr > 0 THEN 'BUY' ELSE 'SELL' END AS side, strength::INT AS strength,
    (strength + len({votes('dr')}))::INT AS score, array_to_string({votes('dr')}, ',') AS ta, ratio AS vol_ratio, close AS price, satr AS atr, vwap,
    CASE WHEN strategy = 'CANDLE_STRUCT' THEN stop END AS struct_sl, CASE WHEN strategy = 'CANDLE_STRUCT' THEN target END AS struct_target,
    CASE WHEN strategy = 'CANDLE_STRUCT' THEN sl_method END AS sl_method FROM ex""")
HITS["cand"] = HITS["cand"].replace("SELECT * EXCLUDE (nm), 3 + list_position(names, nm), dr,", "SELECT * EXCLUDE (nm, dr), 3 + list_position(names, nm), dr,")
SIGNALS = dict(**LEVELS, **{"z" + k if k in ("t", "num", "walk") else k: v for k, v in ZONES.items()}, **GAPS, **HITS)
# the zone walk under names of its own
SIGNALS["t20"] = ZONES["t20"].replace("FROM t", "FROM zt")
SIGNALS["zwalk"] = ZONES["walk"].replace("num b", "znum b").replace("FROM walk a", "FROM zwalk a")
SIGNALS["zw"] = ZONES["zw"].replace("SELECT num.*", "SELECT znum.*").replace("FROM num JOIN walk", "FROM znum JOIN zwalk")

SIG_NUM = ["vol_ratio", "price", "atr", "vwap", "struct_sl", "struct_target"]


@checks.add("r1_candidate_signals", with_views("bars", recursive=True, **SIGNALS) + f"""
SELECT symbol, session_date, ts, pattern, strategy, direction, side, strength, score, ta, {sql_rd(*SIG_NUM)}, sl_method FROM signals""")
def _(spark, d):
    return X.signals(spark, d).select("symbol", "session_date", "ts", "pattern", "strategy", "direction", "side", "strength",
                                      "score", "ta", *rds(*SIG_NUM), "sl_method")


@checks.add("t1_rank_signals", with_views("bars", recursive=True, **SIGNALS) + """
SELECT symbol, ts, strategy, score, (row_number() OVER (PARTITION BY ts ORDER BY score DESC, vol_ratio DESC, strength DESC, symbol, pattern))::INT AS rank
FROM (SELECT * FROM signals QUALIFY row_number() OVER (PARTITION BY ts, symbol ORDER BY score DESC, vol_ratio DESC, strength DESC, symbol, pattern) = 1)
QUALIFY rank <= 2""")
def _(spark, d):
    return G.rank_signals(X.signals(spark, d), [], 2).select("symbol", "ts", "strategy", "score", "rank")


# forecast views derived from the users: one per symbol
VIEWS_SQL = """SELECT concat('U', user_id) AS symbol, CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END::INT AS vdir,
  (count(*) FILTER (value > 45))::DOUBLE / count(*) AS up_prob, avg(value) / 100 AS vol, (avg(value) - 50) / 25 AS exp_ret, max(ts) AS gen
  FROM events GROUP BY user_id"""


def views(spark, d):
    u, v = F.col("user_id"), F.col("value")
    return catalog.table(spark, d, "events").groupBy("user_id").agg(
        (F.count(F.when(v > 45, 1)).cast("double") / F.count(F.lit(1))).alias("up_prob"), (F.avg(v) / 100).alias("vol"),
        ((F.avg(v) - 50) / 25).alias("exp_ret"), F.max("ts").alias("at")).select(
        F.concat(F.lit("U"), u.cast("string")).alias("symbol"),
        F.when(u % 3 == 0, 1).when(u % 3 == 1, -1).otherwise(0).alias("dir"), "up_prob", "vol", "exp_ret", "at")


@checks.add("f8_forecast_gate", with_views("ticks", v=VIEWS_SQL, s="""
  SELECT t.symbol, t.ts, CASE WHEN close >= open THEN 1 ELSE -1 END AS dr, vdir, up_prob FROM ticks t
  LEFT JOIN (SELECT * FROM v WHERE CAST(substr(symbol, 2) AS BIGINT) % 5 <> 0) v USING (symbol)""", c="""
  SELECT *, CASE WHEN dr > 0 THEN up_prob ELSE 1 - up_prob END AS conf FROM s""", st="""
  SELECT *, CASE WHEN vdir IS NULL THEN 'na' WHEN dr = vdir AND conf >= 0.55 THEN 'agree'
    WHEN dr = -vdir AND (conf >= 0.55 OR 1 - conf >= 0.55) THEN 'against' ELSE 'neutral' END AS state FROM c""") + """
SELECT symbol, ts, (CASE state WHEN 'agree' THEN 2 WHEN 'against' THEN -2 ELSE 0 END)::INT AS adjust, state <> 'against' AS strict_allow,
  CASE state WHEN 'against' THEN 'disagree' ELSE state END AS state FROM st""")
def _(spark, d):
    v = views(spark, d).filter(F.substring("symbol", 2, 20).cast("long") % 5 != 0).select("symbol", "dir", "up_prob")
    t = catalog.ticks(spark, d).withColumn("direction", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1)).join(v, "symbol", "left")
    soft = G.forecast_gate(F.col("direction"), F.col("dir"), F.col("up_prob"))
    strict = G.forecast_gate(F.col("direction"), F.col("dir"), F.col("up_prob"), strict=True)
    t = t.withColumns({"a": soft, "b": strict})
    return t.select("symbol", "ts", "a.adjust", F.col("b.allow").alias("strict_allow"),
                    F.regexp_extract("a.reason", r"forecast:([a-z]+)", 1).alias("state"))


@checks.add("f7_score_signal", with_views("ticks", recursive=True, **SNAP, v=VIEWS_SQL, sc=f"""
  SELECT symbol, ts, dr, 5 + 1 + len({votes('dr')}) AS base, vdir, CASE WHEN dr > 0 THEN up_prob ELSE 1 - up_prob END AS conf
  FROM (SELECT ind.*, CASE WHEN close >= open THEN 1 ELSE -1 END AS dr FROM ind) JOIN v USING (symbol)""") + """
SELECT symbol, ts, (base + CASE WHEN dr = vdir AND conf >= 0.55 THEN 2 WHEN dr = -vdir AND (conf >= 0.55 OR 1 - conf >= 0.55) THEN -2 ELSE 0 END)::INT AS score
FROM sc""")
def _(spark, d):
    from barloom.operators.layout import lay_out
    from barloom.operators.recursive import WARM_ROWS

    lay = confluence_inputs(lay_out(catalog.ticks(spark, d), ["symbol"], ["ts"], back=WARM_ROWS))
    df = lay.finish().withColumn("direction", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1))
    df = df.join(views(spark, d).select("symbol", "dir", "up_prob"), "symbol")
    boost, _tags = G.confluence()
    return df.select("symbol", "ts", (F.lit(6) + boost + G.forecast_gate(F.col("direction"), F.col("dir"), F.col("up_prob"))["adjust"]).alias("score"))


NOW = "2024-01-30 22:00:00"


@checks.add("p20_staleness_filter", with_views(v=VIEWS_SQL) + f"""
SELECT symbol, date_diff('microsecond', gen, TIMESTAMP '{NOW}') <= 90 * 60000000::BIGINT AS fresh,
  date_diff('microsecond', gen, TIMESTAMP '{NOW}') <= 1800 * 60000000::BIGINT AND up_prob > 0.4 AND vdir >= 0 AS usable FROM v""")
def _(spark, d):
    now = F.lit(NOW).cast("timestamp_ntz")
    model = F.when(F.col("dir") >= 0, "gbt").otherwise("mean")
    return views(spark, d).select("symbol", G.fresh(F.col("at"), now, 90).alias("fresh"),
                                  G.usable_forecast(F.col("at"), now, model, F.col("up_prob"), "gbt", 0.4).alias("usable"))


@checks.add("s7_read_forecast_json", with_views(v=VIEWS_SQL) + """
SELECT symbol, vdir AS dir, round(up_prob, 6) AS up_prob, round(vol, 6) AS vol, round(exp_ret, 6) AS exp_ret, strftime(gen, '%Y-%m-%dT%H:%M:%S') AS ts FROM v""")
def _(spark, d):
    v = views(spark, d).withColumn("ts", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"))
    entry = F.struct(F.lower("symbol").alias("k"), F.struct("dir", "up_prob", "vol", "exp_ret", "ts").alias("v"))
    docs = (v.groupBy(F.pmod(F.xxhash64("symbol"), F.lit(8)).alias("shard")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
            .select(F.concat(F.lit('{"_meta":{"generated_at":"2024-01-30T00:00:00"},'), F.substring(F.to_json("m"), 2, 1 << 30)).alias("value")))
    path = scratch_path(spark, "views")
    docs.repartition(8).write.text(path)
    return D.read_forecast_views(spark, path, per_line=True).select("symbol", "dir", *rds("up_prob", "vol", "exp_ret"), "ts")


@checks.add("j10_forecast_lookup", with_views("ticks", v=VIEWS_SQL) + f"""
SELECT symbol, ts, round(coalesce(v.vol, 1), 6) AS scale FROM ticks LEFT JOIN
  (SELECT * FROM v WHERE date_diff('microsecond', gen, TIMESTAMP '{NOW}') <= 90 * 60000000::BIGINT) v USING (symbol)""".replace("SELECT symbol, ts", "SELECT symbol, ticks.ts"))
def _(spark, d):
    f = views(spark, d).select("symbol", F.col("vol").alias("scale"), "at")
    ok = G.fresh(F.col("at"), F.lit(NOW).cast("timestamp_ntz"), 90)
    return K.forecast_lookup(catalog.ticks(spark, d), f, ok).select("symbol", "ts", rd("scale"))


@checks.add("j11_strategy_profile_join", """
SELECT o_orderkey, coalesce(p.sl, 1.5)::DOUBLE AS sl_mult, coalesce(p.rr, 2.0)::DOUBLE AS rr, coalesce(p.tr, 1.0)::DOUBLE AS trail_mult
FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN ' orb ' WHEN 1 THEN 'Candle_Struct' WHEN 2 THEN 'OB_SHORT' WHEN 3 THEN 'gap-fill' END AS s FROM orders)
LEFT JOIN (VALUES ('CANDLE_STRUCT', 1.6, 2.8, 1.3), ('ORB', 1.2, 3.0, 1.1), ('GAP-FILL', 1.4, 1.8, 1.2)) p(k, sl, rr, tr) ON upper(trim(s)) = k""")
def _(spark, d):
    k = F.col("o_orderkey")
    s = F.when(k % 5 == 0, " orb ").when(k % 5 == 1, "Candle_Struct").when(k % 5 == 2, "OB_SHORT").when(k % 5 == 3, "gap-fill")
    return catalog.table(spark, d, "orders").select("o_orderkey", K.strategy_profile(s).alias("p")).select("o_orderkey", "p.*")


@checks.add("x1_strategy_plugin", with_views("bars", recursive=True, **RICH) + """
SELECT symbol, session_date, min(ts) AS ts FROM rich
WHERE n >= 4 AND av > 0 AND close * av / 1e5 >= 0.002 AND hour(ts) BETWEEN 3 AND 19 AND volume / av >= 1.2 AND """ + STAR.replace("\n", " ") + """
  AND hour(ts) >= 4 GROUP BY 1, 2""")
def _(spark, d):
    """A registered strategy of one's own: every shooting star is a short."""
    star = S.Strategy(lambda spec: (F.col("name") == "OB Bear Star") & (F.col("raw_ratio") >= spec.volume_ratio), suffix="", bonus=0)
    out = S.candidate_signals(catalog.bars(spark, d), None, None, X.CLOCK, X.ENTRY, None, {"STAR": star})
    return out.select("symbol", "session_date", "ts")
