"""Bounded-frame indicators against DuckDB windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import catalog
from barloom.checks.registry import Checks, rd, rds, sql_rd
from barloom.checks.views_sql import with_views
from barloom.operators import rolling as R
from barloom.operators.layout import lay_out
from barloom.operators.recursive import (BASE_FEATURES, WARM_ROWS, confluence_inputs, feature_frame, index_trend,
                                         indicator_snapshot, latest_features, recursive, synthetic_time_of_day,
                                         time_of_day)

checks = Checks()
OUT = ["symbol", "ts"]


def tick_layout(spark, sf_dir, back, ahead=0):
    return lay_out(catalog.ticks(spark, sf_dir), ["symbol"], ["ts"], back=back, ahead=ahead)


W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def frame(n: int, end: str = "CURRENT ROW") -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND {end})"


def sql_full(expr: str, agg: str, n: int) -> str:
    """Aggregate over the last n rows, null before n values."""
    return f"CASE WHEN count({expr}) {frame(n - 1)} >= {n} THEN {agg}({expr}) {frame(n - 1)} END"


@checks.add("w1_sma", with_views("ticks") + f"""
SELECT symbol, ts, round({sql_full('close', 'avg', 5)}, 6) AS sma5, round({sql_full('close', 'avg', 20)}, 6) AS sma20
FROM ticks""")
def _(spark, d):
    lay = tick_layout(spark, d, 20)
    lay = lay.with_columns(sma5=R.sma(lay, "close", 5), sma20=R.sma(lay, "close", 20))
    return lay.finish().select(*OUT, *rds("sma5", "sma20"))


@checks.add("w2_volume_ratio", with_views("ticks") + f"""
SELECT symbol, ts,
  round(CASE WHEN count(*) {frame(20, '1 PRECEDING')} >= 5 AND avg(volume) {frame(20, '1 PRECEDING')} > 0
        THEN volume / avg(volume) {frame(20, '1 PRECEDING')} END, 6) AS ratio_previous,
  round(CASE WHEN count(*) {frame(19)} >= 20 AND avg(volume) {frame(19)} > 0
        THEN volume / avg(volume) {frame(19)} END, 6) AS ratio_rolling
FROM ticks""")
def _(spark, d):
    lay = tick_layout(spark, d, 20)
    lay = lay.with_columns(ratio_previous=R.volume_ratio(lay), ratio_rolling=R.volume_ratio_rolling(lay))
    return lay.finish().select(*OUT, *rds("ratio_previous", "ratio_rolling"))


@checks.add("w3_ma_cross", with_views("ticks", ma=f"""
  SELECT symbol, ts, {sql_full('close', 'avg', 5)} AS f, {sql_full('close', 'avg', 20)} AS s FROM ticks""", p="""
  SELECT *, lag(f) OVER w AS pf, lag(s) OVER w AS ps FROM ma WINDOW w AS (PARTITION BY symbol ORDER BY ts)""") + """
SELECT symbol, ts, coalesce(f > s AND pf <= ps, false) AS cross_up, coalesce(f < s AND pf >= ps, false) AS cross_down
FROM p WHERE coalesce(f > s AND pf <= ps, false) OR coalesce(f < s AND pf >= ps, false)""")
def _(spark, d):
    lay = R.ma_cross(tick_layout(spark, d, 21), 5, 20)
    return lay.finish(lay.df.filter("cross_up or cross_down")).select(*OUT, "cross_up", "cross_down")


TR = """SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
  greatest(high - low, abs(high - p0), abs(low - p0)) AS tr0 FROM
  (SELECT *, lag(close) OVER w AS p0, coalesce(lag(close) OVER w, close) AS pc FROM ticks
   WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


@checks.add("w4_true_range", with_views("ticks", t=TR) + """
SELECT symbol, ts, round(tr, 6) AS tr, round(tr0, 6) AS tr_known FROM t""")
def _(spark, d):
    lay = tick_layout(spark, d, 1)
    lay = lay.with_columns(tr=R.true_range(lay), tr_known=R.true_range(lay, "skip"))
    return lay.finish().select(*OUT, *rds("tr", "tr_known"))


@checks.add("w7_atr_sma", with_views("ticks", t=TR) + f"""
SELECT symbol, ts, round({sql_full('tr', 'avg', 14)}, 6) AS atr_sma FROM t""")
def _(spark, d):
    lay = R.atr_sma(tick_layout(spark, d, 15), 14)
    return lay.finish().select(*OUT, rd("atr_sma"))


@checks.add("w10_rsi_sma", with_views("ticks", a="""
  SELECT *, close - lag(close) OVER w AS dc FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts)""", b="""
  SELECT *, CASE WHEN dc > 0 THEN dc WHEN dc IS NOT NULL THEN 0 END AS up,
         CASE WHEN dc < 0 THEN -dc WHEN dc IS NOT NULL THEN 0 END AS dn FROM a""") + f"""
SELECT symbol, ts, round(100 - 100 / (1 + ({sql_full('up', 'avg', 14)}) / nullif({sql_full('dn', 'avg', 14)}, 0)), 6) AS rsi
FROM b""")
def _(spark, d):
    lay = R.rsi_sma(tick_layout(spark, d, 15))
    return lay.finish().select(*OUT, rd("rsi"))


FLOW = """((close - low) - (high - close)) / nullif(high - low, 0) * volume"""


@checks.add("w13_cmf", with_views("ticks", a=f"SELECT *, {FLOW} AS mf FROM ticks") + f"""
SELECT symbol, ts, round(CASE WHEN count(mf) {frame(19)} >= 20
       THEN sum(mf) {frame(19)} / nullif(sum(volume) {frame(19)}, 0) END, 6) AS cmf FROM a""")
def _(spark, d):
    lay = tick_layout(spark, d, 20)
    lay = lay.with_columns(cmf=R.cmf(lay))
    return lay.finish().select(*OUT, rd("cmf"))


DAYW = "PARTITION BY symbol, session_date ORDER BY ts"


@checks.add("w15_session_vwap", with_views("bars", "index_bars") + f"""
SELECT 'bar' AS series, symbol, ts, round(sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w, 6) AS vwap,
  round(CASE WHEN row_number() OVER w >= 3 THEN sum((high + low + close) / 3 * volume) OVER w
        / greatest(sum(volume) OVER w, 1) END, 6) AS vwap_strict
FROM bars WINDOW w AS ({DAYW})
UNION ALL
SELECT 'index', NULL, ts, round(avg((high + low + close) / 3) OVER w, 6), NULL
FROM index_bars WINDOW w AS (PARTITION BY session_date ORDER BY ts)""")
def _(spark, d):
    bars = catalog.bars(spark, d)
    both = R.session_vwap(bars, ["symbol"]).withColumnRenamed("vwap", "a")
    both = R.session_vwap_strict(both, ["symbol"]).select(
        F.lit("bar").alias("series"), "symbol", "ts", F.round("a", 6).alias("vwap"), F.round("vwap", 6).alias("vwap_strict"))
    dry = catalog.index_bars(spark, d).withColumn("volume", F.lit(0).cast("long"))
    dry = R.session_vwap(dry, []).select(F.lit("index").alias("series"), F.lit(None).cast("string").alias("symbol"), "ts",
                                         F.round("vwap", 6).alias("vwap"), F.lit(None).cast("double").alias("vwap_strict"))
    return both.unionByName(dry)


@checks.add("w16_cumulative_vwap", with_views("ticks") + """
SELECT symbol, ts, round(sum((high + low + close) / 3 * volume) OVER w
       / CASE WHEN sum(volume) OVER w = 0 THEN 1e-9 ELSE sum(volume) OVER w END, 5) AS cum_vwap
FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(spark, d):
    return R.cumulative_vwap(catalog.ticks(spark, d), ["symbol"]).select(*OUT, rd("cum_vwap", 5))


@checks.add("w18_returns", with_views("ticks") + """
SELECT symbol, ts, round(close / lag(close) OVER w - 1, 6) AS ret1, round(close / lag(close, 3) OVER w - 1, 6) AS ret3,
  round(ln(close / lag(close) OVER w), 6) AS log_ret1, round(ln(close / lag(close, 2) OVER w), 6) AS log_ret2,
  round((open - lag(close) OVER w) / lag(close) OVER w, 6) AS gap_pct, round(lead(close) OVER w, 6) AS next_close
FROM ticks """ + W)
def _(spark, d):
    lay = tick_layout(spark, d, 3, 1)
    lay = lay.with_columns(**R.returns(lay))
    return lay.finish().select(*OUT, *rds("ret1", "ret3", "log_ret1", "log_ret2", "gap_pct", "next_close"))


@checks.add("w19_realized_vol", with_views("ticks", a="""
  SELECT *, ln(close / lag(close) OVER w) AS lr FROM ticks """ + W) + f"""
SELECT symbol, ts, {', '.join(f"round({sql_full('lr', 'stddev_samp', n)}, 6) AS rv{n}" for n in (5, 10, 20))} FROM a""")
def _(spark, d):
    lay = tick_layout(spark, d, 21)
    lay = lay.with_columns(log_ret1=R.returns(lay)["log_ret1"])
    lay = lay.with_columns(**{f"rv{n}": R.realized_vol(lay, n) for n in (5, 10, 20)})
    return lay.finish().select(*OUT, *rds("rv5", "rv10", "rv20"))


@checks.add("w20_volume_zscore", with_views("ticks") + f"""
SELECT symbol, ts, round(coalesce((volume - {sql_full('volume', 'avg', 20)})
       / nullif({sql_full('volume', 'stddev_samp', 20)}, 0), 0), 5) AS vol_z FROM ticks""")
def _(spark, d):
    lay = tick_layout(spark, d, 20)
    lay = lay.with_columns(vol_z=R.volume_zscore(lay))
    return lay.finish().select(*OUT, rd("vol_z", 5))


@checks.add("w21_parkinson_vol", with_views("ticks") + """
SELECT symbol, ts, round(sqrt(pow(ln(greatest(high / low, 1e-9)), 2) / (4 * ln(2))), 6) AS park_vol FROM ticks""")
def _(spark, d):
    return catalog.ticks(spark, d).withColumn("park_vol", R.parkinson()).select(*OUT, rd("park_vol"))


# ---- recursions: DuckDB walks the rows of a series with a recursive CTE -------------------

# seeds and steps follow the row number n of a series (1-based)
NUM = "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM {src}"


def sql_fold(src: str, init: str, step: str, cols: str) -> dict[str, str]:
    """CTE bodies: numbered source and the walk; ``b`` is the new row and ``a`` the walked one."""
    return {"num": NUM.format(src=src),
            "walk": f"SELECT b.symbol, b.n, {init} FROM num b WHERE b.n = 1 UNION ALL "
                    f"SELECT b.symbol, b.n, {step} FROM walk a JOIN num b ON b.symbol = a.symbol AND b.n = a.n + 1"}


def ema_step(prev: str, x: str, span: int) -> str:
    a = 2.0 / (span + 1)
    return f"{1 - a!r}::DOUBLE * {prev} + {a!r}::DOUBLE * {x}"


def wilder_step(prev: str, x: str, seed: str, p: int, at: int) -> str:
    """Null before row ``at``, the seed on it, smoothing after it."""
    return f"CASE WHEN b.n < {at} THEN NULL WHEN b.n = {at} THEN {seed} ELSE ({prev} * {p - 1} + {x}) / {p} END"


@checks.add("w5_ema", with_views("ticks", recursive=True, **sql_fold(
    "ticks", "b.close AS e5, b.close AS e20, b.volume::DOUBLE AS v20",
    f"{ema_step('a.e5', 'b.close', 5)}, {ema_step('a.e20', 'b.close', 20)}, {ema_step('a.v20', 'b.volume', 20)}", "")) + """
SELECT num.symbol, ts, round(e5, 6) AS ema5, round(CASE WHEN n >= 20 THEN e20 END, 6) AS ema20, round(v20, 5) AS volume_ema
FROM walk JOIN num USING (symbol, n)""")
def _(spark, d):
    return recursive(catalog.ticks(spark, d), ["symbol"],
                     {"ema5": "ema_all:5", "ema20": "ema:20", "volume_ema": "volume_ema:20"}).select(
        *OUT, *rds("ema5", "ema20"), rd("volume_ema", 5))


TRN = "SELECT *, avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING) AS tr14 FROM t"


@checks.add("w6_atr_wilder", with_views("ticks", recursive=True, t=TR, t2=TRN, **sql_fold(
    "t2", "NULL::DOUBLE AS y", wilder_step("a.y", "b.tr", "b.tr14", 14, 14), "")) + """
SELECT num.symbol, ts, round(CASE WHEN n >= 15 THEN y END, 6) AS atr14, round(coalesce(y, 0), 6) AS atr14_zero
FROM walk JOIN num USING (symbol, n)""")
def _(spark, d):
    return recursive(catalog.ticks(spark, d), ["symbol"], {"atr14": "atr:14", "atr14_zero": "atr_zero:14"}).select(
        *OUT, *rds("atr14", "atr14_zero"))


@checks.add("w8_atr_ewm", with_views("ticks", recursive=True, t=TR, **sql_fold(
    "t", "b.tr AS y", "a.y + (b.tr - a.y) / 14", "")) + """
SELECT num.symbol, ts, round(CASE WHEN n >= 14 THEN y END, 6) AS atr_ewm FROM walk JOIN num USING (symbol, n)""")
def _(spark, d):
    return recursive(catalog.ticks(spark, d), ["symbol"], {"atr_ewm": "atr_ewm:14"}).select(*OUT, rd("atr_ewm"))


DM = """SELECT *, CASE WHEN up > dn THEN greatest(up, 0) ELSE 0 END AS pdm,
  CASE WHEN dn > up THEN greatest(dn, 0) ELSE 0 END AS ndm FROM
  (SELECT *, coalesce(high - lag(high) OVER w, 0) AS up, coalesce(lag(low) OVER w - low, 0) AS dn FROM t
   WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""
DMN = """SELECT *, avg(tr) OVER w AS tr14, avg(pdm) OVER w AS pdm14, avg(ndm) OVER w AS ndm14 FROM dm
  WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING)"""
DX = """SELECT symbol, n, CASE WHEN n < 14 THEN 0 ELSE
    100 * abs(p - m) / CASE WHEN p + m > 0 THEN p + m ELSE 1e-9 END END AS dx FROM
  (SELECT symbol, n, 100 * sp / CASE WHEN st > 0 THEN st ELSE 1e-9 END AS p,
          100 * sm / CASE WHEN st > 0 THEN st ELSE 1e-9 END AS m FROM walk)"""
DXN = """SELECT *, avg(dx) OVER (PARTITION BY symbol ORDER BY n ROWS 13 PRECEDING) AS dx14 FROM dx"""
DXWALK = f"""SELECT b.symbol, b.n, NULL::DOUBLE AS y FROM dxn b WHERE b.n = 1 UNION ALL
  SELECT b.symbol, b.n, {wilder_step('a.y', 'b.dx', 'b.dx14', 14, 28)}
  FROM adxw a JOIN dxn b ON b.symbol = a.symbol AND b.n = a.n + 1"""
ADX = dict(t=TR, dm=DM, dmn=DMN, **sql_fold(
    "dmn", "NULL::DOUBLE AS st, NULL::DOUBLE AS sp, NULL::DOUBLE AS sm",
    ", ".join(wilder_step(f"a.{o}", f"b.{x}", f"b.{x}14", 14, 14) for o, x in (("st", "tr"), ("sp", "pdm"), ("sm", "ndm"))),
    ""), dx=DX, dxn=DXN, adxw=DXWALK)


@checks.add("w9_adx", with_views("ticks", recursive=True, **ADX) + """
SELECT num.symbol, ts, round(y, 6) AS adx,
  round(CASE WHEN max(n) OVER (PARTITION BY num.symbol) < 28 THEN 20 ELSE coalesce(y, 0) END, 6) AS adx_feature
FROM adxw JOIN num USING (symbol, n)""")
def _(spark, d):
    return recursive(catalog.ticks(spark, d), ["symbol"], {"adx": "adx:14", "adx_feature": "adx_feature:14"}).select(
        *OUT, *rds("adx", "adx_feature"))


MOVES = """SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM
  (SELECT *, coalesce(close - lag(close) OVER w, 0) AS d FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""
MOVESN = """SELECT *, avg(up) OVER w AS up14, avg(dn) OVER w AS dn14 FROM mv
  WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING)"""


@checks.add("w11_rsi_wilder", with_views("ticks", recursive=True, mv=MOVES.format(src="ticks"), mvn=MOVESN, **sql_fold(
    "mvn", "NULL::DOUBLE AS u, NULL::DOUBLE AS l",
    wilder_step("a.u", "b.up", "b.up14", 14, 15) + ", " + wilder_step("a.l", "b.dn", "b.dn14", 14, 15), "")) + """
SELECT num.symbol, ts, round(CASE WHEN max(n) OVER (PARTITION BY num.symbol) <= 14 THEN 50 WHEN u IS NULL THEN 0
  ELSE 100 - 100 / (1 + u / CASE WHEN l = 0 THEN 1e-9 ELSE l END) END, 6) AS rsi FROM walk JOIN num USING (symbol, n)""")
def _(spark, d):
    return recursive(catalog.ticks(spark, d), ["symbol"], {"rsi": "rsi:14"}).select(*OUT, rd("rsi"))


MACD = sql_fold("ticks", "b.close AS e12, b.close AS e26, 0::DOUBLE AS sg, b.close AS e20",
                f"{ema_step('a.e12', 'b.close', 12)}, {ema_step('a.e26', 'b.close', 26)}, "
                + ema_step("a.sg", f"(({ema_step('a.e12', 'b.close', 12)}) - ({ema_step('a.e26', 'b.close', 26)}))", 9)
                + f", {ema_step('a.e20', 'b.close', 20)}", "")


@checks.add("w12_macd_hist", with_views("ticks", recursive=True, **MACD) + """
SELECT num.symbol, ts, round(CASE WHEN n >= 35 THEN e12 - e26 - sg END, 6) AS macd_hist FROM walk JOIN num USING (symbol, n)""")
def _(spark, d):
    return recursive(catalog.ticks(spark, d), ["symbol"], {"macd_hist": "macd_hist"}).select(*OUT, rd("macd_hist"))


# one wide row per tick with every input of the confluence score
SNAP = dict(t=TR, **{k: v.replace("FROM ticks", "FROM t") for k, v in MACD.items()}, mv=MOVES.format(src="t"), ind=f"""
  SELECT symbol, ts, session_date, open, high, low, close, volume, n, CASE WHEN n >= 20 THEN e20 END AS ema20,
    CASE WHEN n >= 35 THEN e12 - e26 - sg END AS macd_hist,
    CASE WHEN n >= 15 THEN 100 - 100 / (1 + up14 / nullif(dn14, 0)) END AS rsi,
    CASE WHEN mfn >= 20 THEN mfs / nullif(vs, 0) END AS cmf,
    CASE WHEN n < 11 THEN 0 WHEN close > (high + low) / 2 + 3 * tr10 THEN 1 WHEN close < (high + low) / 2 - 3 * tr10 THEN -1
         WHEN n < 20 THEN 0 WHEN close >= e20 THEN 1 ELSE -1 END::INT AS supertrend
  FROM (SELECT num.*, walk.* EXCLUDE (symbol, n), avg(tr) {frame(9)} AS tr10,
          avg(CASE WHEN n > 1 THEN mv_up END) {frame(13)} AS up14, avg(CASE WHEN n > 1 THEN mv_dn END) {frame(13)} AS dn14,
          count(mf) {frame(19)} AS mfn, sum(mf) {frame(19)} AS mfs, sum(volume) {frame(19)} AS vs
        FROM (SELECT num.*, {FLOW} AS mf, mv.up AS mv_up, mv.dn AS mv_dn
              FROM num JOIN (SELECT symbol, ts, up, dn FROM mv) mv USING (symbol, ts)) num JOIN walk USING (symbol, n))""")


@checks.add("w14_supertrend_dir", with_views("ticks", recursive=True, **SNAP) + "SELECT symbol, ts, supertrend FROM ind")
def _(spark, d):
    lay = confluence_inputs(tick_layout(spark, d, WARM_ROWS))
    return lay.finish().select(*OUT, "supertrend")


@checks.add("w42_indicator_snapshot", with_views("ticks", recursive=True, **SNAP) + """
SELECT symbol, ts, round(rsi, 6) AS rsi, round(cmf, 6) AS cmf, round(macd_hist, 6) AS macd_hist, supertrend,
       round(ema20, 6) AS ema20
FROM ind QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1 AND n >= 5""")
def _(spark, d):
    return indicator_snapshot(catalog.ticks(spark, d), ["symbol"]).select(
        *OUT, *rds("rsi", "cmf", "macd_hist", "ema20"), "supertrend")


TREND = dict(ib="SELECT 'X' AS symbol, * FROM index_bars", **sql_fold(
    "ib", "b.close AS e", ema_step("a.e", "b.close", 20), ""), trend="""
  SELECT ts, session_date, CASE WHEN close > vwap AND close > e THEN 1 WHEN close < vwap AND close < e THEN -1 ELSE 0 END::INT AS trend
  FROM (SELECT num.*, e, sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w AS vwap
        FROM num JOIN walk USING (symbol, n) WINDOW w AS (PARTITION BY session_date ORDER BY ts))""")


@checks.add("w17_index_trend", with_views("index_bars", recursive=True, **TREND) + "SELECT ts, trend FROM trend")
def _(spark, d):
    return index_trend(catalog.index_bars(spark, d)).select("ts", "trend")


@checks.add("w22_ewma_vol", with_views("ticks", recursive=True, pk="""
  SELECT *, sqrt(pow(ln(greatest(high / low, 1e-9)), 2) / (4 * ln(2))) AS pv FROM ticks""", **sql_fold(
    "pk", "b.pv AS y", ema_step("a.y", "b.pv", 10), "")) + """
SELECT num.symbol, ts, round(y, 6) AS ewma_vol FROM walk JOIN num USING (symbol, n)
QUALIFY row_number() OVER (PARTITION BY num.symbol ORDER BY ts DESC) = 1""")
def _(spark, d):
    vol = recursive(catalog.ticks(spark, d), ["symbol"], {"ewma_vol": "ewma_vol:10"})
    return vol.groupBy("symbol").agg(F.max("ts").alias("ts"), F.round(F.max_by("ewma_vol", "ts"), 6).alias("ewma_vol"))


FEAT = dict(t=TR, dm=DM, mv=MOVES.format(src="dm").replace("AS up", "AS gain").replace("AS dn", "AS loss"), dmn="""
  SELECT *, avg(tr) OVER w AS tr14, avg(pdm) OVER w AS pdm14, avg(ndm) OVER w AS ndm14, avg(gain) OVER w AS gain14,
    avg(loss) OVER w AS loss14 FROM mv WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING)""", **sql_fold(
    "dmn", "NULL::DOUBLE AS st, NULL::DOUBLE AS sp, NULL::DOUBLE AS sm, NULL::DOUBLE AS g, NULL::DOUBLE AS ls, b.close AS e",
    ", ".join([*(wilder_step(f"a.{o}", f"b.{x}", f"b.{x}14", 14, 14) for o, x in (("st", "tr"), ("sp", "pdm"), ("sm", "ndm"))),
               *(wilder_step(f"a.{o}", f"b.{x}", f"b.{x}14", 14, 15) for o, x in (("g", "gain"), ("ls", "loss"))),
               ema_step("a.e", "b.close", 20)]), ""), dx=DX, dxn=DXN, adxw=DXWALK, feat=f"""
  SELECT symbol, ts, session_date, n AS position, coalesce(st, 0) / close AS atr_frac,
    CASE WHEN cnt <= 14 THEN 50 WHEN g IS NULL THEN 0 ELSE 100 - 100 / (1 + g / CASE WHEN ls = 0 THEN 1e-9 ELSE ls END) END AS rsi,
    (close - vwap) / close AS vwap_dist, (close - e) / close AS ema_dist,
    CASE WHEN cnt < 28 THEN 20 ELSE coalesce(y, 0) END AS adx,
    CASE WHEN n >= 20 AND vm > 0 THEN volume / vm END AS vol_ratio, close / p1 - 1 AS ret1, close / p3 - 1 AS ret3,
    (high - low) / close AS range_pct, (open - coalesce(p1, close)) / close AS gap_pct,
    hour(ts) + minute(ts) / 60.0::DOUBLE AS tod, abs(close - open) / CASE WHEN high > low THEN high - low ELSE 1e-9 END AS body_frac,
    coalesce(st, 0) AS atr, close
  FROM (SELECT num.*, walk.* EXCLUDE (symbol, n), y, count(*) OVER (PARTITION BY num.symbol) AS cnt,
      sum((high + low + close) / 3 * volume) OVER w / CASE WHEN sum(volume) OVER w = 0 THEN 1e-9 ELSE sum(volume) OVER w END AS vwap,
      avg(volume) OVER (PARTITION BY num.symbol ORDER BY ts ROWS 19 PRECEDING) AS vm,
      lag(close) OVER w AS p1, lag(close, 3) OVER w AS p3
    FROM num JOIN walk USING (symbol, n) JOIN adxw USING (symbol, n) WINDOW w AS (PARTITION BY num.symbol ORDER BY ts))""")


@checks.add("f18_feature_frame", with_views("ticks", recursive=True, **FEAT) + f"""
SELECT symbol, ts, position, {sql_rd(*BASE_FEATURES, 'atr', digits=5)} FROM feat""")
def _(spark, d):
    return feature_frame(catalog.ticks(spark, d), ["symbol"]).select(
        *OUT, "position", *rds(*BASE_FEATURES, "atr", digits=5))


@checks.add("f18_latest_features", with_views("ticks", recursive=True, **FEAT) + f"""
SELECT symbol, ts, {', '.join(f"round(coalesce({n}, 0), 5) AS {n}" for n in BASE_FEATURES)} FROM feat
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1 AND position >= 20""")
def _(spark, d):
    return latest_features(feature_frame(catalog.ticks(spark, d), ["symbol"]), ["symbol"]).select(
        *OUT, *rds(*BASE_FEATURES, digits=5))


@checks.add("f16_time_of_day", with_views("ticks") + """
SELECT symbol, ts, round(hour(ts) + minute(ts) / 60.0::DOUBLE, 6) AS tod,
  round(9.25::DOUBLE + ((row_number() OVER w - 1) % 75 * 5) / 60.0::DOUBLE, 6) AS tod_synthetic
FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _(spark, d):
    lay = tick_layout(spark, d, 0)
    lay = lay.with_columns(tod=time_of_day(F.col("ts")), tod_synthetic=synthetic_time_of_day(lay.position() - 1))
    return lay.finish().select(*OUT, *rds("tod", "tod_synthetic"))
