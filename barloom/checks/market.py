"""Sources, cleaning, bar aggregation and universes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import catalog
from barloom.checks.registry import Checks, rds
from barloom.checks.views_sql import with_views
from barloom.operators import clean as C, universe as U
from barloom.operators.layout import scratch_path
from barloom.sources import bars as B, dimensions as D
from barloom.spec import SessionSpec

checks = Checks()
OHLC = ["open", "high", "low", "close"]


def bar_out():
    return ["symbol", "ts", *rds(*OHLC), "volume"]


SQL_BAR = "symbol, ts, " + ", ".join(f"round({c}, 6) AS {c}" for c in OHLC) + ", volume"


def bar_folder(spark, d, **renames):
    """The stand-in bars as CSV files, one folder per symbol, in three column orders, one of them with a further column.

    Beside them lie bars without a volume column of a symbol that no query expects and a file without prices.
    """
    path = scratch_path(spark, "bars-csv")
    df = catalog.bars(spark, d).drop("session_date")
    for old, new in renames.items():
        df = df.withColumnRenamed(old, new)
    names = [c for c in df.columns if c != "symbol"]
    orders = [names, names[::-1], [*names[3:], "note", *names[:3]]]
    for k, order in enumerate(orders):
        part = df.filter(F.pmod(F.crc32(F.encode("symbol", "UTF-8")), F.lit(3)) == k).withColumn("note", F.lit("a,b"))
        B.write_csv(part.select("symbol", *order), f"{path}/{k}", ("symbol",))
    B.write_csv(df.limit(3).select(F.lit("NOPRICE").alias("symbol"), names[0]), f"{path}/broken", ("symbol",))
    if not renames:
        B.write_csv(df.limit(30).select(F.lit("NOVOLUME").alias("symbol"), *[c for c in names if c != "volume"]), f"{path}/flat", ("symbol",))
    return path


@checks.add("s1_read_bars", with_views("bars") + f"""
SELECT {SQL_BAR.replace('symbol', 'upper(symbol) AS symbol', 1)} FROM bars WHERE volume > 0 AND symbol <> 'view'
QUALIFY count(*) OVER (PARTITION BY symbol) >= 4""")
def _(spark, d):
    return B.read_bars(spark, bar_folder(spark, d), tz="UTC", skip=("View",)).select(*bar_out())


DAILY = """SELECT symbol, session_date, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, ts) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM {src} GROUP BY 1, 2"""


@checks.add("s2_read_bars_any", with_views("bars", days=DAILY.format(src="bars")) + """
SELECT upper(symbol) AS symbol, session_date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low,
  round(close, 6) AS close, CAST(volume AS DOUBLE) AS volume, CAST(isodow(session_date) - 1 AS DOUBLE) AS dow FROM days""")
def _(spark, d):
    path = bar_folder(spark, d, ts="DateTime", open="Open", close="CLOSE", volume="Volume")
    return B.read_bars_any(spark, path, min_rows=10).select("symbol", "session_date", *rds(*OHLC), "volume", "dow")


@checks.add("s3_read_bars_min_history", with_views("bars") + f"""
SELECT {SQL_BAR.replace('symbol', 'upper(symbol) AS symbol', 1)} FROM bars WHERE volume > 0
QUALIFY count(*) OVER (PARTITION BY symbol) > 50 + 14 + 5""")
def _(spark, d):
    return B.read_bars_min_history(spark, bar_folder(spark, d), tz="UTC").select(*bar_out())


# instrument master derived from suppliers (cash rows) and customers (derivative rows)
INSTR = """
  SELECT 'NSE' AS exchange, 'E' AS segment, CASE WHEN s_suppkey % 10 = 3 THEN 'ETF' ELSE 'EQUITY' END AS instrument,
    concat('Sym', s_suppkey) AS trading_symbol, CAST(s_suppkey AS VARCHAR) AS security_id FROM supplier
  UNION ALL
  SELECT CASE WHEN c_custkey % 7 = 0 THEN 'BSE' ELSE 'nse' END, 'D', CASE c_custkey % 3 WHEN 0 THEN 'FUTSTK' WHEN 1 THEN 'OPTSTK'
    ELSE 'FUTIDX' END, concat('SYM', c_custkey % 200, '-', c_mktsegment), CAST(c_custkey AS VARCHAR) FROM customer"""


def instruments(spark, d):
    s, c = catalog.table(spark, d, "supplier"), catalog.table(spark, d, "customer")
    k, q = F.col("s_suppkey"), F.col("c_custkey")
    cash = s.select(F.lit("NSE").alias("exchange"), F.lit("E").alias("segment"),
                    F.when(k % 10 == 3, "ETF").otherwise("EQUITY").alias("instrument"),
                    F.concat(F.lit("Sym"), k.cast("string")).alias("trading_symbol"), k.cast("string").alias("security_id"))
    deriv = c.select(F.when(q % 7 == 0, "BSE").otherwise("nse"), F.lit("D"),
                     F.when(q % 3 == 0, "FUTSTK").when(q % 3 == 1, "OPTSTK").otherwise("FUTIDX"),
                     F.concat(F.lit("SYM"), (q % 200).cast("string"), F.lit("-"), "c_mktsegment"), q.cast("string"))
    return cash.union(deriv)


@checks.add("s4_read_instruments", f"SELECT * FROM ({INSTR})")
def _(spark, d):
    path = scratch_path(spark, "instruments")
    names = {k: v.lower() for k, v in D.INSTRUMENT_COLUMNS.items()}
    wide = instruments(spark, d).withColumnsRenamed(names).withColumn("lot", F.lit(1)).withColumn("isin", F.lit("x"))
    B.write_csv(wide, path)
    return D.read_instruments(spark, path)


@checks.add("s6_read_trades", with_views("trades") + """
SELECT trade_id, exit_time, round(pnl, 6) AS pnl FROM trades""")
def _(spark, d):
    path = scratch_path(spark, "trades")
    t = catalog.trades(spark, d).select("trade_id", F.date_format("exit_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Close_Time"),
                                        F.col("pnl").alias("PnL_Net"))
    B.write_csv(t, path)
    return D.read_trades(spark, path).select(F.col("trade_id").cast("long").alias("trade_id"), "exit_time",
                                             F.round("pnl", 6).alias("pnl"))


@checks.add("s8_read_ledger_json", with_views("trades") + """
SELECT strategy, side, round(pnl, 6) AS pnl, round(r, 6) AS r, outcome, hour(exit_time)::INT AS hour,
  strftime(exit_time, '%Y-%m-%d') AS date FROM trades""")
def _(spark, d):
    # one document per (day, hour), each an array of that hour's trades
    t = catalog.trades(spark, d).withColumn("date", F.date_format("exit_time", "yyyy-MM-dd"))
    row = F.struct("date", "strategy", "side", "pnl", "r", "outcome", F.hour("exit_time").alias("hour"))
    docs = (t.groupBy("date", F.hour("exit_time").alias("h"), F.pmod(F.xxhash64("trade_id"), F.lit(16)).alias("s"))
            .agg(F.collect_list(row).alias("trades")).select(F.to_json(F.struct("trades")).alias("value")))
    path = scratch_path(spark, "ledger")
    docs.repartition(8).write.option("lineSep", "\n").text(path)
    return (D.read_ledger(spark, path, per_line=True)
            .select("strategy", "side", *rds("pnl", "r"), "outcome", "hour", "date"))


@checks.add("s10_write_bars_partitioned", with_views("bars") + f"""
SELECT {SQL_BAR.replace('symbol', 'upper(symbol) AS symbol', 1)}, '60m' AS interval, year(ts)::INT AS year, month(ts)::INT AS month
FROM bars""")
def _(spark, d):
    path = scratch_path(spark, "bars")
    B.write_bars(catalog.bars(spark, d), path, "60m")
    return spark.read.parquet(path).select(*bar_out(), F.col("interval").cast("string").alias("interval"), "year", "month")


@checks.add("s11_write_results_csv", with_views("trades") + """
SELECT strategy, count(*) AS trades, round(sum(pnl), 4) AS net FROM trades GROUP BY 1""")
def _(spark, d):
    path = scratch_path(spark, "results")
    B.write_csv(catalog.trades(spark, d).groupBy("strategy").agg(
        F.count(F.lit(1)).alias("trades"), F.round(F.sum("pnl"), 4).alias("net")), path)
    return spark.read.option("header", True).schema("strategy string, trades long, net double").csv(path)


OLD_NEW = {"oldb": "SELECT * FROM bars WHERE day(session_date) <= 20",
           "newb": """SELECT symbol, ts, session_date, open, high, low, close + 1 AS close, volume FROM bars
                      WHERE day(session_date) >= 15""",
           "merged": """SELECT * EXCLUDE src FROM (SELECT *, 0 AS src FROM oldb UNION ALL SELECT *, 1 FROM newb)
                        QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY src DESC) = 1"""}


def old_new(spark, d):
    b = catalog.bars(spark, d)
    day = F.dayofmonth("session_date")
    return b.filter(day <= 20), b.filter(day >= 15).withColumn("close", F.col("close") + 1)


@checks.add("s13_merge_bars", with_views("bars", **OLD_NEW) + f"SELECT {SQL_BAR} FROM merged")
def _(spark, d):
    return B.merge_bars(*old_new(spark, d)).select(*bar_out())


@checks.add("s13_merge_counts", with_views("bars", **OLD_NEW) + """
SELECT symbol, greatest(total - coalesce(before, 0), 0) AS added, total
FROM (SELECT symbol, count(*) AS total FROM merged GROUP BY 1) LEFT JOIN (SELECT symbol, count(*) AS before FROM oldb GROUP BY 1)
USING (symbol)""")
def _(spark, d):
    old, new = old_new(spark, d)
    return B.merge_counts(old, B.merge_bars(old, new))


# raw feed with defects: lost values, bars outside the session, repeated times
RAW = """
  SELECT user_id AS symbol, event_id, date_trunc('minute', ts) AS ts, CASE WHEN event_id % 23 = 0 THEN NULL ELSE 100.0 + value END AS open,
    101.0 + value AS high, 99.0 + value AS low, 100.5 + value AS close, CASE WHEN event_id % 13 <> 0 THEN event_id % 40 END AS volume
  FROM events"""
NSE_DAY = SessionSpec()


def raw_feed(spark, d):
    e, v = F.col("event_id"), F.col("value")
    return catalog.table(spark, d, "events").select(
        F.col("user_id").alias("symbol"), "event_id",
        F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"),
        F.when(e % 23 != 0, 100.0 + v).alias("open"), (101.0 + v).alias("high"), (99.0 + v).alias("low"),
        (100.5 + v).alias("close"), F.when(e % 13 != 0, e % 40).alias("volume"))


@checks.add("p1_standardize_bars", f"""
WITH raw AS ({RAW}), loc AS (SELECT * REPLACE (ts + INTERVAL '5 hours 30 minutes' AS ts) FROM raw)
SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close,
  coalesce(volume, 0)::BIGINT AS volume
FROM loc WHERE open IS NOT NULL AND ts::TIME BETWEEN TIME '09:15:00' AND TIME '15:30:00'
QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY event_id DESC) = 1""")
def _(spark, d):
    return C.standardize_bars(raw_feed(spark, d), NSE_DAY, ["symbol"], ["event_id"]).select(*bar_out())


@checks.add("p2_to_session_tz", """
SELECT event_id, ts + INTERVAL '5 hours 30 minutes' AS from_utc, ts AS from_local FROM events""")
def _(spark, d):
    return catalog.table(spark, d, "events").select(
        "event_id", C.to_session_tz(F.col("ts"), "Asia/Kolkata").alias("from_utc"),
        C.to_session_tz(F.col("ts"), "Asia/Kolkata", "Asia/Kolkata").alias("from_local"))


@checks.add("p3_in_market_hours", """
SELECT event_id FROM (SELECT event_id, date_trunc('minute', ts) AS ts FROM events)
WHERE ts::TIME >= TIME '09:15:00' AND ts::TIME <= TIME '15:30:00'""")
def _(spark, d):
    return (catalog.table(spark, d, "events")
            .withColumn("ts", F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz"))
            .filter(C.in_market_hours("ts", NSE_DAY)).select("event_id"))


@checks.add("p4_in_entry_window", """
SELECT event_id, ts::TIME BETWEEN TIME '09:30:00' AND TIME '14:30:00' AS scan,
  hour(ts) * 60 + minute(ts) >= 570 AND hour(ts) * 60 + minute(ts) < 660 AS breakout
FROM (SELECT event_id, date_trunc('minute', ts) AS ts FROM events)""")
def _(spark, d):
    return (catalog.table(spark, d, "events")
            .withColumn("ts", F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz"))
            .select("event_id", C.in_entry_window("ts", NSE_DAY).alias("scan"),
                    C.within("ts", NSE_DAY.breakout_entry).alias("breakout")))


@checks.add("p5_drop_dead_bars", with_views("ticks") + f"SELECT {SQL_BAR} FROM ticks WHERE volume > 0")
def _(spark, d):
    return C.drop_dead_bars(catalog.ticks(spark, d)).select(*bar_out())


@checks.add("p6_drop_forming_bar", with_views("ticks") + f"""
SELECT {SQL_BAR} FROM ticks QUALIFY ts < max(ts) OVER (PARTITION BY symbol)""")
def _(spark, d):
    return C.drop_forming_bar(catalog.ticks(spark, d), ["symbol"]).select(*bar_out())


UNDER = """under AS (SELECT DISTINCT upper(split_part(trading_symbol, '-', 1)) AS underlying FROM instr
  WHERE upper(exchange) = 'NSE' AND instrument IN ('FUTSTK', 'OPTSTK'))"""


@checks.add("p7_fno_universe", f"""
WITH instr AS ({INSTR}), {UNDER}
SELECT min(security_id) AS security_id, trading_symbol AS symbol FROM instr
WHERE exchange = 'NSE' AND segment = 'E' AND instrument = 'EQUITY' AND upper(trading_symbol) IN (SELECT underlying FROM under)
GROUP BY trading_symbol ORDER BY symbol LIMIT 180""")
def _(spark, d):
    return U.fno_universe(instruments(spark, d), limit=180)


@checks.add("p7_fno_universe_all", f"""
WITH instr AS ({INSTR}), {UNDER}
SELECT min(security_id) AS security_id, trading_symbol AS symbol FROM instr
WHERE exchange = 'NSE' AND segment = 'E' AND instrument = 'EQUITY' AND upper(trading_symbol) IN (SELECT underlying FROM under)
GROUP BY trading_symbol""")
def _(spark, d):
    return U.fno_universe(instruments(spark, d))


@checks.add("p7_derivative_names", f"""
WITH instr AS ({INSTR}), {UNDER} SELECT underlying AS symbol FROM under""")
def _(spark, d):
    return U.derivative_names(instruments(spark, d))


LISTED = "SELECT concat('Sym', s_suppkey) AS symbol FROM supplier"


def listed(spark, d):
    return catalog.table(spark, d, "supplier").select(F.concat(F.lit("Sym"), F.col("s_suppkey").cast("string")).alias("symbol"))


@checks.add("p8_validated_list", f"""
WITH instr AS ({INSTR}), {UNDER}, listed AS ({LISTED}),
ok AS (SELECT symbol FROM listed WHERE upper(symbol) IN (SELECT underlying FROM under))
SELECT symbol FROM listed WHERE (SELECT count(*) FROM ok) < 40 OR symbol IN (SELECT symbol FROM ok)""")
def _(spark, d):
    return U.validated_list(listed(spark, d), U.derivative_names(instruments(spark, d)), at_least=40)


@checks.add("p8_validated_list_strict", f"""
WITH instr AS ({INSTR}), {UNDER}, listed AS ({LISTED}) SELECT symbol FROM listed WHERE upper(symbol) IN (SELECT underlying FROM under)""")
def _(spark, d):
    return U.validated_list(listed(spark, d), U.derivative_names(instruments(spark, d)))


@checks.add("u2_stale_names", f"""
WITH instr AS ({INSTR}), {UNDER}, listed AS (SELECT upper(symbol) AS symbol FROM ({LISTED}))
(SELECT symbol, 'stale' AS state FROM (SELECT symbol FROM listed EXCEPT SELECT underlying FROM under))
UNION ALL (SELECT symbol, 'live' FROM (SELECT symbol FROM listed INTERSECT SELECT underlying FROM under))""")
def _(spark, d):
    stale, live = C.stale_names(listed(spark, d).select(F.upper("symbol").alias("symbol")),
                                U.derivative_names(instruments(spark, d)))
    return stale.withColumn("state", F.lit("stale")).unionByName(live.withColumn("state", F.lit("live")))


@checks.add("u1_union_bars", with_views("bars", **OLD_NEW) + f"""
SELECT {SQL_BAR}, NULL::VARCHAR AS source FROM oldb UNION ALL SELECT {SQL_BAR}, 'new' FROM newb""")
def _(spark, d):
    old, new = old_new(spark, d)
    return C.union_bars(old, new.withColumn("source", F.lit("new"))).select(*bar_out(), "source")


@checks.add("u3_dedupe", f"""
WITH raw AS ({RAW})
SELECT symbol, ts::DATE AS session_date, min(event_id) AS first_id, max(event_id) AS last_id FROM raw GROUP BY 1, 2""")
def _(spark, d):
    raw = raw_feed(spark, d).withColumn("session_date", F.to_date("ts")).select("symbol", "session_date", "event_id")
    keys = ["symbol", "session_date"]
    return (C.earliest_per_key(raw, keys, ["event_id"]).withColumnRenamed("event_id", "first_id")
            .join(C.latest_per_key(raw, keys, ["event_id"]).withColumnRenamed("event_id", "last_id"), keys))


@checks.add("p14_filter_dates", with_views("bars") + f"""
SELECT {SQL_BAR} FROM bars WHERE session_date IN (SELECT DISTINCT session_date FROM bars WHERE day(session_date) % 3 = 0)
QUALIFY count(*) OVER (PARTITION BY symbol) >= 4""")
def _(spark, d):
    b = catalog.bars(spark, d)
    return C.filter_dates(b, b.filter(F.dayofmonth("session_date") % 3 == 0), 4).select(*bar_out())


# bars with defects injected by row id
BAD = """
  SELECT user_id AS symbol, event_id, CASE WHEN event_id % 301 = 0 THEN NULL WHEN event_id % 97 = 0 THEN ts - INTERVAL 2 DAY
    ELSE date_trunc('day', ts) + INTERVAL 1 MINUTE * (event_id // 2) END AS ts, 100.0::DOUBLE AS open,
    CASE WHEN event_id % 89 = 0 THEN 98.0 ELSE 101.0 + value END::DOUBLE AS high,
    CASE WHEN event_id % 83 = 0 THEN 100.5 ELSE 99.0 END::DOUBLE AS low,
    CASE WHEN event_id % 211 = 0 THEN 0.0 ELSE 99.5 + value END::DOUBLE AS close,
    CASE WHEN event_id % 67 = 0 THEN -1 ELSE 5 END::BIGINT AS volume FROM events"""


def bad_bars(spark, d):
    e, v = F.col("event_id"), F.col("value")
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    ts = (F.when(e % 301 == 0, F.lit(None)).when(e % 97 == 0, F.col("ts") - F.expr("INTERVAL 2 DAY"))
          .otherwise(day + F.make_dt_interval(mins=F.floor(e / 2).cast("int"))))
    return catalog.table(spark, d, "events").select(
        F.col("user_id").alias("symbol"), "event_id", ts.alias("ts"), F.lit(100.0).alias("open"),
        F.when(e % 89 == 0, 98.0).otherwise(101.0 + v).alias("high"), F.when(e % 83 == 0, 100.5).otherwise(99.0).alias("low"),
        F.when(e % 211 == 0, 0.0).otherwise(99.5 + v).alias("close"), F.when(e % 67 == 0, -1).otherwise(5).cast("long").alias("volume"))


@checks.add("p15_ohlcv_quality", f"""
WITH bad AS ({BAD}), p AS (SELECT *, lag(ts) OVER w AS pt, lag(close) OVER w AS pc, row_number() OVER w AS n,
    count(*) OVER (PARTITION BY symbol, ts) AS same FROM bad WINDOW w AS (PARTITION BY symbol ORDER BY event_id)),
f AS (SELECT symbol, count(*) AS rows, list_filter([
    CASE WHEN bool_or(high < low) THEN 'high < low rows' END,
    CASE WHEN bool_or(high < open OR high < close) THEN 'high < open/close rows' END,
    CASE WHEN bool_or(low > open OR low > close) THEN 'low > open/close rows' END,
    CASE WHEN bool_or(close <= 0 OR open <= 0) THEN 'non-positive prices' END,
    CASE WHEN bool_or(volume < 0) THEN 'negative volume' END,
    CASE WHEN bool_or(ts IS NULL) THEN 'unparseable timestamps' END,
    CASE WHEN bool_or(n > 1 AND (ts IS NULL OR pt IS NULL OR ts < pt)) THEN 'timestamps not sorted' END,
    CASE WHEN bool_or(same > 1) THEN 'duplicate timestamps' END,
    CASE WHEN bool_or(abs(close / nullif(pc, 0) - 1) > 0.4) THEN 'extreme per-bar returns (>40%)' END],
    lambda x: x IS NOT NULL) AS l FROM p GROUP BY symbol)
SELECT symbol, rows, len(l) = 0 AS ok, array_to_string(l, '|') AS issues FROM f""")
def _(spark, d):
    rep = C.ohlcv_quality(bad_bars(spark, d), "event_id")
    return rep.select("symbol", "rows", "ok", F.array_join("issues", "|").alias("issues"))


@checks.add("d1_bars_daily", with_views("bars", days=DAILY.format(src="bars")) + """
SELECT symbol, session_date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close,
  volume FROM days WHERE volume > 0""")
def _(spark, d):
    return C.daily_bars(catalog.bars(spark, d), ["symbol"]).select("symbol", "session_date", *rds(*OHLC), "volume")


@checks.add("d2_bars_15m", with_views("ticks") + f"""
SELECT symbol, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, round(arg_min(open, ticks.ts), 6) AS open, round(max(high), 6) AS high,
  round(min(low), 6) AS low, round(arg_max(close, ticks.ts), 6) AS close, CAST(sum(volume) AS BIGINT) AS volume
FROM ticks WHERE ts::TIME >= TIME '09:15:00' AND ts::TIME < TIME '15:30:00' GROUP BY 1, 2""")
def _(spark, d):
    s = NSE_DAY
    return C.coarser_bars(catalog.ticks(spark, d), 15, ["symbol"], keep=(s.open, s.close - 15)).select(*bar_out())


@checks.add("d24_distinct_dates_ts", with_views("bars") + """
SELECT session_date, count(DISTINCT ts) AS bars FROM bars GROUP BY 1""")
def _(spark, d):
    b = catalog.bars(spark, d)
    per = C.distinct_ts(b).groupBy(F.to_date("ts").alias("session_date")).agg(F.count(F.lit(1)).alias("bars"))
    return C.distinct_dates(b).join(per, "session_date")


@checks.add("d25_symbol_coverage", with_views("ticks") + """
SELECT symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM ticks GROUP BY 1""")
def _(spark, d):
    return C.symbol_coverage(catalog.ticks(spark, d))
