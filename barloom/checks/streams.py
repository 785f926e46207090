"""Streams over the event files, compared with batch SQL on what the watermark has closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import catalog
from barloom.checks import stand_ins as X
from barloom.checks.registry import Checks, rd, rds, sql_rd
from barloom.checks.indicators import TREND
from barloom.checks.signals import SIG_NUM, SIGNALS
from barloom.checks.views_sql import with_views
from barloom.operators.clean import earliest_per_key
from barloom.operators.layout import scratch_path
from barloom.operators.recursive import index_trend
from barloom.plans import signals as S
from barloom.spec import DayLimits
from barloom.streaming import jobs as J

checks = Checks()
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark, d):
    return J.read_stream(spark, d, EVENTS, glob="events.parquet")


def file_stream(df, name, parts=None):
    """A stream over ``df`` written as files; ``parts`` are filters written one after the other, one per trigger."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    for p in parts or [F.lit(True)]:
        df.filter(p).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@checks.add("st1_stream_bars", with_views("bars") + """
SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM bars
WHERE ts + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 5 MINUTE FROM events)""")
def _(spark, d):
    t = events(spark, d).select(F.col("event_type").alias("symbol"), "ts", (100.0 + F.col("value") * (catalog.SCALE / 100)).alias("price"), F.lit(1).alias("size"))
    return J.run_to_files(J.stream_bars(t, "1 hour"), "bars").select("symbol", "ts", *rds("open", "high", "low", "close"), "volume")


@checks.add("st2_stream_dedupe", "SELECT DISTINCT user_id, CAST(hour(ts) AS INT) AS hour FROM events")
def _(spark, d):
    e = events(spark, d).select("user_id", F.hour("ts").alias("hour"), "ts")
    return J.run_to_files(J.stream_dedupe(e, ["user_id", "hour"], delay="40 days"), "dedupe").select("user_id", "hour")


@checks.add("st3_stream_signals", with_views("bars", recursive=True, **SIGNALS) + f"""
SELECT symbol, session_date, ts, pattern, strategy, direction, side, strength, score, ta, {sql_rd(*SIG_NUM)}, sm AS sl_method FROM (SELECT *, sl_method AS sm FROM signals)""")
def _(spark, d):
    # the morning of all sessions first, then the rest in three batches: signals need the bars of the earlier ones
    late = F.hour("ts") >= 11
    bars = file_stream(catalog.bars(spark, d), "bars-in", [~late, *[late & (F.dayofmonth("session_date") % 3 == k) for k in range(3)]])
    out = J.stream_signals(bars, X.zones(spark, d), X.gaps(spark, d), X.CLOCK, X.ENTRY, scratch_path(spark, "bar-store"), scratch_path(spark, "signals"),
                           None, S.stock_strategies(X.LEVELS))
    return out.select("symbol", "session_date", "ts", "pattern", "strategy", "direction", "side", "strength", "score", "ta", *rds(*SIG_NUM), "sl_method")


LIM = DayLimits(max_loss=60.0, profit_target=150.0, max_loss_streak=4)


@checks.add("st5_stream_halts", with_views("trades", k="""
  SELECT *, exit_time::DATE AS day, row_number() OVER w AS n, sum(pnl) OVER w AS net FROM trades WINDOW w AS (PARTITION BY symbol, exit_time::DATE ORDER BY exit_time, trade_id)""", s="""
  SELECT *, n - coalesce(max(CASE WHEN pnl > 0 THEN n END) OVER (PARTITION BY symbol, day ORDER BY n), 0) AS streak FROM k""", r="""
  SELECT *, CASE WHEN net <= -60 THEN 'max loss' WHEN net >= 150 THEN 'profit target' WHEN streak >= 4 THEN 'loss streak' END AS rule FROM s""", f="""
  SELECT symbol, day, min(n) AS fn, arg_min(rule, n) AS why FROM r WHERE rule IS NOT NULL GROUP BY 1, 2""") + """
SELECT symbol AS account, day, trade_id, round(net, 4) AS net, streak, n AS trades, coalesce(n >= fn, false) AS halted, CASE WHEN n >= fn THEN why END AS reason FROM r LEFT JOIN f USING (symbol, day)""")
def _(spark, d):
    t = catalog.trades(spark, d).select(F.col("symbol").alias("account"), F.to_date("exit_time").alias("day"), F.col("exit_time").cast("timestamp").alias("ts"), "trade_id", "pnl")
    stream = file_stream(t, "trades-in", [F.hour("ts") < 9, F.hour("ts") >= 9])
    return J.run_to_files(J.stream_halts(stream, LIM, delay="40 days"), "halts").select("account", "day", "trade_id", rd("net", 4), "streak", "trades", "halted", "reason")


@checks.add("st6_day_reset", with_views("trades") + """
SELECT symbol AS account, exit_time::DATE AS day, count(*) AS trades, round(sum(pnl), 4) AS net FROM trades GROUP BY 1, 2""")
def _(spark, d):
    """The last state of every (account, day): a new day starts from nothing."""
    t = catalog.trades(spark, d).select(F.col("symbol").alias("account"), F.to_date("exit_time").alias("day"), F.col("exit_time").cast("timestamp").alias("ts"), "trade_id", "pnl")
    stream = file_stream(t, "reset-in", [F.dayofmonth("ts") <= 10, (F.dayofmonth("ts") > 10) & (F.dayofmonth("ts") <= 20), F.dayofmonth("ts") > 20])
    out = J.run_to_files(J.stream_halts(stream, LIM, delay="1 hour"), "reset")
    return out.groupBy("account", "day").agg(F.max("trades").alias("trades"), F.round(F.max_by("net", "trades"), 4).alias("net"))


@checks.add("st7_stream_trend", with_views("bars", "index_bars", recursive=True, **TREND, tr="SELECT * FROM trend WHERE hour(ts) % 3 <> 2") + """
SELECT b.symbol, b.ts, CASE WHEN b.close >= b.open THEN 1 ELSE -1 END::INT AS direction, coalesce(n.trend, p.trend) AS trend, CASE WHEN n.ts IS NOT NULL THEN 0 ELSE 1 END::INT AS age
FROM bars b LEFT JOIN tr n ON n.ts = b.ts LEFT JOIN tr p ON p.ts = b.ts - INTERVAL 1 HOUR WHERE n.ts IS NOT NULL OR p.ts IS NOT NULL""")
def _(spark, d):
    sig = catalog.bars(spark, d).select("symbol", "ts", F.when(F.col("close") >= F.col("open"), 1).otherwise(-1).alias("direction"))
    tr = index_trend(catalog.index_bars(spark, d)).filter("hour(ts) % 3 <> 2").select("ts", "trend")
    joined = J.stream_trend(file_stream(sig, "sig-in"), file_stream(tr, "trend-in"), 60, delay="40 days")
    out = J.run_to_files(joined, "trend")
    best = earliest_per_key(out.select("symbol", "ts", "direction", "trend", "age"), ["symbol", "ts"], ["age"])
    return best.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "direction", "trend", "age")


@checks.add("st8_stream_rate_limit", """
SELECT event_type AS sender, event_id, count(*) OVER w AS recent, count(*) OVER w <= 2 AS ok FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '29 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)""")
def _(spark, d):
    e = events(spark, d).select(F.col("event_type").alias("sender"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return J.run_to_files(J.stream_rate_limit(e, 1800, 2), "rate")


@checks.add("st9_stream_coverage", """
SELECT ts::DATE AS day, count(*) FILTER (event_type = 'click') AS attempted, count(*) FILTER (event_type = 'purchase') AS accepted,
  count(*) FILTER (event_type = 'error') AS rejected, count(*) FILTER (event_type = 'view') AS fallbacks FROM events GROUP BY 1""")
def _(spark, d):
    t = F.col("event_type")
    kind = F.when(t == "click", "attempt").when(t == "purchase", "accept").when(t == "error", "reject").when(t == "view", "fallback")
    e = catalog.table(spark, d, "events").select("ts", kind.alias("kind"))
    return J.stream_coverage(file_stream(e, "cov-in", [F.dayofmonth("ts") <= 14, F.dayofmonth("ts") > 14]), scratch_path(spark, "coverage"))
