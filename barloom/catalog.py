"""Input tables and the stand-in views the registered queries run on.

``barloom.checks.views_sql`` holds the same views in DuckDB's spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# An irrational factor keeps derived prices off decimal ties, where two engines may round apart.
SCALE = 1.0471975511965976


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def minute_of_day(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.hour(c) * 60 + F.minute(c)


def bucket_bars(ticks: DataFrame, minutes: int, keys: list[str]) -> DataFrame:
    """Raw (keys, ts, price, size) ticks to bars; the aggregation combines map-side."""
    width = minutes * 60_000_000
    start = F.timestamp_micros(F.floor(micros("ts") / F.lit(width)).cast("long") * F.lit(width)).cast("timestamp_ntz")
    return (ticks.withColumn("bar", start).groupBy(*keys, "bar")
            .agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
                 F.max_by("price", "ts").alias("close"), F.sum("size").cast("long").alias("volume"))
            .select(*keys, F.col("bar").alias("ts"), F.to_date("bar").alias("session_date"),
                    "open", "high", "low", "close", "volume"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly session bars, one series per event type."""
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts",
                                               (100.0 + F.col("value") * (SCALE / 100)).alias("price"), F.lit(1).alias("size"))
    return bucket_bars(ev, 60, ["symbol"])


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = (table(spark, sf_dir, "events")
          .select("ts", (100.0 + F.col("value") * (SCALE / 100)).alias("price"), F.lit(1).alias("size")))
    return bucket_bars(ev, 60, [])


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per event and one series per user: grows row by row with the table."""
    e = F.col("event_id")
    lo_open, close = 100.0 + (e % 50).cast("double"), 100.0 + F.col("value") * SCALE
    return (table(spark, sf_dir, "events")
            .select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), "ts",
                    F.to_date("ts").alias("session_date"), lo_open.alias("open"),
                    (F.greatest(lo_open, close) + (e % 7).cast("double") * 0.5).alias("high"),
                    (F.least(lo_open, close) - (e % 5).cast("double") * 0.5).alias("low"),
                    close.alias("close"),
                    F.when(e % 11 == 0, F.lit(0)).otherwise(1 + e % 97).cast("long").alias("volume")))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    return table(spark, sf_dir, "events").select(
        e.alias("trade_id"), F.concat(F.lit("S"), (u % 50).cast("string")).alias("symbol"),
        F.col("event_type").alias("strategy"), F.when(e % 2 == 0, "BUY").otherwise("SELL").alias("side"),
        F.col("ts").alias("exit_time"), (1 + e % 10).cast("long").alias("qty"),
        (100.0 + (u % 50).cast("double")).alias("entry_price"), ((v - 50.0) * SCALE).alias("pnl"),
        ((v - 50.0) * SCALE / 50.0).alias("r"),
        F.when(v >= 90, "TARGET").when(v < 20, "SL").when(e % 9 == 0, "PARTIAL").otherwise("TIME_STALE").alias("outcome"),
        F.when(u % 3 == 0, "view:agree(0.80)").when(u % 3 == 1, "view:disagree(0.40)").otherwise("").alias("tag"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return (table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
            .select(k.alias("decision_id"), F.concat(F.lit("S"), (c % 40).cast("string")).alias("symbol"),
                    F.col("o_orderpriority").alias("strategy"), F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"),
                    (p * (SCALE / 1000)).alias("entry"), (p * (SCALE / 1000) * F.when(k % 2 == 0, 0.99).otherwise(1.01)).alias("sl"),
                    (1 + k % 20).cast("long").alias("qty"), F.col("o_orderdate").alias("opened_at")))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol to sector, derived from the customers; every fifth symbol has none."""
    c = F.col("c_custkey")
    return (table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0")
            .groupBy((c % 40).alias("k")).agg(F.min("c_mktsegment").alias("sector"))
            .select(F.concat(F.lit("S"), F.col("k").cast("string")).alias("symbol"), "sector"))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.concat(F.lit("D"), (F.col("event_id") % 500).cast("string")).alias("decision_id"),
        F.when(t == "error", "order_rejected").when(t == "signup", "signal_created")
        .when(t == "purchase", "order_submitted").when(t == "click", "model_prediction")
        .otherwise("fallback_invoked").alias("event"), F.col("props").alias("payload"))
