"""Streaming twins of the batch operators.

State is keyed so that it stays small: by symbol for bars, by
(account, day) for circuit breakers, by sender for rate limits. Checkpoints and outputs go
below the shared scratch folder, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.layout import pinned, scratch_path
from barloom.plans import signals as S
from barloom.spec import DayLimits, EntrySpec, SessionSpec
from barloom.streaming.rules import Breaker, pass_breaker


def read_stream(spark: SparkSession, path: str, schema: str, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_to_files(stream: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Runs an append-mode stream over what is available now and reads its files back."""
    spark = stream.sparkSession
    path, checkpoint = path or scratch_path(spark, name), checkpoint or scratch_path(spark, f"{name}-state")
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, fn, name: str, mode: str = "append", checkpoint: str | None = None) -> None:
    """Runs ``fn(batch, batch_id)`` per micro-batch; writes of ``fn`` must replace those of the same id."""
    checkpoint = checkpoint or scratch_path(stream.sparkSession, f"{name}-state")
    query = (stream.writeStream.outputMode(mode).foreachBatch(fn).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def stream_bars(ticks: DataFrame, width: str = "5 minutes", delay: str = "5 minutes", key: str = "symbol") -> DataFrame:
    """Closed bars of a tick stream (key, ts, price, size). The forming bar is held back by the watermark."""
    w = F.window("ts", width)
    bars = (ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(key, w)
            .agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
                 F.max_by("price", "ts").alias("close"), F.sum("size").cast("long").alias("volume")))
    return bars.select(key, F.col("window.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def stream_dedupe(rows: DataFrame, keys: list[str], ts: str = "ts", delay: str = "5 minutes") -> DataFrame:
    """One row per key within the delay. The first arrival wins, where the batch form keeps the last."""
    return (rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys))


def stream_signals(bars: DataFrame, zones: DataFrame, gaps: DataFrame, session: SessionSpec, spec: EntrySpec, store: str, out: str,
                   decimals: int | None = 2, strategies: dict | None = None, checkpoint: str | None = None) -> DataFrame:
    """Signals of each micro-batch of closed bars, equal to the batch plan's.

    A batch adds its bars to a table partitioned by session and batch, recomputes the sessions it touches
    and keeps the signals of its own bars. The dates of the batch are a literal partition filter, so the
    read follows the batch and not the history. Both writes are keyed by batch id, which
    makes a replay harmless. Zones and gaps are written once, before the stream.
    """
    spark = bars.sparkSession
    schema = bars.schema
    zones, gaps = pinned(zones), pinned(gaps)

    def step(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("session_date", "batch_id").parquet(store))
        # as many dates as the batch itself has
        dates = [r["session_date"] for r in batch.select("session_date").distinct().collect()]
        days = spark.read.parquet(store).filter(F.col("session_date").isin(dates) & (F.col("batch_id") <= batch_id))
        mine = days.filter(F.col("batch_id") == batch_id).select(*schema.fieldNames())
        history = days.select(*schema.fieldNames())
        touched = mine.select("symbol", "session_date").distinct()
        history = history.join(touched, ["symbol", "session_date"], "left_semi")
        found = S.candidate_signals(history, zones, gaps, session, spec, decimals, strategies)
        found = found.join(mine.select("symbol", "ts").distinct(), ["symbol", "ts"], "left_semi")
        found.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    run_batches(bars, step, "signals", checkpoint=checkpoint)
    return spark.read.parquet(out).drop("batch_id")


# ---- circuit breakers -------------------------------------------------------------------------
HALT_COLUMNS = "account string, day date, trade_id long, net double, streak long, trades long, halted boolean, reason string"


def stream_halts(trades: DataFrame, limits: DayLimits = DayLimits(), delay: str = "1 day") -> DataFrame:
    """Running day state per account after each closed trade (account, day, ts, trade_id, pnl)."""
    names = Breaker.names()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        breaker = Breaker(*state.get) if state.exists else Breaker()
        rows = pd.concat(list(parts)).sort_values(["ts", "trade_id"])
        out = [(key[0], key[1], int(t), *pass_breaker(breaker, float(p), limits)) for t, p in zip(rows["trade_id"], rows["pnl"])]
        state.update(tuple(getattr(breaker, n) for n in names))
        end = int((pd.Timestamp(key[1]) + pd.Timedelta(days=2)).timestamp() * 1000)
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        yield pd.DataFrame(out, columns=["account", "day", "trade_id", "net", "streak", "trades", "halted", "reason"])

    return (trades.withWatermark("ts", delay).groupBy("account", "day")
            .applyInPandasWithState(step, HALT_COLUMNS, Breaker.schema(), "append", GroupStateTimeout.EventTimeTimeout))


def stream_trend(signals: DataFrame, trend: DataFrame, bar_minutes: int = 5, delay: str = "1 hour") -> DataFrame:
    """Signals with the index trend of their bar or the bar before (``age`` 0 or 1).

    Both streams carry a bar number; each trend row is offered to its own bar and the next one, so the
    interval join is an equi-join with a time bound that lets Spark drop old state. A reader keeps the
    smaller age per signal.
    """
    width = bar_minutes * 60
    number = lambda ts: F.floor(F.unix_seconds(ts) / F.lit(width)).cast("long")
    s = signals.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("bar", number(F.col("ts")))
    t = trend.select(F.col("ts").cast("timestamp").alias("trend_ts"), "trend").withWatermark("trend_ts", delay)
    t = t.withColumn("age", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("bar", number(F.col("trend_ts")) + F.col("age"))
    near = (F.col("trend_ts") <= F.col("ts")) & (F.col("trend_ts") > F.col("ts") - F.expr(f"INTERVAL {2 * width} SECONDS"))
    return s.join(t, (s["bar"] == t["bar"]) & near, "inner").drop(s["bar"]).drop(t["bar"])


RATE_COLUMNS = "sender string, event_id long, recent long, ok boolean"


def stream_rate_limit(events: DataFrame, seconds: int = 60, limit: int = 10, delay: str = "1 minute") -> DataFrame:
    """Count of a sender's events (sender, ts, event_id) in the trailing window; the state is those times."""
    span = seconds * 1_000_000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for ts, event in zip(rows["ts"].astype("datetime64[us]").astype("int64"), rows["event_id"]):
            while times and ts - times[0] >= span:
                times.popleft()
            times.append(int(ts))
            out.append((key[0], int(event), len(times), len(times) <= limit))
        state.update((list(times),))
        end = times[-1] // 1000 + seconds * 1000 + 1
        if end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        yield pd.DataFrame(out, columns=["sender", "event_id", "recent", "ok"])

    return (events.withWatermark("ts", delay).groupBy("sender")
            .applyInPandasWithState(step, RATE_COLUMNS, "times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout))


def stream_coverage(events: DataFrame, out: str, delay: str = "1 day", checkpoint: str | None = None) -> DataFrame:
    """Day counters of model decisions in update mode; each batch writes the days it changed."""
    spark = events.sparkSession
    kind = F.col("kind")
    days = (events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", "1 day"))
            .agg(*[F.count(F.when(kind == k, 1)).alias(n) for k, n in (("attempt", "attempted"), ("accept", "accepted"), ("reject", "rejected"),
                                                                       ("fallback", "fallbacks"))]))
    days = days.select(F.to_date("window.start").alias("day"), "attempted", "accepted", "rejected", "fallbacks")

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    run_batches(days, step, "coverage", mode="update", checkpoint=checkpoint)
    cols = ["attempted", "accepted", "rejected", "fallbacks"]
    latest = spark.read.parquet(out).groupBy("day").agg(F.max_by(F.struct(*cols), "batch_id").alias("s"))
    return latest.select("day", *[F.col(f"s.{c}").alias(c) for c in cols])
