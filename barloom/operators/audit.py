"""Reports, decision records and text hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.trading import net_pnl
from barloom.operators.clean import earliest_per_key, latest_per_key
from barloom.operators.layout import lay_out


def day_report(trades: DataFrame) -> DataFrame:
    """One row per day: counts, realised net, win rate, best and worst.

    Partial exits count as wins and losses but not in the win rate, whose base is final exits.
    """
    p, final = F.col("pnl"), F.col("outcome") != "PARTIAL"
    n_final = F.count(F.when(final, 1))
    return trades.groupBy(F.to_date("exit_time").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), n_final.alias("finals"), F.count(F.when(p > 0, 1)).alias("wins"),
        F.count(F.when(p <= 0, 1)).alias("losses"), F.sum(p).alias("net"),
        F.coalesce(F.count(F.when(final & (p > 0), 1)) / F.nullif(n_final, F.lit(0)) * 100, F.lit(0.0)).alias("win_rate"),
        F.max(p).alias("best"), F.min(p).alias("worst"))


def open_suggestions(suggestions: DataFrame, order: list[str], n: int | None = None) -> DataFrame:
    """Suggestions that led to no trade, numbered per day; with ``n`` the first of each day."""
    waiting = suggestions.filter("not acted")
    w = Window.partitionBy("day").orderBy(*order)
    numbered = waiting.withColumn("n", F.row_number().over(w))
    return numbered if n is None else numbered.filter(F.col("n") <= n)


def floating_pnl(positions: DataFrame, last_price: Column, cost) -> DataFrame:
    return positions.withColumn("floating", net_pnl(F.col("entry"), F.coalesce(last_price, F.col("entry")), F.col("qty"), F.col("side"), cost))


def model_coverage(events: DataFrame, day: Column) -> DataFrame:
    """Model use per day; reads kind (attempt, accept, reject, fallback), reason, symbol and ts.

    The most common reason is found from counts per (day, reason), not from all events.
    """
    kind = F.col("kind")
    base = events.withColumn("day", day)
    per = base.groupBy("day", "reason").agg(
        F.count(F.when(kind == "attempt", 1)).alias("attempted"), F.count(F.when(kind == "accept", 1)).alias("accepted"),
        F.count(F.when(kind == "reject", 1)).alias("rejected"), F.count(F.when(kind == "fallback", 1)).alias("fallbacks"),
        F.max(F.when(kind == "accept", F.struct("ts", "symbol"))).alias("_last"))
    bad = F.when((F.col("rejected") + F.col("fallbacks") > 0) & F.col("reason").isNotNull(),
                 F.struct((F.col("rejected") + F.col("fallbacks")).alias("n"), F.col("reason")))
    # equal counts: the alphabetically first reason
    out = per.groupBy("day").agg(
        *[F.sum(c).alias(c) for c in ("attempted", "accepted", "rejected", "fallbacks")],
        F.min_by("reason", F.when(bad.isNotNull(), F.struct((-bad["n"]).alias("n"), "reason"))).alias("top_reject_reason"),
        F.max("_last").alias("_last"))
    return out.select("day", "attempted", "accepted", "rejected", "fallbacks",
                      (F.col("accepted") / F.nullif(F.col("attempted"), F.lit(0))).alias("acceptance_rate"), "top_reject_reason",
                      F.col("_last.symbol").alias("last_accept_symbol"), F.col("_last.ts").alias("last_accept_ts"))


def decision_id(strategy: Column, symbol: Column, side: Column, ts: Column) -> Column:
    return F.upper(F.concat_ws("-", strategy, symbol, F.date_format(ts, "yyyyMMdd'T'HHmmss"), side))


# fixed values: token shapes that must not reach a log, and the text that replaces them
SECRET_PATTERNS = [r"ghp_[A-Za-z0-9]{20,}", r"[0-9]{8,10}:AA[A-Za-z0-9_-]{30,}"]
MASK = "***REDACTED***"


def redact(text: Column, known_values: tuple[str, ...] = (), patterns: list[str] = SECRET_PATTERNS) -> Column:
    """Known secret values of six letters or more first, then token shapes."""
    for value in known_values:
        if len(value) >= 6:
            text = F.replace(text, F.lit(value), F.lit(MASK))
    for p in patterns:
        text = F.regexp_replace(text, p, MASK)
    return text


# fixed values: event names of the audit log, and model states that mean a fallback
LOG_EVENTS = ["signal_created", "signal_rejected", "model_prediction", "exit_resolved", "order_submitted", "order_rejected",
              "position_changed", "fallback_invoked", "state_restored"]
FALLBACK_STATES = ["MODEL_NOT_FOUND", "META_NOT_FOUND", "LIGHTGBM_NOT_AVAILABLE", "SCHEMA_MISMATCH", "INSUFFICIENT_BARS",
                   "INVALID_FEATURE", "PREDICTION_ERROR", "LOW_CONFIDENCE", "OUT_OF_RANGE", "FALLBACK_USED"]


def audit_json(events: DataFrame, fields: list[str]) -> DataFrame:
    """Adds ``record``: one JSON object per event; unknown events carry a marker."""
    unknown = F.when(~F.col("event").isin(LOG_EVENTS), F.lit(True)).alias("_unknown_event")
    return events.withColumn("record", F.to_json(F.struct("event", "ts", *fields, unknown)))


def is_fallback(status: Column) -> Column:
    return status.isin(FALLBACK_STATES)


def append_new(stored: DataFrame, incoming: DataFrame, key: str = "decision_id") -> DataFrame:
    """Stored rows plus incoming rows whose key is not stored yet; of equal incoming keys the first by ts."""
    fresh = earliest_per_key(incoming, [key], ["ts"]).join(stored.select(key), key, "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def upsert(stored: DataFrame, incoming: DataFrame, version: str, key: str = "decision_id") -> DataFrame:
    """The row with the highest version per key."""
    return latest_per_key(stored.unionByName(incoming), [key], [version])


def mark_acted(suggestions: DataFrame, opened: DataFrame) -> DataFrame:
    """Adds ``acted``: the n-th opened trade of (symbol, strategy) marks its n-th suggestion.

    Suggestions in order of ``suggestion_id``. Only the number of trades matters, so the trades are
    counted and the suggestions numbered in a layout that splits a busy key.
    """
    keys = ["symbol", "strategy"]
    n = opened.groupBy(*keys).agg(F.count(F.lit(1)).alias("_opened"))
    lay = lay_out(suggestions, keys, ["suggestion_id"])
    lay = lay.with_columns(_n=lay.position())
    return (lay.finish().join(n, keys, "left")
            .withColumn("acted", F.col("_n") <= F.coalesce("_opened", F.lit(0))).drop("_n", "_opened"))


def schema_hash(names: list[str], version: str = "v1") -> str:
    """Short fingerprint of an ordered feature list; the format is fixed, stored fingerprints must compare."""
    import hashlib
    import json

    text = json.dumps({"version": version, "features": list(names)})
    return "fs-" + hashlib.sha256(text.encode()).hexdigest()[:12]


def table_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-independent fingerprint of rows: count, xor and sum of 60-bit row digests."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    digest = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    return df.select(digest.alias("d")).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("d").alias("xor"),
                                            F.sum((F.col("d") % 1_000_003)).alias("checksum"))
