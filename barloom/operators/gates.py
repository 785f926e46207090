"""Rules that keep, drop, score or rank signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.layout import Layout
from barloom.operators.rolling import previous


def index_gate(direction: Column, trend: Column, mode: str = "soft") -> Column:
    """soft: not against the index; strict: with the index; off: always true."""
    if mode == "off":
        return F.lit(True)
    if mode == "strict":
        return ((direction > 0) & (trend == 1)) | ((direction < 0) & (trend == -1))
    return ((direction > 0) & (trend >= 0)) | ((direction < 0) & (trend <= 0))


def liquid(close: Column, average_volume: Column, min_lakhs: float) -> Column:
    return (average_volume > 0) & (close * average_volume / 1e5 >= min_lakhs)


def trending(adx: Column, rows: Column, minimum: float = 20.0, period: int = 14) -> Column:
    """Drops only what is known to be choppy: a missing or zero index passes."""
    return ~F.coalesce((rows >= 2 * period) & (adx > 0) & (adx < minimum), F.lit(False))


def confirmed(lay: Layout, direction: Column) -> Column:
    """Long above the previous high, short below the previous low; the first row passes."""
    ph, pl, c = previous(lay, "high"), previous(lay, "low"), F.col("close")
    return (ph.isNull() | ((direction > 0) & (c > ph)) | ((direction < 0) & (c < pl)) | (direction == 0))


def confluence(direction: str = "direction") -> tuple[Column, Column]:
    """(score, tags) of the indicators that agree with the direction column.

    Reads rsi, supertrend, ema20, cmf, macd_hist, close and rows_so_far; a missing value adds nothing.
    """
    d = direction
    # fixed values: tags of the confluence score, one point each
    votes = [f"CASE WHEN {d} > 0 AND rsi >= 45 AND rsi < 70 THEN 'RSI+' WHEN {d} < 0 AND rsi > 30 AND rsi <= 55 THEN 'RSI-' END",
             f"CASE WHEN supertrend = sign({d}) THEN 'ST+' END",
             f"CASE WHEN {d} > 0 AND close >= ema20 THEN 'EMA+' WHEN {d} < 0 AND close <= ema20 THEN 'EMA-' END",
             f"CASE WHEN {d} > 0 AND cmf > 0 THEN 'CMF+' WHEN {d} < 0 AND cmf < 0 THEN 'CMF-' END",
             f"CASE WHEN {d} > 0 AND macd_hist > 0 THEN 'MACD+' WHEN {d} < 0 AND macd_hist < 0 THEN 'MACD-' END"]
    tags = f"CASE WHEN rows_so_far >= 5 AND {d} <> 0 THEN array_compact(array({', '.join(votes)})) ELSE CAST(array() AS array<string>) END"
    return F.expr(f"size({tags})"), F.expr(f"array_join({tags}, ',')")


def first_per_day(signals: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One signal per (symbol, session, strategy, direction): the earliest."""
    rest = [c for c in signals.columns if c not in keys]
    best = signals.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_s"))
    return best.select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest]).select(*signals.columns)


def rank_signals(signals: DataFrame, run_keys: list[str], top: int, use_strength: bool = True) -> DataFrame:
    """Best signal per symbol and bar, then the top N of each bar; adds ``rank``.

    (symbol, pattern) closes ties. Both limits are pruned before their shuffles by Spark.
    """
    order = [F.col("score").desc(), F.col("vol_ratio").desc()]
    order += [F.col("strength").desc()] if use_strength else []
    order += [F.col("symbol"), F.col("pattern")]
    one = Window.partitionBy(*run_keys, "ts", "symbol").orderBy(*order)
    bar = Window.partitionBy(*run_keys, "ts").orderBy(*order)
    best = signals.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    return best.withColumn("rank", F.row_number().over(bar)).filter(F.col("rank") <= top)


# fixed values: forecast gate
MIN_UP_PROB, BOOST, PENALTY = 0.55, 2, 2


def forecast_gate(direction: Column, view_dir: Column, up_prob: Column, strict: bool = False) -> Column:
    """Struct (allow, adjust, reason) of a trade direction against a forecast view (null view: no opinion)."""
    conf = F.when(direction > 0, up_prob).otherwise(1.0 - up_prob)
    agrees = ((direction > 0) & (view_dir > 0)) | ((direction < 0) & (view_dir < 0))
    against = ((direction > 0) & (view_dir < 0)) | ((direction < 0) & (view_dir > 0))
    sure = (conf >= MIN_UP_PROB) | (1.0 - conf >= MIN_UP_PROB)
    missing = view_dir.isNull()
    state = (F.when(missing, "na").when(agrees & (conf >= MIN_UP_PROB), "agree")
             .when(against & sure, "veto" if strict else "disagree").otherwise("neutral"))
    adjust = F.when(state == "agree", BOOST).when(state == "disagree", -PENALTY).otherwise(0)
    reason = F.when(missing, "forecast:na").otherwise(F.concat(F.lit("forecast:"), state, F.lit("("),
                                                              F.format_string("%.2f", conf), F.lit(")")))
    return F.struct((state != "veto").alias("allow"), adjust.alias("adjust"), reason.alias("reason"))


def fresh(generated: Column, now: Column, max_minutes: float) -> Column:
    """True up to and including the age limit."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(generated.cast("timestamp"))) / 60e6
    return generated.isNotNull() & (age <= max_minutes)


def usable_forecast(generated: Column, now: Column, model: Column, skill: Column, accepted_model: str,
                    min_skill: float = 0.0, max_hours: float = 30.0) -> Column:
    """Fresh, from the expected model and with skill strictly above the minimum."""
    return fresh(generated, now, max_hours * 60) & (model == accepted_model) & (F.coalesce(skill, F.lit(0.0)) > min_skill)

