"""Pattern hits of a bar, as column expressions over its session's rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barloom.operators.layout import Layout
from barloom.operators.rolling import previous
from barloom.spec import SessionSpec

HIT = "struct<direction:int,name:string,strength:int>"
# rows the candle rules compare with, as columns
LAGS = {"_o1": ("open", 1), "_c1": ("close", 1), "_o0": ("open", 2), "_h0": ("high", 2), "_l0": ("low", 2), "_c0": ("close", 2)}


def bar_shape(o: Column, h: Column, l: Column, c: Column, ts: Column) -> dict[str, Column]:
    """Range over close, body over range, both wicks and the weekday (Monday is 0) of a bar."""
    return {"range_pct": (h - l) / c, "body_frac": F.abs(c - o) / F.when(h > l, h - l).otherwise(F.lit(1e-9)),
            "upper_wick": h - F.greatest(o, c), "lower_wick": F.least(o, c) - l, "dow": F.weekday(ts)}


def hit(condition: str, direction: int, name: str, strength: int) -> str:
    """SQL of a hit struct, null unless the condition holds."""
    return f"CASE WHEN {condition} THEN named_struct('direction', {direction}, 'name', '{name}', 'strength', {strength}) END"


def with_lags(lay: Layout) -> Layout:
    """Adds the columns the candle and range rules look back on."""
    return lay.with_columns(**{n: previous(lay, c, k) for n, (c, k) in LAGS.items()})


def spread(high: Column, low: Column) -> Column:
    return F.greatest(high - low, F.lit(1e-9))


def shooting_star(o: Column, h: Column, l: Column, c: Column, wick: float = 2.0, body_share: float = 0.35) -> Column:
    """Small body, long upper wick, close in the lower half of the bar."""
    body, upper, lower = F.abs(c - o), h - F.greatest(o, c), F.least(o, c) - l
    return ((body / spread(h, l) <= body_share) & ((body == 0) | (upper >= wick * body)) & (upper > lower)
            & ((c - l) / spread(h, l) <= 0.5))


def candle_hits() -> list[str]:
    """Reversal candles from the last three rows, in their order of precedence (SQL over LAGS)."""
    b0, b1, b2 = "abs(_c0 - _o0)", "abs(_c1 - _o1)", "abs(close - open)"
    r0, r2 = "greatest(_h0 - _l0, 1e-9D)", "greatest(high - low, 1e-9D)"
    upper, lower, mid = "(high - greatest(open, close))", "(least(open, close) - low)", "(_o0 + _c0) / 2"
    small = f"_c0 IS NOT NULL AND {b2} > 0 AND {b2} / {r2} <= 0.35D"
    turn = f"{b0} > 0.6D * {r0} AND {b1} < 0.4D * {b0} AND {b2} > 0.6D * {r2}"
    # fixed values: names and strengths of the candle patterns
    return [
        hit(f"_c0 IS NOT NULL AND _c1 < _o1 AND close > open AND open <= _c1 AND close >= _o1 AND {b2} > {b1}", 1, "Bullish Engulfing", 5),
        hit(f"_c0 IS NOT NULL AND _c1 > _o1 AND close < open AND open >= _c1 AND close <= _o1 AND {b2} > {b1}", -1, "Bearish Engulfing", 5),
        hit(f"{small} AND {lower} >= 2 * {b2} AND {upper} <= 0.3D * {b2}", 1, "Hammer", 4),
        hit(f"{small} AND {upper} >= 2 * {b2} AND {lower} <= 0.3D * {b2}", -1, "Shooting Star", 4),
        hit(f"_c0 < _o0 AND {turn} AND close > open AND close > {mid}", 1, "Morning Star", 5),
        hit(f"_c0 > _o0 AND {turn} AND close < open AND close < {mid}", -1, "Evening Star", 5)]


def crossings(lay: Layout) -> tuple[Column, Column]:
    """(close crossed above the opening range, close crossed below it) on this row."""
    c, p = F.col("close"), previous(lay, "close")
    return ((c > F.col("or_high")) & (p <= F.col("or_high")), (c < F.col("or_low")) & (p >= F.col("or_low")))


MINUTE = "(hour(ts) * 60 + minute(ts))"


def inside(window: tuple[int, int]) -> str:
    return f"{MINUTE} >= {window[0]} AND {MINUTE} < {window[1]}"


def level_cross_hits(spec: SessionSpec) -> list[str]:
    above, below = "close > or_high AND _c1 <= or_high", "close < or_low AND _c1 >= or_low"
    brk, gap = inside(spec.breakout_entry), inside(spec.gap_entry)
    # fixed values: names and strengths of the range patterns
    return [hit(f"{brk} AND {above}", 1, "ORB Long", 5), hit(f"{brk} AND {below}", -1, "ORB Short", 5),
            hit(f"{gap} AND {below}", -1, "GapFill Short", 5), hit(f"{gap} AND {above}", 1, "GapFill Long", 5)]


def found(hits: list[str], when: str = "true") -> Column:
    """Array of the hits that occurred, empty unless ``when`` holds."""
    return F.expr(f"CASE WHEN {when} THEN array_compact(array({', '.join(hits)})) ELSE CAST(array() AS array<{HIT}>) END")


def detect(lay: Layout, spec: SessionSpec) -> Layout:
    """Adds ``hits``, the array of pattern hits of each row; needs or_high, or_low and rows_so_far."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    lay = with_lags(lay).with_columns(_star=shooting_star(o, h, l, c))
    # fixed values: name and strength of the zone pattern
    zone = hit(f"{inside(spec.zone_entry)} AND _star", -1, "OB Bear Star", 4)
    candles = f"rows_so_far >= {spec.min_candle_bars} AND {inside(spec.candle_entry)}"
    every = F.concat(found([zone, *level_cross_hits(spec)]), found(candle_hits(), candles))
    ready = (F.col("rows_so_far") >= spec.min_bars) & (c > 0)
    df = lay.df.withColumn("hits", F.when(ready, every).otherwise(F.array().cast(f"array<{HIT}>"))).drop(*LAGS, "_star")
    return Layout(df, lay.keys, lay.order, lay.split, lay.edges)
