"""Candidate signals of every bar at once: detect, validate, score, first per day.

All steps share the (symbol, session) partitioning of the bars, so the plan shuffles bars once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators import gates, levels, lookups, patterns
from barloom.operators.recursive import confluence_inputs
from barloom.operators.rolling import average_volume_before, typical_price
from barloom.operators.layout import Layout
from barloom.spec import EntrySpec, SessionSpec

COLUMNS = ["symbol", "session_date", "ts", "pattern", "strategy", "direction", "side", "strength", "score", "ta", "vol_ratio",
           "price", "pattern_high", "pattern_low", "atr", "vwap", "struct_sl", "struct_target", "rr", "sl_method", "tgt_method",
           "confirmed", "turnover"]
RECURSIONS = {"_atr": "atr:14", "adx": "adx:14", "volume_ema": "volume_ema:20"}


def enrich(bars: DataFrame, spec: SessionSpec) -> DataFrame:
    """Bars with everything the rules read; windows first, then one grouped pass."""
    lay = levels.session_layout(levels.opening_range(bars, spec))
    upto = lay.rows(Window.unboundedPreceding, 0)
    vol = F.sum(F.col("volume").cast("double")).over(upto)
    lay = lay.with_columns(rows_so_far=lay.position(), avg_volume=average_volume_before(lay))
    lay = lay.with_columns(vwap=F.when((F.col("rows_so_far") >= 3) & (vol > 0),
                                       F.sum(typical_price() * F.col("volume")).over(upto) / F.greatest(vol, F.lit(1.0))))
    lay = patterns.detect(levels.swings_so_far(lay), spec)
    long_ok, short_ok = (gates.confirmed(lay, F.lit(d)) for d in (1, -1))
    lay = lay.with_columns(long_ok=long_ok, short_ok=short_ok)
    lay = Layout(lay.df.drop("swing_high", "swing_low"), lay.keys, lay.order)
    return confluence_inputs(lay, RECURSIONS).df


def candidates(enriched: DataFrame, spec: EntrySpec) -> DataFrame:
    """One row per hit that passes the filters of the bar."""
    df = enriched.filter(F.size("hits") > 0).filter(gates.trending(F.col("adx"), F.col("rows_so_far"), spec.min_trend_strength))
    df = df.filter(gates.liquid(F.col("close"), F.col("avg_volume"), spec.min_turnover_lakhs))
    atr = F.when(F.col("_atr") > 0, F.col("_atr")).otherwise(F.col("close") * 0.005)
    df = df.withColumns({"atr": atr, "raw_ratio": F.col("volume") / F.col("avg_volume"),
                         "turnover": F.col("close") * F.col("avg_volume") / 1e5})
    df = df.select("*", F.posexplode("hits").alias("hit_no", "hit")).drop("hits")
    df = df.withColumns({"direction": F.col("hit.direction"), "name": F.col("hit.name"), "base": F.col("hit.strength")})
    ok = F.when(F.col("direction") > 0, F.col("long_ok")).otherwise(F.col("short_ok"))
    df = df.withColumn("confirmed", ok).drop("hit", "long_ok", "short_ok")
    return df.filter("confirmed") if spec.require_confirmation else df


@dataclass(frozen=True)
class Strategy:
    """A rule over candidate hits: which rows it takes and what it reports for them.

    ``accept`` builds a predicate from the entry limits. It may read the hit (name, direction,
    base), the bar, its indicators, ``zone_hi`` and the gap columns of the session.
    """

    accept: Callable[[EntrySpec], Column]
    bonus: int = 1
    suffix: str = " (LIVE)"
    ratio: Column | None = None
    atr: Column | None = None
    exit: Column | None = None


def _busy(spec: EntrySpec) -> Column:
    return F.col("raw_ratio") >= spec.volume_ratio


def _zone(spec: EntrySpec) -> Column:
    return (F.col("name") == "OB Bear Star") & _busy(spec) & lookups.tight_stop(F.col("zone_hi"), spec)


def _breakout(spec: EntrySpec) -> Column:
    return F.col("name").isin("ORB Long", "ORB Short") & _busy(spec)


def _gap(spec: EntrySpec) -> Column:
    quiet = F.col("volume") < F.col("volume_ema")
    return F.col("name").isin("GapFill Long", "GapFill Short") & quiet & lookups.fades_gap(spec)


# fixed values: names routed to the candle strategy
CANDLES = ["Bullish Engulfing", "Bearish Engulfing", "Hammer", "Shooting Star", "Morning Star", "Evening Star"]


def _candle(spec: EntrySpec) -> Column:
    c, v = F.col("close"), F.col("vwap")
    aligned = v.isNull() | F.when(F.col("direction") > 0, c > v).otherwise(c < v)
    return F.col("name").isin(CANDLES) & _busy(spec) & aligned


def _structure(spec: levels.LevelSpec) -> Column:
    marks = [F.when(F.col(c) > 0, F.col(c)) for c in ("or_high", "or_low", "vwap")]
    found = levels.structure_levels(F.col("swings"), F.col("close"), marks, spec)
    return levels.structure_exit(F.col("close"), F.col("direction"), F.col("atr"), found, spec)


def stock_strategies(level_spec: levels.LevelSpec = levels.LevelSpec()) -> dict[str, Strategy]:
    """The four stock strategies; add entries for more."""
    quiet_ratio = F.col("volume") / F.greatest(F.col("volume_ema"), F.lit(1.0))
    return {"OB_SHORT": Strategy(_zone, bonus=2), "ORB": Strategy(_breakout),
            "GAPFILL": Strategy(_gap, bonus=2, ratio=quiet_ratio, atr=F.col("daily_atr")),
            "CANDLE_STRUCT": Strategy(_candle, suffix=" (STRUCT)", exit=_structure(level_spec))}


EXIT_TYPE = "struct<stop:double,target:double,rr:double,sl_method:string,tgt_method:string>"


def apply_strategies(hits: DataFrame, chosen: dict[str, Strategy], spec: EntrySpec) -> DataFrame:
    """One row per (hit, strategy that accepts it), in one pass over the hits."""
    def report(name: str, s: Strategy) -> Column:
        row = F.struct(F.lit(name).alias("strategy"), F.concat("name", F.lit(s.suffix)).alias("pattern"),
                       (F.col("base") + s.bonus).alias("strength"),
                       (s.ratio if s.ratio is not None else F.col("raw_ratio")).cast("double").alias("vol_ratio"),
                       (s.atr if s.atr is not None else F.col("atr")).cast("double").alias("atr"),
                       (s.exit if s.exit is not None else F.lit(None)).cast(EXIT_TYPE).alias("exit"))
        return F.when(F.coalesce(s.accept(spec), F.lit(False)), row)

    df = hits.withColumn("_r", F.explode(F.array_compact(F.array(*[report(n, s) for n, s in chosen.items()]))))
    return df.drop("atr").select("*", "_r.*").drop("_r")


def scored_hits(bars: DataFrame, zones: DataFrame | None, gaps: DataFrame | None, session: SessionSpec, spec: EntrySpec,
                decimals: int | None = 2, strategies: dict[str, Strategy] | None = None) -> DataFrame:
    """Every hit a strategy accepts, scored; ``decimals`` rounds the reported prices and ratios."""
    hits = candidates(enrich(bars, session), spec)
    hits = lookups.with_zone(hits, zones, spec) if zones is not None else hits.withColumn("zone_hi", F.lit(None).cast("double"))
    if gaps is not None:
        hits = lookups.with_gap(hits, gaps)
    else:
        hits = hits.withColumns({"gap_pct": F.lit(None).cast("double"), "gap_dir": F.lit(None).cast("string"),
                                 "daily_atr": F.lit(None).cast("double")})
    df = apply_strategies(hits, strategies or stock_strategies(), spec)
    score, tags = gates.confluence()
    cut = (lambda c: F.round(c, decimals)) if decimals is not None else (lambda c: c)
    df = df.withColumns({"score": (F.col("strength") + score), "ta": tags,
                         "side": F.when(F.col("direction") > 0, "BUY").otherwise("SELL"),
                         "price": cut(F.col("close")), "pattern_high": cut(F.col("high")), "pattern_low": cut(F.col("low")),
                         "atr": cut(F.col("atr")), "vwap": cut(F.col("vwap")), "vol_ratio": cut(F.col("vol_ratio")),
                         "struct_sl": F.col("exit.stop"), "struct_target": F.col("exit.target"), "rr": F.col("exit.rr"),
                         "sl_method": F.col("exit.sl_method"), "tgt_method": F.col("exit.tgt_method")})
    return df.select(*COLUMNS, "hit_no")


def first_signals(hits: DataFrame, run_keys: list[str] = []) -> DataFrame:
    """The first accepted hit per (symbol, session, strategy, direction)."""
    keys = [*run_keys, "symbol", "session_date", "strategy", "direction"]
    return gates.first_per_day(hits, keys, ["ts", "hit_no"]).drop("hit_no")


def candidate_signals(bars: DataFrame, zones: DataFrame | None, gaps: DataFrame | None, session: SessionSpec, spec: EntrySpec,
                      decimals: int | None = 2, strategies: dict[str, Strategy] | None = None) -> DataFrame:
    """Scored signals of all sessions, one per (symbol, session, strategy, direction)."""
    return first_signals(scored_hits(bars, zones, gaps, session, spec, decimals, strategies))
