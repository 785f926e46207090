"""Price levels: opening range, swings, zones, gaps, and exits placed around levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.catalog import minute_of_day
from barloom.operators.clean import daily_bars
from barloom.operators.layout import Layout, lay_out
from barloom.operators.recursive import recursive_columns, warm_up
from barloom.spec import SessionSpec


@dataclass(frozen=True)
class LevelSpec:
    # fixed values: level search
    swing_rows: int = 3
    cluster: float = 0.0015
    target_buffer_atr: float = 0.15
    stop_buffer_atr: float = 0.20
    min_rr: float = 1.2
    max_rr: float = 5.0
    round_step: float = 0.005
    max_risk: float = 0.015
    decimals: int | None = 2


def session_layout(bars: DataFrame) -> Layout:
    """One window partition per (symbol, session): at most one row per bar interval."""
    return Layout(bars, ["symbol", "session_date"], ["ts"])


def opening_range(bars: DataFrame, spec: SessionSpec) -> DataFrame:
    """Adds ``or_high``/``or_low``, null when the session has too few opening bars."""
    day = Window.partitionBy("symbol", "session_date")
    early = minute_of_day("ts") < spec.range_end
    enough = F.count(F.when(early, 1)).over(day) >= spec.min_range_bars
    return bars.withColumns({"or_high": F.when(enough, F.max(F.when(early, F.col("high"))).over(day)),
                             "or_low": F.when(enough, F.min(F.when(early, F.col("low"))).over(day))})


def swing_flags(lay: Layout, k: int = 3) -> dict[str, Column]:
    """Centred extremes over k rows each side; rows without k neighbours are none."""
    w = lay.rows(-k, k)
    full = F.count(F.lit(1)).over(w) == 2 * k + 1
    return {"swing_high": full & (F.col("high") == F.max("high").over(w)),
            "swing_low": full & (F.col("low") == F.min("low").over(w))}


def swings_so_far(lay: Layout, k: int = 3) -> Layout:
    """Adds ``swings``: prices of the swings confirmed up to each row of its session."""
    lay = lay.with_columns(**swing_flags(lay, k))
    seen = lay.rows(Window.unboundedPreceding, -k)
    highs = F.collect_list(F.when(F.col("swing_high"), F.col("high"))).over(seen)
    lows = F.collect_list(F.when(F.col("swing_low"), F.col("low"))).over(seen)
    return lay.with_columns(swings=F.concat(highs, lows))


def round_levels(price: Column, step_pct: float = 0.005) -> Column:
    step = F.greatest(F.rint(price * step_pct), F.lit(1.0))
    base = F.rint(price / step) * step
    return F.array(base - step, base, base + step, base + 2 * step, base - 2 * step)


def cluster_levels(levels: Column, tol: float) -> Column:
    """Sorted levels without those within ``tol`` of the last one kept."""
    def keep(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        far = F.abs(x - last) / F.greatest(last, F.lit(1e-9)) > tol
        return F.when((F.size(kept) == 0) | far, F.concat(kept, F.array(x))).otherwise(kept)

    return F.aggregate(F.array_sort(levels), F.array().cast("array<double>"), keep)


def structure_levels(swings: Column, price: Column, extra: list[Column], spec: LevelSpec = LevelSpec()) -> Column:
    """Positive levels around ``price``: swings, known marks (null if unknown), round numbers."""
    pool = F.concat(swings, F.array_compact(F.array(*extra)) if extra else F.array().cast("array<double>"),
                    round_levels(price, spec.round_step))
    return cluster_levels(F.filter(pool, lambda x: x > 0), spec.cluster)


def structure_exit(entry: Column, direction: Column, atr: Column, levels: Column, spec: LevelSpec = LevelSpec()) -> Column:
    """Struct of stop, target, rr and the two method tags.

    The target sits just inside the nearest level ahead, the stop just beyond the nearest
    level behind; without such a level a multiple of ATR or of the risk is used. ``rr``
    is reported before the upper cap on the reward.
    """
    sgn = F.signum(direction.cast("double"))
    a = F.when(atr.isNull() | (atr <= 0), entry * 0.005).otherwise(atr)
    up = sgn > 0

    def nearest(lv: Column) -> Column:
        above = lambda gap: F.array_min(F.filter(lv, lambda x: x > entry + gap * a))
        below = lambda gap: F.array_max(F.filter(lv, lambda x: x < entry - gap * a))
        return F.struct(F.when(up, above(spec.target_buffer_atr)).otherwise(below(spec.target_buffer_atr)).alias("wall"),
                        F.when(up, below(spec.stop_buffer_atr)).otherwise(above(spec.stop_buffer_atr)).alias("floor"))

    def first_stop(n: Column) -> Column:
        stop = F.coalesce(n["floor"] - sgn * spec.stop_buffer_atr * a, entry - sgn * 1.5 * a)
        return F.struct(n["wall"].alias("wall"), n["floor"].alias("floor"), stop.alias("stop"),
                        F.abs(entry - stop).alias("risk"))

    def first_target(n: Column) -> Column:
        target = F.coalesce(n["wall"] - sgn * spec.target_buffer_atr * a, entry + sgn * 2.0 * n["risk"])
        wide = n["risk"] > spec.max_risk * entry
        return F.struct(
            F.when(n["floor"].isNull(), "atr_fallback").otherwise("structure").alias("stop_tag"),
            F.when(n["wall"].isNull(), "rr_fallback").otherwise("structure").alias("target_tag"),
            wide.alias("wide"), F.when(wide, entry - sgn * spec.max_risk * entry).otherwise(n["stop"]).alias("stop"),
            F.when(wide, spec.max_risk * entry).otherwise(n["risk"]).alias("risk"), target.alias("target"),
            F.abs(target - entry).alias("reward"))

    cut = (lambda x, n: F.round(x, n)) if spec.decimals is not None else (lambda x, n: x)

    def bounded(n: Column) -> Column:
        least, most = spec.min_rr * n["risk"], spec.max_rr * n["risk"]
        short = n["reward"] < least
        reward = F.greatest(n["reward"], least)
        far = reward > most
        target = F.when(far, entry + sgn * most).when(short, entry + sgn * least).otherwise(n["target"])
        return F.struct(
            cut(n["stop"], spec.decimals).alias("stop"), cut(target, spec.decimals).alias("target"),
            cut(reward / F.greatest(n["risk"], F.lit(1e-9)), 2).alias("rr"),
            F.concat(n["stop_tag"], F.when(n["wide"], "+capped").otherwise("")).alias("sl_method"),
            F.concat(n["target_tag"], F.when(short, "+minrr").otherwise(""), F.when(far, "+capped").otherwise("")).alias("tgt_method"))

    return bind(levels, lambda lv: bind(nearest(lv), lambda n: bind(first_stop(n), lambda m: bind(first_target(m), bounded))))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, instead of being copied into each use."""
    return F.transform(F.array(value), body)[0]


def order_blocks(bars: DataFrame, spec: SessionSpec, period: int = 20, lookback: int = 10, mode: str = "auto") -> DataFrame:
    """Candles before a strong move: bearish before a rise (BULL), bullish before a fall (BEAR).

    ``bars`` are the wide bars (15 minutes on the exchange clock) of whole histories.
    """
    lay = lay_out(bars, ["symbol"], ["ts"], back=max(lookback, warm_up(1 / period) + 1), ahead=4, mode=mode)
    nxt, prior = lay.rows(1, 3), lay.rows(-lookback, -1)
    lay = lay.with_columns(
        _pos=lay.position(), _n3=F.lead("close", 3).over(lay.window()), _n4=F.lead("close", 4).over(lay.window()),
        _mc=F.max("close").over(nxt), _nc=F.min("close").over(nxt), _mh=F.max("high").over(nxt), _nl=F.min("low").over(nxt),
        _ph=F.max("high").over(prior), _pl=F.min("low").over(prior))
    df = recursive_columns(lay, {"_atr": f"atr_zero:{period}"}).finish()
    o, c, atr = F.col("open"), F.col("close"), F.col("_atr")
    # a series needs period + 5 rows in all
    usable = ((F.col("_pos") > period) & F.col("_n3").isNotNull() & (F.col("_n4").isNotNull() | (F.col("_pos") > period + 1))
              & (atr > 0) & minute_of_day("ts").between(*spec.zone_formation))
    kind = (F.when((F.col("_mc") - c > atr) & (F.col("_mh") > F.col("_ph")) & (c < o), "BULL")
            .when((c - F.col("_nc") > atr) & (F.col("_nl") < F.col("_pl")) & (c > o), "BEAR"))
    return (df.filter(usable).withColumn("ob_type", kind).filter("ob_type is not null")
            .select("symbol", "session_date", "ob_type", F.date_format("ts", "HH:mm").alias("ob_time"),
                    F.greatest(o, c).alias("ob_body_high"), F.least(o, c).alias("ob_body_low"),
                    F.col("high").alias("ob_high"), F.col("low").alias("ob_low")))


def previous_day(daily: DataFrame) -> DataFrame:
    """Adds ``prev_close`` and, when ``daily_atr`` is present, ``prev_atr`` of the session before."""
    w = Window.partitionBy("symbol").orderBy("session_date")
    out = daily.withColumn("prev_close", F.lag("close").over(w))
    return out.withColumn("prev_atr", F.lag("daily_atr").over(w)) if "daily_atr" in daily.columns else out


def gap_days(bars: DataFrame, pct: tuple[float, float] = (1.0, 3.0), period: int = 14) -> DataFrame:
    """Sessions that open away from the previous close by a percentage within ``pct``.

    Works on daily rows: a symbol has one per session, far below what a task can hold.
    """
    daily = daily_bars(bars, ["symbol"])
    lay = recursive_columns(Layout(daily.withColumn("ts", F.col("session_date")), ["symbol"], ["session_date"]),
                            {"daily_atr": f"atr_zero:{period}"})
    df = previous_day(lay.df)
    gap = F.abs(F.col("open") - F.col("prev_close")) / F.col("prev_close") * 100
    return (df.filter("prev_close > 0 and prev_atr > 0 and open > 0").withColumn("gap_pct", gap)
            .filter(F.col("gap_pct").between(*pct))
            .select("symbol", "session_date", "prev_close", F.col("open").alias("today_open"), "gap_pct",
                    F.when(F.col("open") > F.col("prev_close"), "UP").otherwise("DOWN").alias("gap_dir"),
                    F.col("prev_atr").alias("daily_atr")))
