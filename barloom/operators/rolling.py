"""Window indicators that need only a bounded frame, as column expressions over a layout.

A frame of n rows gives null until n values are present, as a rolling mean does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.operators.layout import Layout, lay_out, running


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sma(lay: Layout, x: str | Column, n: int) -> Column:
    w = lay.rows(-(n - 1), 0)
    return F.when(F.count(_c(x)).over(w) >= n, F.avg(_c(x)).over(w))


def rolling_std(lay: Layout, x: str | Column, n: int) -> Column:
    w = lay.rows(-(n - 1), 0)
    return F.when(F.count(_c(x)).over(w) >= n, F.stddev_samp(_c(x)).over(w))


def rolling_sum(lay: Layout, x: str | Column, n: int) -> Column:
    w = lay.rows(-(n - 1), 0)
    return F.when(F.count(_c(x)).over(w) >= n, F.sum(_c(x)).over(w))


def previous(lay: Layout, x: str | Column, n: int = 1) -> Column:
    return F.lag(_c(x), n).over(lay.window())


def true_range(lay: Layout, first_row: str = "close") -> Column:
    """``first_row='close'`` takes the row's own close as the missing one, ``'skip'`` ignores it."""
    prev = previous(lay, "close")
    prev = F.coalesce(prev, F.col("close")) if first_row == "close" else prev
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def average_volume_before(lay: Layout, n: int = 20, at_least: int = 5) -> Column:
    """Mean volume of up to n earlier rows, zero when fewer than ``at_least`` exist."""
    w = lay.rows(-n, -1)
    return F.when(F.count("volume").over(w) >= at_least, F.avg("volume").over(w)).otherwise(F.lit(0.0))


def volume_ratio(lay: Layout, n: int = 20) -> Column:
    """Current volume over the mean of up to n previous rows (null without a usable mean)."""
    base = average_volume_before(lay, n)
    return F.when(base > 0, F.col("volume") / base)


def volume_ratio_rolling(lay: Layout, n: int = 20) -> Column:
    """Current volume over the n-row mean that includes it."""
    base = sma(lay, F.col("volume").cast("double"), n)
    return F.when(base > 0, F.col("volume") / base)


def ma_cross(lay: Layout, fast: int, slow: int) -> Layout:
    """Adds ``fast_ma``, ``slow_ma`` and the entry/exit flags of their crossing."""
    lay = lay.with_columns(fast_ma=sma(lay, "close", fast), slow_ma=sma(lay, "close", slow))
    pf, ps = previous(lay, "fast_ma"), previous(lay, "slow_ma")
    return lay.with_columns(
        cross_up=F.coalesce((F.col("fast_ma") > F.col("slow_ma")) & (pf <= ps), F.lit(False)),
        cross_down=F.coalesce((F.col("fast_ma") < F.col("slow_ma")) & (pf >= ps), F.lit(False)))


def atr_sma(lay: Layout, n: int) -> Layout:
    """Adds ``tr`` and its simple rolling mean ``atr_sma``."""
    lay = lay.with_columns(tr=true_range(lay))
    return lay.with_columns(atr_sma=sma(lay, "tr", n))


def rsi_sma(lay: Layout, n: int = 14) -> Layout:
    """Adds ``rsi`` from rolling mean gains and losses; no losses in the frame gives null."""
    d = F.col("close") - previous(lay, "close")
    lay = lay.with_columns(_up=F.greatest(d, F.lit(0.0)), _dn=F.greatest(-d, F.lit(0.0)))
    # greatest skips nulls, so the first row is masked again
    known = previous(lay, "close").isNotNull()
    lay = lay.with_columns(_up=F.when(known, F.col("_up")), _dn=F.when(known, F.col("_dn")))
    lay = lay.with_columns(_au=sma(lay, "_up", n), _ad=sma(lay, "_dn", n))
    rsi = F.when(F.col("_ad") > 0, 100.0 - 100.0 / (1.0 + F.col("_au") / F.nullif(F.col("_ad"), F.lit(0.0))))
    lay = lay.with_columns(rsi=rsi)
    return Layout(lay.df.drop("_up", "_dn", "_au", "_ad"), lay.keys, lay.order, lay.split, lay.edges)


def cmf(lay: Layout, n: int = 20) -> Column:
    """Money-flow ratio over n rows; a row without range makes the frame null."""
    span = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    flow = ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / span * F.col("volume")
    w = lay.rows(-(n - 1), 0)
    vol = F.sum("volume").over(w).cast("double")
    return F.when((F.count(flow).over(w) >= n) & (vol > 0), F.sum(flow).over(w) / F.nullif(vol, F.lit(0.0)))


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3.0


def session_vwap(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Running volume-weighted typical price of each session.

    A session without any volume falls back to the running mean of the typical price. One
    session has at most one row per bar interval, so its window partition stays small.
    """
    day = Window.partitionBy(*keys, "session_date")
    upto = day.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    v = F.greatest(F.col("volume"), F.lit(0)).cast("double")
    weighted = F.sum(typical_price() * v).over(upto) / F.nullif(F.sum(v).over(upto), F.lit(0.0))
    return bars.withColumn("vwap", F.when(F.sum(v).over(day) > 0, weighted).otherwise(F.avg(typical_price()).over(upto)))


def session_vwap_strict(bars: DataFrame, keys: list[str]) -> DataFrame:
    """The scanner's form: null before the third bar or without volume so far."""
    day = Window.partitionBy(*keys, "session_date")
    upto = day.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    vol = F.sum(F.col("volume").cast("double")).over(upto)
    value = F.sum(typical_price() * F.col("volume")).over(upto) / F.greatest(vol, F.lit(1.0))
    return bars.withColumn("vwap", F.when((F.row_number().over(day.orderBy("ts")) >= 3) & (vol > 0), value))


def cumulative_vwap(bars: DataFrame, keys: list[str], mode: str = "auto") -> DataFrame:
    """Volume-weighted typical price since the start of the series, never reset."""
    lay = lay_out(bars, keys, ["ts"], mode=mode)
    lay = running(lay, sums={"cum_volume": F.col("volume").cast("double"),
                             "cum_value": typical_price() * F.col("volume").cast("double")})
    floor = F.when(F.col("cum_volume") == 0, F.lit(1e-9)).otherwise(F.col("cum_volume"))
    return lay.finish(lay.df.withColumn("cum_vwap", F.col("cum_value") / floor)).drop("cum_volume", "cum_value")


def returns(lay: Layout) -> dict[str, Column]:
    """Return columns by name; the log forms are those of the volatility data set."""
    c = F.col("close")
    p1, p2, p3 = (previous(lay, "close", k) for k in (1, 2, 3))
    return {"ret1": c / p1 - 1.0, "ret3": c / p3 - 1.0, "log_ret1": F.log(c / p1), "log_ret2": F.log(c / p2),
            "gap_pct": (F.col("open") - p1) / p1, "next_close": F.lead("close").over(lay.window())}


def realized_vol(lay: Layout, n: int) -> Column:
    """Needs the column ``log_ret1``."""
    return rolling_std(lay, "log_ret1", n)


def volume_zscore(lay: Layout, n: int = 20) -> Column:
    v = F.col("volume").cast("double")
    spread = F.nullif(rolling_std(lay, v, n), F.lit(0.0))
    return F.coalesce((v - sma(lay, v, n)) / spread, F.lit(0.0))


def parkinson() -> Column:
    ratio = F.greatest(F.col("high") / F.col("low"), F.lit(1e-9))
    return F.sqrt(F.pow(F.log(ratio), 2) / F.lit(4.0 * math.log(2.0)))
