"""Recursive indicators: exponential and Wilder smoothing, and what is built on them.

y(t) = (1 - a) * y(t-1) + a * x(t) has no bounded frame, so these run as one Arrow pass per
task that computes every requested column, with the smoothing itself left to
pandas' compiled ``ewm``. In the split layout a lane starts from copies of the rows before
it. The weight of anything older than h rows is (1 - a)**h; ``warm_up`` picks h so that this
weight is below 2**-60, under the last bit of a double, hence lanes and whole series agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barloom.operators.layout import BASE, TOTAL, Layout, lay_out, pick_mode
from barloom.operators.rolling import cmf, cumulative_vwap, previous, rsi_sma, session_vwap, sma, true_range

TINY = 1e-9


def warm_up(*stages: float) -> int:
    """Rows after which the start of chained smoothings no longer shows, by their weights."""
    return sum(math.ceil(60 * math.log(2) / -math.log1p(-a)) for a in stages)


WARM_ROWS = warm_up(1 / 14, 1 / 14) + 2


def smooth(x: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential smoothing seeded with the first value."""
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def ema(x: np.ndarray, span: int) -> np.ndarray:
    return smooth(x, 2.0 / (span + 1))


def seeded(x: np.ndarray, start: int, p: int, first: bool) -> np.ndarray:
    """Wilder smoothing whose seed, at index start+p-1, is the mean of x[start:start+p].

    ``first`` says that the array begins where its series begins; otherwise any seed will do,
    because the copied rows in front let it fade out.
    """
    out = np.full(len(x), np.nan)
    at = start + p - 1
    if not first:
        return smooth(x, 1.0 / p)
    if len(x) <= at:
        return out
    out[at:] = smooth(np.concatenate([[x[start:start + p].mean()], x[at + 1:]]), 1.0 / p)
    return out


def _ranges(h: np.ndarray, l: np.ndarray, c: np.ndarray) -> np.ndarray:
    pc = np.concatenate([[c[0]], c[:-1]])
    return np.maximum(h - l, np.maximum(np.abs(h - pc), np.abs(l - pc)))


def wilder_atr(h, l, c, p: int, first: bool) -> np.ndarray:
    return seeded(_ranges(h, l, c), 0, p, first)


def wilder_rsi(c, p: int, first: bool) -> np.ndarray:
    """Strength index with a tiny floor under the mean loss; undefined rows are left null."""
    move = np.diff(c, prepend=c[0])
    up = seeded(np.maximum(move, 0.0), 1, p, first)
    down = seeded(np.maximum(-move, 0.0), 1, p, first)
    return 100.0 - 100.0 / (1.0 + up / np.where(down == 0, TINY, down))


def directional(h, l, c, p: int, first: bool) -> np.ndarray:
    """Average directional index: the smoothed gap between up-moves and down-moves."""
    up, down = np.diff(h, prepend=h[0]), -np.diff(l, prepend=l[0])
    plus = np.where(up > down, np.maximum(up, 0.0), 0.0)
    minus = np.where(down > up, np.maximum(down, 0.0), 0.0)
    tr, plus, minus = (seeded(x, 0, p, first) for x in (_ranges(h, l, c), plus, minus))
    base = np.where(tr > 0, tr, TINY)
    dip, dim = 100.0 * plus / base, 100.0 * minus / base
    gap = 100.0 * np.abs(dip - dim) / np.where(dip + dim > 0, dip + dim, TINY)
    if first:
        return seeded(np.where(np.isnan(gap), 0.0, gap), p, p, True)
    return seeded(gap, 0, p, False)


# arrays are the ordered rows of one partition; base counts the series' rows before them, total all of its rows
def _compute(name: str, g: dict[str, np.ndarray], base: int, total: int | None = None) -> np.ndarray:
    h, l, c, v = (g[k] for k in ("high", "low", "close", "volume"))
    first, n = base == 0, len(c)
    total = base + n if total is None else total
    pos = base + np.arange(1, n + 1)
    kind, _, arg = name.partition(":")
    p = int(arg or 0)
    if kind == "ema":  # scanner form: null before p rows
        return np.where(pos >= p, ema(c, p), np.nan)
    if kind == "ema_all":
        return ema(c, p)
    if kind == "volume_ema":
        return ema(v, p)
    if kind == "atr":  # needs p + 1 rows
        return np.where(pos >= p + 1, wilder_atr(h, l, c, p, first), np.nan)
    if kind == "atr_zero":  # zero before the seed
        return np.nan_to_num(np.where(pos >= p, wilder_atr(h, l, c, p, first), 0.0))
    if kind == "atr_ewm":  # smoothing of known ranges, null before p of them
        tr = _ranges(h, l, c)
        return np.where(pos >= p, smooth(tr, 1.0 / p), np.nan)
    if kind == "rsi":  # 50 for a series of at most p rows, zero rows read as no gains
        out = np.where(pos > p, wilder_rsi(c, p, first), 0.0)
        return np.full(n, 50.0) if total <= p else out
    if kind == "adx":
        return np.where(pos >= 2 * p, directional(h, l, c, p, first), np.nan)
    if kind == "adx_feature":  # 20 for a short series, zero before the seed
        if total < 2 * p:
            return np.full(n, 20.0)
        return np.nan_to_num(np.where(pos >= 2 * p, directional(h, l, c, p, first), 0.0))
    if kind == "macd_hist":
        macd = ema(c, 12) - ema(c, 26)
        return np.where(pos >= 35, macd - ema(macd, 9), np.nan)
    if kind == "ewma_vol":
        hl = np.log(np.maximum(h / l, TINY))
        return ema(np.sqrt(hl * hl / (4.0 * math.log(2.0))), p)
    raise ValueError(name)


def series_starts(columns: list[pa.ChunkedArray | pa.Array], n: int) -> np.ndarray:
    """Rows at which the key changes, the first row included; nulls are equal to one another."""
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def recursive_columns(lay: Layout, wanted: dict[str, str]) -> Layout:
    """Adds columns ``{output name: kind[:period]}`` in one Arrow pass over rows sorted by series.

    A batch holds many short series, or a part of a long one, which waits for its end. Only the four price columns become arrays,
    every other column passes through untouched.
    """
    names, keys, split = list(wanted), lay.partition, lay.split
    schema = StructType([*lay.df.schema.fields, *[StructField(n, DoubleType()) for n in names]])

    def computed(batches: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(batches).combine_chunks()
        g = {k: table[k].to_numpy().astype(float) for k in ("high", "low", "close", "volume")}
        starts = series_starts([table[k] for k in keys], table.num_rows)
        ends = [*starts[1:].tolist(), table.num_rows]
        bases, totals = (table[c].take(pa.array(starts)).to_pylist() if split else [d] * len(starts) for c, d in ((BASE, 0), (TOTAL, None)))
        out = {n: np.empty(table.num_rows) for n in names}
        for lo, hi, base, total in zip(starts.tolist(), ends, bases, totals, strict=True):
            own = {k: x[lo:hi] for k, x in g.items()}
            for n, kind in wanted.items():
                out[n][lo:hi] = _compute(kind, own, base, total)
        for n, values in out.items():
            table = table.append_column(n, pa.array(values, pa.float64(), mask=np.isnan(values)))
        return table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            at = [b.column(k) for k in keys]
            first, end = (tuple(c[i].as_py() for c in at) for i in (0, b.num_rows - 1))
            cut = int(series_starts(at, b.num_rows)[-1])
            if cut or (open_ and first != last):
                if whole := [*open_, *([b.slice(0, cut)] if cut else [])]:
                    yield from computed(whole).to_batches(max_chunksize=10_000)
                open_ = []
            open_.append(b.slice(cut))
            last = end
        if open_:
            yield from computed(open_).to_batches(max_chunksize=10_000)

    together = lay.df.repartition(*keys) if keys else lay.df.repartition(1)
    out = together.sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in lay.order]).mapInArrow(run, schema)
    return Layout(out, lay.keys, lay.order, lay.split, lay.edges)


def recursive(bars: DataFrame, keys: list[str], wanted: dict[str, str], mode: str = "auto", **lane_args) -> DataFrame:
    lay = recursive_columns(lay_out(bars, keys, ["ts"], back=WARM_ROWS, mode=mode, **lane_args), wanted)
    return lay.finish()


def supertrend_dir() -> Column:
    """Outside the band the band decides, inside it the close against its EMA; zero is unknown.

    Reads ``band_atr`` and ``ema20``.
    """
    mid, band, c = (F.col("high") + F.col("low")) / 2.0, F.lit(3.0) * F.col("band_atr"), F.col("close")
    return (F.when(F.col("band_atr").isNull(), 0).when(c > mid + band, 1).when(c < mid - band, -1)
            .when(F.col("ema20").isNull(), 0).when(c >= F.col("ema20"), 1).otherwise(-1))


def confluence_inputs(lay: Layout, more: dict[str, str] | None = None) -> Layout:
    """Adds rsi, cmf, macd_hist, ema20 and supertrend, plus other recursive columns.

    Window columns come first: the grouped pass reuses their shuffle, the other way round
    the windows would need one of their own.
    """
    lay = rsi_sma(lay, 14)
    lay = lay.with_columns(cmf=cmf(lay, 20), _tr=true_range(lay), rows_so_far=lay.position())
    lay = lay.with_columns(band_atr=F.when(F.col("rows_so_far") >= 11, sma(lay, "_tr", 10)))
    lay = recursive_columns(lay, {"ema20": "ema:20", "macd_hist": "macd_hist", **(more or {})})
    df = lay.df.withColumn("supertrend", supertrend_dir()).drop("_tr", "band_atr")
    return Layout(df, lay.keys, lay.order, lay.split, lay.edges)


def indicator_snapshot(bars: DataFrame, keys: list[str], mode: str = "auto") -> DataFrame:
    """Indicators of the last bar of every series that has at least five bars."""
    lay = confluence_inputs(lay_out(bars, keys, ["ts"], back=WARM_ROWS, mode=mode))
    cols = ["rsi", "cmf", "macd_hist", "supertrend", "ema20", "rows_so_far"]
    last = lay.finish().groupBy(*keys).agg(F.max_by(F.struct("ts", *cols), "ts").alias("s"))
    return last.select(*keys, *[F.col(f"s.{c}").alias(c) for c in ["ts", *cols]]).filter("rows_so_far >= 5").drop("rows_so_far")


def index_trend(index: DataFrame, mode: str = "auto") -> DataFrame:
    """(ts, trend): +1 above both session VWAP and EMA20, -1 below both, else 0.

    The VWAP restarts every session while the EMA runs on across sessions.
    """
    priced = recursive(session_vwap(index, []), [], {"ema20": "ema_all:20"}, mode=mode)
    c = F.col("close")
    trend = (F.when((c > F.col("vwap")) & (c > F.col("ema20")), 1)
             .when((c < F.col("vwap")) & (c < F.col("ema20")), -1).otherwise(0))
    return priced.select("ts", "session_date", trend.alias("trend"))


# fixed values: order of the feature vector
BASE_FEATURES = ["atr_frac", "rsi", "vwap_dist", "ema_dist", "adx", "vol_ratio", "ret1", "ret3", "range_pct", "gap_pct",
                 "tod", "body_frac"]


def time_of_day(ts: Column) -> Column:
    """Hour with fraction; ``ts`` is already on the session clock."""
    return F.hour(ts) + F.minute(ts) / 60.0


def synthetic_time_of_day(position: Column) -> Column:
    """Clock slot for series without timestamps, from the 0-based row position."""
    return 9.25 + ((position % 75) * 5) / 60.0


def feature_frame(bars: DataFrame, keys: list[str], mode: str = "auto") -> DataFrame:
    """The twelve model features of every bar, with ``atr`` and ``close``."""
    mode = pick_mode(bars, keys) if mode == "auto" else mode
    priced = cumulative_vwap(bars, keys, mode)
    lay = lay_out(priced, keys, ["ts"], back=WARM_ROWS, mode=mode)
    c, o, h, l = (F.col(x) for x in ("close", "open", "high", "low"))
    vol = F.col("volume").cast("double")
    mean = sma(lay, vol, 20)
    safe = F.when(c > 0, c).otherwise(F.lit(TINY))
    p1, p3 = previous(lay, "close"), previous(lay, "close", 3)
    lay = lay.with_columns(vol_ratio=vol / F.when(mean > 0, mean), ret1=c / p1 - 1.0, ret3=c / p3 - 1.0,
                           gap_pct=(o - F.coalesce(p1, c)) / safe, _n=lay.position())
    lay = recursive_columns(lay, {"atr": "atr_zero:14", "rsi": "rsi:14", "_ema": "ema_all:20", "adx": "adx_feature:14"})
    df = lay.finish().withColumns({
        "atr_frac": F.col("atr") / safe, "vwap_dist": (c - F.col("cum_vwap")) / safe,
        "ema_dist": (c - F.col("_ema")) / safe, "range_pct": (h - l) / safe, "tod": time_of_day(F.col("ts")),
        "body_frac": F.abs(c - o) / F.when(h - l > 0, h - l).otherwise(F.lit(TINY))})
    return df.select(*keys, "ts", "session_date", *BASE_FEATURES, "atr", "close", F.col("_n").alias("position"))


def latest_features(frame: DataFrame, keys: list[str], at_least: int = 20) -> DataFrame:
    """Last row per series with at least ``at_least`` rows, missing or infinite values as zero."""
    last = frame.groupBy(*keys).agg(F.max_by(F.struct("position", "ts", *BASE_FEATURES), "ts").alias("s"))
    last = last.select(*keys, *[F.col(f"s.{c}").alias(c) for c in ["position", "ts", *BASE_FEATURES]])
    finite = lambda n: F.when(F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 0.0).otherwise(F.col(n))
    return last.filter(F.col("position") >= at_least).select(*keys, "ts", *[finite(n).alias(n) for n in BASE_FEATURES])
