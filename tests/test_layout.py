"""The split layout must give the rows of the keyed one, whatever the skew."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import recursive as REC, rolling as R
from barloom.operators.layout import lay_out, running


@pytest.fixture(scope="module")
def skewed(spark):
    """6,000 bars: one hot symbol holds nearly all rows, 40 symbols hold a few each."""
    i = F.col("id")
    key = F.when(i % 10 < 8, "HOT").otherwise(F.concat(F.lit("S"), (i % 40).cast("string")))
    close = 100 + 10 * F.sin(i / 37.0) + (F.pmod(F.xxhash64("id"), F.lit(1000)) / 250.0)
    df = spark.range(6000).select(key.alias("symbol"), (F.lit("2024-01-01").cast("timestamp_ntz")
                                  + F.make_interval(mins=i.cast("int"))).alias("ts"), close.alias("close"))
    return df.withColumns({"open": F.col("close") - 0.3, "high": F.col("close") + 1 + F.pmod(F.xxhash64("ts"), F.lit(7)) / 9,
                           "low": F.col("close") - 1, "volume": F.pmod(F.xxhash64("ts"), F.lit(50)),
                           "session_date": F.to_date("ts")}).cache()


def frame(df, cols):
    return df.select("symbol", "ts", *cols).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


def same(a, b, cols):
    assert len(a) == len(b)
    for c in cols:
        pd.testing.assert_series_equal(a[c], b[c], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("lanes", [3, 16, 400])
def test_bounded_frames(skewed, lanes):
    def run(mode, **kw):
        lay = lay_out(skewed, ["symbol"], ["ts"], back=20, ahead=2, mode=mode, **kw)
        lay = lay.with_columns(m=R.sma(lay, "close", 20), p3=R.previous(lay, "close", 3),
                               nxt=F.lead("close", 2).over(lay.window()), pos=lay.position(), v=R.volume_ratio(lay))
        return frame(lay.finish(), ["m", "p3", "nxt", "pos", "v"])

    same(run("keyed"), run("split", lanes=lanes), ["m", "p3", "nxt", "pos", "v"])


def test_recursions_in_lanes(skewed):
    kinds = {"e": "ema:26", "a": "atr:14", "z": "atr_zero:14", "x": "adx:14", "r": "rsi:14", "m": "macd_hist", "w": "atr_ewm:14",
             "f": "adx_feature:14"}
    a = frame(REC.recursive(skewed, ["symbol"], kinds, "keyed"), kinds)
    for lanes in (3, 40):
        same(a, frame(REC.recursive(skewed, ["symbol"], kinds, "split", lanes=lanes), kinds), kinds)


def test_first_rows_of_a_series_in_a_lane_of_their_own(spark):
    """A cut shortly after the start must not make the series look short."""
    df = spark.range(300).select(F.when(F.col("id") < 255, "A").otherwise("B").alias("symbol"), (F.lit("2024-01-01").cast("timestamp_ntz")
                                 + F.make_interval(mins=F.col("id").cast("int"))).alias("ts"), (100 + F.sin("id")).alias("close"))
    df = df.withColumns({"high": F.col("close") + 1, "low": F.col("close") - 1, "volume": F.lit(1)})
    kinds = {"x": "adx_feature:14", "r": "rsi:14"}
    a = frame(REC.recursive(df, ["symbol"], kinds, "keyed"), kinds)
    for lanes in (7, 25, 60):
        same(a, frame(REC.recursive(df, ["symbol"], kinds, "split", lanes=lanes), kinds), kinds)


def test_running_totals_in_lanes(skewed):
    def run(mode, **kw):
        lay = lay_out(skewed, ["symbol"], ["ts"], mode=mode, **kw)
        lay = running(lay, sums={"s": F.col("volume")}, maxes={"m": F.col("close")})
        return frame(lay.finish(), ["s", "m"])

    same(run("keyed"), run("split", lanes=16), ["s", "m"])


def test_global_series(skewed):
    def run(mode, **kw):
        lay = lay_out(skewed, [], ["ts"], back=3, mode=mode, **kw)
        lay = lay.with_columns(p=F.lag("close").over(lay.window()), pos=lay.position())
        return frame(lay.finish(), ["p", "pos"])

    same(run("keyed"), run("split", lanes=7), ["p", "pos"])


def test_auto_splits_only_heavy_series(skewed):
    assert lay_out(skewed, ["symbol"], ["ts"], heavy_rows=100).split
    assert not lay_out(skewed, ["symbol"], ["ts"]).split


def test_warm_up_weight():
    for p in (9, 14, 26):
        rows = REC.warm_up(1 / p)
        assert math.pow(1 - 1 / p, rows) <= 2 ** -60


def test_feature_frame_modes_agree(skewed):
    cols = REC.BASE_FEATURES
    a = frame(REC.feature_frame(skewed, ["symbol"], "keyed"), cols)
    b = frame(REC.feature_frame(skewed, ["symbol"], "split"), cols)
    for c in cols:
        pd.testing.assert_series_equal(a[c], b[c], rtol=1e-9, atol=1e-9)


def test_recursive_pass_takes_many_series_at_once(spark):
    """Short series share a batch, a long one spans several; null keys are a series; a batch that ends with its series is complete."""
    rng = np.random.default_rng(3)
    rows = []
    for k, n in [(None, 25), *[(f"S{i}", 1 + i % 40) for i in range(120)], ("long", 900)]:
        close = 100 + rng.normal(0, 1, n).cumsum()
        rows += [(k, t, float(c + 1), float(c - 1), float(c), float(t + 1)) for t, c in enumerate(close)]
    bars = pd.DataFrame(rows, columns=["symbol", "ts", "high", "low", "close", "volume"])
    df = spark.createDataFrame(bars.sample(frac=1, random_state=1), "symbol string, ts long, high double, low double, close double, volume double")
    wanted = {"e": "ema:5", "a": "atr_zero:14", "r": "rsi:14", "x": "adx_feature:14"}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        found = REC.recursive(df, ["symbol"], wanted)
        assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()  # one call per series before
        got = found.toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(bars)
    for key, g in bars.groupby("symbol", dropna=False):
        own = got[got["symbol"].isna() if pd.isna(key) else got["symbol"] == key].sort_values("ts")
        arrays = {c: g[c].to_numpy() for c in ("high", "low", "close", "volume")}
        for name, kind in wanted.items():
            np.testing.assert_array_equal(own[name].to_numpy(float), REC._compute(kind, arrays, 0))
