"""Hand-worked values and boundary cases of the small rules."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import trading as T
from barloom.operators import clean as C, exits as E, gates as G, levels as L, recursive as REC
from barloom.spec import AROUND_THE_CLOCK, ExitSpec, SessionSpec
from barloom.sources import bars as B, dimensions as D

DAY = dt.date(2024, 1, 2)


def at(h, m=0, s=0, day=DAY):
    return dt.datetime.combine(day, dt.time(h, m, s))


def bars(spark, rows, symbol="A"):
    """rows of (ts, open, high, low, close, volume)"""
    return spark.createDataFrame([(symbol, r[0], r[0].date(), *map(float, r[1:5]), int(r[5])) for r in rows],
                                 "symbol string, ts timestamp_ntz, session_date date, open double, high double, low double, close double, volume long")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# ---- recursions -----------------------------------------------------------------------------
def test_wilder_seed_and_steps():
    got = REC.seeded(np.array([1.0, 2, 3, 4, 10]), 0, 3, True)
    assert np.isnan(got[:2]).all()
    # the mean of the first three, which then keeps two thirds of its weight per step
    np.testing.assert_allclose(got[2:], [2, 2 * 2 / 3 + 4 / 3, 2 * 4 / 9 + 4 * 2 / 9 + 10 / 3])


@pytest.mark.parametrize("n", [13, 14, 15, 27, 28, 29])
def test_lengths_around_the_seed(n):
    rng = np.random.default_rng(n)
    c = 100 + rng.normal(size=n).cumsum()
    g = {"high": c + 1, "low": c - 1, "close": c, "volume": np.ones(n)}
    atr = REC._compute("atr:14", g, 0)
    assert np.isnan(atr).sum() == min(n, 14)
    assert (~np.isnan(REC._compute("adx:14", g, 0))).sum() == max(0, n - 27)
    assert (REC._compute("adx_feature:14", g, 0) == 20).all() == (n < 28)
    assert (REC._compute("rsi:14", g, 0) == 50).all() == (n <= 14)


def test_constant_prices_do_not_divide_by_zero():
    c = np.full(40, 100.0)
    g = {"high": c, "low": c, "close": c, "volume": np.ones(40)}
    assert REC._compute("adx:14", g, 0)[-1] == 0
    assert REC._compute("rsi:14", g, 0)[-1] == 0


def test_ema_first_value_and_null_rule():
    g = {"high": np.ones(3), "low": np.ones(3), "close": np.array([1.0, 2, 4]), "volume": np.ones(3)}
    np.testing.assert_allclose(REC._compute("ema_all:3", g, 0), [1, 1.5, 2.75])
    assert np.isnan(REC._compute("ema:3", g, 0)[:2]).all()


# ---- clocks -----------------------------------------------------------------------------------
def test_session_edges(spark):
    ts = [at(9, 14), at(9, 15), at(15, 30), at(15, 31), at(15, 30, 1)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    kept = [r["ts"] for r in df.filter(C.in_market_hours("ts", SessionSpec())).collect()]
    assert kept == [at(9, 15), at(15, 30)]


def test_entry_windows(spark):
    df = spark.createDataFrame([(at(9, 30),), (at(11),), (at(14, 30),), (at(14, 31),)], "ts timestamp_ntz")
    s = SessionSpec()
    got = df.select(C.in_entry_window("ts", s).alias("a"), C.within("ts", s.breakout_entry).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(True, True), (True, False), (True, False), (False, False)]


def test_last_duplicate_wins_and_null_volume(spark):
    raw = spark.createDataFrame([("A", 1, at(4), 1.0, 1.0, 1.0, 1.0, 5), ("A", 2, at(4), 1.0, 1.0, 1.0, 2.0, None)],
                                "symbol string, id int, ts timestamp_ntz, open double, high double, low double, close double, volume int")
    out = C.standardize_bars(raw, SessionSpec(), ["symbol"], ["id"]).collect()
    assert [(r["ts"], r["close"], r["volume"]) for r in out] == [(at(9, 30), 2.0, 0)]


def test_opening_range_needs_three_bars(spark):
    five = [(at(9, 15 + 5 * i), 10, 11 + i, 9 - i, 10, 1) for i in range(3)]
    full = L.opening_range(bars(spark, five), SessionSpec()).first()
    assert (full["or_high"], full["or_low"]) == (13, 7)
    assert L.opening_range(bars(spark, five[:1] + five[2:]), SessionSpec()).first()["or_high"] is None


# ---- files --------------------------------------------------------------------------------------
def test_bar_files(spark, tmp_path):
    (tmp_path / "abc.csv").write_text("ts,open,high,low,close,volume\n2024-01-02 09:15:00+0530,1,2,0.5,1.5,10\n"
                                      "2024-01-02 03:50:00Z,1,2,0.5,1.6,10\n2024-01-02 09:25:00,1,2,0.5,1.7,10\n"
                                      "2024-01-02 09:30:00,1,2,0.5,1.8,0\nnonsense,1,2,0.5,1.9,10\n2024-01-02 09:35:00,1,2,0.5,2.0,3\n")
    (tmp_path / "nifty.csv").write_text("ts,open,high,low,close,volume\n2024-01-02 09:15:00,1,2,0.5,1.5,10\n")
    got = B.read_bars(spark, str(tmp_path), skip=("Nifty",)).orderBy("ts").collect()
    assert [(r["symbol"], r["ts"], r["close"]) for r in got] == [
        ("ABC", at(9, 15), 1.5), ("ABC", at(9, 20), 1.6), ("ABC", at(9, 25), 1.7), ("ABC", at(9, 35), 2.0)]


def test_loose_headers(spark, tmp_path):
    rows = "\n".join(f"2024-01-{d:02d},1,2,0.5,1.5" for d in range(1, 29))
    (tmp_path / "x.csv").write_text("Date,Open,HIGH,Low,Close\n" + rows + "\nbad,1,2,0.5,1\n")
    df = B.read_bars_any(spark, str(tmp_path), min_rows=20)
    assert df.count() == 28 and df.first()["volume"] == 0.0


def test_ledger_document(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"trades": [{"strategy": "ORB", "pnl": 5.5, "hour": 10}, {"strategy": "GAPFILL", "pnl": -1}], "_meta": {}}')
    got = D.read_ledger(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["seq"], r["strategy"], r["pnl"], r["hour"]) for r in got] == [(0, "ORB", 5.5, 10), (1, "GAPFILL", -1.0, None)]


# ---- money ----------------------------------------------------------------------------------------
def test_costs(spark):
    one = lambda side: value(spark, T.net_pnl(F.lit(100.0), F.lit(101.0), F.lit(10), F.lit(side)))
    assert one("BUY") == pytest.approx((101 * 0.9997 - 100 * 1.0003) * 10 - 201 * 10 * 0.0006)
    assert one("SELL") == pytest.approx((100 * 0.9997 - 101 * 1.0003) * 10 - 201 * 10 * 0.0006)


def test_stop_is_clamped_and_missing_atr_falls_back(spark):
    spec = ExitSpec()
    d = lambda atr: value(spark, T.stop_distance(F.lit(1000.0), atr, spec))
    assert d(F.lit(0.1)) == 3.0 and d(F.lit(100.0)) == 15.0 and d(F.lit(None).cast("double")) == 5.0 and d(F.lit(4.0)) == 6.0


def test_quantity_limits(spark):
    q = lambda e, d, w=None: value(spark, T.position_size(F.lit(e), F.lit(d), ExitSpec(), None if w is None else F.lit(w)))
    assert q(100.0, 1.0) == 250 and q(10.0, 1.0) == 500 and q(10.0, 1.0, 9.0) == 750 and q(10.0, 1.0, 0.0) == 200 and q(10.0, 0.0) == 0


def exits_of(spark, path, side="BUY", sl=99.0, tgt=102.0, **kw):
    b = bars(spark, path)
    c = spark.createDataFrame([("A", DAY, side, path[0][0], float(sl), float(tgt))],
                              "symbol string, session_date date, side string, entry_ts timestamp_ntz, sl double, tgt double")
    r = E.first_touch_exit(c, b, AROUND_THE_CLOCK, **kw).first()
    return r["exit_ts"], r["exit_price"], r["outcome"]


def test_both_barriers_on_one_bar(spark):
    path = [(at(5), 100, 101, 99.5, 100, 1), (at(6), 100, 103, 98, 100, 1)]
    assert exits_of(spark, path) == (at(6), 99.0, "SL")
    assert exits_of(spark, path, optimistic=True) == (at(6), 102.0, "TARGET")


def test_stop_equal_to_low_and_entry_bar_counts(spark):
    assert exits_of(spark, [(at(5), 100, 101, 99, 100, 1)]) == (at(5), 99.0, "SL")


def test_square_off_comes_before_the_stop(spark):
    assert exits_of(spark, [(at(21), 100, 101, 99.5, 100, 1), (at(22), 100, 103, 98, 100.5, 1)]) == (at(22), 100.5, "SQUAREOFF")


def test_no_exit_ends_with_the_session_or_is_carried(spark):
    nxt = DAY + dt.timedelta(days=1)
    path = [(at(5), 100, 101, 99.5, 100, 1), (at(6), 100, 101, 99.5, 100.2, 1), (at(3, day=nxt), 100, 104, 100, 103, 1)]
    assert exits_of(spark, path) == (at(6), 100.2, "EOD_FORCED")
    assert exits_of(spark, path, carry=True) == (at(3, day=nxt), 102.0, "TARGET")
    assert exits_of(spark, path[:2], carry=True) == (at(6), 100.2, "EOD_FORCED")


# ---- gates ------------------------------------------------------------------------------------------
@pytest.mark.parametrize("direction,trend,soft,strict", [(1, 1, True, True), (1, 0, True, False), (1, -1, False, False),
                                                         (-1, -1, True, True), (-1, 0, True, False), (-1, 1, False, False)])
def test_index_gate(spark, direction, trend, soft, strict):
    d, t = F.lit(direction), F.lit(trend)
    assert (value(spark, G.index_gate(d, t)), value(spark, G.index_gate(d, t, "strict"))) == (soft, strict)


def test_skill_at_the_minimum_is_not_enough(spark):
    now = F.lit(at(12)).cast("timestamp_ntz")
    ok = lambda skill: value(spark, G.usable_forecast(now, now, F.lit("gbt"), F.lit(skill), "gbt", 0.05))
    assert not ok(0.05) and ok(0.0501)


def test_forecast_gate_states(spark):
    g = lambda d, v, p, strict=False: value(spark, G.forecast_gate(F.lit(d), F.lit(v).cast("int"), F.lit(p), strict))
    assert (g(1, 1, 0.8)["adjust"], g(1, -1, 0.4)["adjust"], g(1, None, 0.5)["adjust"], g(1, 1, 0.5)["adjust"]) == (2, -2, 0, 0)
    assert g(1, 1, 0.8)["reason"] == "forecast:agree(0.80)" and not g(1, -1, 0.4, True)["allow"]


def test_clustered_levels(spark):
    got = value(spark, L.cluster_levels(F.array(*map(F.lit, [100.0, 100.1, 100.2, 101.0])), 0.0015))
    assert got == [100.0, 100.2, 101.0]
