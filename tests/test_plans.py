"""Plans against brute force on small fixtures."""

import collections
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import catalog
from barloom.checks import stand_ins as X
from barloom.operators import asof, ledger as G, performance as P, risk as R
from barloom.plans import admission as AD, models as M, outcomes as O, resampling as RS, sweep as W
from barloom.spec import DayLimits

ORDER = ["exit_time", "trade_id"]


@pytest.fixture(scope="module")
def judged():
    """Random signals with known exits over three sessions and two runs."""
    rng = np.random.default_rng(5)
    rows = []
    for run in (0, 1):
        for day in (2, 3, 4):
            for _ in range(60):
                h, sym = int(rng.integers(3, 20)), f"S{rng.integers(0, 8)}"
                ts = dt.datetime(2024, 1, day, h)
                entry = ts + dt.timedelta(hours=1)
                rows.append((run, ts.date(), sym, ts, ["ORB", "GAPFILL", "OB_SHORT"][rng.integers(0, 3)], "p", int(rng.integers(4, 10)),
                             float(rng.integers(1, 4)), int(rng.integers(4, 7)), bool(rng.random() < 0.8), bool(rng.random() < 0.9), entry,
                             entry + dt.timedelta(hours=int(rng.integers(0, 6))), 2 + run, 6, 2 + 2 * run))
    cols = ["run", "session_date", "symbol", "ts", "strategy", "pattern", "score", "vol_ratio", "strength", "gate_ok", "can_enter", "entry_ts", "exit_ts",
            "max_open", "min_score", "top_per_bar"]
    return pd.DataFrame(rows, columns=cols).drop_duplicates(["run", "ts", "symbol", "score", "vol_ratio", "strength"])


def stepping_book(g):
    """Clock-driven reference: every bar frees slots, then tries its ranked signals."""
    taken, open_, traded = [], [], set()
    cap, floor, top = g["max_open"].iloc[0], g["min_score"].iloc[0], g["top_per_bar"].iloc[0]
    for ts in sorted(g["ts"].unique()):
        open_ = [x for x in open_ if x > ts]
        now = g[(g["ts"] == ts) & g["gate_ok"] & ~g["symbol"].isin(traded)]
        now = now.sort_values(["score", "vol_ratio", "strength", "symbol", "pattern"], ascending=[False, False, False, True, True])
        for r in now.drop_duplicates("symbol").head(top).itertuples():
            if r.score < floor:
                continue
            if len(open_) >= cap:
                break
            if not r.can_enter:
                continue
            taken.append((r.run, r.ts, r.symbol, r.score))
            open_.append(r.exit_ts)
            traded.add(r.symbol)
    return taken


def fold(spark, judged):
    """The judged rows as offers of one filter setting per run; runs differ in their limits."""
    rows = judged.assign(direction=1, trend=judged["gate_ok"].map({True: 1, False: 0}), variants=judged["run"].map(lambda r: [int(r)]))
    df = spark.createDataFrame(rows.drop(columns=["run", "gate_ok", "max_open", "min_score", "top_per_bar"]))
    df = df.withColumn("results", F.array(F.struct(F.lit(None).cast("timestamp").alias("exit_ts"), F.lit(False).alias("can_enter")), F.struct("exit_ts", "can_enter")))
    runs = judged[["run", "top_per_bar", "min_score", "max_open"]].drop_duplicates()
    limits = spark.createDataFrame([(int(r.run), "strict", int(r.top_per_bar), int(r.min_score), int(r.max_open), int(r.run), 1) for r in runs.itertuples()],
                                   "run int, gate string, top_per_bar int, min_score int, max_open int, variant int, setting int")
    return AD.book(df, limits, ["symbol", "session_date", "ts", "score"])


def test_admission_equals_a_stepping_book(spark, judged):
    books = fold(spark, judged)
    walked = AD.taken(books).toPandas()
    got = sorted((r.run, pd.Timestamp(r.ts), r.symbol, r.score) for r in walked.itertuples())
    want = sorted(t for _, g in judged.groupby(["run", "session_date"]) for t in stepping_book(g))
    assert got == [(a, pd.Timestamp(b), c, d) for a, b, c, d in want] and got
    assert {r.run: r.taken for r in AD.admission_counts(books).collect()} == collections.Counter(t[0] for t in want)


def test_fold_runs_in_the_jvm(spark, judged):
    plan = fold(spark, judged)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_cap_is_never_exceeded(spark, judged):
    t = AD.taken(fold(spark, judged)).toPandas()
    limits = judged.groupby("run")["max_open"].first()
    for (run, _), g in t.groupby(["run", "session_date"]):
        for ts in g["ts"]:
            assert ((g["ts"] <= ts) & (g["exit_ts"] > ts)).sum() <= limits[run]
        assert g["symbol"].is_unique


def test_signals_without_entry_keep_their_rank(spark, judged):
    """Without a next bar or quantity a signal uses up its rank, but no slot, and its symbol may try again."""
    ts = pd.Timestamp("2024-01-02 09:00")
    row = lambda sym, hour, score, can: (0, ts.date(), sym, ts + pd.Timedelta(hours=hour), "ORB", "p", score, 1.0, 5, True, can, ts + pd.Timedelta(hours=9), 1, 6, 1)
    rows = [row("A", 0, 9, False), row("B", 0, 8, True), row("A", 1, 7, True), row("B", 2, 9, True)]
    cols = [c if c != "entry_ts" else "can_enter" for c in judged.columns.drop("can_enter")]
    books = fold(spark, pd.DataFrame(rows, columns=cols))
    assert [(r.symbol, r.score) for r in AD.taken(books).collect()] == [("A", 7)]  # B is below the top one, then finds the book full
    c = AD.admission_counts(books).first()
    assert (c.raw_signals, c.position_cap_hits, c.taken) == (4, 1, 1)


def test_asof_with_gaps_and_a_busy_bucket(spark):
    rng = np.random.default_rng(1)
    base = pd.Timestamp("2024-01-01")
    right = pd.DataFrame({"ts": base + pd.to_timedelta(np.unique(rng.integers(0, 20_000, 60)), "m")})
    right["v"] = np.arange(len(right))
    left = pd.DataFrame({"id": range(3000), "ts": base + pd.to_timedelta(np.where(rng.random(3000) < 0.6, rng.integers(1440, 1500, 3000), rng.integers(0, 30_000, 3000)), "m")})
    got = asof.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), "v").toPandas().sort_values("id")
    want = pd.merge_asof(left.sort_values("ts"), right, on="ts").sort_values("id")
    np.testing.assert_array_equal(got["v"].to_numpy(dtype=float), want["v"].to_numpy(dtype=float))


def test_bootstrap_blocks_add_up(spark, sf, monkeypatch):
    trades = catalog.trades(spark, sf).limit(200)
    whole = RS.bootstrap_trades(trades, ORDER, 5).toPandas().sort_values("iter").reset_index(drop=True)
    monkeypatch.setattr(RS, "BLOCK", 7)
    cut = RS.bootstrap_trades(trades, ORDER, 5).toPandas().sort_values("iter").reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, cut[whole.columns], rtol=1e-9)
    assert (whole["max_dd_pct"] >= 0).all() and whole["total_pnl"].nunique() == 5


def test_bootstrap_against_numpy(spark):
    p = [5.0, -3.0, 2.0, -8.0, 4.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "k int, pnl double")
    got = RS.bootstrap_trades(df, ["k"], 3).toPandas().set_index("iter")
    ids = spark.range(15).select((F.col("id") / 5).cast("long").alias("it"), (F.col("id") % 5).alias("i"))
    draws = ids.select("it", "i", F.pmod(RS.draw64(42, F.col("it"), F.col("i")), F.lit(5)).alias("k")).toPandas()
    for it, g in draws.groupby("it"):
        x = np.array(p)[g.sort_values("i")["k"]]
        eq = 100_000 + x.cumsum()
        dd = ((np.maximum.accumulate(eq) - eq) / np.maximum.accumulate(eq)).max() * 100
        assert got.loc[it, "total_pnl"] == pytest.approx(x.sum()) and got.loc[it, "max_dd_pct"] == pytest.approx(dd)


def test_path_summaries_by_brute_force(spark):
    """Curves cut into stretches anywhere have the largest fall of the whole curve."""
    rng = np.random.default_rng(7)
    rows, want = [], []
    for k in range(80):
        p = np.round(rng.normal(0.2, 3, rng.integers(1, 40)), 3)
        cuts = np.sort(rng.integers(0, len(p) + 1, 3))
        rows.append((k, [list(map(float, x)) for x in np.split(p, cuts) if len(x)]))
        curve = 60 + p.cumsum()
        peak = np.maximum.accumulate(curve)
        want.append(((peak - curve) / peak).max())
    df = spark.createDataFrame(rows, "k int, parts array<array<double>>")
    got = df.select("k", RS.worst_fall(F.transform("parts", RS.path_summary), 60.0).alias("w")).toPandas().sort_values("k")
    np.testing.assert_allclose(got["w"], want, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("draw", [RS.draw64, RS.draw_md5])
def test_keyed_permutations_are_bijections(spark, draw):
    """Every position is named once for any size, permutations differ, and no position is preferred."""
    ids = spark.range(200).withColumn("size", F.explode(F.array(*[F.lit(n).cast("long") for n in (1, 2, 3, 7, 30)])))
    rows = ids.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)))
    got = rows.withColumn("x", RS.shuffled_position(F.col("k"), F.col("size"), 42, F.col("id"), draw=draw)).toPandas()
    for (_, size), g in got.groupby(["id", "size"]):
        assert sorted(g["x"]) == list(range(size))
    seven = got[got["size"] == 7]
    counts = seven[seven["k"] == 0]["x"].value_counts()
    assert len(counts) == 7 and counts.max() < 60  # 200 / 7 is 29 with a deviation of 5
    assert seven.groupby("id")["x"].apply(tuple).nunique() > 150


def test_profit_factor_limits(spark):
    df = spark.createDataFrame([("win", 5.0), ("win", 1.0), ("loss", -2.0), ("mix", 4.0), ("mix", -2.0)], "k string, pnl double").withColumn("r", F.col("pnl"))
    got = {r["k"]: r["profit_factor"] for r in P.trade_summary(df, ["k"]).collect()}
    assert got == {"win": 999.0, "loss": 0.0, "mix": 2.0}


def test_single_trade_has_no_sharpe(spark):
    df = spark.createDataFrame([(1, 5.0)], "k int, pnl double")
    assert P.equity_metrics(df, ["k"]).first()["per_trade_sharpe"] == 0.0


def test_split_lanes_for_trades(spark, sf):
    t = catalog.trades(spark, sf).withColumn("day", F.to_date("exit_time"))
    a = R.day_halt(t, ORDER, DayLimits(300.0, 0.0, 8, 5), "keyed").toPandas().sort_values("trade_id").reset_index(drop=True)
    b = R.day_halt(t, ORDER, DayLimits(300.0, 0.0, 8, 5), "split", lanes=6).toPandas().sort_values("trade_id").reset_index(drop=True)
    cols = ["trade_id", "net", "streak", "halted", "reason"]
    pd.testing.assert_frame_equal(a[cols], b[cols], rtol=1e-9)
    ca = P.drawdown(P.equity_curve(t, ORDER, mode="keyed"), ORDER, mode="keyed").toPandas().sort_values("trade_id")
    cb = P.drawdown(P.equity_curve(t, ORDER, mode="split", lanes=5), ORDER, mode="split", lanes=5).toPandas().sort_values("trade_id")
    np.testing.assert_allclose(ca["drawdown"], cb["drawdown"], atol=1e-12)


def test_partition_count_does_not_change_results(spark, sf01):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(tuple, X.signals(spark, sf01).select("symbol", "ts", "strategy", "score").collect()))

    try:
        first = run(2)
        assert first and first == run(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_signals_are_unique_and_outcomes_follow_entries(spark, sf01):
    out = O.candidate_outcomes(X.signals(spark, sf01), catalog.bars(spark, sf01), X.CLOCK, X.EXITS).toPandas()
    assert len(out) and not out.duplicated(["symbol", "session_date", "strategy", "direction"]).any()
    assert (out["entry_ts"] > out["ts"]).all() and (out["exit_ts"] >= out["entry_ts"]).all()


def test_sweep_shares_outcomes_between_runs(spark, sf01):
    grid = W.grid_cross(spark, dict(W.GRIDS["quick"], atr_mult=[1.5], min_score=[6], min_turnover=[0.002], require_confirmation=[False], gate=["off"]))
    hits, bars = X.hits(spark, sf01), catalog.bars(spark, sf01)
    swept = W.parameter_sweep(hits, bars, None, grid, X.CLOCK, X.EXITS).first()
    trades, counts = O.backtest(bars, None, X.signals(spark, sf01), X.CLOCK, X.EXITS, X.ENTRY.with_(gate="off"))
    assert swept["trades"] == trades.count() and swept["raw_signals"] == counts.first()["raw_signals"]
    assert swept["total_pnl"] == pytest.approx(trades.agg(F.sum("pnl_net")).first()[0])


def test_grid_sizes(spark):
    assert W.grid_cross(spark, W.GRIDS["default"]).count() == 162 and W.grid_cross(spark, W.GRIDS["quick"]).count() == 12
    assert W.grid_cross(spark, W.GRIDS["wide"]).select("run").distinct().count() == 25_920


def test_time_split_is_by_time(spark, sf):
    train, valid = M.time_split(catalog.ticks(spark, sf))
    assert train.agg(F.max("ts")).first()[0] < valid.agg(F.min("ts")).first()[0]


def test_few_rows_fall_back(spark, sf):
    data = M.vol_dataset(catalog.ticks(spark, sf).limit(100), min_rows=1)
    model, info = M.train_vol_model(data, min_rows=200)
    assert model is None and info["model"] == "ewma_fallback" and info["status"] == "too_few_rows"


def test_labels_put_disagree_first(spark):
    df = spark.createDataFrame([("view:agree(0.8)",), ("view:disagree(0.4)",), ("",), (None,), ("na",)], "t string")
    assert [r[0] for r in df.select(G.label_tag(F.col("t"))).collect()] == ["agree", "disagree", "na", "na", "na"]


def test_bootstrap_draws_stay_in_their_tasks(spark, sf):
    """Of a small book only summaries of blocks travel: no draw is sorted, collected or shuffled."""
    plan = RS.bootstrap_trades(catalog.trades(spark, sf), ORDER, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(i" not in plan and "Join" not in plan


@pytest.mark.parametrize("hole", [None, float("nan")])
def test_block_summaries_against_columns(spark, monkeypatch, hole):
    """Both ways of drawing give the summaries that columns give, nulls and not-a-numbers included."""
    rng = np.random.default_rng(5)
    rows = [(k, hole if k % 37 == 5 else float(x)) for k, x in enumerate(np.round(rng.normal(0, 3, 90), 2))]
    df = spark.createDataFrame(rows, "k int, pnl double")
    monkeypatch.setattr(RS, "BLOCK", 20)
    own = RS.resample_metrics
    seen = []
    monkeypatch.setattr(RS, "resample_metrics", lambda blocks, capital: (seen.append(blocks.orderBy("iter", "block").collect()), own(blocks, capital))[1])
    small = RS.bootstrap_trades(df, ["k"], 4).orderBy("iter").collect()
    monkeypatch.setattr(RS, "SMALL_BOOK", 10)
    large = RS.bootstrap_trades(df, ["k"], 4).orderBy("iter").collect()
    assert str(small) == str(large) and str(seen[0]) == str(seen[1])
    ids = spark.range(4 * 90).select((F.col("id") / 90).cast("long").alias("iter"), (F.col("id") % 90).alias("i"))
    draws = ids.withColumn("k", F.pmod(RS.draw64(42, F.col("iter"), F.col("i")), F.lit(90))).join(df, "k").withColumn("block", F.floor(F.col("i") / 20))
    steps = draws.groupBy("iter", "block").agg(F.array_sort(F.collect_list(F.struct("i", "pnl"))).alias("s"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("pnl") > 0, 1)).alias("wins"))
    want = steps.withColumn("path", RS.path_summary(F.transform("s", lambda s: s["pnl"]))).orderBy("iter", "block").collect()
    near = lambda path: repr([None if path["total"] is None else round(path["total"], 6), round(path["top"], 6), [(round(m["at"], 6), round(m["low"], 6)) for m in path["marks"]]])
    assert [(r["n"], r["wins"], near(r["path"])) for r in seen[0]] == [(r["n"], r["wins"], near(r["path"])) for r in want]


def test_md5_draws_at_once():
    """Draws made many at a time are those of ``draw_md5``, whatever the lengths of the numbers."""
    import hashlib

    for seed, it, first, end in ((42, 0, 0, 1205), (42, 1999, 9_990, 10_015), (7, 123, 20_000, 30_000), (-5, 1, 7, 8), (123456789012, 31, 5_999_990, 6_000_003)):
        want = [int(hashlib.md5(f"{seed}:{it}:{i}".encode()).hexdigest()[:8], 16) for i in range(first, end)]
        assert RS.md5_draws(seed, it, first, end).tolist() == want


@pytest.mark.parametrize("draw", [RS.draw64, RS.draw_md5])
def test_draws_of_a_large_book_do_not_travel(spark, monkeypatch, draw):
    """A book of several parts: only summaries are shuffled, and the metrics are those of a book in one part, nulls included."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(k, None if k == 40 else float(x)) for k, x in enumerate(rng.normal(0, 900, 95))], "k int, pnl double")
    monkeypatch.setattr(RS, "BLOCK", 20)
    whole = RS.bootstrap_trades(df, ["k"], 6, draw=draw).orderBy("iter").collect()
    monkeypatch.setattr(RS, "SMALL_BOOK", 10)
    cut = RS.bootstrap_trades(df, ["k"], 6, draw=draw)
    assert cut.orderBy("iter").collect() == whole
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "explode" not in plan
    places = spark.range(6 * 95).select(F.floor(F.col("id") / 95).alias("iter"), (F.col("id") % 95).alias("i"))
    picks = places.withColumn("k", F.pmod(draw(42, F.col("iter"), F.col("i")), F.lit(95))).join(df, "k").groupBy("iter").agg(F.sum("pnl").alias("s"))
    want = {r.iter: r.s for r in picks.collect()}
    assert all(abs(want[r.iter] - r.total_pnl) < 1e-6 for r in whole)


def test_deepest_marks_hold_the_worst_fall(spark, monkeypatch):
    """With only the deepest marks of each block the largest fall stays, and few marks travel; curves that may begin below zero keep all marks."""
    rng = np.random.default_rng(8)
    seen, own = [], RS.resample_metrics
    monkeypatch.setattr(RS, "resample_metrics", lambda blocks, capital: (seen.append(blocks.agg(F.sum(F.size("path.marks"))).first()[0]), own(blocks, capital))[1])
    monkeypatch.setattr(RS, "BLOCK", 100)
    for drift, capital, fewer in ((0.0, 2_000.0, True), (40.0, 2_000.0, True), (0.0, 100.0, False)):
        df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(rng.normal(drift, 100, 450))], "k int, pnl double")
        seen.clear()
        monkeypatch.setattr(RS, "MARKS", 1000)
        whole = RS.bootstrap_trades(df, ["k"], 30, capital=capital).orderBy("iter").collect()
        monkeypatch.setattr(RS, "MARKS", 0)
        few = RS.bootstrap_trades(df, ["k"], 30, capital=capital).orderBy("iter").collect()
        assert few == whole and max(r.max_dd_pct for r in few) > 0
        assert (seen[1] < 0.6 * seen[0]) if fewer else (seen[1] == seen[0])
