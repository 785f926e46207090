"""Parameter sweeps, their ranking, and walk-forward validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.functions import trading as T
from barloom.operators import rolling as R
from barloom.operators.layout import lay_out, one_row, pick_mode, pinned, running
from barloom.operators.performance import daily_equity, trade_summary
from barloom.plans import outcomes as O
from barloom.plans.admission import admission_counts, book, let, taken as trades_of
from barloom.plans.signals import first_signals
from barloom.spec import CAPITAL, TRADING_DAYS, CostSpec, ExitSpec, SessionSpec

# fixed values: sweep grids
GRIDS: dict[str, dict[str, list]] = {
    "default": {"atr_mult": [1.0, 1.5, 2.0], "reward_ratio": [1.5, 2.0, 2.5], "min_score": [6, 7, 8],
                "require_confirmation": [True, False], "gate": ["off", "soft", "strict"], "min_turnover": [25.0],
                "min_stop": [0.003], "max_stop": [0.015], "top_per_bar": [30]},
    "quick": {"atr_mult": [1.5, 2.0], "reward_ratio": [2.0], "min_score": [6, 7, 8], "require_confirmation": [True],
              "gate": ["off", "soft"], "min_turnover": [25.0], "min_stop": [0.003], "max_stop": [0.015], "top_per_bar": [30]},
    "wide": {"atr_mult": [0.8, 1.0, 1.25, 1.5, 2.0, 2.5], "reward_ratio": [1.5, 2.0, 2.5, 3.0], "min_score": [5, 6, 7, 8, 9],
             "require_confirmation": [True, False], "gate": ["off", "soft", "strict"], "min_turnover": [10.0, 25.0, 50.0],
             "min_stop": [0.002, 0.003], "max_stop": [0.010, 0.015, 0.020], "top_per_bar": [20, 30]},
}
EXIT_KEYS = ["atr_mult", "reward_ratio", "min_stop", "max_stop"]
SIGNAL_KEYS = ["require_confirmation", "min_turnover"]
NEIGHBOUR_KEYS = ["atr_mult", "reward_ratio", "min_score", "require_confirmation", "gate"]


def grid_cross(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """One row per combination; ``run`` numbers them with the last list varying fastest."""
    df = spark.range(1).select(F.lit(0).cast("int").alias("run"))
    for name, values in grid.items():
        df = df.select("*", F.posexplode(F.array(*[F.lit(v) for v in values])).alias("_i", name))
        df = df.withColumn("run", (F.col("run") * len(values) + F.col("_i")).cast("int")).drop("_i")
    return df


def numbered(grid: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The distinct settings of a grid, numbered from 0: a handful of rows."""
    return grid.select(*keys).distinct().withColumn(name, F.row_number().over(Window.orderBy(*keys)) - 1)


def sweep_books(hits: DataFrame, bars: DataFrame, trend: DataFrame | None, grid: DataFrame, session: SessionSpec,
                exit_spec: ExitSpec, max_open: int = 5, **kw) -> DataFrame:
    """The book of every run and session, with its trades and counters.

    Only the exit parameters change an outcome and only confirmation and turnover change which hits count. A signal is one row
    that names the filter settings it passes and holds a result per exit setting; runs only fold over these rows.
    """
    variants, settings = numbered(grid, SIGNAL_KEYS, "variant"), numbered(grid, EXIT_KEYS, "setting")
    filters = one_row(variants.agg(F.collect_list(F.struct(*SIGNAL_KEYS, "variant")).alias("f")))["f"]
    v = hits.withColumn("x", F.explode(filters)).select("*", "x.*").drop("x")
    v = v.filter((~F.col("require_confirmation") | F.col("confirmed")) & (F.col("turnover") >= F.col("min_turnover"))).drop(*SIGNAL_KEYS)
    first = O.in_scan_window(first_signals(v, ["variant"]), session)
    key = ["symbol", "session_date", "ts", "strategy", "direction", "pattern"]
    rest = [c for c in first.columns if c not in (*key, "variant")]
    signals = first.groupBy(*key).agg(F.collect_set("variant").alias("variants"), *[F.any_value(c).alias(c) for c in rest])
    each = one_row(settings.agg(F.sort_array(F.collect_list(F.struct("setting", *EXIT_KEYS))).alias("s")))["s"]
    done = O.outcomes_by_setting(O.with_entries(signals, bars, keep_all=True), bars, session, exit_spec, each, **kw)
    runs = grid.join(variants, SIGNAL_KEYS).join(settings, EXIT_KEYS).withColumn("max_open", F.lit(max_open))
    return book(O.with_trend(done, trend), runs, ["symbol", "session_date", "ts", "strategy", "side", "entry_ts", "entry_price"])


def run_summary(books: DataFrame, grid: DataFrame, capital: float = CAPITAL, min_trades: int = 30) -> DataFrame:
    """Performance, counters and fitness of every run, including runs that never traded."""
    taken = trades_of(books)
    perf = trade_summary(taken, ["run"], pnl="pnl_net", r="r_multiple", capital=capital)
    # equity is recorded per bar of exit; one run trades at most its cap per bar, so a run is small
    bar = taken.groupBy("run", "exit_ts").agg(F.sum("pnl_net").alias("p"))
    w = Window.partitionBy("run").orderBy("exit_ts").rowsBetween(Window.unboundedPreceding, 0)
    eq = bar.withColumn("equity", capital + F.sum("p").over(w))
    eq = eq.withColumn("peak", F.greatest(F.lit(capital), F.max("equity").over(w)))
    dd = eq.groupBy("run").agg((F.max((F.col("peak") - F.col("equity")) / F.col("peak")) * 100).alias("max_drawdown_pct"))
    days = daily_equity(taken, "exit_ts", "pnl_net", capital, ["run"])
    d = Window.partitionBy("run").orderBy("day")
    days = days.withColumn("c", F.col("equity") / F.lag("equity").over(d) - 1.0)
    sd = F.stddev_samp("c")
    sharpe = days.groupBy("run").agg(F.when(sd > 0, F.avg("c") / sd * TRADING_DAYS ** 0.5).otherwise(0.0).alias("sharpe_annual"))
    counts = admission_counts(books).drop("taken")
    df = grid
    for part in (perf, dd, sharpe, counts):
        df = df.join(part, "run", "left")
    df = df.na.fill(0, ["trades", "wins", "losses", "raw_signals", "gate_rejected", "position_cap_hits"])
    return df.withColumn("fitness", T.fitness(F.col("trades"), F.col("expectancy_r"), F.col("profit_factor"),
                                              F.coalesce("max_drawdown_pct", F.lit(0.0)), min_trades))


def parameter_sweep(hits: DataFrame, bars: DataFrame, trend: DataFrame | None, grid: DataFrame, session: SessionSpec,
                    exit_spec: ExitSpec, **kw) -> DataFrame:
    # four summaries read the books
    return run_summary(pinned(sweep_books(hits, bars, trend, grid, session, exit_spec, **kw)), grid)


def top_configs(results: DataFrame, k: int, by: str = "fitness", tie: str = "run") -> DataFrame:
    return results.orderBy(F.col(by).desc(), F.col(tie)).limit(k)


def sweep_robustness(results: DataFrame) -> DataFrame:
    """One row: best, median and their ratio, share of profitable runs, and the best run's neighbours.

    A neighbour shares all but one of the five compared parameters with the best run.
    """
    best = top_configs(results, 1).select(*NEIGHBOUR_KEYS, "fitness")
    same = sum((F.col(c) == F.col(f"_b.{c}")).cast("int") for c in NEIGHBOUR_KEYS)
    df = results.withColumn("_b", one_row(best)).withColumns({"_m": same, "best_fitness": F.col("_b.fitness")})
    near = F.when(F.col("_m") == len(NEIGHBOUR_KEYS) - 1, F.col("fitness"))
    out = df.agg(F.max("best_fitness").alias("best_fitness"), F.median("fitness").alias("median_fitness"),
                 F.count(F.when(F.col("expectancy_r") > 0, 1)).alias("profitable"),
                 (F.avg(F.coalesce((F.col("expectancy_r") > 0).cast("double"), F.lit(0.0))) * 100).alias("profitable_pct"),
                 F.median(near).alias("neighbour_median"), F.min(near).alias("neighbour_min"))
    return out.withColumn("best_over_median", F.when(F.col("median_fitness") > 0, F.col("best_fitness") / F.col("median_fitness")))


def promotable(results: DataFrame, min_fitness: float = 0.15, min_trades: int = 30) -> DataFrame:
    """Adds ``warnings`` and ``ok`` to sweep rows."""
    c = F.col
    # fixed values: allowed parameter ranges
    warnings = F.array_compact(F.array(
        F.when(c("fitness").isNull() | (c("fitness") < min_fitness), "fitness too low"),
        F.when(c("trades").isNull() | (c("trades") < min_trades), "too few trades"),
        F.when(~c("atr_mult").between(0.5, 4.0), "atr_mult out of [0.5, 4.0]"),
        F.when(~c("reward_ratio").between(1.0, 5.0), "reward_ratio out of [1.0, 5.0]"),
        F.when(~c("min_score").between(1, 15), "min_score out of [1, 15]"),
        F.when(c("min_stop") >= c("max_stop"), "min_stop >= max_stop")))
    return results.withColumn("warnings", warnings).withColumn("ok", F.size("warnings") == 0)


# ---- splits over time --------------------------------------------------------------------
def numbered_dates(dates: DataFrame) -> DataFrame:
    """(session_date, n): distinct dates from 0; a calendar of dates is small enough for one window."""
    d = dates.select("session_date").distinct()
    return d.withColumn("n", F.row_number().over(Window.orderBy("session_date")) - 1)


def date_split(dates: DataFrame, ratio: float) -> DataFrame:
    """(session_date, part): the first ``max(1, int(n * ratio))`` dates train, the rest test."""
    d = numbered_dates(dates)
    cut = d.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * ratio)).alias("cut"))
    part = F.when(F.col("n") < F.col("cut"), "train").otherwise("test")
    return d.withColumn("cut", one_row(cut)["cut"]).select("session_date", part.alias("part"))


def walk_forward_folds(dates: DataFrame, n_folds: int = 5, embargo: int = 12) -> DataFrame:
    """(fold, part, session_date): growing train blocks, a gap of ``embargo`` dates, a validation block.

    No folds when there are too few dates. ``gap`` is the number of dates between train and validation.
    """
    d = numbered_dates(dates)
    n = F.col("total")
    f = d.agg(F.count(F.lit(1)).alias("total")).filter((n >= n_folds * (embargo + 10)) & F.lit(n_folds >= 2))
    f = f.select("total", F.explode(F.sequence(F.lit(1), F.lit(n_folds))).alias("fold"))
    size = F.floor(n / (n_folds + 1))
    f = f.withColumns({"train_end": size * F.col("fold"), "val_start": size * F.col("fold") + embargo})
    f = f.withColumn("val_end", F.least(F.col("val_start") + size, n)).filter((F.col("val_start") < n) & (F.col("val_end") > F.col("val_start")))
    every = f.agg(F.collect_list(F.struct("fold", "train_end", "val_start", "val_end")).alias("folds"))
    rows = d.withColumn("f", F.explode(one_row(every)["folds"])).select("session_date", "n", "f.*")
    part = (F.when(F.col("n") < F.col("train_end"), "train")
            .when((F.col("n") >= F.col("val_start")) & (F.col("n") < F.col("val_end")), "validate"))
    return (rows.withColumns({"part": part, "gap": F.col("val_start") - F.col("train_end")}).filter("part is not null")
            .select("fold", "part", "session_date", "gap"))


def has_no_leakage(folds: DataFrame, embargo: int) -> DataFrame:
    """Per fold: at least ``embargo`` dates lie between train and validation."""
    return folds.groupBy("fold").agg((F.min("gap") >= embargo).alias("ok"))


def oos_rejoin(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """Test results of the k best train runs, with their train fitness and the loss of fitness in percent."""
    best = top_configs(train, k).select("run", F.col("fitness").alias("train_fitness"))
    out = test.join(best, "run")
    drop = (F.col("train_fitness") - F.col("fitness")) / F.abs(F.nullif(F.col("train_fitness"), F.lit(0.0))) * 100
    out = out.withColumn("fitness_drop_pct", drop)
    return out.withColumn("verdict", F.when(drop > 50, "OVERFIT").when(drop > 25, "CAUTION").otherwise("HOLDS"))


def walk_forward_sweep(hits: DataFrame, bars: DataFrame, trend: DataFrame | None, grid: DataFrame, session: SessionSpec,
                       exit_spec: ExitSpec, ratio: float = 0.7, k: int = 5, **kw) -> DataFrame:
    """Sweep on the train dates, the k best runs again on the test dates.

    Signals and outcomes look at one session only, so one sweep over all dates serves both parts; the
    parts differ in which sessions they summarise. The index trend does run across days, hence
    a test part on its own would start with a young average.
    """
    parts = date_split(bars, ratio)
    # both parts read the books: write them once instead of computing them twice
    books = pinned(sweep_books(hits, bars, trend, grid, session, exit_spec, **kw).join(parts, "session_date"))
    summary = lambda part: run_summary(books.filter(F.col("part") == part), grid)
    return oos_rejoin(summary("train"), summary("test"), k)


# ---- moving-average sweep ------------------------------------------------------------------
# fixed values: grid of the moving-average sweep
FAST, SLOW, STOPS, RATIOS = [5, 9, 12], [20, 30, 50], [1.0, 1.5, 2.0, 2.5], [1.2, 1.5, 2.0, 2.5, 3.0]


def ma_trades(bars: DataFrame, fast: list[int] = FAST, slow: list[int] = SLOW, stops: list[float] = STOPS,
              ratios: list[float] = RATIOS, atr_len: int = 14, cost: CostSpec = CostSpec(), mode: str = "auto") -> DataFrame:
    """Long trades of every moving-average pair and stop/target pair, one open at a time.

    A position closes on the first later close that reaches stop or target or crosses back. A cross down
    lies between two crosses up except where the averages touch, so the bars between two crosses down
    form a segment in which an entry meets only its own bars: an array that all stops and targets of the entry
    search, so neither bars nor entries are multiplied by the grid.
    """
    mode = pick_mode(bars, ["symbol"]) if mode == "auto" else mode
    lay = lay_out(bars, ["symbol"], ["ts"], back=max(slow) + atr_len + 1, mode=mode)
    lay = R.atr_sma(lay, atr_len)
    lay = lay.with_columns(**{f"_ma{n}": R.sma(lay, "close", n) for n in {*fast, *slow}})
    lay = lay.with_columns(**{f"_pm{n}": R.previous(lay, f"_ma{n}") for n in {*fast, *slow}})
    pair = lambda f, s: F.struct(
        F.lit(f).alias("fast"), F.lit(s).alias("slow"),
        F.coalesce((F.col(f"_ma{f}") > F.col(f"_ma{s}")) & (F.col(f"_pm{f}") <= F.col(f"_pm{s}")), F.lit(False)).alias("up"),
        F.coalesce((F.col(f"_ma{f}") < F.col(f"_ma{s}")) & (F.col(f"_pm{f}") >= F.col(f"_pm{s}")), F.lit(False)).alias("down"))
    pairs = F.explode(F.array(*[pair(f, s) for f in fast for s in slow if f < s]))
    df = lay.finish().select("symbol", "ts", "close", "atr_sma", pairs.alias("x")).select("symbol", "ts", "close", "atr_sma", "x.*")
    keys = ["symbol", "fast", "slow"]
    seg = running(lay_out(df, keys, ["ts"], mode=mode), sums={"_downs": F.col("down").cast("int")})
    # the bar that crosses down still belongs to the segment it ends
    df = seg.finish().withColumn("segment", F.col("_downs") - F.col("down").cast("int")).drop("_downs")
    frac = lambda sl: F.when(F.col("atr_sma").isNotNull(), F.coalesce(F.greatest(F.lit(0.001), F.least(sl * F.col("atr_sma") / F.col("close"), F.lit(0.05))), F.lit(0.01))).otherwise(0.01)
    # an entry meets the bars of its segment once and searches them for every stop and target
    path = F.array_sort(F.collect_list(F.struct("ts", "close", "down"))).alias("path")
    e = df.filter("up").join(df.groupBy(*keys, "segment").agg(path), [*keys, "segment"]).withColumn("path", F.filter("path", lambda b: b["ts"] > F.col("ts")))
    settings = F.array(*[F.struct(F.lit(float(s)).alias("sl_atr"), F.lit(float(r)).alias("rr")) for s in stops for r in ratios])
    p = F.col("close")

    def first_end(s: Column) -> Column:
        target = lambda f: F.greatest(F.lit(0.001), F.least(f * s["rr"], F.lit(0.2)))
        limits = let(frac(s["sl_atr"]), lambda f: F.struct((p * (1 - f)).alias("low"), (p * (1 + target(f))).alias("high")))
        hit = let(limits, lambda x: F.try_element_at(F.filter("path", lambda b: b["down"] | (b["close"] <= x["low"]) | (b["close"] >= x["high"])), F.lit(1)))
        return let(hit, lambda h: F.struct(s["sl_atr"].alias("sl_atr"), s["rr"].alias("rr"), h["ts"].alias("exit_ts"), h["close"].alias("exit_price")))

    ends = e.withColumn("x", F.explode(F.filter(F.transform(settings, first_end), lambda x: x["exit_ts"].isNotNull())))
    config = [*keys, "sl_atr", "rr"]
    closed = ends.select(*keys, "segment", F.col("ts").alias("entry_ts"), p.alias("entry_price"), "x.*")
    # entries of one segment are few (touching averages): keep those after the last exit kept
    trade = F.struct("entry_ts", "entry_price", "exit_ts", "exit_price")
    kind = closed.select(trade.alias("t")).schema["t"].dataType.simpleString()
    keep = lambda acc, t: F.when((F.size(acc) == 0) | (t["entry_ts"] > F.element_at(acc, -1)["exit_ts"]), F.concat(acc, F.array(t))).otherwise(acc)
    rows = closed.groupBy(*config, "segment").agg(F.array_sort(F.collect_list(trade)).alias("ts"))
    rows = rows.select(*config, F.explode(F.aggregate("ts", F.array().cast(f"array<{kind}>"), keep)).alias("t")).select(*config, "t.*")
    gain = F.col("exit_price") * (1 - cost.slip) * (1 - cost.tax) / (F.col("entry_price") * (1 + cost.slip) * (1 + cost.tax)) - 1.0
    return rows.withColumn("ret", gain)


def ma_sweep(bars: DataFrame, min_trades: int = 5, **kw) -> DataFrame:
    """Results per symbol and configuration with at least ``min_trades`` trades.

    ``sharpe`` is the mean over deviation of trade returns times the root of their number.
    """
    sd = F.stddev_samp("ret")
    out = ma_trades(bars, **kw).groupBy("symbol", "fast", "slow", "sl_atr", "rr").agg(
        F.count(F.lit(1)).alias("trades"), (F.avg((F.col("ret") > 0).cast("double")) * 100).alias("win_rate"),
        ((F.exp(F.sum(F.log1p("ret"))) - 1.0) * 100).alias("total_return_pct"),
        F.when(sd > 0, F.avg("ret") / sd * F.sqrt(F.count(F.lit(1)))).otherwise(0.0).alias("sharpe"))
    out = out.filter(F.col("trades") >= min_trades)
    return out.withColumn("fitness", T.fitness_ma(F.col("trades"), F.col("total_return_pct"), F.col("sharpe"), F.col("win_rate")))


def stop_ratio_regions(results: DataFrame, min_trades: int = 10, k: int = 10) -> DataFrame:
    """Mean fitness, return and win rate per (sl_atr, rr): the k best regions."""
    out = results.filter(F.col("trades") >= min_trades).groupBy("sl_atr", "rr").agg(
        F.avg("fitness").alias("mean_fitness"), F.avg("total_return_pct").alias("mean_ret"), F.avg("win_rate").alias("mean_wr"),
        F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.col("mean_fitness").desc(), "sl_atr", "rr").limit(k)
