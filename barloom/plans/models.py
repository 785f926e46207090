"""Volatility and win-probability models on ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from barloom.functions import trading as T
from barloom.operators import rolling as R
from barloom.operators.clean import enough_rows
from barloom.operators.layout import lay_out, pinned
from barloom.operators.ledger import last_n
from barloom.operators.recursive import BASE_FEATURES, WARM_ROWS, recursive_columns
from barloom.spec import CostSpec

# fixed values: features of the volatility model
VOL_FEATURES = ["ret1", "ret2", "absret1", "rv5", "rv10", "rv20", "atr_frac", "park_vol", "range_pct", "gap_pct", "vol_z", "dow"]
# fixed values: stop and target grids of the win-probability model, in ATR
SL_GRID, TGT_GRID, THETA = [1.0, 1.25, 1.5, 1.75, 2.0, 2.5], [1.5, 2.0, 2.5, 3.0, 3.5, 4.0], 0.6


def vol_dataset(bars: DataFrame, min_rows: int = 40, mode: str = "auto") -> DataFrame:
    """Features of every bar of sufficiently long series and the next bar's Parkinson volatility."""
    lay = lay_out(enough_rows(bars, ["symbol"], min_rows), ["symbol"], ["ts"], back=WARM_ROWS, ahead=1, mode=mode)
    r = R.returns(lay)
    lay = lay.with_columns(log_ret1=r["log_ret1"], ret2=r["log_ret2"], gap_pct=r["gap_pct"], vol_z=R.volume_zscore(lay), park_vol=R.parkinson())
    lay = lay.with_columns(**{f"rv{n}": R.realized_vol(lay, n) for n in (5, 10, 20)}, y_next_vol=F.lead("park_vol").over(lay.window()))
    df = recursive_columns(lay, {"_atr": "atr_ewm:14", "ewma_vol": "ewma_vol:10"}).finish()
    c = F.col("close")
    return df.select("symbol", "ts", "session_date", F.col("log_ret1").alias("ret1"), "ret2", F.abs("log_ret1").alias("absret1"), "rv5", "rv10",
                     "rv20", (F.col("_atr") / c).alias("atr_frac"), "park_vol", ((F.col("high") - F.col("low")) / c).alias("range_pct"), "gap_pct",
                     "vol_z", F.weekday("ts").cast("double").alias("dow"), "y_next_vol", "ewma_vol")


def complete_rows(dataset: DataFrame) -> DataFrame:
    return dataset.na.drop(subset=[*VOL_FEATURES, "y_next_vol"])


def time_split(dataset: DataFrame, ratio: float = 0.85, time: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Train before the moment below which ``ratio`` of the rows lie, validation from it on.

    One moment for all symbols: rows of a later date never train a model that is judged on earlier
    ones. The moment is an approximate quantile, found without sorting the rows.
    """
    t = F.unix_micros(F.col(time).cast("timestamp"))
    cut = dataset.agg(F.percentile_approx(t, ratio, 10_000).alias("cut")).first()["cut"]
    return dataset.filter(t < cut), dataset.filter(t >= cut)


def train_vol_model(dataset: DataFrame, min_rows: int = 2, max_iter: int = 20, max_depth: int = 5, seed: int = 7):
    """(model or None, info). ``info["status"]`` is ``trained``, or ``too_few_rows`` below ``min_rows``; the caller chooses what to do then."""
    # every boosting round reads the rows again: write them once
    rows = pinned(complete_rows(dataset))
    n = rows.count()
    if n < min_rows:
        return None, {"model": "ewma_fallback", "status": "too_few_rows", "reason": f"only {n} rows", "rows": n}
    train, valid = (VectorAssembler(inputCols=VOL_FEATURES, outputCol="features").transform(p) for p in time_split(rows))
    model = GBTRegressor(labelCol="y_next_vol", maxIter=max_iter, maxDepth=max_depth, stepSize=0.05 if max_iter > 100 else 0.1, seed=seed,
                         subsamplingRate=0.85).fit(train)
    mean = train.agg(F.avg("y_next_vol").alias("m")).first()["m"]
    err = model.transform(valid).agg(F.avg(F.abs(F.col("prediction") - F.col("y_next_vol"))).alias("mae"),
                                     F.avg(F.abs(F.col("y_next_vol") - mean)).alias("base")).first()
    skill = 1 - err["mae"] / err["base"] if err["base"] else 0.0
    weights = sorted(zip(VOL_FEATURES, model.featureImportances.toArray()), key=lambda kv: -kv[1])
    return model, {"model": "gbt", "status": "trained", "rows": n, "val_mae": err["mae"], "skill_vs_mean": skill, "top_features": [k for k, _ in weights[:5]]}


def vol_baseline(dataset: DataFrame, window: int = 20) -> DataFrame:
    """Median of the last ``window`` Parkinson values per symbol."""
    recent = last_n(dataset.filter("park_vol is not null").select("symbol", "ts", "park_vol"), ["symbol"], ["ts"], window)
    return recent.groupBy("symbol").agg(F.median("park_vol").alias("baseline"))


def vol_forecast(dataset: DataFrame, model=None) -> DataFrame:
    """Latest prediction per symbol over its baseline, as a clamped scale and a regime."""
    cols = [*VOL_FEATURES, "ewma_vol"]
    # the last rows and the baseline both read the dataset: write it once
    dataset = pinned(dataset.select("symbol", "ts", *cols))
    last = dataset.groupBy("symbol").agg(F.max_by(F.struct("ts", *cols), "ts").alias("s")).select("symbol", *[F.col(f"s.{c}").alias(c) for c in ["ts", *cols]])
    if model is None:
        pred = last.withColumn("pred_vol", F.col("ewma_vol"))
    else:
        usable = F.lit(True)
        for c in VOL_FEATURES:
            usable = usable & F.col(c).isNotNull()
        filled = last.withColumn("_ok", usable).na.fill(0.0, VOL_FEATURES)
        scored = model.transform(VectorAssembler(inputCols=VOL_FEATURES, outputCol="features").transform(filled))
        pred = scored.withColumn("pred_vol", F.when(F.col("_ok"), F.col("prediction")).otherwise(F.col("ewma_vol")))
    out = pred.select("symbol", "pred_vol").join(vol_baseline(dataset), "symbol", "left")
    out = out.withColumn("scale", T.vol_scale(F.col("pred_vol"), F.col("baseline")))
    return out.withColumn("regime", T.vol_regime(F.col("scale")))


def regime_counts(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy("regime").agg(F.count(F.lit(1)).alias("n"))


# ---- win probability of (stop, target) pairs ---------------------------------------------
def pairs(sl: list[float] = SL_GRID, tgt: list[float] = TGT_GRID, theta: float = THETA) -> list[tuple[float, float]]:
    """Grid pairs whose target is not too near against the stop, in grid order."""
    return [(s, t) for s in sl for t in tgt if t > theta * s]


def rr_grid_cross(rows: DataFrame, sl: list[float] = SL_GRID, tgt: list[float] = TGT_GRID, theta: float = THETA) -> DataFrame:
    """Each row once per usable pair; ``pair_no`` is the pair's place in the grid."""
    grid = F.array(*[F.struct(F.lit(i).alias("pair_no"), F.lit(s).alias("sl_mult"), F.lit(t).alias("tgt_mult")) for i, (s, t) in enumerate(pairs(sl, tgt, theta))])
    return rows.withColumn("_g", F.explode(grid)).select("*", "_g.*").drop("_g")


def barrier_labels(bars: DataFrame, horizon: int = 12, stride: int = 3, sl: list[float] = SL_GRID, tgt: list[float] = TGT_GRID,
                   mode: str = "auto") -> DataFrame:
    """Rows (symbol, ts, direction, sl_mult, tgt_mult, label): does the target come before the stop?

    Entry at the close of every ``stride``-th bar, both directions, barriers in multiples of its ATR,
    within ``horizon`` bars. Neither barrier counts as a loss, as does a bar with both. The bars ahead
    travel with each row as a short array, so bars are not joined to themselves.
    """
    lay = lay_out(bars, ["symbol"], ["ts"], back=WARM_ROWS, ahead=horizon, mode=mode)
    path = F.collect_list(F.struct("high", "low")).over(lay.rows(1, horizon))
    lay = lay.with_columns(path=path, position=lay.position())
    df = recursive_columns(lay, {"atr": "atr_zero:14"}).finish()
    df = df.filter((F.col("position") % stride == 0) & (F.col("atr") > 0) & (F.size("path") == horizon))
    df = df.select("symbol", "ts", "position", "close", "atr", "path").withColumn("direction", F.explode(F.array(F.lit(1), F.lit(-1))))
    df = rr_grid_cross(df, sl, tgt)
    d, c, a = F.col("direction"), F.col("close"), F.col("atr")
    stop, goal = c - d * F.col("sl_mult") * a, c + d * F.col("tgt_mult") * a
    df = df.withColumns({"_s": stop, "_g": goal})
    lost = lambda b: F.when(d > 0, b["low"] <= F.col("_s")).otherwise(b["high"] >= F.col("_s"))
    won = lambda b: F.when(d > 0, b["high"] >= F.col("_g")).otherwise(b["low"] <= F.col("_g"))
    first = F.try_element_at(F.filter("path", lambda b: lost(b) | won(b)), F.lit(1))
    df = df.withColumn("_f", first)
    label = F.when(F.col("_f").isNull() | lost(F.col("_f")), 0).otherwise(1)
    return df.select("symbol", "ts", "direction", "sl_mult", "tgt_mult", label.alias("label"))


def train_win_model(features: DataFrame, labels: DataFrame, max_iter: int = 10, max_depth: int = 4, seed: int = 7) -> GBTClassificationModel:
    """Classifier of the label from the bar's features and the pair."""
    cols = [*BASE_FEATURES, "sl_mult", "tgt_mult"]
    rows = labels.join(features.select("symbol", "ts", *BASE_FEATURES), ["symbol", "ts"]).na.fill(0.0, BASE_FEATURES)
    rows = pinned(rows.select(*cols, "label"))
    vec = VectorAssembler(inputCols=cols, outputCol="features").transform(rows)
    return GBTClassifier(labelCol="label", maxIter=max_iter, maxDepth=max_depth, seed=seed, subsamplingRate=0.85).fit(vec)


def best_by_argmax(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Best-scoring pair per key; equal scores keep the earlier pair of the grid."""
    rest = [c for c in scored.columns if c not in keys]
    best = scored.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), (-F.col("pair_no")).alias("o"))).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def rr_score(features: DataFrame, model: GBTClassificationModel, keys: list[str], min_bars: int = 20, min_score: float = 0.0,
             cost: CostSpec = CostSpec()) -> DataFrame:
    """Best pair per feature row with status and reasons; rows that cannot be scored fall back.

    ``position`` counts the bars behind a row, null features are invalid.
    """
    bad = F.lit(False)
    for c in BASE_FEATURES:
        v = F.col(c)
        bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    gate = F.when(F.col("position") < min_bars, "INSUFFICIENT_BARS").when(bad, "INVALID_FEATURE")
    base = features.withColumn("_gate", gate)
    cols = [*BASE_FEATURES, "sl_mult", "tgt_mult"]
    grid = VectorAssembler(inputCols=cols, outputCol="features").transform(rr_grid_cross(base.filter("_gate is null").select(*keys, *BASE_FEATURES)))
    p = vector_to_array(F.col("probability"))[1]
    scored = model.transform(grid).withColumn("p", p)
    scored = scored.withColumn("score", T.grid_score(F.col("p"), F.col("sl_mult"), F.col("tgt_mult"), F.col("atr_frac"), cost))
    best = best_by_argmax(scored.select(*keys, "pair_no", "sl_mult", "tgt_mult", "p", "score"), keys)
    out = base.select(*keys, "_gate").join(best, keys, "left")
    status = F.coalesce(F.col("_gate"), F.when(F.coalesce(F.col("score"), F.lit(-1e18)) < min_score, "OUT_OF_RANGE"), F.lit("ACCEPTED"))
    ok = F.col("status") == "ACCEPTED"
    # fixed values: reason codes by status
    why = (F.when(ok, F.array(F.lit("RR_SCHEMA_VALID"), F.lit("RR_CONFIDENCE_PASSED"), F.lit("RR_ACCEPTED")))
           .when(F.col("status") == "INSUFFICIENT_BARS", F.array(F.lit("RR_INSUFFICIENT_BARS"), F.lit("RR_FALLBACK")))
           .when(F.col("status") == "INVALID_FEATURE", F.array(F.lit("NON_FINITE_VALUE"), F.lit("RR_FALLBACK")))
           .otherwise(F.array(F.lit("RR_CONFIDENCE_LOW"), F.lit("RR_FALLBACK"))))
    keep = lambda c: F.when(ok, F.col(c)).alias(c)
    return out.withColumn("status", status).select(*keys, "status", why.alias("reasons"), keep("sl_mult"), keep("tgt_mult"), keep("score"), keep("p"))


def combo_distribution(picks: DataFrame) -> DataFrame:
    """How often each pair is the best pick."""
    return picks.groupBy("sl_mult", "tgt_mult").agg(F.count(F.lit(1)).alias("n"))


# fixed values: required manifest fields and thresholds of the promotion gate
MANIFEST_FIELDS = ["model_version", "feature_schema_hash", "training_cutoff", "dataset_fingerprint", "label_definition", "horizon",
                   "strategy_compatibility", "validation_metrics", "dependency_versions", "git_commit", "promotion_state"]
MIN_GINI, MIN_COVERAGE, MIN_EXPECTANCY = 0.10, 0.05, 0.0
METRIC_TYPES = ("gini double, skill_vs_mean double, coverage double, expectancy_after_cost double, walk_forward_pass boolean, "
                "leakage_checks_pass boolean, baseline_comparison string")


def promotion_gate(manifests: DataFrame, schema_hash: str | Column) -> DataFrame:
    """Adds ``reasons`` and ``ok`` to manifests whose fields are strings and whose metrics are JSON."""
    m = F.from_json("validation_metrics", METRIC_TYPES)
    df = manifests.withColumn("_m", m)
    empty = lambda c: F.col(c).isNull() | F.trim(F.col(c).cast("string")).isin("", "[]", "{}")
    missing = F.array_compact(F.array(*[F.when(empty(c), F.lit(c)) for c in MANIFEST_FIELDS]))
    live = schema_hash if isinstance(schema_hash, Column) else F.lit(schema_hash)
    v = lambda n: F.col(f"_m.{n}")
    # fixed values: reason texts
    reasons = F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("manifest incomplete: "), F.array_join(missing, ","))),
        F.when(~F.col("feature_schema_hash").eqNullSafe(live), "feature schema mismatch"),
        F.when(F.coalesce(v("gini"), v("skill_vs_mean"), F.lit(0.0)) < MIN_GINI, "gini too low"),
        F.when(F.coalesce(v("coverage"), F.lit(0.0)) < MIN_COVERAGE, "coverage too low"),
        F.when(F.coalesce(v("expectancy_after_cost"), F.lit(-1.0)) < MIN_EXPECTANCY, "expectancy after cost < 0"),
        F.when(~F.coalesce(v("walk_forward_pass"), F.lit(False)), "walk-forward did not pass"),
        F.when(~F.coalesce(v("leakage_checks_pass"), F.lit(False)), "leakage checks failed"),
        F.when(v("baseline_comparison").isNull(), "no baseline comparison")))
    out = df.withColumn("reasons", reasons)
    state = F.col("promotion_state")
    return out.withColumns({"ok": F.size("reasons") == 0, "live_ok": F.coalesce(state == "paper-approved", F.lit(False))}).drop("_m")
