"""Rolling strategy statistics and the weights derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions import trading as T
from barloom.operators.layout import lay_out, running


def last_n(df: DataFrame, keys: list[str], newest: list[str], n: int) -> DataFrame:
    """The n newest rows per key (or overall).

    Per key this is a row-number limit, which Spark applies inside each task before the
    shuffle, so a key with a large share of the rows ships at most n rows per task.
    """
    order = [F.col(c).desc() for c in newest]
    if not keys:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def label_tag(tag: Column) -> Column:
    """agree, disagree or na. ``disagree`` is tested first, because it contains ``agree``."""
    t = F.lower(F.coalesce(tag, F.lit("")))
    return F.when(t.contains("disagree"), "disagree").when(t.contains("agree"), "agree").otherwise("na")


def hour_of_text(time: Column) -> Column:
    return F.try_element_at(F.split(time, ":"), F.lit(1)).try_cast("int")


def append_ledger(ledger: DataFrame, trades: DataFrame, keep: int | None = None) -> DataFrame:
    """Ledger plus labelled trades; with ``keep`` only the newest rows."""
    new = trades.withColumns({"label": label_tag(F.col("tag")), "hour": F.hour("exit_time")})
    both = ledger.unionByName(new, allowMissingColumns=True)
    return both if keep is None else last_n(both, [], ["exit_time", "trade_id"], keep)


def _stats(p: Column, prefix: str = "") -> list[Column]:
    n = F.count(p)
    wins, gain = F.count(F.when(p > 0, 1)), F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0))
    loss = -F.coalesce(F.sum(F.when(p <= 0, p)), F.lit(0.0))
    pf = (F.when(loss > 0, F.least(gain / F.nullif(loss, F.lit(0.0)), F.lit(999.0))).when(gain > 0, 999.0).otherwise(0.0))
    zero = lambda c: F.when(n > 0, c).otherwise(0.0)
    return [n.alias(f"{prefix}n"), zero(wins / F.nullif(n, F.lit(0)) * 100).alias(f"{prefix}wr"),
            zero(F.sum(p) / F.nullif(n, F.lit(0))).alias(f"{prefix}expectancy"), pf.alias(f"{prefix}pf"),
            F.coalesce(F.sum(p), F.lit(0.0)).alias(f"{prefix}net")]


def ledger_stats(trades: DataFrame, newest: list[str], window: int = 40, trust: int = 12) -> DataFrame:
    """Per strategy over its last trades: overall figures and those by forecast label (agree, na)."""
    recent = last_n(trades, ["strategy"], newest, window).withColumn("label", label_tag(F.col("tag")))
    p = F.col("pnl")
    out = recent.groupBy("strategy").agg(*_stats(p), *_stats(F.when(F.col("label") == "agree", p), "agree_"),
                                         *_stats(F.when(F.col("label") == "na", p), "na_"))
    return out.withColumn("trusted", F.col("n") >= trust)


def strategy_weights(stats: DataFrame, previous: DataFrame | None = None, blend: float = 0.5) -> DataFrame:
    """Smoothed risk weight per strategy; untrusted strategies drift to 1.0."""
    df = stats.withColumn("health", T.health(F.col("trusted"), F.col("expectancy"), F.col("pf"), F.col("wr")))
    df = df.withColumn("target", T.health_weight(F.col("health")))
    if previous is not None:
        df = df.join(previous.select("strategy", F.col("weight").alias("prev")), "strategy", "left")
    else:
        df = df.withColumn("prev", F.lit(None).cast("double"))
    df = df.withColumn("prev", F.coalesce("prev", F.lit(1.0)))
    return df.withColumn("weight", T.smoothed_weight(F.col("prev"), F.col("target"), blend))


def loss_streak(trades: DataFrame, order: list[str], mode: str = "auto", **lanes) -> DataFrame:
    """Adds ``streak``: consecutive results <= 0 up to each trade of its day.

    It is the distance to the last win: running counts and a running maximum, both of which
    add up over lanes, so even a day that holds most trades is not sorted in one task.
    """
    win = F.col("pnl") > 0
    lay = running(lay_out(trades, ["day"], order, mode=mode, **lanes), sums={"_k": F.lit(1)})
    lay = running(lay, maxes={"_w": F.when(win, F.col("_k"))})
    return lay.finish(lay.df.withColumn("streak", (F.col("_k") - F.coalesce("_w", F.lit(0))).cast("long"))).drop("_k", "_w")
