"""Which symbols to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.operators.clean import earliest_per_key
from barloom.operators.layout import one_row


def derivative_underlyings(instruments: DataFrame) -> DataFrame:
    # fixed values: exchange code and instrument kinds of the master file
    is_derivative = (F.upper("exchange") == "NSE") & F.upper("instrument").isin("FUTSTK", "OPTSTK")
    return (instruments.filter(is_derivative)
            .select(F.upper(F.split("trading_symbol", "-")[0]).alias("underlying")).distinct())


def derivative_names(instruments: DataFrame) -> DataFrame:
    """Underlyings that are plain alphanumeric or carry ``&`` or ``-``."""
    u = F.col("underlying")
    return derivative_underlyings(instruments).filter(
        F.regexp_like(u, F.lit("^[A-Za-z0-9]+$")) | u.contains("&") | u.contains("-")).select(u.alias("symbol"))


def fno_universe(instruments: DataFrame, limit: int | None = None) -> DataFrame:
    """Cash equities that are also derivative underlyings; with ``limit`` the first of them by name."""
    cash = instruments.filter((F.upper("exchange") == "NSE") & (F.upper("segment") == "E")
                              & (F.upper("instrument") == "EQUITY"))
    listed = cash.join(derivative_underlyings(instruments),
                       F.upper("trading_symbol") == F.col("underlying"), "left_semi")
    one = earliest_per_key(listed.select("trading_symbol", "security_id"), ["trading_symbol"], ["security_id"])
    if limit is not None:
        one = one.orderBy("trading_symbol").limit(limit)
    return one.select("security_id", F.col("trading_symbol").alias("symbol"))


def validated_list(listed: DataFrame, live: DataFrame, at_least: int | None = None) -> DataFrame:
    """Listed symbols that are still live; with ``at_least`` the whole list when fewer than that are."""
    names = live.select(F.upper("symbol").alias("_live")).distinct()
    if at_least is None:
        return listed.join(names, F.upper("symbol") == F.col("_live"), "left_semi")
    marked = listed.join(names, F.upper("symbol") == F.col("_live"), "left")
    kept = marked.agg(F.count("_live").alias("_kept"))
    few = one_row(kept)["_kept"] < at_least
    return marked.withColumn("_few", few).filter(F.col("_few") | F.col("_live").isNotNull()).drop("_live", "_few")
