"""Joins to small keyed tables. Sizes are left to Spark: it broadcasts what its statistics allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.spec import EntrySpec


def with_gap(hits: DataFrame, gaps: DataFrame) -> DataFrame:
    """Adds gap_pct, gap_dir and daily_atr of the session, null without a gap."""
    g = gaps.select("symbol", "session_date", "gap_pct", "gap_dir", "daily_atr")
    return hits.join(g, ["symbol", "session_date"], "left")


def fades_gap(spec: EntrySpec) -> Column:
    """Short after a gap up, long after a gap down, gap size within limits."""
    d = F.col("direction")
    fades = ((d < 0) & (F.col("gap_dir") == "UP")) | ((d > 0) & (F.col("gap_dir") == "DOWN"))
    return F.col("gap_pct").between(*spec.gap_pct) & fades


def join_gap(hits: DataFrame, gaps: DataFrame, spec: EntrySpec) -> DataFrame:
    """Hits that fade a gap of their session."""
    return with_gap(hits, gaps).filter(fades_gap(spec))


def zones_by_session(zones: DataFrame) -> DataFrame:
    """One row per (symbol, session) with its bearish zones in order of formation."""
    zone = F.struct("ob_time", F.col("ob_body_high").alias("hi"), F.col("ob_body_low").alias("lo"))
    return (zones.filter("ob_type = 'BEAR'").groupBy("symbol", "session_date")
            .agg(F.array_sort(F.collect_list(zone)).alias("zones")))


def tight_stop(hi: Column, spec: EntrySpec) -> Column:
    """The stop one tick over the zone lies above the close, and near it."""
    gap = hi + spec.zone_tick - F.col("close")
    return (gap > 0) & (gap / F.col("close") <= spec.zone_max_stop)


def with_zone(hits: DataFrame, zones: DataFrame, spec: EntrySpec, stop_first: bool = False) -> DataFrame:
    """Adds ``zone_hi``, the body top of the first earlier zone that the bar's high reaches.

    ``stop_first`` also tests the stop while searching, so that a later zone may still match.
    """
    now, h = F.date_format("ts", "HH:mm"), F.col("high")

    def reached(z: Column) -> Column:
        ok = (z["ob_time"] < now) & (h >= z["lo"]) & (h <= z["hi"] + spec.zone_slack_atr * F.col("atr"))
        return ok & tight_stop(z["hi"], spec) if stop_first else ok

    found = hits.join(zones_by_session(zones), ["symbol", "session_date"], "left")
    return found.withColumn("zone_hi", F.try_element_at(F.filter("zones", reached), F.lit(1))["hi"]).drop("zones")


def join_zone(hits: DataFrame, zones: DataFrame, spec: EntrySpec, stop_first: bool = False) -> DataFrame:
    """Hits at an earlier bearish zone that leaves a tight stop."""
    return with_zone(hits, zones, spec, stop_first).filter(tight_stop(F.col("zone_hi"), spec))


# fixed values: exit profiles by strategy name (stop in ATR, reward ratio, trail in ATR)
PROFILES = {"CANDLE_STRUCT": (1.6, 2.8, 1.3), "ORB": (1.2, 3.0, 1.1), "OB_SHORTS": (1.3, 2.2, 1.0), "OB SHORTS": (1.3, 2.2, 1.0),
            "GAP_FILL": (1.4, 1.8, 1.2), "GAP-FILL": (1.4, 1.8, 1.2)}


def strategy_profile(strategy: Column, defaults: tuple[float, float, float] = (1.5, 2.0, 1.0),
                     profiles: dict[str, tuple[float, float, float]] = PROFILES) -> Column:
    """Struct (sl_mult, rr, trail_mult) of a strategy name, the defaults for an unknown one.

    A handful of profiles is a literal map, so the lookup costs no join. The profile names do not
    cover the emitted tags OB_SHORT and GAPFILL, which therefore get the defaults; pass other
    ``profiles`` to change that.
    """
    row = lambda v: F.struct(F.lit(v[0]).alias("sl_mult"), F.lit(v[1]).alias("rr"), F.lit(v[2]).alias("trail_mult"))
    table = F.create_map(*[x for k, v in profiles.items() for x in (F.lit(k), row(v))])
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(F.coalesce(strategy, F.lit(""))))), row(defaults))


def forecast_lookup(rows: DataFrame, forecasts: DataFrame, usable: Column) -> DataFrame:
    """Adds ``scale`` per symbol, 1.0 without a usable forecast; ``usable`` reads forecast columns."""
    good = forecasts.filter(usable).select("symbol", "scale")
    return rows.join(good, "symbol", "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))


def sector_join(rows: DataFrame, sectors: DataFrame) -> DataFrame:
    named = sectors.select(F.upper("symbol").alias("_s"), "sector")
    return (rows.join(named, F.upper("symbol") == F.col("_s"), "left").drop("_s")
            .withColumn("sector", F.coalesce("sector", F.lit("UNKNOWN"))))
