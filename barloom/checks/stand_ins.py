"""Rule sets and derived inputs that several check modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom import catalog
from barloom.operators import levels
from barloom.plans import signals as S
from barloom.spec import AROUND_THE_CLOCK, EntrySpec, ExitSpec

CLOCK = AROUND_THE_CLOCK
# hourly stand-in bars hold about three events each, so the turnover floor is scaled down
ENTRY = EntrySpec(min_turnover_lakhs=0.002, zone_max_stop=0.02, gap_pct=(0.2, 3.0), min_score=6)
EXITS = ExitSpec(price_decimals=None)
LEVELS = levels.LevelSpec(decimals=None)


def zones(spark: SparkSession, d: str) -> DataFrame:
    return levels.order_blocks(catalog.bars(spark, d), CLOCK)


def gaps(spark: SparkSession, d: str) -> DataFrame:
    return levels.gap_days(catalog.bars(spark, d), ENTRY.gap_pct)


def signals(spark: SparkSession, d: str, spec: EntrySpec = ENTRY) -> DataFrame:
    return S.candidate_signals(catalog.bars(spark, d), zones(spark, d), gaps(spark, d), CLOCK, spec, decimals=None,
                               strategies=S.stock_strategies(LEVELS))


def hits(spark: SparkSession, d: str, spec: EntrySpec = ENTRY) -> DataFrame:
    return S.scored_hits(catalog.bars(spark, d), zones(spark, d), gaps(spark, d), CLOCK, spec, decimals=None,
                         strategies=S.stock_strategies(LEVELS))
