"""Small reference inputs: instruments, zones, gap days, trades, forecasts, ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.operators.clean import resolve
from barloom.sources.headers import read_by_header

# fixed values: column names of the instrument master
INSTRUMENT_COLUMNS = {"exchange": "SEM_EXM_EXCH_ID", "segment": "SEM_SEGMENT", "instrument": "SEM_INSTRUMENT_NAME",
                      "trading_symbol": "SEM_TRADING_SYMBOL", "security_id": "SEM_SMST_SECURITY_ID"}
# fixed values: accepted names of the trade columns
TIME_NAMES = ["exit_time", "time", "timestamp", "date", "close_time"]
PNL_NAMES = ["pnl", "pnl_net", "net", "profit", "pnl_rs"]


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    """Five string columns of a wide master file; the scan reads no others."""
    raw = spark.read.option("header", True).csv(path)
    picked = {out: resolve(raw, [name]) for out, name in INSTRUMENT_COLUMNS.items()}
    lost = [INSTRUMENT_COLUMNS[k] for k, v in picked.items() if v is None]
    if lost:
        raise ValueError(f"missing columns {lost} in {path}")
    return raw.select(*[F.col(v).alias(k) for k, v in picked.items()])


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Price zones per (symbol, date). ``zone_no`` keeps the order of formation within a date."""
    return _typed(spark, path, {"date": "date", "ob_type": "string", "ob_time": "string", "ob_body_high": "double", "ob_body_low": "double",
                                "ob_high": "double", "ob_low": "double"})


def _typed(spark: SparkSession, path: str, kinds: dict[str, str]) -> DataFrame:
    """(symbol, session_date, ...) of files that are read by their own headers; a file that lacks a column is left out."""
    raw = read_by_header(spark, path, {c: [c] for c in ("symbol", *kinds)}, ["symbol", *kinds])
    return raw.select(F.upper("symbol").alias("symbol"), *[F.col(c).try_cast(t).alias("session_date" if c == "date" else c) for c, t in kinds.items()])


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """Gap days, unique on (symbol, date)."""
    return _typed(spark, path, {"date": "date", "prev_close": "double", "today_open": "double", "gap_pct": "double", "gap_dir": "string", "daily_atr": "double"})


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """Trades with a time and a P&L column under any of their usual names."""
    return name_trades(spark.read.option("header", True).csv(path))


def name_trades(raw: DataFrame) -> DataFrame:
    """Adds typed ``exit_time`` and ``pnl``; rows whose time does not parse are dropped."""
    pnl, time = resolve(raw, PNL_NAMES), resolve(raw, TIME_NAMES)
    if pnl is None or time is None:
        raise ValueError(f"need one of {PNL_NAMES} and one of {TIME_NAMES}, have {raw.columns}")
    rest = [c for c in raw.columns if c not in (pnl, time)]
    return (raw.select(F.try_to_timestamp(F.col(time)).cast("timestamp_ntz").alias("exit_time"),
                       F.coalesce(F.expr(f"try_cast(`{pnl}` as double)"), F.lit(0.0)).alias("pnl"), *rest)
            .filter("exit_time is not null"))


# fixed values: fields of a direction view and of a volatility forecast
VIEW = "dir int, up_prob double, vol double, exp_ret double, ts string"
VOL = "pred_vol double, baseline double, scale double, regime string"


def forecast_views(text: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a JSON map symbol -> view; the ``_meta`` entry only lends its time to views without one."""
    views = F.from_json(column, f"map<string, struct<{VIEW}>>")
    meta = F.from_json(column, "_meta struct<generated_at: string>")["_meta"]["generated_at"]
    return (text.select(meta.alias("generated_at"), F.explode(views).alias("symbol", "v"))
            .filter("symbol <> '_meta'")
            .select(F.upper("symbol").alias("symbol"), "v.dir", "v.up_prob", "v.vol", "v.exp_ret",
                    F.coalesce("v.ts", "generated_at").alias("ts")))


def read_forecast_views(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Views of JSON documents, one per file, or with ``per_line`` one per line, which Spark can split."""
    return forecast_views(spark.read.text(path, wholetext=not per_line))


def vol_forecasts(text: DataFrame, column: str = "value") -> DataFrame:
    """One row per symbol of a volatility forecast, with its generation time, model and skill."""
    doc = F.from_json(column, "generated_utc string, meta struct<model: string, skill_vs_mean: double>, "
                              f"symbols map<string, struct<{VOL}>>")
    return (text.select(doc.alias("d")).select("d.generated_utc", "d.meta.model", "d.meta.skill_vs_mean",
                                               F.explode("d.symbols").alias("symbol", "s"))
            .select(F.upper("symbol").alias("symbol"), "s.pred_vol", "s.baseline", "s.scale", "s.regime", "generated_utc",
                    "model", "skill_vs_mean"))


def forecast_lines(scales: DataFrame, generated_utc: str, model: str, skill: float, bounds=(0.65, 1.60), shards: int = 64) -> DataFrame:
    """JSON lines of a volatility forecast: each line is a whole document with the symbols of one shard.

    ``vol_forecasts`` reads the lines of one forecast back as one table. Sharding by symbol hash
    keeps a document small: choose ``shards`` so that symbols / shards entries make a document.
    """
    shard = F.pmod(F.xxhash64("symbol"), F.lit(shards))
    entry = F.struct(F.upper("symbol").alias("key"), F.struct("pred_vol", "baseline", "scale", "regime").alias("value"))
    return (scales.groupBy(shard.alias("shard")).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("symbols"))
            .select(F.to_json(F.struct(
                F.lit(generated_utc).alias("generated_utc"),
                F.struct(F.lit(model).alias("model"), F.lit(skill).alias("skill_vs_mean")).alias("meta"),
                F.array(*[F.lit(b) for b in bounds]).alias("scale_bounds"), "symbols")).alias("value")))


# fixed values: fields of a stored ledger row
LEDGER_ROW = ("date string, strategy string, side string, pnl double, r double, outcome string, nifty int, kronos string, "
              "hour int")


def read_ledger(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Rows of ``{"trades": [...]}`` documents; ``seq`` is the position in the array, oldest first.

    A file holds one document, or with ``per_line`` one per line, which Spark can split.
    """
    docs = spark.read.text(path, wholetext=not per_line).select(F.from_json("value", f"trades array<struct<{LEDGER_ROW}>>").alias("d"))
    return docs.select(F.posexplode("d.trades").alias("seq", "t")).select("seq", "t.*")
