"""Bar files in, bar tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.operators.clean import TS_ALIASES, drop_dead_bars, enough_rows, latest_per_key, to_session_tz
from barloom.sources.headers import FILE, read_by_header

PRICES = ["open", "high", "low", "close"]


def symbol_of_path() -> Column:
    """Upper-cased ``symbol=`` path component if there is one, else the file stem."""
    path = F.col(FILE)
    part = F.regexp_extract(path, r"/symbol=([^/]+)/", 1)
    stem = F.regexp_extract(path, r"([^/]+)\.[A-Za-z]+$", 1)
    return F.upper(F.when(part != "", part).otherwise(stem))


def parse_ts(text: Column, tz: str, naive_tz: str) -> Column:
    """Text with an offset is converted, text without one is read as ``naive_tz``; junk gives null."""
    zoned = F.regexp_like(F.trim(text), F.lit(r"([+-]\d{2}:?\d{2}|Z)$"))
    iso = F.regexp_replace(F.trim(text), r"([+-]\d{2})(\d{2})$", "$1:$2")
    aware = F.from_utc_timestamp(F.to_utc_timestamp(F.try_to_timestamp(iso), F.current_timezone()), tz).cast("timestamp_ntz")
    plain = to_session_tz(F.try_to_timestamp(text).cast("timestamp_ntz"), tz, naive_tz)
    return F.when(zoned, aware).otherwise(plain)


def _read(spark: SparkSession, path: str, tz: str, naive_tz: str) -> DataFrame:
    raw = read_by_header(spark, path, {"ts": TS_ALIASES, **{c: [c] for c in (*PRICES, "volume")}}, ["ts", *PRICES])
    typed = raw.select(symbol_of_path().alias("symbol"), parse_ts(F.col("ts"), tz, naive_tz).alias("ts"), *[F.col(c).try_cast("double").alias(c) for c in PRICES],
                       F.col("volume").try_cast("double").cast("long").alias("volume"))
    return typed.na.drop(subset=["ts", *PRICES]).withColumn("session_date", F.to_date("ts"))


def read_bars(spark: SparkSession, path: str, tz: str = "Asia/Kolkata", skip: tuple[str, ...] = (), min_bars: int = 4,
              naive_tz: str | None = None) -> DataFrame:
    """Directory of bar CSVs, one symbol per file or folder; every file is read by the names of its own header.

    A file without a time or a price column is skipped alone. Bars without volume and symbols with too few bars are left out. Names in ``skip`` match
    in any case. Naive times are on the session clock unless ``naive_tz`` says otherwise.
    """
    df = _read(spark, path, tz, naive_tz or tz).filter("volume > 0")
    if skip:
        df = df.filter(~F.col("symbol").isin([s.upper() for s in skip]))
    return enough_rows(df, ["symbol"], min_bars)


def read_bars_min_history(spark: SparkSession, path: str, slowest: int = 50, atr_len: int = 14, **kw) -> DataFrame:
    """As ``read_bars`` but only complete bars, of symbols with more than slowest + atr_len + 5 of them."""
    df = read_bars(spark, path, min_bars=1, **kw)
    return enough_rows(drop_dead_bars(df), ["symbol"], slowest + atr_len + 6)


def read_bars_any(spark: SparkSession, path: str, tz: str = "UTC", min_rows: int = 40) -> DataFrame:
    """Bars under loose headers: any letter case and order, several names for the time, volume optional, file by file.

    Symbols with several rows on one calendar day are aggregated to days; the others stay as
    they are. The result has ``dow`` (Monday is 0).
    """
    raw = read_by_header(spark, path, {"ts": TS_ALIASES, **{c: [c] for c in (*PRICES, "volume")}}, ["ts", *PRICES])
    volume = F.when(F.col("has_volume"), F.col("volume").try_cast("double")).otherwise(F.lit(0.0))
    df = raw.select(symbol_of_path().alias("symbol"), parse_ts(F.col("ts"), tz, "UTC").alias("ts"),
                    *[F.col(k).try_cast("double").alias(k) for k in PRICES], volume.alias("volume"))
    df = df.na.drop().withColumn("session_date", F.to_date("ts"))
    per_day = df.groupBy("symbol", "session_date").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"))
    # a symbol with one row per day comes out of the same aggregation unchanged
    out = per_day.withColumn("dow", F.weekday("session_date").cast("double")).drop("n")
    return enough_rows(out, ["symbol"], min_rows)


def merge_bars(old: DataFrame, new: DataFrame, keys: list[str] = ["symbol", "ts"]) -> DataFrame:
    """Stored bars plus new ones, the new row wins for a bar present in both."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, keys, ["_src"]).drop("_src")


def merge_counts(old: DataFrame, merged: DataFrame) -> DataFrame:
    """(symbol, added, total) of a merge."""
    before = old.groupBy("symbol").agg(F.count(F.lit(1)).alias("before"))
    after = merged.groupBy("symbol").agg(F.count(F.lit(1)).alias("total"))
    return after.join(before, "symbol", "left").select(
        "symbol", F.greatest(F.col("total") - F.coalesce("before", F.lit(0)), F.lit(0).cast("long")).alias("added"), "total")


def write_bars(bars: DataFrame, root: str, interval: str) -> None:
    """Parquet below interval=/symbol=/year=/month=; only the partitions present are replaced.

    Rows are spread over (symbol, year, month) first, so that a partition gets few files.
    """
    part = ["interval", "symbol", "year", "month"]
    (bars.withColumns({"interval": F.lit(interval), "symbol": F.upper("symbol"), "year": F.year("ts"), "month": F.month("ts")})
     .repartition("symbol", "year", "month").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(root))


def write_csv(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)
