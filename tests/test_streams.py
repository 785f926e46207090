"""Streams fed in several micro-batches against their batch twins."""

from pyspark.sql import functions as F

from barloom.checks import streams as S
from barloom.streaming import jobs as J


def test_restart_goes_on_from_the_checkpoint(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.hour("ts").alias("hour"), "ts")
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for p in (F.col("hour") < 14, F.col("hour") >= 10):  # both parts hold the hours from 10 to 13
        src.filter(p).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(src.schema).parquet(path)
        done = J.run_to_files(J.stream_dedupe(stream, ["user_id", "hour"], delay="40 days"), "r", out, state)
    assert sorted(map(tuple, done.select("user_id", "hour").collect())) == sorted(map(tuple, src.select("user_id", "hour").distinct().collect()))


def test_trend_join_prefers_the_same_bar(spark, sf):
    out = S.checks.queries["st7_stream_trend"](spark, sf).collect()
    assert {r["age"] for r in out} <= {0, 1}
    assert all((r["age"] == 0) == (r["ts"].hour % 3 != 2) for r in out if r["age"] == 0)
