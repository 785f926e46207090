"""Backward as-of join: the latest right row at or before each left row.

The right side is folded to one row per time bucket: the ordered array of its values in
the bucket and the last value before it. The left side then needs one equi-join on the
bucket, is never sorted, and a bucket that holds a large share of the left rows can be
split by the adaptive skew join, since its right side is a single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.catalog import micros
from barloom.operators.layout import one_row

DAY = 86_400_000_000


def asof_join(left: DataFrame, right: DataFrame, value: str, by: list[str] = [], default: Column | None = None,
              bucket_micros: int = DAY, same_bucket: bool = False, left_ts: str = "ts", right_ts: str = "ts") -> DataFrame:
    """Adds column ``value`` to ``left``; ``same_bucket`` forbids looking into earlier buckets.

    ``right`` is unique on (by, ts). Its rows per bucket bound the arrays, so the bucket must
    be short against the right side's density (a day of bars by default).
    """
    bucket = lambda ts: F.floor(micros(ts) / F.lit(bucket_micros)).cast("long")
    r = right.select(*by, bucket(right_ts).alias("_b"), micros(right_ts).alias("_t"), F.col(value).alias("_v"))
    folded = r.groupBy(*by, "_b").agg(F.array_sort(F.collect_list(F.struct("_t", "_v"))).alias("_rows"))
    l = left.withColumn("_b", bucket(left_ts)).withColumn("_t", micros(left_ts))
    now = F.try_element_at(F.filter("_rows", lambda x: x["_t"] <= F.col("_t")), F.lit(-1))
    if same_bucket:
        out = l.join(folded, [*by, "_b"], "left").withColumn(value, now["_v"])
    else:
        # every bucket up to the last right row: those without right rows carry the value before them
        w = Window.partitionBy(*by).orderBy("_b")
        last = F.struct(F.element_at("_rows", -1)["_v"].alias("v"))
        chain = folded.withColumns({"_last": last, "_past": F.lag(last).over(w), "_next": F.lead("_b").over(w)})
        gap = F.when(F.col("_next") > F.col("_b") + 1, F.sequence(F.col("_b") + 1, F.col("_next") - 1))
        gaps = chain.select(*by, F.explode(gap).alias("_b"), F.lit(None).cast(folded.schema["_rows"].dataType).alias("_rows"),
                            F.col("_last").alias("_past"))
        every = chain.select(*by, "_b", "_rows", "_past").unionByName(gaps)
        ends = folded.groupBy(*by).agg(F.max("_b").alias("_end"), F.max_by(F.struct(F.element_at("_rows", -1)["_v"].alias("v")), "_b").alias("_final"))
        out = l.join(every, [*by, "_b"], "left")
        if by:
            out = out.join(ends, by, "left")
        else:
            out = out.withColumn("_e", one_row(ends)).withColumns({"_end": F.col("_e._end"), "_final": F.col("_e._final")})
        out = out.withColumn(value, F.when(now.isNotNull(), now["_v"]).when(F.col("_b") > F.col("_end"), F.col("_final.v"))
                             .otherwise(F.col("_past.v")))
    if default is not None:
        out = out.withColumn(value, F.coalesce(F.col(value), default))
    return out.select(*left.columns, value)
