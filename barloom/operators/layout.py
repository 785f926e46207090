"""Physical layout of ordered series.

Rolling frames and recursions need the rows of one series in order. Grouping
on the series key alone sends a whole series to one task, which fails as soon
as one series holds a large share of the data. ``lay_out`` therefore picks one
of two layouts after looking at the heaviest key:

* ``keyed``  - one window partition per key, one shuffle;
* ``split``  - rows are range-partitioned on (key, order), so a heavy series is
  cut into lanes of about equal size. The lanes are written to the checkpoint
  folder, because lane numbers must not change when a task is retried. Each
  lane then receives copies of the neighbouring rows its frames reach into
  (``back`` before it, ``ahead`` after it), so every frame sees exactly the rows it
  would see in the keyed layout. The copies are dropped by ``finish``.

Only the first and the last key of a lane can continue in another lane, so
the table of lane boundaries has at most two rows per lane whatever the data
holds; that bound is what makes broadcasting it safe.
"""

from __future__ import annotations

import math
import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

LANE, BASE, HALO, TOTAL = "_lane", "_base", "_halo", "_total"
HEAVY_ROWS = 4_000_000


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a private one only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="barloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    import uuid

    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and fixes nondeterministic columns."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    return df.checkpoint(eager=True)


@dataclass
class Layout:
    df: DataFrame
    keys: list[str]
    order: list[str]
    split: bool = False
    edges: DataFrame | None = None

    @property
    def partition(self) -> list[str]:
        return [*self.keys, LANE] if self.split else list(self.keys)

    def window(self):
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    def rows(self, start: int, end: int):
        return self.window().rowsBetween(start, end)

    def position(self) -> Column:
        """1-based position of a row inside its whole series."""
        here = F.row_number().over(self.window()).cast("long")
        return here + F.col(BASE) if self.split else here

    def with_columns(self, **columns: Column) -> "Layout":
        """Add columns that do not read one another (one projection, one analysis)."""
        return Layout(self.df.withColumns(columns), self.keys, self.order, self.split, self.edges)

    def finish(self, df: DataFrame | None = None) -> DataFrame:
        df = self.df if df is None else df
        if not self.split:
            return df
        return df.filter(~F.col(HALO)).drop(LANE, BASE, HALO, TOTAL)


def key_weight(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows of the heaviest key, rows in all); the group-by combines map-side."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else df.agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max("n").alias("top"), F.sum("n").alias("total")).first()
    return int(row["top"] or 0), int(row["total"] or 0)


def one_row(df: DataFrame) -> Column:
    """The single row of an aggregate as a struct column (a scalar subquery, not a join)."""
    return df.select(F.struct(*df.columns)).scalar()


def pick_mode(df: DataFrame, keys: list[str], heavy_rows: int = HEAVY_ROWS) -> str:
    return "split" if key_weight(df, keys)[0] > heavy_rows else "keyed"


def lay_out(df: DataFrame, keys: list[str], order: list[str], back: int = 0, ahead: int = 0,
            mode: str = "auto", heavy_rows: int = HEAVY_ROWS, lanes: int | None = None) -> Layout:
    """Prepare ``df`` for ordered work; ``order`` must be total within a key."""
    total = 0
    if mode == "auto":
        top, total = key_weight(df, keys)
        mode = "split" if top > heavy_rows else "keyed"
    if mode == "keyed":
        return Layout(df, list(keys), list(order))
    if lanes is None:
        parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        lanes = max(parallel, math.ceil(total / max(heavy_rows // 2, 1)))
    return _split(df, list(keys), list(order), back, ahead, lanes)


def _split(df: DataFrame, keys: list[str], order: list[str], back: int, ahead: int, lanes: int) -> Layout:
    ranged = df.repartitionByRange(lanes, *keys, *order).withColumn(LANE, F.spark_partition_id())
    rows = pinned(ranged)
    edges = lane_edges(rows, keys)
    own = (rows.join(F.broadcast(edges.select(*keys, LANE, BASE, TOTAL)), [*keys, LANE], "left")
           .withColumn(BASE, F.greatest(F.coalesce(BASE, F.lit(0)) - F.lit(back), F.lit(0)).cast("long"))
           .withColumn(HALO, F.lit(False)))
    if back or ahead:
        own = own.unionByName(_halo(rows, edges, keys, order, back, ahead, own.columns))
    return Layout(own, keys, order, True, edges)


def lane_edges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Lanes of the series that continue over several lanes: at most two rows per lane.

    ``TOTAL`` is the length of the whole series; it is null on rows of series within one lane.
    """
    sizes = rows.groupBy(*keys, LANE).agg(F.count(F.lit(1)).alias("_n"))
    span = Window.partitionBy(*keys)
    before = span.orderBy(LANE).rowsBetween(Window.unboundedPreceding, -1)
    return (sizes.withColumn(BASE, F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long"))
            .withColumn(TOTAL, F.sum("_n").over(span))
            .withColumn("_lanes", F.count(F.lit(1)).over(span)).filter("_lanes > 1").drop("_lanes"))


def _halo(rows: DataFrame, edges: DataFrame, keys: list[str], order: list[str], back: int, ahead: int,
          columns: list[str]) -> DataFrame:
    lane = Window.partitionBy(*keys, LANE)
    reach = max(back, ahead)
    inside = rows.join(F.broadcast(edges), [*keys, LANE])
    # two row-number limits: Spark prunes each one before its shuffle
    first = (inside.withColumn("_at", F.row_number().over(lane.orderBy(*order)).cast("long"))
             .filter(F.col("_at") <= reach))
    last = (inside.withColumn("_end", F.row_number().over(lane.orderBy(*[F.col(c).desc() for c in order])))
            .filter(F.col("_end") <= reach)
            .withColumn("_at", (F.col("_n") - F.col("_end") + 1).cast("long")).drop("_end")
            .filter(F.col("_at") > reach))
    rim = first.unionByName(last).withColumn("_pos", F.col(BASE) + F.col("_at"))
    plan = edges.groupBy(*keys).agg(F.collect_list(F.struct(F.col(LANE).alias("lane"), F.col(BASE).alias("base"),
                                                            F.col("_n").alias("n"))).alias("_plan"))
    wanted = F.filter("_plan", lambda p: (p["lane"] != F.col(LANE)) & (
        ((p["base"] >= F.col("_pos")) & (p["base"] < F.col("_pos") + back))
        | ((F.col("_pos") > p["base"] + p["n"]) & (F.col("_pos") <= p["base"] + p["n"] + ahead))))
    copies = rim.join(F.broadcast(plan), keys) if keys else rim.withColumn("_plan", one_row(plan)["_plan"])
    copies = copies.withColumn("_to", F.explode(wanted))
    # rows of the series before the first row, copies included, that the lane holds
    start = F.greatest(F.col("_to.base") - F.lit(back), F.lit(0))
    return (copies.withColumn(LANE, F.col("_to.lane")).withColumn(BASE, start.cast("long"))
            .withColumn(HALO, F.lit(True)).select(*columns))


def running(lay: Layout, sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None) -> Layout:
    """Running sums and maxima from the start of each series to the current row.

    In the split layout a lane adds what the earlier lanes of its series hold; those lane
    totals are again at most two rows per lane, because other series need none.
    """
    sums, maxes = sums or {}, maxes or {}
    upto = lay.rows(Window.unboundedPreceding, 0)
    if not lay.split:
        cols = {n: F.sum(x).over(upto) for n, x in sums.items()} | {n: F.max(x).over(upto) for n, x in maxes.items()}
        return lay.with_columns(**cols)
    own = ~F.col(HALO)
    df = lay.df
    for n, x in {**sums, **maxes}.items():
        df = df.withColumn(f"_in_{n}", F.when(own, x))
    heavy = df.filter(own).join(F.broadcast(lay.edges.select(*lay.keys, LANE)), [*lay.keys, LANE])
    totals = heavy.groupBy(*lay.keys, LANE).agg(*[F.sum(f"_in_{n}").alias(f"_of_{n}") for n in sums],
                                                *[F.max(f"_in_{n}").alias(f"_of_{n}") for n in maxes])
    earlier = Window.partitionBy(*lay.keys).orderBy(LANE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*lay.keys, LANE, *[F.sum(f"_of_{n}").over(earlier).alias(f"_by_{n}") for n in sums],
                          *[F.max(f"_of_{n}").over(earlier).alias(f"_by_{n}") for n in maxes])
    df = df.join(F.broadcast(carry), [*lay.keys, LANE], "left")
    for n in sums:
        df = df.withColumn(n, F.sum(f"_in_{n}").over(upto) + F.coalesce(F.col(f"_by_{n}"), F.lit(0)))
    for n in maxes:
        df = df.withColumn(n, F.greatest(F.max(f"_in_{n}").over(upto), F.col(f"_by_{n}")))
    spare = [f"_{k}_{n}" for n in [*sums, *maxes] for k in ("in", "by")]
    return Layout(df.drop(*spare), lay.keys, lay.order, True, lay.edges)
