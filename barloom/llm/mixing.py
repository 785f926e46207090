"""Mixing sources to target weights by Pfair scheduling.

The documents of a source form blocks of ``BLOCK_DOCS`` documents. The target weights are taken as the exact rationals they are: a source of share w (of a
sum of one) has block i (from 0) released at slot floor(i / w) and due at slot ceil((i + 1) / w); in each slot the earliest deadline among
released blocks is served. As all shares sum to one, every block is served inside its window, so after each slot a source is less
than one block from its share, however long the mixture is. When a source ends, a new phase begins with the weights of the others scaled up; no document
is dropped or repeated.

Only counts per source reach the driver. It makes the schedule, one heap step and three numbers per block, in whole numbers without rounding. Documents are numbered
inside lanes, a lane being a hash of the id, so a source with a third of all rows
spreads over ``lanes`` sort groups; lane offsets come from counts that are combined map-side. The documents are shuffled once.
The schedule travels as arrays of ``CHUNK_BLOCKS`` blocks; it is broadcast only below ``BROADCAST_NUMBERS``, else documents are shuffled once more to meet it.

Defined results: null and empty source are one source; sources without a weight get the mean of the given weights; weights must be positive; null ids come first within
their lane; repeated rows take places of their own; other columns are kept except those named like an output column. An empty table gives an empty
table.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom.checks.registry import Checks
from barloom.llm.common import stored, table

checks = Checks()

BLOCK_DOCS = 64
CHUNK_BLOCKS = 64
LANES = 256
TEMPERATURE = 2.0
BROADCAST_NUMBERS = 4_000_000


def quantised(weights: dict[str, float], period: int) -> dict[str, int]:
    """Slots per period, at least one each, by largest remainder. The mixture does not round its weights; this is for periods of whole numbers."""
    total = sum(weights.values())
    spare = period - len(weights)
    if spare < 0:
        raise ValueError("a period needs a slot per source")
    exact = {s: w / total * spare for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:period - sum(out.values())]:
        out[s] += 1
    return out


def one_period(k: dict[str, int], period: int) -> dict[str, list[int]]:
    """Slots of each source in one period: earliest deadline first among released blocks."""
    slots: dict[str, list[int]] = {s: [] for s in k}
    released: dict[int, list[tuple[int, str, int]]] = {}
    for s, n in k.items():
        for i in range(n):
            released.setdefault(i * period // n, []).append((-(-(i + 1) * period // n), s, i))
    ready: list[tuple[int, str, int]] = []
    for t in range(period):
        for job in released.get(t, ()):
            heapq.heappush(ready, job)
        deadline, s, _ = heapq.heappop(ready)
        if t >= deadline:
            raise AssertionError("a block missed its deadline")
        slots[s].append(t)
    return slots


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, np.ndarray]:
    """Slot, release and deadline (three rows) of every block of every source; a phase ends with the first source that runs out."""
    out = {s: np.zeros((3, n), np.int64) for s, n in blocks.items() if n}
    done, start = dict.fromkeys(out, 0), 0
    while done:
        exact = {s: Fraction(weights[s]) for s in done}
        scale = math.lcm(*(w.denominator for w in exact.values()))
        parts = {s: int(w * scale) for s, w in exact.items()}
        total, first = sum(parts.values()), dict(done)
        # a source waits with its next block (release, source) or is ready with it (deadline, source)
        waiting, ready, t, ended = [(0, s) for s in sorted(done)], [], 0, None
        while ended is None:
            while waiting and waiting[0][0] <= t:
                s = heapq.heappop(waiting)[1]
                heapq.heappush(ready, (-(-(done[s] - first[s] + 1) * total // parts[s]), s))
            deadline, s = heapq.heappop(ready)
            if t >= deadline:
                raise AssertionError("a block missed its deadline")
            i = done[s] - first[s]
            out[s][:, done[s]] = start + t, start + i * total // parts[s], start + deadline
            done[s] += 1
            heapq.heappush(waiting, ((i + 1) * total // parts[s], s))
            t += 1
            if done[s] == blocks[s]:
                ended = s
        del done[ended]
        start += t
    return out


def chunks(plan: dict[str, np.ndarray]) -> pa.Table:
    """The schedule in rows of ``CHUNK_BLOCKS`` blocks."""
    names = ("_slots", "_releases", "_deadlines")
    tables = [pa.table({"_source": pa.array([], pa.string()), "_chunk": pa.array([], pa.int64()), **{n: pa.array([], pa.list_(pa.int64())) for n in names}})]
    for s, own in plan.items():
        at = np.arange(0, own.shape[1], CHUNK_BLOCKS)
        ends = pa.array(np.append(at, own.shape[1]), pa.int32())
        tables.append(pa.table({"_source": pa.array([s] * len(at), pa.string()), "_chunk": pa.array(at // CHUNK_BLOCKS, pa.int64()),
                                **{n: pa.ListArray.from_arrays(ends, pa.array(row)) for n, row in zip(names, own, strict=True)}}))
    return pa.concat_tables(tables)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, lanes: int = LANES,
        source: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with block (in its source), slot, release, deadline (first slot after the window) and position in the mixture.

    Without ``weights`` a source weighs as its count to the power 1 / TEMPERATURE.
    """
    spark = docs.sparkSession
    made = ("block", "slot", "release", "deadline", "position")
    df = docs.drop(*made, "_source", "_lane").withColumns({
        "_source": F.coalesce(F.col(source).cast("string"), F.lit("")), "_lane": F.pmod(F.xxhash64(id_col), F.lit(lanes)).cast("int")})
    sizes = stored(df.groupBy("_source", "_lane").agg(F.count(F.lit(1)).alias("n")), "lanes")
    before = Window.partitionBy("_source").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_source", "_lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    counts = {r["_source"]: r["n"] for r in sizes.groupBy("_source").agg(F.sum("n").alias("n")).collect()}
    given = weights or {s: n ** (1 / TEMPERATURE) for s, n in counts.items()}
    mean = sum(given.values()) / len(given) if given else 1.0
    plan = schedule({s: math.ceil(n / block_docs) for s, n in counts.items()}, {s: given.get(s, mean) for s in counts})
    lookup = spark.createDataFrame(chunks(plan), "_source string, _chunk long, _slots array<long>, _releases array<long>, _deadlines array<long>")
    numbers = sum(own.size for own in plan.values())
    placed = df.withColumn("_row", F.row_number().over(Window.partitionBy("_source", "_lane").orderBy(id_col)) - 1)
    placed = placed.join(offsets, ["_source", "_lane"])
    row = F.col("_row") + F.col("_offset")
    placed = placed.withColumns({"block": F.floor(row / block_docs).cast("long"), "_in": row % block_docs})
    placed = placed.withColumns({"_chunk": F.floor(F.col("block") / CHUNK_BLOCKS).cast("long"), "_at": (F.col("block") % CHUNK_BLOCKS).cast("int")})
    placed = placed.join(F.broadcast(lookup) if numbers <= BROADCAST_NUMBERS else lookup, ["_source", "_chunk"])
    placed = placed.withColumns({"slot": F.col("_slots")[F.col("_at")], "release": F.col("_releases")[F.col("_at")], "deadline": F.col("_deadlines")[F.col("_at")]})
    placed = placed.withColumn("position", (F.col("slot") * block_docs + F.col("_in")).cast("long"))
    return placed.drop("_source", "_lane", "_row", "_offset", "_in", "_chunk", "_at", "_slots", "_releases", "_deadlines")


@checks.add("op7_pfair_mixing")
def op7_pfair_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents").select("doc_id", "source"))
