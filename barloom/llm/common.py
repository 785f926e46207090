"""Helpers that the operators share: column scoping, lazily sliced Arrow batches, stored intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from barloom.operators.layout import scratch_path

# ASCII white space of the word pattern [^\x20\x09-\x0D]+
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 1024


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` once into the shared scratch folder and read it back: lineage ends, retries are cheap.

    ``batch_rows`` bounds the Arrow batches that Python workers get meanwhile: ten thousand whole texts are many times a worker's own memory.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(ARROW_ROWS)
    if batch_rows:
        spark.conf.set(ARROW_ROWS, str(batch_rows if int(before) <= 0 else min(int(before), batch_rows)))
    try:
        df.write.parquet(path)
    finally:
        if batch_rows:
            spark.conf.set(ARROW_ROWS, before)
    return spark.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into small ones, so that Python objects of only a few texts live at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 256) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, rows):
            out = fn(part)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
