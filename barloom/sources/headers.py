"""CSV folders whose files differ in the order, case and number of their columns."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FILE = "file_path"


def _names_one_of(line: Column, names: list[str]) -> Column:
    """The line has a field that is one of ``names``, in any letter case."""
    return F.regexp_like(line, F.lit(r"(?i)(^|,)[\s\x{FEFF}]*\"?\s*(" + "|".join(map(re.escape, names)) + r")\s*\"?\s*(,|$)"))


def read_by_header(spark: SparkSession, path: str, columns: dict[str, list[str]], required: list[str]) -> DataFrame:
    """All files below ``path`` as text columns named by the keys of ``columns``, each file by its own header.

    ``columns`` maps a name to the header names accepted for it, best first. A file whose header lacks a required column is left
    out, files without an optional one have nulls there and false in ``has_<name>``. The headers are found by a scan for lines that name all required columns;
    one row per file, joined on the path; only the distinct headers, a handful of strings, reach the driver.
    """
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
             .select(F.col("_metadata.file_path").alias(FILE), F.rtrim("value", F.lit("\r")).alias("value")))
    is_header = F.lit(True)
    for name in required:
        is_header = is_header & _names_one_of(F.col("value"), columns[name])
    heads = lines.filter(is_header).groupBy(FILE).agg(F.min("value").alias("_head"))
    kinds = [r["_head"] for r in heads.select("_head").distinct().collect()]
    rows = lines.join(heads, FILE).filter("value <> _head AND value <> ''")
    picked = F.lit(None)
    for head in kinds:
        fields = [f.strip().lstrip("\ufeff").strip().lower() for f in next(csv.reader([head]))]
        parsed = F.from_csv("value", ", ".join(f"f{i} string" for i in range(len(fields))))
        at = {name: next((fields.index(n.lower()) for n in accepted if n.lower() in fields), None) for name, accepted in columns.items()}
        text = [(F.lit(None).cast("string") if i is None else F.trim(parsed[f"f{i}"])).alias(name) for name, i in at.items()]
        row = F.struct(*text, *[F.lit(i is not None).alias(f"has_{name}") for name, i in at.items()])
        picked = F.when(F.col("_head") == head, row).otherwise(picked)
    if not kinds:
        return lines.limit(0).select(FILE, *[F.lit(None).cast("string").alias(n) for n in columns], *[F.lit(False).alias(f"has_{n}") for n in columns])
    return rows.select(FILE, picked.alias("_row")).select(FILE, "_row.*")
