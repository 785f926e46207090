r"""Secret scan with an incremental ledger of blobs.

Every historical version of a text is addressed by its SHA-256. The ledger is a table with one row per scanned blob and
scan: ``blob``, ``rules`` (names with versions) and ``spans``. ``scan`` looks only at pairs of blob and rule version that the ledger
lacks, ``paths`` joins what the ledger knows back to all rows that hold a blob.

Rules are regular expressions of the JVM. Spans come from built-in functions: ``split`` gives the gaps,
``regexp_extract_all`` the matches between them, and their lengths in code points add up to the positions. There is no
user function. A blob is scanned once however many copies there are; the copies meet the findings in a join
of two shuffled tables, which adaptive execution splits where one blob is hot.

Defined results: a null text is the empty blob; repeated rows each get the spans; overlapping spans of different rules all stay;
input columns named like an output column are replaced, others kept. Empty tables give empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.checks.registry import Checks
from barloom.llm.common import stored, table

checks = Checks()

SPANS = "array<struct<start:int,end:int,kind:string,rank:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` with its leftmost matches; a match counts if group ``group`` has ``least`` characters.

    ``hint`` is a cheaper expression that every text with a match fulfils.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1
    hint: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# fixed values: the first three rules are given
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2,
         hint=r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]+", 18, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}", 16),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/= \t\r\n]*-----END [A-Z ]*PRIVATE KEY-----", 60, hint="PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 30, hint=r"eyJ[A-Za-z0-9_-]{8,}\.eyJ"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40, hint="gh[pousr]_"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15, hint="xox[abprs]-"),
)
BASE = ("assign", "access", "hex")


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """Spans of one rule: running sums over the gaps and matches of the text."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    lengths = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    counted = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda m: F.length(m)) if rule.group else F.transform(found, lambda m: F.length(m))
    rows = F.arrays_zip(F.slice(lengths, 1, F.size(found)).alias("gap"), F.transform(found, lambda m: F.length(m)).alias("len"), counted.alias("own"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, r: Column) -> Column:
        start = acc["at"] + r["gap"]
        end = start + r["len"]
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rank).alias("rank"))
        return F.struct(end.alias("at"), F.when(r["own"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(F.regexp_like(text, F.lit(rule.hint or rule.pattern)), F.aggregate(rows, zero, step)["out"]).otherwise(F.array().cast(SPANS))


def addressed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("blob", F.sha2(F.coalesce("text", F.lit("")), 256))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: each unseen pair of blob and rule version is scanned once."""
    names = [r.name for r in rules]
    blobs = docs.select("blob", F.coalesce("text", F.lit("")).alias("text"))
    everything = F.array(*[F.lit(n) for n in names])
    if ledger is None:
        blobs = blobs.withColumn("_todo", everything)
    else:
        # a blob has at most one ledger row per scan, a rule version is scanned once
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("_seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("_todo", F.array_except(everything, F.coalesce("_seen", F.array().cast("array<string>")))).drop("_seen")
        blobs = blobs.filter(F.size("_todo") > 0)
    once = blobs.dropDuplicates(["blob"])
    parts = [F.when(F.array_contains("_todo", r.name), _spans(r, k, F.col("text"))).otherwise(F.array().cast(SPANS)) for k, r in enumerate(rules)]
    return once.select("blob", F.col("_todo").alias("rules"), F.concat(*parts).alias("spans"))


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Blobs with spans of the current rule versions, in order of start and kind."""
    current = ledger.withColumn("_use", F.transform(F.array_intersect("rules", F.array(*[F.lit(r.name) for r in rules])), lambda n: F.split_part(n, F.lit("@"), F.lit(1))))
    live = current.withColumn("spans", F.filter("spans", lambda s: F.array_contains(F.col("_use"), s["kind"]))).filter(F.size("spans") > 0)
    merged = live.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return merged.withColumn("spans", ordered)


def paths(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` with ``spans``; an empty array where its blob is clean.

    Only copies of found blobs carry spans; the findings are stored, so that both sides of the join are
    shuffled tables and a hot blob can be split.
    """
    found = stored(findings(ledger, rules), "findings")
    return docs.drop("spans").join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by ``[kind]``; overlapping spans become one."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def oracle() -> str:
    parts = []
    for rank, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""SELECT rid, '{r.kind}' AS kind, {rank} AS rank, unnest(regexp_extract_all(text, '{p}', {r.group})) AS own, unnest(regexp_extract_all(text, '{p}', 0)) AS m,
        unnest(regexp_split_to_array(text, '{p}')[1:len(regexp_extract_all(text, '{p}', 0))]) AS gap, unnest(range(len(regexp_extract_all(text, '{p}', 0)))) AS i, {r.least} AS least FROM d""")
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    m AS ({' UNION ALL '.join(parts)}),
    s AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM m),
    f AS (SELECT rid, kind, rank, (stop - length(m))::BIGINT AS start, kind || ':' || (stop - length(m))::BIGINT || ':' || stop::BIGINT AS item FROM s WHERE length(own) >= least),
    g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(item, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(item, ',' ORDER BY start, rank) AS spans FROM f GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""


@checks.add("op8_secret_scan", oracle())
def op8_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = addressed(table(spark, d, "documents").select("doc_id", "text"))
    ledger = stored(scan(docs), "ledger")
    out = paths(docs.select("doc_id", "blob"), ledger)
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"))
