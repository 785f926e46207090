"""URL filters: allow and block rules, then empirical-Bayes host reputation.

Outcomes of labelled pages (bad or not) are counted per host. The bad rate of a suffix is shrunk towards the rate of all labelled
pages, that of a registered domain towards its suffix, that of a host towards its domain: at each level a beta prior with
the parent's posterior mean and a concentration fitted to the spread of the level by moments of the beta-binomial. A host is
blocked if the lower bound of its bad rate, the posterior mean less ``z`` standard deviations, exceeds ``limit``.
Hosts without a labelled page get their domain's, suffix's or the overall posterior.

All of it is counting and joining on hosts; html is never read. Counts combine map-side, so a hot host costs one row per task.

Defined results: null urls and urls without ``://`` have empty host and path, fit no rule and are judged by the overall
posterior; repeated labels count as often as they occur; without labels everything that no rule blocks is allowed; empty
tables give empty tables; other columns are kept except those with the name of an output column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.checks.registry import Checks
from barloom.llm.common import stored, table

checks = Checks()

# fixed values: host, path, verdict
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
# public suffixes of two labels; all other suffixes are the last label
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "co.nz", "co.in", "com.br", "com.cn")
Z = 1.64
LIMIT = 0.5
LEVELS = ("suffix", "domain", "host")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; the rules are a projection, longest first."""
    name, verdict = None, None
    for host, path, what in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        name = F.when(fits, host + path) if name is None else name.when(fits, host + path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def host_parts(pages: DataFrame) -> DataFrame:
    """Adds host, path, suffix and domain."""
    host, path = split_url(F.col("url"))
    two = F.substring_index("host", ".", -2)
    suffix = F.when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index("host", ".", -1))
    domain = F.when(two.isin(*LONG_SUFFIXES), F.substring_index("host", ".", -3)).otherwise(two)
    return pages.withColumns({"host": host, "path": path}).withColumns({"suffix": suffix, "domain": domain})


def level(counts: DataFrame) -> DataFrame:
    """Adds m and k: posterior mean and weight of a level from its counts and its parent's means.

    ``counts`` has x, n and ``pm``, the parent's posterior mean. The concentration c solves
    E[(x/n - pm)^2] = pm (1 - pm) (1/n + (1 - 1/n) / (c + 1)), summed over the level with weights n.
    """
    spread = F.col("pm") * (1 - F.col("pm"))
    fit = counts.agg(F.sum(F.col("n") * F.pow(F.col("x") / F.col("n") - F.col("pm"), 2)).alias("s"), F.sum(spread).alias("own"), F.sum(spread * (F.col("n") - 1)).alias("more"))
    rho = F.when(F.col("more") > 0, F.least(F.greatest((F.col("s") - F.col("own")) / F.col("more"), F.lit(0.001)), F.lit(0.9))).otherwise(F.lit(0.5))
    weight = fit.select((1 / rho - 1).alias("c"))
    df = counts.withColumn("c", weight.scalar())
    return df.withColumn("m", (F.col("x") + F.col("c") * F.col("pm")) / (F.col("n") + F.col("c"))).withColumn("k", F.col("n") + F.col("c"))


def posteriors(outcomes: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The overall (m, k) and, per level, (key, m_<level>, k_<level>)."""
    base = outcomes.groupBy("suffix", "domain", "host").agg(F.sum("bad").cast("double").alias("x"), F.count(F.lit(1)).cast("double").alias("n"))
    # every level reads the counts and the level above: written once, a row a host, domain or suffix
    base = stored(base, "hosts")
    # Beta(1, 1) before any outcome
    top = base.agg(((F.coalesce(F.sum("x"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("m"), (F.coalesce(F.sum("n"), F.lit(0.0)) + 2).alias("k"))
    out: dict[str, DataFrame] = {}
    parents = None
    for name, parent in zip(LEVELS, (None, *LEVELS[:-1]), strict=True):
        keys = [name] if parent is None else [name, parent]
        counts = base.groupBy(*keys).agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        counts = counts.withColumn("pm", top.select("m").scalar()) if parents is None else counts.join(parents, parent)
        fitted = stored(level(counts), name)
        parents = fitted.select(name, F.col("m").alias("pm"))
        out[name] = fitted.select(name, F.col("m").alias(f"m_{name}"), F.col("k").alias(f"k_{name}"))
    return top, out


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, z: float = Z, limit: float = LIMIT) -> DataFrame:
    """``pages`` with host, path, rule, bad_rate (posterior mean), bound and verdict. ``outcomes``: url, bad (0 or 1) per labelled page."""
    df = host_parts(pages.drop("host", "path", "rule", "verdict", "bad_rate", "bound", "domain", "suffix"))
    top, levels = posteriors(host_parts(outcomes.select("url", "bad")).filter("host <> ''"))
    # verdicts are made per distinct host and travel back to the pages
    seen = df.select("suffix", "domain", "host").distinct()
    for name in LEVELS:
        seen = seen.join(levels[name], name, "left")
    seen = seen.withColumn("_top", top.select(F.struct("m", "k")).scalar())
    mean = F.coalesce("m_host", "m_domain", "m_suffix", F.col("_top.m"))
    weight = F.coalesce("k_host", "k_domain", "k_suffix", F.col("_top.k"))
    seen = seen.select("host", mean.alias("bad_rate"), (mean - z * F.sqrt(mean * (1 - mean) / (weight + 1))).alias("bound"))
    rule, verdict = rule_columns(rules)
    df = df.withColumns({"rule": rule, "_ruled": verdict}).join(seen, "host", "left")
    return df.withColumn("verdict", F.coalesce("_ruled", F.when(F.col("bound") > limit, "block").otherwise("allow"))).drop("_ruled", "suffix", "domain")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """url and outcome of pages whose document, named by the last number of the path, is labelled: bad if of low quality or toxic."""
    number = F.regexp_extract(split_url(F.col("url"))[1], r"/(\d{1,18})[^/0-9]*/?$", 1)
    marked = labels.select(F.col("doc_id").alias("_doc"), (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int").alias("bad"))
    return pages.select("url", number.try_cast("bigint").alias("_doc")).join(marked, "_doc").select("url", "bad")


def oracle() -> str:
    ruled = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in ruled]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{h}{p}'" for c, (h, p, _) in zip(fits, ruled, strict=True)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, (_, _, v) in zip(fits, ruled, strict=True)) + " END"
    suffixes = ", ".join(f"'{x}'" for x in LONG_SUFFIXES)
    fit = """, {x}c AS (SELECT sum(n * pow(x / n - pm, 2)) AS s, sum(pm * (1 - pm)) AS own, sum(pm * (1 - pm) * (n - 1)) AS more FROM {x}0),
    {x}w AS (SELECT 1 / (CASE WHEN more > 0 THEN least(greatest((s - own) / more, 0.001), 0.9) ELSE 0.5 END) - 1 AS c FROM {x}c),
    {x}1 AS (SELECT *, (x + c * pm) / (n + c) AS m, n + c AS k FROM {x}0, {x}w)"""
    levels = ", s0 AS (SELECT suffix, sum(x) AS x, sum(n) AS n, any_value(top.m) AS pm FROM base, top GROUP BY suffix)" + fit.format(x="s")
    levels += ", d0 AS (SELECT domain, suffix, sum(x) AS x, sum(n) AS n, any_value(pm) AS pm FROM (SELECT base.*, s1.m AS pm FROM base JOIN s1 USING (suffix)) GROUP BY domain, suffix)" + fit.format(x="d")
    levels += ", h0 AS (SELECT host, domain, sum(x) AS x, sum(n) AS n, any_value(pm) AS pm FROM (SELECT base.*, d1.m AS pm FROM base JOIN d1 USING (domain)) GROUP BY host, domain)" + fit.format(x="h")
    return rf"""
    WITH r AS (SELECT page_id, url, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    v AS (SELECT *, string_split(host, '.') AS l FROM u),
    p AS (SELECT page_id, host, path, array_to_string(l[-2:], '.') AS two, CASE WHEN array_to_string(l[-2:], '.') IN ({suffixes}) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
      CASE WHEN array_to_string(l[-2:], '.') IN ({suffixes}) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM v),
    o AS (SELECT suffix, domain, host, CASE WHEN coalesce(quality = 0, false) OR coalesce(toxic = 1, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS bad
      FROM p JOIN labels ON labels.doc_id = try_cast(nullif(regexp_extract(path, '/(\d{{1,18}})[^/0-9]*/?$', 1), '') AS BIGINT) WHERE host <> ''),
    base AS (SELECT suffix, domain, host, sum(bad) AS x, count(*)::DOUBLE AS n FROM o GROUP BY ALL),
    top AS (SELECT (coalesce(sum(x), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m, coalesce(sum(n), 0) + 2 AS k FROM base){levels},
    j AS (SELECT p.*, coalesce(h1.m, d1.m, s1.m, top.m) AS m, coalesce(h1.k, d1.k, s1.k, top.k) AS k FROM p CROSS JOIN top
      LEFT JOIN h1 ON h1.host = p.host LEFT JOIN d1 ON d1.domain = p.domain LEFT JOIN s1 ON s1.suffix = p.suffix)
    SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN m - {Z} * sqrt(m * (1 - m) / (k + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
      round(m, 6) AS bad_rate FROM j"""


@checks.add("op4_host_reputation", oracle())
def op4_host_reputation(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    found = judge(pages, labelled_pages(pages, table(spark, d, "labels")))
    return found.select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"))
