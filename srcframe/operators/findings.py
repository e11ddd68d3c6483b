"""Scanner documents as rows, all findings in one table, and the gate over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from srcframe.functions.json_text import one_object
from srcframe.schemas import CODE_SCAN, DEPENDENCY_SCAN
from srcframe.session import compute_once


def parse_dependency_scan(scans: DataFrame) -> DataFrame:
    """Vulnerability rows of dependency-scanner documents ``(repo, json)``."""
    found = (
        compute_once(scans.select("repo", "json"), _scan=one_object(F.col("json"), DEPENDENCY_SCAN))
        .select("repo", F.explode("_scan.results").alias("r"))
        .select("repo", F.explode("r.packages").alias("p"))
        .select("repo", "p.package", F.explode("p.vulnerabilities").alias("v"))
    )
    return found.select(
        "repo",
        F.coalesce("v.id", F.lit("")).alias("id"),
        F.coalesce("package.name", F.lit("unknown")).alias("package_name"),
        F.coalesce("package.version", F.lit("unknown")).alias("vulnerable_version"),
        F.coalesce("v.summary", F.lit("")).alias("summary"),
        F.col("v.database_specific.severity").alias("severity"),
    )


def parse_code_scan(scans: DataFrame) -> DataFrame:
    """Finding rows of code-scanner documents ``(repo, json)``."""
    read = compute_once(scans.select("repo", "json"), _scan=one_object(F.col("json"), CODE_SCAN))
    found = read.select("repo", F.explode("_scan.results").alias("f"))
    return found.select(
        "repo",
        F.coalesce("f.check_id", F.lit("")).alias("check_id"),
        F.coalesce("f.path", F.lit("")).alias("path"),
        F.coalesce("f.start.line", F.lit(0)).alias("line"),
        F.coalesce("f.extra.message", F.lit("")).alias("message"),
        F.coalesce("f.extra.severity", F.lit("INFO")).alias("severity"),
    )


def threat_assessment(
    dep_vulns: DataFrame, code_vulns: DataFrame, secrets: DataFrame
) -> DataFrame:
    """All findings in one table; ``kind`` tells which, columns of other kinds are null."""
    parts = (
        dep_vulns.withColumn("kind", F.lit("dependency")),
        code_vulns.withColumn("kind", F.lit("code")),
        secrets.withColumn("kind", F.lit("secret")),
    )
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.unionByName(part, allowMissingColumns=True)
    return joined


def finding_summary(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Counts per class and the gate: a repository passes when all counts are zero.

    ``repos`` lists the audited repositories; without it only those with findings are known.
    """
    counts = findings.groupBy("repo").agg(*[
        F.count_if(F.col("kind") == kind).alias(f"{kind}_count")
        for kind in ("dependency", "code", "secret")
    ])
    if repos is not None:
        counts = repos.select("repo").distinct().join(counts, "repo", "left").na.fill(0)
    total = F.col("dependency_count") + F.col("code_count") + F.col("secret_count")
    return counts.withColumn("has_findings", total > 0)
