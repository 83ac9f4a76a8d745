"""Aggregates over dependencies, cost findings and violations.

All are counts, flags and minima, so Spark combines them map-side: a hot project
reaches the shuffle as one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import text
from .scan import KEYS

PASSED = "Passed"
ACTION_REQUIRED = "Action Required (Annex IV Documentation Missing)"
BLOCKED = "Blocked by Policy"
SECRET = "Exposed Secret"


def is_high(risk: Column) -> Column:
    return risk == "High"


def has_license() -> Column:
    return text(F.col("license")) != ""


def count_when(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def posture(scans: DataFrame, deps: DataFrame, violation_rows: DataFrame | None = None) -> DataFrame:
    """``compliance_status`` per scan. ``scans`` lists every scan, so one without
    findings still gets its row. Only two flags per scan are joined."""
    risk = deps.groupBy(*KEYS).agg(F.max(is_high(F.col("risk_level"))).alias("_high"))
    out = scans.join(risk, KEYS, "left")
    if violation_rows is None:
        out = out.withColumn("_blocked", F.lit(False))
    else:
        blocked = violation_rows.groupBy(*KEYS).agg(F.max(F.col("severity") == "Blocker").alias("_blocked"))
        out = out.join(blocked, KEYS, "left")
    return out.withColumn("compliance_status", status(F.col("_high"), F.col("_blocked"))).drop("_high", "_blocked")


def status(any_high: Column, any_blocker: Column) -> Column:
    return (
        F.when(F.coalesce(any_blocker, F.lit(False)), BLOCKED)
        .when(F.coalesce(any_high, F.lit(False)), ACTION_REQUIRED)
        .otherwise(PASSED)
    )


def gate(postures: DataFrame) -> DataFrame:
    """Pass or fail of a build, and the exit code it gives."""
    ok = F.col("compliance_status") == PASSED
    return postures.withColumn("gate_passed", ok).withColumn("exit_code", F.when(ok, 0).otherwise(1))


def with_run_context(scans: DataFrame, runs: DataFrame) -> DataFrame:
    """Project and commit from the build context, where it gives them.

    ``runs``: ``project, ci_project, ci_commit_sha``, one row per project.
    """
    return (
        scans.join(runs, "project", "left")
        .withColumn("project", F.coalesce(F.nullif("ci_project", F.lit("")), "project"))
        .withColumn("commit_sha", F.coalesce(F.nullif("ci_commit_sha", F.lit("")), "commit_sha"))
        .drop("ci_project", "ci_commit_sha")
    )


def by_ecosystem(deps: DataFrame) -> DataFrame:
    """Dependencies per ecosystem with risk counts."""
    high = is_high(F.col("risk_level"))
    return deps.groupBy(*KEYS, "ecosystem").agg(
        F.count(F.lit(1)).alias("components"),
        count_when(high).alias("high_risk"),
        F.min("name").alias("first_name"),
        F.max("name").alias("last_name"),
    )


def licensing_summary(deps: DataFrame) -> DataFrame:
    """A High-risk component counts as unlicensed only when it has no license."""
    return deps.groupBy(*KEYS).agg(
        count_when(has_license()).alias("licensed"),
        F.count(F.lit(1)).alias("components"),
        count_when(~has_license() & is_high(F.col("risk_level"))).alias("unlicensed_high_risk"),
    )


def license_distribution(deps: DataFrame) -> DataFrame:
    return deps.filter(has_license()).groupBy(*KEYS, "license").agg(F.count(F.lit(1)).alias("components"))


def risk_register(deps: DataFrame) -> DataFrame:
    """The rows of the register: High-risk components other than secrets."""
    return deps.filter(is_high(F.col("risk_level")) & (F.col("name") != SECRET))


def exposed_secrets(deps: DataFrame) -> DataFrame:
    return deps.groupBy(*KEYS).agg(count_when(F.col("name") == SECRET).alias("exposed_secrets"))


def violations_by_severity(violation_rows: DataFrame) -> DataFrame:
    blocker = F.col("severity") == "Blocker"
    return violation_rows.groupBy(*KEYS).agg(
        count_when(blocker).alias("blockers"), count_when(~blocker).alias("warnings")
    )


def scan_statistics(scans: DataFrame, deps: DataFrame, fins: DataFrame, violation_rows: DataFrame) -> DataFrame:
    """Every per-scan number the documents need, one row per scan.

    A ``compliance_status`` that ``scans`` already has is kept: an uploaded
    document states its own.
    """
    high = is_high(F.col("risk_level"))
    dep_stats = deps.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("components"),
        count_when(has_license()).alias("licensed"),
        count_when(~has_license() & high).alias("unlicensed_high_risk"),
        count_when(high & (F.col("name") != SECRET)).alias("register_rows"),
        count_when(F.col("name") == SECRET).alias("exposed_secrets"),
        F.max(high).alias("_high"),
    )
    fin_stats = fins.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("cost_findings"))
    blocker = F.col("severity") == "Blocker"
    vio_stats = violation_rows.groupBy(*KEYS).agg(
        count_when(blocker).alias("blockers"), count_when(~blocker).alias("warnings")
    )
    counts = ["components", "licensed", "unlicensed_high_risk", "register_rows", "exposed_secrets",
              "cost_findings", "blockers", "warnings"]
    out = scans.join(dep_stats, KEYS, "left").join(fin_stats, KEYS, "left").join(vio_stats, KEYS, "left")
    if "compliance_status" not in scans.columns:
        out = out.withColumn("compliance_status", status(F.col("_high"), F.col("blockers") > 0))
    return out.drop("_high").fillna(0, counts)


# --- row classifications -----------------------------------------------------


def risk_badge(risk: Column) -> Column:
    return F.when(risk == "High", "HIGH RISK (EU AI Act)").when(risk == "Medium", "MEDIUM").otherwise("LOW")


def component_type(name: Column, ecosystem: Column) -> Column:
    return (
        F.when(ecosystem.startswith("Model Weight") | ecosystem.startswith("Container Image"),
               "machine-learning-model")
        .when(name == SECRET, "data")
        .otherwise("library")
    )


def package_url(name: Column, version: Column, ecosystem: Column) -> Column:
    """NULL where there is none. The order of the tests matters: a library that a
    container installs with pip is a pypi package."""
    def at(prefix):
        return F.concat(F.lit(prefix), text(name), F.lit("@"), text(version))

    return (
        F.when(ecosystem.contains("pip") | ecosystem.contains("Poetry"), at("pkg:pypi/"))
        .when(ecosystem.contains("npm"), at("pkg:npm/"))
        .when(ecosystem.contains("Go"), at("pkg:golang/"))
        .when(ecosystem.contains("Dockerfile"), F.concat(F.lit("pkg:docker/"), text(name)))
    )
