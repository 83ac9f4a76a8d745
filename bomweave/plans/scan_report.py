"""From source files to findings, violations and postures, step by step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims as D
from ..functions.storage import materialise
from ..operators import enrich, measures, policy, scan
from ..operators.scan import KEYS
from ..operators.skew import salted_join


@dataclass(frozen=True)
class Branding:
    """Names that appear inside documents. Set them to the names used by an
    earlier tool to get byte-identical documents."""

    product: str = "Bomweave"
    property_prefix: str = "bomweave"
    policy_file: str = policy.POLICY_FILE


@dataclass(frozen=True)
class ScanReport:
    """The flat tables of a scanned corpus."""

    scans: DataFrame          # project, commit_sha, scanned_files
    dependencies: DataFrame   # enriched
    finops: DataFrame
    violations: DataFrame
    branding: Branding = Branding()

    def statistics(self) -> DataFrame:
        return measures.scan_statistics(self.scans, self.dependencies, self.finops, self.violations)

    def postures(self) -> DataFrame:
        return measures.posture(self.scans, self.dependencies, self.violations)

    def materialised(self) -> "ScanReport":
        """Write every table once; the documents read each several times."""
        return ScanReport(
            materialise(self.scans, "scans"), materialise(self.dependencies, "dependencies"),
            materialise(self.finops, "finops"), materialise(self.violations, "violations"), self.branding,
        )


def scan_report(
    files: DataFrame,
    registry: DataFrame | None = None,
    policies: DataFrame | None = None,
    dims: D.Dictionaries = D.DEFAULT,
    branding: Branding = Branding(),
    write_findings: bool = True,
) -> ScanReport:
    """Scan, enrich and evaluate. The findings are written once, because both the
    dependency and the cost branch read them; the files are read once for them,
    once for the path-only file count and once for the root policy files."""
    found = scan.findings(files, dims)
    if write_findings:
        found = materialise(found, "findings")
    return report_of_findings(found, files, registry, policies, dims, branding)


def report_of_findings(
    found: DataFrame,
    files: DataFrame,
    registry: DataFrame | None = None,
    policies: DataFrame | None = None,
    dims: D.Dictionaries = D.DEFAULT,
    branding: Branding = Branding(),
) -> ScanReport:
    """A report from findings at hand. Of ``files`` only the paths and the contents of policy
    files are looked at."""
    deps = enrich.enriched(scan.dependencies(found), registry, dims)
    rules = policies if policies is not None else policy.policies(files, branding.policy_file)
    return ScanReport(
        scans=scan.scanned_files(files),
        dependencies=deps,
        finops=scan.finops(found),
        violations=policy.violations(deps, rules, branding.policy_file),
        branding=branding,
    )


def quick_posture(files: DataFrame, dims: D.Dictionaries = D.DEFAULT) -> DataFrame:
    """Posture without policies in a single pass over the files: the findings are
    never exploded, each file contributes two numbers to a map-side aggregate."""
    tests = scan.kind_tests(F.col("path"), dims)
    dependency_kinds = [k for k in tests if k not in ("kubernetes", "helm", "terraform")]
    high = F.lit(False)
    for kind in dependency_kinds:
        high = high | F.when(tests[kind], F.exists(scan.detector_column(kind, dims), lambda f: f["level"] == "High")).otherwise(False)
    return (
        scan.visible_files(files)
        .groupBy(*KEYS)
        .agg(F.count(F.lit(1)).alias("scanned_files"), F.max(high).alias("_high"))
        .withColumn("compliance_status", measures.status(F.col("_high"), F.lit(False)))
        .drop("_high")
    )


def posture(files: DataFrame, policies: DataFrame | None = None, dims: D.Dictionaries = D.DEFAULT,
            branding: Branding = Branding()) -> DataFrame:
    """``scanned_files`` and ``compliance_status`` per scan with its policy, in one pass over the files.

    Only rules that block decide a posture, and they read name, version, ecosystem and level
    of a finding. So each task keeps the distinct ones of a scan, with its number of files, and
    the policy meets these few rows: no finding is written, no document column is shuffled.
    """
    tests = scan.kind_tests(F.col("path"), dims)
    fields = ("name", "version", "ecosystem", "level")
    none = F.array().cast("array<struct<name:string,version:string,ecosystem:string,level:string>>")
    found = [F.when(tests[kind], F.transform(scan.detector_column(kind, dims), lambda f: F.struct(*[f[x].alias(x) for x in fields])))
             .otherwise(none) for kind in tests if kind not in ("kubernetes", "helm", "terraform")]
    file = F.array(F.struct(*[F.lit(None).cast("string").alias(x) for x in fields]))  # the file itself
    rows = scan.visible_files(files).withColumn("content", F.coalesce("content", F.lit(""))).select(
        *KEYS, F.explode(F.concat(file, *found)).alias("f"))
    cells = materialise(rows.groupBy(*KEYS, *[F.col(f"f.{x}").alias(x) for x in fields]).agg(
        F.count(F.lit(1)).alias("n")).withColumnRenamed("level", "risk_level"), "posture-cells")
    rules = policies if policies is not None else policy.policies(files, branding.policy_file)
    keys = [k for k in KEYS if k in rules.columns]
    judged = salted_join(cells, rules, keys, ["name", "version"]).withColumns({
        "_high": measures.is_high(F.col("risk_level")), "_blocked": policy.blocks()})
    return judged.groupBy(*KEYS).agg(
        F.sum(F.when(F.col("risk_level").isNull(), F.col("n"))).alias("scanned_files"), F.max("_high").alias("_high"),
        F.max("_blocked").alias("_blocked")).select(
        *KEYS, "scanned_files", measures.status(F.col("_high"), F.col("_blocked")).alias("compliance_status"))
