"""Policy files and policy rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.ids import text
from .enrich import is_model
from .scan import KEYS, ORDER, keyed
from .skew import salted_join

POLICY_FILE = ".aibom.yml"
LISTS = ("allowed_models", "blocked_models", "allowed_licenses")
RULES = ("blocked_model", "allowed_model_violation", "high_risk_blocked", "missing_license", "license_not_allowed")


def parsed_policy(content: Column) -> Column:
    """``array<struct(key, value, items)>``: one entry per ``key:`` line with the
    list items that follow it. Blank and comment lines are dropped first, then
    the text is cut in front of every key line."""
    lines = F.filter(
        F.transform(F.split(content, "\n"), X.trim), lambda line: X.is_significant(line)
    )
    pieces = F.filter(
        F.split(F.array_join(lines, "\n"), r"(?md)(?=^(?!- )[^\n]*:)"),
        lambda piece: ~piece.startswith("- ") & piece.contains(":"),
    )

    def entry(piece):
        body = F.split(piece, "\n")
        head = F.split(F.get(body, F.lit(0)), ":", 2)
        return F.struct(
            X.trim(F.get(head, F.lit(0))).alias("key"),
            F.btrim(X.trim(F.get(head, F.lit(1))), F.lit("\"'")).alias("value"),
            F.transform(
                F.filter(body, lambda line: line.startswith("- ")),
                lambda line: F.btrim(X.trim(F.substring(line, F.lit(3), F.length(line))), F.lit("\"'")),
            ).alias("items"),
        )

    return F.transform(pieces, entry)


ROOT_YAML = r"^\.[^/]+\.ya?ml$"


def may_be_policy(path: Column) -> Column:
    """Hidden YAML files at the root of the tree: policies have such names."""
    return path.rlike(ROOT_YAML)


def policies(files: DataFrame, policy_file: str = POLICY_FILE) -> DataFrame:
    """One policy per scan, read from the file at the root of the tree only.

    ``path`` is compared before the content is looked at; of a landed table only the
    part with such files is read. A scan without such a
    file has no row. Should a corpus hold the same root path twice for a scan,
    the greatest content wins, so that the result does not depend on the order.
    """
    if "part" in files.columns and re.match(ROOT_YAML, policy_file):
        files = files.filter(F.col("part") == "policy")
    entries = F.col("_entries")

    def items(key):
        return F.flatten(F.transform(F.filter(entries, lambda e: e["key"] == key), lambda e: e["items"]))

    def last(key):
        hits = F.filter(entries, lambda e: e["key"] == key)
        return F.get(F.transform(hits, lambda e: e["value"]), F.size(hits) - 1)

    return (
        keyed(files).filter(F.col("path") == policy_file)
        .groupBy(*KEYS).agg(F.max("content").alias("content"))
        .select(*KEYS, parsed_policy(F.col("content")).alias("_entries"))
        .select(
            *KEYS,
            items("allowed_models").alias("allowed_models"),
            items("blocked_models").alias("blocked_models"),
            text(last("max_risk_level")).alias("max_risk_level"),
            (text(last("block_on_high_risk")) == "true").alias("block_on_high_risk"),
            (text(last("require_licenses")) == "true").alias("require_licenses"),
            items("allowed_licenses").alias("allowed_licenses"),
        )
    )


def blocked_entries(name: Column, version: Column, blocked: Column) -> Column:
    """All matching entries of a block list, duplicates included."""
    low_name, low_version = F.lower(name), F.lower(version)
    return F.filter(blocked, lambda b: F.contains(low_name, F.lower(b)) | F.contains(low_version, F.lower(b)))


def misses_model_list(name: Column, version: Column, ecosystem: Column, allowed: Column) -> Column:
    low_name, low_version = F.lower(name), F.lower(version)
    listed = F.exists(allowed, lambda a: F.contains(low_version, F.lower(a)) | F.contains(low_name, F.lower(a)))
    return (F.size(allowed) > 0) & is_model(name, ecosystem) & ~listed


def misses_license_list(license: Column, allowed: Column) -> Column:
    value = text(license)
    return (F.size(allowed) > 0) & (value != "") & ~F.exists(allowed, lambda a: F.lower(a) == F.lower(value))


def blocks() -> Column:
    """Whether some rule blocks a dependency joined with its policy (all NULL without one)."""
    name, version, ecosystem = F.col("name"), F.col("version"), F.col("ecosystem")
    hit = (F.size(blocked_entries(name, version, F.col("blocked_models"))) > 0) | misses_model_list(
        name, version, ecosystem, F.col("allowed_models")) | (F.col("block_on_high_risk") & (F.col("risk_level") == "High"))
    return F.coalesce(hit, F.lit(False))


def violation_array(policy_file: str = POLICY_FILE) -> Column:
    """All violations of one dependency row joined with its policy, in rule order."""
    name, version, ecosystem = F.col("name"), F.col("version"), F.col("ecosystem")
    high = F.col("risk_level") == "High"

    def violation(rule_no, severity, description):
        return F.struct(
            F.lit(rule_no).alias("rule_no"), F.lit(RULES[rule_no]).alias("rule"),
            F.lit(severity).alias("severity"), description.alias("description"),
            F.col("location").alias("location"),
        )

    def quoted(prefix, value, suffix):
        return F.concat(F.lit(prefix), text(value), F.lit(suffix))

    blocked = F.transform(
        blocked_entries(name, version, F.col("blocked_models")),
        lambda _: violation(0, "Blocker", quoted(
            "Model '", version, f"' is explicitly blocked by {policy_file} policy")),
    )
    single = F.array(
        F.when(misses_model_list(name, version, ecosystem, F.col("allowed_models")), violation(
            1, "Blocker", quoted(
                "Model '", version, f"' is not in the approved model allowlist defined in {policy_file}"))),
        F.when(F.col("block_on_high_risk") & high, violation(
            2, "Blocker", quoted(
                "High-risk dependency '", name, "' blocked by policy (block_on_high_risk: true)"))),
        F.when(F.col("require_licenses") & high & (text(F.col("license")) == ""), violation(
            3, "Warning", quoted(
                "High-risk dependency '", name,
                "' has no license information. Policy requires licenses for all high-risk components."))),
        F.when(misses_license_list(F.col("license"), F.col("allowed_licenses")), violation(
            4, "Warning", F.concat(
                F.lit("License '"), text(F.col("license")), F.lit("' for '"), text(name),
                F.lit("' is not in the approved license list")))),
    )
    return F.filter(F.concat(blocked, single), lambda v: v.isNotNull())


def violations(deps: DataFrame, policy_rows: DataFrame, policy_file: str = POLICY_FILE) -> DataFrame:
    """All rule violations. One pass over the dependencies, all rules at once.

    ``policy_rows`` holds one row per scan (or per project, when it has no commit
    column). The join is salted because one project may own most dependencies.
    """
    keys = [k for k in KEYS if k in policy_rows.columns]
    order = [c for c in ORDER if c in deps.columns]
    spread = order or ["location", "name", "version"]
    joined = salted_join(deps, policy_rows, keys, spread, how="inner")
    return joined.select(
        *KEYS, *order, F.posexplode(violation_array(policy_file)).alias("violation_no", "v")
    ).select(
        *KEYS, *order, "violation_no", "v.rule_no", "v.rule", "v.severity", "v.description", "v.location"
    )
