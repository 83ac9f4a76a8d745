"""Proof intake: from uploaded BOM documents to ledger rows.

An upload is one row: ``upload_id bigint, api_key, body, created_at``. Decoding,
re-encoding, rendering and hashing are row expressions. Key lookup and quota work
on ids and times; the documents are shuffled once, by upload id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.ids import absent, json_array, json_object, json_string, text
from ..functions.storage import materialise
from ..operators import accounts, quota
from ..schemas import BOM_JSON
from .documents import annex_iv_of_boms
from .scan_report import Branding


def decoded(body: Column) -> Column:
    """BOM struct of a JSON text; unreadable text gives an all-default document."""
    return F.from_json(body, BOM_JSON)


def canonical_json(bom: Column) -> Column:
    """The document re-encoded in fixed field order, as it is hashed and stored.

    Arrays that were missing come out as ``null``, present empty ones as ``[]``.
    """
    def items(name, encode):
        return F.coalesce(json_array(F.transform(bom[name], encode)), F.lit("null"))

    def plain(value):
        return json_string(text(value))

    def optional(value):
        return json_string(absent(value))

    violations = bom["policyViolations"]
    return json_object([
        ("projectName", plain(bom["projectName"])),
        ("commitSha", optional(bom["commitSha"])),
        ("scannedFiles", F.coalesce(bom["scannedFiles"], F.lit(0)).cast("string")),
        ("dependencies", items("dependencies", lambda d: json_object([
            ("name", plain(d["name"])), ("version", plain(d["version"])),
            ("ecosystem", plain(d["ecosystem"])), ("riskLevel", plain(d["riskLevel"])),
            ("description", plain(d["description"])),
            ("location", optional(d["location"])), ("license", optional(d["license"])),
        ]))),
        ("finOps", items("finOps", lambda f: json_object([
            ("resource", plain(f["resource"])), ("severity", plain(f["severity"])),
            ("description", plain(f["description"])), ("location", optional(f["location"])),
        ]))),
        ("policyViolations", F.when(F.size(violations) > 0, json_array(F.transform(
            violations, lambda v: json_object([
                ("rule", plain(v["rule"])), ("severity", plain(v["severity"])),
                ("description", plain(v["description"])), ("location", optional(v["location"])),
            ]))))),
        ("complianceStatus", plain(bom["complianceStatus"])),
    ])


@dataclass(frozen=True)
class Intake:
    """Result of an intake: new ledger rows, projects, those of them that are new, the
    refused uploads, and the decision on every upload with a known key."""

    drills: DataFrame
    projects: DataFrame
    new_projects: DataFrame
    refused: DataFrame
    decided: DataFrame


def proof_intake(
    uploads: DataFrame,
    api_keys: DataFrame,
    projects: DataFrame,
    earlier: DataFrame | None = None,
    branding: Branding = Branding(),
) -> Intake:
    """Resolve the key, apply the quota, decode, upsert the project, render, hash.

    ``earlier`` holds ledger rows before these uploads (``user_id, created_at``,
    the id in ``upload_id``); they occupy quota but are not written again. Within
    a batch the quota is applied in event order, so it is exact.

    Refused bodies are left behind at the scan: the decisions are a written table, which Spark
    broadcasts where it is small, and where it is not, its Bloom filter join drops rows ahead
    of the shuffle (``spark.sql.optimizer.runtime.bloomFilter.enabled``, on by default).
    """
    light = uploads.select("upload_id", "api_key", "created_at")
    tries = accounts.resolved_keys(light, api_keys).select(
        F.col("upload_id").alias("attempt_id"), "user_id", "tier", "created_at", F.lit(False).alias("is_earlier"))
    if earlier is not None:
        # Rows of the ledger were accepted: replay them as always accepted.
        tries = tries.unionByName(earlier.select(
            F.col("upload_id").alias("attempt_id"), "user_id", F.lit("ledger").alias("tier"), "created_at",
            F.lit(True).alias("is_earlier"),
        ))
    decisions = quota.admit(tries).filter(~F.col("is_earlier"))
    decided = materialise(decisions.select(
        F.col("attempt_id").alias("upload_id"), "user_id", "tier", "created_at", "accepted"), "decided")
    accepted = uploads.select("upload_id", "body").join(
        decided.filter("accepted").select("upload_id", "user_id", "created_at"), "upload_id"
    ).select("upload_id", "user_id", "created_at", decoded(F.col("body")).alias("bom"))
    rows = annex_iv_of_boms(accepted.select(
        "upload_id", "user_id", "created_at", "bom", text(F.col("bom.projectName")).alias("name"),
        ids.effective_commit(F.col("bom.commitSha")).alias("commit_sha"),
        canonical_json(F.col("bom")).alias("ai_bom_json"),
    ), "created_at", branding)
    drills = rows.select(
        ids.sha256_hex(F.col("upload_id").cast("string")).alias("id"),
        ids.project_id(F.col("name")).alias("project_id"),
        absent(F.col("user_id").cast("string")).alias("user_id"), "commit_sha", "ai_bom_json",
        F.lit(None).cast("string").alias("risk_register_state"), "annex_iv_markdown",
        ids.proof_hash(F.col("commit_sha"), F.col("ai_bom_json")).alias("crypto_hash"), "created_at",
    )
    names = rows.groupBy("name").agg(F.min("created_at").alias("created_at"))
    fresh = names.join(projects.select("name"), "name", "left_anti").select(
        ids.project_id(F.col("name")).alias("id"), "name",
        F.lit(None).cast("string").alias("repository_url"), "created_at",
    )
    return Intake(drills, projects.unionByName(fresh), fresh, decided.filter(~F.col("accepted")).drop("accepted"), decided)
