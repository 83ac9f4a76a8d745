"""The audit ledger: projects, proof rows, lookups and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from .skew import salted_join

HISTORY_ROWS = 25


def upsert_projects(projects: DataFrame, names: DataFrame, created_at) -> DataFrame:
    """Projects with every name of ``names``; known names keep their row.

    Ids are a hash of the name, so retries and concurrent writers agree.
    """
    new = names.select("name").distinct().join(projects.select("name"), "name", "left_anti")
    return projects.unionByName(new.select(
        ids.project_id(F.col("name")).alias("id"), "name",
        F.lit(None).cast("string").alias("repository_url"), F.lit(created_at).cast(
            projects.schema["created_at"].dataType).alias("created_at"),
    ))


def history(drills: DataFrame, projects: DataFrame) -> DataFrame:
    """Ledger rows with their project name. The documents are not read."""
    rows = drills.select("project_id", "user_id", "commit_sha", "crypto_hash", "created_at")
    names = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    return salted_join(rows, names, ["project_id"], ["crypto_hash", "created_at"], how="inner").select("project_name", "user_id", "commit_sha", "crypto_hash", "created_at")


def latest(drills: DataFrame, projects: DataFrame, user_id=None, rows: int = HISTORY_ROWS, since=None) -> DataFrame:
    """Newest ``rows`` of the ledger, of one tenant or of all, with their projects.

    The rows are picked before the join, as every ledger row has its project. ``since``
    is a lower bound for ``created_at``; on a ledger that is partitioned by day only
    the days from then on are read.
    """
    if user_id is not None:
        drills = drills.filter(F.col("user_id") == user_id)
    if since is not None:
        drills = recent_days(drills, since).filter(F.col("created_at") >= F.lit(since))
    newest = drills.orderBy(F.desc("created_at"), "crypto_hash").limit(rows)
    return history(newest, projects).orderBy(F.desc("created_at"), "crypto_hash")


def latest_per_tenant(drills: DataFrame, projects: DataFrame, rows: int = HISTORY_ROWS) -> DataFrame:
    """The history page of every tenant at once. Spark limits each group before
    the shuffle, so a tenant with most of the ledger sends ``rows`` per task; only
    the rows of the pages are joined with their projects."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "crypto_hash")
    picked = drills.select("project_id", "user_id", "commit_sha", "crypto_hash", "created_at").withColumn(
        "position", F.row_number().over(newest)).filter(F.col("position") <= rows)
    names = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    return salted_join(picked, names, ["project_id"], ["crypto_hash", "created_at"], how="inner").select(
        "project_name", "user_id", "commit_sha", "crypto_hash", "created_at", "position")


def recent_days(drills: DataFrame, since) -> DataFrame:
    """Rows of the days from ``since`` on, where the ledger has its day as a column: the
    filter reaches the partitions of a stored ledger."""
    if "created_date" not in drills.columns:
        return drills
    return drills.filter(F.col("created_date") >= F.to_date(F.lit(since)))


def proofs(requests: DataFrame, drills: DataFrame, per_tenant: bool = True) -> DataFrame:
    """Documents for ``requests(crypto_hash[, user_id])``; a hash that another
    tenant owns is not found."""
    keys = ["crypto_hash", "user_id"] if per_tenant else ["crypto_hash"]
    wanted = requests.select(*keys).distinct()
    return drills.select("crypto_hash", "user_id", "annex_iv_markdown").join(wanted, keys, "left_semi")


def proof(drills: DataFrame, crypto_hash: str, user_id: str | None = None) -> DataFrame:
    """The document of one hash (of one tenant). The hash is a constant, so on a stored ledger
    the statistics of its files are compared with it before any of them is read."""
    found = drills.filter(F.col("crypto_hash") == crypto_hash)
    if user_id is not None:
        found = found.filter(F.col("user_id") == user_id)
    return found.select("crypto_hash", "user_id", "annex_iv_markdown")


def verified(drills: DataFrame) -> DataFrame:
    """Recompute every proof hash (an addition: the ledger implies this check)."""
    expected = ids.proof_hash(F.col("commit_sha"), F.col("ai_bom_json"))
    return drills.withColumn("hash_ok", expected == F.col("crypto_hash"))


def view(drills: DataFrame) -> DataFrame:
    """Short hash for display."""
    return drills.withColumn("hash_prefix", F.substring("crypto_hash", 1, 8))


def findings_view(deps: DataFrame) -> DataFrame:
    """Location with its display default."""
    return deps.withColumn("location", F.coalesce(ids.absent(F.col("location")), F.lit("N/A")))
