"""Postures and documents of commits whose files land over several batches.

A commit is complete when as many different files have landed as its rows announce in
``expected_files``. Detectors run on each file as it lands; findings and paths are kept,
contents are not (but for policy files). The batch that completes a commit assembles
its posture and BOM from all its findings, with the operators of the batch report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims as D
from ..functions.storage import materialise
from ..operators import policy, scan
from ..operators.scan import KEYS
from ..plans import documents
from ..plans.scan_report import Branding, report_of_findings
from ..schemas import FILES, FINDING
from .store import BatchStore, bucket_of, buckets_in

LANDED = FILES + ", expected_files int"
_FINDING = FINDING.removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
FOUND = f"project string, commit_sha string, path string, path_key array<string>, {_FINDING}"


class CommitStream:
    """``write`` is a ``foreachBatch`` function over landed files (``project, commit_sha, path, content,
    expected_files``; any row of a commit may announce the number). ``postures`` and
    ``boms`` read what the committed batches have completed.

    A file that lands again is ignored, and so is one of a completed commit. A commit that
    announces no number, or never receives all its files, stays open.
    """

    def __init__(self, spark: SparkSession, target: str, registry: DataFrame | None = None, dims: D.Dictionaries = D.DEFAULT,
                 branding: Branding = Branding(), buckets: int = 64):
        self.registry, self.dims, self.branding, self.buckets = registry, dims, branding, buckets
        keys = "project string, commit_sha string"
        self.store = BatchStore(
            spark, target, {"progress": f"{keys}, landed long, expected int, done boolean"},
            {"files": f"{keys}, path string, content string", "findings": FOUND,
             "postures": f"{keys}, scanned_files long, compliance_status string",
             "boms": f"{keys}, page long, bom_json string"}, buckets)

    def postures(self) -> DataFrame:
        return self.store.read("postures").drop("bucket")

    def boms(self) -> DataFrame:
        return self.store.read("boms").drop("bucket")

    def open_commits(self) -> DataFrame:
        """Commits that wait for files."""
        return self.store.read("progress").filter(~F.col("done")).drop("bucket", "done")

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", bucket_of(*KEYS, buckets=self.buckets))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        store, columns = self.store, [*KEYS, "path", "bucket"]
        landed = self._placed(scan.keyed(batch))
        touched = buckets_in(landed)
        progress = store.read("progress", batch_id, touched)
        # paths only: contents of earlier files are not read
        earlier = store.read("files", batch_id, touched).select(columns)
        fresh = landed.dropDuplicates(columns).join(earlier, columns, "left_anti").join(
            progress.filter("done").select(*KEYS, "bucket"), [*KEYS, "bucket"], "left_anti")
        kept = F.when(policy.may_be_policy(F.col("path")), F.col("content"))
        fresh = materialise(fresh, "landed-files")
        store.stage("files", fresh.select(*KEYS, "path", kept.alias("content"), "bucket"), batch_id)
        found = materialise(self._placed(scan.findings(fresh, self.dims)), "landed-findings")
        store.stage("findings", found, batch_id)

        counts = progress.select(*KEYS, "bucket", "landed", "expected", "done").unionByName(
            fresh.groupBy(*KEYS, "bucket").agg(F.count(F.lit(1)).alias("landed"), F.lit(None).cast("int").alias("expected"),
                                               F.lit(False).alias("done"))).unionByName(
            landed.groupBy(*KEYS, "bucket").agg(F.lit(0).cast("long").alias("landed"), F.max("expected_files").alias("expected"),
                                                F.lit(False).alias("done")))
        state = materialise(counts.groupBy(*KEYS, "bucket").agg(
            F.sum("landed").alias("landed"), F.max("expected").alias("expected"), F.max("done").alias("was_done")).withColumn(
            "done", F.col("was_done") | F.coalesce(F.col("landed") >= F.col("expected"), F.lit(False))), "commit-progress")
        complete = state.filter("done and not was_done").select(*KEYS, "bucket")
        ready = buckets_in(complete)

        def of_complete(name: str, new: DataFrame) -> DataFrame:
            rows = store.read(name, batch_id, ready)
            return rows.unionByName(new.select(rows.columns)).join(complete, [*KEYS, "bucket"], "left_semi").drop("bucket")

        report = report_of_findings(
            of_complete("findings", found), of_complete("files", fresh), self.registry, None, self.dims, self.branding).materialised()
        store.stage("postures", self._placed(report.postures().select(*KEYS, "scanned_files", "compliance_status")), batch_id)
        store.stage("boms", self._placed(documents.bom_json(report).select(*KEYS, "page", "bom_json")), batch_id)
        store.stage("progress", state.select(*KEYS, "landed", "expected", "done", "bucket"), batch_id)
        store.commit(batch_id, {"progress": touched})
