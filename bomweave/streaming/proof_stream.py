"""Proof intake from a stream of uploads.

Three tables change with a batch: the accepted times that occupy a user's quota, the
projects, and the ledger. They are staged by batch and become visible with one commit, so
a batch that runs again after a failure adds nothing twice and loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..operators import accounts
from ..operators.quota import QUOTA
from ..plans.intake import proof_intake
from ..plans.scan_report import Branding
from ..schemas import PROOF_DRILLS
from .store import BatchStore, bucket_of, buckets_in

PROJECTS = "id string, name string, repository_url string, created_at timestamp"


class ProofStream:
    """``write`` is a ``foreachBatch`` function over uploads (``upload_id, api_key, body, created_at``).
    ``api_keys`` gives the account table as it is when a batch starts.

    Batches are decided one after the other, uploads inside a batch by time: the last accepted times of
    a user, at most the quota, stand for all batches before.
    """

    def __init__(self, spark: SparkSession, target: str, api_keys: Callable[[], DataFrame], user_type: str = "bigint",
                 branding: Branding = Branding(), buckets: int = 64):
        self.api_keys, self.branding, self.buckets = api_keys, branding, buckets
        refused = f"upload_id bigint, user_id {user_type}, tier string, created_at timestamp"
        self.store = BatchStore(spark, target, {"quota": f"user_id {user_type}, created_at timestamp"}, {
            "drills": PROOF_DRILLS, "projects": PROJECTS, "refused": refused}, buckets)

    def ledger(self) -> DataFrame:
        return self.store.read("drills").drop("bucket")

    def projects(self) -> DataFrame:
        return self.store.read("projects").drop("bucket")

    def refused(self) -> DataFrame:
        return self.store.read("refused").drop("bucket")

    def _placed(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.withColumn("bucket", bucket_of(key, buckets=self.buckets))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        store = self.store
        uploads = materialise(batch.select("upload_id", "api_key", "body", "created_at"), "uploads")
        keys = materialise(self.api_keys(), "api-keys")
        users = accounts.resolved_keys(uploads.select("upload_id", "api_key"), keys).select("user_id")
        touched = buckets_in(self._placed(users, "user_id"))
        held = store.read("quota", batch_id, touched).drop("bucket")
        done = proof_intake(uploads, keys, store.read("projects", batch_id).drop("bucket"),
                            held.withColumn("upload_id", F.lit(None).cast("bigint")), self.branding)

        newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"))
        times = held.unionByName(done.decided.filter("accepted").select("user_id", "created_at"))
        times = times.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= QUOTA).drop("n")
        store.stage("quota", self._placed(times, "user_id"), batch_id)
        store.stage("projects", self._placed(done.new_projects, "name"), batch_id)
        store.stage("refused", self._placed(done.refused.select("upload_id", "user_id", "tier", "created_at"), "user_id"), batch_id)
        store.stage("drills", self._placed(done.drills, "crypto_hash"), batch_id)
        store.commit(batch_id, {"quota": touched})
