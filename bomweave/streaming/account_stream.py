"""Account state and key outcomes from a stream of events, batch after batch.

Two keyed tables: accounts by user, and the users that ever checked out as a customer.
A cancellation names a customer only; the second table routes it to the users whose
accounts it may remove. A batch reads and rewrites the buckets of the users that it
touches, and folds their accounts with its events by the batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..operators import accounts
from .seen import SeenIds
from .store import BatchStore, bucket_of, buckets_in

STATE = "user_id {user}, token_hash string, subscription_tier string, stripe_customer_id string"
FROM_STATE = "\0"  # in front of the ids of events that stand for earlier state
LONG_AGO = -62_135_596_800  # the first second of year 1


def compacted(state: DataFrame) -> DataFrame:
    """Account state as the (at most two) events that would produce it."""
    def event(kind, tag, token):
        return (
            F.concat(F.lit(FROM_STATE + tag), F.col("user_id").cast("string")).alias("event_id"), F.lit(kind).alias("event_type"),
            "user_id", F.col("stripe_customer_id").alias("customer_id"),
            F.lit(None).cast("bigint").alias("attempt_count"), F.timestamp_seconds(F.lit(LONG_AGO)).alias("received_at"),
            token.alias("token_hash"),
        )

    paid = state.filter(F.col("subscription_tier") == accounts.PRO)
    keyed = state.filter(F.col("token_hash").isNotNull() | (F.col("subscription_tier") != accounts.PRO))
    return paid.select(*event(accounts.CHECKOUT, "0:", F.lit(None).cast("string"))).unionByName(
        keyed.select(*event(accounts.KEY_ROTATE, "1:", F.col("token_hash"))))


class AccountStream:
    """``write`` is a ``foreachBatch`` function over events (``event_id, event_type, user_id,
    customer_id, attempt_count, received_at, token_hash``). Batches follow each other; inside a batch
    events go by time. Replayed events are dropped however old they are."""

    def __init__(self, spark: SparkSession, target: str, user_type: str = "bigint", buckets: int = 64):
        self.buckets, self.target = buckets, target
        self.seen = SeenIds(spark, f"{target}/seen", buckets=buckets)
        outcome = f"user_id {user_type}, event_id string, received_at timestamp, event_type string, outcome string"
        self.store = BatchStore(
            spark, target, {"accounts": STATE.format(user=user_type), "customers": f"customer_id string, user_id {user_type}"},
            {"outcomes": outcome}, buckets)

    def state(self) -> DataFrame:
        """``api_keys`` after the last batch."""
        return self.store.read("accounts").drop("bucket")

    def outcomes(self) -> DataFrame:
        """Outcomes of all key requests so far."""
        return self.store.read("outcomes").drop("bucket")

    def _placed(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.withColumn("bucket", bucket_of(key, buckets=self.buckets))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        events = self.seen.first_deliveries(batch, batch_id)
        opened = self._placed(accounts.checkouts(events).select("customer_id", "user_id").distinct(), "customer_id")
        gone = self._placed(accounts.cancellations(events).select("customer_id").distinct(), "customer_id")
        named = buckets_in(opened)
        routes = self.store.read("customers", batch_id, sorted({*named, *buckets_in(gone)}))
        users = accounts.key_requests(events).select("user_id").unionByName(opened.select("user_id")).unionByName(
            routes.join(gone, ["bucket", "customer_id"], "left_semi").select("user_id"))
        touched = buckets_in(self._placed(users, "user_id"))

        before = compacted(self.store.read("accounts", batch_id, touched))
        known = materialise(before.unionByName(events.select(before.columns)), "account-events")
        self.store.stage("accounts", self._placed(accounts.account_state(known), "user_id"), batch_id)
        answers = accounts.key_outcomes(known).filter(~F.col("event_id").startswith(FROM_STATE))
        columns = ["user_id", "event_id", "received_at", "event_type", "outcome"]
        self.store.stage("outcomes", self._placed(answers.select(columns), "user_id"), batch_id)
        whole = routes.filter(F.col("bucket").isin(named)).unionByName(opened).distinct()
        self.store.stage("customers", whole, batch_id)
        self.store.commit(batch_id, {"accounts": touched, "customers": named})
