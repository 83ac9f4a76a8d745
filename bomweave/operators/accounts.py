"""Billing events and API keys, folded into account state.

The account table changes with every event, in event order. Instead of replaying
the events of an account in one task, the fold is expressed with aggregates and
running values in measured ranges (``skew.running``):

* a checkout makes the account ``pro`` and names its customer;
* the first cancellation of that customer after a checkout removes the account,
  unless the user's next checkout comes first;
* after the last removal, the state is a handful of ``max_by`` / ``min_by``
  aggregates over the remaining events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import absent, key_hash
from .skew import running, salted_join

CHECKOUT = "checkout.session.completed"
CANCELLED = "customer.subscription.deleted"
PAYMENT_FAILED = "invoice.payment_failed"
KEY_GENERATE, KEY_ROTATE = "key.generate", "key.rotate"
MAX_PAYMENT_ATTEMPTS = 3
PRO, FREE = "pro", "free"
STEP = ["received_at", "event_id"]


def intake(events: DataFrame) -> DataFrame:
    """First delivery of every event id. ``min`` over a struct is combined
    map-side, so many copies of one event cost nothing in the shuffle."""
    others = [c for c in events.columns if c not in ("event_id", "received_at")]
    first = F.min(F.struct("received_at", *others)).alias("_first")
    return events.groupBy("event_id").agg(first).select("event_id", "_first.*").select(*events.columns)


def checkouts(events: DataFrame) -> DataFrame:
    """Provisioning checkouts; those without a user are skipped."""
    user = F.col("user_id")
    return events.filter(
        (F.col("event_type") == CHECKOUT) & user.isNotNull() & (user.cast("string") != "")
    ).select("user_id", "customer_id", *STEP)


def cancellations(events: DataFrame) -> DataFrame:
    """Events that remove a customer's account."""
    kind = F.col("event_type")
    removes = (kind == CANCELLED) | (
        (kind == PAYMENT_FAILED) & (F.col("attempt_count") >= MAX_PAYMENT_ATTEMPTS)
    )
    return events.filter(removes & absent(F.col("customer_id")).isNotNull()).select("customer_id", *STEP)


def key_requests(events: DataFrame) -> DataFrame:
    """Key generations and rotations; ``token_hash`` comes in as data."""
    if "token_hash" not in events.columns:
        events = events.withColumn("token_hash", F.lit(None).cast("string"))
    return events.filter(F.col("event_type").isin(KEY_GENERATE, KEY_ROTATE)).select(
        "user_id", "event_type", "token_hash", *STEP
    )


def removals(events: DataFrame) -> DataFrame:
    """``user_id, removed``: the step (time, event) of every effective removal.

    Looked up from the checkouts: the next cancellation of the customer removes
    the account, unless the user's next checkout comes first. Both are running
    minima from the end, so customers are never paired with their cancellations.
    """
    step = F.struct(*STEP)
    opened = checkouts(events)
    unset = F.lit(None).cast(opened.select(step.alias("s")).schema["s"].dataType)
    by_customer = opened.select("customer_id", "user_id", *STEP, unset.alias("cancel")).unionByName(
        cancellations(events).select(
            "customer_id", F.lit(None).cast(opened.schema["user_id"].dataType).alias("user_id"), *STEP,
            step.alias("cancel"),
        )
    )
    ahead = running(
        by_customer, ["customer_id"], STEP, {"removed": (F.col("cancel"), "min")}, exclusive=True, backward=True,
    ).filter(F.col("user_id").isNotNull()).select("user_id", *STEP, "removed")
    placed = running(
        ahead, ["user_id"], STEP, {"next_checkout": (step, "min")}, exclusive=True, backward=True,
    )
    return placed.filter(
        F.col("removed").isNotNull()
        & (F.col("next_checkout").isNull() | (F.col("removed") < F.col("next_checkout")))
    ).select("user_id", "removed")


def account_state(events: DataFrame) -> DataFrame:
    """``api_keys`` after all (deduplicated) events: ``user_id, token_hash,
    subscription_tier, stripe_customer_id``."""
    step = F.struct(*STEP)
    last_removed = removals(events).groupBy("user_id").agg(F.max("removed").alias("removed"))
    actions = checkouts(events).withColumn("event_type", F.lit(CHECKOUT)).withColumn(
        "token_hash", F.lit(None).cast("string")
    ).unionByName(
        key_requests(events).withColumn("customer_id", F.lit(None).cast("string"))
    )
    alive = salted_join(actions, last_removed, ["user_id"], STEP).filter(
        F.col("removed").isNull() | (step > F.col("removed"))
    )

    def of(kind, value):
        return F.when(F.col("event_type") == kind, value)

    state = alive.groupBy("user_id").agg(
        F.max(of(CHECKOUT, F.struct(*STEP, "customer_id"))).alias("checkout"),
        F.max(of(KEY_ROTATE, F.struct(*STEP, "token_hash"))).alias("rotated"),
        F.min(of(KEY_GENERATE, F.struct(*STEP, "token_hash"))).alias("generated"),
    )
    return state.select(
        "user_id",
        F.coalesce("rotated.token_hash", "generated.token_hash").alias("token_hash"),
        F.when(F.col("checkout").isNotNull(), PRO).otherwise(FREE).alias("subscription_tier"),
        F.col("checkout.customer_id").alias("stripe_customer_id"),
    )


def key_outcomes(events: DataFrame) -> DataFrame:
    """Outcome of every key request: ``issued``, ``conflict`` or ``rotated``.

    A generation conflicts when a key request came after the latest removal
    before it: any key request leaves the account with a key.
    """
    step = F.struct(*STEP)
    requests = key_requests(events)
    gone = removals(events)
    step_type = gone.schema["removed"].dataType
    timeline = requests.select(
        "user_id", "event_type", *STEP, step.alias("asked"), F.lit(None).cast(step_type).alias("removed")
    ).unionByName(gone.select(
        "user_id", F.lit(None).cast("string").alias("event_type"), "removed.received_at", "removed.event_id",
        F.lit(None).cast(step_type).alias("asked"), "removed",
    ))
    seen = running(
        timeline, ["user_id"], STEP,
        {"last_asked": (F.col("asked"), "max"), "last_removed": (F.col("removed"), "max")}, exclusive=True,
    ).filter(F.col("event_type").isNotNull())
    has_key = F.col("last_asked").isNotNull() & (
        F.col("last_removed").isNull() | (F.col("last_asked") > F.col("last_removed"))
    )
    return seen.select(
        "user_id", "event_id", "received_at", "event_type",
        F.when(F.col("event_type") == KEY_ROTATE, "rotated")
        .when(has_key, "conflict").otherwise("issued").alias("outcome"),
    )


# --- keyed merges -------------------------------------------------------------


def merge_accounts(current: DataFrame, changes: DataFrame, key: str = "user_id",
                   defaults: dict | None = None) -> DataFrame:
    """Upsert on ``key``: every non-NULL column of ``changes`` wins, all other
    columns keep the current value. Unknown keys are inserted with ``defaults``
    for the columns the change does not name."""
    columns = [c for c in current.columns if c != key]
    if defaults is None:
        defaults = {"subscription_tier": FREE, "scans_this_month": 0}
    known = current.withColumn("_known", F.lit(True))
    new = changes.select(key, *[
        (F.col(c) if c in changes.columns else F.lit(None)).alias(f"_new_{c}") for c in columns
    ])
    merged = known.join(new, key, "full_outer")

    def value(c):
        kept = F.coalesce(f"_new_{c}", c)
        if c not in defaults:
            return kept.alias(c)
        return F.when(F.col("_known").isNull(), F.coalesce(kept, F.lit(defaults[c]))).otherwise(kept).alias(c)

    return merged.select(key, *[value(c) for c in columns])


def verify_checkouts(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Outcome of every checkout check. ``requests``: ``user_id, session_id``;
    ``sessions``: ``session_id, session_user_id, status, customer_id``.

    A session of another user is forbidden; an unknown session is unavailable; a
    session that is not complete leaves the caller on the free tier.
    """
    outcome = (
        F.when(F.col("status").isNull(), "unavailable")
        .when(~F.col("session_user_id").eqNullSafe(F.col("user_id")), "forbidden")
        .when(F.col("status") == "complete", PRO)
        .otherwise(FREE)
    )
    return requests.join(sessions, "session_id", "left").select(
        "session_id", "user_id", outcome.alias("outcome"), "customer_id"
    )


def checkout_changes(verified: DataFrame) -> DataFrame:
    """Account changes of the verified checkouts, one per user."""
    return verified.filter(F.col("outcome") == PRO).groupBy("user_id").agg(
        F.max(F.struct("session_id", "customer_id")).alias("_last")
    ).select(
        "user_id", F.col("_last.customer_id").alias("stripe_customer_id"),
        F.lit(PRO).alias("subscription_tier"),
    )


def hashed_at_rest(keys: DataFrame) -> DataFrame:
    """Replace the plain token by its hash; hashes already there are kept."""
    return keys.withColumn(
        "token_hash", F.coalesce(F.col("token_hash"), key_hash(F.col("token")))
    ).drop("token")


def resolved_keys(requests: DataFrame, api_keys: DataFrame, key_column: str = "api_key") -> DataFrame:
    """Requests with the account of their key; unknown or empty keys drop out.

    ``requests`` should be light (ids and keys): it is shuffled by key.
    """
    accounts = api_keys.filter(F.col("token_hash").isNotNull()).select(
        "token_hash", F.col("user_id"),
        F.coalesce("subscription_tier", F.lit(FREE)).alias("tier"),
        F.coalesce("scans_this_month", F.lit(0)).alias("scans_this_month"),
    )
    asked = requests.filter(absent(F.col(key_column)).isNotNull()).withColumn(
        "token_hash", key_hash(F.col(key_column)))
    # One key may send most of the requests.
    return salted_join(asked, accounts, ["token_hash"], requests.columns, how="inner")


def account_view(users: DataFrame, api_keys: DataFrame) -> DataFrame:
    """``user_id, tier, has_key`` for every user, with or without an account."""
    return users.join(api_keys.select("user_id", "subscription_tier", "token_hash"), "user_id", "left").select(
        "user_id", tier_or_free(F.col("subscription_tier")).alias("tier"),
        (F.coalesce(F.col("token_hash"), F.lit("")) != "").alias("has_key"),
    )


def tier_or_free(tier: Column) -> Column:
    return F.coalesce(absent(tier), F.lit(FREE))
