"""Rolling usage counts and replay of the free-tier quota."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .skew import running

FREE_TIER = "free"
QUOTA = 10
WINDOW_DAYS = 30


def usage_as_of(ledger: DataFrame, as_of, days: int = WINDOW_DAYS, user="user_id", time="created_at") -> DataFrame:
    """Ledger rows per user in the ``days`` before ``as_of`` (both ends open at the
    old side, as ``created_at > now - interval``). The time filter reaches the scan."""
    now = F.lit(as_of)
    since = now - F.expr(f"INTERVAL {days} DAYS")
    if "created_date" in ledger.columns:  # a stored ledger: reads the days in question only
        ledger = ledger.filter(F.col("created_date").between(F.to_date(since), F.to_date(now)))
    return (
        ledger.filter((F.col(time) > since) & (F.col(time) <= now))
        .groupBy(user).agg(F.count(F.lit(1)).alias("recent"))
    )


def rolling_usage(ledger: DataFrame, days: int = WINDOW_DAYS, user="user_id", time="created_at") -> DataFrame:
    """``recent`` per (user, time): rows of the user in the window that ends there.

    Every row counts +1 when it enters and -1 ``days`` later, when it leaves; the
    rolling count is the running sum. Changes are pre-aggregated per instant, and
    the running sum is cut at measured ranges, so a hot user is not one task.
    """
    enters = ledger.select(user, time, F.lit(1).alias("change"), F.lit(1).alias("attempts"))
    leaves = ledger.select(
        user, (F.col(time) + F.expr(f"INTERVAL {days} DAYS")).alias(time),
        F.lit(-1).alias("change"), F.lit(0).alias("attempts"),
    )
    changes = enters.unionByName(leaves).groupBy(user, time).agg(
        F.sum("change").alias("change"), F.sum("attempts").alias("attempts")
    )
    return (
        running(changes, [user], [time], {"recent": (F.col("change"), "sum")})
        .filter(F.col("attempts") > 0)
        .select(user, time, "attempts", "recent")
    )


def admit(attempts: DataFrame, days: int = WINDOW_DAYS, quota: int = QUOTA) -> DataFrame:
    """``accepted`` per attempt, in order of (created_at, attempt_id).

    An attempt is accepted when its tier is not the free one or when fewer than
    ``quota`` accepted attempts of the user lie in the last ``days``. Refused
    attempts do not count; accepted ones of any tier do. A missing tier is the free
    one, a missing user is a user of its own, ids may repeat, and a free attempt
    without a time is refused. Attempts at the same time with the same id go by tier.

    One shuffle by user and one sort; the sorted rows then stream through a fold whose state
    is the last ``quota`` accepted times of one user. A user's decisions depend on each
    other in order, so they are made by one task. It holds a batch of rows, sorts
    with spilling, and steps over refused attempts by binary search. All columns of
    ``attempts`` take part in the shuffle: pass ids and times, not documents.
    """
    columns = [c for c in attempts.columns if c != "accepted"]
    rows = attempts.select(
        F.struct(*columns).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col("user_id").cast("string")), F.lit("")).alias("user"),
        (F.coalesce(F.col("tier"), F.lit(FREE_TIER)) == FREE_TIER).alias("free"),
    )
    in_order = rows.repartition("user").sortWithinPartitions(
        "user", "row.created_at", "row.attempt_id", F.col("row.tier").asc_nulls_first())
    window = days * 86_400_000_000

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, held = None, deque(maxlen=quota)
        for batch in batches:
            users, attempt = batch.column("user"), batch.column("row")
            times = attempt.field(attempt.type.get_field_index("created_at")).cast(pa.int64())
            timed = times.is_valid().to_numpy(zero_copy_only=False)
            times, free = times.fill_null(0).to_numpy(), batch.column("free").to_numpy(zero_copy_only=False)
            accepted = ~free
            changes = pc.not_equal(users.slice(1), users.slice(0, len(users) - 1)).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(changes) + 1).tolist(), len(users)]
            for start, stop in zip(bounds[:-1], bounds[1:]):
                if start < stop:
                    if users[start].as_py() != user:
                        user = users[start].as_py()
                        held.clear()
                    start += int((~timed[start:stop]).sum())  # those without a time come first
                    accepted[start:stop] = _accepted(times[start:stop], free[start:stop], held, quota, window)
            yield pa.RecordBatch.from_arrays([attempt, pa.array(accepted)], names=["row", "accepted"])

    schema = T.StructType([rows.schema["row"], T.StructField("accepted", T.BooleanType())])
    return in_order.select("row", "user", "free").mapInArrow(folded, schema).select(
        *[F.col("row")[c].alias(c) for c in columns], "accepted")


def _accepted(times: np.ndarray, free: np.ndarray, held: deque, quota: int, window: int) -> np.ndarray:
    """Decisions for attempts of one user in order. ``held`` has the last ``quota``
    accepted times before them, and after them on return."""
    accepted, paid, i = ~free, np.flatnonzero(~free), 0
    while i < len(times):
        if not free[i] or len(held) < quota or quota and held[0] <= times[i] - window:
            accepted[i] = True
            held.append(times[i])
            i += 1
        else:  # refused until the oldest one leaves, or a tier without a quota comes
            leaves = np.searchsorted(times, held[0] + window) if quota else len(times)
            after = np.searchsorted(paid, i)
            i = int(min(leaves, paid[after] if after < len(paid) else len(times)))
    return accepted
