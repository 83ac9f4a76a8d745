"""Streaming jobs. The batch operators are reused unchanged wherever possible."""

from __future__ import annotations

from typing import Any, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import dims as D
from ..operators import scan
from ..operators.quota import FREE_TIER, QUOTA, WINDOW_DAYS
from ..schemas import FILES

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_findings(spark: SparkSession, landed_files: str, dims: D.Dictionaries = D.DEFAULT) -> DataFrame:
    """Findings of files as they land. The detectors are stateless."""
    return scan.findings(spark.readStream.schema(FILES).parquet(landed_files), dims)


class QuotaProcessor(StatefulProcessor):
    """Keeps the newest accepted timestamps of a user; decides in arrival order,
    and by (created_at, attempt_id) inside a micro-batch."""

    def __init__(self, days: int = WINDOW_DAYS, quota: int = QUOTA):
        self.window = pd.Timedelta(days=days)
        self.quota = quota

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState(
            "accepted", T.StructType([T.StructField("times", T.ArrayType(T.TimestampType()))])
        )

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        times = list(self.accepted.get()[0]) if self.accepted.exists() else []
        times = [pd.Timestamp(t) for t in times]
        # light columns of one user's part of a micro-batch: bound it with the source's trigger options
        batch = pd.concat([part[["user_id", "attempt_id", "tier", "created_at"]] for part in rows]).sort_values(
            ["created_at", "attempt_id"], kind="stable")
        decisions = []
        for tier, now in zip(batch["tier"], batch["created_at"]):
            times = [t for t in times if t > now - self.window]
            ok = tier != FREE_TIER or len(times) < self.quota
            if ok:
                times = (times + [now])[-self.quota:]
            decisions.append(ok)
        self.accepted.update(([t.to_pydatetime() for t in times],))
        yield pd.DataFrame({
            "user_id": batch["user_id"], "attempt_id": batch["attempt_id"],
            "created_at": batch["created_at"], "accepted": decisions,
        })

    def close(self) -> None:
        pass


def stream_admissions(attempts: DataFrame, days: int = WINDOW_DAYS, quota: int = QUOTA) -> DataFrame:
    """Accept or refuse uploads as they arrive (needs the RocksDB state store)."""
    schema = "user_id bigint, attempt_id bigint, created_at timestamp, accepted boolean"
    return attempts.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=QuotaProcessor(days, quota), outputStructType=schema,
        outputMode="append", timeMode="none",
    )
