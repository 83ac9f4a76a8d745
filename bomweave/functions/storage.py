"""Materialised intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session inside one process that lacks the setting gets a temporary folder;
    on a cluster a machine-local folder would not survive the loss of an executor.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="bomweave-")
    return _local_dirs[app]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, every table that ``materialise`` wrote in it and did
    not keep for a block around. Results that read such a table must be written or
    collected inside the block."""
    written: list[str] = []
    _scopes.append(written)
    try:
        yield
    finally:
        _scopes[:] = [scope for scope in _scopes if scope is not written]
        jvm = spark.sparkContext._jvm
        for target in written:
            path = jvm.org.apache.hadoop.fs.Path(target)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str, keep: int = 0) -> DataFrame:
    """Write once, read many: cuts lineage and keeps column pruning.

    Used where several consumers read one expensive result. The table is plain
    parquet, so a lost executor costs a re-read and not a re-scan. It stays until the
    enclosing ``scratch`` block ends, or for good without one. ``keep``: how many blocks
    it outlives, for the one around them to delete.
    """
    spark = df.sparkSession
    target = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _scopes[:max(0, len(_scopes) - keep)]
    if scopes:
        scopes[-1].append(target)
    df.write.mode("errorifexists").parquet(target)
    return spark.read.schema(df.schema).parquet(target)
