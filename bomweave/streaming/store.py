"""Tables that micro-batches keep in the shared folder, committed together.

A ``foreachBatch`` job names its output by batch. It reads what earlier batches
committed, stages new files below its own number, and commits once: a row per kept file
group. A batch that runs again after a failure reads the same commit as before and
overwrites its own files, so it adds nothing twice.

* A *kept* table lies in hash buckets; a batch rewrites the buckets that it touches.
* A *grown* table gets new rows from each batch, in the same buckets, and is never
  rewritten; rows of a batch that did not commit are not seen.

Everything is plain parquet, written and read by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "name string, bucket int, batch long"


def bucket_of(*keys: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class BatchStore:
    """``kept`` and ``grown`` map names of tables to their schemas (DDL); every table also has
    a column ``bucket``, and none is called ``batch``."""

    def __init__(self, spark: SparkSession, target: str, kept: dict[str, str], grown: dict[str, str] | None = None,
                 buckets: int = 64):
        self.spark, self.target, self.buckets = spark, target.rstrip("/"), buckets
        self.kept, self.grown = kept, grown or {}

    # -- folders

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def _numbers(self, path: str, prefix: str) -> list[int]:
        """Numbers of the folders ``prefix=N`` in a folder."""
        fs, folder = self._files(path)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{prefix}="))

    def _drop(self, path: str) -> None:
        fs, folder = self._files(path)
        fs.delete(folder, True)

    def _commit_path(self, version: int) -> str:
        return f"{self.target}/commits/batch={version}"

    def last(self, before: int | None = None) -> int | None:
        """Number of the last committed batch (before batch ``before``)."""
        for version in reversed(self._numbers(f"{self.target}/commits", "batch")):
            fs, marker = self._files(f"{self._commit_path(version)}/_SUCCESS")
            if (before is None or version < before) and fs.exists(marker):
                return version
        return None

    def _groups(self, version: int | None) -> dict[tuple[str, int], int]:
        """Where each bucket of each kept table lies; at most tables x buckets entries."""
        if version is None:
            return {}
        rows = self.spark.read.schema(COMMIT).parquet(self._commit_path(version)).collect()
        return {(r["name"], r["bucket"]): r["batch"] for r in rows}

    # -- reading

    def read(self, name: str, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """A table as of the last commit (before batch ``before``), or ``only`` some buckets of it."""
        schema = (self.kept.get(name) or self.grown[name]) + ", bucket int"
        last, base = self.last(before), f"{self.target}/{name}"
        if name in self.kept:
            paths = [f"{base}/batch={v}/bucket={b}" for (n, b), v in self._groups(last).items()
                     if n == name and (only is None or b in only)]
            if not paths:
                return self.spark.createDataFrame([], schema)
            return self.spark.read.schema(schema).option("basePath", base).parquet(*paths).drop("batch")
        if last is None or only == [] or not self._numbers(base, "batch"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema + ", batch long").parquet(base).filter(F.col("batch") <= last)
        return (rows if only is None else rows.filter(F.col("bucket").isin(only))).drop("batch")

    # -- writing

    def stage(self, name: str, rows: DataFrame, batch: int) -> None:
        """Write a batch's rows of a table: new rows of a grown one, or whole new
        contents of the touched buckets of a kept one. Not seen before ``commit``."""
        # a crowded bucket is several files, written by several tasks
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.target}/{name}/batch={batch}")

    def commit(self, batch: int, touched: dict[str, list[int]]) -> None:
        """Make a batch's staged rows the current ones. ``touched`` names the rewritten buckets
        of kept tables. Versions that neither this commit nor the one before needs go."""
        earlier = self._groups(self.last(batch))
        groups = {k: v for k, v in earlier.items() if k[1] not in touched.get(k[0], ())}
        for name in touched:
            groups |= {(name, b): batch for b in self._numbers(f"{self.target}/{name}/batch={batch}", "bucket")}
        rows = [(n, b, v) for (n, b), v in sorted(groups.items())]
        self.spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("overwrite").parquet(self._commit_path(batch))
        needed = {(n, v, b) for table in (earlier, groups) for (n, b), v in table.items()}
        for name in self.kept:
            for version in self._numbers(f"{self.target}/{name}", "batch"):
                for bucket in self._numbers(f"{self.target}/{name}/batch={version}", "bucket"):
                    if (name, version, bucket) not in needed and version < batch:
                        self._drop(f"{self.target}/{name}/batch={version}/bucket={bucket}")
        for old in self._numbers(f"{self.target}/commits", "batch")[:-2]:
            self._drop(self._commit_path(old))


def buckets_in(rows: DataFrame) -> list[int]:
    """Buckets that occur: at most as many as the store has."""
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())
