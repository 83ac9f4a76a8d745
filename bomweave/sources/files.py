"""Ingest of source trees into the ``files`` table.

Spark's file sources skip names that start with a dot or an underscore, and these
must be seen (``.env``, the policy file). So the paths are listed by tasks and
read by tasks: one row per tree comes in, folders are listed level by level, and only
files that some detector looks into are opened. Weight files never are.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims as D
from ..functions.storage import materialise
from ..operators import policy
from ..operators.policy import POLICY_FILE
from ..operators.scan import kind_tests
from ..schemas import FILES

LISTING = "project string, commit_sha string, root string, path string, is_dir boolean"
READ_BATCH = 256


def _hidden(name: str) -> bool:
    return name.startswith(".") and name not in (".", "..")


def _level(batches):
    """The entries of folders, without hidden folders; a linked folder counts as a file."""
    for batch in batches:
        rows = []
        for item in batch.itertuples(index=False):
            try:
                with os.scandir(os.path.join(item.root, item.path)) as entries:
                    for e in entries:
                        is_dir = e.is_dir(follow_symlinks=False)
                        if not (is_dir and _hidden(e.name)):
                            path = f"{item.path}/{e.name}" if item.path else e.name
                            rows.append((item.project, item.commit_sha, item.root, path, is_dir))
                        if len(rows) >= 10_000:
                            yield _frame(rows)
                            rows = []
            except OSError:
                if not item.path:  # a folder below that can't be read is left out, a root must be readable
                    raise
        yield _frame(rows)


def _frame(rows):
    return pd.DataFrame(rows, columns=["project", "commit_sha", "root", "path", "is_dir"])


def _contents(batches):
    for batch in batches:
        for start in range(0, len(batch), READ_BATCH):
            piece = batch.iloc[start:start + READ_BATCH]
            texts = [
                _read(os.path.join(root, path)) if wanted else None
                for root, path, wanted in zip(piece["root"], piece["path"], piece["wanted"])
            ]
            yield piece[["project", "commit_sha", "path"]].assign(content=texts)


def _read(path: str) -> str:
    try:
        with open(path, "rb") as handle:
            return handle.read().decode("utf-8", "replace")
    except OSError:
        return ""


def _tasks(df: DataFrame) -> int:
    """Listing and reading take time by the file, not by the byte: a fixed number of tasks, which
    adaptive execution does not merge."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def list_trees(trees: DataFrame) -> DataFrame:
    """Paths below each tree, hidden directories left out.

    One level a round: the folders found are dealt to all tasks again, so a deep or crowded
    folder is shared however the tree is shaped. Each round is a written table; a lost
    executor repeats its part of one round. There are as many rounds as the deepest tree has levels.
    """
    tasks, rounds = _tasks(trees), []
    frontier = trees.select("project", "commit_sha", "root", F.lit("").alias("path"))
    while True:
        level = materialise(frontier.repartition(tasks, "root", "path").mapInPandas(_level, LISTING), "listing")
        rounds.append(level.filter("not is_dir"))
        frontier = level.filter("is_dir").drop("is_dir")
        if frontier.isEmpty():
            break
    found = rounds[0]
    for level in rounds[1:]:
        found = found.unionByName(level)
    return found.drop("is_dir")


def read_trees(trees: DataFrame, dims: D.Dictionaries = D.DEFAULT, policy_file: str = POLICY_FILE) -> DataFrame:
    """``files`` from ``trees(project, commit_sha, root)``. Roots are folders that
    every executor can read."""
    tests = kind_tests(F.col("path"), dims)
    wanted = F.col("path") == policy_file
    for kind, test in tests.items():
        if kind != "weights":
            wanted = wanted | test
    listed = list_trees(trees).withColumn("wanted", wanted)
    return listed.repartition(_tasks(trees), "project", "commit_sha", "path").mapInPandas(
        _contents, "project string, commit_sha string, path string, content string"
    )


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """Share out a stored table that comes in fewer partitions than there are
    cores, such as one small file. A table that is split already is left alone.
    Only for a table as read: looking at the partitions of a longer plan would
    run its shuffles. Rows go by a hash of ``keys``, so a recomputed task puts
    every row in the same place."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores, *keys)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A landed ``files`` table, with its ``part``."""
    return spread(spark.read.schema(FILES + ", part string").parquet(path), "project", "path")


def land_files(files: DataFrame, target: str) -> None:
    """Append to a landed ``files`` table, which batch and stream scans read. Files that
    can be policies lie in a part of their own, so that reading policies does not
    read the corpus."""
    files.withColumn("part", F.when(policy.may_be_policy(F.col("path")), "policy").otherwise("other")).write.mode(
        "append").partitionBy("part").parquet(target)
