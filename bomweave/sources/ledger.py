"""Document and ledger sinks and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import absent, effective_commit
from ..functions.storage import materialise
from ..schemas import BOM_JSON, PROOF_DRILLS

DOCUMENT_BUCKETS, DOCUMENT_SPREAD = 64, 16
FILE_BYTES = 128 << 20


def write_documents(documents: DataFrame, column: str, target: str) -> None:
    """Document texts, one row per document page, below ``bucket=.../``: a bounded number
    of folders, however many projects there are. Pages of a project are spread over
    the files of its bucket; rows keep ``page``, so a document is read back in order.
    """
    rows = documents.select("project", "commit_sha", "page", column).withColumn(
        "bucket", F.pmod(F.xxhash64("project"), F.lit(DOCUMENT_BUCKETS)).cast("int"))
    rows.repartition("bucket", F.pmod(F.col("page"), F.lit(DOCUMENT_SPREAD))).write.mode("append").partitionBy("bucket").json(target)


def read_documents(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Document pages as ``write_documents`` has written them: ``project, commit_sha, page`` and
    the text in ``column``."""
    rows = spark.read.schema(f"project string, commit_sha string, page bigint, {column} string, bucket int").json(path)
    return rows.drop("bucket")


def read_boms(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """BOM structs from JSON documents: text files with one document per line or, with ``column``,
    what ``write_documents`` has written of documents with one page. Longer documents are read
    with ``read_documents`` and ``documents.dependencies_of_pages``."""
    if column is None:
        return spark.read.text(path).select(F.from_json("value", BOM_JSON).alias("bom"))
    return read_documents(spark, path, column).select("project", "commit_sha", F.from_json(column, BOM_JSON).alias("bom"))


def append_drills(drills: DataFrame, target: str, file_bytes: int = FILE_BYTES) -> None:
    """Append ledger rows for lookups by day and by hash.

    Rows are partitioned by day, so that ``usage_as_of`` and ``latest`` with a bound read recent days
    only. A day has as many files as its measured size asks for; each holds a range of
    hashes, in order, so the statistics of files and row groups leave one of them for a
    hash, and a crowded day is not one task.
    """
    rows = materialise(drills.withColumn("commit_sha", effective_commit(F.col("commit_sha"))).withColumn(
        "user_id", absent(F.col("user_id"))
    ).withColumn("created_date", F.to_date("created_at")), "drills")
    size = F.lit(256)
    for name, kind in drills.dtypes:
        if kind == "string":
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
    days = rows.groupBy("created_date").agg(F.ceil(F.sum(size) / file_bytes).alias("_files"))
    # hashes are spread evenly, so equal ranges of their first digits are equal shares
    part = F.coalesce(F.conv(F.substring("crypto_hash", 1, 8), 16, 10).cast("double") / float(1 << 32), F.lit(0.0))
    dealt = rows.join(days, rows["created_date"].eqNullSafe(days["created_date"]), "left").drop(days["created_date"]).withColumn(
        "_file", F.floor(part * F.col("_files")).cast("int")).drop("_files")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt.repartition(tasks, "created_date", "_file").sortWithinPartitions("created_date", "_file", "crypto_hash").drop(
        "_file").write.mode("append").partitionBy("created_date").option(
        "parquet.bloom.filter.enabled#crypto_hash", "true").parquet(target)


def read_drills(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROOF_DRILLS + ", created_date date").parquet(path)


def read_drills_jdbc(spark: SparkSession, url: str, table: str = "proof_drills", **options) -> DataFrame:
    """The same table in a relational database (needs its driver on the classpath)."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
