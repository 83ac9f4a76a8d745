"""Streaming jobs over the driver tables: rows land as files of a few time ranges, the job
takes one range a micro-batch, and its tables must equal those of the batch operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomweave.functions.storage import shared_folder
from bomweave.streaming.account_stream import AccountStream
from bomweave.streaming.commit_stream import CommitStream
from bomweave.streaming.proof_stream import ProofStream
from bomweave.streaming.seen import SeenIds
from bomweave.operators.scan import KEYS, visible_files
from bomweave.operators.skew import salted_join

from . import adapters as A
from . import oracles as O
from .queries import BRANDING, files, query, registry

PIECES = 2
BUCKETS = 4


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def streamed(spark: SparkSession, rows: DataFrame, name: str, piece, write) -> None:
    """Land ``rows`` piece after piece (0 to ``PIECES - 1``) and run ``write`` on each as a micro-batch.

    All tasks write files of a piece. The job runs after each landing and goes on from its
    checkpoint: without a limit of files, its next micro-batch is all that is new, the whole piece."""
    landed, checkpoint = _folder(spark, f"{name}-landed"), _folder(spark, f"{name}-checkpoint")
    for n in range(PIECES):
        rows.filter(piece == n).write.mode("append").parquet(landed)
        source = spark.readStream.schema(rows.schema).parquet(landed)
        run = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()


def _timed(rows: DataFrame, time: str) -> DataFrame:
    """The tables' times are without a zone, events of a stream have one."""
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def by_time(rows: DataFrame, time: str):
    """The time range of a row: equal parts of the whole span."""
    first, last = rows.agg(F.min(time).cast("double"), F.max(time).cast("double")).first()
    place = (F.col(time).cast("double") - (first or 0.0)) / max(1.0, (last or 0.0) - (first or 0.0)) * PIECES
    return F.least(F.floor(place), F.lit(PIECES - 1))


@query("stream_event_intake", f"SELECT DISTINCT event_id, event_type, user_id, customer_id, attempt_count FROM ({A.BILLING_EVENTS})")
def stream_event_intake(spark, sf):
    """Replays may come in a later batch than the event."""
    events = _timed(A.frame(spark, sf, A.BILLING_EVENTS), "received_at")
    seen, target = SeenIds(spark, _folder(spark, "seen"), buckets=BUCKETS), _folder(spark, "admitted")

    def write(batch, n):
        seen.first_deliveries(batch, n).write.mode("overwrite").parquet(f"{target}/batch={n}")

    streamed(spark, events, "events", by_time(events, "received_at"), write)
    return spark.read.schema(events.schema).parquet(target).drop("received_at", "batch")


@query("stream_key_outcomes", O.account_replay(A.ACCOUNT_EVENTS) + O.OUTCOMES)
def stream_key_outcomes(spark, sf):
    events = _timed(A.frame(spark, sf, A.ACCOUNT_EVENTS), "received_at")
    stream = AccountStream(spark, _folder(spark, "accounts"), buckets=BUCKETS)
    streamed(spark, events, "account-events", by_time(events, "received_at"), stream.write)
    return stream.outcomes().drop("received_at")


@query("stream_commit_postures", O.report("SELECT project, commit_sha, scanned_files, compliance_status FROM stats"))
def stream_commit_postures(spark, sf):
    """Files of a commit land in all pieces; its visible files are what it announces."""
    landed = visible_files(files(spark, sf))
    number = landed.groupBy(*KEYS).agg(F.count(F.lit(1)).cast("int").alias("expected_files"))
    rows = salted_join(landed, number, KEYS, ["path"], "inner").select(*KEYS, "path", "content", "expected_files")
    stream = CommitStream(spark, _folder(spark, "commits"), registry(spark, sf), branding=BRANDING, buckets=BUCKETS)
    streamed(spark, rows, "files", F.pmod(F.xxhash64("path"), F.lit(PIECES)), stream.write)
    return stream.postures()


@query("stream_proof_ledger", O.uploads_sql(O.DRILLS_SELECT))
def stream_proof_ledger(spark, sf):
    uploads = _timed(A.frame(spark, sf, A.UPLOADS), "created_at")
    keys = A.frame(spark, sf, A.UPLOAD_KEYS)
    stream = ProofStream(spark, _folder(spark, "proofs"), lambda: keys, branding=BRANDING, buckets=BUCKETS)
    streamed(spark, uploads, "uploads", by_time(uploads, "created_at"), stream.write)
    return stream.ledger().select(
        "id", "project_id", "user_id", "commit_sha", "ai_bom_json", "crypto_hash", F.col("created_at").cast("timestamp_ntz").alias("created_at"))
