"""Billing events: verified webhook payloads as batch table or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import WEBHOOK_EVENT


def parsed_events(payloads: DataFrame, column: str = "value") -> DataFrame:
    """``billing_events`` from JSON payloads, one per row, of any size. Bodies without
    an id are not events. A customer may be an id or, expanded, an object with one."""
    event = F.from_json(F.col(column), WEBHOOK_EVENT)
    customer = F.col("e.data.object.customer")
    return (
        payloads.select(event.alias("e"))
        .filter(F.col("e.id").isNotNull())
        .select(
            F.col("e.id").alias("event_id"), F.col("e.type").alias("event_type"),
            F.element_at("e.data.object.metadata", "user_id").alias("user_id"),
            F.when(customer.startswith("{"), F.get_json_object(customer, "$.id")).otherwise(customer).alias("customer_id"),
            F.col("e.data.object.attempt_count").alias("attempt_count"),
            F.timestamp_seconds("e.created").alias("received_at"),
        )
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parsed_events(spark.read.text(path))


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return parsed_events(spark.readStream.text(path))
