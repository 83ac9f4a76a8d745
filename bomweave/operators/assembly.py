"""Ordered assembly of flat rows into documents.

A document is first a table of ordered *parts* (text fragments). A part is made
by a narrow expression or a small join; only the last step groups parts, and it
groups them by page. A page starts where the text before it passes another
``PAGE_BYTES``; the texts of a document's pages, in ``page`` order, are the document.
Parts are never cut.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import KEYS
from .skew import PAGE_BYTES, paged

PART_ORDER = ["section", "grp", "rank", "path_key", "detector", "line_no", "seq", "item"]


def part(df: DataFrame, section: int, text: Column, grp: Column | None = None, rank: int = 0,
         item: Column | None = None) -> DataFrame:
    """Parts of one section; order columns the input lacks get neutral values."""
    has = set(df.columns)

    def order(name, neutral, kind):
        return (F.col(name) if name in has else F.lit(neutral)).cast(kind).alias(name)

    path_key = F.col("path_key") if "path_key" in has else F.array().cast("array<string>")
    return df.select(
        *KEYS, F.lit(section).alias("section"),
        (grp if grp is not None else F.lit("")).alias("grp"), F.lit(rank).alias("rank"),
        path_key.alias("path_key"), order("detector", 0, "int"), order("line_no", 0, "int"),
        order("seq", 0, "int"), (item if item is not None else F.lit(0)).cast("int").alias("item"),
        text.alias("text"),
    )


def union_parts(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def assembled(parts: DataFrame, page_bytes: int = PAGE_BYTES, name: str = "text") -> DataFrame:
    """``project, commit_sha, page, <name>``."""
    rows = paged(parts, KEYS, PART_ORDER, F.octet_length("text"), page_bytes)
    ordered = F.array_sort(F.collect_list(F.struct(*PART_ORDER, "text")))
    return rows.groupBy(*KEYS, "page").agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias(name)
    )


def document_hashes(documents: DataFrame, text: str = "bom_json") -> DataFrame:
    """``project, commit_sha, crypto_hash`` of assembled documents.

    SHA-256 is sequential: pages come in page order as a stream, and a task keeps the
    running digest only. One document is therefore one task's reading, however large.
    """
    commit = F.coalesce(F.nullif("commit_sha", F.lit("")), F.lit("local-dev-uncommitted"))

    def digests(batches):
        current, digest = None, None
        for batch in batches:
            for project, sha, start, piece in zip(
                batch["project"], batch["commit_sha"], batch["_commit"], batch[text]
            ):
                if (project, sha) != current:
                    if current is not None:
                        yield pd.DataFrame([(*current, digest.hexdigest())], columns=[*KEYS, "crypto_hash"])
                    current, digest = (project, sha), hashlib.sha256(start.encode())
                digest.update(piece.encode())
        if current is not None:
            yield pd.DataFrame([(*current, digest.hexdigest())], columns=[*KEYS, "crypto_hash"])

    return (
        documents.withColumn("_commit", commit)
        .select(*KEYS, "page", "_commit", text)
        .repartition(*KEYS).sortWithinPartitions(*KEYS, "page")
        .mapInPandas(digests, "project string, commit_sha string, crypto_hash string")
    )
