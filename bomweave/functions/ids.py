"""Hashes, identifiers and JSON text in the exact form the ledger stores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(value: Column) -> Column:
    """NULL and empty string mean the same in the data model."""
    return F.coalesce(value, F.lit(""))


def absent(value: Column) -> Column:
    """Empty string to NULL, for fields that are omitted when empty."""
    return F.when(value != "", value)


def sha256_hex(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def proof_hash(commit_sha: Column, document: Column) -> Column:
    """sha256(commit ++ document) as 64 lower-case hex digits."""
    return sha256_hex(F.concat(commit_sha, document))


def key_hash(key: Column) -> Column:
    return sha256_hex(key)


def project_id(name: Column) -> Column:
    """Deterministic id, so that an upsert is the same on every retry."""
    return sha256_hex(name)


def serial_number(project: Column, commit_sha: Column) -> Column:
    digest = sha256_hex(F.concat(text(project), text(commit_sha)))
    return F.concat(F.lit("urn:uuid:"), F.substring(digest, 1, 36))


def effective_commit(commit_sha: Column) -> Column:
    return F.coalesce(absent(commit_sha), F.lit("local-dev-uncommitted"))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def html_safe(json_text: Column) -> Column:
    """Escape what JSON writers with HTML-safe output escape: < > & U+2028/9."""
    out = json_text
    for raw, escaped in (
        ("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"),
        ("\u2028", "\\u2028"), ("\u2029", "\\u2029"),
    ):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def json_string(value: Column) -> Column:
    """Quoted JSON text of a string; NULL stays NULL.

    The brackets of a one-element array are trimmed off: the quotes protect the
    value. Only a value with rare control characters takes the second branch.
    """
    def encoded():
        return html_safe(F.btrim(F.to_json(F.array(value)), F.lit("[]")))

    return F.when(value.rlike(RARE_CONTROLS), lower_control_escapes(encoded())).otherwise(
        F.when(value.isNotNull(), encoded()))


def json_object(fields: list[tuple[str, Column]], depth: int | None = None) -> Column:
    """JSON object text from (name, JSON text) pairs; NULL values are left out.

    ``depth`` None gives compact text; otherwise two blanks per level, with the
    closing brace at ``depth``.
    """
    gap = "" if depth is None else " "
    pad = "" if depth is None else "\n" + "  " * (depth + 1)
    end = "" if depth is None else "\n" + "  " * depth
    parts = F.filter(
        F.array(*[F.concat(F.lit(f'"{name}":{gap}'), value) for name, value in fields]),
        lambda part: part.isNotNull(),
    )
    return F.concat(F.lit("{" + pad), F.array_join(parts, "," + pad), F.lit(end + "}"))


def json_array(items: Column, depth: int | None = None) -> Column:
    """JSON array text from an array of JSON texts."""
    pad = "" if depth is None else "\n" + "  " * (depth + 1)
    end = "" if depth is None else "\n" + "  " * depth
    return F.when(F.size(items) == 0, "[]").otherwise(
        F.concat(F.lit("[" + pad), F.array_join(items, "," + pad), F.lit(end + "]"))
    )


# Control characters without a short escape whose hex code has a letter.
RARE_CONTROLS = r"[\x0B\x0E\x0F\x1A-\x1F]"
RARE_CODES = (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20))


def lower_control_escapes(json_text: Column) -> Column:
    """``\\u001F`` -> ``\\u001f``: the JSON writer uses upper-case hex, the ledger
    lower-case. An escaped backslash in front is not an escape of the character."""
    out = json_text
    for code in RARE_CODES:
        out = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*)\\u" + f"{code:04X}", r"$1\\u" + f"{code:04x}")
    return out
