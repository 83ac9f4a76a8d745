"""Text helpers shared by the detectors. All are built-in Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import first_match_order, struct_array

# Unicode white space, as trimmed by the scanners this engine is compatible with.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java regex character class body.
WS_CLASS = r"\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
# ``\s`` of the RE2 family: no vertical tab, ASCII only.
RE_SPACE = r"[\t\n\f\r ]"
RE_NON_SPACE = r"[^\t\n\f\r ]"


def trim(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE_SPACE))


def lines_of(content: Column) -> Column:
    """Array of lines."""
    return F.split(content, "\n")


def is_significant(line: Column) -> Column:
    """True for a (trimmed) line that is neither blank nor a ``#`` comment."""
    return (line != "") & ~line.startswith("#")


def minimal_keys(keys) -> list[str]:
    """Keys without those that contain a shorter key: they add nothing to a test
    for *any* key."""
    keys = list(dict.fromkeys(keys))
    return [k for k in keys if not any(o != k and o in k for o in keys)]


def contains_any(value: Column, keys) -> Column:
    """OR of plain substring tests: short-circuits and stays in codegen."""
    result = None
    for key in minimal_keys(keys):
        test = value.contains(key)
        result = test if result is None else result | test
    return F.lit(False) if result is None else result


def mentions_any(value: Column, keys, ignore_case: bool = False) -> Column:
    """One regex alternation over fixed keys, for short values and as a prefilter
    that ignores case."""
    pattern = "|".join(re.escape(k) for k in minimal_keys(keys))
    return value.rlike(("(?i)" if ignore_case else "") + pattern)


def names_after(keys, lead: str) -> str:
    """Regex for any key (ignoring case) right after ``lead``. A lead that fails
    fast, such as a line start or a quote, keeps the prefilter cheap. As the match is
    anchored, only a key that begins with another one adds nothing."""
    keys = list(dict.fromkeys(k.lower() for k in keys))
    shortest = [k for k in keys if not any(o != k and k.startswith(o) for o in keys)]
    return f"(?im){lead}(?:" + "|".join(map(re.escape, shortest)) + ")"


# White space that can stand in front of the first word of a line.
LINE_START = rf"^[{WS_CLASS.replace(chr(92) + 'n', '')}]*+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: inside ``when`` and lambdas a
    repeated expression is evaluated again at every mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_match(value: Column, mapping: dict, key="key", payload="value") -> Column:
    """Struct of the first dictionary entry contained in ``value`` (or NULL).

    The array literal is in priority order, so no join and no shuffle is needed.
    """
    rows = [(k, mapping[k]) for k in first_match_order(mapping)]
    table = struct_array(rows, (key, payload))
    return F.get(F.filter(table, lambda e: value.contains(e[key])), F.lit(0))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(?s)\.[^.]*\z", 0)
