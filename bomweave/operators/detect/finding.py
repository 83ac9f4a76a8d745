"""The finding struct and small array idioms used by every detector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...schemas import FINDING

# Order of the detectors inside one file; part of the report order.
REQUIREMENTS, PACKAGE_JSON, GO_MOD, PYPROJECT = 1, 2, 3, 4
DOCKERFILE, GO_SOURCE, PY_SOURCE, ENV_FILE, WEIGHTS = 5, 6, 7, 8, 9
KUBERNETES, HELM, TERRAFORM = 10, 11, 12


def _number(value) -> Column:
    return value.cast("int") if isinstance(value, Column) else F.lit(int(value))


def _string(value) -> Column:
    if value is None:
        return F.lit(None).cast("string")
    return value if isinstance(value, Column) else F.lit(value)


def finding(detector, name, version, ecosystem, level, description, location, line_no=0, seq=0) -> Column:
    return F.struct(
        _number(detector).alias("detector"),
        _number(line_no).alias("line_no"),
        _number(seq).alias("seq"),
        _string(name).alias("name"),
        _string(version).alias("version"),
        _string(ecosystem).alias("ecosystem"),
        _string(level).alias("level"),
        _string(description).alias("description"),
        _string(location).alias("location"),
    )


def no_findings() -> Column:
    return F.expr(f"cast(array() AS array<{FINDING}>)")


def when_mentioned(condition: Column, findings: Column) -> Column:
    """Run a detector only on files that can possibly have a finding."""
    return F.when(condition, findings).otherwise(no_findings())


def present(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull())


def numbered_lines(lines: Column, extract) -> Column:
    """``transform`` with 1-based line numbers."""
    return F.transform(lines, lambda line, i: extract(line, i + 1))


def at_line(path: Column, line_no: Column) -> Column:
    return F.concat(path, F.lit(":"), line_no.cast("string"))
