"""The driver contract."""

import re

import __spark_entry__ as entry
from workload.queries import QUERIES


def test_registry():
    names = set(entry.queries())
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in names)
    assert set(entry.oracle_sql()) <= names
    own = {n for n in names if n in QUERIES}
    assert len(own) > 80 and own <= set(entry.oracle_sql())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20
    assert {r["compliance_status"] for r in rows} <= {
        "Passed", "Blocked by Policy", "Action Required (Annex IV Documentation Missing)"}
