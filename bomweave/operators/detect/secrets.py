"""Environment files: secrets by variable name and by value prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import dims as D
from ...functions import text as X
from . import finding as R

KEY_NAME, VALUE_PREFIX = 0, 1
PLACEHOLDER = "your-key-here"
SECRET_BYTES = 20


def env_file(path: Column, content: Column, dims: D.Dictionaries) -> Column:
    names = D.string_map(dims.secret_key_names)
    prefixes = D.struct_array(
        [(p, dims.secret_prefixes[p]) for p in D.first_match_order(dims.secret_prefixes)],
        ("prefix", "platform"),
    )

    def parse(numbered):
        n, entry = numbered["n"], X.trim(numbered["line"])
        parts = F.split(entry, "=", 2)
        return F.struct(
            n.alias("n"),
            (X.is_significant(entry) & (F.size(parts) == 2)).alias("ok"),
            F.upper(X.trim(F.get(parts, F.lit(0)))).alias("key"),
            F.btrim(X.trim(F.get(parts, F.lit(1))), F.lit("\"'")).alias("value"),
        )

    assignments = F.filter(
        R.numbered_lines(X.lines_of(content),
                         lambda line, n: F.struct(n.alias("n"), line.alias("line"))),
        lambda e: e["line"].contains("="),
    )
    entries = F.filter(F.transform(assignments, parse), lambda e: e["ok"])

    def secret(e, description, seq):
        return R.finding(
            R.ENV_FILE, "Exposed Secret", "HIDDEN", "Environment File (.env)", "High", description,
            R.at_line(path, e["n"]), line_no=e["n"], seq=seq,
        )

    def by_name(e):
        value = e["value"]
        real = (
            (value != "") & (value != PLACEHOLDER)
            & ~value.startswith("${") & ~value.startswith("<")
        )
        return F.when(F.map_contains_key(names, e["key"]) & real, secret(e, F.concat(
            F.element_at(names, e["key"]),
            F.lit(" API key found in .env file — should be in a secret manager, not committed to VCS"),
        ), KEY_NAME))

    def by_prefix(e):
        hit = F.get(F.filter(prefixes, lambda p: F.startswith(e["value"], p["prefix"])), F.lit(0))
        return F.when(hit.isNotNull() & (F.octet_length(e["value"]) > SECRET_BYTES), secret(e, F.concat(
            hit["platform"], F.lit(" detected in .env file — rotate this key immediately"),
        ), VALUE_PREFIX))

    return F.flatten(F.transform(entries, lambda e: R.present(F.array(by_name(e), by_prefix(e)))))
