"""Package manifests: requirements.txt, package.json, go.mod, pyproject.toml."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import dims as D
from ...functions import text as X
from . import finding as R

# fixed patterns
REQUIREMENT = r"^([a-zA-Z0-9_\-]+)(?:[>=<~]+([a-zA-Z0-9_\-\.]+))?"
GO_REQUIRE = rf"^{X.RE_SPACE}*({X.RE_NON_SPACE}+){X.RE_SPACE}+v?({X.RE_NON_SPACE}+)"
TOML_ENTRY = rf"^([a-zA-Z0-9_-]+){X.RE_SPACE}*={X.RE_SPACE}*([^\n]+)"
TOML_VERSION = rf'version{X.RE_SPACE}*={X.RE_SPACE}*"([^"]+)"'
TOML_SECTIONS = ("[tool.poetry.dependencies]", "[project.dependencies]")


def requirements(path: Column, content: Column, dims: D.Dictionaries) -> Column:
    table = D.library_map(dims)

    def parse(line, line_no):
        entry = X.trim(line)
        return F.struct(
            line_no.alias("line_no"),
            F.lower(F.regexp_extract(entry, REQUIREMENT, 1)).alias("name"),
            F.regexp_extract(entry, REQUIREMENT, 2).alias("version"),
        )

    # Blank and comment lines yield the empty name, which no dictionary holds.
    entries = F.filter(
        R.numbered_lines(X.lines_of(content), parse),
        lambda e: F.map_contains_key(table, e["name"]),
    )
    return R.when_mentioned(
        content.rlike(X.names_after(dims.libraries, X.LINE_START)),
        F.transform(entries, lambda e: R.finding(
            R.REQUIREMENTS, e["name"],
            F.when(e["version"] == "", "unknown").otherwise(e["version"]),
            "Python (pip)",
            F.element_at(table, e["name"])["risk"], F.element_at(table, e["name"])["desc"],
            path, line_no=e["line_no"],
        )),
    )


def package_json(path: Column, content: Column, dims: D.Dictionaries) -> Column:
    """Both dependency maps; a file with any non-string version has no findings.

    The document is parsed once to a variant. Top-level keys are matched without
    case, as the reader this stays compatible with does.
    """
    table = D.library_map(dims)

    def section(top, name):
        value = F.get(F.map_values(F.map_filter(top, lambda k, _: F.lower(k) == name)), F.lit(0))
        return X.let(value, lambda v: F.struct(
            (v.isNull() | F.is_variant_null(v)).alias("empty"),
            F.try_variant_get(v, "$", "map<string,variant>").alias("entries"),
        ))

    def is_valid(part):
        kinds = F.transform(F.map_values(part["entries"]), lambda v: F.schema_of_variant(v))
        strings = part["entries"].isNotNull() & ~F.exists(kinds, lambda k: ~k.isin("STRING", "VOID"))
        return part["empty"] | F.coalesce(strings, F.lit(False))

    def hits(part, number):
        pairs = F.array_sort(F.map_entries(F.map_filter(
            part["entries"], lambda k, _: F.map_contains_key(table, F.lower(k))
        )), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.when(part["empty"], R.no_findings()).otherwise(F.transform(pairs, lambda e, i: R.finding(
            R.PACKAGE_JSON, e["key"],
            F.regexp_replace(F.coalesce(F.try_variant_get(e["value"], "$", "string"), F.lit("")), r"^\^?~?", ""),
            "Node.js (npm)",
            F.element_at(table, F.lower(e["key"]))["risk"], F.element_at(table, F.lower(e["key"]))["desc"],
            path, line_no=F.lit(number), seq=i,
        )))

    def found(parts):
        main, dev = parts["main"], parts["dev"]
        return F.when(is_valid(main) & is_valid(dev), F.concat(hits(main, 1), hits(dev, 2))).otherwise(R.no_findings())

    document = F.try_variant_get(F.try_parse_json(content), "$", "map<string,variant>")
    parts = X.let(document, lambda top: F.struct(
        section(top, "dependencies").alias("main"), section(top, "devdependencies").alias("dev")))
    return R.when_mentioned(content.rlike(X.names_after(dims.libraries, '"')), X.let(parts, found))


def go_mod(path: Column, content: Column, dims: D.Dictionaries) -> Column:
    """The require-block state is not carried line by line: the (trimmed) text is
    cut in front of every line that changes the state, and the first line of each
    piece says whether its lines are inside a block."""
    table = D.library_map(dims)
    trimmed = F.array_join(F.transform(X.lines_of(content), X.trim), "\n")
    pieces = F.split(trimmed, r"(?md)(?=^require \($|^\)$|^require [^(\n]*$)")

    def candidates(piece):
        lines = F.split(piece, "\n")
        head = F.get(lines, F.lit(0))
        single = F.array(F.regexp_replace(head, "^require ", ""))
        return (
            F.when(head == "require (", F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))
            .when(head.startswith("require ") & ~head.contains("("), single)
            .otherwise(F.array().cast("array<string>"))
        )

    def parse(line, i):
        module = F.lower(F.regexp_extract(line, GO_REQUIRE, 1))
        return F.struct(
            i.alias("seq"), module.alias("module"),
            F.regexp_extract(line, GO_REQUIRE, 2).alias("version"),
            X.first_match(module, dims.go_modules, "key", "library").alias("hit"),
        )

    entries = F.filter(
        F.transform(F.flatten(F.transform(pieces, candidates)), parse),
        lambda e: e["hit"].isNotNull(),
    )
    return R.when_mentioned(
        X.let(F.lower(content), lambda low: X.contains_any(low, dims.go_modules)),
        F.transform(entries, lambda e: R.finding(
            R.GO_MOD, e["module"], e["version"], "Go (module)",
            F.coalesce(F.element_at(table, e["hit"]["library"])["risk"], F.lit("Medium")),
            F.coalesce(F.element_at(table, e["hit"]["library"])["desc"], F.lit("AI-related Go module")),
            path, seq=e["seq"],
        )),
    )


def pyproject(path: Column, content: Column, dims: D.Dictionaries) -> Column:
    """Sections are cut in front of lines that start with ``[``; a piece counts
    when its first line is exactly one of the dependency headers."""
    table = D.library_map(dims)
    trimmed = F.array_join(F.transform(X.lines_of(content), X.trim), "\n")
    pieces = F.filter(
        F.transform(F.split(trimmed, r"(?md)(?=^\[)"), lambda p: F.split(p, "\n")),
        lambda lines: F.get(lines, F.lit(0)).isin(*TOML_SECTIONS),
    )
    lines = F.flatten(F.transform(
        pieces, lambda ls: F.slice(ls, 2, F.greatest(F.size(ls) - 1, F.lit(0)))
    ))

    def parse(line, i):
        spec = F.btrim(F.regexp_extract(line, TOML_ENTRY, 2), F.lit(" \"'"))
        inline = F.regexp_extract(spec, TOML_VERSION, 1)
        return F.struct(
            i.alias("seq"),
            F.lower(F.regexp_extract(line, TOML_ENTRY, 1)).alias("name"),
            F.when(spec.startswith("{"), F.when(inline == "", "unknown").otherwise(inline))
            .otherwise(F.ltrim(spec, F.lit("^~>=<!"))).alias("version"),
        )

    entries = F.filter(
        F.transform(lines, parse),
        lambda e: (e["name"] != "python") & F.map_contains_key(table, e["name"]),
    )
    return R.when_mentioned(
        X.contains_any(content, TOML_SECTIONS)
        & content.rlike(X.names_after(dims.libraries, X.LINE_START)),
        F.transform(entries, lambda e: R.finding(
            R.PYPROJECT, e["name"], e["version"], "Python (Poetry/PEP)",
            F.element_at(table, e["name"])["risk"], F.element_at(table, e["name"])["desc"],
            path, seq=e["seq"],
        )),
    )
