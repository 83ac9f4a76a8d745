"""Source files: imports, hardcoded model identifiers and secrets (.py, .go)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import dims as D
from ...functions import text as X
from ...schemas import FINDING
from . import finding as R

# fixed patterns
IMPORT = (
    rf"^{X.RE_SPACE}*(?:import{X.RE_SPACE}+([a-zA-Z0-9_]+)"
    rf"|from{X.RE_SPACE}+([a-zA-Z0-9_]+)(?:\.[a-zA-Z0-9_.]+)?{X.RE_SPACE}+import)"
)
PY_LITERAL = r"""(?:"[^"]*"|'[^']*')"""
SECRET_PREFIX = "sk-"
SECRET_BYTES = 20

# One token of Go text: comments, the two string forms, runes, anything else.
# Possessive quantifiers keep the match iterative on long literals.
GO_TOKEN = (
    r"//[^\n]*+"
    r"|(?s:/\*.*?\*/)"
    r'|"(?:[^"\\\n]|\\[^\n])*+"'
    r"|`[^`]*+`"
    r"|'(?:[^'\\\n]|\\[^\n])*+'"
    r"""|[^"`'/]++"""
    r"|(?s:.)"
)


def is_secret(value: Column) -> Column:
    return value.startswith(SECRET_PREFIX) & (F.octet_length(value) > SECRET_BYTES)


def python_imports(path: Column, content: Column, dims: D.Dictionaries) -> Column:
    """First import of each library in the file: the position of its name in the
    per-line array of imported modules, so no grouping is needed."""
    libraries = D.struct_array(
        [(n, r, d) for n, (r, d) in sorted(dims.libraries.items())], ("name", "risk", "desc")
    )
    modules = F.transform(X.lines_of(content), lambda line: F.lower(F.concat(
        F.regexp_extract(line, IMPORT, 1), F.regexp_extract(line, IMPORT, 2)
    )))
    first_use = X.let(modules, lambda per_line: F.filter(
        F.transform(libraries, lambda lib: F.struct(
            F.array_position(per_line, lib["name"]).cast("int").alias("n"), lib.alias("lib")
        )),
        lambda e: e["n"] > 0,
    ))
    return R.when_mentioned(
        content.rlike(X.names_after(dims.libraries, r"^[\t\f\r ]*+(?:import|from)[\t\f\r ]++")),
        F.transform(first_use, lambda e: R.finding(
            R.PY_SOURCE, e["lib"]["name"], "imported", "Source Code (.py import)", e["lib"]["risk"],
            F.concat(e["lib"]["desc"], F.lit(" (detected via import statement)")),
            R.at_line(path, e["n"]), line_no=e["n"], seq=0,
        )),
    )


def python_literals(path: Column, content: Column, dims: D.Dictionaries) -> Column:
    """Quoted literals that hold a model identifier or look like a key. One
    literal can give both findings."""
    suspicious = X.contains_any(content, dims.models + [SECRET_PREFIX])
    lines = F.filter(
        R.numbered_lines(X.lines_of(content),
                         lambda line, n: F.struct(n.alias("n"), line.alias("line"))),
        lambda e: e["line"].rlike("[\"']") & X.contains_any(e["line"], dims.models + [SECRET_PREFIX]),
    )

    def of_literal(e, literal, i):
        value = F.substring(literal, F.lit(2), F.length(literal) - 2)
        model = F.when(X.mentions_any(value, dims.models), R.finding(
            R.PY_SOURCE, "Hardcoded Model", value, "Source Code (.py)", "High",
            "Hardcoded AI model identifier found in Python source code",
            R.at_line(path, e["n"]), line_no=e["n"], seq=i * 2 + 1,
        ))
        secret = F.when(is_secret(value), R.finding(
            R.PY_SOURCE, "Exposed Secret", "HIDDEN", "Source Code (.py)", "High",
            "Potential hardcoded API key found in Python source code",
            R.at_line(path, e["n"]), line_no=e["n"], seq=i * 2 + 2,
        ))
        return R.present(F.array(model, secret))

    return R.when_mentioned(suspicious, F.flatten(F.transform(lines, lambda e: F.flatten(F.transform(
        F.regexp_extract_all(e["line"], F.lit(PY_LITERAL), 0),
        lambda literal, i: of_literal(e, literal, i),
    )))))


def go_literals(path: Column, content: Column, dims: D.Dictionaries) -> Column:
    """String literals of a Go file with line and byte column.

    The text is cut into tokens and folded once, carrying line and column. This
    is a token scan, not a parser: a file with an unterminated literal or comment,
    or without a leading package clause, yields nothing; other syntax errors are
    not recognised.
    """
    def is_readable(tokens):
        broken = F.exists(tokens, lambda t: t.isin('"', "`", "'")) | F.exists(
            F.zip_with(
                tokens, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
                lambda a, b: (a == "/") & F.coalesce(b, F.lit("")).startswith("*"),
            ),
            lambda x: x,
        )
        code = F.array_join(F.filter(tokens, lambda t: ~(t.startswith("//") | t.startswith("/*"))), " ")
        return ~broken & code.rlike(r"^\x{FEFF}?\s*package\s+[\p{L}_][\p{L}\p{N}_]*")

    def of_literal(token, line, column):
        value = F.btrim(token, F.lit('"'))
        where = F.concat_ws(":", path, line.cast("string"), column.cast("string"))
        model = F.when(X.mentions_any(value, dims.models), R.finding(
            R.GO_SOURCE, "Hardcoded Model", value, "Source Code (.go)", "High",
            "Hardcoded AI model identifier found in source code", where, line_no=line, seq=column * 2,
        ))
        secret = F.when(is_secret(value), R.finding(
            R.GO_SOURCE, "Exposed Secret", "HIDDEN", "Source Code (.go)", "High",
            "Potential hardcoded API key found in source code", where, line_no=line, seq=column * 2 + 1,
        ))
        return R.present(F.array(model, secret))

    def step(acc, token):
        is_string = token.startswith('"') | token.startswith("`")
        hit = is_string & X.mentions_any(token, dims.models + [SECRET_PREFIX])
        breaks = F.length(token) - F.length(F.replace(token, F.lit("\n"), F.lit("")))
        tail = F.octet_length(F.substring_index(token, "\n", -1))
        return F.struct(
            (acc["line"] + breaks).cast("int").alias("line"),
            F.when(breaks > 0, tail + 1).otherwise(acc["col"] + F.octet_length(token)).cast("int").alias("col"),
            F.when(hit, F.concat(acc["found"], of_literal(token, acc["line"], acc["col"])))
            .otherwise(acc["found"]).alias("found"),
        )

    start = F.struct(
        F.lit(1).alias("line"), F.lit(1).alias("col"),
        F.array().cast(f"array<{FINDING}>").alias("found"),
    )
    def found(tokens):
        folded = F.aggregate(tokens, start, step, lambda acc: acc["found"])
        return F.when(is_readable(tokens), folded).otherwise(R.no_findings())

    return R.when_mentioned(
        X.contains_any(content, dims.models + [SECRET_PREFIX]),
        X.let(F.regexp_extract_all(content, F.lit(GO_TOKEN), 0), found),
    )
