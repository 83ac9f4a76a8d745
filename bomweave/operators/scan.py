"""Corpus scan: one narrow pass over ``files`` that runs every detector.

``files`` holds ``project, commit_sha, path, content``. Each row is routed by its
path, the detectors that apply build one ``array<finding>``, and a single
``explode`` yields the findings. The table is read once, whatever the number of
detectors, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims as D
from ..functions import text as X
from .detect import artifacts, containers, manifests, secrets, source_code
from .detect import finding as R

KEYS = ["project", "commit_sha"]
ORDER = ["path_key", "detector", "line_no", "seq"]
FINOPS_DETECTORS = (R.KUBERNETES, R.HELM, R.TERRAFORM)


def visible(path: Column) -> Column:
    """False below a hidden directory; hidden files themselves are visible."""
    folders = F.split(path, "/")
    folders = F.slice(folders, F.lit(1), F.greatest(F.size(folders) - 1, F.lit(0)))
    return ~F.exists(folders, lambda d: d.startswith(".") & ~d.isin(".", ".."))


def keyed(files: DataFrame) -> DataFrame:
    """A scan without commit has the empty one: NULL keys would not join."""
    return files.withColumn("commit_sha", F.coalesce("commit_sha", F.lit("")))


def visible_files(files: DataFrame) -> DataFrame:
    return keyed(files).filter(visible(F.col("path")))


def kind_tests(path: Column, dims: D.Dictionaries = D.DEFAULT) -> dict[str, Column]:
    """Which detectors apply to a path. One file can be of several kinds."""
    name = X.base_name(path)
    ext = F.lower(X.extension(name))
    is_yaml = ext.isin(".yaml", ".yml")
    return {
        "requirements": name == "requirements.txt",
        "package_json": name == "package.json",
        "go_mod": name == "go.mod",
        "pyproject": name == "pyproject.toml",
        "dockerfile": (name == "Dockerfile") | name.startswith("Dockerfile."),
        "go_source": name.endswith(".go"),
        "py_source": name.endswith(".py"),
        "env_file": name.endswith(".env"),
        "weights": ext.isin(*dims.weight_extensions),
        "kubernetes": is_yaml,
        "helm": name.isin("values.yaml", "values.yml"),
        "terraform": ext == ".tf",
    }


def file_kinds(files: DataFrame, dims: D.Dictionaries = D.DEFAULT) -> DataFrame:
    """``project, commit_sha, path, kind``: one row per applicable detector."""
    tests = kind_tests(F.col("path"), dims)
    kinds = R.present(F.array(*[F.when(test, F.lit(kind)) for kind, test in tests.items()]))
    return visible_files(files).select(*KEYS, "path", F.explode(kinds).alias("kind"))


def _build(kind: str, dims: D.Dictionaries) -> Column:
    path, content = F.col("path"), F.col("content")
    return {
        "requirements": lambda: manifests.requirements(path, content, dims),
        "package_json": lambda: manifests.package_json(path, content, dims),
        "go_mod": lambda: manifests.go_mod(path, content, dims),
        "pyproject": lambda: manifests.pyproject(path, content, dims),
        "dockerfile": lambda: containers.dockerfile(path, content, dims),
        "go_source": lambda: source_code.go_literals(path, content, dims),
        "py_source": lambda: F.concat(
            source_code.python_imports(path, content, dims),
            source_code.python_literals(path, content, dims),
        ),
        "env_file": lambda: secrets.env_file(path, content, dims),
        "weights": lambda: artifacts.weight_file(path, dims),
        "kubernetes": lambda: artifacts.kubernetes_gpu(path, content),
        "helm": lambda: artifacts.helm_values(path, content, dims),
        "terraform": lambda: artifacts.terraform_gpu(path, content, dims),
    }[kind]()


_columns: dict = {}


def detector_column(kind: str, dims: D.Dictionaries = D.DEFAULT) -> Column:
    """The ``array<finding>`` expression of a file kind over ``path, content``.

    Expressions of the default dictionaries are kept: building one takes hundreds
    of JVM calls, and it refers to columns by name only.
    """
    if dims is not D.DEFAULT:
        return _build(kind, dims)
    key = (SparkContext._active_spark_context.applicationId, kind)
    if key not in _columns:
        _columns[key] = _build(kind, dims)
    return _columns[key]


def findings(
    files: DataFrame,
    dims: D.Dictionaries = D.DEFAULT,
    kinds: list[str] | None = None,
) -> DataFrame:
    """All findings of the corpus, dependencies and cost findings alike.

    ``kinds`` restricts the scan to some file kinds; the restriction is a filter
    on ``path``, ahead of any look at the content.
    """
    tests = kind_tests(F.col("path"), dims)
    wanted = list(tests) if kinds is None else kinds
    applicable = F.lit(False)
    found = []
    for kind in wanted:
        applicable = applicable | tests[kind]
        column = detector_column(kind, dims)
        found.append(F.when(tests[kind], column).otherwise(R.no_findings()))
    all_found = found[0] if len(found) == 1 else F.concat(*found)
    return (
        visible_files(files)
        .filter(applicable)
        .withColumn("content", F.coalesce("content", F.lit("")))
        .select(*KEYS, "path", F.explode(all_found).alias("f"))
        .select(*KEYS, "path", F.split("path", "/").alias("path_key"), "f.*")
    )


def dependencies(found: DataFrame) -> DataFrame:
    """The dependency part of a findings table (no license yet)."""
    return found.filter(~F.col("detector").isin(*FINOPS_DETECTORS)).select(
        *KEYS, "path", *ORDER, "name", "version", "ecosystem",
        F.col("level").alias("risk_level"), "description", "location",
        F.lit(None).cast("string").alias("license"),
    )


def finops(found: DataFrame) -> DataFrame:
    """The cost part of a findings table."""
    return found.filter(F.col("detector").isin(*FINOPS_DETECTORS)).select(
        *KEYS, "path", *ORDER, F.col("name").alias("resource"),
        F.col("level").alias("severity"), "description", "location",
    )


def scanned_files(files: DataFrame) -> DataFrame:
    """``scanned_files`` per scan; reads no content, counts map-side first."""
    return visible_files(files).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("scanned_files"))
