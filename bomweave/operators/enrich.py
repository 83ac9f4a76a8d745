"""License and risk enrichment of dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims as D
from ..functions import text as X
from ..functions.ids import absent


def is_model(name: Column, ecosystem: Column) -> Column:
    return (name == "Hardcoded Model") | ecosystem.startswith("Model Weight")


def license_source(name: Column, version: Column, ecosystem: Column, dims: D.Dictionaries) -> Column:
    """Matched license entry ``struct(key, hf_id, license)`` or NULL; looks at the
    version, or at the name of a local weight file. An array literal in priority
    order, so no join."""
    table = D.struct_array(
        [(k, *dims.licenses[k]) for k in D.first_match_order(dims.licenses)], ("key", "hf_id", "license")
    )
    value = F.lower(F.when(version == "local", name).otherwise(version))
    return F.when(
        is_model(name, ecosystem),
        F.get(F.filter(table, lambda e: value.contains(e["key"])), F.lit(0)),
    )


def registry_licenses(registry: DataFrame, dims: D.Dictionaries = D.DEFAULT) -> DataFrame:
    """``hf_id, registry_license`` for the ids the license dictionary names.

    The registry may be large; the IN filter reaches its scan and leaves at most
    one row per dictionary entry, which bounds the broadcast below.
    """
    wanted = sorted({hf_id for hf_id, _ in dims.licenses.values() if hf_id})
    tag = F.get(F.filter("tags", lambda t: t.startswith("license:")), F.lit(0))
    return (
        registry.filter(F.col("hf_id").isin(*wanted))
        .groupBy("hf_id").agg(F.min("tags").alias("tags"))
        .select("hf_id", F.substring(tag, F.lit(9), F.length(tag)).alias("registry_license"))
    )


def with_licenses(deps: DataFrame, registry: DataFrame | None = None,
                  dims: D.Dictionaries = D.DEFAULT) -> DataFrame:
    """Fill ``license``: proprietary licenses from the dictionary, the others from
    the supplied registry table. A license already present is kept when nothing
    new is found."""
    hit = license_source(F.col("name"), F.col("version"), F.col("ecosystem"), dims)
    out = deps.withColumn("_hit", hit)
    known = absent(F.col("_hit.license"))
    if registry is None:
        found = known
    else:
        lookup = F.broadcast(registry_licenses(registry, dims))  # at most len(dims.licenses) rows
        out = out.withColumn("hf_id", F.when(known.isNull(), F.col("_hit.hf_id"))).join(lookup, "hf_id", "left")
        found = F.coalesce(known, absent(F.col("registry_license")))
    return out.withColumn("license", F.coalesce(found, F.col("license"))).drop("_hit", "hf_id", "registry_license")


def with_owasp_risks(deps: DataFrame, dims: D.Dictionaries = D.DEFAULT) -> DataFrame:
    """Append the known machine-learning risks to the description, once."""
    notes = D.string_map({name: " | OWASP ML: " + "; ".join(risks) for name, risks in dims.owasp.items()})
    note = F.element_at(notes, F.lower("name"))
    text = F.col("description")
    return deps.withColumn(
        "description",
        F.when(note.isNotNull() & ~text.contains("OWASP"), F.concat(text, note)).otherwise(text),
    )


def enriched(deps: DataFrame, registry: DataFrame | None = None, dims: D.Dictionaries = D.DEFAULT) -> DataFrame:
    return with_owasp_risks(with_licenses(deps, registry, dims), dims)


def library_lookup(df: DataFrame, dims: D.Dictionaries = D.DEFAULT, name_column: str = "name") -> DataFrame:
    """Inner equi-join of package names with the library dictionary.

    The dictionary is a literal of at most ``MAX_DICTIONARY_ENTRIES`` rows, which
    is what makes the broadcast safe.
    """
    table = F.broadcast(dims.library_frame(df.sparkSession)).withColumnRenamed("name", "_library")
    return (
        df.join(table, F.lower(F.col(name_column)) == F.col("_library")).drop("_library")
    )


def model_mentions(df: DataFrame, text_column: str, dims: D.Dictionaries = D.DEFAULT) -> DataFrame:
    """Semi join of a text column with the model identifiers (case-sensitive)."""
    return df.filter(X.mentions_any(F.col(text_column), dims.models))
