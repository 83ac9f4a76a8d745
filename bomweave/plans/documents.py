"""Documents: BOM JSON, CycloneDX JSON, Annex IV markdown.

Each is a set of ordered parts over the flat report tables (see
``operators.assembly``). Timestamps are arguments, never the current time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import absent, json_array, json_object, json_string, rfc3339, serial_number, text
from ..operators import measures
from ..operators.assembly import assembled, part, union_parts
from ..operators.scan import KEYS, ORDER
from ..operators.skew import PAGE_BYTES, first_of_group, paged
from ..schemas import DEPENDENCY_JSON
from .scan_report import Branding, ScanReport


def _depth(indent: bool, depth: int) -> int | None:
    return depth if indent else None


def _elements(df: DataFrame, section: int, body: Column, indent: bool, item: str | None = None) -> DataFrame:
    """Array elements with the separators in front; the first one opens the array."""
    order = [c for c in [*ORDER, item] if c]
    flagged = first_of_group(df, KEYS, order, "_is_first")
    pad = "\n    " if indent else ""
    lead = F.when(F.col("_is_first"), F.lit("[" + pad)).otherwise(F.lit("," + pad))
    return part(flagged, section, F.concat(lead, body), item=F.col(item) if item else None)


def _array_end(count: Column, indent: bool) -> Column:
    return F.when(count == 0, "[]").otherwise("\n  ]" if indent else "]")


def dependency_json(indent: bool = False) -> Column:
    """One dependency object; empty location and license are left out."""
    return json_object([
        ("name", json_string(text(F.col("name")))),
        ("version", json_string(text(F.col("version")))),
        ("ecosystem", json_string(text(F.col("ecosystem")))),
        ("riskLevel", json_string(text(F.col("risk_level")))),
        ("description", json_string(text(F.col("description")))),
        ("location", json_string(absent(F.col("location")))),
        ("license", json_string(absent(F.col("license")))),
    ], _depth(indent, 2))


def finops_json(indent: bool = False) -> Column:
    return json_object([
        ("resource", json_string(text(F.col("resource")))),
        ("severity", json_string(text(F.col("severity")))),
        ("description", json_string(text(F.col("description")))),
        ("location", json_string(absent(F.col("location")))),
    ], _depth(indent, 2))


def violation_json(indent: bool = False) -> Column:
    return json_object([
        ("rule", json_string(text(F.col("rule")))),
        ("severity", json_string(text(F.col("severity")))),
        ("description", json_string(text(F.col("description")))),
        ("location", json_string(absent(F.col("location")))),
    ], _depth(indent, 2))


def bom_json(report: ScanReport, indent: bool = False, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """The BOM document as JSON text, in the field order the proof hash uses."""
    stats = report.statistics()
    gap, new = (" ", "\n  ") if indent else ("", "")
    commit = absent(F.col("commit_sha"))

    def field(name):
        return F.lit(f'"{name}":{gap}')

    comma = F.lit("," + new)
    head = F.concat(
        F.lit("{" + new), field("projectName"), json_string(text(F.col("project"))), comma,
        F.coalesce(F.concat(field("commitSha"), json_string(commit), comma), F.lit("")),
        field("scannedFiles"), F.col("scanned_files").cast("string"), comma, field("dependencies"),
    )
    broken = F.col("blockers") + F.col("warnings")
    after_deps = F.concat(_array_end(F.col("components"), indent), comma, field("finOps"))
    after_fins = F.concat(
        _array_end(F.col("cost_findings"), indent), comma,
        F.when(broken > 0, field("policyViolations")).otherwise(F.lit("")),
    )
    tail = F.concat(
        F.when(broken > 0, F.concat(_array_end(broken, indent), comma)).otherwise(F.lit("")),
        field("complianceStatus"), json_string(F.col("compliance_status")), F.lit("\n}" if indent else "}"),
    )
    return assembled(union_parts(
        part(stats, 10, head),
        _elements(report.dependencies, 20, dependency_json(indent), indent),
        part(stats, 30, after_deps),
        _elements(report.finops, 40, finops_json(indent), indent),
        part(stats, 50, after_fins),
        _elements(report.violations, 60, violation_json(indent), indent, "violation_no"),
        part(stats, 70, tail),
    ), page_bytes, "bom_json")


def dependencies_of_pages(documents: DataFrame, column: str = "bom_json") -> DataFrame:
    """Dependencies of BOM documents, compact or indented, page by page: ``project, commit_sha,
    page, position`` and the fields. A dependency is the only object of strings that starts with
    a name, and pages never cut one, so no document has to be put together."""
    text = r'"(?:[^"\\]|\\.)*+"'
    more = r'(?:\s*+,\s*+"[a-zA-Z]++":\s*+' + text + r")*+"
    objects = F.regexp_extract_all(F.col(column), F.lit(r'\{\s*+"name":\s*+' + text + more + r"\s*+\}"), 0)
    return documents.select(*KEYS, "page", F.posexplode(objects).alias("position", "_json")).select(
        *KEYS, "page", "position", F.from_json("_json", DEPENDENCY_JSON).alias("d")).select(
        *KEYS, "page", "position", "d.name", "d.version", "d.ecosystem", F.col("d.riskLevel").alias("risk_level"),
        "d.description", "d.location", "d.license")


def nested_bom(report: ScanReport, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """The BOM as nested arrays, in ``page`` rows: a scan's arrays are those of its pages
    one after the other. A page holds entries of about ``page_bytes``."""
    def entries(df, section, names, item="0"):
        body = F.struct(*[F.col(c) for c in names])
        return df.select(
            *KEYS, F.lit(section).alias("section"), *ORDER, F.expr(item).cast("int").alias("item"),
            F.octet_length(F.concat_ws("", *names)).alias("_bytes"),
            *[(body if section == s else F.lit(None)).alias(a) for s, a in enumerate(arrays)],
        )

    arrays = ["dependencies", "fin_ops", "policy_violations"]
    rows = (
        entries(report.dependencies, 0,
                ["name", "version", "ecosystem", "risk_level", "description", "location", "license"])
        .unionByName(entries(report.finops, 1, ["resource", "severity", "description", "location"]))
        .unionByName(entries(report.violations, 2, ["rule", "severity", "description", "location"], "violation_no"))
    )
    order = ["section", *ORDER, "item"]
    ordered = paged(rows, KEYS, order, F.col("_bytes"), page_bytes).groupBy(*KEYS, "page").agg(
        F.array_sort(F.collect_list(F.struct(*order, *arrays))).alias("_all")
    )

    def of(section, name):
        return F.transform(
            F.filter("_all", lambda e: e["section"] == section), lambda e: e[name]
        ).alias(name)

    stats = report.statistics().select(*KEYS, "scanned_files", "compliance_status")
    return stats.join(
        ordered.select(*KEYS, "page", *[of(s, a) for s, a in enumerate(arrays)]), KEYS, "left"
    ).select(
        *KEYS, F.coalesce("page", F.lit(0)).alias("page"), "scanned_files",
        *[F.coalesce(a, F.array().cast(rows_type)).alias(a) for a, rows_type in
          ((a, f"array<{rows.schema[a].dataType.simpleString()}>") for a in arrays)],
        "compliance_status",
    )


def component_json(prefix: str, indent: bool = False) -> Column:
    """One CycloneDX component. ``bom-ref`` is always present and empty."""
    name, version, ecosystem = text(F.col("name")), text(F.col("version")), text(F.col("ecosystem"))
    deep = _depth(indent, 4)

    def prop(key, value):
        return F.when(value.isNotNull(), json_object(
            [("name", json_string(F.lit(f"{prefix}:{key}"))), ("value", json_string(value))], deep))

    properties = F.filter(F.array(
        prop("riskLevel", text(F.col("risk_level"))), prop("ecosystem", ecosystem),
        prop("description", text(F.col("description"))), prop("location", absent(F.col("location"))),
    ), lambda p: p.isNotNull())
    license = json_string(absent(F.col("license")))
    licenses = F.when(license.isNotNull(), json_array(F.array(json_object(
        [("license", json_object([("name", license)], _depth(indent, 5)))], deep)), _depth(indent, 3)))
    return json_object([
        ("type", json_string(measures.component_type(name, ecosystem))),
        ("bom-ref", F.lit('""')),
        ("name", json_string(name)),
        ("version", json_string(absent(version))),
        ("purl", json_string(measures.package_url(name, version, ecosystem))),
        ("licenses", licenses),
        ("properties", json_array(properties, _depth(indent, 3))),
    ], _depth(indent, 2))


def cyclonedx_json(report: ScanReport, generated_at: Column, indent: bool = False,
                   page_bytes: int = PAGE_BYTES) -> DataFrame:
    """CycloneDX 1.5 document per scan."""
    stats = report.statistics()
    gap, new = (" ", "\n  ") if indent else ("", "")
    project, commit = text(F.col("project")), F.col("commit_sha")
    subject = json_object([
        ("type", F.lit('"application"')), ("bom-ref", F.lit('""')),
        ("name", json_string(project)), ("version", json_string(absent(commit))),
    ], _depth(indent, 2))
    metadata = json_object(
        [("timestamp", json_string(rfc3339(generated_at))), ("component", subject)], _depth(indent, 1))
    head = F.concat(
        F.lit("{" + new), F.lit(f'"bomFormat":{gap}"CycloneDX",{new}"specVersion":{gap}"1.5",{new}'),
        F.lit(f'"serialNumber":{gap}'), json_string(serial_number(project, commit)),
        F.lit(f',{new}"version":{gap}1,{new}"metadata":{gap}'), metadata, F.lit(f',{new}"components":{gap}'),
    )
    tail = F.concat(_array_end(F.col("components"), indent), F.lit("\n}" if indent else "}"))
    return assembled(union_parts(
        part(stats, 10, head),
        _elements(report.dependencies, 20, component_json(report.branding.property_prefix, indent), indent),
        part(stats, 30, tail),
    ), page_bytes, "cyclonedx_json")


# --- Annex IV -----------------------------------------------------------------
# Fixed text: the wording and the manual-input markers of the document.

TITLE = "# EU AI Act - Annex IV Technical Documentation\n\n"
SECTION_1 = "## 1. General System Description (Annex IV, Section 1)\n"
PURPOSE = "- **Intended Purpose:** `[REQUIRES MANUAL INPUT: Describe the exact purpose of this AI system]`\n\n"
SECTION_2 = "## 2. System Architecture & Components (Annex IV, Section 2)\n"
SECTION_2A = "### 2(a) Pre-trained Systems & Dependencies (AI-BOM)\n"
NO_DEPENDENCIES = "No AI dependencies detected."
SECTION_2B = "### 2(b) Licensing Compliance Summary\n"
SECTION_2C = "### 2(c) Hardware Requirements & Deployment (FinOps Telemetry)\n"
NO_HARDWARE = (
    "No specific hardware constraints or GPU requests detected in infrastructure manifests."
)
SECTION_3 = "## 3. Continuous Risk Management (Article 9 & Annex IV, Section 4)\n"
SECTION_3A = "### 3(a) Automated Risk Register\n"
REGISTER_HEAD = "\n| Component | Risk | Location | Mitigation |\n|---|---|---|---|\n"
NO_HIGH_RISK = "No high-risk AI components detected.\n\n"
SECTION_3B = "### 3(b) Policy-as-Code Compliance\n"
SECTION_3C = "### 3(c) Automated CI/CD Pipeline Controls\n"
VALIDATED = "- [x] High-risk dependency constraints validated.\n"
NOT_VALIDATED = "- [ ] **BLOCKER:** High-risk AI dependencies detected without explicit mitigation.\n"
INJECTION = "- [ ] `[REQUIRES MANUAL INPUT: Detail prompt injection mitigation strategy]`\n\n"
SECTION_4 = (
    "## 4. Human Oversight & Data Governance (Annex IV, Section 3)\n"
    "- **Human-in-the-loop (HITL) Controls:** `[REQUIRES MANUAL INPUT]`\n"
    "- **Training Data Provenance:** `[REQUIRES MANUAL INPUT]`\n"
)
BIAS = "- **Bias Monitoring:** `[REQUIRES MANUAL INPUT]`\n\n"


def dependency_line(get=F.col) -> Column:
    """One line of section 2(a); ``get`` reads a field of a row or of an array entry."""
    license = F.coalesce(F.concat(F.lit(" [License: "), absent(get("license")), F.lit("]")), F.lit(""))
    return F.concat(
        F.lit("- **"), text(get("name")), F.lit("** (v"), text(get("version")), F.lit(")"), license,
        F.lit(": "), text(get("description")), F.lit(" (Risk: "), text(get("risk_level")), F.lit(")\n"),
    )


def cost_lines(get=F.col) -> Column:
    return F.concat(
        F.lit("- **Resource:** "), text(get("resource")), F.lit("\n  - **Finding:** "),
        text(get("description")), F.lit("\n  - **Severity:** "), text(get("severity")), F.lit("\n"))


def register_line(get=F.col) -> Column:
    return F.concat(
        F.lit("| "), text(get("name")), F.lit(" (v"), text(get("version")), F.lit(") | "),
        text(get("risk_level")), F.lit(" | "), text(get("location")), F.lit(" | `[REQUIRES INPUT]` |\n"))


def violation_line(get=F.col) -> Column:
    return F.concat(
        F.when(get("severity") == "Blocker", "- 🚫 [").otherwise("- ⚠️ ["), text(get("rule")), F.lit("] "),
        text(get("description")), F.lit(" ("), text(get("location")), F.lit(")\n"))


def ecosystem_head(ecosystem: Column) -> Column:
    return F.concat(F.lit("\n**"), ecosystem, F.lit(":**\n"))


def license_line(license: Column, components: Column) -> Column:
    return F.concat(F.lit("  - "), license, F.lit(": "), components.cast("string"), F.lit(" component(s)\n"))


@dataclass(frozen=True)
class AnnexFrame:
    """The text between the lists, from the columns of ``scan_statistics``."""

    head: Column
    licensing: Column
    hardware: Column
    risk: Column
    policy: Column
    closing: Column


def annex_frame(system_name: Column, generated_at: Column, branding: Branding) -> AnnexFrame:
    product, policy_file = branding.product, branding.policy_file
    stamp, commit = rfc3339(generated_at), text(F.col("commit_sha"))

    def number(name):
        return F.col(name).cast("string")

    def only_if(condition, value):
        return F.when(condition, value).otherwise(F.lit(""))

    broken = F.col("blockers") + F.col("warnings")
    return AnnexFrame(
        head=F.concat(
            F.lit(TITLE), F.lit("*Generated: "), stamp, F.lit("*\n\n"), F.lit(SECTION_1),
            F.lit("- **System Name:** "), text(system_name),
            F.lit("\n- **Version / Commit SHA:** `"), commit,
            F.lit("`\n- **Total Files Scanned:** "), number("scanned_files"),
            F.lit("\n- **AI Components Detected:** "), number("components"), F.lit("\n"),
            F.lit(PURPOSE), F.lit(SECTION_2 + "\n" + SECTION_2A),
            only_if(F.col("components") == 0, F.lit(NO_DEPENDENCIES + "\n\n")),
        ),
        licensing=F.concat(
            only_if(F.col("components") > 0, F.lit("\n")), F.lit(SECTION_2B),
            F.lit("- **Components with license data:** "), number("licensed"), F.lit(" / "), number("components"),
            F.lit("\n- **High-risk components missing license:** "), number("unlicensed_high_risk"), F.lit("\n"),
            only_if(F.col("licensed") > 0, F.lit("- **License distribution:**\n")),
        ),
        hardware=F.concat(
            F.lit("\n" + SECTION_2C), only_if(F.col("cost_findings") == 0, F.lit(NO_HARDWARE + "\n\n"))),
        risk=F.concat(
            only_if(F.col("cost_findings") > 0, F.lit("\n")), F.lit(SECTION_3),
            F.lit("**Current Automated Posture:** "), F.col("compliance_status"), F.lit("\n\n" + SECTION_3A),
            F.when(F.col("register_rows") > 0, F.lit(REGISTER_HEAD)).otherwise(F.lit(NO_HIGH_RISK)),
        ),
        policy=F.concat(
            only_if(F.col("register_rows") > 0, F.lit("\n")),
            only_if(F.col("exposed_secrets") > 0, F.concat(
                F.lit("⚠️ **CRITICAL:** "), number("exposed_secrets"),
                F.lit(" exposed secret(s) detected in source code. Immediate remediation required.\n\n"))),
            F.lit(SECTION_3B),
            F.when(broken == 0, F.lit(
                f"- [x] No policy violations detected (or no `{policy_file}` policy file configured)\n\n"
            )).otherwise(F.concat(
                F.lit("- **Blockers:** "), number("blockers"), F.lit("\n- **Warnings:** "), number("warnings"),
                F.lit("\n\n"))),
        ),
        closing=F.concat(
            only_if(broken > 0, F.lit("\n")), F.lit(SECTION_3C),
            F.when(F.col("compliance_status") == measures.PASSED, VALIDATED).otherwise(NOT_VALIDATED),
            F.lit(INJECTION), F.lit(SECTION_4 + BIAS),
            F.lit(
                f"## 5. Immutable Compliance Proof ({product} Proof Drill)\n"
                f"This document was generated by **{product}** — an automated AI compliance scanner.\n"
                "The AI-BOM, this Annex IV template, and the commit SHA have been cryptographically\n"
                "hashed together to create an immutable audit trail.\n\n- **Commit SHA:** `"),
            commit, F.lit("`\n- **Scan Timestamp:** "), stamp,
            F.lit(f"\n- **Cryptographic proof hash available in the {product} Cloud dashboard.**\n"),
        ),
    )


def annex_iv(report: ScanReport, generated_at: Column, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """Annex IV markdown per scan: ``project, commit_sha, page, markdown``."""
    stats, deps = report.statistics(), report.dependencies
    frame = annex_frame(F.col("project"), generated_at, report.branding)
    ecosystems = deps.select(*KEYS, text(F.col("ecosystem")).alias("grp")).distinct()
    shares = measures.license_distribution(deps)
    return assembled(union_parts(
        part(stats, 10, frame.head),
        part(ecosystems, 20, ecosystem_head(F.col("grp")), F.col("grp"), 0),
        part(deps, 20, dependency_line(), text(F.col("ecosystem")), 1),
        part(stats, 30, frame.licensing),
        part(shares, 40, license_line(F.col("license"), F.col("components")), F.col("license")),
        part(stats, 50, frame.hardware),
        part(report.finops, 60, cost_lines()),
        part(stats, 70, frame.risk),
        part(measures.risk_register(deps), 80, register_line()),
        part(stats, 90, frame.policy),
        part(report.violations, 100, violation_line(), item=F.col("violation_no")),
        part(stats, 110, frame.closing),
    ), page_bytes, "markdown")


def annex_iv_of_boms(boms: DataFrame, generated_at: str, branding: Branding = Branding()) -> DataFrame:
    """Add ``annex_iv_markdown`` to rows that each hold a whole BOM (``bom``).

    A document that came in as one row is rendered inside that row, from its
    arrays: nothing is exploded, grouped or shuffled. ``generated_at`` names the
    timestamp column. The posture is the one the document states.
    """
    deps, fins, broken = [
        F.coalesce(F.col(f"bom.{name}"), F.expr(f"cast(array() AS {boms.select('bom.' + name).schema[0].dataType.simpleString()})"))
        for name in ("dependencies", "finOps", "policyViolations")
    ]

    def field(entry):
        return lambda name: entry["riskLevel" if name == "risk_level" else name]

    def having(test):
        return F.size(F.filter(F.col("_deps"), test)).cast("long")

    def licensed(d):
        return text(d["license"]) != ""

    def listed(array, line):
        return F.array_join(F.transform(array, lambda e: line(field(e))), "")

    def registered(d):
        return measures.is_high(text(d["riskLevel"])) & (text(d["name"]) != measures.SECRET)

    rows = boms.withColumns({"_deps": deps, "_fins": fins, "_broken": broken}).withColumns({
        "_commit": F.col("commit_sha") if "commit_sha" in boms.columns else F.lit(None),
        "commit_sha": text(F.col("bom.commitSha")),
        "scanned_files": F.coalesce("bom.scannedFiles", F.lit(0)),
        "compliance_status": text(F.col("bom.complianceStatus")),
        "components": F.size("_deps").cast("long"),
        "licensed": having(licensed),
        "unlicensed_high_risk": having(lambda d: ~licensed(d) & measures.is_high(text(d["riskLevel"]))),
        "register_rows": having(registered),
        "exposed_secrets": having(lambda d: text(d["name"]) == measures.SECRET),
        "cost_findings": F.size("_fins").cast("long"),
        "blockers": F.size(F.filter("_broken", lambda v: text(v["severity"]) == "Blocker")).cast("long"),
        "warnings": F.size(F.filter("_broken", lambda v: text(v["severity"]) != "Blocker")).cast("long"),
    })
    frame = annex_frame(F.col("bom.projectName"), F.col(generated_at), branding)
    all_deps = F.col("_deps")
    ecosystems = F.array_sort(F.array_distinct(F.transform(all_deps, lambda d: text(d["ecosystem"]))))
    licenses = F.array_sort(F.array_distinct(F.transform(F.filter(all_deps, licensed), lambda d: d["license"])))
    markdown = F.concat(
        frame.head,
        F.array_join(F.transform(ecosystems, lambda e: F.concat(ecosystem_head(e), listed(
            F.filter(all_deps, lambda d: text(d["ecosystem"]) == e), dependency_line))), ""),
        frame.licensing,
        F.array_join(F.transform(licenses, lambda n: license_line(
            n, F.size(F.filter(all_deps, lambda d: d["license"] == n)))), ""),
        frame.hardware, listed(F.col("_fins"), cost_lines),
        frame.risk, listed(F.filter(all_deps, registered), register_line),
        frame.policy, listed(F.col("_broken"), violation_line),
        frame.closing,
    )
    return rows.select(
        *[F.col("_commit").alias(c) if c == "commit_sha" else F.col(c) for c in boms.columns],
        markdown.alias("annex_iv_markdown"))


def annex_iv_preview(report: ScanReport, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """The short preview: sections 1 to 4, without counts and timestamps."""
    stats = report.statistics()
    deps = first_of_group(report.dependencies, KEYS, ORDER, "_is_first")
    fins = first_of_group(report.finops, KEYS, ORDER, "_is_first")
    between = F.when(F.col("_is_first"), F.lit("")).otherwise(F.lit("\n"))
    whole = dependency_line()
    line = F.substring(whole, F.lit(1), F.length(whole) - 1)
    head = F.concat(
        F.lit(TITLE + SECTION_1), F.lit("- **System Name:** "), text(F.col("project")),
        F.lit("\n- **Version / Commit SHA:** `Pending CI/CD Injection`\n" + PURPOSE + SECTION_2 + SECTION_2A),
        F.when(F.col("components") == 0, F.lit(NO_DEPENDENCIES)).otherwise(F.lit("")),
    )
    hardware = F.concat(
        F.lit("\n\n" + SECTION_2C), F.when(F.col("cost_findings") == 0, F.lit(NO_HARDWARE)).otherwise(F.lit("")))
    closing = F.concat(
        F.lit("\n\n" + SECTION_3 + "**Current Automated Posture:** "), F.col("compliance_status"),
        F.lit("\n\n*Automated CI/CD Pipeline Controls:*\n"),
        F.when(F.col("compliance_status") == measures.PASSED, VALIDATED).otherwise(NOT_VALIDATED),
        F.lit(INJECTION + SECTION_4),
    )
    finding = F.concat(
        between, F.lit("- **Resource:** "), text(F.col("resource")),
        F.lit("\n  - **Finding:** "), text(F.col("description")))
    return assembled(union_parts(
        part(stats, 10, head),
        part(deps, 20, F.concat(between, line)),
        part(stats, 30, hardware),
        part(fins, 40, finding),
        part(stats, 50, closing),
    ), page_bytes, "markdown")
