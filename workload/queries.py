"""Registered queries: one per operator, over the adapters of the driver tables.

``QUERIES`` maps a name to (Spark callable, DuckDB statement). Every query reads
whole tables and whole texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomweave.functions import ids
from bomweave.operators import accounts, enrich, ledger, measures, policy, quota, scan
from bomweave.functions.storage import materialise, shared_folder
from bomweave.operators.assembly import document_hashes
from bomweave.operators.skew import numbered, salted_join
from bomweave.plans import documents, intake
from bomweave.sources import ledger as ledger_files
from bomweave.sources.events import parsed_events
from bomweave.plans.scan_report import Branding, scan_report
from bomweave.plans.scan_report import posture as posture_plan

from . import adapters as A
from . import oracles as O

KEYS = scan.KEYS
BRANDING = Branding(policy_file=A.POLICY_FILE)
GENERATED_AT = "2024-06-01 00:00:00"
LINE_COLUMNS = [*KEYS, "path", "name", "version", "ecosystem", "risk_level", "description", "location"]
COST_COLUMNS = [*KEYS, "path", "resource", "severity", "description", "location"]

QUERIES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = (fn, oracle)
        return fn

    return register


# --- inputs -------------------------------------------------------------------


def files(spark: SparkSession, sf: str) -> DataFrame:
    return A.frame(spark, sf, A.FILES)


def registry(spark, sf):
    return A.frame(spark, sf, A.REGISTRY).select("hf_id", F.array("license_tag").alias("tags"))


def volume(spark, sf):
    return A.frame(spark, sf, A.DEPENDENCIES)


def volume_policies(spark, sf):
    def some(*names):
        return F.filter(F.array(*names), lambda x: x != "")

    return A.frame(spark, sf, A.POLICIES).select(
        "project", some("allowed_model").alias("allowed_models"),
        some("blocked_model", "blocked_too").alias("blocked_models"),
        some("allowed_license").alias("allowed_licenses"), "block_on_high_risk", "require_licenses",
    )


def volume_violations(spark, sf):
    return policy.violations(volume(spark, sf), volume_policies(spark, sf), A.POLICY_FILE)


def report(spark, sf):
    return scan_report(files(spark, sf), registry(spark, sf), branding=BRANDING)


def full_report(spark, sf):
    return report(spark, sf).materialised()


def attempts(spark, sf):
    return A.frame(spark, sf, A.ATTEMPTS)


def drills(spark, sf):
    return A.frame(spark, sf, A.DRILLS)


def projects(spark, sf):
    return A.frame(spark, sf, A.PROJECTS)


def history(spark, sf):
    return ledger.history(drills(spark, sf), projects(spark, sf))


def generated_at():
    return F.lit(GENERATED_AT).cast("timestamp")


# --- detectors ----------------------------------------------------------------


def _detector(name, kind, members=None, keep=None):
    cost = kind in O.FINOPS

    @query(name, O.detector(kind, members, cost))
    def run(spark, sf):
        found = scan.findings(files(spark, sf), kinds=[kind])
        rows = scan.finops(found) if cost else scan.dependencies(found)
        if keep is not None:
            rows = rows.filter(keep())
        return rows.select(*(COST_COLUMNS if cost else LINE_COLUMNS))


_detector("detect_requirements", "requirements")
_detector("detect_package_json", "package_json")
_detector("detect_go_mod", "go_mod")
_detector("detect_pyproject", "pyproject")
_detector("detect_docker_base_images", "dockerfile", ["d5"], lambda: F.col("version") == "docker-image")
_detector("detect_docker_weight_copies", "dockerfile", ["d6"], lambda: F.col("version") == "docker-layer")
_detector("detect_docker_pip_installs", "dockerfile", ["d7"], lambda: F.col("version") == "docker-install")
_detector("detect_python_imports", "py_source", ["d8"], lambda: F.col("version") == "imported")
_detector("detect_python_models", "py_source", ["d9"], lambda: F.col("name") == "Hardcoded Model")
_detector("detect_python_secrets", "py_source", ["d10"], lambda: F.col("name") == "Exposed Secret")
_detector("detect_go_literals", "go_source")
_detector("detect_env_key_names", "env_file", ["d12"], lambda: F.col("description").contains("API key found in"))
_detector("detect_env_value_prefixes", "env_file", ["d13"], lambda: F.col("description").contains("rotate this key"))
_detector("detect_weight_files", "weights")
_detector("detect_kubernetes_gpu", "kubernetes")
_detector("detect_terraform_gpu", "terraform")
_detector("detect_helm_gpu", "helm", ["d17"], lambda: F.col("description").startswith("GPU resource"))
_detector("detect_helm_serving", "helm", ["d18"], lambda: F.col("description").startswith("AI model serving"))


@query("all_findings", O.with_(O.ctes(O.ALL_KINDS), f"SELECT project, commit_sha, path, detector, name, version, ecosystem, level, description, location FROM ({O.union(O.ALL_KINDS)})"))
def all_findings(spark, sf):
    return scan.findings(files(spark, sf)).drop("path_key", "line_no", "seq")


@query("walk_order", O.with_(O.ctes(O.ALL_KINDS), f"SELECT project, commit_sha, path, detector, name, location, position FROM (SELECT *, row_number() OVER (PARTITION BY project, commit_sha ORDER BY string_split(path, '/'), detector, line_no, seq) AS position FROM ({O.union(O.ALL_KINDS)}))"))
def walk_order(spark, sf):
    found = materialise(scan.findings(files(spark, sf)), "findings")
    return numbered(found, KEYS, scan.ORDER).select(*KEYS, "path", "detector", "name", "location", "position")


# --- scan ---------------------------------------------------------------------


@query("scanned_files", O.with_([O.BASE], "SELECT project, commit_sha, count(*) AS scanned_files FROM vis GROUP BY ALL"))
def scanned_files(spark, sf):
    return scan.scanned_files(files(spark, sf))


@query("visible_files", O.with_([O.BASE], "SELECT project, commit_sha, path, sha256(content) AS content_hash FROM vis"))
def visible_files(spark, sf):
    return scan.visible_files(files(spark, sf)).select(*KEYS, "path", ids.sha256_hex(F.col("content")).alias("content_hash"))


_KIND_SQL = {
    "requirements": "fname = 'requirements.txt'", "package_json": "fname = 'package.json'", "go_mod": "fname = 'go.mod'",
    "pyproject": "fname = 'pyproject.toml'", "dockerfile": "fname = 'Dockerfile' OR starts_with(fname, 'Dockerfile.')",
    "go_source": "ends_with(fname, '.go')", "py_source": "ends_with(fname, '.py')", "env_file": "ends_with(fname, '.env')",
    "weights": "lower(ext) IN ('.safetensors', '.onnx', '.pt', '.h5', '.gguf', '.bin', '.tflite', '.pb', '.mlmodel', '.ckpt')",
    "kubernetes": "lower(ext) IN ('.yaml', '.yml')", "helm": "fname IN ('values.yaml', 'values.yml')", "terraform": "lower(ext) = '.tf'",
}


@query("file_kinds", O.with_([O.BASE], " UNION ALL ".join(f"SELECT project, commit_sha, path, '{k}' AS kind FROM vis WHERE {c}" for k, c in _KIND_SQL.items())))
def file_kinds(spark, sf):
    return scan.file_kinds(files(spark, sf))


@query("significant_lines", O.with_([O.BASE], "SELECT project, commit_sha, path, count(*) FILTER (t <> '' AND NOT starts_with(t, '#')) AS significant, count(*) AS lines FROM lines WHERE fname LIKE '%.env' OR fname = 'requirements.txt' OR path = '.aibom.yml' GROUP BY ALL"))
def significant_lines(spark, sf):
    from bomweave.functions import text as X

    path, name = F.col("path"), X.base_name(F.col("path"))
    lines = X.lines_of(F.col("content"))
    return scan.visible_files(files(spark, sf)).filter(
        name.endswith(".env") | (name == "requirements.txt") | (path == A.POLICY_FILE)
    ).select(
        *KEYS, "path", F.size(F.filter(lines, lambda x: X.is_significant(X.trim(x)))).alias("significant"),
        F.size(lines).alias("lines"),
    )


@query("scan_posture", O.report("SELECT project, commit_sha, scanned_files, compliance_status FROM stats"))
def scan_posture(spark, sf):
    return posture_plan(files(spark, sf), branding=BRANDING)


@query("report_postures", O.report("SELECT project, commit_sha, scanned_files, compliance_status FROM stats"))
def report_postures(spark, sf):
    return report(spark, sf).postures().select(*KEYS, "scanned_files", "compliance_status")


@query("posture_without_policy", O.with_(
    O.ctes(O.DEPENDENCY_KINDS), f"SELECT s.project, s.commit_sha, scanned_files, CASE WHEN coalesce(hi, 0) > 0 THEN 'Action Required (Annex IV Documentation Missing)' ELSE 'Passed' END AS compliance_status FROM (SELECT project, commit_sha, count(*) AS scanned_files FROM vis GROUP BY ALL) s LEFT JOIN (SELECT project, commit_sha, count(*) FILTER (level = 'High') AS hi FROM ({O.union(O.DEPENDENCY_KINDS)}) GROUP BY ALL) USING (project, commit_sha)"))
def posture_without_policy(spark, sf):
    from bomweave.plans.scan_report import quick_posture

    return quick_posture(files(spark, sf))


@query("policy_source", O.with_([O.BASE, O.POLICY_CTE], "SELECT project, commit_sha, array_to_string(allowed_models, '|') AS allowed_models, array_to_string(blocked_models, '|') AS blocked_models, max_risk_level, block_on_high_risk, require_licenses, array_to_string(allowed_licenses, '|') AS allowed_licenses FROM pol"))
def policy_source(spark, sf):
    out = policy.policies(files(spark, sf), A.POLICY_FILE)
    for name in policy.LISTS:
        out = out.withColumn(name, F.array_join(name, "|"))
    return out


@query("scan_dependencies", O.report("SELECT project, commit_sha, path, name, version, ecosystem, risk_level, description, location, license FROM deps"))
def scan_dependencies(spark, sf):
    return report(spark, sf).dependencies.select(*LINE_COLUMNS, "license")


@query("scan_violations", O.report("SELECT project, commit_sha, rule, severity, vdesc AS description, location FROM vios"))
def scan_violations(spark, sf):
    return report(spark, sf).violations.select(*KEYS, "rule", "severity", "description", "location")


@query("document_sizes", O.report("SELECT project, commit_sha, components, cost_findings, blockers, warnings, register_rows, secrets AS exposed_secrets FROM stats"))
def document_sizes(spark, sf):
    return report(spark, sf).statistics().select(
        *KEYS, "components", "cost_findings", "blockers", "warnings", "register_rows", "exposed_secrets")


# --- enrichment ---------------------------------------------------------------


_MENTIONS = O.any_contains("text", __import__("bomweave.functions.dims", fromlist=["MODELS"]).MODELS)


@query("license_enrichment", O.with_(
    [O.DIMS["lic"], f"deps0 AS (SELECT *, row_number() OVER () AS rid FROM ({A.DEPENDENCIES}))", O.license_ctes("deps0")],
    "SELECT project, commit_sha, name, version, ecosystem, license, location FROM licensed"))
def license_enrichment(spark, sf):
    return enrich.with_licenses(volume(spark, sf), registry(spark, sf)).select(
        *KEYS, "name", "version", "ecosystem", "license", "location")


@query("registry_licenses", f"SELECT hf_id, substr(min(license_tag), 9) AS registry_license FROM ({A.REGISTRY}) WHERE NOT starts_with(hf_id, 'org/') GROUP BY hf_id")
def registry_licenses(spark, sf):
    return enrich.registry_licenses(registry(spark, sf))


@query("risk_annotations", O.with_(
    [O.DIMS["owasp"], O.VOLUME], "SELECT project, commit_sha, name, location, description || coalesce(note, '') AS description FROM deps LEFT JOIN owasp ON oname = lower(name)"))
def risk_annotations(spark, sf):
    once = enrich.with_owasp_risks(volume(spark, sf))
    return enrich.with_owasp_risks(once).select(*KEYS, "name", "location", "description")


@query("library_lookup", O.with_([O.DIMS["lib"], O.VOLUME], "SELECT project, commit_sha, name, location, lrisk AS risk, ldesc AS \"desc\" FROM deps JOIN lib ON lname = lower(name)"))
def library_lookup(spark, sf):
    return enrich.library_lookup(volume(spark, sf)).select(*KEYS, "name", "location", "risk", "desc")


@query("model_membership", O.with_([O.DIMS["mdl"], O.VOLUME], "SELECT project, commit_sha, version, location FROM deps WHERE EXISTS (SELECT 1 FROM mdl WHERE contains(version, model))"))
def model_membership(spark, sf):
    return enrich.model_mentions(volume(spark, sf), "version").select(*KEYS, "version", "location")


# --- policy rules ---------------------------------------------------------------


_RULES = O.with_([O.VOLUME, O.VOLUME_POLICIES], f"SELECT project, commit_sha, rule, severity, vdesc AS description, location FROM ({O.violation_rules('deps', 'pol', 'project')})")


@query("policy_violations", _RULES)
def policy_violations(spark, sf):
    return volume_violations(spark, sf).select(*KEYS, "rule", "severity", "description", "location")


def _rule(name):
    @query(f"rule_{name}", f"SELECT * FROM ({_RULES}) WHERE rule = '{name}'")
    def run(spark, sf):
        return policy_violations(spark, sf).filter(F.col("rule") == name)


for _name in policy.RULES:
    _rule(_name)


@query("allow_list_misses", O.with_([O.VOLUME, O.VOLUME_POLICIES], "SELECT d.project, name, version, license, location FROM deps d JOIN pol USING (project) WHERE (len(allowed_models) > 0 AND name = 'Hardcoded Model' AND NOT contains(lower(version), allowed_models[1])) OR (len(allowed_licenses) > 0 AND license IS NOT NULL AND lower(license) <> lower(allowed_licenses[1]))"))
def allow_list_misses(spark, sf):
    joined = salted_join(volume(spark, sf), volume_policies(spark, sf), ["project"], ["location"], how="inner")
    return joined.filter(
        policy.misses_model_list(F.col("name"), F.col("version"), F.col("ecosystem"), F.col("allowed_models"))
        | policy.misses_license_list(F.col("license"), F.col("allowed_licenses"))
    ).select("project", "name", "version", "license", "location")


@query("violations_by_severity", O.with_([O.VOLUME, O.VOLUME_POLICIES], f"SELECT project, commit_sha, count(*) FILTER (severity = 'Blocker') AS blockers, count(*) FILTER (severity <> 'Blocker') AS warnings FROM ({O.violation_rules('deps', 'pol', 'project')}) GROUP BY ALL"))
def violations_by_severity(spark, sf):
    return measures.violations_by_severity(volume_violations(spark, sf))


# --- measures at volume ---------------------------------------------------------


@query("posture", O.with_([O.VOLUME, O.VOLUME_POLICIES], f"SELECT d.project, d.commit_sha, CASE WHEN coalesce(bl, 0) > 0 THEN 'Blocked by Policy' WHEN hi > 0 THEN 'Action Required (Annex IV Documentation Missing)' ELSE 'Passed' END AS compliance_status, coalesce(bl, 0) = 0 AND hi = 0 AS gate_passed, CASE WHEN coalesce(bl, 0) = 0 AND hi = 0 THEN 0 ELSE 1 END AS exit_code FROM (SELECT project, commit_sha, count(*) FILTER (risk_level = 'High') AS hi FROM deps GROUP BY ALL) d LEFT JOIN (SELECT project, commit_sha, count(*) FILTER (severity = 'Blocker') AS bl FROM ({O.violation_rules('deps', 'pol', 'project')}) GROUP BY ALL) v USING (project, commit_sha)"))
def posture(spark, sf):
    deps = volume(spark, sf)
    scans = deps.select(*KEYS).distinct()
    return measures.gate(measures.posture(scans, deps, volume_violations(spark, sf)))


@query("dependencies_by_ecosystem", O.with_([O.VOLUME], "SELECT project, commit_sha, ecosystem, count(*) AS components, count(*) FILTER (risk_level = 'High') AS high_risk, min(name) AS first_name, max(name) AS last_name FROM deps GROUP BY project, commit_sha, ecosystem"))
def dependencies_by_ecosystem(spark, sf):
    return measures.by_ecosystem(volume(spark, sf))


@query("licensing_summary", O.with_([O.VOLUME], "SELECT project, commit_sha, count(license) AS licensed, count(*) AS components, count(*) FILTER (license IS NULL AND risk_level = 'High') AS unlicensed_high_risk FROM deps GROUP BY project, commit_sha"))
def licensing_summary(spark, sf):
    return measures.licensing_summary(volume(spark, sf))


@query("license_distribution", O.with_([O.VOLUME], "SELECT project, commit_sha, license, count(*) AS components FROM deps WHERE license IS NOT NULL GROUP BY project, commit_sha, license"))
def license_distribution(spark, sf):
    return measures.license_distribution(volume(spark, sf))


@query("risk_register", O.with_([O.VOLUME], "SELECT project, commit_sha, name, version, risk_level, location FROM deps WHERE risk_level = 'High' AND name <> 'Exposed Secret'"))
def risk_register(spark, sf):
    return measures.risk_register(volume(spark, sf)).select(*KEYS, "name", "version", "risk_level", "location")


@query("exposed_secrets", O.with_([O.VOLUME], "SELECT project, commit_sha, count(*) FILTER (name = 'Exposed Secret') AS exposed_secrets FROM deps GROUP BY project, commit_sha"))
def exposed_secrets(spark, sf):
    return measures.exposed_secrets(volume(spark, sf))


@query("component_types", O.with_([O.VOLUME], f"SELECT project, name, version, location, {O.TYPE_SQL} AS component_type FROM deps"))
def component_types(spark, sf):
    return volume(spark, sf).select(
        "project", "name", "version", "location",
        measures.component_type(F.col("name"), F.col("ecosystem")).alias("component_type"))


@query("package_urls", O.with_([O.VOLUME], f"SELECT project, name, version, location, {O.PURL_SQL} AS purl FROM deps"))
def package_urls(spark, sf):
    return volume(spark, sf).select(
        "project", "name", "version", "location",
        measures.package_url(F.col("name"), F.col("version"), F.col("ecosystem")).alias("purl"))


@query("risk_badges", O.with_([O.VOLUME], "SELECT project, name, coalesce(nullif(location, ''), 'N/A') AS location, CASE risk_level WHEN 'High' THEN 'HIGH RISK (EU AI Act)' WHEN 'Medium' THEN 'MEDIUM' ELSE 'LOW' END AS badge FROM deps"))
def risk_badges(spark, sf):
    return ledger.findings_view(volume(spark, sf)).select(
        "project", "name", "location", measures.risk_badge(F.col("risk_level")).alias("badge"))


@query("run_overrides", O.with_([O.BASE], "SELECT CASE WHEN v.project LIKE '%3' THEN v.project ELSE 'org/' || v.project END AS project, coalesce(p.sha, v.commit_sha) AS commit_sha, scanned_files FROM (SELECT project, commit_sha, count(*) AS scanned_files FROM vis GROUP BY ALL) v LEFT JOIN (SELECT source, CASE WHEN length(source) = 4 THEN md5('run' || source) END AS sha FROM documents GROUP BY source) p ON p.source = v.project"))
def run_overrides(spark, sf):
    runs = A.frame(spark, sf, "SELECT source AS project, CASE WHEN source LIKE '%3' THEN '' ELSE concat('org/', source) END AS ci_project, CASE WHEN length(source) = 4 THEN md5(concat('run', source)) ELSE '' END AS ci_commit_sha FROM documents GROUP BY source")
    return measures.with_run_context(scan.scanned_files(files(spark, sf)), runs)


# --- documents ------------------------------------------------------------------


@query("bom_documents", O.report(O.first_page(O.BOM_SELECT)))
def bom_documents(spark, sf):
    return documents.bom_json(full_report(spark, sf)).select(*KEYS, "page", "bom_json")


@query("nested_boms", O.report(O.NESTED_SELECT))
def nested_boms(spark, sf):
    def flat(array, fields):
        return F.array_join(F.transform(array, lambda e: F.concat_ws("|", *[F.coalesce(e[f], F.lit("")) for f in fields])), ";").alias(array)

    return documents.nested_bom(full_report(spark, sf)).select(
        *KEYS, "page", "scanned_files", "compliance_status",
        flat("dependencies", ["name", "version", "ecosystem", "risk_level", "description", "location", "license"]),
        flat("fin_ops", ["resource", "severity", "description", "location"]),
        flat("policy_violations", ["rule", "severity", "description", "location"]))


@query("bom_json_round_trip", O.report("SELECT project, commit_sha, name, version, ecosystem, risk_level, description, location, license FROM deps"))
def bom_json_round_trip(spark, sf):
    return documents.dependencies_of_pages(documents.bom_json(full_report(spark, sf))).drop("page", "position")


@query("cyclonedx_documents", O.report(O.first_page(O.CYCLONEDX_SELECT)))
def cyclonedx_documents(spark, sf):
    return documents.cyclonedx_json(full_report(spark, sf), generated_at()).select(*KEYS, "page", "cyclonedx_json")


@query("cyclonedx_serials", O.with_([O.BASE], f"SELECT project, commit_sha, {O.SERIAL} AS serial_number FROM vis GROUP BY project, commit_sha"))
def cyclonedx_serials(spark, sf):
    return scan.scanned_files(files(spark, sf)).select(
        *KEYS, ids.serial_number(F.col("project"), F.col("commit_sha")).alias("serial_number"))


@query("annex_iv", O.report(O.first_page(O.annex_select())))
def annex_iv(spark, sf):
    return documents.annex_iv(full_report(spark, sf), generated_at()).select(*KEYS, "page", "markdown")


@query("annex_iv_preview", O.report(O.first_page(O.preview_select())))
def annex_iv_preview(spark, sf):
    return documents.annex_iv_preview(full_report(spark, sf)).select(*KEYS, "page", "markdown")


@query("proof_hashes", O.report(f"SELECT project, commit_sha, sha256(commit_sha || bom_json) AS crypto_hash FROM ({O.BOM_SELECT})"))
def proof_hashes(spark, sf):
    return document_hashes(documents.bom_json(full_report(spark, sf)))


# --- ledger ---------------------------------------------------------------------


@query("ledger_history", O.with_([O.HISTORY], "SELECT * FROM hist"))
def ledger_history(spark, sf):
    return history(spark, sf)


@query("latest_ledger", O.with_([O.HISTORY], "SELECT * FROM hist ORDER BY created_at DESC, crypto_hash LIMIT 25"))
def latest_ledger(spark, sf):
    return ledger.latest(drills(spark, sf), projects(spark, sf))


@query("latest_ledger_of_tenant", O.with_([O.HISTORY], "SELECT * FROM hist WHERE user_id = '8' ORDER BY created_at DESC, crypto_hash LIMIT 25"))
def latest_ledger_of_tenant(spark, sf):
    return ledger.latest(drills(spark, sf), projects(spark, sf), "8")


@query("latest_ledger_per_tenant", O.with_([O.HISTORY], "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, crypto_hash) AS position FROM hist) WHERE position <= 25"))
def latest_ledger_per_tenant(spark, sf):
    return ledger.latest_per_tenant(drills(spark, sf), projects(spark, sf))


@query("tenant_rows", f"SELECT user_id, commit_sha, crypto_hash FROM ({A.DRILLS}) WHERE user_id = '8'")
def tenant_rows(spark, sf):
    return drills(spark, sf).filter(F.col("user_id") == "8").select("user_id", "commit_sha", "crypto_hash")


@query("proof_lookup", f"WITH d AS ({A.DRILLS}), r AS (SELECT sha256(concat(md5(cast(event_id AS string)), coalesce(props, ''))) AS crypto_hash, cast(user_id + event_id % 2 AS string) AS user_id FROM events) SELECT d.crypto_hash, d.user_id, annex_iv_markdown FROM d WHERE EXISTS (SELECT 1 FROM r WHERE r.crypto_hash = d.crypto_hash AND r.user_id = d.user_id)")
def proof_lookup(spark, sf):
    requests = A.frame(spark, sf, "SELECT sha256(concat(md5(cast(event_id AS string)), coalesce(props, ''))) AS crypto_hash, cast(user_id + event_id % 2 AS string) AS user_id FROM events")
    return ledger.proofs(requests, drills(spark, sf))


@query("stored_ledger", f"SELECT id, project_id, user_id, commit_sha, crypto_hash, created_at, CAST(created_at AS DATE) AS created_date FROM ({A.DRILLS})")
def stored_ledger(spark, sf):
    """Written by day and hash range, and read back."""
    target = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    ledger_files.append_drills(drills(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp")), target, file_bytes=1 << 18)
    return ledger_files.read_drills(spark, target).select(
        "id", "project_id", "user_id", "commit_sha", "crypto_hash", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "created_date")


@query("proof_verification", f"SELECT id, crypto_hash, crypto_hash = sha256(commit_sha || ai_bom_json) AS hash_ok, substr(crypto_hash, 1, 8) AS hash_prefix FROM ({A.DRILLS})")
def proof_verification(spark, sf):
    return ledger.view(ledger.verified(drills(spark, sf))).select("id", "crypto_hash", "hash_ok", "hash_prefix")


@query("project_upsert", f"WITH p AS (SELECT * FROM ({A.PROJECTS})), n AS (SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN project_name || '-fork' ELSE project_name END AS name FROM ({A.ATTEMPTS})) SELECT id, name, repository_url, created_at FROM p UNION ALL SELECT sha256(name), name, NULL, TIMESTAMP '2024-06-01 00:00:00' FROM n WHERE name NOT IN (SELECT name FROM p)")
def project_upsert(spark, sf):
    fork = F.when(F.col("user_id") % 3 == 0, F.concat("project_name", F.lit("-fork"))).otherwise(F.col("project_name"))
    return ledger.upsert_projects(projects(spark, sf), attempts(spark, sf).select(fork.alias("name")), GENERATED_AT)


@query("usage_as_of", f"SELECT user_id, count(*) AS recent FROM ({A.ATTEMPTS}) WHERE created_at > TIMESTAMP '{O.AS_OF}' - INTERVAL 30 DAYS AND created_at <= TIMESTAMP '{O.AS_OF}' GROUP BY user_id")
def usage_as_of(spark, sf):
    from datetime import datetime

    return quota.usage_as_of(attempts(spark, sf), datetime.fromisoformat(O.AS_OF))


def _rolling(name, days):
    @query(name, f"SELECT user_id, created_at, count(*) OVER (PARTITION BY user_id, created_at) AS attempts, count(*) OVER (PARTITION BY user_id ORDER BY created_at RANGE BETWEEN INTERVAL '{days} days' - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW) AS recent FROM ({A.ATTEMPTS})")
    def run(spark, sf):
        return quota.rolling_usage(attempts(spark, sf), days)


_rolling("rolling_usage", 30)
_rolling("rolling_usage_3_days", 3)


def _admission(name, days):
    @query(name, O.quota_replay(days))
    def run(spark, sf):
        return quota.admit(attempts(spark, sf), days).select("user_id", "attempt_id", "created_at", "accepted")


_admission("quota_admission", 30)
_admission("quota_admission_3_days", 3)


# --- accounts -------------------------------------------------------------------


@query("event_intake", f"SELECT DISTINCT ON (event_id) event_id, event_type, user_id, customer_id, attempt_count, received_at FROM ({A.BILLING_EVENTS}) ORDER BY event_id, received_at")
def event_intake(spark, sf):
    return accounts.intake(A.frame(spark, sf, A.BILLING_EVENTS))


@query("subscription_state", O.account_replay(O.BILLING_WITH_NO_KEYS) + O.LAST_STATE)
def subscription_state(spark, sf):
    return accounts.account_state(accounts.intake(A.frame(spark, sf, A.BILLING_EVENTS)))


@query("account_state", O.account_replay(A.ACCOUNT_EVENTS) + O.LAST_STATE)
def account_state(spark, sf):
    return accounts.account_state(accounts.intake(A.frame(spark, sf, A.ACCOUNT_EVENTS)))


@query("key_lifecycle", O.account_replay(A.ACCOUNT_EVENTS) + O.OUTCOMES)
def key_lifecycle(spark, sf):
    return accounts.key_outcomes(accounts.intake(A.frame(spark, sf, A.ACCOUNT_EVENTS))).drop("received_at")


@query("account_merge", f"WITH cur AS ({A.API_KEYS}), ch AS (SELECT user_id AS user_id, max(customer_id) AS stripe_customer_id, 'pro' AS subscription_tier FROM ({A.BILLING_EVENTS}) WHERE event_type = 'checkout.session.completed' AND user_id IS NOT NULL GROUP BY user_id) SELECT coalesce(cur.user_id, ch.user_id) AS user_id, cur.token_hash, coalesce(ch.subscription_tier, cur.subscription_tier) AS subscription_tier, coalesce(ch.stripe_customer_id, cur.stripe_customer_id) AS stripe_customer_id, CASE WHEN cur.user_id IS NULL THEN 0 ELSE cur.scans_this_month END AS scans_this_month FROM cur FULL JOIN ch ON cur.user_id = ch.user_id")
def account_merge(spark, sf):
    changes = accounts.checkouts(A.frame(spark, sf, A.BILLING_EVENTS)).groupBy("user_id").agg(
        F.max("customer_id").alias("stripe_customer_id")).withColumn("subscription_tier", F.lit("pro"))
    return accounts.merge_accounts(A.frame(spark, sf, A.API_KEYS), changes)


_CHECKOUT_SQL = f"SELECT r.session_id, r.user_id, CASE WHEN s.status IS NULL THEN 'unavailable' WHEN s.session_user_id <> r.user_id THEN 'forbidden' WHEN s.status = 'complete' THEN 'pro' ELSE 'free' END AS outcome, s.customer_id FROM ({A.CHECKOUT_REQUESTS}) r LEFT JOIN ({A.CHECKOUT_SESSIONS}) s USING (session_id)"


@query("checkout_verification", _CHECKOUT_SQL)
def checkout_verification(spark, sf):
    return accounts.verify_checkouts(A.frame(spark, sf, A.CHECKOUT_REQUESTS), A.frame(spark, sf, A.CHECKOUT_SESSIONS))


@query("checkout_changes", f"SELECT user_id, arg_max(customer_id, session_id) AS stripe_customer_id, 'pro' AS subscription_tier FROM ({_CHECKOUT_SQL}) WHERE outcome = 'pro' GROUP BY user_id")
def checkout_changes(spark, sf):
    return accounts.checkout_changes(checkout_verification(spark, sf))


@query("hash_backfill", "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 4 = 0 THEN md5(c_name) ELSE sha256(c_name) END AS token_hash FROM customer")
def hash_backfill(spark, sf):
    keys = A.frame(spark, sf, "SELECT c_custkey AS user_id, c_name AS token, CASE WHEN c_custkey % 4 = 0 THEN md5(c_name) ELSE NULL END AS token_hash FROM customer")
    return accounts.hashed_at_rest(keys)


@query("key_hashes", "SELECT o_orderkey AS request_id, sha256(o_orderpriority || o_orderkey) AS token_hash FROM orders")
def key_hashes(spark, sf):
    return A.frame(spark, sf, "SELECT o_orderkey, o_orderpriority FROM orders").select(
        F.col("o_orderkey").alias("request_id"), ids.key_hash(F.concat("o_orderpriority", F.col("o_orderkey").cast("string"))).alias("token_hash"))


@query("key_resolution", f"SELECT r.request_id, k.user_id, coalesce(k.subscription_tier, 'free') AS tier, coalesce(k.scans_this_month, 0) AS scans_this_month FROM ({A.KEY_REQUESTS}) r JOIN ({A.API_KEYS}) k ON k.token_hash = sha256(r.api_key) WHERE r.api_key <> ''")
def key_resolution(spark, sf):
    return accounts.resolved_keys(A.frame(spark, sf, A.KEY_REQUESTS), A.frame(spark, sf, A.API_KEYS)).select(
        "request_id", "user_id", "tier", "scans_this_month")


@query("account_view", f"SELECT o.user_id, coalesce(k.subscription_tier, 'free') AS tier, k.token_hash IS NOT NULL AS has_key FROM (SELECT DISTINCT o_custkey + o_orderkey % 2 * 100 AS user_id FROM orders) o LEFT JOIN ({A.API_KEYS}) k USING (user_id)")
def account_view(spark, sf):
    users = A.frame(spark, sf, "SELECT DISTINCT o_custkey + o_orderkey % 2 * 100 AS user_id FROM orders")
    return accounts.account_view(users, A.frame(spark, sf, A.API_KEYS))


@query("webhook_events", "SELECT 'evt_' || event_id AS event_id, event_type, CAST(user_id AS VARCHAR) AS user_id, 'cus_' || user_id AS customer_id, CAST(event_id % 5 AS BIGINT) AS attempt_count, date_trunc('second', ts) AS received_at FROM events")
def webhook_events(spark, sf):
    return parsed_events(A.frame(spark, sf, A.WEBHOOKS))


def taken_in(spark, sf, known=None):
    return intake.proof_intake(
        A.frame(spark, sf, A.UPLOADS), A.frame(spark, sf, A.UPLOAD_KEYS),
        projects(spark, sf) if known is None else known, branding=BRANDING)


@query("proof_intake", O.drills_with_markdown())
def proof_intake(spark, sf):
    return taken_in(spark, sf).drills.select(
        "id", "project_id", "user_id", "commit_sha", "ai_bom_json", "annex_iv_markdown", "crypto_hash", "created_at")


@query("intake_refused", O.uploads_sql(O.REFUSED_SELECT))
def intake_refused(spark, sf):
    return taken_in(spark, sf).refused.select("upload_id", "user_id", "tier", "created_at")


@query("intake_projects", O.uploads_sql(O.NEW_PROJECTS_SELECT))
def intake_projects(spark, sf):
    """Projects of a ledger that knew none before."""
    return taken_in(spark, sf, projects(spark, sf).limit(0)).projects.select("id", "name", "created_at")
