"""DuckDB statements for the registered queries.

They restate the semantics in plain SQL (line tables, windows, joins, recursive
replays) rather than in the shape the Spark operators use.
"""

from __future__ import annotations

from bomweave.functions import dims as D

from . import adapters as A

WS = "' ' || " + " || ".join(f"chr({c})" for c in (
    9, 10, 11, 12, 13, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))


def lit(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    body = ",".join("(" + ",".join(v if isinstance(v, str) and v.isdigit() else lit(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def ranked(mapping) -> list:
    return [(k, str(i)) for i, k in enumerate(D.first_match_order(mapping))]


DIMS = {
    "lib": values("lib", "lname, lrisk, ldesc", [(n, r, d) for n, (r, d) in D.LIBRARIES.items()]),
    "mdl": values("mdl", "model", [(m,) for m in D.MODELS]),
    "gomod": values("gomod", "gkey, prio, glib", [(k, p, D.GO_MODULES[k]) for k, p in ranked(D.GO_MODULES)]),
    "img": values("img", "ikey, prio, idesc", [(k, p, D.BASE_IMAGES[k]) for k, p in ranked(D.BASE_IMAGES)]),
    "cext": values("cext", "ext, prio", [(e, str(i)) for i, e in enumerate(D.COPIED_WEIGHT_EXTENSIONS)]),
    "sname": values("sname", "skey, platform", list(D.SECRET_KEY_NAMES.items())),
    "spre": values("spre", "prefix, prio, platform", [(k, p, D.SECRET_PREFIXES[k]) for k, p in ranked(D.SECRET_PREFIXES)]),
    "fam": values("fam", "cloud, fkey, fdesc, fno", [
        (c, k, d, str(i)) for i, (c, k, d) in enumerate(
            (c, k, d) for c, t in D.GPU_FAMILIES.items() for k, d in sorted(t.items()))]),
    "lic": values("lic", "lkey, prio, hf, plic", [(k, p, *D.LICENSES[k]) for k, p in ranked(D.LICENSES)]),
    "owasp": values("owasp", "oname, note", [
        (n, " | OWASP ML: " + "; ".join(r)) for n, r in D.OWASP_RISKS.items()]),
}


def any_contains(column: str, keys) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(k)})" for k in keys) + ")"


BASE = f"""files AS ({A.FILES}),
vis AS (SELECT *, list_extract(string_split(path, '/'), -1) AS fname, regexp_extract(list_extract(string_split(path, '/'), -1), '\\.[^.]*$') AS ext
  FROM files WHERE NOT regexp_matches(path, '(^|/)\\.([^./]|\\.[^/])[^/]*/')),
cut AS (SELECT project, commit_sha, path, fname, string_split(content, chr(10)) AS l FROM vis WHERE fname NOT LIKE 'README%' AND lower(ext) <> '.pt'),
raw AS (SELECT project, commit_sha, path, fname, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM cut),
lines AS (SELECT *, trim(line, {WS}) AS t FROM raw)"""

COLS = "project, commit_sha, path, detector, line_no, seq, name, version, ecosystem, level, description, location"

RE_S = r"[\t\n\f\r ]"
SK = "(starts_with({0}, 'sk-') AND strlen({0}) > 20)"

FOUND = {
    "requirements": (["lib"], f"""d1 AS (SELECT project, commit_sha, path, 1 AS detector, n AS line_no, 0 AS seq, lname AS name,
  CASE WHEN ver = '' THEN 'unknown' ELSE ver END AS version, 'Python (pip)' AS ecosystem, lrisk AS level, ldesc AS description, path AS location
  FROM (SELECT *, lower(regexp_extract(t, '^([a-zA-Z0-9_\\-]+)(?:[>=<~]+([a-zA-Z0-9_\\-\\.]+))?', 1)) AS nm,
    regexp_extract(t, '^([a-zA-Z0-9_\\-]+)(?:[>=<~]+([a-zA-Z0-9_\\-\\.]+))?', 2) AS ver
    FROM lines WHERE fname = 'requirements.txt' AND t <> '' AND NOT starts_with(t, '#')) JOIN lib ON lname = nm)"""),
    "package_json": (["lib"], """pj AS (SELECT project, commit_sha, path, content::JSON AS js FROM vis WHERE fname = 'package.json' AND json_valid(content)),
pje AS (SELECT *, unnest(map_entries(CAST(js->'$.dependencies' AS MAP(VARCHAR, JSON)))) AS e, 1 AS part FROM pj
  UNION ALL SELECT *, unnest(map_entries(CAST(js->'$.devDependencies' AS MAP(VARCHAR, JSON)))) AS e, 2 AS part FROM pj),
pjbad AS (SELECT DISTINCT project, path FROM pje WHERE json_type(e.value) NOT IN ('VARCHAR', 'NULL')),
d2 AS (SELECT project, commit_sha, path, 2 AS detector, part AS line_no, row_number() OVER (PARTITION BY project, path, part ORDER BY e.key) AS seq,
  e.key AS name, regexp_replace(coalesce(e.value->>'$', ''), '^\\^?~?', '') AS version, 'Node.js (npm)' AS ecosystem, lrisk AS level, ldesc AS description, path AS location
  FROM pje JOIN lib ON lname = lower(e.key) WHERE NOT EXISTS (SELECT 1 FROM pjbad b WHERE b.project = pje.project AND b.path = pje.path))"""),
    "go_mod": (["lib", "gomod"], f"""gm AS (SELECT *, CASE WHEN t = 'require (' THEN 'in' WHEN t = ')' THEN 'out' WHEN starts_with(t, 'require ') AND NOT contains(t, '(') THEN 'one' END AS mark
  FROM lines WHERE fname = 'go.mod'),
gs AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY project, path ORDER BY n) AS state FROM gm),
gc AS (SELECT *, CASE WHEN mark = 'one' THEN substr(t, 9) ELSE t END AS c FROM gs WHERE mark = 'one' OR (mark IS NULL AND state = 'in')),
gx AS (SELECT *, lower(regexp_extract(c, '^{RE_S}*([^\\t\\n\\f\\r ]+){RE_S}+v?([^\\t\\n\\f\\r ]+)', 1)) AS module,
  regexp_extract(c, '^{RE_S}*([^\\t\\n\\f\\r ]+){RE_S}+v?([^\\t\\n\\f\\r ]+)', 2) AS ver FROM gc),
d3 AS (SELECT project, commit_sha, path, 3 AS detector, 0 AS line_no, n AS seq, module AS name, ver AS version, 'Go (module)' AS ecosystem,
  coalesce(lrisk, 'Medium') AS level, coalesce(ldesc, 'AI-related Go module') AS description, path AS location
  FROM (SELECT *, row_number() OVER (PARTITION BY project, path, n ORDER BY prio) AS r FROM gx JOIN gomod ON contains(module, gkey)) LEFT JOIN lib ON lname = glib WHERE r = 1)"""),
    "pyproject": (["lib"], f"""pm AS (SELECT *, CASE WHEN t IN ('[tool.poetry.dependencies]', '[project.dependencies]') THEN 'in' WHEN starts_with(t, '[') THEN 'out' END AS mark
  FROM lines WHERE fname = 'pyproject.toml'),
ps AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY project, path ORDER BY n) AS state FROM pm),
px AS (SELECT *, lower(regexp_extract(t, '^([a-zA-Z0-9_-]+){RE_S}*={RE_S}*([^\\n]+)', 1)) AS nm,
  trim(regexp_extract(t, '^([a-zA-Z0-9_-]+){RE_S}*={RE_S}*([^\\n]+)', 2), ' "''') AS spec FROM ps WHERE mark IS NULL AND state = 'in'),
d4 AS (SELECT project, commit_sha, path, 4 AS detector, 0 AS line_no, n AS seq, nm AS name,
  CASE WHEN starts_with(spec, chr(123)) THEN CASE WHEN regexp_extract(spec, 'version{RE_S}*={RE_S}*"([^"]+)"', 1) = '' THEN 'unknown' ELSE regexp_extract(spec, 'version{RE_S}*={RE_S}*"([^"]+)"', 1) END
    ELSE ltrim(spec, '^~>=<!') END AS version,
  'Python (Poetry/PEP)' AS ecosystem, lrisk AS level, ldesc AS description, path AS location FROM px JOIN lib ON lname = nm WHERE nm <> 'python')"""),
    "dockerfile": (["lib", "img", "cext"], f"""dk AS (SELECT *, lower(t) AS low, regexp_extract(t, '^[^\\s]+[\\s]+([^\\s]+)', 1) AS image FROM lines WHERE fname = 'Dockerfile' OR starts_with(fname, 'Dockerfile.')),
d5 AS (SELECT project, commit_sha, path, 5 AS detector, n AS line_no, 0 AS seq, image AS name, 'docker-image' AS version, 'Container Image (Dockerfile)' AS ecosystem, 'High' AS level,
  idesc || ' detected as base image' AS description, path || ':' || n AS location
  FROM (SELECT *, row_number() OVER (PARTITION BY project, path, n ORDER BY prio) AS r FROM dk JOIN img ON contains(lower(image), ikey) WHERE starts_with(low, 'from ')) WHERE r = 1),
d6 AS (SELECT project, commit_sha, path, 5 AS detector, n AS line_no, 1 AS seq, 'Containerized Model Weight' AS name, 'docker-layer' AS version, 'Container Image (Dockerfile)' AS ecosystem, 'High' AS level,
  'Model weight file (' || ext || ') being copied into container image' AS description, path || ':' || n AS location
  FROM (SELECT *, row_number() OVER (PARTITION BY project, path, n ORDER BY prio) AS r FROM dk JOIN cext ON contains(low, ext) WHERE starts_with(low, 'copy ') OR starts_with(low, 'add ')) WHERE r = 1),
d7 AS (SELECT project, commit_sha, path, 5 AS detector, n AS line_no, 1 + row_number() OVER (PARTITION BY project, path, n ORDER BY lname) AS seq, lname AS name, 'docker-install' AS version,
  'Container Image (pip in Dockerfile)' AS ecosystem, lrisk AS level, ldesc || ' (installed in Dockerfile)' AS description, path || ':' || n AS location
  FROM dk JOIN lib ON contains(low, lname) WHERE starts_with(low, 'run ') AND contains(low, 'pip install'))"""),
    "py_source": (["lib", "mdl"], f"""pyl AS (SELECT * FROM lines WHERE fname LIKE '%.py'),
pyi AS (SELECT *, lower(concat(regexp_extract(line, '^{RE_S}*(?:import{RE_S}+([a-zA-Z0-9_]+)|from{RE_S}+([a-zA-Z0-9_]+)(?:\\.[a-zA-Z0-9_.]+)?{RE_S}+import)', 1),
  regexp_extract(line, '^{RE_S}*(?:import{RE_S}+([a-zA-Z0-9_]+)|from{RE_S}+([a-zA-Z0-9_]+)(?:\\.[a-zA-Z0-9_.]+)?{RE_S}+import)', 2))) AS module FROM pyl),
d8 AS (SELECT project, commit_sha, path, 7 AS detector, min(n) AS line_no, 0 AS seq, lname AS name, 'imported' AS version, 'Source Code (.py import)' AS ecosystem, any_value(lrisk) AS level,
  any_value(ldesc) || ' (detected via import statement)' AS description, path || ':' || min(n) AS location FROM pyi JOIN lib ON lname = module GROUP BY project, commit_sha, path, lname),
pyt AS (SELECT project, commit_sha, path, n, regexp_extract_all(line, '(?:"[^"]*"|''[^'']*'')') AS l FROM pyl WHERE contains(line, '"') OR contains(line, '''')),
pyv AS (SELECT project, commit_sha, path, n, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM pyt),
pyw AS (SELECT *, substr(tok, 2, length(tok) - 2) AS v FROM pyv),
d9 AS (SELECT project, commit_sha, path, 7 AS detector, n AS line_no, i * 2 AS seq, 'Hardcoded Model' AS name, v AS version, 'Source Code (.py)' AS ecosystem, 'High' AS level,
  'Hardcoded AI model identifier found in Python source code' AS description, path || ':' || n AS location FROM pyw WHERE EXISTS (SELECT 1 FROM mdl WHERE contains(v, model))),
d10 AS (SELECT project, commit_sha, path, 7 AS detector, n AS line_no, i * 2 + 1 AS seq, 'Exposed Secret' AS name, 'HIDDEN' AS version, 'Source Code (.py)' AS ecosystem, 'High' AS level,
  'Potential hardcoded API key found in Python source code' AS description, path || ':' || n AS location FROM pyw WHERE {SK.format('v')})"""),
    "go_source": (["mdl"], rf"""got AS (SELECT project, commit_sha, path, regexp_extract_all(content, '//[^\n]*|/\*(?s:.*?)\*/|"(?:[^"\\\n]|\\[^\n])*"|`[^`]*`|''(?:[^''\\\n]|\\[^\n])*''|[^"`''/]+|(?s:.)') AS l FROM vis WHERE fname LIKE '%.go'),
gou AS (SELECT project, commit_sha, path, unnest(l) AS tok, generate_subscripts(l, 1) AS i FROM got),
goo AS (SELECT *, coalesce(sum(strlen(tok)) OVER w, 0) AS off, 1 + coalesce(sum(length(tok) - length(replace(tok, chr(10), ''))) OVER w, 0) AS line FROM gou
  WINDOW w AS (PARTITION BY project, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
gop AS (SELECT *, off - coalesce(max(CASE WHEN contains(tok, chr(10)) THEN off + strlen(tok) - strlen(list_extract(string_split(tok, chr(10)), -1)) END)
  OVER (PARTITION BY project, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS col FROM goo),
gow AS (SELECT *, trim(tok, '"') AS v, path || ':' || line || ':' || col AS loc FROM gop WHERE starts_with(tok, '"') OR starts_with(tok, '`')),
d11 AS (SELECT project, commit_sha, path, 6 AS detector, line AS line_no, col * 2 AS seq, 'Hardcoded Model' AS name, v AS version, 'Source Code (.go)' AS ecosystem, 'High' AS level,
  'Hardcoded AI model identifier found in source code' AS description, loc AS location FROM gow WHERE EXISTS (SELECT 1 FROM mdl WHERE contains(v, model))
 UNION ALL SELECT project, commit_sha, path, 6, line, col * 2 + 1, 'Exposed Secret', 'HIDDEN', 'Source Code (.go)', 'High', 'Potential hardcoded API key found in source code', loc FROM gow WHERE {SK.format('v')})"""),
    "env_file": (["sname", "spre"], f"""envl AS (SELECT project, commit_sha, path, n, upper(trim(substr(t, 1, strpos(t, '=') - 1), {WS})) AS k, trim(trim(substr(t, strpos(t, '=') + 1), {WS}), '"''') AS v
  FROM lines WHERE fname LIKE '%.env' AND t <> '' AND NOT starts_with(t, '#') AND contains(t, '=')),
d12 AS (SELECT project, commit_sha, path, 8 AS detector, n AS line_no, 0 AS seq, 'Exposed Secret' AS name, 'HIDDEN' AS version, 'Environment File (.env)' AS ecosystem, 'High' AS level,
  platform || ' API key found in .env file — should be in a secret manager, not committed to VCS' AS description, path || ':' || n AS location
  FROM envl JOIN sname ON skey = k WHERE v <> '' AND v <> 'your-key-here' AND NOT starts_with(v, '$' || chr(123)) AND NOT starts_with(v, '<')),
d13 AS (SELECT project, commit_sha, path, 8 AS detector, n AS line_no, 1 AS seq, 'Exposed Secret' AS name, 'HIDDEN' AS version, 'Environment File (.env)' AS ecosystem, 'High' AS level,
  platform || ' detected in .env file — rotate this key immediately' AS description, path || ':' || n AS location
  FROM (SELECT *, row_number() OVER (PARTITION BY project, path, n ORDER BY prio) AS r FROM envl JOIN spre ON starts_with(v, prefix) WHERE strlen(v) > 20) WHERE r = 1)"""),
    "weights": ([], "d14 AS (SELECT project, commit_sha, path, 9 AS detector, 0 AS line_no, 0 AS seq, fname AS name, 'local' AS version, 'Model Weight (' || ext || ')' AS ecosystem, 'High' AS level, "
                "'Locally hosted model weight file detected' AS description, path AS location FROM vis WHERE lower(ext) IN (" + ",".join(lit(e) for e in D.WEIGHT_EXTENSIONS) + "))"),
    "kubernetes": ([], f"""d15 AS (SELECT project, commit_sha, path, 10 AS detector, 0 AS line_no, 0 AS seq, fname AS name, cast(NULL AS string) AS version, cast(NULL AS string) AS ecosystem, 'Warning' AS level,
  'Expensive GPU requested without MIG or time-slicing configuration. Potential cost inefficiency.' AS description, path AS location
  FROM (SELECT project, commit_sha, path, fname, bool_or({any_contains('lower(line)', D.GPU_RESOURCE_KEYS)}) AS g, bool_or({any_contains('lower(line)', D.GPU_SHARING_KEYS)}) AS o
    FROM raw WHERE lower(fname) LIKE '%.yaml' OR lower(fname) LIKE '%.yml' GROUP BY ALL) WHERE g AND NOT o)"""),
    "helm": ([], f"""hv AS (SELECT project, commit_sha, path, fname, bool_or({any_contains('lower(t)', D.GPU_RESOURCE_KEYS)}) AS g, bool_or({any_contains('lower(t)', D.AUTOSCALING_KEYS)}) AS a, bool_or({any_contains('lower(t)', D.SERVING_PATTERNS)}) AS s
  FROM lines WHERE fname IN ('values.yaml', 'values.yml') GROUP BY ALL),
d17 AS (SELECT project, commit_sha, path, 11 AS detector, 0 AS line_no, 0 AS seq, fname AS name, cast(NULL AS string) AS version, cast(NULL AS string) AS ecosystem, CASE WHEN a THEN 'Info' ELSE 'Warning' END AS level,
  'GPU resource requests detected in Helm values. ' || CASE WHEN a THEN 'Autoscaling is configured — good cost optimization practice.' ELSE 'No autoscaling configuration found — fixed GPU allocation may lead to cost waste during low-traffic periods.' END AS description, path AS location FROM hv WHERE g),
d18 AS (SELECT project, commit_sha, path, 11 AS detector, 0 AS line_no, 1 AS seq, fname AS name, cast(NULL AS string) AS version, cast(NULL AS string) AS ecosystem, 'Info' AS level,
  'AI model serving framework configuration detected in Helm values. Consider batching inference requests for GPU utilization optimization.' AS description, path AS location FROM hv WHERE s)"""),
    "terraform": (["fam"], f"""tf AS (SELECT *, lower(content) AS low FROM vis WHERE lower(ext) = '.tf'),
d16 AS (SELECT project, commit_sha, path, 12 AS detector, 0 AS line_no, fno AS seq, fname AS name, cast(NULL AS string) AS version, cast(NULL AS string) AS ecosystem,
  CASE WHEN {any_contains('low', D.SPOT_KEYS)} THEN 'Info' ELSE 'Warning' END AS level,
  cloud || ' instance detected in Terraform config: ' || fdesc || '.' || CASE WHEN {any_contains('low', D.SPOT_KEYS)} THEN ' Spot/preemptible pricing detected — good cost optimization.'
   ELSE ' Consider using spot/preemptible instances for 60-90%% cost savings on non-critical workloads.' END AS description, path AS location FROM tf JOIN fam ON contains(low, fkey))"""),
}
MEMBERS = {
    "requirements": ["d1"], "package_json": ["d2"], "go_mod": ["d3"], "pyproject": ["d4"], "dockerfile": ["d5", "d6", "d7"],
    "go_source": ["d11"], "py_source": ["d8", "d9", "d10"], "env_file": ["d12", "d13"], "weights": ["d14"],
    "kubernetes": ["d15"], "helm": ["d17", "d18"], "terraform": ["d16"],
}
FINOPS = ("kubernetes", "helm", "terraform")
DEPENDENCY_KINDS = [k for k in FOUND if k not in FINOPS]


def ctes(kinds) -> list[str]:
    dims = list(dict.fromkeys(d for k in kinds for d in FOUND[k][0]))
    return [DIMS[d] for d in dims] + [BASE] + [FOUND[k][1] for k in kinds]


def union(kinds) -> str:
    return " UNION ALL ".join(f"SELECT {COLS} FROM {m}" for k in kinds for m in MEMBERS[k])


def with_(parts, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def detector(kind: str, members=None, finops=False) -> str:
    members = members or MEMBERS[kind]
    body = " UNION ALL ".join(f"SELECT {COLS} FROM {m}" for m in members)
    if finops:
        out = f"SELECT project, commit_sha, path, name AS resource, level AS severity, description, location FROM ({body})"
    else:
        out = (f"SELECT project, commit_sha, path, name, version, ecosystem, level AS risk_level, description, location "
               f"FROM ({body})")
    return with_(ctes([kind]), out)


ALL_KINDS = list(FOUND)
POLICY_CTE = f"""poll AS (SELECT project, commit_sha, n, t FROM lines WHERE path = '.aibom.yml' AND t <> '' AND NOT starts_with(t, '#')),
polk AS (SELECT *, CASE WHEN NOT starts_with(t, '- ') AND contains(t, ':') THEN trim(substr(t, 1, strpos(t, ':') - 1), {WS}) END AS k FROM poll),
pols AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY project, commit_sha ORDER BY n) AS cur FROM polk),
polv AS (SELECT *, trim(trim(CASE WHEN k IS NULL THEN substr(t, 3) ELSE substr(t, strpos(t, ':') + 1) END, {WS}), '"''') AS v FROM pols),
pol AS (SELECT project, commit_sha,
  coalesce(list(v ORDER BY n) FILTER (k IS NULL AND starts_with(t, '- ') AND cur = 'allowed_models'), []) AS allowed_models,
  coalesce(list(v ORDER BY n) FILTER (k IS NULL AND starts_with(t, '- ') AND cur = 'blocked_models'), []) AS blocked_models,
  coalesce(list(v ORDER BY n) FILTER (k IS NULL AND starts_with(t, '- ') AND cur = 'allowed_licenses'), []) AS allowed_licenses,
  coalesce(arg_max(v, n) FILTER (k = 'max_risk_level'), '') AS max_risk_level,
  coalesce(arg_max(v, n) FILTER (k = 'block_on_high_risk'), '') = 'true' AS block_on_high_risk,
  coalesce(arg_max(v, n) FILTER (k = 'require_licenses'), '') = 'true' AS require_licenses
  FROM polv GROUP BY project, commit_sha)"""


def violation_rules(deps: str, pol: str, keys: str, policy_file: str = ".aibom.yml") -> str:
    """All rules over ``deps`` and ``pol``; ``vno`` numbers them per dependency."""
    d = f"(SELECT *, lower(name) AS ln, lower(version) AS lv, coalesce(license, '') AS lc FROM {deps}) d JOIN {pol} p USING ({keys})"
    model = "(name = 'Hardcoded Model' OR starts_with(ecosystem, 'Model Weight'))"
    return f"""SELECT d.*, 0 AS rule_no, 'blocked_model' AS rule, 'Blocker' AS severity, concat('Model ''', version, ''' is explicitly blocked by {policy_file} policy') AS vdesc, b.i AS vno
  FROM {d}, (SELECT unnest(range(len(blocked_models))) AS i) b WHERE (contains(ln, lower(blocked_models[b.i + 1])) OR contains(lv, lower(blocked_models[b.i + 1])))
UNION ALL SELECT d.*, 1, 'allowed_model_violation', 'Blocker', concat('Model ''', version, ''' is not in the approved model allowlist defined in {policy_file}'), 100
  FROM {d} WHERE len(allowed_models) > 0 AND {model} AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(allowed_models) AS a) WHERE contains(lv, lower(a)) OR contains(ln, lower(a)))
UNION ALL SELECT d.*, 2, 'high_risk_blocked', 'Blocker', concat('High-risk dependency ''', name, ''' blocked by policy (block_on_high_risk: true)'), 200
  FROM {d} WHERE block_on_high_risk AND risk_level = 'High'
UNION ALL SELECT d.*, 3, 'missing_license', 'Warning', concat('High-risk dependency ''', name, ''' has no license information. Policy requires licenses for all high-risk components.'), 300
  FROM {d} WHERE require_licenses AND risk_level = 'High' AND lc = ''
UNION ALL SELECT d.*, 4, 'license_not_allowed', 'Warning', concat('License ''', lc, ''' for ''', name, ''' is not in the approved license list'), 400
  FROM {d} WHERE len(allowed_licenses) > 0 AND lc <> '' AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(allowed_licenses) AS a) WHERE lower(a) = lower(lc))"""


def license_ctes(deps: str) -> str:
    """``licensed``: deps with their license (registry table and dictionary)."""
    return f"""reg AS (SELECT hf_id, min(license_tag) AS tag FROM ({A.REGISTRY}) GROUP BY hf_id),
hit AS (SELECT x.rid, arg_min(struct_pack(hf := lic.hf, plic := lic.plic), lic.prio) AS h FROM {deps} x JOIN lic ON contains(lower(CASE WHEN x.version = 'local' THEN x.name ELSE x.version END), lkey)
  WHERE x.name = 'Hardcoded Model' OR starts_with(x.ecosystem, 'Model Weight') GROUP BY x.rid),
licensed AS (SELECT x.* EXCLUDE (license), coalesce(h.h.plic, nullif(substr(reg.tag, 9), ''), x.license) AS license FROM {deps} x LEFT JOIN hit h ON x.rid = h.rid LEFT JOIN reg ON reg.hf_id = h.h.hf)"""


OWASP_CTE = """noted AS (SELECT l.* EXCLUDE (description), CASE WHEN note IS NOT NULL AND NOT contains(description, 'OWASP') THEN description || note ELSE description END AS description
  FROM licensed l LEFT JOIN owasp ON oname = lower(name))"""

REPORT = [
    *[DIMS[d] for d in ("lib", "mdl", "gomod", "img", "cext", "sname", "spre", "fam", "lic", "owasp")],
    BASE, *[FOUND[k][1] for k in ALL_KINDS],
    f"deps0 AS (SELECT *, level AS risk_level, cast(NULL AS string) AS license, row_number() OVER () AS rid FROM ({union(DEPENDENCY_KINDS)}))",
    license_ctes("deps0"), OWASP_CTE,
    "deps AS MATERIALIZED (SELECT *, string_split(path, '/') AS pk FROM noted)",
    f"fins AS MATERIALIZED (SELECT *, name AS resource, level AS severity, string_split(path, '/') AS pk FROM ({union(FINOPS)}))",
    POLICY_CTE,
    f"vios AS MATERIALIZED ({violation_rules('deps', 'pol', 'project, commit_sha')})",
    "scans AS (SELECT project, commit_sha, count(*) AS scanned_files FROM vis GROUP BY ALL)",
    """stats AS MATERIALIZED (SELECT s.*, coalesce(c, 0) AS components, coalesce(licensed, 0) AS licensed, coalesce(unl, 0) AS unl, coalesce(reg, 0) AS register_rows, coalesce(sec, 0) AS secrets,
  coalesce(fc, 0) AS cost_findings, coalesce(bl, 0) AS blockers, coalesce(wa, 0) AS warnings,
  CASE WHEN coalesce(bl, 0) > 0 THEN 'Blocked by Policy' WHEN coalesce(hi, 0) > 0 THEN 'Action Required (Annex IV Documentation Missing)' ELSE 'Passed' END AS compliance_status
  FROM scans s LEFT JOIN (SELECT project, commit_sha, count(*) AS c, count(*) FILTER (coalesce(license, '') <> '') AS licensed, count(*) FILTER (coalesce(license, '') = '' AND risk_level = 'High') AS unl,
    count(*) FILTER (risk_level = 'High' AND name <> 'Exposed Secret') AS reg, count(*) FILTER (name = 'Exposed Secret') AS sec, count(*) FILTER (risk_level = 'High') AS hi FROM deps GROUP BY ALL) d USING (project, commit_sha)
  LEFT JOIN (SELECT project, commit_sha, count(*) AS fc FROM fins GROUP BY ALL) f USING (project, commit_sha)
  LEFT JOIN (SELECT project, commit_sha, count(*) FILTER (severity = 'Blocker') AS bl, count(*) FILTER (severity <> 'Blocker') AS wa FROM vios GROUP BY ALL) v USING (project, commit_sha))""",
]


def report(select: str) -> str:
    return with_(REPORT, select)


def js(expr: str) -> str:
    return f"replace(replace(replace(to_json({expr})::VARCHAR, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')"


def obj(fields) -> str:
    """Compact JSON object; (name, expr, optional) with JSON-text expressions."""
    first, *rest = [
        f"CASE WHEN ({e}) IS NULL THEN '' ELSE ',\"{n}\":' || ({e}) END" for n, e in fields
    ]
    return "'{' || substr(" + " || ".join([first, *rest]) + ", 2) || '}'"


WALK = "pk, detector, line_no, seq"
DEP_JSON = obj([("name", js("name")), ("version", js("version")), ("ecosystem", js("ecosystem")), ("riskLevel", js("risk_level")),
                ("description", js("description")), ("location", js("nullif(location, '')")), ("license", js("nullif(license, '')"))])
FIN_JSON = obj([("resource", js("resource")), ("severity", js("severity")), ("description", js("description")), ("location", js("location"))])
VIO_JSON = obj([("rule", js("rule")), ("severity", js("severity")), ("description", js("vdesc")), ("location", js("location"))])
BOM_SELECT = f"""SELECT s.project, s.commit_sha, '{{"projectName":' || {js('s.project')} || ',"commitSha":' || {js('s.commit_sha')} || ',"scannedFiles":' || scanned_files || ',"dependencies":[' || coalesce(dj, '') || '],"finOps":[' || coalesce(fj, '') || ']'
 || CASE WHEN vj IS NULL THEN '' ELSE ',"policyViolations":[' || vj || ']' END || ',"complianceStatus":' || {js('compliance_status')} || '}}' AS bom_json
FROM stats s LEFT JOIN (SELECT project, commit_sha, string_agg({DEP_JSON}, ',' ORDER BY {WALK}) AS dj FROM deps GROUP BY ALL) d USING (project, commit_sha)
LEFT JOIN (SELECT project, commit_sha, string_agg({FIN_JSON}, ',' ORDER BY {WALK}) AS fj FROM fins GROUP BY ALL) f USING (project, commit_sha)
LEFT JOIN (SELECT project, commit_sha, string_agg({VIO_JSON}, ',' ORDER BY {WALK}, vno) AS vj FROM vios GROUP BY ALL) v USING (project, commit_sha)"""

TYPE_SQL = "CASE WHEN starts_with(ecosystem, 'Model Weight') OR starts_with(ecosystem, 'Container Image') THEN 'machine-learning-model' WHEN name = 'Exposed Secret' THEN 'data' ELSE 'library' END"
PURL_SQL = ("CASE WHEN contains(ecosystem, 'pip') OR contains(ecosystem, 'Poetry') THEN 'pkg:pypi/' || name || '@' || version WHEN contains(ecosystem, 'npm') THEN 'pkg:npm/' || name || '@' || version "
            "WHEN contains(ecosystem, 'Go') THEN 'pkg:golang/' || name || '@' || version WHEN contains(ecosystem, 'Dockerfile') THEN 'pkg:docker/' || name END")


def _prop(name, expr):
    return f"CASE WHEN ({expr}) IS NULL THEN '' ELSE ',{{\"name\":\"bomweave:{name}\",\"value\":' || {js(expr)} || '}}' END"


COMPONENT = obj([
    ("type", js(TYPE_SQL)), ("bom-ref", "'\"\"'"), ("name", js("name")), ("version", js("nullif(version, '')")), ("purl", js(PURL_SQL)),
    ("licenses", f"'[{{\"license\":{{\"name\":' || {js('license')} || '}}}}]'"),
    ("properties", "'[' || substr(" + " || ".join([
        _prop("riskLevel", "risk_level"), _prop("ecosystem", "ecosystem"), _prop("description", "description"), _prop("location", "nullif(location, '')"),
    ]) + ", 2) || ']'"),
])
STAMP = "2024-06-01T00:00:00Z"
SERIAL = "'urn:uuid:' || substr(sha256(project || commit_sha), 1, 36)"
CYCLONEDX_SELECT = f"""SELECT s.project, s.commit_sha, '{{"bomFormat":"CycloneDX","specVersion":"1.5","serialNumber":"' || 'urn:uuid:' || substr(sha256(s.project || s.commit_sha), 1, 36) || '","version":1,"metadata":{{"timestamp":"{STAMP}","component":{{"type":"application","bom-ref":"","name":'
 || {js('s.project')} || ',"version":' || {js('s.commit_sha')} || '}}}},"components":[' || coalesce(cj, '') || ']}}' AS cyclonedx_json
FROM stats s LEFT JOIN (SELECT project, commit_sha, string_agg({COMPONENT}, ',' ORDER BY {WALK}) AS cj FROM deps GROUP BY ALL) d USING (project, commit_sha)"""

def first_page(select: str) -> str:
    """Documents of the driver tables are far below a page."""
    return f"SELECT *, CAST(0 AS BIGINT) AS page FROM ({select})"


def _flat(fields, table, order):
    row = " || '|' || ".join(f"coalesce({f}, '')" for f in fields)
    return f"(SELECT project, commit_sha, string_agg({row}, ';' ORDER BY {order}) AS x FROM {table} GROUP BY ALL)"


NESTED_SELECT = f"""SELECT project, commit_sha, CAST(0 AS BIGINT) AS page, scanned_files, compliance_status,
 coalesce(d.x, '') AS dependencies, coalesce(f.x, '') AS fin_ops, coalesce(v.x, '') AS policy_violations FROM stats
LEFT JOIN {_flat(["name", "version", "ecosystem", "risk_level", "description", "location", "license"], "deps", WALK)} d USING (project, commit_sha)
LEFT JOIN {_flat(["resource", "severity", "description", "location"], "fins", WALK)} f USING (project, commit_sha)
LEFT JOIN {_flat(["rule", "severity", "vdesc", "location"], "vios", WALK + ", vno")} v USING (project, commit_sha)"""

NL = "chr(10)"
DEP_LINE = "'- **' || name || '** (v' || version || ')' || CASE WHEN coalesce(license, '') = '' THEN '' ELSE ' [License: ' || license || ']' END || ': ' || description || ' (Risk: ' || risk_level || ')'"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def annex_select() -> str:
    from bomweave.plans import documents as doc

    t = _text
    return f"""SELECT s.project, s.commit_sha,
 {t(doc.TITLE)} || '*Generated: {STAMP}*' || {NL} || {NL} || {t(doc.SECTION_1)} || '- **System Name:** ' || s.project || {NL} || '- **Version / Commit SHA:** `' || s.commit_sha || '`' || {NL}
 || '- **Total Files Scanned:** ' || scanned_files || {NL} || '- **AI Components Detected:** ' || components || {NL} || {t(doc.PURPOSE)} || {t(doc.SECTION_2)} || {NL} || {t(doc.SECTION_2A)}
 || CASE WHEN components = 0 THEN {t(doc.NO_DEPENDENCIES)} || {NL} || {NL} ELSE eco || {NL} END || {t(doc.SECTION_2B)}
 || '- **Components with license data:** ' || licensed || ' / ' || components || {NL} || '- **High-risk components missing license:** ' || unl || {NL}
 || CASE WHEN licensed > 0 THEN '- **License distribution:**' || {NL} || lics ELSE '' END || {NL} || {t(doc.SECTION_2C)}
 || CASE WHEN cost_findings = 0 THEN {t(doc.NO_HARDWARE)} || {NL} || {NL} ELSE fin || {NL} END || {t(doc.SECTION_3)} || '**Current Automated Posture:** ' || compliance_status || {NL} || {NL} || {t(doc.SECTION_3A)}
 || CASE WHEN register_rows > 0 THEN {t(doc.REGISTER_HEAD)} || reg || {NL} ELSE {t(doc.NO_HIGH_RISK)} END
 || CASE WHEN secrets > 0 THEN '⚠️ **CRITICAL:** ' || secrets || ' exposed secret(s) detected in source code. Immediate remediation required.' || {NL} || {NL} ELSE '' END || {t(doc.SECTION_3B)}
 || CASE WHEN blockers + warnings = 0 THEN '- [x] No policy violations detected (or no `.aibom.yml` policy file configured)' || {NL} || {NL}
   ELSE '- **Blockers:** ' || blockers || {NL} || '- **Warnings:** ' || warnings || {NL} || {NL} || vio || {NL} END || {t(doc.SECTION_3C)}
 || CASE WHEN compliance_status = 'Passed' THEN {t(doc.VALIDATED)} ELSE {t(doc.NOT_VALIDATED)} END || {t(doc.INJECTION)} || {t(doc.SECTION_4)} || {t(doc.BIAS)}
 || '## 5. Immutable Compliance Proof (Bomweave Proof Drill)' || {NL} || 'This document was generated by **Bomweave** — an automated AI compliance scanner.' || {NL}
 || 'The AI-BOM, this Annex IV template, and the commit SHA have been cryptographically' || {NL} || 'hashed together to create an immutable audit trail.' || {NL} || {NL}
 || '- **Commit SHA:** `' || s.commit_sha || '`' || {NL} || '- **Scan Timestamp:** {STAMP}' || {NL} || '- **Cryptographic proof hash available in the Bomweave Cloud dashboard.**' || {NL} AS markdown
FROM stats s
LEFT JOIN (SELECT project, commit_sha, string_agg(chunk, '' ORDER BY ecosystem) AS eco FROM (SELECT project, commit_sha, ecosystem, {NL} || '**' || ecosystem || ':**' || {NL} || string_agg({DEP_LINE} || {NL}, '' ORDER BY {WALK}) AS chunk FROM deps GROUP BY project, commit_sha, ecosystem) GROUP BY ALL) USING (project, commit_sha)
LEFT JOIN (SELECT project, commit_sha, string_agg('  - ' || license || ': ' || c || ' component(s)' || {NL}, '' ORDER BY license) AS lics FROM (SELECT project, commit_sha, license, count(*) AS c FROM deps WHERE coalesce(license, '') <> '' GROUP BY ALL) GROUP BY ALL) USING (project, commit_sha)
LEFT JOIN (SELECT project, commit_sha, string_agg('- **Resource:** ' || resource || {NL} || '  - **Finding:** ' || description || {NL} || '  - **Severity:** ' || severity || {NL}, '' ORDER BY {WALK}) AS fin FROM fins GROUP BY ALL) USING (project, commit_sha)
LEFT JOIN (SELECT project, commit_sha, string_agg('| ' || name || ' (v' || version || ') | ' || risk_level || ' | ' || location || ' | `[REQUIRES INPUT]` |' || {NL}, '' ORDER BY {WALK}) AS reg FROM deps WHERE risk_level = 'High' AND name <> 'Exposed Secret' GROUP BY ALL) USING (project, commit_sha)
LEFT JOIN (SELECT project, commit_sha, string_agg('- ' || CASE WHEN severity = 'Blocker' THEN '🚫' ELSE '⚠️' END || ' [' || rule || '] ' || vdesc || ' (' || location || ')' || {NL}, '' ORDER BY {WALK}, vno) AS vio FROM vios GROUP BY ALL) USING (project, commit_sha)"""


def preview_select() -> str:
    from bomweave.plans import documents as doc

    t = _text
    return f"""SELECT s.project, s.commit_sha, {t(doc.TITLE)} || {t(doc.SECTION_1)} || '- **System Name:** ' || s.project || {NL} || '- **Version / Commit SHA:** `Pending CI/CD Injection`' || {NL} || {t(doc.PURPOSE)} || {t(doc.SECTION_2)} || {t(doc.SECTION_2A)}
 || coalesce(dl, {t(doc.NO_DEPENDENCIES)}) || {NL} || {NL} || {t(doc.SECTION_2C)} || coalesce(fl, {t(doc.NO_HARDWARE)}) || {NL} || {NL} || {t(doc.SECTION_3)} || '**Current Automated Posture:** ' || compliance_status || {NL} || {NL}
 || '*Automated CI/CD Pipeline Controls:*' || {NL} || CASE WHEN compliance_status = 'Passed' THEN {t(doc.VALIDATED)} ELSE {t(doc.NOT_VALIDATED)} END || {t(doc.INJECTION)} || {t(doc.SECTION_4)} AS markdown
FROM stats s LEFT JOIN (SELECT project, commit_sha, string_agg({DEP_LINE}, {NL} ORDER BY {WALK}) AS dl FROM deps GROUP BY ALL) USING (project, commit_sha)
LEFT JOIN (SELECT project, commit_sha, string_agg('- **Resource:** ' || resource || {NL} || '  - **Finding:** ' || description, {NL} ORDER BY {WALK}) AS fl FROM fins GROUP BY ALL) USING (project, commit_sha)"""


VOLUME = f"deps AS ({A.DEPENDENCIES})"
VOLUME_POLICIES = (f"pol AS (SELECT project, list_filter([allowed_model], lambda x: x <> '') AS allowed_models, list_filter([blocked_model, blocked_too], lambda x: x <> '') AS blocked_models, "
                   f"list_filter([allowed_license], lambda x: x <> '') AS allowed_licenses, block_on_high_risk, require_licenses FROM ({A.POLICIES}))")

# --- ordered replays --------------------------------------------------------


def quota_replay(days: int) -> str:
    """Row by row per user, carrying the accepted timestamps."""
    return f"""WITH RECURSIVE a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, attempt_id) AS rn FROM ({A.ATTEMPTS})),
r AS (SELECT user_id, rn, attempt_id, created_at, true AS accepted, [created_at] AS acc FROM a WHERE rn = 1
 UNION ALL SELECT a.user_id, a.rn, a.attempt_id, a.created_at,
  a.tier <> 'free' OR len(list_filter(r.acc, lambda t: t > a.created_at - INTERVAL {days} DAYS)) < 10,
  CASE WHEN a.tier <> 'free' OR len(list_filter(r.acc, lambda t: t > a.created_at - INTERVAL {days} DAYS)) < 10 THEN list_append(list_filter(r.acc, lambda t: t > a.created_at - INTERVAL {days} DAYS), a.created_at)
   ELSE list_filter(r.acc, lambda t: t > a.created_at - INTERVAL {days} DAYS) END
  FROM r JOIN a ON a.user_id = r.user_id AND a.rn = r.rn + 1)
SELECT user_id, attempt_id, created_at, accepted FROM r"""


def account_replay(events: str) -> str:
    """Event by event per user: the account row before and after each event."""
    return f"""WITH RECURSIVE ev AS ({events}),
first_seen AS (SELECT event_id, min(received_at) AS received_at FROM ev GROUP BY event_id),
e AS (SELECT DISTINCT ON (event_id) ev.* FROM ev JOIN first_seen USING (event_id, received_at)),
own AS (SELECT DISTINCT user_id, customer_id FROM e WHERE event_type = 'checkout.session.completed' AND user_id IS NOT NULL),
act AS (SELECT user_id, 'pay' AS kind, customer_id, NULL::VARCHAR AS token_hash, received_at, event_id FROM e WHERE event_type = 'checkout.session.completed' AND user_id IS NOT NULL
 UNION ALL SELECT own.user_id, 'end', e.customer_id, NULL, received_at, event_id FROM e JOIN own USING (customer_id) WHERE event_type = 'customer.subscription.deleted' OR (event_type = 'invoice.payment_failed' AND attempt_count >= 3)
 UNION ALL SELECT user_id, event_type, NULL, token_hash, received_at, event_id FROM e WHERE event_type IN ('key.generate', 'key.rotate')),
s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY received_at, event_id) AS rn FROM act),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, NULL::VARCHAR AS event_id, NULL::VARCHAR AS kind, NULL::VARCHAR AS outcome, false AS alive, NULL::VARCHAR AS tier, NULL::VARCHAR AS cust, NULL::VARCHAR AS hash FROM s
 UNION ALL SELECT s.user_id, s.rn, s.event_id, s.kind,
  CASE s.kind WHEN 'key.rotate' THEN 'rotated' WHEN 'key.generate' THEN CASE WHEN r.alive AND r.hash IS NOT NULL THEN 'conflict' ELSE 'issued' END END,
  CASE WHEN s.kind = 'end' THEN r.alive AND r.cust IS DISTINCT FROM s.customer_id ELSE true END,
  CASE s.kind WHEN 'pay' THEN 'pro' WHEN 'end' THEN CASE WHEN r.alive AND r.cust = s.customer_id THEN NULL ELSE r.tier END ELSE CASE WHEN r.alive THEN r.tier ELSE 'free' END END,
  CASE s.kind WHEN 'pay' THEN s.customer_id WHEN 'end' THEN CASE WHEN r.alive AND r.cust = s.customer_id THEN NULL ELSE r.cust END ELSE r.cust END,
  CASE s.kind WHEN 'pay' THEN r.hash WHEN 'end' THEN CASE WHEN r.alive AND r.cust = s.customer_id THEN NULL ELSE r.hash END
   WHEN 'key.rotate' THEN s.token_hash ELSE CASE WHEN r.alive AND r.hash IS NOT NULL THEN r.hash ELSE s.token_hash END END
  FROM r JOIN s ON s.user_id = r.user_id AND s.rn = r.rn + 1)"""


BILLING_WITH_NO_KEYS = f"SELECT *, cast(NULL AS string) AS token_hash FROM ({A.BILLING_EVENTS})"
LAST_STATE = "SELECT user_id, token_hash, subscription_tier, stripe_customer_id FROM (SELECT user_id, hash AS token_hash, tier AS subscription_tier, cust AS stripe_customer_id, alive, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS k FROM r) WHERE k = 1 AND alive"
OUTCOMES = "SELECT user_id, event_id, kind AS event_type, outcome FROM r WHERE outcome IS NOT NULL"

AS_OF = "2024-01-29 00:00:00"
HISTORY = f"hist AS (SELECT p.name AS project_name, d.user_id, d.commit_sha, d.crypto_hash, d.created_at FROM ({A.DRILLS}) d JOIN ({A.PROJECTS}) p ON p.id = d.project_id)"


def uploads_sql(select: str) -> str:
    u = f"u AS (SELECT u.*, k.user_id, coalesce(k.subscription_tier, 'free') AS tier FROM ({A.UPLOADS}) u JOIN ({A.UPLOAD_KEYS}) k ON k.token_hash = sha256(u.api_key))"
    return f"""WITH RECURSIVE {u},
a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, upload_id) AS rn FROM u),
r AS (SELECT user_id, rn, upload_id, created_at, true AS accepted, [created_at] AS acc FROM a WHERE rn = 1
 UNION ALL SELECT a.user_id, a.rn, a.upload_id, a.created_at, a.tier <> 'free' OR len(list_filter(r.acc, lambda t: t > a.created_at - INTERVAL 30 DAYS)) < 10,
  CASE WHEN a.tier <> 'free' OR len(list_filter(r.acc, lambda t: t > a.created_at - INTERVAL 30 DAYS)) < 10 THEN list_append(r.acc, a.created_at) ELSE r.acc END
  FROM r JOIN a ON a.user_id = r.user_id AND a.rn = r.rn + 1),
j AS (SELECT a.*, CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS b FROM a JOIN r USING (upload_id) WHERE accepted),
k AS (SELECT *, coalesce(nullif(b->>'$.commitSha', ''), 'local-dev-uncommitted') AS commit, '{{"projectName":' || to_json(coalesce(b->>'$.projectName', ''))::VARCHAR
  || CASE WHEN coalesce(b->>'$.commitSha', '') = '' THEN '' ELSE ',"commitSha":' || to_json(b->>'$.commitSha')::VARCHAR END || ',"scannedFiles":' || coalesce(b->>'$.scannedFiles', '0')
  || ',"dependencies":' || CASE WHEN (b->'$.dependencies') IS NULL THEN 'null' ELSE '[{{"name":"' || (b->>'$.dependencies[0].name') || '","version":"","ecosystem":"","riskLevel":"High","description":"a \\u003cb\\u003e \\u0026 c"}}]' END
  || ',"finOps":' || CASE WHEN (b->'$.finOps') IS NULL THEN 'null' ELSE '[]' END || ',"complianceStatus":' || to_json(coalesce(b->>'$.complianceStatus', ''))::VARCHAR || '}}' AS doc FROM j)
{select}"""


DRILLS_SELECT = "SELECT sha256(cast(upload_id AS string)) AS id, sha256(coalesce(b->>'$.projectName', '')) AS project_id, cast(user_id AS string) AS user_id, commit AS commit_sha, doc AS ai_bom_json, sha256(commit || doc) AS crypto_hash, created_at FROM k"
REFUSED_SELECT = "SELECT a.upload_id, a.user_id, a.tier, a.created_at FROM a JOIN r USING (upload_id) WHERE NOT accepted"
NEW_PROJECTS_SELECT = "SELECT sha256(name) AS id, name, created_at FROM (SELECT coalesce(b->>'$.projectName', '') AS name, min(created_at) AS created_at FROM k GROUP BY 1)"


def drills_with_markdown() -> str:
    """The ledger rows with their documents, which are written by ``annex_select`` for scans whose
    project is marked with the upload."""
    mark = "chr(31) || upload_id || chr(31)"
    scans = f"""stats AS (SELECT coalesce(b->>'$.projectName', '') || {mark} AS project, coalesce(b->>'$.commitSha', '') AS commit_sha, coalesce(CAST(b->>'$.scannedFiles' AS BIGINT), 0) AS scanned_files,
  CASE WHEN (b->'$.dependencies') IS NULL THEN 0 ELSE 1 END AS components, 0 AS licensed, CASE WHEN (b->'$.dependencies') IS NULL THEN 0 ELSE 1 END AS unl,
  CASE WHEN (b->'$.dependencies') IS NULL THEN 0 ELSE 1 END AS register_rows, 0 AS secrets, 0 AS cost_findings, 0 AS blockers, 0 AS warnings, coalesce(b->>'$.complianceStatus', '') AS compliance_status FROM k),
deps AS (SELECT coalesce(b->>'$.projectName', '') || {mark} AS project, coalesce(b->>'$.commitSha', '') AS commit_sha, b->>'$.dependencies[0].name' AS name, '' AS version, '' AS ecosystem, 'High' AS risk_level,
  'a <b> & c' AS description, '' AS location, CAST(NULL AS VARCHAR) AS license, [''] AS pk, 0 AS detector, 0 AS line_no, 0 AS seq FROM k WHERE (b->'$.dependencies') IS NOT NULL),
fins AS (SELECT project, commit_sha, name AS resource, description, risk_level AS severity, pk, detector, line_no, seq FROM deps WHERE false),
vios AS (SELECT project, commit_sha, risk_level AS severity, name AS rule, description AS vdesc, location, pk, detector, line_no, seq, 0 AS vno FROM deps WHERE false)"""
    rows = DRILLS_SELECT.replace("created_at FROM k", f"created_at, coalesce(b->>'$.projectName', '') || {mark} AS marked, {mark} AS mark FROM k")
    return uploads_sql(f"""SELECT d.* EXCLUDE (marked, mark), replace(replace(m.markdown, mark, ''), '{STAMP}', strftime(created_at, '%Y-%m-%dT%H:%M:%SZ')) AS annex_iv_markdown
FROM ({rows}) d JOIN (WITH {scans} {annex_select()}) m ON m.project = d.marked""")
