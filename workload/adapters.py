"""Test-data definitions: the engine's inputs derived from the driver tables.

Every adapter is SQL that Spark and DuckDB run alike, so a query and its oracle
read identical rows. The driver tables hold no AI content; the ``files`` adapter
wraps the *whole* text of every document in one of sixteen file kinds, as
comments or as a JSON value, next to lines of the kind's own syntax. ``doc_id %
16`` chooses the kind of a document; it leaves none out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bomweave.sources.files import spread

POLICY_FILE = ".aibom.yml"

FILES = """
WITH lib(i, n) AS (VALUES
 (0,'openai'),(1,'anthropic'),(2,'google-generativeai'),(3,'cohere'),(4,'mistralai'),(5,'groq'),(6,'tiktoken'),(7,'langchain'),
 (8,'llama-index'),(9,'autogen'),(10,'crewai'),(11,'torch'),(12,'torchvision'),(13,'tensorflow'),(14,'keras'),(15,'jax'),
 (16,'scikit-learn'),(17,'xgboost'),(18,'transformers'),(19,'datasets'),(20,'vllm'),(21,'ollama'),(22,'chromadb'),(23,'mlflow'),
 (24,'flask'),(25,'requests'),(26,'numpy'),(27,'pandas'),(28,'express'),(29,'react'),(30,'boto3'),(31,'lodash')),
mdl(i, m) AS (VALUES
 (0,'gpt-4-turbo'),(1,'claude-3-opus'),(2,'llama-3.1'),(3,'mixtral-8x7b'),(4,'gemini-1.5-pro'),(5,'o1-mini'),(6,'phi-3'),(7,'bert-base')),
d AS (SELECT doc_id, source, text, doc_id % 16 AS k, cast(floor(doc_id / 16) AS bigint) AS h, chr(10) AS nl, chr(34) AS q,
  concat(cast(doc_id % 4 AS string), '.', cast(doc_id % 10 AS string), '.', cast(doc_id % 3 AS string)) AS v,
  concat('# ', replace(text, chr(10), concat(chr(10), '# ')), chr(10)) AS note,
  concat('// ', replace(text, chr(10), concat(chr(10), '// ')), chr(10)) AS slashes,
  replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n')) AS quoted
  FROM documents),
j AS (SELECT d.*, a.n AS n1, b.n AS n2, c.n AS n3, mdl.m AS m FROM d
  JOIN lib a ON a.i = (h * 7 + k) % 32 JOIN lib b ON b.i = (h * 11 + k + 3) % 32 JOIN lib c ON c.i = (h * 13 + k + 5) % 32
  JOIN mdl ON mdl.i = h % 8)
SELECT source AS project, md5(source) AS commit_sha,
 concat('d', cast(doc_id AS string), '/', CASE k WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'package.json' WHEN 2 THEN 'go.mod'
  WHEN 3 THEN 'pyproject.toml' WHEN 4 THEN 'Dockerfile' WHEN 5 THEN 'app.py' WHEN 6 THEN 'main.go' WHEN 7 THEN '.env'
  WHEN 8 THEN 'model.PT' WHEN 9 THEN 'deploy.yaml' WHEN 10 THEN 'values.yaml' WHEN 11 THEN 'main.tf'
  WHEN 12 THEN '.git/requirements.txt' WHEN 13 THEN 'Dockerfile.gpu' WHEN 14 THEN 'README.md' ELSE 'gen.py' END) AS path,
 CASE k
  WHEN 0 THEN concat(note, n1, '==', v, nl, upper(n2), '>=', v, nl, nl, n3, ' == ', v, nl)
  WHEN 1 THEN concat(chr(123), q, 'description', q, ':', q, quoted, q, ',', q, 'dependencies', q, ':', chr(123), q, n1, q, ':', q, '^', v, q, chr(125), ',', q, 'devDependencies', q, ':', chr(123), q, n2, q, ':', q, '~', v, q, CASE WHEN doc_id % 64 = 17 THEN concat(',', q, 'broken', q, ':1') ELSE '' END, chr(125), chr(125))
  WHEN 2 THEN concat('module example.com/m', nl, slashes, 'require (', nl, chr(9), 'github.com/acme/go-', n1, ' v', v, nl, chr(9), 'github.com/tmc/langchaingo v', v, nl, ')', nl, 'github.com/x/ollama v1.0.0', nl, 'require github.com/y/go-cohere v', v, nl)
  WHEN 3 THEN concat('[tool.poetry]', nl, note, n3, ' = ', q, '9', q, nl, '[tool.poetry.dependencies]', nl, 'python = ', q, '^3.11', q, nl, n1, ' = ', q, '^', v, q, nl, n2, ' = ', chr(123), 'version = ', q, '>=', v, q, ', optional = true', chr(125), nl, '[tool.other]', nl, n3, ' = ', q, '1', q)
  WHEN 4 THEN concat(note, 'FROM nvcr.io/nvidia/pytorch:24.01-py3', nl, 'RUN pip install ', n1, ' ', n2, nl, 'COPY w/', m, '.safetensors /m/', nl)
  WHEN 5 THEN concat('import ', n1, nl, 'from ', n2, '.sub import x', nl, 'import ', n1, nl, 'm = ', q, m, q, nl, 'k = ', q, 'sk-', md5(text), q, nl, note)
  WHEN 6 THEN concat('package main', nl, slashes, '// ', q, m, q, nl, 'var m = ', q, m, q, nl, 'var k = ', q, 'sk-', md5(text), q, nl)
  WHEN 7 THEN concat(note, 'OPENAI_API_KEY=sk-ant-', md5(text), nl, 'HF_TOKEN=<x>', nl, 'WANDB_API_KEY=', substr(md5(text), 1, 8), nl, 'export X=hf_', md5(text), nl, 'PORT=8080', nl)
  WHEN 8 THEN text
  WHEN 9 THEN concat(note, 'limits:', nl, '  nvidia.com/gpu: 1', nl, CASE WHEN doc_id % 32 = 9 THEN 'mig.config: all' ELSE 'x: y' END)
  WHEN 10 THEN concat(note, 'image: ', n1, nl, 'AMD.com/gpu: 1', nl, CASE WHEN doc_id % 32 = 10 THEN 'minReplicas: 1' ELSE 'x: y' END)
  WHEN 11 THEN concat(note, 'instance_type = ', q, CASE WHEN doc_id % 48 = 11 THEN 'p4d.24xlarge' WHEN doc_id % 48 = 27 THEN 'g5.xlarge' ELSE 'Standard_NC6s_v3' END, q, nl, CASE WHEN doc_id % 32 = 11 THEN 'capacity_type = spot' ELSE '' END)
  WHEN 12 THEN concat(note, n1, '==', v, nl)
  WHEN 13 THEN concat(note, 'FROM python:3.11', nl, 'RUN echo ok', nl)
  ELSE text END AS content
FROM j
UNION ALL
SELECT source AS project, md5(source) AS commit_sha, '.aibom.yml' AS path,
 CASE length(source) % 2 * 3 + ascii(substr(md5(source), 1, 1)) % 3
  WHEN 0 THEN concat('# rules', chr(10), 'blocked_models:', chr(10), '  - gpt-4', chr(10), '  - ', chr(34), 'gpt-4-turbo', chr(34), chr(10), 'max_risk_level: Medium', chr(10))
  WHEN 1 THEN concat('allowed_models:', chr(10), '- claude-3', chr(10), chr(10), '  # none', chr(10), '- nothing: here', chr(10))
  WHEN 2 THEN concat('block_on_high_risk: true', chr(10))
  WHEN 3 THEN concat('require_licenses: true', chr(10), 'allowed_licenses:', chr(10), ' - proprietary (openai)', chr(10), 'other:', chr(10), ' - dropped', chr(10))
  ELSE concat('require_licenses: ', chr(34), 'true', chr(34), chr(10), 'block_on_high_risk: no', chr(10), 'blocked_models:', chr(10), ' - torch', chr(10)) END AS content
FROM (SELECT DISTINCT source FROM documents) AS sources
"""

ATTEMPTS = """
SELECT event_id AS attempt_id, user_id, CASE WHEN user_id % 3 = 0 THEN 'pro' ELSE 'free' END AS tier,
 concat('proj', cast(event_id % 37 AS string)) AS project_name, md5(cast(event_id AS string)) AS commit_sha, ts AS created_at
FROM events
"""

BILLING_EVENTS = """
WITH e AS (SELECT concat('evt_', cast(event_id AS string)) AS event_id,
 CASE event_type WHEN 'signup' THEN 'checkout.session.completed' WHEN 'view' THEN 'customer.subscription.deleted'
  WHEN 'error' THEN 'invoice.payment_failed' WHEN 'purchase' THEN 'customer.subscription.updated' ELSE 'other' END AS event_type,
 CASE WHEN event_id % 20 = 0 THEN NULL ELSE user_id END AS user_id,
 concat('cus_', cast(user_id AS string)) AS customer_id, event_id % 5 AS attempt_count, ts AS received_at, event_id AS n FROM events)
SELECT event_id, event_type, user_id, customer_id, attempt_count, received_at FROM e
UNION ALL
SELECT event_id, event_type, user_id, customer_id, attempt_count, received_at + INTERVAL 5 MINUTES FROM e WHERE n % 10 = 0
"""

# Billing and key events of one timeline. Some users change their customer.
ACCOUNT_EVENTS = """
SELECT concat('evt_', cast(event_id AS string)) AS event_id,
 CASE WHEN event_type = 'signup' THEN 'checkout.session.completed'
  WHEN event_type = 'view' AND event_id % 3 = 0 THEN 'customer.subscription.deleted'
  WHEN event_type = 'error' THEN 'invoice.payment_failed'
  WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'key.rotate'
  WHEN event_type = 'purchase' THEN 'key.generate'
  ELSE 'other' END AS event_type,
 CASE WHEN event_type = 'signup' AND event_id % 20 = 0 THEN NULL ELSE user_id END AS user_id,
 concat('cus_', cast(user_id AS string), CASE WHEN user_id % 4 = 0 AND event_id % 2 = 0 THEN 'b' ELSE '' END) AS customer_id,
 event_id % 5 AS attempt_count, ts AS received_at, md5(cast(event_id AS string)) AS token_hash
FROM events
"""

DEPENDENCIES = """
WITH lib(i, name, risk) AS (VALUES (0,'openai','High'),(1,'langchain','Medium'),(2,'torch','High'),(3,'scikit-learn','Low'),
 (4,'Hardcoded Model','High'),(5,'Exposed Secret','High'),(6,'mlflow','Medium'),(7,'chromadb','Low'))
SELECT concat('proj', cast(l_orderkey % 500 AS string)) AS project, md5(cast(l_orderkey % 500 AS string)) AS commit_sha, name,
 CASE name WHEN 'Hardcoded Model' THEN CASE l_suppkey % 3 WHEN 0 THEN 'gpt-4-turbo' WHEN 1 THEN 'claude-3-opus' ELSE 'llama-3.1' END
  WHEN 'Exposed Secret' THEN 'HIDDEN' ELSE concat(cast(l_linenumber AS string), '.0') END AS version,
 CASE WHEN name IN ('Hardcoded Model','Exposed Secret') THEN 'Source Code (.py)' WHEN l_linenumber % 3 = 0 THEN 'Python (pip)'
  WHEN l_linenumber % 3 = 1 THEN 'Node.js (npm)' ELSE 'Container Image (pip in Dockerfile)' END AS ecosystem,
 risk AS risk_level, CASE l_returnflag WHEN 'A' THEN 'MIT' WHEN 'R' THEN 'GPL-3.0' ELSE NULL END AS license,
 concat('found ', name) AS description,
 concat('f', cast(l_partkey AS string), '.py:', cast(l_linenumber AS string)) AS location
FROM lineitem JOIN lib ON i = l_partkey % 8
"""

# One policy per project of DEPENDENCIES.
POLICIES = """
SELECT DISTINCT concat('proj', cast(l_orderkey % 500 AS string)) AS project,
 CASE WHEN l_orderkey % 500 % 5 = 2 THEN 'claude-3' ELSE '' END AS allowed_model,
 CASE WHEN l_orderkey % 500 % 5 = 1 THEN 'gpt-4' ELSE '' END AS blocked_model,
 CASE WHEN l_orderkey % 500 % 5 = 1 THEN 'GPT-4-turbo' ELSE '' END AS blocked_too,
 l_orderkey % 500 % 5 = 3 AS block_on_high_risk, l_orderkey % 500 % 5 = 4 AS require_licenses,
 CASE WHEN l_orderkey % 500 % 5 = 4 THEN 'mit' ELSE '' END AS allowed_license
FROM lineitem
"""

REGISTRY = """
SELECT CASE p_partkey % 6 WHEN 0 THEN 'meta-llama/Meta-Llama-3-8B' WHEN 1 THEN 'mistralai/Mixtral-8x7B-v0.1'
  WHEN 2 THEN 'mistralai/Mistral-7B-v0.1' ELSE concat('org/model-', cast(p_partkey AS string)) END AS hf_id,
 CASE p_partkey % 6 WHEN 0 THEN 'license:llama3' WHEN 1 THEN 'license:apache-2.0' WHEN 2 THEN 'license:' ELSE concat('license:x', cast(p_partkey AS string)) END AS license_tag
FROM part
"""

DRILLS = """
SELECT cast(a.event_id AS string) AS id, sha256(concat('proj', cast(a.event_id % 37 AS string))) AS project_id,
 cast(a.user_id AS string) AS user_id, md5(cast(a.event_id AS string)) AS commit_sha, a.props AS ai_bom_json,
 concat('# proof ', cast(a.event_id AS string)) AS annex_iv_markdown,
 sha256(concat(md5(cast(a.event_id AS string)), CASE WHEN a.event_id % 11 = 0 THEN 'tampered' ELSE coalesce(a.props, '') END)) AS crypto_hash, a.ts AS created_at
FROM events a
"""

PROJECTS = """
SELECT sha256(concat('proj', cast(n AS string))) AS id, concat('proj', cast(n AS string)) AS name,
 cast(NULL AS string) AS repository_url, first_seen AS created_at
FROM (SELECT event_id % 37 AS n, min(ts) AS first_seen FROM events GROUP BY event_id % 37) AS g
"""

# Accounts of customers; every fifth has no key, every seventh no tier.
API_KEYS = """
SELECT c_custkey AS user_id,
 CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE sha256(concat('key-', cast(c_custkey AS string))) END AS token_hash,
 CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'pro' ELSE 'free' END AS subscription_tier,
 CASE WHEN c_custkey % 3 = 0 THEN concat('cus_', cast(c_custkey AS string)) ELSE NULL END AS stripe_customer_id,
 CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 4 END AS scans_this_month
FROM customer
"""

# Requests with keys, one per order; every ninth key is unknown or empty.
KEY_REQUESTS = """
SELECT o_orderkey AS request_id, CASE o_orderkey % 9 WHEN 0 THEN concat('bad-', cast(o_custkey AS string)) WHEN 1 THEN ''
 ELSE concat('key-', cast(o_custkey AS string)) END AS api_key
FROM orders
"""

CHECKOUT_SESSIONS = """
SELECT concat('cs_', cast(o_orderkey AS string)) AS session_id, o_custkey + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS session_user_id,
 CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'open' ELSE 'expired' END AS status,
 concat('cus_', cast(o_custkey AS string)) AS customer_id
FROM orders
"""

CHECKOUT_REQUESTS = """
SELECT concat('cs_', cast(CASE WHEN o_orderkey % 13 = 0 THEN -o_orderkey ELSE o_orderkey END AS string)) AS session_id, o_custkey AS user_id
FROM orders
"""

# BOM uploads: one document per event, the key of the event's user.
UPLOADS = """
SELECT event_id AS upload_id, concat('key-', cast(user_id AS string)) AS api_key, ts AS created_at,
 CASE WHEN event_id % 50 = 7 THEN 'no document' ELSE concat(chr(123), chr(34), 'projectName', chr(34), ':', chr(34), 'proj', cast(event_id % 37 AS string), chr(34),
  CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(',', chr(34), 'commitSha', chr(34), ':', chr(34), md5(cast(event_id AS string)), chr(34)) END,
  ',', chr(34), 'scannedFiles', chr(34), ':', cast(event_id % 100 AS string),
  CASE WHEN event_id % 4 = 0 THEN '' ELSE concat(',', chr(34), 'dependencies', chr(34), ':[', chr(123), chr(34), 'name', chr(34), ':', chr(34), event_type, chr(34), ',', chr(34), 'riskLevel', chr(34), ':', chr(34), 'High', chr(34), ',', chr(34), 'description', chr(34), ':', chr(34), 'a <b> & c', chr(34), chr(125), ']') END,
  ',', chr(34), 'finOps', chr(34), ':[],', chr(34), 'complianceStatus', chr(34), ':', chr(34), 'Passed', chr(34), chr(125)) END AS body
FROM events
"""

UPLOAD_KEYS = """
SELECT user_id, sha256(concat('key-', cast(user_id AS string), CASE WHEN user_id % 10 = 9 THEN '-renewed' ELSE '' END)) AS token_hash, CASE WHEN user_id % 3 = 0 THEN 'pro' ELSE 'free' END AS subscription_tier,
 cast(NULL AS string) AS stripe_customer_id, 0 AS scans_this_month
FROM (SELECT DISTINCT user_id FROM events) AS u
"""

# Webhook bodies, one per event; every third customer is an expanded object (Spark only).
WEBHOOKS = """
SELECT concat('{"id":"evt_', event_id, '","type":"', event_type, '","created":', unix_timestamp(ts), ',"data":{"object":{"customer":',
 CASE WHEN event_id % 3 = 0 THEN concat('{"id":"cus_', user_id, '","livemode":false}') ELSE concat('"cus_', user_id, '"') END,
 ',"attempt_count":', event_id % 5, ',"metadata":{"user_id":"', user_id, '"}}}}') AS value
FROM events
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


# Driver tables come as one file with one row group: share them out before the
# heavy work. At scale they come in many splits, and this does nothing.
SPREAD_BY = {"documents": ["doc_id"], "lineitem": ["l_orderkey", "l_linenumber"]}


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run an adapter on Spark over the parquet tables of ``sf_dir``."""
    for table in TABLES:
        if f"FROM {table}" in sql:
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            if table in SPREAD_BY:
                rows = spread(rows, *SPREAD_BY[table])
            rows.createOrReplaceTempView(table)
    return spark.sql(_spark_hash(sql))


def _spark_hash(sql: str) -> str:
    """``sha256(x)`` to ``sha2(x, 256)``."""
    out, rest = "", sql
    while "sha256(" in rest:
        before, rest = rest.split("sha256(", 1)
        depth, end = 1, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
        out += before + "sha2(" + rest[:end - 1] + ", 256)"
        rest = rest[end:]
    return out + rest
