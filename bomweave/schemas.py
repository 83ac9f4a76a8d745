"""Explicit schemas; nothing in the engine is inferred from data."""

from pyspark.sql import types as T

FILES = "project string, commit_sha string, path string, content string"

FINDING = (
    "struct<detector:int,line_no:int,seq:int,name:string,version:string,ecosystem:string,"
    "level:string,description:string,location:string>"
)

DEPENDENCY_JSON = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("ecosystem", T.StringType()),
    T.StructField("riskLevel", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("license", T.StringType()),
])

FINOPS_JSON = T.StructType([
    T.StructField("resource", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("location", T.StringType()),
])

VIOLATION_JSON = T.StructType([
    T.StructField("rule", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("location", T.StringType()),
])

# Field order is the serialisation order.
BOM_JSON = T.StructType([
    T.StructField("projectName", T.StringType()),
    T.StructField("commitSha", T.StringType()),
    T.StructField("scannedFiles", T.IntegerType()),
    T.StructField("dependencies", T.ArrayType(DEPENDENCY_JSON)),
    T.StructField("finOps", T.ArrayType(FINOPS_JSON)),
    T.StructField("policyViolations", T.ArrayType(VIOLATION_JSON)),
    T.StructField("complianceStatus", T.StringType()),
])

POLICY = (
    "project string, allowed_models array<string>, blocked_models array<string>, "
    "max_risk_level string, block_on_high_risk boolean, require_licenses boolean, "
    "allowed_licenses array<string>"
)

PROOF_DRILLS = (
    "id string, project_id string, user_id string, commit_sha string, ai_bom_json string, "
    "risk_register_state string, annex_iv_markdown string, crypto_hash string, created_at timestamp"
)

# Verified webhook payload: id, type, created, data.object
WEBHOOK_EVENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("created", T.LongType()),
    T.StructField("data", T.StructType([
        T.StructField("object", T.StructType([
            T.StructField("customer", T.StringType()),
            T.StructField("attempt_count", T.LongType()),
            T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        ])),
    ])),
])
