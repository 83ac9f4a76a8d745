"""Registered queries of the operators; ``SQL`` has the oracles that DuckDB can run.

A query applies its operator to the whole table and derives digest columns from the
operator's real outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, importance, language, lines, manifest, mixing, near, quality, repeats, token_counts, topk, toxicity, vectors
from .common import fold_of, read, sha256_hex

QUERIES: dict = {}
SQL: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, tokenizer_path("byte_bpe_50k.json")).drop("text")


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, tokenizer_path("word_bpe_49k.json"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_hex(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"),
    )


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.line_dedup(docs).select(
        "doc_id", "n_lines", "n_dropped", sha256_hex(F.col("kept_text")).alias("kept_sha256"))


SQL["op10_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.line, k.pos, coalesce(r.first < k.doc_id, false) AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


TOXICITY_FOLDS = 5


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    """Learnt outside of the held-out fold."""
    return toxicity.fit(docs, labels, learn=fold_of(F.col("doc_id"), TOXICITY_FOLDS) != 0)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (fold_of(F.col("doc_id"), TOXICITY_FOLDS) == 0).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 4, 2


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = fold_of(F.col("doc_id"), LANGUAGE_FOLDS)
    model = language.fit(docs, learn=fold != LANGUAGE_HELD_OUT)
    return language.identify(docs.drop("lang"), model).select(
        "doc_id", (fold == LANGUAGE_HELD_OUT).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5, scale=256.0)


SQL["op1_top_k"] = r"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS value
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.value, c.value), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""


@query
def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), least=0.9)


@query
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, window=400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


MIX_ENTROPY, MIX_LIMIT = 0.99, 2.0


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    drawn = mixing.mix(docs, entropy=MIX_ENTROPY, limit=MIX_LIMIT)
    return drawn.select("doc_id", "source", "mix_pass", mixing.tokens_of(F.col("text")).alias("n_tokens"))


_SPREAD = ("ln(list_sum(list_transform(p, lambda x: pow(x, {a})))) - list_sum(list_transform(p, lambda x: pow(x, {a}) * {a} * ln(x)))"
           " / list_sum(list_transform(p, lambda x: pow(x, {a})))")
_ENTROPY_MET = f"({_SPREAD} >= {MIX_ENTROPY} * ln(len(p)) - 1e-9)"
_LIMIT_MET = f"(pow(list_max(p) / list_min(p), 1 - {{a}}) <= {MIX_LIMIT} + 1e-9)"

SQL["op7_mixing"] = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n_tokens,
         CAST('0x' || substr(md5('1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS place
  FROM documents
), totals AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS total FROM sized GROUP BY source HAVING sum(n_tokens) > 0
), shares AS (
  SELECT list(total / everything ORDER BY total) AS p, max(total) AS most
  FROM (SELECT total, sum(total) OVER () AS everything FROM totals)
), bisect AS (
  SELECT 0 AS i, 0::DOUBLE AS elo, 1::DOUBLE AS ehi, 0::DOUBLE AS rlo, 1::DOUBLE AS rhi
  UNION ALL
  SELECT i + 1,
         CASE WHEN {_ENTROPY_MET.format(a="((elo + ehi) / 2)")} THEN (elo + ehi) / 2 ELSE elo END,
         CASE WHEN {_ENTROPY_MET.format(a="((elo + ehi) / 2)")} THEN ehi ELSE (elo + ehi) / 2 END,
         CASE WHEN {_LIMIT_MET.format(a="((rlo + rhi) / 2)")} THEN rlo ELSE (rlo + rhi) / 2 END,
         CASE WHEN {_LIMIT_MET.format(a="((rlo + rhi) / 2)")} THEN (rlo + rhi) / 2 ELSE rhi END
  FROM bisect, shares WHERE i < 60
), chosen AS (
  SELECT greatest(CASE WHEN {_ENTROPY_MET.format(a="1")} THEN 1 ELSE elo END,
                  CASE WHEN {_LIMIT_MET.format(a="0")} THEN 0 ELSE rhi END) AS a, most
  FROM bisect, shares WHERE i = 60
), passes AS (
  SELECT source, total, CAST(floor(pow(most / total, 1 - a)) AS BIGINT) AS whole,
         CAST(floor((pow(most / total, 1 - a) - floor(pow(most / total, 1 - a))) * total) AS BIGINT) AS rest
  FROM totals, chosen
), plan AS (
  SELECT *, CAST('0x' || substr(md5('1|' || coalesce(source, '') || '|' || whole || '|factor'), 1, 8) AS BIGINT) % 2048 * 2 + 1 AS factor,
         CAST('0x' || substr(md5('1|' || coalesce(source, '') || '|' || whole || '|shift'), 1, 8) AS BIGINT) % 4096 AS shift
  FROM passes
), ranked AS (
  SELECT s.doc_id, s.source, s.n_tokens, s.place // 4096 AS inside, p.whole, p.rest,
         (s.place % 4096 * p.factor + p.shift) % 4096 AS rank
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source WHERE s.n_tokens > 0
), drawn AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY rank, inside, doc_id
                                RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest AS extra
  FROM ranked
), copies AS (
  SELECT doc_id, source, n_tokens, whole + CAST(extra AS INTEGER) AS copies FROM drawn
  UNION ALL SELECT doc_id, source, n_tokens, 1 FROM sized WHERE n_tokens = 0
)
SELECT doc_id, source, CAST(unnest(range(copies)) AS INTEGER) AS mix_pass, n_tokens FROM copies
"""


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), words=2, percent=80)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    hit = fold_of(F.col("doc_id"), 2) == 0  # those rows lose their line feeds
    fields = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in manifest.FIELDS]
    made = manifest.manifest(docs, carry={"tampered": F.when(hit, manifest.leaf_of(fields))})
    root = manifest.folded(F.coalesce("carried.tampered", "leaf"), F.col("proof"))
    return made.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"),
        root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


# unsigned CRC-32 of a text's UTF-8 bytes; ``tab`` is the table of all bytes
_CRC_TABLE = ("SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: "
              "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS tab")
_CRC = ("xor(list_reduce(list_transform(range(strlen({x})), lambda i: CAST('0x' || substr(hex({x}), 2 * i + 1, 2) AS BIGINT)), "
        "lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)")


def _merkle_leaf(text: str) -> str:
    fields = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + "))"


def _merkle_up(nodes: str) -> str:
    """Digests one level up of a list of digests."""
    return (f"list_transform(range(0, len({nodes}), 3), "
            f"lambda i: sha256(array_to_string(list_slice({nodes}, i + 1, least(i + 3, len({nodes}))), '')))")


SQL["op11_merkle_manifest"] = rf"""
WITH RECURSIVE crc AS ({_CRC_TABLE}), leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS key, {_merkle_leaf("text")} AS leaf,
         CASE WHEN {_CRC.format(x="CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_merkle_leaf("replace(text, chr(10), '')")} END AS tampered
  FROM documents, crc
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, leaf) - 1 AS rank FROM leaves
), low AS (
  SELECT key, 0 AS level, list(leaf ORDER BY rank) AS nodes FROM ranked GROUP BY key
  UNION ALL
  SELECT key, level + 1, {_merkle_up("nodes")} FROM low WHERE len(nodes) > 1
), sources AS (
  SELECT key, nodes[1] AS subroot, row_number() OVER (ORDER BY key) - 1 AS rank FROM low WHERE len(nodes) = 1
), high AS (
  SELECT 0 AS level, list(subroot ORDER BY rank) AS nodes FROM sources
  UNION ALL
  SELECT level + 1, {_merkle_up("nodes")} FROM high WHERE len(nodes) > 1
), steps AS (
  SELECT r.key, r.rank, r.doc_id, 0 AS tree, level, nodes, r.rank // CAST(pow(3, level) AS BIGINT) AS place
  FROM ranked r JOIN low USING (key) WHERE len(nodes) > 1
  UNION ALL
  SELECT r.key, r.rank, r.doc_id, 1, level, nodes, s.rank // CAST(pow(3, level) AS BIGINT)
  FROM ranked r JOIN sources s USING (key), high WHERE len(nodes) > 1
), proofs AS (
  SELECT key, rank,
         list(array_to_string(list_slice(nodes, place // 3 * 3 + 1, place), '') || '|'
              || array_to_string(list_slice(nodes, place + 2, least(place // 3 * 3 + 3, len(nodes))), '') ORDER BY tree, level) AS proof
  FROM steps GROUP BY key, rank
), found AS (
  SELECT r.doc_id, r.leaf, s.subroot, (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS root,
         coalesce(p.proof, []) AS proof, coalesce(r.tampered, r.leaf) AS given
  FROM ranked r JOIN sources s USING (key) LEFT JOIN proofs p ON r.key = p.key AND r.rank = p.rank
), folded AS (
  SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(proof, ''), '|', '')) AS proof_sha256,
         list_reduce(proof, lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2)), given) AS folded_root
  FROM found
)
SELECT *, folded_root = root AS verified FROM folded
"""


IMPORTANCE_PERCENT = 10


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.ranked(docs, read(spark, sf_dir, "benchmark"), percent=IMPORTANCE_PERCENT)


SQL["op12_importance_resampling"] = rf"""
WITH crc AS ({_CRC_TABLE}), spread AS (
  SELECT doc_id, 1 AS mine, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT NULL, 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), counted AS (
  SELECT doc_id, mine, word, count(*) AS n FROM spread GROUP BY ALL
), vocabulary AS (
  SELECT word, {_CRC.format(x="word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM counted), crc
), features AS (
  SELECT doc_id, mine, bucket, n FROM counted JOIN vocabulary USING (word)
), totals AS (
  SELECT coalesce(sum(n) FILTER (WHERE mine = 1), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE mine = 0), 0)::DOUBLE AS t FROM features
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(sum(n) FILTER (WHERE mine = 0), 0) + 1) * (any_value(s) + 10000)
                                      / ((coalesce(sum(n) FILTER (WHERE mine = 1), 0) + 1) * (any_value(t) + 10000)))) AS BIGINT) AS gain
  FROM features, totals GROUP BY bucket
), weights AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight
  FROM features JOIN gains USING (bucket) WHERE mine = 1 GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{importance.SEED}:' || d.doc_id), 1, 8) AS BIGINT) + 0.5)::DOUBLE
                                                         / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights w ON d.doc_id = w.doc_id
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= {importance.LEAST_WORDS}
  QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= {IMPORTANCE_PERCENT} * count(*) OVER () // 100
)
SELECT s.doc_id, n_features, weight, score, rank FROM scored s LEFT JOIN drawn d ON s.doc_id = d.doc_id
"""


@query
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity",
        "lowest", "highest")
