"""Extra columns with the names of helpers stay as they are."""

import pytest
from pyspark.sql import functions as F

from bomweave.llm import bpe, language, lines, mixing, near, repeats, token_counts, toxicity
from bomweave.llm.queries import tokenizer_path

HELPERS = ["_encoded", "_counted", "_language", "_Doc", "_dropped", "_left", "_cut", "_parts", "k1", "k2", "_k1", "_k2", "_n1", "_r1",
           "_source", "_id", "_tokens", "_place", "_copies", "_s", "_row", "_total", "_weight", "_label", "_key", "_rank", "_whole",
           "id", "label", "h", "n", "key", "doc", "first", "start", "node", "component_id", "kept", "lang"]
ROWS = [(1, "a", "the quick brown fox jumps over the lazy dog\nanother line of text"), (2, "a", None), (3, "b", ""),
        (4, "b", "the quick brown fox jumps over the lazy dog\nmore"), (5, None, "x " * 300), (5, None, "x " * 300)]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, source string, text string")
    return frame.withColumns({name: F.concat(F.lit(name + " of "), F.col("doc_id").cast("string")) for name in HELPERS})


def applied(spark, docs):
    labels = spark.createDataFrame([(1, 0, "x"), (4, 1, "y")], "doc_id long, toxic int, _label string")
    yield "encode", bpe.encode(docs, tokenizer_path("word_bpe_49k.json"))
    yield "counts", token_counts.token_counts(docs, tokenizer_path("byte_bpe_50k.json"))
    yield "language", language.identify(docs, language.LanguageModel({}))
    yield "lines", lines.line_dedup(docs)
    yield "repeats", repeats.remove_repeats(docs, window=40, anchor=16)
    yield "near", near.drop_near_duplicates(docs)
    yield "mix", mixing.mix(docs)
    yield "toxicity", toxicity.score(docs, toxicity.fit(docs, labels))


def test_helper_names(spark, docs):
    for operator, result in applied(spark, docs):
        assert set(docs.columns) <= set(result.columns), operator
        for row in result.collect():
            for name in HELPERS:
                assert row[name] == f"{name} of {row['doc_id']}", (operator, name)
