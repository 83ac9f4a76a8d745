"""Held-out accuracy and edge cases of language identification."""

import random

from pyspark.sql import functions as F

from bomweave.llm import language

SOUNDS = {
    "en": ["the", "ing", "th", "ou", "wh", "sh", "ed", "and"], "de": ["sch", "ung", "ein", "ich", "ver", "au", "ß", "der"],
    "fr": ["eau", "oi", "ç", "que", "les", "ê", "tion", "ou"], "es": ["ción", "ñ", "ll", "que", "os", "ez", "ue", "la"],
    "xx": ["kw", "qa", "zu", "aa", "xo", "mb", "nd", "ng"],
}


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = list(SOUNDS)[i % len(SOUNDS)]
        words = ["".join(rng.choices(SOUNDS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(6, 40))]
        rows.append((i, " ".join(words), lang, "clash"))
    return rows


def test_held_out(spark):
    docs = spark.createDataFrame(corpus(600), "doc_id long, text string, lang string, lang_pred string")
    model = language.fit(docs, learn=F.col("doc_id") % 7 != 2)
    assert model.languages.keys() == {"germanic", "romance", "xx"}
    got = [r for r in language.identify(docs, model).collect() if r["doc_id"] % 7 == 2]
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["lang_score"] <= 1 for r in got)


def test_edges(spark):
    docs = spark.createDataFrame(corpus(100) + [
        (1000, None, "en", ""), (1001, "", "de", ""), (1002, "123 !? \n", "fr", ""), (None, "the thing", "en", ""),
        (1003, "the thing", None, ""), (1004, "thing " * 100_000, "en", ""), (1004, "thing " * 100_000, "en", "")],
        "doc_id long, text string, lang string, lang_pred string")
    rows = language.identify(docs, language.fit(docs)).collect()
    assert len(rows) == 107
    assert [(r["lang_pred"], r["lang_score"]) for r in rows[100:103]] == [("und", 0.0)] * 3
    assert [r["lang_pred"] for r in rows[103:]] == ["en"] * 4


def test_one_and_no_language(spark):
    docs = spark.createDataFrame([(1, "abc", "en"), (2, "abd", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(docs, language.fit(docs)).collect()} == {"en"}
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(docs, language.fit(none)).collect()} == {"und"}
    assert language.identify(docs.limit(0), language.fit(docs.limit(0))).collect() == []


def test_sample_bound(spark):
    docs = spark.createDataFrame(corpus(500), "doc_id long, text string, lang string, lang_pred string")
    model = language.fit(docs, rows_per_language=20)
    rows = language.identify(docs, model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.9 * len(rows)
