"""The pipeline stage by stage, on planted cases and on odd rows."""

import random

import pytest

import corpus_pipeline
from bomweave.llm import bpe, near
from bomweave.llm.queries import tokenizer_path

KIND = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["w%d" % i for i in range(3000)]


def prose(rng, n=60):
    return " ".join(rng.choices(WORDS, k=n))


def planted():
    """(documents, labels, planted toxic ids, ids of one near-duplicate group)."""
    rng = random.Random(8)
    docs, labels, toxic = [], [], set()
    for i in range(300):
        text = prose(rng)
        if i % 6 == 0:
            text += " you grumbo " + rng.choice(["snarf", "snarfed", "snarfing"])
            toxic.add(i)
        if i % 2 == 0:
            labels.append((i, int(i in toxic)))
        docs.append((i, text + "\nAll rights of this shared footer reserved", "en", f"src{i % 3 if i % 4 else 0}", len(text)))
    base = prose(rng, 200).split()
    group = []
    for i in range(1000, 1012):
        words = list(base)
        words[rng.randrange(200)] = "changed"
        docs.append((i, " ".join(words), "en", "src1", 1))
        group.append(i)
    odd = [(2000, None, None, None, None), (2001, "", "en", "src0", 0), (2002, "long " * 60_000, "en", "src2", 1),
           (None, None, None, None, None), (None, "no id but text", "en", "src1", 3), docs[1], docs[1]]
    return docs + odd, labels, toxic, group


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs, labels, toxic, group = planted()
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(docs, KIND).repartition(3).write.parquet(f"{folder}/documents.parquet")
    frames, current = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, folder).write.parquet(f"{folder}/{k}.parquet")
        current = spark.read.parquet(f"{folder}/{k}.parquet")
        frames.append(current.collect())
    return folder, docs, toxic, group, frames


def test_columns(stages):
    _, docs, _, _, frames = stages
    assert all(list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"] for rows in frames[:-1])


def test_toxic_documents_go_and_clean_ones_stay(stages):
    _, docs, toxic, _, frames = stages
    left = [r["doc_id"] for r in frames[0]]
    assert sorted(left, key=repr) == sorted((d[0] for d in docs if d[0] not in toxic), key=repr)


def test_lines_stay_in_their_first_document(stages):
    _, _, _, _, frames = stages
    holders = {r["doc_id"] for r in frames[1] if "shared footer" in (r["text"] or "")}
    assert len(frames[1]) == len(frames[0]) and holders == {min(r["doc_id"] for r in frames[0] if r["doc_id"] is not None)}
    assert all(r["n_chars"] == len(r["text"]) for r in frames[1])


def test_one_of_each_group_stays(stages):
    _, _, _, group, frames = stages
    left = {r["doc_id"] for r in frames[2]}
    before = {r["doc_id"] for r in frames[1]}
    assert left & set(group) == {min(group)} and before - left == set(group) - {min(group)}


def test_mixture_keeps_every_document(stages):
    _, _, _, _, frames = stages
    count = {}
    for r in frames[3]:
        count[r["doc_id"], r["text"]] = count.get((r["doc_id"], r["text"]), 0) + 1
    assert {(r["doc_id"], r["text"]) for r in frames[2]} == set(count)
    single = [n for k, n in count.items() if k[0] != 1]
    assert max(single) == 2 and min(single) == 1


def test_encoding(stages):
    _, _, _, _, frames = stages
    coder = bpe.load(open(tokenizer_path("word_bpe_49k.json"), "rb").read())
    want = sorted(((r["doc_id"], coder.encode([r["text"] or ""])[0][0].as_py()) for r in frames[3]), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in frames[4]), key=repr) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in frames[4])


def test_run_equals_the_stages(spark, stages):
    folder, _, _, _, frames = stages
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, frames[-1]))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_shingles_of_five_words():
    sets = near.shingle_sets([b"a b c d e f", b"A b  c d\ne f", b"a b"], 5)
    assert len(sets[0]) == 2 and (sets[0] == sets[1]).all() and len(sets[2]) == 1
