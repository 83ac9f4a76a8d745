"""BPE against the tokenizers library, piece counts against plain longest match."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bomweave.llm import bpe, token_counts
from bomweave.llm.queries import tokenizer_path

TEXTS = [
    None, "", "   ", "Hello, World's  ΣΑΣ İstanbul naïve <|endoftext|> x<|startoftext|>y",
    "a\x1cb\x85c​d　e", "\x00 é 'S don't we'LL", "12 ½ ³ Ⅷ", "x" * 5000, "ab" * 700 + "!" * 300,
    "日本語 \U0001f600\U0001f600 café", "<|endoftext|><|endoftext|>", "word " * 3000, "tie tie",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_encode_equals_library(spark, library):
    rows = [(i, t, "clash", [1]) for i, t in enumerate(TEXTS)] + [(0, TEXTS[3], None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>")
    got = bpe.encode(docs, tokenizer_path("word_bpe_49k.json")).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "decoded", "ids"}
    for row in got:
        want = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == want
        assert row["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs.limit(0), tokenizer_path("word_bpe_49k.json")).collect() == []


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("abcdeEs't 0éß\n\t̀!?-İΣ<|>中\x1c"), max_size=60))
def test_encode_property(library, text):
    word_bpe = bpe.load(open(tokenizer_path("word_bpe_49k.json"), "rb").read())
    ids, decoded = word_bpe.encode(["x", text, ""])
    want = library.encode(text, add_special_tokens=False).ids
    assert ids[1].as_py() == want and decoded[1].as_py() == library.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(word=st.text(alphabet="abcinreth", min_size=1, max_size=150))
def test_heap_equals_scan(word):
    word_bpe = bpe.load(open(tokenizer_path("word_bpe_49k.json"), "rb").read())
    parts = [word_bpe.vocab[c] for c in word]
    parts[-1] = word_bpe.vocab[word[-1] + word_bpe.end]
    want = word_bpe._scan(list(parts))
    assert word_bpe._heap(list(parts)) == want
    assert [np.frombuffer(ids, np.int32).tolist() for ids in word_bpe.words(["in", word, "there"])][1] == want


def test_eviction_changes_nothing(monkeypatch):
    word_bpe = bpe.WordBpe(open(tokenizer_path("word_bpe_49k.json"), "rb").read())
    texts = [" ".join(f"w{i}x{j}," for i in range(40)) for j in range(30)] * 2
    want = word_bpe.encode(texts)
    monkeypatch.setattr(bpe, "CACHED_CHUNKS", 50)
    small = bpe.WordBpe(open(tokenizer_path("word_bpe_49k.json"), "rb").read())
    for text, ids, decoded in zip(texts, *want):
        one = small.encode([text + " <|endoftext|>"])
        assert one[0][0].as_py() == ids.as_py() + [49407] and one[1][0].as_py() == decoded.as_py() + " <|endoftext|>"
        assert len(small.chunks) <= 50


def longest_match(first, rest, word):
    count, pieces = 0, first
    while word:
        size = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
        if not size:
            return 1
        word, count, pieces = word[size:], count + 1, rest
    return count


@settings(max_examples=400, deadline=None)
@given(
    first=st.lists(st.text("abc", min_size=1, max_size=4), max_size=8),
    rest=st.lists(st.text("abc", min_size=1, max_size=5), max_size=10),
    word=st.text("abcd", min_size=1, max_size=14),
)
def test_automaton_equals_longest_match(first, rest, word):
    first, rest = [[p.encode() for p in x] for x in (first, rest)]
    counter = token_counts.PieceCounter(first, rest)
    assert counter.word(word.encode()) == longest_match(set(first), set(rest), word.encode())


def test_token_counts(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    first, rest = map(set, token_counts.pieces_of(open(path, "rb").read()))
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(docs, path).collect()}
    for i, t, _ in rows:
        words = token_counts.WORDS.findall((t or "").encode())
        assert got[i] == (len(words), sum(longest_match(first, rest, w) for w in words[:50]) if len(words) < 50 else got[i][1])
    assert got[0] == (0, 0) and token_counts.token_counts(docs.limit(0), path).count() == 0
    long_word = hashlib.sha256(b"x").hexdigest() * 2000
    row = token_counts.token_counts(spark.createDataFrame([(1, long_word)], "doc_id long, text string"), path).first()
    assert row["n_words"] == 1 and row["n_tokens"] > 1000
