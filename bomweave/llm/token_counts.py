"""Greedy word-piece counts in one pass over each word.

The vocabulary is a byte trie. A node's *failure link* leads to the node reached
after its longest matching pieces have been taken off, and its *popped count* is the
number of these pieces. A word is then counted by walking the trie once: on a
missing edge, add the popped count and follow the failure link. No piece is built.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import broadcast, by_slices, session_for_texts, unused

CACHED_WORDS = 200_000
CACHED_BYTES = 64
WORDS = regex.compile(rb"[^\x20\x09-\x0D]+")
_loaded: dict[int, "PieceCounter"] = {}


class PieceCounter:
    """Counts greedy longest-match pieces. ``first`` holds the pieces that may
    start a word, ``rest`` those that may continue it."""

    def __init__(self, first: list[bytes], rest: list[bytes]):
        self.edges: list[dict[int, int]] = [{}, {}]  # node 0 starts words, node 1 continues them
        final = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for byte in piece:
                    follow = self.edges[node].get(byte)
                    if follow is None:
                        follow = self.edges[node][byte] = len(self.edges)
                        self.edges.append({})
                        final.append(False)
                    node = follow
                final[node] |= bool(piece)
        n = len(self.edges)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for byte, child in self.edges[node].items():
                queue.append(child)
                if final[child]:
                    self.fail[child], self.popped[child] = 1, 1
                    continue
                link, count = self.fail[node], self.popped[node]
                while link >= 0 and byte not in self.edges[link]:
                    count += self.popped[link]
                    link = self.fail[link]
                if link >= 0:
                    self.fail[child], self.popped[child] = self.edges[link][byte], count
        self.counts: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        """Pieces of a word; 1 if some part of it matches no piece."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node, count = 0, 0
        for byte in word:
            while (follow := edges[node].get(byte)) is None:
                count += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = follow
        while node != 1:  # nothing is left of the word once all is popped
            count += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return count

    def text(self, text: bytes) -> tuple[int, int]:
        """Numbers of words and of pieces."""
        words = WORDS.findall(text)
        known = self.counts
        total = 0
        for word in words:
            count = known.get(word)
            if count is None:
                count = self.word(word)
                if len(word) <= CACHED_BYTES:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    known[word] = count
            total += count
        return len(words), total


def pieces_of(content: bytes) -> tuple[list[bytes], list[bytes]]:
    """Word pieces of a byte-level vocabulary file: entries that begin with the
    blank's letter start a word (without that letter), the others continue it.
    A word may also start with any single byte."""
    spec = json.loads(content)
    bytes_of = {letter: bytes([i]) for i, letter in enumerate(byte_letters())}
    special = {t["content"] for t in spec["added_tokens"]}
    entries = [b"".join(bytes_of[c] for c in t) for t in spec["model"]["vocab"] if t not in special]
    single = [bytes([i]) for i in range(256)]
    return [e[1:] for e in entries if e[:1] == b" " and len(e) > 1] + single, [e for e in entries if e] + single


def load(content: bytes) -> PieceCounter:
    key = hash(content)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceCounter(*pieces_of(content))
    return _loaded[key]


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Add ``n_words`` and ``n_tokens`` (long): words are runs without ASCII white
    space, tokens their greedy longest-match pieces.

    ``vocabulary`` is the path of a byte-level vocabulary file on the driver; its
    content is broadcast. Null and empty texts have 0 of both. All other columns
    and all rows stay; columns called ``n_words`` or ``n_tokens`` are replaced.
    Work is linear in the text, also inside very long words.
    """
    content = broadcast(session_for_texts(docs), Path(vocabulary).read_bytes())

    @F.arrow_udf("struct<n_words:bigint,n_tokens:bigint>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = load(content.value)

        def part(values: pa.Array) -> pa.Array:
            rows = [counter.text(t or b"") for t in values.cast(pa.binary()).to_pylist()]
            return pa.StructArray.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["n_words", "n_tokens"])

        for texts in batches:
            yield by_slices(texts, part)
        counter.counts.clear()  # the worker lives on for other tasks
        pa.default_memory_pool().release_unused()

    (c,) = unused(docs, "_counted")
    result = docs.withColumn(c, counted(F.col(text)))
    return result.withColumns(
        {"n_words": F.col(c)["n_words"], "n_tokens": F.col(c)["n_tokens"]}).drop(c)
