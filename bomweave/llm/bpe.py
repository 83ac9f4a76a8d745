"""BPE encoding and decoding with a contiguous rank array per word.

A word is an array of part ids and an array of the ranks of adjacent pairs. The
minimum rank is found by scanning, its boundary is deleted, and the two
neighbouring ranks are refreshed. All new short words of a slice of text go through
these steps together, as rows of two matrices. Scanning is quadratic in the word, so words
over ``SHORT_WORD`` symbols keep their ranks in a heap and give the same parts.

A slice's runs between white space are encoded once each; the ids of its texts are
gathered from them, and decoded by taking the ids' entries and joining them.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast, by_slices, session_for_texts, texts_of, unused

SHORT_WORD = 96
WIDTHS = (6, 10, 16, 32, SHORT_WORD)  # words of about the same size share a matrix
CACHED_CHUNKS = 200_000
ID_BITS = 20  # a pair is two ids in one int, a merge its rank and the merged id
ID_MASK = (1 << ID_BITS) - 1
NO_MERGE = 1 << 62
_loaded: dict[str, "WordBpe"] = {}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies:
    itself where printable, else the next letter from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, following = [], 0x100
    for byte in range(256):
        letters.append(chr(byte if byte in shown else following))
        following += byte not in shown
    return letters


class WordBpe:
    """Encoder and decoder of one vocabulary file of the ``word_bpe`` kind: NFC,
    white space to blanks, lower case, pattern split, bytes, merges with word ends."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if self._id(left) is not None and self._id(right) is not None:
                self.merges[self.vocab[left] << ID_BITS | self.vocab[right]] = rank << ID_BITS | self.vocab[left + right]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.marks = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.letters = byte_letters()
        self.blanks = regex.compile(r"\s+")
        # str.split() also cuts at these, the vocabulary's white space does not
        self.separators = regex.compile(r"[\x1c-\x1f]")
        # ids of runs without white space as bytes; special tokens have a blank in front
        self.fixed = {" " + t: np.array([i], np.int32).tobytes() for t, i in self.special.items()}
        self.chunks = dict(self.fixed)
        self.inner = [self._id(x) for x in self.letters]
        self.last = [self._id(x + self.end) for x in self.letters]
        self.whole = None not in self.inner and None not in self.last
        self.pairs = np.array(sorted(self.merges), np.int64)
        self.merged = np.array([self.merges[p] for p in self.pairs.tolist()], np.int64)
        self.entries = pa.array([self.names.get(i, "").encode() for i in range(max(self.names) + 1)], pa.binary())

    def _id(self, symbol: str) -> int | None:
        return self.vocab.get(symbol)

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        symbols = word.encode()
        parts = [self.inner[b] for b in symbols[:-1]]
        parts.append(self.last[symbols[-1]])
        if None in parts:
            parts = [p for p in parts if p is not None]
        return self._scan(parts) if len(parts) <= SHORT_WORD else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        known = self.merges.get
        found = [known(a << ID_BITS | b, NO_MERGE) for a, b in zip(parts, parts[1:])]
        while found and (best := min(found)) != NO_MERGE:
            at = found.index(best)
            parts[at] = merged = best & ID_MASK
            del parts[at + 1], found[at]
            if at < len(found):
                found[at] = known(merged << ID_BITS | parts[at + 1], NO_MERGE)
            if at:
                found[at - 1] = known(parts[at - 1] << ID_BITS | merged, NO_MERGE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        known, n = self.merges.get, len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        pairs = (a << ID_BITS | b for a, b in zip(parts, parts[1:]))
        queue = [(known(pair), i, pair) for i, pair in enumerate(pairs) if pair in self.merges]
        heapq.heapify(queue)
        while queue:
            merge, i, pair = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j >= n or parts[i] << ID_BITS | parts[j] != pair:
                continue
            parts[i], alive[j] = merge & ID_MASK, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (merge := known(parts[a] << ID_BITS | parts[b])) is not None:
                    heapq.heappush(queue, (merge, a, parts[a] << ID_BITS | parts[b]))
        return [p for p, kept in zip(parts, alive) if kept]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merges of pairs of parts, ``NO_MERGE`` where there is none."""
        pair = left << ID_BITS | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.merged[at], NO_MERGE)

    def _together(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at most ``width`` bytes one after the other, and how many each has."""
        size = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)
        parts, every = np.array(self.inner, np.int64)[data], np.arange(len(words))
        parts[every, size - 1] = np.array(self.last, np.int64)[data[every, size - 1]]
        column = np.arange(width)
        ranks = np.full((len(words), width), NO_MERGE, np.int64)
        ranks[:, :-1] = np.where(column[None, 1:] < size[:, None], self._ranks(parts[:, :-1], parts[:, 1:]), NO_MERGE)
        left = every
        while len(left):
            at = ranks[left].argmin(1)
            best = ranks[left, at]
            more = best != NO_MERGE
            left, at, best = left[more], at[more], best[more]
            # delete the boundary: what lies behind it moves up by one
            behind, p, r = column[None, :-1] > at[:, None], parts[left], ranks[left]
            p[:, :-1] = np.where(behind, p[:, 1:], p[:, :-1])
            r[:, :-1] = np.where(behind | (column[None, :-1] == at[:, None]), r[:, 1:], r[:, :-1])
            r[:, -1] = NO_MERGE
            size[left] -= 1
            here = np.arange(len(left))
            p[here, at] = best & ID_MASK
            some = np.flatnonzero(at + 1 < size[left])
            r[some, at[some]] = self._ranks(p[some, at[some]], p[some, at[some] + 1])
            some = np.flatnonzero(at > 0)
            r[some, at[some] - 1] = self._ranks(p[some, at[some] - 1], p[some, at[some]])
            parts[left], ranks[left] = p, r
        return parts[column[None, :] < size[:, None]].astype(np.int32), size

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens, as bytes."""
        symbols = [w.encode() for w in words]
        found: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in symbols], np.int64)
        group = np.searchsorted(WIDTHS, size) if self.whole else np.full(len(words), len(WIDTHS))
        for k in np.unique(group):
            chosen = np.flatnonzero(group == k).tolist()
            if k == len(WIDTHS):
                for i in chosen:
                    found[i] = np.array(self.word(words[i]), np.int32).tobytes()
                continue
            ids, counts = self._together([symbols[i] for i in chosen], WIDTHS[k])
            data, ends = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
            for i, start, end in zip(chosen, [0, *ends], ends):
                found[i] = data[start:end]
        return found

    def runs(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct runs without white space, as bytes."""
        known = self.chunks
        found = [known.get(c) for c in chunks]
        new = [i for i, ids in enumerate(found) if ids is None]
        split = [[c] if c.isascii() and c.isalpha() else self.pattern.findall(c) for c in (chunks[i] for i in new)]
        place: dict[str, int] = {}
        places = [[place.setdefault(w, len(place)) for w in words] for words in split]
        ids = self.words(list(place))
        for i, words in zip(new, places):
            found[i] = ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words])
        if len(known) + len(new) > CACHED_CHUNKS:  # the older half goes
            self.chunks = known = self.fixed | dict(list(known.items())[len(known) // 2:])
        room = CACHED_CHUNKS - len(known)
        known.update((chunks[i], found[i]) for i in new[:max(0, room)] if len(chunks[i]) <= SHORT_WORD)
        return found

    def _chunks(self, text: str) -> list[str]:
        """Runs without white space in normal form, without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # final sigma is lowered like any other
        text = text.lower()
        if self.separators.search(text):
            return [c for c in self.blanks.sub(" ", text).split(" ") if c]
        return text.split()

    def pieces(self, text: str) -> list[str]:
        """Runs of a text. Special tokens are recognised in the raw text."""
        if "<" not in text and not any(m[0] != "<" for m in self.special):
            return self._chunks(text)
        found, start = [], 0
        for mark in self.marks.finditer(text):
            found += self._chunks(text[start:mark.start()])
            found.append(" " + mark[0])
            start = mark.end()
        return found + self._chunks(text[start:])

    def encode(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """Ids and decoded texts of some texts."""
        place: dict[str, int] = {}
        numbers: list[int] = []
        ends = [0]
        for text in texts:
            numbers += [place.setdefault(c, len(place)) for c in self.pieces(text)]
            ends.append(len(numbers))
        found = self.runs(list(place))
        flat, size = np.frombuffer(b"".join(found), np.int32), np.array([len(ids) // 4 for ids in found], np.int64)
        number = np.array(numbers, np.int64)
        counts = size[number] if len(number) else number
        begin = (np.cumsum(size) - size)[number] if len(number) else number
        until = np.cumsum(counts)
        ids = flat[np.arange(int(counts.sum())) + np.repeat(begin - until + counts, counts)]
        offsets = pa.array(np.concatenate([[0], until])[ends], pa.int32())
        rows = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
        return rows, self.decode(rows)

    def decode(self, rows: pa.ListArray) -> pa.Array:
        """The vocabulary has no decoder: its entries are joined by blanks."""
        entries = self.entries.take(rows.values)
        return pc.binary_join(pa.ListArray.from_arrays(rows.offsets, entries), b" ").cast(pa.string())


def load(content: bytes) -> WordBpe:
    """The vocabulary, parsed once per Python worker."""
    key = str(hash(content))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(content)
    return _loaded[key]


def encode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int) and ``decoded`` (string, the ids decoded again).

    ``tokenizer`` is the path of the vocabulary file on the driver; its content
    (a few MB, whatever the data) is broadcast. A null text counts as empty and
    gives no ids and an empty text. All other columns and all rows stay, repeated
    ones included; columns called ``ids`` or ``decoded`` are replaced.
    """
    content = broadcast(session_for_texts(docs), Path(tokenizer).read_bytes())
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(content.value)

        def part(values: pa.Array) -> pa.Array:
            return pa.StructArray.from_arrays(list(bpe.encode(texts_of(values))), fields=list(kind))

        for texts in batches:
            yield by_slices(texts, part)
        pa.default_memory_pool().release_unused()  # the worker lives on for other tasks

    (e,) = unused(docs, "_encoded")
    result = docs.withColumn(e, encoded(F.col(text)))
    return result.withColumns({"ids": F.col(e)["ids"], "decoded": F.col(e)["decoded"]}).drop(e)
