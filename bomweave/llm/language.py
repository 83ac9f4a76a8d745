"""Language identification by hierarchical discrimination.

The language family is predicted first, by one linear support vector machine per
family. Inside the family, one linear machine per pair of languages votes. Features
are hashed letter n-grams of the whole text, as square roots of shares.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast, by_slices, session_for_texts, unused

UNKNOWN = "und"
TRAINING_ROWS = 500  # per language
FEATURES = 1 << 13
STEPS = 120
REGULAR = 1e-4

# fixed values: language codes by family; other codes are families of their own
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tk", "tr", "ug", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "semitic": ("am", "ar", "he", "mt"),
    "celtic": ("br", "cy", "ga", "gd"),
    "austronesian": ("id", "jv", "mg", "ms", "su", "tl"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def features_of(text: str | None) -> np.ndarray | None:
    """Unit vector of a text, None without letters. Words are runs of letters in
    lower case with a blank at either end."""
    points = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le"), np.uint32)
    letter = letter_table()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, 32).astype(np.uint32)
    one, two, three = points[letter], points[:-1] * np.uint32(0x9E3779B1), points[2:]
    pair = two + points[1:] * np.uint32(0x85EBCA77)
    triple = pair[:-1] * np.uint32(0xC2B2AE3D) + three
    codes = np.concatenate([
        one * np.uint32(0x27D4EB2F),
        pair[letter[:-1] | letter[1:]],
        triple[letter[1:-1] & (letter[:-2] | letter[2:])],
    ])
    codes ^= codes >> np.uint32(15)
    codes *= np.uint32(0x2C1B3C6D)
    counts = np.bincount(codes >> np.uint32(19), minlength=FEATURES)
    return np.sqrt(counts / len(codes)).astype(np.float32)


@dataclass(frozen=True)
class Machine:
    """Linear decision; positive for ``yes``."""

    weights: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> float:
        return float(x @ self.weights) + self.bias


def fit_machine(x: np.ndarray, positive: np.ndarray) -> Machine:
    """Averaged subgradient descent on the squared hinge loss, classes balanced."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    speed, bias_speed = np.zeros_like(w), 0.0
    for step in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ w + b)) * y * share
        speed = 0.9 * speed + slack @ x - REGULAR * w
        bias_speed = 0.9 * bias_speed + float(slack.sum())
        w = w + speed
        b += bias_speed
    return Machine(w, b)


@dataclass(frozen=True)
class LanguageModel:
    """Machines per family and per pair of languages of a family."""

    languages: dict[str, list[str]]
    families: dict[str, Machine] = field(default_factory=dict)
    pairs: dict[tuple[str, str], Machine] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features_of(text)
        if x is None or not self.languages:
            return UNKNOWN, 0.0
        names = sorted(self.languages)
        sure = 1.0
        best = names[0]
        if len(names) > 1:
            margins = np.array([self.families[f].margin(x) for f in names])
            best = names[int(margins.argmax())]
            odds = np.exp(2 * np.clip(margins - margins.max(), -30, 0))
            sure = float(odds.max() / odds.sum())
        return self._inside(best, x, sure)

    def _inside(self, family: str, x: np.ndarray, sure: float) -> tuple[str, float]:
        langs = self.languages[family]
        votes = dict.fromkeys(langs, 0)
        total = dict.fromkeys(langs, 0.0)
        for pair in combinations(langs, 2):
            margin = self.pairs[pair].margin(x)
            votes[pair[margin < 0]] += 1
            total[pair[0]] += margin
            total[pair[1]] -= margin
        best = max(langs, key=lambda lang: (votes[lang], total[lang], lang))
        if len(langs) > 1:
            rival = max((lang for lang in langs if lang != best), key=lambda lang: (votes[lang], total[lang], lang))
            pair = (min(best, rival), max(best, rival))
            margin = self.pairs[pair].margin(x) * (1 if pair[0] == best else -1)
            sure *= 1 / (1 + float(np.exp(-2 * np.clip(margin, -30, 30))))
        return best, sure


def fit(docs: DataFrame, learn: Column | None = None, id: str = "doc_id", text: str = "text", lang: str = "lang",
        rows_per_language: int = TRAINING_ROWS, families: dict[str, str] | None = None) -> LanguageModel:
    """Learn from rows with a language, a letter and an id.

    ``rows_per_language`` bounds the sample: the hash of the id admits about that
    many rows of each language. ``learn`` restricts the rows. Languages without a
    usable row in the sample are not learned; with none, everything is ``und``.
    """
    families = FAMILY_OF if families is None else families
    rows = docs.filter(F.col(id).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    if learn is not None:
        rows = rows.filter(learn)
    rows = rows.select(F.col(id).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    counts = {r["_lang"]: r["count"] for r in rows.groupBy("_lang").count().collect()}  # one row per language
    if not counts:
        return LanguageModel({})
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, rows_per_language / n))])
    sample = rows.filter(
        F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.element_at(share, F.col("_lang")) * F.lit(float(1 << 30)))

    @F.arrow_udf("binary")
    def featurised(texts: pa.Array) -> pa.Array:
        def packed(value):
            x = features_of(value)
            return None if x is None else zlib.compress(x.tobytes(), 1)

        return by_slices(texts, lambda part: pa.array([packed(t) for t in part.to_pylist()], pa.binary()))

    table = sample.select("_lang", "_id", featurised("_text").alias("x")).filter("x IS NOT NULL").toArrow()
    names = np.array(table.column("_lang").to_pylist())
    x = np.stack([np.frombuffer(zlib.decompress(v), np.float32) for v in table.column("x").to_pylist()]) if len(
        names) else np.zeros((0, FEATURES), np.float32)
    order = np.lexsort((np.array(table.column("_id").to_pylist()), names))
    names, x = names[order], x[order]
    languages: dict[str, list[str]] = {}
    for name in np.unique(names):
        languages.setdefault(families.get(str(name), str(name)), []).append(str(name))
    of = np.array([families.get(n, n) for n in names.tolist()])
    return LanguageModel(
        languages,
        {f: fit_machine(x, of == f) for f in languages} if len(languages) > 1 else {},
        {pair: fit_machine(x[at := np.isin(names, pair)], names[at] == pair[0])
         for langs in languages.values() for pair in combinations(langs, 2)})


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``lang_score`` (0 to 1) of every whole text: ``und`` and 0
    for a null text or one without a letter. All rows and other columns stay; columns
    with these names are replaced."""
    shared = broadcast(session_for_texts(docs), model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        def part(values: pa.Array) -> pa.Array:
            rows = [shared.value.predict(t) for t in values.to_pylist()]
            return pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())],
                names=["lang", "score"])

        return by_slices(texts, part)

    (found,) = unused(docs, "_language")
    return docs.withColumn(found, predicted(F.col(text))).withColumns(
        {"lang_pred": F.col(found)["lang"], "lang_score": F.col(found)["score"]}).drop(found)
