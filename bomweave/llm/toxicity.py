"""Toxicity classifier with a counterfactual penalty.

A logistic regression over the distinct words of a text and over word beginnings
(inflected insults share their stem, so it also counts how many distinct words have
it). Identity terms in labelled texts are swapped for others of their group, and the
squared change of the logit is added to the loss, so that a group's mention alone
moves no score. All features that differ significantly between the labels compete for
a place in the model; the driver holds the best of them only, and has these replaced
from all the others as long as any feature explains what is left.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise
from .common import broadcast, by_slices, session_for_texts

WORD = re.compile(r"[^\W\d_]+")
TRAINING_ROWS = 8_000
AT_ONCE = 256  # candidates the driver holds at a time; all others wait on the executors
LEAST_DOCUMENTS = 3
LEAST_GAIN = 4.0
STEMS = (3, 4, 5, 6)  # lengths of word beginnings
STEM_COUNTS = (1, 2, 4)  # at least so many distinct words with the beginning
RIDGE = 0.05
COUNTERFACTUAL = 10.0

# fixed values: terms that may replace each other in a sentence
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girl", "boy"), ("girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "transgender"),
    ("black", "white", "asian", "hispanic", "latino", "african", "european", "arab"),
    ("american", "mexican", "chinese", "indian", "russian", "french", "german", "spanish", "turkish"),
    ("old", "young"), ("elderly", "teenage"), ("blind", "deaf", "disabled"),
)


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode())


def words_of(text: str | None) -> set[str]:
    """Distinct words: runs of letters in lower case."""
    return set(WORD.findall((text or "").lower()))


def features_of(words: set[str]) -> set[int]:
    """Hashes of the words and of their beginnings, these once for each count reached."""
    found = set(map(word_hash, words))
    stems = Counter([w[:k] for w in words for k in STEMS if len(w) > k])
    for stem, n in stems.items():
        h = xxhash.xxh3_64_intdigest(stem.encode(), 1)
        found.update([h ^ level for level in STEM_COUNTS if n >= level])
    return found


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the selected features and of the identity terms, by hash."""

    bias: float
    weights: dict[int, float]

    def score(self, words) -> float:
        known = self.weights
        logit = self.bias + sum(sorted(known[h] for h in features_of(words) & known.keys()))
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


class Swaps:
    """Replaces every identity term by another one of its group."""

    def __init__(self, groups=IDENTITY_TERMS):
        self.group = {term: (group, i) for group in groups for i, term in enumerate(group)}

    def other(self, term: str, step: int) -> str:
        group, i = self.group[term]
        return group[(i + 1 + step % max(1, len(group) - 1)) % len(group)]

    def swapped(self, words: set[str], step: int) -> set[str] | None:
        """The words of the counterfactual text, None if there is no identity term."""
        terms = words & self.group.keys()
        return (words - terms) | {self.other(t, step) for t in terms} if terms else None


def _candidates(found: DataFrame, n1: float, n0: float, always: list[int], rows: np.ndarray) -> DataFrame:
    """(h, at, swapped, always): features with the numbers of the rows whose words have them,
    and of those whose swapped words do.

    These are all features whose document frequency differs between the labels by more than
    chance alone would make it with so many features, and those of ``always`` that occur. Of
    features in the very same rows, swapped ones too, one is looked up: a signature of
    the rows (xor of two hashes each) tells them apart before any row list is made.
    ``found`` has (_row, _label, _weight, words, swapped), ``rows`` its rows in the order they
    are numbered."""
    spark = found.sparkSession
    both = found.select("_row", "_label", "_weight", F.explode("words").alias("h"), F.lit(True).alias("plain")).unionByName(
        found.select("_row", "_label", "_weight", F.explode("swapped").alias("h"), F.lit(False).alias("plain")))
    marks = [F.bit_xor(F.when(F.col("plain") == plain, F.xxhash64(F.lit(seed), "_row"))).alias(f"{name}{seed}")
             for plain, name in ((True, "s"), (False, "t")) for seed in (1, 2)]
    counts = materialise(both.groupBy("h").agg(
        F.coalesce(F.sum(F.when(F.col("plain"), F.col("_weight"))), F.lit(0)).alias("both"),
        F.sum(F.when(F.col("plain"), F.col("_weight") * F.col("_label"))).alias("d1"), *marks).filter("both > 0"), "toxicity-counts")
    least = float(np.sqrt(2 * np.log(max(2, counts.count()))))
    share = F.col("both") / (n1 + n0)
    spread = F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    differs = (F.col("both") >= LEAST_DOCUMENTS) & (F.col("both") < n1 + n0)
    z = F.when(differs, F.abs(F.col("d1") / n1 - (F.col("both") - F.col("d1")) / n0) / spread)
    # identity terms stay, whatever else is in their rows
    passed = counts.withColumn("always", F.col("h").isin(always)).filter(F.col("always") | (z >= least)).groupBy(
        "s1", "s2", "t1", "t2", "always", F.when(F.col("always"), F.col("h")).alias("term")).agg(F.min("h").alias("h"))
    passed = materialise(passed.select("h", "always"), "toxicity-passed")
    sorted_rows, number = np.sort(rows), np.argsort(rows).astype(np.int32)
    shared = broadcast(spark, (sorted_rows, number))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers = shared.value
        for batch in batches:
            lists = [[np.sort(numbers[np.searchsorted(names, np.array(r, np.int64))]) for r in batch.column(c).to_pylist()]
                     for c in ("at", "swapped")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("always"), *[pa.array(r, pa.list_(pa.int32())) for r in lists]],
                names=["h", "always", "at", "swapped"])

    columns = both.join(passed, "h").groupBy("h", "always").agg(
        F.collect_list(F.when(F.col("plain"), F.col("_row"))).alias("at"),
        F.collect_list(F.when(~F.col("plain"), F.col("_row"))).alias("swapped"),
    ).select("h", "always", "at", "swapped")
    return materialise(columns.mapInArrow(numbered, "h long, always boolean, at array<int>, swapped array<int>"), "toxicity-candidates")


def _best(candidates: DataFrame, y: np.ndarray, p: np.ndarray, weight: np.ndarray, taken: set[int]) -> tuple[pa.Table, float]:
    """The ``AT_ONCE`` candidates that explain most of what the scores ``p`` leave of the
    labels, by ``LEAST_GAIN`` at least, and the gain of the first one after them."""
    shared = broadcast(candidates.sparkSession, (weight * (y - p), weight * p * (1 - p), taken))

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, spread, used = shared.value
        for batch in batches:
            gain = np.array([_gain(rest[r].sum(), spread[r].sum()) for r in (
                np.array(r, np.int64) for r in batch.column("at").to_pylist())], np.float64)
            good = [h not in used and g >= LEAST_GAIN for h, g in zip(batch.column("h").to_pylist(), gain)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("h", "at", "swapped")], pa.array(gain)], names=[
                "h", "at", "swapped", "gain"]).filter(pa.array(good, pa.bool_()))

    best = candidates.select("h", "at", "swapped").mapInArrow(
        gains, "h long, at array<int>, swapped array<int>, gain double").orderBy(F.desc("gain"), "h").limit(AT_ONCE + 1).toArrow()
    shared.destroy()
    return best.slice(0, AT_ONCE), best.column("gain")[AT_ONCE].as_py() if best.num_rows > AT_ONCE else LEAST_GAIN


def _incidence(n: int, columns: list[list[int]]) -> np.ndarray:
    """0/1 matrix of ``n`` rows with a column for each list of row numbers."""
    x = np.zeros((n, len(columns)), np.float64)
    for k, rows in enumerate(columns):
        x[rows, k] = 1
    return x


def _gain(rest, spread):
    """How far a column's residual differs from 0, in standard deviations."""
    return np.abs(rest) / np.sqrt(0.25 + spread)


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients that minimise weighted log loss + quadratic penalty, and the fitted scores."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w, 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, squares: np.ndarray, taken: int, least: float):
    """Forward selection: as long as some word explains what is left of the labels by
    ``least``, take it in. Words that merely accompany others (copies) stay out. Returns the
    columns taken, their weights and the scores; the first ``taken`` are taken from the start."""
    use = list(range(taken))
    while True:
        penalty = squares[np.ix_(use, use)] + np.diag([1e-9] + [RIDGE] * (len(use) - 1))
        w, p = _newton(x[:, use], y, weight, penalty)
        gain = _gain(x.T @ (weight * (y - p)), (x * x).T @ (weight * p * (1 - p)))
        gain[use] = 0
        best = int(gain.argmax())
        if gain[best] < least:
            return use, w, p
        use = [*use, best]


def _select(candidates: DataFrame, y: np.ndarray, weight: np.ndarray, swappable: np.ndarray, strength: float):
    """Bias, and weights by hash. The driver's candidates are replaced when none of them is
    ahead of those left out, until no candidate at all explains what is left. ``weight`` is
    how often each row occurs, ``swappable`` are the rows with an identity term."""
    n, often = len(y), np.sqrt(weight[swappable])[:, None]

    def matrices(table: pa.Table):
        x = _incidence(n, table.column("at").to_pylist())
        return x, (x - _incidence(n, table.column("swapped").to_pylist()))[swappable] * often

    start = candidates.filter("always").select("h", "at", "swapped").orderBy("h").toArrow()
    names = start.column("h").to_pylist()
    x, change = matrices(start)
    x, change = np.hstack([np.ones((n, 1)), x]), np.hstack([np.zeros((len(change), 1)), change])
    use, w, p = _fit(x, y, weight, change.T @ change * strength, x.shape[1], LEAST_GAIN)
    while True:
        best, after = _best(candidates, y, p, weight, set(names))
        more, moved = matrices(best)
        x, change, taken = np.hstack([x, more]), np.hstack([change, moved]), x.shape[1]
        use, w, p = _fit(x, y, weight, change.T @ change * strength, taken, max(LEAST_GAIN, after * (1 - 1e-9)))
        x, change = x[:, use], change[:, use]
        names += [best.column("h")[k - taken].as_py() for k in use[taken:]]
        if len(use) == taken:
            return float(w[0]), dict(zip(names, w[1:].tolist()))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id: str = "doc_id", text: str = "text",
        label: str = "toxic", max_rows: int = TRAINING_ROWS, groups=IDENTITY_TERMS,
        strength: float = COUNTERFACTUAL) -> ToxicityModel:
    """Learn from the labelled documents.

    ``max_rows`` bounds the sample: where more rows carry a label, the hash of the
    id admits about that many. Features are not bounded. ``learn`` restricts the labels (a condition on their
    columns). Rows without id or label are ignored; an id labelled more than once
    counts as toxic if any row says so. Without two classes the model is the share
    of toxic labels.
    """
    session_for_texts(docs)
    usable = labels if learn is None else labels.filter(learn)
    usable = usable.select(F.col(id).alias("id"), F.col(label).cast("double").alias("label")).dropna().groupBy("id").agg(
        F.max("label").alias("label"))
    n = usable.count()
    if n > max_rows:
        usable = usable.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    swaps = Swaps(groups)

    @F.arrow_udf("struct<words:array<bigint>,swapped:array<bigint>>")
    def featurised(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            words = words_of(t)
            other = swaps.swapped(words, xxhash.xxh3_64_intdigest((t or "").encode()) >> 1)  # copies are swapped alike
            rows.append([None if w is None else np.sort(np.array(list(features_of(w)), np.uint64)).view(np.int64)
                         for w in (words, other)])
        return pa.StructArray.from_arrays(
            [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (0, 1)], names=["words", "swapped"])

    # bounded by max_rows, so the texts stay where they are
    sample = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(usable), "id").select(
        "label", F.xxhash64("id").alias("key"), featurised(F.col("text")).alias("f"))
    # copies are one row with a weight
    found = materialise(sample.groupBy(F.col("label").alias("_label"), "f.words", "f.swapped").agg(
        F.count(F.lit(1)).cast("double").alias("_weight"), F.min("key").alias("_key")).withColumn(
        "_row", F.monotonically_increasing_id()), "toxicity-sample")
    n, positive = found.agg(F.coalesce(F.sum("_weight"), F.lit(0.0)),
                            F.coalesce(F.sum(F.col("_weight") * F.col("_label")), F.lit(0.0))).first()
    if positive in (0, n):
        rate = (positive + 0.5) / (n + 2)  # without labels nothing counts as toxic
        return ToxicityModel(float(np.log(rate / (1 - rate))), {})
    terms = [int(np.uint64(word_hash(t)).astype(np.int64)) for t in swaps.group]
    rows = found.select("_row", "_label", "_weight", F.col("swapped").isNotNull().alias("swappable"), "_key").orderBy(
        "_key", "_label", "_row").toArrow()
    candidates = _candidates(found, positive, n - positive, terms, rows.column("_row").to_numpy())
    bias, weights = _select(candidates, *[rows.column(c).to_numpy() for c in ("_label", "_weight", "swappable")], strength)
    return ToxicityModel(bias, {int(np.int64(h).view(np.uint64)): v for h, v in weights.items()})


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Add ``toxicity`` (0 to 1) of every whole text; a null or empty text gets the
    score of no words. All rows and other columns stay; a column of that name is
    replaced."""
    shared = broadcast(session_for_texts(docs), model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return by_slices(texts, lambda part: pa.array(
            [shared.value.score(words_of(t)) for t in part.to_pylist()], pa.float64()))

    return docs.withColumn("toxicity", scored(F.col(text)))
