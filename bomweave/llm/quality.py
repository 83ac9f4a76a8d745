"""Quality rules: counts of words, symbols and repeats, and n-gram perplexity.

Perplexity comes from a modified Kneser-Ney model per language over character n-grams.
Spark counts the n-grams of all documents; probabilities and back-off weights are joins of
the count tables, order by order. The finished model is stored as arrays of sorted 64-bit hashes
beside their values, searched for all distinct n-grams of a slice of text at once. The
arrays go to the tasks where their number is checked to be small; a larger model stays a
table that the n-grams of the documents are joined with, for the same result.

Each language's documents set its bands: quartiles of their cross-entropies, exact from a
histogram, and an allowance for the scatter of short texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..operators.skew import salted_join
from .common import broadcast, by_slices, session_for_texts, slices

ORDER = 5
START = "\x02"  # stands in front of every text
MODEL_ROWS = 8_000_000  # entries of a model that is handed to the tasks
PENDING = 1_000_000  # n-grams a counting task holds before it passes them on
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
FENCE = 3.0  # quartile ranges beyond the quartiles
SCATTER = 3.0  # standard deviations of a text's mean
LEAST_RANGE = 0.02
STEP = 1e-3  # of the histogram of cross-entropies
MOST_BROADCAST_LANGUAGES = 100_000
NO_WORD = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
CONTINUED = (np.arange(256) & 0xC0) == 0x80
SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
FALLBACK = (0.5, 1.0, 1.5)  # discounts of a language too small to estimate them

MEASURES = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint>"


# --- rules on counts ------------------------------------------------------------


def _mixed(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    h = (h ^ value) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _repeated_words(ids: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Words of each row inside a window of ``WINDOW`` words that the row has twice."""
    if len(ids) <= WINDOW:
        return np.zeros(rows, np.int64)
    last = len(ids) - WINDOW + 1
    key = row[:last].astype(np.uint64)
    for k in range(WINDOW):
        key = _mixed(key, ids[k:last + k])
    at = np.flatnonzero(row[:last] == row[WINDOW - 1:])
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    twice = np.concatenate([order[1:][same], order[:-1][same]])
    change = np.zeros(len(ids) + 1, np.int64)
    change[np.unique(twice)] = 1
    covered = np.convolve(change[:-1], np.ones(WINDOW, np.int64))[:len(ids)] > 0
    return np.bincount(row[covered], minlength=rows)


def _measured(texts: pa.Array) -> pa.Array:
    """The counts of a slice of binary texts."""
    texts = texts.fill_null(b"")
    known: dict[bytes, int] = {}
    ids, n_words, dup_lines = [], [], []
    values = texts.to_pylist()
    for text in values:
        words = text.split()  # of bytes: at ASCII white space
        n_words.append(len(words))
        ids.extend([known.setdefault(w, len(known)) for w in words])
        lines = [line for line in text.split(b"\n") if line.strip()] if b"\n" in text else ()
        dup_lines.append(len(lines) - len(set(lines)))
    size = np.array([len(t) for t in values], np.int64)
    data, owner = np.frombuffer(b"".join(values), np.uint8), np.repeat(np.arange(len(values)), size)
    counts = [np.bincount(owner[chosen[data]], minlength=len(values)) for chosen in (~(NO_WORD | CONTINUED), SYMBOL)]
    repeated = _repeated_words(np.array(ids, np.uint64), np.repeat(np.arange(len(values)), n_words), len(values))
    columns = [n_words, *counts, dup_lines, repeated]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def measures(text: Column) -> Column:
    """Counts of a text: words, code points in words, symbols, lines with a word that equal
    an earlier one, and words in repeated windows."""
    @F.arrow_udf(MEASURES)
    def counted(texts: pa.Array) -> pa.Array:
        return by_slices(texts.cast(pa.binary()), _measured)

    return counted(text)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])


# --- the model --------------------------------------------------------------------


def language_key(lang: Column) -> Column:
    """Never null: a missing language is one of its own."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def _hashes(codes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Hash of each row of code points, under its language's seed."""
    h = seeds + np.uint64(codes.shape[1])
    for k in range(codes.shape[1]):
        h = _mixed(h, codes[:, k].astype(np.uint64))
    return h


def _plain(text: str | None) -> str:
    """Lower case, white space as single spaces, without the two reserved characters."""
    return " ".join((text or "").replace("\0", " ").replace(START, " ").lower().split())


def _codes(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of the texts, and the text's number."""
    front = START * (order - 1)
    codes = np.frombuffer("".join([front + t for t in texts]).encode("utf-32-le"), np.uint32)
    if len(codes) < order:
        return np.zeros((0, order), np.uint32), np.zeros(0, np.int64)
    ends = np.flatnonzero(codes[order - 1:] != ord(START))
    return np.lib.stride_tricks.sliding_window_view(codes, order)[ends], np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def _grams(codes: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    width = codes.shape[1]
    return pa.array(np.ascontiguousarray(codes, np.uint32).view(f"<U{width}").ravel().tolist(), pa.string())


def _sorted_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and where each distinct one starts in it."""
    order = np.argsort(keys)
    ordered = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else [])


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, gram, c, lo, hi`` of a frame with ``lang`` (a language key) and ``text``: how often it
    occurs, and the smallest and largest signature of a text with it, equal if it is in one
    text only. Tasks add up their n-grams and pass them on when they hold ``PENDING``."""
    def added(held: list) -> tuple:
        keys, codes, langs, counts, lo, hi = (np.concatenate(x) for x in zip(*held))
        at, starts = _sorted_groups(keys)
        first = at[starts]
        return keys[first], codes[first], langs[first], np.add.reduceat(counts[at], starts), np.minimum.reduceat(
            lo[at], starts), np.maximum.reduceat(hi[at], starts)

    def rows_of(held: list) -> pa.RecordBatch:
        _, codes, langs, counts, lo, hi = added(held)
        return pa.RecordBatch.from_arrays(
            [pa.array(langs.tolist(), pa.string()), _grams(codes), pa.array(counts), pa.array(lo), pa.array(hi)],
            names=["lang", "gram", "c", "lo", "hi"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            names, start = batch.column(0).to_pylist(), 0
            for part in slices(batch.column(1)):
                langs = np.array(names[start:start + len(part)], object)
                start += len(part)
                texts = part.to_pylist()
                codes, row = _codes([_plain(t) for t in texts], order)
                if not len(row):
                    continue
                signature = np.array([xxhash.xxh3_64_intdigest((t or "").encode()) for t in texts], np.uint64).view(np.int64)
                seeds = np.array([_seed(lang) for lang in langs], np.uint64)
                held.append(added([(_hashes(codes, seeds[row]), codes, langs[row], np.ones(len(row), np.int64),
                                    signature[row], signature[row])]))
                size += len(held[-1][0])
                if size > PENDING:
                    yield rows_of(held)
                    held, size = [], 0
        if size:
            yield rows_of(held)

    return docs.select("lang", "text").mapInArrow(counted, "lang string, gram string, c long, lo long, hi long").groupBy(
        "lang", "gram").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _discounts(grams: DataFrame) -> DataFrame:
    """``lang, d1, d2, d3``: what n-grams seen once, twice and more often give away."""
    n = [F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    usable = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)

    def discount(k: int) -> Column:
        value = F.lit(float(k)) - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0))
        return F.when(usable & (value > 0) & (value < k), value).otherwise(FALLBACK[k - 1]).alias(f"d{k}")

    return grams.groupBy(F.col("lang").alias("l")).agg(*n).select("l", *[discount(k) for k in (1, 2, 3)])


@dataclass(frozen=True)
class Model:
    """``table`` has ``order, context, h, value``: logarithms of probabilities by n-gram hash
    (``context`` false) and of back-off weights by context hash, at most one row for each."""

    table: DataFrame
    order: int
    rows: int


def _small(languages: DataFrame) -> DataFrame:
    """A table with a row per language, to be broadcast where it is counted to be small: one
    language may hold most rows on the other side."""
    return F.broadcast(languages) if languages.count() <= MOST_BROADCAST_LANGUAGES else languages


def train(docs: DataFrame, order: int = ORDER, lang: str = "lang", text: str = "text") -> Model:
    """Modified Kneser-Ney model of every language in ``docs``, from all their texts.

    Below the highest order, an n-gram counts the different characters in front of it; where
    a text begins, it counts as often as it occurs. An n-gram that only one text has, copies
    taken as one, gives all it has away: a text does not vouch for itself. Languages without
    any character have no entries.
    """
    session_for_texts(docs)
    grams = materialise(gram_counts(docs.select(language_key(F.col(lang)).alias("lang"), F.col(text).alias("text")), order), "lm-grams")
    tables = {order: grams}
    for k in range(order - 1, 0, -1):
        shorter = F.substring("gram", 2, k)
        tables[k] = materialise(tables[k + 1].groupBy("lang", shorter.alias("gram")).agg(F.sum(
            F.when(shorter.startswith(START), F.col("c")).otherwise(1)).alias("c"), F.min("lo").alias("lo"),
            F.max("hi").alias("hi")), "lm-grams")

    lower = tables[1].groupBy("lang").agg((1.0 / (F.count("gram") + 1)).alias("p")).select(
        "lang", F.lit("").alias("gram"), "p")
    parts = [lower.select("lang", "gram", F.lit(0).alias("order"), F.lit(False).alias("context"), F.log("p").alias("value"))]
    for k in range(1, order + 1):
        same = Window.partitionBy("lang", "ctx")  # as many rows as characters follow the context
        gone = _small(materialise(_discounts(tables[k]), "lm-discounts"))
        below = lower.select(F.col("lang").alias("l2"), F.col("gram").alias("g2"), F.col("p").alias("q"))
        counted = tables[k].withColumns({"ctx": F.substring("gram", 1, k - 1), "rest": F.substring("gram", 2, k - 1)}).join(
            gone, F.col("lang") == F.col("l"))
        discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        given = F.when(F.col("lo") == F.col("hi"), F.col("c")).otherwise(discount)
        rows = counted.withColumn("given", given).withColumns({
            "total": F.sum("c").over(same), "left": F.sum("given").over(same) / F.sum("c").over(same)})
        rows = materialise(rows.join(below, (F.col("lang") == F.col("l2")) & (F.col("rest") == F.col("g2")), "left").select(
            "lang", "gram", "ctx", "left", F.when(F.col("lo") != F.col("hi"), (
                F.col("c") - F.col("given")) / F.col("total") + F.col("left") * F.col("q")).alias("p")), "lm-probabilities")
        lower = rows.filter("p is not null").select("lang", "gram", "p")
        parts.append(lower.select("lang", "gram", F.lit(k).alias("order"), F.lit(False).alias("context"), F.log("p").alias("value")))
        parts.append(rows.select("lang", F.col("ctx").alias("gram"), F.lit(k - 1).alias("order"), F.lit(True).alias("context"),
                                  F.log("left").alias("value")).distinct())

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, orders = batch.column("lang").to_pylist(), batch.column("order").to_numpy()
            grams_, h = batch.column("gram").to_pylist(), np.zeros(batch.num_rows, np.uint64)
            seeds = np.array([_seed(x) for x in langs], np.uint64)
            for k in np.unique(orders):
                at = np.flatnonzero(orders == k)
                codes = np.frombuffer("".join([grams_[i] for i in at]).encode("utf-32-le"), np.uint32).reshape(len(at), k)
                h[at] = _hashes(codes, seeds[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), batch.column("context"), pa.array(h.view(np.int64)), batch.column("value")],
                names=["order", "context", "h", "value"])

    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    table = materialise(whole.mapInArrow(hashed, "order int, context boolean, h long, value double"), "lm-model")
    return Model(table, order, table.count())


def _arrays(model: Model) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
    """The model as sorted hashes and their values, by order and kind."""
    rows = model.table.toArrow()
    order, context = rows.column("order").to_numpy(), rows.column("context").to_numpy()
    h, value = rows.column("h").to_numpy().view(np.uint64), rows.column("value").to_numpy()
    found = {}
    for k in range(model.order + 1):
        for kind in (False, True):
            at = np.flatnonzero((order == k) & (context == kind))
            at = at[np.argsort(h[at])]
            found[k, kind] = h[at], value[at]
    return found


def _looked_up(arrays, order: int, context: bool, keys: np.ndarray) -> np.ndarray:
    """Values of the keys, nan where there is none."""
    hashes, values = arrays[order, context]
    if len(hashes) == 0:
        return np.full(len(keys), np.nan)
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return np.where(hashes[at] == keys, values[at], np.nan)


def _log_probabilities(arrays, order: int, codes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Of the last character of each n-gram after the others; nan in an unknown language."""
    found, passed = np.full(len(codes), np.nan), np.zeros(len(codes))
    open_ = np.arange(len(codes))
    for k in range(order, -1, -1):
        part = codes[open_, order - k:]
        value = _looked_up(arrays, k, False, _hashes(part, seeds[open_]))
        found[open_] = passed[open_] + value
        miss = np.isnan(value)
        open_, part = open_[miss], part[miss]
        if k == 0 or len(open_) == 0:
            break
        passed[open_] += np.nan_to_num(_looked_up(arrays, k - 1, True, _hashes(part[:, :-1], seeds[open_])))
    return found


ENTROPY = "struct<n_chars:bigint,entropy:double,spread:double>"


def _with_entropy(rows: DataFrame, model: Model) -> DataFrame:
    """Add ``e``: characters of ``text``, mean and standard deviation of their negative log
    probabilities under the model of ``lang``."""
    shared, order = broadcast(rows.sparkSession, _arrays(model)), model.order

    @F.arrow_udf(ENTROPY)
    def scored(langs: pa.Array, texts: pa.Array) -> pa.Array:
        names, start = langs.to_pylist(), 0

        def part(values: pa.Array) -> pa.Array:
            nonlocal start
            seeds = np.array([_seed(x) for x in names[start:start + len(values)]], np.uint64)
            start += len(values)
            codes, row = _codes([_plain(t) for t in values.to_pylist()], order)
            _, first, inverse = np.unique(_hashes(codes, seeds[row]), return_index=True, return_inverse=True)
            cost = -_log_probabilities(shared.value, order, codes[first], seeds[row[first]])[inverse]
            n = np.bincount(row, minlength=len(values))
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = np.bincount(row, weights=cost, minlength=len(values)) / n
                square = np.bincount(row, weights=cost * cost, minlength=len(values)) / n
                spread = np.sqrt(np.maximum(square - mean * mean, 0))
            none = pa.array(np.isnan(mean))
            return pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(mean, mask=np.asarray(none)), pa.array(spread, mask=np.asarray(none))],
                names=["n_chars", "entropy", "spread"])

        return by_slices(texts, part)

    return rows.withColumn("e", scored(F.col("lang"), F.col("text")))


def _joined_entropy(rows: DataFrame, model: Model) -> DataFrame:
    """The same without the model in the tasks: distinct n-grams are joined with the table,
    order by order, and their values with the documents' n-grams. Documents are told apart
    by id and text; repeated rows have the same values."""
    order = model.order
    schema = "id string, sig long, lang string, gram string, h array<long>, x array<long>, c long"

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for part in slices(batch.column("text")):
                here = batch.slice(start, len(part))
                start += len(part)
                langs = here.column("lang").to_pylist()
                seeds = np.array([_seed(x) for x in langs], np.uint64)
                codes, row = _codes([_plain(t) for t in part.to_pylist()], order)
                _, first, counts = np.unique(_mixed(_hashes(codes, seeds[row]), row.astype(np.uint64)),
                                             return_index=True, return_counts=True)
                codes, row = codes[first], row[first]
                suffixes = np.stack([_hashes(codes[:, order - k:], seeds[row]) for k in range(order + 1)], 1).view(np.int64)
                contexts = np.stack([_hashes(codes[:, order - 1 - k:order - 1], seeds[row]) for k in range(order)], 1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [here.column("id").take(pa.array(row)), here.column("sig").take(pa.array(row)),
                     pa.array([langs[r] for r in row], pa.string()), _grams(codes), pa.array(list(suffixes), pa.list_(pa.int64())),
                     pa.array(list(contexts), pa.list_(pa.int64())), pa.array(counts)], names=["id", "sig", "lang", "gram", "h", "x", "c"])

    light = rows.select(F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")).alias("id"),
                        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("sig"), "lang", "text")
    found = materialise(light.mapInArrow(cells, schema), "lm-cells")
    asked = found.groupBy("lang", "gram").agg(F.first("h").alias("h"), F.first("x").alias("x"))
    asked = asked.withColumns({"value": F.lit(None).cast("double"), "passed": F.lit(0.0)})
    for k in range(order, -1, -1):
        p = model.table.filter((F.col("order") == k) & ~F.col("context")).select(F.col("h").alias("ph"), F.col("value").alias("pv"))
        g = model.table.filter((F.col("order") == k - 1) & F.col("context")).select(F.col("h").alias("gh"), F.col("value").alias("gv"))
        asked = asked.join(p, F.col("h")[k] == F.col("ph"), "left").withColumn(
            "value", F.coalesce("value", F.col("passed") + F.col("pv"))).drop("ph", "pv")
        if k:
            asked = asked.join(g, F.col("x")[k - 1] == F.col("gh"), "left").withColumn(
                "passed", F.col("passed") + F.coalesce("gv", F.lit(0.0))).drop("gh", "gv")
        asked = materialise(asked, "lm-asked")
    cost = salted_join(found.select("id", "sig", "lang", "gram", "c"), asked.select("lang", "gram", (-F.col("value")).alias("v")),
                       ["lang", "gram"], ["id", "sig"], how="inner")
    totals = cost.groupBy("id", "sig", "lang").agg(
        F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("m"),
        (F.sum(F.col("c") * F.col("v") * F.col("v")) / F.sum("c")).alias("q"))
    copies = materialise(light.groupBy("id", "sig", "lang").agg(F.count("id").alias("copies")), "lm-copies")
    totals = totals.join(copies, ["id", "sig", "lang"]).select(
        F.col("id").alias("_id"), F.col("sig").alias("_sig"), F.col("lang").alias("_lang"), F.struct(
            (F.col("n") / F.col("copies")).cast("long").alias("n_chars"), F.col("m").alias("entropy"),
            F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))).alias("spread")).alias("e"))
    named = rows.withColumns({"_id": F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")),
                              "_sig": F.coalesce(F.xxhash64("text"), F.lit(0)), "_lang": F.col("lang")})
    none = F.struct(F.lit(0).cast("long").alias("n_chars"), F.lit(None).cast("double").alias("entropy"),
                    F.lit(None).cast("double").alias("spread"))
    return named.join(totals, ["_id", "_sig", "_lang"], "left").withColumn("e", F.coalesce("e", none)).drop("_id", "_sig", "_lang")


# --- bands ------------------------------------------------------------------------


def bands(measured: DataFrame) -> DataFrame:
    """``lang, low, high, scatter`` from the ``lang`` and ``e`` of documents: ``FENCE`` quartile
    ranges beyond the quartiles, and ``SCATTER`` typical deviations of one character.

    The quartiles are exact to ``STEP``: documents are counted by cross-entropy, so a
    language is a bounded number of rows, whatever its share of the corpus.
    """
    cells = measured.filter("e.entropy is not null").groupBy(
        "lang", F.floor(F.col("e.entropy") / STEP).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("e.spread").cast("decimal(20,9)")).alias("s"))
    up = Window.partitionBy("lang").orderBy("cell")
    every = Window.partitionBy("lang")
    placed = cells.withColumns({"until": F.sum("n").over(up), "all": F.sum("n").over(every)})

    def quartile(share: float) -> Column:
        return F.min(F.when(F.col("until") >= share * F.col("all"), F.col("cell"))) * STEP

    found = placed.groupBy("lang").agg(
        quartile(0.25).alias("q1"), quartile(0.75).alias("q3"), (F.sum("s") / F.sum("n")).cast("double").alias("scatter"))
    span = FENCE * F.greatest(F.col("q3") - F.col("q1"), F.lit(LEAST_RANGE))
    return found.select("lang", (F.col("q1") - span).alias("low"), (F.col("q3") + span).alias("high"),
                        (SCATTER * F.col("scatter")).alias("scatter"))


def judged(docs: DataFrame, model: Model | None = None, id: str = "doc_id", lang: str = "lang", text: str = "text",
           model_rows: int = MODEL_ROWS) -> DataFrame:
    """One row per document: ``id``, the counts of ``measures``, ``base_failed``, ``perplexity`` (per
    character), ``lowest`` and ``highest`` (its band) and ``kept``.

    A document fails the base rules with fewer than ``LEAST_WORDS`` words, or more than
    ``MOST_REPEATED`` percent of its words in repeated windows. Of the others, those outside of their
    language's band are not kept; the band is wider for short texts, whose mean scatters more.
    Documents that fail the base rules take no part in the bands. ``model`` is learnt from
    ``docs`` if none is given.

    A null language is one of its own; one without a model has no perplexity, and its documents
    are judged by the base rules. Null and empty texts have no words. Repeated rows and ids are
    judged row by row. Other columns are not read. An empty table has no rows.
    """
    session_for_texts(docs)
    model = model or train(docs, lang=lang, text=text)
    rows = docs.select(F.col(id).alias("id"), language_key(F.col(lang)).alias("lang"), F.col(text).alias("text"))
    scored = _with_entropy(rows, model) if model.rows <= model_rows else _joined_entropy(rows, model)
    light = materialise(scored.select("id", "lang", measures(F.col("text")).alias("m"), "e"), "quality-measures")
    light = light.withColumn("failed", base_failed(F.col("m")))
    found = _small(materialise(bands(light.filter(~F.col("failed"))), "quality-bands"))
    allowed = F.col("scatter") / F.sqrt(F.greatest(F.col("e.n_chars"), F.lit(1)).cast("double"))
    low, high = F.col("low") - allowed, F.col("high") + allowed
    inside = F.coalesce(F.col("e.entropy").between(low, high), F.lit(True))
    return light.join(found, "lang", "left").select(
        F.col("id").alias(id), "m.*", F.col("failed").alias("base_failed"), F.exp("e.entropy").alias("perplexity"),
        F.exp(low).alias("lowest"), F.exp(high).alias("highest"), (~F.col("failed") & inside).alias("kept"))
