"""Language identification with interpolated Kneser-Ney character models.

One model per language over the characters of words (with begin and end marks),
of order ``ORDER``. The discounted probabilities and back-off weights of all
languages lie in one sorted array of 64-bit n-gram hashes per order, a column per
language, and are found by binary search. A text goes to the language of lowest
cross-entropy per predicted symbol. It is also marked as rejected when even that
entropy is beyond what the calibration texts of the language show; the score is
the language's share under a temperature fitted on those texts.

The models are fitted on a bounded sample of labelled documents; every distinct
word is scored once per worker and texts sum over their words.

Edge cases: a null text or one without letters is ``und`` with score 0, and is
rejected; without training rows every text is ``und``; documents of null ``lang``
or null ``doc_id`` never train; a null id counts as held out; repeated rows are
predicted alike; equal entropies go to the language first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Numbering, held_out, remembered, slices, utf8

#: Longest n-gram, in characters.
ORDER = 5
#: Documents per language in the training sample, at most (those of the lowest id hash).
SAMPLE_DOCS = 800
#: Languages that have models, at most: those with the most training rows.
MAX_LANGUAGES = 400
#: Longest text in the sample, in bytes.
SAMPLE_BYTES = 16_384
#: Every so many sample documents calibrate instead of train.
CALIBRATE_EVERY = 4
#: Share of a language's calibration texts that rejection spares.
ACCEPT = 0.995
#: Words that a worker remembers before it starts afresh; affects speed only.
REMEMBERED = 400_000
BEGIN, END = 2, 3
#: Sets the places of an n-gram apart in its hash.
_SALTS = [np.uint64(k * 0x9E3779B97F4A7C15 % 2**64) for k in range(64)]


def letters(word: bytes) -> str:
    if word.isalpha():
        return word.lower().decode()
    return "".join(filter(str.isalpha, word.decode("utf-8", "replace").lower()))


def _grams(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order k: per predicted symbol the hash of the k-gram that ends there (0 if it would leave the word); and each symbol's word."""
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    codes = np.frombuffer("".join([f"{chr(BEGIN)}{w}{chr(END)}" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    keep = place > 0
    out, h = [], np.zeros(len(codes), np.uint64)
    for k in range(1, order + 1):
        # h of the k-gram ending at i: mixes the symbol k - 1 places back into the (k - 1)-gram ending at i
        back = np.concatenate([np.zeros(k - 1, np.uint64), codes[: len(codes) - k + 1]])
        h = (h ^ (back + _SALTS[k])) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
        out.append(np.where(place >= k - 1, h | np.uint64(1), np.uint64(0))[keep])
    return out, owner[keep]


def _contexts(words: list[str], order: int) -> list[np.ndarray]:
    """For each order k: hash of the (k - 1)-gram before the predicted symbol, aligned with :func:`_grams`."""
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    codes = np.frombuffer("".join([f"{chr(BEGIN)}{w}{chr(END)}" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep = place > 0
    out, h = [np.zeros(int(keep.sum()), np.uint64)], np.zeros(len(codes), np.uint64)
    for k in range(1, order):
        back = np.concatenate([np.zeros(k, np.uint64), codes[: len(codes) - k]])
        h = (h ^ (back + _SALTS[k])) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
        out.append(np.where(place >= k, h | np.uint64(1), np.uint64(0))[keep])
    return out


@dataclass
class Level:
    """N-grams of one order: sorted hashes with discounted probabilities, sorted context hashes with back-off weights."""

    grams: np.ndarray
    probability: np.ndarray  # grams x languages
    contexts: np.ndarray
    weight: np.ndarray  # contexts x languages; 1 where a language has not seen the context


def _find(table: np.ndarray, values: np.ndarray, keys: np.ndarray, missing: float) -> np.ndarray:
    if not len(table):
        return np.full((len(keys), values.shape[1]), missing, np.float32)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    found = values[at]
    found[table[at] != keys] = missing
    return found


def _level(counted: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Level:
    """``counted``: per language the distinct n-grams, their contexts and counts."""
    grams = np.unique(np.concatenate([g for g, _, _ in counted]))
    contexts = np.unique(np.concatenate([c for _, c, _ in counted]))
    probability = np.zeros((len(grams), len(counted)), np.float32)
    weight = np.ones((len(contexts), len(counted)), np.float32)
    for j, (g, c, n) in enumerate(counted):
        if not len(g):
            continue
        ones, twos = int((n == 1).sum()), int((n == 2).sum())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        at = np.searchsorted(contexts, c)
        total = np.bincount(at, n, minlength=len(contexts))
        kinds = np.bincount(at, minlength=len(contexts))
        probability[np.searchsorted(grams, g), j] = np.maximum(n - discount, 0) / total[at]
        seen = kinds > 0
        weight[seen, j] = discount * kinds[seen] / total[seen]
    return Level(grams, probability, contexts, weight)


class Models:
    def __init__(self, languages: list[str], levels: list[Level], symbols: int):
        self.languages, self.levels, self.symbols = languages, levels, symbols
        self.temperature, self.limits = 1.0, np.full(len(languages), np.inf)

    def log_probabilities(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word: the log-probability of its letters and end in each language, and how many symbols that are."""
        n = np.fromiter((len(w) + 1 if w else 0 for w in words), np.int64, len(words))
        some = [w for w in words if w]
        out = np.zeros((len(words), len(self.languages)), np.float64)
        if some:
            grams, owner = _grams(some, len(self.levels))
            p = np.full((len(owner), len(self.languages)), 1 / self.symbols, np.float32)
            for level, gram, context in zip(self.levels, grams, _contexts(some, len(self.levels)), strict=True):
                known = gram != 0
                q = _find(level.grams, level.probability, gram[known], 0) + _find(level.contexts, level.weight, context[known], 1) * p[known]
                p[known] = q
            logs = np.log(np.maximum(p, 1e-30))
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            out[n > 0] = np.add.reduceat(logs, starts, axis=0)
        return out, n


def fit(rows: list[tuple[str, bytes]]) -> Models | None:
    """``rows``: language and text of the sample."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    train, check = [[] for _ in languages], []
    for i, (lang, text) in enumerate(rows):
        if i % CALIBRATE_EVERY == CALIBRATE_EVERY - 1:
            check.append((languages.index(lang), text))
        else:
            train[languages.index(lang)].append(text)
    by_language = []
    for texts in train:
        numbers = Numbering()
        at = np.fromiter((numbers[w] for t in texts for w in t.split()), np.int64)
        merged: dict[str, int] = {}
        for word, n in zip(numbers, np.bincount(at, minlength=len(numbers)), strict=True):
            if w := letters(word):
                merged[w] = merged.get(w, 0) + int(n)
        by_language.append(merged)
    symbols = len({c for m in by_language for w in m for c in w}) + 2
    counted: list[list[tuple]] = [[] for _ in range(ORDER)]
    for merged in by_language:
        words, freq = list(merged), np.fromiter(merged.values(), np.int64, len(merged))
        if not words:
            for k in range(ORDER):
                counted[k].append((np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        grams, owner = _grams(words, ORDER)
        contexts = _contexts(words, ORDER)
        for k in range(ORDER):
            known = grams[k] != 0
            gram, context = grams[k][known], contexts[k][known]
            distinct, first, inverse = np.unique(gram, return_index=True, return_inverse=True)
            if k == ORDER - 1:
                n = np.bincount(inverse, freq[owner[known]]).astype(np.int64)
            else:
                # continuation count: how many different symbols precede the n-gram (its longer forms); one for a word's begin
                longer = np.where(grams[k + 1][known] != 0, grams[k + 1][known], gram)
                pairs = np.unique(np.stack([inverse.astype(np.uint64), longer]), axis=1)
                n = np.bincount(pairs[0].astype(np.int64), minlength=len(distinct))
            counted[k].append((distinct, context[first], n))
    models = Models(languages, [_level(c) for c in counted], symbols)
    calibrate(models, check)
    return models


def calibrate(models: Models, check: list[tuple[int, bytes]]) -> None:
    totals, sizes, truth = [], [], []
    for language, text in check:
        logs, n = models.log_probabilities([letters(w) for w in text.split()])
        if n.sum():
            totals.append(logs.sum(0))
            sizes.append(n.sum())
            truth.append(language)
    if not totals:
        return
    entropy = -np.array(totals) / np.array(sizes)[:, None]
    truth = np.array(truth)
    for j in range(len(models.languages)):
        if (truth == j).any():
            models.limits[j] = np.quantile(entropy[truth == j, j], ACCEPT) + 0.25

    def loss(t: float) -> float:
        share = _share(entropy, t)
        return -np.log(np.maximum(share[np.arange(len(truth)), truth], 1e-12)).mean()

    models.temperature = min((2.0**k for k in range(-2, 7)), key=loss)


def _share(entropy: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp(-(entropy - entropy.min(1, keepdims=True)) * temperature)
    return e / e.sum(1, keepdims=True)


class Identifier:
    """Scores texts with remembered words."""

    def __init__(self, models: Models):
        self.models = models
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbering()
        self.logs = np.zeros((0, len(self.models.languages)))
        self.sizes = np.zeros(0, np.int64)

    def entropies(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.numbers) > REMEMBERED:
            self.clear()
        words = [t.split() for t in texts]
        known = len(self.numbers)
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64)
        if len(self.numbers) > known:
            fresh = []
            for word in reversed(self.numbers):
                if self.numbers[word] < known:
                    break
                fresh.append(letters(word))
            logs, sizes = self.models.log_probabilities(fresh[::-1])
            self.logs, self.sizes = np.concatenate([self.logs, logs]), np.concatenate([self.sizes, sizes])
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        size = np.bincount(owner, self.sizes[numbers], minlength=len(texts))
        total = np.stack([np.bincount(owner, self.logs[numbers, j], minlength=len(texts)) for j in range(len(self.models.languages))], 1)
        return -total / np.maximum(size, 1)[:, None], size


def sample(docs: DataFrame, per_language: int, max_languages: int = MAX_LANGUAGES) -> list[tuple[str, bytes]]:
    """``(lang, text)`` of training rows, at most ``per_language`` of each of the ``max_languages`` most frequent languages.

    Rows are taken by the hash of id and text. Counts of the languages give a
    threshold of the hash that few more rows than needed pass, so that no language
    is ranked as a whole.
    """
    usable = docs.where(~held_out()).where("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("place"), utf8().alias("utf8"))
    usable = usable.where((F.length("utf8") > 0) & (F.length("utf8") <= SAMPLE_BYTES))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    share = F.col("place").cast("double") / 2.0**64 + 0.5
    rows = usable.join(F.broadcast(counts), "lang").where(share <= 4 * per_language / F.col("n"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "utf8"))).where(F.col("rank") <= per_language)
    return [(r.lang, bytes(r.utf8)) for r in rows.orderBy("place", "utf8").select("lang", "utf8").toLocalIterator()]


def _identify(broadcast):
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = broadcast.value
        identifier = remembered(("languages", id(models)), lambda: Identifier(models)) if models else None
        for batch, texts in slices(batches, "utf8"):
            n = len(texts)
            lang, score, rejected, bits = ["und"] * n, np.zeros(n), np.ones(n, bool), np.full(n, np.nan)
            if models:
                entropy, size = identifier.entropies(texts)
                best = entropy.argmin(1)
                some = size > 0
                lang = [models.languages[b] if s else "und" for b, s in zip(best, some, strict=True)]
                rows = np.arange(n)
                score = np.where(some, _share(entropy, models.temperature)[rows, best], 0)
                bits = np.where(some, entropy[rows, best], np.nan)
                rejected = ~some | (bits > models.limits[best])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang), pa.array(score), pa.array(rejected), pa.array(bits, from_pandas=True)],
                ["doc_id", "held_out", "lang_pred", "score", "rejected", "cross_entropy"],
            )

    return identify


def identify_languages(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected, cross_entropy`` (nats per symbol) of every whole text of ``docs(doc_id, text, lang)``."""
    models = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, per_language)))
    rows = docs.select("doc_id", held_out().alias("held_out"), utf8().alias("utf8"))
    types = dict(rows.dtypes)
    schema = f"doc_id {types['doc_id']}, held_out boolean, lang_pred string, score double, rejected boolean, cross_entropy double"
    return rows.mapInArrow(_identify(models), schema)
