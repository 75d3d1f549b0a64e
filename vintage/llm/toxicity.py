"""Toxicity by compression distance: two Zstandard dictionaries and the lengths of windows compressed with either.

Training uses a bounded sample of labelled documents. The ordinary dictionary
holds the byte segments that ordinary documents repeat most. The toxic one holds
the segments that set toxic documents apart and, behind them, the ordinary
dictionary, so that a window's two lengths differ by matches with the former
alone. Segments are chosen by the number of documents that have them and the
bytes they save. The library's own trainer was tried in their place, on whole
texts and on windows that the ordinary dictionary compresses badly, and told the
classes apart much worse; the README has the figures.

A text is cut into windows at white space, or between characters where a text has
none for long, so that every window lies within the compressor's own. What counts
is the length difference: the share of windows beyond several thresholds, its mean
and its maximum. A logistic calibration on sample documents that the dictionaries
have not seen turns these into a score, and is shifted so that a score of one half
is the threshold that ``FALSE_POSITIVES`` of its ordinary documents exceed.

Edge cases: null and empty texts score like a text without windows (the
calibration's value at zero features); rows of null ``doc_id`` are scored and
count as held out; unlabelled rows never train; repeated rows score alike; with
no labelled rows of either class the score is 0 for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, remembered, slices, utf8

#: Labelled documents of each class that the classifier is fitted on, at most (those of the lowest id hash).
SAMPLE_TOXIC, SAMPLE_ORDINARY = 2_500, 5_000
#: Longest text in the sample, in bytes; bounds the sample together with the counts above.
SAMPLE_BYTES = 16_384
#: Bytes of a window, about; a window has at most three times as many.
WINDOW = 32
#: Share of ordinary calibration documents that may score one half or more.
FALSE_POSITIVES = 0.01
#: Bytes of class-specific and of common segments in a dictionary.
DISTINCT_BYTES, COMMON_BYTES = 700, 1_000
#: Search of the compressor, and the shortest match it takes.
STRATEGY, MIN_MATCH = zstandard.STRATEGY_LAZY2, 4
#: Lengths of the byte n-grams that segments are made of.
GRAMS = (5, 6, 7, 8)
#: A segment sets toxic texts apart if it is so many times as frequent there.
CONTRAST = 8
#: Length differences, in bytes, beyond which a window counts.
THRESHOLDS = (2, 3, 4, 5, 6, 8)


def _grams(text: bytes, size: int) -> np.ndarray:
    """Distinct n-grams of a text as big-endian numbers, without those that have a space inside."""
    a = np.frombuffer(text, np.uint8)
    n = len(a) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    codes, inner = np.zeros(n, np.uint64), np.zeros(n, bool)
    for i in range(size):
        part = a[i : i + n]
        codes = (codes << np.uint64(8)) | part
        if 0 < i < size - 1:
            inner |= part <= 32
    return np.unique(codes[~inner])


def _frequencies(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([_grams(t, size) for t in texts]), return_counts=True)


def _segments(scored: list[tuple[float, bytes]], size: int) -> bytes:
    """Best n-grams first, each joined to a segment that it overlaps; the best segments come last."""
    segments: list[bytes] = []
    chosen: list[bytes] = []
    total = 0
    for _, gram in sorted(scored, reverse=True):
        if any(gram in s for s in segments) or any(c in gram for c in chosen):
            continue
        chosen.append(gram)
        for i, s in enumerate(segments):
            shared = next((n for n in range(len(gram) - 1, 3, -1) if s.endswith(gram[:n])), 0)
            if shared:
                segments[i] = s + gram[shared:]
                break
            shared = next((n for n in range(len(gram) - 1, 3, -1) if s.startswith(gram[-n:])), 0)
            if shared:
                segments[i] = gram[:-shared] + s
                break
        else:
            shared = 0
            segments.append(gram)
        total += len(gram) - shared
        if total >= size:
            break
    return b"".join(reversed(segments))


def prepare(text: bytes) -> bytes:
    return b" " + text.lower() + b" "


def windows(text: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the windows: cut at the first white space at or behind each multiple of the width.

    Where that is more than a width away, the cut is before the next whole character instead.
    """
    codes = np.frombuffer(text, np.uint8)
    blanks = np.append(np.flatnonzero((codes == 32) | ((codes >= 9) & (codes <= 13))), 1 << 40)
    grid = np.arange(width, len(text), width)
    cuts = blanks[np.searchsorted(blanks, grid)]
    far = cuts - grid > width
    inside = grid[far]
    for _ in range(3):  # a character has three bytes behind its first at most
        inside = np.where((inside < len(text)) & (codes[np.minimum(inside, len(text) - 1)] & 0xC0 == 0x80), inside + 1, inside)
    cuts[far] = inside
    cuts = np.unique(cuts)
    cuts = cuts[(cuts > 0) & (cuts < len(text) - 1)]
    starts = np.concatenate([[0], cuts])
    return starts, np.concatenate([cuts, [len(text)]]) - starts


@dataclass
class Dictionaries:
    toxic: bytes
    ordinary: bytes
    width: int

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        settings = zstandard.ZstdCompressionParameters(
            strategy=STRATEGY, window_log=12, hash_log=11, chain_log=11, search_log=4, min_match=MIN_MATCH, target_length=32,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        return [
            zstandard.ZstdCompressor(compression_params=settings, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for d in (self.ordinary, self.toxic)
        ]

    def differences(self, texts: list[bytes], compressors: list[zstandard.ZstdCompressor]) -> tuple[np.ndarray, np.ndarray]:
        """For each window of the prepared texts: the text's number, and by how many bytes the toxic dictionary is shorter."""
        starts, lengths, owner, at = [], [], [], 0
        for i, text in enumerate(texts):
            s, n = windows(text, self.width)
            starts.append(s + at)
            lengths.append(n)
            owner.append(np.full(len(s), i))
            at += len(text)
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        segments = np.stack([np.concatenate(starts), np.concatenate(lengths)], 1).astype("<u8").tobytes()
        joined = b"".join(texts)
        sizes = []
        for c in compressors:
            out = c.multi_compress_to_buffer(zstandard.BufferWithSegments(joined, segments))
            sizes.append(np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out)))
        return np.concatenate(owner), sizes[0] - sizes[1]


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> Dictionaries:
    """``toxic``, ``ordinary``: prepared texts of either class."""
    distinct, common = [], []
    for size in GRAMS:
        grams, n_toxic = _frequencies(toxic, size)
        other, n_other = _frequencies(ordinary, size)
        at = np.minimum(np.searchsorted(other, grams), len(other) - 1)
        n_both = np.where(other[at] == grams, n_other[at], 0)
        p, q = (n_toxic + 0.5) / (len(toxic) + 1), (n_both + 0.5) / (len(ordinary) + 1)
        good = (n_toxic >= max(3, len(toxic) // 250)) & (p > CONTRAST * q)
        score = p * np.log(p / q) * (size - 3)
        distinct += [(float(s), int(g).to_bytes(size, "big")) for s, g in zip(score[good], grams[good], strict=True)]
        best = np.argsort(-n_other, kind="stable")[:COMMON_BYTES]
        common += [(float(n_other[i]) * (size - 3), int(other[i]).to_bytes(size, "big")) for i in best]
    base = _segments(common, COMMON_BYTES)
    return Dictionaries(_segments(distinct, DISTINCT_BYTES) + base, base, WINDOW)


def features(owner: np.ndarray, difference: np.ndarray, n: int) -> np.ndarray:
    """Per text: for each threshold the share and the logarithm of the number of windows beyond it; mean and maximum."""
    count = np.maximum(np.bincount(owner, minlength=n), 1)
    columns = []
    for t in THRESHOLDS:
        hits = np.bincount(owner, difference >= t, minlength=n)
        columns += [np.sqrt(hits / count), np.log1p(hits)]
    most = np.zeros(n)
    np.maximum.at(most, owner, difference)
    columns += [np.bincount(owner, difference, minlength=n) / count, most / 8, np.log(count) / 4, np.bincount(owner, np.clip(difference - 2, 0, 8) ** 2, minlength=n) / count]
    return np.stack(columns, 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights (the last is the constant) by iteratively reweighted least squares; classes weigh as they occur."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * ridge
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    dictionaries: Dictionaries
    weights: np.ndarray


def sample(docs: DataFrame, labels: DataFrame, n_toxic: int, n_ordinary: int) -> list[tuple[int, bytes]]:
    """``(label, text)`` of labelled training documents, those with the lowest id hash: a bounded number of rows of each class."""
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = [usable.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, n_toxic), (0, n_ordinary))]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.select("doc_id", utf8().alias("utf8")).where((F.length("utf8") > 0) & (F.length("utf8") <= SAMPLE_BYTES))
    rows = rows.join(chosen, "doc_id")
    parts = [rows.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id", "utf8").limit(n) for t, n in ((1, n_toxic), (0, n_ordinary))]
    return [(r.toxic, bytes(r.utf8)) for r in parts[0].unionByName(parts[1]).select("toxic", "utf8").toLocalIterator()]


def fit(rows: list[tuple[int, bytes]]) -> Model | None:
    """Dictionaries from two thirds of the sample, calibration from the other third, which shows honest differences; None without both classes."""
    rows = [r for label in (1, 0) for r in rows if r[0] == label]
    texts = [prepare(t) for _, t in rows]
    y = np.array([label for label, _ in rows], float)
    seen = np.arange(len(rows)) % 3 != 2
    parts = [[t for t, label, s in zip(texts, y, seen, strict=True) if s and label == c] for c in (1, 0)]
    if not all(parts) or len(set(y[~seen])) < 2:
        return None
    dictionaries = train_dictionaries(*parts)
    rest = [t for t, s in zip(texts, seen, strict=True) if not s]
    owner, difference = dictionaries.differences(rest, dictionaries.compressors())
    x = features(owner, difference, len(rest))
    weights = fit_logistic(x, y[~seen])
    weights[-1] -= np.quantile((x @ weights[:-1] + weights[-1])[y[~seen] == 0], 1 - FALSE_POSITIVES, method="higher") + 1e-9
    return Model(dictionaries, weights)


def score_texts(model: Model, texts: list[bytes], compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    owner, difference = model.dictionaries.differences([prepare(t) for t in texts], compressors)
    x = features(owner, difference, len(texts))
    return 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))


def _score(broadcast):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("toxicity", dict)  # keeps nothing, gives back what others kept
        model = broadcast.value
        compressors = model.dictionaries.compressors() if model else None
        for batch, texts in slices(batches, "utf8"):
            scores = score_texts(model, texts, compressors) if model else np.zeros(len(texts))
            keep = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, n_toxic: int = SAMPLE_TOXIC, n_ordinary: int = SAMPLE_ORDINARY) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text of ``docs(doc_id, text)``, learnt from ``labels(doc_id, toxic)``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, n_toxic, n_ordinary)))
    rows = docs.select("doc_id", held_out().alias("held_out"), utf8().alias("utf8"))
    types = dict(rows.dtypes)
    scored = rows.mapInArrow(_score(model), f"doc_id {types['doc_id']}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, SAMPLE_TOXIC, SAMPLE_ORDINARY)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("toxicity", dict)  # keeps nothing, gives back what others kept
        fitted = model.value
        compressors = fitted.dictionaries.compressors() if fitted else None
        for batch, texts in slices(batches, "text"):
            scores = score_texts(fitted, texts, compressors) if fitted else np.zeros(len(texts))
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(keep, docs.schema)
