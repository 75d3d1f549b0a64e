"""Benchmark decontamination by Wu-Manber search over words.

A benchmark item is cut into windows of consecutive words. Windows of one length
form one Wu-Manber automaton whose alphabet is the benchmark's vocabulary: the
shift table says for a block of two words how far the search may jump, a block
that ends no window never stops it, the bucket of a stopping block lists windows
to compare word for word. A word outside the vocabulary lets the search jump by
a whole window. The scan is a narrow map over documents; benchmark texts reach
workers in broadcast groups of bounded size, one map per group. Groups behind the
first leave only their hits, which are joined by id and digest of the text, so
that a benchmark of any size works and no text is written.

Edge cases: null or wordless texts have no words and no hits; null or wordless
items have no windows; a null ``item_id`` is ignored; repeated documents are
judged each for itself; repeated items count once by id; columns that a document
table has besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, remembered, slices, utf8

#: Consecutive words of a window.
WINDOW_WORDS = 10
#: Bytes of benchmark text in one broadcast group; its windows take some hundred times as much in a worker.
GROUP_BYTES = 2 << 20
#: Words of two symbols form a block of the shift table.
BLOCK = 2

#: Lower-cases A-Z and turns every other ASCII character than 0-9 and a-z into a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class WuManber:
    """Finds all occurrences of equally long patterns of word numbers (0: a word that no pattern has)."""

    def __init__(self, patterns: dict[tuple[int, ...], set[str]]):
        self.size = len(next(iter(patterns)))
        self.block = min(BLOCK, self.size)
        self.default = self.size - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for pattern, owners in patterns.items():
            for end in range(self.block, self.size + 1):
                key = pattern[end - self.block : end] if self.block > 1 else pattern[end - 1]
                self.shift[key] = min(self.shift.get(key, self.default), self.size - end)
            self.bucket.setdefault(pattern[self.size - self.block :] if self.block > 1 else pattern[-1], []).append((pattern, owners))

    def search(self, text: list[int]) -> Iterator[tuple[int, set[str]]]:
        """Start of each occurrence, with the owners of the pattern."""
        at, size, default, shift = self.size - 1, self.size, self.default, self.shift.get
        if self.block == 1:
            for i, word in enumerate(text):
                if word:
                    for pattern, owners in self.bucket.get(word, ()):
                        yield i, owners
            return
        while at < len(text):
            word = text[at]
            if not word:
                at += size  # no window holds this word
                continue
            step = shift((text[at - 1], word), default)
            if step:
                at += step
                continue
            start = at - size + 1
            for pattern, owners in self.bucket[text[at - 1], word]:
                if pattern == tuple(text[start : at + 1]):
                    yield start, owners
            at += 1


def build(items: list[tuple[str, bytes]], window: int) -> tuple[dict[bytes, int], list[WuManber]]:
    vocabulary: dict[bytes, int] = {}
    by_size: dict[int, dict[tuple[int, ...], set[str]]] = {}
    for item, text in items:
        numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        size = min(window, len(numbers))
        for at in range(len(numbers) - size + 1 if size else 0):
            by_size.setdefault(size, {}).setdefault(tuple(numbers[at : at + size]), set()).add(item)
    return vocabulary, [WuManber(p) for _, p in sorted(by_size.items())]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


Search = Callable[[], tuple[dict[bytes, int], list[WuManber]]]


def _searches(docs: DataFrame, benchmark: DataFrame, window: int, group_bytes: int) -> Iterator[Search]:
    """One search per group of the benchmark, in a broadcast that workers build once."""
    for group in benchmark_groups(benchmark, group_bytes):
        sent, key = docs.sparkSession.sparkContext.broadcast(group), uuid.uuid4().hex

        def search(sent=sent, key=key):
            # A worker builds a group once and forgets it when another one, or another operator, comes.
            return remembered(("benchmark", key), lambda: build(sent.value, window))

        yield search


def _scan(search: Search):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, automata = search()
        number = vocabulary.get
        for batch, texts in slices(batches, "utf8"):
            n_words, spans, items = [], [], []
            for text in texts:
                words = words_of(text)
                numbers = [number(w, 0) for w in words]
                found, owners = [], set()
                if any(numbers):
                    for automaton in automata:
                        for start, own in automaton.search(numbers):
                            found.append((start, start + automaton.size))
                            owners |= own
                n_words.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in _merge(found)])
                items.append(sorted(owners))
            columns = {n: batch.column(n) for n in batch.schema.names if n != "utf8"} | {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, _SPANS), "items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return scan


def _clean(search: Search):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, automata = search()
        number = vocabulary.get
        for batch, texts in slices(batches, "text"):
            keep = []
            for text in texts:
                numbers = [number(w, 0) for w in words_of(text)]
                keep.append(not any(numbers) or not any(True for a in automata for _ in a.search(numbers)))
            yield batch.filter(pa.array(keep))

    return clean


def benchmark_groups(benchmark: DataFrame, group_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in order of id in groups of about ``group_bytes``, one after the other; one empty group of an empty benchmark."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), utf8().alias("utf8")).orderBy("item", "utf8")
    group, size, any_yet = [], 0, False
    for item, text in rows.toLocalIterator():
        if group and size + len(text) > group_bytes:
            yield group
            group, size, any_yet = [], 0, True
        group.append((item, bytes(text)))
        size += len(text)
    if group or not any_yet:
        yield group


_FOUND = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"
#: Two columns that tell a text from others: rows of equal id and text have equal hits.
_KEY = ["doc_id", "text_key"]


def _later_hits(rows: DataFrame, searches: Iterator[Search], kind: str) -> DataFrame | None:
    """Hits of the groups behind the first, without texts: one narrow pass over the documents and one small table per group."""
    out = None
    for search in searches:
        hits = rows.mapInArrow(_scan(search), f"doc_id {kind}, text_key long, {_FOUND}").where(F.size("spans") > 0).select(*_KEY, "spans", "items")
        hits = materialise(hits, "benchmark-hits")
        out = hits if out is None else out.unionByName(hits)
    return out


def _merged(spans: Column) -> Column:
    """Union of ranges, in order."""
    none = F.array().cast("array<struct<start: long, end: long>>")

    def step(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last.isNotNull() & (s["start"] <= last["end"]), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(F.array_sort(spans), none, step)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``doc_id, n_words, spans, items`` for ``docs(doc_id, text)``: hit word ranges [start, end) and the items found, as strings.

    Of a benchmark of several groups each group reads the documents once; only hits are written and joined, never texts.
    """
    kind, text = dict(docs.dtypes)["doc_id"], utf8()
    searches = _searches(docs, benchmark, window, group_bytes)
    first = next(searches)
    second = next(searches, None)
    if second is None:
        return docs.select("doc_id", text.alias("utf8")).mapInArrow(_scan(first), f"doc_id {kind}, {_FOUND}")
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("utf8"))
    base = rows.mapInArrow(_scan(first), f"doc_id {kind}, text_key long, {_FOUND}")
    more = _later_hits(rows, chain([second], searches), kind).distinct()
    more = more.groupBy(*_KEY).agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("more_items")).toDF("other_id", "other_key", "more_spans", "more_items")
    x = base.join(more, base.doc_id.eqNullSafe(more.other_id) & (base.text_key == more.other_key), "left")
    found = more.more_items.isNotNull()
    return x.select(
        "doc_id", "n_words", F.when(found, _merged(F.concat("spans", "more_spans"))).otherwise(F.col("spans")).alias("spans"), F.when(found, F.array_sort(F.array_union("items", "more_items"))).otherwise(F.col("items")).alias("items")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The documents of ``docs`` without any window of the benchmark, with all their columns."""
    searches = _searches(docs, benchmark, window, group_bytes)
    clean = docs.mapInArrow(_clean(next(searches)), docs.schema)
    second = next(searches, None)
    if second is None:
        return clean
    text = utf8()
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("utf8"))
    hits = _later_hits(rows, chain([second], searches), dict(docs.dtypes)["doc_id"]).select(*_KEY).distinct().toDF("other_id", "other_key")
    return clean.join(hits, clean.doc_id.eqNullSafe(hits.other_id) & (F.xxhash64(text) == hits.other_key), "left_anti").select(*docs.columns)


def contamination_report(found: DataFrame) -> DataFrame:
    """Digest columns of :func:`find_benchmark`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
