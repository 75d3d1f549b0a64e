"""Ranked lexical search by the Best Position Algorithm over impact lists.

One pass over the documents keeps, per document, its number of terms and the
frequencies of the terms that queries use; this table is written once, and the
corpus statistics (documents, terms, document frequencies) are aggregates of it.
A second narrow pass reads it in blocks of bounded size. A block holds one impact
list per term, sorted by falling impact, and a table with each document's position in
each list for direct access. A query reads its lists from their best positions on,
where the best position of a list is the end of the run of seen positions at its
top: a document met in one list is scored in full by direct accesses and its
positions in all lists count as seen. Any document not seen lies below the
best position of every list, so the impacts there bound its score; reading
stops when the bound is strictly below the k-th score, since an equal score may
still win by a smaller id. A task carries the k-th scores of its queries from
block to block. Short lists are merged per query by a window.

Queries are a stated set. They travel in groups of ``GROUP_BYTES`` of text, one
pair of passes each; within a task they are searched in sets of ``SET_TERMS`` distinct terms.

Edge cases: null text has no terms; documents without terms count neither in N
nor in L; repeated documents are rows of their own and share statistics; each row
of the query table is a query, also with a null or repeated id; queries without
a term that some document has return nothing; documents of score 0 are not
returned; equal scores are ordered by id, null ids last; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise, remembered, slices, utf8
from .decontamination import WORD_BYTES

#: Bytes of query text in one broadcast group.
GROUP_BYTES = 8 << 20
#: Distinct terms of the queries that are searched together, and cells of their position table in a block.
SET_TERMS, CELLS = 4096, 32 << 20
#: Documents of a block, at most; a position has to fit in 16 bits.
BLOCK_DOCS, ABSENT = 16384, np.uint16(65535)
#: Bytes of a text that are split into terms at a time.
SPLIT_BYTES = 1 << 20
#: Positions that a query reads from each list in its first round; they double up to the second number.
FIRST_READ, MOST_READ = 16, 512


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in portions, so that a very long text never lies in memory as one list."""
    text, at = text.translate(WORD_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + SPLIT_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count_terms(vocabulary):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary().get
        for batch, texts in slices(batches, "utf8"):
            n, keys = np.zeros(len(texts), np.int64), []
            for i, text in enumerate(texts):
                for words in terms_of(text):
                    n[i] += len(words)
                    found = np.fromiter(map(number, words, repeat(-1)), np.int64, len(words))
                    keys.append(found[found >= 0] + (i << 32))
            key, tf = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
            offsets = pa.array(np.searchsorted(key, np.arange(len(texts) + 1) << 32), pa.int32())
            terms = pa.ListArray.from_arrays(offsets, pa.array((key & 0xFFFFFFFF).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), terms, pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))], ["doc_id", "n", "terms", "tfs"])

    return count


class Block:
    """Impact lists of a block of documents, by term number."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((docs, -impacts, terms))
        self.docs, self.impacts, self.n_docs = docs[order], impacts[order], n_docs
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def positions(self, terms: np.ndarray) -> np.ndarray:
        """For direct access: the position of each document in the list of each of ``terms``."""
        table = np.full((len(terms), self.n_docs), ABSENT, np.uint16)
        for row, term in enumerate(terms):
            a, b = self.starts[term], self.starts[term + 1]
            table[row, self.docs[a:b]] = np.arange(b - a, dtype=np.uint16)
        return table

    def best(self, terms: np.ndarray, rows: np.ndarray, weights: np.ndarray, table: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores, among them all that are among the k best of the block and not below ``floor``."""
        starts, sizes = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        some = sizes > 0
        starts, sizes, rows, weights = starts[some], sizes[some], rows[some], weights[some]
        lists = np.arange(len(rows))
        known = np.zeros(self.n_docs, bool)
        seen = np.zeros((len(rows), self.n_docs + 1), bool)  # the last column takes the documents that a list lacks
        best, step, kth = np.zeros(len(rows), np.int64), FIRST_READ, 0
        all_docs, all_scores = [], []
        while len(rows):
            at = best[:, None] + np.arange(step)
            docs = self.docs[(starts[:, None] + at)[at < sizes[:, None]]]
            docs = np.unique(docs[~known[docs]])
            if len(docs):
                known[docs] = True
                position = table[rows[:, None], docs].astype(np.int64)
                here = position != ABSENT
                score = (np.where(here, self.impacts[np.where(here, starts[:, None] + position, 0)], 0) * weights[:, None]).sum(0)
                seen[lists[:, None], np.where(here, position, self.n_docs)] = True
                keep = score >= max(floor, kth, 1)
                all_docs.append(docs[keep])
                all_scores.append(score[keep])
                together = np.concatenate(all_scores)
                if len(together) >= k:
                    kth = max(kth, int(np.partition(together, len(together) - k)[len(together) - k]))
            best = np.array([b + int(seen[i, b:n].argmin()) if not seen[i, b:n].all() else n for i, b, n in zip(lists, best, sizes, strict=True)], np.int64)
            left = best < sizes
            bound = int((self.impacts[starts[left] + best[left]] * weights[left]).sum())  # of any document not seen
            if not bound or bound < max(floor, kth):
                break
            step = min(2 * step, MOST_READ)
        return (np.concatenate(all_docs), np.concatenate(all_scores)) if all_docs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _sets(queries: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]]:
    """Queries in sets of few distinct terms: the set's terms; per query its number, terms, rows in the set's table and weights."""
    out, have, at = [], {}, []
    for number, (terms, weights) in enumerate(queries):
        fresh = [t for t in terms.tolist() if t not in have]
        if at and len(have) + len(fresh) > SET_TERMS:
            out.append((np.array(list(have), np.int64), at))
            have, at, fresh = {}, [], terms.tolist()
        for t in fresh:
            have[t] = len(have)
        at.append((number, terms, np.array([have[t] for t in terms.tolist()], np.int64), weights))
    if at:
        out.append((np.array(list(have), np.int64), at))
    return out


def _search(group, n_docs: int, n_words: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, ids, n_terms = group()
        sets = _sets(queries)
        block_docs = max(1, min(BLOCK_DOCS, CELLS // max([1, *(len(t) for t, _ in sets)])))
        scores = [np.zeros(0, np.int64) for _ in queries]  # the k best so far, per query
        for whole in batches:
            for start in range(0, whole.num_rows, block_docs):
                batch = whole.slice(start, block_docs)
                sizes = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
                docs, terms, tf = np.repeat(np.arange(batch.num_rows), sizes), batch.column("terms").flatten().to_numpy().astype(np.int64), batch.column("tfs").flatten().to_numpy().astype(np.int64)
                if not len(docs):
                    continue
                length = 100 - 75 + (75 * batch.column("n").to_numpy() * n_docs) // n_words
                block = Block(docs, terms, (1_000_000_000 * tf) // (1000 * tf + 8 * length[docs]), batch.num_rows, n_terms)
                place = np.empty(batch.num_rows, np.int64)
                place[pc.sort_indices(batch.column("doc_id"), null_placement="at_end").to_numpy()] = np.arange(batch.num_rows)
                found = []
                for set_terms, members in sets:
                    table = block.positions(set_terms)
                    for number, own_terms, rows, weights in members:
                        had = scores[number]
                        at, score = block.best(own_terms, rows, weights, table, k, int(had[-1]) if len(had) == k else 0)
                        top = np.lexsort((place[at], -score))[:k]
                        found += [(number, at[top], score[top])] if len(top) else []
                        scores[number] = -np.sort(-np.concatenate([had, score[top]]))[:k]
                if found:
                    numbers = np.repeat([n for n, _, _ in found], [len(a) for _, a, _ in found])
                    at = pa.array(np.concatenate([a for _, a, _ in found]))
                    columns = [pa.array(numbers, pa.int32()), ids.take(pa.array(numbers)), batch.column("doc_id").take(at), pa.array(np.concatenate([s for _, _, s in found]))]
                    yield pa.RecordBatch.from_arrays(columns, ["query", "item_id", "doc_id", "score"])

    return search


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _groups(queries: DataFrame, group_bytes: int) -> Iterator[list[tuple[object, bytes]]]:
    group, size = [], 0
    for item, text in queries.select("item_id", utf8().alias("utf8")).toLocalIterator():
        if group and size + len(text) > group_bytes:
            yield group
            group, size = [], 0
        group.append((item, bytes(text)))
        size += len(text)
    if group:
        yield group


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 10, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best of ``docs(doc_id, text)`` for each row of ``queries(item_id, text)``."""
    context, rows = docs.sparkSession.sparkContext, docs.select("doc_id", utf8().alias("utf8"))
    doc_type, item_type = dict(docs.dtypes)["doc_id"], dict(queries.dtypes)["item_id"]
    item_arrow, out = to_arrow_type(queries.schema["item_id"].dataType), None
    for items in _groups(queries, group_bytes):
        number: dict[bytes, int] = {}
        asked = []
        for _, text in items:
            counts: dict[int, int] = {}
            for words in terms_of(text):
                for w in words:
                    t = number.setdefault(w, len(number))
                    counts[t] = counts.get(t, 0) + 1
            asked.append(counts)
        words, key = context.broadcast(number), uuid.uuid4().hex
        counted = rows.mapInArrow(_count_terms(lambda words=words, key=key: remembered(("terms", key), lambda: words.value)), f"doc_id {doc_type}, n long, terms array<int>, tfs array<int>")
        counted = materialise(counted, "term-counts")
        total = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("words")).first()
        df = {r.term: r["count"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator()}  # of this group's terms only
        of_term = {t: w for t, n in df.items() if (w := weight(total.docs, n)) > 0}
        lists = []
        for counts in asked:
            own = [t for t in counts if t in of_term]
            lists.append((np.array(own, np.int64), np.array([counts[t] * of_term[t] for t in own], np.int64)))
        sent, n_terms = context.broadcast((lists, pa.array([i for i, _ in items], item_arrow))), len(number)

        def group(sent=sent, n_terms=n_terms, key=key):
            return remembered(("queries", key), lambda: (*sent.value, n_terms))

        found = counted.mapInArrow(_search(group, total.docs, max(1, total.words or 0), k), f"query int, item_id {item_type}, doc_id {doc_type}, score long")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id {doc_type}, score long")
    return out
