"""Token counts without token ids: count a pre-token's pieces once, then join and sum.

Plan
----
1. Every worker turns about 32 MB of consecutive text into one block: the block's
   distinct pre-tokens, and per document the frequencies of those pre-tokens by
   number. Both go to one table in the shared folder.
2. The pre-tokens are dealt out by their text. Equal ones meet in one partition,
   where each is counted once; a frequent one brings one row per block that has
   it, not one per document.
3. Counts return to their block and meet its frequency rows; a document's total
   is the dot product of both. No token id is ever listed.

Edge cases: a null or empty text has 0 bytes and 0 tokens; a null ``doc_id`` is
kept; repeated rows are counted each for itself; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Words, WordTokenizer, memory_for, spans
from .common import materialise, text_slices, utf8

#: Text of a block; with it grow a worker's memory and the compression of pre-tokens to one row a block.
BLOCK_BYTES = 32 << 20
#: Text bytes that are split at a time.
TEXT_BYTES = 8 << 20


def _pack(numbers: np.ndarray, freqs: np.ndarray) -> bytes:
    """Ascending numbers as differences, and frequencies, stored byte plane by byte plane."""
    both = np.concatenate([np.diff(numbers, prepend=0), freqs]).astype("<u4")
    return both.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


class _Block:
    def __init__(self, tokenizer: WordTokenizer, number: int):
        self.tokenizer, self.number, self.bytes = tokenizer, number, 0
        self.pieces = pa.array([], pa.string())

    def frequencies(self, texts: pa.Array) -> list[bytes]:
        """Per text, its pieces' numbers in this block and how often it has them, packed."""
        found = Words(self.tokenizer, texts)
        at = pc.index_in(found.pieces, value_set=self.pieces)
        fresh = at.is_null().to_numpy(zero_copy_only=False)
        numbers = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        numbers[fresh] = len(self.pieces) + np.arange(fresh.sum())
        self.pieces = pa.concat_arrays([self.pieces, found.pieces.filter(pa.array(fresh))])
        self.bytes += int(pc.sum(pc.binary_length(texts)).as_py() or 0)
        lengths = found.lengths[found.words]
        pieces = numbers[found.word_pieces[spans(found.starts[found.words], lengths)]]
        ends, bounds = np.concatenate([[0], np.cumsum(lengths)]), np.concatenate([[0], np.cumsum(found.text_words)])
        ends, press = ends[bounds], zstandard.ZstdCompressor(level=1)
        return [press.compress(_pack(*np.unique(pieces[a:b], return_counts=True))) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _rows(kind: int, block: int, n: int, **columns) -> pa.RecordBatch:
    arrays = {
        "doc_id": columns.get("doc_id", pa.nulls(n, pa.int64())),
        "n_bytes": columns.get("n_bytes", pa.nulls(n, pa.int64())),
        "freqs": pa.array(columns.get("freqs", [None] * n), pa.binary()),
        "number": pa.array(columns.get("number", [None] * n), pa.int32()),
        "piece": columns.get("piece", pa.nulls(n, pa.string())),
        "block": pa.array([block] * n, pa.int64()),
        "kind": pa.array([kind] * n, pa.int32()),
    }
    return pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


def _encode(path: str, block_bytes: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = memory_for(path).tokenizer
        block = _Block(tokenizer, TaskContext.get().partitionId() << 32)

        def close() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(block.pieces), 50_000):
                some = block.pieces.slice(at, 50_000)
                yield _rows(1, block.number, len(some), number=range(at, at + len(some)), piece=some)

        for batch, texts in text_slices(batches, "utf8", min(TEXT_BYTES, block_bytes)):
            if block.bytes >= block_bytes:
                yield from close()
                block = _Block(tokenizer, block.number + 1)
            freqs = block.frequencies(texts)
            yield _rows(0, block.number, len(texts), doc_id=batch.column(0).cast(pa.int64()), n_bytes=pc.binary_length(texts).cast(pa.int64()), freqs=freqs)
        yield from close()

    return encode


def _count(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = memory_for(path)
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            at = memory.number(coded.dictionary)
            n = memory.lengths[at][coded.indices.to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int32())], ["block", "number", "n"])

    return count


def _total(documents: pa.Table, counts: pa.Table) -> pa.Table:
    number, n = (counts.column(k).to_numpy() for k in ("number", "n"))
    by_number = np.zeros(len(n), np.int64)
    by_number[number] = n
    press, totals = zstandard.ZstdDecompressor(), []
    for packed in documents.column("freqs"):
        numbers, freqs = _unpack(press.decompress(packed.as_py()))
        totals.append(int((by_number[numbers] * freqs).sum()))
    return pa.table({"doc_id": documents.column("doc_id"), "n_bytes": documents.column("n_bytes"), "n_tokens": pa.array(totals, pa.int64())})


def count_tokens(docs: DataFrame, tokenizer_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text of ``docs(doc_id, text)``."""
    schema = "doc_id long, n_bytes long, freqs binary, number int, piece string, block long, kind int"
    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("utf8")).mapInArrow(_encode(tokenizer_path, block_bytes), schema)
    encoded = materialise(encoded, "token-blocks", ["kind"])
    pieces = encoded.where("kind = 1").select("block", "number", "piece")
    counts = pieces.repartition("piece").mapInArrow(_count(tokenizer_path), "block long, number int, n int")
    documents = encoded.where("kind = 0").select("block", "doc_id", "n_bytes", "freqs")
    return documents.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_total, "doc_id long, n_bytes long, n_tokens long")
