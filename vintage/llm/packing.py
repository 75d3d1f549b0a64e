"""Sum-of-squares packing of tokenised documents into training windows.

Each partition packs its own documents in one pass and shares nothing, so no row
is shuffled and a lost task repeats with the same result. A document first fills
whole windows; what remains is placed by the sum-of-squares rule: among all fill
levels with room (and a new window) take the one after which the sum over levels
of (number of partly filled windows)^2 is least, read from one array indexed by
level. When the partition ends, the windows still open are merged: the emptiest
give their pieces, cut where needed, to the fullest, and the one that is left is
stored as windows whose lengths are powers of two, which need no padding.

Edge cases: a null or empty text consists of the end id alone; a null ``doc_id``
is kept; repeated rows are packed each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import memory_for
from .common import text_slices, utf8

WINDOW = 4096
#: Text bytes tokenised at a time; bounds a worker's arrays of token ids.
TEXT_BYTES = 8 << 20
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Fill levels of open windows: ``place(size)`` gives the level to fill, 0 for a new window."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)  # windows at each level; 0 and the full level stay 0

    def place(self, size: int) -> int:
        last = self.window - size
        # Moving a window from h to h + size changes the sum of squares by
        # 2 * (count[h + size] - count[h]) + 2; opening one by 2 * count[size] + 1;
        # filling one up removes a square: -2 * count[h] + 1.
        change = 2 * (self.count[size:] - self.count[: last + 1]) + 2
        change[0] -= 1
        change[last] -= 1
        change[1:][self.count[1 : last + 1] == 0] = np.iinfo(np.int64).max
        level = int(change.argmin())
        if level:
            self.count[level] -= 1
        if level + size < self.window:
            self.count[level + size] += 1
        return level


class _Packer:
    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.rule = SumOfSquares(window)
        self.open: dict[int, list[list[tuple]]] = {}  # level -> windows, each a list of pieces
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        for at in range(0, whole, self.window):
            self.emit([(doc, at, ids[at : at + self.window], len(ids))])
        if whole == len(ids):
            return
        piece = (doc, whole, ids[whole:].copy(), len(ids))  # an open piece must not keep its whole document
        size = len(ids) - whole
        level = self.rule.place(size)
        pieces = self.open[level].pop() if level else []
        pieces.append(piece)
        if level + size == self.window:
            self.emit(pieces)
        else:
            self.open.setdefault(level + size, []).append(pieces)

    def finish(self) -> None:
        """Fill the fullest open windows with pieces of the emptiest, cut to fit; store what is left."""
        windows = [(level, pieces) for level in sorted(self.open, reverse=True) for pieces in self.open[level]]
        first, last = 0, len(windows) - 1
        while first < last:
            level, pieces = windows[first]
            donor_level, donor = windows[last]
            doc, start, ids, total = donor.pop()
            moved = min(self.window - level, len(ids))
            pieces.append((doc, start, ids[:moved], total))
            if moved < len(ids):
                donor.append((doc, start + moved, ids[moved:], total))
            windows[first], windows[last] = (level + moved, pieces), (donor_level - moved, donor)
            if level + moved == self.window:
                self.emit(pieces)
                first += 1
            if donor_level == moved:
                last -= 1
        if first == last:
            self.tail(windows[first][1])

    @staticmethod
    def cut(pieces: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
        """The first ``size`` tokens of the pieces, and the rest."""
        head, rest = [], list(pieces)
        while size and rest:
            doc, start, ids, total = rest.pop(0)
            head.append((doc, start, ids[:size], total))
            if len(ids) > size:
                rest.insert(0, (doc, start + size, ids[size:], total))
            size -= len(head[-1][2])
        return head, rest

    def tail(self, pieces: list[tuple]) -> None:
        left = sum(len(p[2]) for p in pieces)
        while left:
            size = min(self.window, 1 << (left.bit_length() - 1))
            head, pieces = self.cut(pieces, size)
            self.emit(head)
            left -= size


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in PIECE_SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _pack(path: str, end_id: int, window: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = memory_for(path)
        packer = _Packer(window, TaskContext.get().partitionId() << 36)
        for batch, texts in text_slices(batches, "utf8", TEXT_BYTES):
            ids, lengths = memory.token_ids(texts)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            for doc, a, b in zip(batch.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                packer.add(doc, np.append(ids[a:b], np.uint32(end_id)))
            yield _batch(packer.rows)
            packer.rows = []
        packer.finish()
        yield _batch(packer.rows)

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: which tokens of the document lie where in which sequence."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("utf8")).mapInArrow(_pack(tokenizer_path, end_id, window), PIECE_SCHEMA)
