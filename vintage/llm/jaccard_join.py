"""Exact n-gram Jaccard join with a prefix tree, down to connected groups of documents.

Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of
word n-grams (64-bit hashes). Equal sets form one class; only classes are
compared. No step forms all pairs of a group.

1. *Exchange.* All sets are ordered by hash. A fixed share of the hash space is
   the first tier. A class sends its n-grams of the first tier (at least as many
   as its prefix needs) to buckets of the hash, packed as arrays. A bucket finds
   how many classes have an n-gram and sends those that two or more have back to
   buckets of the class. An n-gram that one map task alone sees in HEAVY classes
   is known to be frequent there and skips the bucket but for one marker, so that
   a passage of very many documents does not pile up in one task.
2. *Prefix filter.* In the order (first tier by rising frequency, then the rest
   by hash) a set of n that links with anything shares one of its first
   n - ceil(percent * n / 100) + 1 n-grams with it. N-grams of one class come
   first and match nothing; most documents consist of them and drop out here.
3. *Candidate groups.* Classes that share a prefix n-gram are connected (star
   edges to the smallest class, then contraction rounds in the shared folder).
   Each class lies in one candidate group, so that sets travel once. The larger
   the table, the more short sets share n-grams by chance, until such sharing
   strings most of them together. A crowded group therefore goes through steps 1
   to 3 again by itself: with all n-grams of its sets and their frequency in the
   group, prefixes are the rarest quarter of a set, and groups fall apart. This is
   repeated for what stays crowded while that halves it.
4. *Prefix tree.* Within a group, or a block of a large one, sets are stored in a
   tree in one global order, frequent n-grams first, so that near copies share
   paths. A set walks the tree, counting the overlap of shared paths once;
   subtrees fall away when the n-grams left cannot reach the needed overlap, or
   when all their sets are already connected with the walking one.
5. *Large groups.* Blocks of a large group are merged: first a few members of
   each component meet, then members outside the largest component meet every
   block. Every pair of sets of one group that is not yet connected is compared.

Edge cases: null, empty or blank texts have no n-grams, link with nothing and
are their own component; a text of fewer words than ``n`` is one n-gram; a null
``doc_id`` keeps its row and links like any other, its component is the smallest
id that links reach, null if they reach none; repeated rows fall into one class; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, remembered, slices, utf8

N_WORDS = 5
PERCENT = 75
#: Share of the hash space that forms the first tier; above 1 - PERCENT / 100, so that prefixes lie within it.
FIRST_TIER = 0.4
#: An n-gram of so many classes is simply frequent: the order does not tell such n-grams apart by frequency.
HEAVY = 64
#: The same among the sets of crowded groups, where the order tells more frequent n-grams apart by sixteenths of a doubling.
HEAVY_IN_CROWD = 4_096
#: Sets of a candidate group above which it is crowded.
CROWDED_SETS = 128
#: Entries of a bucket of the exchange; with it grows a task's memory.
BUCKET_ENTRIES = 700_000
#: Words whose hashes a worker remembers before it starts afresh; affects speed only.
REMEMBERED = 150_000
#: Sets, and bytes of sets, of a block of the prefix tree.
BLOCK_SETS, BLOCK_BYTES = 2_000, 64 << 20
#: Bytes of sets of small candidate groups that share a task.
TASK_BYTES = 8 << 20
#: Members of each component that meet first when blocks are merged.
DELEGATES = 4
#: Rounds in which delegates meet before the exhaustive step.
MEETINGS = 2
#: Bytes of candidate ids that are broadcast to filter texts; more are joined by shuffle.
BROADCAST_BYTES = 32 << 20

_MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(f"shingle {i}") | 1 for i in range(64)], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], n: int = N_WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    hashes_of = remembered("word hashes", _WordHashes)
    if len(hashes_of) > REMEMBERED:
        hashes_of.clear()
    words = [t.lower().split() for t in texts]
    sizes = [len(w) for w in words]
    hashes = np.fromiter(map(hashes_of.__getitem__, chain.from_iterable(words)), np.uint64, sum(sizes))
    grams = np.zeros(0, np.uint64)
    if len(hashes) >= n:
        grams = _mix(sum(hashes[i : len(hashes) - n + 1 + i] * _MULTIPLIERS[i] for i in range(n)))
    out, at = [], 0
    for size in sizes:
        if size >= n:
            out.append(np.unique(grams[at : at + size - n + 1]))
        elif size:  # fewer words: the sequence is one n-gram, told apart by its length
            out.append(_mix((hashes[at : at + size] * _MULTIPLIERS[:size]).sum(dtype=np.uint64, keepdims=True) + _MULTIPLIERS[63 - size]))
        else:
            out.append(hashes[:0])
        at += size
    return out


def _class_of(grams: np.ndarray) -> int:
    """A class id: the signed 64-bit digest of the whole set, never 0."""
    return int.from_bytes(xxhash.xxh3_64_digest(grams.tobytes()), "little", signed=True) or 1


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


# --- packets: many n-grams of many classes as one binary value ------------------------------

_HEAD = np.dtype([("cls", "<i8"), ("n", "<u4"), ("tier", "<u4"), ("count", "<u4")])


def _pack(head: np.ndarray, grams: np.ndarray, ranks: np.ndarray | None = None) -> bytes:
    small = head.tobytes() + (b"" if ranks is None else ranks.astype(np.uint8).tobytes())
    small = zstandard.ZstdCompressor(level=1).compress(small)
    return len(small).to_bytes(4, "little") + len(head).to_bytes(4, "little") + small + grams.tobytes()


def _unpack(packet: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n_small, n_head = int.from_bytes(packet[:4], "little"), int.from_bytes(packet[4:8], "little")
    small = zstandard.ZstdDecompressor().decompress(packet[8 : 8 + n_small])
    head = np.frombuffer(small[: n_head * _HEAD.itemsize], _HEAD)
    return head, np.frombuffer(packet[8 + n_small :], "<u8"), np.frombuffer(small[n_head * _HEAD.itemsize :], np.uint8)


def _by_bucket(bucket: np.ndarray, cls: np.ndarray, n: np.ndarray, tier: np.ndarray, grams: np.ndarray, ranks: np.ndarray | None) -> Iterator[tuple[int, bytes]]:
    """One packet per bucket; entries of a class lie next to each other and keep that order."""
    order = np.argsort(bucket, kind="stable")
    bucket, cls, n, tier, grams = bucket[order], cls[order], n[order], tier[order], grams[order]
    ranks = None if ranks is None else ranks[order]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a == b:
            continue
        first = np.concatenate([[0], np.flatnonzero(np.diff(cls[a:b])) + 1])
        head = np.zeros(len(first), _HEAD)
        head["cls"], head["n"], head["tier"] = cls[a:b][first], n[a:b][first], tier[a:b][first]
        head["count"] = np.diff(np.append(first, b - a))
        yield int(bucket[a]), _pack(head, grams[a:b], None if ranks is None else ranks[a:b])


def _rank(frequency: np.ndarray, heavy: int) -> np.ndarray:
    """The place of a frequency in the order of n-grams: itself up to HEAVY, then by its logarithm, the same from ``heavy`` on."""
    frequency = np.minimum(frequency, heavy)
    return np.where(frequency <= HEAVY, frequency, HEAVY + (16 * np.log2(np.maximum(frequency, HEAVY) / HEAVY)).astype(np.int64))


_EXCHANGE = "bucket long, packet binary, doc_id long, cls long, n int"
_RETURN = "kind int, bucket long, packet binary, doc_id long, cls long, n int"


def _record(names: str, rows: int, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    arrays = [columns[k] if isinstance(columns.get(k), pa.Array) else pa.array(columns[k], kinds[t]) if k in columns else pa.nulls(rows, kinds[t]) for k, t in fields]
    return pa.RecordBatch.from_arrays(arrays, [k for k, _ in fields])


def _flush(sets: list[tuple[int, int, int, np.ndarray]], buckets: int, heavy_at: int) -> Iterator[pa.RecordBatch]:
    """Packets of ``(class, size, n-grams in the first tier, n-grams to send)``. Buckets: 0.. n-grams, ``2 * buckets``.. known frequent n-grams."""
    if not sets:
        return
    lengths = np.array([len(g) for *_, g in sets])
    cls, n, tier = (np.repeat(np.array([s[i] for s in sets], t), lengths) for i, t in ((0, np.int64), (1, np.int64), (2, np.int64)))
    grams = np.concatenate([g for *_, g in sets])
    ordered = np.sort(grams)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    heavy = ordered[starts[np.diff(np.append(starts, len(ordered))) >= heavy_at]]
    at = np.searchsorted(heavy, grams) if len(heavy) else None
    known = heavy[np.minimum(at, len(heavy) - 1)] == grams if len(heavy) else np.zeros(len(grams), bool)
    rest = ~known
    packets = list(_by_bucket((grams[rest] % np.uint64(buckets)).astype(np.int64), cls[rest], n[rest], tier[rest], grams[rest], None))
    if len(heavy):
        zero = np.zeros(len(heavy), np.int64)
        packets += _by_bucket((heavy % np.uint64(buckets)).astype(np.int64), zero, zero, zero, heavy, None)
        ranks = _rank(np.full(int(known.sum()), heavy_at), heavy_at)
        packets += [(2 * buckets + b, p) for b, p in _by_bucket(cls[known] % buckets, cls[known], n[known], tier[known], grams[known], ranks)]
    yield _record(_EXCHANGE, len(packets), bucket=[b for b, _ in packets], packet=[p for _, p in packets])


def _send(n_words: int, percent: int, buckets: int):
    """Map side of the exchange: packets, and document rows in buckets ``buckets``.. ."""
    cutoff = np.uint64(int(FIRST_TIER * 2**64))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen, entries, slice_no = [], set(), 0, TaskContext.get().partitionId() * 7919
        for batch, texts in slices(batches, "utf8"):
            classes, sizes = [], []
            for grams in shingle_sets(texts, n_words):
                cls = _class_of(grams) if len(grams) else None
                classes.append(cls)
                sizes.append(len(grams))
                if cls is None or cls in seen:
                    continue
                seen.add(cls)
                tier = int(np.searchsorted(grams, cutoff))
                sets.append((cls, len(grams), tier, grams[: max(tier, prefix_length(len(grams), percent))]))
                entries += len(sets[-1][-1])
            slice_no += 1
            yield _record(_EXCHANGE, len(texts), bucket=[buckets + slice_no % buckets] * len(texts), doc_id=batch.column(0), cls=classes, n=sizes)
            if entries > BUCKET_ENTRIES:
                yield from _flush(sets, buckets, HEAVY)
                sets, seen, entries = [], set(), 0
        yield from _flush(sets, buckets, HEAVY)

    return send


def _send_sets(buckets: int):
    """Map side of the exchange within candidate groups: all n-grams of the sets of rows ``cls, part, grams``, told apart by group."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, entries = [], 0
        for batch in batches:
            for cls, part, packed in zip(batch.column("cls").to_pylist(), batch.column("part").to_numpy(), batch.column("grams"), strict=True):
                grams = _mix(np.frombuffer(packed.as_py(), "<u8") ^ part.view(np.uint64))
                sets.append((cls, len(grams), len(grams), grams))
                entries += len(grams)
                if entries > BUCKET_ENTRIES:
                    yield from _flush(sets, buckets, HEAVY_IN_CROWD)
                    sets, entries = [], 0
        yield from _flush(sets, buckets, HEAVY_IN_CROWD)

    return send


def _bucket(buckets: int, heavy: int = HEAVY):
    """A bucket of the exchange: n-grams of two or more classes go on to buckets of the class."""

    def bucket(key: tuple, table: pa.Table) -> pa.Table:
        key, rows = key[0].as_py(), table.num_rows
        if key >= 2 * buckets:
            return pa.Table.from_batches([_record(_RETURN, rows, kind=[1] * rows, bucket=[key - 2 * buckets] * rows, packet=table.column("packet").combine_chunks())])
        if key >= buckets:
            columns = {k: table.column(k).combine_chunks() for k in ("doc_id", "cls", "n")}
            return pa.Table.from_batches([_record(_RETURN, rows, kind=[0] * rows, **columns)])
        packets = [_unpack(p) for p in table.column("packet").to_pylist()]
        head = np.concatenate([h for h, _, _ in packets])
        grams = np.concatenate([g for _, g, _ in packets])
        packets.clear()
        row = np.repeat(np.arange(len(head), dtype=np.int32), head["count"])
        order = np.argsort(grams)
        grams, row = grams[order], row[order]
        shared = np.zeros(len(grams), bool)
        same = grams[1:] == grams[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        grams, row = grams[shared], row[shared]
        cls = head["cls"][row]
        order = np.lexsort((cls, grams))
        grams, cls, row = grams[order], cls[order], row[order]
        once = np.ones(len(grams), bool)  # a class may come from several tasks
        once[1:] = (grams[1:] != grams[:-1]) | (cls[1:] != cls[:-1])
        grams, cls, row = grams[once], cls[once], row[once]
        starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        runs = np.diff(np.append(starts, len(grams)))
        frequency = np.add.reduceat(np.where(cls == 0, heavy, 1), starts) if len(grams) else starts
        rank = np.repeat(_rank(frequency, heavy), runs)
        keep = (rank > 1) & (cls != 0)
        grams, cls, row, rank = grams[keep], cls[keep], row[keep], rank[keep]
        order = np.argsort(cls, kind="stable")
        grams, cls, row, rank = grams[order], cls[order], row[order], rank[order]
        out = list(_by_bucket(cls % buckets, cls, head["n"][row].astype(np.int64), head["tier"][row].astype(np.int64), grams, rank))
        return pa.Table.from_batches([_record(_RETURN, len(out), kind=[1] * len(out), bucket=[b for b, _ in out], packet=[p for _, p in out])])

    return bucket


def _prefixes(percent: int, first_tier: float = FIRST_TIER):
    """A bucket of classes: the prefix n-grams, rarest first, of classes that may link at all. ``first_tier`` 1: all n-grams were sent."""
    cutoff = np.uint64(int(first_tier * 2**64)) if first_tier < 1 else None

    def prefixes(table: pa.Table) -> pa.Table:
        packets = [_unpack(p) for p in table.column("packet").to_pylist()]
        head = np.concatenate([h for h, _, _ in packets])
        grams, ranks = np.concatenate([g for _, g, _ in packets]), np.concatenate([r for _, _, r in packets])
        cls, n, tier = (np.repeat(head[k].astype(np.int64), head["count"]) for k in ("cls", "n", "tier"))
        second = grams >= cutoff if cutoff is not None else np.zeros(len(grams), bool)
        order = np.lexsort((grams, np.where(second, 0, ranks), second, cls))
        grams, cls, n, tier, second = grams[order], cls[order], n[order], tier[order], second[order]
        once = np.ones(len(cls), bool)
        once[1:] = (cls[1:] != cls[:-1]) | (grams[1:] != grams[:-1])
        grams, cls, n, tier, second = grams[once], cls[once], n[once], tier[once], second[once]
        starts = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])) if len(cls) else np.zeros(0, np.int64)
        shared = np.add.reduceat((~second).astype(np.int64), starts) if len(cls) else starts
        runs = np.diff(np.append(starts, len(cls)))
        place = np.arange(len(cls)) - np.repeat(starts, runs)
        length = n - (percent * n + 99) // 100 + 1
        alone = tier - np.repeat(shared, runs)  # n-grams of the first tier that no other class has
        # Where the prefix goes beyond the first tier, exactly its second-tier n-grams were sent.
        keep = second | (place < length - alone)
        return pa.table({"gram": pa.array(grams[keep].view(np.int64)), "cls": pa.array(cls[keep])})

    return prefixes


# --- connected components ------------------------------------------------------------------


def _joined(rows: DataFrame, table: DataFrame, n: int, key: str, how: str = "inner") -> DataFrame:
    """Join with a table of ``n`` rows of two numbers: broadcast while that is few bytes, by shuffle beyond."""
    return rows.join(F.broadcast(table) if n * 24 <= BROADCAST_BYTES else table, key, how)


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``: the smallest node that it is connected with.

    Contraction: every node points to its smallest neighbour, followed twice;
    edges between what is left go on. Rounds fall with the logarithm of the longest path.
    """
    edges = materialise(edges.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), "edges")
    labels = edges.selectExpr("a node", "b root").limit(0)
    first = True
    while n := edges.count():
        both = edges.select("a", "b").unionByName(edges.selectExpr("b a", "a b"))
        parent = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).selectExpr("node", "least(node, low) parent"), "parents")
        step = _joined(parent, parent.selectExpr("node parent", "parent root"), 2 * n, "parent").select("node", "root")
        if first:
            labels = step
        else:
            labels = _joined(labels, step.selectExpr("node root", "root next"), 2 * n, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        first = False
        edges = _joined(_joined(edges, step.selectExpr("node a", "root ra"), 2 * n, "a"), step.selectExpr("node b", "root rb"), 2 * n, "b")
        edges = materialise(edges.where("ra <> rb").selectExpr("least(ra, rb) a", "greatest(ra, rb) b").distinct(), "edges")
    return materialise(labels, "labels")


# --- the prefix tree -----------------------------------------------------------------------


class _Node:
    __slots__ = ("segment", "children", "sets", "below", "smallest", "label", "mixed")

    def __init__(self, segment: np.ndarray, below: int, smallest: int, label: int):
        self.segment, self.children, self.sets = segment, {}, []
        self.below, self.smallest, self.label, self.mixed = below, smallest, label, False


class PrefixTree:
    """Sets as sorted arrays of ranks; ``join`` links a set with those stored before it and stores it."""

    def __init__(self, size: int, percent: int, labels: list[int]):
        self.percent, self.parent = percent, list(labels)
        self.root = _Node(np.zeros(0, np.int64), 0, 1 << 62, -1)
        self.root.mixed = True
        self.member = np.zeros(size + 1, bool)
        self.full: list[int] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def unite(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)

    def uniform(self, node: _Node) -> bool:
        if node.mixed:
            own = self.find(node.label)
            node.mixed = any(self.find(s) != own for s in node.sets) or any(c.mixed or self.find(c.label) != own for c in node.children.values())
        return not node.mixed

    def join(self, i: int, ranks: np.ndarray, full: int) -> None:
        """``full``: the size of the set with the elements that no other set here has."""
        self.full.append(full)
        self.member[ranks] = True
        stack = [(c, 0) for c in self.root.children.values()]
        mine, need = self.find(i), self.percent * full
        while stack:
            node, overlap = stack.pop()
            if self.uniform(node) and self.find(node.label) == mine:
                continue
            segment = node.segment
            overlap += int(np.count_nonzero(self.member[segment])) if len(segment) else 0
            left = len(ranks) - int(np.searchsorted(ranks, segment[-1], "right")) if len(segment) else len(ranks)
            most = overlap + min(left, node.below)
            if (100 + self.percent) * most < need + self.percent * node.smallest:
                continue
            for other in node.sets:
                if self.find(other) != mine and (100 + self.percent) * overlap >= need + self.percent * self.full[other]:
                    self.unite(other, i)
                    mine = self.find(i)
            if node.below:
                stack += [(c, overlap) for c in node.children.values()]
        self.member[ranks] = False
        self.store(i, ranks, full)

    def store(self, i: int, ranks: np.ndarray, full: int) -> None:
        node, at, label = self.root, 0, self.find(i)
        while True:
            if node is not self.root:
                node.smallest, node.below = min(node.smallest, full), max(node.below, len(ranks) - at)
                node.mixed = node.mixed or self.find(node.label) != label
            if at == len(ranks):
                node.sets.append(i)
                return
            child = node.children.get(int(ranks[at]))
            if child is None:
                leaf = _Node(ranks[at:], 0, full, i)
                leaf.sets.append(i)
                node.children[int(ranks[at])] = leaf
                return
            segment = child.segment
            same = min(len(segment), len(ranks) - at)
            differ = np.flatnonzero(segment[:same] != ranks[at : at + same])
            same = int(differ[0]) if len(differ) else same
            if same < len(segment):  # split the path where the sets part
                lower = child
                child = _Node(segment[:same], lower.below + len(segment) - same, lower.smallest, lower.label)
                child.mixed = lower.mixed
                child.children[int(segment[same])] = lower
                lower.segment = segment[same:]
                node.children[int(segment[0])] = child
            node, at = child, at + same


def tree_components(sets: list[np.ndarray], labels: list[int], percent: int = PERCENT) -> list[int]:
    """For each set the smallest index that it is connected with. ``labels``: an earlier or equal index that it is known to be connected with."""
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((values, -counts))
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    ranks = rank[inverse]
    common = int((counts > 1).sum())  # elements of one set alone have the last ranks and overlap with nothing
    tree, at = PrefixTree(common, percent, labels), 0
    for i, s in enumerate(sets):
        own = np.sort(ranks[at : at + len(s)])
        at += len(s)
        tree.join(i, own[: np.searchsorted(own, common)], len(s))
    return [tree.find(i) for i in range(len(sets))]


def _tree_task(percent: int):
    """All candidate groups of a task; rows ``part, cls, label, grams``. Gives for each label that met another the smallest label it is now connected with."""

    def task(table: pa.Table) -> pa.Table:
        part, cls, label = (table.column(k).to_numpy() for k in ("part", "cls", "label"))
        grams = table.column("grams")
        order = np.lexsort((cls, label, part))
        a, b, at = [], [], 0
        while at < len(order):
            end = at
            while end < len(order) and part[order[end]] == part[order[at]]:
                end += 1
            rows = order[at:end]
            rows = rows[np.concatenate([[True], cls[rows][1:] != cls[rows][:-1]])]
            first: dict[int, int] = {}
            known = [first.setdefault(int(label[r]), i) for i, r in enumerate(rows)]
            if len(first) > 1:
                roots = tree_components([np.frombuffer(grams[int(r)].as_py(), "<u8") for r in rows], known, percent)
                # rows are in order of label, so the smallest index of a component has its smallest label
                for own, i in first.items():
                    if roots[i] != i:
                        a.append(own)
                        b.append(int(label[rows[roots[i]]]))
            at = end
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return task


def _sets(n_words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "utf8"):
            cls, grams = batch.column("cls").to_pylist(), shingle_sets(texts, n_words)
            keep = [i for i, g in enumerate(grams) if len(g) and _class_of(g) == cls[i]]
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("cls"), rows.column("part"), pa.array([grams[i].tobytes() for i in keep], pa.binary())], ["cls", "part", "grams"])

    return sets


def _run_trees(rows: DataFrame, percent: int, *keys: str) -> DataFrame:
    # A number of partitions that is stated stays: little data is much work here.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys).groupBy(*keys).applyInArrow(_tree_task(percent), "a long, b long")


def _candidate_groups(prefixes: DataFrame) -> DataFrame:
    """``node, root``: classes that share a prefix n-gram are connected."""
    stars = prefixes.groupBy("gram").agg(F.min("cls").alias("b"), F.max("cls").alias("high")).where("b < high").select("gram", "b")
    return connected(prefixes.join(stars, "gram").selectExpr("cls a", "b"))


def _regrouped(sets: DataFrame, percent: int) -> DataFrame:
    """``sets`` in the candidate groups that full prefixes leave within their groups; sets that are alone then are left out."""
    entries = (sets.agg(F.sum(F.length("grams"))).first()[0] or 0) // 8
    buckets = max(4, -(-entries // BUCKET_ENTRIES))
    back = sets.select("cls", "part", "grams").mapInArrow(_send_sets(buckets), _EXCHANGE).groupBy("bucket").applyInArrow(_bucket(buckets, HEAVY_IN_CROWD), _RETURN)
    prefixes = back.where("kind = 1").select("bucket", "packet").groupBy("bucket").applyInArrow(_prefixes(percent, 1), "gram long, cls long")
    groups = _candidate_groups(materialise(prefixes, "prefixes")).selectExpr("node cls", "root part")
    return materialise(_joined(sets.drop("part"), groups, groups.count(), "cls").select(*sets.columns), "sets")


def _uncrowded(sets: DataFrame, percent: int) -> DataFrame:
    """``sets`` with crowded candidate groups split, while a round halves the sets in them."""
    settled, before = [], None
    while True:
        size = sets.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.length("grams")).alias("volume"))
        crowded = materialise(size.where((F.col("n") > CROWDED_SETS) | (F.col("volume") > BLOCK_BYTES)).select("part", "n"), "crowded")
        groups, n = crowded.agg(F.count("*"), F.sum("n")).first()
        if not groups or before and 2 * n > before:
            break
        parts = crowded.select("part")
        settled.append(_joined(sets, parts, groups, "part", "left_anti").select(*sets.columns))
        sets, before = _regrouped(_joined(sets, parts, groups, "part", "left_semi").select(*sets.columns), percent), n
    for more in settled:
        sets = sets.unionByName(more)
    return sets


def _link_groups(sets: DataFrame, percent: int) -> DataFrame:
    """``cls, root``: within every candidate group ``part``, the smallest class that links connect a class with; classes that are their own root may be left out."""
    def blocks_of(size: Column, volume: Column) -> Column:
        return F.ceil(F.greatest(size / BLOCK_SETS, volume / BLOCK_BYTES)).cast("long")

    sets = _uncrowded(sets, percent)
    count, volume = F.count("*"), F.sum(F.length("grams"))
    sizes = sets.groupBy("part").agg(blocks_of(count, volume).alias("blocks"))
    tasks = max(64, (sets.agg(volume).first()[0] or 0) // TASK_BYTES)
    sets = sets.join(sizes, "part").withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("cls"), F.col("blocks"))).otherwise(F.lit(-1)))
    # Small groups share tasks; a block of a large group is a task. A class lies in one of them, so the links are labels already.
    task = F.when(F.col("blocks") > 1, F.xxhash64("part", "block")).otherwise(F.pmod(F.xxhash64("part"), F.lit(tasks)))
    labels = materialise(_run_trees(sets.withColumn("label", F.col("cls")).withColumn("task", task), percent, "task", "blocks").toDF("cls", "root"), "labels")
    if sizes.where("blocks > 1").isEmpty():
        return labels
    big = sets.where("blocks > 1").join(labels, "cls", "left").withColumn("label", F.coalesce("root", "cls")).drop("root")
    big = materialise(big, "large-groups")

    def merge(found: DataFrame) -> None:
        nonlocal big, labels
        n = found.count()
        big = materialise(_joined(big, found.toDF("label", "next"), n, "label", "left").withColumn("label", F.coalesce("next", "label")).drop("next"), "large-groups")
        moved = found.toDF("root", "next")
        kept = _joined(labels, moved, n, "root", "left").select("cls", F.coalesce("next", "root").alias("root"))
        labels = materialise(kept.unionByName(found.toDF("cls", "root")), "labels")  # a label that moved was its own root before

    # Delegates of each component meet in blocks that change from round to round; what they miss, the last step finds.
    for turn in range(MEETINGS):
        first = Window.partitionBy("part", "label").orderBy(F.xxhash64("cls"), "cls")
        few = big.withColumn("place", F.row_number().over(first)).where(F.col("place") <= DELEGATES)
        few = few.withColumn("task", F.pmod(F.xxhash64(F.lit(turn), "label"), F.col("blocks")))
        found = materialise(_run_trees(few, percent, "part", "task"), "links")
        if found.isEmpty():
            break
        merge(found)
    # What lies outside the largest component of its group meets every block of the group.
    components = big.groupBy("part", "label").agg(F.count("*").alias("m"))
    largest = components.groupBy("part").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").select("part", "main")
    rest = materialise(big.join(largest, "part").where("label <> main").drop("main"), "rest")
    chunks = rest.groupBy("part").agg(blocks_of(count, volume).alias("chunks"))
    home = big.join(chunks, "part").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    away = rest.join(chunks, "part").withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "cls"), F.col("chunks")))
    away = away.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ["part", "block", "chunk", "cls", "label", "grams"]
    found = connected(_run_trees(home.select(*columns).unionByName(away.select(*columns)), percent, "part", "block", "chunk"))
    if not found.isEmpty():
        merge(found.where("node <> root"))
    return labels


# --- the operator --------------------------------------------------------------------------


def _classed(n_words: int):
    """Rows with the class of their text; texts without n-grams have none."""

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "_utf8"):
            cls = [_class_of(g) if len(g) else None for g in shingle_sets(texts, n_words)]
            rows = batch.drop_columns(["_utf8"])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cls, pa.int64())], [*rows.schema.names, "_cls"])

    return classed


def with_class(docs: DataFrame, n_words: int = N_WORDS) -> DataFrame:
    """``docs`` plus ``_cls``: equal sets of n-grams have equal classes; null without n-grams."""
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.withColumn("_utf8", utf8()).mapInArrow(_classed(n_words), f"{schema}, _cls long")


def _grouped(docs: DataFrame, n_words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, cls, n`` and classes ``cls, rep, root``: the smallest id of a class (null if no row of it has one) and the class that names its group."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("utf8"))
    volume = texts.agg(F.sum(F.length("utf8"))).first()[0] or 0
    buckets = max(4, -(-int(volume * FIRST_TIER / 6) // BUCKET_ENTRIES))  # about six bytes to a word
    sent = texts.mapInArrow(_send(n_words, percent, buckets), _EXCHANGE)
    back = sent.groupBy("bucket").applyInArrow(_bucket(buckets), _RETURN)
    back = materialise(back, "shared-grams", ["kind"])
    rows = back.where("kind = 0").select("doc_id", "cls", "n")
    prefixes = back.where("kind = 1").select("bucket", "packet").groupBy("bucket").applyInArrow(_prefixes(percent), "gram long, cls long")
    prefixes = materialise(prefixes, "prefixes")
    groups = _candidate_groups(prefixes)
    classes = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    candidates = materialise(groups.selectExpr("node cls", "root part").join(classes, "cls").select("rep", "cls", "part"), "candidates")
    few = candidates.count() * 24 <= BROADCAST_BYTES
    chosen = texts.join(F.broadcast(candidates) if few else candidates, texts.doc_id == candidates.rep).select("utf8", "cls", "part")
    nameless = candidates.where("rep IS NULL").select("cls", "part")
    if not nameless.isEmpty():  # classes that only rows without an id have: their texts are found by class
        own = with_class(texts.where("doc_id IS NULL").select(F.col("utf8").alias("text")), n_words).withColumnRenamed("_cls", "cls")
        once = own.join(F.broadcast(nameless) if few else nameless, "cls").groupBy("cls", "part").agg(F.any_value("text").alias("text"))
        chosen = chosen.unionByName(once.select(F.col("text").alias("utf8"), "cls", "part"))
    sets = materialise(chosen.mapInArrow(_sets(n_words), "cls long, part long, grams binary"), "sets")
    return rows, classes.join(_link_groups(sets, percent), "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))


def near_duplicates(docs: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for ``docs(doc_id, text)``."""
    rows, roots = _grouped(docs, n_words, percent)
    lowest = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = roots.join(lowest, "root").select("cls", "component_id")
    return rows.join(named, "cls", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_per_group(docs: DataFrame, n_words: int = N_WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of every group of ``docs``, that of the smallest id, with all its columns.

    Rows that repeat a kept id and text are the same document and stay with it. A row without an id goes if its group has a
    document with one; of a group without any id one row stays. Where an id has several texts, each text is judged for itself.
    """
    rows, roots = _grouped(docs, n_words, percent)
    lowest = roots.groupBy("root").agg(F.min("rep").alias("lowest"), F.min("cls").alias("first"))
    named = roots.join(lowest, "root").select("cls", "lowest", "first")
    judged = rows.where("cls IS NOT NULL").join(named, "cls").select("doc_id", "cls", "lowest", "first", F.col("doc_id").eqNullSafe(F.col("lowest")).alias("stays"))
    judged = materialise(judged.where("NOT stays OR doc_id IS NULL"), "judged")
    dropped = judged.where("doc_id IS NOT NULL").select("doc_id", "cls").distinct()
    # An id is dropped whole unless it has another text, which may stay.
    texts = rows.join(dropped.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.count_distinct(F.coalesce("cls", F.lit(0))).alias("texts"))
    texts = materialise(texts, "dropped")
    plain, twice = texts.where("texts = 1").select("doc_id"), texts.where("texts > 1").select(F.col("doc_id").alias("_several"))
    few = texts.count() * 24 <= BROADCAST_BYTES
    kept = docs.join(F.broadcast(plain) if few else plain, docs.doc_id.cast("long") == plain.doc_id, "left_anti").select(*docs.columns)
    nameless = judged.where("doc_id IS NULL")
    if nameless.isEmpty() and twice.isEmpty():
        return kept
    # Rows whose id does not say which text it is are judged by class.
    unsure = F.col("doc_id").isNull() | F.col("_several").isNotNull()
    marked = kept.join(twice, kept.doc_id.cast("long") == F.col("_several"), "left")
    sure = marked.where(~unsure).select(*docs.columns)
    own = with_class(marked.where(unsure).select(*docs.columns), n_words)
    own = own.withColumns({"_id": F.col("doc_id").cast("long"), "_row": F.struct(*docs.columns)}).select("_id", "_cls", "_row")
    with_id = own.where("_id IS NOT NULL").join(dropped.toDF("_id", "_cls"), ["_id", "_cls"], "left_anti").select("_row.*")
    without = own.where("_id IS NULL")
    groups = nameless.select(F.col("cls").alias("_cls"), "lowest", "first").distinct()
    once = without.join(groups.where("lowest IS NULL AND _cls = first").select("_cls"), "_cls")
    once = once.groupBy("_cls").agg(F.any_value("_row").alias("_row")).select("_row.*")
    wordless = without.where("_cls IS NULL").select("_row.*")
    return sure.unionByName(with_id).unionByName(once).unionByName(wordless)
