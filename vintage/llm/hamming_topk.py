"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are the signs of up to 64 vector components. Rows of equal codes form one
entry with their ``k + 1`` smallest ids, so that a code which a third of all rows
share costs one entry. Codes are dealt into blocks of bounded size; within a
block every segment of the code has a bucket index. A query probes buckets at
growing segment radius, one segment at a time: once the first ``j + 1`` of ``m``
segments are searched to radius ``s`` and the rest to ``s - 1``, every code within
``m * s + j`` bits is verified. It stops when that bound reaches the distance of
its k-th verified row, or a bound that a sample of real rows proves. The blocks'
short lists are merged per query.

The query set is stated (every id divisible by ``every``) and meets all rows in
blocks; a task holds one block of codes and one block of queries.

Edge cases: null vectors are neither queries nor answers; null components count
as 0 and a component is set when it is above 0; ties are decided by the smaller
id; a query is not its own answer, but its copies are; with fewer than k other
rows all are returned; an empty table gives no rows; repeated ids are rows of
their own; vectors of over 64 components raise an error.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Codes and queries that meet in one task.
BLOCK_CODES, BLOCK_QUERIES = 1 << 17, 1 << 12
#: Distinct codes of the sample that bounds the distance of the k-th row from above.
SAMPLE_CODES = 512
BITS = 64


def sign_code(vector: str) -> Column:
    """The signs of an array column as the bits of a long; null for null."""
    return F.expr(
        f"CASE WHEN size({vector}) > {BITS} THEN raise_error('vectors of over {BITS} components') "
        f"ELSE aggregate(transform({vector}, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b) END"
    )


class BucketIndex:
    """Codes with one bucket table per segment."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        bits = int(np.clip(np.log2(max(len(codes), 2)).round(), 8, 16))
        m = -(-BITS // bits)
        edges = np.linspace(0, BITS, m + 1).round().astype(int)
        self.segments = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            value = ((codes >> np.uint64(a)) & np.uint64((1 << int(b - a)) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            starts = np.searchsorted(value[order], np.arange((1 << int(b - a)) + 1))
            self.segments.append((int(a), int(b - a), order, starts))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    def probes(self, width: int, radius: int) -> np.ndarray:
        """All values of a segment with so many bits set."""
        if (width, radius) not in self.masks:
            self.masks[width, radius] = np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)
        return self.masks[width, radius]

    def search(self, query: int, weight: np.ndarray, need: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of verified codes, among them all up to the distance at which ``need`` rows are reached.

        ``weight``: rows per code. ``bound``: a distance within which that many rows are known to exist.
        """
        m, q = len(self.segments), np.uint64(query)
        seen = np.zeros(len(self.codes), bool)
        rows_at = np.zeros(BITS + 1, np.int64)
        found, distances = [], []
        for radius in range(max(w for _, w, _, _ in self.segments) + 1):
            for j, (shift, width, order, starts) in enumerate(self.segments):
                if radius <= width:
                    values = int((q >> np.uint64(shift)) & np.uint64((1 << width) - 1)) ^ self.probes(width, radius)
                    first, n = starts[values], starts[values + 1] - starts[values]
                    first, n = first[n > 0], n[n > 0]
                    if len(n):
                        at = order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                        at = at[~seen[at]]
                        seen[at] = True
                        d = np.bitwise_count(self.codes[at] ^ q).astype(np.int64)
                        near = d <= bound
                        found.append(at[near])
                        distances.append(d[near])
                        rows_at += np.bincount(d, weight[at], minlength=BITS + 1).astype(np.int64)
                reached = np.flatnonzero(np.cumsum(rows_at) >= need)
                if m * radius + j >= min(bound, int(reached[0]) if len(reached) else BITS):
                    return np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(distances or [np.zeros(0, np.int64)])
        return np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(distances or [np.zeros(0, np.int64)])


def _search(need: int):
    def search(codes: pa.Table, queries: pa.Table) -> pa.Table:
        code = codes.column("code").to_numpy().view(np.uint64)
        lowest, weight = codes.column("lowest").to_numpy(), codes.column("n").to_numpy()
        out_q, out_c, out_d = [], [], []
        if len(code):
            index = BucketIndex(code)
            for query, bound in zip(queries.column("query").to_numpy(), queries.column("bound").to_numpy(), strict=True):
                at, d = index.search(int(query.view(np.uint64)), weight, need, int(bound))
                order = np.lexsort((lowest[at], d))[:need]
                out_q.append(np.full(len(order), query))
                out_c.append(code[at[order]].view(np.int64))
                out_d.append(d[order])
        empty = [np.zeros(0, np.int64)]
        return pa.table({"query": np.concatenate(out_q or empty), "code": np.concatenate(out_c or empty), "distance": np.concatenate(out_d or empty).astype(np.int32)})

    return search


def _bounds(sample: list[tuple[int, int]], need: int):
    """Column function on a query code: distance within which the sampled codes alone have ``need`` rows; all bits, if they have not."""
    codes = np.array([c for c, _ in sample], np.int64).view(np.uint64)
    weight = np.array([n for _, n in sample], np.int64)

    def bounds(batches):
        for batch in batches:
            out = []
            for q in batch.column("query").to_numpy().view(np.uint64):
                rows = np.bincount(np.bitwise_count(codes ^ q), weight, minlength=BITS + 1)[: BITS + 1] if len(codes) else np.zeros(1)
                reached = np.flatnonzero(np.cumsum(rows) >= need)
                out.append(int(reached[0]) if len(reached) else BITS)
            yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array(out, pa.int32())], ["query", "bound"])

    return bounds


def top_k(vectors: DataFrame, k: int = 10, every: int = 20, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, neighbour_id, distance, place``: for each row whose id is divisible by ``every`` its k nearest other rows."""
    need = k + 1  # a query meets itself
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), sign_code(vector).alias("code")).where("code IS NOT NULL AND id IS NOT NULL")
    by_code = Window.partitionBy("code").orderBy("id")
    ids = rows.withColumn("place", F.row_number().over(by_code)).where(F.col("place") <= need).select("code", "id")
    codes = rows.groupBy("code").agg(F.count("*").alias("n"), F.min("id").alias("lowest"))
    queries = rows.where(F.col("id") % every == 0)
    n_codes = codes.count()
    code_blocks = max(1, -(-n_codes // BLOCK_CODES))
    query_codes = queries.select(F.col("code").alias("query")).distinct()
    query_blocks = max(1, -(-query_codes.count() // BLOCK_QUERIES))
    sample = [(r.code, r.n) for r in codes.orderBy(F.xxhash64("code"), "code").limit(SAMPLE_CODES).collect()]

    def blocks(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    dealt = codes.withColumn("code_block", F.pmod(F.xxhash64("code"), F.lit(code_blocks)).cast("int")).withColumn("query_block", blocks(query_blocks))
    asked = query_codes.mapInArrow(_bounds(sample, need), "query long, bound int")
    asked = asked.withColumn("query_block", F.pmod(F.xxhash64("query"), F.lit(query_blocks)).cast("int")).withColumn("code_block", blocks(code_blocks))
    near = dealt.groupBy("code_block", "query_block").cogroup(asked.groupBy("code_block", "query_block")).applyInArrow(_search(need), "query long, code long, distance int")
    lists = near.join(ids, "code")
    best = Window.partitionBy("query").orderBy("distance", "id")
    lists = lists.withColumn("place", F.row_number().over(best)).where(F.col("place") <= need).select("query", "id", "distance")
    pairs = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(lists, "query").where("query_id <> id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return pairs.withColumn("place", place).where(F.col("place") <= k).select("query_id", F.col("id").alias("neighbour_id"), "distance", "place")
