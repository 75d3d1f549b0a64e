"""Hard-negative mining by segment summary filtering.

Vectors are quantised to integers and cut into segments. For a segment of length
s with means m, m' and population deviations d, d' the inner product lies between
s*m*m' - s*d*d' and s*m*m' + s*d*d' (Cauchy-Schwarz on what is left after
the means). A block of rows stores these summaries at three levels, 1, 4 and 16
segments; an anchor bounds the scores of all rows by the coarsest level, keeps
the rows whose bounds still allow a result, refines those, and takes exact
inner products only of what the finest level leaves.

Anchors are a stated set (every id divisible by ``every``). They meet all rows in
blocks: a task holds one block of rows and one block of anchors. The first pass
finds each anchor's positives, the second, with the positives' scores, the
negatives in their score windows; short lists are merged by windows. Rows are
numbered and written once, and dealt to blocks by that number, so that equal
vectors, labels or ids do not meet in one block.

Edge cases: rows with a null label, a null vector or any null, NaN or infinite
component take no part; shorter vectors count as filled up with zeros; repeated
rows are rows of their own, and a copy of an anchor is another row; rows with
a null id are no anchors and lose every tie; a positive of negative score has no
negatives; empty tables give no rows; components of magnitude above 2**18, whose
scores may not fit a long, raise an error; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Most rows and anchors that meet in one task; tables of fewer rows are dealt in blocks of ``LEAST_ROWS`` at least.
BLOCK_ROWS, BLOCK_ANCHORS, LEAST_ROWS = 1 << 16, 1 << 15, 1 << 12
#: Segments of the summaries, from coarse to fine; vectors are filled up with zeros to a multiple of the last.
LEVELS = (1, 4, 16)
MOST_COMPONENT, NO_ID = 1 << 18, (1 << 63) - 1


def quantised(vector: str) -> Column:
    """Components as floor(256 * x); null where the vector takes no part."""
    bad = f"{vector} IS NULL OR exists({vector}, x -> x IS NULL OR isnan(x) OR abs(double(x)) = double('Infinity'))"
    high = f"exists({vector}, x -> abs(double(x)) > {MOST_COMPONENT}D)"
    return F.expr(f"CASE WHEN {bad} THEN NULL WHEN {high} THEN raise_error('components above {MOST_COMPONENT}') ELSE transform({vector}, x -> CAST(floor(256D * double(x)) AS BIGINT)) END")


class Vectors:
    """Quantised vectors of a block with the summaries of their segments."""

    def __init__(self, table: pa.Table):
        lists = table.column("vector").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
        self.width = int(table.column("width")[0].as_py()) if len(lists) else LEVELS[-1]
        self.exact = np.zeros((len(lists), self.width), np.int64)
        at = np.repeat(np.arange(len(lists)), sizes)
        self.exact[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
        # Doubles hold products of these components exactly up to 2**53; beyond, integers are multiplied.
        most = int(np.abs(self.exact).max(initial=0))
        self.safe = most * most * self.width < 1 << 51
        self.doubles = self.exact.astype(np.float64)
        self.means, self.deviations = [], []
        for n in LEVELS:
            parts = self.doubles.reshape(len(lists), n, self.width // n)
            self.means.append(parts.mean(2))
            self.deviations.append(parts.std(2))

    def bounds(self, level: int, at: np.ndarray, other: Vectors, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that rows ``at`` can have with a row of ``other``, with room for rounding."""
        s = self.width // LEVELS[level]
        middle = s * (self.means[level][at] @ other.means[level][row])
        spread = s * (self.deviations[level][at] @ other.deviations[level][row])
        spread = spread + 0.5 + 1e-9 * (np.abs(middle) + spread + s * (np.abs(self.means[level][at]) @ np.abs(other.means[level][row])))
        return middle - spread, middle + spread

    def scores(self, at: np.ndarray, other: Vectors, row: int) -> np.ndarray:
        if self.safe and other.safe:
            return np.rint(self.doubles[at] @ other.doubles[row]).astype(np.int64)
        return self.exact[at] @ other.exact[row]


def _nth(values: np.ndarray, n: int) -> float:
    """The n-th greatest value; minus infinity if there are fewer."""
    return float(np.partition(values, len(values) - n)[len(values) - n]) if len(values) >= n else -np.inf


def _positives(k: int):
    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            vectors, asked = Vectors(rows), Vectors(anchors)
            number, ids, labels = (rows.column(c).to_numpy() for c in ("row", "id", "label"))
            by_label = np.argsort(labels, kind="stable")
            sorted_labels = labels[by_label]
            for i, (own, label) in enumerate(zip(anchors.column("row").to_numpy(), anchors.column("label").to_numpy(), strict=True)):
                at = by_label[np.searchsorted(sorted_labels, label) : np.searchsorted(sorted_labels, label, "right")]
                at = at[number[at] != own]
                for level in range(len(LEVELS)):
                    if len(at) <= k:
                        break
                    low, high = vectors.bounds(level, at, asked, i)
                    at = at[high >= _nth(low, k)]
                score = vectors.scores(at, asked, i)
                best = np.lexsort((number[at], ids[at], -score))[:k]
                out.append((np.full(len(best), own), number[at[best]], ids[at[best]], score[best]))
        return _table(out, ("anchor", "positive", "positive_id", "positive_score"))

    return search


def _negatives(k: int, least: int, most: int):
    """Rows of other labels whose score lies between ``least`` and ``most`` hundredths of the positive's."""

    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and anchors.num_rows:
            vectors, asked = Vectors(rows), Vectors(anchors)
            number, ids, labels = (rows.column(c).to_numpy() for c in ("row", "id", "label"))
            everyone = np.arange(len(number))
            for i, (own, label, wanted) in enumerate(zip(anchors.column("row").to_numpy(), anchors.column("label").to_numpy(), anchors.column("positives").to_pylist(), strict=True)):
                windows = [(w["positive"], -(-least * w["positive_score"] // 100), most * w["positive_score"] // 100) for w in wanted]
                windows = [w for w in windows if w[1] <= w[2]]
                at = everyone[labels != label] if windows else everyone[:0]
                for level in range(len(LEVELS)):
                    if not len(at):
                        break
                    low, high = vectors.bounds(level, at, asked, i)
                    keep = np.zeros(len(at), bool)
                    for _, bottom, top in windows:
                        floor = _nth(low[(low >= bottom) & (high <= top)], k)  # so many rows of the window surely reach it
                        keep |= (high >= max(bottom, floor)) & (low <= top)
                    at = at[keep]
                if not len(at):
                    continue
                score = vectors.scores(at, asked, i)
                order = np.lexsort((number[at], ids[at], -score))
                ranked = score[order]
                for positive, bottom, top in windows:
                    best = order[np.searchsorted(-ranked, -top) : np.searchsorted(-ranked, -bottom, "right")][:k]
                    out.append((np.full(len(best), own), np.full(len(best), positive), number[at[best]], ids[at[best]], score[best]))
        return _table(out, ("anchor", "positive", "negative", "negative_id", "negative_score"))

    return search


def _table(parts: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> pa.Table:
    columns = zip(*parts, strict=True) if parts else [[np.zeros(0, np.int64)]] * len(names)
    return pa.table({n: pa.array(np.concatenate(c).astype(np.int64)) for n, c in zip(names, columns, strict=True)})


def _meet(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int, search, schema: str) -> DataFrame:
    """Every block of rows with every block of anchors."""

    def blocks(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def own(n: int) -> Column:
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    dealt = rows.withColumn("row_block", own(row_blocks)).withColumn("anchor_block", blocks(anchor_blocks))
    anchors = anchors.select(*(F.col(c).alias(c) for c in anchors.columns))  # columns of their own: both sides come from one table
    asked = anchors.withColumn("anchor_block", own(anchor_blocks)).withColumn("row_block", blocks(row_blocks))
    return dealt.groupBy("row_block", "anchor_block").cogroup(asked.groupBy("row_block", "anchor_block")).applyInArrow(search, schema)


def mine_hard_negatives(
    rows: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100, least: int = 80, most: int = 100, id_col: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors: rows whose id is divisible by ``every``. Positives: the best other rows of an anchor's label. Per anchor and
    positive: the best rows of other labels with a score of ``least`` to ``most`` hundredths of the positive's score.
    """
    taken = rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label).cast("long").alias("label"), quantised(vector).alias("vector"))
    taken = materialise(taken.where("label IS NOT NULL AND vector IS NOT NULL"), "negatives-rows")
    is_anchor = (F.col("id") % every == 0) & (F.col("id") != NO_ID)
    found = taken.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(F.size("vector")).alias("width")).first()
    width = max(1, -(-(found.width or 1) // LEVELS[-1])) * LEVELS[-1]
    taken = taken.withColumn("width", F.lit(width))
    anchors = taken.where(is_anchor)
    parallel = taken.sparkSession.sparkContext.defaultParallelism
    row_blocks = max(1, -(-found.n // BLOCK_ROWS), min(2 * parallel, -(-found.n // LEAST_ROWS)))
    anchor_blocks = max(1, -(-found.anchors // BLOCK_ANCHORS))

    near = _meet(taken, anchors, row_blocks, anchor_blocks, _positives(positives), "anchor long, positive long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive"))
    near = materialise(near.withColumn("place", place).where(F.col("place") <= positives).drop("place"), "negatives-positives")
    wanted = near.groupBy("anchor").agg(F.collect_list(F.struct("positive", "positive_score")).alias("positives"))
    asked = anchors.join(wanted, anchors.row == wanted.anchor).drop("anchor")

    hard = _meet(taken, asked, row_blocks, anchor_blocks, _negatives(negatives, least, most), "anchor long, positive long, negative long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative_id", "negative"))
    hard = hard.withColumn("rank", rank).where(F.col("rank") <= negatives)
    ids = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return hard.join(near, ["anchor", "positive"]).join(ids, "anchor").select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")
