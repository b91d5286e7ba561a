"""Hard-negative mining by distributed radix selection.

A negative of an (anchor, positive) window is a row of another label whose score lies between a share of the positive's
score and that score.  Of these the first ``k`` are wanted.  Each round counts, for every window that is not settled
yet, its rows by the next digit of their key (distance from the positive's score, then vec_id) and finds the digit in
which the k-th row lies.  Once few rows lie at or before that digit, only these are gathered and ranked: scores are
never sorted or shuffled by window before that, and a vector that thousands of rows hold is told apart by its ids.

Rows and anchors meet in blocks: a task has a block of rows and a block of anchors and multiplies them as matrices.
What is shuffled in a round is each row once for every block of anchors, and counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, outliving, parallelism, scratch

ROWS, ANCHORS, AT_ONCE = 16_384, 4_096, 256  # rows and anchors of a block, anchors whose scores a task holds at once
BITS = 8  # of a digit
FEW = 64  # a window is settled once no more rows than these are to be gathered for it


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, moved_every: int = 7, classes: int = 10) -> DataFrame:
    """vec_id, label, v of the rows that take part: components floor(scale * x), the label of every 7th id moved on by one.

    Rows without an id or a label, without a vector, or with a null or non-finite component take no part.
    """
    finite = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("l"), F.col(vector_col).cast("array<double>").alias("x"))
    label = F.when(F.col("vec_id") % moved_every == 0, (F.col("l") + 1) % classes).otherwise(F.col("l"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("l").isNotNull() & F.col("x").isNotNull() & finite).select("vec_id", label.alias("label"), F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def first_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by the smaller id, in order."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.nonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])[0]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Blocks:
    """Rows and anchors in numbered blocks, and how they meet."""

    def __init__(self, rows: DataFrame, anchor_every: int) -> None:
        spark = rows.sparkSession
        is_anchor = F.col("vec_id") % anchor_every == 0
        self.base = checkpointed(rows.withColumn("uid", F.monotonically_increasing_id()))  # written, so every round sees the same
        size = F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double")))))
        n, self.width, largest, self.least, most, anchors = self.base.agg(F.count("*"), F.max(F.size("v")), size, F.min("vec_id"), F.max("vec_id"), F.count_if(is_anchor)).first()
        self.width = self.width or 0
        self.exact = np.float64 if (largest or 0.0) ** 2 * max(self.width, 1) < 2**53 else object
        self.id_digits = 0 if n == 0 else -(-(most - self.least).bit_length() // BITS)
        self.n_rows, self.n_anchors = max(-(-n // ROWS), min(n, parallelism(spark)), 1), max(-(-anchors // ANCHORS), 1)
        self.rows = self.base.withColumn("r", F.pmod(F.xxhash64("uid"), F.lit(self.n_rows)).cast("int"))
        self.anchors = self.base.where(is_anchor).withColumn("a", F.pmod(F.xxhash64("uid"), F.lit(self.n_anchors)).cast("int"))

    def meet(self, anchors: DataFrame, kernel: Callable[..., Iterator[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
        """Rows of ``kernel(anchor, scores, ids, uids, labels)`` for every anchor and block of rows."""
        width, exact = self.width, self.exact

        def matrix(column: pa.ChunkedArray) -> np.ndarray:
            """A shorter vector goes on with zeros."""
            lists = column.combine_chunks()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.zeros((len(sizes), width), np.int64)
            out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            return out.astype(exact)

        def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
            columns: list[list] = [[] for _ in types]
            if rows.num_rows and anchors.num_rows:
                ids, uids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "uid", "label"))
                left, right = matrix(rows.column("v")), matrix(anchors.column("v"))
                about = anchors.drop_columns(["v"]).to_pylist()
                for lo in range(0, len(about), AT_ONCE):
                    scores = (left @ right[lo : lo + AT_ONCE].T).astype(np.int64).T
                    for anchor, own in zip(about[lo : lo + AT_ONCE], np.ascontiguousarray(scores), strict=True):
                        for found in kernel(anchor, own, ids, uids, labels):
                            for column, values in zip(columns, found, strict=True):
                                column.append(values)
            joined = [np.concatenate([np.atleast_1d(np.asarray(x)) for x in c]) if c else [] for c in columns]
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(joined, types, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

        left = self.rows.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(self.n_anchors - 1))))
        right = anchors.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(self.n_rows - 1))))
        right = right.select(*(F.col(c).alias(c) for c in right.columns))  # both sides come from one table: these are columns of their own
        return left.groupBy("r", "a").cogroup(right.groupBy("r", "a")).applyInArrow(run, schema)


def positives_of(blocks: Blocks, k: int) -> DataFrame:
    """uid, anchor_id, positive_id, ps: the first ``k`` other rows of each anchor's label."""

    def best(anchor: dict, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray) -> Iterator[tuple]:
        same = np.nonzero((labels == anchor["label"]) & (uids != anchor["uid"]))[0]
        at = same[first_rows(scores[same], ids[same], k)]
        if len(at):
            yield np.full(len(at), anchor["uid"]), np.full(len(at), anchor["vec_id"]), ids[at], scores[at]

    found = blocks.meet(blocks.anchors, best, "uid long, anchor_id long, positive_id long, ps long", [pa.int64()] * 4)
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("ps"), "positive_id"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def settle_windows(blocks: Blocks, windows: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(windows with the digits up to which rows are to be gathered, how many digits of a key are distances).

    A window is (uid, ps, reach): its rows have a distance ``ps - score`` of 0 to ``reach``.  ``depth`` digits of the
    key of its k-th row are known, as ``far`` (of the distance) and ``id_far`` (of the id); ``depth`` 0 stands for a
    window of fewer than ``k`` rows.
    """
    most = windows.agg(F.max("reach")).first()[0] or 0
    far_digits = max(1, -(-most.bit_length() // BITS))
    least, id_digits = np.int64(blocks.least or 0), blocks.id_digits

    def counting(depth: int) -> Callable[..., Iterator[tuple]]:
        def count(anchor: dict, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray) -> Iterator[tuple]:
            other = labels != anchor["label"]
            scores, keys = scores[other], None
            for w in anchor["windows"]:
                far = w["ps"] - scores
                inside = (far >= 0) & (far <= w["reach"])
                if depth < far_digits:
                    shift = BITS * (far_digits - depth - 1)
                    digits = far[inside] >> shift
                    digits = digits[digits >> BITS == w["far"]] & (2**BITS - 1)
                else:
                    keys = (ids[other] - least).astype(np.uint64) if keys is None else keys
                    shift = BITS * (id_digits - (depth - far_digits) - 1)
                    digits = keys[inside & (far == w["far"])] >> np.uint64(shift)
                    digits = (digits[digits >> np.uint64(BITS) == w["id_far"]] & np.uint64(2**BITS - 1)).astype(np.int64)
                counts = np.bincount(digits, minlength=2**BITS)
                there = np.nonzero(counts)[0]
                if len(there):
                    yield np.full(len(there), anchor["uid"]), np.full(len(there), w["ps"]), there, counts[there]

        return count

    state = windows.withColumns({"taken": F.lit(0).cast("long"), "far": F.lit(0).cast("long"), "id_far": F.lit(0).cast("long"), "depth": F.lit(0)})
    done: list[DataFrame] = []
    for depth in range(far_digits + id_digits):
        state = checkpointed(state)
        per_anchor = state.groupBy("uid").agg(F.collect_list(F.struct("ps", "reach", "far", "id_far")).alias("windows"))  # one for each positive at most
        counts = blocks.meet(blocks.anchors.join(per_anchor, "uid"), counting(depth), "uid long, ps long, digit int, n long", [pa.int64(), pa.int64(), pa.int32(), pa.int64()])
        summed = counts.groupBy("uid", "ps", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("uid", "ps").orderBy("digit"))
        joined = summed.withColumn("upto", upto).join(state, ["uid", "ps"])
        at = joined.where((F.col("taken") + F.col("upto") >= k) & (F.col("taken") + F.col("upto") - F.col("n") < k))
        digit = lambda name, now: F.when(F.lit(now), F.col(name) * 2**BITS + F.col("digit")).otherwise(F.col(name)).alias(name)
        found = at.select("uid", "ps", "reach", (F.col("taken") + F.col("upto") - F.col("n")).alias("taken"), digit("far", depth < far_digits), digit("id_far", depth >= far_digits), F.lit(depth + 1).alias("depth"), "n")
        found = checkpointed(found)
        if depth == 0:  # fewer than k rows in all
            done.append(state.join(found, ["uid", "ps"], "left_anti"))
        few = F.col("taken") + F.col("n") <= max(FEW, k)
        last = depth + 1 == far_digits + id_digits
        done.append((found if last else found.where(few)).drop("n"))
        state = found.where(~few).drop("n")
        if last or state.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out, far_digits


def hard_negatives(df: DataFrame, anchor_every: int = 100, positives: int = 5, k: int = 5, least_percent: int = 80, **columns) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``anchor_every``; scores are whole inner products of ``whole_vectors``
    (whose arguments ``columns`` are), where a shorter vector goes on with zeros.  Higher scores come first, ties by the
    smaller id.  A negative's score is between ``least_percent`` of the positive's and all of it, so a positive of a
    negative score has no negatives.  Rows count one by one: equal rows, and rows of one id, are rows of their own.
    An empty table, an anchor without positives and a positive without negatives have no rows; other columns are ignored.
    """
    spark = df.sparkSession
    with scratch(spark):
        blocks = Blocks(whole_vectors(df, **columns), anchor_every)
        pairs = checkpointed(positives_of(blocks, positives))
        reach = F.expr(f"ps * {100 - least_percent} div 100")
        windows = checkpointed(pairs.where("ps >= 0").select("uid", "ps", reach.alias("reach")).distinct())
        settled, far_digits = settle_windows(blocks, windows, k)
        least, id_digits = np.int64(blocks.least or 0), blocks.id_digits

        def gather(anchor: dict, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray) -> Iterator[tuple]:
            other = labels != anchor["label"]
            scores, ids = scores[other], ids[other]
            for w in anchor["windows"]:
                far, depth = w["ps"] - scores, w["depth"]
                inside = (far >= 0) & (far <= w["reach"])
                if depth > far_digits:
                    keys = (ids - least).astype(np.uint64) >> np.uint64(BITS * (id_digits - (depth - far_digits)))
                    inside &= (far < w["far"]) | ((far == w["far"]) & (keys <= w["id_far"]))
                elif depth:
                    inside &= far >> (BITS * (far_digits - depth)) <= w["far"]
                at = np.nonzero(inside)[0]
                at = at[first_rows(scores[at], ids[at], k)]
                if len(at):
                    yield np.full(len(at), anchor["uid"]), np.full(len(at), w["ps"]), ids[at], scores[at]

        per_anchor = settled.groupBy("uid").agg(F.collect_list(F.struct("ps", "reach", "far", "id_far", "depth")).alias("windows"))
        found = blocks.meet(blocks.anchors.join(per_anchor, "uid"), gather, "uid long, ps long, negative_id long, negative_score long", [pa.int64()] * 4)
        rank = F.row_number().over(Window.partitionBy("uid", "ps").orderBy(F.desc("negative_score"), "negative_id"))
        ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
        return outliving(pairs.join(ranked, ["uid", "ps"]).select("anchor_id", "positive_id", "rank", "negative_id", F.col("ps").alias("positive_score"), "negative_score"))
