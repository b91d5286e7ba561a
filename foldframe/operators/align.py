"""Global alignment as an Arrow kernel; everything after it is native expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import c_tag_length, n_tag_length, render_tags

ALIGNMENT = "aligned_a string, aligned_b string, score int, pairs array<struct<a:int,b:int>>"


#: Cells of the score matrix that are held at once; of a larger one only some rows are, and those between are made again.
CELLS = 2_000_000


def _rows(above: np.ndarray, x: np.ndarray, y: np.ndarray, first: int, match: int, mismatch: int, gap: int) -> Iterator[np.ndarray]:
    """The score rows of letters ``x``, the first of which is row ``first``, below the row ``above``.

    A row is filled at once: the moves from the row above are element-wise, and the moves along the row become a
    running maximum once the gap cost of each column is taken out.
    """
    slope = gap * np.arange(len(y) + 1, dtype=np.int64)
    row = np.empty(len(y) + 1, np.int64)
    for i, letter in enumerate(x, first):
        row[0] = i * gap
        row[1:] = np.maximum(above[:-1] + np.where(y == letter, match, mismatch), above[1:] + gap)
        above = (np.maximum.accumulate(row - slope) + slope).astype(np.int32)
        yield above


def align_one(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -2, cells: int = CELLS) -> tuple[str, str, int, list[tuple[int, int]]]:
    """Best global alignment with a linear gap cost; of equal moves the diagonal, then the gap in ``b``.

    Memory grows with the length of ``b`` times the root of that of ``a``: every so many rows one is kept, and on the
    way back the rows from the last one kept are made again, so ties fall as if the whole matrix were there.
    """
    a, b = a.upper(), b.upper()
    if a == b:
        return a, b, match * len(a), [(i, i) for i in range(len(a))]
    x, y = np.array(list(a), "U1"), np.array(list(b), "U1")
    n, m = len(a), len(b)
    step = max(1, n if (n + 1) * (m + 1) <= cells else math.isqrt(n))
    row = (gap * np.arange(m + 1)).astype(np.int32)
    kept = [row]
    for i, row in enumerate(_rows(row, x, y, 1, match, mismatch, gap), 1):
        if i % step == 0 and i < n:
            kept.append(row)
    total = int(row[m])
    left, right, pairs, i, j = [], [], [], n, m
    for low in range((len(kept) - 1) * step, -1, -step):
        block = [kept[low // step], *_rows(kept[low // step], x[low:i], y, low + 1, match, mismatch, gap)]
        while i > low:
            here, above = block[i - low], block[i - low - 1]
            if j and here[j] == above[j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
                i, j = i - 1, j - 1
                left.append(a[i])
                right.append(b[j])
                pairs.append((i, j))
            elif not j or here[j] == above[j] + gap:
                i -= 1
                left.append(a[i])
                right.append("-")
            else:
                j -= 1
                left.append("-")
                right.append(b[j])
    left.append("-" * j)
    right.append(b[:j][::-1])
    return "".join(left)[::-1], "".join(right)[::-1], total, pairs[::-1]


def align(a: Column, b: Column, match: int = 2, mismatch: int = -1, gap: int = -2) -> Column:
    """Struct of both gapped texts, the score, and the 0-based position pairs."""

    @F.pandas_udf(ALIGNMENT)
    def kernel(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = [align_one(x or "", y or "", match, mismatch, gap) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"aligned_a": [f[0] for f in found], "aligned_b": [f[1] for f in found], "score": [f[2] for f in found], "pairs": [[{"a": i, "b": j} for i, j in f[3]] for f in found]})

    return kernel(a, b)


def align_pairs(pairs: DataFrame, a: str, b: str, **costs: int) -> DataFrame:
    """``pairs`` with a column ``alignment``; each distinct pair of texts is aligned once.

    Work grows with the product of the lengths, not with bytes, so the pairs are dealt over all shuffle partitions,
    which adaptive execution would otherwise join into few tasks.
    """
    width = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = pairs.select(a, b).distinct().repartition(width, a, b).withColumn("alignment", align(F.col(a), F.col(b), **costs))
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (a, b)]
    return pairs.alias("l").join(done.alias("r"), keys[0] & keys[1]).select("l.*", "r.alignment")


def with_alignment_qc(aligned: DataFrame, label: str, target: str, min_coverage: float = 0.9, min_identity: float = 0.9, least_tag: int = 6) -> DataFrame:
    """Counts, ratios and the fail-closed status of alignments of ``label`` to ``target``.

    Pairs in a terminal tag of the target count as matched only; the coverage is over the whole label; any
    mismatch fails.
    """
    # Tags and letters are bound to ``s`` once a row; inside the filters they would be made anew for each pair.
    bound = F.struct(
        n_tag_length(F.col(target), least_tag).alias("first"), (F.length(target) - c_tag_length(F.col(target), least_tag)).alias("end"), F.col("alignment.pairs").alias("pairs"),
        F.split(F.upper(label), "").alias("a"), F.split(F.upper(target), "").alias("b"),
    )

    def counted(s: Column) -> Column:
        outside = F.filter(s["pairs"], lambda p: (p["b"] >= s["first"]) & (p["b"] < s["end"]))
        equal = F.filter(s["pairs"], lambda p: (p["b"] >= s["first"]) & (p["b"] < s["end"]) & (F.get(s["a"], p["a"]) == F.get(s["b"], p["b"])))
        return F.struct(F.size(s["pairs"]).alias("matched"), F.size(outside).alias("outside"), F.size(equal).alias("reliable"))

    df = aligned.withColumn("_n", F.transform(F.array(bound), counted)[0])
    df = df.withColumn("matched_label_positions", F.col("_n.matched")).withColumn("reliable_label_positions", F.col("_n.reliable")).withColumn("_outside", F.col("_n.outside")).drop("_n")
    df = df.withColumn("mismatches", F.col("_outside") - F.col("reliable_label_positions")).withColumn("label_length", F.length(label)).withColumn("target_length", F.length(target))
    df = df.withColumn("label_coverage", F.when(F.col("label_length") > 0, F.col("reliable_label_positions") / F.col("label_length")).otherwise(0.0))
    df = df.withColumn("identity", F.when(F.col("_outside") > 0, F.col("reliable_label_positions") / F.col("_outside")).otherwise(0.0)).drop("_outside")
    reason = (
        F.when(F.col("label_length") == 0, "empty_label_sequence").when(F.col("label_coverage") < min_coverage, "low_label_coverage")
        .when(F.col("identity") < min_identity, "low_identity").when(F.col("mismatches") > 0, "mismatched_evaluated_residues").otherwise("ok")
    )
    return df.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "ok", "pass").otherwise("fail")).withColumn("histag_spans", render_tags(F.col(target), least_tag))


def evaluate_alignments(pairs: DataFrame, label: str, target: str, min_coverage: float = 0.9, min_identity: float = 0.9, least_tag: int = 6) -> DataFrame:
    return with_alignment_qc(align_pairs(pairs, label, target), label, target, min_coverage, min_identity, least_tag)
