import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldframe.functions import sequences as S
from foldframe.operators import align as A


def test_tag_spans_and_membership(spark):
    df = spark.createDataFrame([("HHHHHHMABCDEHHHHHHH",), ("ACD",), ("HHHHHHH",)], "s string")
    got = df.select(S.tag_spans(F.col("s")).alias("t"), S.in_tag(F.col("s"), F.lit(0)).alias("first"), S.in_tag(F.col("s"), F.lit(7)).alias("eighth"), S.in_tag(F.col("s"), F.lit(18)).alias("last"), S.render_tags(F.col("s")).alias("r"), S.strip_tags(F.col("s")).alias("x")).collect()
    assert tuple(got[0].t) == (0, 6, 12, 19) and (got[0].first, got[0].eighth, got[0].last) == (True, False, True)
    assert [g.r for g in got] == ["N:1-6;C:13-19", "", "N:1-7;C:1-7"]
    assert [g.x for g in got] == ["MABCDE", "ACD", ""]


GOLDEN = [
    ("ACDEFG", "ACDEFGHHHHHH", "ACDEFG------", 0, 6, 6, 0, 1.0, 1.0, "ok"),
    ("ACDEFG", "AAAAAA", "ACDEFG", -3, 6, 1, 5, 0.1667, 0.1667, "low_label_coverage"),
    ("ACDE", "ACDEHHHHHH", "ACDE------", -4, 4, 4, 0, 1.0, 1.0, "ok"),
    ("ACDEHHHHHH", "ACDEHHHHHH", "ACDEHHHHHH", 20, 10, 4, 0, 0.4, 1.0, "low_label_coverage"),
    ("ACDEFG", "MACDEFG", "-ACDEFG", 10, 6, 6, 0, 1.0, 1.0, "ok"),
    ("ACDEFGIKLM", "ACDEFGIKL", "ACDEFGIKLM", 16, 9, 9, 0, 0.9, 1.0, "ok"),
    ("ACDEFGIKLMNPQRSTVWYA", "ACDEFGIKLMNPQRSTVWYC", "ACDEFGIKLMNPQRSTVWYA", 37, 20, 19, 1, 0.95, 0.95, "mismatched_evaluated_residues"),
    ("AAC", "AC", "AAC", 2, 2, 2, 0, 0.6667, 1.0, "low_label_coverage"),
    ("AC", "AAC", "-AC", 2, 2, 2, 0, 1.0, 1.0, "ok"),
    ("", "ACD", "---", -6, 0, 0, 0, 0.0, 0.0, "empty_label_sequence"),
    ("ACDEH", "ACDEHHHHHHH", "ACDE------H", -2, 5, 4, 0, 0.8, 1.0, "low_label_coverage"),
    ("HHHHHHACDE", "ACDE", "HHHHHHACDE", -4, 4, 4, 0, 0.4, 1.0, "low_label_coverage"),
    ("AC", "A C", "A-C", 2, 2, 2, 0, 1.0, 1.0, "ok"),
]


def test_alignment_and_qc_vectors(spark):
    df = spark.createDataFrame([(i, g[0], g[1]) for i, g in enumerate(GOLDEN)], "i int, a string, b string")
    got = {r.i: r for r in A.evaluate_alignments(df, "a", "b").collect()}
    assert len(got) == len(GOLDEN)
    for i, g in enumerate(GOLDEN):
        r = got[i]
        assert (r.alignment.aligned_a, r.alignment.score, r.matched_label_positions, r.reliable_label_positions, r.mismatches, r.reason) == (g[2], *g[3:7], g[9])
        assert (round(r.label_coverage, 4), round(r.identity, 4)) == (g[7], g[8])
    assert got[0].histag_spans == "C:7-12" and got[0].status == "pass"


def naive(a, b):
    n, m = len(a), len(b)
    s = np.zeros((n + 1, m + 1), int)
    s[:, 0], s[0] = -2 * np.arange(n + 1), -2 * np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s[i, j] = max(s[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), s[i - 1, j] - 2, s[i, j - 1] - 2)
    pairs, i, j = [], n, m
    while i and j:
        if s[i, j] == s[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1):
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif s[i, j] == s[i - 1, j] - 2:
            i -= 1
        else:
            j -= 1
    return s[n, m], pairs[::-1]


def test_kernel_equals_naive_programme():
    r = random.Random(1)
    for _ in range(400):
        a, b = ("".join(r.choice("ABH") for _ in range(r.randint(0, 12))) for _ in range(2))
        _, _, score, pairs = A.align_one(a, b)
        assert (score, pairs) == naive(a, b), (a, b)


def test_expressions(spark):
    df = spark.createDataFrame([("ACDEFGHIKLACDE", "ACDDDKLMWACE"), ("", ""), ("AC", "X")], "a string, b string")
    got = df.select(S.quick_ratio(F.col("a"), F.col("b")).alias("q"), S.shares_kmer(F.col("a"), F.col("b")).alias("k")).collect()
    assert got[0].q == pytest.approx(0.6923076923076923) and got[1].q == 1.0 and [g.k for g in got] == [False, True, True]
    n = spark.createDataFrame([("1",), ("x",), (None,), ("NaN",), ("1d",), (" 2.5 ",)], "v string").select(S.numeric(F.col("v")).alias("n")).collect()
    assert [r.n for r in n] == [1.0, None, None, None, None, 2.5]
    e = spark.createDataFrame([("bmr1_entity2",), ("toy",)], "p string").select(S.entity_from_id(F.col("p")).alias("a"), S.entity_after_marker(F.col("p")).alias("b")).collect()
    assert [tuple(r) for r in e] == [("2", "2"), (None, "")]
    t = spark.createDataFrame(pd.DataFrame({"t": list("AXY.p")})).select(S.token_label(F.col("t")).alias("a"), S.token_label(F.col("t"), True).alias("b")).collect()
    assert [tuple(r) for r in t] == [(0, 0), (1, 1), (0, 1), (1, 1), (None, None)]


def test_dihedral_signs(spark):
    import math

    rows = [(1.0, 1.0, 0.0, 0.0), (-1.0, 1.0, 0.0, math.pi), (0.0, 1.0, 1.0, -math.pi / 2), (0.0, 1.0, -1.0, math.pi / 2)]
    df = spark.createDataFrame(rows, "x double, y double, z double, want double")
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    got = df.select("want", S.dihedral([lit(1, 0, 0), lit(0, 0, 0), lit(0, 1, 0), (F.col("x"), F.col("y"), F.col("z"))]).alias("a")).collect()
    for r in got:
        assert math.sin(r.a) == pytest.approx(math.sin(r.want), abs=1e-9) and math.cos(r.a) == pytest.approx(math.cos(r.want), abs=1e-9)


def whole_matrix(a, b, match=2, mismatch=-1, gap=-2):
    """The best alignment from the whole score matrix, cell by cell."""
    score = [[gap * (i + j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            score[i][j] = max(score[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), score[i - 1][j] + gap, score[i][j - 1] + gap)
    i, j, pairs, moves = len(a), len(b), [], []
    while i or j:
        if i and j and score[i][j] == score[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            pairs.append((i, j))
            moves.append((a[i], b[j]))
        elif i and score[i][j] == score[i - 1][j] + gap:
            i -= 1
            moves.append((a[i], "-"))
        else:
            j -= 1
            moves.append(("-", b[j]))
    return "".join(m[0] for m in moves[::-1]), "".join(m[1] for m in moves[::-1]), score[-1][-1], pairs[::-1]


def test_rows_made_again_keep_every_tie():
    r = random.Random(6)
    for _ in range(300):
        a, b = ("".join(r.choice("ACD") for _ in range(r.randint(0, 25))) for _ in range(2))
        want = whole_matrix(a, b)
        assert A.align_one(a, b, cells=1) == want and A.align_one(a, b) == want


def test_memory_of_long_alignments():
    r = random.Random(7)
    a = "".join(r.choice("ACDEFGHIKL") for _ in range(9000))
    b = a[50:4000] + a[4100:]
    tracemalloc.start()
    found = A.align_one(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[2] == 2 * len(b) - 2 * (len(a) - len(b)) and peak < 20e6  # the matrix would hold 320 MB
