import random
from itertools import combinations

import numpy as np
import pytest

from foldframe import cli
from foldframe.operators import clustering
from foldframe.operators.align import align_one
from foldframe.sources import readers

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def _families(seed, families=6, members=5):
    r = random.Random(seed)
    rows = []
    for f in range(families):
        root = "".join(r.choice(LETTERS) for _ in range(r.randint(40, 90)))
        for m in range(members):
            rows.append((f"f{f}m{m}", "".join(r.choice(LETTERS) if r.random() < 0.2 else c for c in root if r.random() > 0.03)))
    return rows


def _links(a, b, identity=0.3, coverage=0.8):
    left, _, _, pairs = align_one(a, b)
    return sum(a[i] == b[j] for i, j in pairs) >= identity * len(left) and len(pairs) >= coverage * max(len(a), len(b))


def _brute(rows):
    """Union-find over all pairs of sequences, aligned one by one."""
    rows = [(p, s.upper().replace(" ", "") if s is not None else None) for p, s in rows if p is not None]
    up = {p: p for p, _ in rows}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    def unite(p, q):
        p, q = sorted((root(p), root(q)))
        up[q] = p

    holders = {}
    for p, s in rows:
        if s:
            holders.setdefault(s, []).append(p)
    for group in holders.values():
        for p in group:
            unite(group[0], p)
    for a, b in combinations(sorted(holders), 2):
        if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and _links(a, b):
            unite(holders[a][0], holders[b][0])
    return {p: root(p) for p in up}


def _found(df):
    return {r.protein_id: r.cluster for r in df.collect()}


def test_clusters_equal_brute_force(spark, partitions):
    rows = [*_families(3), ("copy", _families(3)[7][1].lower()), ("short", "ACDE"), ("short2", "AC DE"), ("none", None), ("empty", ""), ("empty2", ""), (None, "ACDEFGHIK"), ("f0m0", _families(3)[20][1]), ("short", "ACDE")]
    frame = spark.createDataFrame([(p, s, "x") for p, s in rows], "protein_id string, sequence string, cluster string")
    want = _brute(rows)
    for found in partitions(lambda: _found(clustering.cluster_sequences(frame))):
        assert found == want
    assert want["short"] == want["short2"] and want["empty"] != want["empty2"] and len(set(want.values())) < 15
    assert want["f0m0"] == want["f4m0"]  # rows of one protein bring their sequences together


def _relative(r, root, keep, indels=0.03):
    out = []
    for c in root:
        if r.random() < indels / 2:
            continue
        if r.random() < indels / 2:
            out.append(r.choice(LETTERS))
        out.append(c if r.random() < keep else r.choice(LETTERS.replace(c, "")))
    return "".join(out)


@pytest.mark.parametrize("keep", [0.35, 0.4, 0.5])
def test_recall_of_distant_pairs_against_all_pairs(spark, keep):
    """Families of two, so that no third member brings a missed link back; every pair of the table is aligned."""
    r = random.Random(f"relatives {keep}")
    roots = ["".join(r.choice(LETTERS) for _ in range(r.randint(120, 260))) for _ in range(40)]
    rows = {f"f{i:02}{m}": s for i, root in enumerate(roots) for m, s in (("a", root), ("b", _relative(r, root, keep)))}
    true = {(p, q) for p, q in combinations(sorted(rows), 2) if min(len(rows[p]), len(rows[q])) >= 0.8 * max(len(rows[p]), len(rows[q])) and _links(rows[p], rows[q])}
    found = _found(clustering.cluster_sequences(spark.createDataFrame([*rows.items()], "protein_id string, sequence string")))
    assert len(true) >= 35 and sum(found[p] == found[q] for p, q in true) >= 0.9 * len(true)
    assert all((p, q) in true for p, q in combinations(sorted(rows), 2) if found[p] == found[q])


def test_large_family_of_distant_members_is_one_cluster(spark):
    """More holders of a word than slots."""
    r = random.Random(8)
    root = "".join(r.choice(LETTERS) for _ in range(120))
    rows = [(f"p{i:03}", _relative(r, root, 0.75)) for i in range(90)] + [(f"q{i}", "".join(r.choice(LETTERS) for _ in range(120))) for i in range(5)]
    found = _found(clustering.cluster_sequences(spark.createDataFrame(rows, "protein_id string, sequence string")))
    assert len({c for p, c in found.items() if p[0] == "p"}) == 1 and len(set(found.values())) == 6


def test_frequent_words_make_no_pairs_of_holders(spark):
    """All share one word, which alone would be 80,000 pairs; hits stay below a slot's centre for each holder of a word."""
    r = random.Random(1)
    rows = [(f"p{i}", "HHHHHHHH" + "".join(r.choice(LETTERS) for _ in range(30))) for i in range(400)]
    classes = spark.createDataFrame(rows, "id string, sequence string")
    few, many = (clustering.seed_pairs(classes, 0.8, slots).count() for slots in (1, 32))
    assert few < 400 * len(clustering.PATTERNS) * 4 and many < 400 * 399 / 2
    assert clustering.seed_pairs(classes.limit(0), 0.8).count() == 0


def test_best_run_and_words():
    r = random.Random(2)
    for _ in range(100):
        a, b = ("".join(r.choice("ACD") for _ in range(r.randint(0, 12))) for _ in range(2))
        x, y = (np.frombuffer(t.encode(), np.uint8) for t in (a, b))
        d = r.randint(-12, 12)
        marks = [5 if a[i] == b[i - d] else -1 for i in range(len(a)) if 0 <= i - d < len(b)]
        want = max((sum(marks[i:j]) for i in range(len(marks)) for j in range(i + 1, len(marks) + 1)), default=0)
        assert clustering.best_run(x, y, d) == (want if marks else 0)
    words, places = clustering.words_of("ACDEFGHIK")
    assert len(set(words.tolist())) == len(words) == sum(max(0, 9 - p[-1]) for _, p in clustering.PATTERNS) and places.max() == 4
    assert len(clustering.words_of("ACD")[0]) == 0 and len(clustering.words_of("ÄÖ☃ac-")[0]) > 0


def test_empty_manifest_has_no_clusters(spark):
    assert clustering.cluster_sequences(spark.createDataFrame([], "protein_id string, sequence string")).collect() == []


def test_splits_without_a_cluster_table(spark, tmp_path):
    (tmp_path / "m.csv").write_text("protein_id,sequence\n" + "".join(f"{p},{s}\n" for p, s in _families(3)))
    cli.main(["make-splits", "--manifest", str(tmp_path / "m.csv"), "--work-dir", str(tmp_path / "w"), "--out", str(tmp_path / "s")], spark)
    rows = readers.read_table(spark, str(tmp_path / "s")).collect()
    assert {r.protein_id: r.cluster for r in rows} == _brute(_families(3))
    assert len({(r.cluster, r.split) for r in rows}) == len({r.cluster for r in rows})
