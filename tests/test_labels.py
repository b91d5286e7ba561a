import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from foldframe.functions.sequences import shares_kmer
from foldframe.operators import matching as M
from foldframe.sources import readers


def manifest(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, protein_id string, entity_id string, sequence string")


def labels(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, entry_ID string, sequence string, label string")


def write_zip(path, columns, members=1):
    with zipfile.ZipFile(path, "w") as z:
        for m in range(members):
            z.writestr(f"labels{m}.json", json.dumps(columns))


COLUMNS = {"entry_ID": {"0": "X_CPMG"}, "sequence": {"0": "ACDE"}, "label": {"0": "AXY."}, "seq len": {"0": 4}, "same len as seq?": {"0": 1.0}}


def test_zip_scan(spark, tmp_path):
    write_zip(tmp_path / "l.zip", COLUMNS)
    row = readers.read_label_zip(spark, str(tmp_path / "l.zip")).first()
    assert (row.entry_ID, row.sequence, row.label, row["seq len"]) == ("X_CPMG", "ACDE", "AXY.", "4")
    write_zip(tmp_path / "two.zip", COLUMNS, 2)
    with pytest.raises(Exception, match="Expected exactly one JSON"):
        readers.read_label_zip(spark, str(tmp_path / "two.zip")).collect()
    write_zip(tmp_path / "bad.zip", COLUMNS | {"label": {"0": "AX"}})
    with pytest.raises(ValueError, match="length mismatch"):
        readers.read_label_zip(spark, str(tmp_path / "bad.zip"))
    with pytest.raises(ValueError, match=r"\['label', 'seq len'\]"):
        readers.validate_labels(spark.createDataFrame([("a", "A", 1.0)], "entry_ID string, sequence string, `same len as seq?` double"))


def test_import_maps_and_masks(spark):
    table, qc = M.import_labels(labels(spark, [("e", "AC DE", "AXY.")]).selectExpr("ord", "entry_ID", "'ACDE' as sequence", "label"), manifest(spark, [("bmr1_entity2", "2", "ACDEHHHHHH")]))
    assert qc.first().status == "mapped" and qc.first().histag_spans == "C:5-10"
    rows = sorted(table.collect(), key=lambda r: r.sequence_pos_1based)
    assert [(r.sequence_pos_1based, r.aa, r.raw_label_token, r.label, r.eval_mask) for r in rows] == [(1, "A", "A", 0, 1), (2, "C", "X", 1, 1), (3, "D", "Y", 0, 1), (4, "E", ".", 1, 1)]


def test_ambiguous_unmapped_and_explicit(spark):
    m = manifest(spark, [("a", "1", "ACDE"), ("b", "2", "ACDE"), ("c", "3", "WWWWWWWWWW")])
    q = {r.source_entry_id: r for r in M.import_labels(labels(spark, [("two", "ACDE", "AAAA"), ("far", "GGGGGGGGGG", "AAAAAAAAAA")]), m)[1].collect()}
    assert (q["two"].status, q["two"].reason, q["two"].protein_id, q["two"].candidates_passing) == ("ambiguous", "multiple_entities_pass", None, 2)
    assert (q["far"].status, q["far"].protein_id) == ("unmapped", None) and q["far"].reason == "low_label_coverage"
    named = spark.createDataFrame([(0, "x", "ACDE", "AAAA", 2.0), (1, "y", "ACDE", "AAAA", 9.0)], "ord long, entry_ID string, sequence string, label string, entity_id double")
    q = {r.source_entry_id: r for r in M.import_labels(named, m)[1].collect()}
    assert (q["x"].status, q["x"].protein_id) == ("mapped", "b")
    assert (q["y"].status, q["y"].reason, q["y"].label_length, q["y"].target_length) == ("unmapped", "no_candidate_entities", 4, 0)


def test_candidate_top(spark):
    m = manifest(spark, [(f"p{i}", None, "ACDEFGHIKL" + "ACDEFGHIKL"[: i % 9] + "W" * (i % 3) + "Y") for i in range(300)])
    ready = M.prepare_labels(labels(spark, [("l", "ACDEFGHIKLM", "A" * 11)]))
    found = M.candidates_band(ready, M.prepare_manifest(m)).collect()
    assert len(found) == M.TOP and sorted(r.c_ord for r in found) == list(range(1, M.TOP + 1))


def test_indexed_pairs_are_those_of_the_band_that_share_a_word(spark):
    r = random.Random(3)
    m = manifest(spark, [(f"p{i}", None, ("ACDEFG" if i % 3 else "") + "".join(r.choice("ACD") for _ in range(r.randint(0, 20)))) for i in range(120)])
    l = labels(spark, [(f"l{i}", s := "".join(r.choice("ACDG") for _ in range(r.randint(1, 15))) + ("CDEFGA" if i % 2 else ""), "A" * len(s)) for i in range(30)])  # noqa: E741
    ready, known = M.prepare_labels(l), M.prepare_manifest(m)
    want = M.length_band(ready, known).where(shares_kmer(F.col("sequence"), F.col("stripped")))
    got = M.pairs_by_word(ready, known)
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 100


def test_partition_invariance(spark, partitions):
    m = manifest(spark, [("a", "1", "ACDEFG"), ("b", "2", "ACDEFGHHHHHH"), ("c", "3", "MKLV")])
    l = labels(spark, [("e1", "MKLV", "AX.Y"), ("e2", "ACDEFG", "......")])  # noqa: E741
    one, seven = partitions(lambda: [sorted(map(str, t.collect())) for t in M.import_labels(l, m)])
    assert one == seven


def against_sql(spark, name):
    """Rows of a registered query and of its SQL on the smallest tables, as sorted text."""
    import duckdb

    from foldframe.plans import queries

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
    got = queries.QUERIES[name](spark, folder)
    want = db.execute(queries.ORACLE_SQL[name])
    assert got.columns == [c[0] for c in want.description]
    want = sorted(want.fetchall())
    assert sorted(map(tuple, got.collect())) == want
    return want


def test_exact_classes_hold_every_pair(spark):
    rows = against_sql(spark, "candidate_exact")
    assert any(size > 1 for *_, size in rows)
    assert all(size == sum(c == d for _, d, _ in rows) for _, c, size in rows)


def test_band_queries_meet_every_first_letter(spark):
    from foldframe.plans import queries

    top, shared, _ = (against_sql(spark, name) for name in ("quick_ratio_topk", "kmer_share", "align_score"))
    assert any(name[0] != entity[0] for name, entity, *_ in top)
    folder = "/root/testdata/sf0.001"
    wanted = {row[:2] for row in shared}
    scores = {(r.p_name, r.protein_id): r.score for r in queries.QUERIES["align_score"](spark, folder).collect()}
    qc = {(r.source_entry_id, r.protein_id) for r in queries.QUERIES["alignment_qc"](spark, folder).collect()}
    assert set(scores) == qc == wanted
    sequences = {(r.source_entry_id, r.protein_id): (r.sequence, r.target) for r in queries._band(spark, folder).collect()}

    def score(a, b):
        row = [-2 * j for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            new = [-2 * i]
            for j, y in enumerate(b, 1):
                new.append(max(row[j - 1] + (2 if x == y else -1), row[j] - 2, new[-1] - 2))
            row = new
        return row[-1]

    assert all(scores[k] == score(*sequences[k]) for k in sorted(scores)[::50])
