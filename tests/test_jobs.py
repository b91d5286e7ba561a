"""The jobs: reruns, growing input, odd rows, and the command lines."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foldframe.functions import sequences
from foldframe.plans.inputs import residue_letters
from jobs import evaluate_new, queries, training_set

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
SET, NEW = json.loads(training_set.CONFIG.read_text()), json.loads(evaluate_new.CONFIG.read_text())


def rows_of(spark, path):
    return sorted(map(repr, spark.read.parquet(path).collect()))


def test_training_set_reruns_to_the_same_rows(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    first = training_set.build(spark, f"{DATA}/documents.parquet", f"{DATA}/labels.parquet", out, SET)
    before = rows_of(spark, f"{out}/dataset")
    assert training_set.build(spark, f"{DATA}/documents.parquet", f"{DATA}/labels.parquet", out, SET) == first
    assert rows_of(spark, f"{out}/dataset") == before and len(before) == spark.read.parquet(f"{DATA}/documents.parquet").count() == sum(first.values())


def test_training_set_keeps_clusters_together_and_scales_by_train(spark, tmp_path):
    words = ["ACDE", "acde ", "HHHHHHHACDE", "KKRD", "", None, "WWYF", "GGGP", "LLLM", "IVAL", "STNQ", "CCCA"]
    docs = [(i, w, "en", "src3" if w == "KKRD" else "src1", 99) for i, w in enumerate(words)] + [(3, "KKRD", "en", "src3", 99), (20, "k-k-r-d", "en", "src1", 99), (None, "AAAA", "en", "src1", 99)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, cluster int").coalesce(1).write.parquet(f"{tmp_path}/d.parquet")
    spark.createDataFrame([(0, 1, 5), (0, 0, 5), (1, None, 5), (None, 1, 5)], "doc_id long, quality int, residues int").write.parquet(f"{tmp_path}/l.parquet")
    out = str(tmp_path / "out")
    assert sum(training_set.build(spark, f"{tmp_path}/d.parquet", f"{tmp_path}/l.parquet", out, SET).values()) == 13
    got = {r.doc_id: r for r in spark.read.parquet(f"{out}/dataset").collect()}
    assert len(got) == 13 and got[0].cluster == got[1].cluster == got[2].cluster and got[0].split == got[1].split == got[2].split
    assert got[3].split == got[20].split == "excluded_eval_similar" and got[4].cluster == got[5].cluster
    assert (got[0].label, got[0].eval_mask, got[1].label, got[1].eval_mask, got[2].eval_mask) == (1, 1, None, 0, 0)
    train = [r for r in got.values() if r.split == "train"]
    for name in training_set.FEATURES:
        values = [r[name] for r in train]
        assert abs(sum(values)) < 1e-9 and (abs(sum(v * v for v in values) / len(values) - 1) < 1e-9 or not any(values))
    assert got[2].tags == "N:1-7" and {r.feature for r in spark.read.json(f"{out}/normalizer").collect()} == set(training_set.FEATURES)


def test_training_set_of_an_empty_table_is_refused(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/d.parquet")
    with pytest.raises(ValueError, match="No manifest proteins"):
        training_set.build(spark, f"{tmp_path}/d.parquet", f"{DATA}/labels.parquet", f"{tmp_path}/out", SET)


def brute_auroc(rows):
    up, down = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down))


def test_evaluate_new_takes_only_what_is_new(spark, tmp_path):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect()}
    where = {k: f"{tmp_path}/{k}" for k in ("docs", "out", "state")}
    run = lambda: evaluate_new.update(spark, where["docs"], f"{DATA}/labels.parquet", where["out"], where["state"], NEW)
    expected = {r.doc_id: (sum(c in "!?" or "A" <= c <= "Z" for c in r.text or "") / max(len(r.text or ""), 1)) for r in docs.collect()}

    def check(ids):
        assert {r.doc_id: r.score for r in evaluate_new.all_scores(spark, where["out"]).collect()} == {i: expected[i] for i in ids}
        (overall,) = spark.read.parquet(f"{where['out']}/metrics").where("group = 'overall'").collect()
        pairs = [(expected[i], known[i]) for i in ids if known.get(i) is not None]
        assert overall.rows == len(pairs) and overall.positive == sum(y for _, y in pairs) and overall.AUROC == pytest.approx(brute_auroc(pairs))

    first, second = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    first.coalesce(2).write.mode("append").parquet(where["docs"])
    ids = [r.doc_id for r in first.select("doc_id").collect()]
    assert run() == len(ids)
    check(ids)
    before = rows_of(spark, f"{where['out']}/metrics")
    assert run() == 0 and rows_of(spark, f"{where['out']}/metrics") == before
    second.coalesce(1).write.mode("append").parquet(where["docs"])
    assert run() == second.count()
    check(list(expected))
    assert sorted(p.name for p in (tmp_path / "out/scores").iterdir() if p.is_dir()) == ["batch=0", "batch=1"]
    first.limit(5).coalesce(1).write.mode("append").parquet(where["docs"])  # documents that come again
    assert run() == 5
    check(list(expected))


def test_evaluate_new_replaces_a_batch_that_runs_again(spark, tmp_path):
    """A run that dies after its scores were written, but before the stream's commit, leaves no row twice."""
    where = {k: f"{tmp_path}/{k}" for k in ("docs", "out", "state")}
    spark.read.parquet(f"{DATA}/documents.parquet").coalesce(1).write.parquet(where["docs"])
    run = lambda: evaluate_new.update(spark, where["docs"], f"{DATA}/labels.parquet", where["out"], where["state"], NEW)
    n = run()
    scores = rows_of(spark, f"{where['out']}/scores")
    for p in (tmp_path / "state/commits").iterdir():
        if p.name.strip(".").split(".")[0] == "0":
            p.unlink()
    assert run() == n and rows_of(spark, f"{where['out']}/scores") == scores


def test_evaluate_new_with_odd_rows(spark, tmp_path):
    docs = [(1, None, "en", 1), (2, "", None, 1), (None, "!!!", "en", 1), (3, "!!AB", "en", 1), (4, "ab", "en", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, score int").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(1, 0, 5), (3, 1, 5), (3, 0, 5), (2, 1, 5), (None, 1, 5), (4, None, 5)], "doc_id long, toxic int, grp int").write.parquet(f"{tmp_path}/l.parquet")
    assert evaluate_new.update(spark, f"{tmp_path}/d", f"{tmp_path}/l.parquet", f"{tmp_path}/out", f"{tmp_path}/state", NEW) == 4
    got = {(r.group, r.protein_id): (r.AUROC, r.rows, r.positive) for r in spark.read.parquet(f"{tmp_path}/out/metrics").collect()}
    assert got == {("overall", ""): (0.75, 3, 2), ("per_protein", "en"): (1.0, 2, 1)}
    empty = spark.read.parquet(f"{tmp_path}/d").limit(0)
    empty.write.parquet(f"{tmp_path}/none")
    assert evaluate_new.update(spark, f"{tmp_path}/none", f"{tmp_path}/l.parquet", f"{tmp_path}/out2", f"{tmp_path}/state2", NEW) == 0


@pytest.mark.parametrize("job", ["training_set", "evaluate_new"])
def test_command_lines(job, tmp_path):
    extra = ["--checkpoint", f"{tmp_path}/state"] if job == "evaluate_new" else []
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--documents", f"{DATA}/documents.parquet", "--labels", f"{DATA}/labels.parquet", "--out", f"{tmp_path}/out", *extra], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read" in done.stderr and "wrote" in done.stderr
    assert list((tmp_path / "out").rglob("*=*/*.parquet"))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_registered_jobs_equal_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    plain = lambda rows: sorted(repr([0.0 if v == 0 else v for v in r]) for r in rows)  # noqa: E731  (no minus zero)
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())


def test_tags_are_found_without_a_scan_of_every_text(spark):
    """The lengths of both tags are those of the plain patterns, which only texts that may hold a tag still meet."""
    texts = ["", "H", "HHHHH", "HHHHHH", "hhhhhhA", "AHHHHHHH", "AHHHHHH\n", "AHHHHHHH\r\n", "AHHHHHHA", "HHHHHHAHHHHHHH", "AHHHHHHAA", None]
    seq = F.col("t")
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    plain = [F.length(F.regexp_extract(F.upper(seq), p, 0)) for p in ("^H{6,}", "H{6,}$")]
    rows = df.select(sequences.n_tag_length(seq), sequences.c_tag_length(seq), *plain).collect()
    assert all(tuple(r)[:2] == tuple(r)[2:] for r in rows) and rows[6][1] == 6
    letters = ["", "Ab-C\u017fs\u212ak\u0131z\n", "  XxBbZz jJ ", "\u00e4MkT", None]
    old = F.regexp_replace(F.upper(F.regexp_replace(seq, "[^A-Za-z]", "")), "[^ACDEFGHIKLMNPQRSTVWY]", "")
    assert all(a == b for a, b in spark.createDataFrame([(t,) for t in letters], "t string").select(residue_letters(seq), old).collect())
    plan = df.select(sequences.c_tag_length(seq))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "case when" in plan or "if (" in plan
