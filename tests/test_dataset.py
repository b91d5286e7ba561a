import json
import math
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldframe import cli
from foldframe.operators import dataset as D
from foldframe.operators import embeddings as E
from foldframe.operators import rows as R
from foldframe.operators import training as T
from foldframe.sources import readers, writers


def test_join(spark):
    f = spark.createDataFrame([("p", 1, "e"), ("p", 2, "e")], "protein_id string, sequence_pos_1based int, entity_id string")
    lab = spark.createDataFrame([("p", 1, "E", 1, 1), ("p", 1, "E", 0, 1), (None, 2, "E", 1, 1)], "protein_id string, sequence_pos_1based int, entity_id string, label int, eval_mask int")
    got = sorted(D.join_labels(f, lab).collect(), key=str)
    assert [(r.sequence_pos_1based, r.entity_id, r.entity_id_label, r.label, r.eval_mask) for r in got] == [(1, "e", "E", 0, 1), (1, "e", "E", 1, 1), (2, "e", None, None, 0)]
    assert D.join_labels(f, lab.drop("eval_mask")).where("eval_mask <> 0").count() == 0
    with pytest.raises(ValueError, match="sequence_pos_1based"):
        D.join_labels(f.drop("sequence_pos_1based"), lab)


@pytest.mark.parametrize(("n", "test", "val"), [(10, {"c3"}, {"c0"}), (15, {"c2", "c3"}, {"c0", "c8"}), (25, {"c24", "c2"}, {"c21", "c8"})])
def test_exact_split(spark, n, test, val):
    clusters = spark.createDataFrame([(f"c{i}", f"p{i}") for i in range(n)], "cluster string, protein_id string")
    got = D.cluster_splits(clusters, clusters).collect()
    assert {r.cluster for r in got if r.split == "test"} == test and {r.cluster for r in got if r.split == "val"} == val and len(got) == n


def test_split_excludes_contaminated_clusters(spark):
    clusters = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("b", "9"), ("c", "4")], "cluster string, protein_id string")
    manifest = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "protein_id string")
    ids = spark.createDataFrame([("2",), ("9",)], "protein_id string")
    got = {r.protein_id: r.split for r in D.cluster_splits(clusters, manifest, ids, mode="hash").collect()}
    assert got["1"] == got["2"] == "excluded_eval_similar" and got["3"] == "train" and set(got) == {"1", "2", "3", "4"}
    early = {r.protein_id: r.split for r in D.cluster_splits(clusters, manifest, ids, contaminate_before_filter=True).collect()}
    assert early["3"] == "excluded_eval_similar"
    with pytest.raises(ValueError, match="No manifest proteins"):
        D.cluster_splits(clusters, manifest.where("false"))


def test_normalizer(spark):
    df = spark.createDataFrame([("1", 5.0, None), ("2", 5.0, None), (None, 5.0, None), ("3", 5.0, None)], "a string, b double, c double")
    n = D.fit_normalizer(df, ["a", "b", "c"])
    assert (n.mean, n.std["b"], n.std["c"]) == ({"a": 2.0, "b": 5.0, "c": 0.0}, 1.0, 1.0) and n.std["a"] == pytest.approx(0.816496580927726)
    assert [r.a for r in D.Normalizer.from_json(n.to_json()).transform(df).collect()] == pytest.approx([-1.224744871391589, 0, 0, 1.224744871391589])


METRIC_ROWS = [("a", 1, 0.9), ("a", 0, 0.9), ("a", 1, 0.4), ("a", 0, 0.2), ("a", 0, 0.4), ("b", 0, 0.1), ("b", 0, 0.3), ("c", 1, 0.5), ("c", 0, 0.7), ("c", 1, 0.9)]


def test_metrics(spark, partitions):
    df = spark.createDataFrame([(*r, 1) for r in METRIC_ROWS] + [("a", 1, 0.0, 0), (None, 0, 0.05, 0)], "protein_id string, label int, score double, eval_mask int")
    want = {"": (0.7708333333333334, 0.6261904761904762, 0.4), "a": (2 / 3, 0.5, 0.4), "b": (None, 0.0, 0.0), "c": (0.5, 0.8333333333333333, 2 / 3)}
    for got in partitions(lambda: D.evaluate_predictions(df).collect()):
        assert [r.protein_id for r in got] == ["", "a", "b", "c"]
        for r in got:
            w = want[r.protein_id]
            assert (r.AUROC is None) == (w[0] is None) and (w[0] is None or r.AUROC == pytest.approx(w[0])) and (r.AUPRC, r.baseline, r.AUPRC_norm) == pytest.approx((w[1], w[2], w[1] - w[2]))
    with pytest.raises(ValueError, match="has no label"):
        D.evaluate_predictions(df.withColumn("label", F.lit(None).cast("int")))


def test_row_selection(spark):
    df = R.dense_index(spark.createDataFrame([(i, f"p{i}") for i in range(10)], "ord long, protein_id string"), ["ord"])
    pick = lambda **k: [r.protein_id for r in R.select_rows(df, "row_index", **k).orderBy("row_index").collect()]
    assert pick(start=2, count=6, shard_index=1, num_shards=3) == ["p3", "p6"] and pick(limit=3) == ["p0", "p1", "p2"] and pick(limit=5, start=3) == ["p3", "p4"] and pick(start=8, count=9) == ["p8", "p9"]
    for bad, text in (({"shard_index": 1}, "provided together"), ({"limit": -1}, "non-negative"), ({"shard_index": 3, "num_shards": 3}, "in \\[0")):
        with pytest.raises(ValueError, match=text):
            R.select_rows(df, "row_index", **bad)
    assert E.index_filename() == "embedding_index.csv" and E.index_filename(3, 20) == "embedding_index_shard_0003_of_0020.csv"


def test_parts_and_first_last(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for path in (f"file://{tmp_path}/t.parquet", str(tmp_path / "t")):
        for part, rows in (("x", df), ("y", df.limit(0)), ("x", df.where("v = 2")), ("z", df)):  # part x is written again
            writers.write_part(rows, path, part)
        got = readers.read_table(spark, path)
        assert got.columns == ["k", "v"] and sorted((r.k, int(r.v)) for r in got.collect()) == [("a", 1), ("b", 2), ("b", 2)]
    first, last = (R.one_per_key(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, o int, v string"), ["k"], "o", last=q).first().v for q in (False, True))
    assert (first, last) == ("x", "y")


def test_training_and_ablations(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(f"p{i % 6}", i // 6 + 1, int(x + y > 0), float(x), float(y), 1) for i, (x, y) in enumerate(r.normal(size=(240, 2)))]
    data = spark.createDataFrame(rows, "protein_id string, sequence_pos_1based int, label int, plddt double, relative_sasa double, eval_mask int")
    split = spark.createDataFrame([(f"p{i}", "train" if i < 4 else "test") for i in range(6)], "protein_id string, split string")
    out = T.train_model(data, split, str(tmp_path / "m"), model_type="sidechain", epochs=12, batch=32, rate=0.01)
    assert out["history"][-1]["loss"] < out["history"][0]["loss"] and out["feature_cols"] == ["plddt", "relative_sasa"]
    assert json.loads((tmp_path / "m" / "run_metadata.json").read_text())["lambda_missing"] == 0.2
    inputs = T.model_inputs(out["normalizer"].transform(data.where("protein_id = 'p5'")), out["feature_cols"], "sidechain", None)
    assert D.ranking_metrics(T.score_rows(inputs, out["model"]).selectExpr("'p' as protein_id", "cast(y as int) label", "score", "1 as eval_mask")).first().AUROC > 0.9
    emb = data.select("protein_id", F.col("sequence_pos_1based").alias("position"), F.array(F.col("plddt").cast("float")).alias("embedding"))
    assert len(T.model_inputs(data, ["plddt"], "fusion", emb).first().x) == 2
    with pytest.raises(KeyError):
        T.model_inputs(data, [], "embedding", emb.where("position > 1"))
    with pytest.raises(ValueError, match="No training residues"):
        T.train_model(data.withColumn("eval_mask", F.lit(0)), split, str(tmp_path / "x"), model_type="sidechain")
    assert T.run_ablations(data, split, str(tmp_path / "ab"), emb, epochs=1).ablation.tolist() == [v[0] for v in T.VARIANTS] and (tmp_path / "ab" / "ablation_index.csv").exists()


def test_model_does_not_depend_on_partitions(spark):
    """Several shards, equal rows among them."""
    r = np.random.default_rng(2)
    rows = [([float(a), float(b)], float(a + b > 0)) for a, b in r.normal(size=(300, 2))] + [([1.0, 1.0], 1.0)] * 150
    frame = spark.createDataFrame(rows, "x array<float>, y double")
    models = [T.fit_perceptron(frame.repartition(n), epochs=2, batch=16, shard_rows=100) for n in (1, 7, 64)]
    for model, history in models[1:]:
        assert all(np.array_equal(p, q) for p, q in zip(model.p, models[0][0].p, strict=True)) and history == models[0][1]
    assert models[0][1][1]["loss"] < models[0][1][0]["loss"]


def test_command_line(spark, tmp_path):
    def fake(sequences):
        return [np.arange(len(s) * 2, dtype=float).reshape(-1, 2) / 3 for s in sequences]

    (tmp_path / "m.csv").write_text("protein_id,sequence\n" + "".join(f"p{i},AC D\n" for i in range(5)))
    out = str(tmp_path / "emb")
    cli.main(["extract-esm2-embeddings", "--manifest", str(tmp_path / "m.csv"), "--out-dir", out, "--start", "1", "--count", "3"], spark, fake)
    index = readers.read_table(spark, f"{out}/embedding_index.csv")
    assert [r.protein_id for r in index.orderBy("protein_id").collect()] == ["p1", "p2", "p3"]
    back = readers.read_embeddings(spark, index).where("protein_id = 'p2'").orderBy("position").collect()
    assert [tuple(r.embedding) for r in back] == [tuple(np.float32(np.float16(v)) for v in (2 * i / 3, (2 * i + 1) / 3)) for i in range(3)]
    (tmp_path / "c.tsv").write_text("".join(f"c{i}\tp{i}\n" for i in range(5)))
    cli.main(["make-splits", "--manifest", str(tmp_path / "m.csv"), "--cluster-tsv", str(tmp_path / "c.tsv"), "--out", str(tmp_path / "s")], spark)
    assert readers.read_table(spark, str(tmp_path / "s")).count() == 5
    (tmp_path / "p.csv").write_text("protein_id,label,score,eval_mask\na,1,0.9,1\na,0,0.1,1\n")
    cli.main(["evaluate", "--predictions", str(tmp_path / "p.csv"), "--out", str(tmp_path / "e")], spark)
    assert math.isclose(float(readers.read_table(spark, str(tmp_path / "e")).first().AUROC), 1.0)
    cli.main(["extract-esm2-embeddings", "--manifest", f"file://{tmp_path}/m.csv", "--out-dir", f"file://{tmp_path}/emb", "--resume"], spark, fake)
    stamp = (tmp_path / "emb" / "p2.npz").stat().st_mtime_ns
    cli.main(["extract-esm2-embeddings", "--manifest", f"file://{tmp_path}/m.csv", "--out-dir", f"file://{tmp_path}/emb", "--resume"], spark, lambda _: 1 / 0)  # nothing is left to encode
    assert sorted(f.name for f in (tmp_path / "emb").glob("*.npz")) == [f"p{i}.npz" for i in range(5)] and (tmp_path / "emb" / "p2.npz").stat().st_mtime_ns == stamp
    assert readers.read_embeddings(spark, readers.read_table(spark, f"file://{tmp_path}/emb/embedding_index.csv")).count() == 15
    with pytest.raises(RuntimeError, match="encoder"):
        cli.main(["extract-esm2-embeddings", "--manifest", str(tmp_path / "m.csv"), "--out-dir", str(tmp_path / "none")], spark)


def test_dense_index_shuffles_its_rows_once(spark):
    """Rows are numbered in the stage that sorts them: what is written already has its places, and no window sorts it again."""
    from foldframe.operators import rows

    indexed = rows.dense_index(spark.range(1_000).select((F.col("id") % 7).alias("k"), "id"), ["k", "id"], "i")
    assert "_own" not in indexed.columns and "row_number" not in indexed._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in indexed.orderBy("i").select("k", "id").collect()] == sorted((i % 7, i) for i in range(1_000))


def test_dense_index_of_many_wide_rows(spark):
    """Every index once, whatever adaptive plans make of the partitions; ties and several order columns included."""
    from foldframe.operators.rows import dense_index

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        df = spark.range(2_000_000).select((F.xxhash64("id") % 50_021).alias("k"), "id", F.repeat(F.lit("x"), 40).alias("wide"))
        indexed = dense_index(df, ["k", F.desc("id")], "i")
        assert indexed.columns == ["k", "id", "wide", "i"]
        count, distinct, low, high = indexed.agg(F.count("*"), F.countDistinct("i"), F.min("i"), F.max("i")).first()
        assert (count, distinct, low, high) == (2_000_000, 2_000_000, 0, 1_999_999)
        same = indexed.alias("a").join(indexed.alias("b"), F.col("a.i") + 1 == F.col("b.i"))
        assert same.where("a.k > b.k or (a.k = b.k and a.id < b.id)").isEmpty()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_ranking_metrics_of_continuous_scores(spark, partitions):
    """The overall group is dealt over partitions by score; sums before a partition are added."""
    from foldframe.operators.dataset import ranking_metrics

    r = np.random.default_rng(3)
    score, label = r.normal(size=3_000).round(3), r.integers(0, 2, 3_000)
    data = spark.createDataFrame(pd.DataFrame({"protein_id": r.integers(0, 3, 3_000).astype(str), "score": score, "label": label, "eval_mask": 1}))
    order = np.argsort(-score, kind="stable")
    cut = np.flatnonzero(np.append(np.diff(score[order]) != 0, True))
    tp, n = np.cumsum(label[order])[cut], cut + 1
    ap = (np.diff(tp, prepend=0) * tp / n).sum() / tp[-1]
    for found in partitions(lambda: ranking_metrics(data).collect()):
        overall = next(x for x in found if x.group == "overall")
        positive, negative = score[label == 1][:, None], score[label == 0][None, :]
        auc = ((positive > negative) + 0.5 * (positive == negative)).mean()
        assert len(found) == 4 and abs(overall.AUROC - auc) < 1e-9 and abs(overall.AUPRC - ap) < 1e-9


def test_exact_split_is_that_of_the_seeded_shuffle(spark):
    names = [f"c{i:03}é" if i % 2 else f"C{i}" for i in range(57)]
    found = {r.cluster: r.split for r in D.exact_split(spark.createDataFrame([(c,) for c in names], "cluster string").repartition(5), 0.15, 0.2, 7).collect()}
    shuffled = sorted(names)
    random.Random(7).shuffle(shuffled)
    assert found == {c: "test" if i < 11 else "val" if i < 11 + 9 else "train" for i, c in enumerate(shuffled)}
    assert D.exact_split(spark.createDataFrame([], "cluster string"), 0.1, 0.1, 1).count() == 0


def test_rows_keep_the_order_of_files(spark, tmp_path):
    """Files of unlike size, which Spark deals to tasks by size, and blocks of one file."""
    frames, n = [], 0
    (tmp_path / "m").mkdir()
    for name, size in (("a.csv", 7), ("b.csv", 900), ("c.csv", 60)):
        frames.append(pd.DataFrame({"protein_id": [f"p{n + i}" for i in range(size)], "sequence": "ACDEFGHIKL"}))
        frames[-1].to_csv(tmp_path / "m" / name, index=False)
        n += size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        ordered = readers.read_manifest(spark, f"file://{tmp_path}/m").withColumn("row_index", F.col("ord"))
        whole = pd.concat(frames, ignore_index=True)
        assert [r.protein_id for r in ordered.orderBy("ord").collect()] == whole.protein_id.tolist()
        part = R.select_rows(ordered, "row_index", limit=950, start=3, count=940, shard_index=1, num_shards=4)
        assert sorted(r.protein_id for r in part.collect()) == sorted(whole.iloc[:950].iloc[3:943].iloc[1::4].protein_id)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_commands_of_training(spark, tmp_path):
    r = np.random.default_rng(4)
    rows = [f"p{i % 6},{i // 6 + 1},{int(x > 0)},1,{x:.4f}" for i, x in enumerate(r.normal(size=120))]
    (tmp_path / "d.csv").write_text("protein_id,sequence_pos_1based,label,eval_mask,plddt\n" + "\n".join(rows) + "\n")
    (tmp_path / "s.csv").write_text("protein_id,cluster,split\n" + "".join(f"p{i},c{i},{'train' if i < 4 else 'test'}\n" for i in range(6)))
    both = ["--dataset", str(tmp_path / "d.csv"), "--split", str(tmp_path / "s.csv")]
    cli.main(["train", *both, "--out-dir", str(tmp_path / "m"), "--model-type", "sidechain", "--epochs", "2"], spark)
    assert json.loads((tmp_path / "m" / "run_metadata.json").read_text())["epochs"] == 2
    (tmp_path / "m.csv").write_text("protein_id,sequence\n" + "".join(f"p{i},{'A' * 20}\n" for i in range(6)))
    cli.main(["extract-esm2-embeddings", "--manifest", str(tmp_path / "m.csv"), "--out-dir", str(tmp_path / "emb")], spark, lambda q: [np.ones((len(s), 2)) for s in q])
    cli.main(["run-ablations", *both, "--out-dir", str(tmp_path / "ab"), "--embedding-index", str(tmp_path / "emb" / "embedding_index.csv"), "--epochs", "1"], spark)
    assert len((tmp_path / "ab" / "ablation_index.csv").read_text().splitlines()) == 1 + len(T.VARIANTS)


def test_command_of_labels(spark, tmp_path):
    table = {"entry_ID": {"0": "e1"}, "sequence": {"0": "MK LV"}, "label": {"0": "AX .Y"}, "seq len": {"0": 4}, "same len as seq?": {"0": True}}
    with zipfile.ZipFile(tmp_path / "l.zip", "w") as z:
        z.writestr("l.json", json.dumps(table))
    (tmp_path / "m.csv").write_text("protein_id,sequence\nq_entity1,MKLV\nr_entity2,GGGG\n")
    out = f"file://{tmp_path}"
    cli.main(["import-dyna1-labels", "--label-zip", f"{out}/l.zip", "--manifest", f"{out}/m.csv", "--out-labels", f"{out}/labels", "--out-qc", f"{out}/qc.csv"], spark)
    rows = readers.read_table(spark, f"{out}/labels").orderBy("sequence_pos_1based").collect()
    assert [(r.protein_id, r.sequence_pos_1based, r.label) for r in rows] == [("q_entity1", str(i), x) for i, x in enumerate(["0", "1", "1", "0"], 1)]
    assert json.loads((tmp_path / "qc.schema.json").read_text())["alignment"]["min_identity"] == 0.9
