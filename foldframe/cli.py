"""Command line: the nine steps from labels and structures to metrics."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clustering, dataset, embeddings, features, matching, rows, secondary, training
from .sources import readers, writers
from .sources.shared import checkpointed, exists, has_scheme, remove, scratch, write_text


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="foldframe", description="Residue analytics on Spark")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *required: str, **optional) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        for r in required:
            p.add_argument(f"--{r}", required=True)
        for k, v in optional.items():
            flag = "--" + k.replace("_", "-")
            if v is False:
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, default=v[1] if isinstance(v, tuple) else v, type=v[0] if isinstance(v, tuple) else type(v) if v is not None else str)
        return p

    command("import-dyna1-labels", "Import labels with strict entity matching", "label-zip", "manifest", "out-labels", "out-qc", min_label_coverage=0.9, min_identity=0.9, include_unsuppressed=False)
    command("extract-sidechain-features", "Extract residue features from structures", "manifest", "out", pdb_root=None, out_qc=None, limit=(int, None), checkpoint_every=100_000, resume=False)
    command("augment-dssp-sasa", "Add secondary structure and areas to a feature table", "features", "manifest", "out", pdb_root=None, out_qc=None, checkpoint_every=100_000, resume=False)
    command("extract-esm2-embeddings", "Pre-extract frozen embeddings", "manifest", "out-dir", model_name=embeddings.MODEL, layer=embeddings.LAYER, limit=(int, None), start=(int, None), count=(int, None), shard_index=(int, None), num_shards=(int, None), resume=False)
    command("build-dataset", "Join labels to feature rows", "features", "labels", "out")
    command("make-splits", "Cluster-level splits", "manifest", "out", cluster_tsv=None, eval_ids=None, min_seq_id=0.3, val_fraction=0.1, test_fraction=0.1, seed=13, work_dir="data/mmseqs")
    train = command("train", "Train a perceptron", "dataset", "split", "out-dir", embedding_index=None, seed=13, epochs=5, batch_size=256, lr=1e-3, lambda_missing=0.2)
    train.add_argument("--model-type", choices=["embedding", "sidechain", "fusion"], default="fusion")
    command("evaluate", "Ranking metrics of predictions", "predictions", out=None)
    command("run-ablations", "Five model variants", "dataset", "split", "out-dir", embedding_index=None, epochs=5, seed=13)
    return parser


def _indexed(spark: SparkSession, path: str) -> DataFrame:
    return readers.read_manifest(spark, path).withColumn("row_index", F.col("ord"))


def _folder(path: str) -> str:
    """A URI stays as it is, a plain path becomes absolute."""
    return path.rstrip("/") if has_scheme(path) else os.path.abspath(path)


def _structures(manifest: DataFrame, path: str, root: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest with resolved paths, lines of the files that it names, ids of these files)."""
    base = _folder(path).rsplit("/", 1)[0]
    folder = _folder(root) if root else None
    files = readers.existing_files(readers.structure_places(manifest, base, folder))
    return readers.resolve_structure_paths(manifest, base, folder, files), readers.read_named_structures(files), files


def _chunks(df: DataFrame, index: str, every: int) -> tuple[DataFrame, list[tuple[int, str]]]:
    """``df`` with ``_chunk``, and each chunk's number with a name that its ids decide.

    The same ids make the same name, so a chunk that was cut off by a failure replaces what it had written.
    """
    number = F.floor(F.col(index) / (every if every > 0 else 2**62))
    marked = checkpointed(df.withColumn("_chunk", number))
    ids = F.sum(F.xxhash64(F.col("protein_id").cast("string")).cast("decimal(38,0)"))
    named = marked.groupBy("_chunk").agg(F.md5(F.concat_ws(":", F.count("*"), ids)).alias("name")).orderBy("_chunk").collect()  # a row per commit
    return marked, [(r["_chunk"], r["name"]) for r in named]


def _commit(a: argparse.Namespace, found: DataFrame, qc: DataFrame, name: str) -> None:
    """Rows first: what has a QC row is complete."""
    writers.write_part(found, a.out, name)
    if a.out_qc:
        writers.write_part(qc, a.out_qc, name)


def _extract(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rows of ``checkpoint_every`` proteins are committed at a time, features before their QC, each as a part of its own.

    Resuming goes on from the QC (proteins without structure are in no other table); a part that has features but no QC
    is made again and replaces them.  Without a QC table the feature table says what is done.  Paths may be of any file
    system that Spark reads.
    """
    if not a.resume:
        for path in filter(None, (a.out, a.out_qc)):
            remove(spark, path)
    pending = rows.select_rows(_indexed(spark, a.manifest), "row_index", limit=a.limit)
    done = next((p for p in (a.out_qc, a.out) if p and exists(spark, p)), None)
    if done:
        pending = rows.resume(pending, readers.read_table(spark, done), "protein_id")
    pending, chunks = _chunks(pending, "row_index", a.checkpoint_every)
    for k, name in chunks or ([] if done else [(0, "none")]):
        with scratch(spark):
            part, lines, files = _structures(pending.where(F.col("_chunk") == k).drop("_chunk"), a.manifest, a.pdb_root)
            _commit(a, *features.extract_features(part, lines, files=files, dssp=secondary.assign), name)


def _augment(spark: SparkSession, a: argparse.Namespace) -> None:
    """As ``_extract``, over the proteins of a feature table; with ``--resume`` those that have a QC row are left out."""
    if not a.resume:
        for path in filter(None, (a.out, a.out_qc)):
            remove(spark, path)
    table = readers.read_table(spark, a.features).withColumn("protein_id", F.col("protein_id").cast("string"))
    manifest = readers.read_manifest(spark, a.manifest)
    proteins = rows.dense_index(table.select("protein_id").distinct(), ["protein_id"])
    done = next((p for p in (a.out_qc, a.out) if p and exists(spark, p)), None)
    if done:
        proteins = rows.resume(proteins, readers.read_table(spark, done), "protein_id")
    proteins, chunks = _chunks(proteins, "row_index", a.checkpoint_every)
    for k, name in chunks or ([] if done else [(0, "none")]):
        with scratch(spark):
            own = proteins.where(F.col("_chunk") == k)
            named, lines, files = _structures(rows.members(manifest, own, "protein_id"), a.manifest, a.pdb_root)
            _commit(a, *features.augment_features(rows.members(table, own, "protein_id"), named, lines, files=files, dssp=secondary.assign), name)


def _embeddings(spark: SparkSession, index: str | None) -> DataFrame | None:
    return readers.read_embeddings(spark, readers.read_table(spark, index)) if index else None


def main(argv: list[str] | None = None, spark: SparkSession | None = None, encoder: embeddings.Encoder | None = None) -> None:
    a = build_parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("foldframe").getOrCreate()
    read = lambda p: readers.read_table(spark, p)
    if a.command == "import-dyna1-labels":
        labels, qc = matching.import_labels(readers.read_label_zip(spark, a.label_zip), readers.read_manifest(spark, a.manifest), a.min_label_coverage, a.min_identity, a.include_unsuppressed)
        writers.write_table(labels, a.out_labels)
        writers.write_table(qc, a.out_qc)
        write_text(spark, os.path.splitext(a.out_qc)[0] + ".schema.json", json.dumps(writers.label_schema(a.label_zip, a.min_label_coverage, a.min_identity), indent=2))
    elif a.command == "extract-sidechain-features":
        _extract(spark, a)
    elif a.command == "augment-dssp-sasa":
        _augment(spark, a)
    elif a.command == "extract-esm2-embeddings":
        manifest = rows.select_rows(_indexed(spark, a.manifest), "row_index", a.limit, a.start, a.count, a.shard_index, a.num_shards)
        pending = rows.resume(manifest, readers.stored_embeddings(spark, a.out_dir), "protein_id") if a.resume else manifest
        if not pending.isEmpty():
            writers.write_npz(embeddings.encode_residues(pending, encoder), manifest, a.out_dir).count()
        index = embeddings.embedding_index(manifest, a.model_name, a.layer)
        writers.write_table(index.withColumn("embedding_path", F.concat(F.lit(f"{a.out_dir.rstrip('/')}/"), "embedding_path")), f"{a.out_dir}/{embeddings.index_filename(a.shard_index, a.num_shards)}", one_file=True)
    elif a.command == "build-dataset":
        writers.write_table(dataset.join_labels(read(a.features), read(a.labels)), a.out)
    elif a.command == "make-splits":
        ids = readers.read_eval_ids(spark, a.eval_ids) if a.eval_ids else None
        manifest = readers.read_manifest(spark, a.manifest)
        if a.cluster_tsv is None:
            a.cluster_tsv = os.path.join(a.work_dir, "clusters_cluster.tsv")
            writers.write_clusters(clustering.cluster_sequences(manifest, a.min_seq_id), a.cluster_tsv)
        writers.write_table(dataset.cluster_splits(readers.read_clusters(spark, a.cluster_tsv), manifest, ids, a.val_fraction, a.test_fraction, a.seed), a.out)
    elif a.command == "train":
        training.train_model(read(a.dataset), read(a.split), a.out_dir, _embeddings(spark, a.embedding_index), a.model_type, a.seed, a.epochs, a.batch_size, a.lr, a.lambda_missing)
    elif a.command == "evaluate":
        found = dataset.evaluate_predictions(read(a.predictions))
        if a.out:
            writers.write_table(found, a.out, one_file=True)
        else:
            found.show(truncate=False)
    elif a.command == "run-ablations":
        training.run_ablations(read(a.dataset), read(a.split), a.out_dir, _embeddings(spark, a.embedding_index), a.epochs, a.seed)


if __name__ == "__main__":
    main()
