"""Job 1: a training set without leaks, from texts and labels.

    python -m jobs.training_set --documents PATH --labels PATH --out PATH [--config jobs/training_set.json]

Each document is an entry whose residues are the letters of its text.  The job describes every sequence, attaches the
labels, puts all entries of one sequence (terminal tags aside) into one cluster, deals whole clusters to train, val and
test, shuts out clusters that hold an entry of the external evaluation source, and scales the features by the training
rows alone.  It writes

    OUT/dataset/split=.../   one row per entry
    OUT/normalizer/          mean and deviation of each feature over the training rows
    OUT/summary/             entries, clusters and positive labels of each split

and replaces all three when it runs again; the same input gives the same rows.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.functions.chemistry import SETS
from foldframe.functions.sequences import render_tags, strip_tags
from foldframe.operators import dataset
from foldframe.plans.inputs import residue_letters
from foldframe.schemas import require_columns
from foldframe.sources.shared import checkpointed, scratch

log = logging.getLogger("jobs.training_set")
CONFIG = Path(__file__).with_suffix(".json")
FEATURES = ["residues", "hydrophobic", "polar", "charged", "aromatic"]


def letters_in(sequence: Column, letters: str) -> Column:
    """How many of a sequence's letters are among ``letters``."""
    return F.length(sequence) - F.length(F.translate(sequence, letters, ""))


def described(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, cluster, tags and the features of every document that has an id; no text is an empty one.

    The cluster is the digest of the sequence without terminal tags.  Of rows that share an id the one of the least
    digest of its text holds, so a repeated row changes nothing.
    """
    require_columns(documents, {"doc_id", "text", "lang", "source"}, "documents missing columns")
    texts = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "lang", "source", residue_letters(F.coalesce("text", F.lit(""))).alias("seq"))
    seq = F.col("seq")
    rows = texts.select(
        "doc_id", "lang", "source", F.md5(strip_tags(seq)).alias("cluster"), render_tags(seq).alias("tags"), F.length(seq).alias("residues"),
        *(letters_in(seq, "".join(sorted(SETS[name]))).alias(name) for name in FEATURES[1:]),
    )
    row = F.struct("cluster", "lang", "source", "tags", *FEATURES)
    return rows.groupBy("doc_id").agg(F.min(row).alias("r")).select("doc_id", "r.*")


def build(spark: SparkSession, documents: str, labels: str, out: str, config: dict) -> dict[str, int]:
    """Run the job; the number of rows written for each split."""
    with scratch(spark):
        entries = checkpointed(described(spark.read.parquet(documents)))
        known = spark.read.parquet(labels)
        require_columns(known, {"doc_id", config["label"]}, "labels missing columns")
        one = known.groupBy("doc_id").agg(F.max(config["label"]).cast("int").alias("label")).withColumn("eval_mask", F.col("label").isNotNull().cast("int"))
        log.info("read %d documents with an id from %s, %d labelled ids from %s", entries.count(), documents, one.count(), labels)
        joined = dataset.join_labels(entries, one, ["doc_id"])
        manifest = entries.select(F.col("doc_id").alias("protein_id"), "cluster")
        held = entries.where(F.col("source") == config["eval_source"]).select(F.col("doc_id").alias("protein_id"))
        splits = dataset.cluster_splits(manifest, manifest, held, config["val_fraction"], config["test_fraction"], config["seed"], mode="hash", contaminate_before_filter=True)
        rows = checkpointed(joined.join(splits.select(F.col("protein_id").cast("long").alias("doc_id"), "split"), "doc_id"))
        train = rows.where("split = 'train'")
        normalizer = dataset.fit_normalizer(train, FEATURES)
        scaled = normalizer.transform(rows)
        scaled.select("doc_id", "lang", "cluster", "tags", "label", "eval_mask", *FEATURES, "split").write.mode("overwrite").partitionBy("split").parquet(f"{out}/dataset")
        scales = [(c, normalizer.mean[c], normalizer.std[c]) for c in FEATURES]
        spark.createDataFrame(scales, "feature string, mean double, deviation double").coalesce(1).write.mode("overwrite").json(f"{out}/normalizer")
        summary = rows.groupBy("split").agg(F.count("*").alias("entries"), F.countDistinct("cluster").alias("clusters"), F.sum("eval_mask").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("positive"))
        summary.coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    written = {r.split: r.entries for r in spark.read.json(f"{out}/summary").collect()}  # a row per split
    log.info("wrote %s to %s", ", ".join(f"{n} rows of {k}" for k, n in sorted(written.items())), out)
    return written


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "labels", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    a = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("training_set").getOrCreate()
    try:
        build(spark, a.documents, a.labels, a.out, json.loads(Path(a.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
