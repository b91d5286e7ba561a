"""Job 2: ranking metrics of a score, kept up to date while documents arrive.

    python -m jobs.evaluate_new --documents PATH --labels PATH --out PATH --checkpoint PATH [--config jobs/evaluate_new.json]

A stream with a checkpoint takes the files of the documents that it has not seen, scores their rows once and appends

    OUT/scores/batch=N/       doc_id, group and score of the rows of micro-batch N

A batch that is run again after a failure replaces its own folder, so no row is there twice.  Then the metrics over all
scores and the labels as they stand now (a label may come long after its document) replace

    OUT/metrics/group=.../    overall and for each group, with the numbers of rows and of positive labels

Texts are read once; what a run looks at again is two short columns.  A run without new files changes nothing.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.operators import dataset
from foldframe.schemas import require_columns
from foldframe.sources.shared import checkpointed, exists, place_of, scratch

log = logging.getLogger("jobs.evaluate_new")
CONFIG = Path(__file__).with_suffix(".json")
SCORES, BATCH = "doc_id long, grp string, score double", "batch long"


def scored(documents: DataFrame, config: dict) -> DataFrame:
    """doc_id, grp, score; no text is an empty one, and rows without an id are left out (no label can be theirs)."""
    texts = documents.where(F.col("doc_id").isNotNull()).withColumn("text", F.coalesce("text", F.lit("")))
    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(config["group"]).cast("string").alias("grp"), F.expr(config["score"]).cast("double").alias("score"))


def all_scores(spark: SparkSession, out: str) -> DataFrame:
    """The scores of all batches; of a document that came more than once, those of its first batch."""
    rows = spark.read.schema(f"{SCORES}, {BATCH}").parquet(f"{out}/scores")
    first = F.min(F.struct("batch", "grp", "score"))
    return rows.groupBy("doc_id").agg(first.alias("r")).select("doc_id", "r.batch", "r.grp", "r.score")


def metrics_of(scores: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Ranking metrics overall and by group, with rows and positives; a document with several labels has the largest."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    rows = dataset.join_labels(scores, known.withColumn("eval_mask", F.col("label").isNotNull().cast("int")), ["doc_id"])
    rows = rows.where("eval_mask = 1")
    counts = rows.groupBy(F.coalesce("grp", F.lit("")).alias("g"), F.col("grp").isNull().alias("none")).agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    overall = counts.agg(F.sum("n").alias("rows"), F.sum("p").alias("positive")).select(F.lit("overall").alias("group"), F.lit("").alias("protein_id"), "rows", "positive")
    each = counts.where("not none").select(F.lit("per_protein").alias("group"), F.col("g").alias("protein_id"), F.col("n").alias("rows"), F.col("p").alias("positive"))
    return dataset.ranking_metrics(rows, F.col("grp")).join(overall.unionByName(each), ["group", "protein_id"])


def update(spark: SparkSession, documents: str, labels: str, out: str, checkpoint: str, config: dict) -> int:
    """Run the job; how many new rows it has scored."""
    schema = spark.read.parquet(documents).schema
    require_columns(schema.names, {"doc_id", "text", config["group"]}, "documents missing columns")
    new: list[int] = []

    def append(batch: DataFrame, number: int) -> None:
        place = f"{out}/scores/batch={number}"
        scored(batch, config).write.mode("overwrite").parquet(place)
        new.append(spark.read.schema(SCORES).parquet(place).count())
        log.info("batch %d: wrote %d scores to %s", number, new[-1], place)

    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"])
    place, system = place_of(spark, documents)
    if system.getFileStatus(place).isFile():  # a stream looks at folders
        stream = files.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    else:
        stream = files.parquet(documents)
    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log.info("read %d new documents from %s", sum(new), documents)
    if not exists(spark, f"{out}/scores"):
        log.info("no documents yet, no metrics")
        return 0
    with scratch(spark):
        found = checkpointed(metrics_of(all_scores(spark, out), spark.read.parquet(labels), config["label"]))
        found.write.mode("overwrite").partitionBy("group").parquet(f"{out}/metrics")
        log.info("wrote metrics of %d groups to %s/metrics", found.count(), out)
    return sum(new)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "labels", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    a = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("evaluate_new").getOrCreate()
    try:
        update(spark, a.documents, a.labels, a.out, a.checkpoint, json.loads(Path(a.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
