"""The dataset join, splits, normalisation and ranking metrics."""

from __future__ import annotations

import json
import random
from array import array
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import numeric
from ..schemas import require_columns, require_rows
from .rows import before_parts, dense_index, in_ranges, masked

KEYS = ["protein_id", "sequence_pos_1based"]


def join_labels(features: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Left join of features to labels; clashing label columns get ``_label``, a missing ``eval_mask`` is 0.

    A feature row that several label rows match is repeated; null keys match nothing.
    """
    keys = keys or KEYS
    require_columns(features, keys, "Missing join keys in features")
    require_columns(labels, keys, "Missing join keys in labels")
    clash = {c: f"{c}_label" for c in labels.columns if c in features.columns and c not in keys}
    joined = features.join(labels.withColumnsRenamed(clash), keys, "left")
    mask = F.col("eval_mask") if "eval_mask" in joined.columns else F.lit(0)
    return joined.withColumn("eval_mask", F.coalesce(mask, F.lit(0)).cast("int"))


def contaminated_clusters(clusters: DataFrame, eval_ids: DataFrame) -> DataFrame:
    return clusters.join(eval_ids.select(F.col("protein_id").cast("string").alias("protein_id")).distinct(), "protein_id", "left_semi").select("cluster").distinct()


def cluster_splits(clusters: DataFrame, manifest: DataFrame, eval_ids: DataFrame | None = None, val_fraction: float = 0.1, test_fraction: float = 0.1, seed: int = 13, mode: str = "exact", contaminate_before_filter: bool = False) -> DataFrame:
    """protein_id, cluster, split for each row of the cluster table whose protein is in the manifest.

    Clusters with an evaluation protein are ``excluded_eval_similar``.  ``mode="exact"`` deals them out as a seeded
    ``random.Random`` shuffles their sorted names; ``mode="hash"`` orders them by a hash of seed and name instead, which
    gives another split of the same sizes and has no step that is not distributed.
    """
    every = clusters.select(F.col("cluster").cast("string").alias("cluster"), F.col("protein_id").cast("string").alias("protein_id"))
    rows = every.join(manifest.select(F.col("protein_id").cast("string").alias("protein_id")).distinct(), "protein_id", "left_semi")
    require_rows(rows, "No manifest proteins found in cluster table")
    spark = rows.sparkSession
    dirty = spark.createDataFrame([], "cluster string") if eval_ids is None else contaminated_clusters(every if contaminate_before_filter else rows, eval_ids)
    clean = rows.select("cluster").distinct().join(dirty, "cluster", "left_anti")
    parts = (exact_split if mode == "exact" else hash_split)(clean, val_fraction, test_fraction, seed)
    marked = rows.join(parts, "cluster", "left")
    return marked.select("protein_id", "cluster", F.coalesce("split", F.lit("excluded_eval_similar")).alias("split"))


def exact_split(clusters: DataFrame, val_fraction: float, test_fraction: float, seed: int) -> DataFrame:
    """The split of ``random.Random(seed).shuffle`` over the sorted names.

    Names are sorted and numbered by ranges; the driver shuffles numbers only (a shuffle of Python's generator has no
    other form), and sends back those of test and val.
    """
    n = clusters.count()
    numbers = array("q", range(n))
    random.Random(seed).shuffle(numbers)
    n_test, n_val = int(round(n * test_fraction)), int(round(n * val_fraction))
    held = pd.DataFrame({"_rank": np.frombuffer(numbers, np.int64)[: n_test + n_val], "split": np.where(np.arange(min(n, n_test + n_val)) < n_test, "test", "val")})
    drawn = clusters.sparkSession.createDataFrame(held, "_rank long, split string")
    ranked = dense_index(clusters, ["cluster"], "_rank")
    return ranked.join(drawn, "_rank", "left").select("cluster", F.coalesce("split", F.lit("train")).alias("split"))


def hash_split(clusters: DataFrame, val_fraction: float, test_fraction: float, seed: int) -> DataFrame:
    """Clusters in the order of md5(seed:name); the first are test, the next val."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), "cluster"))
    total = clusters.agg(F.count("*").alias("_n"))
    ranked = dense_index(clusters.withColumn("_h", order), ["_h"], "_rank").join(F.broadcast(total))
    n_test, n_val = F.bround(F.col("_n") * test_fraction), F.bround(F.col("_n") * val_fraction)
    return ranked.select("cluster", F.when(F.col("_rank") < n_test, "test").when(F.col("_rank") < n_test + n_val, "val").otherwise("train").alias("split"))


@dataclass(frozen=True)
class Normalizer:
    """Train-only z-scores."""

    columns: list[str]
    mean: dict[str, float]
    std: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = {c: (F.coalesce(numeric(F.col(c)), F.lit(self.mean[c])) - self.mean[c]) / self.std[c] for c in self.columns}
        return df.withColumns(scaled) if scaled else df

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> Normalizer:
        return cls(**json.loads(text))


def normalizer_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of each column, text and NaN left out."""
    return df.agg(*(x for c in columns for x in (F.avg(numeric(F.col(c))).alias(f"{c}_mean"), F.stddev_pop(numeric(F.col(c))).alias(f"{c}_std"))))


def fit_normalizer(df: DataFrame, columns: list[str]) -> Normalizer:
    """All columns in one aggregate; a column without numbers has mean 0, one without spread deviation 1."""
    row = normalizer_stats(df, columns).first() if columns else {}
    mean = {c: 0.0 if row[f"{c}_mean"] is None else float(row[f"{c}_mean"]) for c in columns}
    usable = lambda v: v is not None and v == v and v not in (0.0, float("inf"))
    return Normalizer(list(columns), mean, {c: float(row[f"{c}_std"]) if usable(row[f"{c}_std"]) else 1.0 for c in columns})


def _metrics(groups: DataFrame, by: list[str]) -> DataFrame:
    """AUROC and step-wise average precision from (group, score) counts; ties share a threshold.

    Counts are range-partitioned by group and score, so a group of any size is dealt over tasks; what stands before a
    partition is a running sum over one row for each partition and group.
    """
    ranged = in_ranges(groups, [*(F.col(c) for c in by), F.desc("score")])
    w = Window.partitionBy("_part", *by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    before = before_parts(ranged.groupBy("_part", *by).agg(F.sum("tp").alias("tp"), F.sum("n").alias("n")), ["tp", "n"], by)
    run = ranged.withColumn("ctp", F.sum("tp").over(w)).withColumn("cn", F.sum("n").over(w)).join(before, ["_part", *by])
    run = run.withColumn("ctp", F.col("ctp") + F.col("_before_tp")).withColumn("cn", F.col("cn") + F.col("_before_n"))
    area = F.sum((F.col("n") - F.col("tp")) * (F.col("ctp") - F.col("tp") / 2))
    summed = run.groupBy(*by).agg(F.sum("tp").alias("p"), F.sum("n").alias("n"), area.alias("u"), F.sum(F.col("tp") * F.col("ctp") / F.col("cn")).alias("ap"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    prc, base = F.when(p > 0, F.col("ap") / p).otherwise(0.0), p / F.col("n")
    return summed.select(*by, F.when((p > 0) & (q > 0), F.col("u") / (p * q)).alias("AUROC"), prc.alias("AUPRC"), (prc - base).alias("AUPRC_norm"), base.alias("baseline"))


def ranking_metrics(predictions: DataFrame, group: str | Column = "protein_id") -> DataFrame:
    """group, protein_id, AUROC, AUPRC, AUPRC_norm, baseline: overall, then per protein (null ids have no group).

    Rows are first summed to (group, score), then dealt out by ranges.  An AUROC of one class is null.
    """
    require_columns(predictions, {"label", "score", "eval_mask"} | ({group} if isinstance(group, str) else set()), "Prediction table missing columns")
    rows = masked(predictions).select((F.col(group) if isinstance(group, str) else group).cast("string").alias("protein_id"), F.col("label").cast("int").alias("label"), F.col("score").cast("double").alias("score"))
    counts = rows.groupBy("protein_id", "score").agg(F.sum("label").alias("tp"), F.count("*").alias("n"))
    overall = counts.groupBy("score").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n")).withColumn("group", F.lit("overall")).withColumn("protein_id", F.lit(""))
    each = counts.where(F.col("protein_id").isNotNull()).withColumn("group", F.lit("per_protein"))
    return _metrics(overall.unionByName(each), ["group", "protein_id"])


def evaluate_predictions(predictions: DataFrame) -> DataFrame:
    """Ranking metrics in order; refuses masked rows without label, and an empty mask."""
    rows = masked(predictions)
    if not rows.where(F.col("label").isNull()).isEmpty():
        raise ValueError("a row with eval_mask=1 has no label")
    require_rows(rows, "No rows with eval_mask=1")
    return ranking_metrics(predictions).orderBy("group", "protein_id")
