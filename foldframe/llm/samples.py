"""Bounded samples of labelled documents for the trained operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int, longest: int = 100_000) -> tuple[pd.DataFrame, float]:
    """(doc_id, text, y) of at most ``per_class`` documents of each class, and the share of class 1.

    Only rows whose crc32(doc_id as text) modulo ``folds`` is not ``held`` are looked at.  The rows are those of
    the least hash of their id, so the sample does not depend on the partitions.  Labelled documents of more than
    ``longest`` characters are left out of the sample (they are scored like all others).  Rows without a label or
    an id count as unlabelled; of several labels of a document the largest holds.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder != held))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    count = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = F.broadcast(parts[0].unionByName(parts[1]))  # at most 2 * per_class rows of two numbers
    rows = id_and_text(docs).where(F.length("text") <= longest).join(picked, "doc_id").dropDuplicates(["doc_id"]).toPandas()
    total = sum(count.values())
    prior = count.get(1, 0) / total if total else 0.5
    return rows.sort_values("doc_id").reset_index(drop=True), prior


def class_weights(y, prior: float):
    """Weights that give the classes of a stratified sample their natural shares."""
    import numpy as np

    y = np.asarray(y)
    share = y.mean() if len(y) else 0.5
    return np.where(y == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9))
