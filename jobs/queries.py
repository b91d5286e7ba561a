"""The jobs as registered queries, with their SQL: each runs twice into one new folder and returns what is there then."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.plans.queries import AA, METRICS_SQL
from foldframe.sources.shared import shared_folder

from . import evaluate_new, training_set


def job1_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, config = shared_folder(spark, "job1-training-set"), json.loads(training_set.CONFIG.read_text())
    for _ in range(2):
        training_set.build(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out, config)
    rows = spark.read.parquet(f"{out}/dataset").withColumns({c: F.round(c, 5) for c in training_set.FEATURES})
    return rows.withColumn("split", F.col("split").cast("string"))


def job2_evaluate_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scored document with the metrics of its language."""
    out, config = shared_folder(spark, "job2-evaluate-new"), json.loads(evaluate_new.CONFIG.read_text())
    for _ in range(2):
        evaluate_new.update(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{out}/out", f"{out}/checkpoint", config)
    metrics = spark.read.parquet(f"{out}/out/metrics").where("group = 'per_protein'").select(F.col("protein_id").alias("grp"), *(F.round(c, 6).alias(c) for c in ("AUROC", "AUPRC")), "rows", "positive")
    scores = spark.read.parquet(f"{out}/out/scores").select("doc_id", "grp", F.round("score", 9).alias("score"))
    return scores.join(F.broadcast(metrics), "grp", "left")


QUERIES = {"job1_training_set": job1_training_set, "job2_evaluate_new": job2_evaluate_new}

_STRIPPED = "CASE WHEN seq ~ '^H+$' AND length(seq) >= 6 THEN '' ELSE regexp_replace(regexp_replace(seq, '^H{6,}', ''), 'H{6,}$', '') END"
_COUNT = "length(seq) - length(translate(seq, '{}', ''))"
ORACLE_SQL = {
    "job1_training_set": f"""
        WITH t AS (SELECT doc_id, lang, source, {AA.format("coalesce(text, '')")} AS seq FROM documents),
        f AS (SELECT doc_id, lang, source, md5({_STRIPPED}) AS cluster, length(regexp_extract(seq, '^H{{6,}}')) AS n, length(regexp_extract(seq, 'H{{6,}}$')) AS c, length(seq) AS residues,
              {_COUNT.format("AVILMFYW")} AS hydrophobic, {_COUNT.format("STNQC")} AS polar, {_COUNT.format("DEKRH")} AS charged, {_COUNT.format("FYWH")} AS aromatic FROM t),
        dirty AS (SELECT DISTINCT cluster FROM f WHERE source = 'src3'),
        clean AS (SELECT cluster, row_number() OVER (ORDER BY md5('13:' || cluster)) - 1 AS r, count(*) OVER () AS many FROM (SELECT DISTINCT cluster FROM f WHERE cluster NOT IN (FROM dirty))),
        s AS (SELECT f.*, CASE WHEN r IS NULL THEN 'excluded_eval_similar' WHEN r < round_even(many * 0.1, 0) THEN 'test' WHEN r < 2 * round_even(many * 0.1, 0) THEN 'val' ELSE 'train' END AS split FROM f LEFT JOIN clean USING (cluster)),
        m AS (SELECT {", ".join(f"avg({x}) AS {x}_m, CASE WHEN stddev_pop({x}) > 0 THEN stddev_pop({x}) ELSE 1 END AS {x}_d" for x in training_set.FEATURES)} FROM s WHERE split = 'train'),
        l AS (SELECT doc_id, max(quality)::INT AS label FROM labels GROUP BY 1)
        SELECT s.doc_id, lang, cluster, concat_ws(';', CASE WHEN n > 0 THEN 'N:1-' || n END, CASE WHEN c > 0 THEN 'C:' || (residues - c + 1) || '-' || residues END) AS tags, label, (label IS NOT NULL)::INT AS eval_mask,
          {", ".join(f"round(({x} - {x}_m) / {x}_d, 5) AS {x}" for x in training_set.FEATURES)}, split FROM s LEFT JOIN l USING (doc_id), m
    """,
    "job2_evaluate_new": f"""
        WITH d AS (SELECT doc_id, lang AS grp, (length(t) - length(regexp_replace(t, '[!?A-Z]', '', 'g'))) / greatest(length(t), 1) AS score FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)),
        l AS (SELECT doc_id, max(toxic) AS label FROM labels GROUP BY 1),
        r AS (SELECT grp, score, label FROM d JOIN l USING (doc_id) WHERE label IS NOT NULL), {METRICS_SQL}
        SELECT doc_id, d.grp, round(score, 9) AS score, round(CASE WHEN p > 0 AND n > p THEN u / (p * (n - p)) END, 6) AS AUROC, round(CASE WHEN p > 0 THEN ap / p ELSE 0.0 END, 6) AS AUPRC, n::BIGINT AS rows, p::BIGINT AS positive
        FROM d LEFT JOIN s ON d.grp = s.grp
    """,
}
