"""A small multilayer perceptron over joined residue rows, trained data-parallel in numpy."""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import random
import subprocess
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CHI_COLUMNS, require_rows
from ..sources.shared import scratch
from .dataset import fit_normalizer
from .rows import dense_index, masked, members

# The model inputs of the data contract, in order.
NUMERIC_FEATURES = [
    "sidechain_heavy_atom_count", "ca_to_sidechain_centroid_distance", "sidechain_spread", "contact_count_4a", "contact_count_6a", "contact_count_8a", "packing_density_8a",
    "hydrophobic_contact_count", "polar_contact_count", "charged_contact_count", "aromatic_contact_count", "salt_bridge_count", "cation_pi_count",
    "disulfide_flag", "plddt", "total_sasa", "sidechain_sasa", "relative_sasa", "sasa_mask",
] + CHI_COLUMNS
# The size of the model, and the variants that an ablation run compares.
HIDDEN, DROPOUT = 128, 0.1
VARIANTS = [("embedding_only", "embedding", 0.0), ("sidechain_only", "sidechain", 0.0), ("fusion_lambda0", "fusion", 0.0), ("fusion_lambda02", "fusion", 0.2), ("fusion_lambda1", "fusion", 1.0)]
#: Rows that a task trains on, and models that the driver averages.
SHARD_ROWS, TEAMS = 50_000, 64


def seed_everything(seed: int) -> None:
    random.seed(seed)
    np.random.seed(seed)
    os.environ["PYTHONHASHSEED"] = str(seed)


def git_commit() -> str | None:
    done = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True)
    return done.stdout.strip() or None


def write_run_metadata(path: str | Path, payload: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload | {"git_commit": git_commit()}, indent=2, sort_keys=True), encoding="utf-8")


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def model_inputs(rows: DataFrame, features: list[str], model_type: str, embeddings: DataFrame | None) -> DataFrame:
    """(x array<float>, y double): embedding, features, or both one after the other.

    Embeddings are (protein_id, position, embedding); a row without one is an error, not a loss.
    """
    feats = F.array(*(F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in features)).cast("array<float>")
    if model_type == "sidechain":
        return rows.select(feats.alias("x"), F.col("label").cast("double").alias("y"))
    if embeddings is None:
        raise ValueError(f"model type {model_type} needs embeddings")
    keyed = embeddings.select(F.col("protein_id").cast("string").alias("_p"), F.col("position").cast("int").alias("_q"), F.col("embedding").cast("array<float>").alias("_e"))
    joined = rows.join(keyed, (F.col("protein_id").cast("string") == F.col("_p")) & (F.col("sequence_pos_1based").cast("int") == F.col("_q")), "left")
    lost = joined.where("_e is null").select("protein_id", "sequence_pos_1based").limit(5).collect()
    if lost:
        raise KeyError(f"no embedding for {[tuple(r) for r in lost]}")
    x = F.col("_e") if model_type == "embedding" else F.concat("_e", feats)
    return joined.select(x.alias("x"), F.col("label").cast("double").alias("y"))


class Perceptron:
    """in -> 128 -> ReLU -> dropout -> 1, AdamW on the logistic loss."""

    def __init__(self, width: int, seed: int):
        r = np.random.default_rng(seed)
        a, b = width**-0.5, HIDDEN**-0.5
        self.p = [r.uniform(-a, a, (width, HIDDEN)), r.uniform(-a, a, HIDDEN), r.uniform(-b, b, HIDDEN), r.uniform(-b, b, 1)]
        self.m, self.v, self.step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3][0]

    def train_batch(self, x: np.ndarray, y: np.ndarray, rate: float, r: np.random.Generator, decay: float = 0.01) -> float:
        pre = x @ self.p[0] + self.p[1]
        keep = (r.random(pre.shape) >= DROPOUT) / (1 - DROPOUT)
        h = np.maximum(pre, 0) * keep
        z = h @ self.p[2] + self.p[3][0]
        d = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
        dh = np.outer(d, self.p[2]) * keep * (pre > 0)
        self.step += 1
        for i, g in enumerate((x.T @ dh, dh.sum(0), h.T @ d, d.sum(keepdims=True))):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            update = self.m[i] / (1 - 0.9**self.step) / (np.sqrt(self.v[i] / (1 - 0.999**self.step)) + 1e-8)
            self.p[i] = self.p[i] * (1 - rate * decay) - rate * update
        return float(np.mean(np.logaddexp(0, z) - y * z))


def averaged(copies: list[Perceptron], rows: list[int]) -> Perceptron:
    """The mean of models, weighted by the rows that each has seen."""
    out, share = copies[0], np.array(rows, float) / sum(rows)
    for name in ("p", "m", "v"):
        setattr(out, name, [sum(w * getattr(c, name)[i] for w, c in zip(share, copies, strict=True)) for i in range(4)])
    out.step = max(c.step for c in copies)
    return out


def _shard_trainer(packed: bytes, seed: int, epoch: int, batch: int, rate: float) -> Callable[[pa.Table], pa.Table]:
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("_i")
        own, shard = pickle.loads(packed), part.column("_shard")[0].as_py()
        x = part.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        y, r, loss = part.column("y").to_numpy(), np.random.default_rng([seed, epoch, shard]), []
        order = r.permutation(len(y))
        for i in range(0, len(y), batch):
            pick = order[i : i + batch]
            loss.append(own.train_batch(x[pick].astype(float), y[pick], rate, r))
        columns = {"team": (shard % TEAMS, pa.int32()), "shard": (shard, pa.int32()), "model": (pickle.dumps(own), pa.binary()), "loss": (sum(loss), pa.float64()), "batches": (len(loss), pa.int64()), "n": (len(y), pa.int64())}
        return pa.table({name: pa.array([value], kind) for name, (value, kind) in columns.items()})

    return run


def _merge(part: pd.DataFrame) -> pd.DataFrame:
    """One model of a team's."""
    part = part.sort_values("shard")
    mean = averaged([pickle.loads(m) for m in part.model], part.n.tolist())
    return pd.DataFrame({"team": [part.team.iloc[0]], "model": [pickle.dumps(mean)], "loss": [part.loss.sum()], "batches": [part.batches.sum()], "n": [part.n.sum()]})


def fit_perceptron(data: DataFrame, seed: int = 13, epochs: int = 5, batch: int = 256, rate: float = 1e-3, shard_rows: int = SHARD_ROWS) -> tuple[Perceptron, list[dict]]:
    """Each epoch a copy of the model is trained on the shuffled batches of every shard; the copies are averaged by rows.

    A shard has about ``shard_rows`` rows, which one task holds; up to that many rows this is plain mini-batch training.
    Rows are numbered in the order of their hash and dealt out in turn, so shards, batches and model depend on the rows
    alone, not on partitions, and equal rows are spread evenly.  Copies are averaged in tasks first; at most ``TEAMS`` of
    them come to the driver.
    """
    spark = data.sparkSession
    with scratch(spark):
        keyed = data.select("x", "y", F.xxhash64("x", "y").alias("_h"), F.monotonically_increasing_id().alias("_t"))
        numbered = dense_index(keyed, ["_h", "_t"], "_i")
        shards = max(1, -(-numbered.count() // shard_rows))
        ready = numbered.select("x", "y", "_i", (F.col("_i") % shards).cast("int").alias("_shard"))  # the rows are written already
        model, history = Perceptron(len(ready.first().x), seed), []
        for epoch in range(epochs):
            copies = ready.groupBy("_shard").applyInArrow(_shard_trainer(pickle.dumps(model), seed, epoch, batch, rate), "team int, shard int, model binary, loss double, batches long, n long")
            done = sorted(copies.groupBy("team").applyInPandas(_merge, "team int, model binary, loss double, batches long, n long").collect())
            model = averaged([pickle.loads(r.model) for r in done], [r.n for r in done])
            history.append({"epoch": epoch + 1, "loss": sum(r.loss for r in done) / sum(r.batches for r in done)})
    return model, history


def train_model(data: DataFrame, split: DataFrame, out_dir: str, embeddings: DataFrame | None = None, model_type: str = "fusion", seed: int = 13, epochs: int = 5, batch: int = 256, rate: float = 1e-3, lambda_missing: float = 0.2) -> dict:
    """Train on masked rows of train proteins; writes normalizer.json, model.npz, history.json, run_metadata.json.

    ``lambda_missing`` is recorded and has no effect, as in the behaviour this follows.
    """
    seed_everything(seed)
    rows = require_rows(masked(members(data, split.where("split = 'train'"), "protein_id")), "No training residues with eval_mask=1")
    features = [c for c in NUMERIC_FEATURES if c in data.columns]
    normalizer = fit_normalizer(rows, features)
    model, history = fit_perceptron(model_inputs(normalizer.transform(rows), features, model_type, embeddings), seed, epochs, batch, rate)
    out = Path(out_dir)
    out.mkdir(parents=True, exist_ok=True)
    (out / "normalizer.json").write_text(normalizer.to_json(), encoding="utf-8")
    np.savez(out / "model.npz", *model.p, model_type=model_type, feature_cols=np.array(features, str))
    (out / "history.json").write_text(json.dumps(history, indent=2), encoding="utf-8")
    write_run_metadata(out / "run_metadata.json", {"model_type": model_type, "seed": seed, "epochs": epochs, "batch_size": batch, "lr": rate, "lambda_missing": lambda_missing})
    return {"history": history, "feature_cols": features, "out_dir": str(out), "model": model, "normalizer": normalizer}


def score_rows(inputs: DataFrame, model: Perceptron) -> DataFrame:
    """An extension: probabilities for rows with a column ``x``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            z = model.logits(np.stack(part.x.to_numpy()).astype(float)) if len(part) else np.zeros(0)
            yield part.assign(score=1 / (1 + np.exp(-np.clip(z, -60, 60))))

    return inputs.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema) + ", score double")


def run_ablations(data: DataFrame, split: DataFrame, out_dir: str, embeddings: DataFrame | None = None, epochs: int = 5, seed: int = 13) -> pd.DataFrame:
    """Five variants; the index (ablation, model_type, lambda_missing, out_dir) is written beside them."""
    data = data.cache()
    rows = [{"ablation": n, "model_type": t, "lambda_missing": lam, "out_dir": train_model(data, split, f"{out_dir}/{n}", embeddings, t, seed, epochs, lambda_missing=lam)["out_dir"]} for n, t, lam in VARIANTS]
    data.unpersist()
    index = pd.DataFrame(rows)
    index.to_csv(Path(out_dir) / "ablation_index.csv", index=False)
    return index
