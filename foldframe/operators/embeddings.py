"""Per-residue embeddings: row selection, a pluggable encoder, and the index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import clean_sequence

MODEL, LAYER = "facebook/esm2_t30_150M_UR50D", 30
#: Takes sequences, returns one (length, width) array for each.
Encoder = Callable[[list[str]], list[np.ndarray]]


def index_filename(shard_index: int | None = None, num_shards: int | None = None) -> str:
    return "embedding_index.csv" if shard_index is None or num_shards is None else f"embedding_index_shard_{shard_index:04d}_of_{num_shards:04d}.csv"


def embedding_index(manifest: DataFrame, model_name: str = MODEL, layer: int = LAYER) -> DataFrame:
    """The index rows of selected manifest rows, in manifest order (``row_index``)."""
    pid = F.col("protein_id").cast("string")
    return manifest.select(pid.alias("protein_id"), F.length(clean_sequence(F.col("sequence"))).alias("sequence_length"), F.concat(pid, F.lit(".npz")).alias("embedding_path"), F.lit(model_name).alias("model_name"), F.lit(layer).alias("layer"), F.lit("float16").alias("dtype"), "row_index").orderBy("row_index").drop("row_index")


def half_precision(values: np.ndarray) -> np.ndarray:
    """What is left of numbers that were stored with 16 bits."""
    return np.asarray(values).astype(np.float16).astype(np.float32)


def encode_residues(manifest: DataFrame, encoder: Encoder | None, batch: int = 8) -> DataFrame:
    """(protein_id, position, embedding) by an encoder that runs in each task; needs no shuffle.

    Without an encoder this raises, as no substitute values are made up.
    """
    if encoder is None:
        raise RuntimeError("Embedding extraction needs an encoder; its machine-learning libraries are not installed.")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for a in range(0, len(part), batch):
                chunk = part.iloc[a : a + batch]
                for pid, seq, values in zip(chunk.protein_id, chunk.sequence, encoder(chunk.sequence.tolist()), strict=True):
                    if len(values) != len(seq):
                        raise ValueError(f"Embedding length mismatch for {pid}: {len(values)} != {len(seq)}")
                    yield pd.DataFrame({"protein_id": pid, "position": np.arange(1, len(seq) + 1, dtype=np.int32), "embedding": list(half_precision(values))})

    rows = manifest.select(F.col("protein_id").cast("string").alias("protein_id"), clean_sequence(F.col("sequence")).alias("sequence"))
    return rows.mapInPandas(run, "protein_id string, position int, embedding array<float>")
