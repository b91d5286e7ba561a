"""Sinks: CSV and Parquet tables, checkpointed appends, FASTA, NPZ, JSON sidecars."""

from __future__ import annotations

import io
import json
import uuid
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import files_of


def write_table(df: DataFrame, path: str, append: bool = False, one_file: bool = False) -> None:
    """A folder of CSV (with header) or, by suffix, Parquet files; the schema is written even without rows."""
    df = df.coalesce(1) if one_file else df
    mode = "append" if append else "overwrite"
    if path.rstrip("/").endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).csv(path, header=True)


PART = "commit"


def write_part(df: DataFrame, path: str, name: str) -> None:
    """One named part of a table (a partition folder, of the table's kind), which a rerun of the same part replaces."""
    place = f"{path.rstrip('/')}/{PART}={name}"
    if path.rstrip("/").endswith(".parquet"):
        df.write.mode("overwrite").parquet(place)
    else:
        df.write.mode("overwrite").csv(place, header=True)


def fasta_record(key: str, sequence: str) -> Column:
    return F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"), F.col(sequence).cast("string"))


def write_fasta(df: DataFrame, path: str) -> None:
    df.select(fasta_record("protein_id", "sequence").alias("value")).write.mode("overwrite").text(path)


def write_clusters(clusters: DataFrame, path: str) -> None:
    """A folder of headless tab-separated files: cluster, protein."""
    clusters.select("cluster", "protein_id").write.mode("overwrite").csv(path, sep="\t")


def write_npz(embeddings: DataFrame, sequences: DataFrame, folder: str) -> DataFrame:
    """One NPZ per protein (embedding as 16-bit floats, sequence, positions) in a folder all executors share."""

    def save(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        path = f"{folder.rstrip('/')}/{group.protein_id.iloc[0]}.npz"
        packed = io.BytesIO()
        np.savez_compressed(packed, embedding=np.stack(group.embedding.to_numpy()).astype(np.float16), sequence=group.sequence.iloc[0], positions_1based=group.position.to_numpy(np.int32))
        system, name = files_of(path)
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"  # not an NPZ name, so a task that is lost leaves nothing to resume from
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(temporary) as stream:
            stream.write(packed.getvalue())
        system.move(temporary, name)
        return pd.DataFrame({"protein_id": [group.protein_id.iloc[0]], "embedding_path": [path], "sequence_length": [len(group)]})

    rows = embeddings.join(sequences.select("protein_id", "sequence"), "protein_id")
    return rows.groupBy("protein_id").applyInPandas(save, "protein_id string, embedding_path string, sequence_length int")


def write_json(path: str, payload: dict) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, indent=2), encoding="utf-8")


# The contract of the label file.
def label_schema(source: str, min_coverage: float, min_identity: float) -> dict:
    return {
        "source": source,
        "format": "column-oriented pandas JSON inside ZIP",
        "required_fields": ["entry_ID", "sequence", "label", "seq len", "same len as seq?"],
        "alignment": {"min_label_coverage": min_coverage, "min_identity": min_identity, "terminal_histag_regex": "H{6,}"},
    }
