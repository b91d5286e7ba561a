"""Scans of the contract's files."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import entity_from_id
from ..operators.rows import dense_index
from ..schemas import require_columns
from .shared import checkpointed, exists, files_of


def read_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Parquet by its suffix, else CSV with a header, every column as text (no pass over the data to guess types).

    The names of a table's parts (``writers.write_part``) are no column of it.
    """
    first = path if isinstance(path, str) else path[0]
    found = spark.read.parquet(*([path] if isinstance(path, str) else path)) if first.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True)
    return found.drop("commit") if "commit" in found.columns else found


def with_file_order(df: DataFrame) -> DataFrame:
    """``ord``: 0-based number of a row in the order of paths and of rows in each file.

    ``df`` is a scan.  Spark packs blocks of files into tasks by size, so the order of tasks is not that of files; a
    row's place is its file, the start of its block, and its number in the task, which goes on within a block.
    """
    place = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    return dense_index(place, ["_path", "_start", "_row"], "ord").drop("_path", "_start", "_row")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    manifest = read_table(spark, path)
    require_columns(manifest, {"protein_id", "sequence"}, "Manifest missing required columns")
    manifest = with_file_order(manifest)
    if "entity_id" not in manifest.columns:
        manifest = manifest.withColumn("entity_id", entity_from_id(F.col("protein_id")))
    return manifest


def read_label_zip(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ZIP archives that hold one column-oriented JSON file each: {column: {row: value}}.

    An archive is inflated in the task that reads it and leaves as one text per row.
    """

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part.path, part.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = [n for n in archive.namelist() if n.endswith(".json")]
                    if len(members) != 1:
                        raise ValueError(f"Expected exactly one JSON file in {name}, found {members}")
                    table = json.loads(archive.read(members[0]))
                keys = list(dict.fromkeys(k for column in table.values() for k in column))
                yield pd.DataFrame({"ord": np.arange(len(keys)), "row": [json.dumps({c: table[c].get(k) for c in table}) for k in keys]})

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "ord long, row string")
    first = raw.first()
    columns = list(json.loads(first.row)) if first else []
    schema = ", ".join(f"`{c}` string" for c in columns)
    return validate_labels(raw.select("ord", F.from_json("row", schema).alias("r")).select("ord", "r.*") if columns else raw)


def validate_labels(labels: DataFrame) -> DataFrame:
    """Required columns are there, and every label is as long as its sequence (before blanks are removed)."""
    require_columns(labels, {"entry_ID", "sequence", "label", "seq len", "same len as seq?"}, "label file missing required columns")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    bad = labels.where(F.length(text("sequence")) != F.length(text("label"))).select("entry_ID", F.length(text("sequence")), F.length(text("label"))).limit(5).collect()
    if bad:
        raise ValueError(f"sequence/label length mismatch: {[tuple(r) for r in bad]}")
    return labels


def structure_lines(texts: DataFrame) -> DataFrame:
    """(structure_id, line_no, line) from (structure_id, value) with whole files as values."""
    return texts.select("structure_id", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """Lines of structure files; a file's id is its path without the scheme."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_path", r"^file:/+", "/").alias("structure_id"), "value")
    return structure_lines(files)


def _given_path(manifest: DataFrame) -> Column:
    named = [F.col(c).cast("string") for c in ("pdb_path", "pdb_filename", "pdb_path_relative") if c in manifest.columns]
    return F.coalesce(*named, F.concat(F.col("protein_id").cast("string"), F.lit(".pdb")))


def structure_places(manifest: DataFrame, base: str, root: str | None = None) -> DataFrame:
    """(structure_id) every place where ``resolve_structure_paths`` may find a row's structure."""
    given = _given_path(manifest)
    below = F.concat(F.lit(f"{(root or base).rstrip('/')}/"), given)
    flat = F.concat(F.lit(f"{(root or base).rstrip('/')}/"), F.element_at(F.split(given, "/"), -1))
    places = F.when(F.startswith(given, F.lit("/")), F.array(given)).otherwise(F.array(below, flat) if root else F.array(below))
    return manifest.select(F.explode(places).alias("structure_id"))


def existing_files(paths: DataFrame) -> DataFrame:
    """The distinct ``structure_id`` that are files; executors look them up, so no folder is listed."""

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            there = []
            for path in part.structure_id:
                system, name = files_of(path)
                there.append(system.get_file_info(name).type == FileType.File)
            yield part[np.array(there, dtype=bool)]

    width = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(paths.select("structure_id").dropna().distinct().repartition(width).mapInPandas(look, "structure_id string"))


def read_named_structures(files: DataFrame) -> DataFrame:
    """Lines of the files that ``structure_id`` names, wherever they lie; read in tasks, one file in memory at a time."""

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part.structure_id:
                system, name = files_of(path)
                with system.open_input_stream(name) as stream:
                    yield pd.DataFrame({"structure_id": [path], "value": [stream.readall().decode("utf-8", "replace")]})

    return structure_lines(files.mapInPandas(load, "structure_id string, value string"))


def resolve_structure_paths(manifest: DataFrame, base: str, root: str | None = None, existing: DataFrame | None = None) -> DataFrame:
    """``pdb_path`` of each row: the first of pdb_path, pdb_filename, pdb_path_relative, {protein_id}.pdb that is there.

    Absolute paths stay.  Below a root, the bare file name is taken if it is among ``existing`` (structure_id), else
    the path as given; without a root paths are relative to ``base``.
    """
    df = manifest.withColumn("_given", _given_path(manifest)).withColumn("_flat", F.concat(F.lit(f"{(root or base).rstrip('/')}/"), F.element_at(F.split("_given", "/"), -1)))
    full = F.concat(F.lit(f"{(root or base).rstrip('/')}/"), "_given")
    if root is None:
        path = full
    elif existing is None:
        path = F.col("_flat")
    else:
        df = df.join(existing.select(F.col("structure_id").alias("_flat"), F.lit(True).alias("_there")).distinct(), "_flat", "left")
        path = F.when(F.col("_there"), F.col("_flat")).otherwise(full)
    return df.withColumn("pdb_path", F.when(F.startswith("_given", F.lit("/")), F.col("_given")).otherwise(path)).drop("_given", "_flat", "_there")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="cluster string, protein_id string")


def read_eval_ids(spark: SparkSession, path: str) -> DataFrame:
    ids = read_table(spark, path)
    require_columns(ids, {"protein_id"}, "eval ids missing columns")
    return ids.select("protein_id")


def read_embeddings(spark: SparkSession, index: DataFrame) -> DataFrame:
    """(protein_id, position, embedding) of the NPZ files that an index names, read in tasks."""

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for pid, path in zip(part.protein_id, part.embedding_path, strict=True):
                system, name = files_of(path)
                with system.open_input_file(name) as stream:
                    values = np.load(io.BytesIO(stream.read()))["embedding"].astype(np.float32)
                yield pd.DataFrame({"protein_id": pid, "position": np.arange(1, len(values) + 1, dtype=np.int32), "embedding": list(values)})

    rows = index.select(F.col("protein_id").cast("string").alias("protein_id"), "embedding_path")
    return rows.mapInPandas(load, "protein_id string, position int, embedding array<float>")


def stored_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """(protein_id) of the NPZ files of a folder; Spark lists it, and no content is read."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "protein_id string")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder)
    return found.select(F.regexp_extract(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"([^/]*)\.npz$", 1).alias("protein_id"))


def merge_indices(spark: SparkSession, pattern: str) -> DataFrame:
    """Shard indices as one table, one row per protein (left-over shards of another count repeat proteins)."""
    return spark.read.csv(pattern, header=True).dropDuplicates(["protein_id"])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
