"""Incremental ingest of structure files with Structured Streaming (an extension: batch in, batch out)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.structure import parse_atoms
from ..sources.readers import structure_lines


def structure_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """(structure_id, value) of structure files as they appear."""
    stream = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    return stream.select(F.regexp_replace("_metadata.file_path", r"^file:/+", "/").alias("structure_id"), "value")


def ingest_structures(spark: SparkSession, folder: str, atoms_path: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Parse every file that was not parsed before and append its atoms; ends when all present files are done.

    The checkpoint remembers files, so a restart goes on where the last run stopped; each micro-batch overwrites its
    own partition of the output, so a batch that is run twice leaves its atoms once.
    """

    def append(batch: DataFrame, number: int) -> None:
        parse_atoms(structure_lines(batch)).write.mode("overwrite").parquet(f"{atoms_path}/batch={number}")

    return structure_stream(spark, folder, files_per_batch).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
