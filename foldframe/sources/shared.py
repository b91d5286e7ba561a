"""Tables that cut a lineage: Parquet in the folder of ``spark.checkpoint.dir``, which driver and executors share.

A lost executor or a restarted driver reads them again.  Inside ``scratch`` they are removed once the block ends.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: For each open ``scratch`` block, the folders written in it.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("_OPEN", default=())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a folder of its own; a cluster has no folder to guess.
    """
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='foldframe-')}"
    spark.sparkContext.setCheckpointDir(base)
    return jsc.getCheckpointDir().get()


def shared_folder(spark: SparkSession, purpose: str, depth: int = 1) -> str:
    """A new folder below the shared checkpoint folder (URI), left to the ``depth``-th open ``scratch`` block."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    blocks = _OPEN.get()
    if len(blocks) >= depth:
        blocks[-depth].append(path)
    return path


def checkpointed(df: DataFrame, depth: int = 1) -> DataFrame:
    """Cut the lineage with a table in the shared folder.

    Unlike ``DataFrame.checkpoint`` the files are columnar and compressed, and the planner knows their size.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "table", depth)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def outliving(df: DataFrame) -> DataFrame:
    """``checkpointed``, but the table stays when the innermost ``scratch`` block ends."""
    return checkpointed(df, depth=2)


def has_scheme(path: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) is not None


def files_of(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) for tasks, which have no Spark session."""
    return fs.FileSystem.from_uri(path) if has_scheme(path) else (fs.LocalFileSystem(), path)


def place_of(spark: SparkSession, path: str):
    """(Hadoop path, its file system): what Spark itself would look at."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = place_of(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    place, system = place_of(spark, path)
    system.delete(place, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, replaced if it is there."""
    place, system = place_of(spark, path)
    stream = system.create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``checkpointed`` writes inside the block are removed at its end."""
    mine: list[str] = []
    token = _OPEN.set((*_OPEN.get(), mine))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in mine:
            remove(spark, path)
