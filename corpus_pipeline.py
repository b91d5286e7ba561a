"""The corpus pipeline: five stages over ``documents``, each one a training-data operator whose decisions take effect.

Every stage is a function of (session, documents so far, folder of the tables); all but the last return the columns
of ``documents``.  Stages read what their predecessor wrote, so each starts from files, not from a long lineage.
Rows with null or empty texts come through every stage that does not decide against them; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldframe.llm.common import checkpointed, table
from foldframe.llm.decontam import drop_contaminated
from foldframe.llm.ngram_join import keep_first_of_components
from foldframe.llm.pieces import encode_pieces
from foldframe.llm.quality import keep_quality, train_quality
from foldframe.llm.queries import piece_model_path
from foldframe.llm.suffix_dedup import cut_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each component of the n-gram Jaccard join."""
    return keep_first_of_components(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that also start earlier."""
    return cut_repeats(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), error_rate=0.1)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (with begin and end) of each document."""
    return encode_pieces(docs, piece_model_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("contamination", contamination), ("pieces", pieces)]

#: A trained network, a join on unbounded groups and a tokenizer are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
