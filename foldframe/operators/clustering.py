"""Clusters of similar sequences: spaced words to hits, ungapped extension, alignments to links, links to components.

Distant relatives share few words of adjacent residues, so words are read through patterns of gaps, and some of them in
a reduced alphabet, where residues that replace each other are one letter.  A word's holders are dealt by a hash to
``SLOTS`` slots, each slot has a centre, and every holder meets every centre of the word: up to some ``SLOTS`` holders
nearly all of them meet, beyond that each meets ``SLOTS`` others, so hits grow with the letters of the input and never
with the square of a word's group.  A hit counts if the residues around it, on the same diagonal, are alike enough;
only then are two sequences aligned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import clean_sequence
from ..schemas import require_columns
from ..sources.shared import checkpointed, outliving, scratch
from .align import align_pairs
from .components import connected_components

#: Residues that replace each other often are one letter (Murphy, Wallqvist and Levy 2000, ten groups).
GROUPS = ["LVIM", "C", "A", "G", "ST", "P", "FYW", "EDNQ", "KR", "H"]
SLOTS = 32
#: Equal and unequal residues on a diagonal: the odds of 35 % identity against chance, in whole numbers.
EQUAL, UNEQUAL, ENOUGH = 5, -1, 38


def patterns(weight: int, span: int) -> list[tuple[int, ...]]:
    """Places of ``weight`` residues in every window up to ``span`` that has one at each end."""
    return [(0, *inner, size - 1) for size in range(weight, span + 1) for inner in combinations(range(1, size - 1), weight - 2)]


PATTERNS = [(False, p) for p in patterns(5, 7)] + [(True, p) for p in patterns(7, 8)]
_PLAIN, _REDUCED = np.full(256, 26, np.int64), np.full(256, 10, np.int64)
_PLAIN[np.arange(65, 91)] = np.arange(26)
for _i, _group in enumerate(GROUPS):
    _REDUCED[[ord(c) for c in _group]] = _i


def words_of(sequence: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words, their first places); what is no capital letter is one more letter."""
    raw = np.frombuffer(sequence.encode("latin-1", "replace"), np.uint8)
    words, places = [], []
    for k, (reduced, pattern) in enumerate(PATTERNS):
        n = len(raw) - pattern[-1]
        if n > 0:
            letters, base = (_REDUCED[raw], 11) if reduced else (_PLAIN[raw], 27)
            words.append((k << 48) + sum(letters[at : at + n] * base**j for j, at in enumerate(pattern)))
            places.append(np.arange(n))
    return (np.concatenate(words), np.concatenate(places)) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def sequence_words(classes: DataFrame) -> DataFrame:
    """id, size, word, pos: every word of every sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, sequence in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, places = words_of(sequence)
                n = len(words)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.string()), pa.array(np.full(n, len(sequence), np.int32)), pa.array(words), pa.array(places.astype(np.int32))], names=["id", "size", "word", "pos"])

    return classes.select("id", "sequence").mapInArrow(run, "id string, size int, word long, pos int")


def best_run(a: np.ndarray, b: np.ndarray, diagonal: int) -> int:
    """The best score of a run of positions i of ``a`` and i - ``diagonal`` of ``b``."""
    low, high = max(0, diagonal), min(len(a), len(b) + diagonal)
    if high <= low:
        return 0
    sums = np.cumsum(np.where(a[low:high] == b[low - diagonal : high - diagonal], EQUAL, UNEQUAL))
    return int((sums - np.minimum.accumulate(np.concatenate([[0], sums[:-1]]))).max())


def _extends(own: pd.Series, other: pd.Series, diagonals: pd.Series) -> pd.Series:
    """Is there a diagonal whose best run reaches ``ENOUGH`` (or the shorter length, where that is less)?"""
    out = []
    for a, b, ds in zip(own, other, diagonals, strict=True):
        x, y = (np.frombuffer(t.encode("latin-1", "replace"), np.uint8) for t in (a, b))
        enough = min(ENOUGH, len(x), len(y))
        out.append(any(best_run(x, y, int(d)) >= enough for d in ds))
    return pd.Series(out, dtype=bool)


def seed_pairs(classes: DataFrame, min_coverage: float, slots: int = SLOTS) -> DataFrame:
    """(a, b, diagonals) with a < b of ``classes`` (id, sequence): pairs that share a word, and the diagonals of the hits.

    Lengths that rule out the coverage do not meet.  Centres are aggregates with partial results; the join has at most
    ``slots`` rows of a word on its centre side, so a frequent word is split by adaptive execution like any skewed key.
    """
    words = sequence_words(classes)
    hashed = F.xxhash64("id", "word")
    first = F.min(F.struct(hashed.alias("h"), "id", "pos", "size")).alias("c")
    centres = words.groupBy("word", F.pmod(hashed, F.lit(slots)).alias("slot")).agg(first).select("word", F.col("c.id").alias("centre"), F.col("c.pos").alias("at"), F.col("c.size").alias("long"))
    near = (F.col("size") >= min_coverage * F.col("long")) & (F.col("long") >= min_coverage * F.col("size"))
    hits = words.join(centres, "word").where((F.col("id") != F.col("centre")) & near)
    turned = F.col("id") > F.col("centre")
    diagonal = F.when(turned, F.col("at") - F.col("pos")).otherwise(F.col("pos") - F.col("at"))
    return hits.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"), diagonal.alias("d")).groupBy("a", "b").agg(F.collect_set("d").alias("diagonals"))  # no more diagonals than letters


def cluster_sequences(manifest: DataFrame, min_identity: float = 0.3, min_coverage: float = 0.8) -> DataFrame:
    """cluster, protein_id: connected components of sequences that align; a cluster has the name of its least protein.

    Two sequences link if they have an extended hit and their global alignment has equal residues in at least
    ``min_identity`` of its columns and pairs over at least ``min_coverage`` of the longer one.  A link without any hit
    is not found: at 35 % conserved sites that is about one in twenty of 150 residues, and more of shorter sequences.
    Sequences are cleaned first.  Proteins of equal sequences, and rows of one ``protein_id``, are always together.
    Empty and null sequences resemble nothing, not even each other.  Rows without a ``protein_id`` are left out; an
    empty manifest has no clusters; other columns are ignored.
    """
    require_columns(manifest, {"protein_id", "sequence"}, "Manifest missing columns")
    spark = manifest.sparkSession
    with scratch(spark):
        rows = manifest.select(F.col("protein_id").cast("string").alias("protein_id"), clean_sequence(F.col("sequence")).alias("sequence")).dropna(subset=["protein_id"])
        rows = checkpointed(rows.withColumn("id", F.md5("sequence")))
        known = rows.where(F.col("sequence") != "")
        classes = checkpointed(known.groupBy("id").agg(F.first("sequence").alias("sequence"), F.min("protein_id").alias("node")))
        side = lambda key, text, node: classes.select(F.col("id").alias(key), F.col("sequence").alias(text), F.col("node").alias(node))
        pairs = seed_pairs(classes, min_coverage).join(side("a", "own", "p"), "a").join(side("b", "other", "q"), "b")
        extends = F.pandas_udf(_extends, "boolean")
        alike = checkpointed(pairs.where(extends("own", "other", "diagonals")).select("p", "q", "own", "other"))
        met = align_pairs(alike, "own", "other")
        longer = F.greatest(F.length("own"), F.length("other"))
        equal = F.size(F.filter("alignment.pairs", lambda x: F.substring("own", x["a"] + 1, F.lit(1)) == F.substring("other", x["b"] + 1, F.lit(1))))
        links = met.where((equal >= min_identity * F.length("alignment.aligned_a")) & (F.size("alignment.pairs") >= min_coverage * longer)).select(F.col("p").alias("a"), F.col("q").alias("b"))
        copies = known.join(classes.select("id", F.col("node").alias("a")), "id").select("a", F.col("protein_id").alias("b"))
        found = connected_components(links.unionByName(copies))
        proteins = rows.select("protein_id").distinct()
        done = proteins.join(found, proteins.protein_id == found.node, "left")
        return outliving(done.select(F.coalesce("component", "protein_id").alias("cluster"), "protein_id"))
