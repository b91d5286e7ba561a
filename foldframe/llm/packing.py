"""Best-fit packing: token pieces of documents into sequences of a fixed capacity.

Best-fit decreasing looks only at sizes, and sizes are whole numbers up to the capacity.  So what it does to a corpus
is settled by the count of each size: items of one size are placed run by run, each run into the tightest open bin that
a segment tree over remaining capacities finds, exactly as if they came one at a time.  The counts (a row per size) and
the plan that comes of them do not grow with the corpus; the items themselves never leave their partitions' order: an
item's rank among those of its size is its rank in its partition plus the counts of the partitions before.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, id_and_text, release_memory, slices

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids binary"
#: Words after which a worker's cache starts a new half, and the longest that it takes in.
CACHED, LONGEST = 1 << 19, 64


class WordEncoder(dict):
    """Ids of whole texts from the ids of their words, of which this dictionary holds the recent ones.

    The vocabulary's pre-tokenizer drops white space, so no token reaches over a blank, and nor do composition and
    lower-casing: a text has the ids of its words one after the other.  Only ASCII blanks part words; what else the
    tokenizer takes for white space is left to it.  In the same way a word of Latin letters is parted from the ASCII
    punctuation at its end and looked up in lower case; and as a word of ASCII letters is one pre-token, of which each
    byte stands for itself, it goes straight to the vocabulary's merges.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.stem = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.;:!?]*)").fullmatch
        self.plain = re.compile("[a-z]+").fullmatch
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if self.plain(word):
                ids = np.array([t.id for t in self.merges(word)], "<u4").tobytes()
            elif (m := self.stem(word)) and (m[2] or not word.islower()):
                ids = self[m[1].lower()] + self[m[2]]
            else:
                ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if len(self) > CACHED:
            self.old = dict(self)
            self.clear()
            self[""] = b""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker: it costs more to load than a small task has to do, and its words come again."""
    return WordEncoder(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids: each whole text's ids and ``end_id``, cut where they pass ``capacity``.

    ``ids`` are little-endian unsigned 32-bit integers.  An empty or null text is ``end_id`` alone.  Rows without an id
    keep a null one, repeated rows each have pieces of their own, and columns other than the two are ignored; ids are
    integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = word_encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = batch.column("text")
            doc_ids = batch.column("doc_id")
            for lo, hi in slices(np.fromiter((len(t.as_py()) for t in texts), np.int64, len(texts)), 4_000_000):
                rows = []
                for doc_id, ids in zip(doc_ids.slice(lo, hi - lo).to_pylist(), map(encoder.encode, texts.slice(lo, hi - lo).to_pylist()), strict=True):
                    ids += last
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, part))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids"])
        release_memory()

    return id_and_text(docs, id_col, text_col).mapInArrow(run, PIECES)


class RoomTree:
    """A segment tree over the remaining capacities 0 .. capacity: which of them has an open bin."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.width)

    def set(self, room: int, there: bool) -> None:
        node = room + self.width
        self.some[node] = there
        while node > 1:
            node >>= 1
            self.some[node] = self.some[2 * node] | self.some[2 * node + 1]

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of at least ``size`` that has an open bin."""
        node = size + self.width
        if not self.some[node]:
            while node > 1 and (node & 1 or not self.some[node + 1]):  # up, to the first tree on the right that has one
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:  # down, to its least leaf
                node = 2 * node + (not self.some[2 * node])
        return node - self.width


def best_fit_plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Runs of the items in decreasing size: rank (of a run's first item in that order), size, per, first, offset.

    Item ``i`` of a run goes to bin ``first + i // per``, at ``offset + i % per * size``.  A run fills a range of bins
    of equal contents.  Only the last run of a size leaves such a range split, so at most four ranges a size come to be,
    and a range takes no size twice: the plan has at most capacity * 4 * sqrt(2 * capacity) rows.
    """
    tree, rooms, bins, rank, runs = RoomTree(capacity), {}, 0, 0, []

    def opened(room: int, first: int, n: int) -> None:
        if n and room:
            if not rooms.setdefault(room, []):
                tree.set(room, True)
            rooms[room].append((first, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = tree.tightest(size)
            if room is None:
                room = capacity
                first, n = bins, -(-left // (capacity // size))
                bins += n
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    tree.set(room, False)
            per = room // size
            placed = min(left, n * per)
            runs.append((rank, size, per, first, capacity - room))
            full, rest = divmod(placed, per)
            opened(room - per * size, first, full)
            opened(room - rest * size, first + full, 1 if rest else 0)
            opened(room, first + full + bool(rest), n - full - bool(rest))
            rank, left = rank + placed, left - placed
    return pd.DataFrame(runs, columns=["rank", "size", "per", "first", "offset"], dtype=np.int64)


def _numbered(items: DataFrame, size_col: str, capacity: int) -> DataFrame:
    """``items`` with their partition and their rank among the items of their size in it, written once."""
    n = len(items.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            sizes = batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(sizes, kind="stable")
            found, first, count = np.unique(sizes[order], return_index=True, return_counts=True)
            own = np.empty(len(sizes), np.int64)
            own[order] = np.arange(len(sizes)) - np.repeat(first, count) + np.repeat(seen[found], count)
            seen[found] += count
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sizes), part, np.int32)), pa.array(own)], names=[*batch.schema.names, "_fit_part", "_fit_own"])

    size = F.col(size_col).cast("long")
    sized = items.withColumn("_fit_size", F.when(size.between(1, capacity), size).otherwise(0))
    schema = sized.limit(0).withColumn("_fit_part", F.lit(0)).withColumn("_fit_own", F.lit(0).cast("long")).schema
    return checkpointed(sized.mapInArrow(run, schema))


def best_fit(items: DataFrame, size_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset`` by best-fit decreasing over all of them.

    Sequences are filled from offset 0 without gaps.  An item whose size is null, below 1 or above ``capacity`` is not
    packed: it keeps null in both columns.  Items that tie are dealt in any order; equal rows are items of their own.
    """
    spark = items.sparkSession
    numbered = _numbered(items, size_col, capacity)
    counts = checkpointed(numbered.where("_fit_size > 0").groupBy("_fit_part", "_fit_size").agg(F.count("*").alias("_fit_n")))
    totals = {r[0]: r[1] for r in counts.groupBy("_fit_size").agg(F.sum("_fit_n")).collect()}  # a row for each size, at most ``capacity``
    plan = best_fit_plan(totals, capacity)
    sizes = sorted(totals, reverse=True)
    start = dict(zip(sizes, np.cumsum([0, *(totals[s] for s in sizes)])[:-1].tolist(), strict=True))  # rank of the first item of a size
    base = np.zeros(capacity + 1, np.int64)
    base[sizes] = [start[s] for s in sizes]
    sent = spark.sparkContext.broadcast((base, {c: plan[c].to_numpy() for c in plan.columns}))  # bounded by the capacity, see best_fit_plan

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        base, runs = sent.value
        size, known = size.to_numpy(np.int64), rank.notna().to_numpy()
        at = rank.fillna(0).to_numpy(np.int64) + base[size]
        run = np.clip(np.searchsorted(runs["rank"], at, "right") - 1, 0, None)
        if not len(runs["rank"]):
            return pd.DataFrame({"sequence_id": pd.array([None] * len(size), "Int64"), "offset": pd.array([None] * len(size), "Int64")})
        i, per = at - runs["rank"][run], runs["per"][run]
        return pd.DataFrame({"sequence_id": pd.Series(runs["first"][run] + i // per).where(known).astype("Int64"), "offset": pd.Series(runs["offset"][run] + i % per * size).where(known).astype("Int64")})

    earlier = Window.partitionBy("_fit_size").orderBy("_fit_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_fit_part", "_fit_size", F.coalesce(F.sum("_fit_n").over(earlier), F.lit(0)).alias("_fit_before"))
    placed = numbered.join(before, ["_fit_part", "_fit_size"], "left").withColumn("_fit", place("_fit_size", F.col("_fit_before") + F.col("_fit_own")))
    return placed.select(*items.columns, "_fit.*")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the pieces of each sequence one after the other (at most ``capacity`` of them)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    grouped = packed.where("sequence_id is not null").groupBy("sequence_id").agg(parts.alias("p"))
    return grouped.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("length"), F.aggregate("p", F.lit(b""), lambda b, x: F.concat(b, x["ids"])).alias("ids"))


def packing_digests(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = token_pieces(docs, tokenizer_path, capacity)
    return best_fit(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "length", capacity)
