"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to k errors (k = ``error_rate`` of its length).  Cut into k + 1 pieces,
at least one piece must then occur unchanged: an Aho-Corasick automaton finds all piece hits in one pass over the
text, each hit names a diagonal, and Myers' bit-parallel algorithm computes the edit distance of the item to the
best substring around that diagonal.  A window is verified only if enough short pieces of the item, all but one for
each error, occur in it (the pigeonhole again, which loses nothing).  Items and texts are compared in lower case with white space as one blank.

Items reach the executors in blocks of at most ``block_bytes``: every document is scanned once per block, whatever
the size of the benchmark, and no more than one block is ever held by the driver or a worker.

Cases: null or empty items match nothing; null or empty texts contain nothing; an item of fewer characters than
1 / error_rate must occur exactly; repeated rows give repeated results; of several places of an item in a text the
one of least distance, then the first, is reported; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_and_text, small_batches, trimmed


def normalize(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces (offset, text) of nearly equal length."""
    n, m = len(item), errors + 1
    cut = [n * i // m for i in range(m + 1)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def worth_verifying(item: str, errors: int, window: str, size: int = 5) -> bool:
    """Can the window hold the item with so many errors?  Each error spoils one of the item's disjoint short pieces at
    most, so all but ``errors`` of them must occur in the window; most windows fail after a few."""
    missing = 0
    for i in range(0, len(item) - size + 1, size):
        if item[i : i + size] not in window:
            missing += 1
            if missing > errors:
                return False
    return True


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring of ``text``, first end of such a substring)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, at = score, j + 1
        ph, mh = ph << 1, mh << 1  # a match may start anywhere: no carry into the first row
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return best, at


class Matcher:
    """Automaton and bit masks of a block of items."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items = [(i, t, int(len(t) * error_rate)) for i, t in ((i, normalize(t or "")) for i, t in items) if t]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                where.setdefault(piece, []).append((n, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, at)
        if where:
            self.automaton.make_automaton()
        self.empty = not where
        self.peq: dict[int, tuple[dict[str, int], dict[str, int]]] = {}

    def matches(self, text: str, first_only: bool = False) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) for each item within its error budget; places in the normalised text."""
        if self.empty or not text:
            return []
        text = normalize(text)
        diagonals = set()
        for end, at in self.automaton.iter(text):
            for n, offset in at:
                diagonals.add((n, (end + 1 - offset) // (2 * self.items[n][2] + 1)))
        best: dict[int, tuple[int, int, int]] = {}
        for n, band in sorted(diagonals):
            _, item, errors = self.items[n]
            if n in best and best[n][0] == 0:
                continue
            low = max(0, band * (2 * errors + 1) - errors)
            window = text[low : (band + 1) * (2 * errors + 1) + len(item) + errors]
            if errors == 0:
                at = window.find(item)
                distance, stop = (0, at + len(item)) if at >= 0 else (1, 0)
            elif not worth_verifying(item, errors, window):
                continue
            else:
                if n not in self.peq:
                    self.peq[n] = masks(item), masks(item[::-1])
                distance, stop = myers(self.peq[n][0], len(item), window)
            if distance <= errors:
                start = stop - len(item)
                if errors:
                    start = stop - myers(self.peq[n][1], len(item), window[:stop][::-1][: len(item) + errors])[1]
                found = (distance, low + start, low + stop)
                if n not in best or found < best[n]:
                    best[n] = found
                if first_only:
                    break
        return [(self.items[n][0], *found) for n, found in sorted(best.items())]


@lru_cache(maxsize=1)
def _matcher(packed: bytes) -> Matcher:
    return Matcher(*pickle.loads(packed))


def item_blocks(items: DataFrame, block_bytes: int, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_bytes``, one at a time on the driver; an item need not have an id."""
    rows = id_and_text(items, id_col, text_col).where(F.col("text") != "")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-total // block_bytes))
    for b in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)) == b)
        yield sorted(((r.doc_id, r.text) for r in part.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def benchmark_matches(docs: DataFrame, items: DataFrame, error_rate: float = 0.1, block_bytes: int = 4_000_000, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """Every (document, item) match: doc_id, item_id, distance, start, end (places in the normalised text).

    An item without an id is matched like any other and reported with a null ``item_id``, a document without one with a
    null ``doc_id``; repeated rows of either match each for itself.  Ids are integers.
    """
    found: DataFrame | None = None
    blocks = item_blocks(items, block_bytes, item_id, text_col)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        part = id_and_text(docs).mapInArrow(trimmed(_finder(pickle.dumps((block, error_rate)))), "doc_id long, item_id long, distance int, start int, end int")
        if found is not None or following is not None:
            part = checkpointed(part)  # the block's items are let go
        found = part if found is None else found.unionByName(part)
        block = following
    return found


def _finder(packed: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(packed)
        for batch in batches:
            rows = [(doc, *m) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in matcher.matches(text.as_py())]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "distance", "start", "end"])

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, error_rate: float = 0.1, block_bytes: int = 4_000_000, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item within its error budget."""
    small_batches(docs.sparkSession)
    blocks = item_blocks(items, block_bytes, item_id, text_col)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        docs = docs.mapInArrow(trimmed(_keeper(pickle.dumps((block, error_rate)), docs.columns.index(text_col))), docs.schema)
        if following is not None:
            docs = checkpointed(docs)
        block = following
    return docs


def _keeper(packed: bytes, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(packed)
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            yield batch.filter(pa.array([not matcher.matches(t.as_py(), first_only=True) for t in texts], pa.bool_()))

    return run
