"""Token counts per section by offset-mapped attribution.

A whole document is encoded once with a byte-level vocabulary.  Tokens of such a vocabulary are byte strings, so the
running sum of their lengths gives every token's exact span; sections are spans of the same text.  Joining both
ordered span lists by binary search attributes each token to the section that holds it.  A token that crosses a
section boundary goes whole to the section that holds most of its bytes, of equals to the earliest.  So the counts of a
document's sections add up to the count of the whole document, which is not so if sections are encoded one by one.

Sections are the lines of a text, each with the line feed that ends it.

Cases: a null or empty text has one empty section without tokens; lines may be empty; texts of any length are encoded
whole; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, slices, trimmed


@lru_cache(maxsize=2)
def byte_vocabulary(path: str, pattern: str):
    """(encoder, byte length of each token)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def attribute(token_ends: np.ndarray, section_ends: np.ndarray) -> np.ndarray:
    """Number of tokens of each section; both lists hold ascending ends of spans that cover the same bytes."""
    if not len(token_ends):
        return np.zeros(len(section_ends), np.int64)
    starts = np.append(0, token_ends[:-1])
    own = np.searchsorted(section_ends, starts, "right")  # the section that holds the first byte
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    for t in np.flatnonzero(last > own).tolist():
        edges = np.concatenate([[starts[t]], section_ends[own[t] : last[t]], [token_ends[t]]])
        own[t] += int(np.diff(edges).argmax())
    return np.bincount(own, minlength=len(section_ends))


def section_ends(raw: bytes) -> np.ndarray:
    """Ends of the lines of a text in bytes; a text without bytes has one empty section."""
    feeds = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return feeds if len(feeds) and feeds[-1] == len(raw) else np.append(feeds, len(raw))


def section_token_counts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section: doc_id, section, start, end (characters), n_tokens, and doc_tokens of the whole document."""
    schema = "doc_id long, section int, start long, end long, n_tokens long, doc_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = byte_vocabulary(vocabulary, pattern)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1)
            sizes = np.array([len(t.as_buffer()) for t in texts], np.int64)
            for a, b in slices(sizes, 2_000_000):
                cols: list[list] = [[], [], [], [], [], []]
                for i in range(a, b):
                    text = texts[i].as_py()
                    raw = text.encode()
                    tokens = encoder.encode_to_numpy(text, disallowed_special=())
                    ends = section_ends(raw)
                    counts = attribute(np.cumsum(lengths[tokens]), ends)
                    chars = ends if len(raw) == len(text) else np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[ends - 1]
                    n = len(ends)
                    for col, v in zip(cols, ([ids[i]] * n, np.arange(n), np.append(0, chars[:-1]), chars, counts, np.full(n, len(tokens))), strict=True):
                        col.append(v)
                flat = [pa.array([x for v in cols[0] for x in v], pa.int64()), pa.array(np.concatenate(cols[1]).astype(np.int32)), *(pa.array(np.concatenate(c).astype(np.int64)) for c in cols[2:])]
                yield pa.RecordBatch.from_arrays(flat, names=["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"])

    return id_and_text(docs, id_col, text_col).mapInArrow(trimmed(run), schema)
