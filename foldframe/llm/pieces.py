"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs whose joined text is a piece, takes the pair of the
highest score (ties: leftmost), merges it, and puts the two pairs that the new symbol forms on the agenda.
``agenda_encode`` does that with a heap for one segment; ``PieceModel.encode_segments`` does the same for
many short segments at once: each keeps its agenda as a row of a matrix, and each round merges the best
pair of every row.

A text is cut where no piece can cross (before a run of word marks; around line feeds), so segments are
independent and a bounded cache of segments serves every text in the batch.  Each Arrow batch is checked
against the sentencepiece library: all segments that the batch added to the cache, and one whole text.  If
they ever differ, the batch's texts are encoded with the library, which is by definition the right result.

Cases: a null or empty text gives begin and end ids only and decodes to ''; a text of any length is encoded
whole; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_and_text, slices, trimmed

MARK = "▁"
FAR = np.int64(1) << 40


class PieceModel:
    """Tables of a merge-type vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if len({sp.is_byte(i) for i in self.byte_ids}) != 1 or not sp.is_byte(self.byte_ids[0]):
            raise ValueError("the vocabulary has no byte fallback")
        ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        scores = {i: sp.get_score(i) for i in ids.values()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        symbols = dict(ids)  # text of a symbol -> its number; characters without a piece follow the pieces
        for p in ids:
            for c in p:
                symbols.setdefault(c, len(symbols) + n)
        self.n, self.other = n, 2 * n + len(symbols) + 1  # other: a character that no piece has
        self.width = np.int64(self.other + 1)
        self.char = np.full(0x110000, self.other, np.int64)
        for text, k in symbols.items():
            if len(text) == 1:
                self.char[ord(text)] = k
        pairs: dict[tuple[int, int], int] = {}
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.pairs = pairs
        self.rank = np.full(n, 0, np.int64)
        for i, s in scores.items():
            self.rank[i] = order[s]
        self._hash(pairs)
        body = [p.lstrip(MARK) for p in ids]
        self.cuts = not any(MARK in b or "\n" in b for b in body)
        self.segment = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if self.cuts else r"(?s).+")
        self.piece_bytes = [b"" if special[i] else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.byte_ids):
            self.piece_bytes[i] = bytes([b])
        self.piece_bytes[self.unk] = " ⁇ ".encode()
        self.cache: dict[str, bytes] = {}

    def _hash(self, pairs: dict[tuple[int, int], int]) -> None:
        bits = max(12, int(len(pairs) * 8).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_piece = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        keys = np.array([a * int(self.width) + b for a, b in pairs], np.int64)
        vals = np.array(list(pairs.values()), np.int64)
        home, self.reach = self._home(keys), 0
        while len(keys):
            at = (home + self.reach) & self.mask
            free = np.flatnonzero(self.slot_key[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.slot_key[at[put]], self.slot_piece[at[put]] = keys[put], vals[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, vals, home = keys[left], vals[left], home[left]
            self.reach += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two adjacent symbols make, or -1."""
        key = a * self.width + b
        home, out = self._home(key), np.full(len(key), -1, np.int64)
        for step in range(self.reach):
            at = (home + step) & self.mask
            hit = self.slot_key[at] == key
            out[hit] = self.slot_piece[at[hit]]
        return out

    def agenda_encode(self, segment: str) -> list[int]:
        """One segment of any length, with a heap as its agenda."""
        sym: list[int] = self.char[np.frombuffer(segment.encode("utf-32-le"), np.uint32)].tolist()
        n = len(sym)
        nxt, prv, agenda = [*range(1, n), -1], list(range(-1, n - 1)), []

        def put(i: int, j: int) -> None:
            piece = self.pairs.get((sym[i], sym[j]))
            if piece is not None:
                heapq.heappush(agenda, (int(self.rank[piece]), i, j, sym[i], sym[j], piece))

        for i in range(n - 1):
            put(i, i + 1)
        while agenda:
            _, i, j, a, b, piece = heapq.heappop(agenda)
            if sym[i] != a or sym[j] != b or nxt[i] != j:
                continue  # one side has been merged meanwhile
            sym[i], sym[j], nxt[i] = piece, -1, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
                put(i, nxt[i])
            if prv[i] >= 0:
                put(prv[i], i)
        out: list[int] = []
        for s, c in zip(sym, segment, strict=True):
            if s >= self.n:
                out += [self.byte_ids[x] for x in c.encode()]
            elif s >= 0:
                out.append(s)
        return out

    def encode_segments(self, segments: list[str], longest: int = 40) -> list[bytes]:
        """Ids of each segment as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(segments)
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        for lo, hi in ((0, 1), (1, 8), (8, 12), (12, 18), (18, longest)):
            group = np.flatnonzero((lengths > lo) & (lengths <= hi))
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000]
                for i, ids in zip(part.tolist(), self._rows([segments[i] for i in part.tolist()], lengths[part]), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(lengths > longest).tolist():
            out[i] = np.array(self.agenda_encode(segments[i]), "<u4").tobytes()
        return out

    def _rows(self, segments: list[str], lengths: np.ndarray) -> list[bytes]:
        count, wide = len(segments), int(lengths.max())
        text = "".join(segments)
        flat = self.char[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        inside = np.arange(wide) < lengths[:, None]
        sym = np.full((count, wide + 2), -1, np.int64)  # two columns of slack for neighbours that are not there
        sym[:, :wide][inside] = flat
        nxt = np.tile(np.arange(1, wide + 3), (count, 1))
        nxt[np.arange(count), lengths - 1] = wide + 1
        prv = np.tile(np.arange(-1, wide + 1), (count, 1))
        prv[:, 0] = wide + 1
        best, made = np.full((count, wide + 2), FAR), np.full((count, wide + 2), -1, np.int64)

        def rate(rows: np.ndarray, left: np.ndarray) -> None:
            a, b = sym[rows, left], sym[rows, nxt[rows, left]]
            ok = (a >= 0) & (b >= 0)
            piece = np.full(len(rows), -1, np.int64)
            piece[ok] = self.join(a[ok], b[ok])
            best[rows, left] = np.where(piece >= 0, self.rank[piece] * 64 + left, FAR)
            made[rows, left] = piece

        rows, cols = np.nonzero(np.arange(wide) < (lengths - 1)[:, None])
        rate(rows, cols)
        live = np.flatnonzero(lengths > 1)
        while len(live):
            agenda = best[live]
            i = agenda.argmin(1)
            has = agenda[np.arange(len(live)), i] < FAR
            live, i = live[has], i[has]
            if not len(live):
                break
            j = nxt[live, i]
            sym[live, i], sym[live, j], best[live, j] = made[live, i], -1, FAR
            after = nxt[live, j]
            nxt[live, i], prv[live, after] = after, i
            prv[live, wide + 1] = wide + 1
            sym[live, wide + 1] = -1
            rate(live, i)
            before = prv[live, i]
            real = before <= wide
            rate(live[real], before[real])
        kept = sym >= 0
        ids, ends = sym[kept], np.cumsum(kept.sum(1))
        odd = set(np.flatnonzero((sym >= self.n).any(1)).tolist())
        raw, starts = ids.astype("<u4").tobytes(), np.concatenate([[0], ends[:-1]])
        out = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        for r in odd:
            got: list[int] = []
            for s, c in zip(sym[r].tolist(), segments[r], strict=False):
                if s >= self.n:
                    got += [self.byte_ids[x] for x in c.encode()]
                elif s >= 0:
                    got.append(s)
            out[r] = np.array(got, "<u4").tobytes()
        return out

    def normalized(self, text: str) -> str:
        """The model's own normalisation: a word mark before the text and for each space."""
        return MARK + text.replace(" ", MARK) if text else ""

    def encode_texts(self, texts: list[str], room: int = 200_000) -> list[bytes]:
        """Ids of whole texts with begin and end ids, as little-endian 32-bit integers."""
        cut = [self.segment.findall(self.normalized(t)) for t in texts]
        cache = self.cache
        every = set().union(*cut)
        if len(cache) + len(every) > room:
            cache.clear()
        new = list(every.difference(cache) if cache else every)
        cache.update(zip(new, self.encode_segments(new), strict=True))
        begin, end = np.array([self.bos], "<u4").tobytes(), np.array([self.eos], "<u4").tobytes()
        out = [b"".join([begin, *map(cache.__getitem__, segments), end]) for segments in cut]
        if not self.agree(new, texts[:1], out[:1]):
            cache.clear()
            out = [np.array(x, "<u4").tobytes() for x in self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)]
        return out

    def agree(self, segments: list[str], texts: list[str], encoded: list[bytes]) -> bool:
        """Does the library give the same ids for these whole texts, and for the segments in one text: those that begin a
        word one after the other, all others but line feeds each behind a line feed?"""
        same = all(self.library.encode(t, add_bos=True, add_eos=True) == np.frombuffer(e, "<u4").tolist() for t, e in zip(texts, encoded, strict=True))
        if same and self.cuts and segments:
            words = [s for s in segments if s[0] == MARK and s != MARK * len(s)]
            lines = [s for s in segments if "\n" not in s and (s[0] != MARK or s == MARK * len(s))]
            feed = np.array([self.byte_ids[10]], "<u4").tobytes()
            got = self.library.encode("\n" + "".join(words + ["\n" + s for s in lines]).replace(MARK, " "))
            lead = np.array(self.library.encode("\n")[:-1], "<u4").tobytes()
            want = b"".join([lead, feed, *map(self.cache.__getitem__, words), *(feed + self.cache[s] for s in lines)])
            same = np.array(got, "<u4").tobytes() == want
        return same

    def decode_ids(self, ids: Iterable[int]) -> str:
        """Text of ids: marks become spaces, the first piece loses the mark put before every text."""
        raw, first = [], True
        for i in ids:
            piece = self.piece_bytes[i]
            if first and i != self.bos and i != self.eos:
                first = False
                piece = piece[1:] if self.pieces[i].startswith(MARK) else piece
            raw.append(piece)
        return _utf8(b"".join(raw))


def _utf8(raw: bytes) -> str:
    """Each byte that belongs to no character becomes one replacement character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, slice_bytes: int = 2_000_000) -> DataFrame:
    """Per document: doc_id, ids (array of int) and, if asked for, the decoded text.

    A map without a shuffle; memory is bounded by a slice of the batch and the segment cache.
    """
    schema = "doc_id long, ids array<int>" + (", decoded string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for ids, encoded in encoded_slices(model, batches, slice_bytes):
            arrays = [ids, pa.ListArray.from_arrays(np.cumsum([0, *(len(e) // 4 for e in encoded)]).astype(np.int32), np.frombuffer(b"".join(encoded), "<i4"))]
            if with_text:
                arrays.append(pa.array([model.decode_ids(np.frombuffer(e, "<u4").tolist()) for e in encoded], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "decoded"][: len(arrays)])

    return id_and_text(docs, id_col, text_col).mapInArrow(trimmed(run), schema)


def encoded_slices(model: PieceModel, batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[tuple[pa.Array, list[bytes]]]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        sizes = np.diff(np.concatenate([[0], np.cumsum(np.array(pc.binary_length(texts)), dtype=np.int64)])) if batch.num_rows else np.zeros(0, np.int64)
        for a, b in slices(sizes, slice_bytes):
            yield ids.slice(a, b - a), model.encode_texts(texts.slice(a, b - a).to_pylist())


def piece_digests(docs: DataFrame, model_path: str, slice_bytes: int = 2_000_000) -> DataFrame:
    """Digest columns: doc_id, n_tokens, ids_sha256, decoded_sha256 (decoded with the library's decode)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for ids, encoded in encoded_slices(model, batches, slice_bytes):
            texts = model.library.decode([np.frombuffer(e, "<u4").tolist() for e in encoded], num_threads=1)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(e) // 4 for e in encoded], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in encoded]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return id_and_text(docs).mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
