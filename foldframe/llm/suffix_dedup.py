"""Suffix-array deduplication by a distributed merge sort that knows common prefixes.

A byte is removed if a string of ``WINDOW`` bytes that covers it also starts earlier in the corpus.  Two such strings
can only be equal if the same place of both is chosen as their anchor: the leftmost least hash among their
``WINDOW - GRAM + 1`` grams.  So only the suffixes that start at anchors take part (about one in 35), and of these
only those whose anchor gram occurs twice:

1. documents are dealt to groups by a hash of their id (the one shuffle of the texts, reused below);
2. each group sends its distinct anchor hashes; those that occur once in the corpus are dropped.  Grams that stand in
   very many different contexts (a line that every document has) are hot: for these the groups send the hashes of the
   strings around them, and strings that occur once are dropped;
3. each group sorts the suffixes at its remaining anchors, settles those whose whole context is equal within the
   group, cuts the rest into a run for each bucket of anchor grams and front-codes every run.  At an anchor with a hot
   gram, each remaining string goes to a bucket of its own, so no bucket has all contexts of the gram;
4. a bucket merges its runs with a loser tree of (run, common prefix with the last suffix put out).  A comparison
   first looks at the two known common prefixes and reads characters, beyond them, only if they are equal.  What
   comes out is the sorted order with the exact common prefix of neighbours;
5. for each distance d between string start and anchor, strings are equal where suffixes share 100 - d bytes and
   the contexts to the left share d.  Of equal strings all but the first in the corpus mark their bytes;
6. marks go back to the groups, which cut the marked bytes out.

A bucket holds for each distinct context at most one suffix per group, so thousands of copies of a document or
passage cost as many suffixes as there are groups that hold them.

Cases: null or empty texts and texts below ``WINDOW`` bytes lose nothing; a text of any length is read whole; of
rows with the same id the one with the smaller text counts as earlier, equal rows follow each other; rows without an
id are left out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import even_keys, id_and_text, parallelism, slices, small_batches, trimmed
from .shingles import mix

WINDOW, GRAM = 100, 32
REACH = WINDOW - GRAM + 1  # grams in a string
HOT = 20_000  # contexts of a gram from which on its strings are dealt out one by one
GROUP_BYTES = 8 << 20  # of the scanned files, in a group of documents
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the gram at each place where a whole gram fits; lengths double in each step."""
    h, n = raw.astype(np.uint64) + np.uint64(1), len(raw)
    for step, odd in enumerate(_ODD):
        gap = 1 << step
        n -= gap
        h = h[:n] * odd + h[gap : gap + n]
        h ^= h >> np.uint64(29)
    return mix(h)


_POWERS = np.ones((2, 1), np.uint64)  # of an odd number and of its inverse


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span; equal bytes have equal hashes."""
    global _POWERS
    if _POWERS.shape[1] <= len(raw):
        odd = 0x9E3779B97F4A7C15
        both = np.array([[odd], [pow(odd, -1, 1 << 64)]], np.uint64)
        grown = np.ones((2, len(raw) + 1), np.uint64)
        grown[:, 1:] = both
        _POWERS = np.multiply.accumulate(grown, axis=1)
    before = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWERS[0, : len(raw)], out=before[1:])
    return mix((before[end] - before[start]) * _POWERS[1, start] + (end - start).astype(np.uint64))


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first and last start of the strings that choose it, hash of its gram) in texts laid end to end."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none, np.zeros(0, np.uint64)
    h = gram_hashes(raw)
    low = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= REACH:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: n - WINDOW + 1], low[REACH - size :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    left = np.repeat(offsets[1:], np.diff(offsets))[: len(at)] - np.arange(len(at))  # bytes to the end of the text
    starts = np.flatnonzero(left >= WINDOW)
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64)
    at = at[starts]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], starts[first], starts[last], h[at[first]]


def group_texts(group: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a group in their fixed order (id, text)."""
    ids, texts = group.column("doc_id").to_numpy(), [t.as_buffer().to_pybytes() for t in group.column("text").combine_chunks()] if group.num_rows else []
    order = np.argsort(ids, kind="stable")
    if len(ids) > 1 and (np.diff(ids[order]) == 0).any():
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])))
    return ids[order], [texts[i] for i in order.tolist()]


def laid(texts: list[bytes], limit: int = 100_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of texts, short enough to stay in a cache."""
    sizes = np.array([len(t) for t in texts], np.int64)
    for a, b in slices(sizes, limit):
        yield a, np.frombuffer(b"".join(texts[a:b]), np.uint8), np.concatenate([[0], np.cumsum(sizes[a:b])])


HASHES = "bucket int, g int, strings boolean, hashes binary"
HASH = [("bucket", pa.int32()), ("g", pa.int32()), ("strings", pa.bool_()), ("hashes", pa.binary())]
CODE, CODES = np.uint64(5), np.uint64(31)  # low bits of a hash that is sent: how often a group has it


def _anchor_hashes(buckets: int):
    """The distinct hashes of a group's anchor grams; the low bits are 0 where the gram occurs once in the group, else one
    more than the binary logarithm of its contexts."""
    keys = even_keys(buckets)

    def run(group: pa.Table) -> pa.Table:
        g = group.column("g")[0].as_py()
        _, texts = group_texts(group)
        found: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
        for _, raw, offsets in laid(texts):
            _, lo, hi, gram = anchors(raw, offsets)
            found[0].append(gram >> CODE)
            found[1].append(span_hashes(raw, lo, hi + WINDOW))
        gram, context = (np.concatenate(c) for c in found)
        by = np.lexsort((context, gram))
        gram, context = gram[by], context[by]
        start = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(gram)))
        other = np.append(True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]))[: len(gram)]
        contexts = np.add.reduceat(other.astype(np.int64), start) if len(start) else count
        code = np.where(count > 1, np.minimum(1 + np.log2(np.maximum(contexts, 1)).astype(np.uint64), CODES), np.uint64(0))
        return _table(_by_bucket(gram[start] << CODE | code, buckets, keys, g, False), HASH)

    return run


def _by_bucket(sent: np.ndarray, buckets: int, keys: np.ndarray, g: int, strings: bool) -> list[tuple]:
    bucket = _bucket(sent >> CODE, buckets)
    by = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[by], np.arange(buckets + 1))
    return [(int(keys[b]), g, strings, sent[by[edge[b] : edge[b + 1]]].tobytes()) for b in np.flatnonzero(np.diff(edge)).tolist()]


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key) % np.uint64(buckets)).astype(np.int64)


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(fields, cols, strict=True)})


def _repeated(hot: int):
    """For each group, which of the hashes it sent occur twice in the corpus; the lowest bit says that they stand in
    ``hot`` contexts or more.  Rows that are not the last step's pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, parts, strings = [], [], False
        for batch in batches:
            for key, g, kind, hashes in zip(*(batch.column(c) for c in range(4)), strict=True):
                if key.is_valid:
                    groups.append(g.as_py())
                    parts.append(np.frombuffer(hashes.as_buffer(), np.uint64))
                    strings = kind.as_py()
                else:
                    yield _table([(None, g.as_py(), False, hashes.as_py())], HASH).to_batches()[0]
        if not parts:
            return
        every = np.sort(np.concatenate(parts))
        plain, code = every >> CODE, every & CODES
        start = np.flatnonzero(np.append(True, plain[1:] != plain[:-1]))
        times = np.add.reduceat(np.where(code > 0, np.uint64(1) << np.maximum(code, np.uint64(1)) - np.uint64(1), np.uint64(1)), start)
        again = (np.diff(np.append(start, len(plain))) > 1) | (np.maximum.reduceat(code, start) > 0)
        known = plain[start][again]
        crowded = (times[again] >= hot).astype(np.uint64)
        if not len(known):
            return
        for g, part in zip(groups, parts, strict=True):
            at = np.minimum(np.searchsorted(known, part >> CODE), len(known) - 1)
            hit = known[at] == part >> CODE
            if hit.any():
                yield _table([(None, g, strings, (known[at[hit]] << np.uint64(1) | crowded[at[hit]]).tobytes())], HASH).to_batches()[0]

    return run


def _marked_hashes(table: pa.Table, strings: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether it is hot) of what came back to a group, in order."""
    sent = [np.frombuffer(h.as_buffer(), np.uint64) for h, kind in zip(table.column("hashes"), table.column("strings").to_pylist(), strict=True) if kind == strings]
    every = np.sort(np.concatenate([np.zeros(0, np.uint64), *sent]))
    return every >> np.uint64(1), every & np.uint64(1) == 1


def _member(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each value would be, whether it is there)."""
    if not len(sorted_values):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return at, sorted_values[at] == values


def _string_hashes(buckets: int):
    """What came back to a group, and the hashes of its strings around hot grams."""
    keys = even_keys(buckets)

    def run(group: pa.Table, repeated: pa.Table) -> pa.Table:
        if not group.num_rows or not repeated.num_rows:
            return _table([], HASH)
        g = group.column("g")[0].as_py()
        known, hot = _marked_hashes(repeated, False)
        rows: list[tuple] = [(None, g, False, (known << np.uint64(1) | hot.astype(np.uint64)).tobytes())]
        if hot.any():
            _, texts = group_texts(group)
            found = [np.zeros(0, np.uint64)]
            for _, raw, offsets in laid(texts):
                _, lo, hi, gram = anchors(raw, offsets)
                at, there = _member(known[hot], gram >> CODE)
                _, start = _strings(lo[there], hi[there])
                found.append(span_hashes(raw, start, start + WINDOW) >> CODE)
            string, count = np.unique(np.concatenate(found), return_counts=True)
            rows += _by_bucket(string << CODE | (count > 1).astype(np.uint64), buckets, keys, g, True)
        return _table(rows, HASH)

    return run


def _strings(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the anchor, start) of every string of some anchors."""
    size = hi - lo + 1
    index = np.repeat(np.arange(len(lo)), size)
    return index, np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)


RUN = [("bucket", pa.int32()), ("g", pa.int32()), ("lcp", pa.binary()), ("rest", pa.binary()), ("rest_len", pa.binary()), ("left", pa.binary()), ("left_len", pa.binary()), ("doc", pa.binary()), ("place", pa.binary()), ("marks", pa.binary())]
RUNS = "bucket int, g int, lcp binary, rest binary, rest_len binary, left binary, left_len binary, doc binary, place binary, marks binary"


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def front_code(suffixes: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(common prefix with the one before, what follows it, its length) of sorted suffixes."""
    lcp, rest, before = bytearray(), [], b""
    for s in suffixes:
        k = common_prefix(before, s, 0)
        lcp.append(k)
        rest.append(s[k:])
        before = s
    return bytes(lcp), b"".join(rest), bytes(map(len, rest))


def _runs(buckets: int):
    keys = even_keys(buckets)

    def run(group: pa.Table, repeated: pa.Table) -> pa.Table:
        if not group.num_rows or not repeated.num_rows:
            return _table([], RUN)
        g = group.column("g")[0].as_py()
        ids, texts = group_texts(group)
        wanted, hot = _marked_hashes(repeated, False)
        strings, _ = _marked_hashes(repeated, True)
        suffixes: list[tuple] = []  # bucket, right context, left context reversed, document, place
        for base, raw, offsets in laid(texts):
            at, lo, hi, gram = anchors(raw, offsets)
            key = gram >> CODE
            where, keep = _member(wanted, key)
            if hot.any():
                crowd = np.flatnonzero(keep & hot[where])
                keep[crowd] = False
                index, start = _strings(lo[crowd], hi[crowd])
                own = span_hashes(raw, start, start + WINDOW) >> CODE
                again = _member(strings, own)[1]
                index, start, own = crowd[index[again]], start[again], own[again]
                at, lo, hi, key = np.append(at[keep], at[index]), np.append(lo[keep], start), np.append(hi[keep], start), np.append(key[keep], own)
            else:
                at, lo, hi, key = at[keep], lo[keep], hi[keep], key[keep]
            text, back = raw.tobytes(), raw[::-1].tobytes()
            n, doc = len(raw), np.searchsorted(offsets, at, "right") - 1
            place, bucket = (at - offsets[doc]).tolist(), _bucket(key, buckets).tolist()
            suffixes += [(b, text[a : h + WINDOW], back[n - a : n - s], d, p) for b, a, s, h, d, p in zip(bucket, at.tolist(), lo.tolist(), hi.tolist(), (doc + base).tolist(), place, strict=True)]
        suffixes.sort()
        rows, marks, part, before = [], [], [], None
        for s in suffixes:
            if before is not None and s[:3] == before[:3]:
                _, right, left, d, p = s  # an equal context stands earlier in this group
                marks.append((d, p - len(left), p + len(right)))
                continue
            if before is not None and s[0] != before[0]:
                rows.append(_packed(part, int(keys[part[0][0]]), g, ids))
                part = []
            part.append(s)
            before = s
        if part:
            rows.append(_packed(part, int(keys[part[0][0]]), g, ids))
        if marks:
            rows.append((int(keys[g % buckets]), g, *[None] * 7, np.array(marks, np.int32).tobytes()))
        return _table(rows, RUN)

    return run


def _packed(part: list[tuple], key: int, g: int, ids: np.ndarray) -> tuple:
    lefts = [s[2] for s in part]
    doc = np.array([s[3] for s in part], np.int32)
    place = np.stack([doc, np.array([s[4] for s in part], np.int32)], 1)
    return (key, g, *front_code([s[1] for s in part]), b"".join(lefts), bytes(map(len, lefts)), ids[doc].astype(np.int64).tobytes(), place.tobytes(), None)


class Run:
    """A front-coded run, decoded one suffix at a time."""

    def __init__(self, lcp: bytes, rest: bytes, rest_len: bytes):
        self.lcp, self.rest, self.rest_len = lcp, rest, rest_len
        self.i, self.at, self.now = -1, 0, b""

    def advance(self) -> int:
        """Move to the next suffix; its common prefix with the one before, -1 at the end."""
        self.i += 1
        if self.i >= len(self.lcp):
            return -1
        k, n = self.lcp[self.i], self.rest_len[self.i]
        self.now = self.now[:k] + self.rest[self.at : self.at + n]
        self.at += n
        return k


def merge_runs(runs: list[Run]) -> tuple[list[int], list[int], list[int], list[bytes]]:
    """(run, index in it, common prefix with the suffix before, suffix) in sorted order.

    The tree's nodes hold losers with their common prefix with the suffix put out last; prefixes once known are
    never compared again.  Equal suffixes come out in any order.
    """
    size = 1
    while size < len(runs):
        size *= 2
    loser, known = [0] * size, [-1] * size
    out_run, out_index, out_lcp, out = [], [], [], []

    def play(node: int) -> tuple[int, int]:
        if node >= size:
            r = node - size
            return (r, 0) if r < len(runs) and runs[r].advance() >= 0 else (r, -1)
        (a, ka), (b, kb) = play(2 * node), play(2 * node + 1)
        if ka < 0 or kb < 0:
            win, lose = ((a, ka), (b, kb)) if kb < 0 else ((b, kb), (a, ka))
        else:
            x, y = runs[a].now, runs[b].now
            k = common_prefix(x, y, 0)
            win, lose = ((a, 0), (b, k)) if x[k : k + 1] <= y[k : k + 1] else ((b, 0), (a, k))
        loser[node], known[node] = lose
        return win

    best, k = play(1)
    while k >= 0:
        run = runs[best]
        out_run.append(best)
        out_index.append(run.i)
        out_lcp.append(k)
        out.append(run.now)
        r, k = best, run.advance()
        node = (r + size) >> 1
        while node:
            other = known[node]
            if other > k:
                r, loser[node], known[node], k = loser[node], r, k, other
            elif other == k and k >= 0:
                x, y = runs[r].now, runs[loser[node]].now
                h = common_prefix(x, y, k)
                if x[h : h + 1] > y[h : h + 1]:
                    r, loser[node] = loser[node], r
                known[node] = h
            node >>= 1
        best = r
    return out_run, out_index, out_lcp, out


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs of each bucket; (group, marked bytes) for every string that also starts earlier."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
            if row[-1] is not None:
                yield _marks(row[1], row[-1])
            else:
                held.setdefault(row[0], []).append(row)
    for bucket in sorted(held):
        rows = held.pop(bucket)
        order_run, order_index, lcp, rights = merge_runs([Run(*row[2:5]) for row in rows])
        groups = np.array([row[1] for row in rows], np.int32)
        start = np.cumsum([0, *(len(row[2]) for row in rows)])[:-1]
        order_run, lcp = np.array(order_run), np.array(lcp)
        at = start[order_run] + np.array(order_index)
        left_len = np.frombuffer(b"".join(row[6] for row in rows), np.uint8).astype(np.int64)
        left_end = np.cumsum(left_len)
        left = np.frombuffer(b"".join(row[5] for row in rows), np.uint8)
        doc = np.frombuffer(b"".join(row[7] for row in rows), np.int64)[at]
        place = np.frombuffer(b"".join(row[8] for row in rows), np.int32).reshape(-1, 2)[at]
        longest, nearest = left_len[at], WINDOW - np.array([len(x) for x in rights])
        group = groups[order_run]
        del rows
        inside = np.arange(REACH) < longest[:, None]
        lefts = np.zeros((len(at), -(-REACH // 8) * 8), np.uint8)
        lefts[:, :REACH][inside] = left[((left_end - left_len)[at][:, None] + np.arange(REACH))[inside]]
        found = equal_strings(lcp, lefts, longest, nearest, np.lexsort((place[:, 1], place[:, 0], doc)))
        which, d_low, d_high = found
        if not len(which):
            continue
        spans = np.stack([place[which, 0], place[which, 1] - d_high, place[which, 1] - d_low + WINDOW], 1).astype(np.int32)
        own = group[which]
        by = np.argsort(own, kind="stable")
        own, spans = own[by], spans[by]
        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(own)).tolist(), strict=True):
            yield _marks(int(own[a]), spans[a:b].tobytes())


def _marks(g: int, marks: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([marks], pa.binary())], names=["g", "marks"])


def equal_strings(lcp: np.ndarray, lefts: np.ndarray, longest: np.ndarray, nearest: np.ndarray, corpus_order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, least and largest distance) of runs of strings that have an equal string earlier in the corpus.

    ``lcp`` is the common prefix of neighbours in sorted order; suffix i has strings at the distances
    ``nearest[i]`` to ``longest[i]`` before its anchor.
    """
    n = len(lcp)
    rank = np.empty(n, np.int64)
    rank[corpus_order] = np.arange(n)
    words = lefts.view(">u8").astype(np.uint64)
    by_left = np.lexsort(words.T[::-1])
    differ = lefts[by_left[1:], :REACH] != lefts[by_left[:-1], :REACH]
    left_lcp = np.where(differ.any(1), differ.argmax(1), REACH)
    left_lcp = np.minimum(left_lcp, np.minimum(longest[by_left[1:]], longest[by_left[:-1]]))
    marked = np.zeros((n, REACH + 1), bool)
    bits = max(1, int(n).bit_length())
    for d in range(REACH):
        active = (nearest <= d) & (longest >= d)
        if active.sum() < 2:
            continue
        right_class = np.cumsum(lcp < WINDOW - d)
        left_class = np.empty(n, np.int64)
        left_class[by_left] = np.concatenate([[0], np.cumsum(left_lcp < d)])
        i = np.flatnonzero(active)
        if bits * 3 <= 63:
            order = np.sort((right_class[i].astype(np.uint64) << np.uint64(2 * bits)) | (left_class[i].astype(np.uint64) << np.uint64(bits)) | rank[i].astype(np.uint64))
            again = np.zeros(len(order), bool)
            again[1:] = order[1:] >> np.uint64(bits) == order[:-1] >> np.uint64(bits)
            hit = corpus_order[(order[again] & np.uint64((1 << bits) - 1)).astype(np.int64)]
        else:
            order = i[np.lexsort((rank[i], left_class[i], right_class[i]))]
            again = (right_class[order[1:]] == right_class[order[:-1]]) & (left_class[order[1:]] == left_class[order[:-1]])
            hit = order[1:][again]
        marked[hit, d] = True
    edge = np.diff(np.concatenate([np.zeros((n, 1), np.int8), marked.astype(np.int8)], 1), axis=1)
    which, low = np.nonzero(edge == 1)
    return which, low, np.nonzero(edge == -1)[1] - 1


def _cut(texts: list[bytes], marks: pa.Table) -> Iterator[tuple[bytes, np.ndarray | None]]:
    """Each text with the mask of its marked bytes (None: nothing marked)."""
    if marks.num_rows:
        m = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in marks.column("marks").combine_chunks()]).reshape(-1, 3)
        m = m[np.argsort(m[:, 0], kind="stable")]
    else:
        m = np.zeros((0, 3), np.int32)
    edge = np.searchsorted(m[:, 0], np.arange(len(texts) + 1))
    for i, text in enumerate(texts):
        own = m[edge[i] : edge[i + 1]]
        if not len(own):
            yield text, None
            continue
        step = np.bincount(own[:, 1], minlength=len(text) + 1) - np.bincount(own[:, 2], minlength=len(text) + 1)
        yield text, np.cumsum(step[: len(text)]) > 0


DIGEST = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]


def _digest(group: pa.Table, marks: pa.Table) -> pa.Table:
    if not group.num_rows:
        return _table([], DIGEST)
    ids, texts = group_texts(group)
    rows = []
    for i, (text, mask) in zip(ids.tolist(), _cut(texts, marks), strict=True):
        removed = spans = 0
        kept = text
        if mask is not None:
            kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
            removed, spans = int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
        rows.append((i, len(text), removed, spans, hashlib.sha256(kept).hexdigest()))
    return _table(rows, DIGEST)


def _groups(docs: DataFrame) -> int:
    """Enough groups that none holds more than ``GROUP_BYTES`` of the scanned files."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length())]
    size = sum(x for x in sizes if x < 1 << 60)  # what is no table of files has no size
    return max(3 * parallelism(docs.sparkSession), -(-size // GROUP_BYTES))


def _grouped(docs: DataFrame) -> DataFrame:
    rows = id_and_text(docs).where("doc_id is not null")
    return rows.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(_groups(docs))).cast("int"))


def _marked(grouped: DataFrame, groups: int) -> DataFrame:
    """(g, marks): in each group, (text, start, end) of marked bytes; texts in the order of ``group_texts``."""
    width = buckets = max(parallelism(grouped.sparkSession), groups // 4)  # a group sends a row to each bucket at most
    hashes = grouped.groupBy("g").applyInArrow(_anchor_hashes(buckets), HASHES)
    repeated = hashes.repartition(width, "bucket").mapInArrow(trimmed(_repeated(HOT)), HASHES)
    finer = grouped.groupBy("g").cogroup(repeated.groupBy("g")).applyInArrow(_string_hashes(buckets), HASHES)
    repeated = finer.repartition(width, F.coalesce("bucket", "g")).mapInArrow(trimmed(_repeated(1 << 62)), HASHES)
    runs = grouped.groupBy("g").cogroup(repeated.groupBy("g")).applyInArrow(_runs(buckets), RUNS)
    return runs.repartition(width, "bucket").mapInArrow(trimmed(_mark), "g int, marks binary")


def suffix_dedup_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    grouped = _grouped(docs)
    marks = _marked(grouped, _groups(docs))
    return grouped.groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, the marked bytes of ``text`` cut out and ``n_chars``, if there, set anew.

    Where a cut parts a character of several bytes, what is left of it goes too.  A text of which nothing is left is
    empty; rows are never dropped.  Rows without an id come through as they are.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.struct(F.lit(0).alias("_none"))
    small_batches(docs.sparkSession)
    groups = _groups(docs)
    grouped = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(groups)).cast("int").alias("g"), F.col("text").isNull().alias("was_null"), rest.alias("rest")
    )

    def run(group: pa.Table, marks: pa.Table) -> pa.Table:
        if not group.num_rows:
            return group.select(["doc_id", "text", "was_null", "rest"])
        ids = group.column("doc_id").to_numpy()
        raw = [t.as_buffer().to_pybytes() for t in group.column("text").combine_chunks()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], raw[i]))
        new = [(text if mask is None else np.frombuffer(text, np.uint8)[~mask].tobytes()).decode(errors="ignore") for text, mask in _cut([raw[i] for i in order], marks)]
        group = group.take(order)
        return group.set_column(group.column_names.index("text"), "text", pa.array(new, group.schema.field("text").type)).select(["doc_id", "text", "was_null", "rest"])

    schema = grouped.select("doc_id", "text", "was_null", "rest").schema
    done = grouped.groupBy("g").cogroup(_marked(grouped, groups).groupBy("g")).applyInArrow(run, schema)
    kind = dict(docs.dtypes)
    text = F.when(F.col("was_null"), F.lit(None)).otherwise(F.col("text"))
    value = {"doc_id": F.col("doc_id").cast(kind["doc_id"]), "text": text}
    if "n_chars" in others:
        value["n_chars"] = F.when(F.col("was_null"), F.col("rest.n_chars")).otherwise(F.length("text")).cast(kind["n_chars"])
    out = done.select(*(value.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))
    return out.unionByName(docs.where("doc_id is null"))
