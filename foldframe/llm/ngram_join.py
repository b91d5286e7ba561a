"""N-gram Jaccard join with adaptive multi-match prefixes; exact links, exact components.

Tokens are shingle hashes.  One global order puts frequent tokens last: by a frequency class from a table of fixed
size, counted over all texts, then by hash.  A document of n tokens has a prefix of
``n - ceil(0.75 n) + l`` tokens.  l starts at 1 and is lengthened where the estimated number of candidates of the
longer prefix, of which correspondingly more tokens must be shared, costs less than that of the shorter one.  If
documents x and y link, their overlap is at least a = ceil(75 (n_x + n_y) / 175), so the one whose prefix ends first
in the order shares at least p - n + a (>= l) of its p prefix tokens with the prefix of the other.  Candidates that
share fewer are never verified.

Texts with equal sets are one class from the start.  Prefix tokens go to buckets as packed arrays; a bucket drops
tokens of a single class; from the rest candidates come in two ways:

* tokens of up to ``CROWDED`` classes give their pairs, counted within the bucket and then summed;
* the lists of more classes, and of tokens so frequent that their lists are dealt over buckets, are crowds and stay
  packed.  In pivot rounds each of their classes is verified against the ones that it shares most tokens with among
  a few of each list, and what links is united.  Pairs that remain apart are counted block by block over inverted
  indexes, among documents of like size, and only those that share enough are put out.

All pairs that share enough prefix tokens and are not yet united are verified; no pair across components is left
out.  Once the components stand, each class's links are counted over all pairs of its component, on whole sets.

The result has one row per document (class, number of links, component), never the pairs of a group.

Cases: null or empty texts, and texts without words, have n_shingles 0 and are their own component; repeated rows
and equal texts fall into one class and get equal components; rows that share an id are one document, which has the
links of all of them, and each of them has a row in the result; rows without an id are left out; an empty table gives
an empty result; columns other than id and text are ignored.  Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import checkpointed, column_bytes, even_keys, id_and_text, outliving, parallelism, scratch, slices, trimmed
from .shingles import distinct_shingles, mix

LENGTHENINGS = np.array([1, 2, 3, 5, 8, 12, 18])
HEAVY = 1 << 22  # at most so many tokens have a frequency class (38 MB); it only decides the order of tokens
CLASS_AT = np.uint64(59)  # keys: frequency class above, token below
SPLIT = 100_000  # a token with more documents than this is dealt over several buckets
AMBASSADORS = 16  # of a split token's list, about one in so many goes to all of its buckets
SMALL_IDS = 500_000  # ids that are sent to all tasks as they are; more are sent as a bitmap of bounded size
CROWDED = 48  # the pairs of a token's list are put out as rows only up to this many classes
CHUNK = 400_000  # entries of crowded lists in a row
BAND = 1.34  # sizes of documents that link differ by less than this factor


def document_sets(batches: Iterator[pa.RecordBatch], k: int, limit: int = 200_000) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        raw, offsets = column_bytes(batch.column(1))
        for a, b in slices(np.diff(offsets), limit):
            yield ids[a:b], [s >> np.uint64(5) for s in distinct_shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)]


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        return tuple(int(mix(tokens + np.uint64(seed)).sum(dtype=np.uint64).astype(np.int64)) for seed in (1, 0x5851F42D4C957F2D))


class Order:
    """The global order: a token's frequency class (binary logarithm; 0 if it is not among the heavy ones), then its
    hash.  Any class is right, a good one saves candidates."""

    def __init__(self, heavy: np.ndarray, classes: np.ndarray):
        self.heavy, self.classes = heavy, classes

    def key(self, tokens: np.ndarray) -> np.ndarray:
        """Keys in ascending order."""
        if not len(self.heavy):
            return np.sort(tokens)
        at = np.minimum(np.searchsorted(self.heavy, tokens), len(self.heavy) - 1)
        known = np.where(self.heavy[at] == tokens, self.classes[at], np.uint8(0))
        return np.sort(tokens | known.astype(np.uint64) << CLASS_AT)

    @staticmethod
    def frequency(keys: np.ndarray) -> np.ndarray:
        return np.maximum(np.float64(2) ** (keys >> CLASS_AT).astype(np.int64), 1.1)

    def prefix(self, keys: np.ndarray, per: int = 75) -> np.ndarray:
        """The prefix whose estimated cost is least: reading its lists, and verifying what l matches leave."""
        n = len(keys)
        base = n - -(-per * n // 100)
        lengths = np.minimum(base + LENGTHENINGS, n)
        if keys[min(base, n - 1)] >> CLASS_AT == 0:
            return keys[: base + 1]  # no frequent token: the shortest prefix has next to no candidates
        reading = np.cumsum(self.frequency(keys[: lengths[-1]]))[lengths - 1]
        cost = reading * (1 + 20 / LENGTHENINGS)
        return keys[: lengths[int(cost.argmin())]]


def _reach(over: np.ndarray) -> np.ndarray:
    """The share 1 / over of all 64-bit integers."""
    return np.uint64(0xFFFFFFFFFFFFFFFF) // over


def ways(keys: np.ndarray, split: int) -> np.ndarray:
    """Over how many buckets the list of each token is dealt, by its frequency class alone."""
    return (np.uint64(1) << (keys >> CLASS_AT)) // np.uint64(split) + np.uint64(1)


def summed(tokens: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens in order, and the sums of their counts."""
    token, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *tokens]), return_inverse=True)
    return token, np.bincount(inverse, np.concatenate([np.zeros(0), *counts]), len(token)).astype(np.int64)


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """Rows of two kinds: (doc_id, n, signature) of each document; of each task and range of tokens, those that the
    task met more than once, with their counts."""
    fields = [("id", pa.int64()), ("n", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("tokens", pa.binary()), ("counts", pa.binary())]
    ranges = max(64, parallelism(docs.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        total: list[list[np.ndarray]] = [[], []]

        def count() -> None:
            every = np.concatenate(held)
            every.sort()
            start = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            times = np.diff(np.append(start, len(every)))
            total[0].append(every[start[times > 1]])
            total[1].append(times[times > 1])
            total[0], total[1] = ([x] for x in summed(*total))

        for ids, sets in document_sets(batches, k):
            sig = [signature(s) for s in sets]
            none = pa.nulls(len(ids), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[0] for s in sig], pa.int64()), pa.array([s[1] for s in sig], pa.int64()), none, none], schema=pa.schema(fields))
            held += sets
            size += sum(map(len, sets))
            if size > 2_000_000:
                count()
                held, size = [], 0
        if size:
            count()
        token, times = summed(*total)
        by = np.argsort(token % np.uint64(ranges), kind="stable")
        token, times = token[by], np.minimum(times[by], 0xFFFFFFFF).astype(np.uint32)
        edge = np.searchsorted(token % np.uint64(ranges), np.arange(ranges + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(edge)).tolist()
        if full:
            z = pa.nulls(len(full), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), z, z, z, *(pa.array([x[edge[r] : edge[r + 1]].tobytes() for r in full], pa.binary()) for x in (token, times))], schema=pa.schema(fields))

    return checkpointed(docs.mapInArrow(trimmed(run), "id long, n long, sig_a long, sig_b long, tokens binary, counts binary"))


def _frequency_classes(profile: DataFrame) -> Order:
    """The heaviest tokens of the corpus with their classes: at most ``HEAVY``, nine bytes each, on the driver."""
    most = HEAVY // max(64, parallelism(profile.sparkSession))

    def run(group: pa.Table) -> pa.Table:
        token, total = summed(*([np.frombuffer(x.as_buffer(), kind) for x in group.column(c).combine_chunks()] for c, kind in (("tokens", np.uint64), ("counts", np.uint32))))
        heavy = np.flatnonzero(total >= 4)
        if len(heavy) > most:
            heavy = heavy[np.argpartition(-total[heavy], most)[:most]]
        classes = np.minimum(np.log2(total[heavy]), 31).astype(np.uint8)
        return pa.table({"tokens": pa.array([token[heavy].tobytes()], pa.binary()), "classes": pa.array([classes.tobytes()], pa.binary())})

    rows = profile.where("tokens is not null").select("id", "tokens", "counts").groupBy("id").applyInArrow(run, "tokens binary, classes binary").collect()
    heavy, classes = (np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in (("tokens", np.uint64), ("classes", np.uint8)))
    by = np.argsort(heavy)
    return Order(heavy[by], classes[by])


POSTINGS = "bucket int, tokens binary, at binary, ids binary, sizes binary, lengths binary, sigs binary"


def _packed_postings(docs: DataFrame, order: Order, k: int, buckets: int) -> DataFrame:
    """One row per task, batch and bucket: parallel arrays of prefix tokens and the documents they belong to.

    Equal sets within a task are sent once, under their least id.
    """

    keys = even_keys(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        seen: dict[tuple[int, int], int] = {}
        prefixes, sizes = [], []

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(p) for p in prefixes], np.int32)
            tokens, doc = np.concatenate(prefixes), np.repeat(np.arange(len(ids), dtype=np.uint32), lengths)
            sig = np.array(list(seen), np.int64)
            over = ways(tokens, SPLIT)
            h = mix(sig[:, 0].astype(np.uint64))[doc]
            salt = h % over  # 0 for a token that is not split
            sent = np.flatnonzero((over > 1) & (h < _reach(over) // np.uint64(AMBASSADORS)))
            if len(sent):  # what is tried as a pivot is known in every bucket of the list
                each = over[sent].astype(np.int64)
                every = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                sent, every = np.repeat(sent, each), every.astype(np.uint64)
                other = every != salt[sent]
                tokens, doc, salt = np.append(tokens, tokens[sent[other]]), np.append(doc, doc[sent[other]]), np.append(salt, every[other])
            bucket = (mix(tokens + salt * np.uint64(7919)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            tokens, doc, bucket = tokens[by], doc[by], bucket[by]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            n, own = np.array(sizes, np.int32), np.array(ids, np.int64)
            out: list[list] = [[] for _ in range(7)]
            for b in np.flatnonzero(np.diff(edge)).tolist():
                part = doc[edge[b] : edge[b + 1]]
                used, local = np.unique(part, return_inverse=True)
                for col, v in zip(out, (keys[b], tokens[edge[b] : edge[b + 1]].tobytes(), local.astype(np.uint32).tobytes(), own[used].tobytes(), n[used].tobytes(), lengths[used].tobytes(), sig[used].tobytes()), strict=True):
                    col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["bucket", "tokens", "at", "ids", "sizes", "lengths", "sigs"])

        held = 0
        for batch_ids, sets in document_sets(batches, k):
            for i, s in zip(batch_ids.tolist(), sets, strict=True):
                if not len(s):
                    continue
                sig = signature(s)
                if sig in seen:
                    ids[seen[sig]] = min(i, ids[seen[sig]])
                    continue
                seen[sig] = len(ids)
                ids.append(i)
                sizes.append(len(s))
                prefixes.append(order.prefix(order.key(s)))
                held += len(prefixes[-1])
            if held > 1_000_000:
                yield flush()
                ids, seen, prefixes, sizes, held = [], {}, [], [], 0
        if ids:
            yield flush()

    return docs.mapInArrow(trimmed(run), POSTINGS)


SHARED = "a long, b long, c int, need int, chunk long, split int, heads binary, lens binary, at binary, ids binary, h binary, n binary, p binary"


def needed(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How many prefix tokens two documents of n and m tokens and prefixes p and q share at least if they link."""
    overlap = -(-75 * (n + m) // 175)
    return np.minimum(p - n + overlap, q - m + overlap)


def _list_pairs(token: np.ndarray, doc: np.ndarray, n: np.ndarray, p: np.ndarray, chunk: int = 2_000_000) -> tuple[np.ndarray, ...]:
    """(a, b, shared, needed): pairs of documents in short token lists, with how many lists they share here."""
    ids, index = np.unique(doc, return_inverse=True)
    size, prefix = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    size[index], prefix[index] = n, p
    start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    df = np.diff(np.append(start, len(token)))
    keys, counts = [], []
    for d in np.unique(df).tolist():
        x, y = np.triu_indices(d, 1)
        lists = start[df == d]
        for i in range(0, len(lists), max(1, chunk // len(x))):
            at = lists[i : i + max(1, chunk // len(x)), None]
            a, b = index[at + x].ravel(), index[at + y].ravel()
            fit = 100 * np.minimum(size[a], size[b]) >= 75 * np.maximum(size[a], size[b])
            a, b = a[fit], b[fit]
            key, count = np.unique(np.minimum(a, b) << 32 | np.maximum(a, b), return_counts=True)
            keys.append(key)
            counts.append(count)
    key, inverse = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_inverse=True)
    count = np.bincount(inverse, np.concatenate(counts) if counts else None, len(key)).astype(np.int64) if len(key) else key
    a, b = key >> 32, key & 0xFFFFFFFF
    return ids[a], ids[b], count, needed(size[a], prefix[a], size[b], prefix[b])


def _shared_tokens(postings: DataFrame) -> DataFrame:
    """What a bucket finds: for tokens of at most ``CROWDED`` classes, pairs (a, b) with how many tokens they share
    here; the lists of others, packed: tokens, lengths and, in the order of a hash, entries that point to the row's
    documents (id, hash, size, prefix).

    A bucket knows only a part of a split token's list, so that is always packed, however short it is here.
    """
    fields = [("a", pa.int64()), ("b", pa.int64()), ("c", pa.int32()), ("need", pa.int32()), ("chunk", pa.int64()), ("split", pa.int32()), *((c, pa.binary()) for c in ("heads", "lens", "at", "ids", "h", "n", "p"))]

    def out(size: int, **cols: np.ndarray | list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[name], kind) if name in cols else pa.nulls(size, kind) for name, kind in fields], schema=pa.schema(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[np.ndarray]] = [[] for _ in range(6)]
        for batch in batches:
            for r in range(batch.num_rows):
                tokens, at, ids, sizes, lengths, sigs = (np.frombuffer(batch.column(c + 1)[r].as_buffer(), t) for c, t in enumerate((np.uint64, np.uint32, np.int64, np.int32, np.int32, np.int64)))
                sigs = sigs.reshape(-1, 2)
                for col, v in zip(rows, (tokens, ids[at], sizes[at], lengths[at], sigs[at, 0], sigs[at, 1]), strict=True):
                    col.append(v)
        if not rows[0]:
            return
        token = np.concatenate(rows[0])
        by = np.argsort(token, kind="stable")  # first drop what stands alone
        same = token[by][1:] == token[by][:-1]
        keep = np.zeros(len(token), bool)
        keep[by[1:][same]] = keep[by[:-1][same]] = True
        del by, same
        keep |= ways(token, SPLIT) > 1  # its other classes may be in other buckets
        token = token[keep]
        cols = []
        for c in rows[1:]:
            cols.append(np.concatenate(c)[keep])
            c.clear()
        doc, n, p, s1, s2 = cols
        del cols
        by = np.lexsort((doc, s2, s1, token))  # of a class, the least id
        token, doc, n, p, s1, s2 = (c[by] for c in (token, doc, n, p, s1, s2))
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        token, doc, n, p, h = (c[first] for c in (token, doc, n, p, mix(s1.astype(np.uint64))))
        del s1, s2, by, first
        by = np.lexsort((doc, h, token))
        token, doc, n, p, h = (c[by] for c in (token, doc, n, p, h))
        del by
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(token)))
        df = np.repeat(size, size)
        split = ways(token, SPLIT) > 1
        short = (df > 1) & (df <= CROWDED) & ~split
        a, b, c, need = _list_pairs(token[short], doc[short], n[short].astype(np.int64), p[short].astype(np.int64))
        for i in range(0, len(a), 200_000):
            part = slice(i, i + 200_000)
            yield out(len(a[part]), a=a[part], b=b[part], c=c[part], need=need[part])
        lists = np.flatnonzero((size > CROWDED) | split[start]) if len(start) else start
        task = TaskContext.get().partitionId()
        for number, (i, j) in enumerate(slices(size[lists], CHUNK)):
            mine = lists[i:j]
            at = np.arange(size[mine].sum()) + np.repeat(start[mine] - (np.cumsum(size[mine]) - size[mine]), size[mine])
            ids, first, local = np.unique(doc[at], return_index=True, return_inverse=True)
            first = at[first]
            packed = (token[start[mine]], size[mine].astype(np.int32), local.astype(np.uint32), ids, h[first], n[first].astype(np.int32), p[first].astype(np.int32))
            yield out(1, chunk=[task << 24 | number], split=[int(split[start[mine]].sum())], **{name: [v.tobytes()] for (name, _), v in zip(fields[6:], packed, strict=True)})

    return postings.mapInArrow(trimmed(run), SHARED)


class Lists:
    """The crowded lists of one packed row, with the labels (component) of its documents."""

    def __init__(self, crowd: pa.Table, labels: pa.Table):
        raw = {c: crowd.column(c)[0].as_buffer() for c in ("heads", "lens", "at", "ids", "h", "n", "p")}
        read = lambda c, kind: np.frombuffer(raw[c], kind)
        self.chunk = crowd.column("chunk")[0].as_py()
        self.token, self.size, self.at = read("heads", np.uint64), read("lens", np.int32).astype(np.int64), read("at", np.uint32).astype(np.int64)
        self.ids, self.h, self.n, self.p = read("ids", np.int64), read("h", np.uint64), read("n", np.int32).astype(np.int64), read("p", np.int32).astype(np.int64)
        self.comp = self.ids.copy()
        for docs, comps in zip(labels.column("docs"), labels.column("comps"), strict=True):
            if docs.is_valid:
                self.comp[np.searchsorted(self.ids, np.frombuffer(docs.as_buffer(), np.int64))] = np.frombuffer(comps.as_buffer(), np.int64)
        self.start = np.cumsum(self.size) - self.size
        own = self.comp[self.at]
        self.low, self.high = np.minimum.reduceat(own, self.start), np.maximum.reduceat(own, self.start)

    def entries(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the entries, list) of every entry of some lists."""
        size = self.size[lists]
        return np.arange(size.sum()) + np.repeat(self.start[lists] - (np.cumsum(size) - size), size), np.repeat(lists, size)


def by_target(docs: np.ndarray, width: int, keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(key, bytes of each column) of the rows of each target, a hash of the document."""
    target = (mix(docs.astype(np.uint64)) % np.uint64(width)).astype(np.int64)
    by = np.argsort(target, kind="stable")
    edge = np.searchsorted(target[by], np.arange(width + 1))
    for t in np.flatnonzero(np.diff(edge)).tolist():
        own = by[edge[t] : edge[t + 1]]
        yield (int(keys[t]), *(c[own].tobytes() for c in (docs, *columns)))


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kind) for (name, kind), c in zip(fields, cols, strict=True)})


def _members(crowd: DataFrame, width: int) -> DataFrame:
    """(target, chunk, docs): which documents of each target a packed row holds, so that labels find their way."""
    keys = even_keys(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(t, chunk, d) for t, d in by_target(np.frombuffer(ids.as_buffer(), np.int64), width, keys)]
                yield from _table(rows, [("target", pa.int32()), ("chunk", pa.int64()), ("docs", pa.binary())]).to_batches()

    return checkpointed(crowd.select("chunk", "ids").mapInArrow(trimmed(run), "target int, chunk long, docs binary"))


def _labels_of_chunks(members: DataFrame, comps: DataFrame | None, width: int) -> DataFrame:
    """(chunk, docs, comps): the labels of a packed row's documents, as far as they have one."""
    schema = "chunk long, docs binary, comps binary"
    if comps is None:
        return members.sparkSession.createDataFrame([], schema)
    keys = even_keys(width)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = list(by_target(batch.column(0).to_numpy(), width, keys, batch.column(1).to_numpy()))
                yield from _table(rows, [("target", pa.int32()), ("docs", pa.binary()), ("comps", pa.binary())]).to_batches()

    def look_up(wanted: pa.Table, known: pa.Table) -> pa.Table:
        rows = []
        if wanted.num_rows and known.num_rows:
            doc, comp = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in known.column(c).combine_chunks()]) for c in ("docs", "comps"))
            by = np.argsort(doc, kind="stable")
            doc, comp = doc[by], comp[by]
            for chunk, ids in zip(wanted.column("chunk").to_pylist(), wanted.column("docs").combine_chunks(), strict=True):
                ids = np.frombuffer(ids.as_buffer(), np.int64)
                at = np.minimum(np.searchsorted(doc, ids), len(doc) - 1)
                hit = doc[at] == ids
                if hit.any():
                    rows.append((chunk, ids[hit].tobytes(), comp[at[hit]].tobytes()))
        return _table(rows, [("chunk", pa.int64()), ("docs", pa.binary()), ("comps", pa.binary())])

    packed = comps.select("doc", "comp").mapInArrow(pack, "target int, docs binary, comps binary")
    return members.groupBy("target").cogroup(packed.groupBy("target")).applyInArrow(look_up, schema)


def _pivot_pairs(crowd: DataFrame, labels: DataFrame, width: int, turn: int, pivots: int = 3, each: int = 3) -> DataFrame:
    """Pairs (a, b) to try: each document with the ones of other components that it shares most tokens with, among
    a few of each of its crowded lists.

    All lists of a round take those that follow the same place in the order of the hash, so near copies, whose lists
    are much alike, meet the same ones.  Lists of one component are passed over.  What a bucket counts leaves it
    packed, summed over its lists.
    """
    keys = even_keys(width)
    place = np.uint64(int(mix(np.array([turn], np.uint64))[0])) if turn else np.uint64(0)
    fields = [("target", pa.int32()), ("doc", pa.binary()), ("near", pa.binary()), ("c", pa.binary()), ("need", pa.binary())]

    def count(crowd: pa.Table, labels: pa.Table) -> pa.Table:
        if not crowd.num_rows:
            return _table([], fields)
        x = Lists(crowd, labels)
        mixed = np.flatnonzero(x.low < x.high)
        if not len(mixed):
            return _table([], fields)
        entry, of = x.entries(mixed)
        doc = x.at[entry]
        over = ways(x.token[mixed], SPLIT)
        reach = np.where(over > 1, _reach(over) // np.uint64(AMBASSADORS), np.uint64(0xFFFFFFFFFFFFFFFF))
        first = np.zeros(len(x.token), np.int64)
        for i, limit in zip(mixed.tolist(), reach.tolist(), strict=True):
            own = x.h[x.at[x.start[i] : x.start[i] + x.size[i]]]
            first[i] = np.searchsorted(own, np.uint64(int(place) * limit >> 64))
        found = []
        for step in range(pivots):
            near = x.at[x.start[of] + (first[of] + step) % x.size[of]]
            ok = (x.comp[near] != x.comp[doc]) & (100 * np.minimum(x.n[near], x.n[doc]) >= 75 * np.maximum(x.n[near], x.n[doc]))
            found.append(doc[ok] << 32 | near[ok])
        pair, c = np.unique(np.concatenate(found), return_counts=True)
        doc, near = pair >> 32, pair & 0xFFFFFFFF
        return _table(list(by_target(x.ids[doc], width, keys, x.ids[near], c.astype(np.int32), needed(x.n[doc], x.p[doc], x.n[near], x.p[near]).astype(np.int32))), fields)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in range(4)]
        for batch in batches:
            for col, c, kind in zip(parts, range(1, 5), (np.int64, np.int64, np.int32, np.int32), strict=True):
                col += [np.frombuffer(v.as_buffer(), kind) for v in batch.column(c)]
        if not parts[0]:
            return
        doc, near, c, need = (np.concatenate(v) for v in parts)
        by = np.lexsort((near, doc))
        doc, near, c, need = doc[by], near[by], c[by].astype(np.int64), need[by]
        start = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (near[1:] != near[:-1])))
        doc, near, c, need = doc[start], near[start], np.add.reduceat(c, start), need[start]
        good = c >= 0.6 * need  # a list gives few of its documents as pivots, so not every shared token is counted
        doc, near, c = doc[good], near[good], c[good]
        by = np.lexsort((near, -c, doc))
        doc, near = doc[by], near[by]
        rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
        doc, near = doc[rank < each], near[rank < each]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc, near)), pa.array(np.maximum(doc, near))], names=["a", "b"])

    counts = crowd.groupBy("chunk").cogroup(labels.groupBy("chunk")).applyInArrow(count, "target int, doc binary, near binary, c binary, need binary")
    return checkpointed(counts.repartition(width, "target").mapInArrow(trimmed(best), "a long, b long").distinct())


def _mixed_documents(crowd: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """(doc, n, p, comp, tokens): documents with lists of several components, and these lists' tokens.

    Whether a split token's list is mixed is decided over all its parts.
    """
    keys = even_keys(width)
    fields = [("target", pa.int32()), ("doc", pa.binary()), ("token", pa.binary()), ("n", pa.binary()), ("p", pa.binary()), ("comp", pa.binary())]
    more = labels.withColumn("token", F.lit(None).cast("long"))
    if not crowd.where("split > 0").isEmpty():

        def ends(crowd: pa.Table, labels: pa.Table) -> pa.Table:
            rows = []
            if crowd.num_rows:
                x = Lists(crowd, labels)
                for i in np.flatnonzero(ways(x.token, SPLIT) > 1).tolist():
                    rows.append((x.chunk, int(x.token[i].astype(np.int64)), int(x.low[i]), int(x.high[i])))
            return _table(rows, [("chunk", pa.int64()), ("token", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

        parts = checkpointed(crowd.where("split > 0").groupBy("chunk").cogroup(labels.groupBy("chunk")).applyInArrow(ends, "chunk long, token long, low long, high long"))
        several = parts.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("token")
        more = more.unionByName(parts.join(several, "token", "left_semi").select("chunk", "token"), allowMissingColumns=True)

    def collect(crowd: pa.Table, labels: pa.Table) -> pa.Table:
        if not crowd.num_rows:
            return _table([], fields)
        x = Lists(crowd, labels)
        over = ways(x.token, SPLIT) > 1
        wide = labels.column("token").drop_null().to_numpy().view(np.uint64)
        entry, of = x.entries(np.flatnonzero(np.where(over, np.isin(x.token, wide), x.low < x.high)))
        doc = x.at[entry]
        return _table(list(by_target(x.ids[doc], width, keys, x.token[of], x.n[doc].astype(np.int32), x.p[doc].astype(np.int32), x.comp[doc])), fields)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in range(5)]
        for batch in batches:
            for col, c, kind in zip(parts, range(1, 6), (np.int64, np.uint64, np.int32, np.int32, np.int64), strict=True):
                col += [np.frombuffer(v.as_buffer(), kind) for v in batch.column(c)]
        if not parts[0]:
            return
        doc, token, n, p, comp = (np.concatenate(v) for v in parts)
        by = np.lexsort((token, doc))
        doc, token, n, p, comp = (c[by] for c in (doc, token, n, p, comp))
        new = np.append(True, (doc[1:] != doc[:-1]) | (token[1:] != token[:-1]))  # ambassadors are in several parts
        doc, token, n, p, comp = (c[new] for c in (doc, token, n, p, comp))
        start = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        ends = np.append(start[1:], len(doc))
        for i in range(0, len(start), 2_000):
            a, b = start[i : i + 2_000], ends[i : i + 2_000]
            lists = pa.array([token[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(n[a]), pa.array(p[a]), pa.array(comp[a]), lists], names=["doc", "n", "p", "comp", "tokens"])

    found = crowd.groupBy("chunk").cogroup(more.groupBy("chunk")).applyInArrow(collect, "target int, doc binary, token binary, n binary, p binary, comp binary")
    return checkpointed(found.repartition(width, "target").mapInArrow(trimmed(gather), "doc long, n int, p int, comp long, tokens binary"))


def _texts(docs: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """(doc_id, text) of the documents of ``nodes`` (doc), and perhaps a few others, without moving other texts.

    ``count`` is an upper bound of the rows of ``nodes``: few ids are sent to all tasks, more as a bitmap of hashes, whose
    size follows the count up to 32 MB.
    """
    if count <= SMALL_IDS:
        return docs.join(F.broadcast(nodes.select(F.col("doc").alias("doc_id")).distinct()), "doc_id", "left_semi")
    words = 1 << min(22, int(count).bit_length() - 2)  # 16 bits an id, as far as that goes
    at = F.pmod(F.xxhash64("doc"), F.lit(words * 64))
    found = nodes.select((at / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc), 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(words, np.uint64)
    bits[found.w.to_numpy()] = found.b.to_numpy(np.int64).astype(np.uint64)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(2).to_numpy(zero_copy_only=False)
            word, bit = (h % (words * 64)) // 64, (h % 64).astype(np.uint64)
            yield batch.select([0, 1]).filter(pa.array(bits[word] >> bit & np.uint64(1) == 1))

    return docs.withColumn("h", F.xxhash64("doc_id")).mapInArrow(wanted, "doc_id long, text string")


def _verified(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) that link, decided on the whole sets of both documents."""
    nodes = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                sets = {}
                for i, t in ((0, 2), (1, 3)):
                    ids = part.column(i).to_pylist()
                    first = {d: r for r, d in enumerate(ids) if d not in sets}
                    texts = part.column(t).take(pa.array(list(first.values()), pa.int64()))
                    sets.update(zip(first, distinct_shingles(*column_bytes(texts), k), strict=True))
                keep = []
                for x, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    x, y = sorted((sets[x], sets[y]), key=len)
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int((y[at] == x).sum())
                    keep.append(100 * both >= 75 * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    found = checkpointed(_texts(docs, nodes, 2 * pairs.count()))
    left = pairs.select("a", "b").join(found.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(found.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    return checkpointed(both.mapInArrow(trimmed(check), "a long, b long"))


def _best(candidates: DataFrame) -> DataFrame:
    """Of each document's candidates (doc, near, c) two of those that share most tokens, as pairs (a, b)."""
    top = candidates.groupBy("doc").agg(F.max(F.struct("c", "near")).alias("x"), F.max(F.struct("c", (-F.col("near")).alias("near"))).alias("y"))
    near = F.explode(F.array(F.col("x.near"), -F.col("y.near"))).alias("near")
    return top.select("doc", near).select(F.least("doc", "near").alias("a"), F.greatest("doc", "near").alias("b")).distinct()


def ngram_links(docs: DataFrame, k: int = 5, rounds: int = 6) -> tuple[DataFrame, DataFrame]:
    """(profile of all documents, links between classes).

    The links connect exactly the components of the complete join; links within a component that was already
    connected are not listed.
    """
    docs = id_and_text(docs).where("doc_id is not null")
    width = parallelism(docs.sparkSession)
    profile = _profile(docs, k)
    postings = _packed_postings(docs, _frequency_classes(profile), k, width)
    found = checkpointed(_shared_tokens(postings.repartition(width, "bucket")))
    crowd = found.where("chunk is not null").drop("a", "b", "c", "need")
    short = checkpointed(found.where("chunk is null").groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("need").alias("need")))

    enough = short.where("c >= need").select("a", "b", "c")
    both = enough.select(F.col("a").alias("doc"), F.col("b").alias("near"), "c").unionByName(enough.select(F.col("b").alias("doc"), F.col("a").alias("near"), "c"))
    links = _verified(docs, checkpointed(_best(both)), k)
    comps = _labels(links, None)

    # pivot rounds unite crowds, so that their pairs need not be looked at
    pairs = enough.select("a", "b")
    if not crowd.isEmpty():
        members = _members(crowd, width)
        for turn in range(rounds):
            tried = _pivot_pairs(crowd, _labels_of_chunks(members, comps, width), width, turn)
            asked = tried.count()
            if not asked:
                break
            more = _verified(docs, tried, k)
            links = links.unionByName(more)
            comps = _labels(more, comps)
            if 50 * more.count() < asked:
                break
        left = _mixed_documents(crowd, _labels_of_chunks(members, comps, width), width)
        pairs = pairs.unionByName(_crowd_pairs(left, short))

    # the complete step: what shares enough tokens and is not united
    rest = checkpointed(_label_pairs(pairs.distinct(), comps).where("ca <> cb").select("a", "b"))
    return profile, checkpointed(links.unionByName(_verified(docs, rest, k)).distinct())


def _labels(links: DataFrame, before: DataFrame | None) -> DataFrame:
    """(doc, comp) of linked documents: labels of ``before``, merged over ``links``.

    Each label takes the least label next to it, then that one's.  Components that should be one may stay apart,
    which costs work in later steps but loses nothing.
    """
    ends = links.select("a", "b") if before is None else _label_pairs(links, before).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    step = checkpointed(both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to")))
    jump = step.alias("s").join(step.alias("t"), F.col("s.to") == F.col("t.a"), "left").select(F.col("s.a").alias("doc"), F.coalesce("t.to", "s.to").alias("comp"))
    if before is None:
        return checkpointed(jump)
    moved = before.join(jump.select(F.col("doc").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("doc", F.coalesce("to", "comp").alias("comp"))
    new = jump.join(before.select("doc"), "doc", "left_anti")
    return checkpointed(moved.unionByName(new))


def _label_pairs(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (a, b) with their labels ca and cb."""
    x, y = comps.select(F.col("doc").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("doc").alias("b"), F.col("comp").alias("cb"))
    return pairs.join(x, "a", "left").join(y, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))


def size_blocks(counts: dict[int, int], block: int) -> list[tuple[int, int, int, int, int]]:
    """(band, first own block, own blocks, first block to meet, last block to meet) of each band of sizes.

    Neighbouring bands share blocks until there are ``block`` documents; a band meets its own blocks and those of the
    bands next to it, as documents of other bands differ too much in size.
    """
    groups: list[list[int]] = []
    for band in sorted(counts):
        if not groups or sum(counts[b] for b in groups[-1]) >= block:
            groups.append([])
        groups[-1].append(band)
    number = [-(-sum(counts[b] for b in g) // block) for g in groups]
    first = np.cumsum([0, *number]).tolist()
    out = []
    for i, g in enumerate(groups):
        meets = [j for j, o in enumerate(groups) if o[0] - 1 <= g[-1] and g[0] - 1 <= o[-1]]
        out += [(band, first[i], number[i], first[meets[0]], first[meets[-1] + 1] - 1) for band in g]
    return out


def _crowd_pairs(rows: DataFrame, short: DataFrame, block: int = 4_000) -> DataFrame:
    """Pairs (a, b) across components that share enough prefix tokens, among documents with a crowded token.

    ``short`` has what such pairs share in short lists.  Crowded lists are too long to be joined row by row: the
    documents are dealt, by ranges of their sizes, to blocks of about ``block``, and for each two blocks whose sizes
    fit one task counts shared tokens with an inverted index.  It puts out a pair only if these and the most that
    either document shares with any other in short lists are enough.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("band", F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int"))
    counts = {r.band: r["count"] for r in rows.groupBy("band").count().collect()}  # some forty bands
    if not counts:
        return spark.createDataFrame([], "a long, b long")
    members = rows.select("doc")
    inner = short.join(members.select(F.col("doc").alias("a")), "a", "left_semi").join(members.select(F.col("doc").alias("b")), "b", "left_semi")
    short = checkpointed(inner.select("a", "b", "c"))
    blocks = F.broadcast(spark.createDataFrame(size_blocks(counts, block), "band int, first int, blocks int, low int, high int"))
    most = short.select(F.explode(F.array("a", "b")).alias("doc"), "c").groupBy("doc").agg(F.max("c").alias("most"))
    one = rows.join(most, "doc", "left").withColumn("most", F.coalesce("most", F.lit(0))).join(blocks, "band").withColumn("own", F.col("first") + F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    spread = one.withColumn("other", F.explode(F.sequence("low", "high"))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).select("doc", "n", "p", "comp", "tokens", "most", "own", "i", "j")

    def run(group: pa.Table) -> pa.Table:
        col = {c: group.column(c).combine_chunks() for c in group.column_names}
        i, j = col["i"][0].as_py(), col["j"][0].as_py()
        doc, n, p, comp, own, most = (col[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc", "n", "p", "comp", "own", "most"))
        raw, offsets = column_bytes(col["tokens"])
        token, ends = raw.view(np.uint64), offsets[1:] // 8
        low = np.flatnonzero(own == i)
        place = np.full(len(doc), -1)
        place[low] = np.arange(len(low))
        holder = np.repeat(place, np.diff(ends, prepend=0))
        listed = holder >= 0
        by = np.argsort(token[listed], kind="stable")
        index, holder = token[listed][by], holder[listed][by]
        found: list[list[np.ndarray]] = [[], [], [], []]
        for r in np.flatnonzero(own == j).tolist():
            mine = token[ends[r - 1] if r else 0 : ends[r]]
            a, b = np.searchsorted(index, mine, "left"), np.searchsorted(index, mine, "right")
            size = b - a
            if not size.any():
                continue
            at = np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)
            shared = np.bincount(holder[at], minlength=len(low))
            need = needed(n[r], p[r], n[low], p[low])
            good = (shared > 0) & (shared + np.minimum(most[r], most[low]) >= need) & (comp[low] != comp[r]) & (100 * np.minimum(n[low], n[r]) >= 75 * np.maximum(n[low], n[r]))
            if i == j:
                good &= doc[low] < doc[r]
            other = doc[low][good]
            for v, x in zip(found, (np.minimum(other, doc[r]), np.maximum(other, doc[r]), shared[good], need[good]), strict=True):
                v.append(x)
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for c, v in zip(("a", "b", "hot", "need"), found, strict=True)})

    hot = spread.groupBy("i", "j").applyInArrow(run, "a long, b long, hot long, need long")
    return hot.join(short.select("a", "b", "c"), ["a", "b"], "left").where(F.col("hot") + F.coalesce("c", F.lit(0)) >= F.col("need")).select("a", "b")


def _shared(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 4_000_000) -> np.ndarray:
    """How many tokens each set of ``left`` shares with each of ``right``: rare tokens by their lists, frequent ones
    as columns of a product of matrices."""
    m, q = len(left), len(right)
    every, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    x, y = (np.repeat(np.arange(len(v)), [len(s) for s in v]) for v in (left, right))
    cx, cy = column[: len(x)], column[len(x) :]
    fx, fy = np.bincount(cx, minlength=len(every)), np.bincount(cy, minlength=len(every))
    dense = fx * fy * 150 > m * q
    out = np.zeros(m * q, np.int64)
    by = np.argsort(cy, kind="stable")
    listed, start = y[by], np.cumsum(fy) - fy
    rare = ~dense[cx] & (fy[cx] > 0)
    row, col = x[rare], cx[rare]
    size = fy[col]
    for a, b in slices(size, chunk):
        n = size[a:b]
        at = np.arange(n.sum()) + np.repeat(start[col[a:b]] - (np.cumsum(n) - n), n)
        out += np.bincount(np.repeat(row[a:b], n) * q + listed[at], minlength=m * q)
    out = out.reshape(m, q)
    number = np.cumsum(dense) - 1
    wide = int(dense.sum())
    step = max(64, chunk // (m + q))
    for a in range(0, wide, step):
        blocks = []
        for size, holder, c in ((m, x, cx), (q, y, cy)):
            block = np.zeros((size, min(step, wide - a)), np.float32)
            here = dense[c] & (number[c] >= a) & (number[c] < a + step)
            block[holder[here], number[c[here]] - a] = 1
            blocks.append(block)
        out += (blocks[0] @ blocks[1].T).astype(np.int64)
    return out


def _degrees(docs: DataFrame, classes: DataFrame, k: int, block: int = 4_000, weight: int = 1_000_000, strip: int = 1_000) -> DataFrame:
    """(class_id, others): the documents of other classes that link to each class, by the whole sets.

    All links are within components, so all pairs of a component's classes are compared, block by block, and only
    sums are put out.  Small components share a bucket; a component beyond ``block`` classes or ``weight`` tokens is
    dealt to blocks.
    """
    whole = classes.groupBy("component_id").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("w")).where("m > 1")
    blocks = F.ceil(F.greatest(F.col("m") / block, F.col("w") / weight)).cast("int")
    inner = checkpointed(classes.join(whole.select("component_id", blocks.alias("blocks")), "component_id"))
    count, total = inner.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    if not count:
        return inner.select("class_id", F.lit(0).cast("long").alias("others"))
    buckets = max(parallelism(docs.sparkSession), -(-count // block), -(-total // weight))
    small = F.col("blocks") == 1
    placed = inner.select(
        "class_id", "component_id", "copies", "blocks", F.pmod(F.xxhash64("class_id"), "blocks").cast("int").alias("own"),
        F.when(small, F.pmod(F.xxhash64("component_id"), F.lit(buckets))).otherwise(F.col("component_id")).alias("team"), small.alias("small"),
    )
    texts = _texts(docs, inner.select(F.col("class_id").alias("doc")), count).withColumnRenamed("doc_id", "class_id")
    rows = placed.join(texts, "class_id")
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def run(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        ids, comp, copies, own = (group.column(c).to_numpy().astype(np.int64) for c in ("class_id", "component_id", "copies", "own"))
        text = group.column("text").combine_chunks()
        first = np.unique(ids, return_index=True)[1]  # repeated rows count once
        first = first[np.argsort(comp[first], kind="stable")]
        out: list[list[np.ndarray]] = [[], []]
        for at in np.split(first, np.flatnonzero(np.diff(comp[first])) + 1):
            x, y = (at, at) if i == j else (at[own[at] == i], at[own[at] == j])
            left = distinct_shingles(*column_bytes(text.take(pa.array(x))), k)
            right = left if i == j else distinct_shingles(*column_bytes(text.take(pa.array(y))), k)
            if not left or not right:
                continue
            m = np.array([len(s) for s in right])
            for a in range(0, len(left), strip):
                part, own = left[a : a + strip], x[a : a + strip]
                both = _shared(part, right)
                link = 100 * both >= 75 * (np.array([len(s) for s in part])[:, None] + m - both)
                if i == j:
                    link[np.arange(len(part)), np.arange(a, a + len(part))] = False
                else:
                    out[0].append(ids[y])
                    out[1].append(copies[own] @ link)
                out[0].append(ids[own])
                out[1].append(link @ copies[y])
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for c, v in zip(("class_id", "others"), out, strict=True)})

    return spread.groupBy("small", "team", "i", "j").applyInArrow(run, "class_id long, others long").groupBy("class_id").agg(F.sum("others").alias("others"))


def _classified(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of each document."""
    profile, links = ngram_links(docs, k)
    meta = profile.where("tokens is null").select(F.col("id").alias("doc_id"), "n", "sig_a", "sig_b")
    classes = meta.where("n > 0").groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("class_id"))
    joined = meta.join(classes, ["sig_a", "sig_b"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))
    comp = connected_components(links).withColumnRenamed("node", "class_id")
    return joined.join(comp, "class_id", "left").select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))


def _nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with a number of its own for each row, and the table (node, id) of these numbers.

    Where no id is repeated the ids are the numbers and there is no table.
    """
    rows = id_and_text(docs).where("doc_id is not null")
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows, None
    numbered = checkpointed(rows.withColumn("node", F.monotonically_increasing_id()))
    return numbered.select(F.col("node").alias("doc_id"), "text"), numbered.select("node", F.col("doc_id").alias("id"))


def _named(rows: DataFrame, names: DataFrame | None) -> DataFrame:
    """Rows of ``_classified`` over numbers, by ids: rows of one id bring their components together."""
    if names is None:
        return rows
    known = checkpointed(rows.join(names, rows.doc_id == names.node).drop("doc_id", "node"))
    least = known.groupBy("component_id").agg(F.min("id").alias("b"))
    united = connected_components(known.join(least, "component_id").select(F.col("id").alias("a"), "b"))
    first = known.groupBy("class_id").agg(F.min("id").alias("first"))
    out = known.join(first, "class_id").join(united, known.id == united.node, "left")
    named = {"doc_id": F.col("id"), "class_id": F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("id")), "component_id": F.coalesce("component", "id")}
    return out.select(*(named[c].alias(c) if c in named else F.col(c) for c in rows.columns))


def ngram_components(docs: DataFrame, k: int = 5) -> DataFrame:
    """Per document: doc_id, n_shingles, class_id (least doc_id with the same set), n_links, component_id.

    n_links is the number of other rows that the row links to, equal sets included.
    """
    with scratch(docs.sparkSession):
        nodes, names = _nodes(docs)
        rows = checkpointed(_classified(nodes, k))
        classes = checkpointed(rows.where("n_shingles > 0").groupBy("class_id", "component_id").agg(F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles")))
        others = _degrees(nodes, classes, k)
        degree = classes.join(others, "class_id", "left").select("class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        linked = rows.join(degree, "class_id", "left").select("doc_id", "n_shingles", "class_id", F.when(F.col("n_shingles") > 0, F.col("n_links")).otherwise(0).alias("n_links"), "component_id")
        return outliving(_named(linked, names))


def keep_first_of_components(docs: DataFrame, k: int = 5) -> DataFrame:
    """The rows of ``docs`` whose document is the least of its component (of rows that share an id, all)."""
    with scratch(docs.sparkSession):
        nodes, names = _nodes(docs)
        drop = outliving(_named(_classified(nodes, k), names).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
