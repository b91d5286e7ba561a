"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded (a learned table), a bank of learned filters of ``WIDTH`` bytes moves over them in
steps of ``STRIDE``, and rectified responses are max-pooled over chunks of two blocks; each chunk overlaps the
next by a block, and together they cover the whole document.  The mean and the maximum over the chunks go
through a small hidden layer into one probability.

Training (Adam, on the driver) sees only a bounded sample of labelled rows outside the held-out fold;
``per_class`` bounds it.  Scoring is a map without a shuffle.

Cases: a null or empty text is scored as a text without bytes (padding only); texts of any length are covered
whole; scores have six places; equal texts get equal scores; without an id held_out is null; an empty table gives an
empty result; without labels of both classes every
score is the share of class 1 (0.5 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, fold, id_and_text, slices, small_batches, trimmed
from .samples import class_weights, labelled_sample

WIDTH, STRIDE, BLOCK = 9, 3, 48
DIM, FILTERS, HIDDEN = 6, 24, 16
SPAN = STRIDE * BLOCK


class ByteNet:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "embed": g(256, DIM, scale=0.5),
            "conv": g(WIDTH * DIM, FILTERS, scale=(WIDTH * DIM) ** -0.5 * 1.4), "conv_b": np.zeros(FILTERS, np.float32),
            "hid": g(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5 * 1.4), "hid_b": np.zeros(HIDDEN, np.float32),
            "out": g(HIDDEN, scale=HIDDEN**-0.5), "out_b": np.zeros(1, np.float32),
        }
        self.constant: float | None = None
        self.shift = np.zeros(2 * FILTERS, np.float32)
        self.scale = np.ones(2 * FILTERS, np.float32)

    def lay_out(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with each document padded to whole blocks, blocks of each document, live positions."""
        size = np.diff(offsets)
        blocks = (size + WIDTH + SPAN - 1) // SPAN
        start = np.concatenate([[0], np.cumsum(blocks * SPAN)])
        laid = np.zeros(start[-1] + WIDTH, np.uint8)
        laid[np.arange(len(raw)) + np.repeat(start[:-1] - offsets[:-1], size)] = raw
        at = np.arange(start[-1] // STRIDE) * STRIDE
        end = np.repeat(start[:-1] + np.maximum(size, 1), blocks * BLOCK)
        return laid, blocks, at < end

    def blocks(self, laid: np.ndarray, live: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maximum of each filter over each block, and where it was."""
        n = len(live)
        windows = np.lib.stride_tricks.sliding_window_view(laid, WIDTH)[: n * STRIDE : STRIDE]
        x = self.p["embed"][windows].reshape(n, WIDTH * DIM)
        a = np.maximum(x @ self.p["conv"] + self.p["conv_b"], 0)
        a[~live] = 0
        a = a.reshape(-1, BLOCK, FILTERS)
        return a.max(1), a.argmax(1) if where else None

    @staticmethod
    def chunks(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First block and second block of each chunk, chunks of each document (a lone block is one chunk)."""
        count = np.maximum(blocks - 1, 1)
        first = np.arange(count.sum()) + np.repeat(np.cumsum(blocks) - blocks - (np.cumsum(count) - count), count)
        return first, first + np.repeat(blocks > 1, count), count

    def pooled(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean and maximum over the chunks: one row for each document."""
        laid, blocks, live = self.lay_out(raw, offsets)
        top = np.concatenate([self.blocks(laid[a * SPAN : b * SPAN + WIDTH], live[a * BLOCK : b * BLOCK])[0] for a, b in _steps(int(blocks.sum()), 4_000)])
        first, second, count = self.chunks(blocks)
        chunk = np.maximum(top[first], top[second])
        begin = np.cumsum(count) - count
        return np.concatenate([np.add.reduceat(chunk, begin) / count[:, None], np.maximum.reduceat(chunk, begin)], 1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        h = np.maximum((pooled - self.shift) / self.scale @ self.p["hid"] + self.p["hid_b"], 0)
        return h @ self.p["out"] + self.p["out_b"][0]

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not len(offsets) - 1:
            return np.zeros(0)
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(raw, offsets)).astype(np.float64), -30, 30)))

    def gradients(self, raw: np.ndarray, offsets: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        laid, blocks, live = self.lay_out(raw, offsets)
        top, arg = self.blocks(laid, live, where=True)
        first, second, count = self.chunks(blocks)
        use_second = top[second] > top[first]
        chunk = np.where(use_second, top[second], top[first])
        begin, doc = np.cumsum(count) - count, np.repeat(np.arange(len(count)), count)
        mean, high = np.add.reduceat(chunk, begin) / count[:, None], np.maximum.reduceat(chunk, begin)
        z = (np.concatenate([mean, high], 1) - self.shift) / self.scale
        pre = z @ p["hid"] + p["hid_b"]
        h = np.maximum(pre, 0)
        prob = 1 / (1 + np.exp(-np.clip(h @ p["out"] + p["out_b"][0], -30, 30)))
        d = ((prob - y) * weight / len(y)).astype(np.float32)
        dh = np.outer(d, p["out"]) * (pre > 0)
        g = {"out": h.T @ d, "out_b": d.sum(keepdims=True), "hid": z.T @ dh, "hid_b": dh.sum(0)}
        dz = dh @ p["hid"].T / self.scale
        dchunk = (dz[:, :FILTERS] / count[:, None])[doc]
        is_high = chunk == high[doc]
        ties = np.add.reduceat(is_high.astype(np.float32), begin)
        dchunk = dchunk + np.where(is_high, (dz[:, FILTERS:] / ties)[doc], 0)
        block = np.where(use_second, second[:, None], first[:, None])
        dblock = np.zeros_like(top)
        np.add.at(dblock, (block, np.broadcast_to(np.arange(FILTERS), block.shape)), dchunk)
        dblock[top <= 0] = 0  # rectified, or padding
        b, f = np.nonzero(dblock)
        dv, at = dblock[b, f], (b * BLOCK + arg[b, f]) * STRIDE
        seen = laid[at[:, None] + np.arange(WIDTH)]
        emb = p["embed"][seen].reshape(len(at), -1)
        g["conv"], g["conv_b"] = np.zeros_like(p["conv"]), np.bincount(f, dv, FILTERS).astype(np.float32)
        for k in range(FILTERS):
            own = f == k
            g["conv"][:, k] = emb[own].T @ dv[own]
        demb = (dv[:, None] * p["conv"].T[f]).reshape(-1, DIM)
        g["embed"] = np.stack([np.bincount(seen.ravel(), demb[:, c], 256) for c in range(DIM)], 1).astype(np.float32)
        return g

    def fit(self, texts: list[bytes], y: np.ndarray, prior: float, epochs: int = 10, batch: int = 48, rate: float = 4e-3, seed: int = 11) -> ByteNet:
        y = np.asarray(y, np.float32)
        if len(y) == 0 or y.min() == y.max():
            self.constant = prior
            return self
        r, weight = np.random.default_rng(seed), class_weights(y, prior).astype(np.float32)
        weight = np.sqrt(weight)  # between balanced and natural; the intercept is put right below
        one, two = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}
        some = r.permutation(len(y))[:300]
        z = self.pooled(*_pack([texts[i] for i in some]))
        self.shift, self.scale = z.mean(0), z.std(0) + 0.1
        step, total = 0, epochs * -(-len(y) // batch)
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), batch):
                pick, step = order[i : i + batch], step + 1
                g = self.gradients(*_pack([texts[k] for k in pick]), y[pick], weight[pick])
                now = rate * (1 - 0.9 * step / total)
                for k, v in g.items():
                    one[k] = 0.9 * one[k] + 0.1 * v
                    two[k] = 0.99 * two[k] + 0.01 * v * v
                    self.p[k] = self.p[k] - (now * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        self._intercept(texts, y, class_weights(y, prior))
        return self

    def _intercept(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> None:
        """Shift the logits until their mean probability is the share of class 1."""
        z = np.concatenate([self.logits(self.pooled(*_pack(texts[i : i + 200]))) for i in range(0, len(texts), 200)]).astype(np.float64)
        want, low, high = np.average(y, weights=weight), -10.0, 10.0
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (mid, high) if np.average(1 / (1 + np.exp(-np.clip(z + mid, -30, 30))), weights=weight) < want else (low, mid)
        self.p["out_b"] = (self.p["out_b"] + low).astype(np.float32)


def _steps(n: int, step: int) -> list[tuple[int, int]]:
    return [(i, min(n, i + step)) for i in range(0, n, step)]


def _pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, per_class: int = 2_000) -> ByteNet:
    """Fit the network on at most ``per_class`` labelled rows of each class outside the held-out fold."""
    rows, prior = labelled_sample(docs, labels, label, folds, held, per_class)
    return ByteNet().fit([t.encode() for t in rows.text], rows.y.to_numpy(), prior)


def scores_of(model: ByteNet, texts: pa.Array, slice_bytes: int = 1_000_000) -> np.ndarray:
    """Scores of whole texts; memory is bounded by the slice (and one text)."""
    raw, offsets = column_bytes(texts)
    parts = [model.score(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(np.diff(offsets), slice_bytes)]
    return np.round(np.concatenate(parts), 6) if parts else np.zeros(0)  # what lies beyond depends on the slice


def quality_scores(docs: DataFrame, model: ByteNet, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = scores_of(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(trimmed(run), "doc_id long, score double")
    return with_fold(scored, folds, held, threshold)


def with_fold(scored: DataFrame, folds: int, held: int, threshold: float) -> DataFrame:
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    return scored.select("doc_id", (rest == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: ByteNet, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text the network accepts."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column(at), "")
            yield batch.filter(pa.array(scores_of(model, text) >= threshold))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(trimmed(run), docs.schema)


__all__ = ["ByteNet", "fold", "keep_quality", "quality_scores", "train_quality"]
