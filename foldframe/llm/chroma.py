"""Media columns: chroma fingerprints of recordings and their alignment.

A recording is cut into overlapping frames; each frame's spectrum is folded into twelve pitch classes and smoothed
over time.  Sixteen box filters over the (frame, pitch class) plane, evaluated with an integral image, each give two
bits; together they are one packed 32-bit integer for each frame.

Recordings with equal fingerprints are one class.  Frames meet by a key of the signs that eleven filters each have in three
frames, ``GAP`` apart.  Every frame of every class is indexed once; a frame that is asked is looked up under all the
keys that come of turning its least certain signs (those with an answer next to zero, up to ``FLIPS``).  The histogram of
the offsets of what meets names the alignments to try, all of them, and the share of differing bits over the whole
overlap decides.  Matches are reported between class representatives, with the class of each recording beside, so
copies are never expanded into pairs.

Frames without sound say nothing: they have no key and count in no overlap where both recordings are silent.  Nor has
the inside of a run of equal keys one (a held tone).  So neither silence nor a tone that many recordings share grows
into pairs of frames.  A key that many recordings share otherwise is a hot key of an equi-join, which adaptive
execution splits.

Cases: a null value, or a recording shorter than one frame, has no fingerprint, no match, and a class of its own; so has
a value that cannot be decoded, with the ``reason``; silence has a constant fingerprint, and matches only within its class; repeated rows fall
into one class; of recordings that share an id and are not equal, one stands for the id; of offsets with equal errors the least, then the smaller, is reported; rows without an id are left out; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import random
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, trimmed
from .shingles import mix

RATE, FRAME, HOP = 4_000, 1_024, 256
CLASSES, WIDTH = 12, 12
GAP, FLIPS, EDGE = 6, 6, 3  # frames between the prints of a key; signs turned; frames kept at the ends of a run


def _filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, height, width) of sixteen different filters, by a rule: three kinds over all classes."""
    out = []
    for i in range(16):
        kind, low, height = i % 3, (5 * i + i // 9) % (CLASSES - 3), 2 + i % 3 * 2
        out.append((kind, low, height if low + height <= CLASSES else 2, 4 + 4 * kind))
    return out


FILTERS = _filters()
STEPS = (-0.12, 0.0, 0.12)  # the limits between a filter's four answers
GRAY = np.array([0, 1, 3, 2], np.uint32)
SILENT = np.uint32(0x55555555)  # every filter answers zero
_DRAW = random.Random(14)  # of two dozen draws one that met all of 425 noisy recordings
KEY_BITS = [(k * GAP, 2 * f + 1) for k in range(3) for f in sorted(_DRAW.sample(range(16), 11))]  # (frame, sign of a filter)


def _fold() -> np.ndarray:
    """Share of each spectral line in each pitch class (nearest semitone, 65 to 1,900 Hz)."""
    hertz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((FRAME // 2 + 1, CLASSES), np.float32)
    heard = (hertz >= 65) & (hertz <= 1_900)
    out[np.flatnonzero(heard), np.round(12 * np.log2(hertz[heard] / 440)).astype(int) % 12] = 1
    return out


FOLD, HANN = _fold(), np.hanning(FRAME).astype(np.float32)


def decode_wav(raw: bytes) -> np.ndarray:
    """Samples of a WAV file of 8, 16, 24 or 32 bits, channels averaged, resampled to ``RATE`` by linear interpolation."""
    with wave.open(io.BytesIO(raw)) as f:
        width, rate, channels = f.getsampwidth(), f.getframerate(), f.getnchannels()
        data = np.frombuffer(f.readframes(f.getnframes()), np.uint8)
    data = data[: len(data) - len(data) % (width * channels)].reshape(-1, width)
    if width == 1:
        x = data[:, 0].astype(np.float32) / 128 - 1
    else:
        wide = np.zeros((len(data), 4), np.uint8)
        wide[:, 4 - width :] = data
        x = wide.view("<i4")[:, 0].astype(np.float32) / 2**31
    x = x.reshape(-1, channels).mean(1)
    if rate != RATE and len(x):
        x = np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x)
    return x.astype(np.float32)


def tune_of_vector(vector: np.ndarray, note: int = 500) -> np.ndarray:
    """A vector as a tune: a note for each component, its pitch rising with the component's value."""
    x = np.asarray(vector, np.float64)
    if not len(x):
        return np.zeros(0, np.float32)
    pitch = 220 * 2 ** np.tanh(0.7 * x * np.sqrt(len(x)))
    phase = np.cumsum(np.repeat(2 * np.pi * pitch / RATE, note))
    return (0.7 * np.sin(phase) + 0.3 * np.sin(2 * phase)).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Pitch-class energies of each frame, smoothed over five frames and of unit length."""
    if len(samples) < FRAME:
        return np.zeros((0, CLASSES), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * HANN
    lines = np.fft.rfft(frames, axis=1)
    energy = (lines.real**2 + lines.imag**2).astype(np.float32) @ FOLD
    padded = np.pad(energy, ((2, 2), (0, 0)), "edge")
    smooth = sum(w * padded[k : k + len(energy)] for k, w in enumerate((0.1, 0.25, 0.3, 0.25, 0.1)))
    norm = np.sqrt((smooth**2).sum(1, keepdims=True))
    return np.where(norm > 1e-6, smooth / np.maximum(norm, 1e-6), 0)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One packed integer for each frame that has ``WIDTH`` frames from it on."""
    plane = chroma(samples)
    n = len(plane) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(plane) + 1, CLASSES + 1))
    image[1:, 1:] = plane.cumsum(0).cumsum(1)
    at = np.arange(n)

    def box(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]

    out = np.zeros(n, np.uint32)
    for kind, low, height, width in FILTERS:
        whole = box(0, width, low, low + height)
        if kind == 0:  # this band against the later half
            part = box(width // 2, width, low, low + height)
        elif kind == 1:  # lower against upper half of the band
            part = box(0, width, low, low + height // 2)
        else:  # crossed quarters
            part = box(0, width // 2, low, low + height // 2) + box(width // 2, width, low + height // 2, low + height)
        value = np.log1p(part) - np.log1p(np.maximum(whole - part, 0))
        out = out << np.uint32(2) | GRAY[np.searchsorted(STEPS, value)]
    return out


def fingerprints(media: DataFrame, decode: Callable = decode_wav, id_col: str = "media_id", value_col: str = "audio") -> DataFrame:
    """Per recording: media_id, sig (hash of the fingerprint, null without one), prints (binary, 4 bytes a frame), reason
    (why a value could not be decoded, else null)."""
    rows = media.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("media_id"), F.col(value_col).alias("value"))

    def one(value) -> tuple[bytes, str | None]:
        if value is None:
            return b"", None
        try:
            return fingerprint(np.asarray(decode(value), np.float32)).astype("<u4").tobytes(), None
        except (wave.Error, EOFError, ValueError) as e:
            return b"", f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                prints, reason = zip(*map(one, part.column(1).to_pylist()), strict=True)
                sig = [int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little", signed=True) if p else None for p in prints]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sig, pa.int64()), pa.array(prints, pa.binary()), pa.array(reason, pa.string())], names=["media_id", "sig", "prints", "reason"])

    return rows.mapInArrow(trimmed(run), "media_id long, sig long, prints binary, reason string")


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame, key, uncertain signs as bits of the key) of a recording's frames that have a key."""
    n = len(prints) - 2 * GAP
    if n < 1:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    key, uncertain = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for place, (at, bit) in enumerate(KEY_BITS):
        part = prints[at : at + n].astype(np.uint64)
        key |= (part >> np.uint64(bit) & np.uint64(1)) << np.uint64(place)
        uncertain |= (part >> np.uint64(bit - 1) & np.uint64(1)) << np.uint64(place)
    sounding = sum((prints[k * GAP : k * GAP + n] != SILENT).astype(int) for k in range(3)) >= 2
    new = np.append(True, key[1:] != key[:-1])
    number = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    at = np.arange(n)
    keep = np.flatnonzero(sounding & ((at - start[number] < EDGE) | (end[number] - at <= EDGE)))
    return keep.astype(np.int32), key[keep], uncertain[keep]


def turned(key: np.ndarray, uncertain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the frame, key) for every choice of up to ``FLIPS`` uncertain signs of each frame."""
    index, left = np.arange(len(key)), uncertain.copy()
    for _ in range(FLIPS):
        low = left & (~left + np.uint64(1))  # the lowest uncertain sign, 0 if there is none
        left ^= low
        more = low[index] > 0
        index, key = np.append(index, index[more]), np.append(key, key[more] ^ low[index[more]])
    return index, key


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys under which the frames of a recording stand, or (asked) are looked up."""
    for batch in batches:
        for a in range(0, batch.num_rows, 400):
            part = batch.slice(a, 400)
            out: list[list[np.ndarray]] = [[], [], []]
            for i, asked, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                at, key, uncertain = keys_of(np.frombuffer(p.as_buffer(), "<u4"))
                if asked:
                    index, key = turned(key, uncertain)
                    at = at[index]
                for col, v in zip(out, (mix(key).astype(np.int64), np.full(len(at), i, np.int64), at), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["key", "id", "at"])


def _bit_errors(least: int, most: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, m, offset, x, y in zip(*(batch.column(c) for c in range(5)), strict=True):
                x, y, o = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4"), offset.as_py()
                a, b = max(0, o), min(len(x), len(y) + o)  # frame t of the query is frame t - o of the match
                x, y = x[a : max(a, b)], y[a - o : max(a, b) - o]
                heard = (x != SILENT) | (y != SILENT)
                frames = int(heard.sum())
                if frames >= least:
                    rate = float(np.bitwise_count(x[heard] ^ y[heard]).sum()) / (32 * frames)
                    if rate <= most:
                        rows.append((q.as_py(), m.as_py(), o, rate))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], names=["class_id", "match_id", "offset", "bit_error_rate"])

    return run


def aligned_classes(prints: DataFrame, asked: DataFrame, least: int = 40, most: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(media_id, class_id, reason) of every recording, and (class_id, match_id, offset, bit_error_rate) of every class
    that holds an asked recording against all classes.

    An alignment has at least ``least`` frames of overlap in which one of both is not silent, of whose bits at most the
    share ``most`` differs; every bin of a pair's offset histogram is tried, the best alignment is reported.
    """
    prints = checkpointed(prints)
    classes = prints.where("sig is not null").groupBy("sig").agg(F.min("media_id").alias("class_id"))
    member = checkpointed(prints.select("media_id", "sig", "reason").join(classes, "sig", "left").select("media_id", F.coalesce("class_id", "media_id").alias("class_id"), "reason"))
    wanted = member.join(asked.select("media_id").distinct(), "media_id", "left_semi").select("class_id").distinct()
    single = prints.where("sig is not null").select(F.col("media_id").alias("class_id"), "prints").join(member.where("media_id = class_id").select("class_id").distinct(), "class_id", "left_semi").dropDuplicates(["class_id"])
    single = checkpointed(single.join(wanted.withColumn("asked", F.lit(True)), "class_id", "left").select("class_id", F.coalesce("asked", F.lit(False)).alias("asked"), "prints"))
    keyed = lambda rows, asked, name: rows.select("class_id", F.lit(asked).alias("asked"), "prints").mapInArrow(trimmed(_keys), "key long, id long, at int").select("key", F.col("id").alias(name), F.col("at").alias(f"{name}_at"))
    q, m = keyed(single.where("asked"), True, "q"), keyed(single, False, "m")
    met = q.join(m, (q.key == m.key) & (F.col("q") != F.col("m"))).select("q", "m", (F.col("q_at") - F.col("m_at")).alias("offset"))
    bins = checkpointed(met.groupBy("q", "m", "offset").agg(F.count("*").alias("hits")))
    both = bins.join(single.where("asked").select(F.col("class_id").alias("q"), F.col("prints").alias("x")), "q").join(single.select(F.col("class_id").alias("m"), F.col("prints").alias("y")), "m").select("q", "m", "offset", "x", "y")
    found = both.mapInArrow(trimmed(_bit_errors(least, most)), "class_id long, match_id long, offset int, bit_error_rate double")
    return member, found.groupBy("class_id", "match_id").agg(F.min(F.struct("bit_error_rate", F.abs("offset").alias("far"), "offset")).alias("b")).select("class_id", "match_id", "b.offset", "b.bit_error_rate")


def search_recordings(media: DataFrame, every: int = 20, decode: Callable = decode_wav, id_col: str = "media_id", value_col: str = "audio") -> DataFrame:
    """Recordings whose id is divisible by ``every`` against all: one row for each recording (media_id, class_id, and
    the reason where it could not be decoded) and one more for each match of an asked class (media_id = class_id,
    match_id, offset, bit_error_rate)."""
    prints = fingerprints(media, decode, id_col, value_col)
    asked = media.select(F.col(id_col).cast("long").alias("media_id")).where(F.col("media_id") % every == 0)
    member, found = aligned_classes(prints, asked)
    return member.unionByName(found.select(F.col("class_id").alias("media_id"), "class_id", "match_id", "offset", "bit_error_rate"), allowMissingColumns=True).withColumnRenamed("media_id", id_col)
