"""Media columns: texts as WAV files, short-time spectra, and spectral-peak pair fingerprints.

``to_wav`` stores bytes losslessly as 8-bit mono samples of a WAV file, read again with the
``wave`` module.  ``landmarks`` takes Hann-windowed frames of FRAME samples every HOP samples,
keeps the strongest bin of each of BANDS frequency bands where it rises above the frame's mean,
and pairs each peak with all other peaks of its own and all of the following REACH frames.  A pair is coded as
(bin << 16 | later bin << 8 | frame distance), at most 15 + 36 * REACH a frame; its time code is the earlier frame's number, so
two recordings of the same sound agree in codes and differ in times by a constant.

Defined results: a null text is an empty one; an empty text gives one unit of padding; equal
payloads give equal files and fingerprints; texts of any length are processed whole, in blocks of
BLOCK frames.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import id_text, per_batch, raw_texts, table

UNIT = 192
RATE = 8000
FRAME, HOP, BANDS, REACH, BLOCK = 192, 96, 6, 3, 4096
#: Bytes of texts whose arrays are made before they leave the worker.
AT_ONCE = 1 << 18


def padded(data: bytes, unit: int = UNIT, fill: bytes = b" ") -> bytes:
    """``data`` with fill up to a positive multiple of ``unit`` bytes."""
    return data + fill * ((-len(data)) % unit or (0 if data else unit))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)
#: Within a frame, each two bands are a pair once.
_ONCE = np.triu(np.ones((BANDS, BANDS), bool), 1)
_EDGES = np.linspace(1, FRAME // 2 + 1, BANDS + 1).astype(int)


def peaks(samples: np.ndarray) -> np.ndarray:
    """(frames, bands): the strongest bin of each band, or -1 where it isn't above the frame's mean."""
    n = max(1, (len(samples) - FRAME) // HOP + 1)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    out = np.empty((n, BANDS), np.int16)
    for lo in range(0, n, BLOCK):
        x = (frames[lo : lo + BLOCK].astype(np.float32) - 128) * _WINDOW
        power = np.abs(np.fft.rfft(x, axis=1))[:, 1:]
        mean = power.mean(axis=1)
        for b in range(BANDS):
            band = power[:, _EDGES[b] - 1 : _EDGES[b + 1] - 1]
            top = band.argmax(axis=1)
            strong = band[np.arange(len(top)), top] > 1.2 * mean
            out[lo : lo + BLOCK, b] = np.where(strong, top + _EDGES[b], -1)
    return out


def landmarks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the peak pairs and the frames they start in, by time and then by code."""
    top = peaks(np.frombuffer(payload, np.uint8))
    found = []
    for lo in range(0, len(top), BLOCK):
        keys = []
        for gap in range(REACH + 1):
            b = top[lo + gap : lo + gap + BLOCK]
            a = top[lo : lo + len(b)]
            both = (a >= 0)[:, :, None] & (b >= 0)[:, None, :]
            t, i, j = np.nonzero(both if gap else both & _ONCE)
            keys.append((lo + t) << 24 | a[t, i].astype(np.int64) << 16 | b[t, j].astype(np.int64) << 8 | gap)
        found.append(np.sort(np.concatenate(keys)))
    key = np.concatenate(found)
    return (key & 0xFFFFFF).astype(np.int32), (key >> 24).astype(np.int32)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))


def _made(batch: pa.RecordBatch):
    """The columns of a batch's rows, some texts at a time, so that no set of arrays is much larger than AT_ONCE."""
    texts = [t or b"" for t in raw_texts(batch.column("text"))]
    part = np.cumsum([len(t) + UNIT for t in texts]) // AT_ONCE
    for lo, hi in zip(starts := np.flatnonzero(np.diff(part, prepend=-1)), [*starts[1:], len(texts)]):
        media = [to_wav(padded(t)) for t in texts[lo:hi]]
        codes, times = zip(*(landmarks(from_wav(m)) for m in media))
        yield {"doc_id": batch.column("doc_id").slice(lo, hi - lo), "n_bytes": [len(t) for t in texts[lo:hi]], "media": media, "codes": codes, "times": times}


def media_columns(df: DataFrame) -> DataFrame:
    """doc_id, text -> the length of the text in bytes, the WAV file, and its fingerprint as time-coded arrays."""

    def make(batch: pa.RecordBatch):
        for made in _made(batch):
            yield made | {c: _lists(made[c]) for c in ("codes", "times")}

    return per_batch(id_text(df), make, "doc_id long, n_bytes long, media binary, codes array<int>, times array<int>")


def feature_of(codes: np.ndarray, times: np.ndarray) -> str:
    """The number of peak pairs, of distinct codes, and a digest of codes and times."""
    return f"{len(codes)}-{len(np.unique(codes))}-{xxhash.xxh3_128_hexdigest(codes.tobytes() + times.tobytes())}"


def media_digests(df: DataFrame) -> DataFrame:
    """``media_columns`` with its files as digests: of the stored file, and of the payload read back from it.  The arrays stay."""

    def make(batch: pa.RecordBatch):
        for made in _made(batch):
            rows = []
            for wav, codes, times in zip(made["media"], made["codes"], made["times"]):
                back = from_wav(wav)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(wav), hashlib.sha256(wav).hexdigest(), feature_of(codes, times)))
            kept = {c: made[c] for c in ("doc_id", "n_bytes")} | {c: _lists(made[c]) for c in ("codes", "times")}
            yield kept | dict(zip(("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"), zip(*rows)))

    return per_batch(
        id_text(df),
        make,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codes array<int>, times array<int>",
    )


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
