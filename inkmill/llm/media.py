"""Media columns: texts as 8-bit WAV files with spectral-peak fingerprints.

``to_wav`` stores a payload losslessly as unsigned 8-bit mono samples with the
standard library's ``wave`` module; ``fingerprint`` reads samples, takes a
short-time Fourier transform, finds the peaks (local maxima over time and
frequency), keeps the strongest of each band per frame and pairs each with the
others of its own and of the next frames. A pair is one 32-bit code (first peak's bin, second peak's bin, time difference)
with the frame number of its first peak: two arrays of one length, ordered by
time and code. Frames overlap by half, over samples padded by half a frame of
silence at both ends: the window is 0 at the ends of a frame, and there another
frame has its middle. Silence has no peaks, so it has no pairs.

Defined results: null and empty texts have a payload of 64 zero bytes and
``n_bytes`` 0. Equal texts give equal rows. Very long texts are transformed in
blocks of frames, so memory is bounded by the block and by the text itself.
Repeated rows are kept; other columns of the input are dropped.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from inkmill.llm.common import load, trimmed

PAYLOAD_UNIT = 64
SAMPLE_RATE = 8000
FRAME = 128
HOP = FRAME // 2
#: FFT bins at which the four bands begin and the last one ends.
BANDS = (1, 6, 14, 30, 64)
FAN_OUT = 3
#: Magnitudes up to this are silence.
FLOOR = 1.0
BLOCK_FRAMES = 4096
#: Texts are taken together up to about this many characters.
BLOCK_CHARS = 1 << 17

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fp_time array<int>, fp_code array<int>"


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    total = max(1, -(-len(raw) // PAYLOAD_UNIT)) * PAYLOAD_UNIT
    return raw.ljust(total, b"\0"), len(raw)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(SAMPLE_RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def peak_bins(padded: np.ndarray) -> np.ndarray:
    """Frames x bands: the FFT bin of each band's strongest peak, -1 where it has none.

    A peak is a bin above ``FLOOR`` that is larger than the next bins of its frame
    and not smaller than itself in the frames before and after.
    """
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    n, bins = len(frames), FRAME // 2 + 1
    peaks = np.empty((n, len(BANDS) - 1), np.int32)
    for at in range(0, n, BLOCK_FRAMES):
        lo, hi = max(0, at - 1), min(n, at + BLOCK_FRAMES + 1)  # a frame more on either side
        power = np.zeros((hi - lo + 2, bins + 2), np.float32)  # and silence around the first and last
        power[1:-1, 1:-1] = np.abs(np.fft.rfft((frames[lo:hi].astype(np.float32) - np.float32(128)) * _WINDOW, axis=1))
        own = power[1:-1, 1:-1]
        top = (own > FLOOR) & (own > power[1:-1, :-2]) & (own > power[1:-1, 2:]) & (own >= power[:-2, 1:-1]) & (own >= power[2:, 1:-1])
        strong = (own * top)[at - lo : at - lo + BLOCK_FRAMES]
        for b in range(len(BANDS) - 1):
            band = strong[:, BANDS[b] : BANDS[b + 1]]
            best = band.argmax(axis=1)
            peaks[at : at + len(band), b] = np.where(band[np.arange(len(band)), best] > 0, BANDS[b] + best, -1)
    return peaks


def fingerprints(sounds: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each sound its time-coded pairs: frame of the first peak, and code f1 << 16 | f2 << 8 | dt.

    Each peak is paired with those of its own frame in higher bands and with all
    of the ``FAN_OUT`` frames that follow. Frame k of a sound is centred on its
    sample k * HOP. The sounds are laid out one after the other, a frame of
    silence between them, so that what one gives doesn't depend on the others.
    """
    n = np.array([-(-len(x) // HOP) + 1 for x in sounds])
    start = np.cumsum(n + 1) - (n + 1)
    padded = np.full((int((n + 1).sum()) + 1) * HOP, 128, np.uint8)
    for x, k in zip(sounds, start.tolist()):
        padded[(k + 1) * HOP : (k + 1) * HOP + len(x)] = x
    peaks = peak_bins(padded)
    owner = np.repeat(np.arange(len(sounds)), n + 1)
    bands = peaks.shape[1]
    times, codes = [], []
    for dt in range(min(FAN_OUT + 1, len(peaks))):
        first, second = peaks[: len(peaks) - dt, :, None], peaks[dt:, None, :]
        both = (first >= 0) & (second >= 0) & (owner[: len(peaks) - dt] == owner[dt:])[:, None, None]
        if dt == 0:
            both &= np.triu(np.ones((bands, bands), bool), 1)
        t, i, j = np.nonzero(both)
        times.append(t)
        codes.append((peaks[t, i] << 16) | (peaks[t + dt, j] << 8) | dt)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    t, c = t[order], c[order]
    cut = np.searchsorted(t, start[1:])
    return [(a - k, b) for a, b, k in zip(np.split(t.astype(np.int32), cut), np.split(c, cut), start.tolist())]


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return fingerprints([samples])[0]


def describe(texts: list[str | None]) -> list[tuple]:
    """The columns of ``SCHEMA`` after the first, for each text."""
    rows, sounds = [], []
    for text in texts:
        payload, n_bytes = payload_of(text)
        media = to_wav(payload)
        stored = from_wav(media)
        sounds.append(np.frombuffer(stored, np.uint8))
        rows.append((n_bytes, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-PAYLOAD_UNIT:]), len(media), hashlib.sha256(media).hexdigest()))
    out = []
    for row, (t, c) in zip(rows, fingerprints(sounds)):
        feature = f"{len(t)}:{zlib.crc32(t.astype('<i4').tobytes()):08x}:{zlib.crc32(c.astype('<i4').tobytes()):08x}"
        out.append((*row, feature, t, c))
    return out


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SCHEMA.split(", ")][1:]
    for batch in batches:
        texts = [x if isinstance(x, str) else None for x in batch["text"]]
        ends = np.cumsum([len(x or "") for x in texts]) // BLOCK_CHARS
        for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1) if texts else ():
            out = pd.DataFrame(describe([texts[k] for k in part]), columns=names)
            out.insert(0, "doc_id", batch["doc_id"].take(part).array)
            yield out


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per document: digests of the stored form and its fingerprint arrays."""
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInPandas(trimmed(_rows), SCHEMA)


def media_files(docs: DataFrame) -> DataFrame:
    """The stored files themselves: doc_id and the WAV bytes."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "wav": [to_wav(payload_of(x if isinstance(x, str) else None)[0]) for x in batch["text"]]})

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInPandas(build, "doc_id long, wav binary")


def op8_media_columns(spark, sf_dir):
    return media_columns(load(spark, sf_dir, "documents"))
