"""Media columns: PCM WAV files as a binary column, their spectra and peak-pair fingerprints.

`encode` stores bytes losslessly as the 8-bit samples of a WAV file, `decode` reads them back with the
wave module. `fingerprint` takes short-time Fourier transforms in blocks, keeps the strongest local
spectral peak of each frame (one at most) and pairs it with those of the next frames; a pair is the two frequency bins and their
distance in frames, stored with its time as `time << 32 | f1 << 20 | f2 << 8 | distance`.

Defined results: null text is empty; a payload is padded with blanks to a positive multiple of 192
bytes, so the empty text is 192 blanks; equal texts have equal values; every row is treated alone, so
repeated rows and null ids are kept; input columns named like an output column are replaced;
other columns are kept.
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
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import materialize, ship, without

UNIT, RATE = 192, 8000
FRAME, HOP, FAN, REACH = 256, 128, 3, 64
#: Frames transformed at once.
BLOCK = 4096
FEATURES = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("n_frames", T.LongType()), T.StructField("n_pairs", T.LongType()), T.StructField("feature", T.StringType()),
])


def pad(data: bytes, unit: int = UNIT) -> bytes:
    return data + b" " * (max(unit, -(-len(data) // unit) * unit) - len(data))


def encode(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def decode(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not a mono file of 8-bit samples")
        return w.readframes(w.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def frames_of(samples: int) -> int:
    return max(1, -(-(samples - FRAME) // HOP) + 1)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, int]:
    """(frame, bin) of each frame's strongest local maximum, and the number of frames. Whole frames, the last one padded with silence."""
    frames = frames_of(len(samples))
    need = (frames - 1) * HOP + FRAME
    x = np.full(need, 128, dtype=np.uint8)
    x[: len(samples)] = samples
    view = np.lib.stride_tricks.as_strided(x, (frames, FRAME), (HOP, 1))
    out = []
    for lo in range(0, frames, BLOCK):
        part = (view[lo : lo + BLOCK].astype(np.float32) - 128) / 128
        power = np.abs(np.fft.rfft(part * _WINDOW, axis=1))[:, 1:-1].astype(np.float32)
        inner = np.where((power[:, 1:-1] > power[:, :-2]) & (power[:, 1:-1] >= power[:, 2:]), power[:, 1:-1], 0)
        best = inner.argmax(axis=1)
        strong = inner[np.arange(len(best)), best] > 1e-3
        out.append(np.stack([np.flatnonzero(strong) + lo, best[strong] + 2], axis=1))
    return np.concatenate(out).astype(np.int64), frames


def pairs(found: np.ndarray) -> np.ndarray:
    """Time-coded pairs of each peak with the FAN peaks after it within REACH frames, by time."""
    out = []
    for k in range(1, FAN + 1):
        a, b = found[:-k], found[k:]
        ok = b[:, 0] - a[:, 0] <= REACH
        out.append((a[ok, 0] << 32) | (a[ok, 1] << 20) | (b[ok, 1] << 8) | (b[ok, 0] - a[ok, 0]))
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def fingerprint(media: bytes) -> tuple[np.ndarray, int]:
    found, frames = peaks(np.frombuffer(decode(media), dtype=np.uint8))
    return pairs(found), frames


def _media(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), encode(pad(data))


@F.pandas_udf(T.BinaryType())
def to_media(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _media(t)[1])


@F.pandas_udf(T.ArrayType(T.LongType()))
def fingerprints(media: pd.Series) -> pd.Series:
    return media.map(lambda m: None if m is None else fingerprint(m)[0])


def _features(n: int, media: bytes, codes: np.ndarray) -> tuple:
    payload = decode(media)
    feature = hashlib.sha256(np.asarray(codes, dtype="<i8").tobytes()).hexdigest()
    samples = len(payload)
    return n, samples, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), frames_of(samples), len(codes), feature


@F.pandas_udf(FEATURES)
def media_features(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for n, media, codes in batches:
        yield pd.DataFrame([_features(*x) for x in zip(n, media, codes, strict=True)], columns=FEATURES.names)


def with_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the binary column `media` and its `fingerprint`, an array of time-coded pairs."""
    ship(docs.sparkSession)
    rows = without(docs, ["media", "fingerprint"])
    out = rows.withColumn("media", to_media(F.col(f"`{text_col}`").cast("string")))
    return out.withColumn("fingerprint", fingerprints("media"))


def features(docs: DataFrame, text_col: str = "text", with_text: bool = True) -> DataFrame:
    """docs with digests of the stored media and of its fingerprint, one column for each field of FEATURES.

    Media and fingerprints are written as a table in the shared folder and read back; with_text: the text column is carried.
    """
    rows = without(docs, [*FEATURES.names, "_m", "_n"])
    held = rows.withColumn("_n", F.octet_length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).cast("bigint"))
    kept = [c for c in held.columns if with_text or c != text_col]
    # columns of those names are put aside, the stored ones are the operator's
    aside = {c: f"_own_{c}" for c in kept if c.lower() in ("media", "fingerprint")}
    stored = materialize(with_media(held.withColumnsRenamed(aside), text_col).select(*[aside.get(c, c) for c in kept], "media", "fingerprint"), "media")
    out = stored.withColumn("_m", media_features("_n", "media", "fingerprint")).drop("media", "fingerprint").withColumnsRenamed({v: k for k, v in aside.items()})
    return out.select(*[F.col(f"`{c}`") for c in kept if c != "_n"], *[F.col(f"_m.{n}").alias(n) for n in FEATURES.names])
