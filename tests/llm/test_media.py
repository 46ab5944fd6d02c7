import hashlib
import zlib

import numpy as np

from factloom.llm import media as M

from .conftest import TEXTS


def test_round_trip():
    for n in (0, 1, 191, 192, 193, 5000):
        payload = M.pad(bytes(range(256)) * 20)[:n] if n else b""
        padded = M.pad(payload)
        assert len(padded) % 192 == 0 and len(padded) >= 192 and M.decode(M.encode(padded)) == padded


def brute_peaks(samples):
    frames = max(1, -(-(len(samples) - M.FRAME) // M.HOP) + 1)
    x = np.concatenate([samples, np.full((frames - 1) * M.HOP + M.FRAME - len(samples), 128, np.uint8)])
    out = []
    for f in range(frames):
        p = np.abs(np.fft.rfft(((x[f * M.HOP : f * M.HOP + M.FRAME].astype(np.float32) - 128) / 128) * np.hanning(M.FRAME).astype(np.float32)))
        tops = [b for b in range(2, M.FRAME // 2 - 1) if p[b] > p[b - 1] and p[b] >= p[b + 1]]
        best = max(tops, key=lambda b: p[b], default=None)
        if best is not None and p[best] > 1e-3:
            out.append((f, best))
    return out, frames


def test_peaks_match_brute_force(monkeypatch):
    samples = np.frombuffer(M.pad(("the cat sat on the mat " * 200).encode()), dtype=np.uint8)
    want, frames = brute_peaks(samples)
    for block in (4096, 3):
        monkeypatch.setattr(M, "BLOCK", block)
        got, n = M.peaks(samples)
        assert n == frames and got.tolist() == [list(x) for x in want]
    codes = M.pairs(got)
    assert len(codes) and (np.diff(codes) >= 0).all() and ((codes & 255) <= M.REACH).all()


def test_features(spark, docs, empty):
    got = M.features(docs).collect()
    assert len(got) == len(TEXTS)
    by = {}
    for r in got:
        data = M.pad((r.text or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((r.text or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert by.setdefault(r.text or "", (r.feature, r.media_sha256, r.media_bytes)) == (r.feature, r.media_sha256, r.media_bytes)
    assert M.features(empty).count() == 0
    r = M.with_media(docs.where("doc_id = 10")).first()
    assert M.decode(bytes(r.media)) == M.pad(r.text.encode()) and r.fingerprint == M.fingerprint(bytes(r.media))[0].tolist()


def test_clashing_names(spark):
    rows = spark.createDataFrame([("a", 1, b"own", "f", 5, "x")], "text string, doc_id int, media binary, Fingerprint string, n_bytes int, extra string")
    r = M.features(rows).first()
    assert (bytes(r.media), r.Fingerprint, r.n_bytes, r.extra, r.text) == (b"own", "f", 1, "x", "a")
    assert M.features(rows, with_text=False).columns[0] == "doc_id"
    r = M.with_media(rows).first()
    assert M.decode(bytes(r.media)) == M.pad(b"a") and r.n_bytes == 5


def brute_pairs(found):
    return sorted((f << 32) | (a << 20) | (b << 8) | (g - f) for i, (f, a) in enumerate(found) for g, b in found[i + 1 : i + 1 + M.FAN] if g - f <= M.REACH)


def test_query_matches_brute_force(spark, docs):
    """Every column of the query by plain Python, from the text to the pairs of peaks."""
    for r in M.features(docs, with_text=True).collect():
        payload = M.pad((r.text or "").encode())
        found, frames = brute_peaks(np.frombuffer(payload, dtype=np.uint8))
        want = brute_pairs(found)
        media = M.encode(payload)
        assert media[-len(payload) :] == payload and media[:4] == b"RIFF"
        assert (r.media_bytes, r.media_sha256, r.n_frames, r.n_pairs) == (len(media), hashlib.sha256(media).hexdigest(), frames, len(want))
        assert r.feature == hashlib.sha256(np.array(want, dtype="<i8").tobytes()).hexdigest()
