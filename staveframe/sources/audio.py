"""Audio files as rows, and features of their frames.

Files are read by Spark's ``binaryFile`` source; decoding and spectra are NumPy on Arrow batches, a row for each file
or frame. Sample arrays never take part in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATE, FRAME, HOP_SECONDS = 22_050, 8_192, 0.25
SILENCE = 0.008
#: How files of each kind begin (hex), and at which byte.
SIGNATURES = {"wav": (0, "52494646"), "flac": (0, "664C6143"), "ogg": (0, "4F676753"), "mp3": (0, "494433"), "m4a": (4, "66747970"), "webm": (0, "1A45DFA3")}
MOST_BYTES = 150 * 1024 * 1024


def decode_wav(content: bytes, strict: bool = False) -> tuple[int, np.ndarray]:
    """Rate and mono samples of a PCM file of 8, 16, 24 or 32 bits or 32-bit floats; ``strict`` takes 16 bits only."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, form, data = 12, None, None
    while at + 8 <= len(content):
        kind, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        body = content[at + 8 : at + 8 + size]
        if kind == b"fmt ":
            form = (int.from_bytes(body[0:2], "little"), int.from_bytes(body[2:4], "little"), int.from_bytes(body[4:8], "little"), int.from_bytes(body[14:16], "little"))
        elif kind == b"data":
            data = body
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("format or data is missing")
    code, channels, rate, bits = form
    if strict and (code, bits) != (1, 16):
        raise ValueError("only 16-bit samples are taken")
    data = data[: len(data) // (channels * bits // 8) * (channels * bits // 8)]
    if code == 3 and bits == 32:
        x = np.frombuffer(data, "<f4").astype(np.float64)
    elif bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128) / 128
    elif bits == 16:
        x = np.frombuffer(data, "<i2") / 32768.0
    elif bits == 24:
        parts = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x / 8388608.0
    elif bits == 32:
        x = np.frombuffer(data, "<i4") / 2147483648.0
    else:
        raise ValueError(f"{bits} bits aren't supported")
    return rate, x.reshape(-1, channels).mean(axis=1)


def resample(x: np.ndarray, source: int, target: int, floor: bool = False) -> np.ndarray:
    """Straight-line interpolation; the length is rounded half up, or down with ``floor``."""
    if source == target or not len(x):
        return x
    n = len(x) * target / source
    n = int(np.floor(n)) if floor else int(np.floor(n + 0.5))
    return np.interp(np.arange(n) * source / target, np.arange(len(x)), x)


def read_wav(spark: SparkSession, path: str, rate: int = RATE, strict: bool = False) -> DataFrame:
    """``path, rate, samples array<float>, error`` of every WAV file under a path; a file that can't be read has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    own, x = decode_wav(bytes(content), strict)
                    out.append((name, rate, resample(x, own, rate).astype(np.float32), None))
                except (ValueError, IndexError, ZeroDivisionError) as e:
                    out.append((name, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "rate", "samples", "error"]).astype({"rate": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, rate int, samples array<float>, error string")


def valid_input(content: Column, extension: Column, length: Column) -> Column:
    """Whether a file begins as its extension says and isn't too large; unknown extensions pass."""
    fits = F.lit(True)
    for kind, (at, sign) in SIGNATURES.items():
        fits = F.when(F.lower(extension) == kind, F.hex(F.substring(content, at + 1, len(sign) // 2)) == sign).otherwise(fits)
    return fits & (length <= MOST_BYTES) & (length > 0)


def usage(spark: SparkSession, path: str) -> DataFrame:
    """``kind, files, bytes`` of the folder, by the first folder below it; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.regexp_extract(F.substring_index("path", path.rstrip("/") + "/", -1), "^([^/]+)/", 1)
    return files.select(kind.alias("kind"), "length").groupBy("kind").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def chroma_of(frame: np.ndarray, rate: int, low: float, high: float, bias: bool = False) -> np.ndarray:
    """Shares of the twelve pitch classes in the spectrum of a frame between two frequencies."""
    mags = np.abs(np.fft.rfft(frame * np.hanning(len(frame) + 1)[:-1]))
    hz = np.arange(len(mags)) * rate / len(frame)
    inside = (hz >= max(low, 1e-9)) & (hz <= high)
    hz, weight = hz[inside], np.sqrt(mags[inside])
    if bias:
        weight = weight * np.sqrt(low / np.maximum(low, hz))
    pitch = np.floor(69 + 12 * np.log2(hz / 440) + 0.5).astype(int) % 12
    out = np.bincount(pitch, weights=weight, minlength=12)
    return out / out.sum() if out.sum() > 0 else out


def pitch_of(frame: np.ndarray, rate: int) -> tuple[float, float] | None:
    """Frequency and confidence of a frame's pitch by the cumulative mean difference; None for a quiet or unclear one."""
    if np.sqrt(np.mean(frame**2)) < SILENCE:
        return None
    low, high = rate // 1200, min(rate // 70, len(frame) // 2)
    if high <= low:
        return None
    lags = np.arange(low, high + 1)
    d = np.array([np.sum((frame[: len(frame) - k] - frame[k:]) ** 2) for k in lags])
    running = np.cumsum(d)
    normal = np.divide(d * np.arange(1, len(d) + 1), running, out=np.ones(len(d)), where=running > 0)
    dips = np.flatnonzero((normal < 0.16) & (d <= np.r_[d[1:], 0.0]))
    k = int(dips[0]) if len(dips) else int(np.argmin(normal))
    return (rate / lags[k], float(np.clip(1 - normal[k], 0, 1))) if normal[k] <= 0.38 else None


def frames(tracks: DataFrame, key: str = "path") -> DataFrame:
    """``key, place, start, end, rms, chroma, root_chroma, frequency, pitch_confidence`` of every frame of tracks ``(key,
    rate, samples)``: ``FRAME`` samples each ``HOP_SECONDS``, the last filled up with zeros. Rows are made where the
    samples are, a bounded number of frames at a time."""
    schema = f"{key} {tracks.schema[key].dataType.simpleString()}, place long, start double, end double, rms double, chroma array<double>, root_chroma array<double>, frequency double, pitch_confidence double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, rate, samples in zip(batch[key], batch["rate"], batch["samples"], strict=True):
                if samples is None:
                    continue
                x, hop, rows = np.asarray(samples, dtype=np.float64), int(rate * HOP_SECONDS), []
                for place, at in enumerate(range(0, len(x), hop)):
                    f = x[at : at + FRAME]
                    f = np.pad(f, (0, FRAME - len(f)))
                    pitch = pitch_of(f[:2048], int(rate)) or (None, None)
                    rows.append((name, place, at / rate, min(len(x), at + hop) / rate, float(np.sqrt(np.mean(f**2))), chroma_of(f, rate, 70, 1400), chroma_of(f, rate, 42, 320, True), *pitch))
                    if len(rows) == 256:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"frequency": "float64", "pitch_confidence": "float64"})
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"frequency": "float64", "pitch_confidence": "float64"})

    return tracks.where(F.col("samples").isNotNull()).select(key, "rate", "samples").mapInPandas(run, schema)


def stem_mix(stems: list[tuple[Column, float]], peak: float = 0.98) -> Column:
    """Weighted mean of sample arrays, scaled down where it would pass the peak."""
    weight = sum(w for _, w in stems)
    mixed = None
    for column, w in stems:
        share = F.lit(w / weight)
        part = F.transform(column, lambda v: v.cast("double") * share)  # noqa: B023
        mixed = part if mixed is None else F.zip_with(mixed, part, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
    most = F.array_max(F.transform(mixed, F.abs))
    return F.when(most > peak, F.transform(mixed, lambda v: v * (F.lit(peak) / most))).otherwise(mixed)


def synthetic(spark: SparkSession, n: int, seed: int, seconds: float = 8.0, rate: int = RATE) -> DataFrame:
    """``track, chord, start, end, rate, samples``: ``n`` tracks of plain triads with known regions, for tests and trials."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k in batch["id"]:
                rng = np.random.default_rng(seed + int(k))
                roots, t = rng.integers(0, 12, size=4), np.arange(int(seconds / 4 * rate)) / rate
                x = np.concatenate([sum(np.sin(2 * np.pi * 440 * 2 ** ((48 + r + d - 69) / 12) * t) for d in (0, 4, 7)) / 4 for r in roots])
                edges = np.arange(5) * seconds / 4
                rows.append((int(k), roots.astype(int).tolist(), edges[:-1].tolist(), edges[1:].tolist(), rate, x.astype(np.float32)))
            yield pd.DataFrame(rows, columns=["track", "root", "start", "end", "rate", "samples"])

    return spark.range(n).mapInPandas(run, "track long, root array<int>, start array<double>, end array<double>, rate int, samples array<float>")
