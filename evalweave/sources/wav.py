"""PCM WAV files as rows: headers, samples, and the sink's bytes."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """Rate, channels, bytes of a sample, samples [frame, channel] from -1 to 1."""
    with wave.open(io.BytesIO(data)) as w:
        rate, channels, width, n = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()
        raw = np.frombuffer(w.readframes(n), np.uint8)
    if not n or not rate:
        raise ValueError("no frames")
    if width == 1:
        x = (raw.astype(float) - 128) / 128
    else:
        wide = np.zeros((len(raw) // width, 4), np.uint8)
        wide[:, 4 - width :] = raw.reshape(-1, width)
        x = wide.reshape(-1).view("<i4") / 2.0**31
    return rate, channels, width, x.reshape(-1, channels)


def encode(samples, rate: int, bits: int = 32) -> bytes:
    """One channel of 16 or 32 bits, clipped to -1 and 1; samples that aren't finite are refused."""
    x = np.asarray(samples, float)
    if bits not in (16, 32) or not np.isfinite(x).all():
        raise ValueError("16 or 32 bits of finite samples")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(bits // 8)
        w.setframerate(rate)
        w.writeframes(np.rint(np.clip(x, -1, 1) * (2 ** (bits - 1) - 1)).astype(f"<i{bits // 8}").tobytes())
    return out.getvalue()


def scan(spark: SparkSession, folder: str, samples: bool = True) -> DataFrame:
    """path, rate, channels, width, frames, seconds, sha256, samples (of the first channel), error: a row a file.

    A file that isn't PCM WAV, or holds only zeros, has an error in place of samples. Spark's reader passes over files of no bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, sha, data in zip(b["path"], b["sha256"], b["content"], strict=True):
                try:
                    rate, channels, width, x = decode(data)
                    silent = not x[:, 0].any()
                    rows.append((path, rate, channels, width, len(x), len(x) / rate, sha, x[:, 0].tolist() if samples and not silent else None, "silent" if silent else None))
                except (wave.Error, EOFError, ValueError) as e:
                    rows.append((path, None, None, None, None, None, sha, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "width", "frames", "seconds", "sha256", "samples", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"), "content").mapInPandas(run, "path string, rate long, channels long, width long, frames long, seconds double, sha256 string, samples array<double>, error string")


def audit_faults(found: DataFrame, records: DataFrame, key: str = "path") -> DataFrame:
    """key, fault of records (key, rate, frames, seconds) against the files that were scanned: not one channel, another header, another length."""
    f = found.select(key, F.col("channels").alias("_channels"), F.col("rate").alias("_rate"), F.col("frames").alias("_frames"), F.col("error").alias("_error"), F.lit(True).alias("_there"))
    fault = (
        F.when(F.col("_there").isNull(), "no file")
        .when(F.col("_error").isNotNull(), F.col("_error"))
        .when(F.col("_channels") != 1, "channels")
        .when(~(F.col("rate").eqNullSafe(F.col("_rate")) & F.col("frames").eqNullSafe(F.col("_frames"))), "header")
        .when(~F.coalesce(F.abs(F.col("seconds") - F.col("_frames") / F.col("_rate")) <= 1e-10, F.lit(False)), "seconds")
    )
    return records.join(f, key, "left").select(key, fault.alias("fault")).filter("fault is not null")
