"""A ray solver's text input and binary arrivals, and the plug for running it.

The solver itself is optional: `run` takes any function of a row's input text, so tests and clusters without it use a table
of arrivals instead.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARRIVAL = "delay_s double, amplitude_real double, amplitude_imag double, source_angle_deg double, receiver_angle_deg double, top_bounces int, bottom_bounces int"
_HEAD, _RECORD = "fiii", "fffffii"  # frequency, sources, receivers, ranges; real, imaginary, delay, two angles, bounces


def parse(data: bytes, order: str) -> list[tuple] | None:
    """Arrivals of a binary file in one byte order ('<' or '>'); null if its head makes no sense in it. A cut file: those before the cut."""
    head, record, count = struct.Struct(order + _HEAD), struct.Struct(order + _RECORD), struct.Struct(order + "i")
    if len(data) < head.size:
        return None
    _, sources, receivers, ranges = head.unpack_from(data)
    if not (0 < sources <= 1000 and receivers > 0 and 0 < ranges <= 100_000):
        return None
    out, at = [], head.size
    for _ in range(sources * receivers * ranges):
        if at + count.size > len(data):
            break
        (n,) = count.unpack_from(data, at)
        at += count.size
        if not 0 < n <= 10_000:
            continue
        whole = min(n, (len(data) - at) // record.size)
        out += [(d, r, i, a, b, top, bottom) for r, i, d, a, b, top, bottom in record.iter_unpack(data[at : at + whole * record.size])]
        if whole < n:
            break
        at += n * record.size
    return out


def binary_arrivals(spark: SparkSession, folder: str, pattern: str = "*.arr") -> DataFrame:
    """path, the columns of ARRIVAL, error: a row an arrival; a file of neither byte order is one row with an error, one without arrivals none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", *[c.split()[0] for c in ARRIVAL.split(", ")], "error"]
        for b in batches:
            for path, data in zip(b["path"], b["content"], strict=True):
                found = parse(data, "<") or parse(data, ">")
                if found is None and parse(data, "<") is None:
                    rows = [(path, *[None] * 7, "not an arrivals file")]
                else:
                    rows = [(path, *r, None) for r in found or []]
                x = pd.DataFrame(rows, columns=names)
                yield x.astype({"top_bounces": "Int32", "bottom_bounces": "Int32"} | {c: float for c in names[1:6]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(run, f"path string, {ARRIVAL}, error string")


def derived(real: Column, imaginary: Column) -> Column:
    """struct linear, db (-400 for nothing), phase_rad of a complex amplitude."""
    size = F.hypot(real, imaginary)
    return F.struct(size.alias("linear"), F.when(size > 1e-20, 20 * F.log10(size)).otherwise(-400.0).alias("db"), F.atan2(imaginary, real).alias("phase_rad"))


def beams(range_km: Column, least: int = 1000, per_km: float = 100.0, most: int = 8000) -> Column:
    """Beams by range, within bounds."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(range_km * per_km))).cast("int")


def more_beams(n: Column, arrivals: Column, most: int = 8000) -> Column:
    """Beams of a second run where the first found no arrival; null where none is due."""
    return F.when((arrivals == 0) & (n < most), F.least(F.lit(most), F.greatest(F.lit(4000), n * 2)))


def trimmed_profile(depths, speeds, bottom: float) -> tuple[np.ndarray, np.ndarray]:
    """A sound speed profile of finite points at rising depths, cut at the bottom with the speed there interpolated."""
    z, c = np.asarray(depths, float), np.asarray(speeds, float)
    sound = np.isfinite(z) & np.isfinite(c)
    z, c = z[sound], c[sound]
    order = np.argsort(z, kind="stable")
    z, c = z[order], c[order]
    rising = np.concatenate(([True], z[1:] > np.maximum.accumulate(z)[:-1])) if len(z) else np.zeros(0, bool)
    z, c = z[rising], c[rising]
    if len(z) < 2 or not bottom > 0:
        raise ValueError("a profile has two rising depths or more, and a bottom")
    above = z < bottom
    return np.append(z[above], bottom), np.append(c[above], np.interp(bottom, z, c))


def input_text(title: str, frequency: float, depths, speeds, bottom: float, source: float, receiver: float, range_km: float, beam_count: int = 0, bottom_speed: float = 1520.0, bottom_density: float = 1.4, bottom_loss: float = 3.0, margin: float = 1.05) -> str:
    """The solver's input for one source, one receiver and one range, with arrivals as output."""
    if not all(np.isfinite(v) and v > 0 for v in (frequency, source, receiver, range_km)):
        raise ValueError("frequency, depths and range are finite and positive")
    if max(source, receiver) >= bottom:
        raise ValueError("source and receiver lie above the bottom")
    z, c = trimmed_profile(depths, speeds, bottom)
    e, margin = (lambda v: f"{v:.8E}"), max(1.01, margin)
    single = [line for v in (source, receiver, range_km) for line in ("1", f"{e(v)} /")]
    box = f"0.0  {max(bottom * margin, bottom + 1.0):.2f}  {max(range_km * margin, range_km + 0.1):.4f}"
    profile = [f"{e(a)}  {e(b)}  /" for a, b in zip(z, c, strict=True)]
    floor = f"{e(bottom)}  {e(bottom_speed)}  0.0  {e(bottom_density)}  {e(bottom_loss)}  0.0 /"
    return "\n".join([f"'{title}'", e(frequency), "1", "'CVF'", f"{len(z)}  {e(1.0)}  {e(bottom)}", *profile, "'A'  0.0", floor, *single, "'A'", str(int(beam_count)), "-90 90 /", box]) + "\n"


def run(df: DataFrame, key: str, text: str, solver: Callable[[str], bytes]) -> DataFrame:
    """key, the columns of ARRIVAL, error: arrivals of each row's input by a solver, a function from input text to binary arrivals.

    What a solver raises is that row's error; other rows go on. It runs where the rows are, so it spreads with the partitions.
    """
    kind = dict(df.dtypes)[key]
    names = [key, *[c.split()[0] for c in ARRIVAL.split(", ")], "error"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text], strict=True):
                try:
                    data = solver(t)
                    found = parse(data, "<") or parse(data, ">") or []
                    rows += [(k, *r, None) for r in found] or [(k, *[None] * 7, "no arrivals")]
                except (OSError, RuntimeError, ValueError) as e:
                    rows.append((k, *[None] * 7, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=names).astype({"top_bounces": "Int32", "bottom_bounces": "Int32"} | {c: float for c in names[1:6]})

    return df.select(key, text).mapInPandas(each, f"{key} {kind}, {ARRIVAL}, error string")
