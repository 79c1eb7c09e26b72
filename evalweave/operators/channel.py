"""Channels applied to recordings: geometry, arrivals to responses, convolution, level, status, and what is still to do.

A row is one recording with one channel, so rows spread freely and a lost task repeats its own rows only. Kernels are NumPy
over Arrow batches; geometry, status and pending rows are expressions and joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import signals

RESULT = "samples array<double>, gain_db double, scale_db double, status string, error string"


def uniform(key: Column, place: str, low: float, high: float, seed: int = 42) -> Column:
    """A number from low to high by hash of (seed, place, key): the same however the input is partitioned."""
    share = F.pmod(F.xxhash64(F.lit(seed), F.lit(place), key), F.lit(1 << 52)).cast("double") / float(1 << 52)
    return low + share * (high - low)


def jittered_geometry(key: Column, source: Column, receiver: Column, range_m: Column, bottom: Column, jitter: float = 0.1, ranges_km: tuple[float, float] = (10.0, 80.0), seed: int = 42) -> Column:
    """struct source_m, receiver_m, range_km: given values off by up to a share, missing ranges drawn; depths from 1 m to 1 m above the bottom.

    A missing depth is drawn between those limits. The range is 10 m or more. A missing bottom: null depths.
    """
    off = lambda c, place: c * (1 + uniform(key, place, -jitter, jitter, seed))
    low, high = F.lit(1.0), F.greatest(F.lit(1.0), bottom - 1.0)
    depth = lambda c, place: F.when(bottom.isNotNull(), F.least(high, F.greatest(low, F.coalesce(off(c, place), uniform(key, place + "+", 0.0, 1.0, seed) * (high - low) + low))))
    km = F.greatest(F.lit(0.01), F.coalesce(off(range_m, "range") / 1000, uniform(key, "range+", *ranges_km, seed=seed)))
    return F.struct(depth(source, "source").alias("source_m"), depth(receiver, "receiver").alias("receiver_m"), km.alias("range_km"))


def profile_for_depth(need: DataFrame, profiles: DataFrame, key: str, depth: str, seed: int = 42, tries: int = 50) -> DataFrame:
    """need with `profile` and `profile_depth`: a profile drawn for each row, again up to `tries` times until it is deep enough,
    else the deepest one. profiles: profile long, max_depth double; they are a library, numbered from 0 without gaps.

    A row's draws are its hashes, so the join is an equi-join on the profile's number: neither side is broadcast for its sake.
    Draws stop at the first that fits, which a row finds by aggregation over its own draws.
    """
    n = profiles.agg(F.count(F.lit(1)).alias("_n"), F.max_by("profile", F.struct("max_depth", -F.col("profile"))).alias("_deepest"), F.max("max_depth").alias("_deep"))
    k = F.col(key).cast("string")
    drawn = need.select(key, depth).crossJoin(F.broadcast(n))  # one row
    at = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda i: F.struct(i.alias("i"), F.pmod(F.xxhash64(F.lit(seed), k, i), F.col("_n")).alias("p")))
    each = drawn.select(key, depth, "_deepest", "_deep", F.explode(at).alias("d")).select(key, depth, "_deepest", "_deep", "d.i", F.col("d.p").alias("profile"))
    fits = each.join(profiles, "profile").groupBy(key).agg(F.min(F.when(F.col("max_depth") >= F.col(depth), F.struct("i", "profile", "max_depth"))).alias("f"), F.first("_deepest").alias("_deepest"), F.first("_deep").alias("_deep"))
    found = fits.select(key, F.coalesce("f.profile", "_deepest").alias("profile"), F.coalesce("f.max_depth", "_deep").alias("profile_depth"))
    return need.join(found, key, "left")


def level(wave: np.ndarray, peak: float) -> tuple[np.ndarray, float]:
    """The wave with the given peak, and the change in decibels to two places; silence is an error."""
    top = float(np.abs(wave).max()) if len(wave) else 0.0
    if not np.isfinite(top) or top <= 0 or not 0 < peak <= 1:
        raise signals.SignalError("the output is silent or not finite")
    return wave * (peak / top), round(20 * float(np.log10(peak / top)), 2)


def single(samples, rate: float, delays, amplitudes, peak: float = 0.95) -> tuple[list[float], float, float]:
    """Samples through the response of one frequency, the response's energy in decibels, and the change of level."""
    x = np.asarray(samples, float)
    response = signals.impulse_response(delays, amplitudes, rate, len(x) / rate, origin=float(np.min(delays)))
    out, scale = level(signals.convolve(x, response), peak)
    return out.tolist(), float(10 * np.log10(max(float((response**2).sum()), 1e-40))), scale


def broadband(samples, rate: float, frequencies, delays, amplitudes, peak: float = 0.95) -> tuple[list[float], float, float]:
    """As single, with a response for each solved frequency; all delays count from the first arrival of any. The gain is that of the RMS."""
    x = np.asarray(samples, float)
    if not len(frequencies) or min(frequencies) <= 0 or max(frequencies) > rate / 2:
        raise signals.SignalError("frequencies lie between 0 and half the rate")
    first = min(float(np.min(d)) for d in delays if len(d))
    responses = [signals.impulse_response(d, a, rate, len(x) / rate, origin=first) for d, a in zip(delays, amplitudes, strict=True)]
    wet = signals.convolve_by_frequency(x, frequencies, responses, rate)
    rms = [np.sqrt(max(1e-20, float((v**2).mean()))) for v in (x, wet)]
    out, scale = level(wet, peak)
    return out.tolist(), float(20 * np.log10(rms[1] / rms[0])), scale


def _each(df: DataFrame, key: str, columns: list[str], kernel) -> DataFrame:
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, *values in zip(b[key], *[b[c] for c in columns], strict=True):
                try:
                    got = kernel(*values)
                    rows.append((k, *got, "success", None) if got else (k, None, None, None, "no_arrivals", None))
                except (signals.SignalError, ValueError) as e:
                    rows.append((k, None, None, None, "failed", str(e)))
            yield pd.DataFrame(rows, columns=[key, *[c.split()[0] for c in RESULT.split(", ")]])

    return df.select(key, *columns).mapInPandas(run, f"{key} {kind}, {RESULT}")


def apply_single(df: DataFrame, key: str = "id", peak: float = 0.95) -> DataFrame:
    """df (key, samples, rate, delays, amplitudes) -> key and RESULT. No arrivals is a status, a silent or empty wave a failure with its reason."""

    def kernel(samples, rate, delays, amplitudes):
        if delays is None or not len(delays):
            return None
        if samples is None or not len(samples):
            raise signals.SignalError("no samples")
        return single(samples, rate, delays, amplitudes, peak)

    return _each(df, key, ["samples", "rate", "delays", "amplitudes"], kernel)


def apply_broadband(df: DataFrame, key: str = "id", peak: float = 0.95) -> DataFrame:
    """df (key, samples, rate, frequencies, delays, amplitudes: arrays by frequency) -> key and RESULT. A frequency without arrivals makes the row no_arrivals."""

    def kernel(samples, rate, frequencies, delays, amplitudes):
        if delays is None or not len(delays) or any(not len(d) for d in delays):
            return None
        if samples is None or not len(samples):
            raise signals.SignalError("no samples")
        return broadband(samples, rate, frequencies, delays, amplitudes, peak)

    return _each(df, key, ["samples", "rate", "frequencies", "delays", "amplitudes"], kernel)


def status_roll_up(df: DataFrame, key: str, status: str) -> DataFrame:
    """key, status, n over a recording's channels: skipped (all existing), success (all usable), partial, no_arrivals (all), failed."""
    usable = F.col(status).isin("success", "existing")
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(usable).alias("_u"), F.count_if(F.col(status) == "existing").alias("_e"), F.count_if(F.col(status) == "no_arrivals").alias("_a"))
    said = F.when(F.col("_e") == F.col("n"), "skipped").when(F.col("_u") == F.col("n"), "success").when(F.col("_u") > 0, "partial").when(F.col("_a") == F.col("n"), "no_arrivals").otherwise("failed")
    return g.select(key, said.alias("status"), "n")


def pending(wanted: DataFrame, done: DataFrame, key: str, version: str, tolerance: float = 0.01) -> DataFrame:
    """Rows of wanted (key, freq_hz, ...) without an output of this version at the same frequency in done (key, model_version, freq_hz)."""
    d = done.filter(F.col("model_version") == version).select(key, F.col("freq_hz").alias("_f")).filter("_f is not null")
    return wanted.join(d, (wanted[key] == d[key]) & (F.abs(wanted["freq_hz"] - d["_f"]) <= tolerance), "left_anti")
