"""What part of a recording or spectrum is shown, and how profiles and figures are prepared, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# The band around a carrier without a bandwidth, and the padding around a band.
LEAST_BAND_HZ, BAND_OF_CARRIER, PADDING, PADDING_BINS = 200.0, 0.1, 0.1, 3
# End of fixed values.


def centred_window(frames: Column, symbol_samples: Column, symbols: int) -> Column:
    """struct start, stop (half-open, in samples), shown (symbols), whole: a window of so many symbols in the middle of a
    recording; null where a symbol has no positive length.
    """
    asked = F.greatest(F.lit(1), F.bround(symbols * symbol_samples).cast("long"))
    length = F.least(frames.cast("long"), asked)
    start = F.floor((frames - length) / 2)
    own = F.struct(start.alias("start"), (start + length).alias("stop"), (length / symbol_samples).alias("shown"), (length == frames).alias("whole"))
    return F.when((symbol_samples > 0) & (frames > 0), own)


def multicarrier_symbol(carriers: Column, bandwidth: Column, prefix: Column, rate: Column) -> Column:
    """Samples of a symbol with a cyclic prefix (a share of it)."""
    return F.when((carriers > 0) & (bandwidth > 0) & (prefix >= 0), (1 + prefix) * carriers / bandwidth * rate)


def display_band(centre: Column, low: Column, high: Column, width: Column, rate: Column, bin_hz: Column) -> Column:
    """struct low, high (the source's band), padding, from, to (what is shown, inside 0 and half the rate), clipped, origin.

    The band is low to high if both are given, else the width around the centre, else a tenth of the centre, 200 Hz at least.
    Null where the band is empty or lies outside what the rate can show.
    """
    given = low.isNotNull() & high.isNotNull()
    half = F.coalesce(width, F.greatest(F.lit(LEAST_BAND_HZ), centre * BAND_OF_CARRIER)) / 2
    a, b = F.when(given, low).otherwise(centre - half), F.when(given, high).otherwise(centre + half)
    pad = F.greatest((b - a) * PADDING, bin_hz * PADDING_BINS)
    left, right = F.greatest(F.lit(0.0), a - pad), F.least(rate / 2, b + pad)
    origin = F.when(given, "band").when(width.isNotNull(), "centre and width").otherwise("centre")
    own = F.struct(a.alias("low"), b.alias("high"), pad.alias("padding"), left.alias("from"), right.alias("to"), ((left != a - pad) | (right != b + pad)).alias("clipped"), origin.alias("origin"))
    return F.when((a < b) & (left < right), own)


def clean_profile(depth: Column, speed: Column) -> Column:
    """array<struct<z, c>>: the points whose depth and speed are finite, by depth; of equal depths the one that came first."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    points = F.zip_with(depth, speed, lambda z, c: F.struct(z.cast("double").alias("z"), c.cast("double").alias("c")))
    numbered = F.transform(F.filter(points, lambda p: finite(p["z"]) & finite(p["c"])), lambda p, i: F.struct(p["z"].alias("z"), i.alias("i"), p["c"].alias("c")))
    ordered = F.array_sort(numbered)
    # an element of the sorted points stays if the one before it lies higher
    kept = F.filter(ordered, lambda p, i: (i == 0) | (p["z"] > F.get(ordered, i - 1)["z"]))
    return F.transform(kept, lambda p: F.struct(p["z"].alias("z"), p["c"].alias("c")))


def profile_fault(points: Column) -> Column:
    """What is wrong with a clean profile: fewer than two depths, or a speed that isn't positive; null if nothing."""
    return F.when(F.size(points) < 2, "fewer than two depths").when(F.exists(points, lambda p: p["c"] <= 0), "speed")


def is_close(a: Column, b: Column, relative: float = 0.0, absolute: float = 0.0) -> Column:
    """Whether two numbers differ by no more than the larger of both tolerances; false for NaN, true for equal infinities."""
    a, b = a.cast("double"), b.cast("double")
    near = F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b)))
    number = ~F.isnan(a) & ~F.isnan(b)
    return number & ((a == b) | (near & (F.abs(a) != float("inf")) & (F.abs(b) != float("inf"))))


def identity_seed(parts: Column) -> Column:
    """A seed of an array of strings: eight bytes of BLAKE2b over them, parted by NUL, little-endian; below 0 stands for 2 ** 64 more."""

    @F.pandas_udf(LongType())
    def seed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from hashlib import blake2b

        for own in batches:
            yield pd.Series([None if p is None else int.from_bytes(blake2b("\0".join("" if x is None else x for x in p).encode(), digest_size=8).digest(), "little", signed=True) for p in own], dtype="Int64")

    return seed(parts)
