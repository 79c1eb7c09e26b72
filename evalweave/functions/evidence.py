"""Phrases that describe a signal from its metadata, and dialogues made of them, as column expressions.

Where the wording varies, a hash of (seed, key, place) picks the variant: the same row has the same words however the
input is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.operators.labels import LEAVES, field, let, number

# Phrases by class, by direction of a sweep, by band, density, harmonics and modulation.
PRECISE = {
    "CW": ["stable single-frequency tone", "unchanging frequency", "narrowband structure"],
    "LFM": ["linear frequency modulation", "straight time-frequency trajectory"],
    "HFM": ["hyperbolic frequency modulation", "curved time-frequency trajectory"],
    "2FSK": ["binary frequency-shift keying", "two discrete frequency states", "symbol-wise frequency switching"],
    "4FSK": ["quaternary frequency-shift keying", "four discrete frequency states", "symbol-wise frequency switching"],
    "BPSK": ["binary phase-shift keying", "two phase states", "approximately 180-degree phase transitions"],
    "QPSK": ["quadrature phase-shift keying", "four phase states", "symbol-wise phase-state transitions"],
    "OFDM": ["orthogonal frequency-division multiplexing", "simultaneous multicarrier structure", "regularly spaced subcarriers"],
}
SWEEPS = {
    "up": {"LFM": ["linear upsweep", "frequency increases linearly with time"], "HFM": ["nonlinear upsweep", "frequency increases nonlinearly with time"]},
    "down": {"LFM": ["linear downsweep", "frequency decreases linearly with time"], "HFM": ["nonlinear downsweep", "frequency decreases nonlinearly with time"]},
    "none": {"LFM": ["linear sweep", "linear chirp"], "HFM": ["nonlinear sweep", "hyperbolic chirp"]},
}
UP, DOWN = ["upsweep", "up", "ascending"], ["downsweep", "down", "descending"]
BANDS = ["broadband-plus-tonal vessel noise", "tonal components concentrated in the low-frequency band", "tonal components spread across the low-to-mid-frequency band", "tonal components spanning a broad frequency range"]
DENSITY = ["discrete machinery tonal components", "sparse discrete tonal structure", "moderate-density discrete tonal structure", "dense discrete tonal structure"]
HARMONICS = ["shaft- and blade-rate-related harmonic lines", "shaft-rate-related harmonic lines", "blade-rate-related harmonic lines", "mechanical tonal components without a dominant harmonic family", "periodic propeller-related modulation"]
MODULATION = ["weak periodic amplitude modulation", "moderate periodic amplitude modulation", "strong periodic amplitude modulation", "periodic propeller-related modulation"]
# End of fixed values.
_PARAMS = "sweep_direction string, lines array<struct<frequency_hz:string,source_type:string>>, line_frequency_range_hz array<string>, num_lines string, shaft_mod_coeff string, blade_mod_coeff string"


def pick(variants: list[Column], key: Column, place: str, seed: int = 42) -> Column:
    """One of the variants by hash."""
    at = F.pmod(F.xxhash64(F.lit(seed), F.lit(place), key), F.lit(len(variants)))
    return F.get(F.array(*variants), at.cast("int"))


def _sweep(p: Column, leaf: str, key: Column, seed: int) -> Column:
    way = F.lower(F.trim(p["sweep_direction"]))
    said = {name: pick([F.lit(x) for x in words[leaf]], key, "sweep", seed) for name, words in SWEEPS.items()}
    return F.when(way.isin(UP), said["up"]).when(way.isin(DOWN), said["down"]).otherwise(said["none"])


def _ship(p: Column, key: Column, seed: int) -> Column:
    lines = F.coalesce(p["lines"], F.array().cast("array<struct<frequency_hz:string,source_type:string>>"))
    own = F.filter(F.transform(lines, lambda x: number(x["frequency_hz"])), lambda v: v.isNotNull())
    given = lambda i: number(F.get(p["line_frequency_range_hz"], F.lit(i)))
    ends = let(own, lambda o: F.when(F.size(o) > 0, F.struct(F.array_min(o).alias("low"), F.array_max(o).alias("high"))).otherwise(F.struct(given(0).alias("low"), given(1).alias("high"))))
    band = let(ends, lambda e: F.when(e["high"].isNull(), BANDS[0]).when(e["high"] <= 250, BANDS[1]).when((e["low"].isNull() | (e["low"] < 250)) & (e["high"] <= 1200), BANDS[2]).otherwise(BANDS[3]))
    count = let(number(p["num_lines"]), lambda n: F.when(n >= 0, F.floor(n)).when(n.isNotNull() | (F.size(lines) > 0), F.size(lines)))
    density = let(count, lambda n: F.when(n.isNull(), DENSITY[0]).when(n <= 4, DENSITY[1]).when(n <= 7, DENSITY[2]).otherwise(DENSITY[3]))
    kinds = F.transform(lines, lambda x: F.lower(F.trim(F.coalesce(x["source_type"], F.lit("")))))
    shaft, blade = (lambda k: F.array_contains(k, "shaft_harmonic")), (lambda k: F.array_contains(k, "blade_harmonic"))
    harmonic = let(kinds, lambda k: F.when(shaft(k) & blade(k), HARMONICS[0]).when(shaft(k), HARMONICS[1]).when(blade(k), HARMONICS[2]).when(F.size(k) > 0, HARMONICS[3]).otherwise(HARMONICS[4]))
    depth = F.greatest(number(p["shaft_mod_coeff"]), number(p["blade_mod_coeff"]))
    modulation = let(depth, lambda d: F.when(d <= 0.09, MODULATION[0]).when(d <= 0.14, MODULATION[1]).when(d.isNotNull(), MODULATION[2]).otherwise(MODULATION[3]))
    drive = let(F.struct(harmonic.alias("h"), modulation.alias("m")), lambda x: pick([F.concat(x["h"], F.lit(" with "), x["m"]), F.concat(x["m"], F.lit(" associated with "), x["h"])], key, "drive", seed))
    return F.array(band, density, drive)


def evidence(leaf: Column, meta: Column, key: Column, seed: int = 42) -> Column:
    """array<string> of phrases for a leaf's key; null for another label. The metadata is parsed once a row."""

    def said(p: Column) -> Column:
        out = F.when(leaf.isin([k for k, parents in LEAVES.items() if parents[0] == "passive"]), _ship(p, key, seed))
        for name, words in PRECISE.items():
            own = [F.lit(w) for w in words]
            out = out.when(leaf == name, F.array(*own, *([_sweep(p, name, key, seed)] if name in SWEEPS["none"] else [])))
        return out

    return let(F.from_json(field(meta, "signal_params"), _PARAMS), said)


def source_letter(l1: Column) -> Column:
    """A for a transmitted signal, B for radiated noise, null else."""
    low = F.lower(F.trim(l1))
    return F.when(low.isin("active", "actively transmitted", "deliberately transmitted"), "A").when(low.isin("passive", "source-radiated", "source-radiated noise"), "B")


def leaf_letter(leaf: Column) -> Column:
    """The option of a leaf among those of its family, from A on."""
    out = F.lit(None).cast("string")
    for side in ("active", "passive"):
        for i, k in enumerate(k for k, p in LEAVES.items() if p[0] == side):
            out = F.when(leaf == k, chr(ord("A") + i)).otherwise(out)
    return out


def dialogue(df: DataFrame, key: str, l1: str, leaf: str, meta: str, questions: list[list[str]], sentences: list[str], seed: int = 42) -> DataFrame:
    """df with `conversations`, array<struct<from, value>>: three questions and their answers.

    questions are the wordings of each turn, {L1} in them stands for the first label; sentences are wordings of the
    reasoning, {L1} and {L3} in them for the label and the evidence. Rows whose labels have no letter are passed over.
    """
    k = F.col(key).cast("string")
    fill = lambda c, what, by: F.replace(c, F.lit(what), by)
    asked = [fill(pick([F.lit(q) for q in own], k, f"q{i}", seed), "{L1}", F.col(l1)) for i, own in enumerate(questions)]
    why = fill(fill(pick([F.lit(s) for s in sentences], k, "why", seed), "{L1}", F.col(l1)), "{L3}", F.array_join(evidence(F.col(leaf), F.col(meta), k, seed), ", "))
    said = [source_letter(F.col(l1)), leaf_letter(F.col(leaf)), why]
    turns = [F.struct(F.lit(who).alias("from"), what.alias("value")) for q, a in zip(asked, said, strict=True) for who, what in (("human", q), ("gpt", a))]
    return df.filter(said[0].isNotNull() & said[1].isNotNull()).withColumn("conversations", F.array(*turns))
