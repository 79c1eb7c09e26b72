"""Labels, numbers and derived fields of nested metadata (JSON text), as column expressions.

Metadata is a JSON string: fields that are missing, null or of another kind are null, whatever else the object holds. None of
these functions shuffles or leaves generated code; a scan with a narrow schema stays narrow.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leaf classes in order with their parents, the classes' names, and other spellings.
LEAVES = {
    "CW": ("active", "pulse"),
    "LFM": ("active", "pulse"),
    "HFM": ("active", "pulse"),
    "2FSK": ("active", "communication"),
    "4FSK": ("active", "communication"),
    "BPSK": ("active", "communication"),
    "QPSK": ("active", "communication"),
    "OFDM": ("active", "communication"),
    "cargo": ("passive", "ship_noise"),
    "cruise": ("passive", "ship_noise"),
    "fishing": ("passive", "ship_noise"),
    "warship": ("passive", "ship_noise"),
    "underwater_target": ("passive", "ship_noise"),
}
LEAF_NAMES = {
    "CW": "CW (Continuous Wave)",
    "LFM": "LFM (Linear Frequency Modulation)",
    "HFM": "HFM (Hyperbolic Frequency Modulation)",
    "2FSK": "2FSK (Binary Frequency Shift Keying)",
    "4FSK": "4FSK (Quaternary Frequency Shift Keying)",
    "BPSK": "BPSK (Binary Phase Shift Keying)",
    "QPSK": "QPSK (Quadrature Phase Shift Keying)",
    "OFDM": "OFDM (Orthogonal Frequency Division Multiplexing)",
    "cargo": "Cargo vessel",
    "cruise": "Cruise ship",
    "fishing": "Fishing vessel",
    "warship": "Naval vessel",
    "underwater_target": "Underwater vehicle",
}
SHORT_NAMES = {"cargo_ship": "cargo", "cruise_ship": "cruise", "fishing_boat": "fishing"}
RECORD_NAMES = {"cargo_ship": "cargo", "cruise_ship": "cruise", "fishing_boat": "fishing", "naval_vessel": "warship", "underwater target": "underwater_target"}
SAVED_NAMES = {
    "cargo vessel": "cargo",
    "cargo ship": "cargo",
    "货船": "cargo",
    "cruise ship": "cruise",
    "邮轮": "cruise",
    "fishing vessel": "fishing",
    "fishing boat": "fishing",
    "渔船": "fishing",
    "naval vessel": "warship",
    "军舰": "warship",
    "underwater vehicle": "underwater_target",
    "underwater target": "underwater_target",
    "水下目标": "underwater_target",
    "水下航行器": "underwater_target",
    "unresolved": "unknown",
}
# End of fixed values.
ACTIVE = [k for k, p in LEAVES.items() if p[0] == "active"]


def mapped(c: Column, names: dict[str, str], otherwise: Column | None = None) -> Column:
    """c's entry in a small table; otherwise c itself, or the column given."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c if otherwise is None else otherwise)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def field(meta: Column, path: str) -> Column:
    return F.get_json_object(meta, f"$.{path}")


def number(c: Column, sign: str = "any") -> Column:
    """A finite double of a JSON number or numeric text; sign 'positive' or 'nonnegative' refuses others. Booleans: null."""
    v = F.when(F.trim(c).rlike(r"^[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?$"), F.trim(c).try_cast("double"))
    ok = F.abs(v) < float("inf")
    if sign == "positive":
        ok = ok & (v > 0)
    elif sign == "nonnegative":
        ok = ok & (v >= 0)
    return F.when(ok, v)


def validity(c: Column, positive: bool = False) -> Column:
    """missing, not_numeric, nonfinite, nonpositive (if asked) or valid."""
    odd = F.lower(F.trim(c)).rlike(r"^[-+]?(nan|inf|infinity)$")
    huge = c.rlike(r"\d") & F.trim(c).try_cast("double").isin(float("inf"), float("-inf"))
    out = F.when(c.isNull(), "missing").when(odd | F.coalesce(huge, F.lit(False)), "nonfinite").when(number(c).isNull(), "not_numeric")
    return (out.when(number(c) <= 0, "nonpositive") if positive else out).otherwise("valid")


def finite_or_null(c: Column) -> Column:
    """A double that JSON can hold."""
    return F.when(F.abs(c) < float("inf"), c)


def leaf(c: Column) -> Column:
    """A leaf's key from a record's spelling: trimmed, aliases, active codes in upper case. Null: empty."""
    low = mapped(F.lower(F.trim(F.coalesce(c, F.lit("")))), RECORD_NAMES)
    return F.when(F.upper(low).isin(ACTIVE), F.upper(low)).otherwise(low)


def _filled(meta: Column, *paths: str) -> Column:
    return F.coalesce(*[F.nullif(field(meta, p), F.lit("")) for p in paths])


def display_labels(meta: Column) -> Column:
    """struct l1, l2, l3, l3_display in the words of questions; the leaf is the sub-type or the type."""
    category, own = field(meta, "signal_category"), F.coalesce(_filled(meta, "sub_type"), field(meta, "signal_type"), F.lit("unknown"))
    l1 = F.when(category.isin("pulse", "communication"), "actively transmitted").when(category == "radiated_noise", "source-radiated").otherwise("unknown")
    l2 = F.when(category == "pulse", "detection pulse").when(category == "communication", "communication signal").when(category == "radiated_noise", "ship-radiated noise").otherwise("unknown")
    return F.struct(l1.alias("l1"), l2.alias("l2"), own.alias("l3"), mapped(own, LEAF_NAMES).alias("l3_display"))


def key_labels(meta: Column, short_ships: bool = False) -> Column:
    """struct l1, l2, l3 as keys. With short_ships a passive leaf counts only under its short name, else it is unknown."""
    category = field(meta, "signal_category")
    active, passive = category.isin("pulse", "communication"), category == "radiated_noise"
    raw = F.lower(F.trim(F.coalesce(_filled(meta, "sub_type", "signal_type"), field(meta, "signal_params.original_class_name"), F.lit("unknown"))))
    ship = F.when(raw.isin([k for k, p in LEAVES.items() if p[0] == "passive"]), raw).otherwise("unknown") if short_ships else mapped(raw, SHORT_NAMES)
    l1 = F.when(active, "active").when(passive, "passive").otherwise("unknown")
    l2 = F.when(active, category).when(passive, "ship_noise").otherwise("unknown")
    l3 = F.when(active, F.upper(mapped(raw, SHORT_NAMES))).when(passive, ship).otherwise("unknown")
    return F.struct(l1.alias("l1"), l2.alias("l2"), l3.alias("l3"))


def saved_label(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """A leaf's key, unknown or cascade_error from a saved label: alias, key, name in either language, or a code in front.

    Null where nothing matches: a caller that must not lose labels asserts that none is null.
    """
    own = mapped(c, aliases) if aliases else c
    low = F.lower(F.trim(own))
    code = reduce(lambda out, k: F.coalesce(out, F.when(own.rlike(rf"(?i)^{k}(?=$|[\s(（]|[\x{{4e00}}-\x{{9fff}}])"), k)), ACTIVE, F.lit(None).cast("string"))
    return F.coalesce(F.when(own.isin([*LEAVES, "unknown", "cascade_error"]), own), mapped(low, SAVED_NAMES, F.lit(None).cast("string")), code)


def path_agrees(l1: Column, l2: Column, l3: Column) -> Column:
    """Whether the three labels are a path of the taxonomy; false for nulls."""
    return F.coalesce(mapped(l3, {k: "/".join(p) for k, p in LEAVES.items()}, F.lit("")) == F.concat_ws("/", l1, l2), F.lit(False))


_CENTER, _CARRIER = ["center_freq_hz", "center_frequency_hz"], ["carrier_freq_hz", "carrier_frequency_hz"]
_PARAMS = ", ".join(f"{c} string" for c in [*_CENTER, *_CARRIER, "band_low_hz", "band_high_hz", "subband_low_hz", "subband_high_hz"])
_GEOMETRY = ", ".join(f"{c} string" for c in ("source_depth_m", "receiver_depth_m", "range_m", "water_depth_m")) + ", geometry struct<tx_depth_m:string,rx_depth_m:string,range_m:string,water_depth_m:string>"


def _band(p: Column, low: str, high: str) -> Column:
    a, b = number(p[low], "nonnegative"), number(p[high])
    return F.when(a < b, (a + b) / 2)


def source_frequency(meta: Column, leaf_key: Column) -> Column:
    """struct value, origin: carrier before center for communication, center before carrier else, then the occupied band's middle."""

    def first(p: Column, keys: list[str]) -> Column:
        found = [(number(p[k], "positive"), f"signal_params.{k}") for k in keys]
        found.append((_band(p, "band_low_hz", "band_high_hz"), "signal_params.band_midpoint_hz"))
        return F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("value"), F.lit(name).alias("origin"))) for v, name in found])

    communication = leaf_key.isin([k for k, p in LEAVES.items() if p[1] == "communication"])
    return let(F.from_json(field(meta, "signal_params"), _PARAMS), lambda p: F.when(communication, first(p, _CARRIER + _CENTER)).otherwise(first(p, _CENTER + _CARRIER)))


def solver_frequency(meta: Column) -> Column:
    """Center, carrier, occupied band's middle, nominal band's middle: the first that is there."""
    own = lambda p: [number(p[k], "positive") for k in (_CENTER[0], _CARRIER[0])]
    return let(F.from_json(field(meta, "signal_params"), _PARAMS), lambda p: F.coalesce(*own(p), _band(p, "band_low_hz", "band_high_hz"), _band(p, "subband_low_hz", "subband_high_hz")))


def geometry(meta: Column) -> Column:
    """struct tx_depth_m, rx_depth_m, range_m, water_depth_m: the field at the top, or else the one inside geometry."""
    either = lambda m, top, inside, sign: F.coalesce(number(m[top], sign), number(m["geometry"][inside], sign)).alias(inside)
    return let(F.from_json(meta, _GEOMETRY), lambda m: F.struct(either(m, "source_depth_m", "tx_depth_m", "nonnegative"), either(m, "receiver_depth_m", "rx_depth_m", "nonnegative"), either(m, "range_m", "range_m", "positive"), either(m, "water_depth_m", "water_depth_m", "positive")))


def channel_metrics(meta: Column, env: str, output: str) -> Column:
    """struct range_km, rbox_km, num_beams, num_arrivals, first_arrival_s, normalization_gain_db of the objects named env and output.

    Arrivals are the summary's number, or else the sum over frequencies.
    """
    each = F.from_json(field(meta, f"{output}.arrivals_per_frequency"), "map<string,long>")
    total = F.when(F.size(each) > 0, F.aggregate(F.map_values(each), F.lit(0).cast("long"), lambda a, x: a + x))
    at = lambda name, path: number(field(meta, path)).alias(name)
    arrivals = F.coalesce(number(field(meta, f"{output}.summary.num_arrivals")).cast("long"), total).alias("num_arrivals")
    return F.struct(at("range_km", f"{env}.range_km"), at("rbox_km", f"{env}.ray_box_range_km"), at("num_beams", f"{env}.num_beams_effective"), arrivals, at("first_arrival_s", f"{output}.absolute_first_arrival_delay_s"), at("normalization_gain_db", f"{output}.output_normalization_gain_db"))


def dataset_kind(path: Column, meta: Column, output: str, folder: str) -> Column:
    """ship by category or broadband mode; waveform by category or a path segment named folder; else unknown."""
    category = F.lower(field(meta, "signal_category"))
    parts = F.split(F.lower(F.translate(path, "\\", "/")), "/")
    return F.when((category == "radiated_noise") | (field(meta, f"{output}.mode") == "broadband"), "ship").when(category.isin("pulse", "communication") | F.array_contains(parts, folder.lower()), "waveform").otherwise("unknown")


def meets_quality(l1: Column, gain: Column, snr: Column, gain_min: float, snr_min: float) -> Column:
    """Active rows by gain, passive ones by signal-to-noise ratio; a missing figure does not pass."""
    return F.coalesce(F.when(l1 == "active", gain >= gain_min).when(l1 == "passive", snr >= snr_min), F.lit(False))


def family_masked(l1: Column, l2: Column, gain: Column, frequency: Column, source_ratio: Column) -> Column:
    """struct gain, frequency (active only), source_ratio (ships only)."""
    return F.struct(F.when(l1 == "active", gain).alias("gain"), F.when(l1 == "active", frequency).alias("frequency"), F.when(l2 == "ship_noise", source_ratio).alias("source_ratio"))


def line_ratio(c: Column) -> Column:
    """A source's line ratio to two places, 0 where it is missing or no number."""
    return F.coalesce(F.round(number(c), 2), F.lit(0.0))


def merged(preferred: Column, fallback: Column, fields: list[str]) -> Column:
    """struct value, origin, conflict by dotted field: the preferred document's value, or else the other's.

    origin says which document (null: neither); conflict, whether both have a value and these differ. One projection for
    any depth: fields name the leaves, so no document is parsed in Python.
    """

    def one(name: str) -> Column:
        a, b = field(preferred, name), field(fallback, name)
        return F.struct(F.coalesce(a, b).alias("value"), F.when(a.isNotNull(), "preferred").when(b.isNotNull(), "fallback").alias("origin"), F.coalesce(a != b, F.lit(False)).alias("conflict")).alias(name.replace(".", "_"))

    return F.struct(*[one(f) for f in fields])


def conflicts(of: Column, fields: list[str]) -> Column:
    """Names of merged() fields that conflict, in order."""
    return F.array_compact(F.array(*[F.when(of[f.replace(".", "_")]["conflict"], f) for f in fields]))


def saved_gain(meta: Column, output: str, keys: tuple[str, str] = ("tl_db", "estimated_transmission_loss_db")) -> Column:
    """The first of the gains that is a number."""
    return F.coalesce(*[number(field(meta, f"{output}.{k}")) for k in keys])


def audit_finding(state: Column, kind: Column, gain: Column, wav_missing: Column, report_unverifiable: bool = False) -> Column:
    """What an audit reports of a record by its evidence state (zero, invalid, nonzero, missing); null if nothing.

    Zero arrivals are definite, an invalid count is reported; without counts a ship whose gain is exactly 0 is reviewed. A
    missing recording is reported where nothing else is.
    """
    zero_gain = F.coalesce(F.abs(gain) <= 1e-8, F.lit(False))
    out = F.when(state == "zero", "definite").when(state == "invalid", "invalid").when((state == "missing") & (kind == "ship") & zero_gain, "review")
    if report_unverifiable:
        out = out.when(state == "missing", "unverifiable")
    return out.when(wav_missing, "missing recording")


def embedded_labels(meta: Column, truth: str = "gt") -> Column:
    """struct l1, l2, l3 of the truth inside a record; no other field stands in for it, and a missing one is an error."""
    at = lambda k: F.coalesce(F.nullif(F.trim(field(meta, f"{truth}.{k}")), F.lit("")), F.raise_error(F.lit(f"a record has no {truth}.{k}")).cast("string"))
    return F.struct(at("L1").alias("l1"), at("L2").alias("l2"), at("L3").alias("l3"))
