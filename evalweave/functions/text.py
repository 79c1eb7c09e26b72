"""Text functions as column expressions; the sequential ones as Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_id(c: Column) -> Column:
    """Without the channel suffix."""
    return F.regexp_replace(c, r"(?i)_ch\d+$", "")


def contains_term(text: Column, term: str) -> Column:
    """Whether a term stands in the text between characters other than a-z and 0-9."""
    return F.lower(text).rlike(rf"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])")


def narrow(c: Column) -> Column:
    """Full-width forms as ASCII, white space collapsed."""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　"
    return F.trim(F.regexp_replace(F.translate(c, wide, "".join(chr(x) for x in range(0x21, 0x7F)) + " "), r"\s+", " "))


# What a unit behind a number multiplies it by.
FACTORS = {"khz": 1e3, "kilo": 1e3, "k": 1e3, "mhz": 1e6, "ms": 1e-3, "m": 1e-3, "ghz": 1e9, "g": 1e9}
# End of fixed values.


def number_with_unit(c: Column) -> Column:
    """A number in front, times the factor of the unit that the rest begins with, the longest such; null if there is no number.

    Case and spaces don't count. A unit that isn't known has the factor 1.
    """
    plain = F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit(""))
    number = F.regexp_extract(plain, r"^([+-]?\d+\.?\d*(?:e[+-]?\d+)?)", 1)
    rest = F.substr(plain, F.length(number) + 1)
    factor = F.lit(1.0)
    for unit in sorted(FACTORS, key=len):
        factor = F.when(rest.startswith(unit), F.lit(FACTORS[unit])).otherwise(factor)
    return F.when(number != "", number.try_cast("double") * factor)


def delimited_field(c: Column, name: str) -> Column:
    """The value of a field, in either case of its name: what follows the name in full-width brackets, with a colon, an equals
    sign or nothing between, up to the line's end or the next bracket; else what follows the name and a colon or equals sign, up
    to the line's end. Marks and white space at its end go; null if there is no such field.
    """
    word = re.escape(name)
    bracketed, bare = (rf"(?i)【{word}】\s*[:：=]?\s*([^\n]+?)(?:\n|【|$)", rf"(?i){word}\s*[:：=]\s*([^\n]+?)(?:\n|$)")
    value = F.when(F.regexp_like(c, F.lit(bracketed)), F.regexp_extract(c, bracketed, 1)).when(F.regexp_like(c, F.lit(bare)), F.regexp_extract(c, bare, 1))
    return F.regexp_replace(F.trim(value), r"[，。,.\s]+$", "")


def longest_terms(terms: list[str]):
    """Of one text: the terms that occur, longer occurrences first, then earlier, then by name; none over another."""
    found = [(t, re.compile(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])")) for t in sorted(set(terms))]

    def one(text: str | None) -> list[str]:
        text = (text or "").lower()
        hits = sorted((-len(t), m.start(), t) for t, p in found if t in text for m in p.finditer(text))
        taken, out = [], set()
        for n, a, t in hits:
            if all(a - n <= x or a >= y for x, y in taken):
                taken.append((a, a - n))
                out.add(t)
        return sorted(out)

    return one


def match_terms(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, terms array<string>: which occurrence wins depends on those before it, so this runs over Arrow batches."""
    one = longest_terms(terms)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({key: x[key], "terms": [one(t) for t in x[text]]})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, terms array<string>")
