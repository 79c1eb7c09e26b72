"""Answers of one option letter: the option's text from the prompt, and the classes that its words name, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalweave.operators.labels import let

# Other names of the classes, by level.
ALIASES = {
    "l1": {
        "active": ["actively transmitted", "active", "active signal", "active transmission", "active sonar", "active sonar signal", "active detection", "deliberately transmitted", "purposefully transmitted", "artificially transmitted", "deliberately emitted", "sonar transmission"],
        "passive": ["source-radiated", "source-radiated noise", "platform-radiated noise", "passive", "passive signal", "target-radiated", "target-radiated signal", "target-radiated noise", "radiated noise", "ship-radiated", "self-radiated by the source platform"],
    },
    "l2": {
        "pulse": ["detection pulse", "sonar pulse", "sonar detection pulse", "pulse signal", "detection pulse class", "active sonar pulse"],
        "communication": ["communication", "communication signal", "underwater communication", "digital communication", "underwater acoustic communication", "acoustic communication"],
        "ship_noise": ["ship-radiated noise", "ship radiated noise", "vessel-radiated noise", "ship noise", "vessel noise", "radiated noise", "target-radiated noise", "shipping noise"],
    },
    "l3": {
        "CW": ["CW", "CW pulse", "continuous wave", "CW continuous wave", "single-frequency pulse", "single frequency", "single tone pulse"],
        "LFM": ["LFM", "LFM pulse", "linear frequency modulation", "linear chirp", "LFM chirp", "linear sweep", "linear FM"],
        "HFM": ["HFM", "HFM pulse", "hyperbolic frequency modulation", "hyperbolic chirp", "hyperbolic FM", "hyperbolic sweep", "Doppler-invariant pulse"],
        "2FSK": ["2FSK", "binary FSK", "binary frequency shift keying", "2-FSK", "2fsk", "2-level FSK"],
        "4FSK": ["4FSK", "quaternary FSK", "quaternary frequency shift keying", "4-FSK", "4fsk", "4-ary FSK", "4-level FSK"],
        "BPSK": ["BPSK", "binary PSK", "binary phase shift keying", "BPSK modulation", "bpsk", "2-PSK"],
        "QPSK": ["QPSK", "quadrature PSK", "quadrature phase shift keying", "QPSK modulation", "qpsk", "4-PSK"],
        "OFDM": ["OFDM", "orthogonal frequency division multiplexing", "OFDM modulation", "ofdm", "multi-carrier modulation"],
        "cargo": ["cargo vessel", "cargo ship", "cargo", "merchant vessel", "merchant ship", "commercial vessel", "commercial ship", "freighter", "container ship"],
        "cruise": ["cruise ship", "cruise", "passenger vessel", "passenger ship", "cruise liner", "ocean liner", "cruise passenger"],
        "fishing": ["fishing vessel", "fishing boat", "fishing", "fisherman boat", "small fishing", "trawler", "commercial fishing"],
        "warship": ["naval vessel", "warship", "naval ship", "military vessel", "military ship", "combat vessel", "navy ship", "frigate", "destroyer"],
        "underwater_target": ["underwater target", "underwater vehicle", "underwater object", "subsurface target", "submerged target", "UUV", "underwater craft", "unmanned underwater vehicle", "underwater drone", "AUV", "submarine"],
    },
}
# End of fixed values.
#: White space and word characters as the answers' reader has them: Java's own classes lack U+001C to U+001F, and \w has marks.
_SPACE, _NO_WORD = r"[\s\x1c-\x1f]", r"[^\p{L}\p{N}_]"
#: A line break is \n alone.
_OPTION = rf"(?Udm)^{_SPACE}*([A-Z])\. +([^\r\n]+)"


def short_answer(output: Column, prompt: Column) -> Column:
    """The text of the option whose letter is the whole answer; empty for another answer or an option that the prompt lacks.

    Options are the prompt's lines "A. text"; of two with one letter the later holds.
    """
    letter = F.upper(F.regexp_extract(output, rf"(?U)\A{_SPACE}*([A-Za-z]){_SPACE}*\z", 1))
    found = F.arrays_zip(F.regexp_extract_all(prompt, F.lit(_OPTION), F.lit(1)).alias("letter"), F.regexp_extract_all(prompt, F.lit(_OPTION), F.lit(2)).alias("text"))
    own = F.filter(found, lambda x: x["letter"] == letter)
    return F.coalesce(F.try_element_at(own, F.lit(-1))["text"], F.lit(""))


def named_class(words: Column, classes: dict[str, list[str]]) -> Column:
    """struct key, tier of the class that a text names by an alias, longer aliases first, then in the order given.

    Tier 1: the alias stands in the text, in either case. Tier 2: it does without what is not a letter, digit or underscore.
    Else 'unknown' with tier 3.
    """
    pairs = [(a.lower(), key) for a, key in sorted(((a, key) for key, own in classes.items() for a in own), key=lambda x: -len(x[0]))]
    bare = [(b, key) for a, key in pairs if (b := re.sub(r"[^\w]", "", a))]
    hit = lambda key, tier: F.struct(F.lit(key).alias("key"), F.lit(tier).alias("tier"))

    def chain(text: Column, own: list[tuple[str, str]], tier: int, otherwise: Column) -> Column:
        if not own:
            return otherwise
        out = F.when(F.contains(text, F.lit(own[0][0])), hit(own[0][1], tier))
        for a, key in own[1:]:
            out = out.when(F.contains(text, F.lit(a)), hit(key, tier))
        return out.otherwise(otherwise)

    loose = lambda text: let(F.regexp_replace(text, _NO_WORD, ""), lambda t: chain(t, bare, 2, hit("unknown", 3)))
    return let(F.lower(words), lambda t: chain(t, pairs, 1, loose(t)))


def parse(output: Column, prompt: Column, classes: dict[str, dict[str, list[str]]] = ALIASES, first_only: bool = False) -> Column:
    """struct of each level's key, parse_tier (the worst of the levels), raw_output and parse_status (valid_option, invalid_format).

    first_only reads the first level alone: the others are 'unknown' and don't count in the tier.
    """
    levels = list(classes)
    read = levels[:1] if first_only else levels

    def result(words: Column) -> Column:
        found = F.struct(*[named_class(words, classes[x]).alias(x) for x in read])
        keys = lambda f: [(f[x]["key"] if x in read else F.lit("unknown")).alias(x) for x in levels]
        tier = lambda f: F.greatest(*[f[x]["tier"] for x in read]) if len(read) > 1 else f[read[0]]["tier"]
        status = F.when(words != "", "valid_option").otherwise("invalid_format")
        return let(found, lambda f: F.struct(*keys(f), tier(f).alias("parse_tier"), output.alias("raw_output"), status.alias("parse_status")))

    return let(short_answer(output, prompt), result)


def first_keyword(text: Column, pairs: list[tuple[str | re.Pattern, str]]) -> Column:
    """The label of the first pair that the text holds: a keyword in either case, or a pattern in Spark's dialect; null if none or no text."""
    out, low = F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("string")), F.lower(text)
    for k, label in pairs:
        out = out.when(F.contains(low, F.lit(k.lower())) if isinstance(k, str) else text.rlike(("(?iu)" if k.flags & re.IGNORECASE else "") + k.pattern), label)
    return out
