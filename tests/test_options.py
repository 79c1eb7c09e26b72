import re

import pytest

from evalweave.functions import options
from evalweave.plans import catalogue

PROMPT = "Which?\nOptions:\nA. Active - Deliberately transmitted signal\n  B.  Passive - Source-radiated noise\rX. no line\nC. A merchant-vessel\r\n D. frigate, radiated  noise\nE. first\nE. (Q-P-S-K)\nF. passenger vessel or cargo\nG. none\nH.x\nI. cont_wave\nJ. continuous²wave 水"
OUTPUTS = ["A", " b ", "\x1cc\x1f", "D\n", "e", "F", "G", "H", "I", "J", "X", "Z", "A.", "AB", "É", "", "the answer is A", None]


def plain(output, prompt, first_only=False):
    answer = (output or "").strip()
    found = dict(re.findall(r"^\s*([A-Z])\. +([^\r\n]+)", prompt, re.MULTILINE))
    words = found.get(answer.upper(), "") if re.fullmatch("[A-Za-z]", answer) else ""
    keys, worst = [], 0
    for level, classes in options.ALIASES.items():
        pairs = sorted(((a, k) for k, own in classes.items() for a in own), key=lambda x: len(x[0]), reverse=True)
        low, bare = words.lower(), re.sub(r"[^\w]", "", words.lower())
        hit = next(((k, 1) for a, k in pairs if a.lower() in low), None) or next(((k, 2) for a, k in pairs if re.sub(r"[^\w]", "", a.lower()) in bare), ("unknown", 3))
        if first_only and level != "l1":
            hit = ("unknown", 0)
        keys.append(hit[0])
        worst = max(worst, hit[1])
    return (*keys, worst, output, "valid_option" if words else "invalid_format")


@pytest.mark.parametrize("first_only", [False, True])
def test_parse(spark, first_only):
    df = spark.createDataFrame([(o, PROMPT) for o in OUTPUTS], "o string, p string")
    got = [tuple(r["x"]) for r in df.select(options.parse(df.o, df.p, first_only=first_only).alias("x")).collect()]
    assert got == [plain(o, PROMPT, first_only) for o in OUTPUTS]
    if not first_only:
        by = dict(zip(OUTPUTS, got))
        assert by["A"][:3] == ("active", "unknown", "unknown") and by["\x1cc\x1f"][2] == "cargo" and by["e"][2] == "QPSK"
        assert by["F"][2] == "cruise" and by["A."][5] == "invalid_format"


def test_tiers(spark):
    texts = {"LFM pulse": ("LFM", 1), "l-f-m": ("LFM", 2), "an ocean liner": ("cruise", 1), "unmanned underwater vehicle, naval vessel": ("underwater_target", 1), "no such thing": ("unknown", 3)}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r[0]: tuple(r[1]) for r in df.select("t", options.named_class(df.t, options.ALIASES["l3"])).collect()} == texts


def test_tier_of_an_event_comes_from_its_option(spark, monkeypatch):
    # with other aliases the same prompts name no class: the histogram has to follow
    monkeypatch.setattr(catalogue, "EVENT_ALIASES", {"l1": {"passive": ["nothing"]}})
    assert {r["tier"] for r in catalogue.parse_tier_hist(spark, "/root/testdata/sf0.001").collect()} == {0, 3}


def test_first_keyword(spark):
    pairs = [("Single", "CW"), (re.compile("li?fm", re.I), "LFM"), (re.compile("^up"), "HFM"), ("pulse", "other")]
    df = spark.createDataFrame([(t,) for t in ("a SINGLE LFM", "an LFM pulse", "Up pulse", "up pulse", "x", "", None)], "t string")
    assert [r[0] for r in df.select(options.first_keyword(df.t, pairs)).collect()] == ["CW", "LFM", "other", "HFM", None, None, None]
