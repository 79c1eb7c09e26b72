"""Whether reasoning uses the terms of the label it argues for."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.functions.text import longest_terms
from evalweave.operators.metrics import ratio


def term_hits(df: DataFrame, key: str, label: str, text: str, terms: dict[str, list[str]]) -> DataFrame:
    """key, label, own, other: whether a term of the label, and one of other labels only, occurs in the text.

    terms: the vocabulary by label, a few hundred phrases. Longer occurrences win over those inside them. A label without
    terms has none of its own; null text: no term.
    """
    vocabulary = sorted({t.lower() for own in terms.values() for t in own})
    owned = {k: {t.lower() for t in own} for k, own in terms.items()}
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = longest_terms(vocabulary)
        for b in batches:
            found = [set(one(t)) for t in b[text]]
            mine = [owned.get(k, set()) for k in b[label]]
            yield pd.DataFrame({key: b[key], label: b[label], "own": [bool(f & m) for f, m in zip(found, mine, strict=True)], "other": [bool(f - m) for f, m in zip(found, mine, strict=True)]})

    return df.select(key, label, text).mapInPandas(run, f"{key} {kinds[key]}, {label} {kinds[label]}, own boolean, other boolean")


def rates(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n and the shares aligned (own only), contradicted (any other), confused (other only), vague (neither), stacked (both); 0 for no rows."""
    own, other, n = F.col("own"), F.col("other"), F.count(F.lit(1))
    share = lambda c, name: F.round(ratio(F.count_if(c), n), 6).alias(name)
    return hits.groupBy(*(by or [])).agg(n.alias("n"), share(own & ~other, "alignment_rate"), share(other, "contradiction_rate"), share(~own & other, "concept_confusion_rate"), share(~own & ~other, "vague_rate"), share(own & other, "term_stacking_rate"))
