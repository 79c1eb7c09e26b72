import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.operators import quantiles, selection


def test_quantiles_and_steps_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.normal(size=3000).round(2)] + [("one", 1.5), ("ties", 2.0), ("ties", 2.0), (None, 3.0), (None, 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    shares = [0.0, 0.25, 1 / 3, 0.5, 0.99, 1.0]
    for most in (quantiles.FEW, 0):
        got = {r[0]: tuple(r)[1:] for r in quantiles.quantiles(df, "g", "v", shares, list("abcdef"), most).collect()}
        assert got.keys() == by.keys()
        for g, own in by.items():
            assert got[g] == pytest.approx(np.quantile(own, shares))
    steps = {(r["g"], r["v"]): r["mass"] for r in selection.ecdf(df, "g", "v").collect()}
    assert steps == {(g, v): round(sum(x <= v for x in own) / len(own), 9) for g, own in by.items() for v in set(own)}
    summary = {r["o"]: r["median"] for r in selection.numeric_summary(df.withColumnRenamed("g", "o"), "o", "v").collect()}
    assert summary["none"] is None and summary[None] == 4.0 and len(summary) == 5


def test_empty(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert quantiles.quantiles(none, "g", "v", [0.5], ["m"]).count() == 0 and quantiles.cumulative(none, "g", "v").count() == 0
    assert quantiles.quantiles(spark.range(3).select(F.lit("a").alias("g"), F.lit(None).cast("double").alias("v")), "g", "v", [0.5], ["m"]).count() == 0
