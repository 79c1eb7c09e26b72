import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.operators import channel, intervals, reasoning, selection

WAVE = [0.0, 1.0, -0.5, 0.25, 0.0, 0.0, 0.0, 0.0]


def test_single_frequency_channel(spark):
    rows = [("one", WAVE, 8.0, [3.0], [0.5]), ("two", WAVE, 8.0, [3.25, 3.0], [0.25, 0.5]), ("none", WAVE, 8.0, [], []), ("null", WAVE, 8.0, None, None), ("silent", [0.0] * 8, 8.0, [1.0], [1.0]), ("empty", [], 8.0, [1.0], [1.0])]
    df = spark.createDataFrame(rows, "id string, samples array<double>, rate double, delays array<double>, amplitudes array<double>")
    got = {r["id"]: r for r in channel.apply_single(df).collect()}
    assert got["one"]["samples"] == pytest.approx(np.array(WAVE) * 0.95, abs=1e-9)
    assert got["one"]["gain_db"] == pytest.approx(20 * np.log10(0.5)) and got["one"]["scale_db"] == round(20 * np.log10(0.95 / 0.5), 2)
    wet = 0.5 * np.array(WAVE) + 0.25 * np.concatenate([[0, 0], WAVE[:-2]])
    assert got["two"]["samples"] == pytest.approx(wet / np.abs(wet).max() * 0.95, abs=1e-9)
    assert [got[k]["status"] for k in ("one", "none", "null", "silent", "empty")] == ["success", "no_arrivals", "no_arrivals", "failed", "failed"]
    assert got["silent"]["error"] and got["none"]["samples"] is None


def test_broadband_channel(spark):
    rows = [("flat", WAVE, 8.0, [1.0, 4.0], [[2.0], [2.0]], [[0.5], [0.5]]), ("gap", WAVE, 8.0, [1.0, 4.0], [[2.0], []], [[0.5], []]), ("high", WAVE, 8.0, [5.0], [[2.0]], [[0.5]])]
    df = spark.createDataFrame(rows, "id string, samples array<double>, rate double, frequencies array<double>, delays array<array<double>>, amplitudes array<array<double>>")
    got = {r["id"]: r for r in channel.apply_broadband(df).collect()}
    assert got["flat"]["samples"] == pytest.approx(np.array(WAVE) * 0.95, abs=1e-9) and got["flat"]["gain_db"] == pytest.approx(20 * np.log10(0.5))
    assert got["gap"]["status"] == "no_arrivals" and got["high"]["status"] == "failed"


def test_geometry_is_the_same_in_any_partitions_and_within_limits(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") % 3 > 0, 50.0).alias("s"), F.lit(5000.0).alias("r"), F.when(F.col("id") % 5 > 0, 100.0).alias("b"))
    g = lambda x: x.select("k", channel.jittered_geometry(F.col("k"), F.col("s"), F.col("s"), F.when(F.col("s").isNotNull(), F.col("r")), F.col("b")).alias("g")).select("k", "g.*")
    a, b = (sorted(map(tuple, x.collect())) for x in (g(df), g(df.repartition(9))))
    assert a == b
    assert all((s is None) == (int(k) % 5 == 0) for k, s, *_ in a)
    assert all(1 <= s <= 99 and (not int(k) % 3 or 45 <= s <= 55) for k, s, *_ in a if s is not None)
    assert all(4.5 <= km <= 5.5 if int(k) % 3 else 10 <= km <= 80 for k, _, _, km in a)


def test_profiles_deep_enough(spark):
    profiles = spark.createDataFrame([(i, 100.0 * (i + 1)) for i in range(10)], "profile long, max_depth double")
    need = spark.createDataFrame([(i, 100.0 * (i % 12)) for i in range(240)], "k long, depth double")
    got = channel.profile_for_depth(need, profiles, "k", "depth").collect()
    assert len(got) == 240
    assert all(r["profile_depth"] >= min(r["depth"], 1000.0) for r in got)
    assert {r["profile"] for r in got if r["depth"] == 1100.0} == {9} and len({r["profile"] for r in got if r["depth"] == 0}) > 3


def test_bootstrap_of_a_mean(spark):
    df = spark.createDataFrame([(float(i % 4 == 0),) for i in range(400)] + [(None,)], "v double")
    low, high = intervals.bootstrap_mean(df, "v").first()
    assert 0.19 < low < 0.25 < high < 0.31
    assert intervals.bootstrap_mean(df.repartition(5), "v").first() == (low, high)
    assert tuple(intervals.bootstrap_mean(df.limit(4), "v").first()) == (None, None)


def test_reasoning_of_nulls_and_nested_terms(spark):
    terms = {"a": ["linear sweep"], "b": ["sweep"], "c": ["tone"]}
    df = spark.createDataFrame([(1, "a", "A linear sweep."), (2, "b", "a linear sweep"), (3, "a", None), (4, "a", "linear sweep and sweep"), (5, None, "tone")], "k long, l string, t string")
    got = {r["k"]: (r["own"], r["other"]) for r in reasoning.term_hits(df, "k", "l", "t", terms).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (False, False), 4: (True, True), 5: (False, True)}
    assert reasoning.rates(reasoning.term_hits(df.limit(0), "k", "l", "t", terms)).first()["vague_rate"] == 0


def test_pool_keeps_a_few_rows_of_a_group_before_the_shuffle(spark):
    df = spark.range(10_000).select(F.when(F.col("id") >= 0, "hot").alias("g"), (F.col("id") % 100).alias("q"), "id")
    x = selection.rank_pool(df, "g", "q", "id", 5)
    assert [r["id"] for r in x.orderBy("rank").collect()] == [99 + 100 * i for i in range(10)] and x.first()["pool_size"] == 10_000
    assert "WindowGroupLimit" in x._jdf.queryExecution().executedPlan().toString()
