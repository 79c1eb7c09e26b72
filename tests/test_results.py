"""Rules for nulls, NaN and ties, and the checks of answers, sources, headers and profiles."""

import math

import pytest
from pyspark.sql import functions as F

from evalweave.functions import text, views
from evalweave.operators import answers, metrics, selection, validation
from evalweave.plans import figures

NAN, INF = math.nan, math.inf
TREE = {"a": ("p", "x"), "b": ("q", "y")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_selection_of_nulls(spark):
    x = spark.createDataFrame([("g", k, float(k)) for k in range(9)] + [("g", 90, None), ("g", 91, NAN), ("g", 92, INF), (None, 93, 1.0), (None, 94, 2.0)], "g string, k int, v double")
    got = {r["k"]: r["stratum"] for r in selection.tertile_strata(x, "g", "v").collect()}
    assert len(got) == 14 and [got[k] for k in (90, 91, 92)] == [None] * 3 and [got[k] for k in range(9)] == [0, 0, 0, 1, 1, 1, 2, 2, 2] and got[93] == 0
    s = {r["g"]: r for r in selection.numeric_summary(x, "g", "v").collect()}
    assert (s["g"]["count"], s["g"]["max"], s["g"]["mean"], s["g"]["median"]) == (9, 8.0, 4.0, 4.0) and s[None]["count"] == 2
    pool = selection.rank_pool(x, "g", "v", "k", 2)
    assert {r["g"] for r in pool.collect()} == {"g", None} and {r["k"] for r in pool.filter("rank = 1").collect()} == {92, 94}
    assert selection.ecdf(x, "g", "v").filter("g = 'g'").count() == 9
    with pytest.raises(Exception, match="not finite in the row 9"):
        selection.robust_medoid(x, "g", "k", ["v"]).collect()
    assert rows(selection.robust_medoid(x.filter("k < 9 or k > 92"), "g", "k", ["v"])) == sorted([("g", 4, 0.0, 9), (None, 93, 1.0, 2)], key=repr)
    split = selection.group_split(x.withColumn("s", F.when(F.col("k") % 2 == 0, F.col("k"))), "g", "s", "1")
    assert split.count() == 10 and {r["g"] for r in split.filter("s is null").collect()} == {"g", None}


def test_distribution_keeps_null_groups_apart(spark):
    x = spark.createDataFrame([("a", None, 1.0), (None, "a", 2.0), ("a", None, 3.0)], "g string, h string, v double")
    assert rows(figures.distribution(x, ["g", "h"], "v")) == sorted([("a", None, 1.0, 0.0), ("a", None, 1.0, 0.5), ("a", None, 3.0, 1.0), (None, "a", 2.0, 0.0), (None, "a", 2.0, 1.0)], key=repr)


def test_representatives_have_their_proof(spark):
    x = spark.createDataFrame([("g", k, float(k % 3), 5.0) for k in range(6)], "g string, k int, v double, w double")
    (r,) = figures.representatives(x, "g", "k", ["v", "w"]).collect()
    assert (r["k"], r["rows"], r["ties"], r["used"], r["dropped"], r["distance"], r["v_median"]) == (1, 6, 2, "v", "w", 0.0, 1.0)


def test_states(spark):
    cols = "l3 string, leaf string, skipped boolean, t1_status string, t2_status string"
    x = spark.createDataFrame([("a", "cascade_error", True, "invalid_format", None), ("a", "cascade_error", True, "valid_option", None), ("a", "unknown", False, "valid_option", "invalid_format"), ("a", "b", False, "valid_option", "valid_option"), ("a", "a", False, "valid_option", "valid_option"), (None, None, None, None, None), ("a", "a", False, "valid_option", None)], cols)
    assert rows(x.select(metrics.outcome_state())) == sorted([(s,) for s in metrics.STRICT_STATES] + [(None,)] * 2, key=repr)
    assert [r["n"] for r in metrics.outcomes(x, strict=False).orderBy("state").collect()] == [1, 2, 2, 2]
    assert [r["n"] for r in metrics.outcomes(x.limit(0)).collect()] == [0] * 5


def test_canonical_answers(spark):
    cols = "id int, l1 string, l2 string, l3 string, t1 string, t1_status string, skipped boolean, leaf string, t2_l1 string, t2_l2 string, t2_status string"
    good = (1, "p", "x", "a", "p", "valid_option", False, "b", "q", "y", "valid_option")
    cases = {
        None: good,
        "truth": (2, "p", "x", "b", *good[4:]),
        "label": (3, *good[1:7], "z", *good[8:]),
        "gate": (4, *good[1:6], None, *good[7:]),
        "skipped label": (5, *good[1:4], "q", "valid_option", True, "b", "q", "y", None),
        "first status": (6, *good[1:5], None, *good[6:]),
        "second status": (7, *good[1:10], "invalid_format"),
        "hierarchy": (8, *good[1:8], "p", "y", "valid_option"),
    }
    a = spark.createDataFrame([*cases.values(), (20, *good[1:]), (20, *good[1:]), (30, *good[1:])], cols)
    m = spark.createDataFrame([(k, "p", "x", "a") for k in (*range(1, 9), 20, 40)], "id int, l1 string, l2 string, l3 string")
    got = sorted(((r["id"], r["fault"]) for r in answers.canonical(a, m, TREE).collect()), key=repr)
    want = [(v[0], k) for k, v in cases.items()] + [(20, None), (20, None), (20, "repeated"), (30, "not in the manifest"), (40, "no answer")]
    assert got == sorted(want, key=repr)
    legacy = {r["id"]: r["fault"] for r in answers.canonical(a.filter("id < 9"), m.filter("id < 9"), TREE, strict=False).collect()}
    assert [legacy[k] for k in (6, 7, 8)] == [None] * 3 and legacy[4] == "gate"


def test_saved_matrix(spark):
    x = spark.createDataFrame([("B!", 0, [5, 1, 0]), ("a", 1, [2, 7, 3]), ("none", 2, [0, 0, 0])], "label string, at int, counts array<long>")
    got = {(r["truth"], r["pred"]): r["n"] for r in answers.saved_matrix(x, {"B!": "b", "a": "a", "none": "unknown"}).collect()}
    assert got["b", "b"] == 5 and got["a", "b"] == 2 and got["a", "unknown"] == 3 and len(got) == 9


def test_intervals_and_merges(spark):
    x = spark.createDataFrame([(k % 5, "a", "a" if k % 3 else "b", "a") for k in range(60)], "c int, truth string, pred_a string, pred_b string")
    got = answers.interval_summary(x, "c", ["a", "b"], replicates=50)
    assert {r["run"]: r["k"] for r in got["wilson"].collect()} == {"a": 40, "b": 60} and got["difference"].count() == 1 and got["bootstrap"].count() == 6
    cols = "id string, run_signature string, l1 string, l2 string, l3 string, prompt_1 string, prompt_2 string, prompt_3 string, pred_1 string, pred_2 string, pred_3 string, skipped boolean, shard_index int, num_shards int"
    one = lambda i, s: (i, "r", "p", "x", "a", "1", "2", "3", "p", "x", "a", False, s, 2)
    shards = [spark.createDataFrame([one("i0", 0)], cols), spark.createDataFrame([one("i1", 1)], cols)]
    manifest = spark.createDataFrame([(i, "p", "x", "a", ["1", "2", "3"]) for i in ("i0", "i1")], "id string, l1 string, l2 string, l3 string, questions array<string>")
    protocols = spark.createDataFrame([("r", "m", s, 2) for s in (0, 1)], "run_signature string, manifest_sha256 string, shard_index int, num_shards int")
    merged = answers.shard_merge(shards, manifest, protocols, ["a"])
    assert merged["faults"].count() == 0 and merged["summary"].first()["total"] == 2 and merged["classes"].first()["f1"] == 1.0
    assert answers.shard_merge(shards[:1], manifest, protocols, ["a"])["faults"].first()["fault"] == "no prediction"


def test_received_and_paths(spark):
    ok = ("s1_ch0", "s1", "CW", "{}", 16000, 10, 5.0, 1.0, "first", 0.5)
    cols = "id string, source_id string, l3 string, params string, rate int, frames int, range_m double, depth_m double, reference string, delay double"
    cases = {None: ok, "class": (*ok[:2], "LFM", *ok[3:]), "parameters": (*ok[:3], None, *ok[4:]), "header": (*ok[:5], 11, *ok[6:]), "geometry": (*ok[:6], NAN, *ok[7:]), "time reference": (*ok[:8], "?", 0.5), "delay": (*ok[:9], -1.0), "no source": ("x", "s2", *ok[2:])}
    r = spark.createDataFrame([(k or "", *v[1:]) for k, v in cases.items()], cols)
    s = spark.createDataFrame([("s1", "CW", "{}", "a\\s1.wav")], "source_id string, l3 string, params string, file string")
    h = spark.createDataFrame([("s1", 16000, 10, 1)], "source_id string, rate int, frames int, channels int")
    assert rows(validation.received_faults(r, s, h, ["range_m", "depth_m"], ["first", "all"])) == sorted([(k, k) for k in cases if k], key=repr)
    p = spark.createDataFrame([("/a/b.wav",), ("./c\\d.wav",), ("C:\\e.wav",), ("",), (None,)], "p string").select(validation.optional_path(F.col("p"), "/root/"))
    assert [r[0] for r in p.collect()] == ["/a/b.wav", "/root/c/d.wav", "C:/e.wav", None, None]


def test_header_sidecar(spark):
    m = spark.createDataFrame([(1, "a"), (2, None)], "id int, l string")
    f = spark.createDataFrame([("w", 5)], "path string, bytes long")
    saved = validation.header_sidecar(m, m, f, "imported")
    assert validation.sidecar_faults(saved, m.orderBy(F.desc("id")), m, f).count() == 0
    assert rows(validation.sidecar_faults(saved, m, m.limit(1), f)) == [("index_digest",), ("index_rows",)]
    assert rows(validation.sidecar_faults(saved.limit(0), m, m, f)) == [("no sidecar",)]


def test_views(spark):
    x = spark.createDataFrame([([3.0, 1.0, NAN, 1.0, None, 2.0, INF], [1.0, 2.0, 3.0, 4.0, 5.0, None, 7.0]), ([], []), (None, None)], "z array<double>, c array<double>")
    got = [r[0] for r in x.select(views.clean_profile(F.col("z"), F.col("c"))).collect()]
    assert [tuple(p) for p in got[0]] == [(1.0, 2.0), (3.0, 1.0)] and got[1:] == [[], None]
    assert x.select(views.profile_fault(views.clean_profile(F.col("z"), F.col("c")))).collect()[1][0] == "fewer than two depths"
    close = spark.createDataFrame([(1.0, 1.05), (NAN, NAN), (INF, INF), (INF, 1.0), (0.0, 1e-9), (None, 1.0)], "a double, b double").select(views.is_close(F.col("a"), F.col("b"), 0.1, 1e-8))
    assert [r[0] for r in close.collect()] == [True, False, True, False, True, None]
    from hashlib import blake2b

    seed = spark.range(1).select(views.identity_seed(F.array(F.lit("42"), F.lit("ä")))).first()[0]
    assert seed % 2**64 == int.from_bytes(blake2b("42\0ä".encode(), digest_size=8).digest(), "little")
    band = spark.range(1).select(views.display_band(F.lit(7990.0), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(100.0), F.lit(16000.0), F.lit(10.0)).alias("b")).first()["b"]
    assert (band["from"], band["to"], band["clipped"], band["padding"]) == (7910.0, 8000.0, True, 30.0)


def test_text_rules(spark):
    said = ["8500 Hz", "8.5k", "8.5 kHz", "200 ms", "15 节", "3叶", "1e3 mhz", "", None, "x", "-2.5 m"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(text.number_with_unit(F.col("s"))).collect()]
    assert got == [8500.0, 8500.0, 8500.0, 0.2, 15.0, 3.0, 1e9, None, None, None, -0.0025]
    lines = ["【Class】: CW 。", "【class】CW【x】", "no\nClass：LFM, \nz", "class CW", "Class=", None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in lines], "s string").select(text.delimited_field(F.col("s"), "class")).collect()]
    assert got == ["CW", "CW", "LFM", None, None, None]


def test_guards(spark):
    a = spark.createDataFrame([(1, "p", True), (2, "q", False)], "id int, pred string, ok boolean")
    pairs = spark.createDataFrame([(1, "p", True, "p", True), (1, "p", True, "p", True), (3, "p", True, "p", True)], "id int, pred_a string, ok_a boolean, pred_b string, ok_b boolean")
    got = rows(answers.raw_run_faults(pairs, a, a))
    assert (2, "not paired") in got and (3, "not in the first run") in got and (1, "repeated") in got
    with pytest.raises(TypeError):
        answers.batch_guard(a, a, "id", "ok")
    sources = spark.createDataFrame([("a b", 1, "x"), ("s", None, "x"), ("t", 1, "x"), ("t", 2, "y"), ("u", 0, None), ("u", 1, None)], "s string, c int, f string")
    assert rows(validation.source_faults(sources, "s", "c", ["f"]).select("s", "fault")) == [("a b", "name"), ("s", "channels"), ("t", "agreement")]


def test_draws_and_shards(spark):
    from evalweave.operators import intervals

    x = spark.range(4000).select((F.rand(3) * 10).alias("v"), (F.col("id") % 3 == 0).alias("ok"))
    exact, poisson = (intervals.bootstrap_mean(x, "v", replicates=300, most=m).first() for m in (10_000, 100))
    assert all(abs(a - b) < 0.05 for a, b in zip(exact, poisson)) and 4.8 < poisson["low"] < poisson["high"] < 5.2
    r = intervals.bootstrap_metric(x, ["ok"], lambda k: float((k["ok"] * k["n"]).sum() / k["n"].sum()), replicates=200).first()
    assert abs(r["estimate"] - 1334 / 4000) < 1e-9 and r["low"] < r["estimate"] < r["high"]
    assert intervals.bootstrap_metric(x.limit(3), ["ok"], lambda k: 1.0).first()["low"] is None
    ids = [r["id"] for r in selection.shard(spark.range(1000).repartition(7), ["id"], 4, 1, 20).orderBy("id").collect()]
    assert ids == list(range(1, 80, 4))
    m = selection.mock_samples(spark, 500, TREE)
    assert m.count() == 500 and m.filter("snr_db between -15 and 25 and complexity between 0 and 10").count() == 500 and m.select("l3").distinct().count() == 2
    assert rows(m) == rows(selection.mock_samples(spark, 500, TREE))


def test_files_by_pattern_and_exports(spark, tmp_path):
    import gzip
    import hashlib
    import tarfile

    from evalweave.sources import records, sinks

    for c in "ab":
        (tmp_path / c / "json").mkdir(parents=True)
        (tmp_path / c / "json" / "1.json").write_text('{"id": "%s" /* x */}' % c)
    assert rows(records.by_class(spark, str(tmp_path), "id string").select("class", "id")) == [("a", "a"), ("b", "b")]
    assert records.expand(spark, [f"{tmp_path}/*/json/*.json", f"{tmp_path}/a/json/1.json"]).count() == 2
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception, match="no files|PATH_NOT_FOUND|does not exist"):
        records.expand(spark, [f"{tmp_path}/empty"])
    df = spark.createDataFrame([(k, f"x/{k}.wav", bytes([k])) for k in range(5)], "k int, path string, content binary")
    digests = []
    for n in range(2):
        sinks.write_gzip_lines(df.orderBy(F.rand(n)).select("k"), str(tmp_path / f"gz{n}"), ["k"])
        (f,) = (tmp_path / f"gz{n}").glob("*.gz")
        assert gzip.open(f, "rt").read().count("\n") == 5
        out = sinks.export_tar(df.coalesce(1), str(tmp_path / f"tar{n}"), "path", "content").collect()
        assert [(r["file"], r["members"]) for r in out] == [("export-00000.tar.gz", 5)]
        digests.append((hashlib.sha256(f.read_bytes()).hexdigest(), hashlib.sha256((tmp_path / f"tar{n}" / "export-00000.tar.gz").read_bytes()).hexdigest()))
    assert digests[0] == digests[1]
    with tarfile.open(tmp_path / "tar0" / "export-00000.tar.gz") as t:
        assert t.getnames() == [f"audio/{k}.wav" for k in range(5)] + ["records.jsonl"] and t.extractfile("audio/3.wav").read() == b"\x03"


def test_pictures(spark):
    import numpy as np

    waves = spark.createDataFrame([(k, np.sin(np.arange(800) * 0.1 * (k + 1)).tolist()) for k in range(2)], "k int, v array<double>")
    x = figures.spectra(waves, "k", "v", 8000, 128, 64)
    assert x.agg({"db": "max"}).first()[0] == 0 and x.agg({"db": "min"}).first()[0] == pytest.approx(-60) and x.select("high").distinct().count() == 1
    q = figures.dataset_quality(spark.createDataFrame([("a", k, float(k)) for k in range(5)], "g string, k int, v double"), "g", "k", ["v"], ["v"])
    assert q["counts"].first()["n"] == 5 and q["representatives"].first()["k"] == 2 and q["v_distribution"].count() == 5
