import io
import json
import struct
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.operators import labels, validation
from evalweave.sources import archives, settings, sinks, solver, wav


def arrivals_file(order, arrivals):
    return struct.pack(order + "fiii", 50.0, 1, 1, 2) + struct.pack(order + "i", 0) + struct.pack(order + "i", len(arrivals)) + b"".join(struct.pack(order + "fffffii", *a) for a in arrivals)


ARRIVALS = [(0.5, -0.25, 1.5, 10.0, -10.0, 1, 2), (0.25, 0.0, 2.5, 20.0, -20.0, 0, 1)]


@pytest.mark.parametrize("order", ["<", ">"])
def test_arrivals_of_either_byte_order(order):
    data = arrivals_file(order, ARRIVALS)
    assert solver.parse(data, order) == [(d, r, i, a, b, t, o) for r, i, d, a, b, t, o in ARRIVALS]
    assert len(solver.parse(data[:-3], order)) == 1  # cut short
    assert solver.parse(b"abc", order) is None


def test_binary_arrivals_scan(spark, tmp_path):
    (tmp_path / "a.arr").write_bytes(arrivals_file("<", ARRIVALS))
    (tmp_path / "b.arr").write_bytes(arrivals_file(">", ARRIVALS[:1]))
    (tmp_path / "c.arr").write_bytes(b"not arrivals at all, but long enough")
    rows = solver.binary_arrivals(spark, str(tmp_path)).collect()
    assert sorted((r["path"][-5], r["delay_s"], r["top_bounces"], r["error"]) for r in rows if r["error"] is None) == [("a", 1.5, 1, None), ("a", 2.5, 0, None), ("b", 1.5, 1, None)]
    assert [r["path"][-5] for r in rows if r["error"]] == ["c"]
    sizes = solver.binary_arrivals(spark, str(tmp_path)).filter("error is null").select(solver.derived(F.col("amplitude_real"), F.col("amplitude_imag"))["linear"].alias("v"))
    assert max(r["v"] for r in sizes.collect()) == pytest.approx(np.hypot(0.5, 0.25))


def test_solver_input_and_run(spark):
    depths, speeds = [30.0, 0.0, 10.0, 10.0, float("nan")], [1520.0, 1500.0, 1510.0, 1.0, 1.0]
    z, c = solver.trimmed_profile(depths, speeds, 20.0)
    assert z.tolist() == [0, 10, 20] and c.tolist() == [1500, 1510, 1515]
    text = solver.input_text("t", 50.0, depths, speeds, 20.0, 5.0, 6.0, 2.0).split("\n")
    assert text[0] == "'t'" and text[4].startswith("3  ") and text[-2] == "0.0  21.00  2.1000"
    with pytest.raises(ValueError):
        solver.input_text("t", 50.0, depths, speeds, 20.0, 25.0, 6.0, 2.0)

    two, none = arrivals_file("<", ARRIVALS), arrivals_file("<", [])

    def fake(text):
        if "bad" in text:
            raise RuntimeError("timeout")
        return two if "two" in text else none

    df = spark.createDataFrame([(1, "two"), (2, "none"), (3, "bad")], "id long, text string")
    got = sorted((r["id"], r["error"] or "", r["delay_s"] or 0) for r in solver.run(df, "id", "text", fake).collect())
    assert got == [(1, "", 1.5), (1, "", 2.5), (2, "no arrivals", 0), (3, "timeout", 0)]


def test_settings(tmp_path):
    (tmp_path / "a.yaml").write_text("root: ${HERE}/x\nlist: ['${GONE}', 2]\nio: {cache: sub/c}\n")
    got = settings.load(str(tmp_path / "a.yaml"), ("io.cache", "io.none"), {"HERE": "/h"})
    assert got == {"root": "/h/x", "list": ["${GONE}", 2], "io": {"cache": str(tmp_path / "sub/c")}}
    (tmp_path / "b.json").write_text("[1]")
    with pytest.raises(ValueError):
        settings.load(str(tmp_path / "b.json"))


def test_cache_is_read_only_if_whole_and_of_the_same_inputs(spark, tmp_path):
    df, at = spark.range(100).withColumn("v", F.when(F.col("id") % 3 > 0, F.col("id").cast("string"))), str(tmp_path / "c")
    assert sinks.read_cache(spark, at, {"a": "1"}) is None
    sinks.write_cache(df, at, {"a": "1"})
    assert sinks.read_cache(spark, at, {"a": "1"}).count() == 100
    assert sinks.read_cache(spark, at, {"a": "2"}) is None
    df.limit(99).write.mode("overwrite").parquet(f"{at}/data")
    assert sinks.read_cache(spark, at, {"a": "1"}) is None
    assert sinks.content_digest(df) == sinks.content_digest(df.repartition(7)) != sinks.content_digest(df.limit(99))


def test_wav_silence_and_export(spark, tmp_path):
    df = spark.createDataFrame([("a.wav", [0.5, -0.5], 8000, 3), ("b.wav", [2.0, 0.25], 8000, 5)], "name string, x array<double>, rate int, n int")
    assert sinks.write_wav(df, str(tmp_path / "w"), "name", "x", "rate").count() == 2
    assert wav.decode((tmp_path / "w/b.wav").read_bytes())[3][:, 0] == pytest.approx([1.0, 0.25], abs=1e-6)
    sinks.write_silence(df, str(tmp_path / "s"), "name", "n", "rate").collect()
    assert [len(wav.decode((tmp_path / "s" / f).read_bytes())[3]) for f in ("a.wav", "b.wav")] == [3, 5]
    assert sorted(f.name for f in (tmp_path / "s").iterdir()) == ["a.wav", "b.wav"]
    files = spark.createDataFrame([(1, "x\\y\\a.wav", b"12"), (2, "b.wav", b"345")], "id long, audio string, data binary")
    assert sinks.export(files, str(tmp_path / "e"), "audio", "data").agg(F.sum("bytes")).first()[0] == 5
    assert sorted(r["audio"] for r in spark.read.json(str(tmp_path / "e/records")).collect()) == ["audio/a.wav", "audio/b.wav"]
    assert (tmp_path / "e/audio/b.wav").read_bytes() == b"345"


def test_report(spark):
    text = sinks.report("R", [("Classes", spark.createDataFrame([("a|b", 0.5), (None, 1.0)], "c string, v double"))], ["one"])
    assert "| a\\|b | 0.5000 |" in text and "|  | 1.0000 |" in text and text.endswith("- one\n")
    with pytest.raises(ValueError):
        sinks.markdown_table(spark.range(20), 10)
    assert sinks.fresh("out") != sinks.fresh("out")


def _tar(members, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members:
            m = tarfile.TarInfo(name)
            m.size = len(data)
            t.addfile(m, io.BytesIO(data))
    return out.getvalue()


def test_nested_archives(spark, tmp_path):
    inner = _tar([("r.json", b"{}"), ("../up.json", b"1")])
    (tmp_path / "a.tar.gz").write_bytes(_tar([("x.json", b"[1]"), ("in.tar.gz", inner), ("n.txt", b"")]))
    (tmp_path / "b.tar.gz").write_bytes(_tar([(f"{i}.tar.gz", _tar([("r.json", b"1")])) for i in range(6)]))
    rows = archives.members(spark, str(tmp_path), "*.tar.gz", (".json", ".jsonl"), nested=True).collect()
    a = sorted((r["member"], r["fault"]) for r in rows if r["archive"].endswith("a.tar.gz"))
    assert a == [("in/../up.json", "path"), ("in/r.json", None), ("x.json", None)]
    b = [r for r in rows if r["archive"].endswith("b.tar.gz")]
    assert len([r for r in b if r["fault"] is None]) == 4 and [r["fault"] for r in b if r["fault"]] == ["too many nested archives"]


def test_checks_of_empty_tables_and_nulls(spark):
    none = spark.createDataFrame([], "id string, v double")
    some = spark.createDataFrame([("a", 1.0), ("a", 1.0), (None, None)], "id string, v double")
    assert validation.repeated(none, "id").count() == 0 and [r["n"] for r in validation.repeated(some, "id").collect()] == [2]
    assert validation.uncovered(some, none, "id").count() == 2
    assert validation.values_of(some, ["id", "v"]).first().asDict() == {"id": 2, "v": 2}
    validation.require_none(none, "none")
    with pytest.raises(ValueError, match="some"):
        validation.require_none(some, "some")
    assert validation.signature({"a": 1, "b": 2}) == validation.signature({"b": 2, "a": 1})
    a = spark.createDataFrame([("x", 0.5), ("y", None)], "k string, f double")
    b = spark.createDataFrame([("x", 0.5 + 1e-14), ("z", 1.0)], "k string, f double")
    # y has no figure on either side and agrees; z was never saved
    assert sorted(r["k"] for r in validation.figure_faults(a, b, "k", ["f"]).collect()) == ["z"]


def test_broken_metadata_gives_nulls(spark):
    docs = [None, "", "not json", "[]", "{}", json.dumps({"signal_params": 3, "geometry": [], "signal_category": None})]
    df = spark.createDataFrame([(d,) for d in docs], "m string")
    m = F.col("m")
    rows = df.select(labels.key_labels(m).alias("k"), labels.geometry(m).alias("g"), labels.solver_frequency(m).alias("f"), labels.source_frequency(m, F.lit("CW")).alias("s"), labels.channel_metrics(m, "env", "output").alias("c")).collect()
    assert all(tuple(r["k"]) == ("unknown",) * 3 and set(r["g"]) == {None} and r["f"] is None and r["s"] is None and set(r["c"]) == {None} for r in rows)


def test_ship_phrases(spark):
    from evalweave.functions import evidence

    lines = [{"frequency_hz": 40, "source_type": "Shaft_Harmonic"}, {"frequency_hz": "300", "source_type": "blade_harmonic"}, {"frequency_hz": None}]
    docs = {
        "all": {"signal_params": {"lines": lines, "shaft_mod_coeff": 0.1, "blade_mod_coeff": 0.05}},
        "range": {"signal_params": {"line_frequency_range_hz": [10, 240], "num_lines": 9}},
        "none": {},
        "odd": {"signal_params": {"lines": 3, "num_lines": "x"}},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()] + [("null", None)], "k string, m string")
    got = {r["k"]: r["e"] for r in df.select("k", evidence.evidence(F.lit("cargo"), F.col("m"), F.col("k")).alias("e")).collect()}
    assert got["all"][:2] == ["tonal components spread across the low-to-mid-frequency band", "sparse discrete tonal structure"]
    assert {w for w in ("shaft- and blade-rate-related harmonic lines", "moderate periodic amplitude modulation") if w in got["all"][2]} == {"shaft- and blade-rate-related harmonic lines", "moderate periodic amplitude modulation"}
    assert got["range"][:2] == ["tonal components concentrated in the low-frequency band", "dense discrete tonal structure"]
    for k in ("none", "odd", "null"):
        assert got[k][:2] == ["broadband-plus-tonal vessel noise", "discrete machinery tonal components"], k
    sweeps = df.select(evidence.evidence(F.lit("LFM"), F.lit('{"signal_params": {"sweep_direction": " Up "}}'), F.col("k")).alias("e")).collect()
    assert all(r["e"][2] in ("linear upsweep", "frequency increases linearly with time") for r in sweeps)
    assert df.select(evidence.evidence(F.lit("other"), F.col("m"), F.col("k")).alias("e")).filter("e is not null").count() == 0
