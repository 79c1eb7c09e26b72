import json

from pyspark.sql import functions as F

from evalweave.operators import validation
from evalweave.plans import catalogue, runs
from evalweave.sources import wav


def test_figure_records(spark):
    m = lambda **k: json.dumps(k)
    rows = [
        ("a_ch1", "a.wav", "active", "pulse", "lfm", m(signal_params={"center_freq_hz": 5}, output={"tl_db": -3, "snr_db": 9})),
        ("s_CH2", "s.wav", "passive", "ship_noise", "cargo_ship", m(signal_params={"center_freq_hz": 5}, output={"tl_db": -3, "snr_db": 9})),
        ("x", "s.wav", "active", "ship_noise", "cargo", None),
        ("y", "gone.wav", "active", "pulse", "CW", ""),
    ]
    r = spark.createDataFrame(rows, "id string, audio string, l1 string, l2 string, l3 string, meta string")
    h = spark.createDataFrame([("a.wav", 8000, 4000), ("s.wav", 8000, 8000)], "audio string, rate long, frames long")
    got = {x["id"]: x for x in runs.figure_records(r, h, "output").collect()}
    assert tuple(got["a_ch1"])[1:] == ("a", "active", "pulse", "LFM", 5.0, "signal_params.center_freq_hz", -3.0, None, 8000, 4000, 0.5, None)
    assert tuple(got["s_CH2"])[1:] == ("s", "passive", "ship_noise", "cargo", None, None, None, 9.0, 8000, 8000, 1.0, None)
    assert (got["x"]["fault"], got["y"]["fault"]) == ("label path", "no header")


def test_dataset_keeps_a_source_in_one_split(spark, tmp_path):
    rows = [(f"s{i // 3}_ch{i % 3}", json.dumps({"signal_category": "pulse", "signal_type": "CW"})) for i in range(300)] + [("u", "{}"), ("n", None)]
    df = spark.createDataFrame(rows, "id string, meta string")
    data = runs.dataset(df, [["a?"], ["{L1}?"], ["why?"]], ["{L3}."])
    got = data.collect()
    assert len(got) == 300 and max(len({r["split"] for r in got if r["source_id"] == f"s{i}"}) for i in range(100)) == 1
    assert {s: len({r["source_id"] for r in got if r["split"] == s}) for s in ("train", "val", "test")} == {"train": 70, "val": 15, "test": 15}
    runs.write_dataset(data, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).count() == 300 and (tmp_path / "d/split=val").is_dir()


def test_silent_control(spark, tmp_path):
    r = spark.createDataFrame([("a", "x/a.wav", 1), ("b", "x/b.wav", None)], "id string, audio string, extra long")
    h = spark.createDataFrame([("x/a.wav", 8000, 5, "h1"), ("x/b.wav", 16000, 7, "h2")], "audio string, rate long, frames long, sha256 string")
    got = runs.silent_control(r, h, str(tmp_path / "o"))
    pairs = {p["id"]: p for p in got["pairs"].collect()}
    rate, _, _, samples = wav.decode((tmp_path / "o" / pairs["b"]["silent_audio"]).read_bytes())
    assert rate == 16000 and len(samples) == 7 and not samples.any()
    assert validation.paired_faults(got["original"], got["silent"], "id", ["audio"]).count() == 0
    assert {x["audio"] for x in got["silent"].collect()} == {p["silent_audio"] for p in pairs.values()}


def test_results_of_runs(spark):
    p = catalogue.predictions(spark, "/root/testdata/sf0.001")
    got = runs.results({"one": p, "two": p.withColumn("pred", F.col("truth")).withColumn("ok3", F.lit(True))}, catalogue.CLASSES)
    s = {r["run"]: r for r in got["summary"].collect()}
    assert s["two"]["l3_accuracy"] == 1 and s["two"]["l3_macro_f1"] == 1 and s["one"]["l3_accuracy"] < 1
    assert got["diagnostics"].count() == 2 * 5 * 7 and {r["run"] for r in got["outcomes"].collect()} == {"one", "two"}
