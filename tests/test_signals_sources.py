import numpy as np
import pytest

from evalweave.functions import signals
from evalweave.sources import records, wav


def test_impulses_and_convolution():
    r = np.random.default_rng(1)
    h = signals.impulse_response([0.0, 0.25], [1.0, 0.5], 8, 1.0, fractional=False)
    assert h.tolist() == [1, 0, 0.5, 0, 0, 0, 0, 0]
    assert np.allclose(signals.impulse_response([5.0], [2.0], 8, 10), np.eye(80)[40] * 2, atol=1e-12)  # whole delays stay one tap
    x, y = r.normal(size=50), r.normal(size=9)
    assert np.allclose(signals.convolve(x, y), np.convolve(x, y)[:50])
    assert np.allclose(signals.convolve_by_frequency(x, [200.0, 100.0], [y, y], 1000), np.convolve(x, y)[:50])
    for bad in (np.zeros(4), []):
        with pytest.raises(signals.SignalError):
            signals.convolve(x, bad)


def test_spectra():
    t = np.arange(4000) / 1000
    f, p = signals.welch(np.sin(2 * np.pi * 125 * t), 1000)
    assert f[p.argmax()] == 125 and abs(p.sum() * f[1] - 0.5) < 1e-6
    assert abs(signals.band_centroid(f, p, 400) - 125) < 1e-6
    f, times, power, width = signals.spectrogram(np.sin(2 * np.pi * 125 * t), 1000, 64, 8)
    assert f[power[100].argmax()] == 125 and abs(power[100].max() - 0.5) < 1e-3 and times[0] == 0 and times[-1] <= 4
    assert abs(width - 1.5 * 1000 / 64) < 1e-9
    with pytest.raises(signals.SignalError):
        signals.band_centroid(f, np.zeros(len(f)), 100)
    assert signals.decibels([1, 0], 1).tolist() == [0, -60]


def test_apply(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, []), (3, None)], "k long, v array<double>")
    got = {r["k"]: r for r in signals.apply(df, "k", "v", lambda x: signals.convolve(x, [2.0]).tolist(), "array<double>").collect()}
    assert np.allclose(got[1]["result"], [2, 4]) and got[1]["error"] is None
    assert got[2]["result"] is None and got[3]["error"] == "null"


@pytest.mark.parametrize("bits", [16, 32])
def test_wav(spark, tmp_path, bits):
    x = np.sin(np.arange(100) / 7)
    for name, data in (("a", wav.encode(x, 16000, bits)), ("b", wav.encode(np.zeros(5), 8000, bits)), ("c", b"RIFF"), ("d", wav.encode([], 8000, bits))):
        (tmp_path / f"{name}.wav").write_bytes(data)
    got = {r["path"][-5]: r for r in wav.scan(spark, str(tmp_path)).collect()}
    assert np.allclose(got["a"]["samples"], x, atol=2.0 ** (2 - bits)) and got["a"]["seconds"] == 100 / 16000
    assert got["b"]["error"] == "silent" and got["c"]["error"] and got["d"]["error"] == "no frames" and got["c"]["samples"] is None
    with pytest.raises(ValueError):
        wav.encode([float("nan")], 8000)


def test_json_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('\ufeff{"id": "a", "n": 1}\n\n{"id": "b"}\nnot json\n{"n": 3}\n{"id": "a", "n": 9}\n', encoding="utf-8")
    schema = "id string, n long"
    assert sorted(r["id"] for r in records.permissive(spark, str(p), schema).collect()) == ["a", "a", "b"]
    assert sorted(r["fault"] for r in records.faults(spark, str(p), schema).collect()) == ["blank field", "not an object", "repeated key", "repeated key"]
    with pytest.raises(ValueError):
        records.strict(spark, str(p), schema)
    p.write_text("\n")
    with pytest.raises(ValueError):
        records.strict(spark, str(p), schema)
    p.write_text('{"id": "a"}\n')
    assert records.strict(spark, str(p), schema).count() == 1


def test_comments_and_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonc").write_text('{ // one\n"id": "x//y", /* two\n */ "n": 4, "s": "a\\"/*b*/" }')
    (tmp_path / "in" / "manifest.jsonc").write_text("{}")
    rows = records.commented(spark, str(tmp_path), "id string, n long, s string").collect()
    assert [(r["id"], r["n"], r["s"]) for r in rows] == [("x//y", 4, 'a"/*b*/')]
    (tmp_path / "a.arr").write_text("2\n 1 2 3 4 5 6 7 8\nx 1 2 3 4 5 6 7\n1 2 3\n")
    assert [r["columns"] for r in records.arrivals(spark, str(tmp_path / "a.arr")).collect()] == [[1.0, 2, 3, 4, 5, 6, 7, 8]]
