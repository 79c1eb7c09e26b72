"""The command line, on small runs."""

import json

from evalweave import __main__ as command

TABLES = "/root/testdata/sf0.001"


def test_list_and_run(spark, tmp_path, capsys):
    assert command.main(["list"]) == 0
    names = capsys.readouterr().out.splitlines()
    assert "level_metrics" in names and "identity_seed (without SQL)" in names
    assert command.main(["run", "level_metrics", TABLES, "--out", str(tmp_path / "m")]) == 0
    assert spark.read.parquet(str(tmp_path / "m")).count() == 6
    assert command.main(["run", "nothing", TABLES]) == 2


def test_merge_and_report(spark, tmp_path):
    one = lambda i, s: {"id": i, "run_signature": "r", "l1": "p", "l2": "x", "l3": "a", "prompt_1": "1", "prompt_2": "2", "prompt_3": "3", "pred_1": "p", "pred_2": "x", "pred_3": "a", "skipped": False, "shard_index": s, "num_shards": 2}
    files = {"s0.jsonl": [one("i0", 0)], "s1.jsonl": [one("i1", 1)], "m.jsonl": [{"id": i, "l1": "p", "l2": "x", "l3": "a", "questions": ["1", "2", "3"]} for i in ("i0", "i1")], "p.jsonl": [{"run_signature": "r", "manifest_sha256": "m", "shard_index": s, "num_shards": 2} for s in (0, 1)]}
    for name, rows in files.items():
        (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    at = lambda name: str(tmp_path / name)
    rest = ["--manifest", at("m.jsonl"), "--protocols", at("p.jsonl"), "--out"]
    assert command.main(["merge", at("s0.jsonl"), *rest, at("bad")]) == 1 and not (tmp_path / "bad").exists()
    assert command.main(["merge", at("s0.jsonl"), at("s1.jsonl"), *rest, at("all")]) == 0
    assert spark.read.parquet(at("all/rows")).count() == 2
    spark.createDataFrame([("a", "a", True, True, True), ("a", "b", True, False, False)], "truth string, pred string, ok1 boolean, ok2 boolean, ok3 boolean").write.parquet(at("preds"))
    assert command.main(["report", at("preds"), "--out", at("r.md")]) == 0
    assert "## 2. Classes" in (tmp_path / "r.md").read_text()
