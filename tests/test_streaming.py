from evalweave.streaming import confusion


def test_batches_count_once(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    rows = lambda *r: spark.createDataFrame(r, "truth string, pred string, more long").coalesce(1).write.mode("append").parquet(source)
    for new, want in (([("a", "a", 1), ("a", "b", 2)], {("a", "a"): 1, ("a", "b"): 1}), ([("a", "a", 3), (None, "a", 4)], {("a", "a"): 2, ("a", "b"): 1, (None, "a"): 1})):
        rows(*new)
        for _ in range(2):  # the second run finds nothing new
            q = confusion.count_stream(spark, source, "truth string, pred string, more long", out, mark, 1)
            q.awaitTermination(60)
            assert q.exception() is None and not q.isActive
        assert {(r["truth"], r["pred"]): r["n"] for r in confusion.totals(spark, out).collect()} == want


def test_pending(spark):
    a = spark.createDataFrame([("x", 1), ("y", None), ("z", 1)], "id string, version long")
    done = spark.createDataFrame([("x", 1), ("y", None), ("z", 2)], "id string, version long")
    assert [r["id"] for r in confusion.pending(a, done, ["id", "version"]).collect()] == ["z"]
    assert confusion.pending(a, done.limit(0), ["id", "version"]).count() == 3
