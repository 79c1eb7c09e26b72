"""Queries that write a table in a format and read it back with the library's own scans."""

from __future__ import annotations

import io
import json
import struct
import tarfile
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.plans.catalogue import query, read
from evalweave.sources import archives, records, settings, sinks, solver, wav
from evalweave.sources.place import shared_folder


def _files(df: DataFrame, out: str, name: str, make) -> str:
    """A file a row of df, written by the tasks."""
    sinks._write_files(df, out, name, make).write.parquet(f"{out}-written")
    return out


@query("SELECT 'o' || o_orderkey AS id, o_orderstatus AS status, CAST(o_totalprice AS DOUBLE) AS price FROM orders")
def jsonl_strict(spark, d):
    out = shared_folder(spark, "jsonl")
    sinks.write_lines(read(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("price")), out)
    return records.strict(spark, out, "id string, status string, price double")


_LINE = "CASE p_partkey % 6 WHEN 0 THEN '{\"id\": \"' || p_partkey || '\", \"size\": ' || p_size || '}' WHEN 1 THEN '[' || p_size || ']' WHEN 2 THEN '{\"id\": \" \", \"size\": 1}' WHEN 3 THEN '   ' WHEN 4 THEN '{\"id\": \"same\", \"size\": 2}' ELSE '{\"id\": \"' END"


def _lines(spark, d) -> str:
    out = shared_folder(spark, "lines")
    read(spark, d, "part").select(F.expr(_LINE).alias("value")).write.text(out)
    return out


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS INT) AS size FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT 'same', 2 FROM part WHERE p_partkey % 6 = 4")
def jsonl_permissive(spark, d):
    return records.permissive(spark, _lines(spark, d), "id string, size int")


@query("SELECT CASE p_partkey % 6 WHEN 1 THEN 'not an object' WHEN 2 THEN 'blank field' WHEN 4 THEN 'repeated key' ELSE 'not an object' END AS fault, count(*) AS n FROM part WHERE p_partkey % 6 IN (1, 2, 4, 5) GROUP BY 1")
def jsonl_faults(spark, d):
    return records.faults(spark, _lines(spark, d), "id string, size int").groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey AS key, n_name AS name, 'http://x/' || n_regionkey AS url FROM nation")
def jsonc_scan(spark, d):
    out = shared_folder(spark, "jsonc")
    n = read(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/"), F.when(F.col("n_nationkey") == -1, "manifest").otherwise("n"), F.col("n_nationkey").cast("string"), F.lit(".jsonc")).alias("file"), "n_nationkey", "n_name", "n_regionkey")
    make = lambda r: f'// {{"key": 1}}\n{{"key": {r["n_nationkey"]}, /* "name": "no", */ "name": {json.dumps(r["n_name"])}, // end\n "url": "http://x/{r["n_regionkey"]}"}}'.encode()
    _files(n, out, "file", make)
    _files(n.limit(1).withColumn("file", F.lit("manifest.jsonc")), out + "/r0", "file", lambda r: b'{"key": -1}')
    return records.commented(spark, out, "key int, name string, url string").select("key", "name", "url")


@query("SELECT l_linenumber AS bounces, count(*) AS n, round(sum(CAST(l_quantity AS DOUBLE)), 4) AS delays FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY 1")
def arrivals_text(spark, d):
    out = shared_folder(spark, "arrivals")
    x = read(spark, d, "lineitem")
    line = F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("'2D' "), F.col("l_quantity").cast("string"))).otherwise(F.concat_ws(" ", F.lit("1.0 0.5"), F.col("l_quantity").cast("double").cast("string"), F.lit("0 -3e-1 .5 "), F.col("l_linenumber").cast("string"), F.lit("2")))
    x.select(line.alias("value")).write.text(out)
    at = lambda i: F.get("columns", F.lit(i))
    return records.arrivals(spark, out).groupBy(at(6).cast("int").alias("bounces")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(at(2)), 4).alias("delays"))


@query("SELECT n_nationkey % 2 AS big, CAST(sum(n_nationkey % 4) AS BIGINT) AS arrivals, CAST(sum((n_nationkey % 4) * n_regionkey) AS BIGINT) AS bounces FROM nation GROUP BY 1")
def arrivals_binary(spark, d):
    out = shared_folder(spark, "binary")
    n = read(spark, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".arr")).alias("file"), "n_nationkey", "n_regionkey")

    def make(r):
        order, k = "<>"[r["n_nationkey"] % 2], r["n_nationkey"] % 4
        return struct.pack(order + "fiiii", 100.0, 1, 1, 1, k) + b"".join(struct.pack(order + "fffffii", 0.5, 0.0, 1.0 + i, 0.0, 0.0, r["n_regionkey"], 0) for i in range(k))

    found = solver.binary_arrivals(spark, _files(n, out, "file", make)).withColumn("big", F.regexp_extract("path", r"(\d+)\.arr$", 1).cast("int") % 2)
    return found.groupBy("big").agg(F.count(F.lit(1)).alias("arrivals"), F.sum("top_bounces").alias("bounces"))


_WAV = "SELECT vec_id, list_transform(embedding, lambda v: greatest(-1.0, least(1.0, CAST(v AS DOUBLE) * 4))) AS v FROM embeddings"


@query(f"SELECT vec_id, 16000::BIGINT AS rate, CAST(len(v) AS BIGINT) AS frames, round(list_max(list_transform(v, lambda x: abs(x))), 4) AS peak, round(list_sum(v), 4) AS total FROM ({_WAV})")
def wav_round_trip(spark, d):
    out = shared_folder(spark, "wav")
    e = read(spark, d, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit(".wav")).alias("file"), F.transform("embedding", lambda v: v.cast("double") * 4).alias("v"), F.lit(16000).alias("rate"))
    sinks.write_wav(e, out, "file", "v", "rate").write.parquet(f"{out}-written")
    v = F.col("samples")
    return wav.scan(spark, out).select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("vec_id"), "rate", "frames", F.round(F.array_max(F.transform(v, F.abs)), 4).alias("peak"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT n_nationkey AS id, CAST(n_regionkey * 30000 + 1 AS BIGINT) AS frames, 'silent' AS error FROM nation")
def silent_wav(spark, d):
    out = shared_folder(spark, "silence")
    n = read(spark, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".wav")).alias("file"), (F.col("n_regionkey") * 30000 + 1).alias("frames"), F.lit(8000).alias("rate"))
    sinks.write_silence(n, out, "file", "frames", "rate").write.parquet(f"{out}-written")
    return wav.scan(spark, out, samples=False).select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("int").alias("id"), "frames", "error")


@query("SELECT r_regionkey AS region, kind, n_nationkey AS nation, strlen(n_name) AS bytes FROM region JOIN nation ON n_regionkey = r_regionkey CROSS JOIN (VALUES ('tar'), ('zip')) v(kind)")
def archive_members(spark, d):
    out = shared_folder(spark, "archives")
    r = read(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("own"))  # as many as nations
    r = r.crossJoin(spark.createDataFrame([("tar",), ("zip",)], "kind string")).withColumn("file", F.concat(F.col("n_regionkey").cast("string"), F.lit("."), "kind"))

    def make(x):
        whole = io.BytesIO()
        if x["kind"] == "zip":
            with zipfile.ZipFile(whole, "w") as z:
                for n in x["own"]:
                    z.writestr(f"a/{n['n_nationkey']}.txt", n["n_name"])
                z.writestr("a/other.bin", b"x")
        else:
            with tarfile.open(fileobj=whole, mode="w") as t:
                for n in x["own"]:
                    data, info = n["n_name"].encode(), tarfile.TarInfo(f"a/{n['n_nationkey']}.txt")
                    info.size = len(data)
                    t.addfile(info, io.BytesIO(data))
                t.addfile(tarfile.TarInfo("a/other.bin"))
        return whole.getvalue()

    found = archives.members(spark, _files(r, out, "file", make), "*.{tar,zip}", ".txt").filter("fault is null")
    named = lambda pattern, c: F.regexp_extract(c, pattern, 1)
    return found.select(named(r"(\d+)\.\w+$", "archive").cast("int").alias("region"), named(r"\.(\w+)$", "archive").alias("kind"), named(r"(\d+)\.txt$", "member").cast("int").alias("nation"), "bytes")


@query("SELECT c_mktsegment AS segment, CAST(count(*) AS VARCHAR) AS n FROM customer GROUP BY 1")
def tsv_report(spark, d):
    out = shared_folder(spark, "tsv")
    records.write_tsv(read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n")), out)
    return spark.read.option("sep", "\t").option("header", True).csv(out)


@query("SELECT s_suppkey, s_name, TRUE AS same, TRUE AS stale FROM supplier")
def cache_round_trip(spark, d):
    out = shared_folder(spark, "cache")
    sinks.write_cache(read(spark, d, "supplier").select("s_suppkey", "s_name"), out, {"supplier": "1"})
    held, stale = sinks.read_cache(spark, out, {"supplier": "1"}), sinks.read_cache(spark, out, {"supplier": "2"})
    return held.withColumn("same", F.lit(True)).withColumn("stale", F.lit(stale is None))


@query("SELECT 'a-b' AS known, '${NOT_SET_ANYWHERE}/x' AS unknown, 3 AS depth")
def settings_expansion(spark, d):
    found = settings.expand({"known": "${A}-${B}", "unknown": "${NOT_SET_ANYWHERE}/x", "deep": [{"n": 3}]}, {"A": "a", "B": "b"})
    return spark.createDataFrame([(found["known"], found["unknown"], found["deep"][0]["n"])], "known string, unknown string, depth int")


@query("SELECT vec_id, CASE vec_id % 4 WHEN 1 THEN 'header' WHEN 2 THEN 'seconds' ELSE 'no file' END AS fault FROM embeddings WHERE vec_id % 4 > 0")
def wav_audit(spark, d):
    out = shared_folder(spark, "audited")
    e = read(spark, d, "embeddings").select("vec_id", F.concat(F.col("vec_id").cast("string"), F.lit(".wav")).alias("file"), F.transform("embedding", lambda v: v.cast("double")).alias("v"), F.lit(16000).alias("rate"))
    sinks.write_wav(e.filter("vec_id % 4 < 3"), out, "file", "v", "rate", bits=16).write.parquet(f"{out}-written")
    found = wav.scan(spark, out, samples=False).withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1))
    frames = F.size("v") + (F.col("vec_id") % 4 == 1).cast("int")
    own = e.select("vec_id", F.col("file").alias("path"), F.col("rate").cast("long").alias("rate"), frames.cast("long").alias("frames"), (frames / F.col("rate") + (F.col("vec_id") % 4 == 2).cast("int")).alias("seconds"))
    return wav.audit_faults(found, own).join(own.select("path", "vec_id"), "path").select("vec_id", "fault")
