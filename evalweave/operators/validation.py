"""What must hold before figures are computed: each check gives the rows that break it, so an empty frame is a pass.

Checks are joins and aggregates on keys; nothing is collected but the first faults that an error names.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signature(identity: dict) -> str:
    """A run's identity as a digest: the same for the same fields in any order."""
    return hashlib.sha256(json.dumps(identity, sort_keys=True).encode()).hexdigest()


def require_none(faults: DataFrame, what: str, show: int = 10) -> None:
    bad = faults.limit(show).collect()
    if bad:
        raise ValueError(f"{what}: " + "; ".join(", ".join(str(v) for v in r) for r in bad))


def first_fault(*checks: tuple[str, Column]) -> Column:
    """The name of the first check that is not true (null counts as not true); null if all are."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks])


def repeated(df: DataFrame, key: str) -> DataFrame:
    """key, n of keys that stand more than once, null among them."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def uncovered(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, side: keys of one side only."""
    ka, kb = a.select(key).distinct(), b.select(key).distinct()
    return ka.join(kb, key, "left_anti").withColumn("side", F.lit("first")).unionByName(kb.join(ka, key, "left_anti").withColumn("side", F.lit("second")))


def values_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many values, null included, each column that should have one has."""
    return df.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns])


def prediction_faults(predictions: DataFrame, manifest: DataFrame) -> DataFrame:
    """id, fault of predictions against their manifest.

    predictions: id, run_signature, l1, l2, l3 (the truth they were scored by), prompt_1..3, pred_1, skipped.
    manifest: id, l1, l2, l3, questions array<string>. Coverage and repeats first, then each row's truth, three questions,
    the first prompt, the gate (skipped exactly where the first answer is wrong) and the prompts behind it.
    """
    signed = predictions.groupBy("run_signature").agg(F.count(F.lit(1)).alias("n"))
    most = F.broadcast(signed.agg(F.max_by("run_signature", F.struct("n", "run_signature")).alias("_signature")))  # one row
    m = manifest.select("id", *[F.col(c).alias(f"m_{c}") for c in ("l1", "l2", "l3")], "questions")
    q = lambda i: F.when(F.col("skipped"), "").otherwise(F.get("questions", F.lit(i)))
    fault = first_fault(
        ("run signature", F.col("run_signature") == F.col("_signature")),
        ("truth", reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in ("l1", "l2", "l3")])),
        ("three questions", F.size("questions") == 3),
        ("first prompt", F.col("prompt_1") == F.get("questions", F.lit(0))),
        ("gate", F.col("skipped") == (F.col("pred_1") != F.col("l1"))),
        ("later prompts", (F.col("prompt_2") == q(1)) & (F.col("prompt_3") == q(2))),
    )
    rows = predictions.join(m, "id").crossJoin(most).select("id", fault.alias("fault")).filter("fault is not null")
    sides = uncovered(predictions, manifest, "id").select("id", F.when(F.col("side") == "first", "not in the manifest").otherwise("no prediction").alias("fault"))
    return sides.unionByName(repeated(predictions, "id").select("id", F.lit("repeated").alias("fault"))).unionByName(rows)


def protocol_faults(protocols: DataFrame, predictions: DataFrame) -> DataFrame:
    """fault of a run's protocols (run_signature, manifest_sha256, shard_index, num_shards) and the predictions' own
    run_signature, shard_index, num_shards. Protocols are a row a shard.
    """
    p = protocols.agg(
        F.count_distinct("run_signature").alias("signatures"), F.count_distinct("manifest_sha256").alias("manifests"), F.count_distinct("num_shards").alias("sizes"),
        F.count(F.lit(1)).alias("n"), F.count_distinct("shard_index").alias("shards"), F.min("shard_index").alias("low"), F.max("shard_index").alias("high"), F.max("num_shards").alias("k"),
        F.max("run_signature").alias("signature"),
    )
    one = lambda c: F.col(c) == 1
    whole = (F.col("n") == F.col("k")) & (F.col("shards") == F.col("k")) & (F.col("low") == 0) & (F.col("high") == F.col("k") - 1)
    own = p.select(first_fault(("run signature", one("signatures")), ("manifest", one("manifests")), ("number of shards", one("sizes")), ("shard coverage", whole)).alias("fault")).filter("fault is not null")
    strange = predictions.select("run_signature", "shard_index", "num_shards").distinct().crossJoin(F.broadcast(p.select("signature", "k")))
    ok = (F.col("run_signature") == F.col("signature")) & (F.col("shard_index") >= 0) & (F.col("shard_index") < F.col("k")) & (F.col("num_shards") == F.col("k"))
    rows = strange.filter(~F.coalesce(ok, F.lit(False))).select(F.concat(F.lit("predictions of shard "), F.coalesce(F.col("shard_index").cast("string"), F.lit("null"))).alias("fault"))
    return own.unionByName(rows)


def paired_faults(a: DataFrame, b: DataFrame, key: str, besides: list[str]) -> DataFrame:
    """key, fault of two manifests that may differ in the columns `besides` only (null equals null)."""
    same = sorted(set(a.columns) & set(b.columns) - {key, *besides})
    j = a.select(key, *[F.col(c).alias(f"_a_{c}") for c in same]).join(b.select(key, *[F.col(c).alias(f"_b_{c}") for c in same]), key)
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), c) for c in same]))
    rows = j.select(key, F.array_join(differ, ",").alias("fault")).filter("fault <> ''")
    return rows.unionByName(uncovered(a, b, key).select(key, F.concat("side", F.lit(" only")).alias("fault")))


def figure_faults(saved: DataFrame, computed: DataFrame, key: str, values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """key, fault: saved figures that are missing or differ from computed ones by more than the tolerance."""
    j = computed.select(key, *[F.col(c).alias(f"_c_{c}") for c in values]).join(saved.select(key, *values), key, "full_outer")
    near = lambda c: F.col(c).eqNullSafe(F.col(f"_c_{c}")) | F.coalesce(F.abs(F.col(c) - F.col(f"_c_{c}")) <= tolerance, F.lit(False))
    return j.select(key, F.array_join(F.array_compact(F.array(*[F.when(~near(c), c) for c in values])), ",").alias("fault")).filter("fault <> ''")


def content_faults(used: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """key, fault: used files (key, bytes, sha256) that are not in an index of them, or differ from it."""
    i = index.select(key, F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    return used.join(i, key, "left").select(key, first_fault(("not in the index", F.col("_sha").isNotNull()), ("bytes", F.col("bytes") == F.col("_bytes")), ("sha256", F.col("sha256") == F.col("_sha"))).alias("fault")).filter("fault is not null")


def resolved_audio(records: DataFrame, files: DataFrame, key: str = "id", path: str = "wav_path") -> DataFrame:
    """records with `audio` and `audio_fault`: the declared path if it is among files (path relative to the root), or else the
    only file named after the key. A path outside the root, no file or several is a fault.
    """
    names = files.select(F.col("path").alias("_file"), F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("_stem"))
    declared = F.regexp_replace(F.translate(F.col(path), "\\", "/"), r"^(\./)+", "")
    by_stem = names.filter("_stem <> ''").groupBy("_stem").agg(F.count(F.lit(1)).alias("_n"), F.min("_file").alias("_only"))
    r = records.withColumn("_declared", declared)
    r = r.join(names.select(F.col("_file").alias("_declared"), F.lit(True).alias("_there")).distinct(), "_declared", "left").join(by_stem, r[key] == F.col("_stem"), "left")
    outside = F.col("_declared").rlike(r"^/|(^|/)\.\.(/|$)|^[A-Za-z]:")
    fault = F.when(F.coalesce(F.trim("_declared"), F.lit("")) == "", "no path").when(outside, "outside the root").when(F.col("_there"), None).when(F.col("_n").isNull(), "no file").when(F.col("_n") > 1, "several files")
    r = r.withColumn("audio_fault", fault).withColumn("audio", F.when(F.col("audio_fault").isNull(), F.when(F.col("_there"), F.col("_declared")).otherwise(F.col("_only"))))
    return r.drop("_declared", "_there", "_stem", "_n", "_only")


def source_faults(records: DataFrame, source: str, channel: str, fields: list[str]) -> DataFrame:
    """source, fault: sources whose channels differ in a field (null equals null), or have a null, negative or repeated channel.

    One pass: a source's channels are reduced to counts of distinct values.
    """
    own = records.groupBy(source).agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct(channel).alias("_channels"), F.min(channel).alias("_least"), F.count(channel).alias("_named"),
        *[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"_v_{c}") for c in fields],
    )
    channels = (F.col("_named") == F.col("_n")) & (F.col("_channels") == F.col("_n")) & (F.col("_least") >= 0)
    differ = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_v_{c}") > 1, c) for c in fields])), ",")
    name = F.col(source).cast("string").rlike(r"^[A-Za-z0-9_-]+$")
    return own.select(source, first_fault(("name", name), ("channels", channels), ("agreement", differ == "")).alias("fault"), differ.alias("differ")).filter("fault is not null")


def received_faults(received: DataFrame, sources: DataFrame, headers: DataFrame, lengths: list[str], references: list[str]) -> DataFrame:
    """id, fault of received records (id, source_id, l3, params, rate, frames, lengths..., reference, delay) against their source
    (source_id, l3, params, file) and the header of its file (source_id, rate, frames, channels).

    lengths are columns that must be positive numbers; reference is one of references; delay isn't negative.
    """
    s = sources.select("source_id", F.col("l3").alias("_l3"), F.col("params").alias("_params"), F.col("file").alias("_file"))
    h = headers.select("source_id", F.col("rate").alias("_rate"), F.col("frames").alias("_frames"), F.col("channels").alias("_channels"))
    j = received.join(s, "source_id", "left").join(h, "source_id", "left")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.col(c).cast("double") < float("inf"))
    fault = first_fault(
        ("no source", F.col("_file").isNotNull()),
        ("source file", F.regexp_extract(F.translate("_file", "\\", "/"), r"([^/]*)$", 1) == F.concat("source_id", F.lit(".wav"))),
        ("class", F.col("l3") == F.col("_l3")),
        ("parameters", F.col("params").eqNullSafe(F.col("_params"))),
        ("header", (F.col("_channels") == 1) & (F.col("rate") == F.col("_rate")) & (F.col("frames") == F.col("_frames"))),
        ("geometry", reduce(lambda a, b: a & b, [finite(c) & (F.col(c) > 0) for c in lengths])),
        ("time reference", F.col("reference").isin(*references)),
        ("delay", finite("delay") & (F.col("delay") >= 0)),
    )
    return j.select("id", fault.alias("fault")).filter("fault is not null")


def first_audio(records: DataFrame, files: DataFrame, key: str = "id", label: str = "l3") -> DataFrame:
    """records with audio, the file label/key.wav or else the first by path of the files named key.wav, and n_audio, how many of
    that name there are (0 to many: an ambiguity is allowed, and seen).
    """
    f = files.select(F.col("path").alias("_path"), F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("_stem")).filter("_stem <> ''")
    by_name = f.groupBy("_stem").agg(F.min("_path").alias("_first"), F.count(F.lit(1)).alias("_n"))
    direct = F.concat_ws("/", F.col(label), F.concat(F.col(key), F.lit(".wav")))
    r = records.withColumn("_direct", direct).join(f.select(F.col("_path").alias("_direct"), F.lit(True).alias("_there")).distinct(), "_direct", "left")
    r = r.join(by_name, F.col(key) == F.col("_stem"), "left")
    return r.withColumn("audio", F.when(F.col("_there"), F.col("_direct")).otherwise(F.col("_first"))).withColumn("n_audio", F.coalesce("_n", F.lit(0))).drop("_direct", "_there", "_stem", "_first", "_n")


def optional_path(path: Column, root: str) -> Column:
    """A path as it is if it is absolute, else below the root; null for none."""
    own = F.translate(F.trim(path), "\\", "/")
    return F.when(own.rlike("^(/|[A-Za-z]:/)"), own).when(F.coalesce(own, F.lit("")) != "", F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(own, r"^(\./)+", "")))


def header_registration(manifest: DataFrame, index: DataFrame, labels: list[str]) -> DataFrame:
    """id, fault: records of the manifest that the header index lacks, or whose labels differ there; and ids that it has twice."""
    i = index.select("id", *[F.col(c).alias(f"_i_{c}") for c in labels], F.lit(True).alias("_there"))
    j = manifest.join(i, "id", "left")
    fault = first_fault(("no header", F.col("_there")), *[(f"label {c}", F.col(c).eqNullSafe(F.col(f"_i_{c}"))) for c in labels])
    return j.select("id", fault.alias("fault")).filter("fault is not null").unionByName(repeated(index, "id").select("id", F.lit("repeated").alias("fault")))


def header_sidecar(manifest: DataFrame, index: DataFrame, sources: DataFrame, how: str) -> DataFrame:
    """One row that binds a header index to what it was made from: digests and counts of the manifest, the index and the
    sources' signatures (path, bytes, modified). Digests don't depend on the order of rows.
    """
    digest = lambda df, name: df.agg(F.count(F.lit(1)).alias(f"{name}_rows"), F.sha2(F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string"), 256).alias(f"{name}_digest"))
    one = digest(manifest, "manifest").crossJoin(digest(index, "index")).crossJoin(digest(sources, "sources"))  # one row each
    return one.withColumn("verification", F.lit(how)).withColumn("schema_version", F.lit(1))


def sidecar_faults(saved: DataFrame, manifest: DataFrame, index: DataFrame, sources: DataFrame) -> DataFrame:
    """fault: what a saved sidecar has that isn't so any more; 'no sidecar' without one."""
    now = header_sidecar(manifest, index, sources, "now")
    j = now.select(*[F.col(c).alias(f"_{c}") for c in now.columns]).join(saved.limit(2), F.lit(True), "left")
    names = [c for c in now.columns if c != "verification"]
    faults = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in names]))
    return j.select(F.explode(F.when(F.col("schema_version").isNull(), F.array(F.lit("no sidecar"))).otherwise(faults)).alias("fault"))


def missing_classes(df: DataFrame, column: str, classes: list[str]) -> DataFrame:
    """Those of the classes that no row has."""
    return df.sparkSession.createDataFrame([(c,) for c in classes], f"{column} string").join(df.select(column).distinct(), column, "left_anti")


def relocated(used: DataFrame, moves: DataFrame, path: str) -> DataFrame:
    """used with its paths as they are now: moves (old, new) names files that were moved, or folders by a trailing slash; the
    longest that fits holds. Folders are looked up by each path's own prefixes, so this is an equi-join.
    """
    m = moves.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    parts = F.split("_path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    own = used.select(F.col(path).alias("_path")).distinct().select("_path", F.explode(F.array_append(folders, F.col("_path"))).alias("_old"))
    best = own.join(m, "_old").groupBy("_path").agg(F.max_by(F.struct("_old", "_new"), F.length("_old")).alias("_m"))
    moved = F.concat(F.col("_m._new"), F.substr(F.col(path), F.length("_m._old") + 1))
    out = used.join(best, F.col(path) == F.col("_path"), "left").withColumn("_now", F.coalesce(moved, F.col(path)))
    return out.select(*[F.col("_now").alias(path) if c == path else F.col(c) for c in used.columns])


def external_metadata(records: DataFrame, documents: DataFrame, path: Column, key: str = "id") -> DataFrame:
    """records with meta and meta_from: the document (path, meta) at the record's own path, or else the only one named after its
    key; null, and 'none' or 'several', where that fails.
    """
    d = documents.select(F.col("path").alias("_at"), F.col("meta").alias("_direct"))
    named = documents.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("_stem"), "meta").groupBy("_stem").agg(F.count(F.lit(1)).alias("_n"), F.min("meta").alias("_only"))
    j = records.withColumn("_at", path).join(d, "_at", "left").join(named, F.col(key) == F.col("_stem"), "left")
    origin = F.when(F.col("_direct").isNotNull(), "path").when(F.col("_n") == 1, "name").when(F.col("_n") > 1, "several").otherwise("none")
    return j.withColumn("meta", F.coalesce("_direct", F.when(F.col("_n") == 1, F.col("_only")))).withColumn("meta_from", origin).drop("_at", "_direct", "_stem", "_n", "_only")


def with_headers(records: DataFrame, index: DataFrame, scanned: DataFrame, key: str = "audio") -> DataFrame:
    """records with rate, frames and header_from: by the header index, or else by a scan of the files; 'none' without either."""
    side = lambda df, x: df.select(key, F.col("rate").alias(f"_rate_{x}"), F.col("frames").alias(f"_frames_{x}"))
    j = records.join(side(index, "i"), key, "left").join(side(scanned, "s"), key, "left")
    origin = F.when(F.col("_rate_i").isNotNull(), "index").when(F.col("_rate_s").isNotNull(), "file").otherwise("none")
    pick = lambda c: F.when(F.col("_rate_i").isNotNull(), F.col(f"_{c}_i")).otherwise(F.col(f"_{c}_s"))
    return j.select(*records.columns, pick("rate").alias("rate"), pick("frames").alias("frames"), origin.alias("header_from"))
