"""Whole runs put together from the operators: records for figures, a dataset with dialogues and splits, silent controls, results of several runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.functions import evidence, text
from evalweave.operators import labels, metrics, selection, validation
from evalweave.plans import figures
from evalweave.sources import sinks


def figure_records(records: DataFrame, headers: DataFrame, output: str) -> DataFrame:
    """id, source_id, l1, l2, l3, frequency, frequency_origin, gain, source_ratio, rate, frames, seconds, fault.

    records: id, audio, l1, l2, l3, meta (JSON); headers: audio, rate, frames. Figures that don't apply to a family are null. A
    label path that isn't in the taxonomy, or a record without a header, is a fault; the row stays.
    """
    r, meta, leaf = records.join(headers.select("audio", "rate", "frames"), "audio", "left"), F.col("meta"), labels.leaf(F.col("l3"))
    at = labels.source_frequency(meta, leaf)
    own = labels.family_masked(F.col("l1"), F.col("l2"), labels.number(labels.field(meta, f"{output}.tl_db")), at["value"], labels.number(labels.field(meta, f"{output}.snr_db")))
    fault = validation.first_fault(("label path", labels.path_agrees(F.col("l1"), F.col("l2"), leaf)), ("no header", F.col("rate").isNotNull()))
    x = r.select("id", text.source_id(F.col("id")).alias("source_id"), "l1", "l2", leaf.alias("l3"), own.alias("_own"), at["origin"].alias("_origin"), "rate", "frames", fault.alias("fault"))
    origin = F.when(F.col("_own.frequency").isNotNull(), F.col("_origin"))
    return x.select("id", "source_id", "l1", "l2", "l3", F.col("_own.frequency").alias("frequency"), origin.alias("frequency_origin"), F.col("_own.gain").alias("gain"), F.col("_own.source_ratio").alias("source_ratio"), "rate", "frames", (F.col("frames") / F.col("rate")).alias("seconds"), "fault")


def dataset(records: DataFrame, questions: list[list[str]], sentences: list[str], seed: int = 42) -> DataFrame:
    """records (id, meta) with labels, dialogue and split: all channels of a source stand in one split. Unknown labels are passed over."""
    x = records.withColumn("_l", labels.key_labels(F.col("meta"))).select(*records.columns, "_l.*").filter("l1 <> 'unknown'")
    x = evidence.dialogue(x, "id", "l1", "l3", "meta", questions, sentences, seed).withColumn("source_id", text.source_id(F.col("id")))
    return x.join(selection.group_split(x, "l3", "source_id", str(seed)), ["l3", "source_id"])


def write_dataset(data: DataFrame, path: str) -> None:
    """A folder of JSON lines for each split; an error if there is one already."""
    data.write.mode("errorifexists").partitionBy("split").json(path)


def silent_control(records: DataFrame, headers: DataFrame, out: str) -> dict[str, DataFrame]:
    """Silent files as long as the records' own, below out, and the manifests `original`, `silent` and `pairs`.

    The manifests differ in `audio` only. A record without a header is an error before a file is written.
    """
    h = headers.select("audio", "rate", "frames", F.col("sha256").alias("source_sha256"))
    validation.require_none(records.join(h, "audio", "left_anti").select("id"), "records without a header")
    named = records.join(h, "audio").withColumn("_file", F.concat(F.lit("audio/"), F.sha2(F.col("id"), 256), F.lit(".wav")))
    sinks.write_silence(named, out, "_file", "frames", "rate").write.mode("errorifexists").parquet(f"{out}/files")
    files = records.sparkSession.read.parquet(f"{out}/files").select(F.col("file").alias("_file"), F.col("sha256").alias("silent_sha256"))
    silent = named.withColumn("audio", F.col("_file")).select(*records.columns)
    pairs = named.join(files, "_file").select("id", F.col("audio").alias("source_audio"), F.col("_file").alias("silent_audio"), "frames", "rate", (F.col("frames") / F.col("rate")).alias("seconds"), "source_sha256", "silent_sha256")
    return {"original": records, "silent": silent, "pairs": pairs}


def results(runs: dict[str, DataFrame], classes: list[str]) -> dict[str, DataFrame]:
    """summary, classes, diagnostics and outcomes of several runs with the run's name: runs are few, each read once a frame.

    A run has truth, pred, ok1 to ok3 and what outcome_state reads: l3, leaf, skipped, t1_status, t2_status.
    """

    def each(make) -> DataFrame:
        return reduce(DataFrame.unionByName, [make(df).withColumn("run", F.lit(name)) for name, df in sorted(runs.items())])

    return {
        "summary": each(figures.summary),
        "classes": each(lambda df: metrics.class_metrics(metrics.confusion(df))),
        "diagnostics": each(lambda df: figures.class_diagnostics(metrics.confusion(df), classes, ["unknown", "cascade_error"])),
        "outcomes": each(metrics.outcomes),
    }
