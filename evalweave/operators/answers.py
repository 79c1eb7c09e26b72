"""Saved answers to two questions, checked against the records they belong to, and the checks of whole runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.operators import metrics, validation

#: What an answer may say besides a class.
UNKNOWN, SKIPPED = "unknown", "cascade_error"
_STATUSES = ("valid_option", "invalid_format")


def answer_fault(taxonomy: dict[str, tuple[str, str]], strict: bool = True) -> Column:
    """The first fault of an answer (t1, t1_status, skipped, leaf, t2_l1, t2_l2, t2_status) to a record (m_l1 to m_l3), scored
    by l1 to l3; null if it has none. taxonomy: of each leaf its first and second level.

    Strict answers carry parse statuses, which must agree with the labels, and a hierarchy that agrees with the leaf.
    """
    same = lambda *pairs: reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in pairs])
    gates = sorted({one for one, _ in taxonomy.values()})
    parents = F.create_map(*[x for leaf, own in sorted(taxonomy.items()) for x in (F.lit(leaf), F.struct(F.lit(own[0]).alias("l1"), F.lit(own[1]).alias("l2")))])
    known = F.col("leaf").isin(*taxonomy)
    checks = [
        ("truth", same(("l1", "m_l1"), ("l2", "m_l2"), ("l3", "m_l3"))),
        ("label", F.col("t1").isin(*gates, UNKNOWN) & F.col("leaf").isin(*taxonomy, UNKNOWN, SKIPPED)),
        ("gate", F.col("skipped") == (F.col("t1") != F.col("l1"))),
        ("skipped label", F.col("skipped") == (F.col("leaf") == SKIPPED)),
    ]
    if strict:
        own = F.try_element_at(parents, F.col("leaf"))
        checks += [
            ("first status", F.col("t1_status").isin(*_STATUSES) & ((F.col("t1_status") == _STATUSES[1]) == (F.col("t1") == UNKNOWN))),
            ("second status", F.col("skipped") | (F.col("t2_status").isin(*_STATUSES) & ((F.col("t2_status") == _STATUSES[1]) == (F.col("leaf") == UNKNOWN)))),
            ("hierarchy", ~known | ((F.col("t2_l1") == own["l1"]) & (F.col("t2_l2") == own["l2"]))),
        ]
    return validation.first_fault(*checks)


def canonical(answers: DataFrame, manifest: DataFrame, taxonomy: dict[str, tuple[str, str]], strict: bool = True) -> DataFrame:
    """answers that a record of the manifest (id, l1, l2, l3) has, a row each, with fault (null: none); ids with a fault of their
    own (repeated, in no record, without an answer) come as rows without an answer.
    """
    m = manifest.select("id", *[F.col(c).alias(f"m_{c}") for c in ("l1", "l2", "l3")])
    own = answers.join(m, "id").withColumn("fault", answer_fault(taxonomy, strict)).drop("m_l1", "m_l2", "m_l3")
    sides = validation.uncovered(answers, manifest, "id").select("id", F.when(F.col("side") == "first", "not in the manifest").otherwise("no answer").alias("fault"))
    again = validation.repeated(answers, "id").select("id", F.lit("repeated").alias("fault"))
    return own.unionByName(sides.unionByName(again), allowMissingColumns=True)


def count_faults(counts: DataFrame, classes: list[str], extra: list[str]) -> DataFrame:
    """fault, n of confusion counts (truth, pred, n) that can't be diagnosed: cells that aren't whole numbers from 0 up, labels
    that aren't classes, and classes without support.
    """
    n = F.col("n").cast("double")
    cell = validation.first_fault(("truth label", F.col("truth").isin(*classes)), ("predicted label", F.col("pred").isin(*classes, *extra)), ("count", (n >= 0) & (n == F.floor(n)) & (n < float("inf"))))
    cells = counts.select(cell.alias("fault")).filter("fault is not null")
    support = counts.groupBy("truth").agg(F.sum("n").alias("n")).filter("n > 0")
    every = counts.sparkSession.createDataFrame([(c,) for c in classes], "truth string")
    return cells.unionByName(every.join(support, "truth", "left_anti").select(F.lit("no support").alias("fault"))).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def saved_matrix(rows: DataFrame, key: dict[str, str]) -> DataFrame:
    """truth, pred, n of a matrix saved as rows (label, counts array), whose columns stand in the order of `at`: rows have
    label, at and counts. key gives the class that a saved label stands for; labels that it lacks stay null.
    """
    names = F.create_map(*[F.lit(x) for pair in sorted(key.items()) for x in pair])
    columns = rows.select(F.col("at").alias("_c"), F.try_element_at(names, F.col("label")).alias("pred"))
    cells = rows.select(F.try_element_at(names, F.col("label")).alias("truth"), F.posexplode("counts").alias("_c", "n"))
    return cells.join(columns, "_c").select("truth", "pred", "n")


def interval_summary(pairs: DataFrame, cluster: str, classes: list[str], replicates: int = 10_000, seed: int = 20261008) -> dict[str, DataFrame]:
    """wilson (accuracy of each run), difference (by rows and by clusters) and bootstrap of two runs on the same rows
    (cluster, truth, pred_a, pred_b), as frames of a few rows.
    """
    from evalweave.operators import intervals

    right = pairs.select(cluster, (F.col("truth") == F.col("pred_a")).alias("a"), (F.col("truth") == F.col("pred_b")).alias("b"))
    each = right.agg(F.count(F.lit(1)).alias("n"), F.count_if("a").alias("a"), F.count_if("b").alias("b"))
    each = each.unpivot("n", ["a", "b"], "run", "k")
    low, high = intervals.wilson(F.col("k"), F.col("n"))
    return {
        "wilson": each.select("run", "k", "n", F.round(metrics.ratio(F.col("k"), F.col("n")), 6).alias("accuracy"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high")),
        "difference": intervals.paired_difference(intervals.discordant(right)),
        "bootstrap": intervals.cluster_bootstrap(pairs, cluster, classes, replicates, seed),
    }


def shard_merge(shards: list[DataFrame], manifest: DataFrame, protocols: DataFrame, classes: list[str]) -> dict[str, DataFrame]:
    """The shards' predictions as one, its faults (coverage, repeats, rows, protocols) and the metrics of the whole."""
    from evalweave.plans import figures

    rows = reduce(DataFrame.unionByName, shards)
    faults = validation.prediction_faults(rows, manifest).select(F.col("id").cast("string").alias("where"), "fault")
    faults = faults.unionByName(validation.protocol_faults(protocols, rows).select(F.lit("protocol").alias("where"), "fault"))
    scored = rows.select("*", (F.col("l1") == F.col("pred_1")).alias("ok1"), (F.col("l2") == F.col("pred_2")).alias("ok2"), (F.col("l3") == F.col("pred_3")).alias("ok3"), F.col("l3").alias("truth"), F.col("pred_3").alias("pred"))
    conf = metrics.confusion(scored)
    return {"rows": rows, "faults": faults, "summary": figures.summary(scored), "classes": metrics.class_metrics(conf).filter(F.col("label").isin(*classes)), "confusion": conf}


def raw_run_faults(pairs: DataFrame, a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """key, fault of paired rows (key, pred_a, pred_b, ok_a, ok_b) that differ from the raw runs (key, pred, ok) they were made from."""
    side = lambda df, x: df.select(key, F.col("pred").alias(f"_pred_{x}"), F.col("ok").alias(f"_ok_{x}"), F.lit(True).alias(f"_in_{x}"))
    j = pairs.join(side(a, "a"), key, "left").join(side(b, "b"), key, "left")
    same = lambda x: F.col(f"pred_{x}").eqNullSafe(F.col(f"_pred_{x}")) & F.col(f"ok_{x}").eqNullSafe(F.col(f"_ok_{x}"))
    fault = validation.first_fault(("not in the first run", F.col("_in_a")), ("not in the second run", F.col("_in_b")), ("first run", same("a")), ("second run", same("b")))
    rows = j.select(key, fault.alias("fault")).filter("fault is not null")
    missing = a.join(pairs, key, "left_anti").select(key, F.lit("not paired").alias("fault"))
    return rows.unionByName(missing).unionByName(validation.repeated(pairs, key).select(key, F.lit("repeated").alias("fault")))


def signed_run_faults(runs: DataFrame, comparisons: DataFrame) -> DataFrame:
    """model, fault of comparisons (model, run_signature) whose run (model, run_signature) is missing or has another signature."""
    r = runs.select("model", F.col("run_signature").alias("_signature"))
    return comparisons.join(r, "model", "left").select("model", validation.first_fault(("no run", F.col("_signature").isNotNull()), ("run signature", F.col("run_signature") == F.col("_signature"))).alias("fault")).filter("fault is not null")


def batch_guard(asked: DataFrame, answered: DataFrame, key: str, answer: str) -> DataFrame:
    """key, fault: questions without an answer or with several, answers to no question, and answers that aren't text."""
    kind = dict(answered.dtypes)[answer]
    if kind != "string":
        raise TypeError(f"answers are {kind}, not text")
    n = answered.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count(answer).alias("_texts"))
    j = asked.select(key).distinct().withColumn("_asked", F.lit(True)).join(n, key, "full_outer")
    fault = validation.first_fault(("not asked", F.col("_asked")), ("no answer", F.col("_n").isNotNull()), ("several answers", F.col("_n") == 1), ("no text", F.col("_texts") == 1))
    return j.select(key, fault.alias("fault")).filter("fault is not null")
