"""Classification metrics, all from one confusion aggregate: one shuffle of pre-aggregated counts, whatever the input's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def confusion(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(truth, pred, n), long form."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(conf: DataFrame) -> DataFrame:
    """Support, tp, fp, fn, precision, recall and F1 (to 4 places) of each class that is a truth or a prediction."""
    sides = conf.select(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"))
    sides = sides.unionByName(conf.select(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))
    g = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return g.select("label", "support", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


def level_summary(conf: DataFrame) -> DataFrame:
    """One row: rows, accuracy (failed answers stay in the denominator), macro F1 over classes with support."""
    macro = class_metrics(conf).filter("support > 0").agg(F.coalesce(F.round(F.avg("f1"), 4), F.lit(0.0)).alias("macro_f1"))
    acc = conf.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.round(ratio(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")), 6).alias("accuracy"))
    return acc.crossJoin(macro)  # one row each


def confusion_share(conf: DataFrame) -> DataFrame:
    """Each cell's share of its true class."""
    return conf.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("truth")), 6))


def top_confusions(conf: DataFrame, n: int = 15) -> DataFrame:
    return conf.filter((F.col("truth") != F.col("pred")) & (F.col("n") > 0)).orderBy(F.desc("n"), F.desc("truth"), F.desc("pred")).limit(n)


def conditional_accuracy(df: DataFrame) -> DataFrame:
    """df (ok1, ok2, ok3 boolean): P(level 2 right | level 1 right), P(3 | 2)."""
    c = lambda x: F.count_if(x)
    one, two, three = F.col("ok1"), F.col("ok2"), F.col("ok3")
    return df.agg(F.round(ratio(c(two & one), c(one)), 6).alias("l2_given_l1"), F.round(ratio(c(three & two), c(two)), 6).alias("l3_given_l2"))


def cascade_funnel(df: DataFrame) -> DataFrame:
    one, two, three = F.col("ok1"), F.col("ok2"), F.col("ok3")
    return df.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(one).alias("n_l1"), F.count_if(one & two).alias("n_l1_l2"), F.count_if(one & two & three).alias("n_l3"))


# The states of an answer to two questions, in the order in which they are shown.
STRICT_STATES = ["T1 invalid", "T1 wrong", "T2 invalid", "T2 leaf wrong", "Leaf correct"]
LEGACY_STATES = ["T1 wrong / unresolved", "T2 leaf wrong / unresolved", "Leaf correct"]
# End of fixed values.
_INVALID = "invalid_format"


def outcome_state(strict: bool = True) -> Column:
    """Of a canonical answer (l3, leaf, skipped, t1_status, t2_status): one of the states; null where what decides is null.

    Strict states tell answers that could not be read from wrong ones by their parse status; the legacy ones can't.
    """
    right = F.when(F.col("leaf") == F.col("l3"), "Leaf correct")
    if not strict:
        return F.when(F.col("skipped").isNull() | F.col("leaf").isNull() | F.col("l3").isNull(), None).when(F.col("skipped"), LEGACY_STATES[0]).otherwise(F.coalesce(right, F.lit(LEGACY_STATES[1])))
    gate = F.when(F.col("t1_status") == _INVALID, STRICT_STATES[0]).otherwise(STRICT_STATES[1])
    leaf = F.when(F.col("t2_status").isNull() | F.col("leaf").isNull() | F.col("l3").isNull(), None).when(F.col("t2_status") == _INVALID, STRICT_STATES[2]).otherwise(F.coalesce(right, F.lit(STRICT_STATES[3])))
    return F.when(F.col("t1_status").isNull() | F.col("skipped").isNull(), None).when(F.col("skipped") | (F.col("t1_status") == _INVALID), gate).otherwise(leaf)


def outcomes(df: DataFrame, strict: bool = True) -> DataFrame:
    """state, n, share: all states in order of the answers, those without rows included; a null state counts answers that have none."""
    own = df.groupBy(outcome_state(strict).alias("state")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame([(s,) for s in (STRICT_STATES if strict else LEGACY_STATES)], "state string")
    x = grid.join(own, "state", "left").unionByName(own.filter("state is null")).select("state", F.coalesce("n", F.lit(0)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))  # one row
    return x.crossJoin(total).select("state", "n", F.round(ratio(F.col("n"), F.col("total")), 6).alias("share"))


def vote_summary(df: DataFrame, key: str, label: str, unknown: str = "unknown") -> DataFrame:
    """One row: keys, the mean over them of their most frequent label's share, and the share of votes that are not unknown."""
    votes = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    known = F.sum(F.when(F.col(label) != unknown, F.col("n")).otherwise(0))
    each = votes.groupBy(key).agg((F.max("n") / F.sum("n")).alias("a"), F.sum("n").alias("n"), known.alias("k"))
    return each.agg(F.count(F.lit(1)).alias("keys"), F.round(F.coalesce(F.avg("a"), F.lit(0.0)), 6).alias("agreement"), F.round(ratio(F.sum("k"), F.sum("n")), 6).alias("parse_rate"))


def vote_agreement(df: DataFrame, key: str, label: str) -> DataFrame:
    """Share of a key's most frequent label, by key."""
    return df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.sum("n").alias("votes"), F.round(F.max("n") / F.sum("n"), 6).alias("agreement"))


def error_metrics(df: DataFrame, pred: str, truth: str, tolerance: float, least: float = 1e-9) -> DataFrame:
    """MAE, RMSE, MAPE (without truths near 0) and the share within a tolerance; NaN for no rows."""
    d, nan = F.abs(F.col(pred) - F.col(truth)), F.lit(float("nan"))
    far = F.abs(F.col(truth)) >= least
    one = lambda c, name, k=4: F.coalesce(F.round(c, k), nan).alias(name)
    return df.agg(one(F.avg(d), "mae"), one(F.sqrt(F.avg(d * d)), "rmse"), one(F.avg(F.when(far, d / F.abs(F.col(truth)))) * 100, "mape"), one(F.avg((d <= tolerance).cast("double")), "within", 6))
