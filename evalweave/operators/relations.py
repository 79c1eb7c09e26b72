"""Coverage, agreement, unions and label rules over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides, on the first only, on the second only."""
    x, y = a.select(F.col(key).alias("k")).distinct().withColumn("in_a", F.lit(1)), b.select(F.col(key).alias("k")).distinct().withColumn("in_b", F.lit(1))
    j = x.join(y, "k", "full_outer")
    return j.agg(F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("both"), F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"))


def agreement(subset: DataFrame, full: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """How many rows of the subset are missing from the whole, and how many differ in a field (null equals null)."""
    s, f = subset.select(key, *[F.col(c).alias(f"_s_{c}") for c in fields]), full.select(key, *fields, F.lit(1).alias("_there"))
    j = s.join(f, key, "left")
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_there").isNull()).alias("missing"), *[F.count_if(F.col("_there").isNotNull() & ~F.col(f"_s_{c}").eqNullSafe(F.col(c))).alias(f"differ_{c}") for c in fields])


def union_check(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows, distinct keys and repeated keys of a union."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    c = u.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"))


def label_distribution(df: DataFrame, levels: list[str]) -> DataFrame:
    """Counts and shares at each level by grouping sets: one pass."""
    g = df.groupingSets([[F.col(c)] for c in levels], *levels).agg(F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in levels]).alias("level"), F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return g.crossJoin(F.broadcast(total)).select("level", F.coalesce(*levels).alias("label"), "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def evidence_state(counts: Column, invalid: Column) -> Column:
    """zero before invalid before nonzero before missing."""
    return F.when(F.exists(counts, lambda x: x == 0), "zero").when(invalid, "invalid").when(F.exists(counts, lambda x: x.isNotNull()), "nonzero").otherwise("missing")


def bucket(v: Column, edges: list[float]) -> Column:
    """Name of the half-open range [edge, next edge)."""
    out = F.when(v < edges[0], F.lit(f"<{edges[0]:g}"))
    for a, b in zip(edges, edges[1:], strict=False):
        out = out.when(v < b, F.lit(f"[{a:g},{b:g})"))
    return out.otherwise(F.lit(f">={edges[-1]:g}"))


def running_share(n: Column, group: list[str], order: list[str]) -> dict[str, Column]:
    """start and share of each row in its group's total, in order. Rows are few: counts of states."""
    w = Window.partitionBy(*group)
    total = F.sum(n).over(w)
    return {"start": (F.sum(n).over(w.orderBy(*order)) - n) / total, "share": n / total}


def shared_range(df: DataFrame, values: str) -> DataFrame:
    """high, low over all elements of all rows' arrays: the reference that several pictures share."""
    return df.agg(F.max(F.array_max(F.transform(values, lambda v: v.cast("double")))).alias("high"), F.min(F.array_min(F.transform(values, lambda v: v.cast("double")))).alias("low"))


def draw_audit(df: DataFrame, drawn: str) -> DataFrame:
    """drawn, n, share, all_same: how often each was drawn, and whether only one ever was."""
    c = df.groupBy(drawn).agg(F.count(F.lit(1)).alias("n"))
    whole = c.agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_kinds"))  # one row
    return c.crossJoin(whole).select(drawn, "n", F.round(F.col("n") / F.col("_total"), 6).alias("share"), (F.col("_kinds") == 1).alias("all_same"))
