"""Cumulative counts and exact quantiles of groups of any size.

Rows are reduced to distinct values with counts. Each group's values are cut into ranges at approximate quantiles; counts run
up inside a range, and what stands in the ranges before comes from a table of at most RANGES rows a group. So no task
holds or sorts a group, and results are exact wherever the cuts fall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a group, and cuts that are looked through at once to find a value's range.
RANGES, STEP = 256, 16
#: Distinct values of all groups, some 20 MB of counts, up to which quantiles() asks Spark's own aggregate.
FEW = 200_000


def _range(v: Column, cuts: Column, coarse: Column) -> Column:
    """How many of the ascending cuts are below v: by every STEP-th cut, then by the cuts behind the last of those below v."""
    below = lambda a: F.size(F.filter(a, lambda k: k < v))
    skipped = below(coarse) * STEP
    return skipped + below(F.slice(cuts, skipped + 1, F.lit(STEP)))


def cumulative(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, n, upto, total: distinct values, their counts, rows up to and with each, rows of the group. Nulls are left out of
    values; a null group is a group."""
    c = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    cuts = c.groupBy(F.col(group).alias("_of")).agg(F.array_distinct(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 1000)).alias("_cuts"))
    cuts = cuts.withColumn("_coarse", F.filter("_cuts", lambda _, i: i % STEP == STEP - 1))
    x = c.join(cuts, c[group].eqNullSafe(cuts["_of"])).select(group, value, "n", _range(F.col(value), F.col("_cuts"), F.col("_coarse")).alias("_b"))
    sums = x.groupBy(F.col(group).alias("_of"), F.col("_b").alias("_k")).agg(F.sum("n").alias("_s"))
    w = Window.partitionBy("_of")
    before = sums.select("_of", "_k", (F.sum("_s").over(w.orderBy("_k")) - F.col("_s")).alias("_before"), F.sum("_s").over(w).alias("total"))
    inside = x.withColumn("_i", F.sum("n").over(Window.partitionBy(group, "_b").orderBy(value)))
    j = inside.join(before, inside[group].eqNullSafe(before["_of"]) & (F.col("_b") == F.col("_k")))
    return j.select(group, value, "n", (F.col("_i") + F.col("_before")).alias("upto"), "total")


def at_rank(rank: Column, value: str) -> Column:
    """Aggregate: the value at a rank, from 0, of cumulative() rows."""
    return F.max(F.when((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("n")), F.col(value)))


def quantiles(df: DataFrame, group: str, value: str, shares: list[float], names: list[str], most: int = FEW) -> DataFrame:
    """group and a column for each share: linear between the two nearest ranks.

    Up to `most` distinct values of all groups, one aggregate holds each group's counts; beyond, ranks come from cumulative().
    Both are exact.
    """
    distinct = df.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    if distinct.limit(most + 1).count() <= most:
        q = distinct.groupBy(group).agg(F.percentile("_v", F.array(*map(F.lit, shares)), F.col("_n")).alias("_q"))
        return q.select(group, *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(names)])
    c = cumulative(df, group, value)
    position = [(F.col("total") - 1) * F.lit(q) for q in shares]
    own = [x for i, p in enumerate(position) for x in (at_rank(F.floor(p), value).alias(f"_l{i}"), at_rank(F.ceil(p), value).alias(f"_h{i}"))]
    g = c.groupBy(group).agg(F.max("total").alias("total"), *own)
    out = []
    for i, (p, name) in enumerate(zip(position, names, strict=True)):
        low, high = F.col(f"_l{i}").cast("double"), F.col(f"_h{i}").cast("double")
        out.append(F.when(low == high, low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high).alias(name))
    return g.select(group, *out)
