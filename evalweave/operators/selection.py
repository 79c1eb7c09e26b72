"""Ranking, pools, strata, medoids, splits, distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.operators.quantiles import cumulative, quantiles


def _finite(c: Column) -> Column:
    """A number that is neither null, NaN nor infinite."""
    v = c.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def rank_pool(df: DataFrame, group: str, quality: str, key: str, n: int, factor: float = 2.0) -> DataFrame:
    """Rank in the group by quality, then key; the group's size; the candidates, min(size, max(n, round half even of n * factor)).

    A null group is a group; a null or NaN quality ranks last. The bound on the rank is a constant, so Spark keeps that many
    rows of a group in each task before the shuffle: a group that holds a third of the rows sends no more than the others.
    """
    pool = int(max(n, round(n * factor)))
    best = F.desc_nulls_last(F.when(~F.isnan(F.col(quality).cast("double")), F.col(quality)))
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(best, key))).filter(F.col("rank") <= pool)
    sizes = df.groupBy(F.col(group).alias("_of")).agg(F.count(F.lit(1)).alias("pool_size"))
    return ranked.join(sizes, F.col(group).eqNullSafe(F.col("_of"))).drop("_of")


def hash_sample(df: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each group in the order of md5(seed, key): the same however the input is partitioned."""
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    return df.withColumn("_h", h).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("_h", key))).filter(F.col("rank") <= n).drop("_h")


def cut_points(df: DataFrame, group: str, value: str) -> DataFrame:
    """Tertile cuts (linear quantiles) by group, of the finite values."""
    return quantiles(df.filter(_finite(F.col(value))), group, value, [1 / 3, 2 / 3], ["q1", "q2"])


def tertile_strata(df: DataFrame, group: str, value: str) -> DataFrame:
    """Stratum 0, 1 or 2: up to the first cut, up to the second, above. Ties are never split.

    A null group is a group. A value that is null, NaN or infinite makes no cut and has a null stratum.
    """
    v = F.col(value)
    cuts = cut_points(df, group, value).withColumnRenamed(group, "_of")
    own = df.join(cuts, df[group].eqNullSafe(cuts["_of"]), "left").drop("_of")
    return own.withColumn("stratum", F.when(~_finite(v), None).when(v <= F.col("q1"), 0).when(v <= F.col("q2"), 1).otherwise(2))


def stratified_recall(df: DataFrame, group: str) -> DataFrame:
    """df (group, stratum, ok): the mean over groups of the recall in a stratum; null where a group has no row in it."""
    cells = df.groupBy(group, "stratum").agg(F.avg(F.col("ok").cast("double")).alias("recall"))
    k = df.agg(F.count_distinct(group).alias("k"))
    out = cells.groupBy("stratum").agg(F.count("recall").alias("groups"), F.avg("recall").alias("m")).crossJoin(F.broadcast(k))
    return out.select("stratum", "groups", F.when(F.col("groups") == F.col("k"), F.round("m", 6)).alias("macro_recall"))


def medoid_distances(df: DataFrame, group: str, key: str, values: list[str]) -> DataFrame:
    """df with, for each value v, v_low, v_median, v_high (its group's quartiles) and distance: squared, in interquartile
    ranges; values whose range is 0 don't count. A null group is a group. A value that is null, NaN or infinite is an error.
    """
    whole = reduce(lambda a, b: a & b, [_finite(F.col(v)) for v in values])
    bad = F.raise_error(F.concat(F.lit("a feature is missing or not finite in the row "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    near = df.withColumn(values[0], F.when(whole, F.col(values[0])).otherwise(bad.cast(df.schema[values[0]].dataType)))
    # all values' quartiles from one pass over (group, value's name, value)
    long = near.select(F.inline(F.array(*[F.struct(F.struct(F.col(group).alias("g"), F.lit(v).alias("f")).alias("_key"), F.col(v).cast("double").alias("_v")) for v in values])))
    names = ["low", "median", "high"]
    q = quantiles(long, "_key", "_v", [0.25, 0.5, 0.75], names)
    q = q.groupBy(F.col("_key.g").alias("_of")).agg(*[F.max(F.when(F.col("_key.f") == v, F.col(n))).alias(f"{v}_{n}") for v in values for n in names])
    near = near.join(q, near[group].eqNullSafe(q["_of"])).drop("_of")
    d: list[Column] = []
    for v in values:
        iqr = F.col(f"{v}_high") - F.col(f"{v}_low")
        d.append(F.when(iqr > 0, F.pow((F.col(v) - F.col(f"{v}_median")) / iqr, F.lit(2.0))).otherwise(0.0))
    return near.withColumn("distance", F.round(reduce(lambda a, b: a + b, d), 9))


def robust_medoid(df: DataFrame, group: str, key: str, values: list[str]) -> DataFrame:
    """The row nearest to the group's medians in interquartile ranges; ties: the least key. Missing features are an error."""
    near = medoid_distances(df, group, key, values)
    return near.groupBy(group).agg(F.min(F.struct("distance", key)).alias("m"), F.count(F.lit(1)).alias("n")).select(group, F.col(f"m.{key}").alias(key), F.col("m.distance").alias("distance"), "n")


def first_seen_codes(df: DataFrame, key: str, order: str) -> DataFrame:
    """key, code: 0 for the key that comes first, and so on. Only distinct keys are ranked, by ranges of order."""
    first = df.groupBy(key).agg(F.min(order).alias("_first")).withColumn("_all", F.lit(1))
    ranked = cumulative(first, "_all", "_first").select(F.col("_first").alias("_at"), (F.col("upto") - F.col("n")).alias("code"))
    return first.join(ranked, first["_first"].eqNullSafe(ranked["_at"])).select(key, "code")


def ecdf(df: DataFrame, group: str, value: str) -> DataFrame:
    """Distinct values with the cumulative mass up to each. Values that are null, NaN or infinite have no step."""
    return cumulative(df.filter(_finite(F.col(value))), group, value).select(group, value, F.round(F.col("upto") / F.col("total"), 9).alias("mass"))


def ecdf_steps(df: DataFrame, group: str, value: str) -> DataFrame:
    """A step of 1/n for each observation, equal ones apart: the same curve by other coordinates."""
    steps = cumulative(df.filter(_finite(F.col(value))), group, value)
    each = steps.select(group, value, "total", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("_k"))
    return each.select(group, value, F.round(F.col("_k") / F.col("total"), 9).alias("mass"))


def numeric_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Of a group's finite values; a group without any only has a count of 0. A null group is a group."""
    x = df.withColumn(value, F.when(_finite(F.col(value)), F.col(value)))
    v = F.col(value)
    g = x.groupBy(group).agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 4).alias("mean"))
    m = quantiles(x, group, value, [0.5], ["_m"]).withColumnRenamed(group, "_g")
    return g.join(m, g[group].eqNullSafe(m["_g"]), "left").select(group, "count", "min", "max", "mean", F.round("_m", 4).alias("median"))


def group_split(df: DataFrame, label: str, source: str, seed: str, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """(label, source, split): sources in hash order, sizes by floor and largest remainder (ties to the earlier split).

    A source stands in one split for a label; a null source or label is one like any other. Ranks are two-level: inside a range of hashes, plus what stands in the ranges
    before it (65,536 counts a label at most), so no task sorts all sources of a label.
    """
    src = df.select(label, source).distinct()
    named = F.coalesce(F.concat(F.lit(seed), F.col(source).cast("string")), F.concat(F.lit(seed), F.lit("\u0000null")))
    src = src.withColumn("_h", F.md5(named)).withColumn("_b", F.substring("_h", 1, 4))
    counts = src.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(label)
    before = counts.select(F.col(label).alias("_of"), F.col("_b").alias("_at"), (F.sum("_c").over(w.orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_n"))
    inside = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", source))
    ranked = src.withColumn("_i", inside)
    ranked = ranked.join(before, ranked[label].eqNullSafe(before["_of"]) & (ranked["_b"] == before["_at"])).withColumn("_r", F.col("_i") + F.col("_before"))
    exact = [F.col("_n") * r for r in ratios]
    base = [F.floor(e) for e in exact]
    left = F.col("_n") - reduce(lambda a, b: a + b, base)
    part = [e - b for e, b in zip(exact, base, strict=True)]
    # how many splits come before split i when remainders are dealt out
    before = [reduce(lambda a, b: a + b, [((part[j] > part[i]) if j > i else (part[j] >= part[i])).cast("int") for j in range(3) if j != i]) for i in range(3)]
    size = [b + (k < left).cast("int") for b, k in zip(base, before, strict=True)]
    return ranked.select(label, source, F.when(F.col("_r") <= size[0], "train").when(F.col("_r") <= size[0] + size[1], "val").otherwise("test").alias("split"))


def shard(df: DataFrame, order: list[str], shards: int, index: int, limit: int | None = None) -> DataFrame:
    """Every shards-th row from index on, in an order whose keys are unique, and of these the first `limit`.

    Rows are numbered by ranges of the order: a task numbers its own range, and the ranges before it add what they hold.
    """
    dealt = df.repartitionByRange(*[F.col(c) for c in order]).select("*", F.spark_partition_id().alias("_p"))
    numbered = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    held = numbered.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = held.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row a range
    own = numbered.join(before, "_p").withColumn("_at", F.col("_i") + F.col("_before")).filter(F.col("_at") % shards == index)
    if limit is not None:
        own = own.filter(F.col("_at") < limit * shards + index)
    return own.drop("_p", "_i", "_n", "_before", "_at")


def mock_samples(spark: SparkSession, n: int, taxonomy: dict[str, tuple[str, str]], seed: int = 42) -> DataFrame:
    """id, l1, l2, l3, audio, snr_db (-15 to 25), complexity (0 to 10) of n made-up samples, by hashes of their numbers."""
    leaves = sorted(taxonomy)
    part = lambda name: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(1_000_003)) / 1_000_003
    at = (part("leaf") * len(leaves)).cast("int")
    own = lambda values: F.get(F.array(*map(F.lit, values)), at)
    x = spark.range(n).select("id", own(leaves).alias("l3"), own([taxonomy[k][1] for k in leaves]).alias("l2"), own([taxonomy[k][0] for k in leaves]).alias("l1"), (part("snr") * 40 - 15).alias("snr_db"), (part("complexity") * 10).alias("complexity"))
    name = F.format_string("mock_%s_%06d", "l3", "id")
    return x.select(name.alias("id"), "l1", "l2", "l3", F.concat(F.lit("mock/audio/"), "l3", F.lit("/"), name, F.lit(".wav")).alias("audio"), "snr_db", "complexity")
