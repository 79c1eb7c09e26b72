"""Intervals and paired comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of a share k / n, within [0, 1]; null for n of 0."""
    n = F.nullif(n, F.lit(0))
    p = k / n
    middle, half, whole = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.greatest(F.lit(0.0), (middle - half) / whole), F.least(F.lit(1.0), (middle + half) / whole)


def discordant(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """df (a, b boolean): both right, first only, second only, neither."""
    a, b = F.col("a"), F.col("b")
    return df.groupBy(*(by or [])).agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))


def paired_difference(counts: DataFrame, z: float = Z95) -> DataFrame:
    """Difference of two shares on the same rows with its analytic interval."""
    n = F.nullif(F.col("both") + F.col("only_a") + F.col("only_b") + F.col("neither"), F.lit(0))
    d = F.col("only_a") - F.col("only_b")
    half = z * F.sqrt(F.greatest(F.lit(0.0), F.col("only_a") + F.col("only_b") - d * d / n)) / n
    return counts.withColumns({"delta": F.round(d / n, 6), "low": F.round(d / n - half, 6), "high": F.round(d / n + half, 6)})


def _scores(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """c (..., 5, classes): support, predicted and hits of a, predicted and hits of b -> accuracy and macro F1, (..., 2) for a and b.

    F1 is rounded to 4 places by class, as numpy rounds; the mean is over classes with support.
    """
    support, predicted, hits = c[..., 0:1, :], c[..., 1::2, :], c[..., 2::2, :]
    f1 = np.round(np.divide(2.0 * hits, predicted + support, out=np.zeros(hits.shape), where=predicted + support > 0), 4)
    return hits.sum(-1) / support.sum(-1), np.where(support > 0, f1, 0.0).sum(-1) / (support > 0).sum(-1)


def cluster_bootstrap(df: DataFrame, cluster: str, classes: list[str], replicates: int = 10_000, seed: int = 20261008, tasks: int = 32, shard_kinds: int = 4096) -> DataFrame:
    """df (cluster, truth, pred_a, pred_b) -> estimate and 95% percentile interval of accuracy and macro F1 of runs a, b and a - b.

    measure (accuracy, macro_f1), run (a, b, delta), estimate, low, high; no rows for no input. A truth that isn't a class is
    an error; a prediction that isn't one is wrong.

    Both measures need of a cluster only its classes' support, predictions and hits, which add up over clusters. Clusters are
    reduced to these counts and dealt by their hash into shards. A replicate draws by a multinomial how many clusters each
    shard gives, then each shard draws that many of its own: together this is drawing all clusters with replacement, and no
    task or driver holds more than a shard (with up to 1024 shards). Each replicate has its own seed in each shard, so results
    don't depend on partitions.
    """
    of = lambda c, x: F.col(c) == x
    cells = [F.count_if(of("truth", x)) for x in classes]
    for p in ("pred_a", "pred_b"):
        cells += [F.count_if(of(p, x)) for x in classes] + [F.count_if(of(p, x) & of("truth", x)) for x in classes]
    width = len(cells)
    stray = F.count_if(~F.coalesce(F.col("truth").isin(classes), F.lit(False)))
    kinds = df.groupBy(cluster).agg(F.array(*cells, stray).alias("counts")).groupBy("counts").agg(F.count(F.lit(1)).alias("m"))
    bucket = lambda n: F.pmod(F.xxhash64("counts"), F.lit(n)).cast("int")
    sums = [F.sum(F.get("counts", F.lit(i)) * F.col("m")) for i in range(width + 1)]
    found = kinds.groupBy(bucket(1024).alias("bucket")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("m").alias("m"), F.array(*sums).alias("counts")).collect()  # 1024 rows at most
    schema = "measure string, run string, estimate double, low double, high double"
    if not found:
        return df.sparkSession.createDataFrame([], schema)
    whole = np.array([r["counts"] for r in found], np.int64).sum(0)
    if whole[-1]:
        raise ValueError(f"{whole[-1]} rows with a truth that is not a class")
    shards = 1
    while shards < 1024 and sum(r["kinds"] for r in found) > shards * shard_kinds:
        shards *= 2
    held = np.zeros(shards, np.int64)  # clusters
    for r in found:
        held[r["bucket"] % shards] += r["m"]
    total, parts = int(held.sum()), max(1, tasks // shards)

    def draw(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        shard, part = map(int, key)
        own = sorted((*c, m) for c, m in zip(x["counts"].map(tuple), x["m"], strict=True))
        counts, m = np.array(own, float)[:, :width], np.array([r[-1] for r in own], np.int64)
        # of many clusters of few kinds the kinds are drawn, else the clusters
        few = m.sum() > 16 * len(m)
        kind = None if few else np.repeat(np.arange(len(m)), m)
        rows = []
        for i in range(part, replicates, parts):
            n = np.random.default_rng([seed, i, 0]).multinomial(total, held / total)[shard]
            rng = np.random.default_rng([seed, i, 1 + shard])
            drawn = rng.multinomial(n, m / m.sum()) if few else np.bincount(kind[rng.integers(0, len(kind), n)], minlength=len(m))
            rows.append((i, drawn @ counts))
        return pd.DataFrame(rows, columns=["id", "counts"])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                yield pd.DataFrame(np.hstack(_scores(np.stack(x["counts"].to_list()).reshape(-1, 5, len(classes)))), columns=["acc_a", "acc_b", "f1_a", "f1_b"])

    dealt = kinds.select("counts", "m", bucket(shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    dealt = dealt.repartition(shards * parts, "shard", "part")  # a number that adaptive execution keeps: rows are few, draws are many
    drawn = dealt.groupBy("shard", "part").applyInPandas(draw, "id long, counts array<double>")
    drawn = drawn.groupBy("id").agg(F.array(*[F.sum(F.get("counts", F.lit(i))) for i in range(width)]).alias("counts"))
    scored = drawn.select("counts").mapInPandas(score, "acc_a double, acc_b double, f1_a double, f1_b double")
    rows = []
    for measure, c, (a, b) in zip(("accuracy", "macro_f1"), ("acc", "f1"), _scores(whole[:-1].reshape(5, -1)), strict=True):
        for run, v, estimate in (("a", F.col(f"{c}_a"), a), ("b", F.col(f"{c}_b"), b), ("delta", F.col(f"{c}_a") - F.col(f"{c}_b"), a - b)):
            rows.append(F.struct(F.lit(measure).alias("measure"), F.lit(run).alias("run"), F.lit(float(estimate)).alias("estimate"), v.alias("v")))
    long = scored.select(F.inline(F.array(*rows)))
    q = long.groupBy("measure", "run", "estimate").agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return q.select("measure", "run", "estimate", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))


def bootstrap_mean(df: DataFrame, value: str, replicates: int = 1000, level: float = 0.95, seed: int = 42, tasks: int = 8, most: int = 1_000_000) -> DataFrame:
    """low, high of the mean of a row's figure over resampled rows; null for fewer than five rows. Null figures are left out.

    Rows are reduced to distinct figures with counts, so what a replicate draws grows with the distinct figures (a right or
    wrong answer has two), not with the rows. Up to `most` of them a replicate draws all rows at once; beyond, each figure is
    drawn by itself, a Poisson number of times, in tasks that hold a bucket of figures: the same interval for so many rows.
    """
    k = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("m"))
    kinds, total = k.agg(F.count(F.lit(1)), F.coalesce(F.sum("m"), F.lit(0))).first()
    if total < 5:
        return df.sparkSession.createDataFrame([(None, None)], "low double, high double")
    spark, tail = df.sparkSession, (1.0 - level) / 2
    if kinds > most:
        means = _poisson_means(k, kinds, replicates, seed, max(1, most // 64))
    else:
        own = np.array([tuple(r) for r in k.orderBy("v").collect()], float).reshape(-1, 2)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                drawn = [np.random.default_rng([seed, int(i)]).multinomial(total, own[:, 1] / total) @ own[:, 0] / total for i in x["id"]]
                yield pd.DataFrame({"v": drawn})

        means = spark.range(0, replicates, 1, tasks).mapInPandas(run, "v double")
    v = means.agg(F.array_sort(F.collect_list("v")).alias("v"))  # as many as replicates
    return v.select(F.get("v", F.lit(int(replicates * tail))).alias("low"), F.get("v", F.lit(min(replicates - 1, int(replicates * (1 - tail))))).alias("high"))


def _poisson_means(k: DataFrame, kinds: int, replicates: int, seed: int, bucket: int) -> DataFrame:
    """v: the mean of each replicate. k (v, m) is dealt by hash into buckets of about so many figures, each with its own seed."""
    buckets = max(1, -(-kinds // bucket))

    def draw(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("v")
        rng, v, sums = np.random.default_rng([seed, int(key[0])]), x["v"].to_numpy(), np.zeros((replicates, 2))
        for i in range(0, len(x), 1024):
            n = rng.poisson(x["m"].to_numpy()[i : i + 1024], (replicates, len(v[i : i + 1024])))
            sums += np.stack((n @ v[i : i + 1024], n.sum(1)), 1)
        return pd.DataFrame({"id": np.arange(replicates), "s": sums[:, 0], "n": sums[:, 1]})

    dealt = k.withColumn("b", F.pmod(F.xxhash64("v"), F.lit(buckets)).cast("int"))
    drawn = dealt.groupBy("b").applyInPandas(draw, "id long, s double, n double")
    return drawn.groupBy("id").agg((F.sum("s") / F.sum("n")).alias("v")).select("v")


def bootstrap_metric(df: DataFrame, columns: list[str], metric: Callable[[pd.DataFrame], float], replicates: int = 1000, level: float = 0.95, seed: int = 42, tasks: int = 8, most: int = 100_000) -> DataFrame:
    """estimate, low, high of any metric of a sample, which gets its rows as distinct values of columns with their count n.

    Such values are few for labels and predictions; more than `most` are an error. Fewer than five rows, or under nine tenths
    of replicates with a finite metric, give a null interval.
    """
    k = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    own = k.orderBy(*columns).limit(most + 1).toPandas()
    if len(own) > most:
        raise ValueError(f"more than {most} distinct rows of {', '.join(columns)}")
    schema, total = "estimate double, low double, high double", int(own["n"].sum())
    whole = float(metric(own)) if total else None
    if total < 5:
        return df.sparkSession.createDataFrame([(whole, None, None)], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = []
            for i in x["id"]:
                n = np.random.default_rng([seed, int(i)]).multinomial(total, own["n"] / total)
                out.append(float(metric(own.assign(n=n)[n > 0])))
            yield pd.DataFrame({"v": out})

    drawn = df.sparkSession.range(0, replicates, 1, tasks).mapInPandas(run, "v double").filter(~F.isnan("v") & (F.abs("v") < float("inf")))
    tail = (1.0 - level) / 2
    v = drawn.agg(F.array_sort(F.collect_list("v")).alias("v"))  # as many as replicates
    n = F.size("v")
    at = lambda share: F.when(n >= 0.9 * replicates, F.get("v", F.least(n - 1, (n * share).cast("int"))))
    return v.select(F.lit(whole).alias("estimate"), at(F.lit(tail)).alias("low"), at(F.lit(1 - tail)).alias("high"))
