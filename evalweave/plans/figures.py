"""Data of figures and reports: small frames made from one aggregate each. Drawing is left to the reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.operators import metrics, relations, selection
from evalweave.operators.labels import validity
from evalweave.operators.quantiles import quantiles


def class_diagnostics(conf: DataFrame, classes: list[str], extra: list[str], mark: float = 0.2) -> DataFrame:
    """truth, pred, n, share, marked over the whole grid of classes by classes and extra columns; marked cells get a label.

    The grid is as large as the taxonomy squared, so it is laid out and joined whatever the rows were.
    """
    spark = conf.sparkSession
    t = spark.createDataFrame([(c,) for c in classes], "truth string")
    p = spark.createDataFrame([(c,) for c in [*classes, *extra]], "pred string")
    cells = t.crossJoin(p).join(conf, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))
    share = F.coalesce(F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy("truth")), F.lit(0)), F.lit(0.0))
    return cells.withColumn("share", F.round(share, 6)).withColumn("marked", share >= mark)


def support_totals(df: DataFrame, l1: str, l2: str, l3: str) -> DataFrame:
    """level, label, n for the hierarchy's panel: sums of every level in one pass."""
    return relations.label_distribution(df, [l1, l2, l3]).select("level", "label", "n")


def series(df: DataFrame, family: str, collection: str, text_value: str, positive: bool = False) -> DataFrame:
    """family, collection, population, valid, missing, not_numeric, nonfinite, nonpositive, median, min, max of a field held as text."""
    kind = validity(F.col(text_value), positive)
    v = F.when(kind == "valid", F.trim(text_value).try_cast("double"))
    x = df.select(F.struct(family, collection).alias("_key"), v.alias("_v"), kind.alias("_kind"))
    n = lambda name: F.count_if(F.col("_kind") == name).alias(name)
    g = x.groupBy("_key").agg(F.count(F.lit(1)).alias("population"), *[n(k) for k in ("valid", "missing", "not_numeric", "nonfinite", "nonpositive")], F.min("_v").alias("min"), F.max("_v").alias("max"))
    m = quantiles(x, "_key", "_v", [0.5], ["median"]).withColumnRenamed("_key", "_own")
    return g.join(m, F.col("_key").eqNullSafe(F.col("_own")), "left").select("_key.*", *[c for c in g.columns if c != "_key"], "median")


def distribution(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """groups, value, mass: steps of the distribution of each group, with the point of mass 0 at its least value. Null is a group's own."""
    steps = selection.ecdf(df.select(F.struct(*groups).alias("_g"), value), "_g", value)
    start = steps.groupBy("_g").agg(F.min(value).alias(value)).withColumn("mass", F.lit(0.0))
    return start.unionByName(steps).select("_g.*", value, "mass")


def representatives(df: DataFrame, group: str, key: str, values: list[str]) -> DataFrame:
    """The class representatives with their proof: group, key, distance, rows, ties (rows as near), used and dropped (values
    whose interquartile range is not, or is, 0), and of each value v: v, v_low, v_median, v_high, v_iqr.
    """
    near = selection.medoid_distances(df, group, key, values)
    of = [c for v in values for c in (v, f"{v}_low", f"{v}_median", f"{v}_high")]
    # ties are counted by pre-aggregated distances: few to a group in any task
    best = near.groupBy(group).agg(F.min(F.struct("distance", key, *of)).alias("m"), F.count(F.lit(1)).alias("rows"))
    ties = near.groupBy(group, "distance").agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(F.min(F.struct("distance", "n")).alias("t")).select(F.col(group).alias("_of"), F.col("t.n").alias("ties"))
    own = best.join(ties, best[group].eqNullSafe(ties["_of"]))
    iqr = {v: F.col(f"m.{v}_high") - F.col(f"m.{v}_low") for v in values}
    names = lambda keep: F.array_join(F.array_compact(F.array(*[F.when(keep(iqr[v]), F.lit(v)) for v in values])), ",")
    return own.select(group, F.col(f"m.{key}").alias(key), F.col("m.distance").alias("distance"), "rows", "ties", names(lambda q: q > 0).alias("used"), names(lambda q: q <= 0).alias("dropped"), *[F.col(f"m.{c}").alias(c) for c in of], *[F.round(iqr[v], 9).alias(f"{v}_iqr") for v in values])


def source_representatives(df: DataFrame, group: str, source: str, channel: str, quality: str, values: list[str]) -> DataFrame:
    """group, source, channels, distance, rows, ties, ...: of the eligible sources of each group, one vote each, the one
    nearest to the group's medians of values (properties of the source) and of its chosen channels' mean quality.
    """
    pairs = channel_pairs(df, group, source, channel, quality)
    own = df.groupBy(group, source).agg(*[F.min(v).alias(v) for v in values])
    near = representatives(pairs.join(own, [group, source]).select(group, source, "quality", *values), group, source, ["quality", *values])
    return near.join(pairs.select(group, source, "channels"), [group, source])


def quartiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, q25, median, q75 of a figure such as the spectral centroid (linear quantiles)."""
    names = ["q25", "median", "q75"]
    n = df.groupBy(F.col(group).alias("_g")).agg(F.count(value).alias("n"))
    q = quantiles(df, group, value, [0.25, 0.5, 0.75], names)
    return n.join(q, n["_g"].eqNullSafe(q[group]), "left").select(F.col("_g").alias(group), "n", *[F.round(c, 6).alias(c) for c in names])


def channel_pairs(df: DataFrame, group: str, source: str, channel: str, quality: str) -> DataFrame:
    """group, source, channels array<long>, quality: each eligible source with its lowest one or two channels.

    Two channels where every group has a source with two, else one for all. The mean of the chosen ones' quality is the
    source's vote.
    """
    # a source's rows are cut to its two lowest channels before they meet: Spark bounds the rank in each task
    low = df.select(group, source, F.col(channel).alias("c"), F.col(quality).alias("q")).withColumn("_r", F.row_number().over(Window.partitionBy(group, source).orderBy("c", "q"))).filter("_r <= 2")
    s = low.groupBy(group, source).agg(F.array_sort(F.collect_list(F.struct("c", "q"))).alias("all"))
    most = s.groupBy(group).agg(F.max(F.size("all")).alias("m")).agg(F.least(F.lit(2), F.min("m")).alias("k"))
    own = s.crossJoin(F.broadcast(most)).filter(F.size("all") >= F.col("k")).withColumn("own", F.slice("all", F.lit(1), F.col("k")))
    mean = F.aggregate("own", F.lit(0.0), lambda a, x: a + x["q"].cast("double")) / F.col("k")
    return own.select(group, source, F.transform("own", lambda x: x["c"].cast("long")).alias("channels"), F.round(mean, 6).alias("quality"))


def performance_range(df: DataFrame, group: str, model: str, value: str, models: int) -> DataFrame:
    """group, low, high, gap_pp, at_low, at_high over models (ties: all names, sorted); null where a model has no figure."""
    w = df.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.collect_list(F.struct(F.col(model).alias("m"), F.col(value).alias("v"))).alias("each"))
    whole = F.col("n") == models
    at = lambda c: F.when(whole, F.array_join(F.array_sort(F.transform(F.filter("each", lambda x: x["v"] == F.col(c)), lambda x: x["m"])), ",")).alias(f"at_{c}")
    return w.select(group, F.when(whole, F.col("low")).alias("low"), F.when(whole, F.col("high")).alias("high"), F.when(whole, F.round((F.col("high") - F.col("low")) * 100, 4)).alias("gap_pp"), at("low"), at("high"))


def outcome_bars(df: DataFrame, group: str, states: list[str], state: Column) -> DataFrame:
    """group, state, n, start, share: the states' bars from left to right in the order given, those without rows included."""
    c = df.groupBy(group, state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
    grid = c.select(group).distinct().crossJoin(df.sparkSession.createDataFrame(list(enumerate(states)), "_at int, state string"))
    x = grid.join(c, [group, "state"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bars = relations.running_share(F.col("n"), [group], ["_at"])
    return x.select(group, "state", "n", *[F.round(v, 6).alias(k) for k, v in bars.items()])


def paired_control(df: DataFrame, group: str, measures: dict[str, tuple[str, str]]) -> DataFrame:
    """group, measure, a, b, delta_pp: shares of two runs on the same rows for each measure (a pair of boolean columns)."""
    g = df.groupBy(group).agg(*[F.avg(F.col(c).cast("double")).alias(f"{m}_{s}") for m, pair in measures.items() for s, c in zip("ab", pair, strict=True)])
    one = lambda m: F.struct(F.lit(m).alias("measure"), F.round(f"{m}_a", 6).alias("a"), F.round(f"{m}_b", 6).alias("b"), F.round((F.col(f"{m}_a") - F.col(f"{m}_b")) * 100, 4).alias("delta_pp"))
    return g.select(group, F.inline(F.array(*[one(m) for m in measures])))


def summary(df: DataFrame) -> DataFrame:
    """One row of the report's figures: rows, accuracies by level, the conditional ones and macro F1 of the leaf."""
    acc = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 6)
    top = df.agg(F.count(F.lit(1)).alias("total"), acc("ok1").alias("l1_accuracy"), acc("ok2").alias("l2_accuracy"), acc("ok3").alias("l3_accuracy"))
    leaf = metrics.level_summary(metrics.confusion(df)).select(F.col("macro_f1").alias("l3_macro_f1"))
    return top.crossJoin(metrics.conditional_accuracy(df)).crossJoin(leaf)  # one row each


def summary_plots(df: DataFrame, levels: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """The data of the nine summary pictures of a run with ok1 to ok3 and, by level, a truth and a prediction column: shares of
    each level's confusions, metrics of each level's classes, label counts, the funnel and the leaf's largest confusions.
    """
    out: dict[str, DataFrame] = {}
    for name, (truth, pred) in levels.items():
        conf = metrics.confusion(df, truth, pred)
        out[f"{name}_confusion"] = metrics.confusion_share(conf)
        out[f"{name}_classes"] = metrics.class_metrics(conf)
    out["labels"] = relations.label_distribution(df, [t for t, _ in levels.values()])
    out["funnel"] = metrics.cascade_funnel(df)
    out["top_confusions"] = metrics.top_confusions(conf)
    return out


def dataset_quality(df: DataFrame, group: str, key: str, features: list[str], shown: list[str]) -> dict[str, DataFrame]:
    """The data of a data set's picture: rows of each class, the classes' representatives, and the shown figures' distributions."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return {"counts": counts, "representatives": representatives(df, group, key, features)} | {f"{v}_distribution": selection.ecdf(df, group, v) for v in shown}


def spectra(waves: DataFrame, key: str, samples: str, rate: int, length: int, hop: int, nfft: int | None = None, floor: float = -60.0) -> DataFrame:
    """key, frequency, time, db, high: spectrograms of a few chosen recordings in decibels below the largest power of all of
    them, which all pictures share. What a recording is refused for is an error.
    """
    from evalweave.functions import signals

    def cells(batches):
        import pandas as pd

        for b in batches:
            for k, v in zip(b[key], b[samples], strict=True):
                f, t, power, _ = signals.spectrogram(v, rate, length, hop, nfft)
                yield pd.DataFrame({key: k, "frequency": list(f) * len(t), "time": [x for x in t for _ in f], "power": power.ravel()})

    kind = dict(waves.dtypes)[key]
    x = waves.select(key, samples).mapInPandas(cells, f"{key} {kind}, frequency double, time double, power double")
    top = x.agg(F.max("power").alias("high"))  # one row
    return x.crossJoin(top).select(key, "frequency", "time", (10 * F.log10(F.greatest(F.col("power") / F.col("high"), F.lit(10 ** (floor / 10))))).alias("db"), "high")
