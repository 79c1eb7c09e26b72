"""Quality rules: base counts, then robust multivariate outliers by language and source.

Each text gives counts (words, their characters, symbols, repeated lines, words in repeated 3-word windows), and these a
vector of transformed statistics. For each (lang, source), each lang and the whole corpus the minimum-covariance-
determinant estimate is sought: from medians and quartiles, and again from mean and covariance of all rows, concentration
steps take the H closest rows of the group by Mahalanobis distance and re-estimate mean and covariance from them, until the
determinant settles; the less of the two determinants decides. All rows count in each step: thresholds come from exact histograms of distances, sums are
pre-aggregated before they are shuffled, so no group, however large, meets in a task.
A document is judged by the first of its three groups that has at least LEAST rows and rejected beyond CUTOFF.

Only rows that pass the base rules are fitted. FLOORS, added to the covariances, keep statistics that are the same in most
documents (no symbols at all, say) from turning small deviations into outliers.

Null text: no words, so base_failed. Null lang or source: a value of its own. Null doc_id, repeated rows: each is a row of
the result, judged alike. An empty table: no rows. Corpora with under LEAST rows: base rules alone. Other columns of the
documents, whatever their names, pass through `filter_documents` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, small

#: Statistics of the vector and the standard deviation that each has at least.
FLOORS = {"log_words": 0.5, "word_length": 0.5, "symbol_share": 0.005, "dup_line_share": 0.1, "repeat_share": 0.15, "distinct_share": 0.1}
P = len(FLOORS)
#: Share of the rows that estimates rest on, and rows of a group at least.
H, LEAST = 0.75, 60
#: Groups up to which models are broadcast, at some 300 bytes each.
BROADCAST = 20_000
#: Change of the determinant's logarithm below which a group has settled, and steps after which what is found counts.
SETTLED, STEPS = 1e-2, 20
#: Squared distance that a normal vector of this size exceeds once in a thousand million.
CUTOFF = 54.0
#: Histogram steps: of a statistic in floors, of a distance by factors of two.
_PER_FLOOR, _PER_OCTAVE = 16, 64
_SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text: str | None) -> tuple[int, int, int, int, int, int, int]:
    """The five counts, then lines that hold a word and distinct words."""
    if not text:
        return 0, 0, 0, 0, 0, 0, 0
    words = text.encode().split()
    n, seen = len(words), {}
    chars = len(text) - sum(text.count(c) for c in _SPACE)
    symbols = sum(text.count(c) for c in _SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    repeated = 0
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    if n >= 3:
        k = len(seen)
        pair = ids[:-1] * k + ids[1:]
        if k > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1]
        key = pair[:-1] * k + ids[2:]
        order = np.argsort(key, kind="stable")
        s = key[order]
        equal = s[1:] == s[:-1]
        if equal.any():
            twice = np.zeros(len(s), bool)
            twice[order[1:][equal]] = True
            twice[order[:-1][equal]] = True
            inside = np.zeros(n, bool)
            for i in range(3):
                inside[i : i + len(s)] |= twice
            repeated = int(inside.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), len(seen)


def _measure():
    @F.pandas_udf("struct<" + ",".join(f"{c}:long" for c in COUNTS) + ",base_failed:boolean,x:array<double>>")
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for own in texts:
            c = np.array([counts(t) for t in own], np.int64).reshape(-1, 7)
            n, chars, symbols, dup, rep, lines, distinct = c.T
            one = np.maximum(n, 1)
            x = np.stack([np.log(one), chars / one, symbols / np.maximum(chars, 1), dup / np.maximum(lines, 1), rep / one, distinct / one], 1)
            del own
            yield pd.DataFrame(dict(zip(COUNTS, c.T[:5], strict=True)) | {"base_failed": (n < 50) | (100 * rep > 50 * n), "x": list(x)})
        give_back()

    return measure


def measure(text: Column) -> Column:
    """struct<counts, base_failed, x>; only the text goes to Python."""
    return _measure()(text)


def statistics(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source) -> doc_id, lang, source, counts, base_failed, x array<double>."""
    return docs.select("doc_id", "lang", "source", measure(F.col("text")).alias("m")).select("doc_id", "lang", "source", "m.*")


def _groups(lang: str = "lang", source: str = "source") -> list[Column]:
    """Names of a row's groups, from the narrowest; null differs from any string."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in (lang, source))
    return [F.to_json(F.array(lang, source)), F.to_json(F.array(lang)), F.lit("[]")]


#: Columns: of a vector, a mean, and the upper triangle of an inverse covariance. Plain doubles, as arrays cost far more here.
_X, _M = [f"x{i}" for i in range(P)], [f"m{i}" for i in range(P)]
_V = [f"v{i}_{j}" for i in range(P) for j in range(i, P)]


def _with_distance(df: DataFrame) -> DataFrame:
    """Adds distance, the squared Mahalanobis distance of a row's vector under its model. Null without a model."""
    apart = df.select("*", *[(F.col(x) - F.col(m)).alias(f"_{x}") for x, m in zip(_X, _M, strict=True)])
    terms = (F.col(f"_x{i}") * F.col(f"_x{j}") * F.col(f"v{i}_{j}") * (1.0 if i == j else 2.0) for i in range(P) for j in range(i, P))
    return apart.withColumn("distance", reduce(lambda a, b: a + b, terms)).drop(*[f"_{x}" for x in _X])


def _bin() -> Column:
    """Of a distance; rounding may make it a little less than 0."""
    return F.floor(F.log2(F.greatest("distance", F.lit(0.0)) + 1) * _PER_OCTAVE)


def _chi2_cdf(x: float, df: int) -> float:
    """For an even df."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(df // 2))


def consistency(share: float = H, p: int = P) -> float:
    """What the covariance of the closest share of normal rows is too small by."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, p) < share else (low, mid)
    return share / _chi2_cdf(low, p + 2)


def _at_share(bins: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """bins (keys, bin, n) -> keys, total, and for each share the first bin up to which so many rows lie. As many rows of a key as bins."""
    w = Window.partitionBy(*keys)
    run = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    return run.groupBy(*keys).agg(F.max("total").alias("total"), *[F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * s), F.col("bin"))).alias(f"q{i}") for i, s in enumerate(shares)])


_MODEL = "grp string, start int, total long, " + ", ".join(f"{c} double" for c in (*_M, *_V, "logdet"))
_SUMS = [f"s{i}" for i in range(P + len(_V))]


def _sums() -> list[Column]:
    products = [F.col(_X[i]) * F.col(_X[j]) for i in range(P) for j in range(i, P)]
    return [F.sum(c).alias(s) for s, c in zip(_SUMS, [*map(F.col, _X), *products], strict=True)]


def _model(grp: pd.Series, start, total: pd.Series, mean: np.ndarray, cov: np.ndarray, logdet) -> pd.DataFrame:
    inv = np.linalg.inv(cov)
    upper = inv[:, *np.triu_indices(P)]
    return pd.DataFrame({"grp": grp, "start": start, "total": total} | dict(zip(_M, mean.T, strict=True)) | dict(zip(_V, upper.T, strict=True)) | {"logdet": logdet})


def _estimated(sums: DataFrame, scale: float) -> DataFrame:
    """sums (grp, start, total, n, sums) -> the model of each: mean and covariance of the n rows, times scale, plus floors."""
    floors = np.array(list(FLOORS.values()))

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = b[_SUMS].to_numpy() / b[["n"]].to_numpy()
            mean, cov = s[:, :P], np.zeros((len(s), P, P))
            cov[:, *np.triu_indices(P)] = s[:, P:]
            cov = cov + np.triu(cov, 1).transpose(0, 2, 1) - mean[:, :, None] * mean[:, None, :]
            cov = cov * scale + np.diag(floors**2)
            yield _model(b["grp"], b["start"], b["total"], mean, cov, np.linalg.slogdet(cov)[1])

    return sums.mapInPandas(estimate, _MODEL)


def _starts(rows: DataFrame) -> DataFrame:
    """What each group's concentration starts from. rows (grp, vector)."""
    floors = np.array(list(FLOORS.values()))
    cells = rows.select("grp", F.posexplode(F.array(*[F.floor(F.col(x) * _PER_FLOOR / float(f)) for x, f in zip(_X, floors, strict=True)])).alias("k", "bin"))
    quarters = _at_share(cells.groupBy("grp", "k", "bin").agg(F.count(F.lit(1)).alias("n")), ["grp", "k"], [0.25, 0.5, 0.75])
    packed = quarters.filter(F.col("total") >= LEAST).groupBy("grp").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("k", "q0", "q1", "q2"))).alias("q"))
    packed = materialize(packed, "mcd-quartiles")

    def quartiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = np.array([[[z["q0"], z["q1"], z["q2"]] for z in q] for q in b["q"]], float).reshape(-1, P, 3)
            mean, spread = (v[:, :, 1] + 0.5) * floors / _PER_FLOOR, (v[:, :, 2] - v[:, :, 0]) * floors / _PER_FLOOR / 1.349
            yield _model(b["grp"], 0, b["total"], mean, (spread**2 + floors**2)[:, :, None] * np.eye(P), math.inf)

    sums = rows.join(small(packed.select("grp", "total"), BROADCAST), "grp").groupBy("grp").agg(F.lit(1).alias("start"), F.max("total").alias("total"), F.count(F.lit(1)).alias("n"), *_sums())
    return packed.mapInPandas(quartiles, _MODEL).union(_estimated(sums, 1.0).withColumn("logdet", F.lit(math.inf)))


def fit(stats: DataFrame) -> DataFrame:
    """stats (lang, source, base_failed, x) -> grp, total, mean (m0, ...) and inverse covariance (v0_0, ...) of each group with LEAST rows."""
    vector = [F.get("x", F.lit(i)).alias(x) for i, x in enumerate(_X)]
    passed = materialize(stats.filter("not base_failed").select(F.array(*_groups()).alias("groups"), *vector), "mcd-rows")
    rows = passed.select(F.explode("groups").alias("grp"), *_X)
    now, done, scale = materialize(_starts(rows), "mcd-start"), [], consistency()
    for _ in range(STEPS):
        now = small(now, 2 * BROADCAST)
        near = _with_distance(rows.join(now, "grp")).select("grp", "start", _bin().alias("bin"))
        limit = materialize(_at_share(near.groupBy("grp", "start", "bin").agg(F.count(F.lit(1)).alias("n")), ["grp", "start"], [H]).select("grp", "start", "q0").join(now, ["grp", "start"]), "mcd-limit")
        closest = _with_distance(rows.join(small(limit, 2 * BROADCAST), "grp")).filter(_bin() <= F.col("q0"))
        sums = closest.groupBy("grp", "start").agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("n"), *_sums())
        was = now.select("grp", "start", F.col("logdet").alias("was"))
        step = materialize(_estimated(sums, scale).join(was, ["grp", "start"]), "mcd-step")
        settled = F.abs(F.col("was") - F.col("logdet")) <= SETTLED
        done.append(step.filter(settled).drop("was"))
        now = step.filter(~settled).drop("was")
        if not now.limit(1).count():
            break
    found = reduce(DataFrame.unionByName, [*done, now])
    # as many rows of a group as starts
    best = found.groupBy("grp").agg(F.min_by(F.struct("total", *_M, *_V), F.struct(F.round("logdet", 9), "start")).alias("m"))
    return materialize(best.select("grp", "m.*"), "mcd")


def _judged(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """measured (lang, source, m: what measure gives, ...) -> the same with distance (null: no group) and kept.

    The model that judges is looked up by (lang, source) in a table with a row for each that occurs: Spark broadcasts it
    where it is small.
    """
    names = measured.select(F.col(lang).alias("lang"), F.col(source).alias("source"), "m.base_failed", "m.x")
    model, columns = fit(names), measured.columns
    narrow, wide, _ = _groups()
    groups = names.groupBy("lang", "source").agg(F.lit(1).alias("one")).select(narrow.alias("k0"), wide.alias("k1"))
    for k in (0, 1):
        groups = groups.join(model.select(F.col("grp").alias(f"k{k}"), F.struct(*_M, *_V).alias(f"g{k}")), f"k{k}", "left")
    whole = model.filter("grp = '[]'").first()
    last = [] if whole is None else [F.struct(*[F.lit(whole[c]).alias(c) for c in (*_M, *_V)])]
    chosen = materialize(groups.select(F.col("k0").alias("_k"), F.coalesce("g0", "g1", *last).alias("g")).select("_k", "g.*"), "mcd-by-group")
    vector = [F.get("m.x", F.lit(i)).alias(x) for i, x in enumerate(_X)]
    out = _with_distance(measured.select("*", *vector, _groups(lang, source)[0].alias("_k")).join(small(chosen, BROADCAST), "_k", "left"))
    return out.select(*columns, "distance", (~F.col("m.base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"))


def judge(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source) -> doc_id, lang, source, counts, base_failed, x, distance (null: no group), kept."""
    measured = materialize(docs.select("doc_id", "lang", "source", measure(F.col("text")).alias("m")), "statistics")
    return _judged(measured).select("doc_id", "lang", "source", "m.*", "distance", "kept")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, all columns. They are written once with their statistics, and never shuffled."""
    # columns are numbered meanwhile, so that no name clashes with those of the method
    own = [f"c{i}" for i in range(len(docs.columns))]
    at = {c.lower(): n for c, n in zip(docs.columns, own, strict=True)}
    measured = docs.toDF(*own).withColumn("m", measure(F.col(at["text"])))
    kept = _judged(materialize(measured, "measured"), at["lang"], at["source"]).filter("kept")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(own, docs.columns, strict=True)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", F.round("distance", 3).alias("distance"))
