"""Queries by name over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalweave.functions import arrays, options, text
from evalweave.operators import cascade, intervals, metrics, relations, selection
from evalweave.operators.quantiles import cumulative

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Predictions for events by a fixed rule: classes, in order, and what an event's number makes of the truth.
CLASSES = ["click", "error", "purchase", "signup", "view"]
#: Their names in option texts, by level.
EVENT_ALIASES = {"l1": {"passive": ["click", "view"], "active": ["error", "purchase", "signup"]}, "l3": {c: [c] for c in CLASSES}}
_NEXT = "CASE event_type WHEN 'click' THEN 'error' WHEN 'error' THEN 'purchase' WHEN 'purchase' THEN 'signup' WHEN 'signup' THEN 'view' ELSE 'click' END"
_L1 = "CASE WHEN {} IN ('click', 'view') THEN 'passive' WHEN {} = 'unknown' THEN 'unknown' ELSE 'active' END"


def _pred(a: int, b: int) -> str:
    return f"CASE WHEN (event_id * {a} + {b}) % 10 < 6 THEN event_type WHEN (event_id * {a} + {b}) % 10 < 8 THEN {_NEXT} ELSE 'unknown' END"


PRED_A, PRED_B = _pred(7919, 13), _pred(104729, 5)
_BASE = f"SELECT event_id, user_id, value, props, event_type AS truth, {PRED_A} AS pred, {PRED_B} AS pred_b FROM events"
_LEVELS = f"SELECT *, {_L1.format('truth', 'truth')} = {_L1.format('pred', 'pred')} AS ok1, truth = pred OR event_id % 5 = 0 AS ok2, truth = pred AS ok3, event_id % 11 <> 0 AS valid FROM ({_BASE}) q"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, value, props, truth, pred, pred_b, ok1 to ok3, valid; and as a canonical answer l3, leaf, skipped, t1_status, t2_status."""
    e = read(spark, sf_dir, "events").withColumns({"pred": F.expr(PRED_A), "pred_b": F.expr(PRED_B)}).withColumnRenamed("event_type", "truth")
    family = lambda c: F.expr(_L1.format(c, c))
    return e.withColumns({"ok1": family("truth") == family("pred"), "ok2": (F.col("truth") == F.col("pred")) | (F.col("event_id") % 5 == 0), "ok3": F.col("truth") == F.col("pred"), "valid": F.col("event_id") % 11 != 0}).withColumns(
        {
            "l3": F.col("truth"),
            "skipped": ~F.col("valid") | ~F.col("ok1"),
            "leaf": F.when(F.col("valid") & F.col("ok1"), F.col("pred")).otherwise("cascade_error"),
            "t1_status": F.when(F.col("valid"), "valid_option").otherwise("invalid_format"),
            "t2_status": F.when(F.col("valid") & F.col("ok1"), F.when(F.col("pred") == "unknown", "invalid_format").otherwise("valid_option")),
        }
    )


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


_CLASS_SQL = f"""
WITH p AS ({_BASE}), c AS (SELECT truth, pred, count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT truth AS label, n AS support, 0 AS predicted, CASE WHEN truth = pred THEN n ELSE 0 END AS tp FROM c UNION ALL SELECT pred, 0, n, 0 FROM c),
g AS (SELECT label, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(tp) AS BIGINT) AS tp FROM s GROUP BY label),
m AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0.0) AS p, coalesce(tp / nullif(support, 0), 0.0) AS r FROM g),
f AS (SELECT label, support, tp, predicted - tp AS fp, support - tp AS fn, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 4) AS f1 FROM m)
"""


@query(_CLASS_SQL + "SELECT * FROM f")
def level_metrics(spark, d):
    return metrics.class_metrics(metrics.confusion(predictions(spark, d)))


@query(_CLASS_SQL + "SELECT (SELECT CAST(sum(n) AS BIGINT) FROM c) AS n, (SELECT round(sum(CASE WHEN truth = pred THEN n END) / sum(n), 6) FROM c) AS accuracy, (SELECT round(avg(f1), 4) FROM f WHERE support > 0) AS macro_f1")
def level_summary(spark, d):
    return metrics.level_summary(metrics.confusion(predictions(spark, d)))


@query(f"SELECT truth, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY truth), 6) AS share FROM ({_BASE}) GROUP BY truth, pred")
def confusion_share(spark, d):
    return metrics.confusion_share(metrics.confusion(predictions(spark, d)))


@query(f"SELECT truth, pred, count(*) AS n FROM ({_BASE}) WHERE truth <> pred GROUP BY truth, pred ORDER BY n DESC, truth DESC, pred DESC LIMIT 15")
def top_confusion_pairs(spark, d):
    return metrics.top_confusions(metrics.confusion(predictions(spark, d)))


@query(_CLASS_SQL + "SELECT * FROM f WHERE support > 0 ORDER BY f1, label LIMIT 3")
def worst_classes(spark, d):
    return metrics.class_metrics(metrics.confusion(predictions(spark, d))).filter("support > 0").orderBy("f1", "label").limit(3)


@query(f"SELECT round(coalesce(count(*) FILTER (ok2 AND ok1) / nullif(count(*) FILTER (ok1), 0), 0), 6) AS l2_given_l1, round(coalesce(count(*) FILTER (ok3 AND ok2) / nullif(count(*) FILTER (ok2), 0), 0), 6) AS l3_given_l2 FROM ({_LEVELS})")
def conditional_accuracy(spark, d):
    return metrics.conditional_accuracy(predictions(spark, d))


@query(f"SELECT count(*) AS n_all, count(*) FILTER (ok1) AS n_l1, count(*) FILTER (ok1 AND ok2) AS n_l1_l2, count(*) FILTER (ok1 AND ok2 AND ok3) AS n_l3 FROM ({_LEVELS})")
def cascade_funnel(spark, d):
    return metrics.cascade_funnel(predictions(spark, d))


@query(f"SELECT CASE WHEN NOT valid THEN 0 WHEN pred = 'unknown' THEN 3 WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS tier, count(*) AS n FROM ({_LEVELS}) GROUP BY 1")
def parse_tier_hist(spark, d):
    # an invalid event stands for one that was not asked; every third prompt spells its options with marks between
    names = [*CLASSES, "none of these"]
    prompt = lambda spell: F.lit("What was it?\nOptions:\n" + "\n".join(f"{chr(65 + i)}. {spell(x)}" for i, x in enumerate(names)))
    letter = F.element_at(F.array(*[F.lit(chr(65 + i)) for i in range(len(names))]), F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, CLASSES)), F.col("pred")), F.lit(0)), F.lit(len(names))).cast("int"))
    said = options.parse(letter, F.when(F.col("event_id") % 3 == 0, prompt("-".join)).otherwise(prompt(str.capitalize)), EVENT_ALIASES)
    tier = F.when(~F.col("valid"), 0).otherwise(said["parse_tier"])
    return predictions(spark, d).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


_PAIR = f"SELECT user_id, truth = pred AS a, truth = pred_b AS b, truth FROM ({_BASE})"
_COUNTS = "count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither"


def _pairs(spark, d):
    p = predictions(spark, d)
    return p.select("user_id", "truth", (F.col("truth") == F.col("pred")).alias("a"), (F.col("truth") == F.col("pred_b")).alias("b"))


@query(f"SELECT user_id, {_COUNTS} FROM ({_PAIR}) GROUP BY user_id")
def cluster_discordance(spark, d):
    return intervals.discordant(_pairs(spark, d), ["user_id"])


@query(f"WITH c AS (SELECT {_COUNTS} FROM ({_PAIR})), x AS (SELECT *, \"both\" + only_a + only_b + neither AS n, only_a - only_b AS dd FROM c) SELECT \"both\", only_a, only_b, neither, round(dd / n, 6) AS delta, round(dd / n - {intervals.Z95} * sqrt(greatest(0.0, only_a + only_b - dd * dd / n)) / n, 6) AS low, round(dd / n + {intervals.Z95} * sqrt(greatest(0.0, only_a + only_b - dd * dd / n)) / n, 6) AS high FROM x")
def paired_diff_interval(spark, d):
    return intervals.paired_difference(intervals.discordant(_pairs(spark, d)))


@query(f"WITH c AS (SELECT truth, count(*) AS n, count(*) FILTER (truth = pred) AS k FROM ({_BASE}) GROUP BY truth), x AS (SELECT *, k / n AS p, {intervals.Z95} AS z FROM c) SELECT truth, n, k, round(greatest(0.0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1.0, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS high FROM x")
def wilson_interval(spark, d):
    c = predictions(spark, d).groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") == F.col("pred")).alias("k"))
    low, high = intervals.wilson(F.col("k"), F.col("n"))
    return c.select("truth", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query()
def cluster_bootstrap(spark, d):
    p = predictions(spark, d).select("user_id", "truth", F.col("pred").alias("pred_a"), "pred_b")
    return intervals.cluster_bootstrap(p, "user_id", CLASSES)


@query("SELECT user_id, CAST(sum(n) AS BIGINT) AS votes, round(max(n) / sum(n), 6) AS agreement FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def vote_agreement(spark, d):
    return metrics.vote_agreement(read(spark, d, "events"), "user_id", "event_type")


@query("WITH x AS (SELECT abs(l_quantity * 2000 - l_extendedprice) AS e, abs(l_extendedprice) AS t FROM lineitem) SELECT round(avg(e), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(CASE WHEN t >= 1e-9 THEN e / t END) * 100, 4) AS mape, round(avg(CAST(e <= 5000 AS INT)), 6) AS within FROM x")
def error_metrics(spark, d):
    return metrics.error_metrics(read(spark, d, "lineitem").withColumn("pred", F.col("l_quantity") * 2000), "pred", "l_extendedprice", 5000.0)


_STRATA = "SELECT e.*, CASE WHEN value <= q1 THEN 0 WHEN value <= q2 THEN 1 ELSE 2 END AS stratum FROM ({}) e JOIN (SELECT truth, quantile_cont(value, 1.0 / 3) AS q1, quantile_cont(value, 2.0 / 3) AS q2 FROM ({}) GROUP BY truth) q USING (truth)".format(_BASE, _BASE)


@query(f"SELECT truth, stratum, count(*) AS n, min(value) AS low, max(value) AS high FROM ({_STRATA}) GROUP BY truth, stratum")
def tertile_strata(spark, d):
    s = selection.tertile_strata(predictions(spark, d), "truth", "value")
    return s.groupBy("truth", "stratum").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query(f"WITH c AS (SELECT truth, stratum, avg(CAST(truth = pred AS INT)) AS recall FROM ({_STRATA}) GROUP BY ALL) SELECT stratum, count(*) AS groups, CASE WHEN count(*) = (SELECT count(DISTINCT truth) FROM c) THEN round(avg(recall), 6) END AS macro_recall FROM c GROUP BY stratum")
def stratified_macro_recall(spark, d):
    s = selection.tertile_strata(predictions(spark, d), "truth", "value").withColumn("ok", F.col("truth") == F.col("pred"))
    return selection.stratified_recall(s, "truth")


@query(f"WITH m AS (SELECT truth, 'a' AS model, round(avg(CAST(truth = pred AS INT)), 6) AS v FROM ({_BASE}) GROUP BY truth UNION ALL SELECT truth, 'b', round(avg(CAST(truth = pred_b AS INT)), 6) FROM ({_BASE}) GROUP BY truth), x AS (SELECT *, min(v) OVER w AS low, max(v) OVER w AS high FROM m WINDOW w AS (PARTITION BY truth)) SELECT truth, low, high, round((high - low) * 100, 4) AS gap_pp, string_agg(CASE WHEN v = low THEN model END, ',' ORDER BY model) AS at_low, string_agg(CASE WHEN v = high THEN model END, ',' ORDER BY model) AS at_high FROM x GROUP BY truth, low, high")
def model_envelope(spark, d):
    p = predictions(spark, d)
    share = lambda c: F.round(F.avg((F.col("truth") == F.col(c)).cast("double")), 6)
    m = p.groupBy("truth").agg(share("pred").alias("a"), share("pred_b").alias("b"))
    models = F.array(F.struct(F.lit("a").alias("m"), F.col("a").alias("v")), F.struct(F.lit("b").alias("m"), F.col("b").alias("v")))
    at = lambda v: F.array_join(F.transform(F.filter(models, lambda x: x["v"] == v), lambda x: x["m"]), ",")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return m.select("truth", low.alias("low"), high.alias("high"), F.round((high - low) * 100, 4).alias("gap_pp"), at(low).alias("at_low"), at(high).alias("at_high"))


@query("SELECT p_partkey, p_brand, p_retailprice, rank, pool_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, count(*) OVER (PARTITION BY p_brand) AS pool_size FROM part) WHERE rank <= least(40, pool_size)")
def quality_rank_pool(spark, d):
    return selection.rank_pool(read(spark, d, "part"), "p_brand", "p_retailprice", "p_partkey", 20).select("p_partkey", "p_brand", "p_retailprice", F.col("rank").cast("long").alias("rank"), "pool_size")


@query("SELECT p_partkey, p_brand, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5('42' || p_partkey), p_partkey) AS rank FROM part) WHERE rank <= 10")
def hash_sample(spark, d):
    return selection.hash_sample(read(spark, d, "part"), "p_brand", "p_partkey", 10, "42").select("p_partkey", "p_brand", F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT DISTINCT event_type, user_id FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('42' || user_id), user_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM s),
e AS (SELECT *, CAST(n AS DOUBLE) * 0.7 AS x0, CAST(n AS DOUBLE) * 0.15 AS x1, CAST(n AS DOUBLE) * 0.15 AS x2 FROM r),
f AS (SELECT *, x0 - floor(x0) AS p0, x1 - floor(x1) AS p1, x2 - floor(x2) AS p2, n - floor(x0) - floor(x1) - floor(x2) AS l FROM e),
g AS (SELECT *, floor(x0) + CAST(CAST(p1 > p0 AS INT) + CAST(p2 > p0 AS INT) < l AS INT) AS a, floor(x1) + CAST(CAST(p0 >= p1 AS INT) + CAST(p2 > p1 AS INT) < l AS INT) AS b FROM f)
SELECT event_type, user_id, CASE WHEN k <= a THEN 'train' WHEN k <= a + b THEN 'val' ELSE 'test' END AS split FROM g""")
def group_split(spark, d):
    return selection.group_split(read(spark, d, "events"), "event_type", "user_id", "42")


@query("WITH q AS (SELECT p_brand, quantile_cont(CAST(p_size AS DOUBLE), [0.25, 0.5, 0.75]) AS qa, quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS qb FROM part GROUP BY p_brand), n AS (SELECT p_brand, p_partkey, round(CASE WHEN qa[3] > qa[1] THEN pow((p_size - qa[2]) / (qa[3] - qa[1]), 2) ELSE 0 END + CASE WHEN qb[3] > qb[1] THEN pow((p_retailprice - qb[2]) / (qb[3] - qb[1]), 2) ELSE 0 END, 9) AS distance FROM part JOIN q USING (p_brand)), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY distance, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM n) SELECT p_brand, p_partkey, distance, n FROM r WHERE k = 1")
def robust_medoid(spark, d):
    return selection.robust_medoid(read(spark, d, "part").withColumn("p_size", F.col("p_size").cast("double")), "p_brand", "p_partkey", ["p_size", "p_retailprice"])


@query("SELECT event_type, value, round(sum(count(*)) OVER (PARTITION BY event_type ORDER BY value) / sum(count(*)) OVER (PARTITION BY event_type), 9) AS mass FROM events GROUP BY event_type, value")
def ecdf(spark, d):
    return selection.ecdf(read(spark, d, "events"), "event_type", "value")


@query("SELECT event_type, CASE WHEN event_id % 17 = 0 THEN 'missing' WHEN event_id % 19 = 0 THEN 'nonfinite' WHEN value - 5 <= 0 THEN 'nonpositive' ELSE 'valid' END AS validity, count(*) AS n FROM events GROUP BY ALL")
def ecdf_series_validity(spark, d):
    e = read(spark, d, "events")
    v = F.when(F.col("event_id") % 17 == 0, F.lit(None)).when(F.col("event_id") % 19 == 0, F.lit(float("inf"))).otherwise(F.col("value") - 5)
    x = e.withColumn("v", v)
    state = F.when(F.col("v").isNull(), "missing").when(F.isnan("v") | (F.abs("v") == float("inf")), "nonfinite").when(F.col("v") <= 0, "nonpositive").otherwise("valid")
    return x.groupBy("event_type", state.alias("validity")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, count(o_totalprice) AS count, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1")
def numeric_summary(spark, d):
    return selection.numeric_summary(read(spark, d, "orders"), "o_orderstatus", "o_totalprice")


@query("WITH x AS (SELECT r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT CASE WHEN grouping(r_name) = 0 THEN 'r_name' WHEN grouping(n_name) = 0 THEN 'n_name' ELSE 'c_mktsegment' END AS level, coalesce(r_name, n_name, c_mktsegment) AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM x), 6) AS share FROM x GROUP BY GROUPING SETS ((r_name), (n_name), (c_mktsegment))")
def label_distribution(spark, d):
    x = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return relations.label_distribution(x.select("r_name", "n_name", "c_mktsegment"), ["r_name", "n_name", "c_mktsegment"])


@query("SELECT CASE WHEN value < 5 THEN '<5' WHEN value < 20 THEN '[5,20)' WHEN value < 40 THEN '[20,40)' WHEN value < 100 THEN '[40,100)' ELSE '>=100' END AS bucket, count(*) AS n FROM events GROUP BY 1")
def bucket_histogram(spark, d):
    return read(spark, d, "events").groupBy(relations.bucket(F.col("value"), [5, 20, 40, 100]).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, count(DISTINCT round(l_discount, 10)) AS discounts, round(var_pop(l_quantity), 6) AS variance FROM lineitem")
def corr_gain(spark, d):
    return read(spark, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.count_distinct(F.round("l_discount", 10)).alias("discounts"), F.round(F.var_pop("l_quantity"), 6).alias("variance"))


@query("SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both, count(*) FILTER (b.k IS NULL) AS only_a, count(*) FILTER (a.k IS NULL) AS only_b FROM (SELECT DISTINCT doc_id AS k FROM documents) a FULL JOIN (SELECT DISTINCT doc_id AS k FROM labels) b ON a.k = b.k")
def coverage_check(spark, d):
    return relations.coverage(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id")


@query("SELECT count(*) AS rows, count(*) FILTER (NOT (o_orderkey IN (SELECT o_orderkey FROM orders))) AS missing, 0::BIGINT AS differ_o_orderstatus, count(*) FILTER (o_orderkey % 50 = 0) AS differ_o_totalprice FROM orders WHERE o_orderkey % 10 = 0")
def subset_agreement(spark, d):
    o = read(spark, d, "orders")
    part = o.filter("o_orderkey % 10 = 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return relations.agreement(part, o, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events), s AS (SELECT CASE WHEN k % 10 = 0 THEN 'zero' WHEN value < 5 THEN 'invalid' WHEN k IS NOT NULL THEN 'nonzero' ELSE 'missing' END AS state FROM e) SELECT state, count(*) AS n FROM s GROUP BY state")
def audit_status(spark, d):
    e = read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("long"))
    state = relations.evidence_state(F.array(F.col("k") % 10, F.col("k")), F.col("value") < 5)
    return e.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, count(*) AS n_questions, string_agg(text, chr(10) ORDER BY turn) AS questions FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id HAVING count(*) = 3")
def dialogue_questions(spark, d):
    c = read(spark, d, "conversations").filter((F.col("role") == "user") & (F.trim("text") != ""))
    q = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_questions"), F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("q")).filter("n_questions = 3")
    return q.select("conv_id", "n_questions", F.array_join(F.transform("q", lambda x: x["text"]), "\n").alias("questions"))


@query("WITH g AS (SELECT conv_id, count(*) AS n, max(turn) AS last, count(DISTINCT turn) AS turns, count(*) FILTER (trim(coalesce(text, '')) = '') AS blank FROM conversations GROUP BY conv_id) SELECT count(*) AS conversations, count(*) FILTER (n <> turns) AS repeated_turns, count(*) FILTER (last <> n - 1) AS gaps, count(*) FILTER (blank > 0) AS with_blank FROM g")
def dialogue_validation(spark, d):
    g = read(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"), F.count_distinct("turn").alias("turns"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))
    return g.agg(F.count(F.lit(1)).alias("conversations"), F.count_if(F.expr("n <> turns")).alias("repeated_turns"), F.count_if(F.expr("last <> n - 1")).alias("gaps"), F.count_if(F.col("blank") > 0).alias("with_blank"))


@query("WITH s AS (SELECT 'cw_' || p_partkey // 3 || CASE WHEN p_partkey % 2 = 0 THEN '_ch' ELSE '_CH' END || p_partkey % 3 AS id FROM part) SELECT regexp_replace(id, '(?i)_ch\\d+$', '') AS source, count(*) AS channels FROM s GROUP BY 1")
def source_id_normalise(spark, d):
    sid = F.concat(F.lit("cw_"), F.floor(F.col("p_partkey") / 3).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "_ch").otherwise("_CH"), (F.col("p_partkey") % 3).cast("string"))
    return read(spark, d, "part").groupBy(text.source_id(sid).alias("source")).agg(F.count(F.lit(1)).alias("channels"))


@query("WITH a AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN ' a ' WHEN 1 THEN 'B' WHEN 2 THEN 'c.' ELSE 'D' END AS answer FROM conversations) SELECT conv_id, turn, CASE upper(trim(answer)) WHEN 'A' THEN 'active' WHEN 'B' THEN 'passive' ELSE '' END AS label FROM a")
def option_parse(spark, d):
    a = read(spark, d, "conversations").withColumn("answer", F.element_at(F.array(F.lit(" a "), F.lit("B"), F.lit("c."), F.lit("D")), (F.col("conv_id") % 4 + 1).cast("int")))
    prompt = F.lit("Classify the sound by its source.\nOptions:\nA. Active - Deliberately transmitted signal\nB. Passive - Source-radiated noise\nReply with the letter only.")
    said = a.select("conv_id", "turn", options.parse(F.col("answer"), prompt, first_only=True).alias("said"))
    return said.select("conv_id", "turn", F.when(F.col("said.parse_status") == "valid_option", F.col("said.l1")).otherwise("").alias("label"))


_TERMS = ["the", "and", "license", "mail"]


@query("SELECT term, count(*) AS n FROM documents, (VALUES ('the'), ('and'), ('license'), ('mail')) v(term) WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || term || '($|[^a-z0-9])') GROUP BY term")
def term_boundary_match(spark, d):
    found = F.array_compact(F.array(*[F.when(text.contains_term(F.col("text"), t), F.lit(t)) for t in _TERMS]))
    return read(spark, d, "documents").select(F.explode(found).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query()
def longest_term_match(spark, d):
    found = text.match_terms(read(spark, d, "documents"), "doc_id", "text", ["general public license", "public license", "license", "mit license", "apache license"])
    return found.select("doc_id", F.array_join("terms", ",").alias("terms"))


@query("SELECT doc_id, trim(regexp_replace(translate('Ａ：' || lang || '　　' || source || '！', 'ＡＢ：！　', 'AB:! '), '\\s+', ' ', 'g')) AS narrow FROM documents")
def fullwidth_normalise(spark, d):
    wide = F.concat(F.lit("Ａ："), F.col("lang"), F.lit("　　"), F.col("source"), F.lit("！"))
    return read(spark, d, "documents").select("doc_id", text.narrow(wide).alias("narrow"))


@query("SELECT p_partkey, p_size * CASE p_partkey % 6 WHEN 0 THEN 0.001 WHEN 1 THEN 1000.0 WHEN 2 THEN 1000000.0 WHEN 3 THEN 1000000000.0 WHEN 4 THEN 0.001 ELSE 1.0 END AS v FROM part")
def unit_parse(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ["ms", " k Hz", "MHz", "ghz", " metres", "节"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", text.number_with_unit(F.concat(F.col("p_size").cast("string"), unit)).alias("v"))


@query("SELECT vec_id, round(list_aggregate(list_transform(generate_series(1, len(embedding) - 1), lambda i: CAST(embedding[i + 1] - embedding[i] AS DOUBLE)), 'var_pop'), 5) AS variance FROM embeddings")
def adjacent_gradient_variance(spark, d):
    v = F.col("embedding")
    return read(spark, d, "embeddings").select("vec_id", F.round(arrays.gradient_variance(F.sequence(F.lit(0), F.size(v) - 1), v), 5).alias("variance"))


@query("SELECT vec_id, round(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS peak, round(CAST(embedding[1] AS DOUBLE) / list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 6) AS first FROM embeddings")
def array_peak_norm(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))), 6).alias("peak"), F.round(F.get(arrays.peak_normalise(F.col("embedding")), F.lit(0)), 6).alias("first"))


@query("WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) AS p FROM embeddings) SELECT vec_id, round(list_sum(list_transform(generate_series(1, len(p)), lambda i: p[i] * (i - 1))) / nullif(list_sum(p), 0), 6) AS centroid FROM p")
def centroid(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("p"))
    return e.select("vec_id", F.round(arrays.centroid(F.sequence(F.lit(0), F.size("p") - 1), F.col("p")), 6).alias("centroid"))


@query("SELECT r_name, count(*) AS nations, count(*) FILTER (n_regionkey <> (n_nationkey * 7 + 1) % 5) AS broken FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_taxonomy(spark, d):
    # each nation is also labelled with a region by a rule; where the path of both labels isn't one of the taxonomy's it is broken
    tree = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    said = tree.withColumn("said", (F.col("n_nationkey") * 7 + 1) % 5)
    paths = tree.select(F.col("n_nationkey").alias("leaf"), F.col("r_regionkey").alias("parent"), F.lit(True).alias("whole"))
    j = said.join(paths, (F.col("n_nationkey") == F.col("leaf")) & (F.col("said") == F.col("parent")), "left")
    return j.groupBy("r_name").agg(F.count(F.lit(1)).alias("nations"), F.count_if(F.col("whole").isNull()).alias("broken"))


@query("WITH u AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 3 > 0), c AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, count(*) FILTER (n > 1) AS repeated FROM c")
def dedupe_union(spark, d):
    docs = read(spark, d, "documents").select("doc_id")
    return relations.union_check([docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 3 > 0")], "doc_id")

@query(f"WITH s AS (SELECT truth, CASE WHEN NOT ok1 THEN 0 WHEN NOT ok2 THEN 1 WHEN NOT ok3 THEN 2 ELSE 3 END AS state, count(*) AS n FROM ({_LEVELS}) GROUP BY ALL), w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY truth) AS DOUBLE) AS total, coalesce(sum(n) OVER (PARTITION BY truth ORDER BY state ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT truth, state, round(before / total, 6) AS start, round(n / total, 6) AS share FROM w")
def stacked_offsets(spark, d):
    state = F.when(~F.col("ok1"), 0).when(~F.col("ok2"), 1).when(~F.col("ok3"), 2).otherwise(3)
    c = predictions(spark, d).groupBy("truth", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("truth", "state", *[F.round(v, 6).alias(k) for k, v in relations.running_share(F.col("n"), ["truth"], ["state"]).items()])


@query("SELECT event_type, user_id, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY event_type ORDER BY user_id) - count(*) AS BIGINT) AS start FROM events GROUP BY event_type, user_id")
def cluster_offsets(spark, d):
    return cumulative(read(spark, d, "events"), "event_type", "user_id").select("event_type", "user_id", "n", (F.col("upto") - F.col("n")).alias("start"))


@query("WITH x AS (SELECT vec_id, list_transform(generate_series(1, len(embedding)), lambda i: {'a': -abs(embedding[i]), 'i': i - 1}) AS e FROM embeddings), s AS (SELECT vec_id, list_transform(list_sort(e), lambda z: z.i)[1:5] AS top FROM x) SELECT vec_id, array_to_string(list_sort(CASE WHEN list_contains(top, 0) THEN top ELSE list_append(top[1:4], 0) END), ',') AS slots FROM s")
def strongest_with_first(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.array_join(arrays.strongest_with_first(F.col("embedding"), 5).cast("array<string>"), ",").alias("slots"))


@query("WITH s AS (SELECT event_type, event_id % 8 AS shard FROM events) SELECT event_type, count(DISTINCT shard) = 8 AND min(shard) = 0 AND max(shard) = 7 AS complete FROM s GROUP BY event_type")
def shard_coverage(spark, d):
    s = read(spark, d, "events").select("event_type", (F.col("event_id") % 8).alias("shard")).distinct()
    return s.groupBy("event_type").agg((F.array_sort(F.collect_set("shard")) == F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("complete"))


@query("WITH t AS (SELECT *, CASE lang WHEN 'en' THEN ['tone', 'sweep'] WHEN 'de' THEN ['sweep', 'hum'] ELSE ['hum'] END AS own FROM documents) SELECT doc_id, array_to_string(list_filter(['hum', 'sweep', 'tone'], lambda x: NOT list_contains(own, x)), ',') AS rest, array_to_string(list_filter(own, lambda x: x IN ('sweep', source)), ',') AS shared, CAST(len(list_distinct(list_concat(own, ['sweep', source]))) AS INT) AS united FROM t")
def term_sets(spark, d):
    words = lambda *w: F.array(*map(F.lit, w))
    own = F.when(F.col("lang") == "en", words("tone", "sweep")).when(F.col("lang") == "de", words("sweep", "hum")).otherwise(words("hum"))
    other = F.array(F.lit("sweep"), F.col("source"))
    return read(spark, d, "documents").select("doc_id", F.array_join(F.array_except(words("hum", "sweep", "tone"), own), ",").alias("rest"), F.array_join(F.array_intersect(own, other), ",").alias("shared"), F.size(F.array_union(own, other)).alias("united"))


@query("SELECT page_id, regexp_replace(url, '^.*/', '') AS base, regexp_replace(url, '/[^/]*$', '') AS parent, sha256(replace(coalesce(html, ''), chr(13) || chr(10), chr(10))) AS digest FROM pages")
def path_and_digest(spark, d):
    p = read(spark, d, "pages")
    return p.select("page_id", F.regexp_replace("url", "^.*/", "").alias("base"), F.regexp_replace("url", "/[^/]*$", "").alias("parent"), F.sha2(F.replace(F.coalesce("html", F.lit("")), F.lit("\r\n"), F.lit("\n")), 256).alias("digest"))


@query("SELECT event_id, round(10 * log10(greatest(value / 50, 1e-6)), 6) AS db, round(20 * log10(greatest(value, 1e-40)), 6) AS scale_db, CAST(least(40, greatest(4, ceil(value * 0.7))) AS BIGINT) AS beams, round(sqrt(value * value + 9), 6) AS radius, round(atan2(value, 3), 6) AS phase FROM events")
def level_and_phase(spark, d):
    v = F.col("value")
    return read(spark, d, "events").select("event_id", F.round(arrays.decibels(v / 50, -60.0), 6).alias("db"), F.round(20 * F.log10(F.greatest(v, F.lit(1e-40))), 6).alias("scale_db"), F.least(F.lit(40), F.greatest(F.lit(4), F.ceil(v * 0.7))).cast("long").alias("beams"), F.round(F.hypot(v, F.lit(3.0)), 6).alias("radius"), F.round(F.atan2(v, F.lit(3.0)), 6).alias("phase"))


@query("SELECT vec_id, w = list_sort(list_distinct(w)) AS increasing FROM (SELECT vec_id, list_transform(generate_series(1, len(embedding)), lambda i: abs(CAST(embedding[i] AS DOUBLE)) + i * 0.25) AS w FROM embeddings)")
def increasing_check(spark, d):
    risen = F.transform("embedding", lambda v, i: F.abs(v.cast("double")) + (i + 1) * F.lit(0.25))
    return read(spark, d, "embeddings").select("vec_id", arrays.is_increasing(risen).alias("increasing"))


@query("WITH u AS (UNPIVOT (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax FROM lineitem) ON quantity, discount, tax INTO NAME metric VALUE v) SELECT l_returnflag, metric, count(v) AS count, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean FROM u GROUP BY ALL")
def metric_table(spark, d):
    x = read(spark, d, "lineitem").select("l_returnflag", *[F.col(f"l_{c}").cast("double").alias(c) for c in ("quantity", "discount", "tax")])
    u = x.unpivot("l_returnflag", ["quantity", "discount", "tax"], "metric", "v")
    return u.groupBy("l_returnflag", "metric").agg(F.count("v").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), F.round(F.avg("v"), 6).alias("mean"))


@query("SELECT l_orderkey, count(*) AS n, round(max(v), 6) AS max_delay, round(min(v), 6) AS min_delay, round(avg(v), 6) AS mean_delay, round(max(20 * log10(q)), 2) AS max_db, count(*) <= 2 AS sparse FROM (SELECT l_orderkey, CAST(l_extendedprice AS DOUBLE) AS v, CAST(l_quantity AS DOUBLE) AS q FROM lineitem) GROUP BY l_orderkey")
def arrival_summary(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("double").alias("v"), F.col("l_quantity").cast("double").alias("q"))
    return x.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("v"), 6).alias("max_delay"), F.round(F.min("v"), 6).alias("min_delay"), F.round(F.avg("v"), 6).alias("mean_delay"), F.round(F.max(20 * F.log10("q")), 2).alias("max_db"), (F.count(F.lit(1)) <= 2).alias("sparse"))


@query("SELECT l_orderkey, l_linenumber, round(v - min(v) OVER w, 6) AS delay, round(q / max(q) OVER w, 6) AS amplitude FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS v, CAST(l_quantity AS DOUBLE) AS q FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey)")
def rebased_arrivals(spark, d):
    w, x = Window.partitionBy("l_orderkey"), read(spark, d, "lineitem")
    v, q = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    return x.select("l_orderkey", "l_linenumber", F.round(v - F.min(v).over(w), 6).alias("delay"), F.round(q / F.max(q).over(w), 6).alias("amplitude"))


@query(f"WITH m AS (SELECT truth, avg(CAST(truth = pred AS INT)) AS a, avg(CAST(truth = pred_b AS INT)) AS b FROM ({_BASE}) GROUP BY truth) SELECT truth, round(b - a, 6) AS delta, round((b - a) * 100, 4) AS delta_pp FROM m")
def signed_deltas(spark, d):
    share = lambda c: F.avg((F.col("truth") == F.col(c)).cast("double"))
    m = predictions(spark, d).groupBy("truth").agg((share("pred_b") - share("pred")).alias("x"))
    return m.select("truth", F.round("x", 6).alias("delta"), F.round(F.col("x") * 100, 4).alias("delta_pp"))


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) = 1 AS consistent, count(*) AS orders FROM orders GROUP BY o_custkey")
def source_consistency(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg((F.count_distinct("o_orderstatus") == 1).alias("consistent"), F.count(F.lit(1)).alias("orders"))


@query("SELECT p_brand, 60::BIGINT AS required, count(*) AS available, count(*) FILTER (p_retailprice >= 1200) AS eligible, count(*) FILTER (p_retailprice >= 1200) < 60 AS insufficient FROM part GROUP BY p_brand")
def insufficient_classes(spark, d):
    e = F.count_if(F.col("p_retailprice") >= 1200)
    return read(spark, d, "part").groupBy("p_brand").agg(F.lit(60).cast("long").alias("required"), F.count(F.lit(1)).alias("available"), e.alias("eligible"), (e < 60).alias("insufficient"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'A' ELSE 'B' END AS letter, replace('a {L1} event', '{L1}', event_type) AS question FROM events")
def question_template(spark, d):
    return read(spark, d, "events").select("event_id", F.when(F.col("event_type").isin("click", "view"), "A").otherwise("B").alias("letter"), F.replace(F.lit("a {L1} event"), F.lit("{L1}"), F.col("event_type")).alias("question"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ' and ' || source WHEN 1 THEN source END AS field FROM documents")
def delimited_field(spark, d):
    own = F.concat(F.lit("【Lang】 : "), "lang", F.lit(" and "), "source", F.lit("。 . 【source】x"))
    line = F.when(F.col("doc_id") % 3 == 0, own).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("a b\nlang = "), "source", F.lit(",\nz"))).otherwise("language of it")
    return read(spark, d, "documents").select("doc_id", text.delimited_field(line, "lang").alias("field"))


def _mock_sql(turn: int, truth: str) -> str:
    limit = {1: "e666", 2: "cccd", 3: "b333"}[turn]
    return f"CASE WHEN substr(md5('42|{turn}|' || event_id), 1, 4) < '{limit}' THEN {truth} ELSE 'unknown' END"


@query(f"WITH e AS (SELECT event_id, {_L1.format('event_type', 'event_type')} AS l1, event_type AS l2, event_type || CAST(event_id % 3 AS VARCHAR) AS l3 FROM events), a AS (SELECT *, {_mock_sql(1, 'l1')} AS pred_1, {_mock_sql(2, 'l2')} AS said_2, {_mock_sql(3, 'l3')} AS said_3 FROM e), c AS (SELECT *, CASE WHEN pred_1 = l1 THEN said_2 ELSE 'cascade_error' END AS pred_2, CASE WHEN pred_1 = l1 THEN said_3 ELSE 'cascade_error' END AS pred_3 FROM a) SELECT event_id, pred_1, pred_2, pred_3, CASE pred_1 WHEN 'unknown' THEN 3 ELSE 1 END AS tier_1, CASE pred_2 WHEN 'cascade_error' THEN 0 WHEN 'unknown' THEN 3 ELSE 1 END AS tier_2, CASE pred_3 WHEN 'cascade_error' THEN 0 WHEN 'unknown' THEN 3 ELSE 1 END AS tier_3 FROM c")
def mock_cascade(spark, d):
    family = F.expr(_L1.format("event_type", "event_type"))
    e = read(spark, d, "events").select("event_id", family.alias("l1"), F.col("event_type").alias("l2"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("l3"))
    return cascade.cascade(e, "event_id", ["l1", "l2", "l3"], cascade.mock()).drop("l1", "l2", "l3")


def queries() -> dict[str, Query]:
    from evalweave.plans import formats, records, results  # noqa: F401  (they register their queries)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from evalweave.plans import formats, records, results  # noqa: F401

    return dict(_SQL)
