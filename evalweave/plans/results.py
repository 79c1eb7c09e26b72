"""Queries over saved answers, runs, sources, figures' windows and profiles. Their tables are made from the driver's by
expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.functions import options, views
from evalweave.operators import answers as ans
from evalweave.operators import labels, metrics, relations, selection, validation
from evalweave.plans import figures
from evalweave.plans.catalogue import CLASSES, PRED_A, PRED_B, _BASE, query, read

#: Of each leaf its first and second level.
TAXONOMY = {"click": ("passive", "browse"), "view": ("passive", "browse"), "error": ("active", "fault"), "purchase": ("active", "account"), "signup": ("active", "account")}
_L1 = "CASE WHEN {0} IN ('click', 'view') THEN 'passive' WHEN {0} IN ('error', 'purchase', 'signup') THEN 'active' END"
_L2 = "CASE WHEN {0} IN ('click', 'view') THEN 'browse' WHEN {0} = 'error' THEN 'fault' WHEN {0} IN ('purchase', 'signup') THEN 'account' END"
_STEPS = [
    ["event_id AS id", "user_id", f"{_L1.format('event_type')} AS l1", f"{_L2.format('event_type')} AS l2", "event_type AS l3", f"{PRED_A} AS said"],
    ["*", "CASE WHEN id % 11 = 0 THEN 'unknown' WHEN id % 7 = 0 THEN CASE WHEN l1 = 'active' THEN 'passive' ELSE 'active' END ELSE l1 END AS t1"],
    ["*", "t1 <> l1 AS skipped", "CASE WHEN t1 = 'unknown' THEN 'invalid_format' ELSE 'valid_option' END AS t1_status", "CASE WHEN t1 <> l1 THEN 'cascade_error' ELSE said END AS leaf"],
    ["id", "user_id", "l1", "l2", "l3", "t1", "t1_status", "skipped", "leaf", f"{_L1.format('leaf')} AS t2_l1", f"{_L2.format('leaf')} AS t2_l2", "CASE WHEN skipped THEN NULL WHEN leaf = 'unknown' THEN 'invalid_format' ELSE 'valid_option' END AS t2_status"],
]
_ANSWERS = "events"
for _step in _STEPS:
    _ANSWERS = f"(SELECT {', '.join(_step)} FROM {_ANSWERS}) q"
_BROKEN = ["id", "user_id", "l1", "CASE WHEN id % 83 = 0 THEN 'x' ELSE l2 END AS l2", "l3", "t1", "CASE WHEN id % 97 = 0 THEN 'other' WHEN id % 101 = 0 AND t1 = 'unknown' THEN 'valid_option' ELSE t1_status END AS t1_status", "CASE WHEN id % 103 = 0 THEN NOT skipped ELSE skipped END AS skipped", "CASE WHEN id % 89 = 0 THEN 'alien' ELSE leaf END AS leaf", "t2_l1", "CASE WHEN id % 107 = 0 THEN 'fault' ELSE t2_l2 END AS t2_l2", "t2_status"]
_STATE = "CASE WHEN t1_status = 'invalid_format' THEN 'T1 invalid' WHEN skipped THEN 'T1 wrong' WHEN t2_status = 'invalid_format' THEN 'T2 invalid' WHEN leaf = l3 THEN 'Leaf correct' ELSE 'T2 leaf wrong' END"
_LEGACY = "CASE WHEN skipped THEN 'T1 wrong / unresolved' WHEN leaf = l3 THEN 'Leaf correct' ELSE 'T2 leaf wrong / unresolved' END"


def answers(spark, d) -> DataFrame:
    out = read(spark, d, "events")
    for step in _STEPS:
        out = out.selectExpr(*step)
    return out


def _states_sql(state: str, names: list[str]) -> str:
    return f"WITH s AS (SELECT {state} AS state, count(*) AS n FROM {_ANSWERS} GROUP BY 1) SELECT state, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT sum(n) FROM s), 6) AS share FROM (SELECT unnest({names}) AS state) LEFT JOIN s USING (state)"


@query(_states_sql(_STATE, metrics.STRICT_STATES))
def outcome_decomposition(spark, d):
    return metrics.outcomes(answers(spark, d))


@query(_states_sql(_LEGACY, metrics.LEGACY_STATES))
def outcome_legacy(spark, d):
    return metrics.outcomes(answers(spark, d), strict=False)


@query(f"""WITH a AS (SELECT * FROM {_ANSWERS}), b AS (SELECT {', '.join(_BROKEN)}, a.l2 AS m_l2, a.skipped AS own, a.leaf AS had FROM a WHERE id % 79 <> 0),
f AS (SELECT CASE WHEN l2 <> m_l2 THEN 'truth' WHEN leaf = 'alien' THEN 'label' WHEN skipped <> own THEN 'gate' WHEN t1_status = 'other' OR (t1_status = 'invalid_format') <> (t1 = 'unknown') THEN 'first status'
  WHEN t2_l2 IS NOT NULL AND t2_l2 <> {_L2.format('leaf')} THEN 'hierarchy' ELSE 'none' END AS fault FROM b
  UNION ALL SELECT 'no answer' FROM a WHERE id % 79 = 0)
SELECT fault, count(*) AS n FROM f GROUP BY 1""")
def canonical_faults(spark, d):
    own = answers(spark, d)
    found = ans.canonical(own.filter("id % 79 <> 0").selectExpr(*_BROKEN), own.select("id", "l1", "l2", "l3"), TAXONOMY)
    return found.groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH k AS (SELECT l3 AS truth, leaf AS pred, count(*) AS n FROM {_ANSWERS} WHERE l3 <> 'view' GROUP BY ALL), c AS (SELECT truth, pred, CASE WHEN truth = 'click' AND pred = 'error' THEN -n ELSE n END AS n FROM k) SELECT fault, count(*) AS n FROM (SELECT CASE WHEN pred = 'unknown' THEN 'predicted label' ELSE 'count' END AS fault FROM c WHERE pred = 'unknown' OR n < 0 UNION ALL SELECT 'no support') GROUP BY 1")
def confusion_faults(spark, d):
    c = metrics.confusion(answers(spark, d).filter("l3 <> 'view'"), "l3", "leaf")
    c = c.withColumn("n", F.when((F.col("truth") == "click") & (F.col("pred") == "error"), -F.col("n")).otherwise(F.col("n")))
    return ans.count_faults(c, CLASSES, ["cascade_error"])


@query("SELECT count(*) AS keys, round(avg(a), 6) AS agreement, round(sum(k) / sum(n), 6) AS parse_rate FROM (SELECT user_id, max(n) / sum(n) AS a, sum(n) AS n, coalesce(sum(n) FILTER (pred <> 'unknown'), 0) AS k FROM (SELECT user_id, pred, count(*) AS n FROM (" + _BASE + ") GROUP BY ALL) GROUP BY user_id)")
def vote_summary(spark, d):
    return metrics.vote_summary(read(spark, d, "events").withColumn("pred", F.expr(PRED_A)), "user_id", "pred")


_KEYWORDS = [("license", "legal"), ("password", "secret"), ("the", "english"), ("der", "german")]


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN NULL " + " ".join(f"WHEN contains(lower(text), '{k}') THEN '{v}'" for k, v in _KEYWORDS) + " END AS label FROM documents")
def keyword_match(spark, d):
    return read(spark, d, "documents").select("doc_id", options.first_keyword(F.col("text"), _KEYWORDS).alias("label"))


@query("SELECT event_type, rank() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY event_type")
def first_seen_codes(spark, d):
    return selection.first_seen_codes(read(spark, d, "events"), "event_type", "event_id")


@query("SELECT p_brand, p_retailprice, round(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) / count(*) OVER (PARTITION BY p_brand), 9) AS mass FROM part")
def ecdf_steps(spark, d):
    return selection.ecdf_steps(read(spark, d, "part"), "p_brand", "p_retailprice")


_MEDOID = """q AS (SELECT {g}, {parts}, count(*) AS rows FROM x GROUP BY {g}),
z AS (SELECT x.*, rows, {own}, round({distance}, 9) AS distance FROM x JOIN q USING ({g})),
t AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY distance, {k}) AS r, count(*) OVER (PARTITION BY {g}, distance) AS ties FROM z)
SELECT {g}, {k}, distance, rows, ties, concat_ws(',', {used}) AS used, concat_ws(',', {dropped}) AS dropped, {out} FROM t WHERE r = 1"""


def _medoid_sql(rows: str, g: str, k: str, values: list[str]) -> str:
    q = lambda v, n, s: f"quantile_cont({v}, {s}) AS {v}_{n}"
    iqr = lambda v: f"({v}_high - {v}_low)"
    return f"WITH {rows}, " + _MEDOID.format(
        g=g, k=k,
        parts=", ".join(q(v, n, s) for v in values for n, s in (("low", 0.25), ("median", 0.5), ("high", 0.75))),
        own=", ".join(f"{v}_low, {v}_median, {v}_high" for v in values),
        distance=" + ".join(f"CASE WHEN {iqr(v)} > 0 THEN (({v} - {v}_median) / {iqr(v)}) ^ 2 ELSE 0 END" for v in values),
        used=", ".join(f"CASE WHEN {iqr(v)} > 0 THEN '{v}' END" for v in values),
        dropped=", ".join(f"CASE WHEN {iqr(v)} <= 0 THEN '{v}' END" for v in values),
        out=", ".join(f"{v}, {v}_low, {v}_median, {v}_high" for v in values) + ", " + ", ".join(f"round({iqr(v)}, 9) AS {v}_iqr" for v in values),
    )


@query(_medoid_sql("x AS (SELECT p_brand, p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice::DOUBLE AS price, 1.0::DOUBLE AS one FROM part)", "p_brand", "p_partkey", ["size", "price", "one"]))
def class_representatives(spark, d):
    x = read(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"), F.lit(1.0).alias("one"))
    return figures.representatives(x, "p_brand", "p_partkey", ["size", "price", "one"])


_PAIRS = "s AS (SELECT l_returnflag, l_orderkey, count(*) AS n, list({'c': l_linenumber, 'q': l_quantity} ORDER BY l_linenumber, l_quantity) AS a, min(CAST(l_extendedprice AS DOUBLE)) AS price FROM lineitem GROUP BY ALL), k AS (SELECT least(2, min(m)) AS k FROM (SELECT max(n) AS m FROM s GROUP BY l_returnflag)), x AS (SELECT l_returnflag, l_orderkey, array_to_string(list_transform(a[1:k], lambda x: x.c), ',') AS channels, round(list_avg(list_transform(a[1:k], lambda x: CAST(x.q AS DOUBLE))), 6) AS quality, price FROM s, k WHERE n >= k)"


@query(_medoid_sql(_PAIRS, "l_returnflag", "l_orderkey", ["quality", "price"]).replace("SELECT l_returnflag, l_orderkey, distance", "SELECT l_returnflag, l_orderkey, channels, distance"))
def source_medoid(spark, d):
    x = read(spark, d, "lineitem").withColumn("price", F.col("l_extendedprice").cast("double"))
    out = figures.source_representatives(x, "l_returnflag", "l_orderkey", "l_linenumber", "l_quantity", ["price"])
    return out.withColumn("channels", F.array_join(F.transform("channels", lambda c: c.cast("string")), ","))


_SOURCE = ["'s' || CAST(event_id % 500 AS VARCHAR(20)) AS source_id", "CAST(event_id AS INT) AS channel", "event_type AS l3", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE 16000 END AS fs", "event_id % 500 % 7 + CASE WHEN event_id % 333 = 0 THEN 1 ELSE 0 END AS frames"]


@query(f"WITH x AS (SELECT {', '.join(_SOURCE)} FROM events WHERE event_id < 4000), g AS (SELECT source_id, count(DISTINCT l3) AS a, count(DISTINCT fs) + CAST(max(CAST(fs IS NULL AS INT)) AS BIGINT) AS b, count(DISTINCT frames) AS c FROM x GROUP BY 1) SELECT source_id, 'agreement' AS fault, concat_ws(',', CASE WHEN a > 1 THEN 'l3' END, CASE WHEN b > 1 THEN 'fs' END, CASE WHEN c > 1 THEN 'frames' END) AS differ FROM g WHERE a > 1 OR b > 1 OR c > 1")
def source_fields_agree(spark, d):
    x = read(spark, d, "events").filter("event_id < 4000").selectExpr(*[e.replace("VARCHAR(20)", "STRING") for e in _SOURCE])
    return validation.source_faults(x, "source_id", "channel", ["l3", "fs", "frames"])


@query(f"""WITH b AS (SELECT event_id AS id, truth = pred AS ok_a, truth = pred_b AS ok_b, pred AS pred_a, pred_b FROM ({_BASE})),
f AS (SELECT id, CASE WHEN id % 41 = 0 THEN 'not in the first run' WHEN id % 43 = 0 THEN 'second run' END AS fault FROM b WHERE id % 37 <> 0 UNION ALL SELECT id, 'not paired' FROM b WHERE id % 37 = 0 AND id % 41 <> 0)
SELECT id, fault FROM f WHERE fault IS NOT NULL""")
def raw_run_faults(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("truth"), F.expr(PRED_A).alias("pred_a"), F.expr(PRED_B).alias("pred_b"))
    pairs = e.select("id", "pred_a", "pred_b", (F.col("truth") == F.col("pred_a")).alias("ok_a"), (F.col("truth") == F.col("pred_b")).alias("ok_b"))
    run = lambda x: pairs.select("id", F.col(f"pred_{x}").alias("pred"), F.col(f"ok_{x}").alias("ok"))
    broken = pairs.filter("id % 37 <> 0").withColumn("ok_b", F.when(F.col("id") % 43 == 0, ~F.col("ok_b")).otherwise(F.col("ok_b")))
    return ans.raw_run_faults(broken, run("a").filter("id % 41 <> 0"), run("b"))


@query("WITH w AS (SELECT o_orderkey, o_orderkey % 9000 + 1 AS frames, 16000.0 / (o_custkey % 400 + 50) AS s FROM orders), x AS (SELECT *, least(frames, greatest(1, CAST(round_even(24 * s, 0) AS BIGINT))) AS n FROM w) SELECT o_orderkey, CAST(floor((frames - n) / 2) AS BIGINT) AS start, CAST(floor((frames - n) / 2) AS BIGINT) + n AS stop, round(n / s, 8) AS shown, n = frames AS whole FROM x")
def symbol_window(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 9000 + 1).cast("long").alias("frames"), (F.lit(16000.0) / (F.col("o_custkey") % 400 + 50)).alias("s"))
    w = o.select("o_orderkey", views.centred_window(F.col("frames"), F.col("s"), 24).alias("w"))
    return w.select("o_orderkey", "w.start", "w.stop", F.round("w.shown", 8).alias("shown"), "w.whole")


_BAND = ["event_id", "CAST(event_id % 9000 + 1 AS DOUBLE) AS centre", "CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 700 AS DOUBLE) END AS low", "CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 900 AS DOUBLE) END AS high", "CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 300 + 10 AS DOUBLE) END AS width"]


@query(f"""WITH w AS (SELECT {', '.join(_BAND)} FROM events), b AS (SELECT *, coalesce(width, greatest(200.0, centre * 0.1)) / 2 AS half FROM w),
c AS (SELECT *, coalesce(low, centre - half) AS a, coalesce(high, centre + half) AS z, CASE WHEN low IS NOT NULL THEN 'band' WHEN width IS NOT NULL THEN 'centre and width' ELSE 'centre' END AS origin FROM b),
p AS (SELECT *, greatest((z - a) * 0.1, 46.875) AS pad FROM c), s AS (SELECT *, greatest(0.0, a - pad) AS f, least(8000.0, z + pad) AS t FROM p)
SELECT event_id, round(f, 6) AS "from", round(t, 6) AS "to", f <> a - pad OR t <> z + pad AS clipped, origin FROM s WHERE a < z AND f < t""")
def display_band(spark, d):
    w = read(spark, d, "events").selectExpr(*_BAND)
    b = w.select("event_id", views.display_band(F.col("centre"), F.col("low"), F.col("high"), F.col("width"), F.lit(16000.0), F.lit(15.625)).alias("b")).filter("b is not null")
    return b.select("event_id", F.round("b.from", 6).alias("from"), F.round("b.to", 6).alias("to"), "b.clipped", "b.origin")


@query("WITH p AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), z AS (SELECT vec_id, i, round(CAST(v AS DOUBLE) * 8) AS z FROM p WHERE i % 5 <> 0), f AS (SELECT vec_id, z, min(i) AS i FROM z GROUP BY vec_id, z) SELECT vec_id, count(*) AS points, string_agg(CAST(i AS VARCHAR), ',' ORDER BY z) AS speeds FROM f GROUP BY vec_id")
def profile_cleaning(spark, d):
    """Depths are coarse steps of a vector's elements, so that many are equal, with every fifth missing; speeds are positions."""
    e = read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v, i: F.when((i + 1) % 5 != 0, F.round(v.cast("double") * 8))).alias("z"), F.transform("embedding", lambda v, i: (i + 1).cast("double")).alias("c"))
    x = e.select("vec_id", views.clean_profile(F.col("z"), F.col("c")).alias("p"))
    return x.select("vec_id", F.size("p").cast("long").alias("points"), F.array_join(F.transform("p", lambda p: p["c"].cast("long").cast("string")), ",").alias("speeds"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, abs(l_discount::DOUBLE - l_tax::DOUBLE) <= greatest(0.011, 0.2 * greatest(abs(l_discount::DOUBLE), abs(l_tax::DOUBLE))) AS near FROM lineitem")
def closeness(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", views.is_close(F.col("l_discount"), F.col("l_tax"), 0.2, 0.011).alias("near"))


@query("SELECT max(v) AS high, min(v) AS low FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)")
def shared_range(spark, d):
    return relations.shared_range(read(spark, d, "embeddings"), "embedding")


@query()
def identity_seed(spark, d):
    return read(spark, d, "events").select("event_id", views.identity_seed(F.array(F.lit("42"), "event_type", F.col("event_id").cast("string"))).alias("seed"))


_STATE_OF = "CASE event_id % 5 WHEN 0 THEN 'zero' WHEN 1 THEN 'invalid' WHEN 2 THEN 'nonzero' ELSE 'missing' END"
_KIND_OF = "CASE WHEN event_id % 2 = 0 THEN 'ship' ELSE 'waveform' END"


@query(f"SELECT finding, count(*) AS n FROM (SELECT CASE WHEN s = 'zero' THEN 'definite' WHEN s = 'invalid' THEN 'invalid' WHEN s = 'missing' AND k = 'ship' AND event_id % 7 = 0 THEN 'review' WHEN event_id % 3 = 0 THEN 'missing recording' END AS finding FROM (SELECT event_id, {_STATE_OF} AS s, {_KIND_OF} AS k FROM events)) WHERE finding IS NOT NULL GROUP BY finding")
def audit_findings(spark, d):
    meta = F.concat(F.lit('{"out": {"tl_db": null, "estimated_transmission_loss_db": '), (F.col("event_id") % 7).cast("string"), F.lit("}}"))
    e = read(spark, d, "events")
    found = labels.audit_finding(F.expr(_STATE_OF), F.expr(_KIND_OF), labels.saved_gain(meta, "out"), F.col("event_id") % 3 == 0)
    return e.select(found.alias("finding")).filter("finding is not null").groupBy("finding").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 19 = 0 THEN 'no header' WHEN o_orderkey % 23 = 0 THEN 'label o_orderstatus' END AS fault FROM orders WHERE o_orderkey % 19 = 0 OR o_orderkey % 23 = 0")
def header_registration(spark, d):
    m = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    index = m.filter("id % 19 <> 0").withColumn("o_orderstatus", F.when(F.col("id") % 23 == 0, "?").otherwise(F.col("o_orderstatus")))
    return validation.header_registration(m, index, ["o_orderstatus"])


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 4 = 1 THEN 'k/p' || page_id || '.wav' ELSE 'a/p' || page_id || '.wav' END AS audio, CASE page_id % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS n_audio FROM pages")
def first_audio(spark, d):
    p = read(spark, d, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.lit("k").alias("l3"))
    at = lambda folder: F.concat(F.lit(folder), "id", F.lit(".wav")).alias("path")
    files = p.filter("page_id % 4 = 1").select(at("k/")).unionByName(p.filter("page_id % 4 > 1").select(at("a/"))).unionByName(p.filter("page_id % 4 = 3").select(at("b/c/")))
    return validation.first_audio(p, files).select("page_id", "audio", F.col("n_audio").cast("int").alias("n_audio"))


@query("SELECT event_type AS model, CASE WHEN event_type = 'view' THEN 'no run' ELSE 'run signature' END AS fault FROM (SELECT DISTINCT event_type FROM events) WHERE event_type IN ('view', 'click')")
def signed_run_faults(spark, d):
    models = read(spark, d, "events").select(F.col("event_type").alias("model")).distinct()
    runs = models.filter("model <> 'view'").withColumn("run_signature", F.sha2("model", 256))
    said = models.withColumn("run_signature", F.when(F.col("model") == "click", "?").otherwise(F.sha2("model", 256)))
    return ans.signed_run_faults(runs, said)


@query("SELECT event_id, CASE WHEN event_id % 29 = 0 THEN 'no answer' WHEN event_id % 31 = 0 THEN 'several answers' ELSE 'no text' END AS fault FROM events WHERE event_id % 29 = 0 OR event_id % 31 = 0 OR event_id % 37 = 0")
def batch_guard(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("event_type").alias("answer"))
    said = e.filter("event_id % 29 <> 0").withColumn("answer", F.when(F.col("event_id") % 37 != 0, F.col("answer")))
    return ans.batch_guard(e, said.unionByName(said.filter("event_id % 31 = 0")), "event_id", "answer")


@query("SELECT 'unseen' AS event_type")
def missing_classes(spark, d):
    return validation.missing_classes(read(spark, d, "events"), "event_type", [*CLASSES, "unseen"])


@query("WITH c AS (SELECT event_id % 13 AS profile, count(*) AS n FROM events WHERE event_id < 1000 GROUP BY 1) SELECT profile, n, round(n / sum(n) OVER (), 6) AS share, count(*) OVER () = 1 AS all_same FROM c")
def draw_audit(spark, d):
    return relations.draw_audit(read(spark, d, "events").filter("event_id < 1000").select((F.col("event_id") % 13).alias("profile")), "profile")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i % 7 = 3 ORDER BY event_id LIMIT 400")
def shard_rows(spark, d):
    return selection.shard(read(spark, d, "events").select("event_id"), ["event_id"], 7, 3, 400)


@query(f"WITH c AS (SELECT truth, pred, count(*) AS n FROM ({_BASE}) GROUP BY ALL), l AS (SELECT * FROM c WHERE truth <> pred ORDER BY n DESC, truth DESC, pred DESC LIMIT 15) SELECT 'confusion' AS plot, truth || '>' || pred AS item, CAST(n AS DOUBLE) AS v FROM c UNION ALL SELECT 'top', truth || '>' || pred, n FROM l UNION ALL SELECT 'labels', truth, sum(n) FROM c GROUP BY truth")
def summary_plots(spark, d):
    from evalweave.plans.catalogue import predictions

    x = figures.summary_plots(predictions(spark, d), {"leaf": ("truth", "pred")})
    row = lambda df, plot, item, v: df.select(F.lit(plot).alias("plot"), item.alias("item"), v.cast("double").alias("v"))
    pair = F.concat("truth", F.lit(">"), "pred")
    return row(x["leaf_confusion"], "confusion", pair, F.col("n")).unionByName(row(x["top_confusions"], "top", pair, F.col("n"))).unionByName(row(x["labels"], "labels", F.col("label"), F.col("n")))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def dataset_quality(spark, d):
    x = read(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"))
    return figures.dataset_quality(x, "p_brand", "p_partkey", ["size", "price"], ["price"])["counts"]


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'one/' || p_partkey WHEN p_partkey % 3 = 1 THEN 'new/' || p_size || '/f' || p_partkey ELSE 'c/d' || p_partkey END AS path FROM part")
def relocated_inputs(spark, d):
    own = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("a/b/x"), F.col("p_partkey").cast("string"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a/b/"), F.col("p_size").cast("string"), F.lit("/f"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("c/d"), F.col("p_partkey").cast("string")))
    used = read(spark, d, "part").select("p_partkey", own.alias("path"))
    moves = used.filter("p_partkey % 3 = 0").select(F.col("path").alias("old"), F.concat(F.lit("one/"), F.col("p_partkey").cast("string")).alias("new")).unionByName(spark.createDataFrame([("a/b/", "new/"), ("a/", "wrong/")], "old string, new string"))
    return validation.relocated(used, moves, "path")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'm' || page_id WHEN 1 THEN 'n' || page_id END AS meta, CASE page_id % 4 WHEN 0 THEN 'path' WHEN 1 THEN 'name' WHEN 2 THEN 'several' ELSE 'none' END AS meta_from FROM pages")
def external_metadata(spark, d):
    p = read(spark, d, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"))
    doc = lambda part, folder, x: p.filter(f"page_id % 4 = {part}").select(F.concat(F.lit(folder), "id", F.lit(".json")).alias("path"), F.concat(F.lit(x), F.col("page_id").cast("string")).alias("meta"))
    docs = doc(0, "k/", "m").unionByName(doc(0, "o/", "x")).unionByName(doc(1, "o/", "n")).unionByName(doc(2, "o/", "x")).unionByName(doc(2, "q/", "y"))
    return validation.external_metadata(p, docs, F.concat(F.lit("k/"), "id", F.lit(".json"))).select("page_id", "meta", "meta_from")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey % 5 * 1000 END AS rate, CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey END AS frames, CASE WHEN o_orderkey % 5 < 2 THEN 'index' WHEN o_orderkey % 5 < 4 THEN 'file' ELSE 'none' END AS header_from FROM orders")
def with_headers(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5 * 1000).alias("rate"), F.col("o_orderkey").alias("frames"))
    return validation.with_headers(o.select("o_orderkey"), o.filter("o_orderkey % 5 < 2"), o.filter("o_orderkey % 5 < 4").withColumn("rate", F.col("rate")), "o_orderkey")


@query("SELECT event_id, event_type AS l1, 'x' AS l2, 'y' || event_id AS l3 FROM events")
def embedded_labels(spark, d):
    meta = F.to_json(F.struct(F.struct(F.col("event_type").alias("L1"), F.lit(" x ").alias("L2"), F.concat(F.lit("y"), F.col("event_id").cast("string")).alias("L3")).alias("gt")))
    return read(spark, d, "events").select("event_id", F.inline(F.array(labels.embedded_labels(meta))))
