"""Queries over metadata, checks and figure data. Metadata is made from events by one expression that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalweave.functions import evidence
from evalweave.operators import channel, intervals, labels, metrics, reasoning, validation
from evalweave.plans import figures
from evalweave.plans.catalogue import _BASE, _LEVELS, CLASSES, predictions, query, read
from evalweave.sources import solver

_CATEGORY = "CASE event_id % 4 WHEN 0 THEN 'pulse' WHEN 1 THEN 'communication' WHEN 2 THEN 'radiated_noise' ELSE 'other' END"
_TYPE = "CASE event_id % 3 WHEN 0 THEN ' lfm' WHEN 1 THEN 'cargo_ship' ELSE 'QPSK' END"
_META = f"""'{{"signal_category": "' || {_CATEGORY} || '", "signal_type": "' || {_TYPE} || '", "sub_type": ' || CASE WHEN event_id % 5 = 0 THEN '"Fishing_Boat"' WHEN event_id % 5 = 1 THEN '""' ELSE 'null' END
|| ', "source_depth_m": ' || CASE WHEN event_id % 7 = 0 THEN '-1' WHEN event_id % 7 = 1 THEN 'true' ELSE '"' || CAST(event_id % 90 AS VARCHAR(20)) || '.5"' END
|| ', "geometry": {{"tx_depth_m": ' || CAST(event_id % 40 AS VARCHAR(20)) || ', "range_m": ' || CAST(event_id % 3 AS VARCHAR(20)) || '}}'
|| ', "signal_params": {{"band_low_hz": ' || CAST(event_id % 50 AS VARCHAR(20)) || ', "band_high_hz": ' || CAST(event_id % 60 AS VARCHAR(20))
|| CASE WHEN event_id % 6 = 0 THEN ', "carrier_freq_hz": 700' ELSE '' END || CASE WHEN event_id % 9 = 0 THEN ', "center_frequency_hz": "900"' ELSE '' END
|| ', "num_lines": ' || CAST(event_id % 11 AS VARCHAR(20)) || ', "line_frequency_range_hz": [' || CAST(event_id % 400 AS VARCHAR(20)) || ', ' || CAST(event_id % 2000 AS VARCHAR(20)) || '], "shaft_mod_coeff": 0.' || CAST(event_id % 3 AS VARCHAR(20)) || '}}'
|| ', "output": {{"summary": {{' || CASE WHEN event_id % 2 = 0 THEN '"num_arrivals": ' || CAST(event_id % 9 AS VARCHAR(20)) ELSE '' END || '}}, "arrivals_per_frequency": {{"50": 2, "60": ' || CAST(event_id % 4 AS VARCHAR(20)) || '}}}}}}'"""
_RECORDS = f"SELECT event_id, {_META} AS meta FROM events"


def records(spark, d):
    return read(spark, d, "events").select("event_id", F.expr(_META.replace("VARCHAR(20)", "STRING")).alias("meta"))


_RAW = f"lower(trim(CASE WHEN event_id % 5 = 0 THEN 'Fishing_Boat' ELSE {_TYPE} END))"
_SHIP = f"CASE {_RAW} WHEN 'fishing_boat' THEN 'fishing' WHEN 'cargo_ship' THEN 'cargo' ELSE {_RAW} END"


@query(f"SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'active' WHEN event_id % 4 = 2 THEN 'passive' ELSE 'unknown' END AS l1, CASE event_id % 4 WHEN 0 THEN 'pulse' WHEN 1 THEN 'communication' WHEN 2 THEN 'ship_noise' ELSE 'unknown' END AS l2, CASE WHEN event_id % 4 < 2 THEN upper({_SHIP}) WHEN event_id % 4 = 2 THEN {_SHIP} ELSE 'unknown' END AS l3 FROM events")
def key_label_extraction(spark, d):
    return records(spark, d).select("event_id", F.inline(F.array(labels.key_labels(F.col("meta")))))


@query(f"SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'actively transmitted' WHEN event_id % 4 = 2 THEN 'source-radiated' ELSE 'unknown' END AS l1, CASE event_id % 4 WHEN 0 THEN 'detection pulse' WHEN 1 THEN 'communication signal' WHEN 2 THEN 'ship-radiated noise' ELSE 'unknown' END AS l2, l3, CASE l3 WHEN 'QPSK' THEN 'QPSK (Quadrature Phase Shift Keying)' ELSE l3 END AS l3_display FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Fishing_Boat' ELSE {_TYPE} END AS l3 FROM events)")
def display_label_extraction(spark, d):
    return records(spark, d).select("event_id", F.inline(F.array(labels.display_labels(F.col("meta")))))


@query("SELECT event_id, CASE WHEN event_id % 7 < 2 THEN event_id % 40 ELSE event_id % 90 + 0.5 END::DOUBLE AS tx_depth_m, NULL::DOUBLE AS rx_depth_m, nullif(event_id % 3, 0)::DOUBLE AS range_m, NULL::DOUBLE AS water_depth_m FROM events")
def geometry_resolution(spark, d):
    return records(spark, d).select("event_id", F.inline(F.array(labels.geometry(F.col("meta")))))


_MIDDLE = "CASE WHEN event_id % 50 < event_id % 60 THEN (event_id % 50 + event_id % 60) / 2.0 END"


@query(f"SELECT event_id, CASE WHEN event_id % 6 = 0 AND (event_id % 4 = 1 OR event_id % 9 <> 0) THEN 700.0 WHEN event_id % 9 = 0 THEN 900.0 ELSE {_MIDDLE} END::DOUBLE AS value, CASE WHEN event_id % 6 = 0 AND (event_id % 4 = 1 OR event_id % 9 <> 0) THEN 'signal_params.carrier_freq_hz' WHEN event_id % 9 = 0 THEN 'signal_params.center_frequency_hz' WHEN {_MIDDLE} IS NOT NULL THEN 'signal_params.band_midpoint_hz' END AS origin, CASE WHEN event_id % 6 = 0 THEN 700.0 ELSE {_MIDDLE} END::DOUBLE AS solver FROM events")
def frequency_resolution(spark, d):
    leaf = F.when(F.col("event_id") % 4 == 1, "QPSK").otherwise("LFM")
    f = labels.source_frequency(F.col("meta"), leaf)
    return records(spark, d).select("event_id", f["value"].alias("value"), f["origin"].alias("origin"), labels.solver_frequency(F.col("meta")).alias("solver"))


_TEXT = "CASE event_id % 7 WHEN 0 THEN ' 1.5e1 ' WHEN 1 THEN 'abc' WHEN 2 THEN '-inf' WHEN 3 THEN '-3' WHEN 4 THEN 'true' WHEN 5 THEN '1e999' END"


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'valid' WHEN 1 THEN 'not_numeric' WHEN 2 THEN 'nonfinite' WHEN 3 THEN 'nonpositive' WHEN 4 THEN 'not_numeric' WHEN 5 THEN 'nonfinite' ELSE 'missing' END AS kind, CASE event_id % 7 WHEN 0 THEN 15.0 WHEN 3 THEN -3.0 END::DOUBLE AS v FROM events")
def number_validity(spark, d):
    t = F.expr(_TEXT)
    return read(spark, d, "events").select("event_id", labels.validity(t, True).alias("kind"), labels.number(t).alias("v"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id % 9 ELSE 2 + event_id % 4 END AS num_arrivals FROM events")
def channel_arrivals(spark, d):
    return records(spark, d).select("event_id", labels.channel_metrics(F.col("meta"), "env", "output")["num_arrivals"].alias("num_arrivals"))


@query("WITH e AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 5 AS VARCHAR) END AS a, CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 2 AS VARCHAR) END AS b FROM events) SELECT event_id, coalesce(a, b) AS value, CASE WHEN a IS NOT NULL THEN 'preferred' WHEN b IS NOT NULL THEN 'fallback' END AS origin, CASE WHEN a <> b THEN 'x.y' ELSE '' END AS conflicts FROM e")
def document_merge(spark, d):
    e = read(spark, d, "events")
    doc = lambda n, k: F.when(F.col("event_id") % k > 0, F.concat(F.lit('{"x": {"y": '), (F.col("event_id") % n).cast("string"), F.lit("}}"))).otherwise(F.lit('{"x": {}}'))
    m = e.select("event_id", labels.merged(doc(5, 3), doc(2, 4), ["x.y"]).alias("m"))
    return m.select("event_id", F.col("m.x_y.value").alias("value"), F.col("m.x_y.origin").alias("origin"), F.array_join(labels.conflicts(F.col("m"), ["x.y"]), ",").alias("conflicts"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'cargo' WHEN 1 THEN 'QPSK' WHEN 2 THEN 'warship' WHEN 3 THEN 'unknown' WHEN 4 THEN 'LFM' END AS label FROM events")
def saved_label_key(spark, d):
    t = F.expr("CASE event_id % 6 WHEN 0 THEN ' Cargo Ship' WHEN 1 THEN 'qpsk (four phases)' WHEN 2 THEN '军舰' WHEN 3 THEN 'unresolved' WHEN 4 THEN 'LFM脉冲' ELSE 'LFMX' END")
    return read(spark, d, "events").select("event_id", labels.saved_label(t).alias("label"))


@query("""SELECT event_id, CASE WHEN hi <= 250 THEN 'tonal components concentrated in the low-frequency band' WHEN lo < 250 AND hi <= 1200 THEN 'tonal components spread across the low-to-mid-frequency band' ELSE 'tonal components spanning a broad frequency range' END AS band,
CASE WHEN event_id % 11 <= 4 THEN 'sparse discrete tonal structure' WHEN event_id % 11 <= 7 THEN 'moderate-density discrete tonal structure' ELSE 'dense discrete tonal structure' END AS density FROM (SELECT event_id, event_id % 400 AS lo, event_id % 2000 AS hi FROM events)""")
def ship_evidence(spark, d):
    e = evidence.evidence(F.lit("cargo"), F.col("meta"), F.col("event_id").cast("string"))
    return records(spark, d).select("event_id", F.get(e, F.lit(0)).alias("band"), F.get(e, F.lit(1)).alias("density"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS first, CASE event_id % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'D' WHEN 2 THEN 'G' ELSE 'A' END AS second, 6 AS turns FROM events")
def dialogue_answers(spark, d):
    at = F.expr("CASE WHEN event_id % 2 = 0 THEN 'active' ELSE 'passive' END")
    leaf = F.expr("CASE event_id % 4 WHEN 0 THEN 'LFM' WHEN 1 THEN 'warship' WHEN 2 THEN 'QPSK' ELSE 'cargo' END")
    r = records(spark, d).withColumns({"l1": at, "l3": leaf})
    asked = [["Which kind of source?", "Is it sent or radiated?"], ["The signal is {L1}. Which type?"], ["Why?"]]
    x = evidence.dialogue(r, "event_id", "l1", "l3", "meta", asked, ["It is {L1}: {L3}."])
    say = lambda i: F.get("conversations", F.lit(i))["value"]
    return x.select("event_id", say(1).alias("first"), say(3).alias("second"), F.size("conversations").alias("turns"))


@query("SELECT event_id, CAST(least(8000, greatest(1000, ceil(value * 100))) AS INT) AS beams, CAST(CASE WHEN event_id % 3 = 0 AND least(8000, greatest(1000, ceil(value * 100))) < 8000 THEN least(8000, greatest(4000, 2 * least(8000, greatest(1000, ceil(value * 100))))) END AS INT) AS again FROM events")
def beam_counts(spark, d):
    n = solver.beams(F.col("value"))
    return read(spark, d, "events").select("event_id", n.alias("beams"), solver.more_beams(n, F.col("event_id") % 3).alias("again"))


_ALL = CLASSES + ["unknown"]


@query(f"WITH c AS (SELECT truth, pred, count(*) AS n FROM ({_BASE}) GROUP BY ALL), g AS (SELECT t AS truth, p AS pred FROM (SELECT unnest({CLASSES}) AS t), (SELECT unnest({_ALL}) AS p)), x AS (SELECT truth, pred, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (truth, pred)) SELECT *, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY truth), 0), 0), 6) AS share, coalesce(n / nullif(sum(n) OVER (PARTITION BY truth), 0), 0) >= 0.2 AS marked FROM x")
def class_diagnostics(spark, d):
    return figures.class_diagnostics(metrics.confusion(predictions(spark, d)), CLASSES, ["unknown"])


@query(f"SELECT count(*) AS total, round(avg(CAST(ok1 AS INT)), 6) AS l1_accuracy, round(avg(CAST(ok2 AS INT)), 6) AS l2_accuracy, round(avg(CAST(ok3 AS INT)), 6) AS l3_accuracy, round(count(*) FILTER (ok1 AND ok2) / count(*) FILTER (ok1), 6) AS l2_given_l1, round(count(*) FILTER (ok2 AND ok3) / count(*) FILTER (ok2), 6) AS l3_given_l2, (SELECT round(avg(f1), 4) FROM (SELECT round(2 * tp / (s + p), 4) AS f1 FROM (SELECT truth, count(*) AS s, count(*) FILTER (truth = pred) AS tp FROM ({_BASE}) GROUP BY truth) JOIN (SELECT pred AS truth, count(*) AS p FROM ({_BASE}) GROUP BY pred) USING (truth))) AS l3_macro_f1 FROM ({_LEVELS})")
def report_summary(spark, d):
    return figures.summary(predictions(spark, d))


@query(f"WITH t AS (SELECT event_type, event_id % 2 = 0 AS eval, {_TEXT} AS x FROM events), v AS (SELECT *, CASE WHEN trim(x) = '1.5e1' THEN 15.0 END::DOUBLE AS n FROM t) SELECT event_type, eval, count(*) AS population, count(n) AS valid, count(*) FILTER (x IS NULL) AS missing, count(*) FILTER (x IN ('abc', 'true')) AS not_numeric, count(*) FILTER (x IN ('-inf', '1e999')) AS nonfinite, count(*) FILTER (x = '-3') AS nonpositive, median(n) AS median, min(n) AS min, max(n) AS max FROM v GROUP BY ALL")
def distribution_series(spark, d):
    e = read(spark, d, "events").withColumn("x", F.expr(_TEXT)).withColumn("eval", F.col("event_id") % 2 == 0)
    return figures.series(e, "event_type", "eval", "x", True)


@query("WITH e AS (SELECT event_type, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS part, value FROM events), s AS (SELECT event_type, part, value, round(sum(count(*)) OVER (PARTITION BY event_type, part ORDER BY value) / sum(count(*)) OVER (PARTITION BY event_type, part), 9) AS mass FROM e GROUP BY event_type, part, value) SELECT * FROM s UNION ALL SELECT event_type, part, min(value), 0 FROM e GROUP BY event_type, part")
def distribution_steps(spark, d):
    e = read(spark, d, "events").withColumn("part", F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd"))
    return figures.distribution(e, ["event_type", "part"], "value")


@query("SELECT p_brand, count(p_retailprice) AS n, round(quantile_cont(p_retailprice, 0.25), 6) AS q25, round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(quantile_cont(p_retailprice, 0.75), 6) AS q75 FROM part GROUP BY p_brand")
def class_quartiles(spark, d):
    return figures.quartiles(read(spark, d, "part"), "p_brand", "p_retailprice")


@query("WITH s AS (SELECT l_returnflag, l_orderkey, count(*) AS n, list({'c': l_linenumber, 'q': l_quantity} ORDER BY l_linenumber, l_quantity) AS a FROM lineitem GROUP BY ALL), k AS (SELECT least(2, min(m)) AS k FROM (SELECT max(n) AS m FROM s GROUP BY l_returnflag)) SELECT l_returnflag, l_orderkey, array_to_string(list_transform(a[1:k], lambda x: x.c), ',') AS channels, round(list_avg(list_transform(a[1:k], lambda x: CAST(x.q AS DOUBLE))), 6) AS quality FROM s, k WHERE n >= k")
def channel_pairs(spark, d):
    x = figures.channel_pairs(read(spark, d, "lineitem"), "l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    return x.withColumn("channels", F.array_join(F.transform("channels", lambda c: c.cast("string")), ","))


@query(f"WITH m AS (SELECT truth, 'a' AS m, avg(CAST(truth = pred AS INT)) AS v FROM ({_BASE}) GROUP BY truth UNION ALL SELECT truth, 'b', avg(CAST(truth = pred_b AS INT)) FROM ({_BASE}) WHERE truth <> 'view' GROUP BY truth), r AS (SELECT truth, m, round(v, 6) AS v FROM m), x AS (SELECT *, min(v) OVER w AS low, max(v) OVER w AS high, count(*) OVER w = 2 AS whole FROM r WINDOW w AS (PARTITION BY truth)) SELECT truth, any_value(CASE WHEN whole THEN low END) AS low, any_value(CASE WHEN whole THEN high END) AS high, any_value(CASE WHEN whole THEN round((high - low) * 100, 4) END) AS gap_pp, string_agg(m, ',' ORDER BY m) FILTER (whole AND v = low) AS at_low, string_agg(m, ',' ORDER BY m) FILTER (whole AND v = high) AS at_high FROM x GROUP BY truth")
def performance_range(spark, d):
    p = predictions(spark, d)
    share = lambda c: F.round(F.avg((F.col("truth") == F.col(c)).cast("double")), 6).alias("v")
    both = p.groupBy("truth").agg(share("pred")).withColumn("m", F.lit("a")).unionByName(p.filter("truth <> 'view'").groupBy("truth").agg(share("pred_b")).withColumn("m", F.lit("b")))
    return figures.performance_range(both, "truth", "m", "v", 2)


_STATES = metrics.STRICT_STATES


@query(f"WITH s AS (SELECT truth, CASE WHEN NOT valid THEN 1 WHEN NOT ok1 THEN 2 WHEN pred = 'unknown' THEN 3 WHEN truth <> pred THEN 4 ELSE 5 END AS i, count(*) AS n FROM ({_LEVELS}) GROUP BY ALL), g AS (SELECT truth, i, coalesce(n, 0) AS n FROM (SELECT DISTINCT truth FROM s) CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5])::INT AS i) LEFT JOIN s USING (truth, i)) SELECT truth, {_STATES}[i] AS state, n, round((sum(n) OVER (PARTITION BY truth ORDER BY i) - n) / sum(n) OVER (PARTITION BY truth), 6) AS start, round(n / sum(n) OVER (PARTITION BY truth), 6) AS share FROM g")
def outcome_bars(spark, d):
    return figures.outcome_bars(predictions(spark, d), "truth", _STATES, metrics.outcome_state())


@query(f"WITH x AS (SELECT truth, 'leaf' AS measure, avg(CAST(truth = pred AS INT)) AS a, avg(CAST(truth = pred_b AS INT)) AS b FROM ({_BASE}) GROUP BY truth) SELECT truth, measure, round(a, 6) AS a, round(b, 6) AS b, round((a - b) * 100, 4) AS delta_pp FROM x")
def paired_control(spark, d):
    p = predictions(spark, d).withColumns({"in_a": F.col("truth") == F.col("pred"), "in_b": F.col("truth") == F.col("pred_b")})
    return figures.paired_control(p, "truth", {"leaf": ("in_a", "in_b")})


@query("""WITH e AS (SELECT event_id FROM events) SELECT event_id AS id, CASE WHEN event_id % 97 = 0 THEN 'run signature' WHEN event_id % 89 = 0 THEN 'truth' WHEN event_id % 83 = 0 THEN 'three questions' WHEN event_id % 79 = 0 THEN 'gate' WHEN event_id % 73 = 0 THEN 'later prompts' END AS fault FROM e
WHERE (event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0 OR event_id % 79 = 0 OR event_id % 73 = 0) AND event_id % 101 <> 0 UNION ALL SELECT event_id, 'no prediction' FROM e WHERE event_id % 101 = 0""")
def prediction_faults(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("id"))
    is_ = lambda n: F.col("id") % n == 0
    own = F.array(*[F.lit(x) for x in ("q1", "q2", "q3")])
    m = e.withColumns({"l1": F.lit("x"), "l2": F.lit("y"), "l3": F.lit("z"), "questions": F.when(is_(83), F.slice(own, 1, 2)).otherwise(own)})
    skipped = is_(79) | F.col("id").isNull()
    p = e.filter(~is_(101)).withColumns({"run_signature": F.when(is_(97), "t").otherwise("s"), "l1": F.lit("x"), "l2": F.lit("y"), "l3": F.when(is_(89), "w").otherwise("z"), "prompt_1": F.lit("q1"), "pred_1": F.lit("x"), "skipped": skipped, "prompt_2": F.when(is_(73), "other").otherwise("q2"), "prompt_3": F.lit("q3")})
    return validation.prediction_faults(p, m)


@query("SELECT event_id, CASE WHEN event_id % 41 = 0 THEN 'first only' ELSE 'value' END AS fault FROM events WHERE event_id % 41 = 0 OR event_id % 37 = 0")
def paired_manifest_faults(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", "value", F.lit("a").alias("audio"))
    b = e.filter("event_id % 41 <> 0").withColumns({"audio": F.lit("b"), "value": F.when(F.col("event_id") % 37 == 0, -1.0).otherwise(F.col("value"))})
    return validation.paired_faults(e, b, "event_id", ["audio"])


@query("SELECT 'predictions of shard ' || s AS fault FROM (SELECT DISTINCT event_id % 6 AS s FROM events) WHERE s > 3 UNION ALL SELECT 'shard coverage'")
def protocol_faults(spark, d):
    shards = read(spark, d, "events").select((F.col("event_id") % 6).alias("shard_index")).distinct()
    protocol = shards.filter("shard_index < 3").withColumns({"run_signature": F.lit("s"), "manifest_sha256": F.lit("m"), "num_shards": F.lit(4)})
    own = read(spark, d, "events").select(F.lit("s").alias("run_signature"), (F.col("event_id") % 6).alias("shard_index"), F.lit(4).alias("num_shards"))
    return validation.protocol_faults(protocol, own)


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'not in the index' ELSE 'sha256' END AS fault FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0")
def content_faults(spark, d):
    p = read(spark, d, "pages").select("page_id", F.octet_length(F.coalesce("html", F.lit(""))).alias("bytes"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"))
    index = p.filter("page_id % 5 <> 0").withColumn("sha256", F.when(F.col("page_id") % 7 == 0, "0").otherwise(F.col("sha256")))
    return validation.content_faults(p, index, "page_id")


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'd/' || page_id || '.wav' WHEN 1 THEN 'd/' || page_id || '.wav' END AS audio, CASE page_id % 5 WHEN 2 THEN 'several files' WHEN 3 THEN 'no file' WHEN 4 THEN 'outside the root' END AS audio_fault FROM pages")
def audio_resolution(spark, d):
    p, key = read(spark, d, "pages").select("page_id"), F.col("page_id").cast("string")
    declared = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("d\\"), key, F.lit(".wav"))).when(F.col("page_id") % 5 == 4, F.concat(F.lit("../"), key, F.lit(".wav"))).otherwise("gone.wav")
    files = p.filter("page_id % 5 < 3").select(F.explode(F.when(F.col("page_id") % 5 == 2, F.array(F.lit("d/"), F.lit("e/"))).otherwise(F.array(F.lit("d/")))).alias("at"), key.alias("k")).select(F.concat("at", "k", F.lit(".wav")).alias("path"))
    x = validation.resolved_audio(p.withColumns({"id": key, "wav_path": declared}), files)
    return x.select("page_id", "audio", "audio_fault")


_STATUS = "CASE WHEN o_custkey % 7 = 0 THEN 'existing' WHEN o_custkey % 7 = 1 THEN 'no_arrivals' WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'O' THEN 'existing' ELSE 'failed' END"


@query(f"WITH s AS (SELECT o_custkey, {_STATUS} AS status FROM orders), g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (status IN ('success', 'existing')) AS u, count(*) FILTER (status = 'existing') AS e, count(*) FILTER (status = 'no_arrivals') AS a FROM s GROUP BY o_custkey) SELECT o_custkey, n, CASE WHEN e = n THEN 'skipped' WHEN u = n THEN 'success' WHEN u > 0 THEN 'partial' WHEN a = n THEN 'no_arrivals' ELSE 'failed' END AS status FROM g")
def channel_status(spark, d):
    return channel.status_roll_up(read(spark, d, "orders").withColumn("status", F.expr(_STATUS)), "o_custkey", "status")


@query("SELECT event_id, value AS freq_hz FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0")
def pending_channels(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("value").alias("freq_hz"))
    shift = F.when(F.col("event_id") % 5 == 0, F.col("freq_hz") + 1).otherwise(F.col("freq_hz") + 0.001)
    done = e.select("event_id", F.when(F.col("event_id") % 3 == 0, "v1").otherwise("v2").alias("model_version"), shift.alias("freq_hz"))
    return channel.pending(e, done, "event_id", "v2")


_TERMS = {"en": ["the", "license"], "de": ["und", "die"]}
_HAS = "regexp_matches(lower(coalesce(text, '')), '(^|[^a-z0-9])({})($|[^a-z0-9])')"


@query(f"WITH h AS (SELECT lang, {_HAS.format('the|license')} AS e, {_HAS.format('und|die')} AS g FROM documents), r AS (SELECT lang, CASE lang WHEN 'en' THEN e WHEN 'de' THEN g ELSE false END AS own, CASE lang WHEN 'en' THEN g WHEN 'de' THEN e ELSE e OR g END AS other FROM h) SELECT lang, count(*) AS n, round(count(*) FILTER (own AND NOT other) / count(*), 6) AS alignment_rate, round(count(*) FILTER (other) / count(*), 6) AS contradiction_rate, round(count(*) FILTER (NOT own AND other) / count(*), 6) AS concept_confusion_rate, round(count(*) FILTER (NOT own AND NOT other) / count(*), 6) AS vague_rate, round(count(*) FILTER (own AND other) / count(*), 6) AS term_stacking_rate FROM r GROUP BY lang")
def reasoning_rates(spark, d):
    return reasoning.rates(reasoning.term_hits(read(spark, d, "documents"), "doc_id", "lang", "text", _TERMS), ["lang"])


@query()
def bootstrap_accuracy(spark, d):
    p = predictions(spark, d).select((F.col("truth") == F.col("pred")).cast("double").alias("v"))
    return intervals.bootstrap_mean(p, "v")
