"""Coercion, derived measures, routing and dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.functions import coerce as co, ids, text as tx
from tracelane.operators import ranks as rk, reconcile as rc, requests as rq, rollups, routing
from tracelane.plans.adapter import request_sql, requests, rounded, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pick(values: tuple, by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


def _pick_sql(values: tuple, by: str) -> str:
    return "([" + ", ".join("NULL" if v is None else repr(v) for v in values) + f"])[{by} % {len(values)} + 1]"


UNITS = ("ms", "s", "us", "ns", "Seconds", "parsec")


@query(f"""
SELECT event_id, round(value * CASE u WHEN 's' THEN 1000 WHEN 'Seconds' THEN 1000 WHEN 'us' THEN .001 WHEN 'ns' THEN .000001 ELSE 1 END, 8) AS by_unit,
  round(value * CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN .001 ELSE .000001 END, 8) AS by_path FROM (SELECT *, {_pick_sql(UNITS, 'event_id')} AS u FROM events)""")
def duration_units(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    path = F.concat(F.lit("metrics.ttft_"), _pick(("ms", "s", "us", "ns"), i))
    return rounded(table(spark, d, "events").select("event_id", co.duration_ms("value", _pick(UNITS, i)).alias("by_unit"), co.duration_ms("value", path=path).alias("by_path")))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) * 1000 WHEN 1 THEN epoch_us(ts) // 1000000 * 1000000000 WHEN 2 THEN epoch_us(ts) // 1000 * 1000000 ELSE epoch_us(ts) * 1000 END AS ns FROM events""")
def epoch_times(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    i = F.col("event_id") % 4
    t = F.when(i == 0, us * 1000).when(i == 1, F.expr("unix_micros(cast(ts as timestamp)) div 1000000")).when(i == 2, F.expr("unix_micros(cast(ts as timestamp)) div 1000")).otherwise(us)
    return table(spark, d, "events").select("event_id", co.epoch_ns(t).alias("ns"))


TEXTS = ("true", " Yes ", "0", "", "none", "12", "-3.5", "nan", "inf", "maybe", None, "1e3", "9007199254740993")


@query(f"""
SELECT event_id, CASE WHEN x IN ('true', '1', 'yes', 'y') THEN true WHEN x IN ('false', '0', 'no', 'n', '', 'none', 'null') THEN false WHEN v IS NOT NULL THEN v <> 0 END AS truth, v AS number,
  CASE WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN CAST(x AS BIGINT) ELSE CAST(trunc(v) AS BIGINT) END AS whole, CASE WHEN v = floor(v) THEN CASE WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN CAST(x AS BIGINT) ELSE CAST(v AS BIGINT) END END AS integral, nullif(trim(t), '') AS text_value
FROM (SELECT *, CASE WHEN x NOT IN ('nan', 'inf', 'true') THEN TRY_CAST(x AS DOUBLE) END AS v FROM (SELECT event_id, t, lower(trim(t)) AS x FROM (SELECT event_id, {_pick_sql(TEXTS, 'event_id')} AS t FROM events)))""")
def coerced_values(spark: SparkSession, d: str) -> DataFrame:
    t = _pick(TEXTS, F.col("event_id"))
    return table(spark, d, "events").select("event_id", co.truth(t).alias("truth"), co.number(t).alias("number"), co.whole(t).alias("whole"), co.integral(t).alias("integral"), co.text_or_null(t).alias("text_value"))


ERRORS = (None, "", "{}", "boom\nsecond line", '{"type":"Timeout","message":"late"}', '{"message":"only"}', "[]", "false")


@query(f"""
SELECT present, category, count(*) AS n FROM (SELECT coalesce(e IS NOT NULL AND lower(trim(e)) NOT IN ('', 'false', 'none', 'null', '0', '{{}}'), false) AS present,
  CASE e WHEN 'boom' || chr(10) || 'second line' THEN e WHEN '{{"type":"Timeout","message":"late"}}' THEN 'Timeout' WHEN '{{"message":"only"}}' THEN 'only' WHEN '[]' THEN '[]' END AS category
  FROM (SELECT {_pick_sql(ERRORS, 'event_id').replace(chr(92) + 'n', "' || chr(10) || '")} AS e FROM events)) GROUP BY ALL""")
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    e = _pick(ERRORS, F.col("event_id"))
    x = table(spark, d, "events").select(F.coalesce(co.error_present(e), F.lit(False)).alias("present"), co.error_category(e).alias("category"))
    return x.groupBy("present", "category").agg(F.count("*").alias("n"))


@query(request_sql("""
SELECT record_ordinal, round(coalesce(itl_ms, CASE WHEN output_tokens > 1 THEN value * 2 / nullif(output_tokens - 1, 0) END), 8) AS itl_ms,
  CASE WHEN input_tokens >= user_id AND user_id >= 0 THEN input_tokens - user_id END AS new_prompt_tokens, round(CASE WHEN input_tokens >= user_id AND user_id >= 0 THEN user_id / nullif(input_tokens, 0) END, 8) AS cached_ratio,
  CASE WHEN input_tokens >= user_id THEN 'explicit' ELSE 'unvalidated' END AS cache_status, round(CASE WHEN user_id <= input_tokens THEN user_id / nullif(input_tokens, 0) END, 8) AS acceptance FROM r"""))
def prompt_cache(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d)
    r = rq.cache_metrics(r.withColumns({"prompt_tokens": F.col("input_tokens"), "cached_tokens": F.col("user_id").cast("double")}))
    return rounded(r.select("record_ordinal", rq.decode_itl(F.col("value") * 2, "output_tokens", "itl_ms").alias("itl_ms"), "new_prompt_tokens", "cached_ratio", "cache_status", rq.acceptance("cached_tokens", "prompt_tokens").alias("acceptance")))


@query("""SELECT n_name, lower(n_name) = 'nation_1' OR lower(n_name) LIKE 'x' AS same, CASE WHEN n_nationkey % 3 = 0 THEN 'pass' WHEN n_nationkey % 3 = 1 THEN 'pass_alias_equivalent' ELSE 'mismatch' END AS status, CASE WHEN n_nationkey % 3 = 2 THEN '1-3;7' ELSE '5' END AS ranges FROM nation""")
def label_equality(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    a = F.when(k == 0, "Model-A").when(k == 1, "org/model-a").otherwise("other")
    ranges = tx.index_ranges(F.when(k == 2, F.array(*map(F.lit, (3, 1, 7, 2, 2)))).otherwise(F.array(F.lit(5))))
    return table(spark, d, "nation").select("n_name", tx.same_label("n_name", F.lit("nation 1")).alias("same"), rc.label_status(a, F.lit("MODEL a"), (("org/model-a", "model a"),)).alias("status"), ranges.alias("ranges"))


@query(request_sql("""
SELECT event_type, count(*) AS n_requests, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM p GROUP BY event_type"""))
def routing_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(routing.routing_share(rq.profiled(requests(spark, d)), "event_type").select("event_type", "n_requests", "share"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    """events as front-end lines: of six, four complete a request and two are checkpoints of a router's id."""
    i = F.col("event_id")
    client, router = F.format_string("c-%x", i), F.format_string("a-%x", F.floor(i / 6) * 6)
    stamp = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z "))
    done = F.concat(stamp, F.lit("request completed request_id="), F.format_string("a-%x", i), F.lit(' model=m x_request_id="'), F.when(i % 97 == 0, F.lit("c-0")).otherwise(client), F.lit('" prefill_worker_id='), (F.col("user_id") % 7).cast("string"), F.lit(" decode_worker_id="), (F.col("user_id") % 11).cast("string"))
    wait = F.concat(stamp, F.lit('\x1b[32mINFO\x1b[0m dynamo_kv_router::scheduling::queue: refreshed overlap scores after long queue wait request_id="'), router, F.lit('" wait_ms='), F.floor(F.col("value") * 100).cast("string"))
    return table(spark, d, "events").select(F.when(i % 6 < 4, done).otherwise(wait).alias("line"))


@query("""
WITH c AS (SELECT 'a-' || printf('%x', event_id) AS router, CASE WHEN event_id % 97 = 0 THEN 'c-0' ELSE 'c-' || printf('%x', event_id) END AS client, user_id FROM events WHERE event_id % 6 < 4 QUALIFY count(*) OVER (PARTITION BY client) = 1),
q AS (SELECT 'a-' || printf('%x', event_id // 6 * 6) AS router, count(*) AS n, min(w) AS lo, max(w) AS hi, arg_min(w, (ts, w)) AS f FROM (SELECT *, floor(value * 100) AS w FROM events) WHERE event_id % 6 >= 4 GROUP BY ALL)
SELECT event_id AS request_no, (user_id % 7)::VARCHAR AS prefill_worker, (user_id % 11)::VARCHAR AS decode_worker, router AS router_request_id, n AS n_checkpoints, lo AS min_wait_ms, hi AS max_wait_ms, f AS first_wait_ms, CASE WHEN router IS NULL THEN 'unmatched' ELSE 'exact' END AS routing_match_status
FROM (SELECT event_id FROM events) e LEFT JOIN (SELECT * FROM c LEFT JOIN q USING (router)) ON client = 'c-' || printf('%x', event_id)""")
def request_routing(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "events").select(F.col("event_id").alias("request_no"), F.format_string("c-%x", "event_id").alias("x_request_id"))
    return routing.routed(asked, _log(spark, d)).select("request_no", "prefill_worker", "decode_worker", "router_request_id", "n_checkpoints", "min_wait_ms", "max_wait_ms", "first_wait_ms", "routing_match_status")


@query("""SELECT doc_id AS record_ordinal, row_number() OVER (PARTITION BY lang, n_chars, source ORDER BY doc_id) > 1 AS seen_before FROM documents""")
def row_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.col("doc_id").alias("record_ordinal"), "lang", "n_chars", "source")
    return rq.with_fingerprint(x).select("record_ordinal", "seen_before")


@query(request_sql("SELECT concurrency, round(m * n, 4) AS derived_input_tokens, 'mean_input_tokens x requests' AS derived_input_tokens_note FROM (SELECT concurrency, avg(input_tokens) AS m, count(*) AS n FROM p GROUP BY ALL)"))
def derived_token_totals(spark: SparkSession, d: str) -> DataFrame:
    s = rc.raw_aggregates(rq.profiled(requests(spark, d)))
    return rc.derived_totals(s).select("concurrency", F.round("derived_input_tokens", 4).alias("derived_input_tokens"), "derived_input_tokens_note")


@query("""
SELECT page_id, CASE WHEN n = 1 THEN a END AS artifact_id, CASE coalesce(n, 0) WHEN 1 THEN 'unambiguous' WHEN 0 THEN 'unmatched' ELSE 'ambiguous' END AS artifact_status FROM pages LEFT JOIN (
  SELECT page_id AS p, count(DISTINCT c_custkey) AS n, min(c_custkey)::VARCHAR AS a FROM pages, customer WHERE list_contains(string_split(url, '/'), (c_custkey % 900)::VARCHAR) GROUP BY page_id) ON p = page_id""")
def artifact_matching(spark: SparkSession, d: str) -> DataFrame:
    art = table(spark, d, "customer").select((F.col("c_custkey") % 900).cast("string").alias("artifact_name"), F.col("c_custkey").cast("string").alias("artifact_id"))
    # ids are compared as text, so the smallest is by text: only unambiguous ones are shown
    m = rc.matching_artifacts(table(spark, d, "pages").select("page_id", F.col("url").alias("path")), art)
    return m.select("page_id", "artifact_id", "artifact_status")


@query(request_sql("""
SELECT worker, CASE WHEN n = 0 OR eq < n THEN 'unresolved' WHEN worker % 2 = 0 THEN 'validated_duplicate_worker_gauge' ELSE 'likely_duplicate_worker_gauge' END AS verdict FROM (
  SELECT worker, count(*) FILTER (k = 5) AS n, count(*) FILTER (k = 5 AND lo = hi) AS eq FROM (SELECT user_id AS worker, request_start_ns // 604800000000000 AS s, count(DISTINCT event_type) AS k, min(CASE WHEN user_id % 5 = 0 THEN 1 ELSE input_tokens END) AS lo, max(CASE WHEN user_id % 5 = 0 THEN 1 ELSE input_tokens END) AS hi FROM r GROUP BY ALL) GROUP BY worker)"""))
def duplicate_gauges(spark: SparkSession, d: str) -> DataFrame:
    g = requests(spark, d).groupBy(F.col("user_id").alias("worker"), F.expr("request_start_ns div 604800000000000").alias("slice"), F.col("event_type").alias("rank"))
    low = g.agg(F.min("input_tokens").alias("v"), F.max("input_tokens").alias("w"))
    pick = lambda c: F.when(F.col("worker") % 5 == 0, 1.0).otherwise(F.col(c))
    each = low.groupBy("worker", "slice").agg(F.count_distinct("rank").alias("k"), F.min(pick("v")).alias("lo"), F.max(pick("w")).alias("hi"))
    s = each.groupBy("worker").agg(F.count_if(F.col("k") == 5).alias("n"), F.count_if((F.col("k") == 5) & (F.col("lo") == F.col("hi"))).alias("eq"))
    return s.select("worker", rk.duplicate_verdict(F.col("worker") % 2 == 0, (F.col("n") > 0) & (F.col("eq") == F.col("n"))).alias("verdict"))


@query(request_sql("""SELECT record_ordinal, coalesce(v, w) AS chosen, CASE WHEN v IS NOT NULL THEN 'avg' WHEN w IS NOT NULL THEN 'last' END AS field,
  CASE WHEN v IS NOT NULL THEN 'selected raw avg field from exported one-second scheduler occupancy bins' WHEN w IS NOT NULL THEN 'selected raw last field from exported scheduler occupancy bins' ELSE 'exported scheduler occupancy-bin field with unresolved selected statistic' END || '; not an instantaneous unique-request maximum.' AS scope,
  (['prefill', 'decode', 'unlabeled', 'Planner'])[record_ordinal % 4 + 1] AS component, CASE WHEN record_ordinal % 2 = 0 THEN 'tp' || (record_ordinal % 4) || '_dp1' ELSE 'dp1' END AS rank_name,
  'AIPerf public server-metrics profiling export; explicit SGLang metric; ' || CASE WHEN record_ordinal % 4 < 2 THEN (['prefill', 'decode'])[record_ordinal % 4 + 1] || ' endpoint/rank-series scope. Values across rank exports are not summed into a worker or cluster count.' ELSE 'component scope unavailable.' END AS series FROM (SELECT record_ordinal, ttft_ms AS v, itl_ms AS w FROM r)"""))
def gauge_labels(spark: SparkSession, d: str) -> DataFrame:
    r, i = requests(spark, d), F.col("record_ordinal")
    value, field = tx.first_number({"avg": "ttft_ms", "last": "itl_ms"})
    comp = tx.component(_pick(("prefill", "backend", "", "Planner"), i))
    return r.select("record_ordinal", value.alias("chosen"), field.alias("field"), tx.bin_scope(field).alias("scope"), comp.alias("component"), tx.rank_label(F.when(i % 2 == 0, (i % 4).cast("string")), F.lit("1")).alias("rank_name"), tx.series_scope(comp).alias("series"))


@query(request_sql("""
SELECT worker, good AS rank_equality_validated, CASE WHEN NOT good THEN 'unresolved' WHEN worker % 2 = 0 THEN 'validated_duplicate_worker_gauge' ELSE 'likely_duplicate_worker_gauge' END AS verdict,
  CASE WHEN NOT good THEN 'Unknown' WHEN worker % 2 = 0 THEN 'Validated reconstruction' ELSE 'Strong inference' END AS status, CASE WHEN other THEN 2 ELSE 1 END AS n_metrics FROM (
  SELECT worker, bool_or(metric = 'b') AS other, coalesce(count(*) FILTER (ranks = 2 AND slices = whole AND whole = eq) = 2, false) AS good FROM (
    SELECT worker, metric, max(k) AS ranks, count(*) AS slices, count(*) FILTER (k = 2 AND n = 2) AS whole, count(*) FILTER (k = 2 AND n = 2 AND lo = hi) AS eq FROM (
      SELECT worker, metric, slice, count(*) AS k, count(v) AS n, min(v) AS lo, max(v) AS hi FROM (
        SELECT user_id AS worker, 'a' AS metric, concurrency % 2 AS rank, request_start_ns // 2419200000000000 AS slice, max(CASE WHEN user_id % 3 = 0 THEN 1 ELSE input_tokens END) AS v FROM r GROUP BY ALL
        UNION ALL SELECT user_id, 'b', concurrency % 2, request_start_ns // 2419200000000000, 7 FROM r WHERE user_id % 4 > 0 GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) GROUP BY worker)"""))
def worker_gauge_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Two gauges of two ranks for each user; a fourth of the users lacks the second gauge."""
    g = requests(spark, d).groupBy(F.col("user_id").alias("worker"), (F.col("concurrency") % 2).alias("rank"), F.expr("request_start_ns div 2419200000000000").alias("slice")).agg(F.max("input_tokens").alias("m"))
    a = g.select("worker", F.lit("a").alias("metric"), "rank", "slice", F.when(F.col("worker") % 3 == 0, 1.0).otherwise(F.col("m")).alias("v"))
    b = g.where(F.col("worker") % 4 > 0).select("worker", F.lit("b").alias("metric"), "rank", "slice", F.lit(7.0).alias("v"))
    checks = rk.validation(a.unionByName(b), ["worker", "metric"], ["slice"], "rank", "v", 2)
    v = rk.worker_verdicts(checks, "worker", "metric", ["a", "b"], 2, F.col("worker") % 2 == 0)
    return v.select("worker", "rank_equality_validated", "verdict", "status", F.when(F.col("evidence").contains("missing:b"), 1).otherwise(2).alias("n_metrics"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'csv_histogram_labels_unparsed' WHEN p_partkey % 5 = 0 THEN 'decode' WHEN p_partkey % 5 = 1 THEN 'worker' WHEN p_partkey % 2 = 0 THEN 'frontend' ELSE 'unlabeled' END AS component,
  CASE WHEN p_partkey % 3 > 0 THEN CASE WHEN p_partkey % 7 = 0 THEN 'host' ELSE 'w' || p_partkey % 4 END END AS worker, CASE WHEN p_partkey % 3 > 0 THEN 'dp_rank=' || p_partkey % 8 || CASE WHEN p_partkey % 2 = 0 THEN ';pp_rank=0' ELSE '' END END AS rank,
  CASE WHEN p_partkey % 3 = 0 THEN 'histogram' WHEN p_partkey % 2 = 0 THEN 'Dynamo frontend/request-plane metric; separate from profile interval overlap and SGLang running' WHEN p_partkey % 11 = 0 THEN 'configured capacity metric; not observed scheduler running' ELSE 'public AIPerf server-metrics aggregate; retain component/rank scope' END AS meaning,
  CASE WHEN p_partkey % 3 > 0 THEN p_size::DOUBLE END AS max, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 2 = 0 THEN p_size / 2 END AS avg FROM part""")
def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("p_partkey")
    text = lambda c: c.cast("string")
    p = table(spark, d, "part").select(
        i.alias("p_partkey"), F.when(i % 2 == 0, "dynamo_frontend_x").otherwise("sglang:x").alias("Metric"), F.when(i % 3 == 0, "Histogram").otherwise("gauge").alias("Type"), F.when(i % 11 == 0, "Queue Capacity").alias("Description"), F.lit("host").alias("Endpoint"),
        F.when(i % 5 == 0, "backend").otherwise(" ").alias("dynamo_component"), F.when(i % 5 == 1, "worker").alias("worker_type"), F.when(i % 7 > 0, F.concat(F.lit("w"), text(i % 4))).alias("worker_id"), text(i % 8).alias("dp_rank"), F.when(i % 2 == 0, "0").alias("pp_rank"),
        text(F.col("p_size")).alias("max"), F.when(i % 2 == 0, text(F.col("p_size") / 2)).otherwise("nan").alias("avg"),
    )
    names = {"metric": "Metric", "type": "Type", "description": "Description", "endpoint": "Endpoint", "component": "dynamo_component", "worker": "worker_id", **{c: c for c in ("worker_type", "dp_rank", "pp_rank", "max", "avg")}}
    m = rk.metric_inventory(p.withColumnRenamed("p_partkey", "line_no"), ["dynamo_frontend_x", "sglang:x"], names)
    return m.select(F.col("line_no").alias("p_partkey"), "component", "worker", "rank", F.when(F.col("component") == tx.HISTOGRAM_COMPONENT, "histogram").otherwise(F.col("meaning")).alias("meaning"), "max", "avg")


@query(request_sql("SELECT concurrency, max(CASE WHEN x > 5 THEN 'comparative_sample_size_available' ELSE 'suppressed_n_lt_6_descriptive_only' END) AS state, count(*) AS n FROM (SELECT concurrency, root_trace_id, count(itl_ms) AS x FROM p GROUP BY ALL) GROUP BY concurrency, x > 5"))
def sparse_suppression(spark: SparkSession, d: str) -> DataFrame:
    g = rq.profiled(requests(spark, d)).groupBy("concurrency", "root_trace_id").agg(F.count("itl_ms").alias("x"))
    return g.groupBy("concurrency", (F.col("x") > 5).alias("b")).agg(F.max(rollups.sparse_status("x", 6)).alias("state"), F.count("*").alias("n")).drop("b")


@query("""SELECT conv_id, turn, conv_id || '|' || turn AS k, turn::BIGINT AS whole FROM conversations""")
def whole_keys(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", ids.joined_key("conv_id", "turn").alias("k"), ids.whole_key(F.concat(F.col("turn").cast("string"), F.lit(".0"))).alias("whole"))


@query(request_sql("""
SELECT CAST(b.i AS INTEGER) AS bucket_no, b.b AS bucket, coalesce(s.n, 0) AS n, s.m AS mean_ttft_ms FROM (SELECT unnest(range(0, 6)) AS i, unnest(['<32k', '32-64k', '64-128k', '128-192k', '192-256k', '256k+']) AS b) b
LEFT JOIN (SELECT CASE WHEN input_tokens * 1000 < 32000 THEN '<32k' WHEN input_tokens * 1000 < 64000 THEN '32-64k' WHEN input_tokens * 1000 < 128000 THEN '64-128k' WHEN input_tokens * 1000 < 192000 THEN '128-192k' END AS bucket, count(*) AS n, round(avg(ttft_ms), 8) AS m FROM p GROUP BY ALL) s ON s.bucket = b.b"""))
def input_buckets(spark: SparkSession, d: str) -> DataFrame:
    g = rq.profiled(requests(spark, d)).withColumn("i", F.col("input_tokens") * 1000)
    s = g.groupBy(rollups.input_bucket("i").alias("bucket")).agg(F.count("*").alias("n"), F.avg("ttft_ms").alias("mean_ttft_ms"))
    return rounded(rollups.with_all_buckets(s, "bucket", [label for _, label in rollups.INPUTS], ["n"]).select("bucket_no", "bucket", "n", "mean_ttft_ms"))


@query(request_sql("""
SELECT concurrency, count(*) AS n_requests, count(*) FILTER (input_tokens >= user_id AND record_ordinal % 5 > 0) AS n_exported, round(sum(user_id) FILTER (input_tokens >= user_id AND record_ordinal % 5 > 0) / nullif(sum(input_tokens) FILTER (input_tokens >= user_id AND record_ordinal % 5 > 0), 0), 8) AS cache_ratio, 'partial' AS cache_status FROM p GROUP BY concurrency"""))
def cache_ratios(spark: SparkSession, d: str) -> DataFrame:
    g = rq.profiled(requests(spark, d)).withColumns({"prompt_tokens": F.col("input_tokens"), "cached_tokens": F.when(F.col("record_ordinal") % 5 > 0, F.col("user_id").cast("double"))})
    return rounded(rollups.cache_summary(g, ["concurrency"]))


@query("""SELECT name, largest, coalesce(n, 0) AS n, CASE WHEN largest IS NULL THEN 'Unknown' ELSE 'Evidence' END AS status FROM (SELECT unnest(['running_requests', 'waiting_requests', 'batch_size', 'token_usage']) AS name) LEFT JOIN (
  SELECT 'running_requests' AS name, max(event_id % 40)::DOUBLE AS largest, count(*) AS n FROM events UNION ALL SELECT 'waiting_requests', max(event_id % 7), count(*) FROM events UNION ALL SELECT 'token_usage', 0.25 + max(event_id % 3), count(*) FROM events) USING (name)""")
def observed_counters(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    line = F.concat(F.lit("max_running_requests=200 running_requests="), (i % 40).cast("string"), F.lit(" num-waiting reqs: "), (i % 7).cast("string"), F.lit(" token usage: "), (i % 3).cast("string"), F.lit(".25"))
    x = table(spark, d, "events").select(F.explode(tx.counters(line)).alias("c")).select("c.*")
    return routing.counter_summary(x, ["running_requests", "waiting_requests", "batch_size", "token_usage"])


@query("""
SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'a1' WHEN 1 THEN '77' WHEN 2 THEN 'a4' END AS artifact_id, CASE conv_id % 4 WHEN 0 THEN 'folder_name' WHEN 1 THEN 'folder_id' WHEN 2 THEN 'concurrency' ELSE 'not_found' END AS context_rule FROM (SELECT DISTINCT conv_id FROM conversations)""")
def profile_contexts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("conv_id") % 4
    path = F.concat(F.when(k == 0, "/x/run-one").when(k == 1, "/x/part_77_b").when(k == 2, "/x/conc4").otherwise("/x/y"), F.lit("/f"), F.col("conv_id").cast("string"))
    art = spark.createDataFrame([("run-one", "a1", 1), ("run-two", "77", 2), ("run-four", "a4", 4)], "artifact_name string, artifact_id string, concurrency int")
    return rc.profile_context(table(spark, d, "conversations").select("conv_id", path.alias("path")).distinct(), art).drop("path")
