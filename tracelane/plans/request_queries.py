"""Filtering, metrics, rollups and coverage of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.functions import ids
from tracelane.functions.aggregates import distinct_with_null, first_known, token_weighted_itl
from tracelane.operators import order_statistics, matching, requests as rq, rollups
from tracelane.plans.adapter import measures_sql, request_sql, requests, rounded, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def good(spark: SparkSession, d: str) -> DataFrame:
    return rq.profiled(requests(spark, d))


@query(request_sql(f"SELECT concurrency, root_trace_id, {measures_sql()} FROM p GROUP BY ALL"))
def id_concurrency_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rollups.summarize(good(spark, d), ["concurrency", "root_trace_id"]))


@query(request_sql("SELECT coalesce(exclusion_reason, 'included') AS reason, concurrency, count(*) AS n FROM r GROUP BY ALL"))
def filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    r = rq.with_reasons(requests(spark, d))
    return r.groupBy(F.coalesce("exclusion_reason", F.lit("included")).alias("reason"), "concurrency").agg(F.count("*").alias("n"))


@query(request_sql("""
SELECT CASE WHEN benchmark_phase IS NULL THEN 'missing_benchmark_phase' WHEN exclusion_reason IS NOT NULL THEN exclusion_reason
  WHEN output_tokens > 1 AND (itl_ms IS NULL OR itl_ms <= 0) THEN 'missing_itl' ELSE 'included' END AS reason, count(*) AS n FROM r GROUP BY ALL"""))
def filter_reasons_strict(spark: SparkSession, d: str) -> DataFrame:
    r = rq.with_reasons(requests(spark, d), require_phase=True, require_itl=True)
    return r.groupBy(F.coalesce("exclusion_reason", F.lit("included")).alias("reason")).agg(F.count("*").alias("n"))


@query(request_sql("SELECT record_ordinal, exclusion_reason FROM r WHERE exclusion_reason IS NOT NULL"))
def excluded_records(spark: SparkSession, d: str) -> DataFrame:
    return rq.excluded(requests(spark, d)).select("record_ordinal", "exclusion_reason")


_ID = "|| '|' ||".join(f"coalesce(CAST({c} AS VARCHAR), '<null>')" for c in ("NULL", "concurrency", "NULL", "session_num", "conversation_id", "turn_index", "request_start_ns", "record_ordinal"))


@query(request_sql(f"""
SELECT record_ordinal, {_ID} AS request_identity, round(ttft_ms / 1000, 8) AS ttft_s, round(greatest(e2e_ms - ttft_ms, 0), 8) AS post_ttft_ms, ttft_ms > e2e_ms AS ttft_exceeds_e2e,
  round(CASE WHEN output_tokens > 1 AND itl_ms > 0 THEN 1000 / itl_ms END, 8) AS itl_tps,
  round(CASE WHEN output_tokens > 1 THEN (output_tokens - 1) * 1000 / nullif(greatest(e2e_ms - ttft_ms, 0), 0) END, 8) AS post_ttft_tps,
  round(output_tokens * 1000 / nullif(e2e_ms, 0), 8) AS e2e_tps, round(input_tokens * 1000 / nullif(ttft_ms, 0), 8) AS input_per_ttft_s
FROM p"""))
def derived_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = rq.add_metrics(rq.add_identity(good(spark, d)))
    return rounded(out.select("record_ordinal", "request_identity", "ttft_s", "post_ttft_ms", "ttft_exceeds_e2e", "itl_tps", "post_ttft_tps", "e2e_tps", "input_per_ttft_s"))


@query(request_sql(f"SELECT concurrency, root_trace_id, session_num, {measures_sql(False)} FROM p GROUP BY ALL"))
def replay_instances(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rollups.summarize(good(spark, d), ["concurrency", "root_trace_id", "session_num"], zero_sums=False))


@query(request_sql("""
SELECT s.*, n_records, n_errors, n_cancelled, n_excluded,
  coalesce(nullif(concat_ws(';', CASE WHEN n_requests < 5 THEN 'low_request_count' END, CASE n_sessions WHEN 0 THEN 'missing_session_num_group' WHEN 1 THEN 'single_session_num_group_unvalidated' END,
    CASE WHEN n_sessions = n_requests THEN 'session_num_unique_per_profiled_row' END), ''), 'ok') AS quality
FROM s LEFT JOIN c USING (concurrency, root_trace_id)""", f"""
s AS (SELECT concurrency, root_trace_id, count(DISTINCT session_num) AS n_sessions, {measures_sql()} FROM p GROUP BY ALL),
c AS (SELECT concurrency, root_trace_id, count(*) AS n_records, count(*) FILTER (error_present) AS n_errors, count(*) FILTER (was_cancelled) AS n_cancelled, count(exclusion_reason) AS n_excluded FROM r GROUP BY ALL)"""))
def id_summary_with_status(spark: SparkSession, d: str) -> DataFrame:
    r = rq.with_reasons(requests(spark, d))
    keys = ["concurrency", "root_trace_id"]
    s = r.where("exclusion_reason is null").groupBy(*keys).agg(F.count_distinct("session_num").alias("n_sessions"), *rollups.measures())
    return rounded(rollups.with_status(s, rollups.status_counts(r, keys), keys).withColumn("quality", rollups.quality_flag()))


@query(request_sql("""
SELECT concurrency, 'request' AS weighting, count(ttft_ms) AS sample_count, round(quantile_cont(ttft_ms, .5), 8) AS value FROM p GROUP BY ALL
UNION ALL SELECT concurrency, 'root_id', count(m), round(quantile_cont(m, .5), 8) FROM (SELECT concurrency, root_trace_id, quantile_cont(ttft_ms, .5) AS m FROM p GROUP BY ALL) GROUP BY concurrency
UNION ALL SELECT concurrency, 'session_group', count(m), round(quantile_cont(m, .5), 8) FROM (SELECT concurrency, root_trace_id, session_num, quantile_cont(ttft_ms, .5) AS m FROM p GROUP BY ALL) GROUP BY concurrency
UNION ALL SELECT concurrency, 'token', count(*) FILTER (output_tokens > 1), round(sum(CASE WHEN itl_ms > 0 AND output_tokens > 1 THEN itl_ms * (output_tokens - 1) END) / sum(CASE WHEN itl_ms > 0 AND output_tokens > 1 THEN output_tokens - 1 END), 8) FROM p GROUP BY ALL"""))
def weighting_comparison(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rollups.weightings(good(spark, d)))


@query(request_sql(f"SELECT concurrency, branch_type, {measures_sql()} FROM p GROUP BY ALL"))
def branch_types(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rollups.summarize(good(spark, d), ["concurrency", "branch_type"]))


_ORIGIN = "CASE WHEN source_branch_type IS NULL OR trim(source_branch_type) IN ('', 'unknown') THEN 'unknown' WHEN source_branch_type = 'root' THEN 'root' ELSE 'subagent' END"


@query(request_sql(f"SELECT concurrency, {_ORIGIN} AS origin, {measures_sql()} FROM p GROUP BY ALL"))
def branch_origins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rollups.summarize(good(spark, d).withColumn("origin", rollups.origin_group("source_branch_type")), ["concurrency", "origin"]))


@query(request_sql("""
SELECT concurrency, root_trace_id, count(*) FILTER (branch_type = 'root') AS n_root, count(*) FILTER (branch_type <> 'root') AS n_other_branch, count(*) FILTER (branch_type IS NULL) AS n_unknown_branch,
  count(DISTINCT session_num) + max(CASE WHEN session_num IS NULL THEN 1 ELSE 0 END) AS n_replays, arg_min(branch_type, record_ordinal) FILTER (branch_type IS NOT NULL) AS first_branch FROM p GROUP BY ALL"""))
def branch_counts(spark: SparkSession, d: str) -> DataFrame:
    return good(spark, d).groupBy("concurrency", "root_trace_id").agg(*rollups.branch_counts("branch_type"), distinct_with_null("session_num").cast("long").alias("n_replays"), first_known("branch_type", "record_ordinal").alias("first_branch"))


@query(request_sql("""
SELECT CASE WHEN GROUPING(concurrency) = 0 THEN 'concurrency' ELSE 'all' END AS scope, concurrency, count(*) AS n_rows, count(session_num) AS n_known, count(DISTINCT session_num) AS n_sessions,
  count(DISTINCT CASE WHEN session_num IS NOT NULL THEN concurrency || '|' || session_num END) AS n_concurrency_sessions, CAST(count(DISTINCT session_num) + max(CASE WHEN session_num IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_with_null,
  count(session_num) - count(DISTINCT session_num) AS n_repeated_rows, round(count(DISTINCT session_num) / nullif(count(session_num), 0), 8) AS unique_rate
FROM p GROUP BY GROUPING SETS ((), (concurrency))"""))
def session_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rollups.session_diagnostics(good(spark, d)))


_ORD = "ORDER BY request_start_ns NULLS LAST, request_ack_ns NULLS LAST, source_file_path NULLS LAST, record_ordinal NULLS LAST"


@query(request_sql(f"""
SELECT record_ordinal, CASE WHEN exclusion_reason IS NULL THEN row_number() OVER (PARTITION BY exclusion_reason IS NULL, concurrency {_ORD}) - 1 END AS ordinal_in_concurrency,
  CASE WHEN exclusion_reason IS NULL THEN row_number() OVER (PARTITION BY exclusion_reason IS NULL, concurrency, root_trace_id {_ORD}) - 1 END AS ordinal_in_root,
  CASE WHEN exclusion_reason IS NULL THEN row_number() OVER (PARTITION BY exclusion_reason IS NULL, concurrency, root_trace_id, conversation_id {_ORD}) - 1 END AS ordinal_in_branch FROM r"""))
def execution_ordinals(spark: SparkSession, d: str) -> DataFrame:
    r = rq.with_reasons(requests(spark, d)).withColumn("source_conversation_path", F.col("conversation_id"))
    out = rq.add_ordinals(r, F.col("exclusion_reason").isNull())
    return out.select("record_ordinal", *(F.col(f"ordinal_in_{k}").cast("long").alias(f"ordinal_in_{k}") for k in ("concurrency", "root", "branch")))


_TOP = " UNION ALL ".join(
    f"SELECT '{m}' AS rank_metric, row_number() OVER (ORDER BY {m} {way} NULLS LAST, root_trace_id NULLS LAST, concurrency NULLS LAST) AS rank, CAST({m} AS DOUBLE) AS value, root_trace_id, concurrency FROM s"
    for m, way in (("n_requests", "DESC"), ("output_tps", "ASC"), ("ttft_p95_ms", "DESC"))
)


@query(request_sql(f"SELECT * FROM ({_TOP}) WHERE rank <= 10", f"s AS (SELECT concurrency, root_trace_id, {measures_sql()} FROM p GROUP BY ALL)"))
def top_ids(spark: SparkSession, d: str) -> DataFrame:
    s = rounded(rollups.summarize(good(spark, d), ["concurrency", "root_trace_id"]))
    out = rollups.top_by(s, {"n_requests": True, "output_tps": False, "ttft_p95_ms": True}, ["root_trace_id", "concurrency"], 10)
    return out.withColumn("rank", F.col("rank").cast("long"))


_BUCKETS = "CASE WHEN {0} >= 0 AND {0} <= 1 THEN '1' WHEN {0} >= 0 AND {0} <= 32 THEN '2-32' WHEN {0} >= 0 AND {0} <= 128 THEN '33-128' WHEN {0} >= 0 AND {0} <= 512 THEN '129-512' WHEN {0} >= 0 AND {0} <= 2048 THEN '513-2048' WHEN {0} > 2048 THEN '>2048' END"


@query(request_sql(f"""
SELECT output_bucket, input_bucket, load_bucket, count(*) AS n, round(avg(ttft_ms), 8) AS mean_ttft_ms FROM (
  SELECT ttft_ms, {_BUCKETS.format('(output_tokens * 300)')} AS output_bucket,
    CASE WHEN input_tokens * 3000 < 32000 THEN '<32k' WHEN input_tokens * 3000 < 64000 THEN '32-64k' WHEN input_tokens * 3000 < 128000 THEN '64-128k' WHEN input_tokens * 3000 < 192000 THEN '128-192k' WHEN input_tokens * 3000 < 256000 THEN '192-256k' WHEN input_tokens IS NOT NULL THEN '256k+' END AS input_bucket,
    CASE WHEN input_tokens < 0 THEN NULL WHEN input_tokens <= 4 THEN '1-4' WHEN input_tokens <= 8 THEN '5-8' WHEN input_tokens <= 12 THEN '9-12' WHEN input_tokens <= 16 THEN '13-16' WHEN input_tokens <= 24 THEN '17-24' WHEN input_tokens > 24 THEN '25+' END AS load_bucket
  FROM p) GROUP BY ALL"""))
def buckets(spark: SparkSession, d: str) -> DataFrame:
    g = good(spark, d).withColumns({"o": F.col("output_tokens") * 300, "i": F.col("input_tokens") * 3000})
    return rounded(g.groupBy(rollups.length_bucket("o").alias("output_bucket"), rollups.input_bucket("i").alias("input_bucket"), rollups.load_bucket("input_tokens").alias("load_bucket")).agg(F.count("*").alias("n"), F.avg("ttft_ms").alias("mean_ttft_ms")))


@query(request_sql("""
SELECT concurrency, metric, q, round(value, 8) AS value FROM (
  SELECT concurrency, unnest(['ttft_ms', 'e2e_ms', 'itl_ms']) AS metric, unnest([quantile_cont(ttft_ms, [.5, .9, .99]), quantile_cont(e2e_ms, [.5, .9, .99]), quantile_cont(itl_ms, [.5, .9, .99])]) AS v FROM p GROUP BY concurrency),
  LATERAL (SELECT unnest([.5, .9, .99])::DOUBLE AS q, unnest(v) AS value)"""))
def latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(order_statistics.quantiles(good(spark, d), ["concurrency"], ["ttft_ms", "e2e_ms", "itl_ms"], [0.5, 0.9, 0.99]))


@query(request_sql("""
SELECT record_ordinal, CASE WHEN contains(conversation_id, '::sa:') THEN split_part(conversation_id, '::sa:', 1) ELSE regexp_replace(conversation_id, '::(fa|aux|wg):.*$', '') END AS root_id,
  CASE WHEN contains(conversation_id, '::sa:') THEN CASE WHEN split_part(conversation_id, '::sa:', 1) = '' THEN 'invalid_empty_root_before_sa' ELSE 'split_before_first_sa' END WHEN regexp_matches(conversation_id, '.::fa:') THEN 'split_direct_fanout_suffix' WHEN regexp_matches(conversation_id, '.::aux:') THEN 'split_direct_auxiliary_suffix' WHEN regexp_matches(conversation_id, '.::wg:') THEN 'split_direct_worker_group_suffix' ELSE 'identity' END AS rule,
  CASE WHEN regexp_matches(conversation_id, ':fa:') THEN 'fanout' WHEN regexp_matches(conversation_id, ':aux:') THEN 'auxiliary' WHEN regexp_matches(conversation_id, ':wg:') THEN 'worker_group' WHEN contains(conversation_id, '::sa:') THEN 'subagent_main' ELSE 'root' END AS branch,
  CASE WHEN contains(conversation_id, '::sa:') THEN split_part(conversation_id, '::sa:', 1) || '::sa:' || regexp_replace(split_part(conversation_id, '::sa:', 2), ':(fa|aux|wg):.*$', '') ELSE regexp_replace(conversation_id, '::(fa|aux|wg):.*$', '') END AS path
FROM r"""))
def conversation_ids(spark: SparkSession, d: str) -> DataFrame:
    c = "conversation_id"
    return requests(spark, d).select("record_ordinal", ids.root_id(c).alias("root_id"), ids.root_rule(c).alias("rule"), ids.branch_class(c).alias("branch"), ids.branch_path(c).alias("path"))


@query(request_sql("""
SELECT concurrency, rule, count(*) AS n, count(DISTINCT conversation_id) AS n_conversations FROM (
  SELECT concurrency, conversation_id, CASE WHEN contains(conversation_id, '::sa:') THEN CASE WHEN split_part(conversation_id, '::sa:', 1) = '' THEN 'invalid_empty_root_before_sa' ELSE 'split_before_first_sa' END WHEN regexp_matches(conversation_id, '.::fa:') THEN 'split_direct_fanout_suffix' WHEN regexp_matches(conversation_id, '.::aux:') THEN 'split_direct_auxiliary_suffix' WHEN regexp_matches(conversation_id, '.::wg:') THEN 'split_direct_worker_group_suffix' ELSE 'identity' END AS rule FROM r) GROUP BY ALL"""))
def normalization_rules(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).groupBy("concurrency", ids.root_rule("conversation_id").alias("rule")).agg(F.count("*").alias("n"), F.count_distinct("conversation_id").alias("n_conversations"))


@query(request_sql("""
SELECT c.conv, coalesce(CASE WHEN s.a IS NOT NULL THEN c.root WHEN s2.a IS NOT NULL THEN c.cut END, c.root) AS root_trace_id, (s.a IS NOT NULL OR s2.a IS NOT NULL) AS root_known,
  CASE WHEN s.a IS NULL AND s2.a IS NOT NULL THEN 'strip_replay_suffix' WHEN contains(c.conv, '::sa:') THEN 'split_before_first_sa' ELSE 'identity' END AS root_source
FROM (SELECT conv, root, regexp_replace(root, '__replay_\\d+$', '') AS cut FROM (
    SELECT DISTINCT root_trace_id || CASE WHEN user_id % 2 = 0 THEN '__replay_' || (user_id % 5) ELSE '' END || CASE WHEN user_id % 3 = 0 THEN '::sa:x' ELSE '' END AS conv, root_trace_id || CASE WHEN user_id % 2 = 0 THEN '__replay_' || (user_id % 5) ELSE '' END AS root FROM r)) c
LEFT JOIN u s ON s.a = c.root LEFT JOIN u s2 ON s2.a = c.cut""", "u AS (SELECT 't' || c_custkey AS a FROM customer WHERE c_mktsegment <> 'BUILDING')"))
def resolved_roots(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d)
    conv = F.concat("root_trace_id", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("__replay_"), (F.col("user_id") % 5).cast("string"))).otherwise(""), F.when(F.col("user_id") % 3 == 0, "::sa:x").otherwise(""))
    known = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("id"))
    out = ids.resolve_roots(r.select(conv.alias("conv")).distinct(), known, "conv")
    return out.select("conv", "root_trace_id", "root_known", "root_source")


@query(request_sql("""
SELECT w.wanted, count(k.root_trace_id) AS n_candidates, CASE count(k.root_trace_id) WHEN 0 THEN 'not_found' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS resolution,
  CASE WHEN count(k.root_trace_id) = 1 THEN min(k.root_trace_id) END AS resolved_id, coalesce(string_agg(k.root_trace_id, ';' ORDER BY k.root_trace_id), '') AS candidates
FROM (SELECT DISTINCT 'root' || substr(root_trace_id, 1, 3) AS wanted FROM r UNION SELECT 'nothing') w
LEFT JOIN (SELECT DISTINCT 'root' || root_trace_id AS root_trace_id FROM r) k ON starts_with(k.root_trace_id, w.wanted) GROUP BY w.wanted"""))
def requested_ids(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d).select("root_trace_id").distinct()
    wanted = r.select(F.concat(F.lit("root"), F.substring("root_trace_id", 1, 3)).alias("wanted")).unionByName(spark.createDataFrame([("nothing",)], "wanted string"))
    return ids.resolve_prefixes(wanted, r.select(F.concat(F.lit("root"), "root_trace_id").alias("id")))


@query("""
WITH o AS (SELECT o_orderkey AS id FROM orders), l AS (SELECT l_orderkey AS id, l_linenumber AS c FROM lineitem)
SELECT u.id, """ + ", ".join(f"count(*) FILTER (c = {k}) AS n_{k}" for k in range(1, 8)) + """
FROM (SELECT id FROM o UNION SELECT id FROM l) u LEFT JOIN l ON u.id = l.id GROUP BY u.id""")
def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("c"))
    return matching.presence_matrix(u, o, "id", "c", list(range(1, 8)))


@query(request_sql("""
SELECT c.concurrency, coalesce(n_requests, 0) AS n_requests, coalesce(n_roots, 0) AS n_roots, coalesce(n_known_roots, 0) AS n_known_roots, (SELECT count(DISTINCT a) FROM u) AS n_universe, round(coalesce(n_known_roots, 0) / (SELECT count(DISTINCT a) FROM u), 8) AS coverage
FROM (SELECT concurrency FROM p WHERE concurrency IS NOT NULL UNION SELECT unnest([1, 2, 8, 16])) c
LEFT JOIN (SELECT concurrency, count(*) AS n_requests, count(DISTINCT root_trace_id) AS n_roots FROM p GROUP BY ALL) s USING (concurrency)
LEFT JOIN (SELECT concurrency, count(DISTINCT root_trace_id) AS n_known_roots FROM p WHERE root_trace_id IN (SELECT a FROM u) GROUP BY ALL) k USING (concurrency)""", "u AS (SELECT 't' || c_custkey AS a FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD'))"))
def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "customer").where("c_mktsegment IN ('BUILDING', 'HOUSEHOLD')").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("a"))
    return rounded(rollups.coverage_summary(good(spark, d), u, [1, 2, 8, 16]))


@query("""
SELECT c AS concurrency, observed, count(*) AS n_ids, round(avg(o_totalprice), 4) AS mean_price, round(quantile_cont(o_totalprice, .5), 4) AS median_price FROM (
  SELECT o.o_orderkey, o.o_totalprice, k.c, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber = k.c) AS observed FROM orders o, (SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS c) k) GROUP BY ALL""")
def coverage_bias(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("concurrency"))
    f = matching.observed_flags(u, o, "o_orderkey", "concurrency", list(range(1, 8)))
    return rounded(f.groupBy("concurrency", "observed").agg(F.count("*").alias("n_ids"), F.avg("o_totalprice").alias("mean_price"), F.percentile("o_totalprice", 0.5).alias("median_price")), 4)


@query("""
WITH m AS (SELECT source, CASE WHEN doc_id % 10 = 0 THEN [] ELSE list_distinct([lang, CASE WHEN doc_id % 2 = 0 THEN 'xx' ELSE lang END]) END AS models FROM documents),
e AS (SELECT source, unnest(models) AS model FROM m), n AS (SELECT source, model, count(*) AS n FROM e GROUP BY ALL)
SELECT source, model, n, round(n / sum(n) OVER (PARTITION BY source), 8) AS share FROM n
UNION ALL SELECT source, 'none', 0, NULL FROM (SELECT DISTINCT source FROM m) WHERE source NOT IN (SELECT source FROM e)""")
def model_composition(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select("source", F.when(F.col("doc_id") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array("lang", F.when(F.col("doc_id") % 2 == 0, "xx").otherwise(F.col("lang"))))).alias("models"))
    return rounded(rollups.composition(m, ["source"], "models"))


@query(request_sql("""
SELECT concurrency, count(*) AS n_requests, count(DISTINCT p.root_trace_id) AS n_roots, count(DISTINCT CASE WHEN a IS NOT NULL THEN p.root_trace_id END) AS n_matched_roots, round(avg(CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END), 8) AS match_rate
FROM p LEFT JOIN (SELECT DISTINCT 't' || c_custkey AS a FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')) ON a = p.root_trace_id GROUP BY ALL"""))
def mapping_summary(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").where("c_mktsegment IN ('BUILDING', 'HOUSEHOLD')").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("a"))
    m = matching.member_flag(good(spark, d), "root_trace_id", known, "hit")
    return rounded(m.groupBy("concurrency").agg(F.count("*").alias("n_requests"), F.count_distinct("root_trace_id").alias("n_roots"), F.count_distinct(F.when(F.col("hit"), F.col("root_trace_id"))).alias("n_matched_roots"), F.avg(F.col("hit").cast("int")).alias("match_rate")))


@query(request_sql("""
SELECT root_trace_id, conversation_id, count(*) AS n FROM r WHERE root_trace_id NOT IN (SELECT 't' || c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')) GROUP BY ALL ORDER BY n DESC, root_trace_id, conversation_id LIMIT 100"""))
def unmatched_examples(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").where("c_mktsegment IN ('BUILDING', 'HOUSEHOLD')").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("a"))
    m = matching.member_flag(requests(spark, d), "root_trace_id", known, "hit").where("not hit")
    return m.groupBy("root_trace_id", "conversation_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root_trace_id", "conversation_id").limit(100)


@query(request_sql("""
SELECT concurrency, arg_min(root_trace_id, (request_start_ns, record_ordinal)) AS first_root, arg_max(root_trace_id, (request_start_ns, record_ordinal)) AS last_root, min(turn_index) AS min_turn, max(turn_index) AS max_turn, count(DISTINCT turn_index) AS n_turns,
  array_to_string(list_sort(list(DISTINCT turn_index)), ';') AS turns FROM p GROUP BY ALL"""))
def source_bounds(spark: SparkSession, d: str) -> DataFrame:
    from tracelane.functions.text import joined_sorted

    order = F.struct("request_start_ns", "record_ordinal")
    return good(spark, d).groupBy("concurrency").agg(F.min_by("root_trace_id", order).alias("first_root"), F.max_by("root_trace_id", order).alias("last_root"), F.min("turn_index").alias("min_turn"), F.max("turn_index").alias("max_turn"), F.count_distinct("turn_index").alias("n_turns"), joined_sorted("turn_index").alias("turns"))


@query(request_sql("SELECT worker_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share, round(sum(CASE WHEN itl_ms > 0 AND output_tokens > 1 THEN itl_ms * (output_tokens - 1) END) / sum(CASE WHEN itl_ms > 0 AND output_tokens > 1 THEN output_tokens - 1 END), 8) AS weighted_itl_ms FROM p GROUP BY worker_id"))
def worker_distribution(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    g = good(spark, d).groupBy("worker_id").agg(F.count("*").alias("n"), token_weighted_itl().alias("weighted_itl_ms"))
    return rounded(g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))))
