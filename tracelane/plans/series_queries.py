"""Intervals, rank gauges, reconciliation, traces, schema inventory, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelane.functions import text as tx
from tracelane.operators import intervals as iv, ranks as rk, reconcile as rc, schema_inventory as si, traces as tr
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


DAY_NS = 86_400_000_000_000
_ST = """
iv AS (SELECT concurrency, request_start_ns AS s, request_end_ns AS e, CASE WHEN source_branch_type IS NULL OR trim(source_branch_type) = '' THEN 'unknown' WHEN source_branch_type = 'root' THEN 'root' ELSE 'subagent' END AS g FROM r WHERE request_end_ns > request_start_ns),
ch AS (SELECT concurrency, at_ns, sum(x) AS x, sum(x) FILTER (g = 'root') AS xr, sum(x) FILTER (g = 'subagent') AS xs FROM (SELECT concurrency, s AS at_ns, 1 AS x, g FROM iv UNION ALL SELECT concurrency, e, -1, g FROM iv) GROUP BY ALL),
st AS (SELECT concurrency, at_ns, CAST(sum(x) OVER w AS BIGINT) AS in_flight, CAST(sum(coalesce(xr, 0)) OVER w AS BIGINT) AS in_flight_root, CAST(sum(coalesce(xs, 0)) OVER w AS BIGINT) AS in_flight_subagent, lead(at_ns) OVER w AS until_ns FROM ch WINDOW w AS (PARTITION BY concurrency ORDER BY at_ns))"""


@query(request_sql("SELECT * FROM st", _ST))
def in_flight_states(spark: SparkSession, d: str) -> DataFrame:
    out = iv.states(requests(spark, d), ["concurrency"], chunk_ns=DAY_NS)
    return out.select("concurrency", "at_ns", "in_flight", "in_flight_root", "in_flight_subagent", "until_ns")


@query(request_sql("""
SELECT a.concurrency, max(in_flight) AS max, round(sum(in_flight * d) / sum(d), 8) AS mean, round(sum(d) / 1e9, 4) AS observed_s, """ + ", ".join(f"round(sum(CASE WHEN in_flight >= {t} THEN d ELSE 0 END) / sum(d), 8) AS fraction_ge_{t}" for t in (8, 12, 16, 24, 32)) + """,
  any_value(q.p50) AS p50, any_value(q.p90) AS p90, any_value(q.p95) AS p95, any_value(q.p99) AS p99
FROM (SELECT concurrency, in_flight, CAST(until_ns - at_ns AS DOUBLE) AS d FROM st WHERE until_ns IS NOT NULL) a JOIN (
  SELECT concurrency, """ + ", ".join(f"min(in_flight) FILTER (run >= {q} * total - 1e-9 * total) AS p{round(q * 100)}" for q in (.5, .9, .95, .99)) + """ FROM (
    SELECT concurrency, in_flight, sum(w) OVER (PARTITION BY concurrency ORDER BY in_flight) AS run, sum(w) OVER (PARTITION BY concurrency) AS total FROM (SELECT concurrency, in_flight, sum(CAST(until_ns - at_ns AS DOUBLE)) AS w FROM st WHERE until_ns IS NOT NULL GROUP BY ALL)) GROUP BY ALL) q USING (concurrency) GROUP BY ALL""", _ST))
def in_flight_summary(spark: SparkSession, d: str) -> DataFrame:
    s = iv.load_summary(iv.state_intervals(requests(spark, d), ["concurrency"], chunk_ns=DAY_NS), ["concurrency"])
    return rounded(s.withColumn("observed_s", F.round("observed_s", 4)))


# running numbers of starts and ends up to each time of a lane
_CONTEXTS = """
va AS (SELECT record_ordinal, concurrency, request_start_ns AS s, request_end_ns AS e, row_number() OVER (PARTITION BY concurrency, request_end_ns ORDER BY record_ordinal) AS nth FROM r WHERE request_end_ns > request_start_ns),
pt AS (SELECT concurrency, t, sum(a) AS a, sum(b) AS b FROM (SELECT concurrency, s AS t, 1 AS a, 0 AS b FROM va UNION ALL SELECT concurrency, e, 0, 1 FROM va) GROUP BY ALL),
cu AS (SELECT *, sum(a) OVER w AS aa, sum(b) OVER w AS bb FROM pt WINDOW w AS (PARTITION BY concurrency ORDER BY t))"""
_CONTEXTS_SQL = """
SELECT record_ordinal, CAST(x.aa - x.a - x.bb AS BIGINT) AS before_start, CAST(x.aa - x.bb AS BIGINT) AS at_start, CAST(y.aa - y.a - (y.bb - y.b) - nth + 1 AS BIGINT) AS before_end
FROM va JOIN cu x ON x.concurrency = va.concurrency AND x.t = s JOIN cu y ON y.concurrency = va.concurrency AND y.t = e"""


@query(request_sql(_CONTEXTS_SQL, _CONTEXTS))
def request_contexts(spark: SparkSession, d: str) -> DataFrame:
    c = iv.contexts(requests(spark, d), ["concurrency"], "record_ordinal", chunk_ns=DAY_NS)
    return c.select("record_ordinal", "before_start", "at_start", "before_end")


@query(request_sql(_CONTEXTS_SQL, _CONTEXTS))
def all_request_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The same under its earlier name."""
    return request_contexts(spark, d)


@query(request_sql("SELECT CASE WHEN request_start_ns IS NULL THEN 'missing_request_start_ns' WHEN request_end_ns IS NULL THEN 'missing_request_end_ns' WHEN request_end_ns <= request_start_ns THEN 'nonpositive_request_interval' ELSE 'valid' END AS reason, count(*) AS n FROM r GROUP BY ALL"))
def interval_validity(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).groupBy(F.coalesce(iv.invalid_reason(), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


_GAPS = """
gp AS (SELECT user_id % 2 AS side, user_id // 2 AS pair, s, lead(s) OVER (PARTITION BY user_id ORDER BY s, record_ordinal) AS e, input_tokens AS v FROM (SELECT user_id, record_ordinal, request_start_ns AS s, input_tokens FROM r)),
ov AS (SELECT a.pair, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e, a.v + b.v AS v FROM gp a JOIN gp b ON a.pair = b.pair AND a.side = 0 AND b.side = 1 AND a.s < a.e AND b.s < b.e AND a.s < b.e AND b.s < a.e)"""


@query(request_sql("SELECT pair, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS overlap_ns, max(v) AS max_sum, round(sum(v * (e - s)) / sum(e - s), 6) AS mean_sum FROM ov GROUP BY pair", _GAPS))
def interval_overlaps(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d)
    g = r.select((F.col("user_id") % 2).alias("side"), F.floor(F.col("user_id") / 2).alias("pair"), F.col("request_start_ns").alias("s"), F.lead("request_start_ns").over(Window.partitionBy("user_id").orderBy("request_start_ns", "record_ordinal")).alias("e"), F.col("input_tokens").alias("v"))
    o = iv.overlaps(g.where("side = 0"), g.where("side = 1"), "s", "e", 86_400_000_000_000, ["pair"], ["v"])
    o = o.withColumn("v", F.col("v_a") + F.col("v_b"))
    return rounded(o.groupBy("pair").agg(F.count("*").alias("n"), F.sum("duration").alias("overlap_ns"), F.max("v").alias("max_sum"), (F.sum(F.col("v") * F.col("duration")) / F.sum("duration")).alias("mean_sum")), 6)


_WK = "g AS (SELECT user_id AS worker, event_type AS rank, request_start_ns // 604800000000000 AS slice, max(input_tokens) AS v FROM r GROUP BY ALL), sl AS (SELECT worker, slice, count(DISTINCT rank) AS n_ranks, count(v) AS n, min(v) AS low, quantile_cont(v, .5) AS middle, max(v) AS high, sum(v) AS total FROM g GROUP BY ALL)"


def _gauges(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).groupBy(F.col("user_id").alias("worker"), F.col("event_type").alias("rank"), F.expr("request_start_ns div 604800000000000").alias("slice")).agg(F.max("input_tokens").alias("v"))


@query(request_sql("""
SELECT worker, count(*) AS n_slices, count(*) FILTER (n_ranks = 5 AND n = 5) AS n_complete, count(*) FILTER (n_ranks = 5 AND n = 5 AND low = high) AS n_equal, max(high - low) FILTER (n_ranks = 5 AND n = 5) AS max_spread,
  CASE WHEN max(n_ranks) <> 5 THEN 'rank_count_mismatch' WHEN count(*) FILTER (n_ranks = 5 AND n = 5) = count(*) THEN 'exact_all_rank_timestamp_alignment' ELSE 'partial_rank_timestamp_alignment' END AS status FROM sl GROUP BY worker""", _WK))
def rank_validation(spark: SparkSession, d: str) -> DataFrame:
    return rk.validation(_gauges(spark, d), ["worker"], ["slice"], "rank", "v", 5).select("worker", "n_slices", "n_complete", "n_equal", "max_spread", "status")


@query(request_sql("SELECT worker, slice, low, middle, high, CASE WHEN n_ranks = 5 AND n = 5 THEN total END AS shard_sum, CASE WHEN n_ranks = 5 AND n = 5 AND low = high THEN low END AS worker_value FROM sl", _WK))
def rank_envelopes(spark: SparkSession, d: str) -> DataFrame:
    g, keys = _gauges(spark, d), ["worker", "slice"]
    e = rk.envelope(g, keys, "rank", "v", 5).drop("n_ranks")
    s = rk.shard_sum(g, keys, "rank", "v", 5).select(*keys, F.col("value").alias("shard_sum"))
    w = rk.deduplicated(g, keys, "rank", "v", 5).withColumnRenamed("value", "worker_value")
    return e.join(s, keys).join(w, keys)


@query(request_sql("""
SELECT a.rank AS rank_left, b.rank AS rank_right, count(*) AS n_common, round(100 * count(*) FILTER (a.v = b.v) / count(*), 8) AS match_percent, round(corr(a.v, b.v), 8) AS r FROM g a JOIN g b ON a.worker = b.worker AND a.slice = b.slice AND a.rank < b.rank GROUP BY ALL""", _WK))
def rank_pairs(spark: SparkSession, d: str) -> DataFrame:
    g = _gauges(spark, d).withColumn("all", F.lit("all"))
    return rounded(rk.rank_pairs(g, ["all"], ["worker", "slice"], "rank", "v").drop("all"))


@query(request_sql("SELECT worker, rank, (SELECT count(DISTINCT slice) FROM g b WHERE b.worker = g.worker) - count(DISTINCT slice) AS n_missing FROM g GROUP BY worker, rank", _WK))
def missing_ranks(spark: SparkSession, d: str) -> DataFrame:
    return rk.missing_by_rank(_gauges(spark, d), ["worker"], ["slice"], "rank", "v")


@query(request_sql("""
SELECT worker, count(*) AS n_ranks, CAST(sum(n) AS BIGINT) AS n_samples, """ + ", ".join(f"round({f}, 8) AS {s}_{n}" for s in ("mean", "p95", "max") for n, f in (("low", f"min({s})"), ("middle", f"quantile_cont({s}, .5)"), ("high", f"max({s})"))) + """
FROM (SELECT worker, rank, count(v) AS n, avg(v) AS mean, quantile_cont(v, .95) AS p95, max(v) AS max FROM g GROUP BY ALL) GROUP BY worker""", _WK))
def scheduler_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rk.across_ranks(_gauges(spark, d), ["worker"], "rank", "v"))


_BINS = "b AS (SELECT event_type, floor((request_start_ns - 1704067200000000000) / 86400000000000.0)::BIGINT AS bin, value, input_tokens FROM r)"


@query(request_sql("SELECT event_type, bin, round(avg(value), 8) AS mean_value, count(value) AS n_samples FROM b GROUP BY ALL", _BINS))
def phase_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rk.binned(requests(spark, d), ["event_type"], "request_start_ns", 1704067200000000000, 86_400_000_000_000, "value"))


@query(request_sql("SELECT event_type, bin, min(value) AS low, round(quantile_cont(value, .5), 8) AS middle, max(value) AS high FROM b GROUP BY ALL", _BINS))
def downsampled(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rk.downsampled(requests(spark, d), ["event_type"], "request_start_ns", 1704067200000000000, 86_400_000_000_000, "value"))


@query(request_sql("""
SELECT event_type, count(*) AS n_common, count(*) FILTER (x > 0 AND y = 0) AS n_only_x, count(*) FILTER (y > 0 AND x = 0) AS n_only_y, round(count(*) FILTER (x = y) / count(*), 8) AS same_fraction,
  round(quantile_cont(abs(x - y), .5), 8) AS gap_p50, round(quantile_cont(abs(x - y), .95), 8) AS gap_p95, round(max(abs(x - y)), 8) AS gap_max
FROM (SELECT event_type, bin, avg(value) AS x, avg(input_tokens) AS y FROM b GROUP BY ALL) GROUP BY event_type""", _BINS))
def series_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d)
    side = lambda v: rk.binned(r, ["event_type"], "request_start_ns", 1704067200000000000, 86_400_000_000_000, v)
    return rounded(rk.crosscheck(side("value"), side("input_tokens"), ["event_type"]))


@query(request_sql("""SELECT slice, CASE WHEN count(*) FILTER (worker = 1) = 1 AND count(*) FILTER (worker = 2) = 1 THEN sum(v) END AS cluster_value, count(*) FILTER (worker = 1) = 1 AND count(*) FILTER (worker = 2) = 1 AS complete
FROM (SELECT worker, slice, max(v) AS v FROM g GROUP BY ALL) WHERE worker IN (1, 2) GROUP BY slice""", _WK))
def worker_pair_sum(spark: SparkSession, d: str) -> DataFrame:
    g = _gauges(spark, d).groupBy("worker", "slice").agg(F.max("v").alias("v"))
    return rk.worker_sum(g, [1, 2], ["slice"], "worker", "v")


@query(request_sql("""SELECT worker, slice, field, CASE WHEN field <> 'min' AND count(DISTINCT rank) = 5 AND count(x) = 5 THEN sum(x) END AS value, count(DISTINCT rank) AS n_ranks, CASE WHEN field = 'min' OR count(x) <> 5 THEN 'Unavailable' ELSE 'complete' END AS status
FROM (SELECT worker, slice, rank, unnest(['avg', 'last', 'min']) AS field, unnest([v, v + 1, NULL]) AS x FROM g) GROUP BY worker, slice, field""", _WK))
def field_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    g = _gauges(spark, d).withColumns({"avg": F.col("v"), "last": F.col("v") + 1})
    return rk.field_variants(g, ["worker", "slice"], "rank", ["avg", "last", "min"], 5)


@query("""
WITH raw AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount)) AS total_ms, count(*)::DOUBLE AS requests FROM lineitem GROUP BY ALL), pub AS (SELECT o_orderkey AS k, o_totalprice AS total_ms, (o_orderkey % 7)::DOUBLE AS requests FROM orders),
a AS (SELECT coalesce(raw.k, pub.k) AS k, m AS metric, CASE m WHEN 'total_ms' THEN raw.total_ms ELSE raw.requests END AS x, CASE m WHEN 'total_ms' THEN pub.total_ms ELSE pub.requests END AS y FROM raw FULL JOIN pub ON raw.k = pub.k, (SELECT unnest(['total_ms', 'requests']) AS m)),
s AS (SELECT metric, CASE WHEN x IS NULL OR y IS NULL THEN 'not_comparable' WHEN metric = 'total_ms' AND (abs(x - y) <= 1 OR coalesce(abs(x - y) / nullif(abs(y), 0) <= .01, false)) OR metric = 'requests' AND (abs(x - y) <= 1e-9 OR abs(x - y) <= 1e-9 * abs(y)) THEN 'pass' ELSE 'mismatch' END AS validation_status FROM a)
SELECT metric, validation_status, count(*) AS n FROM s GROUP BY ALL""")
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total_ms"), F.count("*").cast("double").alias("requests"))
    pub = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("total_ms"), (F.col("o_orderkey") % 7).cast("double").alias("requests"))
    return rc.status_totals(rc.compared(rc.aligned_metrics(raw, pub, "k", ["total_ms", "requests"])), ["metric"])


@query(request_sql("""SELECT concurrency, count(*) AS requests, sum(input_tokens) AS total_input_tokens, round(avg(output_tokens), 8) AS mean_output_tokens, round(avg(CASE WHEN itl_ms > 0 THEN itl_ms END), 8) AS mean_itl_ms, round(quantile_cont(ttft_ms, .99), 8) AS p99_ttft_ms,
  round((max(request_end_ns) - min(request_start_ns)) / 1e9, 8) AS duration_s, round(sum(output_tokens) / ((max(request_end_ns) - min(request_start_ns)) / 1e9), 8) AS output_tps FROM p GROUP BY ALL"""))
def raw_aggregates(spark: SparkSession, d: str) -> DataFrame:
    from tracelane.operators.requests import profiled

    return rounded(rc.raw_aggregates(profiled(requests(spark, d))).select("concurrency", "requests", "total_input_tokens", "mean_output_tokens", "mean_itl_ms", "p99_ttft_ms", "duration_s", "output_tps"))


@query("""SELECT coalesce(c, o) AS id, CASE WHEN c IS NULL THEN 'missing' WHEN o IS NULL THEN 'unexpected' ELSE 'present' END AS status FROM (SELECT DISTINCT c_custkey AS c FROM customer) FULL JOIN (SELECT DISTINCT o_custkey + 5 AS o FROM orders) ON c = o""")
def inventory_check(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return rc.inventory_check(a, table(spark, d, "orders").select((F.col("o_custkey") + 5).alias("id")), "id")


@query(request_sql("""SELECT concurrency, metric, v AS value, CASE metric WHEN 'n' THEN 'requests' ELSE 'ms' END AS unit, CASE WHEN v IS NULL THEN 'Unknown' ELSE 'available' END AS status
FROM (SELECT concurrency, unnest(['n', 'm', 'none']) AS metric, unnest([n, m, NULL]) AS v FROM (SELECT concurrency, count(*)::DOUBLE AS n, max(ttft_ms) AS m FROM p GROUP BY concurrency))"""))
def long_report(spark: SparkSession, d: str) -> DataFrame:
    from tracelane.operators.requests import profiled

    s = profiled(requests(spark, d)).groupBy("concurrency").agg(F.count("*").alias("n"), F.max("ttft_ms").alias("m"), F.max(F.lit(None).cast("double")).alias("none"))
    return rc.long_report(s, ["concurrency"], {"n": ("requests", "requests"), "m": ("ms", "largest"), "none": ("ms", "absent")}).drop("meaning")


_BLOCKS = "b AS (SELECT conv_id, turn, role, [length(w) FOR w IN string_split(coalesce(text, ''), ' ')] AS h FROM conversations), l AS (SELECT *, lag(h) OVER (PARTITION BY conv_id, role ORDER BY turn, h) AS p FROM b)"


def _turn_state(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    h = F.transform(F.split(F.coalesce("text", F.lit("")), " ", -1), lambda w: F.length(w).cast("long"))
    c = c.select(F.col("conv_id").cast("string").alias("root_trace_id"), F.concat_ws("::sa:", F.col("conv_id").cast("string"), "role").alias("source_conversation_path"), F.col("turn").alias("row_no"), h.alias("hash_ids"), F.lit(4).cast("long").alias("block_size"), (F.size(h) * 4 + 2).cast("long").alias("source_input_tokens"), F.col("conv_id"), F.col("role"))
    return tr.branch_state(c)


@query(f"WITH {_BLOCKS} SELECT conv_id, role, turn, CASE WHEN p IS NOT NULL THEN CAST(coalesce(list_position([p[i] IS NOT DISTINCT FROM h[i] FOR i IN range(1, least(len(p), len(h)) + 1)], false) - 1, least(len(p), len(h))) AS BIGINT) END AS shared_blocks FROM l")
def prefix_reuse(spark: SparkSession, d: str) -> DataFrame:
    return _turn_state(spark, d).select("conv_id", "role", F.col("row_no").alias("turn"), "shared_blocks")


@query(f"""WITH {_BLOCKS}, s AS (SELECT role, len(h) * 4 + 2 AS n, len(p) AS lp, CASE WHEN p IS NOT NULL THEN coalesce(list_position([p[i] IS NOT DISTINCT FROM h[i] FOR i IN range(1, least(len(p), len(h)) + 1)], false) - 1, least(len(p), len(h))) END AS k FROM l)
SELECT role, count(*) AS n_requests, count(k) AS n_with_previous, round(quantile_cont(CASE WHEN k IS NOT NULL THEN least(n, k * 4) / n END, .5), 8) AS cached_ratio_p50, round(quantile_cont(CASE WHEN k IS NOT NULL THEN least(n, k * 4) / n END, .9), 8) AS cached_ratio_p90, CAST(sum(CASE WHEN k IS NOT NULL THEN least(n, k * 4) END) AS BIGINT) AS cached_tokens,
  CAST(sum(CASE WHEN k IS NOT NULL THEN n - least(n, k * 4) END) AS BIGINT) AS new_tokens, count(*) FILTER (lp - k > 0) AS n_rollbacks FROM s GROUP BY role""")
def cache_shape(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.cache_shape(_turn_state(spark, d), ["role"]))


@query("""
SELECT 'c' || conv_id AS root_trace_id, count(role) AS n_requests, 1::BIGINT AS n_containers, count(*) FILTER (role <> 'user') AS n_subagent_requests, CAST(sum(length(text)) FILTER (role IS NOT NULL) AS BIGINT) AS input_tokens, CAST(nullif(3 * count(role), 0) AS BIGINT) AS output_tokens,
  max(length(text)) FILTER (role IS NOT NULL) AS max_input_tokens, min(turn::DOUBLE) FILTER (role IS NOT NULL) AS first_t, max(turn::DOUBLE) FILTER (role IS NOT NULL) AS last_t, coalesce(string_agg(DISTINCT role, ';' ORDER BY role), '') AS models, (max(turn) FILTER (role IS NOT NULL) - min(turn) FILTER (role IS NOT NULL))::DOUBLE AS span_s
FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id""")
def flattened_traces(spark: SparkSession, d: str) -> DataFrame:
    """Traces built from conversations: the user's turns at the top, the others in an agent's list."""
    c = table(spark, d, "conversations")
    req = F.struct(F.col("turn").cast("double").alias("t"), F.col("role").alias("model"), F.length("text").alias("in"), F.lit(3).alias("out"), F.transform(F.sequence(F.lit(0), F.least(F.col("turn"), F.lit(5))), lambda i: i).alias("hash_ids"))
    top = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("role") == "user", req))).alias("u"), F.sort_array(F.collect_list(F.when(F.col("role") != "user", req))).alias("a"))
    inner = F.to_json(F.struct(F.lit("subagent").alias("type"), F.lit("agent_001").alias("agent_id"), F.col("a").alias("requests")))
    users = F.transform("u", lambda x: F.to_json(x))
    text = F.concat(F.lit('{"id":"c'), F.col("conv_id").cast("string"), F.lit('","block_size":64,"requests":['), F.concat_ws(",", F.concat(users, F.array(inner))), F.lit("]}"))
    return tr.root_summary(tr.flatten(top.select(text.alias("value")))).withColumn("models", F.array_join("models", ";"))


@query("""SELECT 'k' AS path, count(*) AS n_present, 0::BIGINT AS n_null, 'bigint' AS kinds, min(CAST(props->>'k' AS DOUBLE)) AS min_value, max(CAST(props->>'k' AS DOUBLE)) AS max_value, 0.0::DOUBLE AS null_rate FROM events""")
def schema_inventory(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    flat = si.flattened(e.select("event_id", "props"), ["event_id"], "props", depth=3)
    n = e.agg(F.count("*").alias("all_"))
    return si.inventory(flat, 1).join(F.broadcast(n)).select("path", "n_present", "n_null", "kinds", "min_value", "max_value", (1 - (F.col("n_present") - F.col("n_null")) / F.col("all_")).alias("null_rate"))  # one row


@query("""SELECT event_id, CAST(props->>'k' AS BIGINT)::VARCHAR AS value, 'k' AS path FROM events""")
def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    flat = si.flattened(table(spark, d, "events").select("event_id", "props"), ["event_id"], "props", depth=2)
    return si.lookup(flat, ["event_id"], ["missing", "K", "other"])


_LINE = "'2024-01-01T00:00:' || lpad((event_id % 60)::VARCHAR, 2, '0') || 'Z max_running_requests=200 running_requests=' || (event_id % 40) || CASE WHEN event_id % 3 = 0 THEN ' waiting_reqs: ' || (event_id % 7) ELSE '' END"


@query(f"""WITH l AS (SELECT event_id, {_LINE} AS line FROM events)
SELECT name, observed, count(*) AS n, max(value) AS largest FROM (
  SELECT 'configured_max_running_requests' AS name, false AS observed, 200::DOUBLE AS value FROM l UNION ALL SELECT 'running_requests', true, event_id % 40 FROM l UNION ALL SELECT 'waiting_requests', true, event_id % 7 FROM l WHERE event_id % 3 = 0) GROUP BY ALL""")
def scheduler_counters(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    line = F.concat(F.lit("2024-01-01T00:00:"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit("Z max_running_requests=200 running_requests="), (i % 40).cast("string"), F.when(i % 3 == 0, F.concat(F.lit(" waiting_reqs: "), (i % 7).cast("string"))).otherwise(""))
    x = table(spark, d, "events").select(F.explode(tx.counters(line)).alias("c"))
    return x.groupBy("c.name", "c.observed").agg(F.count("*").alias("n"), F.max("c.value").alias("largest"))


@query("""SELECT doc_id, CASE WHEN starts_with(m, '[') THEN 2 ELSE 1 END::BIGINT AS n_models, CASE WHEN contains(lower(text), 'fp8') THEN 'fp8' WHEN regexp_matches(lower(text), 'bf16|bfloat16') THEN 'bf16' WHEN regexp_matches(lower(text), 'fp16|float16') THEN 'fp16' END AS precision
FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN '["a","b"]' ELSE lang END AS m FROM documents)""")
def text_labels(spark: SparkSession, d: str) -> DataFrame:
    m = F.when(F.col("doc_id") % 2 == 0, '["a","b"]').otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", F.size(tx.model_list(m)).cast("long").alias("n_models"), tx.precision("text").alias("precision"))


@query("""SELECT label, count(*) AS n, round(min(x), 8) AS low, round(quantile_cont(x, .5), 8) AS middle, round(max(x), 8) AS high FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label""")
def vector_envelopes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return rounded(e.groupBy("label").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.percentile("x", 0.5).alias("middle"), F.max("x").alias("high")))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS page, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title FROM pages""")
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    got = lambda c, p: F.regexp_extract(c, p, 1)
    return table(spark, d, "pages").select("page_id", got("url", "^[a-z]+://([^/?#]+)").alias("host"), F.nullif(got("url", "[?&]page=([0-9]+)"), F.lit("")).alias("page"), F.nullif(got("html", "<title>([^<]*)</title>"), F.lit("")).alias("title"))
