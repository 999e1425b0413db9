"""Keys, duplicates, joins, pairs and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.functions import ids
from tracelane.functions.arrays import fingerprint
from tracelane.operators import keys, matching, order_statistics, pairing, relations, requests as rq, rollups
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


def good(spark: SparkSession, d: str) -> DataFrame:
    return rq.profiled(requests(spark, d))


@query("""
SELECT doc_id AS record_ordinal, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) > 1 AS is_exact_duplicate, sha256(coalesce(text, '')) AS text_sha256 FROM documents""")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("record_ordinal"), "text", "lang")
    return rq.mark_duplicates(docs).select("record_ordinal", "is_exact_duplicate", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("""
WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS f FROM lineitem)
SELECT count(*) AS n_rows, count(DISTINCT (k, n)) AS n_keys, count(*) FILTER (c > 1) AS n_ambiguous FROM (SELECT *, count(*) OVER (PARTITION BY k, n) AS c FROM x)""")
def ambiguous_keys(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    dup = keys.repeated_keys(x.withColumnRenamed("n", "m"), ["k", "m"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_ambiguous"))
    return x.agg(F.count("*").alias("n_rows"), F.count_distinct("k", "n").alias("n_keys")).join(F.broadcast(dup)).select("n_rows", "n_keys", "n_ambiguous")


@query("""
SELECT o_orderkey, l_quantity, l_extendedprice, l_orderkey IS NOT NULL AS turn_matched FROM orders LEFT JOIN (
  SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL HAVING count(*) = 1) l ON l_orderkey = o_orderkey AND l_linenumber = 1""")
def unique_key_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey").withColumn("one", F.lit(1))
    li = table(spark, d, "lineitem")
    return matching.exact_turns(o, li, {"o_orderkey": "l_orderkey", "one": "l_linenumber"}, {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice"}).drop("one")


_SOURCE = """
src AS (SELECT root_trace_id, turn_index AS outer_i, min(conversation_id) AS path, min(input_tokens) AS si, min(output_tokens) AS so FROM r WHERE value < 40 GROUP BY ALL HAVING count(*) = 1),
q AS (SELECT record_ordinal, root_trace_id, turn_index, conversation_id, CASE WHEN record_ordinal % 2 = 0 THEN root_trace_id END AS sid, CAST(input_tokens AS DOUBLE) AS it, output_tokens AS ot FROM r)"""


def _turn_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = requests(spark, d)
    src = r.where("value < 40").groupBy("root_trace_id", "turn_index").agg(F.count("*").alias("n"), F.min("conversation_id").alias("source_conversation_path"), F.min("input_tokens").alias("source_input_tokens"), F.min("output_tokens").alias("source_output_tokens")).where("n = 1")
    src = src.select("root_trace_id", "source_conversation_path", F.col("turn_index").alias("source_branch_request_index"), F.col("turn_index").alias("source_outer_request_index"), F.lit(None).cast("long").alias("source_inner_request_index"), "source_input_tokens", "source_output_tokens", F.lit("root").alias("source_branch_type"))
    req = r.select("record_ordinal", "root_trace_id", "turn_index", F.col("conversation_id").alias("request_path"), F.when(F.col("record_ordinal") % 2 == 0, F.col("root_trace_id")).alias("source_trace_id"), F.col("turn_index").alias("source_outer_idx"), F.lit(None).cast("long").alias("source_inner_idx"), "input_tokens", "output_tokens")
    return req, src


@query(request_sql("""
SELECT q.record_ordinal, CASE WHEN sid IS NOT NULL THEN sid || '|' || q.turn_index || '|-1' END AS loader_key,
  CASE WHEN l.root_trace_id IS NOT NULL AND abs(q.it - l.si) <= 1e-9 THEN 'exact_turn_match' WHEN l.root_trace_id IS NOT NULL THEN 'loader_metadata_turn_match' WHEN t.root_trace_id IS NOT NULL THEN 'exact_turn_match'
    WHEN EXISTS (SELECT 1 FROM src b WHERE b.root_trace_id = q.root_trace_id AND b.path = q.conversation_id) THEN 'branch_match_unverified' WHEN q.root_trace_id IN (SELECT root_trace_id FROM src) THEN 'root_match_only' ELSE 'unmatched' END AS match_class
FROM q LEFT JOIN src l ON l.root_trace_id = q.sid AND l.outer_i = q.turn_index LEFT JOIN src t ON t.root_trace_id = q.root_trace_id AND t.path = q.conversation_id AND t.outer_i = q.turn_index AND t.si = q.it""", _SOURCE))
def turn_matching(spark: SparkSession, d: str) -> DataFrame:
    req, src = _turn_tables(spark, d)
    return matching.match_turns(req, src).select("record_ordinal", "loader_key", "match_class")


@query("""
SELECT n_a, n_b, n_both, n_a - n_both AS only_a, n_b - n_both AS only_b, n_both / n_either AS jaccard FROM (
  SELECT (SELECT count(DISTINCT o_orderkey) FROM orders WHERE o_orderstatus = 'F') AS n_a, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_quantity > 40) AS n_b,
    (SELECT count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)) AS n_both,
    (SELECT count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)) AS n_either)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return matching.set_sizes(a, table(spark, d, "lineitem").where("l_quantity > 40").select("l_orderkey"))


_COLLAPSED = "c AS (SELECT l_partkey AS k, l_linenumber AS g, count(*) AS n_rows, quantile_cont(l_quantity, .5) AS q, quantile_cont(l_extendedprice, .5) AS e FROM lineitem GROUP BY ALL)"


def _collapsed(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("g"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"), F.col("l_orderkey").alias("record_ordinal"))
    return pairing.collapse(li, ["k", "g"], ["q", "e"])


@query(f"""WITH {_COLLAPSED}, b AS (SELECT k, arg_min(g, (g <> 1, g)) AS bg, arg_min(q, (g <> 1, g)) AS bq, arg_min(e, (g <> 1, g)) AS be FROM c GROUP BY k)
SELECT c.k, c.g, bg AS baseline_g, round(q / nullif(bq, 0), 8) AS q_ratio, round(e / nullif(be, 0), 8) AS e_ratio,
  q / nullif(bq, 0) BETWEEN .8 AND 1.25 AND e / nullif(be, 0) BETWEEN .8 AND 1.25 AS comparable FROM c JOIN b USING (k)""")
def baseline_ratios(spark: SparkSession, d: str) -> DataFrame:
    out = pairing.against_baseline(_collapsed(spark, d), ["k"], "g", ["q", "e"])
    return rounded(out.withColumn("comparable", pairing.comparable("q_ratio", "e_ratio")).select("k", "g", "baseline_g", "q_ratio", "e_ratio", "comparable"))


@query(f"""WITH {_COLLAPSED} SELECT a.k, a.g AS g_left, b.g AS g_right, round(b.q / nullif(a.q, 0), 8) AS q_ratio, round(b.q - a.q, 8) AS q_difference FROM c a JOIN c b ON a.k = b.k AND a.g < b.g""")
def group_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = pairing.pair_ratios(pairing.all_pairs(_collapsed(spark, d), ["k"], "g", ["q"]), ["q"])
    return rounded(p.select("k", "g_left", "g_right", "q_ratio", "q_difference"))


_KEYED = "kx AS (SELECT root_trace_id || '|' || turn_index AS k, concurrency AS g, quantile_cont(output_tokens, .5) AS o, quantile_cont(ttft_ms, .5) AS t, quantile_cont(itl_ms, .5) AS i FROM p GROUP BY ALL), x AS (SELECT a.k, a.g AS gl, b.g AS gr, a.o AS ol, b.o AS o2, a.t AS tl, b.t AS tr, a.i AS il, b.i AS ir FROM kx a JOIN kx b ON a.k = b.k AND a.g < b.g)"


def _turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = good(spark, d).withColumn("k", F.concat_ws("|", "root_trace_id", "turn_index"))
    c = pairing.collapse(r, ["k", "concurrency"], ["output_tokens", "ttft_ms", "itl_ms"])
    p = pairing.strict_flags(pairing.all_pairs(c, ["k"], "concurrency", ["output_tokens", "ttft_ms", "itl_ms"]))
    return pairing.pair_ratios(p, ["ttft_ms", "itl_ms"])


_DEC = "coalesce(il > 0 AND ir > 0 AND ol = o2 AND ol > 1, false)"


@query(request_sql(f"""
SELECT gl AS concurrency_left, gr AS concurrency_right, count(*) AS n_pairs, count(*) FILTER (coalesce(tl > 0 AND tr > 0, false)) AS n_strict_ttft, count(*) FILTER ({_DEC}) AS n_strict_decode,
  round(quantile_cont(CASE WHEN tl > 0 AND tr > 0 THEN tr / tl END, .5), 8) AS median_ttft_ms_ratio, round(quantile_cont(CASE WHEN {_DEC} THEN ir / nullif(il, 0) END, .5), 8) AS median_itl_ms_ratio,
  round(sum(CASE WHEN {_DEC} THEN ir * (o2 - 1) END) / nullif(sum(CASE WHEN {_DEC} THEN o2 - 1 END), 0), 8) AS weighted_itl_right_ms FROM x GROUP BY ALL""", _KEYED))
def pair_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pairing.pair_summary(_turn_pairs(spark, d), ["concurrency_left", "concurrency_right"], ["ttft_ms", "itl_ms"]))


@query(request_sql("""
SELECT record_l AS root_trace_id, ml AS left_turns, mr AS right_turns, round(tr / nullif(tl, 0), 8) AS ttft_ms_ratio FROM (
  SELECT a.root_trace_id AS record_l, a.n AS ml, b.n AS mr, a.t AS tl, b.t AS tr FROM (SELECT root_trace_id, count(*) AS n, quantile_cont(ttft_ms, .5) AS t FROM p WHERE concurrency = 1 GROUP BY ALL) a
  JOIN (SELECT root_trace_id, count(*) AS n, quantile_cont(ttft_ms, .5) AS t FROM p WHERE concurrency = 2 GROUP BY ALL) b USING (root_trace_id))"""))
def one_to_one_pairs(spark: SparkSession, d: str) -> DataFrame:
    r = good(spark, d)
    side = lambda c: pairing.collapse(r.where(F.col("concurrency") == c), ["root_trace_id"], ["ttft_ms"])
    p = pairing.one_to_one(side(1), side(2), ["root_trace_id"], ["n_rows", "ttft_ms"])
    return rounded(pairing.pair_ratios(p, ["ttft_ms"]).select("root_trace_id", F.col("n_rows_left").alias("left_turns"), F.col("n_rows_right").alias("right_turns"), "ttft_ms_ratio"))


@query("""
WITH s AS (SELECT DISTINCT l_partkey AS k, l_linenumber AS g FROM lineitem), n AS (SELECT g, count(*) AS n FROM s GROUP BY g)
SELECT a.g AS g_left, a.n AS n_left, b.g AS g_right, b.n AS n_right, (SELECT count(*) FROM s x JOIN s y ON x.k = y.k WHERE x.g = a.g AND y.g = b.g) AS n_both,
  round((SELECT count(*) FROM s x JOIN s y ON x.k = y.k WHERE x.g = a.g AND y.g = b.g) / (a.n + b.n - (SELECT count(*) FROM s x JOIN s y ON x.k = y.k WHERE x.g = a.g AND y.g = b.g)), 8) AS jaccard FROM n a JOIN n b ON a.g < b.g""")
def key_jaccard(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("g"))
    return rounded(pairing.key_overlap(s, "k", "g")).select("g_left", "n_left", "g_right", "n_right", "n_both", "jaccard")


@query(request_sql("""
SELECT concurrency, round(t / b_t, 8) AS latency_inflation, round((n / concurrency) / (b_n / b_c), 8) AS rate_retention, round(n / b_n, 8) AS throughput_ratio FROM (
  SELECT *, first(t) OVER (ORDER BY concurrency) AS b_t, first(n) OVER (ORDER BY concurrency) AS b_n, first(concurrency) OVER (ORDER BY concurrency) AS b_c FROM (SELECT concurrency, quantile_cont(ttft_ms, .5) AS t, count(*)::DOUBLE AS n FROM p GROUP BY ALL))"""))
def scaling_curve(spark: SparkSession, d: str) -> DataFrame:
    s = good(spark, d).groupBy("concurrency").agg(F.percentile("ttft_ms", 0.5).alias("t"), F.count("*").cast("double").alias("n"))
    return rounded(pairing.scaling_curve(s, "concurrency", "t", "n").select("concurrency", "latency_inflation", "rate_retention", "throughput_ratio"))


@query(request_sql("""
SELECT a.root_trace_id, a.metric, round(a.v, 8) AS left_value, round(b.v, 8) AS right_value, round(b.v / nullif(a.v, 0), 8) AS ratio, round((b.v / 4) / nullif(a.v / 2, 0), 8) AS worker_normalized_ratio
FROM (UNPIVOT (SELECT root_trace_id, count(*)::DOUBLE AS n, sum(output_tokens) AS tokens, quantile_cont(ttft_ms, .5) AS ttft FROM p WHERE concurrency = 1 GROUP BY ALL) ON n, tokens, ttft INTO NAME metric VALUE v) a
JOIN (UNPIVOT (SELECT root_trace_id, count(*)::DOUBLE AS n, sum(output_tokens) AS tokens, quantile_cont(ttft_ms, .5) AS ttft FROM p WHERE concurrency = 2 GROUP BY ALL) ON n, tokens, ttft INTO NAME metric VALUE v) b USING (root_trace_id, metric)"""))
def system_comparison(spark: SparkSession, d: str) -> DataFrame:
    r = good(spark, d)
    side = lambda c: r.where(F.col("concurrency") == c).groupBy("root_trace_id").agg(F.count("*").alias("n"), F.sum("output_tokens").alias("tokens"), F.percentile("ttft_ms", 0.5).alias("ttft"))
    return rounded(pairing.compare_systems(side(1), side(2), "root_trace_id", ["n", "tokens", "ttft"], (2, 4)))


REPS, SEED = 1000, 7


@query(request_sql(f"""
SELECT g, n_rows, n_clusters, round(m, 8) AS median_ratio, round(q[1], 8) AS ci_low, round(q[2], 8) AS ci_high FROM
  (SELECT g, count(*) AS n_rows, count(DISTINCT c) AS n_clusters, quantile_cont(v, .5) AS m FROM z GROUP BY g) JOIN
  (SELECT g, quantile_cont(m, [.025, .975]) AS q FROM (SELECT d.g, rep, quantile_cont(v, .5) AS m FROM d JOIN z ON z.g = d.g AND z.c = d.c GROUP BY ALL) GROUP BY g) USING (g)""", f"""
z AS (SELECT concurrency AS g, root_trace_id AS c, e2e_ms / nullif(ttft_ms, 0) AS v FROM p WHERE e2e_ms / nullif(ttft_ms, 0) > 0),
cl AS (SELECT g, c, row_number() OVER (PARTITION BY g ORDER BY c) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM (SELECT DISTINCT g, c FROM z)),
d AS (SELECT s.g, s.rep, cl.c FROM (SELECT g, rep, CAST('0x' || substr(md5('{SEED}|' || g || '|' || rep || '|' || slot), 1, 8) AS BIGINT) % n AS i
    FROM (SELECT g, any_value(n) AS n, unnest(range(any_value(n))) AS slot FROM cl GROUP BY g), (SELECT unnest(range({REPS})) AS rep)) s JOIN cl ON cl.g = s.g AND cl.i = s.i)"""))
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    from tracelane.functions.coerce import ratio

    r = good(spark, d).select(F.col("concurrency").alias("g"), F.col("root_trace_id").alias("c"), ratio("e2e_ms", "ttft_ms").alias("v"))
    return rounded(pairing.bootstrap_ratio(r, "c", "v", ["g"], REPS, SEED))


@query(request_sql("""
SELECT scope, count(*) AS n, round(corr(rx, ry), 8) AS rho FROM (
  SELECT scope, rank() OVER (PARTITION BY scope ORDER BY input_tokens) + (count(*) OVER (PARTITION BY scope, input_tokens) - 1) / 2 AS rx, rank() OVER (PARTITION BY scope ORDER BY ttft_ms) + (count(*) OVER (PARTITION BY scope, ttft_ms) - 1) / 2 AS ry
  FROM (SELECT 'all' AS scope, input_tokens, ttft_ms FROM p UNION ALL SELECT coalesce(branch_type, 'unknown'), input_tokens, ttft_ms FROM p) WHERE input_tokens IS NOT NULL AND ttft_ms IS NOT NULL) GROUP BY scope"""))
def cache_relationship(spark: SparkSession, d: str) -> DataFrame:
    return rounded(relations.spearman_all_and_each(good(spark, d), "branch_type", "input_tokens", "ttft_ms"))


@query(None)
def spearman_p_values(spark: SparkSession, d: str) -> DataFrame:
    return relations.with_p_value(order_statistics.rank_correlation(good(spark, d), ["concurrency"], "input_tokens", "ttft_ms"))


@query(request_sql("""
SELECT concurrency, lag, n, round(r, 8) AS r FROM (SELECT *, row_number() OVER (PARTITION BY concurrency ORDER BY round(abs(r), 12) DESC, lag) AS o FROM (
  SELECT concurrency, k AS lag, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n, corr(x, y) AS r FROM ("""
    + " UNION ALL ".join(f"SELECT concurrency, {k} AS k, input_tokens AS x, {'lag' if k >= 0 else 'lead'}(e2e_ms, {abs(k)}) OVER (PARTITION BY concurrency ORDER BY record_ordinal) AS y FROM p" for k in range(-5, 6))
    + ") GROUP BY ALL) WHERE r IS NOT NULL) WHERE o = 1"))
def best_lags(spark: SparkSession, d: str) -> DataFrame:
    out = relations.best_lag(good(spark, d), ["concurrency"], "record_ordinal", "input_tokens", "e2e_ms")
    return rounded(out.select("concurrency", "lag", "n", "r"))


@query("""SELECT l_orderkey AS k, l_linenumber AS line, l_quantity AS q FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1""")
def last_per_key(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return keys.last_per_key(li, ["l_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("q"))


@query("""SELECT l_partkey, count(DISTINCT (l_returnflag, l_linestatus)) AS versions FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1""")
def conflicting_ids(spark: SparkSession, d: str) -> DataFrame:
    return keys.conflicts(table(spark, d, "lineitem"), "l_partkey", ["l_returnflag", "l_linestatus"])


@query("""SELECT * FROM (SELECT 'regions' AS "check", 5::BIGINT AS expected, count(*) AS actual, count(*) = 5 AS passed FROM nation WHERE n_nationkey < 5
UNION ALL SELECT 'all', 20, count(*), count(*) = 20 FROM nation)""")
def scope_checks(spark: SparkSession, d: str) -> DataFrame:
    return keys.row_counts(table(spark, d, "nation"), {"regions": (F.col("n_nationkey") < 5, 5), "all": (F.lit(True), 20)})


@query("""SELECT conv_id, turn, sha256('[' || array_to_string(ts, ',') || ']') AS hash FROM (SELECT conv_id, turn, [length(coalesce(text, '')), conv_id, turn] AS ts FROM conversations)""")
def array_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", fingerprint(F.array(F.length(F.coalesce("text", F.lit(""))).cast("long"), F.col("conv_id"), F.col("turn"))).alias("hash"))


@query(request_sql("SELECT record_ordinal, root_trace_id || '|' || turn_index || '|' || coalesce(CAST(session_num AS VARCHAR), '-1') AS source_key FROM r"))
def source_keys(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select("record_ordinal", ids.source_key("root_trace_id", "turn_index", "session_num").alias("source_key"))


@query("""
WITH n AS (SELECT conv_id, turn, 'run_' || role || CASE WHEN conv_id % 2 = 0 THEN '-conc' || (conv_id % 4 + 1) ELSE '_' || (conv_id % 4 + 1) || 'conc' END || CASE turn % 4 WHEN 0 THEN '-bmk_agentic' WHEN 1 THEN '_agentic' WHEN 2 THEN '-server-logs' ELSE '-run-stats' END || CASE WHEN turn = 5 THEN '.c-9' ELSE '' END AS name FROM conversations)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'aggregated_agentic' WHEN 1 THEN CASE WHEN turn = 5 THEN 'other' ELSE 'raw_agentic' END WHEN 2 THEN 'server_log' ELSE 'run_summary' END AS category, CASE WHEN turn <> 5 OR conv_id % 4 + 1 = 9 THEN CAST(conv_id % 4 + 1 AS INTEGER) END AS concurrency FROM n""")
def artifact_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    kind, n = F.element_at(F.array(*map(F.lit, ("-bmk_agentic", "_agentic", "-server-logs", "-run-stats"))), (F.col("turn") % 4 + 1).cast("int")), (F.col("conv_id") % 4 + 1).cast("string")
    conc = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("-conc"), n)).otherwise(F.concat(F.lit("_"), n, F.lit("conc")))
    name = F.concat(F.lit("run_"), "role", conc, kind, F.when(F.col("turn") == 5, ".c-9").otherwise(""))
    return c.select("conv_id", "turn", ids.artifact_category(name).alias("category"), ids.name_concurrency(name).alias("concurrency"))


@query(request_sql("""SELECT concurrency, count(*) AS n_requests, count(*) FILTER (h) AS n_found FROM (SELECT p.concurrency, p.root_trace_id IN (SELECT 't' || c_custkey FROM customer) AS h FROM p) GROUP BY ALL"""))
def requested_coverage(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("id"))
    m = matching.member_flag(good(spark, d), "root_trace_id", known, "h")
    return m.groupBy("concurrency").agg(F.count("*").alias("n_requests"), F.count_if("h").alias("n_found"))


@query("""SELECT c_mktsegment AS segment, rank_metric, CAST(rank AS BIGINT) AS rank, value, c_custkey FROM (
  SELECT 'acctbal' AS rank_metric, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rank, c_acctbal AS value, c_custkey, c_mktsegment FROM customer) WHERE rank <= 20""")
def top_customers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumnRenamed("c_acctbal", "acctbal")
    return rollups.top_by(c, {"acctbal": True}, ["c_custkey", "c_mktsegment"], 20).select(F.col("c_mktsegment").alias("segment"), "rank_metric", F.col("rank").cast("long").alias("rank"), "value", "c_custkey")
