"""Profiles under many spellings, published results, and tables built from files written from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.operators import published as pb
from tracelane.plans.adapter import table
from tracelane.session import new_folder
from tracelane.sources import build, profiles
from tracelane.sources.sinks import read_table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _json(**fields) -> Column:
    return F.to_json(F.struct(*((F.lit(v) if isinstance(v, (str, int, bool)) else v).alias(k) for k, v in fields.items())), {"ignoreNullFields": "false"})


def _struct(**fields) -> Column:
    return F.struct(*((F.lit(v) if isinstance(v, (str, int, bool)) else v).alias(k) for k, v in fields.items()))


def spelled_profiles(events: DataFrame) -> DataFrame:
    """events as profile records in the spellings of six exporters: event_id and value (JSON). SPELLED_SQL is what they say."""
    i, v, user = F.col("event_id"), F.col("value"), F.col("user_id").cast("string")
    whole = F.floor(v * 1000).cast("long")
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    gone = i % 5 == 0
    metric = lambda value, unit: _struct(value=value, unit=unit)
    forms = [
        _json(
            metadata=_struct(conversation_id=F.concat(F.lit("t"), user, F.lit("::sa:a1:fa:000")), benchmark_phase="profiling", was_cancelled=gone, session_num=i % 3, turn_index=i % 7, request_start_ns=start, request_end_ns=start + 5, worker_id="w1"),
            metrics=_struct(input_sequence_length=metric(i % 50, "tokens"), output_sequence_length=metric(i % 9, "tokens"), time_to_first_token=metric(v, "s"), request_latency=metric(whole, "us"), inter_token_latency=metric(whole * 1000, "ns")),
            error=F.lit(None).cast("string"),
        ),
        _json(trace_id=user, phase=" Profiling ", is_cancelled=gone, session=i % 3, turn=(i % 7).cast("string"), start_time_ns=start, end_ns=start + 5, ttft_ms=v, request_latency_ms=v + 1, tpot_ms=v / 2, prompt_tokens=i % 50, completion_tokens=(i % 9).cast("string"), server_id="w2"),
        _json(Conversation=_struct(Conversation_ID=user), request=_struct(phase="warmup", canceled=F.when(gone, "yes").otherwise("no"), isl=i % 50, osl=i % 9), timing=_struct(TTFT=_struct(val=v), latency_ms=v + 1, itl_ms=_struct(value=v / 2, unit="furlong")), result_status="Failed"),
        _json(conversation_id=user, source_trace_id=F.concat(F.lit("root-"), user), source_outer_index=i, source_inner_idx=i % 2, timings=_struct(time_to_first_token_ms=v, end_to_end_latency_ms=v + 1, time_per_output_token_ms=v / 2), usage=_struct(input_token_count=i % 50, output_token_count=i % 9), cancelled=F.when(gone, 1).otherwise(0), error=_struct(type=F.concat(F.lit("Timeout\nat "), user))),
        _json(conversation_id=F.lit(None).cast("string"), trace_id=user, phase="profiling", cancelled=gone, ttft="nan", time_to_first_token=v, request_latency=metric(v, "sec"), decode_duration=metric(v * 8, "ms"), usage_prompt_tokens=i % 50, usage=_struct(prompt_cache_read_tokens=i % 4), input_tokens=i % 50, output_tokens=i % 9, accepted_tokens=i % 3, failed=F.when(i % 7 == 0, True).otherwise(False)),
        _json(worker="w5", tokens=F.array(F.lit(1), F.lit(2)), error=_struct(nothing=_struct())),
    ]
    form = forms[0]
    for k, f in enumerate(forms[1:], 1):
        form = F.when(i % 6 == k, f).otherwise(form)
    return events.select("event_id", form.alias("value"))


SPELLED_SQL = """
s AS (
  SELECT *, event_id % 6 AS k, user_id::VARCHAR AS u, floor(value * 1000)::BIGINT AS w, epoch_us(ts) * 1000 AS start_ns, event_id % 5 = 0 AS gone, event_id % 9 AS o FROM events),
spelled AS (
  SELECT event_id, CASE k WHEN 0 THEN 't' || u || '::sa:a1:fa:000' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE u END AS conversation_id,
    CASE k WHEN 3 THEN 'root-' || u WHEN 0 THEN 't' || u WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE u END AS root_trace_id, CASE WHEN k = 3 THEN event_id END AS source_outer_idx, CASE WHEN k = 3 THEN event_id % 2 END AS source_inner_idx,
    CASE k WHEN 0 THEN 'profiling' WHEN 1 THEN 'Profiling' WHEN 2 THEN 'warmup' WHEN 4 THEN 'profiling' END AS benchmark_phase, CASE WHEN k < 5 THEN gone END AS was_cancelled,
    CASE WHEN k < 2 THEN event_id % 3 END AS session_num, CASE WHEN k < 2 THEN event_id % 7 END AS turn_index, CASE WHEN k < 2 THEN start_ns END AS request_start_ns, CASE WHEN k < 2 THEN start_ns + 5 END AS request_end_ns,
    CASE k WHEN 0 THEN 'w1' WHEN 1 THEN 'w2' WHEN 5 THEN 'w5' END AS worker_id, CASE WHEN k < 5 THEN (event_id % 50)::DOUBLE END AS input_tokens, CASE WHEN k < 5 THEN o::DOUBLE END AS output_tokens,
    round(CASE WHEN k = 0 THEN value * 1000 WHEN k < 5 THEN value END, 6) AS ttft_ms, round(CASE k WHEN 0 THEN w / 1000 WHEN 4 THEN value * 1000 WHEN 5 THEN NULL ELSE value + 1 END, 6) AS e2e_ms,
    round(CASE k WHEN 0 THEN w / 1000 WHEN 4 THEN CASE WHEN o > 1 THEN value * 8 / (o - 1) END WHEN 5 THEN NULL ELSE value / 2 END, 6) AS itl_ms,
    CASE k WHEN 2 THEN true WHEN 3 THEN true WHEN 4 THEN event_id % 7 = 0 WHEN 5 THEN true ELSE false END AS error_present, CASE k WHEN 2 THEN 'failed' WHEN 3 THEN 'Timeout' WHEN 4 THEN CASE WHEN event_id % 7 = 0 THEN 'error_present' END WHEN 5 THEN 'error_present' END AS error_category,
    CASE WHEN k = 2 THEN 'Failed' END AS raw_status, CASE WHEN k = 4 THEN (event_id % 4)::DOUBLE END AS cache_read_tokens, CASE WHEN k = 4 THEN (event_id % 3)::DOUBLE END AS mtp_accepted_tokens,
    (['metrics.time_to_first_token.value', 'ttft_ms', 'timing.TTFT.val', 'timings.time_to_first_token_ms', 'time_to_first_token', NULL])[k + 1] AS raw_ttft_field,
    CASE k WHEN 0 THEN 'metrics.inter_token_latency.value' WHEN 1 THEN 'tpot_ms' WHEN 2 THEN 'timing.itl_ms.value' WHEN 3 THEN 'timings.time_per_output_token_ms' WHEN 4 THEN CASE WHEN o > 1 THEN 'derived:decode_duration.value/(output_sequence_length-1)' END END AS raw_itl_field
  FROM s)
"""


@query(f"WITH {SPELLED_SQL} SELECT * FROM spelled")
def profile_aliases(spark: SparkSession, d: str) -> DataFrame:
    p = profiles.canonical(spelled_profiles(table(spark, d, "events")))
    rounded = {c: F.round(c, 6) for c in ("ttft_ms", "e2e_ms", "itl_ms")}
    return p.withColumns(rounded).select(
        "event_id", "conversation_id", "root_trace_id", "source_outer_idx", "source_inner_idx", "benchmark_phase", "was_cancelled", "session_num", "turn_index", "request_start_ns", "request_end_ns", "worker_id", "input_tokens", "output_tokens",
        "ttft_ms", "e2e_ms", "itl_ms", "error_present", "error_category", "raw_status", "cache_read_tokens", "mtp_accepted_tokens", "raw_ttft_field", "raw_itl_field",
    )


@query(f"""
WITH {SPELLED_SQL}, r AS (
  SELECT CAST(event_id % 4 + 1 AS INTEGER) AS concurrency, CASE WHEN lower(benchmark_phase) <> 'profiling' THEN 'not_profiling_phase' WHEN error_present THEN 'error_present' WHEN was_cancelled THEN 'was_cancelled'
    WHEN input_tokens IS NULL OR output_tokens IS NULL THEN 'missing_token_count' WHEN ttft_ms <= 0 THEN 'nonpositive_ttft' WHEN e2e_ms <= 0 THEN 'nonpositive_e2e' END AS exclusion_reason FROM spelled)
SELECT concurrency, coalesce(exclusion_reason, 'profiled') AS state, count(*) AS n FROM r GROUP BY ALL""")
def built_requests(spark: SparkSession, d: str) -> DataFrame:
    """Profiles written as files of four concurrencies, built into tables, and counted from those."""
    raw, out = new_folder(spark, "profiles"), new_folder(spark, "requests")
    lines = spelled_profiles(table(spark, d, "events")).select("value", (F.col("event_id") % 4 + 1).alias("conc"))
    for c in range(1, 5):
        lines.where(F.col("conc") == c).select("value").write.text(f"{raw}/conc{c}/raw_agentic")
    build.build_requests(spark, raw, out, glob="part-*")
    every, good = (read_table(spark, f"{out}/requests_{n}.parquet") for n in ("all", "profiled"))
    bad = spark.read.option("header", True).csv(f"{out}/request_exclusions.csv").select(F.col("concurrency").cast("int").alias("concurrency"), F.col("exclusion_reason").alias("state"))
    parts = good.select("concurrency", F.lit("profiled").alias("state")).unionByName(bad).groupBy("concurrency", "state").agg(F.count("*").alias("n"))
    total = every.groupBy("concurrency").agg(F.count("*").alias("total_"))
    checked = parts.join(total, "concurrency").withColumn("sum_", F.expr("sum(n) over (partition by concurrency)"))
    return checked.select("concurrency", "state", F.when(F.col("sum_") == F.col("total_"), F.col("n")).alias("n"))


def result_files(orders: DataFrame) -> DataFrame:
    """orders as published results in three layouts, one file for each order: path and value. A file of the first layout
    holds two results in a list."""
    k, i, v = F.col("o_orderkey") % 4, F.col("o_orderkey"), F.col("o_totalprice")
    conc = i % 1000
    seconds = lambda more: _struct(mean=v / 1000 + more, p95=v / 500)
    one = lambda c, more: _struct(conc=c, model="m", num_requests_successful=i % 100, num_prefill_gpu=8, num_decode_gpu=i % 8, request_metrics=_struct(latency=_struct(ttft=seconds(more), tpot=_struct(mean=v)), tokens=_struct(input=_struct(mean=v), output_actual=_struct(mean=F.lit(2.5)))))
    nested = F.to_json(F.struct(F.lit("run").alias("name"), F.array(one(conc, F.lit(0.0)), one(conc + 1000, F.lit(1.0))).alias("results")))
    flat = _json(concurrency=conc, mean_ttft_ms=v, ttft_p95=v * 2, framework="f", total_gpus=16, output_tokens_per_second=v, request_count=i % 100, total_input_tokens=i)
    direct = _json(time_to_first_token=_struct(avg=v, p95=v * 2, unit=F.when(i % 3 == 0, "sec").otherwise("ms")), request_latency=_struct(avg=v), benchmark_duration=v)
    none = _json(note="nothing here")
    value = F.when(k == 0, nested).when(k == 1, flat).when(k == 2, direct).otherwise(none)
    return orders.select(F.concat(F.lit("/run/conc"), conc.cast("string"), F.lit("/part"), (i % 3).cast("string"), F.lit("/o"), F.col("o_custkey").cast("string"), F.lit("-"), i.cast("string"), F.lit(".json")).alias("path"), value.alias("value"), i.alias("o_orderkey"))


RESULTS_SQL = """
o AS (SELECT o_orderkey AS i, o_orderkey % 4 AS k, o_orderkey % 1000 AS conc, o_totalprice AS v, '/run/conc' || o_orderkey % 1000 || '/part' || o_orderkey % 3 || '/o' || o_custkey || '-' || o_orderkey || '.json' AS path FROM orders),
res AS (
  SELECT i, k, path, 0 AS object_no, conc, v, 0.0 AS more FROM o UNION ALL SELECT i, k, path, 1, conc + 1000, v, 1.0 FROM o WHERE k = 0),
found AS (
  SELECT i AS o_orderkey, path, CAST(object_no AS INTEGER) AS object_no, CAST(conc AS INTEGER) AS concurrency, k < 3 AS recognized,
    round(CASE k WHEN 0 THEN (v / 1000 + more) * 1000 WHEN 1 THEN v WHEN 2 THEN CASE WHEN i % 3 = 0 THEN v * 1000 ELSE v END END, 6) AS mean_ttft_ms,
    round(CASE k WHEN 0 THEN v / 500 * 1000 WHEN 1 THEN v * 2 WHEN 2 THEN CASE WHEN i % 3 = 0 THEN v * 2000 ELSE v * 2 END END, 6) AS p95_ttft_ms,
    round(CASE k WHEN 0 THEN v * 1000 END, 6) AS mean_itl_ms, round(CASE k WHEN 2 THEN v END, 6) AS mean_e2e_ms, CASE k WHEN 0 THEN (8 + i % 8)::DOUBLE WHEN 1 THEN 16 END AS gpu_count,
    CASE WHEN k < 2 THEN (i % 100)::DOUBLE END AS successful_profiled_request_count, round(CASE k WHEN 0 THEN v * (i % 100) WHEN 1 THEN i END, 4) AS total_input_tokens, CASE WHEN k = 0 THEN 'derived from request_metrics.tokens.input.mean × num_requests_successful; published mean is rounded' END AS total_input_tokens_derivation,
    CASE WHEN k = 2 THEN v END AS duration_s, CASE WHEN k = 0 THEN 'm' END AS target_model, CASE WHEN k = 1 THEN 'f' END AS framework, CASE WHEN k = 3 THEN 'no recognized aggregate metrics' END AS unparsed
  FROM res)
"""


@query(f"WITH {RESULTS_SQL} SELECT * EXCLUDE (path, recognized) FROM found")
def published_results(spark: SparkSession, d: str) -> DataFrame:
    r = pb.published_results(result_files(table(spark, d, "orders")))
    digits = {"mean_ttft_ms": 6, "p95_ttft_ms": 6, "mean_itl_ms": 6, "mean_e2e_ms": 6, "total_input_tokens": 4}
    columns = ["o_orderkey", "object_no", "concurrency", *digits, "gpu_count", "successful_profiled_request_count", "total_input_tokens_derivation", "duration_s", "target_model", "framework", "unparsed"]
    return r.withColumns({c: F.round(c, n) for c, n in digits.items()}).select(*columns)


@query(f"""
WITH {RESULTS_SQL}, g AS (
  SELECT concurrency, count(*) FILTER (recognized) AS n, count(DISTINCT path) FILTER (recognized) AS files, any_value(mean_ttft_ms) FILTER (recognized) AS v FROM found GROUP BY concurrency)
SELECT concurrency, files AS candidate_file_count, n AS candidate_object_count, CASE WHEN n = 0 THEN 'no_recognized_published_metrics' WHEN files > 1 OR n > 1 THEN 'ambiguous_published_candidates' END AS selection_status, CASE WHEN n = 1 THEN v END AS mean_ttft_ms FROM g""")
def published_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = pb.chosen(pb.published_results(result_files(table(spark, d, "orders"))))
    return c.select("concurrency", "candidate_file_count", "candidate_object_count", "selection_status", F.round("mean_ttft_ms", 6).alias("mean_ttft_ms"))


@query("""
WITH p AS (SELECT CAST(c_custkey AS INTEGER) AS c, c_acctbal AS b, c_custkey % 5 AS k FROM customer),
x AS (
  SELECT c AS concurrency, unnest(['mean_ttft_ms', 'total_output_tokens', 'target_model', 'duration_s']) AS metric, unnest([b, 10, NULL, b]) AS raw, unnest([b + k / 2, 10 + k * 0.3, NULL, CASE WHEN k < 4 THEN b * 1.03 + 0.2 END]) AS pub, k FROM p)
SELECT concurrency, metric, round(abs(raw - pub), 6) AS absolute_difference,
  CASE metric WHEN 'target_model' THEN CASE k WHEN 0 THEN 'pass' WHEN 1 THEN 'pass_alias_equivalent' ELSE 'mismatch' END WHEN 'total_output_tokens' THEN CASE WHEN k * 0.3 <= 1 THEN 'pass' ELSE 'mismatch' END
    WHEN 'mean_ttft_ms' THEN CASE WHEN k / 2 <= 1 OR k / 2 <= 0.01 * abs(b_) THEN 'pass' ELSE 'mismatch' END ELSE CASE WHEN k = 4 THEN 'not_comparable' WHEN abs(raw - pub) <= 0.1 OR abs(raw - pub) <= 0.02 * abs(pub) THEN 'pass' ELSE 'mismatch' END END AS validation_status,
  CASE metric WHEN 'target_model' THEN CASE k WHEN 1 THEN 'alias' ELSE 'label' END WHEN 'total_output_tokens' THEN 'derived' WHEN 'duration_s' THEN CASE WHEN k = 4 THEN 'absent' END END AS note
FROM (SELECT *, pub AS b_ FROM x)""")
def published_validation(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("concurrency"), F.col("c_acctbal").alias("b"), (F.col("c_custkey") % 5).alias("k"))
    raw = c.select("concurrency", F.col("b").alias("mean_ttft_ms"), F.lit(10.0).alias("total_output_tokens"), F.lit("GLM-5.2 FP8").alias("target_model"), F.col("b").alias("duration_s"))
    label = F.when(F.col("k") == 0, "glm 5.2 fp8").when(F.col("k") == 1, "zai-org/GLM-5.2-FP8").otherwise("other")
    mean = (10 + F.col("k") * 0.3) / 10
    said = _json(conc=F.col("concurrency"), mean_ttft_ms=F.col("b") + F.col("k") / 2, model=label, elapsed_time_s=F.when(F.col("k") < 4, F.col("b") * 1.03 + 0.2), num_requests_successful=10, request_metrics=_struct(tokens=_struct(output_actual=_struct(mean=mean))))
    files = c.select(F.concat(F.lit("/r/"), F.col("concurrency").cast("string")).alias("path"), said.alias("value"))
    v = pb.validated(raw, pb.chosen(pb.published_results(files))).where(F.col("metric").isin("mean_ttft_ms", "total_output_tokens", "target_model", "duration_s"))
    n = F.col("validation_note")
    note = F.when(n == pb.NOT_COMPARABLE, "absent").when(n == pb.ALIAS_NOTE, "alias").when(n == pb.LABEL_NOTE, "label").when(n.contains("rounding tolerance"), "derived")
    return v.select("concurrency", "metric", F.round("absolute_difference", 6).alias("absolute_difference"), "validation_status", note.alias("note"))


@query("""
WITH n AS (SELECT n_nationkey AS k, 'bmk-' || n_nationkey || '_x' AS name, 'id' || n_nationkey || 'z' AS id FROM nation WHERE n_nationkey % 3 <> 2),
p AS (SELECT page_id, '/a/' || CASE page_id % 4 WHEN 0 THEN 'BMK-' || page_id % 25 || '_X' WHEN 1 THEN 'in-id' || page_id % 25 || 'z' WHEN 2 THEN 'bmk-0_x/id1z' ELSE 'none' END AS path FROM pages),
m AS (SELECT page_id, count(k) AS c, any_value(id) AS id FROM p LEFT JOIN n ON contains(lower(path), lower(name)) OR contains(lower(path), id) GROUP BY page_id)
SELECT page_id, CASE c WHEN 1 THEN 'unambiguous' WHEN 0 THEN 'unmatched' ELSE 'ambiguous' END AS artifact_match_status, CASE WHEN c = 1 THEN id END AS artifact_id FROM m""")
def artifact_contexts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    art = table(spark, d, "nation").select(F.concat(F.lit("id"), n.cast("string"), F.lit("z")).alias("artifact_id"), F.concat(F.lit("bmk-"), n.cast("string"), F.lit("_x")).alias("artifact_name"), F.when(n % 3 == 0, "aggregated_agentic").when(n % 3 == 1, "run_summary").otherwise("raw_agentic").alias("category"), n.alias("concurrency"))
    i = F.col("page_id")
    k = (i % 25).cast("string")
    path = F.concat(F.lit("/a/"), F.when(i % 4 == 0, F.concat(F.lit("BMK-"), k, F.lit("_X"))).when(i % 4 == 1, F.concat(F.lit("in-id"), k, F.lit("z"))).when(i % 4 == 2, F.lit("bmk-0_x/id1z")).otherwise("none"))
    return pb.artifact_context(table(spark, d, "pages").select("page_id", path.alias("path")), art).select("page_id", "artifact_match_status", "artifact_id")
