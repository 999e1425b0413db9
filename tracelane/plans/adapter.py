"""The provided tables seen as request records, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelane.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """df with every double rounded, for comparing with another engine's last bits."""
    return df.select(*((F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as requests: REQUESTS_SQL says the same."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    i = F.col("event_id")
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    root = F.concat(F.lit("t"), F.col("user_id").cast("string"))
    suffix = F.element_at(F.array(*map(F.lit, ("", "::sa:agent_001", "::sa:agent_001:fa:000", "::fa:000", "::aux:000", "::sa:agent_002:wg:001_002"))), (i % 6 + 1).cast("int"))
    out = (i % 9).cast("double")
    ttft = F.when(i % 17 != 0, F.col("value"))
    itl = F.when(i % 11 != 0, F.col("value") / 2 + i % 5)
    return e.select(
        i.alias("record_ordinal"), F.lit("events").alias("source_file_path"), root.alias("root_trace_id"), (i % 4 + 1).cast("int").alias("concurrency"), F.concat(root, suffix).alias("conversation_id"),
        F.when(i % 23 != 0, F.col("user_id") % 3).alias("session_num"), (i % 7).alias("turn_index"), start.alias("request_start_ns"), (start + 1000).alias("request_ack_ns"),
        F.when(i % 31 != 0, start + F.floor(F.col("value") * 100).cast("long") * 600000000).alias("request_end_ns"),
        F.when(i % 13 == 0, None).when(F.col("event_type") == "signup", "warmup").otherwise("profiling").alias("benchmark_phase"),
        (F.col("event_type") == "error").alias("error_present"), (i % 29 == 0).alias("was_cancelled"), k.alias("input_tokens"), out.alias("output_tokens"), ttft.alias("ttft_ms"), (F.col("value") * 3 + k - 20).alias("e2e_ms"), itl.alias("itl_ms"),
        F.element_at(F.array(F.lit("root"), F.lit("fanout"), F.lit("auxiliary"), F.lit(None).cast("string")), (i % 4 + 1).cast("int")).alias("branch_type"),
        F.element_at(F.array(F.lit("root"), F.lit("subagent"), F.lit("root"), F.lit(""), F.lit(None).cast("string")), (i % 5 + 1).cast("int")).alias("source_branch_type"),
        F.col("event_type").alias("worker_id"), F.col("event_type"), F.col("user_id"), F.col("value"), F.col("props"),
    )


REQUESTS_SQL = """
r0 AS (
  SELECT event_id AS record_ordinal, 'events' AS source_file_path, 't' || user_id AS root_trace_id, CAST(event_id % 4 + 1 AS INTEGER) AS concurrency,
    't' || user_id || (['', '::sa:agent_001', '::sa:agent_001:fa:000', '::fa:000', '::aux:000', '::sa:agent_002:wg:001_002'])[event_id % 6 + 1] AS conversation_id,
    CASE WHEN event_id % 23 <> 0 THEN user_id % 3 END AS session_num, event_id % 7 AS turn_index, epoch_us(ts) * 1000 AS request_start_ns, epoch_us(ts) * 1000 + 1000 AS request_ack_ns,
    CASE WHEN event_id % 31 <> 0 THEN epoch_us(ts) * 1000 + CAST(floor(value * 100) AS BIGINT) * 600000000 END AS request_end_ns,
    CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_type = 'signup' THEN 'warmup' ELSE 'profiling' END AS benchmark_phase,
    event_type = 'error' AS error_present, event_id % 29 = 0 AS was_cancelled, CAST(props->>'k' AS DOUBLE) AS input_tokens, CAST(event_id % 9 AS DOUBLE) AS output_tokens,
    CASE WHEN event_id % 17 <> 0 THEN value END AS ttft_ms, value * 3 + CAST(props->>'k' AS DOUBLE) - 20 AS e2e_ms, CASE WHEN event_id % 11 <> 0 THEN value / 2 + event_id % 5 END AS itl_ms,
    (['root', 'fanout', 'auxiliary', NULL])[event_id % 4 + 1] AS branch_type, (['root', 'subagent', 'root', '', NULL])[event_id % 5 + 1] AS source_branch_type,
    event_type AS worker_id, event_type, user_id, value, props
  FROM events),
r AS (
  SELECT *, CASE WHEN benchmark_phase <> 'profiling' THEN 'not_profiling_phase' WHEN error_present THEN 'error_present' WHEN was_cancelled THEN 'was_cancelled'
    WHEN input_tokens IS NULL OR output_tokens IS NULL THEN 'missing_token_count' WHEN input_tokens < 0 OR output_tokens < 0 THEN 'negative_token_count'
    WHEN ttft_ms IS NULL THEN 'missing_ttft' WHEN ttft_ms <= 0 THEN 'nonpositive_ttft' WHEN e2e_ms IS NULL THEN 'missing_e2e' WHEN e2e_ms <= 0 THEN 'nonpositive_e2e' END AS exclusion_reason
  FROM r0),
p AS (SELECT * FROM r WHERE exclusion_reason IS NULL)
"""


def measures_sql(zero: bool = True) -> str:
    """The measures of rollups.measures."""
    total = (lambda c: f"coalesce(sum({c}), 0.0)") if zero else (lambda c: f"sum({c})")
    parts = ["count(*) AS n_requests", f"round({total('input_tokens')}, 8) AS input_tokens", f"round({total('output_tokens')}, 8) AS output_tokens"]
    for c in ("ttft", "e2e", "itl"):
        parts += [f"round(quantile_cont({c}_ms, {q}), 8) AS {c}_{n}_ms" for n, q in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95))]
    span = "(max(request_end_ns) - min(request_start_ns)) / 1e9"
    parts += [
        "round(sum(CASE WHEN itl_ms > 0 AND output_tokens > 1 THEN itl_ms * (output_tokens - 1) END) / nullif(sum(CASE WHEN itl_ms > 0 AND output_tokens > 1 THEN output_tokens - 1 END), 0), 8) AS weighted_itl_ms",
        f"round({span}, 8) AS wall_s", f"round(CASE WHEN {span} > 0 THEN sum(output_tokens) / ({span}) END, 8) AS output_tps", "round(sum(e2e_ms) / 1000, 8) AS summed_wall_s",
    ]
    return ", ".join(parts)


def request_sql(body: str, more: str = "") -> str:
    return f"WITH {REQUESTS_SQL}{',' + more if more else ''}\n{body}"
