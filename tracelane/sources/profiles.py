"""Raw request profiles (nested JSON lines) to canonical requests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracelane.functions.coerce import SOME_ERROR, duration_ms, epoch_ns, error_category, error_present, finite, number, text_or_null, truth, whole
from tracelane.functions.ids import branch_class, branch_path, path_concurrency, root_id, root_rule
from tracelane.operators.aliases import resolved
from tracelane.operators.requests import decode_itl
from tracelane.sources.lines import good_records, numbered

# The names under which a record may have each field, the first one that fits decides.
TEXTS = {
    "conversation_id": ("conversation_id", "conversationid", "trace_id", "traceid"),
    "source_trace_id": ("source_trace_id", "source_traceid", "source_root_trace_id"),
    "benchmark_phase": ("benchmark_phase", "phase", "request_phase", "benchmarkphase"),
    "worker_id": ("worker_id", "worker", "server_id", "replica_id"),
    "correlation_id": ("x_correlation_id", "correlation_id", "request_correlation_id"),
    "raw_status": ("status", "request_status", "result_status"),
    "x_request_id": ("x_request_id",),
}
LONGS = {
    "source_outer_idx": ("source_outer_idx", "source_outer_index", "source_request_outer_index"),
    "source_inner_idx": ("source_inner_idx", "source_inner_index", "source_request_inner_index"),
    "session_num": ("session_num", "session", "session_id", "replay_session"),
    "turn_index": ("turn_index", "turn", "request_index", "request_num", "request_number"),
}
TIMES = {
    "request_start_ns": ("request_start_ns", "request_start_time_ns", "start_ns", "start_time_ns"),
    "request_ack_ns": ("request_ack_ns", "request_ack_time_ns", "ack_ns", "ack_time_ns"),
    "request_end_ns": ("request_end_ns", "request_end_time_ns", "end_ns", "end_time_ns"),
    "cancellation_time_ns": ("cancellation_time_ns", "cancel_time_ns", "cancelled_at_ns"),
}
NUMBERS = {
    "input_tokens": ("input_sequence_length", "input_tokens", "input_token_count", "isl", "prompt_tokens"),
    "output_tokens": ("output_sequence_length", "output_tokens", "output_token_count", "osl", "completion_tokens"),
    "theoretical_prefix_cache_hit": ("theoretical_prefix_cache_hit", "prefix_cache_hit", "cache_hit_rate"),
}
DURATIONS = {
    "ttft_ms": ("ttft_ms", "time_to_first_token_ms", "time_to_first_token", "ttft"),
    "e2e_ms": ("e2e_ms", "request_latency_ms", "request_latency", "end_to_end_latency_ms", "end_to_end_latency", "latency_ms"),
    "itl_ms": ("itl_ms", "inter_token_latency_ms", "inter_token_latency", "tpot_ms", "time_per_output_token_ms"),
}
CANCELLED = ("was_cancelled", "cancelled", "is_cancelled", "canceled", "is_canceled")
ERROR = ("error", "error_message", "exception", "failure", "failed")
# Names of the fields of the second study. An input sequence length is no logical prompt length there.
EXTRA_NUMBERS = {
    "logical_prompt_tokens": ("logical_prompt_tokens", "logical_prompt_token_count", "dynamo_frontend_input_sequence_tokens"),
    "usage_prompt_tokens": ("usage_prompt_tokens",),
    "cache_read_tokens": ("usage_prompt_cache_read_tokens", "usage.prompt_cache_read_tokens", "prompt_cache_read_tokens", "cache_read_tokens", "cached_tokens", "cache_hit_tokens", "logical_kv_load_tokens"),
    "cache_write_tokens": ("cache_write_tokens", "cache_creation_input_tokens", "prompt_cache_write_tokens", "store_tokens", "kv_store_tokens"),
    "mtp_draft_tokens": ("mtp_draft_tokens", "draft_tokens", "speculative_draft_tokens", "num_draft_tokens"),
    "mtp_accepted_tokens": ("mtp_accepted_tokens", "accepted_tokens", "speculative_accepted_tokens", "num_accepted_tokens"),
    "mtp_acceptance_length": ("mtp_acceptance_length", "acceptance_length", "accepted_length", "speculative_acceptance_length"),
    "mtp_acceptance_rate": ("mtp_acceptance_rate", "acceptance_rate", "speculative_acceptance_rate"),
}
EXTRA_DURATIONS = {"decode_duration_ms": ("decode_duration",), "full_decode_duration_ms": ("full_decode_duration",)}
EXTRA_LENGTHS = {"input_sequence_length": NUMBERS["input_tokens"][:-1], "output_sequence_length": NUMBERS["output_tokens"][:-1]}
GLOB = "profile_export*.jsonl"
#: What a record doesn't say itself: where it was read and what the run was.
CONTEXT = {"github_run_id": "string", "artifact_id": "string", "artifact_name": "string", "concurrency": "int", "target_model": "string", "target_precision": "string", "target_hardware": "string", "target_gpu_count": "bigint", "framework": "string"}


def canonical(records: DataFrame, json_text: str = "value", extended: bool = True) -> DataFrame:
    """Canonical requests from JSON objects, one in each row, whatever names the exporter gave their fields.

    Every column of CONTEXT is there, null where records has none. raw_<field>_field is the path that a latency came
    from. extended: the second study's fields too, each with its path, and the inter-token latency from the decode
    duration where the record has none. No record is dropped and no missing value is filled.
    """
    fields = {**TEXTS, **LONGS, **TIMES, **NUMBERS, **DURATIONS, "was_cancelled": CANCELLED, "error": ERROR}
    fields |= {**EXTRA_NUMBERS, **EXTRA_DURATIONS, **EXTRA_LENGTHS} if extended else {}
    own = [c for c in records.columns if c not in (json_text, "record")]
    timed = {*DURATIONS, *EXTRA_DURATIONS}
    placed = {*timed, *TIMES, "raw_status", *EXTRA_NUMBERS, *EXTRA_LENGTHS}
    read = {f: ("value", *["path"] * (f in placed), *["unit"] * (f in timed), *["kind"] * (f == "error")) for f in fields}
    out = resolved(records, json_text, fields, objects=("error",), keep=own, parts=read)
    value, path, unit = (lambda f, part=part: F.col(f"found.{f}.{part}") for part in ("value", "path", "unit"))
    duration = lambda f: duration_ms(value(f), unit(f), path(f))
    made: dict[str, Column] = {c: F.lit(None).cast(t) for c, t in CONTEXT.items() if c not in own}
    made |= {c: text_or_null(value(c)) for c in TEXTS} | {c: whole(value(c)) for c in LONGS} | {c: epoch_ns(value(c), path=path(c)) for c in TIMES}
    made |= {c: number(value(c)) for c in NUMBERS} | {c: duration(c) for c in DURATIONS} | {f"raw_{c.removesuffix('_ms')}_field": path(c) for c in DURATIONS}
    said = F.col("found.error.kind").isin("boolean", "number")
    error, status = F.when(~said, value("error")), text_or_null(value("raw_status"))
    flagged = said & F.coalesce(truth(value("error")), F.lit(False))
    exported = value("itl_ms").isNotNull()
    made |= {
        "was_cancelled": truth(value("was_cancelled")), "error_present": F.coalesce(error_present(error, status), F.lit(False)) | flagged,
        "error_category": F.coalesce(error_category(error, status), F.when(flagged, F.coalesce(F.lower(status), F.lit(SOME_ERROR)))),
        "source_metric_name": F.when(exported, "inter_token_latency"), "itl_interpretation": F.when(exported, "request-level ITL/TPOT metric"),
    }
    out = out.withColumns(made)
    if extended:
        more = {c: number(value(c)) for c in EXTRA_NUMBERS} | {c: duration(c) for c in EXTRA_DURATIONS} | {"status": status, "raw_status_field": path("raw_status")}
        more |= {f"raw_{c}_field": path(c) for c in (*EXTRA_NUMBERS, *EXTRA_DURATIONS, *EXTRA_LENGTHS)}
        more |= {"input_sequence_length": F.col("input_tokens"), "output_sequence_length": F.col("output_tokens"), "prompt_tokens": number(value("usage_prompt_tokens")), "cached_tokens": number(value("cache_read_tokens")), "decode_ms": duration("decode_duration_ms")}
        out = out.withColumns(more)
        derived = decode_itl("decode_duration_ms", "output_tokens", "itl_ms")
        by_decode = finite("itl_ms").isNull() & derived.isNotNull()
        out = out.withColumns({
            "raw_itl_field": F.when(by_decode, F.concat(F.lit("derived:"), "raw_decode_duration_ms_field", F.lit("/(output_sequence_length-1)"))).otherwise(F.col("raw_itl_field")),
            "source_metric_name": F.when(by_decode, "decode_duration").otherwise(F.col("source_metric_name")),
            "itl_interpretation": F.when(by_decode, "request-level ITL derived from decode_duration/(output_sequence_length-1)").otherwise(F.col("itl_interpretation")),
            "itl_ms": derived,
        })
    given = F.col("source_trace_id").isNotNull()
    out = out.withColumns({
        "root_trace_id": F.coalesce("source_trace_id", root_id("conversation_id")), "branch_type": branch_class("conversation_id"), "request_path": branch_path("conversation_id"),
        "root_trace_id_provenance": F.when(given, "metadata.source_trace_id").otherwise("conversation_id_normalization"),
        "normalization_rule": F.when(given, "explicit_metadata_source_trace_id").otherwise(root_rule("conversation_id")),
    })
    return out.drop("found")


def read_profiles(spark: SparkSession, path: str, artifacts: DataFrame | None = None, environment: Mapping[str, object] | None = None, extended: bool = True, glob: str = GLOB, bad: Observation | None = None) -> DataFrame:
    """All profile_export.jsonl (or files of another name pattern) below a path as canonical requests, with file and line number.

    artifacts (artifact_id, artifact_name, concurrency): the run's inventory; a file's artifact is found by its path.
    Without one, and where it leaves the concurrency open, that of the path counts. environment: values for columns of
    CONTEXT. Lines that are no JSON objects are left out and, with bad, counted; lines.issues gives them.
    """
    from tracelane.operators.reconcile import profile_context

    lines = numbered(spark, path, recursive=True, glob=glob)
    records = good_records(lines, bad).withColumnsRenamed({"file_path": "source_file_path", "line_no": "record_ordinal"})
    known = path_concurrency("source_file_path")
    if artifacts is not None:
        files = records.select("source_file_path").distinct()
        inventory = artifacts.select("artifact_id", "artifact_name", F.col("concurrency").cast("int").alias("concurrency"))
        context = profile_context(files, inventory, "source_file_path").select("source_file_path", "artifact_id").join(inventory.dropDuplicates(["artifact_id"]), "artifact_id", "left")
        records = records.join(context, "source_file_path", "left")
        known = F.coalesce("concurrency", known)
    records = records.withColumn("concurrency", known)
    records = records.withColumns({c: F.lit(v).cast(CONTEXT[c]) for c, v in (environment or {}).items()})
    return canonical(records, extended=extended)
