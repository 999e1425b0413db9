"""Request records: the profiling filter, derived metrics, ordinals, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelane.functions.coerce import as_column, finite, ratio
from tracelane.functions.ids import joined_key

# The columns of the canonical request that operators read.
REQUEST = {
    "record_ordinal": T.LongType(), "source_file_path": T.StringType(), "artifact_id": T.StringType(), "github_run_id": T.StringType(),
    "concurrency": T.IntegerType(), "conversation_id": T.StringType(), "root_trace_id": T.StringType(), "session_num": T.LongType(), "turn_index": T.LongType(),
    "request_start_ns": T.LongType(), "request_ack_ns": T.LongType(), "request_end_ns": T.LongType(), "benchmark_phase": T.StringType(), "error_present": T.BooleanType(),
    "was_cancelled": T.BooleanType(), "input_tokens": T.DoubleType(), "output_tokens": T.DoubleType(), "ttft_ms": T.DoubleType(), "e2e_ms": T.DoubleType(), "itl_ms": T.DoubleType(),
    "branch_type": T.StringType(), "source_branch_type": T.StringType(), "worker_id": T.StringType(),
}
#: Columns that tell where a record was read, not what it says.
ORIGIN = ("record_ordinal", "source_file_path", "is_exact_duplicate", "exclusion_reason")
# The parts of a request's identity.
IDENTITY = ("github_run_id", "concurrency", "artifact_id", "session_num", "conversation_id", "turn_index", "request_start_ns", "record_ordinal")
PROFILING = "profiling"


def ensure_columns(df: DataFrame, columns: dict[str, T.DataType] | None = None) -> DataFrame:
    """df with every missing column added as null; names are compared as Spark does."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({n: F.lit(None).cast(t) for n, t in (columns or REQUEST).items() if n.lower() not in have})


def exclusion_reason(require_phase: bool = False, require_itl: bool = False, duplicate: Column | None = None) -> Column:
    """Why a record is not a profiled request: the first of the reasons that holds, null for a good record."""
    phase = F.lower(F.trim("benchmark_phase"))
    out, ttft, e2e, itl = (finite(c) for c in ("output_tokens", "ttft_ms", "e2e_ms", "itl_ms"))
    inp = finite("input_tokens")
    checks: list[tuple[Column, str]] = [(phase.isNull(), "missing_benchmark_phase")] if require_phase else []
    checks += [
        (phase.isNotNull() & (phase != PROFILING), "not_profiling_phase"),
        (F.col("error_present"), "error_present"),
        (F.col("was_cancelled"), "was_cancelled"),
        (inp.isNull() | out.isNull(), "missing_token_count"),
        ((inp < 0) | (out < 0), "negative_token_count"),
        (ttft.isNull(), "missing_ttft"),
        (ttft <= 0, "nonpositive_ttft"),
        (e2e.isNull(), "missing_e2e"),
        (e2e <= 0, "nonpositive_e2e"),
    ]
    if require_itl:
        checks.append(((out > 1) & (itl.isNull() | (itl <= 0)), "missing_itl"))
    if duplicate is not None:
        checks.append((duplicate, "exact_duplicate"))
    case = F.when(*checks[0][:1], checks[0][1])
    for test, name in checks[1:]:
        case = case.when(test, name)
    return case


def with_reasons(df: DataFrame, require_phase: bool = False, require_itl: bool = False, exclude_duplicates: bool = False) -> DataFrame:
    """df with exclusion_reason; included rows are those without one, so both halves come from one scan."""
    df = ensure_columns(df)
    if exclude_duplicates:
        df = mark_duplicates(df)
        return df.withColumn("exclusion_reason", exclusion_reason(require_phase, require_itl, F.col("is_exact_duplicate")))
    return df.withColumn("exclusion_reason", exclusion_reason(require_phase, require_itl))


def profiled(df: DataFrame, **how) -> DataFrame:
    return with_reasons(df, **how).where(F.col("exclusion_reason").isNull()).drop("exclusion_reason")


def excluded(df: DataFrame, **how) -> DataFrame:
    return with_reasons(df, **how).where(F.col("exclusion_reason").isNotNull())


def mark_duplicates(df: DataFrame, order: str = "record_ordinal", parts: int | None = None) -> DataFrame:
    """df with is_exact_duplicate: another row, earlier in order, says the same in all columns but the origin's.

    Rows meet by a hash of what they say and are compared in full, so wide rows are not sorted as a whole. parts: how
    many partitions they meet in, for a caller that knows how much there is; Spark's number by default.
    """
    said = [c for c in df.columns if c not in ORIGIN and not c.startswith("raw_")]
    df = df.withColumn("said_", F.xxhash64(*said))
    df = df.repartition(parts, "said_") if parts else df
    w = Window.partitionBy("said_", *said).orderBy(F.col(order).asc_nulls_last())
    return df.withColumn("is_exact_duplicate", F.row_number().over(w) > 1).drop("said_")


def with_fingerprint(df: DataFrame) -> DataFrame:
    """df with the SHA-256 of what a row says and whether an earlier row, of any batch, has the same."""
    said = sorted(c for c in df.columns if c not in ORIGIN and not c.startswith("raw_"))
    df = df.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*said), {"ignoreNullFields": "false"}), 256))
    return df.withColumn("seen_before", F.row_number().over(Window.partitionBy("fingerprint").orderBy("record_ordinal")) > 1)


def add_identity(df: DataFrame, name: str = "request_identity") -> DataFrame:
    return df.withColumn(name, joined_key(*IDENTITY))


def add_metrics(df: DataFrame) -> DataFrame:
    """df with seconds, time after the first token and token rates; null wherever a part is missing."""
    after = F.when(F.col("e2e_ms").isNotNull() & F.col("ttft_ms").isNotNull(), F.greatest(F.col("e2e_ms") - F.col("ttft_ms"), F.lit(0.0)))
    df = df.withColumns({"ttft_s": F.col("ttft_ms") / 1000, "e2e_s": F.col("e2e_ms") / 1000, "itl_s": F.col("itl_ms") / 1000, "post_ttft_ms": after, "ttft_exceeds_e2e": F.col("ttft_ms") > F.col("e2e_ms")})
    many = F.col("output_tokens") > 1
    return df.withColumns({
        "itl_tps": F.when(many & (F.col("itl_ms") > 0), ratio(F.lit(1000.0), "itl_ms")),
        "post_ttft_tps": F.when(many, ratio((F.col("output_tokens") - 1) * 1000, "post_ttft_ms")),
        "e2e_tps": ratio(F.col("output_tokens") * 1000, "e2e_ms"),
        "input_per_ttft_s": ratio(F.col("input_tokens") * 1000, "ttft_ms"),
    })


def decode_itl(decode_ms: Column | str, output: Column | str, itl: Column | str) -> Column:
    """The exported inter-token latency, else decode time over the tokens after the first."""
    o = as_column(output)
    return F.coalesce(finite(itl), F.when(o > 1, ratio(decode_ms, o - 1)))


def cache_metrics(df: DataFrame, prompt: str = "prompt_tokens", cached: str = "cached_tokens") -> DataFrame:
    """df with new_prompt_tokens (prompt less cached where the prompt holds as many) and cached_ratio."""
    p, c = finite(prompt), finite(cached)
    ok = (c >= 0) & (p >= c)
    return df.withColumns({"new_prompt_tokens": F.when(ok, p - c), "cached_ratio": F.when(ok, ratio(c, p)), "cache_status": F.when(c.isNull(), "not_exported").when(ok, "explicit").otherwise("unvalidated")})


def acceptance(accepted: Column | str, drafted: Column | str) -> Column:
    """Accepted over drafted tokens where 0 <= accepted <= drafted."""
    a, d = finite(accepted), finite(drafted)
    return F.when((a >= 0) & (a <= d), ratio(a, d))


def metric_status(c: Column | str, valid: Column) -> Column:
    return F.when(as_column(c).isNull(), "not_exported").when(valid, "explicit").otherwise("unvalidated")


ORDER = ("request_start_ns", "request_ack_ns", "source_file_path", "record_ordinal")


def add_ordinals(df: DataFrame, keep: Column | None = None) -> DataFrame:
    """df with each row's place, from 0, in its concurrency, its root and its branch, by time with nulls last;
    keep: rows that count (profiled ones), others get null."""
    order = [F.col(c).asc_nulls_last() for c in ORDER]
    counts = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    path = F.coalesce("source_conversation_path", F.lit("<unknown>")) if "source_conversation_path" in df.columns else F.lit("<unknown>")
    keys = {"ordinal_in_concurrency": ["concurrency"], "ordinal_in_root": ["concurrency", "root_trace_id"], "ordinal_in_branch": ["concurrency", "root_trace_id", path]}
    return df.withColumns({n: F.when(counts, F.row_number().over(Window.partitionBy(*k, counts).orderBy(*order)) - 1) for n, k in keys.items()})


def chronological(df: DataFrame) -> DataFrame:
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in ORDER if c in df.columns))
