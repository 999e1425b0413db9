"""Summaries of requests: one aggregation each, partial before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelane.functions.aggregates import distinct_with_null, exact_percentile, exact_percentiles, token_weighted_itl, wall_seconds
from tracelane.functions.coerce import ratio, truth

QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}


def measures(latencies: Sequence[str] = ("ttft_ms", "e2e_ms", "itl_ms"), zero_sums: bool = True) -> list[Column]:
    """The measures of a group of requests. zero_sums: the sum of no known value is 0, else null."""
    total = (lambda c: F.coalesce(F.sum(c), F.lit(0.0))) if zero_sums else F.sum
    out = [F.count("*").alias("n_requests"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens")]
    for c in latencies:
        out += [p.alias(f"{c.removesuffix('_ms')}_{name}_ms") for name, p in zip(QUANTILES, exact_percentiles(c, [*QUANTILES.values()]), strict=True)]
    span = wall_seconds("request_start_ns", "request_end_ns")
    return [*out, token_weighted_itl().alias("weighted_itl_ms"), span.alias("wall_s"), F.when(span > 0, ratio(F.sum("output_tokens"), span)).alias("output_tps"), (F.sum("e2e_ms") / 1000).alias("summed_wall_s")]


def summarize(df: DataFrame, keys: Sequence[str], **how) -> DataFrame:
    return df.groupBy(*keys).agg(*measures(**how))


def status_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts over all records, good or not. A null key is a group."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_records"), F.count_if(truth("error_present")).alias("n_errors"), F.count_if(truth("was_cancelled")).alias("n_cancelled"), F.count_if(F.col("exclusion_reason").isNotNull()).alias("n_excluded"))


def with_status(summary: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """summary left-joined to counts, null keys matching null keys."""
    right = counts.select(*(F.col(k).alias(f"{k}_r") for k in keys), *(c for c in counts.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_r"))
    return summary.join(right, on, "left").drop(*(f"{k}_r" for k in keys))


def quality_flag(n: str = "n_requests", sessions: str = "n_sessions", few: int = 5) -> Column:
    """Warnings about a group of n requests in so many session groups, joined by semicolons, or ok."""
    k, m = F.col(n), F.coalesce(F.col(sessions), F.lit(0))
    # flags
    flags = F.concat_ws(";", F.when(k < few, "low_request_count"), F.when(m < 1, "missing_session_num_group").when(m == 1, "single_session_num_group_unvalidated"), F.when((k > 0) & (m == k), "session_num_unique_per_profiled_row"))
    return F.when(flags == "", "ok").otherwise(flags)


def branch_counts(column: str) -> list[Column]:
    """Root, other known and unknown branches."""
    c = F.lower(F.trim(F.col(column)))
    known = c.isNotNull() & (c != "") & (c != "unknown")
    return [F.count_if(c == "root").alias("n_root"), F.count_if(known & (c != "root")).alias("n_other_branch"), F.count_if(~F.coalesce(known, F.lit(False))).alias("n_unknown_branch")]


def origin_group(column: str) -> Column:
    c = F.lower(F.trim(F.col(column)))
    return F.when(c.isNull() | c.isin("", "unknown"), "unknown").when(c == "root", "root").otherwise("subagent")


def weightings(df: DataFrame, value: str = "ttft_ms") -> DataFrame:
    """One median by four weightings, for each concurrency: each request, each root, each session, and the mean by
    output tokens. The count of the last is of rows with more than one token."""
    request = df.groupBy("concurrency").agg(F.lit("request").alias("weighting"), F.count(value).alias("sample_count"), exact_percentile(value, 0.5).alias("value"))

    def nested(name: str, keys: list[str]) -> DataFrame:
        inner = df.groupBy("concurrency", *keys).agg(exact_percentile(value, 0.5).alias("m"))
        return inner.groupBy("concurrency").agg(F.lit(name).alias("weighting"), F.count("m").alias("sample_count"), exact_percentile("m", 0.5).alias("value"))

    token = df.groupBy("concurrency").agg(F.lit("token").alias("weighting"), F.count_if(F.col("output_tokens") > 1).alias("sample_count"), token_weighted_itl().alias("value"))
    return request.unionByName(nested("root_id", ["root_trace_id"])).unionByName(nested("session_group", ["root_trace_id", "session_num"])).unionByName(token)


def session_diagnostics(df: DataFrame) -> DataFrame:
    """Whether session numbers stand for sessions, over all rows and for each concurrency (a null one kept apart)."""
    pair = F.when(F.col("session_num").isNotNull(), F.struct("concurrency", "session_num"))
    out = df.groupingSets([[], ["concurrency"]], "concurrency").agg(
        F.when(F.grouping_id() == 0, "concurrency").otherwise("all").alias("scope"), F.count("*").alias("n_rows"), F.count("session_num").alias("n_known"),
        F.count_distinct("session_num").alias("n_sessions"), F.count_distinct(pair).alias("n_concurrency_sessions"), distinct_with_null("session_num").cast("long").alias("n_with_null"),
    )
    return out.withColumns({"n_repeated_rows": F.col("n_known") - F.col("n_sessions"), "unique_rate": ratio("n_sessions", "n_known")})


def coverage_summary(df: DataFrame, universe: DataFrame, expected: Sequence[int]) -> DataFrame:
    """For each expected or present concurrency the roots seen and the share of the universe they make; null ones drop."""
    size = universe.select(F.count_distinct(universe.columns[0]).alias("n_universe"))
    conc = df.select("concurrency").where("concurrency is not null").distinct().unionByName(df.sparkSession.createDataFrame([(int(c),) for c in expected], "concurrency int")).distinct()
    known = universe.select(F.col(universe.columns[0]).alias("root_trace_id")).distinct()
    seen = df.groupBy("concurrency").agg(F.count("*").alias("n_requests"), F.count_distinct("root_trace_id").alias("n_roots"))
    inside = df.join(known, "root_trace_id", "left_semi").groupBy("concurrency").agg(F.count_distinct("root_trace_id").alias("n_known_roots"))
    out = conc.join(seen, "concurrency", "left").join(inside, "concurrency", "left").na.fill(0)
    return out.join(F.broadcast(size)).withColumn("coverage", ratio("n_known_roots", "n_universe"))  # one row


def composition(df: DataFrame, keys: Sequence[str], models: str) -> DataFrame:
    """The share of each model among the models listed in a group; a group without any keeps one row."""
    each = df.select(*keys, F.explode_outer(models).alias("model")).groupBy(*keys, "model").agg(F.count("model").alias("n"))
    each = each.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    return each.where((F.col("n") > 0) | (F.col("total") == 0)).select(*keys, F.coalesce("model", F.lit("none")).alias("model"), "n", ratio("n", "total").alias("share"))


def top_by(df: DataFrame, metrics: dict[str, bool], keys: Sequence[str], n: int) -> DataFrame:
    """The n best rows for each metric (True: largest first), nulls last, ties by keys: metric, rank, value and keys."""
    long = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("rank_metric"), F.lit(up).alias("up"), F.col(m).cast("double").alias("value")) for m, up in metrics.items()))).alias("x"))
    long = long.select(*keys, "x.*").withColumn("by_", F.when(F.col("up"), -F.col("value")).otherwise(F.col("value")))
    order = [F.col("by_").asc_nulls_last(), *(F.col(k).asc_nulls_last() for k in keys)]
    # the window keeps a heap-like limit: Spark filters each task's rows to the group limit before the shuffle
    return long.withColumn("rank", F.row_number().over(Window.partitionBy("rank_metric").orderBy(*order))).where(F.col("rank") <= n).select("rank_metric", "rank", "value", *keys)


def quantile_table(df: DataFrame, keys: Sequence[str], columns: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Exact quantiles in long form: metric, q, value."""
    agg = df.groupBy(*keys).agg(*(F.percentile(c, F.array(*map(F.lit, qs))).alias(c) for c in columns))
    stack = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.lit(float(q)).alias("q"), F.try_element_at(F.col(c), F.lit(i + 1)).alias("value")) for c in columns for i, q in enumerate(qs))))
    return agg.select(*keys, stack.alias("x")).select(*keys, "x.*")


# The upper ends of buckets and their labels.
LENGTHS = ((1, "1"), (32, "2-32"), (128, "33-128"), (512, "129-512"), (2048, "513-2048"), (None, ">2048"))
INPUTS = ((32_000, "<32k"), (64_000, "32-64k"), (128_000, "64-128k"), (192_000, "128-192k"), (256_000, "192-256k"), (None, "256k+"))
LOADS = ((4, "1-4"), (8, "5-8"), (12, "9-12"), (16, "13-16"), (24, "17-24"), (None, "25+"))


def _bucket(x: Column, ends: tuple[tuple[int | None, str], ...], below: Callable[[Column, int], Column]) -> Column:
    case = F.when(x.isNull() | F.isnan(x.cast("double")), None)
    for end, label in ends:
        case = case.otherwise(label) if end is None else case.when(below(x, end), label)
    return case


def length_bucket(c: str) -> Column:
    """Right-closed buckets of output length, 0 in the first; below 0 is none."""
    x = F.col(c)
    return F.when(x >= 0, _bucket(x, LENGTHS, lambda v, end: v <= end))


def input_bucket(c: str) -> Column:
    """Left-closed buckets of input size."""
    return _bucket(F.col(c), INPUTS, lambda v, end: v < end)


def load_bucket(c: str) -> Column:
    """Right-closed buckets of requests in flight, 0 in the first; below 0 is none."""
    x = F.col(c)
    return F.when(x >= 0, _bucket(x, LOADS, lambda v, end: v <= end))


def time_bin(at: Column | str, start: Column | str, width: int) -> Column:
    """The bin of a time, counted from start; earlier times get negative bins."""
    a, s = (F.col(c) if isinstance(c, str) else c for c in (at, start))
    return F.floor((a - s) / F.lit(width)).cast("long")


def sparse_status(n: str, least: int = 3) -> Column:
    """Whether a group has enough samples for its rate to be compared."""
    return F.when(F.coalesce(F.col(n) < least, F.lit(True)), f"suppressed_n_lt_{least}_descriptive_only").otherwise("comparative_sample_size_available")


def ratio_groups(df: DataFrame, group: str, flag: str = "comparable") -> tuple[DataFrame, DataFrame]:
    """Ratios to a baseline without the baseline's own rows: comparable ones, and confounded or unknown ones."""
    other = df.where(F.col(group) != F.col(f"baseline_{group}"))
    return other.where(F.coalesce(flag, F.lit(False))), other.where(~F.coalesce(flag, F.lit(False)))


def context_fit(df: DataFrame, evidence: str | None, limit: int) -> DataFrame:
    """Rows known to fit a context limit: none without a column of exact evidence, whatever other sizes say."""
    return df.where(F.lit(False)) if evidence is None else df.where(F.col(evidence) <= limit)


def with_all_buckets(summary: DataFrame, bucket: str, labels: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """summary with a row for every label, in order (bucket_no): a bucket without rows has count 0 and null measures."""
    listed = summary.sparkSession.createDataFrame(list(enumerate(labels)), f"bucket_no int, `{bucket}` string")
    return listed.join(summary, bucket, "left").na.fill(0, list(counts))


def cache_summary(df: DataFrame, keys: Sequence[str], prompt: str = "prompt_tokens", cached: str = "cached_tokens") -> DataFrame:
    """Cached over prompt tokens of a group, over rows that export both, and whether that is all of them."""
    ok = F.col(prompt).isNotNull() & F.col(cached).isNotNull() & (F.col(cached) >= 0) & (F.col(prompt) >= F.col(cached))
    out = df.groupBy(*keys).agg(F.count("*").alias("n_requests"), F.count_if(ok).alias("n_exported"), ratio(F.sum(F.when(ok, F.col(cached))), F.sum(F.when(ok, F.col(prompt)))).alias("cache_ratio"))
    return out.withColumn("cache_status", F.when(F.col("n_exported") == 0, "not_exported").when(F.col("n_exported") < F.col("n_requests"), "partial").otherwise("explicit"))
