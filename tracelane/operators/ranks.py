"""Gauges exported by several ranks of a worker: alignment, equality, envelopes, sums over complete grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelane.functions import text
from tracelane.functions.aggregates import correlation
from tracelane.functions.coerce import finite, number, ratio, text_or_null
from tracelane.operators.rollups import time_bin


def slices(df: DataFrame, keys: Sequence[str], rank: str, value: str, expected: int) -> DataFrame:
    """A row for each key and time slice: ranks, numeric samples, whether all expected ones are there, extremes,
    median and sum. keys name the slice too."""
    v = finite(value)
    out = df.groupBy(*keys).agg(F.count_distinct(rank).alias("n_ranks"), F.count(v).alias("n_samples"), F.min(v).alias("low"), F.percentile(v, 0.5).alias("middle"), F.max(v).alias("high"), F.sum(v).alias("total"))
    return out.withColumn("complete", (F.col("n_ranks") == expected) & (F.col("n_samples") == expected))


def deduplicated(df: DataFrame, keys: Sequence[str], rank: str, value: str, expected: int) -> DataFrame:
    """The worker's value where all ranks are there and agree, else null; slices stay."""
    return slices(df, keys, rank, value, expected).select(*keys, F.when(F.col("complete") & (F.col("low") == F.col("high")), F.col("low")).alias("value"))


def envelope(df: DataFrame, keys: Sequence[str], rank: str, value: str, expected: int) -> DataFrame:
    """Minimum, median and maximum over ranks: never a sum."""
    return slices(df, keys, rank, value, expected).select(*keys, "n_ranks", "low", "middle", "high")


def shard_sum(df: DataFrame, keys: Sequence[str], rank: str, value: str, expected: int, worker: str | None = None, approved: Sequence[str] = ()) -> DataFrame:
    """The sum over ranks of complete slices, null for others; only approved workers if any are named."""
    if worker is not None and approved:
        df = df.where(F.col(worker).isin(*approved))
    return slices(df, keys, rank, value, expected).select(*keys, F.when(F.col("complete"), F.col("total")).alias("value"), "n_ranks")


def validation(df: DataFrame, series: Sequence[str], slice_keys: Sequence[str], rank: str, value: str, expected: int) -> DataFrame:
    """For each series: slices, complete ones, those where all ranks agree, the largest spread, and a status. Rows
    whose slice has a null key count for the number of ranks only."""
    each = slices(df, [*series, *slice_keys], rank, value, expected)
    known = F.lit(True)
    for k in slice_keys:
        known = known & F.col(k).isNotNull()
    each = each.withColumn("complete", F.col("complete") & known) if slice_keys else each
    equal = F.col("complete") & (F.col("low") == F.col("high"))
    out = each.groupBy(*series).agg(F.count_if(known).alias("n_slices"), F.count_if("complete").alias("n_complete"), F.count_if(equal).alias("n_equal"), F.max(F.when(F.col("complete"), F.col("high") - F.col("low"))).alias("max_spread"), F.max("n_ranks").alias("most_ranks"))
    # statuses
    status = F.when(F.col("most_ranks") != expected, "rank_count_mismatch").when(F.col("n_slices") == 0, "no_timeslices").when(F.col("n_complete") == F.col("n_slices"), "exact_all_rank_timestamp_alignment").otherwise("partial_rank_timestamp_alignment")
    return out.withColumns({"equal_ratio": ratio("n_equal", "n_complete"), "status": status})


def rank_pairs(df: DataFrame, series: Sequence[str], slice_keys: Sequence[str], rank: str, value: str) -> DataFrame:
    """For each series and pair of ranks (numeric ranks by number): common slices, exact matches and correlation. A
    slice has one row for each rank, so pairs grow with the number of ranks only."""
    base = df.select(*series, *slice_keys, F.col(rank).cast("string").alias("rank_"), finite(value).alias("v_")).withColumn("no_", F.struct(F.coalesce(F.col("rank_").try_cast("long"), F.lit(2**62)).alias("n"), F.col("rank_").alias("t")))
    a, b = base.alias("a"), base.alias("b")
    on = F.col("a.no_") < F.col("b.no_")
    for k in (*series, *slice_keys):
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    joined = a.join(b, on).select(*(F.col(f"a.{k}").alias(k) for k in series), F.col("a.rank_").alias("rank_left"), F.col("b.rank_").alias("rank_right"), F.col("a.v_").alias("x"), F.col("b.v_").alias("y"))
    return joined.groupBy(*series, "rank_left", "rank_right").agg(F.count("*").alias("n_common"), ratio(F.count_if(F.col("x") == F.col("y")) * 100, F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull())).alias("match_percent"), correlation("x", "y").alias("r"))


def pairs_json(pairs: DataFrame, series: Sequence[str], value: str) -> DataFrame:
    """The pairs' values of each series as one JSON object; a series has as many entries as it has pairs of ranks."""
    entry = F.struct(F.concat_ws("-", "rank_left", "rank_right").alias("key"), F.col(value).alias("value"))
    return pairs.groupBy(*series).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias(f"{value}_json"))


def missing_by_rank(df: DataFrame, series: Sequence[str], slice_keys: Sequence[str], rank: str, value: str) -> DataFrame:
    """For each series and rank the slices that other ranks have and it lacks."""
    all_ = df.select(*series, *slice_keys).distinct().groupBy(*series).agg(F.count("*").alias("n_all"))
    own = df.where(finite(value).isNotNull()).groupBy(*series, rank).agg(F.count_distinct(F.struct(*slice_keys)).alias("n_own"))
    return own.join(all_, list(series)).select(*series, rank, (F.col("n_all") - F.col("n_own")).alias("n_missing"))


# Verdicts on rank gauges and how sure each is.
DUPLICATE, LIKELY, UNRESOLVED = "validated_duplicate_worker_gauge", "likely_duplicate_worker_gauge", "unresolved"
CERTAINTY = {DUPLICATE: "Validated reconstruction", LIKELY: "Strong inference", UNRESOLVED: "Unknown"}


def duplicate_verdict(semantic: Column, equal: Column) -> Column:
    """Whether rank gauges repeat one worker's value: validated only if that is what they mean and all ranks agree;
    agreement alone makes it likely, anything else (also null) leaves it open."""
    return F.when(semantic & equal, DUPLICATE).when(equal, LIKELY).otherwise(UNRESOLVED)


def worker_verdicts(checks: DataFrame, worker: str, metric: str, required: Sequence[str], expected: int, semantic: Column | bool) -> DataFrame:
    """For each worker of checks (validation by worker and metric): rank_equality_validated, verdict, status and
    evidence. Every required metric must be there, from the expected ranks, complete in all slices and equal in all."""
    one = lambda c: F.abs(F.col(c) - 1) <= 1e-12
    c = checks.withColumns({"complete_ratio_": ratio("n_complete", "n_slices"), "equal_ratio_": ratio("n_equal", "n_complete")})
    good = F.coalesce((F.col("most_ranks") == expected) & one("complete_ratio_") & one("equal_ratio_"), F.lit(False))
    shown = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("None"))
    said = F.concat(F.col(metric), F.lit(": ranks="), shown("most_ranks"), F.lit(f"/{expected}; complete="), shown("complete_ratio_"), F.lit("; exact="), shown("equal_ratio_"))
    by_metric = c.groupBy(worker).agg(F.map_from_entries(F.collect_list(F.when(F.col(metric).isin(*required), F.struct(F.col(metric), F.struct(good.alias("good"), said.alias("said")))))).alias("m_"))
    found = [F.try_element_at("m_", F.lit(m)) for m in required]
    equal = F.lit(True)
    for f in found:
        equal = equal & F.coalesce(f["good"], F.lit(False))
    evidence = F.concat_ws(" | ", *(F.coalesce(f["said"], F.lit(f"missing:{m}")) for m, f in zip(required, found, strict=True)))
    verified = semantic if isinstance(semantic, Column) else F.lit(semantic)
    out = by_metric.withColumns({"required_metrics": F.lit(";".join(required)), "source_semantics_verified": verified, "rank_equality_validated": equal, "verdict": duplicate_verdict(verified, equal), "evidence": evidence}).drop("m_")
    status = F.lit(None).cast("string")
    for verdict, sure in CERTAINTY.items():
        status = F.when(F.col("verdict") == verdict, sure).otherwise(status)
    return out.withColumn("status", status)


def metric_inventory(rows: DataFrame, wanted: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Selected metrics of a ragged metrics CSV (see files.ragged_csv) with component, worker, rank, meaning, unit and
    statistics. A histogram's row has its labels and statistics elsewhere than the header says, so both stay null and
    its component says so. columns: what the file calls metric, type, description, unit, endpoint, component,
    worker_type, worker and each of avg, min, max, p50, p90, p95, dp_rank, tp_rank, pp_rank; absent ones are null."""
    at = lambda n: F.col(columns[n]) if n in columns else F.lit(None).cast("string")
    histogram = F.lower(F.coalesce(at("type"), F.lit(""))) == "histogram"
    unless = lambda c: F.when(~histogram, c)
    stats = {n: unless(finite(number(at(n)))) for n in ("avg", "min", "max", "p50", "p90", "p95")}
    picked = rows.where(at("metric").isin(*wanted))
    return picked.select(
        F.when(histogram, text.HISTOGRAM_COMPONENT).otherwise(text.metric_component(at("component"), at("worker_type"), at("metric"))).alias("component"),
        unless(F.coalesce(text_or_null(at("worker")), text_or_null(at("endpoint")))).alias("worker"), unless(text.rank_names(dp_rank=at("dp_rank"), tp_rank=at("tp_rank"), pp_rank=at("pp_rank"))).alias("rank"),
        *([F.col("line_no")] if "line_no" in rows.columns else []), at("metric").alias("metric"), F.when(histogram, text.HISTOGRAM_SCOPE).otherwise(text.metric_meaning(at("metric"), at("description"))).alias("meaning"),
        text_or_null(at("unit")).alias("unit"), *(c.alias(n) for n, c in stats.items()),
    )


def binned(df: DataFrame, keys: Sequence[str], at: str, start: int, width: int, value: str) -> DataFrame:
    """Mean and count for each bin that has samples; none is filled."""
    return df.groupBy(*keys, time_bin(at, F.lit(start), width).alias("bin")).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n_samples"))


def downsampled(df: DataFrame, keys: Sequence[str], at: str, start: int, width: int, value: str) -> DataFrame:
    return df.groupBy(*keys, time_bin(at, F.lit(start), width).alias("bin")).agg(F.min(value).alias("low"), F.percentile(value, 0.5).alias("middle"), F.max(value).alias("high"))


def crosscheck(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two binned series by bin: common bins, equal values, disagreements about being zero, and differences."""
    x = a.select(*keys, "bin", F.col("mean_value").alias("x"))
    y = b.select(*keys, "bin", F.col("mean_value").alias("y"))
    both = x.join(y, [*keys, "bin"])
    gap = F.abs(F.col("x") - F.col("y"))
    return both.groupBy(*keys).agg(
        F.count("*").alias("n_common"), F.count_if((F.col("x") > 0) & (F.col("y") == 0)).alias("n_only_x"), F.count_if((F.col("y") > 0) & (F.col("x") == 0)).alias("n_only_y"),
        ratio(F.count_if(F.col("x") == F.col("y")), F.count("*")).alias("same_fraction"), F.percentile(gap, 0.5).alias("gap_p50"), F.percentile(gap, 0.95).alias("gap_p95"), F.max(gap).alias("gap_max"),
    )


def worker_sum(df: DataFrame, workers: Sequence[str], keys: Sequence[str], worker: str, value: str) -> DataFrame:
    """The sum over named workers for slices in which each has exactly one value, else null."""
    per = [F.count_if((F.col(worker) == w) & F.col(value).isNotNull()) == 1 for w in workers]
    ok = per[0]
    for p in per[1:]:
        ok = ok & p
    return df.where(F.col(worker).isin(*workers)).groupBy(*keys).agg(F.when(ok, F.sum(value)).alias("cluster_value"), ok.alias("complete"))


def guarded_sum(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, allowed: bool) -> DataFrame:
    """The sum of two stages by key, only if the caller states that they may be added; else null with a reason."""
    if not allowed:
        return a.select(*keys, F.lit(None).cast("double").alias("stage_sum"), F.lit("Unknown").alias("status"))
    right = b.select(*keys, F.col(value).alias("v_"))
    return a.join(right, list(keys)).select(*keys, (F.col(value) + F.col("v_")).cast("double").alias("stage_sum"), F.lit("summed").alias("status"))


def field_variants(df: DataFrame, keys: Sequence[str], rank: str, fields: Sequence[str], expected: int) -> DataFrame:
    """Shard sums by each exported field (avg, last, max): a field that is absent has no value, and no other stands in."""
    long = df.select(*keys, rank, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), (F.col(f) if f in df.columns else F.lit(None)).cast("double").alias("v")) for f in fields))).alias("x"))
    flat = long.select(*keys, rank, "x.*")
    out = shard_sum(flat, [*keys, "field"], rank, "v", expected)
    return out.withColumn("status", F.when(F.col("value").isNull(), "Unavailable").otherwise("complete"))


def across_ranks(df: DataFrame, series: Sequence[str], rank: str, value: str) -> DataFrame:
    """Statistics of each rank, then their minimum, median and maximum over ranks: ranks are never added up."""
    each = df.groupBy(*series, rank).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.95).alias("p95"), F.max(value).alias("max"))
    out = [f(F.col(s)).alias(f"{s}_{name}") for s in ("mean", "p95", "max") for name, f in (("low", F.min), ("middle", lambda c: F.percentile(c, 0.5)), ("high", F.max))]
    return each.groupBy(*series).agg(F.count("*").alias("n_ranks"), F.sum("n").alias("n_samples"), *out)


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("r_ = 1").drop("r_")
