"""Requests in flight over time, and overlaps of interval series. Intervals are [start, end) in nanoseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelane.functions.aggregates import weighted_fraction, weighted_mean, weighted_quantiles

GROUPS = ("root", "subagent", "unknown")


def invalid_reason(start: str = "request_start_ns", end: str = "request_end_ns") -> Column:
    s, e = F.col(start), F.col(end)
    # reasons
    return F.when(s.isNull(), "missing_request_start_ns").when(e.isNull(), "missing_request_end_ns").when(e <= s, "nonpositive_request_interval")


def branch_group(c: str) -> Column:
    x = F.lower(F.trim(F.col(c)))
    return F.when(x.isNull() | (x == ""), "unknown").when(x == "root", "root").otherwise("subagent")


def changes(df: DataFrame, keys: Sequence[str], start: str = "request_start_ns", end: str = "request_end_ns", branch: str = "source_branch_type") -> DataFrame:
    """Net changes by key and time: ends take effect before starts at the same time, so only sums matter here."""
    ok = df.where(invalid_reason(start, end).isNull()).withColumn("g_", branch_group(branch))
    points = ok.select(*keys, "g_", F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("x"))
    per = [F.coalesce(F.sum(F.when(F.col("g_") == g, F.col("x.d"))), F.lit(0)).alias(f"d_{g}") for g in GROUPS]
    return points.groupBy(*keys, F.col("x.at").alias("at_ns")).agg(F.sum("x.d").alias("d_total"), F.count_if(F.col("x.d") > 0).alias("n_started"), F.count_if(F.col("x.d") < 0).alias("n_ended"), *per)


def states(df: DataFrame, keys: Sequence[str], chunk_ns: int | None = None, **columns) -> DataFrame:
    """The numbers in flight (total, root, subagent, unknown) from each time to the next change.

    chunk_ns splits long series: counts run within chunks of time and each chunk adds the changes of all earlier
    ones, so one key, however long, isn't one task.
    """
    ch = changes(df, keys, **columns)
    sums = {"in_flight": "d_total", **{f"in_flight_{g}": f"d_{g}" for g in GROUPS}}
    if chunk_ns is None:
        w = Window.partitionBy(*keys).orderBy("at_ns")
        out = ch.withColumns({n: F.sum(d).over(w) for n, d in sums.items()}).withColumn("until_ns", F.lead("at_ns").over(w))
        return out
    ch = ch.withColumn("chunk_", F.floor(F.col("at_ns") / chunk_ns))
    firsts = ch.groupBy(*keys, "chunk_").agg(F.min("at_ns").alias("first_"), *(F.sum(d).alias(f"all_{d}") for d in sums.values()))
    over = Window.partitionBy(*keys).orderBy("chunk_")
    firsts = firsts.withColumns({f"before_{d}": F.sum(f"all_{d}").over(over) - F.col(f"all_{d}") for d in sums.values()} | {"next_": F.lead("first_").over(over)})
    w = Window.partitionBy(*keys, "chunk_").orderBy("at_ns")
    out = ch.join(firsts, [*keys, "chunk_"]).withColumns({n: F.sum(d).over(w) + F.col(f"before_{d}") for n, d in sums.items()})
    out = out.withColumn("until_ns", F.coalesce(F.lead("at_ns").over(w), "next_"))
    return out.select(*ch.drop("chunk_").columns, *sums, "until_ns")


def state_intervals(df: DataFrame, keys: Sequence[str], **how) -> DataFrame:
    return states(df, keys, **how).where("until_ns is not null").withColumn("duration_ns", F.col("until_ns") - F.col("at_ns"))


def contexts(df: DataFrame, keys: Sequence[str], row_key: str, start: str = "request_start_ns", end: str = "request_end_ns", **columns) -> DataFrame:
    """Each valid request with the load before it starts (after all ends and before any start at that time), once all
    starts of that time have taken effect, and before and after its own end (ends of one time go by row key)."""
    st = states(df, keys, start=start, end=end, **columns)
    at_start = st.select(*(F.col(k).alias(f"s_{k}") for k in keys), F.col("at_ns").alias("s_at"), (F.col("in_flight") - F.col("n_started")).alias("before_start"), F.col("in_flight").alias("at_start"))
    at_end = st.select(*(F.col(k).alias(f"e_{k}") for k in keys), F.col("at_ns").alias("e_at"), (F.col("in_flight") - F.col("n_started") + F.col("n_ended")).alias("before_ends"))
    ok = df.where(invalid_reason(start, end).isNull()).withColumn("end_no", F.row_number().over(Window.partitionBy(*keys, end).orderBy(row_key)))
    on_s, on_e = F.col(start) == F.col("s_at"), F.col(end) == F.col("e_at")
    for k in keys:
        on_s, on_e = on_s & F.col(k).eqNullSafe(F.col(f"s_{k}")), on_e & F.col(k).eqNullSafe(F.col(f"e_{k}"))
    out = ok.join(at_start, on_s).join(at_end, on_e)
    out = out.withColumn("after_end", F.col("before_ends") - F.col("end_no")).withColumn("before_end", F.col("before_ends") - F.col("end_no") + 1)
    return out.drop("s_at", "e_at", "before_ends", "end_no", *(f"s_{k}" for k in keys), *(f"e_{k}" for k in keys))


def load_summary(intervals: DataFrame, keys: Sequence[str], thresholds: Sequence[int] = (8, 12, 16, 24, 32), value: str = "in_flight", weight: str = "duration_ns", prefix: str = "") -> DataFrame:
    """Time-weighted load: maximum, mean, quantiles (lowest value that reaches the share) and shares of time at or
    above thresholds."""
    marks = [weighted_fraction(F.col(value) >= t, weight).alias(f"{prefix}fraction_ge_{t}") for t in thresholds]
    base = intervals.groupBy(*keys).agg(F.max(value).alias(f"{prefix}max"), weighted_mean(value, weight).alias(f"{prefix}mean"), (F.sum(weight) / 1e9).alias(f"{prefix}observed_s"), *marks)
    qs = weighted_quantiles(intervals, list(keys), value, weight, {f"{prefix}p{round(q * 100)}": q for q in (0.5, 0.9, 0.95, 0.99)})
    return base.join(qs, list(keys), "left") if keys else base.join(qs)


def overlaps(a: DataFrame, b: DataFrame, start: str, end: str, width: int, keys: Sequence[str] = (), take: Sequence[str] = ()) -> DataFrame:
    """Overlaps [max start, min end) of two interval tables. Both sides are dealt to the time buckets they touch and
    meet by bucket; a pair counts in the bucket of its overlap's start, so it comes out once."""

    def dealt(df: DataFrame, side: str) -> DataFrame:
        ok = df.where(F.col(start) < F.col(end))
        buckets = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
        return ok.select(F.explode(buckets).alias("bucket"), *(F.col(k).alias(f"{k}_{side}") for k in keys), F.col(start).alias(f"start_{side}"), F.col(end).alias(f"end_{side}"), *(F.col(c).alias(f"{c}_{side}") for c in take))

    x, y = dealt(a, "a"), dealt(b, "b").withColumnRenamed("bucket", "bucket_b")
    on = (F.col("bucket") == F.col("bucket_b")) & (F.col("start_a") < F.col("end_b")) & (F.col("start_b") < F.col("end_a"))
    for k in keys:
        on = on & (F.col(f"{k}_a") == F.col(f"{k}_b"))
    out = x.join(y, on).withColumns({"start": F.greatest("start_a", "start_b"), "end": F.least("end_a", "end_b")})
    out = out.where(F.floor(F.col("start") / width) == F.col("bucket")).drop("bucket", "bucket_b")
    return out.withColumn("duration", F.col("end") - F.col("start")).drop(*(f"{k}_b" for k in keys)).withColumnsRenamed({f"{k}_a": k for k in keys})


def self_overlap_count(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """For each key how many intervals begin before an earlier one ended: 0 is what overlaps() expects of a series."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("upto_", F.max(end).over(w)).groupBy(*keys).agg(F.count_if(F.col(start) < F.col("upto_")).alias("n_overlapping"))


def clipped(df: DataFrame, start: str, end: str, low: int, high: int) -> DataFrame:
    """Intervals that overlap a window, cut to it."""
    return df.where((F.col(start) < high) & (F.col(end) > low)).withColumns({start: F.greatest(F.col(start), F.lit(low)), end: F.least(F.col(end), F.lit(high))})
