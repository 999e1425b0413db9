"""Recomputed against published aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.functions.aggregates import exact_percentile, exact_percentiles
from tracelane.functions.coerce import ratio, text_or_null
from tracelane.functions.text import same_label

# Absolute and relative tolerance by kind of metric, first pattern that fits a metric's name.
TOLERANCES = (
    ("derived_.*tokens", 1.0, 0.0),
    (".*(count|tokens)", 0.0, 0.0),
    (".*_ms", 1.0, 0.01),
    (".*_tps", 0.1, 0.02),
    ("duration_s", 0.1, 0.02),
    (".*", 1e-9, 1e-9),
)

PERCENTILES = [0.5, 0.9, 0.95, 0.99]


def tolerance(metric: str) -> tuple[Column, Column]:
    """The absolute and relative tolerance of a metric."""
    absolute = relative = None
    for pattern, a, r in TOLERANCES:
        hit = F.col(metric).rlike(f"^{pattern}$")
        absolute = F.when(hit, a) if absolute is None else absolute.when(hit, a)
        relative = F.when(hit, r) if relative is None else relative.when(hit, r)
    return absolute, relative


def compared(df: DataFrame, metric: str = "metric", raw: str = "raw_value", published: str = "published_value") -> DataFrame:
    """df with differences and status: pass within either tolerance, else mismatch; not_comparable without both."""
    a, r = tolerance(metric)
    gap = F.abs(F.col(raw) - F.col(published))
    rel = F.when(gap == 0, 0.0).otherwise(ratio(gap, F.abs(F.col(published))))
    ok = (gap <= a) | F.coalesce(rel <= r, F.lit(False))
    status = F.when(F.col(raw).isNull() | F.col(published).isNull(), "not_comparable").when(ok, "pass").otherwise("mismatch")
    note = F.when(F.col(raw).isNull(), "no recomputed value").when(F.col(published).isNull(), "no published value").when(~ok, "outside both tolerances")
    return df.withColumns({"absolute_difference": gap, "relative_difference": rel, "validation_status": status, "note": note})


def label_status(a: Column | str, b: Column | str, aliases: tuple[tuple[str, str], ...] = ()) -> Column:
    x, y = (text_or_null(c) for c in (a, b))
    return F.when(x.isNull() | y.isNull(), "not_comparable").when(same_label(x, y), "pass").when(same_label(x, y, aliases), "pass_alias_equivalent").otherwise("mismatch")


def aligned_metrics(raw: DataFrame, published: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Both sides in long form, aligned by key and metric; what one side lacks stays with a null."""
    long = lambda df, name: df.select(key, *(F.col(m).cast("double").alias(m) for m in metrics if m in df.columns)).unpivot(key, [m for m in metrics if m in df.columns], "metric", name)
    return long(raw, "raw_value").join(long(published, "published_value"), [key, "metric"], "full_outer")


def raw_aggregates(df: DataFrame, keys: Sequence[str] = ("concurrency",), gpus: str | None = None) -> DataFrame:
    """Aggregates recomputed from requests, with latencies over positive values only and rates for each GPU by the
    median GPU count."""
    itl = F.when(F.col("itl_ms") > 0, F.col("itl_ms"))
    stats = []
    for name, c in (("ttft", F.col("ttft_ms")), ("e2e", F.col("e2e_ms")), ("itl", itl)):
        stats += [F.avg(c).alias(f"mean_{name}_ms"), F.min(c).alias(f"min_{name}_ms"), F.max(c).alias(f"max_{name}_ms"), *(p.alias(f"p{round(q * 100)}_{name}_ms") for q, p in zip(PERCENTILES, exact_percentiles(c, PERCENTILES), strict=True))]
    span = (F.max("request_end_ns") - F.min("request_start_ns")) / F.lit(1e9)
    out = df.groupBy(*keys).agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("total_input_tokens"), F.sum("output_tokens").alias("total_output_tokens"), F.avg("input_tokens").alias("mean_input_tokens"), F.avg("output_tokens").alias("mean_output_tokens"), *stats, span.alias("duration_s"), *([exact_percentile(gpus, 0.5).alias("gpus")] if gpus else []))
    positive = F.when(F.col("duration_s") > 0, F.col("duration_s"))
    out = out.withColumns({"output_tps": ratio("total_output_tokens", positive), "request_rate": ratio("requests", positive)})
    return out.withColumn("output_tps_per_gpu", ratio("output_tps", "gpus")) if gpus else out


def derived_totals(df: DataFrame) -> DataFrame:
    """Token totals as the mean times the successful requests, with how they were derived."""
    out = {}
    for side in ("input", "output"):
        out[f"derived_{side}_tokens"] = F.col(f"mean_{side}_tokens") * F.col("requests")
        out[f"derived_{side}_tokens_note"] = F.when(F.col(f"mean_{side}_tokens").isNotNull() & F.col("requests").isNotNull(), f"mean_{side}_tokens x requests")
    return df.withColumns(out)


def matching_artifacts(candidates: DataFrame, artifacts: DataFrame, path: str = "path") -> DataFrame:
    """Candidates with the one artifact whose name is a part of their path; several or none give a null with a reason.
    The inventory is one row for each artifact of a run, joined by exact path parts."""
    parts = candidates.select(path).distinct().withColumn("part_", F.explode(F.split(path, "/")))
    found = parts.join(artifacts.select(F.col("artifact_name").alias("part_"), "artifact_id"), "part_").groupBy(path).agg(F.count_distinct("artifact_id").alias("n_artifacts"), F.min("artifact_id").alias("a_"))
    out = candidates.join(found, path, "left").na.fill(0, ["n_artifacts"])
    return out.withColumns({"artifact_id": F.when(F.col("n_artifacts") == 1, F.col("a_")), "artifact_status": F.when(F.col("n_artifacts") == 1, "unambiguous").when(F.col("n_artifacts") == 0, "unmatched").otherwise("ambiguous")}).drop("a_")


def inventory_check(found: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Each id found or expected: present, missing or unexpected."""
    a = found.select(key).distinct().withColumn("f_", F.lit(True))
    b = expected.select(key).distinct().withColumn("e_", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("f_").isNull(), "missing").when(F.col("e_").isNull(), "unexpected").otherwise("present").alias("status"))


def status_totals(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "validation_status").agg(F.count("*").alias("n"))


def long_report(df: DataFrame, keys: Sequence[str], metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """metric, value, unit, meaning and status rows of a summary; a null value is Unknown, never zero."""
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(u).alias("unit"), F.lit(t).alias("meaning")) for m, (u, t) in metrics.items())))
    return df.select(*keys, rows.alias("x")).select(*keys, "x.*").withColumn("status", F.when(F.col("value").isNull(), "Unknown").otherwise("available"))


def profile_context(files: DataFrame, artifacts: DataFrame, path: str = "path") -> DataFrame:
    """Each file's artifact: one whose name is a folder of the path, else one whose id is such a folder's part, else
    the only one of the path's concurrency; several at one level, or none at all, leave it open.

    artifacts (artifact_name, artifact_id, concurrency) is the inventory of a run; files meet it by folder names.
    """
    from tracelane.functions.ids import path_concurrency

    parts = files.select(path).distinct().withColumn("part_", F.explode(F.split(path, "/")))
    a = artifacts.select("artifact_name", "artifact_id", "concurrency")
    by_name = parts.join(a, F.col("part_") == F.col("artifact_name")).select(path, "artifact_id", F.lit(1).alias("level"))
    words = parts.select(path, F.explode(F.split("part_", "[^0-9A-Za-z]+")).alias("word_")).distinct()
    by_id = words.join(a, F.col("word_") == F.col("artifact_id")).select(path, "artifact_id", F.lit(2).alias("level"))
    conc = files.select(path).distinct().withColumn("c_", path_concurrency(path))
    by_conc = conc.join(a, F.col("c_") == F.col("concurrency")).select(path, "artifact_id", F.lit(3).alias("level"))
    found = by_name.unionByName(by_id).unionByName(by_conc).distinct().groupBy(path, "level").agg(F.count("*").alias("n_"), F.min("artifact_id").alias("a_"))
    best = found.groupBy(path).agg(F.min_by(F.struct("n_", "a_", "level"), "level").alias("b_"))
    names = F.element_at(F.array(F.lit("folder_name"), F.lit("folder_id"), F.lit("concurrency")), F.col("b_.level"))
    return files.join(best, path, "left").select(*files.columns, F.when(F.col("b_.n_") == 1, F.col("b_.a_")).alias("artifact_id"), F.when(F.col("b_").isNull(), "not_found").when(F.col("b_.n_") > 1, "ambiguous").otherwise(names).alias("context_rule"))
