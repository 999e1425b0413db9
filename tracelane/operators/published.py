"""Published results: found in nested JSON, chosen or left ambiguous, compared with what requests say."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelane.functions.aggregates import exact_percentile, exact_percentiles
from tracelane.functions.coerce import duration_ms, number, ratio, text_or_null
from tracelane.functions.ids import path_concurrency
from tracelane.functions.text import same_label
from tracelane.operators.aliases import resolved

# Keys that may wrap the result objects of a file, in order.
WRAPPERS = ("results", "benchmarks", "benchmark_results", "summary", "data")
# The names of each metric, nested paths before flat ones; Q stands for each of QUANTILES.
QUANTILES = (50, 75, 90, 95)
COUNTS = {
    "successful_profiled_request_count": ("num_requests_successful", "successful_profiled_request_count", "successful_requests", "num_successful_requests", "num_requests_successful", "success_count", "request_count"),
    "total_input_tokens": ("total_input_tokens", "input_tokens_total", "input_token_count"),
    "total_output_tokens": ("total_output_tokens", "output_tokens_total", "output_token_count"),
}
LATENCIES = {
    "mean_ttft_ms": ("request_metrics.latency.ttft.mean", "time_to_first_token.avg", "mean_ttft_ms", "mean_time_to_first_token_ms", "mean_time_to_first_token", "ttft_mean"),
    "pQ_ttft_ms": ("request_metrics.latency.ttft.pQ", "time_to_first_token.pQ", "pQ_ttft_ms", "ttft_pQ", "ttft_pQ_ms", "time_to_first_token_pQ"),
    "mean_itl_ms": ("request_metrics.latency.itl.mean", "request_metrics.latency.tpot.mean", "inter_token_latency.avg", "mean_itl_ms", "mean_inter_token_latency_ms", "mean_inter_token_latency", "itl_mean", "mean_tpot_ms"),
    "pQ_itl_ms": ("request_metrics.latency.itl.pQ", "request_metrics.latency.tpot.pQ", "inter_token_latency.pQ", "pQ_itl_ms", "itl_pQ", "inter_token_latency_pQ", "tpot_pQ"),
    "mean_e2e_ms": ("request_metrics.latency.e2el.mean", "request_latency.avg", "mean_e2e_ms", "mean_request_latency_ms", "mean_request_latency", "e2e_mean"),
    "pQ_e2e_ms": ("request_metrics.latency.e2el.pQ", "request_latency.pQ", "pQ_e2e_ms", "e2e_pQ", "request_latency_pQ"),
}
RATES = {
    "input_throughput_tps": ("request_metrics.throughput.input.tokens_per_second", "input_throughput_tps", "input_token_throughput", "input_tokens_per_second"),
    "output_throughput_tps": ("request_metrics.throughput.output.tokens_per_second", "output_throughput_tps", "output_token_throughput", "output_tokens_per_second"),
    "total_throughput_tps": ("request_metrics.throughput.total.tokens_per_second", "total_throughput_tps", "total_token_throughput", "total_tokens_per_second"),
    "duration_s": ("request_metrics.throughput.duration_seconds", "benchmark_duration", "duration_s", "benchmark_duration_s", "duration_seconds", "elapsed_time_s"),
    "gpu_count": ("num_gpus", "gpu_count", "num_gpus", "total_gpus"),
    "per_gpu_input_throughput_tps": ("request_metrics.throughput.per_gpu.input_tput_tps", "per_gpu_input_throughput_tps"),
    "per_gpu_output_throughput_tps": ("request_metrics.throughput.per_gpu.output_tput_tps", "per_gpu_output_throughput_tps"),
    "per_gpu_total_throughput_tps": ("request_metrics.throughput.per_gpu.total_tput_tps", "per_gpu_total_throughput_tps"),
}
LABELS = {"target_model": ("model", "model", "target_model"), "precision": ("precision",), "framework": ("framework",)}
CONCURRENCY = {"metadata_concurrency": ("conc", "conc", "concurrency", "target_concurrency")}
# Parts of metrics that a result may lack.
PARTS = {
    "asked_concurrency": ("concurrency", "target_concurrency", "conc"), "prefill_gpus": ("num_prefill_gpu",), "decode_gpus": ("num_decode_gpu",), "successes": ("num_requests_successful",),
    "mean_input": ("request_metrics.tokens.input.mean",), "mean_output": ("request_metrics.tokens.output_actual.mean",),
}
# What is read of these besides their values.
MEANS = ("mean_input", "mean_output", "successes")
IN_SECONDS, SECOND_UNITS = "request_metrics.latency", ("s", "sec", "seconds")
# Four units in the last place of a double, relative to it.
ROUNDING = 2.0**-50
# Labels that name one model.
MODEL_ALIASES = (("GLM-5.2 FP8", "zai-org/GLM-5.2-FP8"),)
# What is said of metrics and of choices that weren't made.
NOT_COMPARABLE = "Unknown: one or both values are unavailable in raw/profiled or published aggregate data."
ALIAS_NOTE = "Evidence: literal target-model labels differ but are the documented GLM-5.2 FP8 alias pair (`GLM-5.2 FP8` and `zai-org/GLM-5.2-FP8`)."
LABEL_NOTE = "Metadata comparison; raw context provenance must be checked separately from numeric reconstruction."
PER_GPU_NOTE = "Raw value divides reconstructed shared-system throughput by recorded GPU count."
SELECTION_NOTES = {
    "no_recognized_published_metrics": "Unknown: published aggregate file(s) were found, but no supported metric path was recognized for this concurrency.",
    "several_files": "Unknown: multiple published aggregate JSON candidates exist for this concurrency; raw-vs-published comparison was skipped rather than selecting one by path order.",
    "several_objects": "Unknown: one published aggregate JSON contains multiple recognized objects for this concurrency; comparison was skipped.",
    "artifact": "Unknown: aggregate JSON could not be mapped unambiguously to an inventory-confirmed aggregate/run-summary artifact; comparison was skipped.",
}


def _each_quantile(names: Mapping[str, Sequence[str]]) -> dict[str, tuple[str, ...]]:
    """names with every entry that has a Q repeated for each quantile."""
    out: dict[str, tuple[str, ...]] = {}
    for metric, aliases in names.items():
        for q in QUANTILES if "pQ" in metric else ("Q",):
            out[metric.replace("pQ", f"p{q}")] = tuple(a.replace("pQ", f"p{q}") for a in aliases)
    return out


_LATENCIES = _each_quantile(LATENCIES)
METRICS = {**COUNTS, **_LATENCIES, **RATES, **LABELS, **CONCURRENCY}
NUMERIC = [m for m in METRICS if m not in LABELS]


def result_objects(payload: object) -> list:
    """The result objects of a JSON document: a list's objects, or those under the first wrapper that has any (a list's
    objects, or one object), or the document itself."""
    if isinstance(payload, list):
        return [x for x in payload if isinstance(x, dict)]
    if not isinstance(payload, dict):
        return []
    for key in WRAPPERS:
        v = payload.get(key)
        found = [x for x in v if isinstance(x, dict)] if isinstance(v, list) else [v] if isinstance(v, dict) else []
        if found or isinstance(v, dict):
            return found
    return [payload]


def published_results(files: DataFrame, json_text: str = "value", path: str = "path") -> DataFrame:
    """A row for each result object of each file: every metric (latencies in milliseconds, labels as text), the
    concurrency (its own, else the artifact's in a column artifact_concurrency, else the path's), <total>_derivation of
    token totals made from means, object_no and unparsed (why a file or an object gave nothing).

    Nested request latencies are seconds; others go by a unit beside them, then by their path, and are milliseconds
    where nothing says otherwise. A file that is no JSON has one row of nulls.
    """
    own = [c for c in files.columns if c != json_text]
    read = {f: ("value", "path", "unit") if f in _LATENCIES else ("value", "path") if f in MEANS else ("value",) for f in (*METRICS, *PARTS)}
    out = resolved(files.withColumn("is_json_", F.try_parse_json(json_text).isNotNull()), json_text, {**METRICS, **PARTS}, near_units=True, split=result_objects, keep=[*own, "is_json_"], parts=read)
    value, at = (lambda m: number(F.col(f"found.{m}.value"))), (lambda m: F.col(f"found.{m}.path"))

    def latency(m: str) -> Column:
        by_unit = F.lower(F.trim(f"found.{m}.unit")).isin(*SECOND_UNITS)
        seconds = at(m).contains(IN_SECONDS) | F.coalesce(by_unit, F.lit(False))
        return F.when(seconds, value(m) * 1000).otherwise(duration_ms(F.col(f"found.{m}.value"), path=at(m)))

    made = {m: latency(m) if m in _LATENCIES else text_or_null(F.col(f"found.{m}.value")) if m in LABELS else value(m) for m in METRICS}
    made["gpu_count"] = F.coalesce(value("gpu_count"), value("prefill_gpus") + value("decode_gpus"))
    for side in ("input", "output"):
        total, mean = f"total_{side}_tokens", value(f"mean_{side}")
        derived = mean * value("successes")
        made[total] = F.coalesce(value(total), derived)
        said = F.concat(F.lit("derived from "), at(f"mean_{side}"), F.lit(" × "), at("successes"), F.lit("; published mean is rounded"))
        made[f"{total}_derivation"] = F.when(value(total).isNull() & derived.isNotNull(), said)
    given = F.col("artifact_concurrency").cast("double") if "artifact_concurrency" in own else F.lit(None).cast("double")
    made["concurrency"] = F.coalesce(value("asked_concurrency"), given, path_concurrency(path).cast("double")).cast("int")
    out = out.withColumns(made)
    recognized = F.greatest(*(F.col(m).isNotNull() for m in METRICS))
    unparsed = F.when(~F.col("is_json_"), "invalid JSON").when(~recognized, "no recognized aggregate metrics")
    return out.withColumns({"unparsed": unparsed, "recognized": recognized}).drop("found", "is_json_")


def chosen(results: DataFrame, path: str = "path") -> DataFrame:
    """One row for each concurrency: the only recognized result object's metrics, or a selection_status that says why
    none was chosen, with its selection_note, the candidates' files and their count. A null concurrency is one too.

    With columns artifact_match_status, artifact_id and artifact_name (see artifact_context) a result whose file isn't
    that of one known artifact is not chosen."""
    r = F.col("recognized")
    linked = "artifact_match_status" in results.columns
    columns = [c for c in results.columns if c not in ("concurrency", "recognized")]
    # taken only where one object is recognized, so any object's will do; a column each, so that unread ones aren't shuffled
    one = [F.any_value(F.when(r, F.col(c)), True).alias(f"one_{c}_") for c in columns]
    seen = results.groupBy("concurrency").agg(
        F.count_distinct(F.when(r, F.col(path))).alias("candidate_file_count"), F.count_if(r).alias("candidate_object_count"),
        F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(r, F.col(path)))), "; "), F.lit("")).alias("recognized_paths_"), F.nullif(F.array_join(F.array_sort(F.collect_set(path)), "; "), F.lit("")).alias("all_paths_"),
        *one,
    )
    status = F.coalesce("one_artifact_match_status_", F.lit("unambiguous")) if linked else F.lit("unambiguous")
    by_artifact = F.when(status == "ambiguous", "ambiguous_artifact_context").when(status != "unambiguous", "unmatched_artifact_context")
    n_files, n_objects = F.col("candidate_file_count"), F.col("candidate_object_count")
    seen = seen.withColumns({
        "candidate_source_paths": F.coalesce("recognized_paths_", "all_paths_"),
        "selection_status": F.when(n_objects == 0, "no_recognized_published_metrics").when((n_files > 1) | (n_objects > 1), "ambiguous_published_candidates").otherwise(by_artifact),
        "selection_note": F.when(n_objects == 0, SELECTION_NOTES["no_recognized_published_metrics"]).when(n_files > 1, SELECTION_NOTES["several_files"]).when(n_objects > 1, SELECTION_NOTES["several_objects"]).when(by_artifact.isNotNull(), SELECTION_NOTES["artifact"]),
    })
    take = [F.when(F.col("selection_status").isNull(), F.col(f"one_{c}_")).alias(c) for c in columns]
    return seen.select("concurrency", "candidate_file_count", "candidate_object_count", "candidate_source_paths", "selection_status", "selection_note", *take)


def artifact_context(files: DataFrame, artifacts: DataFrame, path: str = "path", kinds: Sequence[str] = ("aggregated_agentic", "run_summary")) -> DataFrame:
    """files with artifact_match_status (unambiguous, ambiguous or unmatched) and, if it is one, artifact_id,
    artifact_name and artifact_concurrency: artifacts of the kinds whose id or name stands anywhere in the path,
    without case. artifacts is the inventory of a run (artifact_id, artifact_name, category, concurrency), held as one
    list of at most a few hundred entries that every path is searched for."""
    known = [(r.artifact_id or "", (r.artifact_name or "").lower(), r.artifact_name, r.concurrency) for r in artifacts.where(F.col("category").isin(*kinds)).select("artifact_id", "artifact_name", "concurrency").collect()]
    fields = "array<struct<id:string, low:string, name:string, concurrency:int>>"
    inventory = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(n).alias("low"), F.lit(name).alias("name"), F.lit(c).cast("int").alias("concurrency")) for i, n, name, c in known)) if known else F.array().cast(fields)
    low = F.lower(path)
    found = F.filter(inventory, lambda a: low.contains(a["id"]) | low.contains(a["low"]))
    out = files.withColumn("found_", found)
    one = lambda f: F.when(F.size("found_") == 1, F.col("found_")[0][f])
    status = F.when(F.size("found_") == 1, "unambiguous").when(F.size("found_") == 0, "unmatched").otherwise("ambiguous")
    return out.withColumns({"artifact_match_status": status, "artifact_id": one("id"), "artifact_name": one("name"), "artifact_concurrency": one("concurrency")}).drop("found_")


def recomputed(df: DataFrame) -> DataFrame:
    """All METRICS from profiled requests, for each concurrency; inter-token latencies above 0 only."""
    stats = []
    for name, c in (("ttft", F.col("ttft_ms")), ("itl", F.when(F.col("itl_ms") > 0, F.col("itl_ms"))), ("e2e", F.col("e2e_ms"))):
        qs = [q / 100 for q in QUANTILES]
        stats += [F.avg(c).alias(f"mean_{name}_ms"), *(p.alias(f"p{q}_{name}_ms") for q, p in zip(QUANTILES, exact_percentiles(c, qs), strict=True))]
    first = lambda c: F.min_by(text_or_null(c), F.when(text_or_null(c).isNotNull(), F.struct("source_file_path", "record_ordinal")))
    span = (F.max("request_end_ns") - F.min("request_start_ns")) / F.lit(1e9)
    out = df.groupBy("concurrency").agg(
        F.count("*").cast("double").alias("successful_profiled_request_count"), F.coalesce(F.sum("input_tokens"), F.lit(0.0)).alias("total_input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0.0)).alias("total_output_tokens"),
        *stats, span.alias("duration_s"), exact_percentile("target_gpu_count", 0.5).alias("gpu_count"), first("target_model").alias("target_model"), first("target_precision").alias("precision"), first("framework").alias("framework"),
    )
    positive = F.when(F.col("duration_s") > 0, F.col("duration_s"))
    rates = {"input": F.col("total_input_tokens"), "output": F.col("total_output_tokens"), "total": F.col("total_input_tokens") + F.col("total_output_tokens")}
    out = out.withColumns({f"{k}_throughput_tps": ratio(v, positive) for k, v in rates.items()} | {"metadata_concurrency": F.col("concurrency").cast("double")})
    return out.withColumns({f"per_gpu_{k}_throughput_tps": ratio(f"{k}_throughput_tps", "gpu_count") for k in rates})


def _long(df: DataFrame, side: str, more: Sequence[str] = ()) -> DataFrame:
    """key_, metric, <side>_value, <side>_label and derivation of every metric; absent columns count as null."""
    have = set(df.columns)
    col = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t)
    rows = [F.struct(F.lit(m).alias("metric"), (F.lit(None).cast("double") if m in LABELS else col(m, "double")).alias("v"), (col(m, "string") if m in LABELS else F.lit(None).cast("string")).alias("t"), col(f"{m}_derivation", "string").alias("d")) for m in METRICS]
    return df.select(F.col("concurrency").alias("key_"), *more, F.explode(F.array(*rows)).alias("x")).select("key_", *more, F.col("x.metric"), F.col("x.v").alias(f"{side}_value"), F.col("x.t").alias(f"{side}_label"), F.col("x.d").alias(f"{side}_derivation"))


def tolerances(metric: Column, derived: Column) -> tuple[Column, Column]:
    """Absolute and relative tolerance: counts and tokens exact (1 for totals made from rounded means), milliseconds 1
    or 1 %, rates and durations 0.1 or 2 %; labels have none."""
    exact = metric.endswith("count") | metric.endswith("tokens")
    absolute = F.when(metric.isin(*LABELS), None).when(exact, F.when(metric.endswith("tokens") & derived, 1.0).otherwise(0.0)).when(metric.endswith("_ms"), 1.0).when(metric.endswith("_tps") | (metric == "duration_s"), 0.1).otherwise(1e-9)
    relative = F.when(metric.isin(*LABELS), None).when(exact, 0.0).when(metric.endswith("_ms"), 0.01).when(metric.endswith("_tps") | (metric == "duration_s"), 0.02).otherwise(1e-9)
    return absolute, relative


def validated(raw: DataFrame, published: DataFrame, path: str = "path") -> DataFrame:
    """Every metric of every concurrency on either side: values or labels, differences, tolerances, validation_status
    (pass, pass_alias_equivalent, mismatch, not_comparable, or why nothing was chosen) and validation_note.

    raw: recomputed; published: chosen. Nothing absent passes. A difference equal to a tolerance passes, whatever the
    rounding of the doubles it is between; where the tolerance is 0, only equal values do."""
    more = ["selection_status", "selection_note", "candidate_file_count", "candidate_object_count", "candidate_source_paths", path]
    a = _long(raw, "raw").drop("raw_derivation")
    b = _long(published, "published", more).withColumnsRenamed({"key_": "p_", "metric": "m_"})
    out = a.join(b, a["key_"].eqNullSafe(b["p_"]) & (a["metric"] == b["m_"]), "full_outer")
    blocked, metric = F.col("selection_status").isNotNull(), F.coalesce("metric", "m_")
    out = out.select(F.coalesce("key_", "p_").alias("concurrency"), metric.alias("metric"), "raw_value", "raw_label", "published_value", "published_label", F.col("published_derivation").alias("published_value_derivation"), F.col(path).alias("published_source_file_path"), *more[:-1])
    out = out.withColumns({f"candidate_{n}_count": F.coalesce(f"candidate_{n}_count", F.lit(0)) for n in ("file", "object")})
    gap = F.abs(F.col("raw_value") - F.col("published_value"))
    away = F.when(F.col("published_value") != 0, gap / F.abs("published_value")).when(gap == 0, 0.0)
    most, share = tolerances(F.col("metric"), F.col("published_value_derivation").isNotNull())
    # 4.9 - 3.9 is a little more than 1 in doubles: what is within a tolerance may exceed it by the rounding of its terms
    rounding = ROUNDING * F.greatest(F.abs("raw_value"), F.abs("published_value"))
    near = (gap == 0) | ((most > 0) & (gap <= most + rounding)) | ((share > 0) & (gap <= share * F.abs("published_value") + rounding))
    x, y = text_or_null("raw_label"), text_or_null("published_label")
    labels = F.when(x.isNull() | y.isNull(), "not_comparable").when(same_label(x, y), "pass").when((F.col("metric") == "target_model") & same_label(x, y, MODEL_ALIASES), "pass_alias_equivalent").otherwise("mismatch")
    numbers = F.when(gap.isNull(), "not_comparable").when(near, "pass").otherwise("mismatch")
    is_label = F.col("metric").isin(*LABELS)
    out = out.withColumns({"absolute_difference": F.when(~blocked, gap), "relative_difference": F.when(~blocked, away), "tolerance_absolute": most, "tolerance_relative": share, "validation_status": F.when(blocked, F.col("selection_status")).when(is_label, labels).otherwise(numbers)})
    derived = F.concat(F.lit("Evidence: "), "published_value_derivation", F.lit("; validation uses an explicit rounding tolerance."))
    status = F.col("validation_status")
    note = F.when(blocked, F.col("selection_note")).when(status == "not_comparable", NOT_COMPARABLE).when(status == "pass_alias_equivalent", ALIAS_NOTE).when(derived.isNotNull(), derived).when(is_label, LABEL_NOTE).when(F.col("metric").startswith("per_gpu_"), PER_GPU_NOTE)
    return out.withColumn("validation_note", note).drop("selection_status", "selection_note")
