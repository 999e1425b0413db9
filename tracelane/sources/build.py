"""From raw profiles to request tables: one scan, several outputs, counts that must agree."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelane.operators.requests import add_identity, add_metrics, mark_duplicates, with_reasons
from tracelane.sources.lines import issues, numbered
from tracelane.sources.profiles import GLOB, canonical, read_profiles
from tracelane.sources.sinks import read_table, write_csv, write_parquet, write_status

# The columns of the exclusion table, in order.
EXCLUSIONS = (
    "github_run_id", "artifact_id", "artifact_name", "concurrency", "conversation_id", "source_trace_id", "source_outer_idx", "source_inner_idx", "root_trace_id", "root_trace_id_provenance", "session_num", "turn_index",
    "record_ordinal", "source_file_path", "benchmark_phase", "error_present", "was_cancelled", "input_tokens", "output_tokens", "ttft_ms", "e2e_ms", "itl_ms", "is_exact_duplicate", "exclusion_reason",
)
#: Bytes of profiles, as text, whose requests one task sorts to find duplicates: at most, and where Spark's number of
#: partitions would do, at least. As a row a request takes several times its text.
MOST_TEXT, LEAST_TEXT = 16 << 20, 1 << 20


def classified(requests: DataFrame, parts: int | None = None, **how) -> DataFrame:
    """Canonical requests with exact duplicates marked (not excluded by that), exclusion_reason, is_profiled_valid,
    derived metrics and identity. parts: as mark_duplicates says."""
    out = with_reasons(mark_duplicates(requests, parts=parts), **how)
    return add_identity(add_metrics(out.withColumn("is_profiled_valid", F.col("exclusion_reason").isNull())))


def empty_requests(spark: SparkSession) -> DataFrame:
    """A table of no requests with every column."""
    none = spark.createDataFrame([], "source_file_path string, record_ordinal bigint, concurrency int, value string")
    return classified(canonical(none))


def _profile_files(spark: SparkSession, path: str, glob: str) -> tuple[int, int]:
    """How many files there are and their bytes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return 0, 0
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    return len(files.inputFiles()), int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _parts(spark: SparkSession, n_bytes: int) -> int:
    """Partitions for requests of so many bytes of text. Spark would join partitions by their compressed bytes, which
    say little of what a sort of wide rows holds."""
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / LEAST_TEXT))
    return max(1, least, math.ceil(n_bytes / MOST_TEXT))


def build_requests(spark: SparkSession, raw: str, out: str, artifacts: DataFrame | None = None, environment: Mapping[str, object] | None = None, missing: str = "empty", glob: str = GLOB, **how) -> dict:
    """Write requests_all and requests_profiled (Parquet), request_exclusions (CSV) and build_status (JSON) below out.

    Profiles are read and classified once; the profiled table and the exclusions are read from the written table, whose
    counts were observed while it was written and must agree with both. No profile is a state of its own (missing:
    empty writes empty tables, error raises), never a table of zeros. Returns the status.
    """
    n_files, n_bytes = _profile_files(spark, raw, glob)
    if not n_files and missing == "error":
        raise FileNotFoundError(f"no {glob} below {raw}")
    faults = Observation("faults")
    rows = classified(read_profiles(spark, raw, artifacts, environment, glob=glob, bad=faults), parts=_parts(spark, n_bytes), **how) if n_files else empty_requests(spark)
    count = Observation("requests")
    rows = rows.observe(count, F.count(F.lit(1)).alias("all"), F.count_if("is_profiled_valid").alias("profiled"), F.count_if(~F.col("is_profiled_valid")).alias("excluded"), F.count_if("is_exact_duplicate").alias("duplicates"))
    write_parquet(rows, f"{out}/requests_all.parquet")
    seen = count.get
    written = read_table(spark, f"{out}/requests_all.parquet")
    write_parquet(written.where("is_profiled_valid"), f"{out}/requests_profiled.parquet")
    write_csv(written.where("NOT is_profiled_valid").select(*EXCLUSIONS), f"{out}/request_exclusions.csv")
    profiled = read_table(spark, f"{out}/requests_profiled.parquet").count()
    if profiled != seen["profiled"] or seen["profiled"] + seen["excluded"] != seen["all"]:
        raise ValueError(f"{profiled} profiled requests were written, {seen} were seen")
    n_bad = faults.get["n"] if n_files else 0
    if n_bad:  # only then are the lines read again
        bad = issues(numbered(spark, raw, recursive=True, glob=glob)).select("file_path", "line_no", "issue")
        write_parquet(bad, f"{out}/request_issues.parquet")
    status = {
        "raw_root": raw, "output_dir": out, "profile_export_count": n_files, "all_record_count": seen["all"], "profiled_record_count": seen["profiled"], "excluded_record_count": seen["excluded"],
        "exact_duplicate_count": seen["duplicates"], "malformed_jsonl_line_count": n_bad, "requests_available": bool(n_files),
        "status": "blocked_no_profile_export" if not n_files else "completed_with_malformed_lines" if n_bad else "completed",
    }
    write_status(spark, f"{out}/build_status", status)
    return status


def schema_mapping(requests: DataFrame) -> DataFrame:
    """For each field and each path that it was read from: records, with the field's type."""
    fields = [c for c in requests.columns if c.startswith("raw_") and c.endswith("_field")]
    long = requests.select(F.explode(F.array(*(F.struct(F.lit(c[4:-6]).alias("field"), F.col(c).alias("path")) for c in fields))).alias("x")).select("x.*")
    return long.where("path IS NOT NULL").groupBy("field", "path").agg(F.count("*").alias("n_records"))


def study_tables(spark: SparkSession, out: str, makers: Mapping[str, Callable[[DataFrame, DataFrame], DataFrame]] | None = None) -> dict[str, int]:
    """The second study's tables from those that build_requests wrote, each with its rows.

    makers: name to (all requests, profiled requests) -> table; those of STUDY by default. Every table is written with
    its observed row count, and the tables that split the profiled requests must add up to them.
    """
    every, good = (read_table(spark, f"{out}/requests_{n}.parquet") for n in ("all", "profiled"))
    rows: dict[str, int] = {}
    for name, make in (makers or STUDY).items():
        count = Observation(name)
        write_parquet(make(every, good).observe(count, F.count(F.lit(1)).alias("n")), f"{out}/{name}.parquet")
        rows[name] = count.get["n"]
    total = good.count()
    for name in [n for n in SPLITS if n in rows]:
        n = read_table(spark, f"{out}/{name}.parquet").agg(F.coalesce(F.sum("n_requests"), F.lit(0))).first()[0]
        if n != total:
            raise ValueError(f"{name} has {n} of {total} requests")
    return rows


def _study() -> dict[str, Callable[[DataFrame, DataFrame], DataFrame]]:
    from tracelane.operators import rollups as ro
    from tracelane.operators.pairing import all_pairs, collapse, pair_ratios, strict_flags

    metrics = ["output_tokens", "ttft_ms", "itl_ms", "e2e_ms"]
    key = ["root_trace_id", "source_outer_idx", "source_inner_idx"]

    def pairs(every: DataFrame, good: DataFrame) -> DataFrame:
        """Exact source turns at two concurrencies; a turn without an inner index meets others without."""
        turns = collapse(good.where("root_trace_id IS NOT NULL AND source_outer_idx IS NOT NULL"), [*key, "concurrency"], metrics)
        return pair_ratios(strict_flags(all_pairs(turns, key, "concurrency", metrics, null_safe=True)), metrics[1:])

    return {
        "schema_mapping": lambda every, good: schema_mapping(every),
        "concurrency_summary": lambda every, good: ro.summarize(good, ["concurrency"]),
        "worker_distribution": lambda every, good: ro.summarize(good, ["concurrency", "worker_id"]),
        "root_subagent_summary": lambda every, good: ro.summarize(good, ["concurrency", "branch_type"]),
        "id_summary": lambda every, good: ro.summarize(good, ["concurrency", "root_trace_id"]),
        "cross_concurrency_pairs": pairs,
    }


STUDY = _study()
#: Tables of which every profiled request is in one row.
SPLITS = ("concurrency_summary", "worker_distribution", "root_subagent_summary", "id_summary")
