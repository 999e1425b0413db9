"""Workload traces: the recursive request tree flattened in order, prefix reuse, summaries."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracelane.functions.arrays import common_prefix, fingerprint
from tracelane.functions.coerce import ratio

FLAT = T.StructType([
    T.StructField("root_trace_id", T.StringType()), T.StructField("row_no", T.LongType()), T.StructField("source_conversation_path", T.StringType()),
    T.StructField("source_branch_type", T.StringType()), T.StructField("source_outer_request_index", T.LongType()), T.StructField("source_inner_request_index", T.LongType()),
    T.StructField("t", T.DoubleType()), T.StructField("model", T.StringType()), T.StructField("source_input_tokens", T.LongType()), T.StructField("source_output_tokens", T.LongType()),
    T.StructField("hash_ids", T.ArrayType(T.LongType())), T.StructField("api_time_s", T.DoubleType()), T.StructField("block_size", T.LongType()), T.StructField("n_containers", T.LongType()),
])


def _int(x: object) -> int | None:
    try:
        f = float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return None if isinstance(x, bool) or f != f or abs(f) == float("inf") or f != int(f) else int(x) if isinstance(x, int) else int(f)


def _float(x: object) -> float | None:
    try:
        f = float(x)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None
    return None if isinstance(x, bool) or f != f or abs(f) == float("inf") else f


def _first(node: dict, *names: str) -> object:
    return next((node[n] for n in names if node.get(n) is not None), None)


def _label(node: dict) -> str:
    """Words in a subagent's type and the branch they stand for."""
    kind = str(node.get("subagent_type") or "").lower()
    for words, name in ((("fan", "fork"), "fanout"), (("aux",), "auxiliary"), (("worker", "group"), "worker_group")):
        if any(w in kind for w in words):
            return name
    return "subagent"


def _opens_branch(node: dict) -> bool:
    """Whether a node with requests of its own stands for an agent: typed so, named so, or without an input size."""
    typed = str(node.get("type") or "").lower() in ("subagent", "agent", "branch")
    return typed or "agent_id" in node or "subagent_type" in node or _first(node, "in", "input_tokens", "input_length") is None


def walk(line: str) -> Iterator[tuple]:
    """The rows of one trace in the order of a depth-first walk, from an explicit stack, so depth costs no recursion.

    A node with requests of its own that stands for an agent opens the path parent::sa:agent and is no request
    itself. Another node with requests is a request, then its requests follow on its path. The outer index is the
    place in the root's list of the request or of what holds it; the inner one the place in the nested list, null
    in the root's. A trace without any request gives one row without a path, with the number of agents.
    """
    trace = json.loads(line)
    root = str(trace.get("id") or "").strip()
    if not root:
        raise ValueError("a trace without id")
    if not isinstance(trace.get("requests"), list):
        raise ValueError(f"trace {root} has no list of requests")
    block = _int(trace.get("block_size"))
    rows: list[list] = []
    containers = 0
    # node, path, branch, outer index (None in the root's list), place in its list, agents above
    stack: list[tuple] = [(n, root, "root", None, i, 0) for i, n in reversed(list(enumerate(trace["requests"])))]
    while stack:
        node, path, branch, outer, place, depth = stack.pop()
        if not isinstance(node, dict):
            continue
        kids = node.get("requests") if isinstance(node.get("requests"), list) else None
        top = place if outer is None else outer
        if kids is not None and _opens_branch(node):
            containers += 1
            below = f"{path}::sa:{str(node.get('agent_id') or '').strip() or f'unknown_{depth}_{place}'}"
            stack.extend((k, below, _label(node), top, i, depth + 1) for i, k in reversed(list(enumerate(kids))))
            continue
        hashes = _first(node, "hash_ids", "hashes")
        rows.append([root, len(rows), path, branch, top, None if outer is None else place, _float(node.get("t")), _first(node, "model"), _int(_first(node, "in", "input_tokens", "input_length")), _int(_first(node, "out", "output_tokens", "output_length")), [int(h) for h in hashes] if isinstance(hashes, list) else None, _float(_first(node, "api_time", "duration")), block, None])
        if kids is not None:
            stack.extend((k, path, branch, top, i, depth) for i, k in reversed(list(enumerate(kids))))
    for r in rows or [[root, None, *[None] * 10, block, None]]:
        r[-1] = containers
        yield tuple(r)


def flatten(lines: DataFrame, column: str = "value", batch_rows: int = 8192) -> DataFrame:
    """A row for each request of each trace (one JSON text in each row), by walk(), in Arrow batches of batch_rows. A
    malformed trace is an error, a blank text is none. A trace must fit into a task, its rows needn't."""
    want = to_arrow_schema(FLAT)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), want, strict=True)], schema=want)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (x for b in batches for x in b.column(0).to_pylist() if x is not None and x.strip())
        rows = (r for text in texts for r in walk(text))
        while held := list(itertools.islice(rows, batch_rows)):
            yield made(held)

    return lines.select(F.col(column).cast("string")).mapInArrow(walked, FLAT)


def branch_state(flat: DataFrame, branch: list[str] | None = None) -> DataFrame:
    """flat with ordinals in root and branch and the reuse of the previous request's prefix in the same branch: shared
    blocks, cached and new tokens, ratio, rollback. A previous request without hashes gives nulls; it isn't skipped."""
    keys = branch or ["root_trace_id", "source_conversation_path"]
    w = Window.partitionBy(*keys).orderBy("row_no")
    out = flat.withColumns({"request_ordinal": F.row_number().over(Window.partitionBy("root_trace_id").orderBy("row_no")) - 1, "source_branch_request_index": F.row_number().over(w) - 1, "before_": F.lag("hash_ids").over(w)})
    out = out.withColumn("first_in_branch", F.col("source_branch_request_index") == 0).withColumn("shared_blocks", common_prefix("before_", "hash_ids"))
    cached = F.least(F.col("source_input_tokens"), F.col("shared_blocks") * F.col("block_size"))
    cached = F.when(F.col("shared_blocks").isNotNull() & F.col("source_input_tokens").isNotNull() & F.col("block_size").isNotNull(), cached)
    return out.withColumns({"cached_tokens": cached, "new_tokens": F.col("source_input_tokens") - cached, "cached_ratio": ratio(cached, "source_input_tokens"), "rollback_blocks": F.when(F.col("shared_blocks").isNotNull(), F.size("before_") - F.col("shared_blocks")), "n_hashes": F.when(F.col("hash_ids").isNotNull(), F.size("hash_ids")), "hash_fingerprint": fingerprint("hash_ids")}).drop("before_")


def is_fork(path: Column | str = "source_conversation_path") -> Column:
    return (F.col(path) if isinstance(path, str) else path).contains("::sa:")


def root_summary(flat: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """One row for each trace: requests, containers, tokens, time span, models (declared ones first, others sorted).
    Containers count even where they hold no request."""
    real = F.col("source_conversation_path").isNotNull()
    out = flat.groupBy("root_trace_id").agg(
        F.count_if(real).alias("n_requests"), F.max("n_containers").alias("n_containers"), F.count_if(real & is_fork()).alias("n_subagent_requests"), F.sum("source_input_tokens").alias("input_tokens"),
        F.sum("source_output_tokens").alias("output_tokens"), F.max("source_input_tokens").alias("max_input_tokens"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.array_sort(F.collect_set("model")).alias("models"),
    )
    out = out.withColumn("span_s", F.col("last_t") - F.col("first_t"))
    if declared is None:
        return out
    d = declared.select(F.col("root_trace_id").alias("d_"), F.col("declared_models").alias("dm_"))
    return out.join(d, F.col("root_trace_id") == F.col("d_"), "left").withColumn("models", F.array_union(F.coalesce("dm_", F.array().cast("array<string>")), "models")).drop("d_", "dm_")


def cache_shape(state: DataFrame, keys: list[str]) -> DataFrame:
    return state.groupBy(*keys).agg(F.count("*").alias("n_requests"), F.count("shared_blocks").alias("n_with_previous"), F.percentile("cached_ratio", 0.5).alias("cached_ratio_p50"), F.percentile("cached_ratio", 0.9).alias("cached_ratio_p90"), F.sum("cached_tokens").alias("cached_tokens"), F.sum("new_tokens").alias("new_tokens"), F.count_if(F.col("rollback_blocks") > 0).alias("n_rollbacks"))


def trace_check(lines: DataFrame, column: str = "value") -> DataFrame:
    """Size, traces, distinct ids and all top-level keys of a trace table, in one pass."""
    keys = F.explode_outer(F.json_object_keys(F.col(column)))
    n = lines.agg(F.count("*").alias("n_traces"), F.count_distinct(F.get_json_object(column, "$.id")).alias("n_ids"), F.sum(F.octet_length(column)).alias("n_bytes"))
    names = lines.select(keys.alias("k")).distinct().agg(F.array_join(F.array_sort(F.collect_list("k")), ";").alias("top_level_keys"))
    return n.join(F.broadcast(names))  # one row each


def require_unique_roots(flat_lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines, or an error when a trace id repeats: raised by the row that does, so it costs no extra pass."""
    w = Window.partitionBy("id_")
    ids = flat_lines.withColumn("id_", F.get_json_object(column, "$.id")).withColumn("n_", F.count("*").over(w))
    return ids.withColumn(column, F.when(F.col("n_") > 1, F.raise_error(F.concat(F.lit("repeated trace id "), F.col("id_")))).otherwise(F.col(column))).drop("id_", "n_")
