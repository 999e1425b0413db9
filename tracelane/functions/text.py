"""Text: labels, model names, log lines, index lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelane.functions.coerce import as_column, number, text_or_null

# Fixed values: (name, observed, words) of the counters in scheduler lines; a word's parts are joined by nothing, _, a
# blank or -, and a configured limit (max) is no observation.
COUNTERS = (
    ("configured_max_running_requests", False, r"\bmax[_ -]?running[_ -]?(?:reqs|requests)"),
    ("configured_max_waiting_requests", False, r"\bmax[_ -]?waiting[_ -]?(?:reqs|requests)"),
    ("running_requests", True, r"(?<!max_)(?<!max-)(?<!max )\b(?:num[_ -]?)?running[_ -]?(?:reqs|requests)"),
    ("waiting_requests", True, r"(?<!max_)(?<!max-)(?<!max )\b(?:num[_ -]?)?waiting[_ -]?(?:reqs|requests)"),
    ("batch_size", True, r"\bbatch[_ -]?size"),
    ("token_load", True, r"\b(?:num[_ -]?)?tokens?"),
    ("token_usage", True, r"\btoken[_ -]?usage"),
)
COUNT = r"\s*[:=]\s*([-+]?\d+(?:\.\d+)?)"
# Front-end lines. A completion names the router's id, the client's and two workers; a checkpoint of a
# long wait names the router's id only.
ID = r"[0-9a-f-]+"
COMPLETED = rf'(?i)request completed request_id=({ID}).*?x_request_id="({ID})".*?prefill_worker_id=(\d+)\s+decode_worker_id=(\d+)'
QUEUED = rf'(?i)dynamo_kv_router::scheduling::queue: refreshed overlap scores after long queue wait\s+request_id="({ID})"\s+wait_ms=(\d+)'
STAMP = r"(\d{4}-\d{2}-\d{2}T[^\s]+Z)"
ANSI = r"\x1b\[[0-9;]*[A-Za-z]"


def precision(c: Column | str) -> Column:
    """fp8, bf16 or fp16 named in a text."""
    x = F.lower(as_column(c))
    return F.when(x.contains("fp8"), "fp8").when(x.rlike("bf16|bfloat16"), "bf16").when(x.rlike("fp16|float16"), "fp16")


def same_label(a: Column | str, b: Column | str, aliases: tuple[tuple[str, str], ...] = ()) -> Column:
    """Labels equal without case and punctuation, or a pair of aliases."""
    plain = lambda c: F.regexp_replace(F.lower(F.trim(as_column(c))), "[^a-z0-9]+", "")
    x, y = plain(a), plain(b)
    same = x == y
    for p, q in aliases:
        p, q = ("".join(ch for ch in v.lower() if ch.isalnum()) for v in (p, q))
        same = same | ((x == p) & (y == q)) | ((x == q) & (y == p))
    return same


def counters(line: Column | str) -> Column:
    """(name, value, observed) of the scheduler counters in a line: configured limits are not observations."""
    x = F.lower(F.regexp_replace(as_column(line), ANSI, ""))
    each = lambda name, seen, words: F.transform(F.regexp_extract_all(x, F.lit(words + COUNT), 1), lambda v: F.struct(F.lit(name).alias("name"), v.cast("double").alias("value"), F.lit(seen).alias("observed")))
    return F.array_distinct(F.flatten(F.array(*(each(*c) for c in COUNTERS))))


def completion(line: Column | str) -> Column:
    """(router_request_id, x_request_id, prefill_worker, decode_worker) of a completion line, else null."""
    x = F.regexp_replace(as_column(line), ANSI, "")
    names = ("router_request_id", "x_request_id", "prefill_worker", "decode_worker")
    got = [F.regexp_extract(x, COMPLETED, i) for i in range(1, 5)]
    return F.when(got[0] != "", F.struct(*(g.alias(n) for g, n in zip(got, names, strict=True))))


def queue_wait(line: Column | str) -> Column:
    """(router_request_id, wait_ms) of a checkpoint line, else null."""
    x = F.regexp_replace(as_column(line), ANSI, "")
    rid, wait = F.regexp_extract(x, QUEUED, 1), F.regexp_extract(x, QUEUED, 2)
    return F.when(rid != "", F.struct(rid.alias("router_request_id"), number(wait).alias("wait_ms")))


def line_stamp(line: Column | str) -> Column:
    return F.nullif(F.regexp_extract(as_column(line), STAMP, 1), F.lit(""))


def first_number(fields: dict[str, Column | str]) -> tuple[Column, Column]:
    """The first finite number among ordered fields, and the name of its field."""
    values = [number(c) for c in fields.values()]
    named = [F.when(v.isNotNull(), name) for name, v in zip(fields, values, strict=True)]
    return F.coalesce(*values), F.coalesce(*named)


# What a selected statistic of an exported bin stands for.
BIN_SCOPES = {
    "avg": "selected raw avg field from exported one-second scheduler occupancy bins",
    "last": "selected raw last field from exported scheduler occupancy bins",
    "max": "selected raw max field from exported scheduler occupancy bins",
    "value": "selected raw value field from exported scheduler occupancy bins",
}
OTHER_SCOPE, NOT_A_MAXIMUM = "exported scheduler occupancy-bin field with unresolved selected statistic", "; not an instantaneous unique-request maximum."
# What server metrics count, by name, by the beginning of a name, and otherwise.
METRIC_SCOPES = {
    "sglang:num_running_reqs": "explicit SGLang running-request gauge; rank-export scope, not summed",
    "sglang:num_queue_reqs": "explicit SGLang queue/waiting-request gauge; rank-export scope, not summed",
    "sglang:queue_time_seconds": "explicit SGLang aggregate queue-time histogram; not request-correlated to profile TTFT",
}
FRONTENDS, FRONTEND_SCOPE = ("dynamo_frontend", "dynamo_request_plane"), "Dynamo frontend/request-plane metric; separate from profile interval overlap and SGLang running"
CAPACITY_SCOPE, ANY_SCOPE = "configured capacity metric; not observed scheduler running", "public AIPerf server-metrics aggregate; retain component/rank scope"
HISTOGRAM_SCOPE = "AIPerf histogram row with shifted compact-CSV label schema; use JSON export for component/rank and histogram estimates."
HISTOGRAM_COMPONENT, UNLABELED = "csv_histogram_labels_unparsed", "unlabeled"
SERIES_SCOPE = "AIPerf public server-metrics profiling export; explicit SGLang metric"


def bin_scope(field: Column | str) -> Column:
    """What a time-slice value of a field stands for; no bin's statistic is a count of requests at one moment."""
    f = as_column(field)
    said = F.lit(OTHER_SCOPE)
    for name, text in BIN_SCOPES.items():
        said = F.when(f == name, text).otherwise(said)
    return F.concat(said, F.lit(NOT_A_MAXIMUM))


def component(label: Column | str) -> Column:
    """The component of a series by its label: a backend decodes, others keep their name, none is unlabeled."""
    x = F.nullif(as_column(label).cast("string"), F.lit(""))
    return F.when(x == "backend", "decode").otherwise(F.coalesce(x, F.lit(UNLABELED)))


def metric_component(label: Column | str, worker_type: Column | str, metric: Column | str) -> Column:
    """The component of a metric's row: its label, else the worker's type, else the front end by the metric's name."""
    x, kind, m = text_or_null(label), text_or_null(worker_type), F.coalesce(as_column(metric), F.lit(""))
    front = F.when(F.greatest(*(m.startswith(p) for p in FRONTENDS)), "frontend")
    return F.coalesce(F.when(x == "backend", "decode").otherwise(x), kind, front, F.lit(UNLABELED))


def rank_label(tp: Column | str, dp: Column | str) -> Column:
    """The tensor- and data-parallel ranks that are known, as one label."""
    part = lambda mark, c: F.when(text_or_null(c).isNotNull(), F.concat(F.lit(mark), text_or_null(c)))
    return F.coalesce(F.nullif(F.concat_ws("_", part("tp", tp), part("dp", dp)), F.lit("")), F.lit("unranked"))


def rank_names(**ranks: Column | str) -> Column:
    """name=value of every rank that is known, joined by semicolons in the order given; null if none is."""
    parts = [F.when(text_or_null(c).isNotNull(), F.concat(F.lit(f"{n}="), text_or_null(c))) for n, c in ranks.items()]
    return F.nullif(F.concat_ws(";", *parts), F.lit(""))


def metric_meaning(metric: Column | str, description: Column | str) -> Column:
    """What a server metric counts: known ones by name, then configured capacities, then its own description."""
    m, d = F.coalesce(as_column(metric), F.lit("")), text_or_null(description)
    said = F.when(F.greatest(*(m.startswith(p) for p in FRONTENDS)), FRONTEND_SCOPE).when(F.coalesce(F.lower(d).contains("capacity"), F.lit(False)) | m.contains("max_num"), CAPACITY_SCOPE).otherwise(F.coalesce(d, F.lit(ANY_SCOPE)))
    for name, text in METRIC_SCOPES.items():
        said = F.when(m == name, text).otherwise(said)
    return said


def series_scope(of: Column | str) -> Column:
    """How far the values of a component's series may be taken."""
    c = as_column(of)
    own = F.concat(F.lit(SERIES_SCOPE + "; "), c, F.lit(" endpoint/rank-series scope. Values across rank exports are not summed into a worker or cluster count."))
    return F.when(c.isin("prefill", "decode"), own).otherwise(SERIES_SCOPE + "; component scope unavailable.")


def metric_scope(name: Column | str, worker: Column | str, rank: Column | str) -> Column:
    return F.concat_ws("/", as_column(name), F.coalesce(text_or_null(worker), F.lit("all")), F.coalesce(text_or_null(rank), F.lit("all")))


def joined_sorted(c: Column | str) -> Column:
    """Aggregate: distinct values in order, joined by semicolons."""
    return F.array_join(F.array_sort(F.collect_set(as_column(c))), ";")


def index_ranges(indices: Column | str) -> Column:
    """A sorted distinct int array as ranges: [1,2,3,7] gives 1-3;7."""
    xs = F.array_sort(F.array_distinct(F.filter(as_column(indices), lambda x: x.isNotNull())))
    begins = F.filter(xs, lambda x: ~F.array_contains(xs, x - 1))
    ends = F.filter(xs, lambda x: ~F.array_contains(xs, x + 1))
    show = lambda p: F.when(p["b"] == p["e"], p["b"].cast("string")).otherwise(F.concat_ws("-", p["b"].cast("string"), p["e"].cast("string")))
    return F.array_join(F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), show), ";")


def model_list(c: Column | str) -> Column:
    """A JSON list of models, or one plain name, as an array; blank gives an empty array."""
    x = text_or_null(c)
    listed = F.from_json(x, "array<string>")
    return F.when(x.isNull(), F.array().cast("array<string>")).when(x.startswith("["), F.coalesce(listed, F.array(x))).otherwise(F.array(x))


def looks_like_metric(path: Column | str) -> Column:
    """Whether a field path names a measurement."""
    return F.lower(as_column(path)).rlike(r"(latency|token|ttft|itl|duration|throughput|time|rate|length|bytes|count)")


def unit_label(unit: Column | str) -> Column:
    """Aggregate: the unit if all rows have one and the same, else each unit with its count."""
    u = as_column(unit)
    kinds = F.array_sort(F.collect_set(u))
    return F.when(F.size(kinds) <= 1, F.coalesce(F.try_element_at(kinds, F.lit(1)), F.lit("none"))).otherwise(F.array_join(kinds, ";"))
