"""Front-end logs: which worker served a request, how long it queued, and the load it met there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelane.functions.coerce import ratio
from tracelane.functions.text import completion, line_stamp, queue_wait
from tracelane.operators.intervals import load_summary, state_intervals


FRONTEND = r"(^|/)worker-\d+_frontend_\d+\.out$"


def _place(lines: DataFrame) -> list[Column]:
    """file and line of a log line, where lines has member and line_no."""
    known = {"member": "string", "line_no": "bigint"}
    return [(F.col(c) if c in lines.columns else F.lit(None).cast(t)).alias(c) for c, t in known.items()]


def completions(lines: DataFrame, line: str = "line", strict: bool = False) -> DataFrame:
    """router_request_id, x_request_id, prefill_worker, decode_worker, completed_at, routing_source_file and
    routing_source_line of completion lines. A client's id or a router's id that several lines name is left out, since it can't tell a
    request's workers; strict: it is an error. lines with a column member: front-end logs only count."""
    logs = lines.where(F.col("member").rlike(FRONTEND)) if "member" in lines.columns else lines
    c = logs.select(completion(line).alias("c"), line_stamp(line).alias("completed_at"), *_place(lines)).where("c is not null")
    c = c.select("c.*", "completed_at", F.col("member").alias("routing_source_file"), F.col("line_no").alias("routing_source_line"))
    n = lambda key: F.count("*").over(Window.partitionBy(key))
    c = c.withColumns({"n_": F.greatest(n("x_request_id"), n("router_request_id"))})
    if strict:
        return c.withColumn("x_request_id", F.when(F.col("n_") > 1, F.raise_error(F.concat(F.lit("several completions of "), "x_request_id"))).otherwise(F.col("x_request_id"))).drop("n_")
    return c.where("n_ = 1").drop("n_")


def checkpoints(lines: DataFrame, line: str = "line") -> DataFrame:
    """Queue checkpoints of each router's id: count, shortest, longest and first wait, and where the first one stands."""
    logs = lines.where(F.col("member").rlike(FRONTEND)) if "member" in lines.columns else lines
    q = logs.select(queue_wait(line).alias("q"), line_stamp(line).alias("at"), *_place(lines)).where("q is not null").select("q.*", "at", "member", "line_no")
    first = F.min_by(F.struct("wait_ms", "member", "line_no"), F.struct("at", "member", "line_no", "wait_ms"))
    out = q.groupBy("router_request_id").agg(F.count("*").alias("n_checkpoints"), F.min("wait_ms").alias("min_wait_ms"), F.max("wait_ms").alias("max_wait_ms"), first.alias("f_"))
    return out.select("router_request_id", "n_checkpoints", "min_wait_ms", "max_wait_ms", F.col("f_.wait_ms").alias("first_wait_ms"), F.col("f_.member").alias("queue_checkpoint_source_file"), F.col("f_.line_no").alias("queue_checkpoint_source_line"))


def routes(lines: DataFrame, line: str = "line", strict: bool = False) -> DataFrame:
    """Completions with the checkpoints of their router's id: the router's id is the bridge between the client's id and
    a wait, and a completion without a checkpoint has no wait, not one of zero."""
    return completions(lines, line, strict).join(checkpoints(lines, line), "router_request_id", "left")


def routed(df: DataFrame, lines: DataFrame, key: str = "x_request_id", line: str = "line", strict: bool = False) -> DataFrame:
    """df with each request's workers and queue checkpoints and routing_match_status (exact or unmatched); a request
    without a completion keeps nulls."""
    found = routes(lines, line, strict).withColumnRenamed("x_request_id", "c_")
    out = df.join(found, F.col(key) == F.col("c_"), "left").drop("c_")
    exact = F.col("prefill_worker").isNotNull() & F.col("decode_worker").isNotNull()
    return out.withColumn("routing_match_status", F.when(exact, "exact").otherwise("unmatched"))


def attach_by_ordinal(df: DataFrame, raw: DataFrame, ordinal: str, take: Sequence[str], check: tuple[str, str] | None = None, limit_ns: int = 0) -> DataFrame:
    """df with columns of the raw row of the same ordinal; check: two time columns that must agree within limit_ns, or
    the row is an error."""
    right = raw.select(F.col(ordinal).alias("o_"), *take, *([F.col(check[1]).alias("t_")] if check else []))
    out = df.join(right, F.col(ordinal) == F.col("o_"), "left").drop("o_")
    if check:
        far = F.abs(F.col(check[0]) - F.col("t_")) > limit_ns
        first = take[0]
        out = out.withColumn(first, F.when(far, F.raise_error(F.concat(F.lit("times differ at ordinal "), F.col(ordinal).cast("string")))).otherwise(F.col(first))).drop("t_")
    return out


def routing_share(df: DataFrame, worker: str) -> DataFrame:
    """Each worker's requests, their share, and the load in flight there."""
    n = df.groupBy(worker).agg(F.count("*").alias("n_requests"))
    n = n.withColumn("share", ratio("n_requests", F.sum("n_requests").over(Window.partitionBy(F.lit(1)))))  # one row for each worker
    load = load_summary(state_intervals(df, [worker]), [worker], thresholds=())
    return n.join(load, worker, "left")


def counter_summary(counters: DataFrame, names: Sequence[str]) -> DataFrame:
    """The largest value of each named counter among observations; configured limits don't count, and a counter that
    was never observed is Unknown, not zero; others are Evidence. counters: name, value, observed."""
    seen = counters.where("observed").groupBy("name").agg(F.max("value").alias("largest"), F.count("*").alias("n"))
    wanted = counters.sparkSession.createDataFrame([(n,) for n in names], "name string")
    out = wanted.join(seen, "name", "left").na.fill(0, ["n"])
    return out.withColumn("status", F.when(F.col("largest").isNull(), "Unknown").otherwise("Evidence"))
