"""Paired measurements across concurrencies or systems, and their summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracelane.functions.aggregates import exact_percentile, first_known
from tracelane.functions.coerce import ratio
from tracelane.operators import order_statistics
from tracelane.session import checkpointed


def collapse(df: DataFrame, keys: Sequence[str], medians: Sequence[str], firsts: Sequence[str] = (), order: str = "record_ordinal") -> DataFrame:
    """One row for each key: medians of numbers, first known values of attributes, and n_rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *(exact_percentile(c, 0.5).alias(c) for c in medians), *(first_known(c, order).alias(c) for c in firsts))


def against_baseline(df: DataFrame, key: Sequence[str], group: str, values: Sequence[str], preferred: int = 1, keep_self: bool = True) -> DataFrame:
    """Each row with its key's baseline (the preferred group, else the lowest) and ratios <value>_ratio to it.

    The baseline is picked by a window, so nothing is joined. keep_self: the baseline's own row stays.
    """
    w = Window.partitionBy(*key)
    best = F.min(F.struct((F.col(group) != preferred).alias("other"), F.col(group).alias("g"), *(F.col(v).alias(v) for v in values))).over(w)
    out = df.where(F.col(group).isNotNull()).withColumn("b_", best)
    out = out.withColumn(f"baseline_{group}", F.col("b_.g")).withColumns({f"baseline_{v}": F.col(f"b_.{v}") for v in values})
    out = out.withColumns({f"{v}_ratio": ratio(v, f"baseline_{v}") for v in values}).drop("b_")
    return out if keep_self else out.where(F.col(group) != F.col(f"baseline_{group}"))


def comparable(*ratios: str, low: float = 0.8, high: float = 1.25) -> Column:
    """Whether all known ratios lie within bounds; null if none is known."""
    known = F.array_compact(F.array(*(F.col(r).cast("double") for r in ratios)))
    return F.when(F.size(known) > 0, F.forall(known, lambda x: (x >= low) & (x <= high)))


def all_pairs(df: DataFrame, keys: Sequence[str], group: str, take: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Pairs of rows of one key whose groups are in order (left < right). A key has one row for each group, so pairs
    grow with the number of groups only. null_safe: null keys meet null keys."""
    left = df.select(*(F.col(k).alias(f"l_{k}") for k in keys), F.col(group).alias(f"{group}_left"), *(F.col(c).alias(f"{c}_left") for c in take))
    right = df.select(*(F.col(k).alias(f"r_{k}") for k in keys), F.col(group).alias(f"{group}_right"), *(F.col(c).alias(f"{c}_right") for c in take))
    on = F.col(f"{group}_left") < F.col(f"{group}_right")
    for k in keys:
        on = on & (F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) if null_safe else F.col(f"l_{k}") == F.col(f"r_{k}"))
    return left.join(right, on).withColumnsRenamed({f"l_{k}": k for k in keys}).drop(*(f"r_{k}" for k in keys))


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], take: Sequence[str], drop_null_keys: bool = True) -> DataFrame:
    """Rows of equal keys from two collapsed tables, values suffixed _left and _right, with the strict flags' parts."""
    a = left.select(*(F.col(k).alias(f"l_{k}") for k in keys), *(F.col(c).alias(f"{c}_left") for c in take))
    b = right.select(*(F.col(k).alias(f"r_{k}") for k in keys), *(F.col(c).alias(f"{c}_right") for c in take))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"l_{k}") == F.col(f"r_{k}") if drop_null_keys else F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")))
    return a.join(b, on).withColumnsRenamed({f"l_{k}": k for k in keys}).drop(*(f"r_{k}" for k in keys))


def strict_flags(df: DataFrame) -> DataFrame:
    """Pairs fit for comparing first-token latency (both above 0) and decoding (equal output above 1, both above 0)."""
    pos = lambda c: (F.col(f"{c}_left") > 0) & (F.col(f"{c}_right") > 0)
    same = (F.col("output_tokens_left") == F.col("output_tokens_right")) & (F.col("output_tokens_left") > 1)
    return df.withColumns({"strict_ttft": F.coalesce(pos("ttft_ms"), F.lit(False)), "strict_decode": F.coalesce(pos("itl_ms") & same, F.lit(False))})


def pair_ratios(df: DataFrame, values: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{v}_ratio": ratio(f"{v}_right", f"{v}_left") for v in values} | {f"{v}_difference": F.col(f"{v}_right") - F.col(f"{v}_left") for v in values})


def pair_summary(pairs: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Pairs, those fit for each comparison, and median ratios over the fit ones."""
    fit = {"ttft_ms": "strict_ttft", "itl_ms": "strict_decode"}
    medians = [exact_percentile(F.when(F.col(fit[v]), F.col(f"{v}_ratio")) if v in fit else F.col(f"{v}_ratio"), 0.5).alias(f"median_{v}_ratio") for v in values]
    itl = ratio(F.sum(F.when(F.col("strict_decode"), F.col("itl_ms_right") * (F.col("output_tokens_right") - 1))), F.sum(F.when(F.col("strict_decode"), F.col("output_tokens_right") - 1)))
    return pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.count_if("strict_ttft").alias("n_strict_ttft"), F.count_if("strict_decode").alias("n_strict_decode"), *medians, itl.alias("weighted_itl_right_ms"))


def key_overlap(df: DataFrame, key: str, group: str) -> DataFrame:
    """Jaccard index of the key sets of every two groups: keys are gathered by key, never by group."""
    sets = df.where(F.col(key).isNotNull() & F.col(group).isNotNull()).select(key, group).distinct()
    sizes = sets.groupBy(group).agg(F.count("*").alias("n"))
    pairs = all_pairs(sets, [key], group, []).groupBy(f"{group}_left", f"{group}_right").agg(F.count("*").alias("n_both"))
    a, b = (sizes.select(F.col(group).alias(f"{group}_{s}"), F.col("n").alias(f"n_{s}")) for s in ("left", "right"))
    listed = a.join(b, F.col(f"{group}_left") < F.col(f"{group}_right"))  # groups are few: concurrencies or systems
    out = listed.join(pairs, [f"{group}_left", f"{group}_right"], "left").na.fill(0, ["n_both"])
    return out.withColumn("jaccard", ratio("n_both", F.col("n_left") + F.col("n_right") - F.col("n_both")))


def scaling_curve(summary: DataFrame, group: str, latency: str, rate: str) -> DataFrame:
    """Each group's latency inflation, rate retention for each unit of the group, and throughput ratio, against the
    lowest group. summary holds one row for each group."""
    first = lambda c: F.first(c).over(Window.orderBy(F.col(group).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = summary.withColumns({f"base_{c}": first(c) for c in (group, latency, rate)})
    each = ratio(ratio(rate, group), ratio(f"base_{rate}", f"base_{group}"))
    return out.withColumns({"latency_inflation": ratio(latency, f"base_{latency}"), "rate_retention": each, "throughput_ratio": ratio(rate, f"base_{rate}")})


def compare_systems(a: DataFrame, b: DataFrame, key: str, metrics: Sequence[str], workers: tuple[int, int] = (1, 1)) -> DataFrame:
    """metric, left, right, ratio and worker_normalized_ratio of two systems' summaries by key."""
    long = lambda df, name: df.unpivot(key, [*metrics], "metric", name)
    cast = lambda df: df.select(key, *(F.col(m).cast("double").alias(m) for m in metrics))
    out = long(cast(a), "left_value").join(long(cast(b), "right_value"), [key, "metric"])
    return out.withColumns({"ratio": ratio("right_value", "left_value"), "worker_normalized_ratio": ratio(F.col("right_value") / workers[1], F.col("left_value") / workers[0])})


#: Draws that a task sorts at a time.
DRAWS = 1 << 20


def _drawn(clusters: DataFrame, keys: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """keys, i_ and reps: the replicates that drew cluster i_ of c_, in lists that together hold every draw once. Slot
    i_ of replicate rep draws the first four bytes of md5(seed|keys|rep|slot), modulo c_. About a million draws are
    sorted at a time, so that what is shuffled is lists, not draws."""
    schema = T.StructType([*(clusters.schema[k] for k in keys), T.StructField("i_", T.LongType()), T.StructField("reps", T.ArrayType(T.IntegerType()))])
    want, n = to_arrow_schema(schema), len(keys)
    middles = [b"|%d|" % rep for rep in range(replicates)]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, DRAWS // replicates)
        for part in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            heads, slots, sizes = (part.column(n + k).to_pylist() for k in range(3))
            ends = zip([h.encode() for h in heads], [b"%d" % slot for slot in slots], strict=True)
            words = b"".join([md5(head + m + slot).digest()[:4] for head, slot in ends for m in middles])
            groups = {h: row for row, h in enumerate(heads)}  # of each group one row, which has its keys
            group = np.repeat([groups[h] for h in heads], replicates)
            drawn = np.frombuffer(words, ">u4").astype(np.int64) % np.repeat(sizes, replicates)
            order = np.lexsort((drawn, group))
            group, drawn = group[order], drawn[order]
            first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (drawn[1:] != drawn[:-1])])
            reps = np.tile(np.arange(replicates, dtype=np.int32), part.num_rows)[order]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(reps)].astype(np.int32)), pa.array(reps), type=want.field("reps").type)
            own = part.take(pa.array(group[first]))
            yield pa.RecordBatch.from_arrays([*(own.column(k).cast(want.field(k).type) for k in range(n)), pa.array(drawn[first]), lists], schema=want)

    head = F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))
    return clusters.select(*keys, head.alias("head_"), "i_", "c_").mapInArrow(draw, schema)


def bootstrap_ratio(df: DataFrame, cluster: str, value: str, keys: Sequence[str], replicates: int = 1000, seed: int = 7, width: int = 256) -> DataFrame:
    """Median ratio for each key with a 95 % interval from resampling whole clusters with replacement.

    Draws are hashes of (seed, key, replicate, slot), so they are the same on every cluster and in SQL. Each cluster
    gets one list of the replicates that drew it, once for each draw. Its rows are counted by value range first: sums
    by replicate and range tell which range holds a replicate's median, and only the values of that range are then
    counted one by one. What is shuffled for a replicate depends on the ranges (``width`` values or more each), not on
    the rows. Null and non-positive ratios go first, and so do rows without a cluster.
    """
    keys = list(keys)
    rows = df.where((F.col(value) > 0) & F.col(cluster).isNotNull()).select(*keys, cluster, F.col(value).cast("double").alias("v_"))
    cells = checkpointed(rows.groupBy(*keys, cluster, "v_").agg(F.count("*").alias("n_")))
    clusters = order_statistics.placed(cells.select(*keys, cluster).distinct(), keys, cluster).select(*keys, cluster, F.col("before_n").alias("i_"), F.col("all_n").alias("c_"))
    cells = order_statistics.with_ranges(cells, cells.select(*keys, "v_").distinct(), keys, "v_", width)

    # few small rows become many: they are dealt before, which AQE would take back without a number
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = _drawn(clusters.repartition(tasks, *keys, "i_"), keys, replicates, seed).groupBy(*keys, "i_").agg(F.flatten(F.collect_list("reps")).alias("reps"))
    once = F.array(F.lit(-1))  # replicate -1 is the table itself
    lists = clusters.join(lists, [*keys, "i_"], "left").select(*keys, cluster, F.concat(once, F.coalesce("reps", F.array().cast("array<int>"))).alias("reps"))
    lists = checkpointed(lists)

    by_range = cells.groupBy(*keys, cluster, "range_").agg(F.sum("n_").alias("n_")).repartition(tasks, *keys, cluster).join(lists, [*keys, cluster])
    sums = by_range.select(*keys, "range_", "n_", F.explode("reps").alias("rep")).groupBy(*keys, "rep", "range_").agg(F.sum("n_").alias("n_"))
    each = Window.partitionBy(*keys, "rep")
    sums = sums.withColumns({"first_": F.sum("n_").over(each.orderBy("range_")) - F.col("n_"), "all_": F.sum("n_").over(each)})
    low, high = F.floor((F.col("all_") - 1) / 2), F.ceil((F.col("all_") - 1) / 2)
    holds = lambda place: (F.col("first_") <= place) & (place < F.col("first_") + F.col("n_"))
    middle = checkpointed(sums.where(holds(low) | holds(high)).select(*keys, "rep", "range_", "first_", "all_"))

    near = cells.join(middle.select(*keys, "range_").distinct(), [*keys, "range_"], "left_semi").repartition(tasks, *keys, cluster).join(lists, [*keys, cluster])
    near = near.select(*keys, "range_", "v_", "n_", F.explode("reps").alias("rep")).groupBy(*keys, "rep", "range_", "v_").agg(F.sum("n_").alias("n_"))
    upto = F.sum("n_").over(Window.partitionBy(*keys, "rep", "range_").orderBy("v_"))
    near = near.join(middle, [*keys, "rep", "range_"]).withColumn("first_", F.col("first_") + upto - F.col("n_"))
    at = lambda place: F.max(F.when(holds(place), F.col("v_")))
    medians = near.groupBy(*keys, "rep").agg(((at(low) + at(high)) / 2).alias("m_"), F.max("all_").alias("all_"))
    whole = F.col("rep") == -1
    limits = F.percentile(F.when(~whole, F.col("m_")), F.array(F.lit(0.025), F.lit(0.975)))
    out = medians.groupBy(*keys).agg(F.max(F.when(whole, F.col("all_"))).alias("n_rows"), F.max(F.when(whole, F.col("m_"))).alias("median_ratio"), limits.alias("q_"))
    out = out.join(lists.groupBy(*keys).agg(F.count("*").alias("n_clusters")), keys)
    return out.select(*keys, "n_rows", "n_clusters", "median_ratio", F.col("q_")[0].alias("ci_low"), F.col("q_")[1].alias("ci_high"))
