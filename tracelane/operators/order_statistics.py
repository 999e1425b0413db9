"""Ranks and quantiles of groups of any size: no group is one task's window or one aggregate's buffer.

Rows are first counted by value. A group of many distinct values is cut into value ranges: values whose hash falls in
one of d / width classes are the borders (deterministic, so that every evaluation cuts alike), at most about ``RANGES``
of them. Ranges are summed and added up, which gives each range the rows before it; within a range a window counts on.
A frequent value is one row, however often it occurs. Groups of up to ``WIDTH`` distinct values stay whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelane.functions.coerce import number

WIDTH, RANGES = 65_536, 256


def _same(keys: Sequence[str], suffix: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{k}{suffix}"))
    return out


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left with right's columns by keys, null keys meeting null keys."""
    other = right.withColumnsRenamed({k: f"{k}_r_" for k in keys})
    return left.join(other, _same(keys, "_r_"), how).drop(*(f"{k}_r_" for k in keys))


def with_ranges(df: DataFrame, counts: DataFrame, keys: Sequence[str], value: str, width: int = WIDTH) -> DataFrame:
    """df with range_, the value range of its group that a row falls in; counts holds each value of each group once."""
    sizes = counts.groupBy(*keys).agg(F.count("*").alias("d_"))
    classes = F.greatest(F.lit(width), F.expr(f"d_ div {RANGES}"))
    # a group that needs no cut has no border, and its rows stay in range 0
    large = sizes.where(F.col("d_") > width)
    borders = _joined(counts.select(*keys, value), large, keys).where(F.pmod(F.xxhash64(value), classes) == 0)
    borders = borders.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias("borders_"))
    cut = _joined(df, borders, keys, "left")
    return cut.withColumn("range_", F.coalesce(F.size(F.filter("borders_", lambda b: b < F.col(value))), F.lit(0))).drop("borders_")


def placed(df: DataFrame, keys: Sequence[str], value: str, width: int = WIDTH) -> DataFrame:
    """keys, value, n (its rows), before_n (rows of the group with a smaller value) and all_n (the group's rows with a
    value). Nulls don't count."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    cut = with_ranges(counts, counts, keys, value, width)
    sums = cut.groupBy(*keys, "range_").agg(F.sum("n").alias("sum_"))
    group = Window.partitionBy(*keys)
    sums = sums.withColumns({"first_": F.sum("sum_").over(group.orderBy("range_")) - F.col("sum_"), "all_n": F.sum("sum_").over(group)}).drop("sum_")
    within = F.sum("n").over(Window.partitionBy(*keys, "range_").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    out = _joined(cut.withColumn("within_", within), sums, [*keys, "range_"])
    return out.select(*keys, value, "n", (F.col("first_") + F.col("within_")).alias("before_n"), "all_n")


def quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], qs: Sequence[float], width: int = WIDTH) -> DataFrame:
    """keys, metric, q and value: exact quantiles, interpolated between neighbours, of every column's finite numbers; a
    group without any has null values."""
    long = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), number(c).alias("v")) for c in columns))).alias("x")).select(*keys, "x.*")
    by = [*keys, "metric"]
    at = [F.lit(float(q)) * (F.col("all_n") - 1) for q in qs]
    holds = lambda place: (F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n"))
    low = [F.max(F.when(holds(F.floor(p)), F.col("v"))).alias(f"low_{i}") for i, p in enumerate(at)]
    high = [F.max(F.when(holds(F.ceil(p)), F.col("v"))).alias(f"high_{i}") for i, p in enumerate(at)]
    part = [F.max(p - F.floor(p)).alias(f"part_{i}") for i, p in enumerate(at)]
    found = placed(long, by, "v", width).groupBy(*by).agg(*low, *high, *part)
    groups = long.select(*by).distinct()
    each = [F.struct(F.lit(float(q)).alias("q"), (F.col(f"low_{i}") * (1 - F.col(f"part_{i}")) + F.col(f"high_{i}") * F.col(f"part_{i}")).alias("value")) for i, q in enumerate(qs)]
    return _joined(groups, found, by, "left").select(*by, F.explode(F.array(*each)).alias("x")).select(*by, "x.*")


def rank_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str, width: int = WIDTH) -> DataFrame:
    """keys, n and rho: Pearson's r of average ranks over rows where both sides are known; null for fewer than 3 rows
    or a constant side. Rows of equal x and y are one weighted row."""
    keys = list(keys)
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("x_"), F.col(y).alias("y_"))
    pairs = both.groupBy(*keys, "x_", "y_").agg(F.count("*").alias("w_"))
    for side in ("x_", "y_"):  # a rank's distance from the mean rank
        away = F.col("before_n") + (F.col("n") + 1) / 2 - (F.col("all_n") + 1) / 2
        ranks = placed(both, keys, side, width).select(*keys, side, away.alias(f"away_{side}"))
        pairs = _joined(pairs, ranks, [*keys, side])
    w, a, b = (F.col(c).cast("double") for c in ("w_", "away_x_", "away_y_"))
    sums = pairs.groupBy(*keys).agg(F.sum("w_").alias("n"), F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"))
    return sums.select(*keys, "n", F.when((F.col("n") >= 3) & (F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa")) / F.sqrt(F.col("bb"))).alias("rho"))
