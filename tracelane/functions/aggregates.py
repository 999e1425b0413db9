"""Aggregates with exact null and tie rules. All are plain Spark aggregates: partial sums before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelane.functions.coerce import as_column, number, ratio


def exact_percentile(c: Column | str, q: float | list[float]) -> Column:
    """Linear-interpolated percentile of finite numbers; null if there is none."""
    return F.percentile(number(c), q if isinstance(q, float) else F.array(*map(F.lit, q)))


def exact_percentiles(c: Column | str, qs: list[float]) -> list[Column]:
    """Several percentiles of one column, read from one aggregate: the values are held and sorted once."""
    every = exact_percentile(c, qs)
    return [F.try_element_at(every, F.lit(i + 1)) for i in range(len(qs))]


def sum_or_zero(c: Column | str) -> Column:
    return F.coalesce(F.sum(as_column(c)), F.lit(0))


def sum_or_null(c: Column | str) -> Column:
    return F.sum(as_column(c))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Mean of values by positive weights; null without any."""
    v, w = as_column(value).cast("double"), as_column(weight).cast("double")
    ok = v.isNotNull() & (w > 0)
    return ratio(F.sum(F.when(ok, v * w)), F.sum(F.when(ok, w)))


def weighted_fraction(condition: Column, weight: Column | str) -> Column:
    """Share of the positive weight for which a condition holds."""
    w = F.when(as_column(weight) > 0, as_column(weight).cast("double"))
    return ratio(F.sum(F.when(condition, w).otherwise(F.when(w.isNotNull(), 0.0))), F.sum(w))


def token_weighted_itl(itl: Column | str = "itl_ms", output: Column | str = "output_tokens") -> Column:
    """Inter-token latency by the tokens after the first, over rows with latency above 0 and 2 tokens or more."""
    i, o = as_column(itl), as_column(output)
    ok = (i > 0) & (o > 1)
    return ratio(F.sum(F.when(ok, i * (o - 1))), F.sum(F.when(ok, o - 1)))


def wall_seconds(start: Column | str = "start_ns", end: Column | str = "end_ns") -> Column:
    """Latest end less earliest start, each over its own known values."""
    return (F.max(as_column(end)) - F.min(as_column(start))) / F.lit(1e9)


def distinct_with_null(c: Column | str) -> Column:
    """Distinct values, null being one of them."""
    x = as_column(c)
    return F.count_distinct(x) + F.max(F.when(x.isNull(), 1).otherwise(0))


def first_known(c: Column | str, order: Column | str) -> Column:
    """The first non-null value in the given order."""
    x = as_column(c)
    return F.min_by(x, F.when(x.isNotNull(), as_column(order)))


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, quantiles: dict[str, float]) -> DataFrame:
    """For each key the lowest value whose cumulative weight reaches each share of the total: never interpolated.

    Weights are summed by value first, so a key's window holds its distinct values only.
    """
    sums = df.where((F.col(weight) > 0) & F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(F.col(weight).cast("double")).alias("w_"))
    w = Window.partitionBy(*keys)
    run = sums.withColumn("run_", F.sum("w_").over(w.orderBy(value))).withColumn("all_", F.sum("w_").over(w))
    return run.groupBy(*keys).agg(*(F.min(F.when(F.col("run_") >= F.lit(q) * F.col("all_") - F.lit(1e-9) * F.col("all_"), F.col(value))).alias(name) for name, q in quantiles.items()))


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with the average rank of value within keys."""
    ordered = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return df.withColumn(name, F.rank().over(ordered) + (F.count("*").over(ties) - 1) / 2.0)


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's r from sums; null for fewer than 3 pairs or a constant side."""
    a, b = as_column(x).cast("double"), as_column(y).cast("double")
    ok = a.isNotNull() & b.isNotNull()
    a, b = F.when(ok, a), F.when(ok, b)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= 3) & (F.count_distinct(a) > 1) & (F.count_distinct(b) > 1), ratio(F.covar_pop(a, b), spread))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n and rho: the correlation of average ranks over rows where both sides are known."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(both, keys, x, "rx_"), keys, y, "ry_")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), correlation("rx_", "ry_").alias("rho"))
