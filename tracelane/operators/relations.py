"""Rank correlations, lags and p-values."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelane.functions.aggregates import correlation
from tracelane.operators.order_statistics import rank_correlation


def spearman_all_and_each(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """rho over all rows (key 'all') and for each key."""
    each = df.select(F.coalesce(F.col(key).cast("string"), F.lit("unknown")).alias("scope"), x, y)
    whole = df.select(F.lit("all").alias("scope"), x, y)
    return rank_correlation(whole.unionByName(each), ["scope"], x, y)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_two_sided(t: float, freedom: float) -> float:
    """Two-sided p of Student's t."""
    x = freedom / (freedom + t * t)
    a, b = freedom / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x > 0 else 0.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def with_p_value(df: DataFrame, rho: str = "rho", n: str = "n") -> DataFrame:
    """df with p_value of a rank correlation by the t distribution with n - 2 degrees; null where rho is."""

    @F.pandas_udf("double")
    def p(rhos: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for r, k in rhos:
            yield pd.Series([None if pd.isna(a) or pd.isna(b) or b < 3 else 0.0 if abs(a) >= 1 else t_two_sided(a * math.sqrt((b - 2) / (1 - a * a)), b - 2) for a, b in zip(r, k, strict=True)], dtype="float64")

    return df.withColumn("p_value", p(F.col(rho).cast("double"), F.col(n).cast("double")))


def best_lag(df: DataFrame, keys: Sequence[str], order: str, x: str, y: str, most: int = 5) -> DataFrame:
    """For each key the shift of y, in rows of the ordered series, with the largest |r|; of equal ones the lowest."""
    w = Window.partitionBy(*keys).orderBy(order)
    shifted = df.select(*keys, F.col(x).alias("x_"), F.array(*(F.struct(F.lit(k).alias("lag"), F.lag(y, k).over(w).alias("y_")) for k in range(-most, most + 1))).alias("all_"))
    rs = shifted.select(*keys, "x_", F.explode("all_").alias("s")).groupBy(*keys, F.col("s.lag").alias("lag")).agg(F.count_if(F.col("x_").isNotNull() & F.col("s.y_").isNotNull()).alias("n"), correlation("x_", "s.y_").alias("r"))
    known = rs.where("r is not null")
    top = Window.partitionBy(*keys).orderBy(F.round(F.abs("r"), 12).desc(), F.col("lag"))
    return known.withColumn("p_", F.row_number().over(top)).where("p_ = 1").drop("p_")
