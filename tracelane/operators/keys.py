"""Key rules: unique keys, one row per key, conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def only_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is complete and belongs to no other row: all rows of an ambiguous key go."""
    known = df.na.drop(subset=list(keys))
    single = known.groupBy(*keys).agg(F.count("*").alias("n_")).where("n_ = 1").drop("n_")
    return known.join(single, list(keys), "left_semi")


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() if isinstance(c, str) else c.desc() for c in order))
    return df.withColumn("r_", F.row_number().over(w)).where("r_ = 1").drop("r_")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several rows have, with how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def conflicts(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose rows disagree in the columns, with the number of versions."""
    return df.groupBy(key).agg(F.count_distinct(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("versions")).where("versions > 1")


def require(df: DataFrame, what: str) -> None:
    """ValueError naming what is wrong if df has a row."""
    found = df.limit(3).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "repeated key") -> DataFrame:
    require(repeated_keys(df, keys), what)
    return df


def row_counts(df: DataFrame, expected: dict[str, tuple[Column, int]]) -> DataFrame:
    """check, expected, actual and passed for named conditions that a known number of rows should meet."""
    seen = df.agg(*(F.count_if(c).alias(n) for n, (c, _) in expected.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.lit(e).cast("long").alias("expected"), F.col(n).alias("actual")) for n, (_, e) in expected.items())))
    return seen.select(rows.alias("x")).select("x.*", (F.col("x.expected") == F.col("x.actual")).alias("passed"))
