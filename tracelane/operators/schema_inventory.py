"""What fields loosely typed records have: paths, presence, types, ranges, units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelane.functions.coerce import canonical_name, number


def flattened(df: DataFrame, keys: Sequence[str], json: str, depth: int = 8) -> DataFrame:
    """keys, path, value and kind for every leaf of a JSON text column. Arrays stay JSON text; an empty object has no
    path; unreadable text gives no row. A level of nesting is one projection, objects below depth stay JSON text."""
    level = df.select(*keys, F.lit("").alias("path"), F.try_parse_json(F.col(json)).alias("v")).where("v is not null")
    out = None
    for k in range(depth):
        kids = level.select(*keys, F.col("path").alias("above"), F.expr("explode_outer(cast(try_variant_get(v, '$', 'map<string,variant>') as map<string,variant>))")).where("key is not null")
        kids = kids.select(*keys, F.concat(F.when(F.col("above") != "", F.concat("above", F.lit("."))).otherwise(""), "key").alias("path"), F.col("value").alias("v"))
        kind = F.expr("schema_of_variant(v)")
        kids = kids.withColumn("kind", F.when(F.expr("is_variant_null(v)"), "null").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise(F.lower(kind)))
        leaf = kids if k == depth - 1 else kids.where("kind <> 'object'")
        leaf = leaf.select(*keys, "path", F.when(F.col("kind").isin("array", "object"), F.expr("to_json(v)")).otherwise(F.expr("try_variant_get(v, '$', 'string')")).alias("value"), "kind")
        out = leaf if out is None else out.unionByName(leaf)
        level = kids.where("kind = 'object'").select(*keys, "path", "v")
    return out


def lookup(flat: DataFrame, keys: Sequence[str], aliases: Sequence[str]) -> DataFrame:
    """For each record the value found under the first alias that fits, and its path. An alias fits a whole path, else
    the last name of a path, else the name before a closing .value or .val, all without case and punctuation."""
    tail = F.element_at(F.split("path", r"\."), -1)
    parent = F.when(F.lower(tail).isin("value", "val"), F.try_element_at(F.split("path", r"\."), F.lit(-2)))
    spec = F.array(*(F.struct(F.lit(i).alias("i"), F.lit("".join(c for c in a.lower() if c.isalnum())).alias("name")) for i, a in enumerate(aliases)))
    cand = flat.withColumn("a_", F.explode(spec)).withColumn("tier_", F.when(canonical_name("path") == F.col("a_.name"), 0).when(canonical_name(tail) == F.col("a_.name"), 1).when(canonical_name(parent) == F.col("a_.name"), 2))
    cand = cand.where("tier_ is not null")
    return cand.groupBy(*keys).agg(F.min_by(F.struct("value", "path"), F.struct("a_.i", "tier_", "path")).alias("m_")).select(*keys, F.col("m_.value").alias("value"), F.col("m_.path").alias("path"))


def inventory(flat: DataFrame, n_records: int | F.Column) -> DataFrame:
    """For each path: records that have it, share that lack it or hold null, kinds, numeric range, units of a sibling
    .unit with their counts where they are mixed."""
    n = F.lit(n_records) if isinstance(n_records, int) else n_records
    base = flat.groupBy("path").agg(
        F.count("*").alias("n_present"), F.count_if(F.col("kind") == "null").alias("n_null"), F.array_join(F.array_sort(F.collect_set("kind")), ";").alias("kinds"),
        F.min(F.when(~F.col("kind").isin("array", "object", "null"), number("value"))).alias("min_value"), F.max(F.when(~F.col("kind").isin("array", "object", "null"), number("value"))).alias("max_value"),
    )
    units = flat.where(F.lower("path").endswith(".unit")).groupBy(F.regexp_replace("path", r"(?i)\.unit$", "").alias("metric_key"), "value").agg(F.count("*").alias("n"))
    units = units.groupBy("metric_key").agg(F.when(F.count("*") == 1, F.max("value")).otherwise(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "value", "n"))), ";")).alias("units"))
    key = F.regexp_replace("path", r"(?i)\.(value|val|unit)$", "")
    out = base.withColumn("metric_key", key).join(units, "metric_key", "left")
    return out.withColumn("null_rate", 1 - (F.col("n_present") - F.col("n_null")) / n)
