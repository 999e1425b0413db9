"""Text lines with exact line numbers, JSON lines with their faults, evidence in text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str | list[str], recursive: bool = False, glob: str | None = None) -> DataFrame:
    """file_path, line_no (from 1) and value of every line. Files are read in splits; the lines of each split are
    counted, and a line's number is its place in the split plus the lines of the splits before, so no file is read by
    one task. Compressed files, which can't be split, are one split."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("at_"), F.monotonically_increasing_id().alias("id_"), "value")
    splits = raw.groupBy("file_path", "at_").agg(F.min("id_").alias("first_"), F.count("*").alias("n_"))
    before = Window.partitionBy("file_path").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before_", F.coalesce(F.sum("n_").over(before), F.lit(0)))
    out = raw.join(F.broadcast(splits), ["file_path", "at_"])  # a few numbers for each split; no line is shuffled
    return out.select("file_path", (F.col("id_") - F.col("first_") + F.col("before_") + 1).alias("line_no"), "value")


def json_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """lines that aren't blank, with record (variant) and issue: malformed_json, not_an_object or null. strict: a line
    with an issue is an error that names its place."""
    out = lines.where(F.trim("value") != "").withColumn("record", F.try_parse_json("value"))
    issue = F.when(F.col("record").isNull(), "malformed_json").when(~F.col("value").rlike(r"^\s*\{"), "not_an_object")
    out = out.withColumn("issue", issue)
    if strict:
        where = F.concat(F.col("issue"), F.lit(" at "), *( [F.col("file_path"), F.lit(":"), F.col("line_no").cast("string")] if "line_no" in lines.columns else [F.substring("value", 1, 80)]))
        out = out.withColumn("issue", F.when(F.col("issue").isNotNull(), F.raise_error(where).cast("string")))
    return out


def good_records(lines: DataFrame, bad: Observation | None = None) -> DataFrame:
    """The lines that are JSON objects. bad: counts the others on the way, as n."""
    out = json_lines(lines)
    out = out.observe(bad, F.count_if(F.col("issue").isNotNull()).alias("n")) if bad is not None else out
    return out.where("issue is null").drop("issue")


def issues(lines: DataFrame) -> DataFrame:
    return json_lines(lines).where("issue is not null").drop("record")


def evidence(lines: DataFrame, patterns: dict[str, str], key: str = "file_path") -> DataFrame:
    """For each named pattern (plain text) the first line that holds it, by key and line_no, or status not_found.

    The patterns are a fixed short list, tested within one scan of the lines.
    """
    hits = F.filter(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("text")) for n, p in patterns.items())), lambda x: F.col("value").contains(x["text"]))
    place = F.struct(key, "line_no")
    found = lines.select(place.alias("place"), "value", F.explode(hits).alias("x")).groupBy("x.name").agg(F.min("place").alias("place"), F.min_by("value", "place").alias("line"))
    wanted = lines.sparkSession.createDataFrame([(n, p) for n, p in patterns.items()], "name string, pattern string")
    out = wanted.join(found, "name", "left")
    return out.select("name", "pattern", F.when(F.col("line").isNull(), "not_found").otherwise("found").alias("status"), F.col(f"place.{key}").alias(key), F.col("place.line_no").alias("line_no"), "line")


def first_field(record: Column | str, paths: Sequence[str], kind: str = "string") -> Column:
    r = F.col(record) if isinstance(record, str) else record
    return F.coalesce(*(F.try_variant_get(r, f"$.{p}", kind) for p in paths))
