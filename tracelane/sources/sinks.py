"""Table sinks: typed, atomic, never empty by accident."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df cast to the schema, missing columns null, others dropped; NaN and infinite doubles become null."""
    have = {c.lower() for c in df.columns}
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`").try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"{source} could not be renamed to {target}")


def _remove(fs, path) -> None:
    if fs.exists(path) and not fs.delete(path, True):
        raise OSError(f"{path} could not be deleted")


def _places(spark: SparkSession, path: str):
    """The file system, and a swap's folders: the table, the finished new one and the one that was there."""
    path = path.rstrip("/")
    (fs, table), (_, new), (_, old) = (_hadoop(spark, path + suffix) for suffix in ("", ".swap-new", ".swap-old"))
    return fs, table, new, old


def recover(spark: SparkSession, path: str) -> None:
    """Complete a swap that was cut short. A table beside the target is complete from the moment that it has the name
    .swap-new, so from then on it is the table: the old one goes aside, the new one takes its name, the old one goes."""
    fs, table, new, old = _places(spark, path)
    if fs.exists(new):
        if fs.exists(table):
            _remove(fs, old)
            _rename(fs, table, old)
        _rename(fs, new, table)
    elif fs.exists(old) and not fs.exists(table):
        _rename(fs, old, table)
    _remove(fs, old)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at path, also while a swap is cut short: the new one if it is complete, else the one that was there."""
    fs, table, new, old = _places(spark, path)
    return spark.read.parquet(str(next((p for p in (new, table, old) if fs.exists(p)), table)))


def write_parquet(df: DataFrame, path: str, schema: T.StructType | None = None) -> None:
    """Write beside the target, then swap by renaming. A failed write leaves the table that was there; a swap that
    fails on its way leaves a table that read_table reads and that recover, or the next write, completes. One writer
    at a time."""
    spark = df.sparkSession
    recover(spark, path)
    building = f"{path.rstrip('/')}.building-{uuid.uuid4().hex[:8]}"
    fs, made = _hadoop(spark, building)
    try:
        (conformed(df, schema) if schema else df).write.option("compression", "zstd").parquet(building)
    except Exception:
        fs.delete(made, True)
        raise
    _rename(fs, made, _places(spark, path)[2])
    recover(spark, path)


def write_empty(spark: SparkSession, path: str, schema: T.StructType, missing: str = "empty") -> None:
    """A valid table without rows for absent input, or an error if the policy is error."""
    if missing == "error":
        raise FileNotFoundError(f"no input for {path}")
    write_parquet(spark.createDataFrame([], schema), path)


def write_csv(df: DataFrame, path: str) -> None:
    """One write with a header in every part file; exclusions and reports are written once, not appended."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_status(spark: SparkSession, path: str, status: dict) -> None:
    """A JSON status document with sorted keys."""
    text = json.dumps(status, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_blocked(spark: SparkSession, tables: dict[str, T.StructType], folder: str, reason: str) -> None:
    """Schema-only tables with a status that says why: a blocked stage never reports zero counts."""
    for name, schema in tables.items():
        write_parquet(spark.createDataFrame([], schema), f"{folder}/{name}.parquet")
    write_status(spark, f"{folder}/status", {"status": "blocked", "reason": reason, "tables": sorted(tables)})
