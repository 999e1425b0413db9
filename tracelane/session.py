"""Sessions with the defaults that the queries expect, and shipping of the package to executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "8m"
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; conf: more settings, with __ for dots."""
    builder = SparkSession.builder.appName("tracelane").config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application, and keep Arrow batches small, so that a
    Python worker and the JVM hold little of a table of long texts at a time."""
    batch = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    if batch.strip("b") in ("64m", str(64 << 20), "-1"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "_tracelane_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tracelane-")) / "tracelane.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    context.addPyFile(str(target))
    context._tracelane_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where the session has none, a local one is
    set if Spark runs in one process (tests); on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tracelane-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, for a result that several branches of a plan read."""
    path = new_folder(df.sparkSession, "checkpoint")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
