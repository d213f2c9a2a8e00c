"""Session helpers: shipping the package, staging tables, checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["broadcast_if_small", "hot_join", "prepare", "ship", "spread", "stage", "stage_dir", "table"]

_SHIPPED: set[str] = set()
#: Rows per Arrow batch where the session still has Spark's default of 10,000: pages are long.
ARROW_ROWS = "1000"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="folio-ship-")) / "folio.zip"  # read by the driver's file server only
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path("folio") / path.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package and bound the size of Arrow batches."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, ARROW_ROWS)
    return spark


def stage_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, one is set for a session on a single machine (as in tests); a cluster's executors share
    no local folder, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = java.get() if java.isDefined() else None
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder there that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="folio-stage-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors cost nothing.

    The files are deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` if it has at most ``max_rows`` rows, else ``df``: the join then shuffles.

    Counts with a limit, so a large side is never read whole for the check.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def hot_join(rows: DataFrame, facts: DataFrame, keys: list[str], by: str, max_rows: int = 100_000, salts: int | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` (few rows for each of ``keys``), where one key may hold a large part of ``rows``.

    Up to ``max_rows`` facts are broadcast; beyond, both sides are shuffled by the keys and a salt (a hash of the
    column ``by`` of ``rows``), so that a hot key is dealt out to ``salts`` tasks: 16, or one for each million rows.
    Both ways give the same rows.
    """
    if facts.limit(max_rows + 1).count() <= max_rows:
        return rows.join(F.broadcast(facts), keys, how)
    salts = salts or max(16, rows.count() // 1_000_000)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return salted.join(facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, "__salt"], how).drop("__salt")


def spread(df: DataFrame) -> DataFrame:
    """A scan that its files split into fewer tasks than there are cores is dealt out to all of them before work in Python.

    Only how rows are laid out changes; a scan with enough tasks, and whatever already has a shuffle, is left as it is.
    """
    cores = max(2, df.sparkSession.sparkContext.defaultParallelism)
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in str(plan.nodeName()) or plan.execute().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
