"""Sessions, tables by name, and tables staged in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[tuple[SparkSession, str]] = []

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("tessera").config("spark.driver.memory", memory)
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or in its absence a new one, which only a session on one machine may have."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(shutil.rmtree, at, True)
    return at


def staged(df: DataFrame, label: str = "stage", partition_by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it again.

    It cuts the lineage and is computed once; a lost executor costs no more than the tasks that read it. Parquet keeps it
    smaller than a checkpoint of rows. The files live until the session ends, or until `dropped` if nothing reads them any more.
    """
    spark = df.sparkSession
    at = os.path.join(shared_dir(spark), f"tessera-{label}-{uuid.uuid4().hex}")
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(at)
    if not _STAGED:
        atexit.register(_clear)
    _STAGED.append((spark, at))
    out = spark.read.schema(df.schema).parquet(at)
    out._staged_at = at
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no plan reads any more, as the rounds of an iteration but the last."""
    for df in tables:
        at = getattr(df, "_staged_at", None)
        if at:
            _delete(df.sparkSession, at)
            _STAGED[:] = [x for x in _STAGED if x[1] != at]


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _clear() -> None:
    for spark, at in _STAGED:
        try:
            _delete(spark, at)
        except Exception:  # the session, or the folder, is gone  # noqa: BLE001
            pass
    _STAGED.clear()
