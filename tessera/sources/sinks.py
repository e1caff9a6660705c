"""Keyed tables: upserts, appends with new columns, and tables made if absent."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.sequences import last_per_key
from tessera.sources.files import _exists


def upserted(old: DataFrame, new: DataFrame, keys: list[str], policy: Mapping[str, str] | None = None) -> DataFrame:
    """`old` with the rows of `new` in place of those with the same key. Policies by column: `new` (default), `keep` the old value where there is
    one, `add`, `greatest`. Keys are compared with missing values equal; `new` must have a row a key. Columns of `old` alone are kept."""
    policy = policy or {}
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns], F.lit(True).alias("__o"))
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns], F.lit(True).alias("__n"))
    match = F.lit(True)
    for k in keys:
        match = match & o[f"o_{k}"].eqNullSafe(n[f"n_{k}"])
    both = o.join(n, match, "full")
    out = []
    for c in old.columns:
        if c not in new.columns:
            out.append(F.col(f"o_{c}").alias(c))
            continue
        a, b, rule = F.col(f"o_{c}"), F.col(f"n_{c}"), policy.get(c, "new")
        value = {
            "new": F.when(F.col("__n"), b).otherwise(a),
            "keep": F.coalesce(a, b),
            "add": F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if rule == "add" else None,
            "greatest": F.greatest(a, b) if rule == "greatest" else None,
        }[rule]
        out.append((F.when(F.col("__n"), b).otherwise(a) if c in keys else value).alias(c))
    return both.select(*out)


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list[str], policy: Mapping[str, str] | None = None) -> None:
    """Upsert the last row of each key by `order` into the Parquet table at `path`. The new table is written beside the old one and takes its
    place by rename, so a lost executor or driver leaves one of the two whole."""
    latest = last_per_key(new, keys, *order)
    result = upserted(spark.read.parquet(path), latest, keys, policy) if _exists(spark, path) else latest
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    result.write.parquet(aside)
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = jvm.Path(aside + "-old")
    if fs.exists(jvm.Path(path)):
        fs.rename(jvm.Path(path), old)
    fs.rename(jvm.Path(aside), jvm.Path(path))
    fs.delete(old, True)


def append(path: str, rows: DataFrame) -> None:
    """Append to a Parquet table; `read_evolved` gives missing columns as missing values."""
    rows.write.mode("append").parquet(path)


def append_run(path: str, rows: DataFrame) -> str:
    """Append the rows of a run under a new `run_id`, which is returned."""
    run = uuid.uuid4().hex
    append(path, rows.withColumn("run_id", F.lit(run)))
    return run


def read_evolved(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def ensure_table(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table at `path` if there is none."""
    if not _exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)
