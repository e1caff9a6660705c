"""Operators on rows in an order: first and last, running totals, streaks, steps and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.prefix import running_max_before, running_sum

LARGE = 5_000_000  # rows of a key that one task may sort


def _one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def last_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key; missing orders come first."""
    return _one(df, keys, [F.desc_nulls_last(c) for c in order])


def first_per_key(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return _one(df, keys, [F.asc_nulls_first(c) for c in order])


def _large(df: DataFrame, keys: list[str]) -> bool:
    """Whether a key has more rows than one task should sort; both ways of going on give the same."""
    most = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) > LARGE


def _grouped(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("__key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, ceiling: float | None = None) -> DataFrame:
    """`df` with `running` and, if a ceiling is given, `over`: whether the total with this row is strictly above it. A key with more than `LARGE` rows is spread over tasks
    by prefix sums, for which the values must be whole numbers and the order must name a row."""
    if dict(df.dtypes)[value] in ("int", "bigint", "smallint", "tinyint") and _large(df, keys):
        out = running_sum(_grouped(df, keys), "__key", order, value, "running").drop("__key")
    else:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        out = df.withColumn("running", F.sum(F.coalesce(value, F.lit(0))).over(w))
    return out if ceiling is None else out.withColumn("over", F.col("running") > ceiling)


def streaks(df: DataFrame, keys: list[str], order: list[str], failed: Column) -> DataFrame:
    """`df` with `streak`, the number of failures in a row up to this row, 0 at a success: successes open the islands. A key with more than `LARGE` rows is spread over
    tasks: its failures so far, less those up to the last success before."""
    own = df.withColumn("__f", F.coalesce(failed, F.lit(False)).cast("int"))
    if _large(df, keys):
        total = running_sum(_grouped(own, keys), "__key", order, "__f", "__n")
        total = running_max_before(total.withColumn("__s", F.when(F.col("__f") == 0, F.col("__n"))), "__key", order, "__s", "__m")
        streak = F.when(F.col("__f") == 0, F.lit(0)).otherwise(F.col("__n") - F.coalesce("__m", F.lit(0))).cast("bigint")
        return total.withColumn("streak", streak).drop("__f", "__key", "__n", "__s", "__m")
    w = Window.partitionBy(*keys).orderBy(*order)
    own = own.withColumn("__island", F.sum(1 - F.col("__f")).over(w))
    inner = Window.partitionBy(*keys, "__island").orderBy(*order)
    return own.withColumn("streak", F.sum("__f").over(inner)).drop("__f", "__island")


def step_changes(df: DataFrame, keys: list[str], order: list[str], step: str) -> DataFrame:
    """The rows whose step is greater than every step before them. A key with more than `LARGE` rows is spread over tasks by running maxima."""
    if _large(df, keys):
        own = running_max_before(_grouped(df, keys).withColumn("__v", F.col(step)), "__key", order, "__v", "__b").drop("__key", "__v")
    else:
        own = df.withColumn("__b", F.max(step).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    return own.filter(F.col("__b").isNull() & F.col(step).isNotNull() | (F.col(step) > F.col("__b"))).drop("__b")


def gaps(df: DataFrame, keys: list[str], start: str, end: str, first: int = 1) -> DataFrame:
    """`df` with `gap_start` and `gap_end`, the lines between the end of the row before (or the first line) and this row's start; `gap` is their number."""
    before = F.coalesce(F.lag(end).over(Window.partitionBy(*keys).orderBy(start, end)), F.lit(first - 1))
    return df.withColumn("gap_start", before + 1).withColumn("gap_end", F.col(start) - 1).withColumn("gap", F.greatest(F.col(start) - before - 1, F.lit(0)))


def top_per_group(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group, pruned before the shuffle."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")


def segments(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files (file_path, content) cut along their chunks (file_path, start_line, end_line): rows (file_path, pos, kind, first, last, content) of the `preamble` before the
    first chunk, a `section` for each chunk with the lines between it and the one before, and the `epilogue` after the last. Segments of blanks are left out, pos
    counts those that stay from 0. A file without chunks is one preamble, also if blank. A file's chunks are one row's work."""
    own = chunks.filter("start_line is not null and end_line is not null").groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line"))).alias("c"))
    known = lines.select("file_path", F.split("content", "\n").alias("l")).join(own, "file_path", "left").withColumn("n", F.size("l"))

    def cut(kind: str, first: Column, last: Column) -> Column:
        last = F.least(last, F.col("n"))
        return F.struct(F.lit(kind).alias("kind"), first.alias("first"), last.alias("last"), F.when(last >= first, F.array_join(F.slice("l", first, last - first + 1), "\n")).otherwise("").alias("content"))

    sections = F.transform("c", lambda x, i: cut("section", F.when(i == 0, x["start_line"]).otherwise(F.get("c", i - 1)["end_line"] + 1), x["end_line"]))
    head, tail = cut("preamble", F.lit(1), F.element_at("c", 1)["start_line"] - 1), cut("epilogue", F.element_at("c", -1)["end_line"] + 1, F.col("n"))
    kept = F.filter(F.concat(F.array(head), sections, F.array(tail)), lambda x: F.trim(F.translate(x["content"], "\t\r\n\f", "    ")) != "")
    out = known.select("file_path", F.posexplode(F.when(F.col("c").isNull(), F.array(cut("preamble", F.lit(1), F.col("n")))).otherwise(kept)).alias("pos", "x"))
    return out.select("file_path", "pos", "x.kind", "x.first", "x.last", "x.content")
