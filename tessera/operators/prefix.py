"""Running sums and maxima within groups that may be larger than a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import staged


def running_sum(df: DataFrame, group: str, order: list[str], value: str, out: str = "upto") -> DataFrame:
    """`df` with `out`, the sum of `value` in the group up to and with the row in the order of `order`, which must name a row.

    Rows are range-partitioned by group and order, summed within partitions, and shifted by the sums of the partitions before, so a
    group of any size is spread over tasks. A missing value counts as 0; rows with a missing group form a group. The inputs' columns
    may have any names except `__part` and `__x`.
    """
    return _running(df, group, order, value, out, False)


def running_max_before(df: DataFrame, group: str, order: list[str], value: str, out: str = "before") -> DataFrame:
    """`df` with `out`, the greatest number `value` of the group before the row, missing if there is none; otherwise as `running_sum`."""
    return _running(df.withColumn(value, F.col(value).cast("double")), group, order, value, out, True)


def _running(df: DataFrame, group: str, order: list[str], value: str, out: str, greatest: bool) -> DataFrame:
    names = df.columns
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    at_group, at_value = names.index(group), names.index(value)
    none = -np.inf if greatest else 0
    kind, arrow = (T.DoubleType(), np.float64) if greatest else (T.LongType(), np.int64)

    def local(batches):
        """Within the partition: the running value up to the row, and without it."""
        from pyspark import TaskContext

        part, carried = TaskContext.get().partitionId(), {}
        for b in batches:
            keys = b.column(at_group).dictionary_encode(null_encoding="encode")
            codes, n = keys.indices.to_numpy(), b.column(at_value).fill_null(none).to_numpy(zero_copy_only=False).astype(arrow)
            upto, before = np.full(len(b), none, arrow), np.full(len(b), none, arrow)
            order_ = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order_])) + 1
            for at in np.split(order_, cuts) if len(b) else []:
                name = keys.dictionary[int(codes[at[0]])].as_py()
                had = carried.get(name, none)
                own = np.maximum(np.maximum.accumulate(n[at]), had) if greatest else np.cumsum(n[at]) + had
                upto[at], before[at[1:]], before[at[0]] = own, own[:-1], had
                carried[name] = own[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(upto), pa.array(before), pa.array(np.full(len(b), part))], names=[*names, out, "__x", "__part"])

    schema = T.StructType([*df.schema.fields, T.StructField(out, kind), T.StructField("__x", kind), T.StructField("__part", T.LongType())])
    cut = staged(ranged.mapInArrow(local, schema), "sums")
    sums = cut.groupBy(group, "__part").agg(F.max(out).alias("__s"))  # a row for each group and partition it touches
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as (group, partition) pairs: groups that lie within one partition need no shift.
    shift = (F.max("__s") if greatest else F.sum("__s")).over(before)
    offsets = sums.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), shift.alias("__before")).filter("__before is not null")
    joined = cut.join(offsets, cut[group].eqNullSafe(offsets["__g"]) & (cut["__part"] == offsets["__p"]), "left")
    if greatest:
        top = F.greatest("__x", "__before")
        return joined.select(*[cut[c] for c in names], F.when(top > -np.inf, top).alias(out))
    return joined.select(*[cut[c] for c in names], (F.col(out) + F.coalesce("__before", F.lit(0))).alias(out))
