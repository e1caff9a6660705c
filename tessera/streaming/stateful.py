"""Operators on streams: rows whose step rises, running totals that forget, and circuit breakers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRIP_AFTER, COOL_DOWN = 3, 300.0  # fixed values: failures in a row that open a breaker, and seconds it stays open
FORGET_AFTER = 24 * 3600  # seconds after which a total that saw nothing is forgotten


def _in_order(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(order, kind="stable")


def breaker_states(kinds: list[str], times: list[float], errors: int = 0, tripped: float | None = None) -> tuple[list[bool], int, float | None]:
    """Whether the breaker is open after each event of kind `error`, `success` or `check`, and the state that is left.

    The third error in a row opens it, later ones renew it; a success resets the count but doesn't close it; a check more than COOL_DOWN seconds after it
    opened closes it and resets the count.
    """
    out = []
    for kind, t in zip(kinds, times):
        if kind == "error":
            errors += 1
            if errors >= TRIP_AFTER:
                tripped = t
        elif kind == "success":
            errors = 0
        elif tripped is not None and t - tripped > COOL_DOWN:
            errors, tripped = 0, None
        out.append(tripped is not None)
    return out, errors, tripped


def breakers(events: DataFrame) -> DataFrame:
    """Rows (provider, ts, kind, is_open) of a stream or table of events (provider, ts, kind), each provider in the order of ts.

    On a stream, events of one micro-batch are put in order; the state of a provider is two numbers. On a table, a task reads its providers in order and
    holds a batch at a time.
    """
    own = events.select("provider", F.col("ts").cast("timestamp").alias("ts"), "kind")
    out = "provider string, ts timestamp, kind string, is_open boolean"
    if not own.isStreaming:
        own = own.withColumn("provider", F.col("provider").cast("string")).repartition("provider").sortWithinPartitions("provider", "ts", "kind")

        def through(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Rows in order, a batch at a time: of what came before, a provider's state is all that is held."""
            last, errors, tripped = "", 0, None
            for df in frames:
                flags: list[bool] = []
                seconds = df["ts"].astype("int64") / (1e9 if "ns" in str(df["ts"].dtype) else 1e6)
                for provider, own_rows in df.assign(seconds=seconds).groupby((df["provider"].fillna("\0") != df["provider"].fillna("\0").shift()).cumsum(), sort=False):
                    name = own_rows["provider"].iloc[0]
                    name = None if pd.isna(name) else name
                    if name != last:
                        errors, tripped = 0, None
                    more, errors, tripped = breaker_states(own_rows["kind"].tolist(), own_rows["seconds"].tolist(), errors, tripped)
                    flags += more
                    last = name
                yield df.assign(is_open=flags)

        return own.mapInPandas(through, out)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        df = _in_order(frames, ["ts", "kind"])
        errors, tripped = state.get if state.exists else (0, None)
        seconds = [x.timestamp() for x in df["ts"]]
        flags, errors, tripped = breaker_states(df["kind"].tolist(), seconds, errors, tripped)
        state.update((errors, tripped))
        yield df.assign(provider=key[0], is_open=flags)[["provider", "ts", "kind", "is_open"]]

    return own.groupBy("provider").applyInPandasWithState(step, out, "errors int, tripped double", "append", GroupStateTimeout.NoTimeout)


def rising_steps(events: DataFrame, key: str, step: str, order: str) -> DataFrame:
    """The rows of a stream (key, order, step) whose step is greater than all before of its key."""

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        df = _in_order(frames, [order])
        top = state.get[0] if state.exists else None
        keep = []
        for s in df[step]:
            rises = not pd.isna(s) and (top is None or s > top)
            top = s if rises else top
            keep.append(rises)
        if top is not None:
            state.update((float(top),))
        yield df[keep][[key, order, step]]

    own = events.select(key, order, step)
    return own.groupBy(key).applyInPandasWithState(run, own.schema, "top double", "append", GroupStateTimeout.NoTimeout)


def running_totals(events: DataFrame, key: str, value: str, ceiling: float) -> DataFrame:
    """Rows (key, total, over) of a stream after each micro-batch that touched the key; a total that saw nothing for FORGET_AFTER seconds is forgotten."""

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total = (state.get[0] if state.exists else 0.0) + sum(float(f["value"].fillna(0).sum()) for f in frames)
        state.update((total,))
        state.setTimeoutDuration(FORGET_AFTER * 1000)
        yield pd.DataFrame({"key": [k[0]], "total": [total], "over": [total > ceiling]})

    own = events.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
    return own.groupBy("key").applyInPandasWithState(run, "key string, total double, over boolean", "total double", "update", GroupStateTimeout.ProcessingTimeTimeout)


def windowed(events: DataFrame, ts: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event time; rows later than `late` are dropped on streams."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("w.start", "event_type", "n", "total")


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """All that a stream has now, through to a table in memory; for tests and replays."""
    spark, idle = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    spark.conf.set(idle, "false")  # states that can time out ask for batches without end
    try:
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(idle, before)
    return stream.sparkSession.table(name)
