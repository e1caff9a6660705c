"""Ledgers of runs: states of tasks, attempts and checks, reports, queues. All of it joins, windows and aggregates over logs that only grow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sequences import last_per_key


def latest_state(log: DataFrame, key: str, step: str, *fields: str) -> DataFrame:
    """Rows (key, step, fields) of each key's greatest step; of equal steps the greatest fields. Rows without key or step don't count."""
    best = F.max(F.struct(step, *fields)).alias("x")
    return log.filter(F.col(key).isNotNull() & F.col(step).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"x.{c}").alias(c) for c in (step, *fields)])


def first_value(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Rows (key, value): the first value in order that is not missing."""
    own = rows.filter(F.col(value).isNotNull())
    return own.groupBy(key).agg(F.min(F.struct(*order, value)).alias("x")).select(key, F.col(f"x.{value}").alias(value))


def task_states(tasks: DataFrame, results: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Each task with the last result of its path in its run, by `order`: `tasks` (keys, ...) left of `results` (keys, order, status, tokens_used, branch_name).
    Without a result tokens are 0 and the branch is a dash; `has_branch` tells a branch from none."""
    last = last_per_key(results.select(*keys, *order, "status", "tokens_used", "branch_name"), keys, *order).select(*keys, "status", "tokens_used", "branch_name")
    both = tasks.join(last, keys, "left")
    return both.withColumns({"tokens_used": F.coalesce("tokens_used", F.lit(0)), "has_branch": F.col("branch_name").isNotNull(), "branch_name": F.coalesce("branch_name", F.lit("—"))})


def newest_first(rows: DataFrame, at: str, *ties: str) -> DataFrame:
    """`rows` with `place`, from 1, by falling time; missing times come last. Runs are few enough for one order; each is one row."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last(at), *[F.asc(c) for c in ties])))


def cost_report(runs: DataFrame, reports: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Runs (thread_id, started_at, tokens) left of reports (thread_id, created_at, total_tasks, succeeded), by the day of the start or else of the report, of the
    last `days` days before `as_of`: rows (day, runs, attempted, succeeded, tokens)."""
    both = runs.join(reports, "thread_id", "left").withColumn("at", F.coalesce("started_at", "created_at"))
    recent = both.filter(F.col("at") >= as_of - F.expr(f"interval {days} days"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for c, n in (("total_tasks", "attempted"), ("succeeded", "succeeded"), ("tokens", "tokens"))]
    return recent.groupBy(F.to_date("at").alias("day")).agg(F.count("thread_id").alias("runs"), *sums)


def outcomes(tasks: DataFrame, results: DataFrame, passed: DataFrame, critiqued: DataFrame) -> DataFrame:
    """Rows (thread_id, total, succeeded, failed, tokens, rate): paths passed; failed or rejected results and paths critiqued that did not pass; the share of
    passed paths among the tasks, 1 of no tasks. Inputs: tasks (thread_id, task_id), results (thread_id, status, tokens_used), passed and critiqued (thread_id, module_path)."""
    total = tasks.distinct().groupBy("thread_id").agg(F.count("*").alias("total"))
    ended = results.groupBy("thread_id").agg(F.count_if(F.col("status").isin("failed", "rejected")).alias("ended"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"))
    good = passed.distinct().groupBy("thread_id").agg(F.count("*").alias("succeeded"))
    bad = critiqued.distinct().join(passed.distinct(), ["thread_id", "module_path"], "left_anti").groupBy("thread_id").agg(F.count("*").alias("refused"))
    threads = tasks.select("thread_id").union(results.select("thread_id")).distinct()
    out = threads.join(total, "thread_id", "left").join(ended, "thread_id", "left").join(good, "thread_id", "left").join(bad, "thread_id", "left").fillna(0)
    rate = F.when(F.col("total") > 0, F.round(F.col("succeeded") / F.col("total"), 6)).otherwise(1.0)
    return out.select("thread_id", "total", "succeeded", (F.col("ended") + F.col("refused")).alias("failed"), "tokens", rate.alias("rate"))


def surviving(results: DataFrame, passed: DataFrame, *order: str) -> DataFrame:
    """Rows (thread_id, module_path, branch_name): the last branch of each path that passed."""
    own = results.filter("branch_name is not null").join(passed.distinct(), ["thread_id", "module_path"], "left_semi")
    return last_per_key(own, ["thread_id", "module_path"], *order).select("thread_id", "module_path", "branch_name")


def next_in_queue(queue: DataFrame, ended: DataFrame) -> DataFrame:
    """Rows (queue, member, score): what each queue (queue, member, score) would give next - the smallest score, of equal ones the first member in byte order - of
    what is not in `ended` (queue, member). A member that was pushed again has its last score; pushes are (queue, member, score, pushed)."""
    last = last_per_key(queue, ["queue", "member"], "pushed").join(ended.select("queue", "member").distinct(), ["queue", "member"], "left_anti")
    return last.groupBy("queue").agg(F.min(F.struct("score", "member")).alias("x")).select("queue", "x.member", "x.score")


def gauntlet(checks: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows (key, attempt, passed, errors) of a log of checks (key, attempt, name, code, output): an attempt passes if no check of it failed; what failed is
    listed in the order of `names`, each under its name, with a blank line between. A check that was not run counts for nothing."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    said = F.when(F.col("code") != 0, F.struct(place.alias("place"), F.concat(F.lit("["), "name", F.lit("]\n"), F.trim(F.coalesce("output", F.lit("")))).alias("text")))
    out = checks.groupBy("key", "attempt").agg(F.bool_and(F.col("code") == 0).alias("passed"), F.array_sort(F.collect_list(said)).alias("e"))  # as many as names
    return out.select("key", "attempt", "passed", F.array_join(F.transform("e", lambda x: x["text"]), "\n\n").alias("errors"))


def verdicts(attempts: DataFrame, fixes: int = 2, most: int = 500) -> DataFrame:
    """Rows (key, passed, retries, reason) of attempts (key, attempt from 0, passed, errors): the first attempt and at most `fixes` more count; the first that passes
    ends it. Of a key that never passes, the reason is the start of the last errors that count."""
    own = attempts.filter(F.col("attempt") <= fixes)
    best = own.groupBy("key").agg(F.min(F.when(F.col("passed"), F.col("attempt"))).alias("at"), F.max("attempt").alias("last"), F.max_by("errors", "attempt").alias("errors"))
    failed = F.col("at").isNull()
    return best.select("key", (~failed).alias("passed"), F.coalesce("at", "last").alias("retries"), F.when(failed, F.substring("errors", 1, most)).alias("reason"))


def retried(attempts: DataFrame, delays: Sequence[float] = (10.0, 30.0, 60.0)) -> DataFrame:
    """Rows (key, calls, waited, outcome) of attempts (key, attempt from 0, limited, ok): a call that met a limit is repeated after the next delay, any other ends it;
    outcomes are `ok`, `failed` and, if the delays ran out, `exhausted`."""
    w = Window.partitionBy("key").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max((~F.col("limited")).cast("int")).over(w), F.lit(0))
    used = attempts.withColumn("done", ended).filter((F.col("done") == 0) & (F.col("attempt") <= len(delays)))
    waits = F.array(*[F.lit(float(sum(delays[:i]))) for i in range(len(delays) + 1)])
    last = used.groupBy("key").agg(F.max("attempt").alias("a"), F.max_by("limited", "attempt").alias("limited"), F.max_by("ok", "attempt").alias("ok"))
    outcome = F.when(~F.col("limited"), F.when(F.col("ok"), "ok").otherwise("failed")).when(F.col("a") == len(delays), "exhausted").otherwise("failed")
    return last.select("key", (F.col("a") + 1).alias("calls"), F.get(waits, F.col("a")).alias("waited"), outcome.alias("outcome"))


def first_closed(choices: Column, closed: Column) -> Column:
    """The first of an array of names that is in `closed`; if none is, the last."""
    return F.coalesce(F.try_element_at(F.filter(choices, lambda x: F.array_contains(closed, x)), F.lit(1)), F.element_at(choices, -1))


def as_json_map(df: DataFrame, key: str, name: str, value: str, out: str = "breakdown") -> DataFrame:
    """Rows (key, out): the summed values by name as a JSON object with its names in order. There are as many entries as names."""
    per = df.groupBy(key, name).agg(F.coalesce(F.sum(value), F.lit(0)).alias("v"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(name).alias("key"), F.col("v").alias("value"))))
    return per.filter(F.col(name).isNotNull()).groupBy(key).agg(F.to_json(F.map_from_entries(entries)).alias(out))


def percent_text(share: Column) -> Column:
    """A share as percents with one decimal; a dash for a missing one."""
    return F.when(share.isNotNull(), F.format_string("%.1f%%", share * 100)).otherwise("—")


def money_text(amount: Column) -> Column:
    return F.when(amount.isNotNull(), F.format_string("$%.4f", amount)).otherwise("—")


def table_line(*cells: Column) -> Column:
    """A line of a table in markdown."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") for c in cells]), F.lit(" |"))
