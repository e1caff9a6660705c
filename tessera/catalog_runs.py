"""Named queries over ledgers of runs, contexts and module graphs, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import _SPARSE, _dense, _sparse, query
from tessera.functions import tables as tf
from tessera.functions import text as tx
from tessera.operators import contexts, evals, graph, retrieval, runs
from tessera.session import table

# Runs and their reports are those of the threads in migration_tasks; a run has begun if it has a task of high risk.
_LEDGER = """t AS (SELECT DISTINCT task_id, thread_id, module_path, risk_level, priority, created_at FROM migration_tasks),
    r AS (SELECT t.thread_id, x.* FROM task_results x JOIN (SELECT DISTINCT task_id, thread_id FROM t) t USING (task_id)),
    runs AS (SELECT t.thread_id, min(t.created_at) FILTER (WHERE t.risk_level = 'high') AS started_at, CAST(coalesce(any_value(k.tokens), 0) AS BIGINT) AS tokens
        FROM t LEFT JOIN (SELECT thread_id, sum(tokens_used) AS tokens FROM r GROUP BY 1) k USING (thread_id) GROUP BY t.thread_id),
    reports AS (SELECT t.thread_id, max(r.finished_at) AS created_at, count(DISTINCT t.task_id) AS total_tasks, count(DISTINCT r.task_id) FILTER (WHERE r.status = 'success') AS succeeded
        FROM t JOIN r USING (thread_id) GROUP BY t.thread_id)"""


def _tasks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "migration_tasks").select("task_id", "thread_id", "module_path", "risk_level", "priority", "created_at").distinct()


def _results(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "task_results").join(_tasks(s, d).select("task_id", "thread_id").distinct(), "task_id")


def _ledger(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tasks, results = _tasks(s, d), _results(s, d)
    started = tasks.groupBy("thread_id").agg(F.min(F.when(F.col("risk_level") == "high", F.col("created_at"))).alias("started_at"), F.count_distinct("task_id").alias("total_tasks"))
    used = results.groupBy("thread_id").agg(
        F.sum("tokens_used").alias("tokens"), F.max("finished_at").alias("created_at"), F.count_distinct(F.when(F.col("status") == "success", F.col("task_id"))).alias("succeeded")
    )
    both = started.join(used, "thread_id", "left")
    own = both.select("thread_id", "started_at", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))
    return own, both.filter("created_at is not null").select("thread_id", "created_at", "total_tasks", "succeeded")


@query(
    f"WITH {_LEDGER} SELECT thread_id, succeeded, total_tasks, tokens, started_at, row_number() OVER (ORDER BY started_at DESC NULLS LAST, thread_id) AS place FROM reports LEFT JOIN runs USING (thread_id)"
)
def run_list(s: SparkSession, d: str) -> DataFrame:
    own, reports = _ledger(s, d)
    listed = runs.newest_first(reports.join(own, "thread_id", "left"), "started_at", "thread_id")
    return listed.select("thread_id", "succeeded", "total_tasks", "tokens", "started_at", F.col("place").cast("bigint").alias("place"))


@query(f"WITH {_LEDGER} SELECT runs.thread_id, coalesce(reports.total_tasks, -1) AS total_tasks, coalesce(reports.created_at, runs.started_at) AS known_at FROM runs LEFT JOIN reports USING (thread_id)")
def report_or_run(s: SparkSession, d: str) -> DataFrame:
    own, reports = _ledger(s, d)
    return own.join(reports, "thread_id", "left").select("thread_id", F.coalesce("total_tasks", F.lit(-1)).alias("total_tasks"), F.coalesce("created_at", "started_at").alias("known_at"))


@query(
    f"""WITH {_LEDGER}, b AS (SELECT CAST(coalesce(started_at, created_at) AS DATE) AS day, runs.thread_id, total_tasks, succeeded, tokens FROM runs LEFT JOIN reports USING (thread_id)
        WHERE coalesce(started_at, created_at) >= TIMESTAMP '2025-07-01' - INTERVAL 400 DAY),
    g AS (SELECT day, count(thread_id) AS runs, CAST(coalesce(sum(total_tasks), 0) AS BIGINT) AS attempted, CAST(coalesce(sum(succeeded), 0) AS BIGINT) AS succeeded, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens FROM b GROUP BY day)
    SELECT *, row_number() OVER (ORDER BY day DESC) AS place, '| ' || strftime(day, '%Y-%m-%d') || ' | ' || runs || ' | ' || CASE WHEN attempted > 0 THEN printf('%.1f%%', succeeded / attempted * 100) ELSE '—' END || ' |' AS line FROM g"""
)
def cost_report(s: SparkSession, d: str) -> DataFrame:
    own, reports = _ledger(s, d)
    days = runs.newest_first(runs.cost_report(own, reports, F.expr("timestamp_ntz'2025-07-01 00:00:00'"), 400), "day")
    share = F.when(F.col("attempted") > 0, F.col("succeeded") / F.col("attempted"))
    return days.withColumn("place", F.col("place").cast("bigint")).withColumn("line", runs.table_line(F.date_format("day", "yyyy-MM-dd"), F.col("runs"), runs.percent_text(share)))


@query(
    f"""WITH {_LEDGER}, l AS (SELECT thread_id, module_path, status, tokens_used, branch_name FROM r QUALIFY row_number() OVER (PARTITION BY thread_id, module_path ORDER BY finished_at DESC, result_id DESC) = 1)
    SELECT t.task_id, t.thread_id, t.module_path, regexp_extract(t.module_path, '[^/]+$') AS module_name, coalesce(l.status, 'none') AS last_status, coalesce(l.tokens_used, 0) AS tokens_used,
        l.branch_name IS NOT NULL AS has_branch, coalesce(l.branch_name, '—') AS branch_name FROM t LEFT JOIN l USING (thread_id, module_path)"""
)
def task_states(s: SparkSession, d: str) -> DataFrame:
    own = runs.task_states(_tasks(s, d).select("task_id", "thread_id", "module_path", "risk_level", "priority", "created_at"), _results(s, d), ["thread_id", "module_path"], "finished_at", "result_id")
    name = F.regexp_extract("module_path", r"[^/]+$", 0).alias("module_name")
    return own.select("task_id", "thread_id", "module_path", name, F.coalesce("status", F.lit("none")).alias("last_status"), "tokens_used", "has_branch", "branch_name")


@query("SELECT module_path, branch_name FROM task_results WHERE branch_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY module_path ORDER BY finished_at, result_id) = 1")
def first_branches(s: SparkSession, d: str) -> DataFrame:
    return runs.first_value(table(s, d, "task_results"), "module_path", "branch_name", "finished_at", "result_id")


@query(
    f"""WITH {_LEDGER}, k AS (SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY finished_at, result_id) AS step, module_path, status FROM r)
    SELECT thread_id, step, module_path, status FROM k QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY step DESC) = 1"""
)
def latest_states(s: SparkSession, d: str) -> DataFrame:
    step = F.row_number().over(Window.partitionBy("thread_id").orderBy("finished_at", "result_id")).cast("bigint")
    return runs.latest_state(_results(s, d).withColumn("step", step), "thread_id", "step", "module_path", "status")


@query(
    f"""WITH {_LEDGER}, g AS (SELECT thread_id, status, CAST(coalesce(sum(tokens_used), 0) AS BIGINT) AS v FROM r GROUP BY ALL)
    SELECT thread_id, '{{' || string_agg('"' || status || '":' || v, ',' ORDER BY status) || '}}' AS breakdown FROM g GROUP BY thread_id"""
)
def token_breakdowns(s: SparkSession, d: str) -> DataFrame:
    return runs.as_json_map(_results(s, d), "thread_id", "status", "tokens_used")


@query(
    f"""WITH {_LEDGER}, p AS (SELECT DISTINCT thread_id, module_path FROM r WHERE status = 'success'), c AS (SELECT DISTINCT thread_id, module_path FROM r WHERE status IN ('success', 'transformed')),
    a AS (SELECT thread_id, count(DISTINCT task_id) AS total FROM t GROUP BY 1), e AS (SELECT thread_id, count(*) FILTER (WHERE status IN ('failed', 'rejected')) AS ended, coalesce(sum(tokens_used), 0) AS tokens FROM r GROUP BY 1),
    g AS (SELECT thread_id, count(*) AS succeeded FROM p GROUP BY 1), b AS (SELECT thread_id, count(*) AS refused FROM (SELECT * FROM c EXCEPT SELECT * FROM p) GROUP BY 1)
    SELECT thread_id, total, coalesce(succeeded, 0) AS succeeded, coalesce(ended, 0) + coalesce(refused, 0) AS failed, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens, round(coalesce(succeeded, 0) / total, 6) AS rate
    FROM a LEFT JOIN e USING (thread_id) LEFT JOIN g USING (thread_id) LEFT JOIN b USING (thread_id)"""
)
def run_outcomes(s: SparkSession, d: str) -> DataFrame:
    r = _results(s, d)
    paths = r.select("thread_id", "module_path")
    return runs.outcomes(_tasks(s, d).select("thread_id", "task_id"), r, paths.filter(r["status"] == "success"), paths.filter(r["status"].isin("success", "transformed")))


@query(
    f"""WITH {_LEDGER}, p AS (SELECT DISTINCT thread_id, module_path FROM r WHERE status = 'success')
    SELECT thread_id, module_path, branch_name FROM r SEMI JOIN p USING (thread_id, module_path) WHERE branch_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY thread_id, module_path ORDER BY finished_at DESC, result_id DESC) = 1"""
)
def surviving_branches(s: SparkSession, d: str) -> DataFrame:
    r = _results(s, d)
    return runs.surviving(r, r.filter("status = 'success'").select("thread_id", "module_path"), "finished_at", "result_id")


@query(f"WITH {_LEDGER} SELECT thread_id, bool_or(status = 'failed') AS any_failed, bool_or(status = 'rejected') AS any_rejected, bool_and(status <> 'skipped') AS none_skipped, count(*) FILTER (WHERE status IN ('success', 'transformed')) AS moved FROM r GROUP BY thread_id")
def run_flags(s: SparkSession, d: str) -> DataFrame:
    status = F.col("status")
    flags = [F.bool_or(status == "failed").alias("any_failed"), F.bool_or(status == "rejected").alias("any_rejected"), F.bool_and(status != "skipped").alias("none_skipped")]
    return _results(s, d).groupBy("thread_id").agg(*flags, F.count_if(status.isin("success", "transformed")).alias("moved"))


@query(
    f"""WITH {_LEDGER}, o AS (SELECT thread_id, sum(coalesce(tokens_used, 0)) OVER (PARTITION BY thread_id ORDER BY finished_at, result_id) AS running FROM r)
    SELECT thread_id, bool_or(running > 5000) AS exceeded FROM o GROUP BY thread_id"""
)
def ceilings(s: SparkSession, d: str) -> DataFrame:
    from tessera.operators import sequences

    own = sequences.running_total(_results(s, d), ["thread_id"], ["finished_at", "result_id"], "tokens_used", 5000)
    return own.groupBy("thread_id").agg(F.bool_or("over").alias("exceeded"))


@query(
    f"""WITH {_LEDGER}, q AS (SELECT thread_id, task_id, min(priority) AS score FROM t WHERE task_id NOT IN (SELECT task_id FROM r WHERE status = 'success') GROUP BY ALL)
    SELECT thread_id AS queue, task_id AS member, score FROM q QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY score, task_id) = 1"""
)
def queue_heads(s: SparkSession, d: str) -> DataFrame:
    pushed = _tasks(s, d).groupBy(F.col("thread_id").alias("queue"), F.col("task_id").alias("member")).agg(F.min("priority").alias("score"), F.max("created_at").alias("pushed"))
    ended = _results(s, d).filter("status = 'success'").select(F.col("thread_id").alias("queue"), F.col("task_id").alias("member"))
    return runs.next_in_queue(pushed, ended)


# A log of checks is read out of the results: each is an attempt, with a lint that fails on failure, a type check that fails above 5,000 tokens and, if there is a branch, a test that fails on rejection.
_ATTEMPTS = """a AS (SELECT task_id AS key, row_number() OVER (PARTITION BY task_id ORDER BY finished_at, result_id) - 1 AS attempt, * FROM task_results),
    c AS (SELECT key, attempt, 'lint' AS name, 1 AS place, CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS code, error AS output FROM a
        UNION ALL SELECT key, attempt, 'types', 2, CASE WHEN tokens_used > 5000 THEN 2 ELSE 0 END, 'tokens ' || tokens_used FROM a
        UNION ALL SELECT key, attempt, 'test', 3, CASE WHEN status = 'rejected' THEN 1 ELSE 0 END, branch_name FROM a WHERE branch_name IS NOT NULL),
    g AS (SELECT key, attempt, bool_and(code = 0) AS passed, coalesce(string_agg('[' || name || ']' || chr(10) || trim(coalesce(output, '')), chr(10) || chr(10) ORDER BY place) FILTER (WHERE code <> 0), '') AS errors FROM c GROUP BY key, attempt)"""


def _checks(s: SparkSession, d: str) -> DataFrame:
    attempt = (F.row_number().over(Window.partitionBy("task_id").orderBy("finished_at", "result_id")) - 1).cast("bigint")
    a = table(s, d, "task_results").withColumn("attempt", attempt)

    def code(bad, n: int = 1):
        return F.when(bad, n).otherwise(0).alias("code")

    each = F.filter(
        F.array(
            F.struct(F.lit("lint").alias("name"), code(F.col("status") == "failed"), F.col("error").alias("output")),
            F.struct(F.lit("types").alias("name"), code(F.col("tokens_used") > 5000, 2), F.concat(F.lit("tokens "), F.col("tokens_used").cast("string")).alias("output")),
            F.when(F.col("branch_name").isNotNull(), F.struct(F.lit("test").alias("name"), code(F.col("status") == "rejected"), F.col("branch_name").alias("output"))),
        ),
        lambda x: x.isNotNull(),
    )
    return a.select(F.col("task_id").alias("key"), "attempt", F.explode(each).alias("c")).select("key", "attempt", "c.name", "c.code", "c.output")


@query(f"WITH {_ATTEMPTS} SELECT key, attempt, passed, errors FROM g")
def check_results(s: SparkSession, d: str) -> DataFrame:
    return runs.gauntlet(_checks(s, d), ("lint", "types", "test"))


@query(
    f"""WITH {_ATTEMPTS}, k AS (SELECT key, min(attempt) FILTER (WHERE passed) AS won, max(attempt) AS last, arg_max(errors, attempt) AS errors FROM g WHERE attempt <= 2 GROUP BY key)
    SELECT key, won IS NOT NULL AS passed, coalesce(won, last) AS retries, CASE WHEN won IS NULL THEN errors[1:500] END AS reason FROM k"""
)
def check_verdicts(s: SparkSession, d: str) -> DataFrame:
    return runs.verdicts(runs.gauntlet(_checks(s, d), ("lint", "types", "test")))


@query(
    """WITH a AS (SELECT task_id AS key, row_number() OVER (PARTITION BY task_id ORDER BY finished_at, result_id) - 1 AS attempt,
        coalesce(contains(lower(error), '429') OR contains(lower(error), 'rate limit') OR contains(lower(error), 'too many requests') OR contains(lower(error), 'resource_exhausted'), false) AS limited, status <> 'failed' AS ok FROM task_results),
    u AS (SELECT *, coalesce(max(CASE WHEN limited THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM a),
    l AS (SELECT key, max(attempt) AS n, arg_max(limited, attempt) AS limited, arg_max(ok, attempt) AS ok FROM u WHERE done = 0 AND attempt <= 3 GROUP BY key)
    SELECT key, n + 1 AS calls, CAST(list_extract([0.0, 10.0, 40.0, 100.0], n + 1) AS DOUBLE) AS waited, CASE WHEN NOT limited THEN CASE WHEN ok THEN 'ok' ELSE 'failed' END WHEN n = 3 THEN 'exhausted' ELSE 'failed' END AS outcome FROM l"""
)
def retried_calls(s: SparkSession, d: str) -> DataFrame:
    attempt = (F.row_number().over(Window.partitionBy("task_id").orderBy("finished_at", "result_id")) - 1).cast("bigint")
    limited = tx.is_rate_limit(F.col("error"), ("429", "rate limit", "too many requests", "resource_exhausted"))
    return runs.retried(table(s, d, "task_results").select(F.col("task_id").alias("key"), attempt.alias("attempt"), limited.alias("limited"), (F.col("status") != "failed").alias("ok")))


@query(
    f"""WITH {_LEDGER}, n AS (SELECT thread_id, task_id, count(*) AS attempts FROM r GROUP BY ALL)
    SELECT a.thread_id, round(avg(n.attempts), 6) AS mean_attempts FROM (SELECT DISTINCT thread_id FROM t) a LEFT JOIN n USING (thread_id) GROUP BY a.thread_id"""
)
def mean_attempts(s: SparkSession, d: str) -> DataFrame:
    """Means of attempts a task, missing for runs without any."""
    n = _results(s, d).groupBy("thread_id", "task_id").agg(F.count("*").alias("attempts"))
    return _tasks(s, d).select("thread_id").distinct().join(n, "thread_id", "left").groupBy("thread_id").agg(F.round(F.avg("attempts"), 6).alias("mean_attempts"))


@query(
    f"""WITH {_LEDGER} SELECT runs.thread_id, CASE WHEN started_at IS NULL THEN NULL ELSE greatest(0, CAST(floor(epoch(reports.created_at) - epoch(started_at)) AS BIGINT)) END AS seconds FROM runs JOIN reports USING (thread_id)"""
)
def run_durations(s: SparkSession, d: str) -> DataFrame:
    own, reports = _ledger(s, d)
    seconds = F.floor((F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1_000_000)
    both = own.join(reports, "thread_id")
    return both.select("thread_id", F.when(F.col("started_at").isNotNull(), F.greatest(F.lit(0), seconds)).alias("seconds"))


@query(
    """WITH q AS (SELECT DISTINCT title FROM documents WHERE title IS NOT NULL), a AS (SELECT title, min(doc_chunk_id) AS best, count(*) AS n FROM doc_chunks WHERE title IS NOT NULL GROUP BY title)
    SELECT q.title, coalesce(a.best, -1) AS best, coalesce(a.n, 0) AS n FROM q LEFT JOIN a USING (title)"""
)
def answers_by_title(s: SparkSession, d: str) -> DataFrame:
    """Items with what was found under their very text; what is missing is empty."""
    found = table(s, d, "doc_chunks").filter("title is not null").groupBy("title").agg(F.min("doc_chunk_id").alias("best"), F.count("*").alias("n"))
    return table(s, d, "documents").filter("title is not null").select("title").distinct().join(found, "title", "left").fillna({"best": -1, "n": 0})


@query("SELECT pattern_id, md5(before_code || ' -> ' || migration_type) AS key, before_code, after_code, migration_type, source_framework, target_framework, success_count FROM migration_patterns")
def pattern_payloads(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "migration_patterns")
    return p.select("pattern_id", F.md5(tx.signature_key(F.col("before_code"), F.col("migration_type"))).alias("key"), "before_code", "after_code", "migration_type", "source_framework", "target_framework", "success_count")


@query("SELECT name, alpha, retrieve_k, rerank_k, rerank FROM (VALUES ('default', 0.5::DOUBLE, 20, 6, false), ('reranker', 0.5, 20, 6, true), ('dense_only', 1.0, 20, 6, false), ('sparse_only', 0.0, 20, 6, false)) t(name, alpha, retrieve_k, rerank_k, rerank)")
def search_configs(s: SparkSession, d: str) -> DataFrame:
    rows = [(n, c.alpha, c.retrieve_k, c.rerank_k, c.rerank) for n, c in retrieval.CONFIGS.items()]
    return s.createDataFrame(rows, "name string, alpha double, retrieve_k int, rerank_k int, rerank boolean")


@query(
    f"""WITH {_LEDGER} SELECT thread_id, module_path, status FROM r QUALIFY row_number() OVER (PARTITION BY thread_id, module_path ORDER BY finished_at DESC, result_id DESC) = 1 AND status IN ('failed', 'rejected')"""
)
def rerun_paths(s: SparkSession, d: str) -> DataFrame:
    """Paths whose last result failed, which would be queued again; earlier results are replaced by later ones."""
    from tessera.operators.sequences import last_per_key

    return last_per_key(_results(s, d), ["thread_id", "module_path"], "finished_at", "result_id").filter("status in ('failed', 'rejected')").select("thread_id", "module_path", "status")


@query(
    """WITH x AS (SELECT r.repo, avg(t.rate) AS mean_rate, CAST(sum(t.n) AS BIGINT) AS files FROM repos r JOIN (SELECT repo, file_path, avg(CASE WHEN docstring IS NOT NULL THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS n FROM code_chunks GROUP BY ALL) t USING (repo) GROUP BY r.repo)
    SELECT coalesce(repo, '(all)') AS repo, round(avg(mean_rate), 6) AS mean_rate, CAST(sum(files) AS BIGINT) AS chunks FROM x GROUP BY ROLLUP (repo)"""
)
def documented_share(s: SparkSession, d: str) -> DataFrame:
    """Means by repo and of all repos in one pass; repos without files have no row."""
    per = table(s, d, "code_chunks").groupBy("repo", "file_path").agg(F.avg(F.col("docstring").isNotNull().cast("double")).alias("rate"), F.count("*").alias("n"))
    own = table(s, d, "repos").select("repo").join(per, "repo").groupBy("repo").agg(F.avg("rate").alias("mean_rate"), F.sum("n").alias("n"))
    return own.rollup("repo").agg(F.round(F.avg("mean_rate"), 6).alias("mean_rate"), F.sum("n").alias("chunks")).withColumn("repo", F.coalesce("repo", F.lit("(all)")))


@query("SELECT task_id, array_to_string([x for x in [nullif(trim(description), ''), CASE WHEN len(predicted_changes) > 0 THEN 'Changes:' || chr(10) || array_to_string(list_transform(predicted_changes, lambda c: '- ' || c), chr(10)) END, CASE WHEN len(retrieved_context_ids) > 0 THEN 'Context: ' || array_to_string(retrieved_context_ids, ', ') END] if x IS NOT NULL], chr(10) || chr(10)) AS prompt FROM (SELECT DISTINCT task_id, description, predicted_changes, retrieved_context_ids FROM migration_tasks)")
def task_prompts(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "migration_tasks").select("task_id", "description", "predicted_changes", "retrieved_context_ids").distinct()
    return t.select("task_id", contexts.prompt(F.col("description"), F.col("predicted_changes"), F.col("retrieved_context_ids"), F.lit(None).cast("string")).alias("prompt"))


@query("SELECT pattern_id, source_framework || '→' || target_framework AS kind, source_framework || ' ' || target_framework || ' migration' || chr(10) || coalesce(before_code, '')[1:400] AS code_query, source_framework || ' to ' || target_framework || ' migration' AS guide_query FROM migration_patterns")
def context_queries(s: SparkSession, d: str) -> DataFrame:
    a, b = F.col("source_framework"), F.col("target_framework")
    return table(s, d, "migration_patterns").select("pattern_id", contexts.kind_of_change(a, b).alias("kind"), contexts.code_query(a, b, F.col("before_code")).alias("code_query"), contexts.guide_query(a, b).alias("guide_query"))


def _ranked_words(corpus: str, queries: str, name: str) -> str:
    word, saturated = "'[a-z0-9_ß-öø-ÿ]+'", "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256.0))"
    tf_of = "SELECT id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT id, len(words) AS n, unnest(words) AS term FROM (SELECT id, regexp_extract_all(lower(text), {w}) AS words FROM ({t}))) GROUP BY id, term"
    return f"""{name}_p AS (SELECT id, term, {saturated} AS weight FROM ({tf_of.format(w=word, t=corpus)})), {name}_q AS (SELECT id AS query_id, term, {saturated} AS wq FROM ({tf_of.format(w=word, t=queries)})),
    {name}_s AS (SELECT query_id, id, round(sum(wq * weight), 6) AS score FROM {name}_q JOIN {name}_p USING (term) GROUP BY query_id, id),
    {name} AS (SELECT query_id, list('{name}:' || id ORDER BY score DESC, id) AS ids FROM (SELECT * FROM {name}_s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3) GROUP BY query_id)"""


_CODE_Q = "SELECT pattern_id AS id, source_framework || ' ' || target_framework || ' migration' || chr(10) || coalesce(before_code, '')[1:400] AS text FROM migration_patterns WHERE pattern_id % 50 = 0"
_GUIDE_Q = "SELECT pattern_id AS id, source_framework || ' to ' || target_framework || ' migration' AS text FROM migration_patterns WHERE pattern_id % 50 = 0"


@query(
    f"""WITH {_ranked_words("SELECT chunk_id AS id, content AS text FROM code_chunks", _CODE_Q, "code")}, {_ranked_words("SELECT doc_chunk_id AS id, content AS text FROM doc_chunks", _GUIDE_Q, "docs")}
    SELECT pattern_id AS query_id, array_to_string(list_concat(coalesce(code.ids, []), coalesce(docs.ids, [])), ',') AS context FROM migration_patterns p LEFT JOIN code ON code.query_id = pattern_id LEFT JOIN docs ON docs.query_id = pattern_id WHERE pattern_id % 50 = 0"""
)
def change_contexts(s: SparkSession, d: str) -> DataFrame:
    """For every pattern whose id is divisible by 50, the three best chunks of code and of documents by words, against all of both."""
    p = table(s, d, "migration_patterns").filter("pattern_id % 50 = 0")
    a, b = F.col("source_framework"), F.col("target_framework")
    code = contexts.searched(p.select(F.col("pattern_id").alias("query_id"), contexts.code_query(a, b, F.col("before_code")).alias("text")), table(s, d, "code_chunks").select(F.col("chunk_id").alias("id"), F.col("content").alias("text")), 3)
    docs = contexts.searched(p.select(F.col("pattern_id").alias("query_id"), contexts.guide_query(a, b).alias("text")), table(s, d, "doc_chunks").select(F.col("doc_chunk_id").alias("id"), F.col("content").alias("text")), 3)
    out = contexts.gathered(p.select(F.col("pattern_id").alias("query_id")), {"code": code, "docs": docs})
    return out.select("query_id", F.array_join("context", ",").alias("context"))


# ---------------------------------------------------------------- filtered and configured search


def _configured_sql(alpha: float, side: int, k: int, keep: str = "true", name: str = "", rerank: int = 0) -> str:
    """Fused lists under one configuration over the documents that `keep` asks for, cut to k, or with `rerank` reranked by shared words and cut to it."""
    from tessera.catalog import _DENSE

    dense, sparse = _DENSE, _SPARSE
    if keep != "true":
        dense = dense.replace("FROM v q, v WHERE q.id % 50 = 0", f"FROM v q, v WHERE q.id % 50 = 0 AND v.id IN (SELECT doc_id FROM documents WHERE {keep})")
        sparse = sparse.replace("AS words FROM documents),\n", f"AS words FROM documents WHERE {keep}),\n", 1)
    fused = f"""WITH {dense}, {sparse}, f AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.id, y.id) AS id, x.rank AS xr, y.rank AS yr
        FROM (SELECT * FROM dr WHERE rank < {side}) x FULL JOIN (SELECT * FROM sr WHERE rank < {side}) y ON x.query_id = y.query_id AND x.id = y.id),
    g AS (SELECT query_id, id, xr, yr, round(coalesce({alpha}::DOUBLE / (60 + xr + 1), 0) + coalesce((1 - {alpha}::DOUBLE) / (60 + yr + 1), 0), 12) AS score FROM f),
    h AS (SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, xr NULLS LAST, yr NULLS LAST, id) - 1 AS rank FROM g QUALIFY rank < {k})"""
    if not rerank:
        return f"{fused} SELECT '{name}' AS config, query_id, id, score, rank FROM h"
    word = "'[a-z0-9_ß-öø-ÿ]+'"
    return f"""{fused}, q AS (SELECT doc_id AS query_id, list_distinct(regexp_extract_all(lower(coalesce(title, '')), {word})) AS qw FROM documents WHERE doc_id % 50 = 0), c AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), {word})) AS cw FROM documents),
    z AS (SELECT h.query_id, h.id, h.rank AS prior, CASE WHEN len(qw) > 0 THEN round(len(list_intersect(qw, cw)) / len(qw), 6) ELSE 0.0 END AS score FROM h JOIN q USING (query_id) LEFT JOIN c USING (id))
    SELECT '{name}' AS config, query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prior) - 1 AS rank FROM z QUALIFY rank < {rerank}"""


def _reranked(s: SparkSession, d: str, hits: DataFrame, k: int) -> DataFrame:
    docs = table(s, d, "documents")
    return retrieval.rerank(hits, docs.select(F.col("doc_id").alias("query_id"), F.col("title").alias("query")), docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), k)


def _plain(name: str, hits: DataFrame) -> DataFrame:
    return hits.select(F.lit(name).alias("config"), "query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(_configured_sql(0.5, 160, 10, "source = 'guide' AND lang = 'en'", "filtered"))
def filtered_search(s: SparkSession, d: str) -> DataFrame:
    """Hybrid search within the guides in English: both sides rank what the filter lets through."""
    wanted = retrieval.metadata_filter({"source": "guide", "lang": "en", "repo": None})
    ids = table(s, d, "documents").filter(wanted).select(F.col("doc_id").alias("id"))
    _, side, _, final, _ = retrieval.limits(10)
    return _plain("filtered", retrieval.fuse(_dense(s, d, side, ids), _sparse(s, d, side, ids), 0.5, final))


@query(" UNION ALL ".join(f"(SELECT * FROM ({_configured_sql(a, 80, 20, 'true', n, r)}))" for n, a, r in (("default", 0.5, 0), ("reranker", 0.5, 6), ("dense_only", 1.0, 0), ("sparse_only", 0.0, 0))))
def configured_search(s: SparkSession, d: str) -> DataFrame:
    """Every named configuration over the same two ranked lists, which are computed once."""
    from tessera.session import staged

    sides = {retrieval.limits(config=c)[1] for c in retrieval.CONFIGS.values()}
    dense, sparse = staged(_dense(s, d, max(sides)), "dense-side"), staged(_sparse(s, d, max(sides)), "sparse-side")
    out = None
    for name, config in retrieval.CONFIGS.items():
        alpha, side, fused, final, rerank = retrieval.limits(config=config)
        hits = retrieval.fuse(dense.filter(F.col("rank") < side), sparse.filter(F.col("rank") < side), alpha, fused)
        hits = _plain(name, _reranked(s, d, hits, final) if rerank else hits.filter(F.col("rank") < final))
        out = hits if out is None else out.unionByName(hits)
    return out


@query(" UNION ALL ".join(f"(SELECT * FROM ({_configured_sql(a, 160, 10, 'true', f'{a}/{n}', r)}))" for a in retrieval.ALPHAS for n, r in (("plain", 0), ("reranked", 6))))
def full_sweep(s: SparkSession, d: str) -> DataFrame:
    """Every weight, as fused and reranked, over the same two lists: eight configurations in one plan."""
    side = retrieval.limits(10)[1]
    fused = retrieval.sweep(_dense(s, d, side), _sparse(s, d, side), s)
    keyed = fused.select(F.struct("alpha", "query_id").alias("query_id"), "id", "score", "rank")
    docs = table(s, d, "documents")
    asked = fused.select("alpha", "query_id").distinct().join(docs.select(F.col("doc_id").alias("query_id"), F.col("title").alias("query")), "query_id").select(F.struct("alpha", "query_id").alias("query_id"), "query")
    better = retrieval.rerank(keyed, asked, docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), 6)
    out = keyed.withColumn("kind", F.lit("plain")).unionByName(better.withColumn("kind", F.lit("reranked")).select(*keyed.columns, "kind"))
    name = F.concat(F.col("query_id.alpha").cast("string"), F.lit("/"), F.col("kind")).alias("config")
    return out.select(name, F.col("query_id.query_id").alias("query_id"), "id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("SELECT query_id, count(*) AS found, count(*) FILTER (WHERE other = label) AS right_ones FROM (SELECT q.vec_id AS query_id, q.label, x.label AS other FROM embeddings q JOIN embeddings x ON x.vec_id BETWEEN q.vec_id + 1 AND q.vec_id + 5 WHERE q.vec_id % 50 = 0) GROUP BY query_id HAVING count(*) FILTER (WHERE other = label) = 0")
def misses(s: SparkSession, d: str) -> DataFrame:
    """Lists - here of the five vectors that follow - in which nothing is right."""
    v = table(s, d, "embeddings").select("vec_id", "label")
    lists = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 5)).alias("vec_id"))
    met = lists.join(v.select("vec_id", F.col("label").alias("other")), "vec_id")
    return met.groupBy("query_id").agg(F.count("*").alias("found"), F.count_if(F.col("label") == F.col("other")).alias("right_ones")).filter("right_ones = 0")


# ---------------------------------------------------------------- graphs of modules


def _relative(path):
    return F.regexp_replace(path, r"^/srv/checkouts/[^/]+/", "")


@query(
    r"""WITH f AS (SELECT DISTINCT repo, file_path, regexp_replace(file_path, '^/srv/checkouts/[^/]+/', '') AS rel FROM code_chunks WHERE repo IS NOT NULL), g AS (SELECT *, replace(regexp_replace(rel, '([^/])\.[^./]+$', '\1'), '/', '.') AS dotted FROM f),
        m AS (SELECT repo, file_path, CASE WHEN rel LIKE '%.py' THEN regexp_replace(dotted, '(^|\.)__init__$', '') ELSE regexp_replace(dotted, '\.index$', '') END AS module FROM g WHERE regexp_matches(lower(rel), '\.(py|ts|tsx|js|jsx)$'))
    SELECT repo, module, max(file_path) AS file_path, count(*) AS files FROM m WHERE module <> '' GROUP BY repo, module"""
)
def modules(s: SparkSession, d: str) -> DataFrame:
    """The modules of each repo with their file; of several files of one module the last path counts."""
    return graph.modules(table(s, d, "code_chunks").filter("repo is not null").select("repo", "file_path", _relative(F.col("file_path")).alias("path")))


@query()
def module_edges(s: SparkSession, d: str) -> DataFrame:
    """Imports between the known modules of a repo; Python's come from its syntax tree, which has no SQL."""
    chunks = table(s, d, "code_chunks").filter("repo is not null")
    sources = tf.assembled(chunks).join(chunks.select("file_path", "repo").distinct(), "file_path")
    return graph.module_edges(sources.select("repo", _relative(F.col("file_path")).alias("path"), "content"))


@query(
    r"""WITH m AS (SELECT DISTINCT repo, replace(regexp_replace(regexp_replace(file_path, '^/srv/checkouts/[^/]+/', ''), '\.[^./]+$', ''), '/', '.') AS module, regexp_matches(lower(file_path), '\.py$') AS py FROM code_chunks WHERE repo IS NOT NULL AND regexp_matches(lower(file_path), '\.(py|ts|tsx|js|jsx)$'))
    SELECT repo, count(DISTINCT module) AS nodes, count(DISTINCT CASE WHEN py THEN module END) AS python_nodes FROM m GROUP BY repo"""
)
def module_counts(s: SparkSession, d: str) -> DataFrame:
    known = modules(s, d)
    return known.groupBy("repo").agg(F.count_distinct("module").alias("nodes"), F.count_distinct(F.when(F.lower("file_path").endswith(".py"), F.col("module"))).alias("python_nodes"))


@query(
    r"""WITH f AS (SELECT DISTINCT repo, regexp_replace(file_path, '^/srv/checkouts/[^/]+/', '') AS path FROM code_chunks WHERE repo IS NOT NULL), a AS (SELECT DISTINCT repo, regexp_replace(path, '/[^/]+$', '') AS folder FROM f WHERE path LIKE '%.py' AND contains(path, '/'))
    SELECT a.repo, replace(folder, '/', '.') AS module, coalesce((SELECT min(path) FROM f WHERE f.repo = a.repo AND f.path = folder || '.py'), (SELECT min(path) FROM f WHERE f.repo = a.repo AND f.path = folder || '/__init__.py'), 'none') AS path FROM a"""
)
def package_files(s: SparkSession, d: str) -> DataFrame:
    """The file of each package: the module of its name, else its init."""
    files = table(s, d, "code_chunks").filter("repo is not null").select("repo", _relative(F.col("file_path")).alias("path")).distinct()
    folders = files.filter(F.col("path").endswith(".py") & F.col("path").contains("/")).select("repo", F.regexp_replace("path", r"/[^/]+$", "").alias("folder")).distinct()
    return graph.module_files(folders.select("repo", F.replace("folder", F.lit("/"), F.lit(".")).alias("module")), files).select("repo", "module", F.coalesce("path", F.lit("none")).alias("path"))


@query(
    """WITH e AS (SELECT label, count(*) AS n, avg(CASE WHEN vec_id % 3 = 0 THEN 1.0 ELSE 0.0 END) AS hit, max(vec_id) AS top FROM embeddings GROUP BY label)
    SELECT row_number() OVER (ORDER BY hit DESC, label) AS place, '| ' || label || ' | ' || n || ' | ' || printf('%.1f%%', hit * 100) || ' |' AS line FROM e"""
)
def score_table(s: SparkSession, d: str) -> DataFrame:
    """A table in markdown of labels in order of a share."""
    own = table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("vec_id") % 3 == 0).cast("double")).alias("hit"))
    return evals.table(own, ["label", "n"], "hit", "label").withColumn("place", F.col("place").cast("bigint"))
