"""Named queries over a folder of tables, each over its whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import tables as tf
from tessera.functions import text as tx
from tessera.operators import evals, graph, patterns, retrieval, sequences, vectors
from tessera.session import table
from tessera.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "hybrid_search"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- filters and projections


@query("SELECT chunk_id, file_path, start_line, end_line FROM code_chunks WHERE language = 'python' AND node_type = 'function'")
def metadata_filter(s: SparkSession, d: str) -> DataFrame:
    wanted = retrieval.metadata_filter({"language": "python", "node_type": "function", "file_path": ""})
    return table(s, d, "code_chunks").filter(wanted).select("chunk_id", "file_path", "start_line", "end_line")


@query("SELECT node_type, count(*) AS n FROM code_chunks GROUP BY node_type")
def metadata_filter_none(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "code_chunks").filter(retrieval.metadata_filter({"language": None})).groupBy("node_type").agg(F.count("*").alias("n"))


@query("SELECT task_id, module_path, priority FROM migration_tasks WHERE risk_level = 'high'")
def high_risk_tasks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "migration_tasks").filter("risk_level = 'high'").select("task_id", "module_path", "priority")


@query(
    r"""WITH k AS (SELECT chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(file_path || ':' || start_line || ':' || end_line)) AS h FROM code_chunks)
    SELECT chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || lower(printf('%x', (('0x' || h[17:18])::INT & 63) | 128)) || h[19:20] || '-' || h[21:32] AS point_key FROM k"""
)
def chunk_point_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "code_chunks").select("chunk_id", tx.uuid5(tx.chunk_key(F.col("file_path"), F.col("start_line"), F.col("end_line"))).alias("point_key"))


@query("SELECT doc_chunk_id, sha1(source || ':' || title)[1:32] AS item FROM doc_chunks")
def item_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "doc_chunks").select("doc_chunk_id", tx.item_id(F.col("source"), F.col("title")).alias("item"))


@query("SELECT chunk_id, CAST(length(content) - length(replace(content, chr(10), '')) + 1 AS INTEGER) AS n_lines FROM code_chunks")
def line_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "code_chunks").select("chunk_id", tx.line_count(F.col("content")).alias("n_lines"))


@query(
    r"""SELECT doc_chunk_id, CASE WHEN regexp_matches(content, '(?m)^#{1,6}\s+.+$') THEN regexp_replace(regexp_extract(content, '(?m)^#{1,6}\s+(.+)$', 1), '^\s+|\s+$', '', 'g')
        ELSE coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(split_part(content, chr(10), 1), '^\s+|\s+$', '', 'g'), '^#+', ''), '^\s+|\s+$', '', 'g')[1:80], ''), 'untitled') END AS title FROM doc_chunks"""
)
def titles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "doc_chunks").select("doc_chunk_id", tx.title(F.col("content")).alias("title"))


@query(
    r"""SELECT chunk_id, nullif(regexp_replace(CASE WHEN regexp_matches(content, '"{3}[\s\S]*?"{3}') THEN regexp_extract(content, '"{3}([\s\S]*?)"{3}', 1)
        ELSE regexp_extract(content, '''{3}([\s\S]*?)''{3}', 1) END, '^\s+|\s+$', '', 'g'), '') AS doc FROM code_chunks WHERE language = 'python'"""
)
def docstrings(s: SparkSession, d: str) -> DataFrame:
    own = table(s, d, "code_chunks").filter("language = 'python'")
    return own.select("chunk_id", tx.docstring(F.col("content"), F.col("language")).alias("doc"))


@query(
    r"""SELECT chunk_id, nullif(trim(regexp_extract(list_filter(string_split(parent_context, chr(10)), lambda x: starts_with(ltrim(x), 'class '))[-1], '^\s*class ([^(:]*)', 1)), '') AS parent FROM code_chunks"""
)
def parent_classes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "code_chunks").select("chunk_id", tx.parent_class(F.col("parent_context")).alias("parent"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)```[ \t]*(?:python|py)?[ \t]*\n[\s\S]*?```') THEN regexp_extract(text, '(?i)```[ \t]*(?:python|py)?[ \t]*\n([\s\S]*?)```', 1) END AS code FROM documents""")
def fenced_code(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", tx.fenced_code(F.col("text")).alias("code"))


@query(
    r"""WITH f AS (SELECT DISTINCT file_path, replace(regexp_replace(file_path, '([^/])\.[^./]+$', '\1'), '/', '.') AS dotted FROM code_chunks)
    SELECT file_path, CASE WHEN file_path LIKE '%.py' THEN regexp_replace(dotted, '(^|\.)__init__$', '') ELSE regexp_replace(dotted, '\.index$', '') END AS module FROM f"""
)
def module_names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "code_chunks").select("file_path").distinct().withColumn("module", tx.module_name(F.col("file_path")))


@query(
    r"""SELECT task_id, module_path, 'migration/' || thread_id || '/' || regexp_replace(replace(regexp_replace(replace(module_path, chr(92), '/'), '\.py$', ''), '/', '.'), '[^\p{L}\p{M}\p{N}_./-]', '-', 'g') AS branch FROM migration_tasks"""
)
def branch_names(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "migration_tasks").select("task_id", "module_path", tx.branch_name(F.col("thread_id"), F.col("module_path")).alias("branch"))


@query("SELECT task_id, replace(replace(rtrim(to_base64(encode(module_path)), '='), '+', '-'), '/', '_') AS slug, module_path AS back FROM migration_tasks")
def slugs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "migration_tasks").withColumn("slug", tx.slug(F.col("module_path"))).select("task_id", "slug", tx.unslug(F.col("slug")).alias("back"))


@query("SELECT pattern_id, before_code || ' -> ' || migration_type AS signature FROM migration_patterns")
def signature_keys(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "migration_patterns").select("pattern_id", tx.signature_key(F.col("before_code"), F.col("migration_type")).alias("signature"))


@query("SELECT result_id, least(pow(2.0, row_number() OVER (PARTITION BY task_id ORDER BY finished_at, result_id) - 1), 60.0) AS seconds FROM task_results")
def backoff_schedule(s: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("task_id").orderBy("finished_at", "result_id")) - 1
    return table(s, d, "task_results").select("result_id", tx.backoff_seconds(n).alias("seconds"))


@query(
    """SELECT result_id, coalesce(contains(lower(error), '429') OR contains(lower(error), 'rate limit') OR contains(lower(error), 'rate-limited') OR contains(lower(error), 'too many requests')
        OR contains(lower(error), 'quota') OR contains(lower(error), 'resource_exhausted'), false) AS limited FROM task_results"""
)
def rate_limit_errors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "task_results").select("result_id", tx.is_rate_limit(F.col("error")).alias("limited"))


# ---------------------------------------------------------------- joins


@query(
    """WITH r AS (SELECT * FROM task_results QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY finished_at DESC, result_id DESC) = 1),
        t AS (SELECT DISTINCT task_id, thread_id, module_path, priority FROM migration_tasks)
    SELECT t.task_id, t.thread_id, t.module_path, r.status, r.branch_name FROM t LEFT JOIN r USING (task_id)"""
)
def last_results(s: SparkSession, d: str) -> DataFrame:
    last = sequences.last_per_key(table(s, d, "task_results"), ["task_id"], "finished_at", "result_id")
    tasks = table(s, d, "migration_tasks").select("task_id", "thread_id", "module_path").distinct()
    return tasks.join(last.select("task_id", "status", "branch_name"), "task_id", "left")


@query(
    """WITH t AS (SELECT DISTINCT task_id, thread_id, module_path, priority FROM migration_tasks WHERE module_path NOT IN (SELECT module_path FROM task_results WHERE module_path IS NOT NULL)),
        f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY thread_id, module_path ORDER BY priority, task_id) = 1)
    SELECT thread_id, task_id, module_path, priority FROM f QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY priority, task_id) <= 3"""
)
def ready_tasks(s: SparkSession, d: str) -> DataFrame:
    """The next three of each run: no result for the path yet, one task a path."""
    tasks = table(s, d, "migration_tasks").select("task_id", "thread_id", "module_path", "priority").distinct()
    open_ = tasks.join(table(s, d, "task_results").select("module_path"), "module_path", "left_anti")
    first = sequences.first_per_key(open_, ["thread_id", "module_path"], "priority", "task_id")
    return sequences.top_per_group(first, ["thread_id"], 3, F.asc("priority"), F.asc("task_id")).select("thread_id", "task_id", "module_path", "priority")


@query("SELECT DISTINCT task_id FROM migration_tasks t WHERE NOT EXISTS (SELECT 1 FROM task_results r WHERE r.task_id = t.task_id)")
def tasks_without_result(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "migration_tasks").select("task_id").distinct().join(table(s, d, "task_results").select("task_id"), "task_id", "left_anti")


@query(
    """WITH t AS (SELECT module_path, max(task_id) AS task FROM migration_tasks GROUP BY module_path)
    SELECT r.result_id, coalesce(t.task, r.module_path) AS task FROM task_results r LEFT JOIN t USING (module_path)"""
)
def task_of_result(s: SparkSession, d: str) -> DataFrame:
    last = table(s, d, "migration_tasks").groupBy("module_path").agg(F.max("task_id").alias("task"))
    return table(s, d, "task_results").join(last, "module_path", "left").select("result_id", F.coalesce("task", "module_path").alias("task"))


@query("SELECT r.repo, r.team, count(DISTINCT c.file_path) AS files, count(c.chunk_id) AS chunks FROM repos r LEFT JOIN code_chunks c USING (repo) GROUP BY r.repo, r.team")
def repo_sizes(s: SparkSession, d: str) -> DataFrame:
    # Files first, then repos: a repo with a third of all chunks is summed up before it is shuffled by its name.
    files = table(s, d, "code_chunks").groupBy("repo", "file_path").agg(F.count("*").alias("n")).groupBy("repo").agg(F.count("file_path").alias("files"), F.sum("n").alias("chunks"))
    return table(s, d, "repos").select("repo", "team").join(files, "repo", "left").fillna(0, ["files", "chunks"])


@query(
    """WITH t AS (SELECT DISTINCT task_id, thread_id, priority, depends_on FROM migration_tasks), e AS (SELECT task_id, thread_id, priority, unnest(depends_on) AS dep FROM t)
    SELECT e.task_id, e.dep FROM e JOIN (SELECT DISTINCT task_id AS dep, thread_id, priority AS p FROM t) x ON e.dep = x.dep AND e.thread_id = x.thread_id WHERE x.p < e.priority"""
)
def earlier_dependencies(s: SparkSession, d: str) -> DataFrame:
    tasks = table(s, d, "migration_tasks").select("task_id", "thread_id", "priority", "depends_on").distinct()
    edges = tasks.select("task_id", "thread_id", "priority", F.explode("depends_on").alias("dep"))
    known = tasks.select(F.col("task_id").alias("dep"), "thread_id", F.col("priority").alias("p")).distinct()
    return edges.join(known, ["dep", "thread_id"]).filter("p < priority").select("task_id", "dep")


@query(
    """WITH t AS (SELECT DISTINCT task_id, retrieved_context_ids FROM migration_tasks), e AS (SELECT task_id, unnest(retrieved_context_ids) AS point_id FROM t)
    SELECT task_id, count(*) AS listed, count(*) FILTER (WHERE point_id IN (SELECT point_id FROM code_chunks)) AS known FROM e GROUP BY task_id"""
)
def known_context(s: SparkSession, d: str) -> DataFrame:
    tasks = table(s, d, "migration_tasks").select("task_id", "retrieved_context_ids").distinct()
    points = table(s, d, "code_chunks").select("point_id").distinct().withColumn("there", F.lit(1))
    return tasks.select("task_id", F.explode("retrieved_context_ids").alias("point_id")).join(points, "point_id", "left").groupBy("task_id").agg(F.count("*").alias("listed"), F.count("there").alias("known"))


@query(
    r"""WITH f AS (SELECT DISTINCT file_path FROM code_chunks), t AS (SELECT file_path, regexp_replace(file_path, '([^/]+)$', 'test_\1') AS test FROM f),
        g AS (SELECT file_path FROM f UNION SELECT test FROM t WHERE file_path LIKE '%.py')
    SELECT t.file_path, t.test, t.test IN (SELECT file_path FROM g) AS adjacent, t.test IN (SELECT file_path FROM f) AS there FROM t"""
)
def adjacent_tests(s: SparkSession, d: str) -> DataFrame:
    """Where each file's test would lie, and whether it is there: among the files, and among the files and the tests that Python files would have."""
    files = table(s, d, "code_chunks").select("file_path").distinct()
    placed = files.withColumn("test", tx.test_path(F.col("file_path")))
    would = files.select(F.col("file_path").alias("test")).union(placed.filter("file_path like '%.py'").select("test")).distinct()
    found = placed.join(would.withColumn("a", F.lit(True)), "test", "left").join(files.select(F.col("file_path").alias("test"), F.lit(True).alias("b")), "test", "left")
    return found.select("file_path", "test", F.coalesce("a", F.lit(False)).alias("adjacent"), F.coalesce("b", F.lit(False)).alias("there"))


# ---------------------------------------------------------------- aggregations


@query("SELECT CAST(finished_at AS DATE) AS day, count(*) AS results, count(DISTINCT task_id) AS tasks, CAST(coalesce(sum(tokens_used), 0) AS BIGINT) AS tokens FROM task_results GROUP BY 1")
def daily_rollup(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "task_results")
    return r.groupBy(F.to_date("finished_at").alias("day")).agg(F.count("*").alias("results"), F.count_distinct("task_id").alias("tasks"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"))


@query(
    """WITH t AS (SELECT DISTINCT task_id, thread_id FROM migration_tasks)
    SELECT t.thread_id, count(DISTINCT t.task_id) AS tasks, count(DISTINCT r.task_id) AS with_result, CAST(coalesce(sum(r.tokens_used), 0) AS BIGINT) AS tokens,
        CAST(trunc(count(DISTINCT r.task_id) / count(DISTINCT t.task_id) * 100) AS INTEGER) AS percent, coalesce(bool_or(r.status = 'failed'), false) AS any_failed
    FROM t LEFT JOIN task_results r USING (task_id) GROUP BY t.thread_id"""
)
def run_summaries(s: SparkSession, d: str) -> DataFrame:
    tasks = table(s, d, "migration_tasks").select("task_id", "thread_id").distinct()
    per = table(s, d, "task_results").groupBy("task_id").agg(F.sum("tokens_used").alias("tokens"), F.bool_or(F.col("status") == "failed").alias("failed"), F.lit(1).alias("r"))
    own = tasks.join(per, "task_id", "left").groupBy("thread_id").agg(F.count("*").alias("tasks"), F.count("r").alias("with_result"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.bool_or("failed"), F.lit(False)).alias("any_failed"))
    return own.withColumn("percent", tx.percent(F.col("with_result"), F.col("tasks")))


@query(
    """WITH e AS (SELECT user_id, event_type, round(sum(value), 2) AS total FROM events GROUP BY ALL)
    SELECT user_id, string_agg(event_type || '=' || printf('%.2f', total), ',' ORDER BY event_type) AS breakdown FROM e GROUP BY user_id"""
)
def breakdown_maps(s: SparkSession, d: str) -> DataFrame:
    per = table(s, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 2).alias("total"))
    entries = F.array_sort(F.collect_list(F.concat("event_type", F.lit("="), F.format_string("%.2f", "total"))))  # as many as event types
    return per.groupBy("user_id").agg(F.array_join(entries, ",").alias("breakdown"))


@query(
    """SELECT file_path, string_agg(coalesce(chunk_index, -1) || '. ' || content[1:400], chr(10) || chr(10) ORDER BY chunk_index NULLS FIRST, doc_chunk_id) AS sections FROM doc_chunks WHERE content IS NOT NULL GROUP BY file_path"""
)
def ordered_sections(s: SparkSession, d: str) -> DataFrame:
    piece = F.concat(F.coalesce("chunk_index", F.lit(-1)).cast("string"), F.lit(". "), F.substring("content", 1, 400))
    own = table(s, d, "doc_chunks").filter("content is not null").select("file_path", F.struct("chunk_index", "doc_chunk_id", piece.alias("p")).alias("x"))
    return own.groupBy("file_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["p"]), "\n\n").alias("sections"))


@query(
    """WITH t AS (SELECT DISTINCT task_id, complexity, risk_level, priority FROM migration_tasks)
    SELECT complexity, risk_level, count(*) AS n, round(avg(priority), 4) AS mean_priority FROM t GROUP BY GROUPING SETS ((complexity), (risk_level), ())"""
)
def task_breakdowns(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "migration_tasks").select("task_id", "complexity", "risk_level", "priority").distinct()
    sets = [[F.col("complexity")], [F.col("risk_level")], []]
    return t.groupingSets(sets, F.col("complexity"), F.col("risk_level")).agg(F.count("*").alias("n"), F.round(F.avg("priority"), 4).alias("mean_priority"))


@query("SELECT source, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY mean_chars DESC, source LIMIT 1")
def longest_source(s: SparkSession, d: str) -> DataFrame:
    own = table(s, d, "documents").filter("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))
    return evals.best(own, "mean_chars", order="source")


@query(
    """SELECT target_framework, migration_type, count(*) AS n, CAST(sum(success_count) AS BIGINT) AS successes FROM migration_patterns GROUP BY CUBE (target_framework, migration_type)"""
)
def pattern_cube(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "migration_patterns").cube("target_framework", "migration_type").agg(F.count("*").alias("n"), F.sum("success_count").alias("successes"))


# ---------------------------------------------------------------- windows


@query("SELECT thread_id, task_id, dense_rank() OVER (PARTITION BY thread_id ORDER BY priority, task_id) - 1 AS place FROM (SELECT DISTINCT thread_id, task_id, priority FROM migration_tasks)")
def dense_priorities(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "migration_tasks").select("thread_id", "task_id", "priority").distinct()
    return t.select("thread_id", "task_id", (F.dense_rank().over(Window.partitionBy("thread_id").orderBy("priority", "task_id")) - 1).cast("bigint").alias("place"))


@query(
    """WITH c AS (SELECT DISTINCT file_path, start_line, end_line FROM code_chunks WHERE start_line IS NOT NULL),
        g AS (SELECT *, coalesce(lag(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line), 0) AS b FROM c)
    SELECT file_path, start_line, end_line, CAST(greatest(start_line - b - 1, 0) AS INTEGER) AS gap FROM g"""
)
def chunk_gaps(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "code_chunks").filter("start_line is not null").select("file_path", "start_line", "end_line").distinct()
    return sequences.gaps(c, ["file_path"], "start_line", "end_line").select("file_path", "start_line", "end_line", "gap")


@query(
    r"""WITH o AS (SELECT file_path, start_line, content FROM code_chunks WHERE start_line IS NOT NULL AND content IS NOT NULL AND file_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_path, start_line ORDER BY chunk_id) = 1),
        l AS (SELECT file_path, start_line + i - 1 AS line, string_split(content, chr(10))[i] AS t FROM (SELECT file_path, start_line, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM o)),
        c AS (SELECT DISTINCT file_path, start_line, end_line FROM code_chunks WHERE start_line IS NOT NULL AND end_line IS NOT NULL AND node_type IN ('function', 'class')),
        p AS (SELECT *, row_number() OVER w AS k, lag(end_line) OVER w AS prev FROM c WINDOW w AS (PARTITION BY file_path ORDER BY start_line, end_line)),
        e AS (SELECT file_path, min(start_line) AS a, max(end_line) AS b FROM c GROUP BY file_path),
        g AS (SELECT l.file_path, l.line, l.t, CASE WHEN e.a IS NULL OR l.line < e.a THEN 0 WHEN l.line > e.b THEN 1000000 ELSE p.k END AS k FROM l LEFT JOIN e USING (file_path)
            LEFT JOIN p ON p.file_path = l.file_path AND l.line BETWEEN coalesce(p.prev + 1, p.start_line) AND p.end_line),
        s AS (SELECT file_path, k, CASE k WHEN 0 THEN 'preamble' WHEN 1000000 THEN 'epilogue' ELSE 'section' END AS kind, bool_or(trim(t, E' \t\r\f') <> '') AS solid, sum(length(replace(t, ' ', ''))) AS n FROM g GROUP BY file_path, k)
    SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY k) - 1 AS pos, kind, CAST(n AS BIGINT) AS solid_chars FROM s WHERE solid"""
)
def file_segments(s: SparkSession, d: str) -> DataFrame:
    """Files put together from their chunks and cut along their functions and classes: what stands around these is preamble, part of a section, or epilogue."""
    chunks = table(s, d, "code_chunks")
    own = chunks.filter("node_type in ('function', 'class')").select("file_path", "start_line", "end_line").distinct()
    cut = sequences.segments(tf.assembled(chunks), own)
    return cut.select("file_path", F.col("pos").cast("bigint").alias("pos"), "kind", F.length(F.translate("content", " \n", "")).cast("bigint").alias("solid_chars"))


@query(
    """WITH t AS (SELECT DISTINCT task_id, thread_id FROM migration_tasks), r AS (SELECT t.thread_id, r.result_id, r.finished_at, r.tokens_used FROM t JOIN task_results r USING (task_id))
    SELECT thread_id, result_id, CAST(sum(coalesce(tokens_used, 0)) OVER w AS BIGINT) AS running, sum(coalesce(tokens_used, 0)) OVER w > 5000 AS over
    FROM r WINDOW w AS (PARTITION BY thread_id ORDER BY finished_at, result_id ROWS UNBOUNDED PRECEDING)"""
)
def running_tokens(s: SparkSession, d: str) -> DataFrame:
    tasks = table(s, d, "migration_tasks").select("task_id", "thread_id").distinct()
    own = tasks.join(table(s, d, "task_results"), "task_id")
    return sequences.running_total(own, ["thread_id"], ["finished_at", "result_id"], "tokens_used", 5000).select("thread_id", "result_id", "running", "over")


@query(
    """WITH i AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
    SELECT event_id, CAST(sum(f) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS streak FROM i"""
)
def error_streaks(s: SparkSession, d: str) -> DataFrame:
    own = sequences.streaks(table(s, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")
    return own.select("event_id", "streak")


@query(
    """WITH b AS (SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events)
    SELECT event_id, user_id, value FROM b WHERE value IS NOT NULL AND (top IS NULL OR value > top)"""
)
def step_changes(s: SparkSession, d: str) -> DataFrame:
    return sequences.step_changes(table(s, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "value")


@query("SELECT repo, file_path, n FROM (SELECT repo, file_path, count(*) AS n FROM code_chunks GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY n DESC, file_path) <= 3")
def largest_files(s: SparkSession, d: str) -> DataFrame:
    own = table(s, d, "code_chunks").groupBy("repo", "file_path").agg(F.count("*").alias("n"))
    return sequences.top_per_group(own, ["repo"], 3, F.desc("n"), F.asc("file_path"))


# ---------------------------------------------------------------- sets and upserts


@query("SELECT 'code' AS collection, CAST(chunk_id AS VARCHAR) AS id, file_path, NULL AS title FROM code_chunks UNION ALL SELECT 'docs', CAST(doc_chunk_id AS VARCHAR), file_path, title FROM doc_chunks")
def all_collections(s: SparkSession, d: str) -> DataFrame:
    code = table(s, d, "code_chunks").select(F.lit("code").alias("collection"), F.col("chunk_id").cast("string").alias("id"), "file_path")
    docs = table(s, d, "doc_chunks").select(F.lit("docs").alias("collection"), F.col("doc_chunk_id").cast("string").alias("id"), "file_path", "title")
    return code.unionByName(docs, allowMissingColumns=True)


@query("SELECT module_path FROM migration_tasks EXCEPT SELECT module_path FROM task_results WHERE status = 'failed'")
def paths_without_failure(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "migration_tasks").select("module_path").subtract(table(s, d, "task_results").filter("status = 'failed'").select("module_path"))


@query("SELECT module_path FROM migration_tasks INTERSECT SELECT file_path FROM code_chunks")
def planned_files(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "migration_tasks").select("module_path").intersect(table(s, d, "code_chunks").select("file_path"))


@query(
    """WITH c AS (SELECT point_id, file_path, content, ingested_at, chunk_id FROM code_chunks QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY ingested_at DESC, chunk_id DESC) = 1)
    SELECT point_id, file_path, chunk_id, length(content) AS n_chars FROM c"""
)
def latest_points(s: SparkSession, d: str) -> DataFrame:
    own = sequences.last_per_key(table(s, d, "code_chunks").select("point_id", "file_path", "chunk_id", "ingested_at", F.length("content").cast("bigint").alias("n_chars")), ["point_id"], "ingested_at", "chunk_id")
    return own.select("point_id", "file_path", "chunk_id", "n_chars")


@query(
    """WITH o AS (SELECT task_id, min(finished_at) AS first_at, CAST(sum(tokens_used) AS BIGINT) AS tokens FROM task_results WHERE finished_at < TIMESTAMP '2024-07-01' GROUP BY 1),
        n AS (SELECT task_id, min(finished_at) AS first_at, CAST(sum(tokens_used) AS BIGINT) AS tokens FROM task_results WHERE finished_at >= TIMESTAMP '2024-07-01' GROUP BY 1)
    SELECT coalesce(o.task_id, n.task_id) AS task_id, coalesce(o.first_at, n.first_at) AS first_at,
        CASE WHEN o.tokens IS NULL AND n.tokens IS NULL THEN NULL ELSE coalesce(o.tokens, 0) + coalesce(n.tokens, 0) END AS tokens FROM o FULL JOIN n USING (task_id)"""
)
def upserted_ledger(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "task_results")

    def ledger(part: DataFrame) -> DataFrame:
        return part.groupBy("task_id").agg(F.min("finished_at").alias("first_at"), F.sum("tokens_used").alias("tokens"))

    cut = F.expr("timestamp_ntz'2024-07-01 00:00:00'")
    return sinks.upserted(ledger(r.filter(F.col("finished_at") < cut)), ledger(r.filter(F.col("finished_at") >= cut)), ["task_id"], {"first_at": "keep", "tokens": "add"})


# ---------------------------------------------------------------- retrieval

_DENSE = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
    dense AS (SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.vec, v.vec), 6) AS score FROM v q, v WHERE q.id % 50 = 0),
    dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM dense)"""
_SPARSE = r"""tok AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_ß-öø-ÿ]+') AS words FROM documents),
    tf AS (SELECT id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT id, len(words) AS n, unnest(words) AS term FROM tok) GROUP BY id, term),
    post AS (SELECT id, term, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256.0)) AS weight FROM tf),
    qtok AS (SELECT doc_id AS query_id, regexp_extract_all(lower(title), '[a-z0-9_ß-öø-ÿ]+') AS words FROM documents WHERE doc_id % 50 = 0),
    qtf AS (SELECT query_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT query_id, len(words) AS n, unnest(words) AS term FROM qtok) GROUP BY query_id, term),
    qp AS (SELECT query_id, term, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256.0)) AS wq FROM qtf),
    sparse AS (SELECT query_id, id, round(sum(wq * weight), 6) AS score FROM qp JOIN post USING (term) GROUP BY query_id, id),
    sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM sparse)"""


def _dense(s: SparkSession, d: str, k: int, among: DataFrame | None = None) -> DataFrame:
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return vectors.nearest(v.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), v.join(among, "id", "left_semi") if among else v, k)


def _sparse(s: SparkSession, d: str, k: int, among: DataFrame | None = None) -> DataFrame:
    docs = table(s, d, "documents")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    postings = vectors.term_weights(texts.join(among, "id", "left_semi") if among else texts)
    terms = vectors.term_weights(docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("id"), F.col("title").alias("text"))).withColumnRenamed("id", "query_id")
    return vectors.sparse_nearest(terms, postings, k)


@query(f"WITH {_DENSE} SELECT query_id, id, score, rank FROM dr WHERE rank < 10")
def dense_topk(s: SparkSession, d: str) -> DataFrame:
    return _dense(s, d, 10).select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {_SPARSE} SELECT query_id, id, score, rank FROM sr WHERE rank < 10")
def sparse_topk(s: SparkSession, d: str) -> DataFrame:
    return _sparse(s, d, 10).select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


def _fused_sql(alphas: str) -> str:
    return f"""WITH {_DENSE}, {_SPARSE}, a AS (SELECT unnest({alphas}) AS alpha),
    f AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.id, y.id) AS id, x.rank AS xr, y.rank AS yr
        FROM (SELECT * FROM dr WHERE rank < 160) x FULL JOIN (SELECT * FROM sr WHERE rank < 160) y ON x.query_id = y.query_id AND x.id = y.id),
    g AS (SELECT alpha, query_id, id, xr, yr, round(coalesce(alpha / (60 + xr + 1), 0) + coalesce((1 - alpha) / (60 + yr + 1), 0), 12) AS score FROM f, a)
    SELECT alpha, query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, xr NULLS LAST, yr NULLS LAST, id) - 1 AS rank FROM g
    QUALIFY rank < 10"""


@query(_fused_sql("[0.5]").replace("SELECT alpha, query_id, id, round(score, 9)", "SELECT query_id, id, round(score, 9)"))
def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    """The ten best of the fusion of vectors and words; every document whose id is divisible by 50 is a query."""
    _, side, _, final, _ = retrieval.limits(10)
    out = retrieval.fuse(_dense(s, d, side), _sparse(s, d, side), 0.5, final)
    return out.select("query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(_fused_sql("[0.0, 0.5, 0.7, 1.0]::DOUBLE[]"))
def alpha_sweep(s: SparkSession, d: str) -> DataFrame:
    side = retrieval.limits(10)[1]
    out = retrieval.sweep(_dense(s, d, side), _sparse(s, d, side), s)
    return out.select("alpha", "query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    rf"""WITH {_SPARSE}, h AS (SELECT query_id, id, rank FROM sr WHERE rank < 20),
    q AS (SELECT doc_id AS query_id, list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9_ß-öø-ÿ]+')) AS qw FROM documents WHERE doc_id % 50 = 0),
    c AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_ß-öø-ÿ]+')) AS cw FROM documents),
    s2 AS (SELECT h.query_id, h.id, h.rank AS prior, CASE WHEN len(qw) > 0 THEN round(len(list_intersect(qw, cw)) / len(qw), 6) ELSE 0.0 END AS score FROM h JOIN q USING (query_id) JOIN c USING (id))
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prior) - 1 AS rank FROM s2 QUALIFY rank < 6"""
)
def reranked(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    hits = retrieval.rerank(_sparse(s, d, 20), docs.select(F.col("doc_id").alias("query_id"), F.col("title").alias("query")), docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")), 6)
    return hits.select("query_id", "id", "score", F.col("rank").cast("bigint").alias("rank"))


_PATTERNS = "v AS (SELECT pattern_id AS id, CAST(embedded_signature AS DOUBLE[]) AS vec FROM migration_patterns WHERE len(embedded_signature) = 64 AND list_max(list_transform(embedded_signature, lambda x: abs(x))) > 0)"


def _signatures(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "migration_patterns").select(F.col("pattern_id").alias("id"), F.col("embedded_signature").alias("vec"))


@query(
    f"""WITH {_PATTERNS}, x AS (SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.vec, v.vec), 6) AS score FROM v q, v WHERE q.id % 50 = 0)
    SELECT query_id, id, score FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3"""
)
def similar_patterns(s: SparkSession, d: str) -> DataFrame:
    v = _signatures(s, d)
    return vectors.nearest(v.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), v, 3).select("query_id", "id", "score")


@query(f"WITH {_PATTERNS}, x AS (SELECT q.id AS query_id, v.id, round(list_cosine_similarity(q.vec, v.vec), 6) AS score FROM v q, v WHERE q.id % 50 = 0) SELECT query_id, id, score FROM x WHERE score >= 0.95 AND query_id <> id")
def known_patterns(s: SparkSession, d: str) -> DataFrame:
    v = _signatures(s, d)
    return vectors.nearest(v.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), v, None, threshold=0.95).filter("query_id <> id").select("query_id", "id", "score")


@query()
def recorded_patterns(s: SparkSession, d: str) -> DataFrame:
    """Patterns whose id is divisible by 50 arriving at a store of all others. Each depends on what arrived before, which SQL can't say."""
    v = _signatures(s, d)
    return patterns.record(v.filter("id % 50 <> 0"), v.filter("id % 50 = 0"))


# ---------------------------------------------------------------- evaluation


@query(
    f"""WITH {_DENSE}, h AS (SELECT dr.query_id, q.label, min(CASE WHEN x.label = q.label THEN dr.rank END) + 1 AS found_at
        FROM dr JOIN v q ON q.id = dr.query_id JOIN v x ON x.id = dr.id WHERE dr.rank < 11 AND dr.id <> dr.query_id GROUP BY ALL)
    SELECT label, count(*) AS n, round(avg(CASE WHEN found_at IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / found_at, 0)), 6) AS mrr FROM h GROUP BY label"""
)
def hit_rates(s: SparkSession, d: str) -> DataFrame:
    labels = table(s, d, "embeddings").select("vec_id", "label")
    hits = _dense(s, d, 11).filter("id <> query_id").join(labels.toDF("query_id", "label"), "query_id").join(labels.toDF("id", "other"), "id")
    ranks = hits.groupBy("query_id", "label").agg((F.min(F.when(F.col("label") == F.col("other"), F.col("rank"))) + 1).alias("found_at"))
    return evals.hit_rate(ranks, "label")


@query(
    f"""WITH {_DENSE}, l AS (SELECT query_id, list(id ORDER BY rank) AS found FROM dr WHERE rank < 10 GROUP BY query_id),
    t AS (SELECT label, list(id ORDER BY id) AS truth FROM v GROUP BY label),
    m AS (SELECT l.query_id, v.label, len(list_intersect(l.found[1:5], t.truth)) / len(t.truth) AS recall,
        coalesce(1.0 / list_min(list_filter(list_transform(range(1, 11), lambda i: CASE WHEN list_contains(t.truth, l.found[i]) THEN i END), lambda x: x IS NOT NULL)), 0) AS mrr,
        list_sum(list_transform(range(1, 6), lambda i: CASE WHEN list_contains(t.truth, l.found[i]) THEN 1 / log2(i + 1) ELSE 0 END)) / list_sum(list_transform(range(1, 1 + least(len(t.truth), 5)), lambda i: 1 / log2(i + 1))) AS ndcg
        FROM l JOIN v ON v.id = l.query_id JOIN t USING (label))
    SELECT label, count(*) AS n, round(avg(round(recall, 6)), 4) AS recall, round(avg(round(mrr, 6)), 4) AS mrr, round(avg(round(ndcg, 6)), 4) AS ndcg FROM m GROUP BY GROUPING SETS ((label), ())"""
)
def retrieval_quality(s: SparkSession, d: str) -> DataFrame:
    labels = table(s, d, "embeddings").select("vec_id", "label")
    queries = labels.filter("vec_id % 50 = 0").toDF("query_id", "label").join(labels.groupBy("label").agg(F.count("*").alias("size")), "label")
    hits = _dense(s, d, 10).join(labels.toDF("query_id", "label"), "query_id").join(labels.toDF("id", "other"), "id")
    return evals.summary(evals.graded(hits.select("query_id", "rank", (F.col("label") == F.col("other")).alias("relevant")), queries), "label")


# ---------------------------------------------------------------- graphs

_GRAPH = """t AS (SELECT DISTINCT task_id, depends_on FROM migration_tasks), n AS (SELECT DISTINCT task_id AS node FROM t),
    e AS (SELECT DISTINCT src, dst FROM (SELECT task_id AS src, unnest(depends_on) AS dst FROM t) WHERE src <> dst AND dst IN (SELECT node FROM n))"""


def _tasks_graph(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(s, d, "migration_tasks")
    nodes = t.select(F.col("task_id").alias("node")).distinct()
    return nodes, graph.known_edges(t.select(F.col("task_id").alias("src"), F.explode("depends_on").alias("dst")), nodes)


@query(f"WITH {_GRAPH} SELECT src, dst FROM e")
def dependency_edges(s: SparkSession, d: str) -> DataFrame:
    return _tasks_graph(s, d)[1]


@query(
    f"""WITH {_GRAPH}, o AS (SELECT src AS node, count(*) AS c FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS c FROM e GROUP BY 1)
    SELECT n.node, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) = 0 AS is_leaf, coalesce(i.c, 0) = 0 AS is_entry FROM n LEFT JOIN o USING (node) LEFT JOIN i USING (node)"""
)
def degree_roles(s: SparkSession, d: str) -> DataFrame:
    return graph.roles(*_tasks_graph(s, d))


@query(
    f"""WITH RECURSIVE {_GRAPH}, p AS (SELECT node, 0 AS level FROM n UNION SELECT e.src, p.level + 1 FROM p JOIN e ON e.dst = p.node WHERE p.level < 200)
    SELECT node, CAST(max(level) AS BIGINT) AS batch FROM p GROUP BY node"""
)
def migration_order(s: SparkSession, d: str) -> DataFrame:
    """Dependencies of tasks have no cycles, so the SQL need not know them; the tests have graphs with cycles."""
    return graph.migration_order(*_tasks_graph(s, d)).select("node", F.col("batch").cast("bigint").alias("batch"))


@query()
def python_import_edges(s: SparkSession, d: str) -> DataFrame:
    """Imports of Python files, resolved; the syntax tree has no SQL."""
    files = tf.assembled(table(s, d, "code_chunks").filter("lower(file_path) like '%.py'"))
    found = files.select(tx.module_name(F.col("file_path")).alias("src"), F.explode(tf.python_imports(F.col("content"))).alias("i"))
    return found.select("src", tx.import_target(F.col("i"), F.col("src")).alias("dst")).filter("dst is not null and src <> dst").distinct()


@query(
    r"""WITH f AS (SELECT DISTINCT file_path, regexp_replace(content, '("(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*''|`(?:[^`\\]|\\[\s\S])*`)|//[^\n]*|/\*[\s\S]*?\*/', '\1', 'g') AS content
        FROM code_chunks WHERE regexp_matches(lower(file_path), '\.(ts|tsx|js|jsx)$'))
    SELECT DISTINCT file_path, unnest(regexp_extract_all(content, '(?:\bimport\s*(?:[\w$*{},\s]+\bfrom\s*)?|\brequire\s*\(\s*)["''](\.{1,2}/[^"'']*)["'']', 1)) AS spec FROM f"""
)
def script_imports(s: SparkSession, d: str) -> DataFrame:
    own = table(s, d, "code_chunks").filter(F.lower("file_path").rlike(r"\.(ts|tsx|js|jsx)$"))
    return own.select("file_path", F.explode(tf.script_imports(F.col("content"))).alias("spec")).distinct()


@query()
def markdown_chunks(s: SparkSession, d: str) -> DataFrame:
    """The recursive splitter over all documents; its recursion has no SQL, the tests compare it with worked examples."""
    own = table(s, d, "documents").select("doc_id", F.posexplode(tf.markdown_chunks(F.col("text"))).alias("chunk_index", "content"))
    return own.select("doc_id", "chunk_index", tx.title(F.col("content")).alias("title"), "content")


@query()
def ingested_docs(s: SparkSession, d: str) -> DataFrame:
    """Documents as points with keys, titles and vectors; the splitter has no SQL."""
    from tessera.plans import ingest

    return ingest.doc_points(table(s, d, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content")))


@query()
def diff_summaries(s: SparkSession, d: str) -> DataFrame:
    own = table(s, d, "migration_patterns")
    return own.select("pattern_id", tf.diff_summary(F.col("before_code"), F.col("after_code"), F.concat(F.lit("pattern_"), F.col("pattern_id"))).alias("diff"))


@query(
    """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS provider, ts, kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, kind) AS i
        FROM (SELECT user_id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'success' ELSE 'check' END AS kind FROM events)),
    r AS (SELECT provider, ts, kind, i, CASE WHEN kind = 'error' THEN 1 ELSE 0 END AS errors, NULL::TIMESTAMP AS tripped FROM e WHERE i = 1
        UNION ALL SELECT e.provider, e.ts, e.kind, e.i,
            CASE WHEN e.kind = 'error' THEN r.errors + 1 WHEN e.kind = 'success' OR epoch(e.ts) - epoch(r.tripped) > 300 THEN 0 ELSE r.errors END,
            CASE WHEN e.kind = 'error' AND r.errors >= 2 THEN e.ts WHEN e.kind = 'check' AND epoch(e.ts) - epoch(r.tripped) > 300 THEN NULL ELSE r.tripped END
        FROM r JOIN e ON e.provider = r.provider AND e.i = r.i + 1)
    SELECT provider, ts, kind, tripped IS NOT NULL AS is_open FROM r"""
)
def breaker_states(s: SparkSession, d: str) -> DataFrame:
    """Circuit breakers over the events of each user: errors open them, views are successes, all else are checks."""
    from tessera.streaming import stateful

    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "success").otherwise("check")
    own = stateful.breakers(table(s, d, "events").select(F.col("user_id").alias("provider"), "ts", kind.alias("kind")))
    return own.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    """SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"""
)
def hourly_events(s: SparkSession, d: str) -> DataFrame:
    from tessera.streaming import stateful

    own = stateful.windowed(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value")
    return own.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


from tessera import catalog_runs  # noqa: E402, F401  (its queries join the others)
