import pytest
from pyspark.sql import functions as F

from tessera.operators import contexts, graph, runs


def test_states_and_firsts(spark, rows):
    tasks = spark.createDataFrame([("r", "a"), ("r", "b")], "thread_id string, module_path string")
    results = spark.createDataFrame([("r", "a", 1, "failed", 5, None), ("r", "a", 2, "success", None, "x"), ("q", "b", 1, "success", 3, "y")], "thread_id string, module_path string, at int, status string, tokens_used int, branch_name string")
    got = runs.task_states(tasks, results, ["thread_id", "module_path"], "at").select("module_path", "status", "tokens_used", "branch_name", "has_branch")
    assert rows(got) == [("a", "success", 0, "x", True), ("b", None, 0, "—", False)]
    assert rows(runs.first_value(results, "module_path", "branch_name", "at")) == [("a", "x"), ("b", "y")]
    assert rows(runs.latest_state(results, "module_path", "at", "status")) == [("a", 2, "success"), ("b", 1, "success")]
    assert rows(runs.latest_state(results.limit(0), "module_path", "at", "status")) == []
    assert rows(runs.surviving(results, results.filter("status = 'success'").select("thread_id", "module_path"), "at")) == [("q", "b", "y"), ("r", "a", "x")]


def test_outcomes_of_nothing_and_something(spark, rows):
    tasks = spark.createDataFrame([("r", "1"), ("r", "1"), ("r", "2")], "thread_id string, task_id string")
    results = spark.createDataFrame([("r", "failed", 2), ("s", "success", None)], "thread_id string, status string, tokens_used int")
    paths = spark.createDataFrame([("r", "a"), ("r", "b")], "thread_id string, module_path string")
    got = runs.outcomes(tasks, results, paths.filter("module_path = 'a'"), paths)
    assert rows(got) == [("r", 2, 1, 2, 2, 0.5), ("s", 0, 0, 0, 0, 1.0)]


def test_queue_gives_smallest_score_then_first_member(spark, rows):
    q = spark.createDataFrame([("q", "b", 1, 1), ("q", "a", 1, 1), ("q", "c", 0, 1), ("q", "c", 5, 2), ("p", "z", 9, 1)], "queue string, member string, score int, pushed int")
    none = spark.createDataFrame([], "queue string, member string")
    assert rows(runs.next_in_queue(q, none)) == [("p", "z", 9), ("q", "a", 1)]
    assert rows(runs.next_in_queue(q, spark.createDataFrame([("q", "a"), ("q", "a"), ("p", "z")], "queue string, member string"))) == [("q", "b", 1)]


def test_gauntlet_and_verdicts(spark, rows):
    log = [("m", 0, "lint", 1, " bad \n"), ("m", 0, "types", 2, None), ("m", 1, "lint", 0, "x"), ("m", 1, "types", 1, "t"), ("m", 2, "lint", 0, ""), ("n", 0, "types", 0, ""), ("n", 0, "lint", 0, ""), ("o", 0, "lint", 1, "a"), ("o", 1, "lint", 1, "b" * 600), ("o", 2, "lint", 1, "c"), ("o", 3, "lint", 0, "")]
    checks = spark.createDataFrame(log, "key string, attempt int, name string, code int, output string")
    attempts = runs.gauntlet(checks, ("lint", "types"))
    assert rows(attempts.filter("key = 'm'")) == [("m", 0, False, "[lint]\nbad \n\n\n[types]\n"), ("m", 1, False, "[types]\nt"), ("m", 2, True, "")]
    assert rows(runs.verdicts(attempts)) == [("m", True, 2, None), ("n", True, 0, None), ("o", False, 2, "[lint]\nc")]
    assert rows(runs.verdicts(attempts, fixes=1).filter("key = 'o'").select(F.length("reason"))) == [(500,)]


def test_retries_only_on_limits(spark, rows):
    log = [("a", 0, True, False), ("a", 1, False, True), ("b", 0, False, False), ("b", 1, False, True), ("c", 0, True, False), ("c", 1, True, False), ("c", 2, True, False), ("c", 3, True, False), ("c", 4, False, True), ("d", 0, True, False)]
    got = runs.retried(spark.createDataFrame(log, "key string, attempt int, limited boolean, ok boolean"))
    assert rows(got) == [("a", 2, 10.0, "ok"), ("b", 1, 0.0, "failed"), ("c", 4, 100.0, "exhausted"), ("d", 1, 0.0, "failed")]


def test_texts(spark):
    df = spark.range(1)
    closed = F.array(F.lit("b"), F.lit("c"))
    choice = [runs.first_closed(F.array(*[F.lit(x) for x in c]), closed).alias(c) for c in ("abc", "axy")]
    cells = [runs.percent_text(F.lit(0.256)), runs.percent_text(F.lit(None).cast("double")), runs.money_text(F.lit(1.5))]
    parts = contexts.prompt(F.lit(" do it "), F.array(F.lit("x"), F.lit("y")), F.array().cast("array<string>"), F.lit("abcdef"), 3)
    assert tuple(df.select(*choice, *cells, parts, contexts.prompt(F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.array(F.lit("k")), F.lit(""))).first()) == ("b", "y", "25.6%", "—", "$1.5000", "do it\n\nChanges:\n- x\n- y\n\n```\nabc\n```", "Context: k")
    assert df.select(contexts.code_query(F.lit("a"), F.lit("b"), F.lit("c" * 500)), contexts.kind_of_change(F.lit("a"), F.lit("b"))).first()[:] == ("a b migration\n" + "c" * 400, "a→b")


def test_contexts_are_gathered_in_order(spark, rows):
    q = spark.createDataFrame([(1, "red fox"), (2, "nothing")], "query_id long, text string")
    code = spark.createDataFrame([(10, "red"), (11, "red fox"), (12, "fox red fox"), (13, "dog"), (14, None)], "id long, text string")
    hits = contexts.searched(q, code, 2)
    out = contexts.gathered(q, {"code": hits, "docs": hits.limit(0)})
    got = {r["query_id"]: r["context"] for r in out.collect()}
    assert got[2] == [] and len(got[1]) == 2 and set(got[1]) == {"code:11", "code:12"}


def test_module_graph(spark, rows):
    files = [
        ("r", "app/__init__.py", "from . import models\nfrom .views import x\nimport os"),
        ("r", "app/models.py", "import app.views\nfrom .nothing import y"),
        ("r", "app/views.py", "from ..app import models\nimport app.views"),
        ("r", "main.py", "from . import util\nimport app"),
        ("r", "util.py", "def ("),
        ("s", "util.py", "import main"),
        ("r", "web/index.ts", "import { a } from './a';\n// import './b'\nrequire('../web/b')"),
        ("r", "web/a.tsx", "import './index'; import './a'"),
        ("r", "web/b.js", "import '../../s/util'"),
        ("r", "notes.md", "import app"),
    ]
    sources = spark.createDataFrame(files, "repo string, path string, content string")
    assert rows(graph.module_edges(sources)) == [
        ("r", "app.models", "app.views"), ("r", "app.views", "app"), ("r", "main", "app"), ("r", "main", "util"), ("r", "web", "web.a"), ("r", "web", "web.b"), ("r", "web.a", "web"),
    ]
    known = graph.modules(sources.select("repo", F.col("path").alias("file_path"), "path"))
    assert known.count() == 9 and rows(graph.modules(spark.createDataFrame([("r", "a/x.ts", "a/x.ts"), ("r", "a/x.js", "a/x.js")], "repo string, file_path string, path string"))) == [("r", "a.x", "a/x.ts", 2)]
    named = spark.createDataFrame([("r", "app"), ("r", "app.models"), ("r", "gone")], "repo string, module string")
    assert rows(graph.module_files(named, sources.select("repo", "path"))) == [("r", "app", "app/__init__.py"), ("r", "app.models", "app/models.py"), ("r", "gone", None)]


@pytest.mark.parametrize("days,expected", [(1, [("2024-01-02", 1, 0, 0, 7)]), (10, [("2024-01-01", 1, 5, 4, 3), ("2024-01-02", 1, 0, 0, 7)])])
def test_cost_report_takes_recent_days_and_falls_back(spark, rows, days, expected):
    own = spark.createDataFrame([("a", None, 3), ("b", "2024-01-02 01:00:00", 7), ("c", None, 9)], "thread_id string, started_at string, tokens long").withColumn("started_at", F.col("started_at").cast("timestamp"))
    reports = spark.createDataFrame([("a", "2024-01-01 09:00:00", 5, 4)], "thread_id string, created_at string, total_tasks int, succeeded int").withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = runs.cost_report(own, reports, F.expr("timestamp'2024-01-03 00:00:00'"), days)
    assert rows(got.withColumn("day", F.col("day").cast("string"))) == expected


def test_command_line(spark, tmp_path, capsys):
    import json

    from tessera.__main__ import evaluate, main

    src = tmp_path / "src"
    (src / "docs").mkdir(parents=True)
    (src / "a.py").write_text("def parse_query(x):\n    return x\n\n\nclass Store:\n    size = 1\n")
    (src / "docs" / "g.md").write_text("# Guide\n\nHow to parse a query.\n")
    assert main(["ingest-code", str(src), str(tmp_path / "code")]) == 0 and main(["ingest-docs", str(src), str(tmp_path / "docs")]) == 0
    points = spark.read.parquet(str(tmp_path / "code"))
    wanted = points.filter("name = 'parse_query'").first()["point_id"]
    (tmp_path / "q.jsonl").write_text(json.dumps({"query": "parse_query", "ground_truth_chunk_ids": [wanted], "query_type": "exact", "difficulty": "easy"}))
    got = {r["query_type"]: (r["n"], r["recall"], r["mrr"]) for r in evaluate(spark, str(tmp_path / "q.jsonl"), str(tmp_path / "code")).collect()}
    assert got == {"exact": (1, 1.0, 1.0), None: (1, 1.0, 1.0)}
    assert main(["queries"]) == 0 and "hybrid_search" in capsys.readouterr().out


def test_models_and_seeds(spark, rows):
    from tessera.operators import patterns, retrieval

    hits = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2)], "query_id int, id string, rank int")
    queries, texts = spark.createDataFrame([(1, "x")], "query_id int, query string"), spark.createDataFrame([("a", "1"), ("b", "22"), ("c", None)], "id string, content string")
    score = retrieval.model_score(lambda: lambda q, c: [float(len(t)) for t in c])
    assert [r["id"] for r in retrieval.rerank(hits, queries, texts, 2, score).orderBy("rank").collect()] == ["b", "a"]
    store = spark.createDataFrame([("p", 7), ("q", 3)], "id string, success_count int")
    once = patterns.seeded(store, store.filter("id = 'p'"))
    assert rows(once) == rows(patterns.seeded(once, store.filter("id = 'p'"))) == [("p", 1), ("q", 3)]


def test_inputs_are_checked_and_runs_have_ids(spark, tmp_path):
    from tessera.operators import retrieval
    from tessera.sources import sinks

    assert retrieval.checked(" a ", 100, 0.0) == "a"
    for bad in ((" ", 5, None), ("a", 0, None), ("a", 101, None), ("a", 5, 1.1)):
        with pytest.raises(ValueError):
            retrieval.checked(*bad)
    path, row = str(tmp_path / "t"), spark.createDataFrame([(1,)], "x int")
    ids = {sinks.append_run(path, row), sinks.append_run(path, row)}
    assert {r["run_id"] for r in sinks.read_evolved(spark, path).collect()} == ids and len(ids) == 2
