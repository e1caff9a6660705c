import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import evals, graph, patterns, prefix, retrieval, sequences, vectors
from tessera.operators.components import components
from tessera.sources import sinks


def test_fusion_values(spark):
    d = spark.createDataFrame([(1, "a", 2), (1, "b", 0)], "query_id int, id string, rank int")
    s = spark.createDataFrame([(1, "a", 2), (1, "c", 5)], "query_id int, id string, rank int")
    got = {r["id"]: (round(r["score"], 6), r["rank"]) for r in retrieval.fuse(d, s, 0.5).collect()}
    assert got["a"] == (0.015873, 0) and got["b"] == (0.008197, 1)
    only = retrieval.fuse(d, s, 1.0).orderBy("rank").collect()
    assert [r["id"] for r in only] == ["b", "a", "c"] and only[-1]["score"] == 0.0
    swapped = {r["id"]: r["score"] for r in retrieval.fuse(s, d, 0.3).collect()}
    assert swapped == {r["id"]: r["score"] for r in retrieval.fuse(d, s, 0.7).collect()}


def test_limits_and_filters(spark, rows):
    assert retrieval.limits(10) == (0.5, 160, 40, 10, False)
    assert retrieval.limits(3, retrieval.CONFIGS["reranker"]) == (0.5, 80, 20, 6, True)
    for bad in (0, 101):
        with pytest.raises(ValueError):
            retrieval.limits(bad)
    with pytest.raises(ValueError):
        retrieval.Config(alpha=1.5)
    df = spark.createDataFrame([("python", "f"), ("java", "f"), (None, "g")], "language string, node_type string")
    assert df.filter(retrieval.metadata_filter({"language": "python", "node_type": ""})).count() == 1
    assert df.filter(retrieval.metadata_filter({})).count() == 3
    asked = ["show me how to define a route in Python", "what changed and how do I upgrade", "what arguments are accepted", "migrate my app with examples", "x", None]
    routed = spark.createDataFrame([(q,) for q in asked], "q string").select(retrieval.route(F.col("q")).alias("r")).select("r.*").collect()
    assert [r["intent"] for r in routed] == ["code_pattern", "migration_guide", "api_reference", "combined", "combined", "combined"] and routed[0]["language_hint"] == "python" and routed[1]["language_hint"] is None
    assert [r["collections"] for r in routed[:4]] == [["code_chunks", "migration_patterns"], ["doc_chunks"], ["doc_chunks", "code_chunks"], ["code_chunks", "doc_chunks", "migration_patterns"]]


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 8)).round(2)
    v[7] = v[3]
    data = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(900, None), (901, [0.0] * 8), (902, [1.0]), (903, [])]
    df = spark.createDataFrame(data, "id long, vec array<double>")
    got = vectors.nearest(df.filter("id < 30").withColumnRenamed("id", "query_id"), df, 5, block=7)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.round(unit[:30] @ unit.T, 6)
    expected = {(q, int(i)) for q in range(30) for i in np.lexsort((np.arange(120), -cos[q]))[:5]}
    assert {(r["query_id"], r["id"]) for r in got.collect()} == expected
    assert vectors.nearest(df.limit(0).withColumnRenamed("id", "query_id"), df, 5).count() == 0


def test_sparse_and_rerank(spark, rows):
    docs = spark.createDataFrame([(1, "red red fox"), (2, "blue fox"), (3, None), (4, "")], "id int, text string")
    q = vectors.term_weights(spark.createDataFrame([(9, "fox red")], "id int, text string")).withColumnRenamed("id", "query_id")
    got = vectors.sparse_nearest(q, vectors.term_weights(docs), 5).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2]
    hits = retrieval.rerank(vectors.sparse_nearest(q, vectors.term_weights(docs), 5), spark.createDataFrame([(9, "blue fox")], "query_id int, query string"), docs.withColumnRenamed("text", "content"), 1)
    assert rows(hits.select("id", "score")) == [(2, 1.0)]


def test_measures(spark):
    df = spark.createDataFrame([(["b", "a", "c"], ["a", "c"]), (["a", "a", "b"], ["a", "c"]), ([], ["a"]), (["a"], [])], "found array<string>, truth array<string>")
    r = evals.per_query(df, 5).collect()
    assert r[0]["ndcg"] == 0.693426 and r[0]["mrr"] == 0.5 and r[0]["recall"] == 1.0
    assert (r[2]["recall"], r[2]["mrr"], r[2]["ndcg"]) == (0, 0, 0) and (r[3]["recall"], r[3]["ndcg"]) == (0, 0)
    assert df.limit(2).select(evals.recall_at(F.col("found"), F.col("truth"), 2)).collect()[1][0] == 0.5
    assert evals.summary(evals.per_query(df.limit(0))).first()["recall"] is None
    ranks = spark.createDataFrame([(1,), (2,), (None,)], "found_at int")
    assert tuple(evals.hit_rate(ranks).first()) == (3, 0.666667, 0.5)
    judged = spark.createDataFrame([([True], 2), ([True, True, True], 2), (None, 2), ([True], 0)], "j array<boolean>, n int")
    assert [r[0] for r in judged.select(evals.context_precision(F.col("j"), F.col("n"))).collect()] == [0.5, 1.0, None, None]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def order(spark, names, pairs):
    out = {}
    for r in graph.migration_order(nodes(spark, names), edges(spark, pairs)).collect():
        out.setdefault(r["batch"], []).append(r["node"])
    return [sorted(out[k]) for k in sorted(out)]


def test_migration_order(spark):
    assert order(spark, "abc", [("a", "b"), ("b", "c")]) == [["c"], ["b"], ["a"]]
    assert order(spark, "abc", [("a", "b"), ("b", "a"), ("c", "a")]) == [["c"], ["a", "b"]]
    assert order(spark, "abcd", [("a", "b"), ("b", "a"), ("c", "d")]) == [["d"], ["c"], ["a", "b"]]
    assert order(spark, "abcd", [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]) == [["d"], ["b", "c"], ["a"]]


def test_cycles_roles_records(spark, rows):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "a"), ("g", "g")])
    assert rows(graph.cycle_members(e)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    assert graph.cycle_members(e.limit(0)).count() == 0
    r = {x["node"]: (x["is_leaf"], x["is_entry"]) for x in graph.roles(nodes(spark, "abc"), edges(spark, [("a", "b"), ("b", "c")])).collect()}
    assert r == {"a": (False, True), "b": (False, False), "c": (True, False)}
    n, e2 = graph.from_record(graph.as_record(nodes(spark, "ab"), edges(spark, [("a", "b")]), "g"))
    assert rows(n) == [("g", "a"), ("g", "b")] and rows(e2) == [("g", "a", "b")]
    assert rows(graph.known_edges(edges(spark, [("a", "b"), ("a", "b"), ("a", "a"), ("a", "zz")]), nodes(spark, "ab"))) == [("a", "b")]


def test_components_and_sums(spark, rows):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1)] + [(100 + i, 101 + i) for i in range(60)], "u int, v int")
    got = dict(rows(components(e)))
    assert got[3] == got[1] == 1 and got[5] == 4 and got[7] == 7 and got[160] == 100
    data = [("a" if i % 3 else None, i, i % 7 if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(data, "g string, k int, v long").repartition(5)
    sums, expected = {}, {}
    for g, k, v in data:
        sums[g] = expected[k] = sums.get(g, 0) + (v or 0)
    assert {r["k"]: r["upto"] for r in prefix.running_sum(df, "g", ["k"], "v").collect()} == expected


def test_sequences(spark, rows):
    df = spark.createDataFrame([("x", 1, "e"), ("x", 2, "e"), ("x", 3, "s"), ("x", 4, "e"), ("y", 1, "e")], "k string, t int, kind string")
    assert [r[-1] for r in rows(sequences.streaks(df, ["k"], ["t"], F.col("kind") == "e"))] == [1, 2, 0, 1, 1]
    v = spark.createDataFrame([("x", 1, 3.0), ("x", 2, 3.0), ("x", 3, None), ("x", 4, 4.0)], "k string, t int, v double")
    assert [r[1] for r in rows(sequences.step_changes(v, ["k"], ["t"], "v"))] == [1, 4]
    assert [(r["running"], r["over"]) for r in sequences.running_total(v, ["k"], ["t"], "v", 6.0).orderBy("t").collect()] == [(3, False), (6, False), (6, False), (10, True)]
    assert rows(sequences.last_per_key(df, ["k"], "t").select("k", "t")) == [("x", 4), ("y", 1)]
    chunks = spark.createDataFrame([("f", 3, 5), ("f", 8, 9), ("h", 1, 2)], "file_path string, start_line int, end_line int")
    lines = spark.createDataFrame([("f", "1\n2\n3\n4\n5\n\n7\n8\n9\n10\n"), ("g", "1\n2"), ("h", "1\n2\n \n")], "file_path string, content string")
    want = [("f", 0, "preamble", 1, 2), ("f", 1, "section", 3, 5), ("f", 2, "section", 6, 9), ("f", 3, "epilogue", 10, 11), ("g", 0, "preamble", 1, 2), ("h", 0, "section", 1, 2)]
    cut = sequences.segments(lines, chunks)
    assert rows(cut.drop("content")) == want and rows(cut.select("content"))[0] == ("10\n",)


def test_large_keys_give_the_same_over_many_tasks(spark, rows, monkeypatch):
    import random

    rng = random.Random(4)
    data = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1, 2, 5, i]), rng.random() < 0.6) for i in range(600)]
    df = spark.createDataFrame(data, "k string, t int, v int, bad boolean").repartition(5)

    def all_three():
        return (
            rows(sequences.running_total(df, ["k"], ["t"], "v", 50)),
            rows(sequences.streaks(df, ["k"], ["t"], F.col("bad")).select("t", "streak")),
            rows(sequences.step_changes(df, ["k"], ["t"], "v").select("t")),
        )

    few = all_three()
    monkeypatch.setattr(sequences, "LARGE", 10)
    assert all_three() == few and len(few[0]) == 600


def test_pattern_store(spark, rows):
    def at(deg):
        return [math.cos(math.radians(deg)), math.sin(math.radians(deg))]

    same = math.cos(math.radians(18)) - 1e-6  # 18 degrees apart is the same
    store = spark.createDataFrame([(1, at(0))], "id long, vec array<double>")
    new = spark.createDataFrame([(10, at(10)), (11, at(60)), (12, at(75)), (13, at(90)), (14, at(105)), (15, None)], "id long, vec array<double>")
    got = {r["id"]: (r["entry"], r["is_new"]) for r in patterns.record(store, new.filter("vec is not null"), same).collect()}
    assert got == {10: (1, False), 11: (11, True), 12: (11, False), 13: (13, True), 14: (13, False)}
    counts = patterns.counts(spark.createDataFrame([(1, 5)], "id long, success_count int"), patterns.record(store, new.filter("vec is not null"), same))
    assert rows(counts) == [(1, 6), (11, 2), (13, 2)]


def test_upserts(spark, rows, tmp_path):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), (None, 9, 90)], "k string, first int, n int")
    new = spark.createDataFrame([("b", 5, 3), ("c", 6, 4), (None, 7, 1)], "k string, first int, n int")
    got = rows(sinks.upserted(old, new, ["k"], {"first": "keep", "n": "add"}))
    assert got == [("a", 1, 10), ("b", 2, 23), ("c", 6, 4), (None, 9, 91)]
    path = str(tmp_path / "t")
    sinks.upsert(spark, path, old, ["k"], ["n"])
    sinks.upsert(spark, path, new.union(spark.createDataFrame([("b", 0, 1)], "k string, first int, n int")), ["k"], ["n"])
    assert rows(spark.read.parquet(path).select("k", "n")) == [("a", 10), ("b", 3), ("c", 4), (None, 1)]
    sinks.ensure_table(spark, str(tmp_path / "e"), "a int")
    sinks.append(str(tmp_path / "e"), spark.createDataFrame([(1, "x")], "a int, b string"))
    assert rows(sinks.read_evolved(spark, str(tmp_path / "e"))) == [(1, "x")]
