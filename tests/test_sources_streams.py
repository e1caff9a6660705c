import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import files
from tessera.streaming import stateful


def test_walk(spark, tmp_path):
    for p, t in {"a/x.py": "x = 1", "a/node_modules/y.py": "y", ".hid/z.py": "z", "gen/g.py": "g", "gen/keep.py": "k", "b.md": "# T", "b.txt": "t", "blank.py": "  \n"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    (tmp_path / "bad.py").write_bytes(b"a = '\xff'")
    (tmp_path / ".gitignore").write_text("# c\ngen/*\n!gen/keep.py\n")
    got = files.walk(spark, str(tmp_path)).withColumn("t", files.as_text(F.col("content")))
    found = {r["path"]: r["t"] for r in got.collect()}
    assert sorted(found) == ["a/x.py", "bad.py", "blank.py", "gen/keep.py"]
    assert found["blank.py"] is None and "\ufffd" in found["bad.py"]
    assert files.markdown(spark, str(tmp_path)).count() == 1


def test_eval_queries(spark, tmp_path):
    good = {"query": "q", "ground_truth_chunk_ids": ["a"], "query_type": "exact_symbol", "difficulty": "easy"}
    (tmp_path / "q.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(good) + "\n")
    assert files.eval_queries(spark, str(tmp_path / "q.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):
        files.eval_queries(spark, str(tmp_path / "bad.jsonl")).collect()


def test_breaker_machine():
    flags, errors, at = stateful.breaker_states(["error", "error", "error", "success", "check", "check"], [0, 1, 2, 3, 302, 302.5])
    assert flags == [False, False, True, True, True, False] and errors == 0 and at is None
    assert stateful.breaker_states(["error", "error", "success", "error"], [0, 1, 2, 3])[0] == [False] * 4


def _stream(spark, tmp_path, rows, schema):
    src = tmp_path / "in"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(src))
    return spark.readStream.schema(schema).json(str(src))


def test_streams_equal_batches(spark, tmp_path):
    events = [("p", f"2024-01-01 00:00:0{i}", k) for i, k in enumerate(["error", "error", "error", "check", "success"])] + [("q", "2024-01-01 00:00:00", "error")]
    schema = "provider string, ts timestamp, kind string"
    batch_in = spark.createDataFrame(events, "provider string, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    (tmp_path / "b").mkdir()
    batch_in.coalesce(1).write.json(str(tmp_path / "b" / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "b" / "in"))
    got = stateful.drained(stateful.breakers(stream), "breakers", "append", str(tmp_path / "c1"))
    key = lambda df: sorted((r["provider"], r["ts"], r["is_open"]) for r in df.collect())
    assert key(got) == key(stateful.breakers(batch_in))
    steps = _stream(spark, tmp_path, [("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 2.0), ("b", 1, 5.0)], "k string, t int, v double")
    out = stateful.drained(stateful.rising_steps(steps, "k", "v", "t"), "steps", "append", str(tmp_path / "c2"))
    assert sorted((r["k"], r["t"]) for r in out.collect()) == [("a", 1), ("a", 3), ("b", 1)]
    totals = stateful.drained(stateful.running_totals(steps, "k", "v", 3.5), "totals", "update", str(tmp_path / "c3"))
    assert sorted(tuple(r) for r in totals.collect()) == [("a", 4.0, True), ("b", 5.0, True)]
