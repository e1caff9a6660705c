import numpy as np
from pyspark.sql import functions as F

from tessera.functions.embedding import HashedProjection, embedding
from tessera.plans import ingest


def test_embedder_is_the_same_everywhere(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, "Fox red"), (3, None), (4, "")], "id int, t string").repartition(3)
    v = {r["id"]: r["v"] for r in df.select("id", embedding(F.col("t")).alias("v")).collect()}
    assert v[1] == v[2] and v[3] is None and not any(v[4]) and abs(np.linalg.norm(v[1]) - 1) < 1e-6
    assert HashedProjection(8).embed(["a b"]).shape == (1, 8)


def test_ingest_twice_changes_nothing(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "web").mkdir(parents=True)
    (repo / "a.py").write_text('import os\n\n\ndef f():\n    """Says hello."""\n    return 1\n')
    (repo / "web" / "b.ts").write_text("export const x = 1;\n")
    (repo / "c.go").write_text("package c\n")
    (repo / "blank.py").write_text("\n")
    (repo / "g.md").write_text("# Guide\n\n" + "\n\n".join("word " * 120 for _ in range(4)))
    out = str(tmp_path / "code")
    assert ingest.ingest_repo(spark, str(repo), out) == 3
    first = sorted((r["point_id"], r["node_type"], r["docstring"]) for r in spark.read.parquet(out).collect())
    ingest.ingest_repo(spark, str(repo), out)
    assert sorted((r["point_id"], r["node_type"], r["docstring"]) for r in spark.read.parquet(out).collect()) == first
    assert {r[1] for r in first} == {"import", "function", "code"} and "Says hello." in {r[2] for r in first}
    n = ingest.ingest_docs(spark, str(repo), str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert n > 1 and docs.count() == n and docs.agg(F.max(F.length("content"))).first()[0] <= 1000
    assert ingest.terms_of(docs).filter("term = 'word'").count() == n


def test_all_languages_are_cut_and_know_their_parents(spark):
    java = "import a.B;\n\n/** Says. */\npublic class Big extends C {\n  int x = 1; // }\n" + "".join(f"  @Override\n  public int m{i}(int a) {{\n    return a + {i}; // {'w' * 300}\n  }}\n\n" for i in range(8)) + "}\n"
    cs = "using System;\nnamespace N\n{\n  class Deep\n  {\n" + "".join(f"    public string P{i}(int a)\n    {{\n      return @\"}}\" + \"{'v' * 400}\";\n    }}\n" for i in range(5)) + "  }\n}\n"
    ts = "import { a } from './a';\nimport b from 'b';\nfunction small() {\n  return `${a}}`;\n}\nclass W {\n" + "".join(f"  run{i}(x: number) {{\n    return /[}}]/.test('{'z' * 500}');\n  }}\n" for i in range(4)) + "}\n"
    js = "var q=[" + ",".join(f"{{a:{i}}}" for i in range(900)) + "];"
    py = "class K:\n    def long(self):\n        x = 0\n" + "".join(f"        # step {i}\n        x += call_{i}(x, {i})\n" for i in range(120)) + "        return x\n"
    sources = {"B.java": java, "D.cs": cs, "w.ts": ts, "min.js": js, "k.py": py}
    got = {}
    for r in ingest.code_points(spark.createDataFrame(list(sources.items()), "path string, content string")).collect():
        got.setdefault(r["file_path"], []).append(r)
    solid = lambda t: "".join(t.split())
    for path, text in sources.items():
        rows = sorted(got[path], key=lambda r: r["start_line"]) if path != "min.js" else sorted(got[path], key=lambda r: js.index(r["content"]))
        assert all(len(solid(r["content"])) <= 1200 for r in rows) and len({r["point_id"] for r in rows}) == len(rows) > 1, path
        assert "".join(solid(r["content"]) for r in rows) == solid(text), path
    kinds = {p: [(r["node_type"], r["name"], r["parent_class"]) for r in sorted(got[p], key=lambda r: r["start_line"])] for p in got}
    assert kinds["B.java"] == [("import", None, None), ("class", "Big", None), ("code", None, "Big"), *(("function", f"m{i}", "Big") for i in range(8))]
    assert [k for k in kinds["D.cs"] if k[0] != "code"] == [("class", "Deep", None), *(("function", f"P{i}", "Deep") for i in range(5))]
    assert kinds["w.ts"] == [("import", None, None), ("function", "small", None), ("class", "W", None), *(("function", f"run{i}", "W") for i in range(4))]
    assert {r["parent_context"] for r in got["B.java"]} == {"B.java", "public class Big extends C"} and {r["parent_context"] for r in got["k.py"]} >= {"class K:", "class K:\ndef long(self):"}
