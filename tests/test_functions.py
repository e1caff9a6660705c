import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import tables as tf
from tessera.functions import text as tx


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_uuid5_is_pythons(spark):
    keys = ["abc", "", "a/b.py:1:9", "ünïcode"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(tx.uuid5(F.col("k"))).collect()] == [str(uuid.uuid5(uuid.NAMESPACE_URL, k)) for k in keys]
    assert one(spark, tx.uuid5(F.lit("abc"))) == ("68661508-f3c4-55b4-945d-ae2b4dfe5db4",)
    assert one(spark, tx.uuid5(F.lit(None).cast("string"))) == (None,)


@pytest.mark.parametrize(
    "level,name,module,expected",
    [(1, "models", "app", "models"), (1, None, "app", None), (10, "x", "app", None), (1, "models", "app.views.users", "app.views.models"), (2, "config", "app.views.users", "app.config"), (1, "", "app.views", "app")],
)
def test_relative_imports(spark, level, name, module, expected):
    assert one(spark, tx.resolve_relative(F.lit(level), F.lit(name).cast("string"), F.lit(module))) == (expected,)


def test_modules_titles_fences(spark):
    assert one(spark, *[tx.module_name(F.lit(p)) for p in ("app/models/user.py", "app/__init__.py", "__init__.py", "web/index.ts", "web/a.tsx")]) == ("app.models.user", "app", "", "web", "web.a")
    assert one(spark, *[tx.title(F.lit(t)) for t in ("x\n## Two words \ny", " plain\nrest", "\nsecond", "#", "", "a" * 100, "# " + "b" * 100)]) == ("Two words", "plain", "untitled", "untitled", "untitled", "a" * 80, "b" * 100)
    fences = ("```python\na\n```", "```PY \nb\n```", "```\nc\n```", "```js\nd\n```", "none", "``` python  \ne```", "```\n```", "```python x\ny```")
    assert one(spark, *[tx.fenced_code(F.lit(t)) for t in fences]) == ("a\n", "b\n", "c\n", None, None, "e", "", None)
    assert one(spark, tx.docstring(F.lit("'''b''' \"\"\" a \"\"\""), F.lit("python")), tx.docstring(F.lit('"""a"""'), F.lit("java")), tx.docstring(F.lit('""" """ \'\'\'b\'\'\''), F.lit("python")), tx.docstring(F.lit("'''b'''"), F.lit("python"))) == ("a", None, None, "b")
    assert one(spark, tx.parent_class(F.lit("x\nclass A(B):\n  class C:")), tx.parent_class(F.lit("f.py"))) == ("C", None)
    assert one(spark, *[tx.node_type(F.lit(t)) for t in ("constructor_declaration", "arrow_function", "interface_declaration", "import_from_statement", "x")]) == ("function", "function", "code", "import", "code")
    assert one(spark, *[tx.language_of_path(F.lit(t)) for t in ("a.js", "a.JSX", "a.cs", "a.go")]) == ("typescript", "typescript", "csharp", None)


def test_small_values(spark):
    assert one(spark, *[tx.backoff_seconds(F.lit(i)) for i in range(8)]) == (1, 2, 4, 8, 16, 32, 60, 60)
    assert one(spark, tx.percent(F.lit(2), F.lit(3)), tx.percent(F.lit(0), F.lit(0)), tx.ratio(F.lit(1), F.lit(0), 1.0)) == (66, 0, 1.0)
    assert one(spark, tx.is_rate_limit(F.lit("HTTP 429")), tx.is_rate_limit(F.lit("other")), tx.is_rate_limit(F.lit(None).cast("string")), tx.is_rate_limit(F.lit("Rate-Limited")), tx.is_rate_limit(F.lit("rate_limit_exhausted"))) == (True, False, False, True, False)
    assert one(spark, tx.token_usage(F.lit('{"usage_metadata":{"input_tokens":3,"output_tokens":4}}')), tx.token_usage(F.lit('{"token_usage":{"prompt_tokens":5}}')), tx.token_usage(F.lit("x"))) == ((3, 4), (5, 0), (0, 0))
    assert one(spark, tx.branch_name(F.lit("r1"), F.lit("a b/c.py")), tx.worktree_path(F.lit("/w"), F.lit("m/a"))) == ("migration/r1/a-b.c", "/w/m_a")
    assert one(spark, tx.branch_name(F.lit("abc"), F.lit("pkg\\sub/mod é+.py"))) == ("migration/abc/pkg.sub.mod-é-",)


@settings(max_examples=20, deadline=None)
@given(st.text(max_size=40))
def test_slug_round_trip(spark, text):
    text = text.replace("\x00", "")
    s = one(spark, tx.slug(F.lit(text)), tx.unslug(tx.slug(F.lit(text))))
    assert s[1] == text and not set("+/=") & set(s[0])


def test_splitter_examples():
    assert tf.split_markdown("word word word ", 10, 3) == ["word\nword", "ord\nword"]
    blanks = "x" * 800 + " " * 199 + "y"
    assert tf.split_markdown(blanks + "\n" + blanks) == [blanks, blanks]  # parts of the limit's size stay as they are, no overlap fits
    assert tf.split_markdown("abcdefghij", 4, 1) == ["abcd", "defg", "ghij", "j"]
    assert tf.split_markdown("") == [] and tf.split_markdown("  \n ") == []
    two = "\n\n".join(["a" * 700, "b" * 700])
    assert tf.split_markdown(two) == ["a" * 700, "a" * 100 + "\n" + "b" * 700]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n#", max_size=400), st.integers(12, 60), st.integers(0, 10))
def test_splitter_bounds(text, size, overlap):
    pieces = tf.split_markdown(text, size, overlap)
    assert all(len(p) <= size and p.strip() for p in pieces)
    if overlap == 0:
        assert "".join("".join(pieces).split()) == "".join(text.split())


def test_imports_chunks_diffs(spark):
    df = spark.createDataFrame([(1, "import a.b, c\nfrom x import y\nfrom . import m, n\nfrom ..p import q"), (2, "def f(:"), (3, None)], "id int, code string")
    assert rows_of(spark, "import a\nfrom . import m\nfrom .p import q\nfrom ...z import w", "pkg.mod") == ["a", "pkg.m", "pkg.p", None] and rows_of(spark, "from . import m", "top") == ["m"]
    got = {r["id"]: [(i["level"], i["name"]) for i in r["i"]] for r in df.select("id", tf.python_imports(F.col("code")).alias("i")).collect()}
    assert sorted(got[1]) == [(0, "a.b"), (0, "c"), (0, "x"), (1, "m"), (1, "n"), (2, "p")] and got[2] == got[3] == []
    code = spark.createDataFrame([("import a\nimport b\n\ndef f():\n    pass\n\nclass C:\n    x = 1\n",), ("def (",), ("",), (None,)], "code string")
    out = [[(c["start_line"], c["end_line"], c["node_type"]) for c in r[0]] for r in code.select(tf.python_chunks(F.col("code"))).collect()]
    assert out == [[(1, 2, "import"), (4, 5, "function"), (7, 8, "class")], [(1, 1, "code")], [], []]
    d = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "x")], "a string, b string").select(tf.diff_summary(F.col("a"), F.col("b"), F.lit("m.py"))).collect()
    assert [r[0] for r in d] == ["(no diff)", "--- a/m.py\n+++ b/m.py\n@@ -1 +1 @@\n-a+b", "--- a/m.py\n+++ b/m.py\n@@ -0,0 +1 @@\n+x"]
    long = spark.createDataFrame([("\n".join(map(str, range(100))), "")], "a string, b string").select(tf.diff_summary(F.col("a"), F.col("b"), F.lit("m"))).first()[0]
    assert long.count("\n") == 61 and long.endswith("... (43 more lines)\n")


def rows_of(spark, code, module):
    df = spark.createDataFrame([(code,)], "c string").select(F.explode(tf.python_imports(F.col("c"))).alias("i"))
    return [r[0] for r in df.select(tx.import_target(F.col("i"), F.lit(module))).collect()]


def test_script_targets(spark, rows):
    imports = spark.createDataFrame([("a/x.ts", "a", "./y"), ("a/x.ts", "a", "../b"), ("a/x.ts", "a", "./none"), ("a/x.ts", "a", "./y.service")], "src string, folder string, spec string")
    files = spark.createDataFrame([("a/y.js",), ("a/y.ts",), ("b/index.js",)], "file_path string")
    assert rows(tf.script_targets(imports, files)) == [("a/x.ts", "../b", "b/index.js"), ("a/x.ts", "./y", "a/y.ts"), ("a/x.ts", "./y.service", "a/y.ts")]
    code = spark.createDataFrame([("import { a,\n b } from './a';\nimport './b'\n// import './no'\n/* require('./no') */ const c = require(\"../c\"), s = \"// import './x'\";\nexport * from './no';\nimport('./no'); import x from 'ext'",)], "c string")
    assert code.select(tf.script_imports(F.col("c"))).first()[0] == ["./a", "./b", "../c", "./x"]


def test_imports_are_those_of_whole_files(spark, rows, tmp_path):
    from tessera import catalog

    chunks = [
        ("a/m.py", 1, 3, "import one\n\nclass C:"),
        ("a/m.py", 4, 4, "    def f(self):\n        import two\n        return two"),  # doesn't parse alone
        ("a/m.py", 4, 9, "import again"),  # redelivered
        ("a/bad.py", 1, 5, "import three"),
        ("a/bad.py", 2, 6, "def ("),
        ("a/n.ts", 1, 7, "import four"),
        ("a/none.py", None, 8, "import five"),
    ]
    spark.createDataFrame(chunks, "file_path string, start_line int, chunk_id long, content string").write.parquet(str(tmp_path / "code_chunks.parquet"))
    assert rows(catalog.python_import_edges(spark, str(tmp_path))) == [("a.m", "one"), ("a.m", "two")]
