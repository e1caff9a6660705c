"""Repositories, documents and labelled queries read from files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Folders that are never walked, and endings that are.
PRUNED = ("node_modules", ".venv", "venv", "env", "__pycache__", "dist", "build", ".git", ".mypy_cache", ".ruff_cache", ".pytest_cache")
WALKED = ("py", "java", "cs", "ts", "tsx", "js", "jsx", "go")

EVAL_ENTRY = T.StructType([T.StructField("query", T.StringType(), False), T.StructField("ground_truth_chunk_ids", T.ArrayType(T.StringType()), False), T.StructField("query_type", T.StringType(), False), T.StructField("difficulty", T.StringType(), False)])


def glob_regex(pattern: str) -> tuple[str, bool]:
    """A line of an ignore file as a regular expression on relative paths, and whether it takes paths back in."""
    keep = pattern.startswith("!")
    body = pattern[1:] if keep else pattern
    anchored, folder = "/" in body.rstrip("/"), body.endswith("/")
    out = ""
    for part in re.findall(r"\*\*/|/\*\*|\*|\?|\[[^\]]*\]|[^*?\[/]+|/|\[", body.strip("/")):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part if part[0] == "[" and len(part) > 1 else re.escape(part))
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)"), keep


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether a relative path is ignored; later lines override earlier ones."""
    out = F.lit(False)
    for line in (x.strip() for x in lines):
        if line and not line.startswith("#"):
            pattern, keep = glob_regex(line)
            out = F.when(path.rlike(pattern), F.lit(not keep)).otherwise(out)
    return out


def walk(spark: SparkSession, root: str, endings: tuple[str, ...] = WALKED) -> DataFrame:
    """Rows (path, length, content) of the source files under a folder, path relative to it: no pruned or hidden folders, nothing that the
    `.gitignore` at the root names. The content is binary; files are read by the executors. A folder without any gives none."""
    base = root.rstrip("/")
    rules = _lines(spark, f"{base}/.gitignore")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(endings) + "}").load(base)
    own = found.withColumn("path", F.regexp_replace("path", "^[a-z]+:/*" + re.escape("/" + base.split("://")[-1].lstrip("/")) + "/|^[a-z]+:" + re.escape(base) + "/", ""))
    folder = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    hidden = F.exists(folder, lambda f: f.startswith(".") | f.isin(*PRUNED))
    return own.filter(~hidden & ~ignored(F.col("path"), rules)).select("path", "length", "content")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of one small file, none if it is absent; Spark's readers pass over hidden files."""
    if not _exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()


def as_text(content: Column) -> Column:
    """Bytes as UTF-8 with bad ones replaced; missing for blank files."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.when(F.length(F.regexp_replace(text, r"\s", "")) > 0, text)


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """Rows (path, content) of the markdown files under a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    return found.select("path", as_text(F.col("content")).alias("content"))


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """Labelled queries, one JSON object a line; blank lines are skipped, others that don't fit fail the job."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value")
    return lines.select(F.from_json("value", EVAL_ENTRY, {"mode": "FAILFAST"}).alias("e")).select("e.*")
