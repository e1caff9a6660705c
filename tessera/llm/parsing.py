"""Source files and rewritten code that are not valid in their language.

A file's chunks are brought together by its path and streamed in the order of their lines, so that a task holds one file at a time;
every source is parsed by the generalised LL recogniser of `gll` with the grammar of its language, in which the dialects run together.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.syntax import EXTENSIONS, valid

_FILES = "file_path string, repo string, language string, n_lines bigint, valid boolean"


def language_of(name: Column) -> Column:
    return F.nullif(F.lower(F.trim(name)), F.lit(""))


def _most(values: Counter) -> str | None:
    return min(values, key=lambda v: (-values[v], v)) if values else None


def files(chunks: DataFrame) -> DataFrame:
    """Rows (file_path, repo, language, n_lines, valid), one for each file of code chunks.

    A file's source is the content of its chunks, one for each start_line (of redelivered ones the smallest chunk_id), at its line, with
    empty lines between. Its language and repo are those of most of its rows, the language without regard to case and blanks around it, or by
    the extension if all are missing. `valid` is missing for languages without a grammar. Rows without path, start_line or content add nothing.
    Of a gap between chunks no more than two empty lines are held, which parse as any number does.
    """
    own = chunks.select("file_path", "start_line", "chunk_id", "repo", language_of(F.col("language")).alias("language"), "content")
    own = own.filter("file_path is not null and start_line is not null and content is not null")
    placed = own.repartition("file_path").sortWithinPartitions("file_path", "start_line", "chunk_id")

    def run(batches):
        path, lines, count, langs, repos, last, out = None, [], 0, Counter(), Counter(), None, []

        def done():
            ext = path[path.rfind(".") :].lower() if "." in path else ""
            lang = _most(langs) or EXTENSIONS.get(ext)
            out.append((path, _most(repos), lang, count, valid(lang, "\n".join(lines))))

        def flush():
            cols = list(zip(*out)) if out else [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_()))], names=["file_path", "repo", "language", "n_lines", "valid"])

        for b in batches:
            for p, start, repo, lang, content in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5))):
                if p != path:
                    if path is not None:
                        done()
                    path, lines, count, langs, repos, last = p, [], 0, Counter(), Counter(), None
                if lang:
                    langs[lang] += 1
                if repo:
                    repos[repo] += 1
                if start != last:
                    last = start
                    gap = max(start - 1 - count, 0)
                    own = content.split("\n")
                    lines.extend([""] * min(gap, 2))
                    lines.extend(own)
                    count += gap + len(own)
            if len(out) > 1000:
                yield flush()
        if path is not None:
            done()
        yield flush()

    return placed.mapInArrow(run, _FILES)


def snippets(df: DataFrame, id_col: str, code_col: str, language_col: str) -> DataFrame:
    """Rows (id, language, valid) of the rows of `df` that have code and a language."""
    own = df.select(F.col(id_col).alias("id"), language_of(F.col(language_col)).alias("language"), F.col(code_col).alias("code")).filter("code is not null and language is not null")
    id_type = own.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ok = [valid(lang, code) for lang, code in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["id", "language", "valid"])

    return own.mapInArrow(run, f"id {id_type}, language string, valid boolean")


def patterns(migration_patterns: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Rows (id, language, valid) of after_code in the language of target_framework, whose name counts without case and blanks around it."""
    key = language_of(F.col("framework"))
    known = frameworks.select(key.alias("key"), F.col("language").alias("lang")).filter("key is not null and lang is not null").dropDuplicates(["key"])
    own = migration_patterns.select("pattern_id", "after_code", language_of(F.col("target_framework")).alias("key")).join(known, "key")
    return snippets(own.select("pattern_id", "after_code", "lang"), "pattern_id", "after_code", "lang")


def found(chunks: DataFrame, migration_patterns: DataFrame, frameworks: DataFrame) -> DataFrame:
    """Rows (tab, rec_key) of files and patterns that are not valid."""
    f = files(chunks).filter("not valid").select(F.lit("code_chunks").alias("tab"), F.col("file_path").alias("rec_key"))
    p = patterns(migration_patterns, frameworks).filter("not valid").select(F.lit("migration_patterns").alias("tab"), F.col("id").cast("string").alias("rec_key"))
    return f.unionByName(p)


def rates(checked: DataFrame) -> DataFrame:
    """Rows (repo, language, files, invalid, rate) of `files`: by both, by repo, by language, and of all; rolled-up columns are missing and
    `level` says which remain. Files of languages without a grammar are not counted."""
    own = checked.filter("valid is not null").select(F.coalesce("repo", F.lit("(none)")).alias("repo"), "language", (~F.col("valid")).cast("int").alias("bad"))
    out = own.cube("repo", "language").agg(F.count("*").alias("files"), F.sum("bad").alias("invalid"), F.grouping_id().alias("g"))
    level = F.element_at(F.array(F.lit("repo and language"), F.lit("repo"), F.lit("language"), F.lit("all")), F.col("g").cast("int") + 1)
    return out.select(level.alias("level"), "repo", "language", "files", "invalid", F.round(F.col("invalid") / F.col("files"), 6).alias("rate"))
