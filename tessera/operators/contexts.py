"""What a step is given to work with: queries built from rows, and the best hits of several collections for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import vectors


def kind_of_change(source: Column, target: Column) -> Column:
    return F.concat(source, F.lit("→"), target)


def code_query(source: Column, target: Column, code: Column, most: int = 400) -> Column:
    """The query for code: both frameworks and the beginning of what is to be changed."""
    return F.concat(source, F.lit(" "), target, F.lit(" migration\n"), F.substring(F.coalesce(code, F.lit("")), 1, most))


def planning_query(source: Column, module: Column, target: Column, code: Column, most: int = 500) -> Column:
    return F.concat(source, F.lit(" "), module, F.lit(" to "), target, F.lit("\n"), F.substring(F.coalesce(code, F.lit("")), 1, most))


def guide_query(source: Column, target: Column) -> Column:
    return F.concat(source, F.lit(" to "), target, F.lit(" migration"))


def searched(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The k best of `corpus` (id, text) by words for each of `queries` (query_id, text): rows (query_id, id, score, rank)."""
    terms = vectors.term_weights(queries.select(F.col("query_id").alias("id"), "text")).withColumnRenamed("id", "query_id")
    return vectors.sparse_nearest(terms, vectors.term_weights(corpus), k)


def gathered(queries: DataFrame, hits: dict[str, DataFrame]) -> DataFrame:
    """A row for each of `queries` (query_id) with an array of ids in order of rank for each collection of `hits` (query_id, id, rank), empty where nothing was found, and
    `context`, all of them in the order of the collections. Hits are cut to a few before."""
    out = queries.select("query_id").distinct()
    for name, found in hits.items():
        ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: F.concat(F.lit(name + ":"), x["id"].cast("string")))
        out = out.join(found.groupBy("query_id").agg(ids.alias(name)), "query_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.withColumn("context", F.concat(*hits))


def prompt(title: Column, changes: Column, context: Column, code: Column, most: int = 3000) -> Column:
    """The parts of a prompt in their order, those that are missing or empty left out; code is cut at `most` characters."""
    listed = F.when(F.size(changes) > 0, F.concat(F.lit("Changes:\n"), F.array_join(F.transform(changes, lambda c: F.concat(F.lit("- "), c)), "\n")))
    known = F.when(F.size(context) > 0, F.concat(F.lit("Context: "), F.array_join(context, ", ")))
    body = F.when(F.length(code) > 0, F.concat(F.lit("```\n"), F.substring(code, 1, most), F.lit("\n```")))
    return F.concat_ws("\n\n", F.nullif(F.trim(title), F.lit("")), listed, known, body)
