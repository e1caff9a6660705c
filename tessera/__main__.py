"""Command line: `python -m tessera COMMAND`. Sessions are local unless the environment's Spark configuration names a master."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    from tessera.session import local_session

    return SparkSession.builder.getOrCreate() if os.environ.get("SPARK_MASTER") or SparkSession.getActiveSession() else local_session()


def evaluate(spark: SparkSession, queries: str, points: str, k: int = 5):
    """Means of the measures of labelled queries (JSON lines) against a table of points, by query type and of all: word search over their contents."""
    from tessera.operators import contexts, evals
    from tessera.sources import files

    asked = files.eval_queries(spark, queries).withColumn("query_id", F.xxhash64("query"))
    found = contexts.searched(asked.select("query_id", F.col("query").alias("text")), spark.read.parquet(points).select(F.col("point_id").alias("id"), F.col("content").alias("text")), max(k, 10))
    true = asked.select("query_id", F.explode("ground_truth_chunk_ids").alias("id")).distinct().withColumn("relevant", F.lit(True))
    hits = found.join(true, ["query_id", "id"], "left").select("query_id", "rank", F.coalesce("relevant", F.lit(False)).alias("relevant"))
    truth = asked.select("query_id", "query_type", F.size(F.array_distinct("ground_truth_chunk_ids")).alias("size"))
    return evals.summary(evals.graded(hits, truth, k), "query_type")


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("ingest-code", "chunk the sources under ROOT into TABLE"), ("ingest-docs", "chunk the markdown under ROOT into TABLE")):
        c = sub.add_parser(name, help=what)
        c.add_argument("root"), c.add_argument("table")
    c = sub.add_parser("evaluate", help="measure labelled queries against a table of points")
    c.add_argument("queries"), c.add_argument("table"), c.add_argument("-k", type=int, default=5)
    c = sub.add_parser("query", help="run a named query over a folder of tables and show or write its rows")
    c.add_argument("name"), c.add_argument("folder"), c.add_argument("--out"), c.add_argument("--rows", type=int, default=20)
    sub.add_parser("queries", help="names of the queries")
    a = p.parse_args(argv)
    if a.command == "queries":
        from tessera import catalog

        print(*catalog.QUERIES, sep="\n")
        return 0
    spark = _session()
    if a.command == "query":
        from tessera import catalog

        df = catalog.QUERIES[a.name](spark, a.folder)
        df.write.mode("overwrite").parquet(a.out) if a.out else df.show(a.rows, truncate=False)
    elif a.command == "evaluate":
        evaluate(spark, a.queries, a.table, a.k).show(truncate=False)
    else:
        from tessera.plans import ingest

        print((ingest.ingest_repo if a.command == "ingest-code" else ingest.ingest_docs)(spark, a.root, a.table))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
