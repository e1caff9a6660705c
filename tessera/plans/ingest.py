"""From files to collections of chunks with keys, vectors and terms, written so that a second run changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import embedding as em
from tessera.functions import tables as tf
from tessera.functions import text as tx
from tessera.operators.vectors import term_weights
from tessera.sources import files, sinks


def doc_points(docs: DataFrame, make=em.HashedProjection) -> DataFrame:
    """Rows (point_id, file_path, title, content, chunk_index, source, dense) of documents (path, content), chunk_index before blank chunks are left out."""
    pieces = docs.select("path", F.posexplode(tf.markdown_chunks(F.col("content"))).alias("chunk_index", "piece"))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    key = F.concat("path", F.lit(":"), F.col("chunk_index").cast("string"))
    own = pieces.select(tx.uuid5(key).alias("point_id"), F.col("path").alias("file_path"), tx.title(F.col("piece")).alias("title"), F.col("piece").alias("content"), "chunk_index", stem.alias("source"))
    return own.withColumn("dense", em.embedding(F.col("content"), make))


def code_points(sources: DataFrame, make=em.HashedProjection, limit: int = 1200) -> DataFrame:
    """Rows of the chunks of sources (path, content) that are in a known language; others and blank ones give none. Python is cut along its syntax, other
    languages along their blocks, in chunks of at most `limit` characters that are no blanks. A chunk's context is that of its blocks, or the path."""
    known = sources.withColumn("language", tx.language_of_path(F.col("path"))).filter("language is not null and content is not null")
    python = known.filter("language = 'python'").select("path", "language", F.explode(tf.python_chunks(F.col("content"), limit)).alias("c"))
    other = known.filter("language <> 'python'").select("path", "language", F.explode(tf.brace_chunks(F.col("content"), F.col("language"), limit)).alias("c"))
    rows = python.unionByName(other).select("path", "language", "c.*")
    key = tx.chunk_key(F.col("path"), F.col("start_line"), F.col("end_line"))
    own = rows.select(
        tx.uuid5(F.when(F.col("part") > 0, F.concat(key, F.lit(":"), F.col("part").cast("string"))).otherwise(key)).alias("point_id"), F.col("path").alias("file_path"), "language", "content", "node_type", "name", "start_line", "end_line",
        tx.docstring(F.col("content"), F.col("language")).alias("docstring"), "parent_class", F.coalesce("parent_context", "path").alias("parent_context"),
    )
    return own.withColumn("dense", em.embedding(F.col("content"), make))


def terms_of(points: DataFrame) -> DataFrame:
    """The postings (id, term, weight) of points."""
    return term_weights(points.select(F.col("point_id").alias("id"), F.col("content").alias("text")))


def ingest_repo(spark: SparkSession, root: str, path: str) -> int:
    """Chunk the sources under `root` and upsert them into the table at `path`; the number of chunks. Chunks of parts that are gone stay."""
    sources = files.walk(spark, root).select("path", files.as_text(F.col("content")).alias("content"))
    points = code_points(sources).withColumn("seen_at", F.current_timestamp())
    sinks.upsert(spark, path, points, ["point_id"], ["seen_at"])
    return points.count()


def ingest_docs(spark: SparkSession, root: str, path: str) -> int:
    points = doc_points(files.markdown(spark, root)).withColumn("seen_at", F.current_timestamp())
    sinks.upsert(spark, path, points, ["point_id"], ["seen_at"])
    return points.count()
