"""Exact nearest vectors and term weights: the two ranked lists of hybrid retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import staged

QUERY_BLOCK = 2048  # queries that a task holds at a time
ROW_BLOCK = 1 << 15  # and vectors that they meet there
POSTING_BLOCK = 1 << 22  # or postings
SCORES = 1 << 23  # scores that are held at a time
DECIMALS = 6
#: Fixed values of the term weights.
K1, B, AVERAGE_LENGTH = 1.2, 0.75, 256.0


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two arrays of numbers, in double precision; missing if either is missing, zero or of another length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def nearest(queries: DataFrame, corpus: DataFrame, k: int | None, decimals: int = DECIMALS, threshold: float | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """Rows (query_id, id, score, rank) of the k most similar vectors of `corpus` (id, vec) for each of `queries` (query_id, vec), rank from 0.

    Scores are cosines rounded to `decimals`; ties go to the smaller id. A given set of queries meets all rows in blocks: each block of
    queries is joined to each partition of the corpus, multiplied there, and cut to k for each query before anything is shuffled. Missing
    and zero vectors take no part, nor do those of another length. Without k, all at or above the threshold come out. Filters belong on `corpus`, before the ranking.
    """
    q_type, id_type = queries.schema["query_id"].dataType.simpleString(), corpus.schema["id"].dataType.simpleString()
    numbered = staged(queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null and query_id is not null"), "queries")
    usable = corpus.select("id", F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null and id is not null")
    blocks, parts = max(1, -(-numbered.count() // block)), _parts(usable, usable.count(), ROW_BLOCK)
    left = numbered.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "query_id", "vec")
    right = usable.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block2"), "id", F.col("vec").alias("vec2"))

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        (qv, qn), (cv, cn) = _flat(q.column("vec")), _flat(c.column("vec2"))
        places = _places(c.column("id"))
        for dim in np.unique(qn[qn > 0]).tolist():
            qi, ci = np.flatnonzero(qn == dim), np.flatnonzero(cn == dim)
            if len(ci):
                b = _scaled(cv, cn, ci, dim)
                for some in np.array_split(qi, -(-len(qi) * len(ci) // SCORES)):
                    r, at, score = _best(np.round(_scaled(qv, qn, some, dim) @ b.T, decimals), places[ci], k, threshold)
                    out.append((some[r], ci[at], score))
        a, b, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": q.column("query_id").take(pa.array(a)), "id": c.column("id").take(pa.array(b)), "score": pa.array(score)})

    hits = left.groupBy("block", "part").cogroup(right.groupBy("block2", "part")).applyInArrow(run, f"query_id {q_type}, id {id_type}, score double")
    return ranked(hits, k)


def _parts(df: DataFrame, rows: int, size: int) -> int:
    """Into how many parts rows are cut: none holds many more than `size`, and small tables keep all cores busy."""
    return max(1, -(-rows // size), min(df.sparkSession.sparkContext.defaultParallelism * 2, rows // 1000))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of lists side by side, and the length of each list."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths(), np.int64)


def _scaled(flat: np.ndarray, sizes: np.ndarray, rows: np.ndarray, dim: int) -> np.ndarray:
    """The lists of length `dim` at `rows` as a matrix of rows of length 1; zero rows, and those with numbers that are none, become NaN."""
    starts = np.cumsum(sizes) - sizes
    m = flat[starts[rows][:, None] + np.arange(dim)].astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def _places(ids: pa.ChunkedArray) -> np.ndarray:
    """The place of each id in their order."""
    order = pc.sort_indices(ids).to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _best(scores: np.ndarray, places: np.ndarray, k: int | None, threshold: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k greatest scores of each row, of equal ones those of the first places; NaN and what is below the threshold don't count."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    least = np.full(len(scores), -np.inf if threshold is None else threshold)
    if k is not None and k < scores.shape[1]:
        least = np.maximum(least, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
    r, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    s = scores[r, c]
    order = np.lexsort((places[c], -s, r))
    r, c, s = r[order], c[order], s[order]
    if k is not None:
        ok = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c, s = r[ok], c[ok], s[ok]
    return r, c, s


def ranked(hits: DataFrame, k: int | None = None, order: list | None = None) -> DataFrame:
    """Hits (query_id, id, score) with their rank from 0 within the query, the first k if k is given."""
    w = Window.partitionBy("query_id").orderBy(*(order or [F.desc("score"), F.asc("id")]))
    out = hits.withColumn("rank", F.row_number().over(w) - 1)
    return out if k is None else out.filter(F.col("rank") < k)


def tokens(text: Column) -> Column:
    """Lower-case words: runs of ASCII letters, digits and underscore and of letters beyond ASCII."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_ß-öø-ÿ]+"), F.lit(0))


def term_weights(docs: DataFrame, k1: float = K1, b: float = B, average: float = AVERAGE_LENGTH) -> DataFrame:
    """Rows (id, term, weight) of `docs` (id, text): saturated term frequencies, without a factor for rarity. A missing text has none."""
    terms = docs.select("id", tokens(F.col("text")).alias("terms")).filter("size(terms) > 0")
    tf = terms.select("id", F.size("terms").alias("n"), F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("n").alias("n"))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / average))
    return tf.select("id", "term", weight.alias("weight"))


def sparse_nearest(query_terms: DataFrame, postings: DataFrame, k: int, decimals: int = DECIMALS, block: int = QUERY_BLOCK) -> DataFrame:
    """Rows (query_id, id, score, rank) of the k documents of `postings` (id, term, weight) with the greatest sum of products with each query
    of `query_terms` (query_id, term, weight); documents that share no term don't appear.

    Documents are cut into parts that each hold all their terms, queries into blocks; every block meets every part, is summed up there, and cut to k for each
    query before anything is shuffled. So a word that all documents have is no key, and its products never leave their task. Postings of words that no query has stay behind.
    """
    q_type, id_type = query_terms.schema["query_id"].dataType.simpleString(), postings.schema["id"].dataType.simpleString()
    asked = staged(query_terms.select("query_id", "term", F.col("weight").cast("double").alias("wq")).filter("query_id is not null"), "query-terms")
    held = postings.join(asked.select("term").distinct(), "term", "left_semi").select("id", F.xxhash64("term").alias("term"), F.col("weight").cast("double").alias("weight"))
    held = staged(held.filter("id is not null"), "postings")
    blocks, parts = max(1, -(-asked.select("query_id").distinct().count() // block)), _parts(held, held.count(), POSTING_BLOCK)
    left = asked.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "query_id", F.xxhash64("term").alias("term"), "wq")
    right = held.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block2"), "id", "term", "weight")

    def run(q: pa.Table, p: pa.Table) -> pa.Table:
        docs, of_doc = _coded(p.column("id"))
        asking, of_query = _coded(q.column("query_id"))
        terms, weights = p.column("term").to_numpy(), p.column("weight").to_numpy()
        order = np.argsort(terms, kind="stable")
        terms, weights, of_doc = terms[order], weights[order], of_doc[order]
        by_query = np.argsort(of_query, kind="stable")
        wanted, wq, of_query = q.column("term").to_numpy()[by_query], q.column("wq").to_numpy()[by_query], of_query[by_query]
        first, last = np.searchsorted(terms, wanted), np.searchsorted(terms, wanted, side="right")
        ends = np.searchsorted(of_query, np.arange(len(asking) + 1))
        places, out = _places(docs), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i in range(len(asking)):
            sums, met = np.zeros(len(docs)), np.zeros(len(docs), bool)
            for t in range(ends[i], ends[i + 1]):
                own = of_doc[first[t] : last[t]]  # a document has a term once
                sums[own] += wq[t] * weights[first[t] : last[t]]
                met[own] = True
            at = np.flatnonzero(met)
            if len(at):
                r, c, score = _best(np.round(sums[at], decimals)[None, :], places[at], k)
                out.append((np.full(len(r), i), at[c], score))
        a, b, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": asking.take(pa.array(a)), "id": docs.take(pa.array(b)), "score": pa.array(score)})

    hits = left.groupBy("block", "part").cogroup(right.groupBy("block2", "part")).applyInArrow(run, f"query_id {q_type}, id {id_type}, score double")
    return ranked(hits, k)


def _coded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values, and for each row the number of its value."""
    coded = column.combine_chunks().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()
