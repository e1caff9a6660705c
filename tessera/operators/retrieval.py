"""Hybrid retrieval: filters, rank fusion, reranking, configurations and routing of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.operators.vectors import ranked, tokens

#: The constant of the fusion, the named configurations, and words of the routes.
RRF_K = 60
OVERFETCH = 4


@dataclass(frozen=True)
class Config:
    alpha: float = 0.5
    retrieve_k: int = 20
    rerank_k: int = 6
    rerank: bool = True

    def __post_init__(self):
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must be within 0 and 1")


CONFIGS = {"default": Config(rerank=False), "reranker": Config(), "dense_only": Config(alpha=1.0, rerank=False), "sparse_only": Config(alpha=0.0, rerank=False)}
ALPHAS = (0.0, 0.5, 0.7, 1.0)


def limits(top_k: int = 10, config: Config | None = None, prefetch: int | None = None) -> tuple[float, int, int, int, bool]:
    """(alpha, candidates of each side, fused, final, rerank) of a search; with a configuration `top_k` counts for nothing."""
    if not 1 <= top_k <= 100:
        raise ValueError("top_k must be within 1 and 100")
    if config:
        return config.alpha, config.retrieve_k * OVERFETCH, config.retrieve_k, config.rerank_k if config.rerank else config.retrieve_k, config.rerank
    fused = prefetch or top_k * OVERFETCH
    return 0.5, fused * OVERFETCH, fused, top_k, False


def checked(query: str, top_k: int = 10, alpha: float | None = None) -> str:
    """A query without blanks around it; a blank one, a number of hits beyond 1 to 100 or a weight beyond 0 to 1 is an error."""
    if not query or not query.strip():
        raise ValueError("the query is blank")
    limits(top_k)
    if alpha is not None:
        Config(alpha=alpha)
    return query.strip()


def metadata_filter(wanted: Mapping[str, str | None]) -> Column:
    """All given fields equal; a missing or empty value asks for nothing."""
    return reduce(lambda a, b: a & b, [F.col(c) == v for c, v in wanted.items() if v], F.lit(True))


def fuse(dense: DataFrame, sparse: DataFrame, alpha: float | Column = 0.5, k: int | None = None, rrf_k: int = RRF_K, decimals: int = 12) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists (query_id, id, rank).

    A hit of one list alone counts 0 in the other, and is kept even where its list has no weight. Ties keep the dense order, then the sparse one.
    """
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    both = dense.select("query_id", "id", F.col("rank").alias("dense_rank")).join(sparse.select("query_id", "id", F.col("rank").alias("sparse_rank")), ["query_id", "id"], "full")

    def part(weight: Column, rank: str) -> Column:
        return F.coalesce(weight / (F.lit(rrf_k) + F.col(rank) + 1), F.lit(0.0))

    scored = both.withColumn("score", F.round(part(a, "dense_rank") + part(1 - a, "sparse_rank"), decimals))
    return ranked(scored, k, [F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.asc("id")])


def overlap_score(query: Column, content: Column) -> Column:
    """The default reranker: the share of the query's words that the content holds."""
    q, c = F.array_distinct(tokens(F.coalesce(query, F.lit("")))), F.array_distinct(tokens(F.coalesce(content, F.lit(""))))
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, c)) / F.size(q), 6)).otherwise(0.0)


def model_score(make: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """A reranker from a model: `make` is called once in each worker, what it returns scores lists of queries and contents."""

    @pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, c in batches:
            yield pd.Series(model(q.fillna("").tolist(), c.fillna("").tolist()), dtype=float)

    return lambda query, content: run(query, content)


def rerank(hits: DataFrame, queries: DataFrame, contents: DataFrame, k: int, score: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """Hits (query_id, id, rank) with the model's score of (query_id, query) and (id, content) in place of the old one, cut to k; ties keep the old order."""
    own = hits.select("query_id", "id", F.col("rank").alias("prior")).join(queries.select("query_id", "query"), "query_id").join(contents.select("id", "content"), "id", "left")
    scored = own.select("query_id", "id", "prior", score(F.col("query"), F.col("content")).alias("score"))
    return ranked(scored, k, [F.desc("score"), F.asc("prior")])


def sweep(dense: DataFrame, sparse: DataFrame, spark: SparkSession, alphas: tuple[float, ...] = ALPHAS, k: int = 10) -> DataFrame:
    """The fusion under every alpha, in one plan: rows (alpha, query_id, id, score, rank)."""
    weights = F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha")
    d, s = (x.select(weights, "query_id", "id", "rank") for x in (dense, sparse))
    key = F.struct("alpha", "query_id")
    out = fuse(d.withColumn("query_id", key), s.withColumn("query_id", key), F.col("query_id.alpha"), k)
    return out.select("query_id.alpha", "query_id.query_id", "id", "score", "rank")


#: The intents of queries with the collections that are searched for them.
COLLECTIONS = {
    "code_pattern": ("code_chunks", "migration_patterns"),
    "migration_guide": ("doc_chunks",),
    "api_reference": ("doc_chunks", "code_chunks"),
    "combined": ("code_chunks", "doc_chunks", "migration_patterns"),
}
LANGUAGES = ("python", "typescript", "javascript", "java", "csharp", "go")


def intent(query: Column) -> Column:
    """The default classifier of queries, by words: each of three intents has its own, and a query with words of several, or of none, is `combined`."""
    low = F.lower(query)
    code = low.rlike(r"\b(show|example|examples|snippet|pattern|implement\w*|define|syntax|write)\b")
    guide = low.rlike(r"\b(migrat\w*|upgrade\w*|changed|changelog|convert\w*|guide)\b")
    reference = low.rlike(r"\b(signature|arguments?|parameters?|returns?|return type|accepts?|class|module|does)\b|\w\(\)")
    hits = code.cast("int") + guide.cast("int") + reference.cast("int")
    return F.when(hits != 1, "combined").when(code, "code_pattern").when(guide, "migration_guide").when(reference, "api_reference").otherwise("combined")


def route(query: Column, of: Callable[[Column], Column] = intent) -> Column:
    """(intent, collections, language_hint) of a query: the collections of its intent, and the language that it names, if it does."""
    kind = of(query)
    named = F.create_map(*[x for k, v in COLLECTIONS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])
    hint = F.nullif(F.regexp_extract(F.lower(query), r"\b(" + "|".join(LANGUAGES) + r")\b", 1), F.lit(""))
    return F.struct(kind.alias("intent"), named[kind].alias("collections"), hint.alias("language_hint"))
