"""Quality of ranked lists against what should have been found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at(found: Column, truth: Column, k: int) -> Column:
    """The share of the true ids among the first k found; 0 if nothing is true."""
    true = F.array_distinct(truth)
    return F.when(F.size(true) > 0, F.size(F.array_intersect(F.slice(found, 1, k), true)) / F.size(true)).otherwise(0.0)


def mrr(found: Column, truth: Column) -> Column:
    """1 over the rank of the first true id in the whole list; 0 if there is none."""
    hits = F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(truth, x), i + 1)), lambda r: r.isNotNull())
    return F.when(F.size(hits) > 0, 1.0 / F.array_min(hits)).otherwise(0.0)


def ndcg_at(found: Column, truth: Column, k: int) -> Column:
    """Discounted gain of the first k found, each true id counting 1, over that of a perfect list; 0 if nothing is true."""

    def gain(i: Column) -> Column:
        return 1.0 / F.log2(i.cast("double") + 2)

    got = F.aggregate(F.transform(F.slice(found, 1, k), lambda x, i: F.when(F.array_contains(truth, x), gain(i)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    best = F.aggregate(F.sequence(F.lit(0), F.greatest(F.least(F.size(F.array_distinct(truth)), F.lit(k)) - 1, F.lit(0))), F.lit(0.0), lambda a, i: a + gain(i))
    return F.when(F.size(truth) > 0, got / best).otherwise(0.0)


def context_precision(judgements: Column, shown: Column) -> Column:
    """The share of shown hits judged relevant; missing judgements count as not, spare ones are dropped; missing if nothing was shown or judged."""
    kept = F.filter(F.slice(judgements, F.lit(1), F.greatest(shown, F.lit(0))), lambda x: x)
    return F.when((shown > 0) & judgements.isNotNull(), F.size(kept) / shown)


def per_query(lists: DataFrame, k: int = 5, decimals: int = 6) -> DataFrame:
    """Rows of `lists` (query_id, found, truth, ...) with recall, mrr and ndcg."""
    f, t = F.col("found"), F.col("truth")
    return lists.withColumns({"recall": F.round(recall_at(f, t, k), decimals), "mrr": F.round(mrr(f, t), decimals), "ndcg": F.round(ndcg_at(f, t, k), decimals)})


def graded(hits: DataFrame, truth: DataFrame, k: int = 5, decimals: int = 6) -> DataFrame:
    """The measures of ranked hits (query_id, rank from 0, relevant) against the number of what is true for each query (query_id, size, ...): rows of `truth` with recall, mrr
    and ndcg. No list is gathered, so what is true may be any number; `hits` holds a query's relevant ids once each."""
    gain = 1.0 / F.log2(F.col("rank").cast("double") + 2)
    seen = hits.filter("relevant").groupBy("query_id").agg(F.count_if(F.col("rank") < k).alias("found"), F.min("rank").alias("first"), F.coalesce(F.sum(F.when(F.col("rank") < k, gain)), F.lit(0.0)).alias("got"))
    best = F.aggregate(F.sequence(F.lit(0), F.greatest(F.least(F.col("size"), F.lit(k)) - 1, F.lit(0)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i.cast("double") + 2))
    some = F.col("size") > 0
    out = truth.join(seen, "query_id", "left").withColumns(
        {
            "recall": F.round(F.when(some, F.coalesce("found", F.lit(0)) / F.col("size")).otherwise(0.0), decimals),
            "mrr": F.round(F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0)), decimals),
            "ndcg": F.round(F.when(some, F.coalesce("got", F.lit(0.0)) / best).otherwise(0.0), decimals),
        }
    )
    return out.drop("found", "first", "got")


def summary(measured: DataFrame, *by: str, decimals: int = 4) -> DataFrame:
    """Means of the measures by each of the columns `by` and of all, in one pass; of no queries the means are missing."""
    means = [F.round(F.avg(c), decimals).alias(c) for c in ("recall", "mrr", "ndcg")]
    if not by:
        return measured.agg(F.count("*").alias("n"), *means)
    sets = [[F.col(c)] for c in by] + [[]]
    return measured.groupingSets(sets, *[F.col(c) for c in by]).agg(F.count("*").alias("n"), *means)


def hit_rate(ranks: DataFrame, *by: str) -> DataFrame:
    """Share of queries with a hit and mean reciprocal rank of rows with `found_at`, from 1, missing where nothing was found; 0 of no queries."""
    rate = F.coalesce(F.avg(F.col("found_at").isNotNull().cast("double")), F.lit(0.0))
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), F.round(rate, 6).alias("hit_rate"), F.round(F.coalesce(F.avg(F.coalesce(1.0 / F.col("found_at"), F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"))


def best(runs: DataFrame, *measures: str, order: str) -> DataFrame:
    """The run with the greatest measures, the first in `order` among equals."""
    return runs.orderBy(*[F.desc(m) for m in measures], F.asc(order)).limit(1)


def table(measured: DataFrame, names: list[str], share: str, order: str) -> DataFrame:
    """Rows (place, line) of a table in markdown, by falling share and then `order`; for a few rows."""
    from pyspark.sql import Window

    from tessera.operators.runs import percent_text, table_line

    place = F.row_number().over(Window.orderBy(F.desc(share), F.asc(order))).alias("place")
    return measured.select(place, table_line(*[F.col(c) for c in names], percent_text(F.col(share))).alias("line"))
