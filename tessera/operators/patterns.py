"""A store of patterns that counts near-duplicates instead of keeping them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.vectors import nearest
from tessera.session import staged

SAME = 0.95  # a fixed value: from this cosine on a pattern is one that is known


def leaders(ids: DataFrame, links: DataFrame) -> DataFrame:
    """Those of `ids` (id) that become entries when they arrive in order of id: the ones that no earlier entry is linked to by `links` (a, b), a < b.

    All whose earlier neighbours are decided are decided together, so the rounds are few, and no group of neighbours is gathered.
    """
    entries = None
    open_, pairs = staged(ids.select("id").distinct(), "open"), staged(links.select("a", "b").distinct(), "links")
    while open_.take(1):
        free = staged(open_.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_anti"), "free")
        entries = free if entries is None else entries.union(free)
        hit = staged(pairs.join(free.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct(), "hit")
        gone = free.union(hit)
        open_ = staged(open_.join(gone, "id", "left_anti"), "open")
        pairs = staged(pairs.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"), "links")
    return entries if entries is not None else ids.select("id").limit(0)


def record(store: DataFrame, incoming: DataFrame, threshold: float = SAME) -> DataFrame:
    """Rows (id, entry, score, is_new) of what each incoming pattern (id, vec) becomes: a count more for the most similar entry at or above the
    threshold, the older of equals, or an entry of its own. Entries of the store (id, vec) come before all that are incoming; those arrive by id.
    """
    known = nearest(incoming.withColumnRenamed("id", "query_id"), store, 1, threshold=threshold).select(F.col("query_id").alias("id"), F.col("id").alias("entry"), "score")
    known = staged(known, "known")
    fresh = staged(incoming.join(known.select("id"), "id", "left_anti"), "fresh")
    near = staged(nearest(fresh.withColumnRenamed("id", "query_id"), fresh, None, threshold=threshold).filter("query_id <> id"), "near")
    links = near.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"))
    new = staged(leaders(fresh, links), "leaders")
    best = near.filter("id < query_id").join(new, "id").withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter("n = 1")
    joined = best.select(F.col("query_id").alias("id"), F.col("id").alias("entry"), "score").join(new, "id", "left_anti")
    own = new.select("id", F.col("id").alias("entry"), F.lit(1.0).alias("score"))
    return known.union(joined).withColumn("is_new", F.lit(False)).union(own.withColumn("is_new", F.lit(True)))


def counts(store: DataFrame, recorded: DataFrame) -> DataFrame:
    """Rows (id, success_count) of all entries after `recorded`: the store's own counts and one for each pattern that fell to an entry."""
    more = recorded.groupBy(F.col("entry").alias("id")).agg(F.count("*").alias("n"))
    return store.select("id", "success_count").join(more, "id", "full").select("id", (F.coalesce("success_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("success_count"))


def seeded(store: DataFrame, seeds: DataFrame) -> DataFrame:
    """`store` with `seeds` (id, success_count, ...) in place of the entries of their ids, counted once again; seeding twice changes nothing more."""
    own = seeds.dropDuplicates(["id"]).withColumn("success_count", F.lit(1))
    return store.join(own.select("id"), "id", "left_anti").unionByName(own, allowMissingColumns=True)
