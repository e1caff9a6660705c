"""Mixing sources to target shares of all tokens.

Documents get hash-random keys and are range-sorted by source and key; the running token count within a source is a sum within the
partition plus the sums of the partitions before it. Each source is then cut at its budget, after as many whole passes as it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import encode_corpus
from tessera.operators.prefix import running_sum
from tessera.session import staged


def token_sizes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", folder: str | None = None) -> DataFrame:
    """Rows (row_no, doc_id, source, mark, n_tokens), one for each document, whatever repeats or is missing. `mark` is a hash of the text; `row_no`
    tells rows apart, is another one in every run, and decides nothing but which of entirely equal rows comes first."""
    own = staged(documents.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), "mix-input")
    return own.select("row_no", "doc_id", "source", F.xxhash64("text").alias("mark")).join(encode_corpus(own, "row_no", "text", folder=folder, counts=True), "row_no")


def _targets(targets: DataFrame) -> DataFrame:
    """One row for each source with a positive weight; of repeated sources the heavier counts."""
    w = Window.partitionBy("source").orderBy(F.desc("weight"), F.desc("max_repeats"))
    t = targets.select("source", "weight", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).cast("bigint").alias("max_repeats"))
    return t.filter(F.col("source").isNotNull() & (F.col("weight") > 0)).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Rows (source, weight, max_repeats, n_docs, available_tokens, budget), one for each source of the targets.

    Without `total_tokens` the mix is the largest in which every source that has any tokens keeps its weight against the others
    within its repeats. With it, sources that would need more repeats than allowed give what they can, and the others share the rest
    by weight, until nothing changes. A source without tokens has budget 0.
    """
    have = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("available_tokens"))
    t = _targets(targets).join(have, "source", "left").fillna(0, ["n_docs", "available_tokens"])
    cap = F.col("available_tokens") * F.col("max_repeats")
    t = t.withColumn("cap", cap.cast("double"))
    every = Window.partitionBy(F.lit(1))  # as many rows as the targets have
    live = F.col("cap") > 0
    if total_tokens is None:
        t = t.withColumn("scale", F.min(F.when(live, F.col("cap") / F.col("weight"))).over(every))
        return t.withColumn("budget", F.when(live, F.least("cap", F.col("scale") * F.col("weight"))).otherwise(0.0)).drop("cap", "scale")
    # Sources sorted by cap over weight fill up first: with the first k full, the rest have (total - their caps) / (weights left).
    by_ratio = every.orderBy(F.col("cap") / F.col("weight"), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(float(total_tokens)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    t = t.withColumn("level", level)
    t = t.withColumn("final", F.min(F.when(F.col("level") < F.col("cap") / F.col("weight"), F.col("level"))).over(every))
    return t.withColumn("budget", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.greatest(F.col("final"), F.lit(0.0)) * F.col("weight")))).drop("cap", "level", "final")


def running(sizes: DataFrame, seed: int = 7) -> DataFrame:
    """Sizes with `upto`, the tokens of the source up to and with the document in random order; no source is gathered in one task."""
    used = sizes.filter(F.col("source").isNotNull() & (F.col("n_tokens") > 0))
    keyed = used.select("row_no", "doc_id", "source", "n_tokens", F.xxhash64(F.lit(seed), "doc_id", "source", "mark").alias("key"), "mark")
    return running_sum(keyed, "source", ["key", "doc_id", "mark", "row_no"], "n_tokens").drop("key", "mark")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix as rows (doc_id, source, use_no, n_tokens), a row for each use of a document, and the report by source.

    A source is used in whole passes while its budget lasts; in the last pass, documents in random order up to the one nearest to the
    budget. No document is used more often than max_repeats (missing: once). Documents of no target source and documents without
    tokens are not used; targets without documents are reported with 0. The order depends on the seed, doc_id, source and text alone, not on how the rows
    are stored or partitioned. The report:
    (source, weight, max_repeats, n_docs, available_tokens, budget, used_docs, used_tokens, share).
    """
    sizes = staged(token_sizes(documents, folder=folder), "mix-sizes")
    plan = staged(budgets(sizes, targets, total_tokens), "mix-plan")
    cut = running(sizes, seed).join(plan.select("source", "budget", "available_tokens", "max_repeats"), "source")
    passes = F.least(F.floor(F.col("budget") / F.col("available_tokens")), F.col("max_repeats"))
    rest = F.col("budget") - passes * F.col("available_tokens")
    last = (F.col("upto") - F.col("n_tokens") / 2 <= rest) & (passes < F.col("max_repeats"))
    used = cut.withColumn("uses", (passes + last.cast("int")).cast("int")).filter("uses > 0")
    used = staged(used.select("doc_id", "source", "n_tokens", "uses"), "mix-used")
    got = used.groupBy("source").agg(F.sum("uses").alias("used_docs"), F.sum(F.col("uses") * F.col("n_tokens")).alias("used_tokens"))
    report = plan.join(got, "source", "left").fillna(0, ["used_docs", "used_tokens"])
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    report = report.withColumn("share", F.when(total > 0, F.col("used_tokens") / total).otherwise(0.0))
    rows = used.select("doc_id", "source", F.explode(F.sequence(F.lit(1), "uses")).alias("use_no"), "n_tokens")
    return rows, report.select("source", "weight", "max_repeats", "n_docs", "available_tokens", F.round("budget").cast("bigint").alias("budget"), "used_docs", "used_tokens", F.round("share", 6).alias("share"))
