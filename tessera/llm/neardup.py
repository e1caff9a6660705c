"""Near-duplicate records by the words they share: SetSketch registers, banded, estimated jointly, verified.

A record's words become 64-bit hashes. Register i of its sketch is floor(1 - log_b h) of the smallest exponentially distributed value h
that its words draw, truncated to 0..q+1: sketches of parts merge by maximum, and equal registers are likelier the more words two records
share. Records of equal words form a class with one representative. Representatives that agree in all registers of a band are candidates;
the likelihood of the counts of larger, smaller and equal registers gives the similarity, and what remains is counted exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import components
from tessera.session import staged

THRESHOLD = 0.8
BANDS, ROWS = 48, 7  # two records at the threshold agree in no band once in 75,000 cases
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 2  # b, a and q of the sketch
MARGIN = 0.15  # estimates further below the threshold are dropped: over six standard deviations with 336 registers
BLOCK = 256  # members of a bucket that meet in one join key


def word_sets(df: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """Rows (id, words): sorted distinct hashes of the maximal runs of ASCII letters, digits and underscore, in lower case."""
    text = F.concat_ws("\n", *[F.col(c) for c in fields])
    words = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+"), F.lit(0)), lambda w: F.xxhash64(F.lower(w)))
    return df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(words)).alias("words")).filter("id is not null and size(words) > 0")


def _multipliers(m: int) -> np.ndarray:
    return np.random.default_rng(20240917).integers(0, 2**63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(flat: np.ndarray, starts: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """Sketches (sets x m) of the sets of hashes that begin at `starts` in `flat`; no set is empty."""
    x = flat.view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    low = np.empty((len(starts), m), np.uint64)
    for i, a in enumerate(_multipliers(m)):
        v = x * a
        v ^= v >> np.uint64(29)
        low[:, i] = np.minimum.reduceat(v, starts)
    h = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def merge(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of the union of sets."""
    return np.maximum.reduce(sketches)


def band_keys(reg: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, m = reg.shape
    keys = np.zeros((n, m // rows), np.uint64)
    keys += np.arange(m // rows, dtype=np.uint64)[None, :]
    for r in range(rows):
        keys = (keys * np.uint64(0xD6E8FEB86659FD93)) ^ reg[:, r::rows].astype(np.uint64)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity that makes the counts of larger, smaller and equal registers most likely, given the sizes of both sets."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        x, y = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(x) < likelihood(y)
        low, high = np.where(left, x, low), np.where(left, high, y)
    return (low + high) / 2


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.asarray(column.value_lengths())
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def sketched(classes: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Rows (id, words, reg, keys) of rows (id, words)."""
    id_type = classes.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            flat, ends = _lists(batch.column(1))
            reg = registers(flat, ends[:-1], bands * rows)
            keys = band_keys(reg, rows)
            offsets = pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32))
            blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bands * rows * 2), len(reg), [None, pa.py_buffer(reg.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blob, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=["id", "words", "reg", "keys"])

    return classes.select("id", "words").mapInArrow(run, f"id {id_type}, words array<bigint>, reg binary, keys array<bigint>")


def _blocked(rows: DataFrame, key: str, block: int) -> DataFrame:
    """`rows` (id, key) of the keys that more than one row has, with `blocks`, the number of blocks of about `block` rows that the key is cut into,
    and `mine`, the block of the row."""
    big = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    own = rows.join(big, key).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    return own.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def together(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs a < b of ids of rows (id, key) that share a key, once for each key they share.

    A bucket of n rows is cut into blocks of about `block`, and pairs of blocks are the join keys, so a bucket of any size is
    spread over tasks and none is cut short.
    """
    own = _blocked(rows, "key", block)
    left = own.select("key", F.col("id").alias("a"), F.col("mine").alias("i"), F.explode(F.sequence(F.col("mine"), F.col("blocks") - 1)).alias("j"))
    right = own.select("key", F.col("id").alias("b"), F.col("mine").alias("j"), F.explode(F.sequence(F.lit(0), "mine")).alias("i"))
    met = left.join(right, ["key", "i", "j"]).filter((F.col("i") < F.col("j")) & (F.col("a") != F.col("b")) | (F.col("a") < F.col("b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def bucket_pairs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct pairs of `together`."""
    return together(rows, block).distinct()


def verified(pairs: DataFrame, sketches: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """Rows (a, b, similarity) of the pairs at or above the threshold. The registers of both go first; words travel for the pairs whose estimate is
    not further below the threshold than `margin` alone."""
    id_type = pairs.schema["a"].dataType.simpleString()

    def estimate(batches):
        for batch in batches:
            if not len(batch):
                continue
            na, nb = (batch.column(k).to_numpy() for k in (2, 3))
            ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(len(batch), -1) for k in (4, 5))
            keep = pa.array((joint_estimate(ra, rb, na, nb) >= threshold - margin) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    def exact(batches):
        for batch in batches:
            if not len(batch):
                continue
            (fa, ea), (fb, eb) = _lists(batch.column(2)), _lists(batch.column(3))
            na, nb = np.diff(ea), np.diff(eb)
            at, sim = [], []
            for i in range(len(batch)):
                common = len(np.intersect1d(fa[ea[i] : ea[i + 1]], fb[eb[i] : eb[i + 1]], assume_unique=True))
                union = int(na[i] + nb[i]) - common
                if common >= threshold * union - 1e-9:
                    at.append(i)
                    sim.append(common / union)
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(sim, pa.float64())], names=["a", "b", "similarity"])

    def with_both(p: DataFrame, own: DataFrame) -> DataFrame:
        names = own.columns[1:]
        both = p.join(own.toDF("a", *[f"{c}_a" for c in names]), "a").join(own.toDF("b", *[f"{c}_b" for c in names]), "b")
        return both.select("a", "b", *[f"{c}_{side}" for c in names for side in "ab"])

    likely = with_both(pairs, sketches.select("id", F.size("words").alias("n"), "reg")).mapInArrow(estimate, f"a {id_type}, b {id_type}")
    return with_both(likely, sketches.select("id", "words")).mapInArrow(exact, f"a {id_type}, b {id_type}, similarity double")


def _with_keys(sets: DataFrame) -> DataFrame:
    return sets.select("id", "words", F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words", F.size("words")).alias("k2"))


def _one_record(sets: DataFrame) -> DataFrame:
    """Staged `sets` (id, words) with keys of the words, the rows of a repeated id as one, which has the words of all of them."""
    sets = staged(_with_keys(sets), "word-sets")
    twice = staged(sets.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "repeated-ids")
    if not twice.take(1):
        return sets
    words = sets.join(twice, "id").select("id", F.explode("words").alias("w")).distinct()
    merged = words.groupBy("id").agg(F.array_sort(F.collect_list("w")).alias("words"))  # no more than the distinct words of a record
    return staged(sets.join(twice, "id", "left_anti").unionByName(_with_keys(merged)), "word-sets")


def near_duplicates(df: DataFrame, id_col: str, fields: Sequence[str], threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Membership (id, class_id) of the records in classes of equal words, and pairs (a, b, similarity) between class representatives.

    A missing field has no words; a record without words or id is in no class; rows of one id are one record with the words of all. A class is named by its smallest id. Pairs have a < b and a share
    of common words of `threshold` or more; none between representatives is left out but for the banding, see `BANDS`. Other columns of `df`
    don't matter. An empty table gives empty results.
    """
    sets = _one_record(word_sets(df, id_col, fields))
    heads = sets.groupBy("k1", "k2").agg(F.min("id").alias("class_id"))
    member = staged(sets.select("id", "k1", "k2").join(heads, ["k1", "k2"]).select("id", "class_id"), "classes")
    classes = sets.select("id", "words").join(member.filter("id = class_id").select("id"), "id")
    sketches = staged(sketched(classes, bands, rows), "sketches")
    pairs = bucket_pairs(sketches.select("id", F.explode("keys").alias("key")))
    return member, verified(pairs, sketches, threshold)


def all_pairs(member: DataFrame, pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b), a < b, of records: of one class, or of two linked classes. Classes are cut into blocks of about `block` records that meet
    each other, so neither a class nor a link of two large ones is one task's work."""
    inside = together(member.select("id", F.col("class_id").alias("key")), block)
    sizes = member.groupBy("class_id").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = member.join(sizes, "class_id").select("id", "class_id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("mine"))
    linked = pairs.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"))
    linked = linked.join(sizes.toDF("class_a", "n_a"), "class_a").join(sizes.toDF("class_b", "n_b"), "class_b")
    linked = linked.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_a") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)))
    across = linked.join(placed.toDF("a", "class_a", "i"), ["class_a", "i"]).join(placed.toDF("b", "class_b", "j"), ["class_b", "j"])
    return inside.union(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def groups(member: DataFrame, pairs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Rows (id, class_id, group_id, n_links): a record's class, its connected group of classes, and the links of its class. Of the records of `ids`
    (id), those in no class, which have no words, are each a class and group of their own."""
    linked = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    known = linked.join(ends, "node").withColumnRenamed("node", "class_id")
    if ids is not None:
        member = member.unionByName(ids.filter("id is not null").join(member.select("id").distinct(), "id", "left_anti").select("id", F.col("id").alias("class_id")))
    out = member.join(known, "class_id", "left")
    return out.select("id", "class_id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
