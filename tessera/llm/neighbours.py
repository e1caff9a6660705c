"""The k most similar vectors of every vector, by a permutation index.

Pivots are drawn from the vectors; a vector is represented by its nearest pivots in order. It is posted in the inverted files of the
first of them and, as a query, visits the files of its very first ones. There the rows are ranked by the footrule distance of their
pivot orders, and the nearest by that measure, with all ties, are reranked by cosine. Files that grow large are cut into blocks, and
blocks of queries meet blocks of postings. Equal vectors are one entry that carries its smallest ids.

A direction that many different vectors have (scaled copies) is crowded: its smallest entries stand for it in the index, all its vectors get
its smallest ids, and a query from outside that it is near to meets all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import staged

MAX_PIVOTS = 1 << 16  # bound of the sample that the index is fitted on, and of what each task holds of it; reached at 1.07 billion vectors
ORDER = 64  # pivots in a vector's order
POSTED, VISITED = 8, 8  # files a vector is posted in, and visits; six more visits for every tenfold of VISITED_AT vectors
VISITED_AT = 40_000
RERANKED = 0.4  # share of a file that is reranked for a query, the nearest by footrule and their ties
LEAST = 64  # and at least so many
BLOCK = 4096  # rows of a block of a file
DECIMALS = 9
CROWD = 64  # different vectors of one direction from which on it is crowded; more than k
GRID = 2.0**-16  # diameter of the cells of directions: vectors of one cell have a cosine of 1 to nine decimals
REACH = 2e-5  # by which the cosines of a crowded direction may differ, seen from elsewhere
SLACK = 1e-5  # twice the error of a cosine in float32


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """Rows (id, vec) whose vector has `dim` numbers, not all of them zero and none missing or not finite."""
    good = F.size("vec").eqNullSafe(F.lit(dim)) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    return df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).filter("id is not null").filter(F.coalesce(good, F.lit(False)))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True).astype(np.float64)
    y = x / scale
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def _direction(x: np.ndarray) -> np.ndarray:
    """Hashes of directions: rows of one cell of a grid of unit vectors have the same."""
    factors = np.random.default_rng(7).integers(1, 2**63, x.shape[1], dtype=np.uint64) | np.uint64(1)
    return (np.rint(_unit(x) * (math.sqrt(x.shape[1]) / GRID)).astype(np.int64).view(np.uint64) * factors).sum(1, dtype=np.uint64).view(np.int64)


def pivot_count(n: int) -> int:
    """Twice the root of the number of vectors: files and the search for pivots then grow alike."""
    return int(min(MAX_PIVOTS, n, max(32, math.ceil(2 * math.sqrt(n)))))


def visit_count(n: int) -> int:
    """Files that a query visits: the more pivots there are, the more of them share the vectors near to it."""
    return VISITED + max(0, round(6 * math.log10(max(n, 1) / VISITED_AT)))


def _order(units: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    out = []
    for part in np.array_split(units.astype(np.float32), max(1, len(units) * len(pivots) >> 22)):  # some tens of MB at a time
        cos = part @ pivots.T
        top = np.argpartition(-cos, length - 1, axis=1)[:, :length] if length < cos.shape[1] else np.tile(np.arange(cos.shape[1]), (len(part), 1))
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(cos, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out).astype(np.uint16)


def _closeness(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For pivot orders of queries and postings, the sum over pivots of min(l - place in q, l - place in x): the footrule distance with
    absent pivots at place l is l(l+1) minus twice that."""
    length = q.shape[1]
    names, local = np.unique(np.concatenate([x.ravel(), q.ravel()]), return_inverse=True)
    weight = np.arange(length, 0, -1, dtype=np.int8)  # up to 127
    posted = np.zeros((len(names), len(x)), np.int8)  # an inverted file a row, dense within the block
    posted[local[: x.size].reshape(x.shape), np.arange(len(x))[:, None]] = weight
    out = np.empty((len(q), len(x)), np.int16)
    for i, files in enumerate(local[x.size :].reshape(q.shape)):
        np.minimum(posted[files], weight[:, None]).sum(0, dtype=np.int16, out=out[i])
    return out


def _nearest(q: np.ndarray, x: np.ndarray, q_id: np.ndarray, x_id: np.ndarray, close: np.ndarray, k: int, reranked: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the k nearest postings other than itself, as (query row, posting row, cosine), of the nearest by footrule."""
    n = len(x)
    keep = max(LEAST, math.ceil(reranked * n))
    if n > keep:
        cut = np.partition(close, n - keep, axis=1)[:, n - keep]
        cos = np.where(close >= cut[:, None], q.astype(np.float32) @ x.astype(np.float32).T, np.float32(-3))
    else:
        cos = q.astype(np.float32) @ x.astype(np.float32).T
    cos[q_id[:, None] == x_id[None, :]] = -3
    kth = np.partition(cos, n - k, axis=1)[:, n - k] if n > k else np.full(len(q), np.float32(-2))
    rows, cols = np.nonzero(cos >= np.maximum(kth - np.float32(SLACK), np.float32(-2))[:, None])  # with all that may be tied
    exact = np.empty(len(rows))
    for at in range(0, len(rows), 65536):
        part = slice(at, at + 65536)
        exact[part] = np.round(np.einsum("ij,ij->i", q[rows[part]], x[cols[part]]), DECIMALS)
    order = np.lexsort((x_id[cols], -exact, rows))
    rows, cols, exact = rows[order], cols[order], exact[order]
    ok = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[ok], cols[ok], exact[ok]


def nearest(df: DataFrame, id_col: str, vec_col: str, dim: int = 64, k: int = 5, posted: int = POSTED, visited: int | None = None, reranked: float = RERANKED) -> DataFrame:
    """Rows (id, neighbour, cosine, place) of the k most similar vectors of every vector, place from 1.

    Cosines are rounded to nine decimals; ties go to the smaller id. Vectors that are missing, of another length than `dim`, all zero or
    not finite take no part. Equal vectors each get the others as neighbours. ids must be integers; other columns don't matter. Fewer than k + 1 vectors
    give fewer neighbours, an empty table none. Found are most neighbours, not all; see the README for recall against brute force.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col, dim).withColumn("k1", F.xxhash64("vec")).withColumn("k2", F.xxhash64(F.lit(1), "vec"))
    rows = rows.withColumn("id", F.col("id").cast("bigint"))

    def directed(batches):
        for b in batches:
            own = _direction(_matrix(b.column(1), dim)) if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], names=["id", "vec", "k1", "k2", "d"])

    rows = staged(rows.mapInArrow(directed, "id bigint, vec array<float>, k1 bigint, k2 bigint, d bigint"), "vectors")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))).filter(F.col("n") <= k + 1)  # pruned before the shuffle
    own = first.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("id")).alias("members"), F.min("id").alias("cid"))  # k + 1 ids at most
    heads = own.join(first.filter("n = 1").select("k1", "k2", "vec", "d"), ["k1", "k2"])
    heads = everyone = staged(heads, "vector-heads")
    crowds = staged(heads.groupBy("d").agg(F.count("*").alias("size")).filter(F.col("size") > max(CROWD, k)), "crowded-directions")
    crowded = crowds.count() > 0
    if crowded:
        inside = heads.join(crowds.select("d"), "d").select("d", "cid", "members")
        inside = inside.withColumn("n", F.row_number().over(Window.partitionBy("d").orderBy("cid"))).filter(F.col("n") <= k + 1)  # pruned before the shuffle
        fronts = staged(inside, "crowd-fronts")
        heads = staged(heads.join(crowds.select("d"), "d", "left_anti").unionByName(heads.join(fronts.select("cid"), "cid", "left_semi")), "vector-entries")
    n = heads.count()
    empty = spark.createDataFrame([], "id bigint, neighbour bigint, cosine double, place int")
    if not n:
        return empty
    p = pivot_count(n)
    sample = heads.select("vec", F.xxhash64(F.lit(3), "cid").alias("h"), "cid").orderBy("h", "cid").limit(p).toArrow()  # MAX_PIVOTS rows at most
    pivots = _unit(_matrix(sample.column("vec").combine_chunks(), dim)).astype(np.float32)
    length, posted, visited = min(ORDER, p), min(posted, p), min(visited or visit_count(n), p, ORDER)

    def orders(batches):
        for b in batches:
            if len(b):
                o = _order(_unit(_matrix(b.column(1), dim)), pivots, length)
                offsets = pa.array(np.arange(0, o.size + 1, length, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(o.ravel().view(np.int16)))], names=["cid", "vec", "pivots"])

    index = staged(heads.select("cid", "vec").mapInArrow(orders, "cid bigint, vec array<float>, pivots array<smallint>"), "pivot-orders")
    sizes = index.select(F.explode(F.slice("pivots", 1, posted)).alias("file")).groupBy("file").count().toArrow()  # a row for each pivot
    blocks = np.ones(p, np.int32)
    blocks[sizes.column("file").to_numpy().view(np.uint16)] = -(-sizes.column("count").to_numpy() // BLOCK)

    def routed(batches):
        """A row for each file and pair of blocks in which the vector is a query (1), a posting (2) or both (3)."""
        for b in batches:
            o = b.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, length) if len(b) else np.zeros((0, length), np.uint16)
            ids = b.column(0).to_numpy()
            mix = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            at, file, qb, xb, role = [], [], [], [], []
            for place in range(max(posted, visited)):
                f = o[:, place]
                count = blocks[f]
                mine = (mix % count.astype(np.uint64)).astype(np.int32)
                for c in np.unique(count).tolist():
                    sel = np.flatnonzero(count == c)
                    for other in range(c):
                        if place < visited:
                            same = (mine[sel] == other) & (place < posted)
                            at.append(sel), file.append(f[sel]), qb.append(mine[sel]), xb.append(np.full(len(sel), other)), role.append(np.where(same, 3, 1))
                        if place < posted:
                            only = sel[(mine[sel] != other) | (place >= visited)]
                            at.append(only), file.append(f[only]), qb.append(np.full(len(only), other)), xb.append(mine[only]), role.append(np.full(len(only), 2))
            if not at:
                continue
            at = np.concatenate(at)
            cols = [pa.array(np.concatenate(c).astype(t)) for c, t in ((file, np.int32), (qb, np.int32), (xb, np.int32), (role, np.int8))]
            for s in range(0, len(at), 10_000):
                part = pa.array(at[s : s + 10_000])
                yield pa.RecordBatch.from_arrays([*(c.slice(s, 10_000) for c in cols), b.column(0).take(part), b.column(1).take(part), b.column(2).take(part)], names=["file", "qb", "xb", "role", "cid", "vec", "pivots"])

    def search(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        role, ids = t.column("role").to_numpy(), t.column("cid").to_numpy()
        units = _unit(_matrix(t.column("vec").combine_chunks(), dim))
        o = t.column("pivots").combine_chunks().flatten().to_numpy().view(np.uint16).reshape(-1, length)
        is_q, is_x = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(is_x) and len(is_q):
            parts = []
            for sel in np.array_split(is_q, math.ceil(len(is_q) / 512)):
                r, c, s = _nearest(units[sel], units[is_x], ids[sel], ids[is_x], _closeness(o[sel], o[is_x]), k, reranked)
                parts.append((ids[sel][r], ids[is_x][c], s))
            out = [np.concatenate(x) for x in zip(*parts)]
        return pa.table({"cid": out[0], "other": out[1], "cosine": out[2]})

    met = index.mapInArrow(routed, "file int, qb int, xb int, role tinyint, cid bigint, vec array<float>, pivots array<smallint>")
    hits = met.groupBy("file", "qb", "xb").applyInArrow(search, "cid bigint, other bigint, cosine double").dropDuplicates(["cid", "other"])
    if crowded:
        hits = staged(hits, "vector-hits")
    first_k = Window.partitionBy("cid").orderBy(F.desc("cosine"), "other")
    best = hits.withColumn("n", F.row_number().over(first_k)).filter(F.col("n") <= k)
    if crowded:
        # Queries from outside a crowd that one of its fronts comes near: they meet all of it, in blocks.
        limit = best.filter(F.col("n") == k).select("cid", F.col("cosine").alias("kth"))
        met = hits.join(fronts.select(F.col("cid").alias("other"), "d"), "other").join(limit, "cid", "left").filter(F.col("cosine") >= F.coalesce("kth", F.lit(-2.0)) - REACH)
        asking = met.select("cid", "d").distinct().join(fronts.select("cid", "d"), ["cid", "d"], "left_anti").join(heads.select("cid", "vec"), "cid").join(crowds, "d")
        count = F.ceil(F.col("size") / BLOCK).cast("int")
        asking = asking.select("d", F.explode(F.sequence(F.lit(0), count - 1)).alias("block"), F.lit(1).alias("role"), "cid", "vec")
        asked = everyone.join(crowds, "d").join(asking.select("d").distinct(), "d", "left_semi")
        asked = asked.select("d", F.pmod(F.xxhash64("cid"), count).cast("int").alias("block"), F.lit(2).alias("role"), "cid", "vec")

        def meet(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            role, ids = t.column("role").to_numpy(), t.column("cid").to_numpy()
            units = _unit(_matrix(t.column("vec").combine_chunks(), dim))
            is_q, is_x = np.flatnonzero(role == 1), np.flatnonzero(role == 2)
            parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for sel in np.array_split(is_q, math.ceil(len(is_q) / 512)) if len(is_q) and len(is_x) else []:
                r, c, s = _nearest(units[sel], units[is_x], ids[sel], ids[is_x], np.zeros((len(sel), len(is_x)), np.int16), k, 1.0)
                parts.append((ids[sel][r], ids[is_x][c], s))
            out = [np.concatenate(x) for x in zip(*parts)]
            return pa.table({"cid": out[0], "other": out[1], "cosine": out[2]})

        more = asking.unionByName(asked).groupBy("d", "block").applyInArrow(meet, "cid bigint, other bigint, cosine double")
        best = hits.unionByName(more).dropDuplicates(["cid", "other"]).withColumn("n", F.row_number().over(first_k)).filter(F.col("n") <= k)
        best = staged(best, "vector-best")
    named = best.join(own.select(F.col("cid").alias("other"), "members"), "other")
    near = named.groupBy("cid").agg(F.flatten(F.collect_list(F.transform("members", lambda m: F.struct((-F.col("cosine")).alias("far"), m.alias("id"))))).alias("near"))  # k classes of k + 1 ids
    classes = own.join(near, "cid", "left").select("k1", "k2", "members", "near")

    def listing(members, near):
        mates = F.transform(F.filter(members, lambda m: m != F.col("id")), lambda m: F.struct(F.lit(-1.0).alias("far"), m.alias("id")))
        rest = F.filter(F.coalesce(near, F.array().cast("array<struct<far:double,id:bigint>>")), lambda m: m["id"] != F.col("id"))
        return F.slice(F.array_sort(F.array_distinct(F.concat(mates, rest))), 1, k).alias("near")

    alone = rows.join(crowds.select("d"), "d", "left_anti") if crowded else rows
    listed = alone.select("id", "k1", "k2").join(classes, ["k1", "k2"]).select("id", listing(F.col("members"), F.col("near")))
    if crowded:
        # All of a crowd have its smallest ids at a cosine of 1, and those that its first vector finds so elsewhere.
        held = fronts.groupBy("d").agg(F.flatten(F.collect_list("members")).alias("members"), F.min("cid").alias("cid"))  # k + 1 classes of k + 1 ids
        held = held.join(near, "cid", "left").select("d", "members", F.filter("near", lambda m: m["far"] == -1).alias("near"))
        listed = listed.unionByName(rows.select("id", "d").join(held, "d").select("id", listing(F.col("members"), F.col("near"))))
    return listed.select("id", F.posexplode("near").alias("pos", "x")).select("id", F.col("x.id").alias("neighbour"), (-F.col("x.far")).alias("cosine"), (F.col("pos") + 1).alias("place"))


def pairs(neighbours: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of which one is among the other's nearest."""
    return neighbours.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
