"""Long exact spans that documents share.

Every span of `LEAST` characters holds one of the anchors of its text: places whose hash of `GRAM` characters is the smallest in a window, or
lies in a stretch that repeats itself with a period of at most half a gram. In such stretches all anchors but the first and the last of a row are
left out; the stretches themselves are compared by their smallest gram, period and phase, without their text. Anchors
that occur in one document only can't be in a shared span and are dropped; around the others, the text that a span through
the anchor can reach - a passage of at most 2 * LEAST - GRAM characters - goes to a shard chosen by the anchor's hash. Passages of equal text are one entry
that stands for all its documents. Each shard builds an FM-index of its passages, one for each direction, and the passages are streamed
through both: from the anchor back and forth, backward search gives the maximal stretches that stand in another document as well. The union of
the intervals of a document are its shared spans. The passages of a frequent anchor are told apart by more of their text around it before they go to shards,
so that no shard is all pairs of a boilerplate's copies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.fmindex import FMIndex
from tessera.session import staged

LEAST = 200
GRAM = 64  # a power of two
SHARD = 1024  # passages of a shard
BLOCK = 1 << 18  # characters that are hashed at a time
PARTS = 8  # ranges of places of a frequent anchor within a span, each with a text of its own that all spans of the range share


def _blocks(column: pa.Array, least: int):
    """Texts by about BLOCK characters, as (row, begin in the text, part). A longer text comes in parts that overlap, so that every span of `least` is within one."""
    rows, begins, parts, size = [], [], [], 0
    for i, text in enumerate(column.to_pylist()):
        for begin in range(0, max(1, len(text) - 2 * least), BLOCK):
            part = text[begin : begin + BLOCK + 2 * least]
            rows.append(i), begins.append(begin), parts.append(part)
            size += len(part)
            if size >= BLOCK:
                yield np.array(rows), np.array(begins), parts
                rows, begins, parts, size = [], [], [], 0
    if parts:
        yield np.array(rows), np.array(begins), parts


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and where each text begins; the last number is their end."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def _hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` codes from each place on, by doubling."""
    with np.errstate(over="ignore"):
        h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        m, power = 1, np.uint64(0xD6E8FEB86659FD93)
        while m < gram:
            longer = h * power
            longer[:-m] += h[m:]
            h, power, m = longer, power * power, m * 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(33))


def anchors(codes: np.ndarray, starts: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[tuple[np.ndarray, ...], list[tuple[int, int, int, int, int, int]]]:
    """Anchors of texts as (text, place in it, hash), and stretches of `least` or more with a short period as (text, start, end, period, hash and place of an anchor).

    Any `least` characters of a text that are not within one of these stretches hold the gram of an anchor, at the same place wherever they stand.
    """
    window = 1 << int(math.log2(least - gram + 1))  # places in a window
    n = len(codes)
    if n < gram:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)), []
    h = _hashes(codes, gram)
    sizes = np.diff(starts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(n) - starts[text]
    inside = place + gram <= sizes[text]
    h[~inside] = np.uint64(2**64 - 1)
    low, m = h.copy(), 1
    while m < window:
        low[:-m] = np.minimum(low[:-m], low[m:])
        m *= 2
    high, m = low, 1
    while m < window:
        longer = high.copy()
        longer[m:] = np.maximum(high[m:], high[:-m])
        high, m = longer, m * 2
    at = np.flatnonzero((high == h) & inside & (sizes[text] >= least))
    # Equal grams at a short distance make the text between repeat itself. A gram that recurs within half its length tells its period's phase.
    step = np.diff(at)
    row = (h[at[1:]] == h[at[:-1]]) & (text[at[1:]] == text[at[:-1]]) & (step <= gram // 2)
    within = np.zeros(len(at), bool)
    within[1:-1] = row[1:] & row[:-1] & (step[1:] == step[:-1])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], within, [0]])))
    stretches = []
    for i, j in zip(edges[::2].tolist(), edges[1::2].tolist()):
        t, d = int(text[at[i]]), int(step[i])
        a, b = _extended(codes, int(at[i - 1]), int(at[j]) + gram, d, int(starts[t]), int(starts[t + 1]))
        if b - a >= least:
            stretches.append((t, a - int(starts[t]), b - int(starts[t]), d, int(h[at[i]]), int(place[at[i]])))
    at = at[~within]
    return (text[at], place[at], h[at]), stretches


def _extended(codes: np.ndarray, a: int, b: int, d: int, first: int, last: int) -> tuple[int, int]:
    """The longest stretch around [a, b) within [first, last) in which each code equals the one `d` further on."""
    while a > first:
        k = min(64, a - first)
        other = np.flatnonzero(codes[a - k : a] != codes[a - k + d : a + d])
        a = a - k if not len(other) else a - k + int(other[-1]) + 1
        if len(other):
            break
    while b < last:
        k = min(64, last - b)
        other = np.flatnonzero(codes[b : b + k] != codes[b - d : b + k - d])
        b = b + k if not len(other) else b + int(other[0])
        if len(other):
            break
    return a, b


def phases(start: int, end: int, period: int, place: int, least: int) -> list[tuple[int, int, int]]:
    """For each phase, counted from the anchor at `place`, that a span of `least` within the stretch may begin in: (phase, begin of the first such span, end of the last)."""
    out = []
    for s in range(start, min(start + period, end - least + 1)):
        out.append(((s - place) % period, s, s + (end - least - s) // period * period + least))
    return out


def search(passages: list[str], anchor: np.ndarray, owner: np.ndarray, indexed: np.ndarray, streamed: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches (passage, start, end) of at least `least` characters through the anchor of each streamed passage that stand in an
    indexed passage of another owner."""
    sizes = np.array([len(p) for p in passages], np.int64)
    raw = np.frombuffer("".join(p + "\0" for p in passages).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    ends = starts + sizes
    closing = np.zeros(len(raw), bool)
    closing[ends] = True
    alphabet, codes = np.unique(np.where(closing, 0, raw.astype(np.int64) + 1), return_inverse=True)
    codes = codes.astype(np.int32)
    which = np.repeat(np.arange(len(sizes)), sizes + 1)
    # The same texts, each reversed in its own place.
    mirror = starts[which] + np.where(closing, sizes[which], sizes[which] - 1 - (np.arange(len(raw)) - starts[which]))
    back_codes = codes[mirror]
    pick = np.isin(which, np.flatnonzero(indexed))
    longest = int(sizes.max()) + 1
    left, right = FMIndex(codes[pick], owner[which[pick]], longest), FMIndex(back_codes[pick], owner[which[pick]], longest)
    rows = np.flatnonzero(streamed)
    begin, end = starts[rows], ends[rows]
    mark = begin + anchor[rows]

    def back(k: np.ndarray, upto: np.ndarray) -> np.ndarray:
        return left.extend(codes, upto, begin[k], owner[rows[k]])

    def forth(k: np.ndarray, since: np.ndarray) -> np.ndarray:
        """The end of the longest stretch from `since` on: backward search in the mirrored texts."""
        far = right.extend(back_codes, begin[k] + (end[k] - since), begin[k], owner[rows[k]])
        return end[k] - (far - begin[k])

    found = [(np.zeros(0, np.int64),) * 3]
    k = np.arange(len(rows))
    lo = back(k, mark + gram)
    while len(k):
        keep = (lo <= mark[k]) & (end[k] - lo >= least)
        k, lo = k[keep], lo[keep]
        if not len(k):
            break
        hi = forth(k, lo)
        long = hi - lo >= least
        found.append((rows[k[long]], (lo - begin[k])[long], (hi - begin[k])[long]))
        more = hi < end[k]
        k, hi = k[more], hi[more]
        lo = back(k, hi + 1)
    return tuple(np.concatenate(x) for x in zip(*found))


def shared_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """Rows (id, start, length), one for each maximal run of characters that lie in a stretch of `least` or more that stands in another document too.

    Counted in code points from 0. Missing and short texts share nothing, nor do rows without id; rows of one id are one document, whose repeats
    within itself don't count. Texts of any length are taken whole. Other columns don't matter.
    """
    id_type = documents.schema[id_col].dataType.simpleString()
    docs = documents.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter(f"doc is not null and length(text) >= {least}")

    def pick(batches):
        """Anchors, without `stop`, and phases of stretches with a period, up to `stop`; their `h` names period, phase and smallest gram."""
        for b in batches:
            for rows, begins, parts in _blocks(b.column(1), least):
                (text, place, h), stretches = anchors(*_codes(parts), least, gram)
                own = [(t, s, e, hash((x, d, phase)) & (2**63 - 1)) for t, begin, end, d, x, p in stretches for phase, s, e in phases(begin, end, d, p, least)]
                t2, s2, e2, h2 = (np.array(c, np.int64) for c in zip(*own)) if own else (np.zeros(0, np.int64),) * 4
                both = np.concatenate([text, t2])
                stop = pa.concat_arrays([pa.nulls(len(text), pa.int32()), pa.array((e2 + begins[t2]).astype(np.int32))])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h.view(np.int64), h2])), b.column(0).take(pa.array(rows[both])), pa.array((np.concatenate([place, s2]) + begins[both]).astype(np.int32)), stop], names=["h", "doc", "place", "stop"])

    marks = staged(docs.mapInArrow(pick, f"h bigint, doc {id_type}, place int, stop int"), "anchors")

    def of_several(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a <> b").select("h")

    periodic = marks.filter("stop is not null")
    periodic = periodic.join(of_several(periodic), "h").select("doc", F.col("place").cast("bigint").alias("s"), F.col("stop").cast("bigint").alias("e"))
    marks = marks.filter("stop is null").drop("stop")
    common = of_several(marks)
    places = marks.join(common, "h").groupBy("doc").agg(F.collect_set(F.struct("place", "h")).alias("marks"))  # no more than its text has

    def cut(batches):
        def passages(b, cols):
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), b.column(0).take(pa.array(cols[1], pa.int64())), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())], names=["h", "doc", "start", "anchor", "passage"])

        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for i, (text, own) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for m in own:
                    p = m["place"]
                    lo = max(0, p + gram - least)
                    for c, v in zip(cols, (m["h"], i, lo, p - lo, text[lo : p + least])):
                        c.append(v)
                    if len(cols[0]) >= 10_000:
                        yield passages(b, cols)
                        cols = ([], [], [], [], [])
            if cols[0]:
                yield passages(b, cols)

    cuts = docs.join(places, "doc").select("doc", "text", "marks").mapInArrow(cut, f"h bigint, doc {id_type}, start int, anchor int, passage string")
    cuts = staged(cuts.withColumn("k1", F.xxhash64("passage", "anchor")).withColumn("k2", F.xxhash64(F.lit(1), "passage")), "passages")
    entry = ["h", "anchor", "k1", "k2"]
    entries = cuts.groupBy(*entry).agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.first("passage").alias("passage"))
    entries = staged(entries.withColumn("several", F.col("a") != F.col("b")), "entries")
    sizes = entries.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")  # others have no text to be compared with
    frequent = staged(sizes.filter(F.col("n") > shard).select("h"), "frequent-anchors")
    routed = entries.join(sizes.filter(F.col("n") <= shard).select("h"), "h").withColumn("route", F.col("h")).drop("b")
    hits = []
    if frequent.take(1):
        hot = _told_apart(entries.join(frequent, "h"), least, gram)
        groups = hot.groupBy("route").agg(F.count("*").alias("n"), F.min("a").alias("x"), F.max("b").alias("y")).filter("x <> y")
        groups = staged(groups.select("route", "n"), "frequent-texts")
        routed = routed.unionByName(hot.join(groups.filter(F.col("n") <= shard).select("route"), "route").select(*routed.columns))
        hits.append(_equal_spans(hot.join(groups.filter(F.col("n") > shard).select("route"), "route"), entry, least))
    routed = staged(routed, "routed") if hits else routed
    total = routed.count() if hits else sizes.filter(F.col("n") <= shard).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    routed = routed.withColumn("shard", F.pmod("route", F.lit(max(1, math.ceil(total / shard)))))

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        several = t.column("several").to_numpy(zero_copy_only=False)
        owner = np.unique(np.array(t.column("a").to_pylist()), return_inverse=True)[1].astype(np.int64)
        owner = np.where(several, -1 - np.arange(len(owner)), owner)  # an entry of several documents has another one for everybody
        indexed = np.ones(len(owner), bool)
        out = [np.zeros(0, np.int64)] * 3
        if not several.all():
            out = search(t.column("passage").to_pylist(), t.column("anchor").to_numpy(), owner, indexed, ~several, least, gram)
        return t.select(entry).take(pa.array(out[0])).append_column("lo", pa.array(out[1], pa.int64())).append_column("hi", pa.array(out[2], pa.int64()))

    hits.append(routed.groupBy("shard").applyInArrow(run, "h bigint, anchor int, k1 bigint, k2 bigint, lo bigint, hi bigint"))
    whole = entries.filter(f"several and length(passage) >= {least}").select(*entry, F.lit(0).cast("bigint").alias("lo"), F.length("passage").cast("bigint").alias("hi"))
    for more in hits:
        whole = whole.unionByName(more)
    spans = cuts.select(*entry, "doc", "start").join(whole, entry).select("doc", (F.col("start") + F.col("lo")).alias("s"), (F.col("start") + F.col("hi")).alias("e"))
    spans = spans.unionByName(periodic)
    by_doc = Window.partitionBy("doc").orderBy("s", "e")
    reach = F.max("e").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(by_doc))
    runs = islands.groupBy("doc", "island").agg(F.min("s").alias("start"), F.max("e").alias("stop"))
    return runs.select(F.col("doc").alias(id_col), "start", (F.col("stop") - F.col("start")).alias("length"))


def _told_apart(entries: DataFrame, least: int, gram: int) -> DataFrame:
    """A row for each entry and range of places that a span may begin at before the anchor, with `low` and `high`, the range, and `route`, a hash of the anchor, the
    range and the text that all spans of the range hold. Entries share a span only if they share a route."""
    spread = least - gram + 1
    width = math.ceil(spread / PARTS)
    ranges = [(low, min(low + width, spread) - 1) for low in range(0, spread, width)]

    def core(low: int, high: int):
        there = (F.col("anchor") >= low) & (F.length("passage") - F.col("anchor") >= least - high)
        text = F.substring("passage", F.col("anchor") - low + 1, F.lit(least - high + low))
        return F.when(there, F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"), F.xxhash64(F.lit(low), "h", text).alias("route")))

    each = F.filter(F.array(*[core(*r) for r in ranges]), lambda x: x.isNotNull())
    return entries.select("*", F.explode(each).alias("x")).select(*entries.columns, "x.low", "x.high", "x.route")


def _equal_spans(rows: DataFrame, entry: list[str], least: int) -> DataFrame:
    """Spans (entry, lo, hi) of `least` characters that entries of several documents share, for routes that more entries have than a shard holds."""
    at = F.explode(F.sequence(F.greatest(F.col("low"), F.col("anchor") + least - F.length("passage")), F.least(F.col("high"), F.col("anchor"))))
    rows = rows.filter(F.greatest(F.col("low"), F.col("anchor") + least - F.length("passage")) <= F.least(F.col("high"), F.col("anchor")))
    each = rows.select(*entry, "a", "b", "several", "passage", "route", at.alias("back"))
    text = F.substring("passage", F.col("anchor") - F.col("back") + 1, F.lit(least))
    each = each.select(*entry, "a", "b", "several", "back", F.xxhash64("route", "back", text).alias("w1"), F.xxhash64(F.lit(1), text).alias("w2"))
    several = each.groupBy("w1", "w2").agg(F.min("a").alias("x"), F.max("b").alias("y")).filter("x <> y").select("w1", "w2")
    lo = (F.col("anchor") - F.col("back")).cast("bigint")
    return each.filter("not several").join(several, ["w1", "w2"]).select(*entry, lo.alias("lo"), (lo + least).alias("hi"))


def coverage(documents: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_chars, n_spans, shared_chars, share), one for each row of `documents`; a missing or empty text has share 0."""
    sums = spans.groupBy(id_col).agg(F.count("*").alias("n_spans"), F.sum("length").alias("shared_chars"))
    n = F.coalesce(F.length(text_col), F.lit(0)).cast("bigint")
    own = documents.select(id_col, n.alias("n_chars")).join(sums, id_col, "left").fillna(0, ["n_spans", "shared_chars"])
    return own.select(id_col, "n_chars", "n_spans", "shared_chars", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(0.0).alias("share"))
