"""Cutting contents above a size limit at natural boundaries, with overlap.

One regular expression tiles a content: its alternatives are ordered by the strength of the boundary, each takes as much as it can up
to the limit (bounded quantifiers), and the last one takes characters. The tiles are the cores of the pieces; the overlap is looked
back for in the two cores before. All of it is SQL on strings and arrays within the row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.prefix import running_sum
from tessera.session import staged

BLANKS = " \t\r\n"
TRAILING = r"[ \t\r\n]++\z"
_RESULTS = ("over", "forced", "pieces", "__tiles", "__at")  # columns of these names are replaced
PART = 512  # numbers that are summed up at a time
DOC_PIECE = "struct<content:string,back:int,forced:boolean>"
CODE_PIECE = "struct<content:string,start_line:int,end_line:int,back:int,forced:boolean>"


def doc_pattern(limit: int, overlap: int) -> str:
    """Tiles of a document: rest of the text, before a heading, after a paragraph, a line, a blank; a whole long word; characters."""
    core, least = limit - overlap, max(1, (limit - overlap) // 4)
    ends = (r"(?<=\n)(?=#{1,6}[ \t])", r"(?<=\n\n|\n\r\n)(?![\r\n])", r"(?<=\n|\r)(?<!\r(?=\n))", r"(?<=[ \t\r\n])")
    some, any_ = rf"[\s\S]{{{least},{core}}}", rf"[\s\S]{{1,{core}}}"
    parts = [rf"{any_}\z", *(some + e for e in ends), any_ + ends[-1], rf"[^ \t\r\n]{{1,{limit}}}(?=[ \t\r\n]|\z)", any_]
    return "|".join(parts)


def code_pattern(limit: int, reserve: int) -> str:
    """Tiles of code, whose size is counted in characters that are not blank: rest, after blank lines, a line, a blank; characters.

    Characters are counted in eights, so that the expression's stack stays flat whatever the limit.
    """
    one = r"[ \t\r\n]*+[^ \t\r\n]"

    def upto(n: int, least: int = 0) -> str:
        return rf"(?:(?:{one}){{8}}+){{{least // 8},{(n - 1) // 8}}}(?:{one}){{1,{(n - 1) % 8 + 1}}}"

    core, line = limit - reserve, r"[ \t\r]*+\n"
    core, limit = core // 8 * 8, limit // 8 * 8
    return "|".join([
        rf"{upto(core)}[ \t\r\n]*+\z",
        rf"{upto(core, core // 3)}{line}(?:{line})++",
        rf"{upto(core)}{line}(?:{line})*+",
        rf"{upto(limit)}(?:{line}(?:{line})*+|[ \t\r]*+\z)",
        rf"{upto(core)}[ \t]++",
        upto(core),
        r"[ \t\r\n]+",
    ])


def _tiles(content: Column, pattern: str) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(0))


def _once(df: DataFrame, value: Column, name: str = "__tiles") -> DataFrame:
    """`df` with `value`, behind a generator, so that later expressions don't each compute it again."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _previous(tiles: Column, i: Column) -> Column:
    """The two tiles before tile `i`, which counts from 0."""
    return F.concat(F.when(i > 1, F.get(tiles, i - 2)).otherwise(""), F.when(i > 0, F.get(tiles, i - 1)).otherwise(""))


def _sums_before(values: Column) -> Column:
    """The sum of the numbers before each number, in time that grows with the array: sums within parts of `PART`, shifted by the sums of the parts."""

    def sums(xs: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("before"), F.lit(0).alias("total"))
        return F.aggregate(xs, start, lambda s, x: F.struct(F.concat(s["before"], F.array(s["total"])).alias("before"), (s["total"] + x).alias("total")))

    last = F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / PART).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda j: sums(F.slice(values, j * PART + 1, PART)))
    return _let(parts, lambda own: _let(sums(F.transform(own, lambda p: p["total"]))["before"], lambda shift: F.flatten(F.zip_with(own, shift, lambda p, s: F.transform(p["before"], lambda b: b + s)))))


def split_docs(docs: DataFrame, limit: int = 1000, overlap: int = 100, content_col: str = "content") -> DataFrame:
    """`docs` with `over` (content above the limit), `forced` (a cut within a word was needed) and `pieces`, an array of (content, back, forced).

    Sizes are code points. A content within the limit is its own only piece; a missing one has none, nor has a blank one. No piece is
    longer than the limit; each but the first starts with the last `overlap` characters before it, except a word of more than
    limit - overlap characters, which is a piece by itself. Pieces without their overlap give the content again, but for pieces of blanks,
    which are dropped. `back` is the length of a piece's overlap. A piece is forced if it begins within a word. Other columns stay as they are,
    those named as results are replaced.
    """
    content, docs = F.col(content_col), docs.drop(*_RESULTS)
    over = F.coalesce(F.length(content) > limit, F.lit(False))
    out = _once(docs.withColumn("over", over), F.when(F.col("over"), _tiles(content, doc_pattern(limit, overlap))))
    none = F.array().cast(f"array<{DOC_PIECE}>")
    whole = F.when(F.translate(content, BLANKS, "") != "", F.array(F.struct(content.alias("content"), F.lit(0).alias("back"), F.lit(False).alias("forced"))))
    out = _once(out, F.coalesce(F.when(F.col("over"), _doc_pieces(F.col("__tiles"), limit, overlap)).otherwise(whole), none), "pieces")
    return out.withColumn("forced", F.exists("pieces", lambda p: p["forced"])).drop("__tiles")


def _doc_pieces(tiles: Column, limit: int, overlap: int) -> Column:
    def piece(core: Column, i: Column) -> Column:
        before = _previous(tiles, i)
        back = F.when(F.length(core) > limit - overlap, F.lit("")).otherwise(F.right(before, F.lit(overlap)))
        inside = (i > 0) & ~before.rlike(r"[ \t\r\n]\z") & ~core.rlike(r"\A[ \t\r\n]")
        return F.struct(F.concat(back, core).alias("content"), F.length(back).alias("back"), inside.alias("forced"))

    kept = F.filter(F.transform(tiles, lambda c, i: F.struct(c.alias("core"), i.alias("i"))), lambda x: F.translate(x["core"], BLANKS, "") != "")
    return F.transform(kept, lambda x: piece(x["core"], x["i"]))


def split_code(chunks: DataFrame, limit: int = 1200, reserve: int = 200, overlap_lines: int = 2, content_col: str = "content", start_col: str = "start_line") -> DataFrame:
    """`chunks` with `over`, `forced` (a cut within a line was needed) and `pieces`, an array of (content, start_line, end_line, back, forced), `back` the length of the overlap.

    Sizes are characters that are not space, tab or line break. A piece ends at blank lines or a line end where there is one within
    limit - reserve, or else within the limit, else at a blank, else anywhere. It starts with the `overlap_lines` lines before it, or fewer, as they fit; a
    piece that starts within a line has no overlap. Lines are counted from `start_col` (missing: the piece's lines are missing). A
    content within the limit is one piece without its trailing line breaks; a missing or blank one has none. A piece is forced if it begins within
    a line. The work grows with the content: a file of megabytes in one row is cut in seconds.
    """
    content, chunks = F.col(content_col), chunks.drop(*_RESULTS)
    over = F.coalesce(F.length(F.translate(content, BLANKS, "")) > limit, F.lit(False))
    out = _once(chunks.withColumn("over", over), F.when(F.col("over"), _tiles(content, code_pattern(limit, reserve))))
    out = _once(out, _sums_before(F.transform("__tiles", _breaks)), "__at")
    trimmed = F.regexp_replace(content, TRAILING, "")
    whole = F.when(F.translate(content, BLANKS, "") != "", F.array(_piece(trimmed, F.col(start_col), F.lit(0), F.lit(False))))
    made = F.when(F.col("over"), _code_pieces(F.col("__tiles"), F.col("__at"), F.col(start_col), limit, overlap_lines)).otherwise(whole)
    out = _once(out, F.coalesce(made, F.array().cast(f"array<{CODE_PIECE}>")), "pieces")
    return out.withColumn("forced", F.exists("pieces", lambda p: p["forced"])).drop("__tiles", "__at")


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "\n", ""))


def _piece(content: Column, first: Column, back: Column, forced: Column) -> Column:
    return F.struct(content.alias("content"), first.cast("int").alias("start_line"), (first + _breaks(content)).cast("int").alias("end_line"), back.alias("back"), forced.alias("forced"))


def _code_pieces(tiles: Column, at: Column, start: Column, limit: int, overlap_lines: int) -> Column:
    both = F.transform(tiles, lambda c, i: F.struct(c.alias("core"), F.get(at, i).alias("at"), i.alias("i")))
    kept = F.filter(both, lambda x: F.translate(x["core"], BLANKS, "") != "")

    def solid(t: Column) -> Column:
        return F.length(F.translate(t, BLANKS, ""))

    def fitting(prev: Column, core: Column) -> Column:
        room = F.lit(limit) - solid(core)
        backs = F.array(*[F.regexp_extract(prev, rf"(?:\A|\n)((?:[^\n]*\n){{{k}}})\z", 1) for k in range(overlap_lines, 0, -1)], F.lit(""))
        return F.filter(backs, lambda b: solid(b) <= room)

    def piece(x: Column) -> Column:
        def cut(prev: Column) -> Column:
            back = F.try_element_at(F.filter(fitting(prev, x["core"]), lambda b: b != ""), F.lit(1))
            inside = (x["i"] > 0) & ~prev.rlike(r"\n\z")
            return _let(F.coalesce(back, F.lit("")), lambda b: _let(F.regexp_replace(F.concat(b, x["core"]), TRAILING, ""), lambda c: _piece(c, start + x["at"] - _breaks(b), F.length(b), inside)))

        return _let(_previous(tiles, x["i"]), cut)

    return F.transform(kept, piece)


def doc_pieces(docs: DataFrame, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """Pieces of doc_chunks as rows (doc_chunk_id, file_path, title, source, chunk_index, content), chunk_index anew and gapless in each
    document in the order of the old one (missing ones first, then by doc_chunk_id). Rows are numbered by running sums, so a document
    of any size is spread over tasks."""
    own = docs.select("doc_chunk_id", "file_path", "title", "source", "chunk_index", "content", F.monotonically_increasing_id().alias("__row"))
    made = staged(split_docs(own, limit, overlap).drop("content"), "doc-pieces")  # the row numbers and the pieces of one reading
    sizes = made.select("file_path", "chunk_index", "doc_chunk_id", "__row", F.size("pieces").cast("bigint").alias("n"))
    ends = running_sum(sizes, "file_path", ["chunk_index", "doc_chunk_id", "__row"], "n").select("__row", "n", "upto")
    rows = made.join(ends, "__row").select("doc_chunk_id", "file_path", "title", "source", (F.col("upto") - F.col("n")).alias("first"), F.posexplode("pieces").alias("pos", "piece"))
    return rows.select("doc_chunk_id", "file_path", "title", "source", (F.col("first") + F.col("pos")).cast("int").alias("chunk_index"), F.col("piece.content").alias("content"))


def code_pieces(chunks: DataFrame, limit: int = 1200) -> DataFrame:
    """Pieces of code_chunks as rows (chunk_id, file_path, language, node_type, piece_no, start_line, end_line, content)."""
    made = split_code(chunks.select("chunk_id", "file_path", "language", "node_type", "start_line", "content"), limit)
    rows = made.select("chunk_id", "file_path", "language", "node_type", F.posexplode("pieces").alias("piece_no", "p"))
    return rows.select("chunk_id", "file_path", "language", "node_type", "piece_no", "p.start_line", "p.end_line", "p.content")


def joined(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (tab, rec_id, solid, within): the pieces of each content, without their overlaps, put together again, of which blanks are left out, and whether none is above a limit."""

    def solid(pieces: str) -> Column:
        return F.translate(F.array_join(F.transform(pieces, lambda p: F.substring(p["content"], p["back"] + 1, F.length(p["content"]))), ""), BLANKS, "").alias("solid")

    def rows(df: DataFrame, tab: str, name: str, size, limit: int) -> DataFrame:
        within = F.forall("pieces", lambda p: size(p["content"]) <= limit).alias("within")
        return df.select(F.lit(tab).alias("tab"), F.col(name).alias("rec_id"), solid("pieces"), within)

    d = rows(split_docs(docs), "doc_chunks", "doc_chunk_id", F.length, 1000)
    return d.unionByName(rows(split_code(chunks), "code_chunks", "chunk_id", lambda c: F.length(F.translate(c, BLANKS, "")), 1200))


def found(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows (tab, rec_id, cut) of contents that were cut: 'forced' if a piece begins where there is no boundary, else 'natural'."""
    cut = F.when(F.col("forced"), "forced").otherwise("natural").alias("cut")
    d = split_docs(docs).filter("over").select(F.lit("doc_chunks").alias("tab"), F.col("doc_chunk_id").alias("rec_id"), cut)
    c = split_code(chunks).filter("over").select(F.lit("code_chunks").alias("tab"), F.col("chunk_id").alias("rec_id"), cut)
    return d.unionByName(c)
