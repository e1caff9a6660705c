"""Encoding a corpus with a public byte-level BPE, each distinct word once.

A text is cut into words (pre-tokens) by the pattern of the vocabulary. Documents travel as blocks of about `BLOCK_CHARS`
characters. In a block a word is a small number, so that a frequent word crosses the shuffle once for a block and not once for an
occurrence, and no word is a hot key: those that nearly all blocks have are looked up under several. The distinct words of all blocks are encoded once each, joined back to the blocks, and put at
their positions. Fewer than `SHARES` frequent words are broadcast, and nothing reaches the driver but their total.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import staged

TOKENIZERS = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pattern that belongs to the vocabulary; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_CHARS = 1_000_000
SHARES = 1000


@functools.lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(2)
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(1)
def words_of():
    import regex

    return regex.compile(PATTERN).findall


_BLOCKS = pa.schema([("block", pa.int64()), ("at", pa.int64()), ("refs", pa.list_(pa.int32())), ("word", pa.string()), ("word_no", pa.int32())])


def _block(key: int, texts: list[str | None]) -> pa.RecordBatch:
    """Rows of one block: a document's row has its place and word numbers; a word's row has the word and its number."""
    number: dict[str, int] = {}
    find, refs, offsets = words_of(), [], [0]
    for text in texts:
        if text:
            refs.extend([number.setdefault(w, len(number)) for w in find(text)])
        offsets.append(len(refs))
    n, m = len(texts), len(number)
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(refs, pa.int32()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + m, key)),
            pa.concat_arrays([pa.array(np.arange(n)), pa.nulls(m, pa.int64())]),
            pa.concat_arrays([lists, pa.nulls(m, lists.type)]),
            pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(number, pa.string())]),
            pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.arange(m, dtype=np.int32))]),
        ],
        schema=_BLOCKS,
    )


def _cuts(lengths: np.ndarray, limit: int) -> list[int]:
    """Ends of runs of rows of at most `limit` characters, or of one row."""
    ends, total = [], 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            ends.append(i)
            total = 0
        total += int(n)
    return [*ends, len(lengths)]


def blocked(df: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents as blocks of word numbers together with the words of each block, staged: both later uses see the same blocks."""
    id_type = df.schema[id_col].dataType

    def run(batches):
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, k, held, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def out():
            nonlocal k
            b = _block(part << 32 | k, held)
            k += 1
            at = pa.concat_arrays([pa.array(ids, id_arrow), pa.nulls(len(b) - len(ids), id_arrow)])
            return pa.RecordBatch.from_arrays([*b.columns, at], names=[*b.schema.names, "doc"])

        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            start = 0
            for end in _cuts(lengths, block_chars):
                n = int(lengths[start:end].sum())
                if held and size + n > block_chars:
                    yield out()
                    held, ids, size = [], [], 0
                held += batch.column(1).slice(start, end - start).to_pylist()
                ids += batch.column(0).slice(start, end - start).to_pylist()
                size += n
                start = end
        if held:
            yield out()

    from pyspark.sql import types as T

    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("at", T.LongType()), T.StructField("refs", T.ArrayType(T.IntegerType())), T.StructField("word", T.StringType()), T.StructField("word_no", T.IntegerType()), T.StructField("doc", id_type)]
    )
    return staged(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema), "blocks")


def encoded_words(words: DataFrame, path: str, counts: bool) -> DataFrame:
    """Each word of a table that has it once, with its ids, or with their number."""

    def run(batches):
        enc = encoding(path)._encode_single_piece
        for batch in batches:
            ids = [enc(w) for w in batch.column(0).to_pylist()]
            col = pa.array([len(x) for x in ids], pa.int32()) if counts else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), col], names=["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids int" if counts else "word string, ids array<int>")


def _looked_up(words: DataFrame, path: str, counts: bool) -> DataFrame:
    """`words` (block, word_no, word) with the ids of each word, which is encoded once. A word that more than one in `SHARES` rows has is looked up under several keys, so
    that none has more than that share of the rows; there are fewer than `SHARES` such words, whatever the corpus."""
    each = staged(words.groupBy("word").agg(F.count("*").alias("n")), "words")
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = each.filter(F.col("n") * SHARES > total).select("word", F.ceil(F.col("n") * SHARES / F.lit(max(total, 1))).cast("int").alias("salts"))

    def with_salts(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(frequent), "word", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))

    left = with_salts(words).withColumn("salt", F.pmod(F.xxhash64("block"), F.col("salts")).cast("int")).drop("salts")
    right = with_salts(encoded_words(each, path, counts)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return left.join(right, ["word", "salt"])


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, folder: str | None = None, counts: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (`id_col`, ids), or with `counts` (`id_col`, n_tokens), one for each row of `df`.

    A missing or empty text gives an empty list (0 tokens). Strings of special tokens are ordinary text. Repeated rows and missing
    ids come out as often as they go in; other columns are left behind, whatever their names. An empty table gives no rows. A text of
    any length is one row and is encoded whole.
    """
    path = os.path.join(folder or TOKENIZERS, vocabulary)
    blocks = blocked(df, id_col, text_col, block_chars)
    id_type = df.schema[id_col].dataType.simpleString()
    words = blocks.filter(F.col("word").isNotNull()).select("block", "word_no", "word")
    known = _looked_up(words, path, counts).select(F.col("block").alias("key"), "word_no", "ids")
    docs = blocks.filter(F.col("at").isNotNull()).select("block", "doc", "refs")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        refs = left.column("refs").combine_chunks()
        numbers = right.column("word_no").to_numpy()
        order = np.argsort(numbers)
        flat = refs.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(np.asarray(refs.value_lengths().fill_null(0)))])
        ids = right.column("ids").combine_chunks()
        if counts:
            size = ids.to_numpy()[order] if len(ids) else np.zeros(0, np.int32)
        else:
            lists = ids.take(pa.array(order))
            size = np.asarray(lists.value_lengths()) if len(ids) else np.zeros(0, np.int32)
        sums = np.concatenate([[0], np.cumsum(size[flat] if len(flat) else np.zeros(0, np.int64))])[ends]
        if counts:
            out = pa.array(np.diff(sums), pa.int64())
        else:
            values = lists.take(pa.array(flat)).flatten() if len(flat) else pa.array([], pa.int32())
            out = pa.ListArray.from_arrays(pa.array(sums, pa.int32()), values)
        return pa.table({"doc": left.column("doc"), "out": out})

    made = docs.groupBy("block").cogroup(known.groupBy("key")).applyInArrow(assemble, f"doc {id_type}, out {'bigint' if counts else 'array<int>'}")
    return made.select(F.col("doc").alias(id_col), F.col("out").alias("n_tokens" if counts else "ids"))


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """Rows (`id_col`, text): the bytes of the tokens side by side, as UTF-8, in which bytes that are none are replaced.

    It joins the table of tokens and their bytes. An empty or missing list gives an empty text. Rows of one id, and rows without, come out one by one.
    """
    spark = df.sparkSession
    rows = [(i, b) for b, i in ranks(os.path.join(folder or TOKENIZERS, vocabulary)).items()]
    tokens = spark.createDataFrame(rows, "token int, bytes binary")  # as many rows as the vocabulary, whatever the corpus
    own = staged(df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), F.col(ids_col).alias("ids")), "ids")
    pieces = own.select("row", F.posexplode("ids").alias("pos", "token")).join(F.broadcast(tokens), "token")
    text = F.make_valid_utf8(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))), lambda x: x["h"]), "")).cast("string"))
    made = pieces.groupBy("row").agg(text.alias("text"))  # no more than the tokens of one row
    return own.select("row", "doc").join(made, "row", "left").select(F.col("doc").alias(id_col), F.coalesce("text", F.lit("")).alias("text"))
