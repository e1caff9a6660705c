import random
import re

import pytest

from pyspark.sql import functions as F

from tessera.llm import fmindex, mixing, spans, splitting, tokens

np = pytest.importorskip("numpy")


def test_encoding_equals_library_and_round_trips(spark):
    texts = ["Hello world", "", None, "naïve café 日本語 \U0001f600", "<|endoftext|> x", "  \n\t spaces   ", "a" * 5000, "Hello world"]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts)] + [(None, "null id", 1, "z")], "doc_id long, text string, block int, word string")
    got = [(r["doc_id"], list(r["ids"])) for r in tokens.encode_corpus(df, block_chars=40).collect()]
    enc = tokens.encoding(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    assert sorted(got, key=str) == sorted([(i, enc.encode_ordinary(t) if t else []) for i, t in enumerate(texts)] + [(None, enc.encode_ordinary("null id"))], key=str)
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.encode_corpus(df, counts=True).collect()}
    assert all(counts[i] == len(x) for i, x in got)
    both = df.union(df.filter("doc_id = 0"))
    back = sorted(((r["doc_id"], r["text"]) for r in tokens.decode_corpus(tokens.encode_corpus(both)).collect()), key=str)
    assert back == sorted([(i, t or "") for i, t in enumerate(texts)] + [(None, "null id"), (0, "Hello world")], key=str)
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_frequent_words_under_several_keys(spark, monkeypatch):
    texts = [f"the word {i % 7} the the {i}" for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    enc = tokens.encoding(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}")
    monkeypatch.setattr(tokens, "SHARES", 50)
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_corpus(df, block_chars=40).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_mix_meets_shares(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["word"] * rng.randint(20, 60)), "big" if i % 3 else ("small" if i % 2 else None)) for i in range(600)] + [(9000, None, "small"), (9001, "", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("none", 0.1, 2), (None, 0.3, 1)], "source string, weight double, max_repeats int")
    mix, report = mixing.mix(df, targets)
    share = {r["source"]: r["share"] for r in report.collect()}
    assert share["none"] == 0 and abs(share["big"] - 0.5) < 0.01 and abs(share["small"] - 0.5) < 0.01
    used = mix.groupBy("source", "doc_id").count().groupBy("source").agg({"count": "max"}).collect()
    assert all(r[1] <= (1 if r[0] == "big" else 3) for r in used)
    capped = {r["source"]: r for r in mixing.mix(df, targets, total_tokens=10**7)[1].collect()}
    assert capped["small"]["used_tokens"] == 3 * capped["small"]["available_tokens"] and capped["big"]["used_tokens"] == capped["big"]["available_tokens"]
    assert mixing.mix(df.limit(0), targets)[0].count() == 0


def test_mix_depends_on_rows_alone(spark):
    rows = [(i % 90, f"text number {i % 97} " * (1 + i % 7), "ab"[i % 2]) for i in range(300)] + [(5, "same", "a")] * 4
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 1)], "source string, weight double, max_repeats int")
    one, two = (mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n), targets)[0].collect() for n in (2, 7))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and one


def test_doc_splitting(spark):
    rng = random.Random(2)
    words = lambda n: " ".join("x" * rng.randint(1, 12) for _ in range(n))
    texts = ["\n\n".join(f"## H{i}\n{words(60)}" for i in range(9)), words(900), "y" * 2500, "y" * 950 + " " + "z" * 950, " " + "q" * 1000 + " tail", "\n" * 1500, "short", "", None, "é\U0001f600 " * 700, "a\r\n" * 600]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_chunk_id long, content string, i int")
    out = {r["doc_chunk_id"]: r for r in splitting.split_docs(df).collect()}
    for i, t in enumerate(texts):
        over = t is not None and len(t) > 1000
        r = out[i]
        assert r["over"] == over and r["forced"] == bool(over and re.search(r"[^ \t\r\n]{1001}", t)), i
        pieces = [p["content"] for p in r["pieces"]]
        assert all(0 < len(p) <= 1000 and p.strip() for p in pieces)
        if t and t.strip():
            assert "".join("".join(pieces).split()).startswith("".join(t.split())[:50])
            at = 0  # every piece stands in the text, overlapping or meeting the one before
            for p in pieces:
                k = t.rfind(p, 0, at + len(p))
                k = k if k >= 0 and k + len(p) > at else t.find(p, at)
                assert k >= 0 and (k <= at or not t[at:k].strip())
                at = max(at, k + len(p))
            assert not t[at:].strip()


def test_code_splitting(spark):
    line = lambda i: f"    value_{i} = call({i}, other)"
    texts = ["\n".join(line(i) for i in range(200)), "x" * 5000, "\n".join(["a" * 1100, "b" * 1150, "c"]), "one\n\n", None, "\n\n".join(line(i) for i in range(100)), "k = 1 \n" * 700]
    df = spark.createDataFrame([(i, "f.py", "python", "code", 11, t) for i, t in enumerate(texts)], "chunk_id long, file_path string, language string, node_type string, start_line int, content string")
    pieces = splitting.code_pieces(df).collect()
    solid = lambda s: len(re.sub(r"[ \t\r\n]", "", s))
    assert all(0 < solid(p["content"]) <= 1200 for p in pieces)
    forced = {r["chunk_id"] for r in splitting.split_code(df).filter("forced").collect()}
    assert forced == {1}
    for i in (0, 2, 3, 5, 6):
        lines, own, last = texts[i].split("\n"), sorted((p for p in pieces if p["chunk_id"] == i), key=lambda p: p["piece_no"]), 10
        for p in own:
            assert "\n".join(lines[p["start_line"] - 11 : p["end_line"] - 10]).rstrip() == p["content"].rstrip() and p["start_line"] <= last + 1 or not "".join(lines[last - 10 : p["start_line"] - 11]).strip()
            last = p["end_line"]
    assert [(p["start_line"], p["end_line"]) for p in pieces if p["chunk_id"] == 3] == [(11, 11)]
    docs = spark.createDataFrame([(1, "d", "t", "s", 3, "w " * 900), (2, "d", "t", "s", 1, "x"), (3, "d", "t", "s", None, "y"), (4, None, None, None, 0, "z")], "doc_chunk_id long, file_path string, title string, source string, chunk_index int, content string")
    got = sorted((r["chunk_index"], r["doc_chunk_id"]) for r in splitting.doc_pieces(docs).collect() if r["file_path"] == "d")
    assert got == [(0, 3), (1, 2), (2, 1), (3, 1), (4, 1)][: len(got)] and len(got) >= 4


def test_code_of_megabytes_in_one_row(spark):
    """The work grows with the content: four million characters in one row."""
    text = "".join(f"    value_{i} = call({i}, other)\n" for i in range(110_000))
    df = spark.createDataFrame([(1, text, 11)], "chunk_id long, content string, start_line int")
    pieces = splitting.split_code(df).first()["pieces"]
    assert pieces[0]["start_line"] == 11 and pieces[-1]["end_line"] == 110_010 and not any(p["forced"] for p in pieces)
    lines, last = text.split("\n"), 10
    for p in pieces:
        assert p["start_line"] <= last + 1 <= p["end_line"] and lines[p["end_line"] - 11] == p["content"].rsplit("\n", 1)[-1]
        last = p["end_line"]


def test_clashing_names_and_empty_tables(spark):
    from tessera.llm import neardup, secrets

    names = "chunk_id long, content string, start_line int, over string, forced int, pieces int, __tiles int, __at int, n_masked int"
    df = spark.createDataFrame([(1, "a b", 1, "x", 2, 3, 4, 5, 6), (2, None, None, None, None, None, None, None, None), (3, "", 1, "", 0, 0, 0, 0, 0)], names)
    for split in (splitting.split_code, splitting.split_docs):
        got = {r["chunk_id"]: [p["content"] for p in r["pieces"]] for r in split(df).collect()}
        assert got == {1: ["a b"], 2: [], 3: []} and split(df.limit(0)).count() == 0
    assert {r["chunk_id"]: r["n_masked"] for r in secrets.redacted(df).collect()} == {1: 0, 2: 0, 3: 0} and secrets.redacted(df.limit(0)).count() == 0
    assert secrets.places(df.limit(0)).count() == 0
    member, pairs = neardup.near_duplicates(df.limit(0), "chunk_id", ["content", "over"])
    assert neardup.all_pairs(member, pairs).count() == 0 and neardup.groups(member, pairs, df.select(F.col("chunk_id").alias("id"))).count() == 3


def brute(texts, least):
    where = {}
    for i, t in texts.items():
        for p in range(len(t) - least + 1):
            where.setdefault(t[p : p + least], set()).add(i)
    out = set()
    for i, t in texts.items():
        run = None
        for p in range(len(t) - least + 1):
            if len(where[t[p : p + least]]) > 1:
                if run and p <= run[1]:
                    run[1] = p + least
                else:
                    if run:
                        out.add((i, run[0], run[1] - run[0]))
                    run = [p, p + least]
        if run:
            out.add((i, run[0], run[1] - run[0]))
    return out


@pytest.mark.parametrize("shard", [4096, 3])
def test_spans_equal_brute_force(spark, shard):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgh é\U0001f600") for _ in range(n))
    common, licence = text(450), text(260)
    texts = {i: text(rng.randint(0, 700)) + (common[rng.randint(0, 150) : rng.randint(330, 450)] if i % 3 == 0 else "") + (licence if i % 2 else "") + text(rng.randint(0, 300)) for i in range(40)}
    texts[50] = texts[51] = texts[4]
    texts[52] = text(300) * 2  # repeats within one text only
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()] + [(60, None, 0), (61, "", 0), (None, texts[4], 0), (52, texts[52], 0)], "doc_id long, text string, h int")
    got = spans.shared_spans(df, shard=shard)
    assert {tuple(r) for r in got.collect()} == brute(texts, 200)
    cover = {r["doc_id"]: r["share"] for r in spans.coverage(df.filter("doc_id is not null and doc_id <> 52"), got).collect()}
    assert cover[50] == 1.0 and cover[60] == 0.0
    assert spans.shared_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [4096, 4])
def test_spans_of_runs_and_boilerplate(spark, shard):
    """Texts with stretches of short periods, cut at all places, between others; and a frequent passage with other text around it in every copy."""
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    units = ["-", " ", "ab", "+--", "0, ", "=-=-~", text(31), text(32), text(33), text(70)]
    licence, texts = text(240), {}
    for i in range(110):
        parts = []
        for _ in range(rng.randint(1, 4)):
            u = rng.choice(units)
            n = rng.choice([90, 150, 199, 200, 201, 215, 230, 260, 420])
            k = rng.randrange(len(u))
            parts += [(u * (n // len(u) + 3))[k : k + n], text(rng.choice([0, 1, 5, 30]))]
        texts[i] = "".join(parts)
    for i in range(200, 240):
        texts[i] = text(rng.randint(0, 150)) + licence[rng.randint(0, 20) :] + text(rng.randint(0, 150))
    texts[300], texts[301] = "-" * 700, "x" + "-" * 199 + "x"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {tuple(r) for r in spans.shared_spans(df, shard=shard).collect()} == brute(texts, 200)


def test_runs_cost_what_other_text_does():
    for unit in (" ", "-", "ab", "| --- "):
        codes, starts = spans._codes([(unit * 100_000)[:100_000], "abc"])
        kept, stretches = spans.anchors(codes, starts)
        assert len(kept[0]) <= 4 and [(t, s, e, d) for t, s, e, d, _, _ in stretches] == [(0, 0, 100_000, len(unit))]


def test_long_texts_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    big = "".join(rng.choice("abcd") for _ in range(9000))
    monkeypatch.setattr(spans, "BLOCK", 1000)
    df = spark.createDataFrame([(1, big), (2, "x" * 50 + big[2900:3400]), (3, big[7000:])], "doc_id long, text string")
    assert {tuple(r) for r in spans.shared_spans(df).collect()} == brute({1: big, 2: "x" * 50 + big[2900:3400], 3: big[7000:]}, 200)


def test_index_counts():
    rng = np.random.default_rng(1)
    codes = rng.integers(1, 4, 300)
    codes[99::100] = 0
    order = fmindex.suffix_array(codes, 100)
    suffix = lambda i: tuple(codes[i : i + list(codes[i:]).index(0) + 1])
    assert [suffix(i) for i in order] == sorted(suffix(i) for i in range(300))
    bits = fmindex.Bits((codes == 2).astype(np.uint8))
    assert (bits.ones(np.arange(301)) == np.concatenate([[0], np.cumsum(codes == 2)])).all()
