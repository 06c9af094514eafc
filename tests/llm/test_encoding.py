import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stelae.llm import encoding

TEXTS = [
    "", None, " ", "\n\n  \t x", "Hello world, it's 3pm.  Don't  \r\n stop", "<|endoftext|> a", "日本語 テキスト。", "Ça va? É", "a" * 3000,
    "  two   spaces ", "x  \u0085 y　z", "Ᲊ new letter \U0001f600\U0001fae8", "tab\tend ", "don'T 'S 're", "١٢٣ ½ Ⅻ", "﻿bom", "\x00nul\x1f", "word " * 20_000,
]


def reference(texts):
    tokenizer = Tokenizer.from_file(encoding.TOKENIZER)
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def frame(spark, texts):
    return spark.createDataFrame([(n, t, 1, "clash", None) for n, t in enumerate(texts)], "doc_id long, text string, block int, word string, lengths string")


def test_ids_equal_the_tokenizer(spark):
    df = frame(spark, TEXTS).repartition(3)
    for size in (64, 1 << 20):
        got = {r.doc_id: r.ids for r in encoding.encoded(df, "doc_id", "text", block_octets=size).collect()}
        assert [got[n] for n in range(len(TEXTS))] == reference(TEXTS)
    assert got[0] == got[1] == []


def test_more_partitions_than_the_session_has(spark, monkeypatch):
    monkeypatch.setattr(encoding, "PARTITION_OCTETS", 2_000)
    got = {r.doc_id: r.ids for r in encoding.encoded(frame(spark, TEXTS), "doc_id", "text", block_octets=64).collect()}
    assert [got[n] for n in range(len(TEXTS))] == reference(TEXTS)


def test_random_texts_and_counts(spark):
    rng = random.Random(6)
    letters = "abc ÀЖ日  \n\t.,'!-123 　٣¼​😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(300)]
    df = frame(spark, texts).repartition(4)
    got = {r.doc_id: r.ids for r in encoding.encoded(df, "doc_id", "text", block_octets=2000).collect()}
    want = reference(texts)
    assert [got[n] for n in range(len(texts))] == want
    counts = {r.doc_id: r.tokens for r in encoding.token_counts(df, "doc_id", "text", block_octets=2000).collect()}
    assert [counts[n] for n in range(len(texts))] == [len(w) for w in want]


def test_round_trip(spark):
    texts = [t for t in TEXTS if t is not None]
    ids = encoding.encoded(frame(spark, texts), "doc_id", "text")
    back = encoding.decoded(ids, "doc_id")
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts))


def test_repeated_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (3, None)], "doc_id long, text string")
    got = encoding.encoded(df, "doc_id", "text")
    assert sorted(((r.doc_id, len(r.ids)) for r in got.collect()), key=repr) == [(3, 0), (3, 2), (None, 2), (None, 2)]
    assert encoding.encoded(df.limit(0), "doc_id", "text").count() == 0
    assert encoding.token_counts(df.filter("text IS NULL"), "doc_id", "text").first().tokens == 0


def test_every_word_is_encoded_once(spark):
    pairs = spark.createDataFrame([(b, w) for b in range(5) for w in ("a", " b", "c") for _ in range(2)], "block int, word string")
    assert sorted(r.word for r in encoding.word_table(pairs).collect()) == [" b", "a", "c"]


def test_partitions_follow_the_size(spark):
    cores = spark.sparkContext.defaultParallelism
    size = lambda octets: encoding._partitions(spark.range(1), octets, -(-octets // encoding.BLOCK_OCTETS))
    assert size(1) == 1 and size(2 << 30) == 256 and size(20 << 20) == min(5, max(3, cores))
    assert size(100 << 40) == encoding.MOST_PARTITIONS


def test_decoding_joins_pieces(spark):
    """The plan has a join with the table of pieces, and an id without one fails."""
    df = spark.createDataFrame([(1, [0, 1]), (2, [])], "doc_id long, ids array<int>")
    back = encoding.decoded(df, "doc_id", block_octets=4)
    assert "Join" in back._jdf.queryExecution().optimizedPlan().toString()
    assert encoding.decoded(df.limit(0), "doc_id").count() == 0
    with pytest.raises(Exception, match="an id has no piece"):
        encoding.decoded(spark.createDataFrame([(1, [50_999_999])], "doc_id long, ids array<int>"), "doc_id").collect()


def test_java_and_tokenizer_split_alike(spark):
    """Every code point Java knows is of the same class in both."""
    tokenizer = Tokenizer.from_file(encoding.TOKENIZER)
    points = [c for c in range(0x3000 + 1) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in points]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    lengths = {r.n: r.x for r in df.select("n", encoding.word_octets(F.col("t")).alias("x")).collect()}
    for n, text in enumerate(texts):
        spans = tokenizer.pre_tokenizer.pre_tokenize_str(text)
        want = [len(text[a:b].encode()) for _, (a, b) in spans]
        assert lengths[n] is None or lengths[n] == want, hex(points[n])


def test_decoding_odd_lists(spark):
    df = spark.createDataFrame([(1, None), (2, []), (2, [0, 1]), (None, [220, 187])], "doc_id long, ids array<int>")
    got = sorted(((r.doc_id, r.text) for r in encoding.decoded(df, "doc_id").collect()), key=repr)
    assert got == [(1, ""), (2, "!\""), (2, ""), (None, " �")]
