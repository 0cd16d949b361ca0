"""Encoding against the tokenizer library itself, decoding as an exact round trip."""

import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ashlar.llm import encoding
from ashlar.llm.vocabulary import BYTE_BPE_50K, split

SCHEMA = "doc_id long, text string, row string, words string, ids string, rare string, place int, n long, word string"
NASTY = [
    None, "", " ", "  ", "\n", " \n\t x", "a  b", "<|endoftext|>", "x<|endoftext|>y", "don't we'll 'S ''s", "naïve café", "日本語の注釈", "👩‍💻🚧", "A​B", "é", "3²½ⅷ٣", " 　x y\u0085z",
    "ࡰࡱ new letters \U00010d40\U00010d41", "\x00\x1c\x1f", "🇩🇪" * 50, "a" * 200_000, " " * 5_000 + "x", ("word " * 3 + "\r\n") * 20_000, "�", "\U000f0000",
]


def truth(texts):
    t = Tokenizer.from_file(BYTE_BPE_50K)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def documents(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "r", "w", "i", "x", 1, 2, "v") for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def test_whole_table_equals_library(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], truth([r["text"] for r in rows])))
    got = {r["doc_id"]: r["ids"] for r in encoding.encode(docs).collect()}
    assert got == want
    back = {r["doc_id"]: r["text"] for r in encoding.decode(encoding.encode(docs)).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.mark.parametrize("hot", [1, 4, 65_536])
def test_nasty_texts(spark, hot):
    """Whichever words are hot, none or all, the ids are the same."""
    docs = documents(spark, NASTY).repartition(3)
    got = {r["doc_id"]: r["ids"] for r in encoding.encode(docs, hot_words=hot).collect()}
    assert got == dict(enumerate(truth(NASTY)))


def test_random_code_points(spark):
    rng = random.Random(2)
    texts = ["".join(chr(rng.choice([rng.randrange(0x20, 0x2FF), rng.randrange(0x300, 0xD7FF), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(60)) for _ in range(300)]
    got = {r["doc_id"]: r["ids"] for r in encoding.encode(documents(spark, texts)).collect()}
    assert got == dict(enumerate(truth(texts)))


def test_repeated_rows_and_null_ids(spark):
    docs = documents(spark, ["same text", "same text", "same text", None], [7, 7, None, 7])
    rows = encoding.encode(docs).collect()
    assert len(rows) == 4 and len({r["row"] for r in rows}) == 4
    assert sorted(len(r["ids"]) for r in rows) == [0, 2, 2, 2]


def test_empty_table(spark):
    docs = documents(spark, [])
    assert encoding.encode(docs).isEmpty() and encoding.decode(encoding.encode(docs)).isEmpty()


def test_round_trip_of_nasty_texts(spark):
    docs = documents(spark, NASTY)
    back = {r["doc_id"]: r["text"] for r in encoding.decode(encoding.encode(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(NASTY)}


def test_each_word_is_encoded_once(spark):
    docs = documents(spark, ["a b a b", "b a", None])
    table = encoding.word_table(encoding.words_of(docs))
    rows = {r["word"]: r["n"] for r in table.collect()}
    assert rows == {"a": 1, " b": 2, " a": 2, "b": 1}
    assert table.filter(F.size("ids") == 0).isEmpty()


def test_python_split_is_the_tokenizers():
    assert split("it's  two\n\nwords") == ["it", "'s", " ", " two", "\n", "\n", "words"]
