"""Encoding of a corpus by a public tokenizer through a table of distinct words.

Texts are split into words in the JVM, every distinct word is encoded once, and the ids are joined back by position.
Words of at least ``1 / HOT_WORDS`` of all occurrences, which are at most ``HOT_WORDS`` and most of a text, are joined
inside each task from a broadcast table; so no word is frequent in the shuffled join of the others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm import vocabulary as v
from ashlar.runtime import materialize

HOT_WORDS = 65_536


def _split_unknown(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [v.split(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(words, pa.list_(pa.string()))], ["row", "doc_id", "words"])


def words_of(documents: DataFrame) -> DataFrame:
    """row (unique), doc_id and the words of each text; none for empty and null texts."""
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    odd = F.col("text").rlike(v.UNKNOWN)
    usual = rows.filter(~odd).select("row", "doc_id", F.regexp_extract_all("text", F.lit(v.SPLIT), F.lit(0)).alias("words"))
    return usual.unionByName(rows.filter(odd).mapInArrow(_split_unknown, usual.schema))


def _encoder(path: str):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = v.whole_words(path)
        for b in batches:
            words = b.column("word").to_pylist()
            ids = [e.ids for e in t.encode_batch(words, add_special_tokens=False)] if words else []
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return encode


def word_table(words: DataFrame, path: str = v.BYTE_BPE_50K) -> DataFrame:
    """Each distinct word once: word, n (occurrences), ids."""
    counts = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "words")
    ids = counts.select("word").mapInArrow(_encoder(path), "word string, ids array<int>")
    return materialize(counts.join(ids, "word"), "word-ids")


class _Hot:
    """The broadcast part of the word table: sorted for lookup, ids as one flat array with offsets."""

    def __init__(self, table: pa.Table):
        column = table.column("ids").combine_chunks()
        ids = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        words = table.column("word").combine_chunks()
        self.words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        self.lengths = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        self.starts = ids.offsets.to_numpy()[:-1].astype(np.int64)
        self.flat = ids.flatten().to_numpy()


def _offsets(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges ``flat[start : start + length]``."""
    total = int(lengths.sum())
    step = np.arange(total) - np.repeat(_offsets(lengths)[:-1], lengths)
    return flat[np.repeat(starts, lengths) + step]


def _hot_or_rare(hot):
    """The rare words of each row with their positions."""

    def rare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value.words
        for b in batches:
            lists = b.column("words")
            flat = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            at = pc.is_null(pc.index_in(flat, known)).to_numpy(zero_copy_only=False)
            where = np.nonzero(at)[0]
            rows = np.repeat(b.column("row").to_numpy(), sizes)[where]
            place = (np.arange(len(flat)) - np.repeat(_offsets(sizes)[:-1], sizes))[where]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(place.astype(np.int32)), flat.take(pa.array(where))], ["row", "place", "word"])

    return rare


def _assemble(hot):
    """Ids of each row: hot words by lookup, rare ones from the joined lists, in the order of positions."""

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hot.value
        for b in batches:
            lists = b.column("words")
            flat = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            first = _offsets(sizes)
            code = pc.fill_null(pc.index_in(flat, h.words), -1).to_numpy().astype(np.int64)
            known = code >= 0
            lengths = np.zeros(len(flat), np.int64)
            starts = np.zeros(len(flat), np.int64)
            lengths[known], starts[known] = h.lengths[code[known]], h.starts[code[known]]
            pool = h.flat
            rare = b.column("rare")
            if len(rare.flatten()):
                items = rare.flatten()
                of = np.repeat(np.arange(len(sizes)), np.diff(rare.offsets.to_numpy()) if not rare.null_count else np.array([len(x) if x is not None else 0 for x in rare.to_pylist()]))
                ids = items.field("ids")
                at = first[of] + items.field("place").to_numpy()
                lengths[at] = np.diff(ids.offsets.to_numpy())
                starts[at] = ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py() + len(pool)
                pool = np.concatenate([pool, ids.flatten().to_numpy()])
            out = _gather(pool, starts, lengths).astype(np.int32)
            ends = _offsets(lengths)[first].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(out))], ["row", "doc_id", "ids"])

    return join


def encode(documents: DataFrame, path: str = v.BYTE_BPE_50K, hot_words: int = HOT_WORDS) -> DataFrame:
    """The token ids of every document: row (unique number), doc_id, ids; special tokens are never made.

    ``path`` is the tokenizer's file. Empty and null texts have an empty list; blank and very long ones are encoded
    whole like any other. One row for each row of ``documents``, so a repeated or null doc_id stays as it is; other
    columns are ignored.
    """
    words = materialize(words_of(documents), "document-words")
    table = word_table(words, path)
    occurrences = table.agg(F.sum("n")).first()[0] or 0
    least = max(1, -(-occurrences // hot_words))
    hot = table.filter(F.col("n") >= least).select("word", "ids").toArrow()  # at most hot_words rows
    hot = documents.sparkSession.sparkContext.broadcast(_Hot(hot))
    rare = words.select("row", "words").mapInArrow(_hot_or_rare(hot), "row long, place int, word string")
    rare = rare.join(table.filter(F.col("n") < least).select("word", "ids"), "word")
    rare = rare.groupBy("row").agg(F.collect_list(F.struct("place", "ids")).alias("rare"))
    empty = F.array().cast("array<struct<place:int,ids:array<int>>>")
    both = words.join(rare, "row", "left").select("row", "doc_id", "words", F.coalesce("rare", empty).alias("rare"))
    return both.mapInArrow(_assemble(hot), "row long, doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = v.BYTE_BPE_50K) -> DataFrame:
    """The texts of token ids: row, doc_id, text; through a join with the table of pieces (of fixed size, so broadcast).
    Bytes that are no UTF-8 become replacement characters."""
    spark = encoded.sparkSession
    table = spark.createDataFrame([(i, b.hex()) for i, b in v.pieces(path)], "id int, hex string")
    each = encoded.select("row", "doc_id", F.posexplode("ids").alias("place", "id")).join(F.broadcast(table), "id")
    parts = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "hex"))).alias("parts"))
    text = F.decode(F.unhex(F.array_join(F.col("parts.hex"), "")), "UTF-8")
    return encoded.select("row", "doc_id").join(parts, "row", "left").select("row", "doc_id", F.coalesce(text, F.lit("")).alias("text"))
