"""Texts as sequences of terms: tokenised once into a work table, then worked on as arrays, a batch at a time."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.terms import MARK, sequence, terms
from ashlar.runtime import materialize

_FENCE = re.compile(r"^\s*```", re.M)
_LIST = re.compile(r"^\s*[*+-] ", re.M)
HEADING = re.compile(r"^\s*#{1,6} .*$", re.M)
_FIELDS = [("row", pa.int64()), ("doc_id", pa.int64()), ("body", pa.string()), ("heading", pa.string()), ("fence", pa.bool_()), ("list", pa.bool_())]


def read(text: str) -> tuple[str, str, bool, bool]:
    """The terms of a text by sentence, those of its headings, and whether it has fenced code and lists."""
    heading = [t for h in HEADING.findall(text) for t in terms(h)] if "#" in text else []
    body = sequence(HEADING.sub("", text) if "#" in text else text)
    return body, " ".join(heading), bool(_FENCE.search(text)), bool(_LIST.search(text))


def as_batch(texts: list[str]) -> pa.RecordBatch:
    rows = [read(t) for t in texts]
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64())] * 2 + [pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS[2:])], [n for n, _ in _FIELDS])


def _tokenised(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [read(t) for t in b.column("text").to_pylist()]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *[pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS[2:])]], [n for n, _ in _FIELDS])


def tokenised(documents: DataFrame) -> DataFrame:
    """A work table of the documents with a text: row (unique), doc_id, body, heading, fence, list."""
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    return materialize(rows.mapInArrow(_tokenised, "row long, doc_id long, body string, heading string, fence boolean, list boolean"), "tokens")


def sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of ``values`` by group."""
    out = np.empty((n, values.shape[1]))
    for j in range(values.shape[1]):
        out[:, j] = np.bincount(of, values[:, j], n)
    return out


class Words:
    """The terms of a batch of texts: ``terms`` (distinct), ``size``, and of each word ``code`` (which term), ``doc``,
    ``sent`` (sentence, counted over the batch); ``begins`` and ``ends`` of sentences among the words."""

    def __init__(self, column: pa.Array):
        self.docs = len(column)
        parts = pc.split_pattern(column, " ")
        lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(parts).dictionary_encode()
        self.terms = coded.dictionary.to_pylist()
        self.size = len(self.terms)
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(self.docs), lengths)
        kept = ~np.isin(codes, [i for i, t in enumerate(self.terms) if t in ("", MARK)])
        part = (np.cumsum(np.isin(codes, [i for i, t in enumerate(self.terms) if t == MARK])) + doc)[kept]
        self.code, self.doc = codes[kept], doc[kept]
        new = np.ones(len(part), bool)
        new[1:] = part[1:] != part[:-1]
        self.sent = np.cumsum(new) - 1
        self.begins = np.flatnonzero(new)
        self.ends = np.append(self.begins[1:], len(part)).astype(np.int64)
        self.doc_of = self.doc[self.begins]
        self.sentences = np.bincount(self.doc_of, minlength=self.docs)
        self._pairs = None

    def pairs(self) -> np.ndarray:
        """The distinct terms of each sentence, as sentence * size + code, sorted."""
        if self._pairs is None:
            self._pairs = np.unique(self.sent * max(self.size, 1) + self.code)
        return self._pairs
