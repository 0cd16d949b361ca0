"""Filling containers of fixed capacity with neighbouring documents along a space-filling curve."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm import curve, encoding
from ashlar.llm import vocabulary as v
from ashlar.runtime import materialize

CAPACITY = 2048
#: Neighbours on the curve that are packed together, largest first.
WINDOW = 1024
#: Containers that stay open for the next window.
OPEN = 64
#: Rows of a range of the curve, about: one task packs it.
RANGE_ROWS = 500_000


def _project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    matrix = curve.projection()
    for b in batches:
        ids = b.column("ids")
        offsets = ids.offsets.to_numpy().astype(np.int64)
        flat = ids.flatten().to_numpy()
        p = curve.vectors(flat, offsets - offsets[0]) @ matrix
        columns = [b.column("row"), b.column("doc_id"), pa.array(np.diff(offsets))] + [pa.array(p[:, i]) for i in range(curve.DIMENSIONS)]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", *[f"x{i}" for i in range(curve.DIMENSIONS)]])


def _key(mean: np.ndarray, deviation: np.ndarray):
    def key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(f"x{i}").to_numpy() for i in range(curve.DIMENSIONS)])
            h = curve.keys(x, mean, deviation) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("n_tokens"), pa.array(h)], ["row", "doc_id", "n_tokens", "curve"])

    return key


class _Packer:
    """Best fit, largest first in each window, over a bounded number of open containers."""

    def __init__(self, capacity: int, base: int):
        self.capacity, self.next, self.open = capacity, base, []  # open: sorted (room, container)

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def window(self, items: list[tuple[int, int, int]]) -> list[tuple]:
        """Rows (container, row, doc_id, piece, pieces, start, length) of the items (n, row, doc_id)."""
        out, rest = [], []
        for n, row, doc in items:
            pieces = max(1, -(-n // self.capacity))
            for i in range(pieces - 1):
                out.append((self._new(), row, doc, i, pieces, i * self.capacity, self.capacity))
            start = (pieces - 1) * self.capacity
            if n:
                rest.append((n - start, row, doc, pieces, start))
            else:
                out.append((None, row, doc, 0, 1, 0, 0))
        for n, row, doc, pieces, start in sorted(rest, key=lambda x: (-x[0], x[1])):
            i = bisect_left(self.open, (n, -1))
            room, at = self.open.pop(i) if i < len(self.open) else (self.capacity, self._new())
            out.append((at, row, doc, pieces - 1, pieces, start, n))
            if room > n:
                insort(self.open, (room - n, at))
        del self.open[: max(0, len(self.open) - OPEN)]  # those with the least room
        return out


def _pack(capacity: int, window: int):
    names = ["container_id", "row", "doc_id", "piece", "pieces", "start", "n_tokens"]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = _Packer(capacity, TaskContext.get().partitionId() << 33)

        def emit(items: list) -> pa.RecordBatch:
            columns = list(zip(*packer.window(items))) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        held: list = []
        for b in batches:
            held += zip(b.column("n_tokens").to_pylist(), b.column("row").to_pylist(), b.column("doc_id").to_pylist())
            while len(held) >= window:
                yield emit(held[:window])
                held = held[window:]
        yield emit(held)

    return pack


def pack(documents: DataFrame, capacity: int = CAPACITY, window: int = WINDOW, path: str = v.BYTE_BPE_50K) -> DataFrame:
    """The documents in containers of ``capacity`` tokens: container_id, row, doc_id, piece, pieces, start, n_tokens.

    A document's hashed token vector is projected to few dimensions, and documents are range-partitioned and sorted by
    the Hilbert key of the projection. Each range is packed as a stream: a window of neighbours by best fit, largest
    first, into containers left open by the window before or new ones. Only a document of more than ``capacity``
    tokens is divided: into full containers and one rest. Documents without tokens (null and empty texts) are in no
    container (null) with 0 tokens. Ties on the curve, such as exact copies, are ordered by size and row, so a group of
    copies is spread over ranges like any other rows.
    """
    points = materialize(encoding.encode(documents, path).mapInArrow(_project, "row long, doc_id long, n_tokens long, " + ", ".join(f"x{i} double" for i in range(curve.DIMENSIONS))), "points")
    dims = range(curve.DIMENSIONS)
    some = points.filter("n_tokens > 0").agg(F.count(F.lit(1)), *[F.avg(f"x{i}") for i in dims], *[F.stddev_pop(f"x{i}") for i in dims]).first()
    rows, *some = [x or 0.0 for x in some]
    mean, deviation = np.array([some[: len(dims)], some[len(dims) :]])
    # as many ranges as the rows ask for; few rows are still spread over the cores
    n = int(max(1, -(-rows // RANGE_ROWS), min(documents.sparkSession.sparkContext.defaultParallelism, rows // (16 * window))))
    keyed = points.mapInArrow(_key(mean, deviation), "row long, doc_id long, n_tokens long, curve long")
    order = ["curve", "n_tokens", "row"]
    ranges = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return ranges.mapInArrow(_pack(capacity, window), "container_id long, row long, doc_id long, piece long, pieces long, start long, n_tokens long")


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: documents, containers, tokens, least_containers (no packing needs fewer) and fill (share of used room)."""
    held = packed.filter("container_id is not null")
    containers = F.count_distinct("container_id")
    return held.agg(
        F.count_distinct("row").alias("documents"), containers.alias("containers"), F.sum("n_tokens").alias("tokens"),
        F.ceil(F.sum("n_tokens") / capacity).alias("least_containers"), F.try_divide(F.sum("n_tokens"), containers * capacity).alias("fill"),
    )
