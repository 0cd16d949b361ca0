"""What changed between consecutive full snapshots.

The rows of all runs are range-partitioned and sorted by (workspace, stable_id, run, ordinal) and each range is read
once as a stream: neighbouring groups of rows are the two sides of the merge. The range keys end with the unique
``ordinal``, so ranges are of equal size however many rows one key has, and as many as the counted bytes ask for. Groups
that cross the border of two ranges are carried on as the ranges' edges, four groups each at most, which are merged by
blocks of neighbouring ranges until one block is left. ``SnapshotStore`` keeps the last snapshot in that order for the
next one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.functions.json_values import facts, spelled
from ashlar.operators.skew import lookup_join
from ashlar.runtime import checked_broadcast, materialize
from ashlar.sources.tables import runs

_OUT = "kind string, workspace string, stable_id string, seq int, change string, state string, place long, done boolean"
#: Bytes of props in a range, about, until there are ``MANY`` ranges; from there on up to 16 times as many. And how many
#: ranges have their edges merged in one task.
RANGE_BYTES, MANY, TOGETHER = 8 << 20, 20_000, 1024
#: Rows of one entity in a run are folded into one state whenever so many wait.
_FOLD = 64


class _Group:
    """The rows of one entity in one run, merged only when they must be compared."""

    __slots__ = ("key", "seq", "rows", "_labels", "_props", "_merged")

    def __init__(self, key: tuple, seq: int):
        self.key, self.seq, self.rows, self._labels, self._props, self._merged = key, seq, [], set(), {}, False

    def add(self, labels: list | None, props: str | None) -> None:
        self.rows.append((labels, props))
        if len(self.rows) >= _FOLD:
            self._fold()

    def _fold(self) -> None:
        for labels, props in self.rows:
            self._labels.update(x for x in labels or () if x is not None)
            for k, v in facts(props).items():
                self._props[k] = None if v is None else spelled(v)
        self.rows, self._merged = [], True

    def merged(self) -> tuple[set, dict]:
        if self.rows:
            self._fold()
        return self._labels, {k: v for k, v in self._props.items() if v is not None}

    def join(self, later: _Group) -> None:
        """Takes the later rows of the same entity and run; nulls of the later part still remove."""
        self._fold()
        later._fold()
        self._labels |= later._labels
        self._props |= later._props

    def dump(self) -> str:
        if self.rows:
            self._fold()
        return json.dumps([sorted(self._labels), self._props])

    @classmethod
    def load(cls, key: tuple, seq: int, text: str) -> _Group:
        self = cls(key, seq)
        labels, self._props = json.loads(text)
        self._labels, self._merged = set(labels), True
        return self

    def same(self, other: _Group) -> bool:
        if not self._merged and not other._merged and self.rows == other.rows:
            return True
        return self.merged() == other.merged()


def _changes(a: _Group | None, b: _Group | None) -> Iterator[tuple]:
    """The changes that two neighbouring groups show: (workspace, stable_id, seq, change)."""
    if a and b and a.key == b.key and a.seq + 1 == b.seq:
        if not a.same(b):
            yield *b.key, b.seq, "changed"
        return
    if a:
        yield *a.key, a.seq + 1, "removed"  # of no effect after the last run
    if b and b.seq > 1:
        yield *b.key, b.seq, "added"


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[_Group]:
    group = None
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("workspace", "stable_id", "seq", "labels", "props_json")]
        for workspace, stable_id, seq, labels, props in zip(*columns):
            if group is None or group.seq != seq or group.key != (workspace, stable_id):
                if group is not None:
                    yield group
                group = _Group((workspace, stable_id), seq)
            group.add(labels, props)
    if group is not None:
        yield group


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_())
    names = ("kind", "workspace", "stable_id", "seq", "change", "state", "place", "done")
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], list(names))


def _merge(groups: Iterable[tuple[_Group, bool]], part: int, whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Compares neighbouring groups; each comes with whether it was compared with the one before it already.

    The first and the last group may go on in the neighbouring ranges, so their pairs wait: the first two and the last
    two groups come out as kind ``edge`` (``done``: compared with the edge before). With ``whole`` nothing lies beyond.
    """
    out: list[tuple] = []
    edges: list[tuple[_Group, bool]] = []
    before, last = None, (None, True)
    n = 0
    for g, done in groups:
        if n and last[0].key == g.key and last[0].seq == g.seq:
            last[0].join(g)
            continue
        if n >= 3 or whole:
            if not last[1]:
                out.extend(("change", *x, "", 0, False) for x in _changes(before, last[0]))
            if len(out) >= 10_000:
                yield _emit(out)
                out = []
        n += 1
        before, last = last[0], (g, done if n > 1 else False)
        if n <= 2:
            edges.append(last)
    if whole:
        if n:
            out.extend(("change", *x, "", 0, False) for x in [*([] if last[1] else _changes(before, last[0])), *_changes(last[0], None)])
    else:
        if n >= 4:
            edges += [(before, True), last]
        elif n == 3:
            edges.append(last)
        out.extend(("edge", *g.key, g.seq, "", g.dump(), part * 4 + i, done) for i, (g, done) in enumerate(edges))
    yield _emit(out)


def _merge_range(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The changes inside a range, and its edges."""
    from pyspark import TaskContext

    yield from _merge(((g, False) for g in _groups(batches)), TaskContext.get().partitionId())


def _edges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[_Group, bool, int]]:
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("workspace", "stable_id", "seq", "state", "place", "done")]
        for workspace, stable_id, seq, state, place, done in zip(*columns):
            yield _Group.load((workspace, stable_id), seq, state), done, place // 4


def _stitch(ranges: int | None):
    """Merges the edges of ``ranges`` neighbouring ranges to the edges of one; of all ranges without a number."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, some in groupby(_edges(batches), lambda e: e[2] // ranges if ranges else 0):
            yield from _merge(((g, done) for g, done, _ in some), to, whole=ranges is None)

    return over


def _compared(rows: DataFrame, size: int, together: int) -> DataFrame:
    """The changes of rows (workspace, stable_id, seq, ordinal, labels, props_json) by ``_merge`` over ranges of about
    ``size`` bytes; the edges of ``together`` ranges are merged at a time, in as many steps as that takes."""
    order = ["workspace", "stable_id", "seq", "ordinal"]
    width = F.coalesce(F.octet_length("props_json"), F.lit(0)) + 64
    total = rows.agg(F.sum(width.cast("long"))).first()[0] or 0
    n = max(1, -(-total // size))
    n = n if n <= MANY else max(MANY, -(-total // (16 * size)))
    n = max(n, rows.sparkSession.sparkContext.defaultParallelism if total > size else 1)
    step = materialize(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_merge_range, _OUT), "snapshot-merge")
    changes = step.filter("kind = 'change'")
    while n > together:
        n = -(-n // together)
        block = F.floor(F.col("place") / (4 * together))
        edges = step.filter("kind = 'edge'").repartition(n, block).sortWithinPartitions("place")
        step = materialize(edges.mapInArrow(_stitch(together), _OUT), "snapshot-edges")
        changes = changes.union(step.filter("kind = 'change'"))
    last = step.filter("kind = 'edge'").repartition(1).sortWithinPartitions("place").mapInArrow(_stitch(None), _OUT)
    return changes.union(last.filter("kind = 'change'")).select("workspace", "seq", "stable_id", "change")


def _rows(entities: DataFrame, known: DataFrame) -> DataFrame:
    rows = entities.select("stable_id", "provenance_id", "ordinal", "labels", "props_json").filter(F.col("stable_id").isNotNull())
    return lookup_join(rows, known, ["provenance_id"], "stable_id").filter("seq is not null").select("workspace", "stable_id", "seq", "ordinal", "labels", "props_json")


def snapshot_changes(entities: DataFrame, provenance: DataFrame, size: int = RANGE_BYTES, together: int = TOGETHER) -> DataFrame:
    """The entities added, removed or changed between consecutive runs of a workspace.

    Columns: provenance_id (the later run), stable_id, change (``added``, ``removed``, ``changed``).

    The rows of an id in a run are merged in order of ``ordinal``: labels as a set, of each top-level key of
    ``props_json`` the later value, a null removes it. Nulls, empty lists and ``{}`` are all "nothing"; repeated rows
    change nothing; a text that is no JSON object counts as one value of its own. Rows with a null id, or of a run that
    provenance doesn't know, belong to no snapshot and are left out. Of equal ordinals, either may be the later. Empty
    tables give an empty result; other columns are ignored.
    """
    known = runs(provenance)
    changes = _compared(_rows(entities, known), size, together)
    return changes.join(checked_broadcast(known), ["workspace", "seq"]).select("provenance_id", "stable_id", "change")


class SnapshotStore:
    """The last snapshot of each workspace, kept in a folder range-partitioned and sorted by (workspace, stable_id,
    ordinal), so that new runs are compared without reading the older ones again.

    ``add`` takes the runs delivered since, all of whose rows must be there; a run at or before the kept one of its
    workspace is refused. A new state is written beside the old one and becomes the current one by one small file, so a
    failure leaves the old state; the one before it is kept for jobs that still read it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def state(self) -> int:
        """The number of the current state, 0 if there is none."""
        path, fs = self._at("")
        if not fs.exists(path):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return max((int(n.removeprefix("current-")) for n in names if n.startswith("current-")), default=0)

    def rows(self) -> DataFrame | None:
        """The kept rows with their run; None before the first ``add``."""
        n = self.state()
        return self.spark.read.parquet(f"{self.folder}/state-{n}") if n else None

    def add(self, entities: DataFrame, provenance: DataFrame) -> DataFrame:
        """The changes that the new runs bring, as ``snapshot_changes`` gives them."""
        kept, n = self.rows(), self.state()
        new = provenance.select("id", "metadata_json")
        if kept is not None:
            old = self.spark.read.parquet(f"{self.folder}/runs-{n}")
            order = runs(old.withColumn("old", F.lit(1)).unionByName(new, allowMissingColumns=True))
            order = materialize(order.join(old.select(F.col("id").alias("provenance_id"), F.lit(True).alias("old")), "provenance_id", "left"), "runs")
            if not order.filter("old and seq > 1").isEmpty():
                raise ValueError("a run isn't later than the kept one of its workspace")
            entities = kept.select("stable_id", "provenance_id", "ordinal", "labels", "props_json").unionByName(entities.select("stable_id", "provenance_id", "ordinal", "labels", "props_json"))
            new = old.union(new)
        else:
            order = materialize(runs(new), "runs")
        rows = _rows(entities, order)
        changes = materialize(_compared(rows, RANGE_BYTES, TOGETHER).join(checked_broadcast(order), ["workspace", "seq"]).select("provenance_id", "stable_id", "change"), "snapshot-changes")
        last = order.groupBy("workspace").agg(F.max("seq").alias("seq")).join(order, ["workspace", "seq"]).select("workspace", "seq", "provenance_id")
        last = last.join(new.groupBy(F.col("id").alias("provenance_id")).agg(F.min("metadata_json").alias("metadata_json")), "provenance_id")
        last = materialize(last, "last-runs")
        last.select(F.col("provenance_id").alias("id"), "metadata_json").write.parquet(f"{self.folder}/runs-{n + 1}")
        state = rows.join(checked_broadcast(last.drop("metadata_json")), ["workspace", "seq"]).drop("seq")
        by = ["workspace", "stable_id", "ordinal"]
        state.repartitionByRange(*by).sortWithinPartitions(*by).write.option("compression", "zstd").parquet(f"{self.folder}/state-{n + 1}")
        path, fs = self._at(f"current-{n + 1}")
        fs.create(path, False).close()
        for old_name in (f"current-{n - 1}", f"state-{n - 1}", f"runs-{n - 1}"):
            path, fs = self._at(old_name)
            fs.delete(path, True)
        return changes
