"""Session-level helpers shared by the operators: the work folder, materialised tables, checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted to have at most so many rows and bytes.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20

_OWN_FOLDER: dict[str, str] = {}
_WRITTEN: set[str] = set()


def work_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that is unset (tests, local use)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        holder = tempfile.TemporaryDirectory(prefix="ashlar-")
        atexit.register(holder.cleanup)
        _OWN_FOLDER[app] = "file://" + holder.name
    return _OWN_FOLDER[app]


class WorkTable:
    """A DataFrame written to the work folder, which cuts lineage and outlives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{work_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        _WRITTEN.add(self.path)
        df.write.option("compression", "zstd").parquet(self.path)
        # the schema is given, so reading back starts no job; files hold nullable columns
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Removes the files; only for tables that no result still reads."""
        _delete(self.spark, self.path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN.discard(path)


def clear_work(spark: SparkSession) -> int:
    """Removes all tables that this process wrote to the work folder, once the results that read them are stored
    elsewhere; returns how many."""
    paths = list(_WRITTEN)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def together(tables: list[WorkTable]) -> DataFrame:
    """The rows of work tables of one schema by one scan, so that plans, and the code generated for them, stay the same
    however many tables there are."""
    spark = tables[0].spark
    return spark.read.schema(tables[0].df.schema).parquet(*[t.path for t in tables])


def materialize(df: DataFrame, name: str) -> DataFrame:
    return WorkTable(df, name).df


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and, as text, ``size`` bytes; reads no more than ``rows + 1`` of them."""
    text = F.octet_length(F.to_json(F.struct(*df.columns)))
    n, b = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(text.cast("long"))).first()
    return n <= rows and (b or 0) <= size


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is small by rows and bytes, else as it is (a shuffled join then).

    Give it only tables that are cheap to count: the count is an action.
    """
    return F.broadcast(df) if is_small(df, rows, size) else df
