"""Named queries that run streams over a whole table to their end, each beside its SQL over the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.functions.ids import normalized_sql
from ashlar.runtime import work_folder
from ashlar.sources.tables import table
from ashlar.streaming import runtime_stream as rs

_T = "CASE WHEN score > 0 THEN score ELSE epoch_ms(ingested_at) END"


def _run(spark: SparkSession, d: str, view, mode: str = "complete") -> DataFrame:
    path = f"{d}/runtime_records.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        stream = reader.parquet(path)
    else:  # a stream's source is a folder; here the one with the file
        stream = reader.option("pathGlobFilter", "runtime_records.parquet").parquet(d)
    return rs.run_to_end(view(stream), f"{work_folder(spark)}/stream-{uuid.uuid4().hex}", mode)


def stream_latest_values(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, rs.latest_values)


def stream_session_totals(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, rs.session_totals)


def stream_merged_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, rs.merged_nodes)


def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, lambda s: rs.windowed_counts(s.withColumn("event_at", F.timestamp_millis(rs.event_time()))))


def stream_anchored_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "raw_entities", "stable_id")
    return _run(spark, d, lambda s: rs.anchored(rs.valid(s), e).select("event_id", "anchor", "known"), "append")


QUERIES = {f.__name__: f for f in (stream_latest_values, stream_session_totals, stream_merged_nodes, stream_window_counts, stream_anchored_events)}
ORACLE_SQL = {
    "stream_latest_values": f"SELECT function_stable_id, arg_max(kind, (t, event_id)) AS kind, max(t) AS last_ms, count(*) AS events FROM (SELECT *, {_T} AS t FROM runtime_records) WHERE function_stable_id IS NOT NULL GROUP BY ALL",
    "stream_session_totals": f"SELECT session_id, count(*) AS events, count(*) FILTER (kind = 'error') AS errors, min(t) AS first_ms, max(t) AS last_ms FROM (SELECT *, {_T} AS t FROM runtime_records) WHERE session_id IS NOT NULL GROUP BY ALL",
    "stream_merged_nodes": "SELECT node_id, "
    + ", ".join(f"arg_min({c}, (t, event_id)) FILTER ({c} IS NOT NULL) AS {c}" for c in ("parent_node_id", "session_id", "correlation_id", "kind"))
    + f", count(*) AS events, coalesce(bool_or(update_only), false) AS update_merged FROM (SELECT *, {_T} AS t FROM runtime_records) WHERE node_id IS NOT NULL GROUP BY ALL",
    "stream_window_counts": f"SELECT time_bucket(INTERVAL '5 minutes', make_timestamp({_T} * 1000), TIMESTAMP '1970-01-01') AS window_start, kind, count(*) AS events FROM runtime_records GROUP BY ALL",
    "stream_anchored_events": f"SELECT event_id, {normalized_sql('function_stable_id')} AS anchor, coalesce({normalized_sql('function_stable_id')} IN (SELECT {normalized_sql('stable_id')} FROM raw_entities WHERE stable_id IS NOT NULL), false) AS known FROM runtime_records WHERE node_id IS NOT NULL",
}
