"""Runtime records as a stream: ingestion, running views, late data, and anchoring to the static graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ashlar.functions.ids import normalize_id
from ashlar.operators.runtime_events import event_time

RECORD = (
    "event_id string, node_id string, parent_node_id string, function_stable_id string, session_id string, correlation_id string, "
    "kind string, update_only boolean, score long, ingested_at timestamp, raw_json string"
)


def source(spark: SparkSession, path: str, files_per_trigger: int | None = None, fmt: str = "parquet", schema: str = RECORD) -> DataFrame:
    """New files of a folder as a stream; ``files_per_trigger`` bounds what one batch takes (back-pressure)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def normalized(payload: Column) -> Column:
    """One payload shape from three: an envelope with ``nodeProps``, an older one with ``props``, or a bare event."""
    get = lambda *ks: F.coalesce(*[F.get_json_object(payload, f"$.{k}") for k in ks])
    return F.struct(
        get("nodeid", "nodeId", "event.nodeId", "id").alias("node_id"), get("parentNodeid", "parentNodeId", "event.parentNodeId").alias("parent_node_id"),
        get("nodeProps.sessionId", "props.sessionId", "sessionId").alias("session_id"), get("nodeProps.correlationId", "props.correlationId", "correlationId").alias("correlation_id"),
        get("nodeProps.kind", "props.kind", "kind").alias("kind"), F.coalesce(get("updateOnly") == "true", F.lit(False)).alias("update_only"),
        F.try_to_number(get("nodeProps.tsMs", "props.tsMs", "tsMs", "score"), F.lit("9999999999999")).cast("long").alias("score"), payload.alias("raw_json"),
    )


def valid(records: DataFrame) -> DataFrame:
    """Records with a node; the others can't be stored."""
    return records.filter("node_id is not null")


def timed(records: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """With ``event_at`` and a watermark on it. The watermark is an addition: without one, state is kept for ever."""
    return records.withColumn("event_at", F.timestamp_millis(event_time())).withWatermark("event_at", delay)


def ingest(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends valid records to a table by day, and the numbers of stored and skipped ones of each batch beside it.

    A batch that runs again after a failure replaces its own files, so nothing comes twice. The source of a batch is read
    twice rather than kept on executors, which may be lost.
    """

    def store(batch: DataFrame, number: int) -> None:
        good = valid(batch).withColumn("day", F.to_date(F.timestamp_millis(event_time())))
        good.write.mode("overwrite").partitionBy("day").parquet(f"{path}/records/batch={number}")
        counts = batch.select("node_id").agg(F.count("node_id").alias("stored"), F.count_if(F.col("node_id").isNull()).alias("skipped"))
        counts.write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    return records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(records: DataFrame) -> DataFrame:
    """Each event once within the watermark; off by default, as sources deliver at least once on purpose."""
    return records.dropDuplicatesWithinWatermark(["event_id"])


def latest_values(records: DataFrame) -> DataFrame:
    """The last kind and time of each function, for update or complete mode."""
    last = F.max(F.struct(event_time().alias("t"), "event_id", "kind")).alias("l")
    rows = records.filter("function_stable_id is not null").groupBy("function_stable_id").agg(last, F.count(F.lit(1)).alias("events"))
    return rows.select("function_stable_id", "l.kind", F.col("l.t").alias("last_ms"), "events")


def session_totals(records: DataFrame) -> DataFrame:
    """Events, errors and the time span of each session, for update or complete mode."""
    t = event_time()
    return records.filter("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("kind") == "error").alias("errors"), F.min(t).alias("first_ms"), F.max(t).alias("last_ms"))


def merged_nodes(records: DataFrame) -> DataFrame:
    """Update rows merged into their node: the first non-null of each column by time, for update or complete mode."""
    at = F.struct(event_time().alias("t"), "event_id")
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in ("parent_node_id", "session_id", "correlation_id", "kind")]
    return valid(records).groupBy("node_id").agg(*first, F.count(F.lit(1)).alias("events"), F.coalesce(F.bool_or("update_only"), F.lit(False)).alias("update_merged"))


def windowed_counts(records: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Events by window and kind; of timed records, a window comes out once the watermark has passed it (append mode)."""
    g = records.groupBy(F.window("event_at", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("events"))
    return g.select(F.col("w.start").alias("window_start"), "kind", "events")


def anchored(records: DataFrame, entities: DataFrame) -> DataFrame:
    """Each record with the entity it stands for, if known: a join of the stream with the static table."""
    known = entities.select(normalize_id("stable_id").alias("anchor")).filter("anchor is not null").distinct()
    return records.withColumn("anchor", normalize_id("function_stable_id")).join(known.withColumn("known", F.lit(True)), "anchor", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def run_to_end(df: DataFrame, path: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns its result: the rows appended, or the last complete state."""
    spark = df.sparkSession
    out = f"{path}/out"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(out)
    last = [-1]

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        last[0] = number

    df.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/checkpoint").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(f"{out}/batch={last[0]}")


def clear(spark: SparkSession, path: str) -> None:
    """Removes a stream's tables and checkpoint."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
