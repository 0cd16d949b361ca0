"""Readers, writers and upserts of graph catalogs."""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ashlar.operators.canonical import merge_entities, merge_relationships, relationship_signature

FLUSH_ROWS = 50_000
ROWS_PER_FILE = 100_000

ENTITY = "ordinal long, stable_id string, labels array<string>, props_json string, source_kind string, provenance_id string"
RELATIONSHIP = "ordinal long, signature string, from_id string, to_id string, rel_type string, props_json string, source_kind string, provenance_id string"

#: Relationship types by the kind of access to a store.
ACCESS = {"get": "GETS", "set": "SETS", "delete": "DELETES", "clear": "CLEARS"}


# -- reading ----------------------------------------------------------------------------------------------------------


def read_catalog(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """nodes, relationships and provenance of a catalog; raises ``ValueError`` if a row's run isn't in provenance."""
    tables = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("nodes", "relationships", "provenance")}
    known = tables["provenance"].select(F.col("id").alias("provenance_id"))
    for n in ("nodes", "relationships"):
        unknown = tables[n].select("provenance_id").distinct().join(known, "provenance_id", "left_anti").limit(3).collect()
        if unknown:
            raise ValueError(f"{n} has runs that provenance doesn't know: {[r[0] for r in unknown]}")
    return tables


def batches(df: DataFrame, size: int = ROWS_PER_FILE) -> Iterator[list[Row]]:
    """The rows in lists of ``size``, one partition at a time in the driver's memory."""
    rows = df.toLocalIterator(prefetchPartitions=True)
    while batch := list(itertools.islice(rows, size)):
        yield batch


# -- writing ----------------------------------------------------------------------------------------------------------


class Appender:
    """Collects rows and appends them to a table whenever ``threshold`` wait, and at the end."""

    def __init__(self, spark: SparkSession, path: str, schema: str, threshold: int = FLUSH_ROWS):
        self.spark, self.path, self.schema, self.threshold, self.rows, self.written = spark, path, schema, threshold, [], 0

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        if len(self.rows) >= self.threshold:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.spark.createDataFrame(self.rows, self.schema).write.mode("append").option("compression", "zstd").parquet(self.path)
            self.written += len(self.rows)
            self.rows = []

    def __enter__(self) -> Appender:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.flush()


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", rows_per_file: int = ROWS_PER_FILE) -> int:
    """Writes zstd Parquet files of bounded size and returns the number of rows, observed while writing; an existing
    table is an error unless ``mode`` says otherwise."""
    from pyspark.sql import Observation

    seen = Observation(f"rows-{uuid.uuid4().hex}")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return seen.get["n"]


def write_verified(df: DataFrame, path: str, expected: int) -> None:
    """``write_table`` that raises ``ValueError`` if another number of rows was written."""
    n = write_table(df, path)
    if n != expected:
        raise ValueError(f"{n} rows written to {path}, {expected} expected")


def write_report(report: dict, path: str) -> None:
    """A small JSON report; never overwrites one."""
    with open(path, "x", encoding="utf-8") as f:
        json.dump(report, f, indent=2, sort_keys=True)


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> None:
    """Writes a catalog beside ``folder``, moves the old one away and the new one in.

    Readers see the old or the new one whole, or for the moment between the two renames none. If the second rename
    fails, the old catalog is moved back; what was written stays beside it.
    """
    jvm = spark._jvm
    new, old = f"{folder}-new-{uuid.uuid4().hex}", f"{folder}-old-{uuid.uuid4().hex}"
    for name, df in tables.items():
        write_table(df, f"{new}/{name}.parquet")
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    moved = fs.exists(path(folder))
    if moved and not fs.rename(path(folder), path(old)):
        raise OSError(f"{folder} can't be moved away")
    done = False
    try:
        done = fs.rename(path(new), path(folder))
    finally:
        if moved and not done:
            fs.rename(path(old), path(folder))
    if not done:
        raise OSError(f"{folder} can't be replaced")
    if moved:
        fs.delete(path(old), True)


def import_run(spark: SparkSession, path: str, provenance_id: str, kind: str, entities: int, relationships: int) -> None:
    """Appends the record of an import."""
    row = spark.createDataFrame([(uuid.uuid4().hex, provenance_id, kind, entities, relationships)], "run_id string, provenance_id string, kind string, entities long, relationships long")
    row.withColumn("imported_at", F.current_timestamp()).write.mode("append").parquet(path)


def resumable(existing: DataFrame, provenance_id: str) -> bool:
    """Whether a staging may go on: it is empty or of the same run; rows of another run raise ``ValueError``."""
    other = existing.filter(~F.col("provenance_id").eqNullSafe(F.lit(provenance_id))).limit(1).collect()
    if other:
        raise ValueError(f"the staging belongs to run {other[0]['provenance_id']}")
    return not existing.isEmpty()


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, or ``ValueError`` if a key comes twice."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"not unique: {[r.asDict() for r in twice]}")
    return df


# -- upserts ----------------------------------------------------------------------------------------------------------


def _ranked(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both as one table whose ordinals put the old rows first."""
    a = old.withColumn("ordinal", F.lit(0).cast("long"))
    return a.unionByName(new.withColumn("ordinal", F.lit(1).cast("long")), allowMissingColumns=True)


def upsert_entities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """stable_id, labels, props_json after merging: labels united, incoming props patched over the existing ones.

    Both sides have unique ids (``merge_entities`` makes them so)."""
    columns = ["stable_id", "labels", "props_json"]
    return merge_entities(_ranked(existing.select(columns), incoming.select(columns)), within=[])


def upsert_relationships(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """signature, from_id, to_id, rel_type, props_json after merging by signature (which keeps outcomes apart)."""
    columns = ["from_id", "to_id", "rel_type", "props_json"]
    return merge_relationships(_ranked(relationship_signature(existing.select(columns)), relationship_signature(incoming.select(columns))), within=[])


def resolve_endpoints(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """The relationships with both ends among ``nodes``. Others raise ``ValueError``, except captures that only give
    context, which are left out."""
    ids = nodes.select("stable_id").distinct()
    ends = [ids.select(F.col("stable_id").alias(f"{e}_id"), F.lit(True).alias(f"_{e}")) for e in ("from", "to")]
    both = relationships.join(ends[0], "from_id", "left").join(ends[1], "to_id", "left")
    there = F.col("_from").isNotNull() & F.col("_to").isNotNull()
    excused = F.coalesce((F.col("rel_type") == "CAPTURES_VALUE") & (F.get_json_object("props_json", "$.context_only") == "true"), F.lit(False))
    lost = both.filter(~there & ~excused).select("from_id", "rel_type", "to_id").limit(20).collect()
    if lost:
        raise ValueError(f"missing endpoints: {[tuple(r) for r in lost]}")
    return both.filter(there).select(*relationships.columns)


def replace_keeping(existing: DataFrame, incoming: DataFrame, keep: Column, key: str = "stable_id") -> DataFrame:
    """A full replacement by ``incoming`` that keeps the existing rows for which ``keep`` holds and that it doesn't
    replace (such as annotations)."""
    return incoming.unionByName(existing.filter(keep).join(incoming, key, "left_anti"), allowMissingColumns=True)


def replace_types(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Relationships after replacing, for each source and type that comes in, all existing ones of it."""
    return existing.join(incoming.select("from_id", "rel_type").distinct(), ["from_id", "rel_type"], "left_anti").select(*existing.columns).unionByName(incoming)


def scoped_replacement(nodes: DataFrame, relationships: DataFrame, scope: DataFrame, new_nodes: DataFrame, new_relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replaces what lies in a scope (column stable_id); edges that cross its border stay unless the new ones have the
    same signature or an end is gone."""
    ids = scope.select("stable_id").distinct()
    kept_nodes = nodes.join(ids, "stable_id", "left_anti").join(new_nodes, "stable_id", "left_anti")
    all_nodes = kept_nodes.unionByName(new_nodes)
    marked = relationships
    for e in ("from", "to"):
        marked = marked.join(ids.select(F.col("stable_id").alias(f"{e}_id"), F.lit(True).alias(f"_{e}")), f"{e}_id", "left")
    inside = F.col("_from").isNotNull() & F.col("_to").isNotNull()
    kept = marked.filter(~inside).select(*relationships.columns).join(new_relationships.select("signature"), "signature", "left_anti")
    for e in ("from", "to"):
        kept = kept.join(all_nodes.select(F.col("stable_id").alias(f"{e}_id")), f"{e}_id", "left_semi")
    return all_nodes, kept.select(*relationships.columns).unionByName(new_relationships)


# -- rows of other shapes to the graph --------------------------------------------------------------------------------


def to_graph(rows: DataFrame, source: str, target: str, rel_type: Column | str, source_labels: list[str], target_labels: list[str], kind: str, provenance_id: str, props: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of typed rows: each distinct end is an entity, each row a relationship. Rows without
    both ends give none. Ordinals are unique and follow no order."""
    rel = F.lit(rel_type) if isinstance(rel_type, str) else rel_type
    rows = rows.filter(F.col(source).isNotNull() & F.col(target).isNotNull())
    text = F.to_json(props) if props is not None else F.lit("{}")
    edges = rows.select(F.col(source).alias("from_id"), F.col(target).alias("to_id"), rel.alias("rel_type"), text.alias("props_json"))
    ends = [rows.select(F.col(c).alias("stable_id"), F.array(*[F.lit(x) for x in ls]).alias("labels")) for c, ls in ((source, source_labels), (target, target_labels))]
    both = ends[0].union(ends[1]).distinct()
    tail = [F.lit(kind).alias("source_kind"), F.lit(provenance_id).alias("provenance_id")]
    entities = both.select(F.monotonically_increasing_id().alias("ordinal"), "stable_id", "labels", F.lit("{}").alias("props_json"), *tail)
    signed = relationship_signature(edges).select(F.monotonically_increasing_id().alias("ordinal"), "signature", "from_id", "to_id", "rel_type", "props_json", *tail)
    return entities, signed


def access_type(column: str) -> Column:
    """The relationship type of a store access."""
    table = F.create_map(*[F.lit(x) for p in ACCESS.items() for x in p])
    return F.element_at(table, F.lower(F.col(column)))


def file_edges(rows: DataFrame) -> DataFrame:
    """File imports with slashes turned and the folders and names of both ends; rows without a path are left out."""
    for end in ("from", "to"):
        path = F.regexp_replace(F.replace(F.trim(f"{end}_path"), F.lit("\\"), F.lit("/")), "^\\./", "")
        rows = rows.withColumn(f"{end}_path", F.nullif(path, F.lit("")))
        rows = rows.withColumn(f"{end}_folder", F.when(F.contains(f"{end}_path", F.lit("/")), F.regexp_extract(f"{end}_path", "^(.*)/[^/]*$", 1)).otherwise("."))
        rows = rows.withColumn(f"{end}_name", F.regexp_extract(f"{end}_path", "([^/]*)$", 1))
    return rows.filter("from_path is not null and to_path is not null").withColumn("same_folder", F.col("from_folder") == F.col("to_folder"))


def package_edges(rows: DataFrame, packages: DataFrame, otherwise: str = "transitiveOrUnlisted") -> DataFrame:
    """Package imports with the ``scope`` of their package's metadata, or the default."""
    known = packages.groupBy("package").agg(F.min("scope").alias("scope"))
    return rows.join(known, "package", "left").withColumn("scope", F.coalesce("scope", F.lit(otherwise)))


def numbered(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """With dense numbers from 0 in a total order, without a window over all rows: counts by sorted partition, then
    offsets."""
    from ashlar.runtime import materialize

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    kept = materialize(ranged, "numbered")
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    starts = sizes.withColumn("_start", F.sum("n").over(W.orderBy("_part")) - F.col("n"))  # one row for each partition
    out = kept.join(F.broadcast(starts.select("_part", "_start", "_first")), "_part")
    return out.select(*df.columns, (F.col("_start") + F.col("_at") - F.col("_first")).alias(name))


def staged(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small table from driver rows."""
    return spark.createDataFrame(list(rows), schema)
