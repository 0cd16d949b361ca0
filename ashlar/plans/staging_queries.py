"""Named queries of sources, canonicalization and comparison of catalogs, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.operators import canonical, relational
from ashlar.sources.tables import runs, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_entities")


def relationships(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_relationships")


def _spelled(props: str):
    """Top-level keys and values as one comparable text."""
    m = F.from_json(props, "map<string,string>")
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e.key, F.lit("="), F.coalesce(e.value, F.lit("null"))))), "|")


_SPELLED = "array_to_string(list_sort(list_transform(json_keys({0}), lambda k: k || '=' || coalesce(json_extract_string({0}, '$.\"' || k || '\"'), 'null'))), '|')"
_PATCHED = "list_reduce(list(props_json::JSON ORDER BY ordinal) FILTER (props_json IS NOT NULL), lambda a, b: json_merge_patch(a, b))"


@query(f"""WITH m AS (SELECT provenance_id, stable_id, array_to_string(list_sort(list_distinct(flatten(list(coalesce(labels, []))))), ',') AS labels,
  CASE WHEN count(*) > 1 THEN {_PATCHED} ELSE any_value(props_json)::JSON END AS p FROM raw_entities GROUP BY ALL)
SELECT provenance_id, stable_id, labels, coalesce({_SPELLED.format('p')}, '') AS props FROM m""")
def canonical_entities(spark: SparkSession, d: str) -> DataFrame:
    merged = canonical.merge_entities(entities(spark, d))
    labels = F.array_join(F.array_sort(F.array_distinct(F.coalesce("labels", F.array().cast("array<string>")))), ",")
    return merged.select("provenance_id", "stable_id", labels.alias("labels"), F.coalesce(_spelled("props_json"), F.lit("")).alias("props"))


@query(f"""WITH m AS (SELECT provenance_id, signature, arg_min(from_id, ordinal) AS from_id, arg_min(to_id, ordinal) AS to_id, arg_min(rel_type, ordinal) AS rel_type,
  CASE WHEN count(*) > 1 THEN {_PATCHED} ELSE any_value(props_json)::JSON END AS p FROM raw_relationships WHERE signature IS NOT NULL GROUP BY provenance_id, signature)
SELECT provenance_id, md5(signature) AS signature, from_id, to_id, rel_type, coalesce({_SPELLED.format('p')}, '') AS props FROM m""")
def canonical_relationships(spark: SparkSession, d: str) -> DataFrame:
    merged = canonical.merge_relationships(relationships(spark, d))
    return merged.select("provenance_id", F.md5("signature").alias("signature"), "from_id", "to_id", "rel_type", F.coalesce(_spelled("props_json"), F.lit("")).alias("props"))


@query("SELECT provenance_id, stable_id, count(*) AS n FROM raw_entities WHERE stable_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_entity_ids(spark: SparkSession, d: str) -> DataFrame:
    return canonical.duplicates(entities(spark, d), ["provenance_id", "stable_id"])


@query("SELECT provenance_id, md5(signature) AS signature, count(*) AS n FROM raw_relationships WHERE signature IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_signatures(spark: SparkSession, d: str) -> DataFrame:
    found = canonical.duplicates(relationships(spark, d), ["provenance_id", "signature"])
    return found.withColumn("signature", F.md5("signature"))


@query("""WITH refs AS (SELECT provenance_id, from_id AS stable_id, 'from' AS endpoint FROM raw_relationships UNION ALL SELECT provenance_id, to_id, 'to' FROM raw_relationships)
SELECT provenance_id, stable_id, endpoint, count(*) AS reference_count FROM refs r WHERE stable_id IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM raw_entities e WHERE e.provenance_id = r.provenance_id AND e.stable_id = r.stable_id)
GROUP BY ALL ORDER BY reference_count DESC, stable_id, endpoint, provenance_id LIMIT 20""")
def missing_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return canonical.missing_endpoints(relationships(spark, d), entities(spark, d))


@query("""SELECT 'rawEntities' AS name, (SELECT count(*) FROM raw_entities) AS value UNION ALL
SELECT 'rawRelationships', (SELECT count(*) FROM raw_relationships) UNION ALL
SELECT 'canonicalEntities', (SELECT count(*) FROM (SELECT DISTINCT provenance_id, stable_id FROM raw_entities WHERE stable_id IS NOT NULL)) UNION ALL
SELECT 'canonicalRelationships', (SELECT count(*) FROM (SELECT DISTINCT provenance_id, signature FROM raw_relationships WHERE signature IS NOT NULL))""")
def staging_stats(spark: SparkSession, d: str) -> DataFrame:
    return canonical.staging_stats(entities(spark, d), relationships(spark, d))


@query("""WITH s AS (SELECT rel_type, signature, from_id || chr(0) || rel_type || chr(0) || to_id || CASE WHEN json_extract_string(props_json, '$.producer_outcome') IN ('true', 'false')
  THEN chr(0) || 'producer_outcome=' || json_extract_string(props_json, '$.producer_outcome') ELSE '' END AS made FROM raw_relationships)
SELECT rel_type, count(*) AS n, count(*) FILTER (signature IS NULL) AS absent, count(*) FILTER (signature IS NOT NULL AND signature IS DISTINCT FROM made) AS different FROM s GROUP BY ALL""")
def signature_check(spark: SparkSession, d: str) -> DataFrame:
    """Stored signatures against those that the rows make."""
    stored = relationships(spark, d).withColumn("stored", F.col("signature"))
    made = canonical.relationship_signature(stored)
    absent = F.col("stored").isNull()
    return made.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(absent).alias("absent"), F.count_if(~absent & ~F.col("stored").eqNullSafe(F.col("signature"))).alias("different"))


@query("""SELECT id AS provenance_id, json_extract_string(metadata_json, '$.workspace') AS workspace,
row_number() OVER (PARTITION BY json_extract_string(metadata_json, '$.workspace') ORDER BY json_extract_string(metadata_json, '$.extracted_at')::TIMESTAMPTZ, id)::INTEGER AS seq FROM extraction_provenance""")
def run_order(spark: SparkSession, d: str) -> DataFrame:
    return runs(table(spark, d, "extraction_provenance"))


@query("""SELECT id AS provenance_id, (json_extract_string(metadata_json, '$.id') IS DISTINCT FROM id) AS other_id,
(SELECT count(*) FROM raw_entities e WHERE e.provenance_id = p.id) AS entities, (SELECT count(*) FROM raw_relationships r WHERE r.provenance_id = p.id) AS relationships FROM extraction_provenance p""")
def catalog_validation(spark: SparkSession, d: str) -> DataFrame:
    """Each run with whether its metadata names another id, and its numbers of rows."""
    p = table(spark, d, "extraction_provenance").select(F.col("id").alias("provenance_id"), (~F.get_json_object("metadata_json", "$.id").eqNullSafe(F.col("id"))).alias("other_id"))
    for name, df in (("entities", entities(spark, d)), ("relationships", relationships(spark, d))):
        n = df.groupBy("provenance_id").agg(F.count(F.lit(1)).alias(name))
        p = p.join(n, "provenance_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return p


@query("""SELECT provenance_id, count(*) AS n FROM (SELECT provenance_id FROM raw_entities UNION ALL SELECT provenance_id FROM raw_relationships)
WHERE provenance_id IS NULL OR provenance_id NOT IN (SELECT id FROM extraction_provenance) GROUP BY ALL""")
def provenance_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose run provenance doesn't know."""
    known = table(spark, d, "extraction_provenance").select(F.col("id").alias("provenance_id"))
    both = entities(spark, d).select("provenance_id").unionAll(relationships(spark, d).select("provenance_id"))
    return both.groupBy("provenance_id").agg(F.count(F.lit(1)).alias("n")).join(known, "provenance_id", "left_anti")


_RUNS = """runs AS (SELECT id AS provenance_id, json_extract_string(metadata_json, '$.workspace') AS workspace,
row_number() OVER (PARTITION BY json_extract_string(metadata_json, '$.workspace') ORDER BY json_extract_string(metadata_json, '$.extracted_at')::TIMESTAMPTZ, id) AS seq FROM extraction_provenance)"""


def _edges_by_run(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return relationships(spark, d).select("provenance_id", *columns).join(runs(table(spark, d, "extraction_provenance")), "provenance_id")


@query(f"""WITH {_RUNS}, e AS (SELECT workspace, seq, from_id, rel_type, to_id FROM raw_relationships JOIN runs USING (provenance_id)),
later AS (SELECT workspace, seq + 1 AS seq, from_id, rel_type, to_id FROM e), known AS (SELECT workspace, seq FROM runs WHERE seq > 1),
l AS (SELECT e.* FROM e JOIN known USING (workspace, seq)), b AS (SELECT later.* FROM later JOIN known USING (workspace, seq))
SELECT side, rel_type, count(*) AS n FROM (SELECT 'before' AS side, * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM l) UNION ALL SELECT 'after', * FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM b)) GROUP BY ALL""")
def catalog_bag_diff(spark: SparkSession, d: str) -> DataFrame:
    """Relationship rows, with repeats, that only one of two consecutive runs has, by type."""
    e = _edges_by_run(spark, d, "from_id", "rel_type", "to_id").select("workspace", "seq", "from_id", "rel_type", "to_id")
    known = runs(table(spark, d, "extraction_provenance")).filter("seq > 1").select("workspace", "seq")
    before = e.withColumn("seq", F.col("seq") + 1).join(known, ["workspace", "seq"])
    diff = relational.bag_difference(before, e.join(known, ["workspace", "seq"]))
    side = F.when(F.col("side") == "left", "before").otherwise("after")
    return diff.groupBy(side.alias("side"), "rel_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_RUNS}, s AS (SELECT DISTINCT workspace, seq, md5(signature) AS signature, rel_type FROM raw_relationships JOIN runs USING (provenance_id) WHERE signature IS NOT NULL)
SELECT r.provenance_id, s.rel_type, count(*) AS added FROM s JOIN runs r USING (workspace, seq) WHERE s.seq > 1
AND NOT EXISTS (SELECT 1 FROM s b WHERE b.workspace = s.workspace AND b.seq = s.seq - 1 AND b.signature = s.signature) GROUP BY ALL""")
def added_by_rel_type(spark: SparkSession, d: str) -> DataFrame:
    """New signatures of each run against the run before, by type."""
    e = _edges_by_run(spark, d, "signature", "rel_type").filter("signature is not null").distinct()
    before = e.select("workspace", (F.col("seq") + 1).alias("seq"), "signature")
    new = e.filter("seq > 1").join(before, ["workspace", "seq", "signature"], "left_anti")
    return new.groupBy("provenance_id", "rel_type").agg(F.count(F.lit(1)).alias("added"))


@query(f"""WITH {_RUNS}, n AS (SELECT workspace, seq, stable_id, array_to_string(list_sort(list_distinct(flatten(list(coalesce(labels, []))))), ',') AS labels FROM raw_entities JOIN runs USING (provenance_id) GROUP BY ALL)
SELECT coalesce(a.workspace, b.workspace) AS workspace, coalesce(a.seq + 1, b.seq) AS seq, coalesce(a.stable_id, b.stable_id) AS stable_id,
CASE WHEN a.stable_id IS NULL THEN 'added' WHEN b.stable_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM n a FULL JOIN n b ON a.workspace = b.workspace AND a.seq + 1 = b.seq AND a.stable_id = b.stable_id
JOIN runs r ON r.workspace = coalesce(a.workspace, b.workspace) AND r.seq = coalesce(a.seq + 1, b.seq)
WHERE r.seq > 1 AND a.labels IS DISTINCT FROM b.labels""")
def label_changes(spark: SparkSession, d: str) -> DataFrame:
    """Entities added, removed or differently labelled, between consecutive runs, by a full join."""
    known = runs(table(spark, d, "extraction_provenance"))
    rows = entities(spark, d).join(known, "provenance_id").select("workspace", "seq", "stable_id", F.explode_outer("labels").alias("label"))
    n = rows.groupBy("workspace", "seq", "stable_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    later = known.filter("seq > 1").select("workspace", "seq")
    before = n.withColumn("seq", F.col("seq") + 1).join(later, ["workspace", "seq"], "left_semi")
    return relational.changes_between(before, n.filter("seq > 1"), ["workspace", "seq", "stable_id"], ["labels"])


@query(f"""WITH {_RUNS} SELECT r.workspace, count(DISTINCT e.stable_id) AS ids, count(*) AS rows FROM raw_entities e JOIN runs r USING (provenance_id)
WHERE r.seq = (SELECT max(seq) FROM runs x WHERE x.workspace = r.workspace) GROUP BY ALL""")
def latest_snapshot_sizes(spark: SparkSession, d: str) -> DataFrame:
    known = runs(table(spark, d, "extraction_provenance"))
    last = relational.latest_by_key(known, ["workspace"], ["seq"], ["provenance_id"])
    rows = entities(spark, d).join(last, "provenance_id")
    return rows.groupBy("workspace").agg(F.count_distinct("stable_id").alias("ids"), F.count(F.lit(1)).alias("rows"))
