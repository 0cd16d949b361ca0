"""The pN_ queries of the general problems: each takes (spark, folder) and reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ashlar.functions.ids import normalized_sql
from ashlar.operators import hierarchy as trees
from ashlar.operators import references, schema_drift, skew
from ashlar.operators.snapshots import snapshot_changes
from ashlar.sources.tables import table

#: The shares of a run's rows from which a key is found.
SHARES = {"from_id": 0.05, "rel_type": 0.15}


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "raw_entities"), table(spark, d, "raw_relationships"), table(spark, d, "extraction_provenance")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    e, _, p = _graph(spark, d)
    return schema_drift.drift(e, p)


def p1_scripts(spark: SparkSession, d: str) -> DataFrame:
    e, _, p = _graph(spark, d)
    return schema_drift.edit_scripts(e, p)


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    e, _, p = _graph(spark, d)
    return schema_drift.consistent_table(e, p)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.dominant_keys(table(spark, d, "raw_relationships"), SHARES)


def p2_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = skew.relationship_keys(table(spark, d, "raw_relationships"))
    return keys.select("provenance_id", "key_field", "key_value", "row_count", "distinct_neighbours", "latest.ordinal", "latest.to_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The direct orphans: the first round of the fixpoint."""
    e, r, p = _graph(spark, d)
    return references.Orphans(r, e, p).direct.select("ordinal", "endpoint", "state")


def p3_cascade(spark: SparkSession, d: str) -> DataFrame:
    e, r, p = _graph(spark, d)
    return references.Orphans(r, e, p).records()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    e, r, p = _graph(spark, d)
    return references.Orphans(r, e, p).report()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    e, _, p = _graph(spark, d)
    return snapshot_changes(e, p)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    e, r, _ = _graph(spark, d)
    return trees.parent_cycles(e, r)


def p5_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    e, r, _ = _graph(spark, d)
    return trees.hierarchy(e, r)


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    e, r, _ = _graph(spark, d)
    return trees.all_descendants(e, r)


QUERIES = {f.__name__: f for f in (p1_found, p1_scripts, p1_table, p2_found, p2_keys, p3_found, p3_cascade, p3_report, p4_found, p5_found, p5_hierarchy, p5_descendants)}

_RUNS = """runs AS (SELECT id AS provenance_id, json_extract_string(metadata_json, '$.workspace') AS workspace,
row_number() OVER (PARTITION BY json_extract_string(metadata_json, '$.workspace') ORDER BY json_extract_string(metadata_json, '$.extracted_at')::TIMESTAMPTZ, id) AS seq FROM extraction_provenance)"""
_UP, _DOWN = (f"('{"', '".join(x)}')" for x in (trees.CHILD_TO_PARENT, trees.PARENT_TO_CHILD))
_TREE = f"""n AS (SELECT DISTINCT provenance_id, {normalized_sql("stable_id")} AS id FROM raw_entities WHERE stable_id IS NOT NULL),
raw AS (SELECT DISTINCT provenance_id, CASE WHEN rel_type IN {_UP} THEN {normalized_sql("from_id")} ELSE {normalized_sql("to_id")} END AS child, CASE WHEN rel_type IN {_UP} THEN {normalized_sql("to_id")} ELSE {normalized_sql("from_id")} END AS parent
FROM raw_relationships WHERE rel_type IN {_UP} OR rel_type IN {_DOWN}), l AS (SELECT r.* FROM raw r JOIN n a ON a.provenance_id = r.provenance_id AND a.id = r.child JOIN n b ON b.provenance_id = r.provenance_id AND b.id = r.parent)"""
_WALK = f"""WITH RECURSIVE {_TREE}, w AS (SELECT provenance_id, id, id AS root, 0 AS depth, [id] AS path FROM n WHERE (provenance_id, id) NOT IN (SELECT (provenance_id, child) FROM l)
UNION ALL SELECT l.provenance_id, l.child, w.root, w.depth + 1, list_append(w.path, l.child) FROM w JOIN l ON l.provenance_id = w.provenance_id AND l.parent = w.id)"""
#: Right where each child has one parent, as in the test tables; the operators hold for several too.
ORACLE_SQL = {
    "p2_found": """WITH t AS (SELECT provenance_id, count(*) AS n FROM raw_relationships GROUP BY ALL), k AS (SELECT provenance_id, 'from_id' AS key_field, from_id AS key_value, 20 AS part FROM raw_relationships
UNION ALL SELECT provenance_id, 'rel_type', rel_type, 100 / 15.0 FROM raw_relationships)
SELECT k.provenance_id, key_field, key_value FROM k JOIN t USING (provenance_id) WHERE key_value IS NOT NULL GROUP BY k.provenance_id, key_field, key_value, part, n HAVING count(*) * part >= n""",
    "p2_keys": """WITH k AS (SELECT provenance_id, 'from_id' AS key_field, from_id AS key_value, to_id, ordinal FROM raw_relationships UNION ALL SELECT provenance_id, 'rel_type', rel_type, to_id, ordinal FROM raw_relationships)
SELECT provenance_id, key_field, key_value, count(*) AS row_count, count(DISTINCT to_id) AS distinct_neighbours, max(ordinal) AS ordinal, max_by(coalesce(to_id, chr(1)), ordinal) AS to_id_, FROM k WHERE key_value IS NOT NULL GROUP BY ALL""",
    "p3_found": f"""WITH {_RUNS}, e AS (SELECT DISTINCT workspace, seq, {normalized_sql("stable_id")} AS id FROM raw_entities JOIN runs USING (provenance_id) WHERE stable_id IS NOT NULL), s AS (SELECT workspace, id, list(seq) AS seqs FROM e GROUP BY ALL),
r AS (SELECT ordinal, workspace, seq, 'from_id' AS endpoint, {normalized_sql("from_id")} AS id FROM raw_relationships JOIN runs USING (provenance_id) UNION ALL SELECT ordinal, workspace, seq, 'to_id', {normalized_sql("to_id")} FROM raw_relationships JOIN runs USING (provenance_id))
SELECT ordinal, endpoint, CASE WHEN list_min(seqs) < seq THEN 'deleted' WHEN list_max(seqs) > seq THEN 'late' ELSE 'missing' END AS state FROM r LEFT JOIN s USING (workspace, id) WHERE id IS NOT NULL AND NOT coalesce(list_contains(seqs, seq), false)""",
    "p5_found": f"""WITH RECURSIVE {_TREE}, up AS (SELECT provenance_id, child AS origin, parent AS above FROM l UNION SELECT up.provenance_id, up.origin, l.parent FROM up JOIN l ON l.provenance_id = up.provenance_id AND l.child = up.above)
SELECT DISTINCT provenance_id, origin AS stable_id FROM up WHERE origin = above""",
    "p5_descendants": f"""WITH RECURSIVE {_TREE}, up AS (SELECT provenance_id, child AS origin, parent AS above, 1 AS steps FROM l
UNION SELECT up.provenance_id, up.origin, l.parent, steps + 1 FROM up JOIN l ON l.provenance_id = up.provenance_id AND l.child = up.above WHERE steps < 64)
SELECT provenance_id, above AS ancestor, origin AS descendant, min(steps)::INTEGER AS distance FROM up WHERE above <> origin GROUP BY ALL""",
    "p5_hierarchy": f"""{_WALK}, up AS (SELECT provenance_id, child AS origin, parent AS above FROM l UNION SELECT up.provenance_id, up.origin, l.parent FROM up JOIN l ON l.provenance_id = up.provenance_id AND l.child = up.above)
SELECT provenance_id, id AS stable_id, root, depth, path, 'tree' AS status FROM w UNION ALL
SELECT provenance_id, id, NULL, NULL, NULL, CASE WHEN (provenance_id, id) IN (SELECT (provenance_id, origin) FROM up WHERE origin = above) THEN 'cycle' ELSE 'to_cycle' END FROM n WHERE (provenance_id, id) NOT IN (SELECT (provenance_id, id) FROM w)""",
    "p3_cascade": f"""WITH RECURSIVE {_TREE.replace(" JOIN n b ON b.provenance_id = r.provenance_id AND b.id = r.parent", "")}, o AS (SELECT provenance_id, child AS id, 1 AS level FROM l WHERE (provenance_id, parent) NOT IN (SELECT (provenance_id, id) FROM n)
UNION SELECT l.provenance_id, l.child, o.level + 1 FROM o JOIN l ON l.provenance_id = o.provenance_id AND l.parent = o.id WHERE o.level < 100)
SELECT provenance_id, id AS stable_id, CASE WHEN min(level) = 1 THEN 'direct' ELSE 'inherited' END AS kind, min(level)::INTEGER AS level FROM o GROUP BY ALL""",
}
_NUM = "CASE WHEN json_type({0}) IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN CAST({0} AS DOUBLE)::VARCHAR ELSE CAST({0} AS VARCHAR) END"
#: Objects are compared to one level, which is as deep as those of the test tables are.
ORACLE_SQL["p4_found"] = f"""WITH {_RUNS}, k AS (SELECT provenance_id, stable_id, ordinal, props_json AS p, unnest(json_keys(props_json)) AS key FROM raw_entities WHERE stable_id IS NOT NULL),
v AS (SELECT provenance_id, stable_id, ordinal, key, json_extract(p, '$."' || key || '"') AS v FROM k),
c AS (SELECT provenance_id, stable_id, key, arg_max(CASE json_type(v) WHEN 'NULL' THEN '' WHEN 'OBJECT' THEN list_sort(list_transform(json_keys(v), lambda x: x || ':' || {_NUM.format("json_extract(v, '$.\"' || x || '\"')")}))::VARCHAR ELSE {_NUM.format("v")} END, ordinal) AS v FROM v GROUP BY ALL),
f AS (SELECT provenance_id, stable_id, string_agg(key || '=' || v, '|' ORDER BY key) AS props FROM c WHERE v <> '' GROUP BY ALL),
g AS (SELECT provenance_id, stable_id, list_sort(list_distinct(flatten(list(coalesce(labels, [])))))::VARCHAR AS labels FROM raw_entities WHERE stable_id IS NOT NULL GROUP BY ALL),
e AS (SELECT workspace, seq, stable_id, labels || '#' || coalesce(props, '') AS facts FROM g LEFT JOIN f USING (provenance_id, stable_id) JOIN runs USING (provenance_id))
SELECT r.provenance_id, coalesce(a.stable_id, b.stable_id) AS stable_id, CASE WHEN a.stable_id IS NULL THEN 'added' WHEN b.stable_id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM e a FULL JOIN e b ON a.workspace = b.workspace AND a.seq + 1 = b.seq AND a.stable_id = b.stable_id JOIN runs r ON r.workspace = coalesce(a.workspace, b.workspace) AND r.seq = coalesce(a.seq + 1, b.seq) WHERE r.seq > 1 AND a.facts IS DISTINCT FROM b.facts"""
ORACLE_SQL["p3_report"] = f"""SELECT provenance_id, rel_type, endpoint, state, count(*) AS n, 'reference' AS kind FROM ({ORACLE_SQL["p3_found"]}) JOIN raw_relationships USING (ordinal) GROUP BY ALL
UNION ALL SELECT provenance_id, NULL, NULL, NULL, count(*), kind FROM ({ORACLE_SQL["p3_cascade"]}) GROUP BY ALL"""
ORACLE_SQL["p2_keys"] = ORACLE_SQL["p2_keys"].replace("max_by(coalesce(to_id, chr(1)), ordinal) AS to_id_,", "nullif(max_by(coalesce(to_id, chr(1)), ordinal), chr(1)) AS to_id")
