"""Named queries of projections, joins, aggregates, windows and rules over the graph tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.functions.ids import coordinate, normalize_id
from ashlar.operators import classification as cl
from ashlar.operators import relational as rel
from ashlar.runtime import materialize
from ashlar.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Keys of ``props_json`` that become columns, with their aliases in order.
PROMOTED = {"name": ("name", "label"), "file": ("repoRelativePath", "repo_relative_path"), "declaration_kind": ("declarationKind",), "annotation_kind": ("annotationKind",), "source_coverage": ("sourceCoverage",), "lines": ("lineCount", "line-count"), "key": ("storeKey",)}


def _path(k: str) -> str:
    return f"$['{k}']" if "-" in k else f"$.{k}"


def promoted(entities: DataFrame) -> DataFrame:
    """One row for each entity of a run with its hot keys as columns (the last non-null value) and its labels."""
    rows = entities.filter("stable_id is not null").select(
        "provenance_id", "stable_id", "ordinal", "labels", *[F.coalesce(*[F.get_json_object("props_json", _path(k)) for k in ks]).alias(c) for c, ks in PROMOTED.items()]
    )
    keys = ["provenance_id", "stable_id"]
    facts = rows.groupBy(*keys).agg(*[rel.nonnull_last(c, "ordinal").alias(c) for c in PROMOTED], F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.filter(F.coalesce("labels", F.array().cast("array<string>")), lambda x: x.isNotNull()))))).alias("labels"))
    return facts


_PROMOTED = "n AS (SELECT provenance_id, stable_id, list_sort(list_distinct(flatten(list(coalesce(labels, []))))) AS labels, " + ", ".join(
    "arg_max({0}, ordinal) FILTER ({0} IS NOT NULL) AS {1}".format("coalesce(" + ", ".join(f"json_extract_string(props_json, '$.\"{k}\"')" for k in ks) + ")", c) for c, ks in PROMOTED.items()
) + " FROM raw_entities WHERE stable_id IS NOT NULL GROUP BY provenance_id, stable_id)"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return promoted(table(spark, d, "raw_entities"))


def rels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_relationships")


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _array(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"WITH {_PROMOTED} SELECT provenance_id, stable_id, array_to_string(labels, ',') AS labels, {', '.join(PROMOTED)} FROM n")
def promoted_nodes(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).withColumn("labels", F.array_join("labels", ","))


@query(f"""WITH {_PROMOTED} SELECT provenance_id, count(*) AS n, count(*) FILTER (list_contains(labels, 'Step')) AS steps, count(*) FILTER (list_has_any(labels, ['Fn', 'LocalFn'])) AS functions,
count(*) FILTER (list_has_all(labels, ['Annotatable', 'VisualProxy'])) AS proxies FROM n GROUP BY ALL""")
def label_membership(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).groupBy("provenance_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("labels", "Step")).alias("steps"), F.count_if(cl.has_any("labels", ["Fn", "LocalFn"])).alias("functions"), F.count_if(cl.has_all("labels", ["Annotatable", "VisualProxy"])).alias("proxies")
    )


_AT = r"regexp_extract(replace({0}, '\', '/'), '^(.*):([0-9]+):([0-9]+):([0-9]+):([0-9]+)(:.*)?$', {1})"


@query("WITH c AS (SELECT DISTINCT " + ", ".join(f"{_AT.format(c, i)} AS {n}_{k}" for n, c in (("a", "from_id"), ("b", "to_id")) for i, k in ((1, "p"), (2, "sl"), (3, "sc"), (4, "el"), (5, "ec"))) + """, from_id, to_id, provenance_id FROM raw_relationships WHERE rel_type = 'AST_CHILD' AND from_id IS NOT NULL AND to_id IS NOT NULL)
SELECT provenance_id, count(*) AS links, count(*) FILTER (a_p = b_p) AS same_file, count(*) FILTER (a_p = b_p AND (b_sl::BIGINT, b_sc::BIGINT) >= (a_sl::BIGINT, a_sc::BIGINT) AND (b_el::BIGINT, b_ec::BIGINT) <= (a_el::BIGINT, a_ec::BIGINT)) AS inside FROM c WHERE a_p <> '' AND b_p <> '' GROUP BY ALL""")
def coordinate_containment(spark: SparkSession, d: str) -> DataFrame:
    """How many syntax children lie inside their parent's range of the same file."""
    r = rels(spark, d).filter("rel_type = 'AST_CHILD' and from_id is not null and to_id is not null").select("provenance_id", "from_id", "to_id").distinct()
    c = r.select("provenance_id", coordinate("from_id").alias("a"), coordinate("to_id").alias("b")).filter("a is not null and b is not null")
    same = F.col("a.path") == F.col("b.path")
    inside = same & (F.struct("b.start_line", "b.start_col") >= F.struct("a.start_line", "a.start_col")) & (F.struct("b.end_line", "b.end_col") <= F.struct("a.end_line", "a.end_col"))
    return c.groupBy("provenance_id").agg(F.count(F.lit(1)).alias("links"), F.count_if(same).alias("same_file"), F.count_if(inside).alias("inside"))


def _case(pairs, otherwise="NULL", labels="labels"):
    return "CASE " + " ".join(f"WHEN list_contains({labels}, '{a}') THEN '{b}'" for a, b in pairs) + f" ELSE {otherwise} END"


def _when(pairs, labels="labels"):
    return " ".join(f"WHEN list_contains({labels}, '{a}') THEN '{b}'" for a, b in pairs)


@query(f"""WITH {_PROMOTED}, k AS (SELECT labels AS l, nullif(annotation_kind, '') AS own FROM n) SELECT kind, count(*) AS n FROM (SELECT CASE WHEN list_has_any(l, {_array(cl.HIDDEN)}) THEN NULL
WHEN own IN {_list(cl.OWN_KINDS)} THEN own WHEN list_has_any(l, {_array(cl.TYPE_LABELS)}) AND NOT list_has_any(l, {_array(cl.CODE_LABELS)}) THEN NULL {_when(cl.STRONG_KINDS, "l")}
WHEN list_contains(l, '{cl.DEFINED}') AND list_has_any(l, {_array(cl.DEFINED_LABELS)}) THEN 'FunctionalEntity' {_when(cl.STRONG_KINDS_AFTER_OWN_WORK, "l")}
WHEN own IS NOT NULL THEN own WHEN list_has_all(l, {_array(cl.FLOW_BLOCK)}) THEN 'FlowBlock' {_when(cl.WEAK_KINDS, "l")} END AS kind FROM k) GROUP BY ALL""")
def annotation_kinds(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).groupBy(cl.kind_of("labels", "annotation_kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH r AS (SELECT rel_type, count(*) AS n FROM raw_relationships GROUP BY ALL), x AS (SELECT *, array_to_string(list_filter([{', '.join(f"CASE WHEN rel_type IN {_list(k)} THEN '{r}' END" for r, k in cl.ROLES.items())}], lambda x: x IS NOT NULL), ',') AS roles FROM r)
SELECT rel_type, n, CASE WHEN roles = '' THEN 'Data' ELSE roles END AS roles, CASE rel_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in cl.CONTROL.items())} END AS control_kind FROM x""")
def edge_role_inventory(spark: SparkSession, d: str) -> DataFrame:
    n = rels(spark, d).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select("rel_type", "n", F.array_join(cl.edge_roles("rel_type"), ",").alias("roles"), cl.role_kind("rel_type", "Control").alias("control_kind"))


@query(f"""WITH p(rel_type, annotation_use, flow_traversal, flow_visible, flow_composition, functional_visible) AS (VALUES {', '.join('(' + ', '.join(repr(v) if isinstance(v, str) else 'NULL' if v is None else str(v).lower() for v in (t, *x)) + ')' for t, x in cl.POLICY.items())})
SELECT r.rel_type, count(*) AS n, any_value(p.annotation_use) AS annotation_use, coalesce(bool_or(p.flow_traversal), true) AS flow_traversal, coalesce(bool_or(p.flow_visible), true) AS flow_visible,
coalesce(bool_or(p.flow_composition), false) AS flow_composition, coalesce(bool_or(p.functional_visible), true) AS functional_visible FROM raw_relationships r LEFT JOIN p USING (rel_type) GROUP BY ALL""")
def relationship_policies(spark: SparkSession, d: str) -> DataFrame:
    return cl.with_policy(rels(spark, d).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n")))


@query(f"""WITH {_PROMOTED}, p AS (SELECT provenance_id, list_filter(string_split(file, '/'), lambda x: x <> '') AS s FROM n WHERE file IS NOT NULL)
SELECT provenance_id, array_to_string((CASE WHEN len(s) <= 1 THEN s ELSE s[:len(s) - 1] END)[:3], '/') AS surface, count(*) AS n FROM p GROUP BY ALL""")
def module_surfaces(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).filter("file is not null").groupBy("provenance_id", cl.folder_surface("file").alias("surface")).agg(F.count(F.lit(1)).alias("n"))


_SPEC = "regexp_replace(split_part(stable_id, '#', 1), '^(package|external):', '')"


@query(f"""WITH s AS (SELECT DISTINCT {_SPEC} AS spec FROM raw_entities WHERE stable_id LIKE 'package:%' OR stable_id LIKE 'external:%')
SELECT spec, CASE WHEN trim(spec) = '' OR spec[1] IN ('.', '/') OR starts_with(spec, 'node:') OR (CASE WHEN spec[1] = '@' THEN spec ELSE list_filter(string_split(spec, '/'), lambda x: x <> '')[1] END) IN {_list(cl.BUILTIN)} THEN NULL
WHEN spec[1] = '@' THEN CASE WHEN len(string_split(spec, '/')) >= 2 THEN string_split(spec, '/')[1] || '/' || string_split(spec, '/')[2] END ELSE list_filter(string_split(spec, '/'), lambda x: x <> '')[1] END AS package FROM s""")
def package_names(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "raw_entities").filter(F.col("stable_id").startswith("package:") | F.col("stable_id").startswith("external:"))
    spec = F.regexp_replace(F.split("stable_id", "#")[0], "^(package|external):", "")
    return e.select(spec.alias("spec")).distinct().select("spec", cl.package_name("spec").alias("package"))


@query(f"""WITH {_PROMOTED}, s AS (SELECT provenance_id, to_id AS stable_id, count(DISTINCT from_id) AS steps FROM raw_relationships WHERE rel_type = 'NESTED_IN' AND to_id IS NOT NULL GROUP BY ALL),
f AS (SELECT provenance_id, stable_id, TRY_CAST(regexp_extract(stable_id, '^.+?:([0-9]+):[0-9]+:([0-9]+):[0-9]+$', 2) AS BIGINT) - TRY_CAST(regexp_extract(stable_id, '^.+?:([0-9]+):[0-9]+:([0-9]+):[0-9]+$', 1) AS BIGINT) + 1 AS lines, coalesce(steps, 0) AS steps FROM n LEFT JOIN s USING (provenance_id, stable_id) WHERE list_has_any(labels, ['Fn', 'LocalFn']))
SELECT *, CASE WHEN lines >= 120 OR steps >= 60 THEN 'large' ELSE 'small' END AS size_class, array_to_string(list_filter([CASE WHEN lines >= 120 THEN 'lines' END, CASE WHEN steps >= 60 THEN 'steps' END], lambda x: x IS NOT NULL), ',') AS reasons FROM f""")
def function_size_class(spark: SparkSession, d: str) -> DataFrame:
    steps = rels(spark, d).filter("rel_type = 'NESTED_IN' and to_id is not null").groupBy("provenance_id", F.col("to_id").alias("stable_id")).agg(F.count_distinct("from_id").alias("steps"))
    f = nodes(spark, d).filter(cl.has_any("labels", ["Fn", "LocalFn"])).select("provenance_id", "stable_id", coordinate("stable_id").alias("at"))
    f = f.join(steps, ["provenance_id", "stable_id"], "left").select("provenance_id", "stable_id", (F.col("at.end_line") - F.col("at.start_line") + 1).alias("lines"), F.coalesce("steps", F.lit(0)).alias("steps"), F.lit(1).alias("stages"))
    size, reasons = cl.size_class("lines", "steps", "stages")
    return f.select("provenance_id", "stable_id", "lines", "steps", size, F.array_join(reasons, ",").alias("reasons"))


@query("""SELECT stable_id, value FROM (SELECT DISTINCT stable_id, unnest(json_extract_string(props_json, '$.allowedValues[*]')) AS value FROM raw_entities WHERE json_type(props_json, '$.allowedValues') = 'ARRAY'
UNION SELECT DISTINCT stable_id, unnest(json_extract_string(props_json, '$.writers[*]')) FROM raw_entities WHERE json_type(props_json, '$.writers') = 'ARRAY') WHERE stable_id IS NOT NULL AND value IS NOT NULL""")
def list_valued_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "raw_entities").filter("stable_id is not null")
    parts = []
    for k in ("allowedValues", "writers"):
        text = F.get_json_object("props_json", f"$.{k}")
        parts.append(e.select("stable_id", text.alias("t")).filter(F.col("t").startswith("[")).select("stable_id", F.explode(cl.string_list("t")).alias("value")))
    return parts[0].union(parts[1]).filter("value is not null").distinct()


@query(f"""WITH {_PROMOTED} SELECT provenance_id, count(*) AS n FROM n WHERE contains(lower(name), 'session') OR contains(lower(file), 'session') GROUP BY ALL""")
def name_or_path_search(spark: SparkSession, d: str) -> DataFrame:
    """Entities whose name or path holds a text, whatever the case."""
    hit = F.contains(F.lower("name"), F.lit("session")) | F.contains(F.lower("file"), F.lit("session"))
    return nodes(spark, d).filter(hit).groupBy("provenance_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_PROMOTED} SELECT reason, count(*) AS n, count(DISTINCT provenance_id) AS runs FROM (SELECT *, CASE WHEN list_contains(labels, 'VisualProxy') THEN 'presentation' WHEN list_has_any(labels, ['External', 'Package']) THEN 'external'
WHEN list_has_any(labels, ['Fn', 'LocalFn']) AND source_coverage = 'complete' THEN 'callable-complete' WHEN list_has_any(labels, ['Fn', 'LocalFn']) THEN 'callable-open' WHEN list_has_any(labels, ['Step', 'FlowBlock']) THEN 'owned-part'
WHEN list_has_any(labels, ['Value', 'LiteralDomain']) THEN 'value' WHEN declaration_kind IS NOT NULL THEN 'declaration' ELSE 'unclassified' END AS reason FROM n) GROUP BY ALL""")
def first_match_classes(spark: SparkSession, d: str) -> DataFrame:
    """Entities by the first rule that holds."""
    fn = cl.has_any("labels", ["Fn", "LocalFn"])
    rules = [
        (cl.has_any("labels", ["VisualProxy"]), "presentation"), (cl.has_any("labels", ["External", "Package"]), "external"), (fn & (F.col("source_coverage") == "complete"), "callable-complete"), (fn, "callable-open"),
        (cl.has_any("labels", ["Step", "FlowBlock"]), "owned-part"), (cl.has_any("labels", ["Value", "LiteralDomain"]), "value"), (F.col("declaration_kind").isNotNull(), "declaration"),
    ]
    reason = cl.first_match(rules, "unclassified")
    return nodes(spark, d).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("provenance_id").alias("runs"))


_LABELS = "l AS (SELECT ordinal, unnest(list_distinct(labels)) AS label FROM raw_entities WHERE labels IS NOT NULL)"


@query(f"""WITH {_LABELS}, t AS (SELECT label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY ALL), p AS (SELECT a.label AS a, b.label AS b, count(*) AS together FROM l a JOIN l b ON a.ordinal = b.ordinal AND a.label < b.label GROUP BY ALL)
SELECT p.a, p.b, together, x.n AS of_a, y.n AS of_b, round(together / x.n, 9) AS coverage_a, round(together / y.n, 9) AS coverage_b, together = x.n AND together = y.n AS identical FROM p JOIN t x ON x.label = p.a JOIN t y ON y.label = p.b""")
def label_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    found = rel.co_occurrence(table(spark, d, "raw_entities", "labels").filter("labels is not null"), "labels")
    return found.withColumns({c: F.round(c, 9) for c in ("coverage_a", "coverage_b")})


@query(f"WITH {_LABELS} SELECT label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY ALL")
def label_populations(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "raw_entities", "labels").select(F.explode(F.array_distinct("labels")).alias("label"))
    return each.filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH x AS (SELECT DISTINCT unnest(labels) AS label, stable_id FROM raw_entities) SELECT label, stable_id FROM x WHERE label IS NOT NULL AND stable_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY stable_id) <= 4""")
def top_examples_per_label(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "raw_entities").select(F.explode("labels").alias("label"), "stable_id").na.drop().distinct()
    return rel.top_per_group(x, ["label"], ["stable_id"], 4)


_FILES = "regexp_replace(replace({0}, '\\', '/'), '^file:', '')"


@query(f"""WITH i AS (SELECT provenance_id, {_FILES.format('from_id')} AS f, {_FILES.format('to_id')} AS t FROM raw_relationships WHERE rel_type IN ('IMPORTS', 'REEXPORTS') AND starts_with(from_id, 'file:') AND starts_with(to_id, 'file:'))
SELECT provenance_id, regexp_extract(f, '^(.*)/[^/]*$', 1) AS from_folder, regexp_extract(t, '^(.*)/[^/]*$', 1) AS to_folder, count(*) AS imports, count(*) FILTER (f = t) AS own, count(DISTINCT f) AS files FROM i GROUP BY ALL""")
def folder_dependency_counts(spark: SparkSession, d: str) -> DataFrame:
    """Imports between folders."""
    r = rels(spark, d).filter(F.col("rel_type").isin("IMPORTS", "REEXPORTS") & F.col("from_id").startswith("file:") & F.col("to_id").startswith("file:"))
    path = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^file:", "")
    i = r.select("provenance_id", path("from_id").alias("f"), path("to_id").alias("t"))
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    g = i.groupBy("provenance_id", folder("f").alias("from_folder"), folder("t").alias("to_folder"))
    return g.agg(F.count(F.lit(1)).alias("imports"), F.count_if(F.col("f") == F.col("t")).alias("own"), F.count_distinct("f").alias("files"))


_OWN = """ev AS (SELECT provenance_id, from_id AS stable_id, to_id AS target, rel_type AS evidence, CASE rel_type WHEN 'NESTED_IN' THEN 0 WHEN 'DECLARED_IN' THEN 1 WHEN 'IN_FOLDER' THEN 2 ELSE 3 END AS tier FROM raw_relationships WHERE rel_type IN ('NESTED_IN', 'DECLARED_IN', 'IN_FOLDER', 'PARENT_FOLDER')
UNION SELECT provenance_id, to_id, from_id, rel_type, CASE rel_type WHEN 'AST_CHILD' THEN 0 ELSE 1 END FROM raw_relationships WHERE rel_type IN ('AST_CHILD', 'HAS_FLOW_BLOCK', 'HAS_MEMBER')), own AS (SELECT * FROM ev WHERE stable_id IS NOT NULL AND target IS NOT NULL AND stable_id <> target)"""


def ownership(relationships: DataFrame) -> DataFrame:
    """provenance_id, stable_id, target, evidence, tier: explicit evidence of who owns an entity, nearest tier first."""
    up = {"NESTED_IN": 0, "DECLARED_IN": 1, "IN_FOLDER": 2, "PARENT_FOLDER": 3}
    down = {"AST_CHILD": 0, "HAS_FLOW_BLOCK": 1, "HAS_MEMBER": 1}
    tier = lambda m: F.element_at(F.create_map(*[F.lit(x) for p in m.items() for x in p]), F.col("rel_type"))
    parts = [
        relationships.filter(F.col("rel_type").isin(*m)).select("provenance_id", F.col(a).alias("stable_id"), F.col(b).alias("target"), F.col("rel_type").alias("evidence"), tier(m).alias("tier"))
        for m, a, b in ((up, "from_id", "to_id"), (down, "to_id", "from_id"))
    ]
    return parts[0].union(parts[1]).na.drop().filter("stable_id <> target").distinct()


@query(f"WITH {_OWN} SELECT provenance_id, stable_id, target, evidence, tier FROM own QUALIFY tier = min(tier) OVER (PARTITION BY provenance_id, stable_id)")
def nearest_owner_tier(spark: SparkSession, d: str) -> DataFrame:
    return rel.nearest_tier(ownership(rels(spark, d)), ["provenance_id", "stable_id"], "tier")


@query(f"""WITH {_OWN} SELECT provenance_id, stable_id, array_to_string(list(DISTINCT target ORDER BY target), ',') AS owners, array_to_string(list(DISTINCT evidence ORDER BY evidence), ',') AS evidence FROM own GROUP BY ALL""")
def owner_evidence_lists(spark: SparkSession, d: str) -> DataFrame:
    sets = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return ownership(rels(spark, d)).groupBy("provenance_id", "stable_id").agg(sets("target").alias("owners"), sets("evidence").alias("evidence"))


@query(f"""WITH {_PROMOTED}, {_OWN}, o AS (SELECT provenance_id, stable_id, count(DISTINCT target) AS owners FROM own GROUP BY ALL), b AS (SELECT provenance_id, from_id AS stable_id, count(DISTINCT to_id) AS body FROM raw_relationships WHERE rel_type IN ('HAS_FLOW_BLOCK', 'RETURNS_VALUE') AND from_id <> to_id GROUP BY ALL),
s AS (SELECT provenance_id, from_id AS stable_id, count(*) FILTER (rel_type = 'HAS_MEMBER') AS members, count(*) FILTER (rel_type = 'AST_CHILD') AS children FROM raw_relationships GROUP BY ALL)
SELECT provenance_id, stable_id, coalesce(owners, 0) AS owners, coalesce(body, 0) AS body, coalesce(members, 0) AS members, coalesce(children, 0) AS children, list_has_any(labels, ['Fn', 'LocalFn']) AS definition,
CASE WHEN list_contains(labels, 'VisualProxy') AND coalesce(owners, 0) > 0 THEN 'inline' WHEN list_has_any(labels, ['Fn', 'LocalFn']) AND coalesce(body, 0) > 0 THEN 'standalone' WHEN coalesce(owners, 0) > 0 THEN 'inline' ELSE 'unresolved' END AS mode
FROM n LEFT JOIN o USING (provenance_id, stable_id) LEFT JOIN b USING (provenance_id, stable_id) LEFT JOIN s USING (provenance_id, stable_id)""")
def fact_flags_case(spark: SparkSession, d: str) -> DataFrame:
    """Facts of each entity from pre-aggregated sides, and its mode by rule."""
    keys = ["provenance_id", "stable_id"]
    r = rels(spark, d)
    owners = ownership(r).groupBy(*keys).agg(F.count_distinct("target").alias("owners"))
    body = r.filter("rel_type in ('HAS_FLOW_BLOCK', 'RETURNS_VALUE') and from_id <> to_id").groupBy("provenance_id", F.col("from_id").alias("stable_id")).agg(F.count_distinct("to_id").alias("body"))
    parts = r.filter("from_id is not null").groupBy("provenance_id", F.col("from_id").alias("stable_id")).agg(F.count_if(F.col("rel_type") == "HAS_MEMBER").alias("members"), F.count_if(F.col("rel_type") == "AST_CHILD").alias("children"))
    f = nodes(spark, d)
    for side in (owners, body, parts):
        f = f.join(side, keys, "left")
    f = f.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("owners", "body", "members", "children")})
    definition = cl.has_any("labels", ["Fn", "LocalFn"])
    mode = cl.first_match([(cl.has_any("labels", ["VisualProxy"]) & (F.col("owners") > 0), "inline"), (definition & (F.col("body") > 0), "standalone"), (F.col("owners") > 0, "inline")], "unresolved")
    return f.select(*keys, "owners", "body", "members", "children", definition.alias("definition"), mode.alias("mode"))


@query("""SELECT provenance_id, stable_id, property, value FROM (SELECT provenance_id, stable_id, ordinal, json_extract_string(props_json, '$.name') AS name, json_extract_string(props_json, '$.declarationKind') AS kind, json_extract_string(props_json, '$.role') AS role FROM raw_entities),
LATERAL (VALUES ('name', name), ('kind', kind), ('role', role)) v(property, value) WHERE value IS NOT NULL""")
def unpivot_properties(spark: SparkSession, d: str) -> DataFrame:
    get = lambda k: F.get_json_object("props_json", f"$.{k}")
    e = table(spark, d, "raw_entities").select("provenance_id", "stable_id", get("name").alias("name"), get("declarationKind").alias("kind"), get("role").alias("role"))
    return rel.unpivot(e, ["provenance_id", "stable_id"], ["name", "kind", "role"], "property", "value")


@query("""SELECT provenance_id, from_id AS stable_id, count(*) AS n FROM raw_relationships WHERE rel_type IN ('READS_FROM', 'VALUE_FROM') AND from_id <> to_id GROUP BY ALL HAVING count(DISTINCT rel_type) = 2""")
def index_consumers_having(spark: SparkSession, d: str) -> DataFrame:
    """Entities that both read and take a value."""
    r = rels(spark, d).filter("rel_type in ('READS_FROM', 'VALUE_FROM') and from_id <> to_id")
    g = r.groupBy("provenance_id", F.col("from_id").alias("stable_id")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rel_type").alias("roles"))
    return g.filter("roles = 2").drop("roles")


@query("""SELECT (SELECT count(*) FROM raw_entities e SEMI JOIN (SELECT provenance_id, stable_id FROM raw_entities GROUP BY ALL HAVING count(*) > 1) d USING (provenance_id, stable_id)) AS repeated,
(SELECT count(*) FROM raw_entities e ANTI JOIN (SELECT provenance_id, stable_id FROM raw_entities GROUP BY ALL HAVING count(*) > 1) d USING (provenance_id, stable_id)) AS single""")
def semi_anti_split(spark: SparkSession, d: str) -> DataFrame:
    from ashlar.operators.canonical import duplicates

    e = table(spark, d, "raw_entities").select("provenance_id", "stable_id")
    twice = materialize(duplicates(e, ["provenance_id", "stable_id"]).select("provenance_id", "stable_id"), "twice")
    n = lambda how, name: e.join(twice, ["provenance_id", "stable_id"], how).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(name))
    both = n("left_semi", "repeated").union(n("left_anti", "single"))
    return both.agg(F.max(F.when(F.col("side") == "repeated", F.col("n"))).alias("repeated"), F.max(F.when(F.col("side") == "single", F.col("n"))).alias("single"))


@query("""WITH s AS (SELECT provenance_id, to_id AS c, from_id AS m, json_extract_string(props_json, '$.order')::BIGINT AS i FROM raw_relationships WHERE rel_type = 'NESTED_IN' AND json_extract_string(props_json, '$.order') IS NOT NULL AND from_id IS NOT NULL AND to_id IS NOT NULL), x AS (SELECT DISTINCT * FROM s)
SELECT provenance_id, c AS container, m AS member, i AS place, (SELECT count(*) FROM x y WHERE y.provenance_id = x.provenance_id AND y.c = x.c AND y.i > x.i) AS later FROM x""")
def later_siblings(spark: SparkSession, d: str) -> DataFrame:
    """How many siblings come after each member of a container: a window instead of a join on ``>``."""
    order = F.try_to_number(F.get_json_object("props_json", "$.order"), F.lit("999999999")).cast("long")
    x = rels(spark, d).filter("rel_type = 'NESTED_IN' and from_id is not null and to_id is not null").select("provenance_id", F.col("to_id").alias("container"), F.col("from_id").alias("member"), order.alias("place")).filter("place is not null").distinct()
    from pyspark.sql import Window as W

    w = W.partitionBy("provenance_id", "container").orderBy(F.desc("place")).rangeBetween(W.unboundedPreceding, -1)
    return x.withColumn("later", F.count(F.lit(1)).over(w))


@query("""WITH r AS (SELECT ordinal, from_id, provenance_id FROM raw_relationships WHERE rel_type = 'READS_FROM' AND from_id IS NOT NULL), w AS (SELECT ordinal, from_id, provenance_id, to_id FROM raw_relationships WHERE rel_type = 'ASSIGNS_VALUE' AND from_id IS NOT NULL)
SELECT r.ordinal, (SELECT arg_max(w.to_id, w.ordinal) FROM w WHERE w.from_id = r.from_id AND w.provenance_id = r.provenance_id AND w.ordinal < r.ordinal) AS latest_to_id FROM r""")
def preceding_artifact(spark: SparkSession, d: str) -> DataFrame:
    """The last assignment of the same source before each read (as of)."""
    r = rels(spark, d).filter("from_id is not null")
    reads = r.filter("rel_type = 'READS_FROM'").select("provenance_id", "from_id", "ordinal")
    writes = r.filter("rel_type = 'ASSIGNS_VALUE'").select("provenance_id", "from_id", "ordinal", "to_id")
    return rel.latest_before(reads, writes, ["provenance_id", "from_id"], "ordinal", ["to_id"]).select("ordinal", "latest_to_id")


@query(r"""WITH p AS (SELECT DISTINCT replace(substr(stable_id, 6), '\', '/') AS file FROM raw_entities WHERE starts_with(stable_id, 'file:')), s AS (SELECT DISTINCT stable_id, regexp_extract(stable_id, '^(.*):[0-9]+:[0-9]+:[0-9]+:[0-9]+$', 1) AS file FROM raw_entities WHERE regexp_matches(stable_id, '^.*:[0-9]+:[0-9]+:[0-9]+:[0-9]+$'))
SELECT p.file, min(s.stable_id) AS stable_id FROM p LEFT JOIN s USING (file) GROUP BY ALL""")
def first_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The first entity whose id begins with each file's path."""
    e = table(spark, d, "raw_entities").select("stable_id").na.drop().distinct()
    files = e.filter(F.col("stable_id").startswith("file:")).select(F.replace(F.substring("stable_id", 6, 1 << 30), F.lit("\\"), F.lit("/")).alias("file")).distinct()
    return rel.prefix_join(files, "file", e.filter(e.stable_id.rlike(r"^.+?:\d+:\d+:\d+:\d+$")), "stable_id").select("file", "stable_id")


@query("""WITH x AS (SELECT DISTINCT provenance_id, stable_id, json_extract_string(props_json, '$.name') AS name FROM raw_entities) SELECT a.provenance_id, a.rel_type, count(*) AS n FROM (SELECT DISTINCT provenance_id, from_id, to_id, rel_type FROM raw_relationships) a
JOIN x f ON f.provenance_id = a.provenance_id AND f.stable_id = a.from_id JOIN x t ON t.provenance_id = a.provenance_id AND t.stable_id = a.to_id AND t.name = f.name GROUP BY ALL""")
def same_name_links(spark: SparkSession, d: str) -> DataFrame:
    """Links between entities of one name: a JSON value becomes a join key by projection first."""
    x = table(spark, d, "raw_entities").select("provenance_id", "stable_id", F.get_json_object("props_json", "$.name").alias("name")).distinct()
    r = rels(spark, d).select("provenance_id", "from_id", "to_id", "rel_type").distinct()
    f, t = (x.select("provenance_id", F.col("stable_id").alias(c), "name") for c in ("from_id", "to_id"))
    return r.join(f, ["provenance_id", "from_id"]).join(t, ["provenance_id", "to_id", "name"]).groupBy("provenance_id", "rel_type").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT stable_id, name FROM (SELECT DISTINCT stable_id, json_extract_string(props_json, '$.name') AS name FROM raw_entities WHERE stable_id IS NOT NULL) ORDER BY name NULLS LAST, stable_id LIMIT 50 OFFSET 100""")
def pagination_page(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "raw_entities").select("stable_id", F.get_json_object("props_json", "$.name").alias("name")).filter("stable_id is not null").distinct()
    return rel.page(e, [F.col("name").asc_nulls_last(), "stable_id"], 50, 100)


@query("""SELECT rel_type, n, true AS more FROM (SELECT rel_type, count(*) AS n FROM raw_relationships GROUP BY ALL) ORDER BY n DESC, rel_type LIMIT 10""")
def has_more_page(spark: SparkSession, d: str) -> DataFrame:
    n = rels(spark, d).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))
    return rel.with_overflow(n, [F.desc("n"), "rel_type"], 10)


@query(f"""WITH {_OWN}, n AS (SELECT DISTINCT provenance_id, stable_id FROM raw_entities) SELECT provenance_id, count(*) AS n FROM n WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.provenance_id = n.provenance_id AND o.stable_id = n.stable_id AND NOT EXISTS
(SELECT 1 FROM own p WHERE p.provenance_id = o.provenance_id AND p.stable_id = o.target)) GROUP BY ALL""")
def nested_not_exists(spark: SparkSession, d: str) -> DataFrame:
    """Entities none of whose owners is without an owner: two staged anti-joins."""
    own = materialize(ownership(rels(spark, d)), "own")
    top = own.join(own.select("provenance_id", F.col("stable_id").alias("target")).distinct(), ["provenance_id", "target"], "left_anti")
    n = table(spark, d, "raw_entities").select("provenance_id", "stable_id").distinct()
    return n.join(top, ["provenance_id", "stable_id"], "left_anti").groupBy("provenance_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH i AS (SELECT DISTINCT provenance_id, from_id AS f, to_id AS item FROM raw_relationships WHERE rel_type IN ('CALLS', 'READS_FROM') AND from_id IS NOT NULL AND to_id IS NOT NULL), k AS (SELECT provenance_id || ' ' || f AS k, item FROM i),
n AS (SELECT k, count(*) AS n FROM k GROUP BY ALL), p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM k a JOIN k b ON a.item = b.item AND a.k < b.k GROUP BY ALL)
SELECT p.a, p.b, round(c / (x.n + y.n - c), 9) AS jaccard FROM p JOIN n x ON x.k = p.a JOIN n y ON y.k = p.b WHERE c / (x.n + y.n - c) >= 0.6""")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Callables whose sets of targets overlap by 0.6 or more."""
    r = rels(spark, d).filter("rel_type in ('CALLS', 'READS_FROM') and from_id is not null and to_id is not null")
    items = r.select(F.concat_ws(" ", "provenance_id", "from_id").alias("k"), F.col("to_id").alias("item"))
    return rel.jaccard_pairs(items, "k", "item", 0.6).withColumn("jaccard", F.round("jaccard", 9))


@query("""SELECT t.rel_type, count(*) AS n, count(DISTINCT t.from_id) AS readers, count(DISTINCT t.to_id) AS targets FROM raw_relationships t JOIN (SELECT DISTINCT provenance_id, stable_id FROM raw_entities WHERE list_contains(labels, 'StorageCell')) c ON c.provenance_id = t.provenance_id AND c.stable_id = t.to_id GROUP BY ALL""")
def external_affectors(spark: SparkSession, d: str) -> DataFrame:
    """What touches storage cells, by type."""
    cells = table(spark, d, "raw_entities").filter(F.array_contains("labels", "StorageCell")).select("provenance_id", F.col("stable_id").alias("to_id")).distinct()
    return rels(spark, d).join(cells, ["provenance_id", "to_id"]).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("from_id").alias("readers"), F.count_distinct("to_id").alias("targets"))


@query("""WITH n AS (SELECT DISTINCT provenance_id || ' ' || stable_id AS node FROM raw_entities WHERE list_contains(labels, 'Folder')), e AS (SELECT provenance_id || ' ' || from_id AS f, provenance_id || ' ' || to_id AS t, rel_type FROM raw_relationships WHERE from_id IS NOT NULL AND to_id IS NOT NULL)
SELECT rel_type, count(*) FILTER (f IN (SELECT node FROM n) AND t NOT IN (SELECT node FROM n)) AS outgoing, count(*) FILTER (f NOT IN (SELECT node FROM n) AND t IN (SELECT node FROM n)) AS incoming FROM e GROUP BY ALL""")
def crossing_scope_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that cross the border of a scope (folders)."""
    scope = table(spark, d, "raw_entities").filter(F.array_contains("labels", "Folder")).select("provenance_id", F.col("stable_id").alias("id")).distinct().withColumn("_in", F.lit(True))
    e = rels(spark, d).filter("from_id is not null and to_id is not null").select("provenance_id", "from_id", "to_id", "rel_type")
    for end in ("from", "to"):
        e = e.join(scope.withColumnsRenamed({"id": f"{end}_id", "_in": f"{end}_in"}), ["provenance_id", f"{end}_id"], "left")
    a, b = (F.coalesce(f"{end}_in", F.lit(False)) for end in ("from", "to"))
    return e.groupBy("rel_type").agg(F.count_if(a & ~b).alias("outgoing"), F.count_if(~a & b).alias("incoming"))


@query("""WITH w AS (SELECT DISTINCT provenance_id || ' ' || stable_id AS n, lower(regexp_extract(json_extract_string(props_json, '$.name'), '^[a-z]+')) AS token FROM raw_entities WHERE stable_id IS NOT NULL), t AS (SELECT token, count(*) AS support FROM w WHERE length(token) >= 3 GROUP BY ALL), a AS (SELECT count(DISTINCT n) AS n FROM w)
SELECT token, support, round(support / a.n, 9) AS coverage FROM t, a WHERE support >= 2 AND support / a.n <= 0.35""")
def concept_candidates(spark: SparkSession, d: str) -> DataFrame:
    """First words of names by how many entities bear them; at least 2, at most 35 in a hundred."""
    e = table(spark, d, "raw_entities").filter("stable_id is not null")
    w = e.select(F.concat_ws(" ", "provenance_id", "stable_id").alias("n"), F.lower(F.regexp_extract(F.get_json_object("props_json", "$.name"), "^[a-z]+", 0)).alias("token")).distinct()
    total = w.agg(F.count_distinct("n")).first()[0] or 1
    t = w.filter(F.length("token") >= 3).groupBy("token").agg(F.count(F.lit(1)).alias("support"))
    share = F.col("support") / total
    return t.filter((F.col("support") >= 2) & (share <= 0.35)).withColumn("coverage", F.round(share, 9))


@query("""WITH want(rel_type, least) AS (VALUES ('CALLS', 1), ('AST_CHILD', 1), ('THROWS', 1), ('NESTED_IN', 1000000000)), have AS (SELECT rel_type, count(*) AS n FROM raw_relationships GROUP BY ALL)
SELECT want.rel_type, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n < least THEN 'short' ELSE 'ok' END AS state FROM want LEFT JOIN have USING (rel_type)""")
def golden_scenario_check(spark: SparkSession, d: str) -> DataFrame:
    """Expected types against those there are."""
    want = spark.createDataFrame([("CALLS", 1), ("AST_CHILD", 1), ("THROWS", 1), ("NESTED_IN", 1_000_000_000)], "rel_type string, least long")
    have = rels(spark, d).groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") < F.col("least"), "short").otherwise("ok")
    return F.broadcast(want).join(have, "rel_type", "left").select("rel_type", F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


@query("""WITH b AS (SELECT DISTINCT provenance_id, from_id AS owner, to_id AS part FROM raw_relationships WHERE rel_type = 'HAS_FLOW_BLOCK' AND from_id IS NOT NULL AND to_id IS NOT NULL), m AS (SELECT provenance_id, from_id AS owner, min(to_id) AS primary_part FROM raw_relationships WHERE rel_type = 'RETURNS_VALUE' AND from_id IS NOT NULL AND to_id IS NOT NULL GROUP BY ALL),
a AS (SELECT provenance_id, owner, part, 1 AS k FROM b UNION SELECT provenance_id, owner, primary_part, 0 FROM m WHERE (provenance_id, owner) IN (SELECT (provenance_id, owner) FROM b)) SELECT provenance_id, owner, array_to_string(list(part ORDER BY k, part), ',') AS parts FROM a GROUP BY ALL""")
def composition_parts(spark: SparkSession, d: str) -> DataFrame:
    """Ordered parts of each owner, its primary part first."""
    r = rels(spark, d).filter("from_id is not null and to_id is not null")
    blocks = r.filter("rel_type = 'HAS_FLOW_BLOCK'").select("provenance_id", F.col("from_id").alias("owner"), F.lit(1).alias("k"), F.col("to_id").alias("part")).distinct()
    first = r.filter("rel_type = 'RETURNS_VALUE'").groupBy("provenance_id", F.col("from_id").alias("owner")).agg(F.min("to_id").alias("part"))
    first = first.join(blocks, ["provenance_id", "owner"], "left_semi").select("provenance_id", "owner", F.lit(0).alias("k"), "part")
    g = blocks.union(first).groupBy("provenance_id", "owner").agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("p"))
    return g.select("provenance_id", "owner", F.array_join("p.part", ",").alias("parts"))


@query(r"""WITH s AS (SELECT provenance_id, to_id AS owner, list(DISTINCT json_extract_string(props_json, '$.order')::BIGINT) AS places FROM raw_relationships WHERE rel_type = 'DECLARED_IN' AND json_extract_string(props_json, '$.order') IS NOT NULL AND to_id IS NOT NULL GROUP BY ALL)
SELECT provenance_id, owner, len(places) AS parts, list_max(places) - list_min(places) + 1 = len(places) AS contiguous FROM s""")
def contiguous_parts(spark: SparkSession, d: str) -> DataFrame:
    """Whether the places of an owner's parts have no gap."""
    order = F.try_to_number(F.get_json_object("props_json", "$.order"), F.lit("999999999")).cast("long")
    r = rels(spark, d).filter("rel_type = 'DECLARED_IN' and to_id is not null").select("provenance_id", F.col("to_id").alias("owner"), order.alias("i")).filter("i is not null")
    g = r.groupBy("provenance_id", "owner").agg(F.count_distinct("i").alias("parts"), (F.max("i") - F.min("i") + 1).alias("span"))
    return g.select("provenance_id", "owner", "parts", (F.col("span") == F.col("parts")).alias("contiguous"))


@query(f"""WITH n AS (SELECT DISTINCT provenance_id, stable_id FROM raw_entities WHERE list_contains(labels, 'UiSurface')), r AS (SELECT DISTINCT provenance_id, from_id, to_id, rel_type FROM raw_relationships WHERE from_id IS NOT NULL AND to_id IS NOT NULL)
SELECT provenance_id, stable_id, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming, count(DISTINCT other) AS neighbours FROM (SELECT r.provenance_id, r.from_id AS stable_id, 1 AS o, 0 AS i, r.to_id AS other FROM r SEMI JOIN n ON n.provenance_id = r.provenance_id AND n.stable_id = r.from_id
UNION ALL SELECT r.provenance_id, r.to_id, 0, 1, r.from_id FROM r SEMI JOIN n ON n.provenance_id = r.provenance_id AND n.stable_id = r.to_id) GROUP BY ALL""")
def one_hop_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Edges out of and into each interface surface."""
    n = table(spark, d, "raw_entities").filter(F.array_contains("labels", "UiSurface")).select("provenance_id", "stable_id").distinct()
    r = rels(spark, d).filter("from_id is not null and to_id is not null").select("provenance_id", "from_id", "to_id", "rel_type").distinct()
    out = r.select("provenance_id", F.col("from_id").alias("stable_id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("to_id").alias("other"))
    into = r.select("provenance_id", F.col("to_id"), F.lit(0), F.lit(1), F.col("from_id"))
    both = out.union(into).join(n, ["provenance_id", "stable_id"], "left_semi")
    return both.groupBy("provenance_id", "stable_id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"), F.count_distinct("other").alias("neighbours"))
