"""Named queries of evidence, transitions between runs, similarity and reports, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.functions.ids import coordinate
from ashlar.operators import evidence as ev
from ashlar.operators import levels, relational
from ashlar.plans.graph_queries import _CLOSE, _DEPS, _E, _LABEL, _links, edges, labelled, nodes
from ashlar.plans.graph_queries import _LINKS as _LINK_SQL
from ashlar.plans.relational_queries import _OWN, _PROMOTED, ownership, promoted
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


_RUNS = """runs AS (SELECT id AS provenance_id, json_extract_string(metadata_json, '$.workspace') AS workspace,
row_number() OVER (PARTITION BY json_extract_string(metadata_json, '$.workspace') ORDER BY json_extract_string(metadata_json, '$.extracted_at')::TIMESTAMPTZ, id) AS seq FROM extraction_provenance)"""


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "raw_entities"), table(spark, d, "raw_relationships")


def _known_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs(table(spark, d, "extraction_provenance"))


@query("""SELECT DISTINCT r.provenance_id, r.from_id AS stable_id FROM raw_relationships r WHERE rel_type IN ('CALLS', 'READS_FROM') AND from_id <> to_id AND json_extract_string(props_json, '$.context_only') IN ('true')
AND EXISTS (SELECT 1 FROM raw_entities e WHERE e.provenance_id = r.provenance_id AND e.stable_id = r.from_id AND list_has_any(e.labels, ['Fn', 'LocalFn']))""")
def context_only_callers(spark: SparkSession, d: str) -> DataFrame:
    e, r = _tables(spark, d)
    return ev.relation_evidence(r, e, ["CALLS", "READS_FROM"], ["Fn", "LocalFn"], {"context_only": ["true"]})


@query("""SELECT provenance_id, from_id AS stable_id FROM raw_relationships WHERE rel_type = 'CALLS' AND from_id <> to_id AND json_extract_string(props_json, '$.context_only') IN ('true', 'false')
GROUP BY ALL HAVING count(DISTINCT json_extract_string(props_json, '$.context_only')) = 2""")
def callers_of_both_kinds(spark: SparkSession, d: str) -> DataFrame:
    e, r = _tables(spark, d)
    return ev.relation_evidence(r, e, ["CALLS"], None, {"context_only": ["true", "false"]}, every="context_only")


_OWNERS = f"{_OWN}, o AS (SELECT DISTINCT provenance_id || ' ' || stable_id AS node, provenance_id || ' ' || target AS owner FROM own WHERE evidence IN ('NESTED_IN', 'DECLARED_IN', 'HAS_FLOW_BLOCK'))"


@query(f"""WITH RECURSIVE {_OWNERS}, c AS (SELECT node AS src, owner AS dst FROM o UNION SELECT c.src, o.owner FROM c JOIN o ON o.node = c.dst)
SELECT node, owner FROM o WHERE NOT EXISTS (SELECT 1 FROM o p JOIN c ON c.src = p.owner WHERE p.node = o.node AND c.dst = o.owner)""")
def innermost_owners(spark: SparkSession, d: str) -> DataFrame:
    own = ownership(table(spark, d, "raw_relationships")).filter("evidence in ('NESTED_IN', 'DECLARED_IN', 'HAS_FLOW_BLOCK')")
    return ev.innermost(own.select(F.concat_ws(" ", "provenance_id", "stable_id").alias("node"), F.concat_ws(" ", "provenance_id", "target").alias("owner")).distinct())


_ID = "regexp_extract(stable_id, '^(.*):([0-9]+):([0-9]+):([0-9]+):([0-9]+)$', {0})"


@query(f"""WITH x AS (SELECT DISTINCT provenance_id, stable_id, {_ID.format(1)} AS file, TRY_CAST({_ID.format(2)} AS BIGINT) AS a, TRY_CAST({_ID.format(4)} AS BIGINT) AS b, list_contains(labels, 'Fn') AS fn, list_contains(labels, 'Step') AS step FROM raw_entities WHERE {_ID.format(1)} <> ''),
f AS (SELECT DISTINCT provenance_id, stable_id, file, a, b FROM x WHERE fn), s AS (SELECT DISTINCT provenance_id, stable_id, file, a FROM x WHERE step)
SELECT f.provenance_id, f.stable_id, count(*) AS steps, min(s.a) AS first_line, max(s.a) AS last_line FROM f JOIN s ON s.provenance_id = f.provenance_id AND s.file = f.file AND s.a BETWEEN f.a AND f.b GROUP BY ALL""")
def steps_in_function_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Steps that begin inside each function's lines."""
    e = table(spark, d, "raw_entities").filter("stable_id is not null").withColumn("at", coordinate("stable_id")).filter("at is not null and at.suffix is null")
    base = e.select("provenance_id", "stable_id", "labels", F.col("at.path").alias("file"), F.col("at.start_line").alias("a"), F.col("at.end_line").alias("b"))
    f = base.filter(F.array_contains("labels", "Fn")).select("provenance_id", "file", "stable_id", F.col("a").alias("first"), F.col("b").alias("last")).distinct()
    s = base.filter(F.array_contains("labels", "Step")).select("provenance_id", "file", F.col("stable_id").alias("step"), "a").distinct()
    joined = ev.interval_join(s, f, ["provenance_id", "file"], "a", "first", "last")
    return joined.groupBy("provenance_id", "stable_id").agg(F.count(F.lit(1)).alias("steps"), F.min("a").alias("first_line"), F.max("a").alias("last_line"))


_FEATURES = """f AS (SELECT DISTINCT provenance_id || ' ' || from_id AS key, CASE WHEN rel_type = 'CALLS' THEN 'fn' WHEN rel_type = 'READS_FROM' THEN 'store' ELSE 'type' END AS kind, to_id AS item FROM raw_relationships
WHERE rel_type IN ('CALLS', 'READS_FROM', 'TYPED_AS') AND from_id IS NOT NULL AND to_id IS NOT NULL)"""
_WEIGHTS = {"fn": 0.5, "store": 0.3, "type": 0.2}


def _features(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_relationships").filter("rel_type in ('CALLS', 'READS_FROM', 'TYPED_AS') and from_id is not null and to_id is not null")
    kind = F.when(F.col("rel_type") == "CALLS", "fn").when(F.col("rel_type") == "READS_FROM", "store").otherwise("type")
    return r.select(F.concat_ws(" ", "provenance_id", "from_id").alias("key"), kind.alias("kind"), F.col("to_id").alias("item")).distinct()


@query(f"""WITH {_FEATURES}, n AS (SELECT key, kind, count(*) AS n FROM f GROUP BY ALL), s AS (SELECT a.key AS a, b.key AS b, kind, count(*) AS k FROM f a JOIN f b USING (kind, item) WHERE a.key < b.key GROUP BY ALL),
w(kind, weight) AS (VALUES ('fn', 0.5::DOUBLE), ('store', 0.3::DOUBLE), ('type', 0.2::DOUBLE)) SELECT s.a, s.b, round(sum(weight * k / (x.n + y.n - k)), 6) AS score FROM s JOIN w USING (kind) JOIN n x ON x.key = s.a AND x.kind = s.kind JOIN n y ON y.key = s.b AND y.kind = s.kind
GROUP BY s.a, s.b HAVING sum(weight * k / (x.n + y.n - k)) >= 0.45 - 1e-12""")
def weighted_similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ev.weighted_similarity(_features(spark, d), _WEIGHTS, 0.45).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE p AS ({ORACLE_SQL["weighted_similarity_pairs"].replace("WITH ", "WITH ", 1)}), {_FEATURES}, u AS (SELECT a, b FROM p UNION SELECT b, a FROM p), w AS (SELECT DISTINCT key AS node, key AS other FROM f UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.other) SELECT node, min(other) AS component FROM w GROUP BY ALL""")
def similarity_components(spark: SparkSession, d: str) -> DataFrame:
    return ev.similarity_components(_features(spark, d), _WEIGHTS, 0.45)


@query(f"""WITH RECURSIVE {_E}, {_DEPS}, {_LABEL.format('s', 'UiSurface')}, {_LABEL.format('t', 'StorageCell')}, fw AS (SELECT node FROM s UNION SELECT deps.dst FROM fw JOIN deps ON deps.src = fw.node), bw AS (SELECT node FROM t UNION SELECT deps.src FROM bw JOIN deps ON deps.dst = bw.node),
i AS (SELECT node FROM fw INTERSECT SELECT node FROM bw) SELECT src, dst FROM deps WHERE src IN (SELECT node FROM i) AND dst IN (SELECT node FROM i)""")
def origin_slice(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies between interface surfaces and the storage they rest on."""
    deps = levels.dependency_edges(edges(spark, d))
    return ev.slice_between(deps, labelled(spark, d, "UiSurface"), labelled(spark, d, "StorageCell"))


@query(f"""WITH RECURSIVE {_CLOSE}, {_LABEL.format('x', 'External')}, late AS (SELECT DISTINCT provenance_id || ' ' || stable_id AS node FROM raw_entities WHERE stable_id IS NOT NULL AND json_extract_string(props_json, '$.sourceCoverage') = 'deferred'),
b AS (SELECT node FROM x UNION SELECT src FROM r WHERE dst IN (SELECT node FROM x)), s AS (SELECT src AS node FROM r WHERE dst IN (SELECT node FROM cyc)), l AS (SELECT node FROM late UNION SELECT src FROM r WHERE dst IN (SELECT node FROM late))
SELECT node, CASE WHEN node IN (SELECT node FROM cyc) THEN 'cyclic' WHEN node IN (SELECT node FROM b) THEN 'blocked' WHEN node IN (SELECT node FROM s) THEN 'waits-on-cycle' WHEN node IN (SELECT node FROM l) THEN 'doubtful' ELSE 'ready' END AS state FROM alln""")
def readiness_states(spark: SparkSession, d: str) -> DataFrame:
    """What stands in each entity's way: external packages block, deferred sources are doubtful."""
    deps = levels.dependency_edges(edges(spark, d))
    e = table(spark, d, "raw_entities").filter("stable_id is not null")
    late = e.filter(F.get_json_object("props_json", "$.sourceCoverage") == "deferred").select(F.concat_ws(" ", "provenance_id", "stable_id").alias("node")).distinct()
    return ev.readiness(deps, nodes(spark, d), labelled(spark, d, "External"), late)


_COVER = f"{_RUNS}, c AS (SELECT workspace, seq, stable_id, arg_max(json_extract_string(props_json, '$.sourceCoverage'), ordinal) FILTER (json_extract_string(props_json, '$.sourceCoverage') IS NOT NULL) AS coverage FROM raw_entities JOIN runs USING (provenance_id) WHERE stable_id IS NOT NULL AND source_kind = 'semantic/functionFlowGraph' GROUP BY ALL)"


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "raw_entities").filter("stable_id is not null and source_kind = 'semantic/functionFlowGraph'").join(_known_runs(spark, d), "provenance_id")
    rows = e.select("workspace", "seq", "stable_id", "ordinal", F.get_json_object("props_json", "$.sourceCoverage").alias("coverage"))
    return rows.groupBy("workspace", "seq", "stable_id").agg(relational.nonnull_last("coverage", "ordinal").alias("coverage"))


@query(f"""WITH {_COVER} SELECT a.workspace, a.seq + 1 AS seq, CASE WHEN b.stable_id IS NULL THEN 'missing' WHEN b.coverage = 'complete' AND a.coverage IS DISTINCT FROM 'complete' THEN 'expanded' WHEN b.coverage = 'deferred' THEN 'still-deferred'
WHEN b.coverage = 'complete' THEN 'complete' ELSE 'not-confirmed' END AS transition, count(*) AS n FROM c a JOIN runs r ON r.workspace = a.workspace AND r.seq = a.seq + 1 LEFT JOIN c b ON b.workspace = a.workspace AND b.seq = a.seq + 1 AND b.stable_id = a.stable_id GROUP BY ALL""")
def coverage_transitions(spark: SparkSession, d: str) -> DataFrame:
    """What became of each entity's source coverage in the next run."""
    c = _coverage(spark, d)
    later = _known_runs(spark, d).select("workspace", (F.col("seq") - 1).alias("seq"))
    after = c.select("workspace", (F.col("seq") - 1).alias("seq"), "stable_id", F.col("coverage").alias("after"), F.lit(True).alias("there"))
    both = c.join(later, ["workspace", "seq"]).join(after, ["workspace", "seq", "stable_id"], "left")
    complete = F.col("after") == "complete"
    state = F.when(F.col("there").isNull(), "missing").when(complete & ~F.col("coverage").eqNullSafe(F.lit("complete")), "expanded").when(F.col("after") == "deferred", "still-deferred").when(complete, "complete").otherwise("not-confirmed")
    return both.groupBy("workspace", (F.col("seq") + 1).alias("seq"), state.alias("transition")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_COVER}, k AS (SELECT workspace, stable_id FROM c WHERE seq = 1) SELECT r.workspace, r.seq::INTEGER AS seq, count(*) AS cohort, count(c.stable_id) AS present, count(*) FILTER (c.coverage = 'complete') AS complete FROM runs r JOIN k USING (workspace)
LEFT JOIN c ON c.workspace = r.workspace AND c.seq = r.seq AND c.stable_id = k.stable_id GROUP BY ALL""")
def cohort_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The entities of each workspace's first run, followed through its later ones."""
    c = _coverage(spark, d)
    cohort = c.filter("seq = 1").select("workspace", "stable_id")
    size = cohort.groupBy("workspace").agg(F.count(F.lit(1)).alias("cohort"))
    seen = c.join(cohort, ["workspace", "stable_id"], "left_semi").groupBy("workspace", "seq").agg(F.count(F.lit(1)).alias("present"), F.count_if(F.col("coverage") == "complete").alias("complete"))
    r = _known_runs(spark, d).select("workspace", "seq").join(size, "workspace").join(seen, ["workspace", "seq"], "left")
    return r.select("workspace", "seq", "cohort", F.coalesce("present", F.lit(0)).alias("present"), F.coalesce("complete", F.lit(0)).alias("complete"))


@query("""WITH n AS (SELECT provenance_id, stable_id, bool_or(list_contains(labels, 'External') OR list_contains(labels, 'Package')) AS ext FROM raw_entities WHERE stable_id IS NOT NULL GROUP BY ALL)
SELECT r.provenance_id, CASE WHEN r.to_id IS NULL THEN 'no-target' WHEN n.stable_id IS NULL AND starts_with(r.to_id, 'external:') THEN 'external-unknown' WHEN n.stable_id IS NULL THEN 'target-missing' WHEN n.ext THEN 'external' WHEN r.from_id = r.to_id THEN 'self' ELSE 'resolved' END AS category, count(*) AS n
FROM raw_relationships r LEFT JOIN n ON n.provenance_id = r.provenance_id AND n.stable_id = r.to_id WHERE r.rel_type IN ('USES_REFERENCE', 'RESOLVES_TO', 'ALIASES') GROUP BY ALL""")
def reference_categories(spark: SparkSession, d: str) -> DataFrame:
    e, r = _tables(spark, d)
    n = e.filter("stable_id is not null").groupBy("provenance_id", F.col("stable_id").alias("to_id")).agg(F.bool_or(F.coalesce(F.arrays_overlap("labels", F.array(F.lit("External"), F.lit("Package"))), F.lit(False))).alias("ext"))
    joined = r.filter("rel_type in ('USES_REFERENCE', 'RESOLVES_TO', 'ALIASES')").join(n, ["provenance_id", "to_id"], "left")
    lost = F.col("ext").isNull()
    category = F.when(F.col("to_id").isNull(), "no-target").when(lost & F.col("to_id").startswith("external:"), "external-unknown").when(lost, "target-missing").when(F.col("ext"), "external").when(F.col("from_id") == F.col("to_id"), "self").otherwise("resolved")
    return joined.groupBy("provenance_id", category.alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_PROMOTED}, r AS (SELECT DISTINCT provenance_id, from_id AS stable_id, rel_type, to_id FROM raw_relationships WHERE rel_type IN ('TYPED_AS', 'VALUE_FROM', 'CALLS') AND from_id IS NOT NULL AND to_id IS NOT NULL)
SELECT r.provenance_id, r.stable_id, array_to_string(list(DISTINCT to_id ORDER BY to_id) FILTER (rel_type = 'TYPED_AS'), ',') AS types, array_to_string(list(DISTINCT to_id ORDER BY to_id) FILTER (rel_type = 'VALUE_FROM'), ',') AS values_, count(DISTINCT to_id) FILTER (rel_type = 'CALLS') AS callables
FROM r SEMI JOIN n ON n.provenance_id = r.provenance_id AND n.stable_id = r.stable_id GROUP BY ALL""")
def required_contexts(spark: SparkSession, d: str) -> DataFrame:
    e, r = _tables(spark, d)
    r = r.filter("rel_type in ('TYPED_AS', 'VALUE_FROM', 'CALLS') and from_id is not null and to_id is not null").select("provenance_id", F.col("from_id").alias("stable_id"), "rel_type", "to_id").distinct()
    r = r.join(e.select("provenance_id", "stable_id").distinct(), ["provenance_id", "stable_id"], "left_semi")
    targets = lambda t: F.array_sort(F.collect_set(F.when(F.col("rel_type") == t, F.col("to_id"))))
    text = lambda t: F.nullif(F.array_join(targets(t), ","), F.lit(""))
    return r.groupBy("provenance_id", "stable_id").agg(text("TYPED_AS").alias("types"), text("VALUE_FROM").alias("values_"), F.count_distinct(F.when(F.col("rel_type") == "CALLS", F.col("to_id"))).alias("callables"))


@query(f"""WITH {_E}, {_DEPS}, p AS (SELECT a.src AS a, a.dst AS b FROM deps a JOIN deps b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst) SELECT a, b, rel_type, count(*) AS n FROM (SELECT p.a, p.b, e.rel_type FROM p JOIN e ON e.src = p.a AND e.dst = p.b
UNION ALL SELECT p.a, p.b, e.rel_type FROM p JOIN e ON e.src = p.b AND e.dst = p.a) GROUP BY ALL""")
def reciprocal_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The relationships behind each pair that needs each other: an either-way condition as two equi-joins."""
    e = edges(spark, d)
    deps = levels.dependency_edges(e)
    pairs = deps.filter("src < dst").join(deps.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"])
    one = pairs.join(e, ["src", "dst"]).select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel_type")
    other = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(e, ["src", "dst"]).select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel_type")
    return one.unionAll(other).groupBy("a", "b", "rel_type").agg(F.count(F.lit(1)).alias("n"))


_SETS = ("node_id", "parent_node_id", "session_id", "correlation_id", "kind")


@query("SELECT function_stable_id, " + ", ".join(f"count(DISTINCT {c}) AS {c}s" for c in _SETS) + ", array_to_string(list(DISTINCT kind ORDER BY kind), ',') AS kind_list FROM runtime_records WHERE function_stable_id IS NOT NULL GROUP BY ALL")
def function_family_sets(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "runtime_records").filter("function_stable_id is not null")
    return r.groupBy("function_stable_id").agg(*[F.count_distinct(c).alias(f"{c}s") for c in _SETS], F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kind_list"))


@query("""SELECT provenance_id, from_id AS stable_id, count(*) FILTER (rel_type = 'READS_FROM') AS reads, count(*) FILTER (rel_type = 'ASSIGNS_VALUE') AS writes, count(*) FILTER (rel_type = 'CAPTURES_VALUE') AS captures, arg_max(rel_type, ordinal) AS last_effect
FROM raw_relationships WHERE rel_type IN ('READS_FROM', 'ASSIGNS_VALUE', 'CAPTURES_VALUE') AND from_id IS NOT NULL GROUP BY ALL""")
def state_effects(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "raw_relationships").filter("rel_type in ('READS_FROM', 'ASSIGNS_VALUE', 'CAPTURES_VALUE') and from_id is not null")
    n = lambda t, name: F.count_if(F.col("rel_type") == t).alias(name)
    return r.groupBy("provenance_id", F.col("from_id").alias("stable_id")).agg(n("READS_FROM", "reads"), n("ASSIGNS_VALUE", "writes"), n("CAPTURES_VALUE", "captures"), F.max_by("rel_type", "ordinal").alias("last_effect"))


#: Words that say nothing about a name.
STOP_WORDS = ("the", "and", "for", "with", "from", "get", "set", "use")


@query(f"""WITH t AS (SELECT provenance_id, unnest(list_distinct(string_split(lower(regexp_replace(json_extract_string(props_json, '$.name'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), ' '))) AS token FROM raw_entities WHERE json_extract_string(props_json, '$.name') IS NOT NULL)
SELECT token, count(*) AS n FROM t WHERE length(token) >= 3 AND token NOT IN {STOP_WORDS} GROUP BY ALL""")
def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Parts of camel-case names by how many rows bear them."""
    name = F.get_json_object("props_json", "$.name")
    parts = F.array_distinct(F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")), " "))
    t = table(spark, d, "raw_entities").select(F.explode(parts).alias("token"))
    return t.filter((F.length("token") >= 3) & ~F.col("token").isin(*STOP_WORDS)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT provenance_id, stable_id, json_extract_string(props_json, '$.name') AS name, json_extract_string(props_json, '$.label') AS label FROM raw_entities) SELECT CASE WHEN contains(lower(name), 'queue') AND contains(lower(stable_id), 'queue') THEN 'both' WHEN contains(lower(name), 'queue') THEN 'name-only' ELSE 'path-only' END AS evidence,
count(*) AS n, count(DISTINCT provenance_id) AS runs FROM l WHERE contains(lower(name), 'queue') OR contains(lower(stable_id), 'queue') GROUP BY ALL""")
def lexical_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Where a word is found: in the name, in the path, or in both."""
    e = table(spark, d, "raw_entities").select("provenance_id", "stable_id", F.get_json_object("props_json", "$.name").alias("name"))
    hit = lambda c: F.coalesce(F.contains(F.lower(c), F.lit("queue")), F.lit(False))
    kind = F.when(hit("name") & hit("stable_id"), "both").when(hit("name"), "name-only").otherwise("path-only")
    return e.filter(hit("name") | hit("stable_id")).groupBy(kind.alias("evidence")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("provenance_id").alias("runs"))


@query("""WITH b AS (SELECT DISTINCT provenance_id, from_id, rel_type FROM raw_relationships WHERE rel_type IN ('TRUE', 'FALSE', 'NEXT') AND from_id IS NOT NULL) SELECT provenance_id, from_id AS stable_id, array_to_string(list(rel_type ORDER BY rel_type), ',') AS outcomes FROM b GROUP BY ALL HAVING count(*) > 1""")
def branch_points(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "raw_relationships").filter("rel_type in ('TRUE', 'FALSE', 'NEXT') and from_id is not null")
    g = b.groupBy("provenance_id", F.col("from_id").alias("stable_id")).agg(F.array_sort(F.collect_set("rel_type")).alias("o"))
    return g.filter(F.size("o") > 1).select("provenance_id", "stable_id", F.array_join("o", ",").alias("outcomes"))


_TOP = r"regexp_extract(replace({0}, '\', '/'), '^(?:file:|folder:)?[^/]+/([^/:]+)', 1)"


@query(f"""SELECT provenance_id, {_TOP.format('from_id')} AS component, count(*) AS calls, count(*) FILTER ({_TOP.format('from_id')} <> {_TOP.format('to_id')}) AS crossing FROM raw_relationships WHERE rel_type = 'CALLS' AND from_id IS NOT NULL AND to_id IS NOT NULL GROUP BY ALL""")
def cross_component_calls(spark: SparkSession, d: str) -> DataFrame:
    top = lambda c: F.regexp_extract(F.replace(c, F.lit("\\"), F.lit("/")), "^(?:file:|folder:)?[^/]+/([^/:]+)", 1)
    r = table(spark, d, "raw_relationships").filter("rel_type = 'CALLS' and from_id is not null and to_id is not null")
    return r.groupBy("provenance_id", top("from_id").alias("component")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(top("from_id") != top("to_id")).alias("crossing"))


@query("""SELECT subject_stable_id, arg_max(doc_id, (noted_at, doc_id)) AS doc_id, max(noted_at) AS noted_at, count(*) AS notes FROM documents WHERE subject_stable_id IS NOT NULL AND noted_at IS NOT NULL GROUP BY ALL""")
def newest_note_per_subject(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "subject_stable_id", "noted_at").na.drop()
    last = docs.groupBy("subject_stable_id").agg(F.max(F.struct("noted_at", "doc_id")).alias("l"), F.count(F.lit(1)).alias("notes"))
    return last.select("subject_stable_id", "l.doc_id", "l.noted_at", "notes")


@query(f"""WITH {_E}, d AS (SELECT provenance_id || ' ' || stable_id AS node, bool_or(list_contains(labels, 'Value')) AS v FROM raw_entities WHERE stable_id IS NOT NULL GROUP BY ALL)
SELECT rel_type, count(*) AS n, count(DISTINCT dst) AS domains FROM e SEMI JOIN (SELECT node FROM d WHERE v) k ON k.node = e.dst GROUP BY ALL""")
def finite_domain_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Relationships to values, by semi-join."""
    e = edges(spark, d).join(labelled(spark, d, "Value").withColumnRenamed("node", "dst"), "dst", "left_semi")
    return e.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("domains"))


@query(f"""WITH {_LINK_SQL}, n AS (SELECT DISTINCT provenance_id || ' ' || stable_id AS node FROM raw_entities WHERE stable_id IS NOT NULL), k AS (SELECT parent, count(DISTINCT child) AS children FROM l GROUP BY ALL)
SELECT 'parents' AS measure, count(*) AS n FROM k UNION ALL SELECT 'children', sum(children)::BIGINT FROM k UNION ALL SELECT 'lost parents', count(*) FROM k WHERE parent NOT IN (SELECT node FROM n) UNION ALL SELECT 'nodes', count(*) FROM n""")
def import_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters that an import is verified by."""
    links = _links(spark, d)
    k = links.groupBy("parent").agg(F.count_distinct("child").alias("children"))
    n = nodes(spark, d)
    lost = k.join(n.withColumnRenamed("node", "parent"), "parent", "left_anti")
    one = lambda df, name, agg=F.count(F.lit(1)): df.agg(agg.alias("n")).select(F.lit(name).alias("measure"), "n")
    return one(k, "parents").union(one(k, "children", F.sum("children"))).union(one(lost, "lost parents")).union(one(n, "nodes"))


@query(f"""WITH {_PROMOTED}, c AS (SELECT provenance_id, file, name, stable_id, CASE WHEN declaration_kind = 'function' THEN 1 WHEN declaration_kind IN ('const', 'arrow') THEN 2 WHEN list_contains(labels, 'Step') THEN 3 END AS tier FROM n WHERE name IS NOT NULL AND file IS NOT NULL)
SELECT provenance_id, file, name, stable_id, tier, count(*) OVER (PARTITION BY provenance_id, file, name) > 1 AS ambiguous FROM (SELECT * FROM c WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY provenance_id, file, name))""")
def candidate_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The best candidates for each name of a file, and whether there are several."""
    n = promoted(table(spark, d, "raw_entities")).filter("name is not null and file is not null")
    tiers = [F.col("declaration_kind") == "function", F.col("declaration_kind").isin("const", "arrow"), F.array_contains("labels", "Step")]
    return ev.best_tier(n, ["provenance_id", "file", "name"], tiers).select("provenance_id", "file", "name", "stable_id", "tier", "ambiguous")


@query("""WITH k AS (SELECT DISTINCT node_id, function_stable_id FROM runtime_records WHERE node_id IS NOT NULL AND function_stable_id IS NOT NULL), p AS (SELECT DISTINCT node_id, parent_node_id FROM runtime_records WHERE node_id IS NOT NULL AND parent_node_id IS NOT NULL AND parent_node_id IN (SELECT node_id FROM runtime_records WHERE node_id IS NOT NULL))
SELECT node_id AS from_id, 'PARENT' AS rel_type, parent_node_id AS to_id FROM p UNION ALL SELECT node_id, 'STATIC_DEF', function_stable_id FROM k WHERE function_stable_id IN (SELECT stable_id FROM raw_entities WHERE stable_id IS NOT NULL)""")
def runtime_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return ev.runtime_graph(table(spark, d, "runtime_records"), table(spark, d, "raw_entities"))[1]


@query("""WITH s AS (SELECT DISTINCT stable_id, sha256(array_to_string(list_sort(list_transform(json_keys(props_json), lambda k: k || '=' || coalesce(json_extract_string(props_json, '$."' || k || '"'), 'null'))), '|')) AS fingerprint FROM raw_entities WHERE props_json IS NOT NULL AND stable_id IS NOT NULL)
SELECT stable_id, count(*) AS versions, min(fingerprint) AS least FROM s GROUP BY ALL""")
def props_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Versions of each id's props, by a hash of their sorted fields."""
    m = F.map_entries(F.from_json("props_json", "map<string,string>"))
    text = F.array_join(F.array_sort(F.transform(m, lambda e: F.concat(e.key, F.lit("="), F.coalesce(e.value, F.lit("null"))))), "|")
    s = table(spark, d, "raw_entities").filter("props_json is not null and stable_id is not null").select("stable_id", F.sha2(text, 256).alias("fingerprint")).distinct()
    return s.groupBy("stable_id").agg(F.count(F.lit(1)).alias("versions"), F.min("fingerprint").alias("least"))
