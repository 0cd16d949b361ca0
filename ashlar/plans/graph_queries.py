"""Named queries of walks and dependency levels, each beside its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.functions.ids import normalized_sql
from ashlar.operators import levels, traversal
from ashlar.operators.canonical import merge_entities
from ashlar.operators.hierarchy import parent_links
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


def node(run: str, id_: str):
    """An entity of a run as one id."""
    return F.concat_ws(" ", run, id_)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, rel_type of all relationship rows with both ends, ids qualified by run."""
    r = table(spark, d, "raw_relationships", "provenance_id", "from_id", "to_id", "rel_type").na.drop()
    return r.select(node("provenance_id", "from_id").alias("src"), node("provenance_id", "to_id").alias("dst"), "rel_type")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "raw_entities", "provenance_id", "stable_id").na.drop()
    return e.select(node("provenance_id", "stable_id").alias("node")).distinct()


def labelled(spark: SparkSession, d: str, label: str) -> DataFrame:
    e = table(spark, d, "raw_entities", "provenance_id", "stable_id", "labels").filter(F.array_contains("labels", label) & F.col("stable_id").isNotNull())
    return e.select(node("provenance_id", "stable_id").alias("node")).distinct()


def _sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_E = "e AS (SELECT provenance_id || ' ' || from_id AS src, provenance_id || ' ' || to_id AS dst, rel_type FROM raw_relationships WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND rel_type IS NOT NULL AND provenance_id IS NOT NULL)"
_N = "n AS (SELECT DISTINCT provenance_id || ' ' || stable_id AS node FROM raw_entities WHERE stable_id IS NOT NULL)"
_DEPS = f"""deps AS (SELECT DISTINCT CASE WHEN rel_type IN {_sql_list(levels.REVERSE)} THEN dst ELSE src END AS src, CASE WHEN rel_type IN {_sql_list(levels.REVERSE)} THEN src ELSE dst END AS dst
FROM e WHERE rel_type IN {_sql_list(levels.FORWARD + levels.REVERSE)})"""
_LABEL = "{0} AS (SELECT DISTINCT provenance_id || ' ' || stable_id AS node FROM raw_entities WHERE list_contains(labels, '{1}') AND stable_id IS NOT NULL)"


@query(f"""SELECT rel_type, count(*) AS n, CASE WHEN rel_type IN {_sql_list(levels.FORWARD)} THEN 'forward' WHEN rel_type IN {_sql_list(levels.REVERSE)} THEN 'reverse'
WHEN rel_type IN {_sql_list(levels.IGNORED)} THEN 'ignored' ELSE 'unclassified' END AS disposition FROM raw_relationships GROUP BY ALL""")
def relation_inventory_policy(spark: SparkSession, d: str) -> DataFrame:
    return levels.inventory(table(spark, d, "raw_relationships"))


@query(f"WITH {_E}, {_DEPS} SELECT src, dst FROM deps")
def dependency_edges(spark: SparkSession, d: str) -> DataFrame:
    return levels.dependency_edges(edges(spark, d))


@query(f"WITH {_E}, {_DEPS} SELECT a.src AS a, a.dst AS b FROM deps a JOIN deps b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def reciprocal_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two nodes that need each other."""
    deps = levels.dependency_edges(edges(spark, d))
    back = deps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return deps.filter("src < dst").join(back, ["src", "dst"]).select(F.col("src").alias("a"), F.col("dst").alias("b"))


_CLOSE = f"""{_E}, {_DEPS}, {_N}, r AS (SELECT src, dst FROM deps UNION SELECT r.src, deps.dst FROM r JOIN deps ON deps.src = r.dst), alln AS (SELECT node FROM n UNION SELECT src FROM deps UNION SELECT dst FROM deps),
cyc AS (SELECT src AS node FROM r WHERE src = dst), comp AS (SELECT a.node, least(a.node, min(m.dst)) AS component FROM alln a LEFT JOIN (SELECT x.src, x.dst FROM r x JOIN r y ON y.src = x.dst AND y.dst = x.src) m ON m.src = a.node GROUP BY a.node)"""
_KNOWN = _sql_list(levels.FORWARD + levels.REVERSE + levels.IGNORED)


def _levels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = edges(spark, d)
    named = merge_entities(levels.named_owners(table(spark, d, "raw_entities")))
    deps = materialize(levels.dependency_edges(e).union(levels.ownership_edges(named, "provenance_id")).distinct(), "deps")
    known = levels.policy(spark)
    odd = e.join(F.broadcast(known), "rel_type", "left_anti")
    unknown = odd.select(F.col("src").alias("node")).union(odd.select("dst"))
    return deps, levels.dependency_levels(deps, nodes(spark, d), unknown)


@query(f"""WITH RECURSIVE {_CLOSE}, ce AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM deps JOIN comp a ON a.node = deps.src JOIN comp b ON b.node = deps.dst WHERE a.component <> b.component),
w AS (SELECT DISTINCT component, 0 AS level FROM comp WHERE component NOT IN (SELECT src FROM ce) UNION SELECT ce.src, w.level + 1 FROM w JOIN ce ON ce.dst = w.component), l AS (SELECT component, max(level)::INTEGER AS level FROM w GROUP BY ALL),
stuck AS (SELECT node FROM cyc UNION SELECT src FROM r WHERE dst IN (SELECT node FROM cyc)), t AS (SELECT src AS node FROM e WHERE rel_type NOT IN {_KNOWN} UNION SELECT dst FROM e WHERE rel_type NOT IN {_KNOWN} UNION SELECT deps.src FROM t JOIN deps ON deps.dst = t.node)
SELECT node, component, level AS component_level, CASE WHEN node IN (SELECT node FROM stuck) THEN -1 ELSE level END AS structural_level, node IN (SELECT node FROM cyc) AS in_cycle, node IN (SELECT node FROM t) AS unknown_dependency_semantics,
CASE WHEN node IN (SELECT node FROM cyc) THEN 'cyclic-dependency' WHEN node IN (SELECT node FROM stuck) THEN 'depends-on-cycle' ELSE 'acyclic' END AS dependency_status FROM comp JOIN l USING (component)""")
def dependency_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)[1]


@query("SELECT 'none' AS violation, 0::BIGINT AS n WHERE false")
def level_violations(spark: SparkSession, d: str) -> DataFrame:
    deps, found = _levels(spark, d)
    return levels.level_violations(deps, materialize(found, "levels"))


@query(f"""WITH RECURSIVE {_CLOSE} SELECT component, count(*) AS size FROM comp GROUP BY ALL HAVING count(*) > 1 ORDER BY size DESC, component LIMIT 10""")
def largest_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest components, as a report."""
    parts = levels.strongly_connected(levels.dependency_edges(edges(spark, d)))
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return sizes.orderBy(F.desc("size"), "component").limit(10)


@query(f"""WITH RECURSIVE {_E}, {_DEPS}, t AS (SELECT src AS node FROM e WHERE rel_type NOT IN {_sql_list(levels.FORWARD + levels.REVERSE + levels.IGNORED)}
UNION SELECT dst FROM e WHERE rel_type NOT IN {_sql_list(levels.FORWARD + levels.REVERSE + levels.IGNORED)} UNION SELECT deps.src FROM t JOIN deps ON deps.dst = t.node) SELECT node FROM t""")
def unknown_taint(spark: SparkSession, d: str) -> DataFrame:
    """Nodes at a relationship of unknown meaning, and their consumers."""
    e = edges(spark, d)
    odd = e.join(F.broadcast(levels.policy(spark)), "rel_type", "left_anti")
    start = odd.select(F.col("src").alias("node")).union(odd.select("dst"))
    consumers = levels.dependency_edges(e).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return traversal.reachable(consumers, start, keep_origin=False).select("node")


def _tpch(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies between the rows of the star schema."""
    t = lambda n: table(spark, d, n)
    id_ = lambda p, *c: F.concat_ws(":", F.lit(p), *c)
    line = id_("line", "l_orderkey", "l_linenumber")
    l = t("lineitem")  # noqa: E741
    parts = [
        l.select(line.alias("src"), id_("part", "l_partkey").alias("dst")), l.select(line, id_("supplier", "l_suppkey")), l.select(id_("order", "l_orderkey"), line),
        t("orders").select(id_("customer", "o_custkey"), id_("order", "o_orderkey")), t("customer").select(id_("customer", "c_custkey"), id_("nation", "c_nationkey")),
        t("supplier").select(id_("supplier", "s_suppkey"), id_("nation", "s_nationkey")), t("nation").select(id_("nation", "n_nationkey"), id_("region", "n_regionkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


_TPCH = """e AS (SELECT DISTINCT * FROM (SELECT 'line:' || l_orderkey || ':' || l_linenumber AS src, 'part:' || l_partkey AS dst FROM lineitem
UNION ALL SELECT 'line:' || l_orderkey || ':' || l_linenumber, 'supplier:' || l_suppkey FROM lineitem UNION ALL SELECT 'order:' || l_orderkey, 'line:' || l_orderkey || ':' || l_linenumber FROM lineitem
UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation))"""


@query(f"""WITH RECURSIVE {_TPCH}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), w AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT src FROM e)
UNION SELECT e.src, w.level + 1 FROM w JOIN e ON e.dst = w.node) SELECT node, max(level)::INTEGER AS level FROM w GROUP BY ALL""")
def dag_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of the star schema's rows, which have no cycle."""
    e = _tpch(spark, d)
    return levels.waves(e, e.select(F.col("src").alias("node")))


_LINKS = """l AS (SELECT DISTINCT provenance_id || ' ' || CASE WHEN rel_type IN ('AST_CHILD', 'HAS_FLOW_BLOCK') THEN norm(to_id) ELSE norm(from_id) END AS child,
provenance_id || ' ' || CASE WHEN rel_type IN ('AST_CHILD', 'HAS_FLOW_BLOCK') THEN norm(from_id) ELSE norm(to_id) END AS parent FROM raw_relationships
WHERE rel_type IN ('AST_CHILD', 'HAS_FLOW_BLOCK', 'PARENT_FOLDER', 'IN_FOLDER', 'DECLARED_IN', 'NESTED_IN') AND from_id IS NOT NULL AND to_id IS NOT NULL)"""
_LINKS = _LINKS.replace("norm(to_id)", normalized_sql("to_id")).replace("norm(from_id)", normalized_sql("from_id"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    r = parent_links(table(spark, d, "raw_relationships"))
    return r.select(node("provenance_id", "child").alias("child"), node("provenance_id", "parent").alias("parent")).distinct()


@query(f"""WITH RECURSIVE {_LINKS}, w AS (SELECT parent AS origin, child AS node, 1 AS depth FROM l WHERE child <> parent UNION
SELECT w.origin, l.child, w.depth + 1 FROM w JOIN l ON l.parent = w.node WHERE w.depth < 3 AND l.child <> w.origin)
SELECT origin, node, min(depth)::INTEGER AS depth FROM w GROUP BY ALL""")
def variable_length_containment(spark: SparkSession, d: str) -> DataFrame:
    """What lies one to three containment steps below each parent."""
    links = _links(spark, d)
    down = links.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    reach = traversal.reachable(down, down.select(F.col("src").alias("node")), 3)
    return reach.filter("depth > 0")


@query(f"""WITH RECURSIVE {_E}, c AS (SELECT src, dst FROM e WHERE rel_type = 'NESTED_IN' UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst AND e.rel_type = 'NESTED_IN') SELECT src, dst FROM c""")
def lexical_nesting_closure(spark: SparkSession, d: str) -> DataFrame:
    return traversal.transitive_closure(edges(spark, d).filter("rel_type = 'NESTED_IN'"))


@query(f"""WITH {_LINKS} SELECT DISTINCT parent AS node FROM l WHERE parent NOT IN (SELECT child FROM l)""")
def containment_roots(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    return links.select(F.col("parent").alias("node")).distinct().join(links.select(F.col("child").alias("node")), "node", "left_anti")


@query(f"""WITH RECURSIVE {_E}, {_LABEL.format('s', 'UiAffordance')}, f AS (SELECT DISTINCT src, dst FROM e WHERE rel_type IN ('CALLS', 'READS_FROM', 'NEXT')),
w AS (SELECT node, 0 AS depth FROM s UNION SELECT f.dst, w.depth + 1 FROM w JOIN f ON f.src = w.node WHERE w.depth < 40) SELECT node, min(depth)::INTEGER AS depth FROM w GROUP BY ALL""")
def depth_from_roots(spark: SparkSession, d: str) -> DataFrame:
    """Least number of flow steps from any interface element."""
    flow = edges(spark, d).filter(F.col("rel_type").isin("CALLS", "READS_FROM", "NEXT"))
    return traversal.reachable(flow, labelled(spark, d, "UiAffordance"), keep_origin=False)


@query(f"""WITH RECURSIVE {_E}, {_LABEL.format('s', 'UiAffordance')}, {_LABEL.format('t', 'StorageCell')}, f AS (SELECT DISTINCT src, dst FROM e WHERE rel_type IN ('CALLS', 'READS_FROM', 'NEXT')),
w AS (SELECT node AS origin, node, 0 AS hops FROM s UNION SELECT w.origin, f.dst, w.hops + 1 FROM w JOIN f ON f.src = w.node WHERE w.hops < 40)
SELECT origin, node AS target, min(hops)::INTEGER AS hops FROM w WHERE origin <> node AND node IN (SELECT node FROM t) GROUP BY ALL""")
def shortest_path_lengths(spark: SparkSession, d: str) -> DataFrame:
    """From each interface element to each storage cell that it reaches by flow steps."""
    flow = edges(spark, d).filter(F.col("rel_type").isin("CALLS", "READS_FROM", "NEXT"))
    found = traversal.shortest_paths(flow, labelled(spark, d, "UiAffordance"), labelled(spark, d, "StorageCell"))
    return found.select("origin", "target", "hops")


@query(f"""WITH RECURSIVE {_E}, {_LABEL.format('s', 'UiAffordance')}, {_LABEL.format('t', 'StorageCell')}, f AS (SELECT DISTINCT src, dst FROM e WHERE rel_type IN ('CALLS', 'READS_FROM', 'NEXT')),
w AS (SELECT node AS origin, node, 0 AS hops FROM s UNION SELECT w.origin, f.dst, w.hops + 1 FROM w JOIN f ON f.src = w.node WHERE w.hops < 40),
m AS (SELECT origin, node AS target, min(hops)::INTEGER AS hops FROM w WHERE origin <> node AND node IN (SELECT node FROM t) GROUP BY ALL)
SELECT origin, target, hops FROM m QUALIFY row_number() OVER (PARTITION BY origin ORDER BY hops, target) = 1""")
def nearest_target(spark: SparkSession, d: str) -> DataFrame:
    """The storage cell nearest to each interface element."""
    flow = edges(spark, d).filter(F.col("rel_type").isin("CALLS", "READS_FROM", "NEXT"))
    found = traversal.shortest_paths(flow, labelled(spark, d, "UiAffordance"), labelled(spark, d, "StorageCell"), nearest_only=True)
    return found.select("origin", "target", "hops")


@query()
def simple_flow_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of control flow from each function's first step; at most 8 steps and 64 paths a start, else marked."""
    flow = edges(spark, d).filter(F.col("rel_type").isin("NEXT", "TRUE", "FALSE"))
    heads = flow.select(F.col("src").alias("node")).join(flow.select(F.col("dst").alias("node")), "node", "left_anti")
    found = traversal.simple_paths(flow, heads, 8, 64)
    return found.select("origin", F.array_join("path", " > ").alias("path"), "ended", "truncated")


@query(f"""WITH RECURSIVE {_E}, f AS (SELECT DISTINCT src, dst FROM e WHERE rel_type IN ('NEXT', 'TRUE', 'FALSE')), b AS (SELECT DISTINCT src AS branch, dst AS start FROM e WHERE rel_type IN ('TRUE', 'FALSE')),
w AS (SELECT start, start AS node, 0 AS depth FROM (SELECT DISTINCT start FROM b) UNION SELECT w.start, f.dst, w.depth + 1 FROM w JOIN f ON f.src = w.node WHERE w.depth < 40),
r AS (SELECT start, node, min(depth) AS depth FROM w GROUP BY ALL), m AS (SELECT branch, node, count(*) AS n, max(depth) AS depth FROM b JOIN r USING (start) GROUP BY ALL)
SELECT branch, node, depth::INTEGER AS depth FROM m JOIN (SELECT branch, count(*) AS want FROM b GROUP BY ALL) USING (branch) WHERE n = want QUALIFY row_number() OVER (PARTITION BY branch ORDER BY depth, node) = 1""")
def branch_join_points(spark: SparkSession, d: str) -> DataFrame:
    """The nearest node that all outcomes of a branch reach."""
    e = edges(spark, d)
    outcomes = e.filter(F.col("rel_type").isin("TRUE", "FALSE")).select(F.col("src").alias("branch"), F.col("dst").alias("node"))
    return traversal.common_reach(e.filter(F.col("rel_type").isin("NEXT", "TRUE", "FALSE")), outcomes, most_hops=None)


@query(f"""WITH RECURSIVE {_E}, c AS (SELECT DISTINCT src, dst FROM e WHERE rel_type = 'CALLS'), w AS (SELECT src AS origin, dst AS node, 1 AS hops FROM c
UNION SELECT w.origin, c.dst, w.hops + 1 FROM w JOIN c ON c.src = w.node WHERE w.hops < 40) SELECT origin, min(hops)::INTEGER AS hops FROM w WHERE origin = node GROUP BY ALL""")
def call_cycle_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Callables that reach themselves by calls, with the least number."""
    calls = edges(spark, d).filter("rel_type = 'CALLS'")
    return traversal.cycle_witness(calls, calls.select(F.col("src").alias("node"))).select("origin", "hops")


@query(f"""WITH RECURSIVE {_E}, {_DEPS}, {_LABEL.format('s', 'UiAffordance')}, w AS (SELECT node AS origin, node, 0 AS depth FROM s
UNION SELECT w.origin, deps.dst, w.depth + 1 FROM w JOIN deps ON deps.src = w.node WHERE w.depth < 8), r AS (SELECT origin, node, min(depth) AS depth FROM w GROUP BY ALL)
SELECT origin, count(*) AS nodes, max(depth)::INTEGER AS depth, count(*) > 2000 AS overflow FROM r GROUP BY ALL""")
def bounded_dependency_closure(spark: SparkSession, d: str) -> DataFrame:
    """What each interface element needs within 8 steps; more than 2,000 nodes are flagged."""
    reach = traversal.reachable(levels.dependency_edges(edges(spark, d)), labelled(spark, d, "UiAffordance"), 8)
    return reach.groupBy("origin").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"), (F.count(F.lit(1)) > 2000).alias("overflow"))


@query()
def contracted_flow(spark: SparkSession, d: str) -> DataFrame:
    """Control flow with straight runs of steps drawn together; storage cells stay."""
    flow = edges(spark, d).filter(F.col("rel_type").isin("NEXT", "TRUE", "FALSE"))
    return traversal.contract_chains(flow, labelled(spark, d, "StorageCell"))


@query(f"""WITH RECURSIVE {_E}, c AS (SELECT src, min(dst) AS dst FROM e WHERE rel_type IN ('CAPTURES_VALUE', 'ALIASES') GROUP BY ALL), s AS (SELECT DISTINCT dst AS node FROM e WHERE rel_type = 'RETURNS_VALUE'),
w AS (SELECT src AS origin, [src] AS path FROM c UNION ALL SELECT w.origin, list_append(w.path, c.dst) FROM w JOIN c ON c.src = w.path[-1] WHERE NOT list_contains(w.path, c.dst) AND NOT (len(w.path) > 1 AND w.path[-1] IN (SELECT node FROM s)) AND len(w.path) <= 64),
f AS (SELECT origin, path FROM w QUALIFY len(path) = max(len(path)) OVER (PARTITION BY origin))
SELECT origin, len(path)::INTEGER AS nodes, path[-1] AS last, CASE WHEN len(path) > 1 AND path[-1] IN (SELECT node FROM s) THEN 'found' WHEN path[-1] NOT IN (SELECT src FROM c) THEN 'open' WHEN list_contains(path, (SELECT dst FROM c WHERE c.src = path[-1])) THEN 'cycle' ELSE 'limit' END AS state FROM f""")
def capture_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains of captures until a value that captures nothing, or a value reference."""
    e = edges(spark, d)
    captures = e.filter(F.col("rel_type").isin("CAPTURES_VALUE", "ALIASES"))
    stops = e.filter("rel_type = 'RETURNS_VALUE'").select(F.col("dst").alias("node"))
    found = traversal.chain_walk(captures, captures.select(F.col("src").alias("node")), stops)
    return found.select("origin", F.size("path").alias("nodes"), F.element_at("path", -1).alias("last"), "state")


@query(f"""WITH RECURSIVE {_E}, u AS (SELECT src AS a, dst AS b FROM e WHERE rel_type = 'REEXPORTS' UNION SELECT dst, src FROM e WHERE rel_type = 'REEXPORTS'), w AS (SELECT a AS node, a AS other FROM u UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.other)
SELECT node, min(other) AS component FROM w GROUP BY ALL""")
def reexport_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected groups of re-exports."""
    return traversal.components(edges(spark, d).filter("rel_type = 'REEXPORTS'"))


@query(f"""WITH RECURSIVE {_LINKS}, v AS (SELECT provenance_id || ' ' || stable_id AS node, min(json_extract_string(props_json, '$.extension')) AS value FROM raw_entities WHERE stable_id IS NOT NULL GROUP BY ALL),
p AS (SELECT child AS node, min(parent) AS parent FROM l GROUP BY ALL), a AS (SELECT node FROM v UNION SELECT node FROM p UNION SELECT parent FROM p),
w AS (SELECT a.node, v.value, a.node AS at, 0 AS distance FROM a LEFT JOIN v ON v.node = a.node UNION
SELECT w.node, v.value, p.parent, w.distance + 1 FROM w JOIN p ON p.node = w.at LEFT JOIN v ON v.node = p.parent WHERE w.value IS NULL AND w.distance < 40)
SELECT a.node, arg_min(w.value, w.distance) FILTER (w.value IS NOT NULL) AS value, min(w.distance) FILTER (w.value IS NOT NULL)::INTEGER AS distance FROM a JOIN w USING (node) GROUP BY ALL""")
def inherited_field_fill(spark: SparkSession, d: str) -> DataFrame:
    """The extension of each entity, or of the nearest parent that has one."""
    links = _links(spark, d).select(F.col("child").alias("node"), "parent")
    e = table(spark, d, "raw_entities").filter("stable_id is not null")
    own = e.groupBy(node("provenance_id", "stable_id").alias("node")).agg(F.min(F.get_json_object("props_json", "$.extension")).alias("value"))
    return traversal.inherited(links, own)
