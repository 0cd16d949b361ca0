"""Named queries of runtime analytics, each beside its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.functions.ids import normalized_sql
from ashlar.operators import relational, traversal
from ashlar.operators import runtime_events as rt
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


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "runtime_records")


_T = "CASE WHEN score > 0 THEN score ELSE epoch_ms(ingested_at) END"
_REC = f"rec AS (SELECT *, {_T} AS t, json_extract_string(raw_json, '$.nodeProps.iterationIndex') AS iter, json_extract_string(raw_json, '$.nodeProps.matched') AS matched FROM runtime_records)"
_FIRST = ", ".join(f"arg_min({c}, (t, event_id)) FILTER ({c} IS NOT NULL) AS {c}" for c in rt.CARRIED)
_NODES = f"""{_REC}, nodes AS (SELECT node_id, {_FIRST}, min(t) AS first_ms, max(t) AS last_ms, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, count(*) AS events,
coalesce(bool_or(update_only), false) AS update_merged, coalesce(bool_or(update_only AND kind IN ('response', 'error')), false) AS has_response_update FROM rec WHERE node_id IS NOT NULL GROUP BY node_id)"""
_PARENT = "SELECT 'PARENT:' || parent_node_id || ':' || node_id || ':' || coalesce(correlation_id, '') AS id, parent_node_id AS source, node_id AS target, 'PARENT' AS kind, 'strong' AS strength FROM nodes WHERE parent_node_id IN (SELECT node_id FROM nodes)"
_ASYNC = """SELECT 'ASYNC:' || p || ':' || node_id || ':' || correlation_id AS id, p AS source, node_id AS target, 'ASYNC' AS kind, 'medium' AS strength FROM
(SELECT *, lag(node_id) OVER (PARTITION BY correlation_id ORDER BY first_ms, node_id) AS p FROM nodes WHERE correlation_id IS NOT NULL) WHERE p IS NOT NULL"""


@query(f"WITH {_NODES} SELECT * FROM nodes")
def merged_runtime_nodes(spark: SparkSession, d: str) -> DataFrame:
    return rt.merged_nodes(records(spark, d)).withColumn("kinds", F.array_join("kinds", ","))


@query(f"WITH {_NODES} {_PARENT}")
def causal_parent_links(spark: SparkSession, d: str) -> DataFrame:
    return rt.parent_links(rt.merged_nodes(records(spark, d)))


@query(f"WITH {_NODES} {_ASYNC}")
def causal_correlation_links(spark: SparkSession, d: str) -> DataFrame:
    return rt.correlation_links(rt.merged_nodes(records(spark, d)))


@query(f"WITH {_NODES} SELECT DISTINCT * FROM ({_PARENT} UNION ALL {_ASYNC})")
def causal_links(spark: SparkSession, d: str) -> DataFrame:
    return rt.causal_links(rt.merged_nodes(records(spark, d)))


@query("""SELECT * FROM (SELECT 'correlation' AS by, correlation_id AS key, count(DISTINCT node_id) AS nodes, count(*) AS rows FROM runtime_records WHERE correlation_id IS NOT NULL AND node_id IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'session', session_id, count(DISTINCT node_id), count(*) FROM runtime_records WHERE session_id IS NOT NULL AND node_id IS NOT NULL GROUP BY ALL) WHERE nodes >= 2""")
def causal_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rt.causal_candidates(records(spark, d))


@query(f"""WITH r AS (SELECT session_id, node_id, {normalized_sql('function_stable_id')} AS f FROM runtime_records WHERE session_id IS NOT NULL), k AS (SELECT DISTINCT {normalized_sql('stable_id')} AS f FROM raw_entities)
SELECT session_id, count(*) AS events, count(DISTINCT node_id) AS nodes, count(DISTINCT f) AS functions, count(DISTINCT f) FILTER (f IN (SELECT f FROM k WHERE f IS NOT NULL)) AS anchored FROM r GROUP BY ALL""")
def event_sessions_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rt.session_coverage(records(spark, d), table(spark, d, "raw_entities"))


@query(f"""WITH {_REC} SELECT function_stable_id, arg_max(session_id, (t, event_id)) AS session_id, arg_max(kind, (t, event_id)) AS kind, max(t) AS last_ms, count(*) AS events FROM rec WHERE function_stable_id IS NOT NULL GROUP BY ALL""")
def event_latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    return rt.latest_by_function(records(spark, d))


@query(f"""WITH {_REC}, m AS (SELECT session_id, max(t) AS last_ms FROM rec WHERE session_id IS NOT NULL GROUP BY ALL)
SELECT session_id, last_ms, count(*) AS recent FROM rec JOIN m USING (session_id) WHERE t >= last_ms - 30000 GROUP BY ALL""")
def recent_window_events(spark: SparkSession, d: str) -> DataFrame:
    return rt.recent_window(records(spark, d))


_ITER = f"""{_REC}, it AS (SELECT session_id, function_stable_id, iter::BIGINT AS iteration, count(*) AS events,
min(CASE WHEN kind = 'error' THEN 1 WHEN kind = 'store.set' THEN 2 WHEN matched = 'true' THEN 3 ELSE 4 END) AS rank, array_to_string(list(coalesce(kind, '?') ORDER BY t, event_id), '>') AS path
FROM rec WHERE iter IS NOT NULL AND function_stable_id IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {_ITER} SELECT session_id, function_stable_id, iteration, events, ['error', 'accumulated', 'accepted', 'rejected'][rank] AS outcome, path, md5(path) AS signature FROM it""")
def iteration_segments(spark: SparkSession, d: str) -> DataFrame:
    return rt.iterations(records(spark, d))


@query(f"""WITH {_ITER}, s AS (SELECT DISTINCT path, function_stable_id FROM it QUALIFY dense_rank() OVER (PARTITION BY path ORDER BY function_stable_id) <= 5)
SELECT md5(i.path) AS signature, i.path, count(*) AS n, count(DISTINCT i.function_stable_id) AS functions, (SELECT array_to_string(list(s.function_stable_id ORDER BY s.function_stable_id), ',') FROM s WHERE s.path = i.path) AS samples FROM it i GROUP BY ALL""")
def branch_segments(spark: SparkSession, d: str) -> DataFrame:
    return rt.branch_segments(rt.iterations(records(spark, d)))


_PAIRS = f"""{_REC}, pr AS (SELECT lag(function_stable_id) OVER (PARTITION BY session_id ORDER BY t, event_id) AS source, function_stable_id AS target FROM rec WHERE function_stable_id IS NOT NULL AND session_id IS NOT NULL)"""


@query(f"WITH {_PAIRS} SELECT source, target, count(*) AS n FROM pr WHERE source <> target GROUP BY ALL")
def observed_edge_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rt.edge_pairs(records(spark, d))


@query(f"""WITH {_REC} SELECT event_id, count(*) FILTER (kind = 'guard') OVER w AS case_no, last_value(iter IGNORE NULLS) OVER (PARTITION BY session_id, function_stable_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_iteration
FROM rec WHERE function_stable_id IS NOT NULL AND session_id IS NOT NULL WINDOW w AS (PARTITION BY session_id, function_stable_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)""")
def guard_cases(spark: SparkSession, d: str) -> DataFrame:
    return rt.guard_cases(records(spark, d))


@query(f"""WITH {_PAIRS}, r AS (SELECT DISTINCT {normalized_sql('source')} AS source, {normalized_sql('target')} AS target FROM pr WHERE source <> target), s AS (SELECT DISTINCT {normalized_sql('from_id')} AS source, {normalized_sql('to_id')} AS target
FROM raw_relationships WHERE rel_type = 'CALLS' AND from_id IS NOT NULL AND to_id IS NOT NULL), r2 AS (SELECT * FROM r WHERE source <> target)
SELECT coalesce(r2.source, s.source) AS source, coalesce(r2.target, s.target) AS target, CASE WHEN r2.source IS NULL THEN 'static-only' WHEN s.source IS NULL THEN 'runtime-only' ELSE 'matched' END AS status
FROM r2 FULL JOIN s ON r2.source = s.source AND r2.target = s.target""")
def runtime_static_transitions(spark: SparkSession, d: str) -> DataFrame:
    return rt.transitions(records(spark, d), table(spark, d, "raw_relationships"))


@query(r"""SELECT key, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(replace(function_stable_id, '\', '/'), '^.*:[0-9]+:[0-9]+:[0-9]+:[0-9]+(:.*)?$') THEN 'coord:' || regexp_extract(replace(function_stable_id, '\', '/'), '^(.*):([0-9]+):[0-9]+:[0-9]+:[0-9]+(:.*)?$', 1)
|| ':' || regexp_extract(replace(function_stable_id, '\', '/'), '^(.*):([0-9]+):[0-9]+:[0-9]+:[0-9]+(:.*)?$', 2)::BIGINT ELSE function_stable_id END AS key FROM runtime_records WHERE function_stable_id IS NOT NULL) GROUP BY ALL""")
def coordinate_key_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d).filter("function_stable_id is not null")
    return rows.groupBy(rt.coordinate_key("function_stable_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT session_id, count(*) AS events, count(*) FILTER (parent_node_id IS NULL) AS roots, count(*) FILTER (parent_node_id IS NOT NULL AND parent_node_id NOT IN (SELECT node_id FROM runtime_records WHERE node_id IS NOT NULL)) AS lost_parents,
count(*) FILTER (correlation_id IS NULL) AS uncorrelated, count(*) FILTER (function_stable_id IS NULL) AS unanchored, count(*) FILTER (NOT coalesce(score, 0) > 0) AS untimed FROM runtime_records GROUP BY ALL""")
def session_completeness(spark: SparkSession, d: str) -> DataFrame:
    return rt.completeness(records(spark, d))


@query(f"""WITH {_REC} SELECT session_id, function_stable_id, ['then', 'else', 'evaluated'][min(CASE WHEN matched = 'true' THEN 1 WHEN matched = 'false' THEN 2 ELSE 3 END)] AS outcome, count(*) AS evaluations
FROM rec WHERE kind = 'guard' AND function_stable_id IS NOT NULL GROUP BY ALL""")
def branch_outcome_priority(spark: SparkSession, d: str) -> DataFrame:
    return rt.branch_outcomes(records(spark, d))


@query("""WITH b AS (SELECT coalesce('corr:' || correlation_id, 'parent:' || parent_node_id, 'node:' || node_id) AS bucket, * FROM runtime_records)
SELECT bucket, count(*) AS events, count(DISTINCT function_stable_id) AS functions, sha256(coalesce(array_to_string(list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)), ','), '')) AS fingerprint FROM b GROUP BY ALL""")
def trace_buckets(spark: SparkSession, d: str) -> DataFrame:
    return rt.trace_buckets(records(spark, d))


@query(f"""SELECT DISTINCT {normalized_sql('stable_id')} AS stable_id FROM raw_entities WHERE list_contains(labels, 'Fn') AND {normalized_sql('stable_id')} NOT IN (SELECT {normalized_sql('function_stable_id')} FROM runtime_records WHERE function_stable_id IS NOT NULL)""")
def coverage_targets_uncovered(spark: SparkSession, d: str) -> DataFrame:
    return rt.uncovered(table(spark, d, "raw_entities"), records(spark, d), "Fn")


@query("""WITH y AS (SELECT o_orderpriority AS name, year(o_orderdate) AS y, round(sum(o_totalprice), 0) AS v FROM orders GROUP BY ALL), m AS (SELECT max(y) AS y FROM y), b AS (SELECT name, v FROM y, m WHERE y.y = m.y - 2), c AS (SELECT name, v FROM y, m WHERE y.y = m.y - 1)
SELECT coalesce(b.name, c.name) AS name, b.v AS before, c.v AS after, c.v - b.v AS delta, round((c.v - b.v) * 100 / b.v, 6) AS percent, CASE WHEN c.v IS NULL THEN 'missing' WHEN b.v IS NULL THEN 'new' WHEN c.v > b.v THEN 'slower' WHEN c.v < b.v THEN 'faster' ELSE 'same' END AS state FROM b FULL JOIN c ON b.name = c.name""")
def performance_interval_diff(spark: SparkSession, d: str) -> DataFrame:
    """The two last full years of orders by priority, as intervals to compare."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name"), F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 0).alias("v"))
    last = o.agg(F.max("y")).first()[0] or 0
    found = rt.interval_comparison(o.filter(F.col("y") == last - 2), o.filter(F.col("y") == last - 1), "name", "v")
    return found.withColumn("percent", F.round("percent", 6))


@query(f"""WITH {_REC}, l AS (SELECT * FROM rec ORDER BY t DESC, event_id LIMIT 1000) SELECT event_id, kind, t FROM l WHERE kind = 'error' ORDER BY t DESC, event_id LIMIT 200""")
def last_events_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Errors among the last 1,000 events; the limit comes before the filter, as the report defines it."""
    rows = records(spark, d).select("event_id", "kind", rt.event_time().alias("t")).orderBy(F.desc("t"), "event_id").limit(1000)
    return rows.filter("kind = 'error'").orderBy(F.desc("t"), "event_id").limit(200)


@query(f"""WITH {_REC} SELECT session_id, event_id, t FROM rec WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY t DESC, event_id DESC) <= 5""")
def index_range_read(spark: SparkSession, d: str) -> DataFrame:
    """The five newest events of each session."""
    rows = records(spark, d).filter("session_id is not null").select("session_id", "event_id", rt.event_time().alias("t"))
    return relational.top_per_group(rows, ["session_id"], [F.desc("t"), F.desc("event_id")], 5)


@query(f"""WITH RECURSIVE {_NODES}, p AS (SELECT node_id, parent_node_id FROM nodes WHERE parent_node_id IN (SELECT node_id FROM nodes)), w AS (SELECT node_id AS root, node_id, 1 AS length FROM nodes WHERE node_id NOT IN (SELECT node_id FROM p)
UNION SELECT w.root, p.node_id, w.length + 1 FROM w JOIN p ON p.parent_node_id = w.node_id) SELECT root, max(length)::INTEGER AS length FROM w GROUP BY ALL""")
def longest_runtime_chain(spark: SparkSession, d: str) -> DataFrame:
    """The length of the longest chain of nodes below each root."""
    nodes = rt.merged_nodes(records(spark, d)).select("node_id", "parent_node_id")
    down = nodes.select(F.col("parent_node_id").alias("src"), F.col("node_id").alias("dst")).join(nodes.select(F.col("node_id").alias("src")), "src", "left_semi")
    roots = nodes.select(F.col("node_id").alias("node")).join(down.select(F.col("dst").alias("node")), "node", "left_anti")
    reach = traversal.reachable(down, roots)  # a tree: the depth is the one path's length
    return reach.groupBy(F.col("origin").alias("root")).agg((F.max("depth") + 1).alias("length"))


@query(f"""WITH RECURSIVE {_NODES}, c AS (SELECT parent_node_id AS src, arg_min(node_id, (first_ms, node_id)) AS dst FROM nodes WHERE parent_node_id IS NOT NULL GROUP BY ALL), w AS (SELECT node_id AS origin, node_id, 1 AS nodes FROM nodes WHERE parent_node_id IS NULL
UNION SELECT w.origin, c.dst, w.nodes + 1 FROM w JOIN c ON c.src = w.node_id WHERE w.nodes < 60) SELECT origin, max(nodes)::INTEGER AS nodes FROM w GROUP BY ALL""")
def earliest_child_chain(spark: SparkSession, d: str) -> DataFrame:
    """From each node without a parent, how many nodes there are when always the earliest child is followed."""
    nodes = rt.merged_nodes(records(spark, d))
    first = nodes.filter("parent_node_id is not null").groupBy(F.col("parent_node_id").alias("src")).agg(F.min(F.struct("first_ms", "node_id")).alias("m"))
    roots = nodes.filter("parent_node_id is null").select(F.col("node_id").alias("node"))
    found = traversal.chain_walk(first.select("src", F.col("m.node_id").alias("dst")), roots, roots.limit(0))
    return found.select("origin", F.size("path").alias("nodes"))


@query(f"""WITH RECURSIVE {_NODES}, l AS (SELECT 'n:' || node_id AS a, 'n:' || parent_node_id AS b FROM nodes WHERE parent_node_id IS NOT NULL UNION SELECT 'n:' || node_id, 'c:' || correlation_id FROM nodes WHERE correlation_id IS NOT NULL),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), w AS (SELECT a AS node, a AS other FROM u UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.other) SELECT node, min(other) AS component FROM w WHERE starts_with(node, 'n:') GROUP BY ALL""")
def connected_runtime_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nodes joined by parents and correlations: node, component."""
    nodes = rt.merged_nodes(records(spark, d))
    by_parent = nodes.select(F.concat(F.lit("n:"), "node_id").alias("src"), F.concat(F.lit("n:"), "parent_node_id").alias("dst"))
    by_key = nodes.select(F.concat(F.lit("n:"), "node_id"), F.concat(F.lit("c:"), "correlation_id"))
    return traversal.components(by_parent.union(by_key)).filter(F.col("node").startswith("n:"))


@query("SELECT event_type, value FROM (SELECT event_type, list_sort(list(value) FILTER (value IS NOT NULL)) AS l FROM events GROUP BY ALL), LATERAL (SELECT l[least(len(l), floor(len(l) * 0.9)::BIGINT + 1)] AS value)")
def percentile_threshold(spark: SparkSession, d: str) -> DataFrame:
    return relational.rank_percentile(table(spark, d, "events"), ["event_type"], "value", 0.9)


@query("SELECT event_id, list_sort(list(kind) OVER (PARTITION BY node_id ORDER BY score, event_id ROWS UNBOUNDED PRECEDING)) AS kinds FROM runtime_records WHERE node_id IS NOT NULL AND kind IS NOT NULL")
def running_accumulator(spark: SparkSession, d: str) -> DataFrame:
    """The kinds that each node has had up to each event."""
    rows = records(spark, d).filter("node_id is not null and kind is not null").select("event_id", "node_id", "score", "kind")
    return relational.running_list(rows, ["node_id"], ["score", "event_id"], "kind", "kinds").select("event_id", F.array_sort("kinds").alias("kinds"))


@query(f"""WITH {_REC}, g AS (SELECT *, CASE WHEN lag(kind) OVER w IS NOT DISTINCT FROM kind AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM rec WHERE session_id IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY t, event_id)),
s AS (SELECT session_id, kind, sum(new) OVER (PARTITION BY session_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS stage FROM g) SELECT session_id, stage, any_value(kind) AS kind, count(*) AS events FROM s GROUP BY session_id, stage""")
def stage_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal kinds in each session's order of events."""
    rows = records(spark, d).filter("session_id is not null").select("session_id", "kind", "event_id", rt.event_time().alias("t"))
    staged = relational.runs_of_equal(rows, ["session_id"], ["t", "event_id"], "kind")
    return staged.groupBy("session_id", "stage").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("events"))


@query(f"""WITH {_REC}, o AS (SELECT DISTINCT session_id, function_stable_id FROM rec WHERE kind = 'error' AND function_stable_id IS NOT NULL AND session_id IS NOT NULL)
SELECT session_id, count(DISTINCT event_id) AS events FROM rec WHERE session_id IS NOT NULL AND (EXISTS (SELECT 1 FROM o WHERE o.session_id = rec.session_id AND o.function_stable_id = rec.function_stable_id)
OR EXISTS (SELECT 1 FROM rec x WHERE x.kind = 'error' AND x.session_id = rec.session_id AND x.correlation_id = rec.correlation_id)) GROUP BY ALL""")
def scoped_event_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Events of a session that share a function or a correlation with one of its errors: a union of semi-joins."""
    rows = records(spark, d).filter("session_id is not null")
    errors = rows.filter("kind = 'error'")
    parts = [rows.join(errors.select("session_id", k).na.drop().distinct(), ["session_id", k], "left_semi").select("session_id", "event_id") for k in ("function_stable_id", "correlation_id")]
    return parts[0].union(parts[1]).distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("events"))


@query("""SELECT user_id, window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS window_start FROM events) GROUP BY ALL""")
def hourly_event_totals(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("user_id", F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("user_id", F.col("w.start").alias("window_start"), "event_type", "n", "total")
