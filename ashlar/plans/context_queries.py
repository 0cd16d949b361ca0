"""Named queries of contexts around entities, chains by type, and checks of an import, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ashlar.operators import classification as cl
from ashlar.operators import evidence as ev
from ashlar.operators import relational, traversal
from ashlar.operators import runtime_events as rt
from ashlar.plans.evidence_queries import _RUNS, _known_runs, _tables
from ashlar.plans.graph_queries import _E, _LABEL, edges, labelled
from ashlar.plans.relational_queries import _PROMOTED, promoted
from ashlar.plans.runtime_queries import _REC
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


@query(f"""WITH RECURSIVE {_E}, s AS (SELECT src AS origin, dst AS node FROM e WHERE rel_type = 'CALLS' UNION SELECT s.origin, e.dst FROM s JOIN e ON e.src = s.node AND e.rel_type IN ('BINDS_TO_PARAMETER', 'TYPED_AS'))
SELECT DISTINCT s.origin, e.dst AS node FROM s JOIN e ON e.src = s.node AND e.rel_type = 'RETURNS_VALUE' WHERE s.origin <> e.dst""")
def signature_chain(spark: SparkSession, d: str) -> DataFrame:
    """What a call leads to over parameters and types until a returned value."""
    t = F.col("rel_type")
    return traversal.typed_chain(edges(spark, d), t == "CALLS", t.isin("BINDS_TO_PARAMETER", "TYPED_AS"), t == "RETURNS_VALUE")


@query(f"""WITH RECURSIVE {_E}, f AS (SELECT DISTINCT src, dst FROM e WHERE rel_type IN ('CALLS', 'NEXT')), q AS (SELECT DISTINCT src AS origin, dst AS target FROM e WHERE rel_type = 'REEXPORTS'),
w AS (SELECT origin, origin AS node, 0 AS hops FROM (SELECT DISTINCT origin FROM q) UNION SELECT w.origin, f.dst, w.hops + 1 FROM w JOIN f ON f.src = w.node WHERE w.hops < 4), m AS (SELECT origin, node AS target, min(hops)::INTEGER AS hops FROM w GROUP BY ALL)
SELECT q.origin, q.target, CASE WHEN q.origin = q.target THEN NULL ELSE m.hops END AS hops, CASE WHEN q.origin = q.target THEN 'same' WHEN m.hops IS NULL THEN 'unavailable' ELSE 'found' END AS status FROM q LEFT JOIN m ON m.origin = q.origin AND m.target = q.target""")
def path_requests(spark: SparkSession, d: str) -> DataFrame:
    """For each re-export, whether the flow leads from its source to its target in at most 4 steps."""
    e = edges(spark, d)
    wanted = e.filter("rel_type = 'REEXPORTS'").select(F.col("src").alias("origin"), F.col("dst").alias("target")).distinct()
    return traversal.path_requests(e.filter("rel_type in ('CALLS', 'NEXT')"), wanted, 4).drop("path")


@query(f"""WITH {_REC}, i AS (SELECT session_id, function_stable_id, iter::BIGINT AS iteration, arg_min(node_id, (t, event_id)) AS first_node, arg_max(node_id, (t, event_id)) AS last_node FROM rec WHERE iter IS NOT NULL AND function_stable_id IS NOT NULL AND session_id IS NOT NULL AND node_id IS NOT NULL GROUP BY ALL),
p AS (SELECT *, lag(last_node) OVER (PARTITION BY session_id, function_stable_id ORDER BY iteration) AS before FROM i) SELECT session_id, function_stable_id, before AS source, first_node AS target, count(*) AS n FROM p WHERE before IS NOT NULL AND before <> first_node GROUP BY ALL""")
def iteration_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Inferred edges from the last node of an iteration to the first of the next one."""
    r = table(spark, d, "runtime_records").withColumn("iteration", F.try_to_number(rt.node_prop("iterationIndex"), F.lit("999999999")).cast("long"))
    r = r.filter("iteration is not null and function_stable_id is not null and session_id is not null and node_id is not null")
    at = F.struct(rt.event_time(), "event_id")
    i = r.groupBy("session_id", "function_stable_id", "iteration").agg(F.min_by("node_id", at).alias("first_node"), F.max_by("node_id", at).alias("last_node"))
    p = relational.consecutive_pairs(i, ["session_id", "function_stable_id"], ["iteration"], ["last_node"]).filter("previous_last_node <> first_node")
    return p.groupBy("session_id", "function_stable_id", F.col("previous_last_node").alias("source"), F.col("first_node").alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x).lower() for x in (m, *v)) + ")" for m, v in cl.COLLECTION_METHODS.items()) + ") t(method, mode, result, short_circuit, reverse, mutates_receiver, item_parameter, callback_action)")
def collection_methods(spark: SparkSession, d: str) -> DataFrame:
    return cl.collection_methods(spark)


@query("""SELECT r.provenance_id, coalesce(json_extract_string(props_json, '$.tier'), CASE WHEN starts_with(to_id, 'external:') THEN 'external' WHEN starts_with(to_id, 'package:') THEN 'package' ELSE 'local' END) AS tier, count(*) AS n FROM raw_relationships r WHERE rel_type = 'CALLS' AND to_id IS NOT NULL GROUP BY ALL""")
def callable_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The stored tier of each call, else one from its target's id."""
    r = table(spark, d, "raw_relationships").filter("rel_type = 'CALLS' and to_id is not null")
    other = cl.first_match([(F.col("to_id").startswith("external:"), "external"), (F.col("to_id").startswith("package:"), "package")], "local")
    return r.groupBy("provenance_id", F.coalesce(F.get_json_object("props_json", "$.tier"), other).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_RUNS}, s AS (SELECT workspace, seq, stable_id, md5(array_to_string(list_sort(list(DISTINCT rel_type || ' ' || coalesce(to_id, '?'))), '|')) AS probe FROM (SELECT workspace, seq, from_id AS stable_id, rel_type, to_id FROM raw_relationships JOIN runs USING (provenance_id) WHERE from_id IS NOT NULL AND rel_type IN ('CALLS', 'READS_FROM')) GROUP BY ALL)
SELECT r.provenance_id, count(*) AS known, count(*) FILTER (b.probe IS DISTINCT FROM a.probe) AS stale FROM s a JOIN runs r ON r.workspace = a.workspace AND r.seq = a.seq + 1 LEFT JOIN s b ON b.workspace = a.workspace AND b.seq = a.seq + 1 AND b.stable_id = a.stable_id GROUP BY ALL""")
def stale_answers(spark: SparkSession, d: str) -> DataFrame:
    """Entities whose outgoing links, taken together as a fingerprint, are not those of the run before."""
    r = table(spark, d, "raw_relationships").filter("from_id is not null and rel_type in ('CALLS', 'READS_FROM')").join(_known_runs(spark, d), "provenance_id")
    probe = F.md5(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "rel_type", F.coalesce("to_id", F.lit("?"))))), "|"))
    s = r.groupBy("workspace", "seq", F.col("from_id").alias("stable_id")).agg(probe.alias("probe"))
    later = s.select("workspace", (F.col("seq") - 1).alias("seq"), "stable_id", F.col("probe").alias("now"))
    run = _known_runs(spark, d).select("provenance_id", "workspace", (F.col("seq") - 1).alias("seq"))
    both = s.join(run, ["workspace", "seq"]).join(later, ["workspace", "seq", "stable_id"], "left")
    return both.groupBy("provenance_id").agg(F.count(F.lit(1)).alias("known"), F.count_if(~F.col("probe").eqNullSafe(F.col("now"))).alias("stale"))


_LAYERS = ("filesystem/tree", "semantic/functionFlowGraph", "storage/cells")


@query(f"SELECT provenance_id, array_to_string(list(DISTINCT source_kind ORDER BY source_kind), ',') AS layers, list_has_all(list(DISTINCT source_kind), {list(_LAYERS)}) AS ready FROM raw_entities GROUP BY ALL")
def layer_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Which layers a run has, and whether all needed ones are among them."""
    g = table(spark, d, "raw_entities").groupBy("provenance_id").agg(F.array_sort(F.collect_set("source_kind")).alias("l"))
    return g.select("provenance_id", F.array_join("l", ",").alias("layers"), cl.has_all("l", _LAYERS).alias("ready"))


@query("""WITH s AS (SELECT provenance_id, from_id AS stable_id, count(*) FILTER (rel_type IN ('NEXT', 'TRUE', 'FALSE')) AS control, count(*) FILTER (rel_type IN ('READS_FROM', 'ASSIGNS_VALUE', 'CAPTURES_VALUE')) AS resource, count(*) FILTER (rel_type IN ('ALIASES', 'RESOLVES_TO')) AS link, count(DISTINCT to_id) FILTER (rel_type = 'CALLS') AS callees
FROM raw_relationships WHERE from_id IS NOT NULL GROUP BY ALL) SELECT s.* FROM s SEMI JOIN (SELECT DISTINCT provenance_id, stable_id FROM raw_entities WHERE list_contains(labels, 'Fn')) f ON f.provenance_id = s.provenance_id AND f.stable_id = s.stable_id""")
def function_flow_profile(spark: SparkSession, d: str) -> DataFrame:
    """The edges of each function by family."""
    e, r = _tables(spark, d)
    fn = e.filter(F.array_contains("labels", "Fn")).select("provenance_id", "stable_id").distinct()
    n = lambda *t: F.count_if(F.col("rel_type").isin(*t))
    g = r.filter("from_id is not null").groupBy("provenance_id", F.col("from_id").alias("stable_id"))
    g = g.agg(n("NEXT", "TRUE", "FALSE").alias("control"), n("READS_FROM", "ASSIGNS_VALUE", "CAPTURES_VALUE").alias("resource"), n("ALIASES", "RESOLVES_TO").alias("link"), F.count_distinct(F.when(F.col("rel_type") == "CALLS", F.col("to_id"))).alias("callees"))
    return g.join(fn, ["provenance_id", "stable_id"], "left_semi")


@query(f"""WITH {_E}, b AS (SELECT DISTINCT src AS branch, rel_type AS outcome, dst AS step FROM e WHERE rel_type IN ('TRUE', 'FALSE')), c AS (SELECT DISTINCT src, dst FROM e WHERE rel_type = 'CALLS')
SELECT branch, outcome, count(DISTINCT step) AS steps, count(DISTINCT c.dst) AS calls FROM b LEFT JOIN c ON c.src = b.step GROUP BY ALL""")
def call_branches(spark: SparkSession, d: str) -> DataFrame:
    """What the steps after each outcome of a branch call."""
    e = edges(spark, d)
    b = e.filter("rel_type in ('TRUE', 'FALSE')").select(F.col("src").alias("branch"), F.col("rel_type").alias("outcome"), F.col("dst").alias("step")).distinct()
    c = e.filter("rel_type = 'CALLS'").select(F.col("src").alias("step"), F.col("dst").alias("callee")).distinct()
    return b.join(c, "step", "left").groupBy("branch", "outcome").agg(F.count_distinct("step").alias("steps"), F.count_distinct("callee").alias("calls"))


@query("""WITH h AS (SELECT provenance_id, to_id AS slot, ordinal, rel_type FROM raw_relationships WHERE rel_type IN ('ASSIGNS_VALUE', 'READS_FROM', 'CAPTURES_VALUE', 'ALIASES') AND to_id IS NOT NULL) SELECT provenance_id, slot, count(*) AS events, array_to_string(list(rel_type ORDER BY ordinal), '>') AS history, arg_min(rel_type, ordinal) AS first, arg_max(rel_type, ordinal) AS last FROM h GROUP BY ALL""")
def binding_history(spark: SparkSession, d: str) -> DataFrame:
    """The accesses of each slot in order."""
    h = table(spark, d, "raw_relationships").filter("rel_type in ('ASSIGNS_VALUE', 'READS_FROM', 'CAPTURES_VALUE', 'ALIASES') and to_id is not null")
    order = F.array_sort(F.collect_list(F.struct("ordinal", "rel_type")))
    return h.groupBy("provenance_id", F.col("to_id").alias("slot")).agg(F.count(F.lit(1)).alias("events"), F.array_join(F.transform(order, lambda x: x.rel_type), ">").alias("history"), F.min_by("rel_type", "ordinal").alias("first"), F.max_by("rel_type", "ordinal").alias("last"))


@query(f"""WITH {_PROMOTED}, {_RUNS}, u AS (SELECT workspace, seq, file, name, declaration_kind, any_value(stable_id) AS stable_id FROM n JOIN runs USING (provenance_id) WHERE name IS NOT NULL AND file IS NOT NULL AND declaration_kind IS NOT NULL GROUP BY ALL HAVING count(*) = 1)
SELECT a.workspace, a.seq + 1 AS seq, count(*) AS both, count(*) FILTER (a.stable_id <> b.stable_id) AS drifted FROM u a JOIN u b ON b.workspace = a.workspace AND b.seq = a.seq + 1 AND b.file = a.file AND b.name = a.name AND b.declaration_kind = a.declaration_kind GROUP BY ALL""")
def coordinate_drift(spark: SparkSession, d: str) -> DataFrame:
    """Declarations of one name, kind and file in two consecutive runs, and how many stand elsewhere."""
    n = promoted(table(spark, d, "raw_entities")).filter("name is not null and file is not null and declaration_kind is not null").join(_known_runs(spark, d), "provenance_id")
    keys = ["workspace", "seq", "file", "name", "declaration_kind"]
    u = n.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), F.min("stable_id").alias("stable_id")).filter("k = 1").drop("k")
    after = u.withColumn("seq", F.col("seq") - 1).withColumnRenamed("stable_id", "after")
    both = u.join(after, keys)
    return both.groupBy("workspace", (F.col("seq") + 1).alias("seq")).agg(F.count(F.lit(1)).alias("both"), F.count_if(F.col("stable_id") != F.col("after")).alias("drifted"))


@query(f"""WITH {_REC}, b AS (SELECT DISTINCT session_id, coalesce(correlation_id, node_id) AS bucket, function_stable_id FROM rec WHERE function_stable_id IS NOT NULL AND session_id IS NOT NULL), c AS (SELECT DISTINCT from_id, to_id FROM raw_relationships WHERE rel_type = 'CALLS' AND from_id IS NOT NULL AND to_id IS NOT NULL)
SELECT b.session_id, count(*) AS expected, count(o.bucket) AS observed FROM b JOIN c ON c.from_id = b.function_stable_id LEFT JOIN b o ON o.session_id = b.session_id AND o.bucket = b.bucket AND o.function_stable_id = c.to_id GROUP BY ALL""")
def downstream_calls(spark: SparkSession, d: str) -> DataFrame:
    """How many of the calls that observed functions have were observed in the same bucket."""
    b = table(spark, d, "runtime_records").filter("function_stable_id is not null and session_id is not null").select("session_id", F.coalesce("correlation_id", "node_id").alias("bucket"), "function_stable_id").distinct()
    c = table(spark, d, "raw_relationships").filter("rel_type = 'CALLS' and from_id is not null and to_id is not null").select(F.col("from_id").alias("function_stable_id"), "to_id").distinct()
    seen = b.select("session_id", "bucket", F.col("function_stable_id").alias("to_id"), F.lit(1).alias("seen"))
    return b.join(c, "function_stable_id").join(seen, ["session_id", "bucket", "to_id"], "left").groupBy("session_id").agg(F.count(F.lit(1)).alias("expected"), F.count("seen").alias("observed"))


@query(f"""WITH {_E}, {_LABEL.format('s', 'UiAffordance')}, f AS (SELECT DISTINCT src, dst, rel_type FROM e) SELECT s.node, count(DISTINCT o.dst) AS outgoing, count(DISTINCT i.src) AS incoming, array_to_string(list(DISTINCT o.rel_type ORDER BY o.rel_type) FILTER (o.rel_type IS NOT NULL), ',') AS types
FROM s LEFT JOIN f o ON o.src = s.node LEFT JOIN f i ON i.dst = s.node GROUP BY ALL""")
def affordance_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Each interface element with its neighbours on both sides; sides are aggregated before they are joined."""
    e, s = edges(spark, d), labelled(spark, d, "UiAffordance")
    out = e.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("outgoing"), F.array_join(F.array_sort(F.collect_set("rel_type")), ",").alias("types"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("incoming"))
    both = s.join(out, "node", "left").join(into, "node", "left")
    return both.select("node", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("incoming", F.lit(0)).alias("incoming"), "types")


@query()
def flow_stages(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each container in order, drawn together into stages by their numbers of children."""
    e, r = _tables(spark, d)
    order = F.try_to_number(F.get_json_object("props_json", "$.order"), F.lit("999999999")).cast("long")
    parts = r.filter("rel_type = 'NESTED_IN' and from_id is not null and to_id is not null").select("provenance_id", F.col("to_id").alias("container"), F.col("from_id").alias("part"), order.alias("place")).filter("place is not null")
    parts = parts.groupBy("provenance_id", "container", "place").agg(F.min("part").alias("part"))
    steps = r.filter("rel_type = 'AST_CHILD'").groupBy("provenance_id", F.col("from_id").alias("part")).agg(F.count(F.lit(1)).alias("steps"))
    exits = r.filter("rel_type = 'RETURNS_VALUE'").select("provenance_id", F.col("from_id").alias("part"), F.lit(True).alias("exits")).distinct()
    s = parts.join(steps, ["provenance_id", "part"], "left").join(exits, ["provenance_id", "part"], "left")
    return ev.stage_merge(s.drop("part"), ["provenance_id", "container"], "place", "steps", "exits", 20)


@query()
def property_paths(spark: SparkSession, d: str) -> DataFrame:
    """Where values go with the members they are put under, within 64 steps: reads pass on, blocks push, returns pop."""
    e = edges(spark, d)
    key = F.regexp_extract("dst", "([^/:]+):[0-9]+:", 1)
    op = F.when(F.col("rel_type") == "HAS_FLOW_BLOCK", "push").when(F.col("rel_type") == "RETURNS_VALUE", "pop").when(F.col("rel_type").isin("VALUE_FROM", "ASSIGNS_VALUE"), "pass")
    walks = e.select("src", "dst", op.alias("op"), F.when(op != "pass", key).alias("key")).filter("op is not null")
    starts = e.filter("rel_type = 'ASSIGNS_VALUE'").select(F.col("src").alias("node")).distinct()
    found = ev.stack_walk(walks, starts, 64, 64)  # each step pushes one key at most
    return found.select("origin", "node", F.array_join("keys", ".").alias("keys"), "hops")
