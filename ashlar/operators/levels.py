"""Dependency levels: policies, normalised edges, waves from the sinks up, taint, and their checks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.operators.components import SMALL_CORE, strongly_connected
from ashlar.runtime import WorkTable, materialize

#: Relationship types whose source depends on the target, those of the other direction, and those that
#: are no dependency. Other types have no known meaning.
FORWARD = (
    "VALUE_FROM", "READS_FROM", "RESOLVES_TO", "RESOLVES_TO_MEMBER", "USES_REFERENCE", "USES_MEMBER_REFERENCE", "ALIASES",
    "DERIVES_FROM", "CALLS", "CALLS_VALUE", "INVOKES", "HAS_ARGUMENT", "HAS_PROPERTY", "HAS_OPERATION", "HAS_FLOW_BLOCK",
    "HAS_PARAMETER", "HAS_MEMBER", "RETURNS_VALUE", "SPREADS_FROM", "TYPED_AS", "TYPE_ARGUMENT", "COMPOSES_SYNTAX",
    "SIGNATURE_PARAMETER", "SIGNATURE_RETURN", "RETURN_TYPE_ARGUMENT", "USES_LITERAL", "REEXPORTS", "EXTENDS",
)
REVERSE = ("BINDS_TO_PARAMETER", "NESTED_IN")
IGNORED = ("NEXT", "TRUE", "FALSE", "REPEATS", "REJOINS", "XOR_JOIN", "BODY_ENTRY", "ENCLOSED_BY", "AST_CHILD", "ArgJoin", "FieldJoin")


def policy(spark) -> DataFrame:
    """rel_type, direction; of fixed size."""
    rows = [(t, d) for ts, d in ((FORWARD, "forward"), (REVERSE, "reverse"), (IGNORED, "ignored")) for t in ts]
    return spark.createDataFrame(rows, "rel_type string, direction string")


def inventory(relationships: DataFrame) -> DataFrame:
    """rel_type, n, disposition (``unclassified`` for types without a policy)."""
    known = F.broadcast(policy(relationships.sparkSession))
    n = relationships.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))
    return n.join(known, "rel_type", "left").select("rel_type", "n", F.coalesce("direction", F.lit("unclassified")).alias("disposition"))


def dependency_edges(edges: DataFrame) -> DataFrame:
    """src (consumer), dst (prerequisite), distinct; from src, dst, rel_type as stored."""
    known = F.broadcast(policy(edges.sparkSession).filter("direction <> 'ignored'"))
    turned = F.col("direction") == "reverse"
    rows = edges.na.drop(subset=["src", "dst"]).join(known, "rel_type")
    return rows.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst")).distinct()


def _small_waves(base: int, marks: list[str]):
    """The levels of a small rest of a graph from ``base`` on: rows (src, dst) are edges, (src, null) nodes with marks."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        consumers: dict = {}
        need: dict = {}
        bits: dict = {}
        kind = pa.string()
        for b in batches:
            kind = b.column("src").type
            own = list(zip(*[b.column(m).to_pylist() for m in marks])) if marks else [()] * b.num_rows
            for s, t, m in zip(b.column("src").to_pylist(), b.column("dst").to_pylist(), own):
                need.setdefault(s, 0)
                if t is None:
                    bits[s] = list(m)
                else:
                    need[s] += 1
                    consumers.setdefault(t, []).append(s)
        level = {n: base for n, k in need.items() if not k}
        queue = deque(level)
        while queue:
            t = queue.popleft()
            for s in consumers.get(t, ()):
                need[s] -= 1
                for i, m in enumerate(bits[t]):
                    bits[s][i] |= m
                if not need[s]:  # waves come in order, so the last prerequisite met is a highest one
                    level[s] = level[t] + 1
                    queue.append(s)
        names = list(need)
        found = [pa.array(names, kind), pa.array([level.get(n, -1) for n in names], pa.int32())]
        yield pa.RecordBatch.from_arrays([*found, *[pa.array([bits[n][i] for n in names], pa.bool_()) for i in range(len(marks))]], ["node", "level", *marks])

    return over


#: Keys of ``props_json`` that name an entity's owner, nearest first, in the two orders that are in use.
OWNER_KEYS = {
    "inventory": ("parentStepStableId", "parentFlowBlockStableId", "parentLocalFunctionStableId", "parentFnStableId"),
    "levels": ("parentFlowBlockStableId", "parentLocalFunctionStableId", "parentFnStableId"),
}


def owner_id(order: str = "inventory", props: str = "props_json"):
    """The owner that an entity names itself: the first key of the order that is there."""
    return F.coalesce(*[F.get_json_object(props, f"$.{k}") for k in OWNER_KEYS[order]])


def ownership_edges(nodes: DataFrame, run: str | None = None) -> DataFrame:
    """src (owner), dst (direct child), distinct, by the owners that ``nodes`` (stable_id, labels, props_json) name: steps
    and flow blocks belong to the block or function, others to their step. An owner that is no node has no edge. With
    ``run``, a column, owners are looked for within it, and src and dst are led by it and a space.

    The key that depends on the labels is a column first, so the join is one on equality.
    """
    has = lambda x: F.array_contains(F.coalesce("labels", F.array().cast("array<string>")), x)
    key = F.when(has("Step") | (has("Flow") & has("Block")), owner_id("levels")).otherwise(F.get_json_object("props_json", "$.parentStepStableId"))
    within = (lambda c: F.concat(F.col(run), F.lit(" "), c)) if run else lambda c: c
    child = nodes.select(within(F.col("stable_id")).alias("dst"), within(key).alias("src")).na.drop().filter("src <> dst")
    return child.join(nodes.select(within(F.col("stable_id")).alias("src")).distinct(), "src", "left_semi").select("src", "dst").distinct()


def named_owners(entities: DataFrame) -> DataFrame:
    """The rows of the entities that some row names an owner of, and of these owners: all that ``ownership_edges`` needs,
    which is little where few entities have such keys."""
    keys = ["provenance_id", "stable_id"]
    rows = entities.filter(F.col("stable_id").isNotNull())
    telling = rows.filter(F.rlike("props_json", F.lit('"parent[A-Za-z]*StableId"')))
    owners = telling.select("provenance_id", F.explode(F.array(*[F.get_json_object("props_json", f"$.{k}") for k in OWNER_KEYS["inventory"]])).alias("stable_id"))
    wanted = telling.select(*keys).union(owners.na.drop()).distinct()
    return rows.join(wanted, keys, "left_semi").select(*entities.columns)


def reconciled(levels: DataFrame, published: DataFrame) -> DataFrame:
    """problem, n: what keeps published levels (node, component, level) from being those computed: nodes that one side
    lacks, other levels, and components with more than one level; none if they may be used."""
    both = levels.select("node", F.col("component_level").alias("want")).join(published.select("node", F.col("level").alias("have"), F.lit(True).alias("there")), "node", "full")
    problem = F.when(F.col("want").isNull(), "unknown node").when(F.col("there").isNull(), "missing node").when(~F.col("want").eqNullSafe(F.col("have")), "other level")
    found = both.select(problem.alias("problem")).filter("problem is not null").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    mixed = published.groupBy("component").agg(F.min("level").alias("a"), F.max("level").alias("b")).filter("a <> b").agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(mixed.filter("n > 0").select(F.lit("mixed component").alias("problem"), "n"))


def waves(edges: DataFrame, nodes: DataFrame, small_core: int = SMALL_CORE, marks: tuple[str, ...] = ()) -> DataFrame:
    """node, level: 0 without prerequisites, else 1 + the greatest level among them; -1 on a cycle or above one.

    ``marks``: boolean columns of ``nodes``; they come out true for a node that has the mark itself or needs, however
    indirectly, one that has it (not for nodes of level -1, whose marks are their own and those of finished ones).

    One round per level: a node is done once its last prerequisite was; edges into a finished level are dropped, so
    each round reads fewer. Once the nodes still open and the edges among them are counted to be few, one task finishes them.
    Parallel edges and repeated nodes count once; a self-loop is a cycle.
    """
    live = WorkTable(edges.select("src", "dst").na.drop().distinct(), "wave-edges")
    unmarked = [F.lit(False).alias(m) for m in marks]
    nodes = nodes.select("node", *[F.coalesce(m, F.lit(False)).alias(m) for m in marks]).filter("node is not null")
    nodes = nodes.union(live.df.select("src", *unmarked)).union(live.df.select("dst", *unmarked))
    nodes = nodes.groupBy("node").agg(*[F.bool_or(m).alias(m) for m in marks]) if marks else nodes.distinct()
    need = live.df.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("need"))
    open_ = WorkTable(nodes.join(need, "node", "left").select("node", F.coalesce("need", F.lit(0)).alias("need"), *marks), "waves")
    left, among = open_.df.count(), live.df.count()
    done, level = [], 0
    while True:
        if left + among <= small_core:  # the ends of live edges are open
            none = [F.lit(None).cast("boolean").alias(m) for m in marks]
            rest = live.df.select("src", "dst", *none).union(open_.df.select(F.col("node").alias("src"), F.lit(None).alias("dst"), *marks))
            kind = rest.schema["src"].dataType.simpleString()
            done.append(rest.repartition(1).mapInArrow(_small_waves(level, list(marks)), f"node {kind}, level int" + "".join(f", {m} boolean" for m in marks)))
            return _union(done)
        ready = WorkTable(open_.df.filter("need = 0").select("node", F.lit(level).alias("level"), *marks), "waves").df
        finished = ready.count()
        if not finished:
            break
        done.append(ready)
        newest = ready.select(F.col("node").alias("dst"), *[F.col(m).alias(f"_{m}") for m in marks])
        met = live.df.join(newest, "dst").groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("met"), *[F.bool_or(f"_{m}").alias(f"_{m}") for m in marks])
        rest = open_.df.filter("need > 0").join(met, "node", "left")
        rest = rest.select("node", (F.col("need") - F.coalesce("met", F.lit(0))).alias("need"), *[(F.col(m) | F.coalesce(f"_{m}", F.lit(False))).alias(m) for m in marks])
        rest = WorkTable(rest, "waves")
        further = WorkTable(live.df.join(newest.select("dst"), "dst", "left_anti").select("src", "dst"), "wave-edges")
        for t in (open_, live):
            t.drop()
        open_, live = rest, further
        left, among = left - finished, live.df.count()
        level += 1
        if len(done) > 16:
            done = [materialize(_union(done), "waves")]
    return _union([*done, open_.df.select("node", F.lit(-1).alias("level"), *marks)])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dependency_levels(edges: DataFrame, nodes: DataFrame, unknown: DataFrame | None = None, small_core: int = SMALL_CORE) -> DataFrame:
    """node, component, component_level, structural_level, in_cycle, unknown_dependency_semantics, dependency_status.

    ``edges``: src needs dst. ``component_level`` counts waves of the graph of components, ``structural_level`` those of
    single nodes (-1 on or above a cycle). ``unknown`` (node): nodes at a relationship of unknown meaning; they and all
    their consumers are tainted. Statuses: ``cyclic-dependency``, ``depends-on-cycle``, ``acyclic``.

    One wave over the components finds both levels: a node neither on nor above a cycle has the level of its component,
    and that a prerequisite is on a cycle or tainted is carried up as a mark.
    """
    edges = materialize(edges.select("src", "dst").na.drop().distinct(), "dependency-edges")
    parts = materialize(strongly_connected(edges, nodes, small_core), "dependency-components")
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
    between = edges.join(of("src"), "src").join(of("dst"), "dst")
    between = materialize(between.select(F.col("src_c").alias("src"), F.col("dst_c").alias("dst"), (F.col("src") == F.col("dst")).alias("loop")).distinct(), "component-edges")
    loops = between.filter("loop").select(F.col("src").alias("component"), F.lit(True).alias("_loop")).distinct()
    odd = parts.select("node", "component") if unknown is None else parts.join(unknown.select("node").na.drop().distinct().withColumn("_odd", F.lit(True)), "node", "left")
    odd = odd.withColumn("_odd", F.lit(False)) if unknown is None else odd
    marked = odd.groupBy("component").agg((F.count(F.lit(1)) > 1).alias("large"), F.bool_or(F.coalesce("_odd", F.lit(False))).alias("tainted")).join(loops, "component", "left")
    marked = marked.select(F.col("component").alias("node"), (F.col("large") | F.coalesce("_loop", F.lit(False))).alias("stuck"), "tainted")
    marked = materialize(marked, "component-marks")
    found = waves(between.filter("src <> dst"), marked, small_core, ("stuck", "tainted")).withColumnRenamed("level", "component_level")
    found = found.join(marked.select("node", F.col("stuck").alias("in_cycle")), "node").withColumnRenamed("node", "component")
    out = parts.join(found, "component")
    status = F.when(F.col("in_cycle"), "cyclic-dependency").when(F.col("stuck"), "depends-on-cycle").otherwise("acyclic")
    return out.select(
        "node", "component", "component_level", F.when(F.col("stuck"), -1).otherwise(F.col("component_level")).alias("structural_level"),
        "in_cycle", F.col("tainted").alias("unknown_dependency_semantics"), status.alias("dependency_status"),
    )


def level_violations(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """violation, n: edges whose consumer isn't above its prerequisite, and nodes that break the recurrence; none if the
    levels are right."""
    of = lambda end: levels.select(F.col("node").alias(end), F.col("structural_level").alias(f"{end}_l"))
    each = edges.select("src", "dst").na.drop().distinct().join(of("src"), "src").join(of("dst"), "dst")
    order = each.filter("src_l >= 0 and not (dst_l >= 0 and dst_l < src_l)").agg(F.count(F.lit(1)).alias("n")).withColumn("violation", F.lit("order"))
    top = each.groupBy(F.col("src").alias("node")).agg(F.max("dst_l").alias("m"))
    wrong = levels.join(top, "node", "left").filter("structural_level >= 0 and structural_level <> coalesce(m + 1, 0)")
    wrong = wrong.agg(F.count(F.lit(1)).alias("n")).withColumn("violation", F.lit("recurrence"))
    other = levels.filter("structural_level >= 0 and structural_level <> component_level").agg(F.count(F.lit(1)).alias("n")).withColumn("violation", F.lit("component"))
    return order.unionByName(wrong).unionByName(other).filter("n > 0").select("violation", "n")
