"""Evidence tables, innermost owners, interval joins, similarity, readiness, and walks with a stack of keys."""

from __future__ import annotations

import math
from functools import reduce
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ashlar.functions.ids import key128
from ashlar.operators import relational, traversal
from ashlar.operators.components import cyclic_nodes
from ashlar.operators.runtime_events import event_time
from ashlar.runtime import WorkTable

#: Keys of a profile, and about so many profiles of an item, that make a block; a pair of blocks gives its square at most.
BLOCK = 1000
#: Pairs of blocks that may give more rows than this are spread over tasks by the number of rows.
SPREAD = 10_000
PARTS = "array<struct<k1:bigint,k2:bigint>>"

#: The parts of a parsed plan that only read.
QUERY_PLANS = {
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Range", "Sample", "Sort",
    "SubqueryAlias", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTableValuedFunction", "UnresolvedWith", "Union", "Unpivot", "Window", "WithWindowDefinition",
}


def relation_evidence(relationships: DataFrame, entities: DataFrame, types: list[str], labels: list[str] | None = None, props: dict[str, list[str]] | None = None, every: str | None = None) -> DataFrame:
    """provenance_id and stable_id of the sources of certain relationships: of a type, from an entity with any of the
    labels, with props among given values, and, with ``every``, having all values of that prop."""
    r = relationships.filter(F.col("rel_type").isin(*types) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & (F.col("from_id") != F.col("to_id")))
    for k, values in (props or {}).items():
        r = r.filter(F.get_json_object("props_json", f"$.{k}").isin(*values))
    keys = ["provenance_id", "stable_id"]
    r = r.withColumn("stable_id", F.col("from_id"))
    if labels:
        known = entities.filter(F.arrays_overlap("labels", F.array(*[F.lit(x) for x in labels]))).select(*keys).distinct()
        r = r.join(known, keys, "left_semi")
    if every:
        want = len((props or {})[every])
        return r.groupBy(*keys).agg(F.count_distinct(F.get_json_object("props_json", f"$.{every}")).alias("_n")).filter(F.col("_n") == want).select(*keys)
    return r.select(*keys).distinct()


def innermost(owners: DataFrame) -> DataFrame:
    """The owners (node, owner) of each node that don't themselves own, however indirectly, another of its owners."""
    edges = owners.select(F.col("node").alias("src"), F.col("owner").alias("dst")).filter("src <> dst")
    above = traversal.transitive_closure(edges)
    pairs = owners.join(above.select(F.col("src").alias("owner"), F.col("dst").alias("outer")), "owner").select("node", F.col("outer").alias("owner"))
    return owners.select("node", "owner").distinct().join(pairs, ["node", "owner"], "left_anti")


def interval_join(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, first: str, last: str, width: int = 64) -> DataFrame:
    """Points with the ranges of their key that hold them (both ends belong). Ranges are laid into cells of ``width``,
    so it is an equi-join on key and cell; a range that is very long gets very many cells, so choose ``width`` for it."""
    cell = lambda c: F.floor(F.col(c) / width)
    laid = ranges.filter(F.col(first) <= F.col(last)).withColumn("_cell", F.explode(F.sequence(cell(first), cell(last))))
    return points.withColumn("_cell", cell(at)).join(laid, [*keys, "_cell"]).filter(F.col(at).between(F.col(first), F.col(last))).drop("_cell")


def _profiles(features: DataFrame, weights: dict[str, float], least: float) -> DataFrame:
    """key, p, own, items: each key with its profile, all its items as hashes with the number of their kind.

    ``p`` stands for the profile and ``own`` is its score with itself, the most it has with any; where that is below
    ``least``, or the key has no items, ``p`` is null. One row a key, so its text is shuffled once.
    """
    known = F.col("kind").isin(*weights) & F.col("item").isNotNull()
    number = F.array_position(F.array(*map(F.lit, weights)), F.col("kind")).cast("int") - 1
    item = F.when(known, F.struct(number.alias("k"), *key128("item")))
    sets = features.filter("key is not null").groupBy("key").agg(F.array_sort(F.collect_set(item)).alias("items"))
    own = sum((F.when(n > 0, w).otherwise(0.0) for n, w in zip(_sizes(weights), weights.values())), F.lit(0.0))
    p = F.when((own >= least - 1e-12) & (F.size("items") > 0), F.struct(*key128("items")))
    return WorkTable(sets.select("key", p.alias("p"), own.alias("own"), "items"), "profiles").df


def _sizes(weights: dict[str, float]) -> list[Column]:
    """How many of a profile's items are of each kind."""
    of = lambda i: F.filter("items", lambda x: x["k"] == i)
    return [F.size(of(i)) for i in range(len(weights))]


def _same_parts(weights: dict[str, float], least: float) -> Column:
    """For each smallest set of kinds whose weights reach ``least``: a profile's items of these kinds as one hash, null
    where it lacks one of the kinds. Profiles that agree in any of them are similar."""
    ws, sizes, parts, taken = list(weights.values()), _sizes(weights), [], []
    for some in chain.from_iterable(combinations(range(len(ws)), r + 1) for r in range(len(ws))):
        if sum(ws[i] for i in some) >= least - 1e-12 and not any(t <= {*some} for t in taken):
            taken.append({*some})
            all_there = reduce(lambda x, y: x & y, [sizes[i] > 0 for i in some])
            parts.append(F.when(all_there, F.struct(*key128(F.filter("items", lambda x: x["k"].isin(*some))))))
    return F.array(*parts).cast(PARTS)


def _similar_profiles(keyed: DataFrame, weights: dict[str, float], least: float, parts: Column | None = None) -> DataFrame:
    """a, b, score: the pairs of different profiles (a < b) with a score of ``least`` or more; with ``parts``, without
    those that agree in any of them.

    A profile's items are put in one order for all, from rare to frequent, over the kinds. What two profiles share then
    lies behind their first common item in both, so the shares of the items from there on, weighted, are a bound of
    their score in either: only items from which on ``least`` can be reached are joined, and a frequent item mostly
    isn't one. The candidates are scored exactly.
    """
    ws = list(weights.values())
    rows = keyed.filter("p is not null").select("p", "items").dropDuplicates(["p"])
    rows = rows.select("p", F.array(*_sizes(weights)).alias("ns"), (F.array().cast(PARTS) if parts is None else parts).alias("parts"), F.explode("items").alias("x"))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("x"))).filter("n > 1")  # others are common to none
    rows = WorkTable(rows, "profile-items").df
    onwards = W.partitionBy("p").orderBy(F.desc("n"), F.desc("x")).rowsBetween(W.unboundedPreceding, 0)
    prefix = rows.withColumn("cs", F.array(*[F.count(F.when(F.col("x.k") == i, 1)).over(onwards) for i in range(len(ws))]))
    # of the kinds that have none, 0 of 1
    prefix = prefix.filter(sum((w * F.col("cs")[i] / F.greatest(F.col("ns")[i], F.lit(1)) for i, w in enumerate(ws)), F.lit(0.0)) >= least - 1e-9)
    # items of very many profiles are joined by pairs of blocks of them
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    prefix = prefix.withColumn("m", blocks).withColumn("at", F.pmod(F.xxhash64("p"), F.col("m")).cast("int"))
    of = lambda p: [F.col(c).alias(f"{c}_{p}") for c in ("p", "ns", "cs", "parts")]
    left = prefix.select("x", F.col("at").alias("i"), F.explode(F.sequence(F.col("at"), F.col("m") - 1)).alias("j"), *of("a"))
    right = prefix.select("x", F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"), F.col("at").alias("j"), *of("b"))
    most = [F.least(F.col("cs_a")[i], F.col("cs_b")[i]) for i in range(len(ws))]
    bound = sum((w * m / F.greatest(F.col("ns_a")[i] + F.col("ns_b")[i] - m, F.lit(1)) for i, (w, m) in enumerate(zip(ws, most))), F.lit(0.0))
    pairs = left.join(right, ["x", "i", "j"]).filter(((F.col("i") < F.col("j")) | (F.col("p_a") < F.col("p_b"))) & (bound >= least - 1e-9))
    agree = F.exists(F.arrays_zip("parts_a", "parts_b"), lambda z: F.coalesce(z["parts_a"] == z["parts_b"], F.lit(False)))
    pairs = pairs if parts is None else pairs.filter(~agree)
    pairs = pairs.select(F.least("p_a", "p_b").alias("a"), F.greatest("p_a", "p_b").alias("b")).distinct()
    side = lambda p: rows.select(F.col("p").alias(p), "x", F.get("ns", F.col("x.k")).alias(f"n{p}"))
    shared = pairs.join(side("a"), "a").join(side("b"), ["b", "x"]).groupBy("a", "b", F.col("x.k").alias("k"), "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    part = F.get(F.array(*map(F.lit, ws)), F.col("k")) * F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))
    scored = shared.groupBy("a", "b").agg(F.sum(part).alias("score"))
    return WorkTable(scored.filter(F.col("score") >= least - 1e-12), "similar").df


def weighted_similarity(features: DataFrame, weights: dict[str, float], least: float) -> DataFrame:
    """Pairs (a < b) of keys with a weighted sum of Jaccard overlaps by kind of ``least`` or more: a, b, score.

    ``features``: key, kind, item; weights add up to 1. Keys with the same items are one profile: profiles are compared,
    and keys paired only in the output, from blocks of a profile's keys. So what is shuffled grows with the keys and the
    pairs of profiles, not with the pairs of keys; and blocks that give many pairs are spread over tasks by their number.
    """
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must add up to 1")
    keyed = _profiles(features, weights, least)
    similar = _similar_profiles(keyed, weights, least)
    at = F.floor((F.row_number().over(W.partitionBy("p").orderBy("key")) - 1) / BLOCK)
    laid = keyed.filter("p is not null").select("p", "own", "key", at.cast("int").alias("at"))
    blocks = laid.groupBy("p", "at").agg(F.max("own").alias("score"), F.array_sort(F.collect_list("key")).alias("keys"))
    blocks = WorkTable(blocks.withColumn("n", F.size("keys").cast("long")), "blocks").df
    light = blocks.filter(F.col("n") * F.col("n") <= SPREAD).select("score", "keys", F.posexplode("keys").alias("i", "a"))
    light = light.select("a", F.explode(F.slice("keys", F.col("i") + 2, F.size("keys"))).alias("b"), "score")
    side = lambda p, i, *more: blocks.select(F.col("p").alias(p), F.col("at").alias(i), *more)
    other = similar.join(side("a", "i", F.col("n").alias("na")), "a").join(side("b", "j", F.col("n").alias("nb")), "b")
    other = other.select("a", "i", "b", "j", "score", (F.col("na") * F.col("nb")).alias("n"))
    upto = F.when(F.col("n") * F.col("n") > SPREAD, F.col("at")).otherwise(F.col("at") - 1)
    same = blocks.withColumn("upto", upto).filter("upto >= 0").select(F.col("p").alias("a"), F.explode(F.sequence(F.lit(0), "upto")).alias("i"), F.col("p").alias("b"), F.col("at").alias("j"), "score", (F.col("n") * BLOCK).alias("n"))
    links = WorkTable(other.unionByName(same), "links").df
    heavy = F.col("n") > SPREAD
    rows = links.filter(heavy).agg(F.sum("n")).first()[0] or 0

    def paired(links: DataFrame, tasks: int = 0) -> DataFrame:
        both = links.join(side("a", "i", F.col("keys").alias("left")), ["a", "i"]).join(side("b", "j", F.col("keys").alias("right")), ["b", "j"])
        both = both.repartition(tasks, "a", "i", "b", "j") if tasks else both
        itself = (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))
        both = both.select("score", itself.alias("itself"), "right", F.explode("left").alias("x")).select("score", "itself", "x", F.explode("right").alias("y"))
        return both.filter("not itself or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")

    out = light.unionByName(paired(links.filter(~heavy)))
    return out.unionByName(paired(links.filter(heavy), math.ceil(rows / (BLOCK * BLOCK)))) if rows else out


def similarity_components(features: DataFrame, weights: dict[str, float], least: float) -> DataFrame:
    """node, component: groups of keys joined by similar pairs; keys without one are groups of their own.

    No pairs of keys are made: those of one profile are similar if the profile can be similar to any. Profiles that agree
    in enough kinds are linked to the least of them, and only others compared. As a profile is in one group at most by
    the first such kinds, these groups are the nodes that the rest is linked by.
    """
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("weights must add up to 1")
    keyed = _profiles(features, weights, least)
    parts = _same_parts(weights, least)
    similar = _similar_profiles(keyed, weights, least, parts)
    profiles = keyed.filter("p is not null").select("p", "key", parts.alias("parts")).groupBy("p").agg(F.min("key").alias("first"), F.first("parts").alias("parts"))
    profiles = WorkTable(profiles.withColumn("g", F.coalesce(F.get("parts", F.lit(0)), "p")), "profiles").df
    groups = WorkTable(profiles.groupBy("g").agg(F.min("p").alias("group"), F.min("first").alias("first")), "groups").df
    member = WorkTable(profiles.select("p", "g", "parts").join(groups.select("g", "group"), "g").select("p", "group", "parts"), "members").df
    of = lambda x, to: member.select(F.col("p").alias(x), F.col("group").alias(to))
    links = similar.join(of("a", "src"), "a").join(of("b", "dst"), "b").select("src", "dst")
    others = member.select("group", F.posexplode("parts").alias("i", "part")).filter("i > 0 and part is not null").distinct()
    others = WorkTable(others, "parts").df
    stars = others.join(others.groupBy("i", "part").agg(F.min("group").alias("dst")), ["i", "part"]).select(F.col("group").alias("src"), "dst")
    links = WorkTable(links.union(stars).filter("src <> dst").distinct(), "links").df
    roots = traversal.components(links).select(F.col("node").alias("group"), F.col("component").alias("root"))
    named = WorkTable(groups.select("group", "first").join(roots, "group", "left"), "roots").df
    of_root = named.filter("root is not null").groupBy("root").agg(F.min("first").alias("component"))
    named = named.join(of_root, "root", "left").select("group", F.coalesce("component", "first").alias("component"))
    named = member.select("p", "group").join(named, "group").select("p", "component")
    alone = keyed.filter("p is null").select(F.col("key").alias("node"), F.col("key").alias("component"))
    return keyed.filter("p is not null").join(named, "p").select(F.col("key").alias("node"), "component").unionByName(alone)


def readiness(edges: DataFrame, nodes: DataFrame, blocked: DataFrame, doubtful: DataFrame) -> DataFrame:
    """node, state: what stands in a node's way among itself and all it needs (``edges``: src needs dst): ``cyclic`` if
    it lies on a cycle, else ``blocked``, ``waits-on-cycle``, ``doubtful`` or ``ready``, the first that holds."""
    cyclic = WorkTable(cyclic_nodes(edges), "cyclic").df
    consumers = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    everything = nodes.select("node").union(edges.select("src")).union(edges.select("dst")).na.drop().distinct()
    out = everything.join(cyclic.withColumn("c0", F.lit(True)), "node", "left")
    for name, start in (("b", blocked), ("c", cyclic), ("d", doubtful)):
        out = out.join(traversal.reachable(consumers, start, keep_origin=False).select("node", F.lit(True).alias(name)), "node", "left")
    state = F.when(F.col("c0"), "cyclic").when(F.col("b"), "blocked").when(F.col("c"), "waits-on-cycle").when(F.col("d"), "doubtful").otherwise("ready")
    return out.select("node", state.alias("state"))


def slice_between(edges: DataFrame, roots: DataFrame, targets: DataFrame) -> DataFrame:
    """The edges on walks from a root to a target: both ends reached forwards from roots and backwards from targets."""
    forwards = traversal.reachable(edges, roots, keep_origin=False)
    backwards = traversal.reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), targets, keep_origin=False)
    inside = WorkTable(forwards.select("node").join(backwards.select("node"), "node"), "slice").df
    kept = edges.select("src", "dst").distinct().join(inside.withColumnRenamed("node", "src"), "src", "left_semi")
    return kept.join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def stack_walk(edges: DataFrame, starts: DataFrame, most_hops: int = 64, most_keys: int = 8) -> DataFrame:
    """Where values go with their property paths: origin, node, keys (the stack), hops, cut.

    ``edges``: src, dst, op (``pass``, ``push``, ``pop``), key. A push puts the key on the stack; a pop is taken only if
    its key is on top, or, with an empty stack, not at all. States (node and stack) are visited once an origin. As stacks
    can grow without end around a cycle, a push beyond ``most_keys`` isn't taken and no walk is longer than ``most_hops``;
    ``cut`` tells at which states either ended a walk that would have gone on.
    """
    edges = WorkTable(edges.select("src", "dst", "op", "key").na.drop(subset=["src", "dst", "op"]).distinct(), "stack-edges").df
    first = starts.select(F.col("node").alias("origin"), "node").na.drop().distinct().withColumn("keys", F.array().cast("array<string>")).withColumn("hops", F.lit(0))
    seen = traversal._Seen(first, "stack")
    state = ["origin", "node", "keys"]
    top = F.col("key").eqNullSafe(F.try_element_at("keys", F.lit(-1)))
    moves = F.col("op").isin("pass", "push") | ((F.col("op") == "pop") & (F.size("keys") > 0) & top)
    for hop in range(1, most_hops + 1):
        step = seen.newest.withColumnRenamed("node", "src").join(edges, "src")
        step = step.filter(moves & ((F.col("op") != "push") | (F.size("keys") < most_keys)))
        keys = F.when(F.col("op") == "push", F.concat("keys", F.array("key"))).when(F.col("op") == "pop", F.slice("keys", F.lit(1), F.greatest(F.size("keys") - 1, F.lit(0)))).otherwise(F.col("keys"))
        step = step.select("origin", F.col("dst").alias("node"), keys.alias("keys")).distinct()
        if not seen.add(step.join(seen.df.select(*state), state, "left_anti").withColumn("hops", F.lit(hop))):
            break
    ends = seen.df.filter((F.col("hops") == most_hops) | (F.size("keys") >= most_keys)).withColumnRenamed("node", "src").join(edges, "src")
    ends = ends.filter(moves & ((F.col("hops") == most_hops) | (F.col("op") == "push"))).select("origin", F.col("src").alias("node"), "keys").distinct()
    return seen.df.join(ends.withColumn("cut", F.lit(True)), state, "left").select(*state, "hops", F.coalesce("cut", F.lit(False)).alias("cut"))


def bounded_closure(edges: DataFrame, starts: DataFrame, hops: int, most_nodes: int) -> DataFrame:
    """origin, node, depth, truncated: what each start reaches within ``hops``, nearest first, at most ``most_nodes`` a
    start as a report; ``truncated`` tells that there is more."""
    reach = traversal.reachable(edges, starts, hops)
    w = W.partitionBy("origin")
    ranked = reach.withColumn("_at", F.row_number().over(w.orderBy("depth", "node"))).withColumn("truncated", F.count(F.lit(1)).over(w) > most_nodes)
    return ranked.filter(F.col("_at") <= most_nodes).drop("_at")


def best_tier(candidates: DataFrame, keys: list[str], tiers: list[Column]) -> DataFrame:
    """Each key's candidates of the first tier that any of them meets: with tier (from 1) and ambiguous (several)."""
    tier = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(tiers, 1)])
    found = relational.nearest_tier(candidates.withColumn("tier", tier), keys, "tier")
    return found.withColumn("ambiguous", F.count(F.lit(1)).over(W.partitionBy(*keys)) > 1)


def stage_merge(sections: DataFrame, keys: list[str], order: str, steps: str, exits: str, budget: int = 60) -> DataFrame:
    """With ``stage``: neighbouring sections drawn together until the sum of their steps would pass ``budget``, or one
    ends in an exit. The sum starts anew at each stage, so it is folded over each key's ordered list, which is short."""
    item = F.struct(order, F.coalesce(steps, F.lit(0)).cast("long").alias("n"), F.coalesce(exits, F.lit(False)).alias("out"), *[F.col(c) for c in sections.columns if c not in (*keys, order, steps, exits)])
    lists = sections.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(1).alias("stage"), F.lit(0).cast("long").alias("sum"), F.lit(False).alias("out"), F.array().cast("array<int>").alias("stages"))

    def step(acc: Column, x: Column) -> Column:
        new = (F.size(acc.stages) > 0) & (acc.out | (acc["sum"] + x.n > budget))
        stage = acc.stage + new.cast("int")
        return F.struct(stage.alias("stage"), F.when(new, x.n).otherwise(acc["sum"] + x.n).alias("sum"), x.out.alias("out"), F.concat(acc.stages, F.array(stage)).alias("stages"))

    folded = lists.withColumn("stages", F.aggregate("items", start, step, lambda acc: acc.stages))
    each = folded.select(*keys, F.explode(F.arrays_zip("items", "stages")).alias("z"))
    return each.select(*keys, *[F.col(f"z.items.{order}").alias(order), F.col("z.items.n").alias(steps), F.col("z.items.out").alias(exits)], F.col("z.stages").alias("stage"))


def runtime_graph(records: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runtime nodes and their edges: parents, and ``STATIC_DEF`` to the entity a record stands for, where known."""
    from ashlar.functions.ids import normalize_id

    rows = records.filter("node_id is not null").withColumn("anchor", normalize_id("function_stable_id"))
    nodes = rows.groupBy("node_id").agg(F.array_sort(F.collect_set("kind")).alias("labels"), F.min(event_time()).alias("first_ms"))
    known = entities.select(normalize_id("stable_id").alias("anchor")).na.drop().distinct()
    parents = rows.filter("parent_node_id is not null").select("node_id", F.col("parent_node_id").alias("to_id")).distinct().join(nodes.select(F.col("node_id").alias("to_id")), "to_id", "left_semi")
    anchors = rows.select("node_id", "anchor").na.drop().distinct().join(known, "anchor", "left_semi")
    edges = parents.select(F.col("node_id").alias("from_id"), F.lit("PARENT").alias("rel_type"), "to_id").union(anchors.select("node_id", F.lit("STATIC_DEF"), "anchor"))
    return nodes, edges


def select_events(records: DataFrame, session: str | None = None, correlation: str | None = None, node: str | None = None) -> DataFrame:
    """Events by the strongest selector given (session, then correlation, then node), widened to the whole sessions of
    what it finds."""
    for column, value in (("session_id", session), ("correlation_id", correlation), ("node_id", node)):
        if value is not None:
            hit = records.filter(F.col(column) == value)
            if column == "session_id":
                return hit
            return records.join(hit.select("session_id").na.drop().distinct(), "session_id", "left_semi").select(*records.columns).unionByName(hit.filter("session_id is null"))
    raise ValueError("a selector is needed")


def read_only(spark: SparkSession, sql: str) -> DataFrame:
    """The result of one query; anything that isn't a query (by the parsed plan, not by words in it) is refused."""
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
    while todo:
        plan = todo.pop()
        if plan.getClass().getSimpleName() not in QUERY_PLANS:
            raise PermissionError(f"only queries are allowed, not {plan.getClass().getSimpleName()}")
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return spark.sql(sql)
