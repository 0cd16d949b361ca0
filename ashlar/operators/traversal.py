"""Walks over edges (src, dst): reachability, shortest and simple paths, closures, chains, components.

Every walk is a loop of joins on the newest rows only. Each round is written to the work folder, which cuts lineage,
and rows seen before are taken out by an anti-join, so cycles end.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ashlar.runtime import WorkTable, together


def _clean(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select("src", "dst", *more).na.drop(subset=["src", "dst"])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class _Seen:
    """Rows found so far, a table for each round; all are read by one scan."""

    def __init__(self, first: DataFrame, name: str):
        self.name, self.tables = name, [WorkTable(first, name)]

    @property
    def newest(self) -> DataFrame:
        return self.tables[-1].df

    @property
    def df(self) -> DataFrame:
        return together(self.tables)

    def add(self, rows: DataFrame) -> bool:
        """Takes the next round's rows; False (and nothing kept) if there are none."""
        step = WorkTable(rows.select(*self.tables[0].df.columns), self.name)
        if step.df.isEmpty():
            step.drop()
            return False
        self.tables.append(step)
        return True


def reachable(edges: DataFrame, starts: DataFrame, most_hops: int | None = None, keep_origin: bool = True) -> DataFrame:
    """origin, node, depth (least number of edges) of all nodes reached from ``starts`` (column node), themselves at 0.

    Without ``keep_origin`` only node and depth, from any start: one row a node.
    """
    edges = WorkTable(_clean(edges).distinct(), "edges").df
    keys = ["origin", "node"] if keep_origin else ["node"]
    first = starts.select("node").na.drop().distinct().withColumn("depth", F.lit(0))
    seen = _Seen(first.withColumn("origin", F.col("node")) if keep_origin else first, "reach")
    depth = 0
    while most_hops is None or depth < most_hops:
        depth += 1
        step = seen.newest.withColumnRenamed("node", "src").join(edges, "src").select(*keys[:-1], F.col("dst").alias("node")).distinct()
        if not seen.add(step.join(seen.df.select(*keys), keys, "left_anti").withColumn("depth", F.lit(depth))):
            break
    return seen.df.select(*keys, "depth")


def transitive_closure(edges: DataFrame, most_hops: int | None = None) -> DataFrame:
    """src, dst of every pair joined by one or more edges (semi-naive: the newest pairs meet the edges)."""
    base = WorkTable(_clean(edges).distinct(), "edges").df
    seen = _Seen(base, "closure")
    hops = 1
    while most_hops is None or hops < most_hops:
        hops += 1
        step = seen.newest.select("src", F.col("dst").alias("mid")).join(base.withColumnRenamed("src", "mid"), "mid").select("src", "dst").distinct()
        if not seen.add(step.join(seen.df, ["src", "dst"], "left_anti")):
            break
    return seen.df


def least_distances(edges: DataFrame) -> DataFrame:
    """src, dst, distance (least number of edges) of all pairs of two nodes joined by edges; rounds double the distance.

    A pair further apart than the distances known so far has a node on a shortest path just that far from its src.
    """
    edges = _clean(edges).distinct().filter("src <> dst").withColumn("distance", F.lit(1))
    seen = _Seen(edges, "distances")
    span = 1
    while True:
        half = seen.df.filter(F.col("distance") == span).select("src", F.col("dst").alias("mid"))
        step = half.join(seen.df.select(F.col("src").alias("mid"), "dst", "distance"), "mid").filter("src <> dst")
        step = step.groupBy("src", "dst").agg((F.min("distance") + span).alias("distance"))
        if not seen.add(step.join(seen.df.select("src", "dst"), ["src", "dst"], "left_anti")):
            return seen.df
        span *= 2


def shortest_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, most_hops: int | None = None, nearest_only: bool = False, interior: DataFrame | None = None) -> DataFrame:
    """origin, target, hops and path (nodes) of a shortest path from each start (column node) to each target (column
    node) within ``most_hops`` if given; of equally short ones the least by order of its nodes.

    ``nearest_only``: a start's walk ends at the round of its first hit. ``interior``: nodes that a path may pass
    through (column node); starts and targets needn't be among them.
    """
    edges = WorkTable(_clean(edges).distinct(), "edges").df
    targets = WorkTable(targets.select("node").na.drop().distinct(), "targets").df
    first = starts.select(F.col("node").alias("origin"), "node").na.drop().distinct().withColumn("path", F.array("node"))
    seen = _Seen(first, "paths")
    live = seen.newest
    for _ in count() if most_hops is None else range(most_hops):
        if interior is not None and live is not first:
            live = live.filter("origin = node").unionByName(live.filter("origin <> node").join(interior.select("node"), "node", "left_semi").select(*live.columns))
        step = live.withColumnRenamed("node", "src").join(edges, "src").select("origin", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("origin", "node").agg(F.min("path").alias("path"))
        if not seen.add(step.join(seen.df.select("origin", "node"), ["origin", "node"], "left_anti")):
            break
        live = seen.newest
        if nearest_only:
            live = live.join(live.join(targets, "node", "left_semi").select("origin").distinct(), "origin", "left_anti")
    found = seen.df.filter("origin <> node").join(targets, "node", "left_semi")
    out = found.select("origin", F.col("node").alias("target"), (F.size("path") - 1).alias("hops"), "path")
    if nearest_only:
        w = W.partitionBy("origin").orderBy("hops", "target")
        out = out.withColumn("_at", F.row_number().over(w)).filter("_at = 1").drop("_at")
    return out


def simple_paths(edges: DataFrame, starts: DataFrame, most_hops: int | None = None, most_paths: int | None = None) -> DataFrame:
    """origin, path, ended (no further node) and truncated of the paths without a repeated node from each start.

    Without limits all of them come out. As their number can explode, at most ``most_paths`` per start go on to the
    next round if that is given, in the order of their nodes, and every path of a start where that or ``most_hops`` cut
    something off is marked ``truncated``.
    """
    edges = WorkTable(_clean(edges).distinct(), "edges").df
    live = WorkTable(starts.select(F.col("node").alias("origin"), F.array("node").alias("path")).na.drop().distinct(), "simple").df
    done, cut = [], []
    for _ in count() if most_hops is None else range(most_hops):
        ends = live.withColumn("src", F.element_at("path", -1))
        step = ends.join(edges, "src").filter(~F.array_contains("path", F.col("dst"))).select("origin", "path", "dst")
        step = WorkTable(step, "simple").df
        done.append(WorkTable(live.join(step.select("origin", "path").distinct(), ["origin", "path"], "left_anti"), "simple").df)
        grown = step.select("origin", F.concat("path", F.array("dst")).alias("path"))
        if most_paths is None:
            live = WorkTable(grown, "simple").df
        else:
            w = W.partitionBy("origin").orderBy("path")
            grown = WorkTable(grown.withColumn("_at", F.row_number().over(w)), "simple").df
            cut.append(grown.filter(F.col("_at") > most_paths).select("origin").distinct())
            live = grown.filter(F.col("_at") <= most_paths).drop("_at")
        if live.isEmpty():
            break
    further = live.withColumn("src", F.element_at("path", -1)).join(edges, "src").filter(~F.array_contains("path", F.col("dst"))).select("origin", "path").distinct()
    open_ = live.join(further, ["origin", "path"], "left_semi").withColumn("ended", F.lit(False))
    closed = live.join(further, ["origin", "path"], "left_anti").withColumn("ended", F.lit(True))
    out = _union([d.withColumn("ended", F.lit(True)) for d in done] + [open_, closed])
    cut = _union(cut + [open_.select("origin")]).distinct().withColumn("truncated", F.lit(True))
    return out.join(cut, "origin", "left").select("origin", "path", "ended", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def chain_walk(edges: DataFrame, starts: DataFrame, stops: DataFrame, most_hops: int | None = None) -> DataFrame:
    """origin, path, state: walks from each start along the least edge of each node until a stop: ``found``, ``cycle``
    (the next node is on the path already), ``open`` (no edge) or, where ``most_hops`` are given, ``limit``. Without
    them every walk goes to its end, as none passes a node twice."""
    least = _clean(edges).groupBy("src").agg(F.min("dst").alias("dst"))
    least = WorkTable(least, "edges").df
    stops = WorkTable(stops.select(F.col("node").alias("_stop")).na.drop().distinct(), "stops").df
    live = WorkTable(starts.select(F.col("node").alias("origin"), F.array("node").alias("path")).na.drop().distinct(), "chain").df
    done = []
    for hop in count():
        ends = live.withColumn("src", F.element_at("path", -1))
        at_stop = ends.join(stops, (F.col("src") == F.col("_stop")) & (F.size("path") > 1), "left").join(least, "src", "left")
        state = (
            F.when(F.col("_stop").isNotNull(), "found").when(F.col("dst").isNull(), "open").when(F.array_contains("path", F.col("dst")), "cycle")
        )
        step = WorkTable(at_stop.withColumn("state", F.lit("limit") if hop == most_hops else state).select("origin", "path", "dst", "state"), "chain").df
        done.append(step.filter("state is not null").select("origin", "path", "state"))
        live = step.filter("state is null").select("origin", F.concat("path", F.array("dst")).alias("path"))
        if live.isEmpty():
            break
    return _union(done)


def _fingerprint(links: DataFrame) -> tuple:
    """The number of distinct rows and two sums of their hashes, by which two sets of rows are told apart."""
    total = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    return tuple(links.agg(F.count(F.lit(1)), total("u", "v"), total(F.lit(7), "v", "u")).first())


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component: the least node of its (undirected) connected component.

    Alternating star operations: each node's larger neighbours, then its smaller ones, are linked to the least of its
    neighbourhood. Minima are partial aggregates, so a node with very many neighbours is no long task, and the number
    of rounds grows with the logarithm of the size.
    """
    everything = _clean(edges).select(F.col("src").alias("node")).union(_clean(edges).select("dst"))
    if nodes is not None:
        everything = everything.union(nodes.select("node").na.drop())
    everything = WorkTable(everything.distinct(), "nodes").df
    links = WorkTable(_clean(edges).filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "star")
    while True:
        both = links.df.select("u", "v").union(links.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are tables of their own: a join of two plain shuffles is one whose hot nodes can be split
        low = WorkTable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star").df
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = WorkTable(large, "star")
        low = WorkTable(large.df.groupBy("u").agg(F.min("v").alias("m")), "star").df
        small = large.df.join(low, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        small = WorkTable(small, "star")
        same = _fingerprint(links.df) == _fingerprint(small.df)
        links.drop()
        large.drop()
        links = small
        if same:
            break
    root = links.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return everything.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def inherited(parents: DataFrame, values: DataFrame) -> DataFrame:
    """node, value, distance: the value of the nearest node at or above with one, along ``parents`` (node, parent).

    Pointers double: nodes without a value jump to where their pointer's target points. Of several parents the least
    counts; walks into a cycle without a value end with null, as do those that reach a root without one.
    """
    up = parents.na.drop().groupBy("node").agg(F.min("parent").alias("parent"))
    own = values.select("node", "value").filter("value is not null").groupBy("node").agg(F.min("value").alias("value"))
    everything = parents.select("node").union(parents.select("parent")).union(values.select("node")).na.drop().distinct()
    state = everything.join(own, "node", "left").join(up, "node", "left")
    state = state.select("node", "value", F.when(F.col("value").isNull(), F.col("parent")).alias("at"), F.lit(1).alias("hops"), F.when(F.col("value").isNotNull(), 0).alias("distance"))
    now = WorkTable(state, "inherited")
    waiting = -1
    while True:
        target = now.df.select(F.col("node").alias("at"), F.col("value").alias("_v"), F.col("at").alias("_at"), F.col("hops").alias("_h"), F.col("distance").alias("_d"))
        step = now.df.join(target, "at", "left")
        step = step.select(
            "node", F.coalesce("value", "_v").alias("value"), F.when(F.col("value").isNull() & F.col("_v").isNull(), F.col("_at")).alias("at"),
            (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"), F.coalesce("distance", F.col("hops") + F.col("_d")).alias("distance"),
        )
        step = WorkTable(step, "inherited")
        now.drop()
        now = step
        left = now.df.filter("at is not null").count()
        if not left or left == waiting:
            return now.df.select("node", "value", "distance")
        waiting = left


def contract_chains(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """src, dst, through: edges between the nodes that stay (``anchors``, ends, and nodes with several edges in or out);
    runs of nodes with one edge in and one out become one edge with ``through`` inner nodes.

    Each inner node's pointer to its next node doubles until it points at a node that stays.
    """
    edges = WorkTable(_clean(edges).filter("src <> dst").distinct(), "edges").df
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"), F.min("dst").alias("next"))
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"))
    inner = outs.filter("o = 1").join(ins.filter("i = 1"), "node").join(anchors.select("node").na.drop().distinct(), "node", "left_anti")
    pointer = WorkTable(inner.select("node", "next", F.lit(1).alias("n")), "contract")
    waiting = -1
    while True:
        target = pointer.df.select(F.col("node").alias("next"), F.col("next").alias("_next"), F.col("n").alias("_n"))
        step = pointer.df.join(target, "next", "left")
        step = step.select("node", F.coalesce("_next", "next").alias("next"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.col("_next").isNotNull().alias("moved"))
        step = WorkTable(step, "contract")
        moved = step.df.filter("moved").count()
        if not moved or moved == waiting:  # rings without a staying node never end: they have no edge to give
            ring = step.df.filter("moved").select("node")
            ends = step.df.join(ring, "node", "left_anti").select(F.col("node").alias("dst"), F.col("next").alias("_to"), "n")
            kept = edges.join(inner.select(F.col("node").alias("src")), "src", "left_anti")
            kept = kept.join(ring.withColumnRenamed("node", "dst"), "dst", "left_anti").join(ends, "dst", "left")
            return kept.select("src", F.coalesce("_to", "dst").alias("dst"), F.coalesce("n", F.lit(0)).alias("through"))
        waiting = moved
        step.df = step.df.drop("moved")
        pointer.drop()
        pointer = step


def cycle_witness(edges: DataFrame, starts: DataFrame, most_hops: int | None = None) -> DataFrame:
    """origin, hops, path of a shortest walk from each start back to itself within ``most_hops`` if given; starts without one
    don't come out. Of equally short ones the least."""
    edges = WorkTable(_clean(edges).distinct(), "edges").df
    first = starts.select(F.col("node").alias("origin")).na.drop().distinct()
    live = first.withColumn("node", F.col("origin")).withColumn("path", F.array("origin"))
    seen = _Seen(live.limit(0), "witness")
    for _ in count() if most_hops is None else range(most_hops):
        step = live.withColumnRenamed("node", "src").join(edges, "src").select("origin", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("origin", "node").agg(F.min("path").alias("path"))
        if not seen.add(step.join(seen.df.select("origin", "node"), ["origin", "node"], "left_anti")):
            break
        back = seen.newest.filter("origin = node")
        live = seen.newest.join(back.select("origin"), "origin", "left_anti")
    found = seen.df.filter("origin = node")
    return found.select("origin", (F.size("path") - 1).alias("hops"), "path")


def common_reach(edges: DataFrame, branches: DataFrame, order: Column | None = None, most_hops: int | None = 64) -> DataFrame:
    """branch, node, depth: the nearest node that every start of a branch reaches; ``branches``: branch, node (start)."""
    reach = reachable(edges, branches.select("node"), most_hops)
    starts = branches.select("branch", F.col("node").alias("origin")).na.drop().distinct()
    want = starts.groupBy("branch").agg(F.count(F.lit(1)).alias("_want"))
    met = starts.join(reach, "origin").groupBy("branch", "node").agg(F.count(F.lit(1)).alias("_n"), F.max("depth").alias("depth"))
    met = met.join(want, "branch").filter("_n = _want")
    best = met.groupBy("branch").agg(F.min(F.struct("depth", "node")).alias("m"))
    return best.select("branch", "m.node", "m.depth")


def typed_chain(edges: DataFrame, seeds: Column, steps: Column, finish: Column) -> DataFrame:
    """origin, node: nodes that an edge meeting ``finish`` leads to at the end of a chain that begins with an edge meeting
    ``seeds`` and goes on over any number of edges meeting ``steps``; edges: src, dst and the columns the conditions use."""
    edges = WorkTable(edges, "typed-edges").df
    begin = edges.filter(seeds).select(F.col("src").alias("origin"), F.col("dst").alias("node")).na.drop().distinct()
    reach = reachable(edges.filter(steps), begin.select("node")).select(F.col("origin").alias("node"), F.col("node").alias("at"))
    ends = begin.join(reach, "node").select("origin", F.col("at").alias("src")).distinct()
    last = edges.filter(finish).select("src", F.col("dst").alias("node"))
    return ends.join(last, "src").filter("origin <> node").select("origin", "node").distinct()


def path_requests(edges: DataFrame, requests: DataFrame, most_hops: int) -> DataFrame:
    """origin, target, hops, path and status of each requested pair (origin, target): ``found``, ``same``, ``incomplete``
    (an end is null) or ``unavailable`` within ``most_hops``."""
    whole = requests.na.drop().filter("origin <> target")
    found = shortest_paths(edges, whole.select(F.col("origin").alias("node")), whole.select(F.col("target").alias("node")), most_hops)
    status = F.when(F.col("origin").isNull() | F.col("target").isNull(), "incomplete").when(F.col("origin") == F.col("target"), "same").when(F.col("hops").isNotNull(), "found").otherwise("unavailable")
    return requests.distinct().join(found, ["origin", "target"], "left").select("origin", "target", "hops", "path", status.alias("status"))
