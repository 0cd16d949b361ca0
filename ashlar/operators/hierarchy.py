"""Parent links to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.functions.ids import key128, normalize_id
from ashlar.operators.components import cyclic_nodes
from ashlar.operators.traversal import least_distances, reachable
from ashlar.runtime import WorkTable, materialize

#: The relationship types that link a child to its parent, and a parent to its child.
CHILD_TO_PARENT = ("PARENT_FOLDER", "IN_FOLDER", "DECLARED_IN", "NESTED_IN")
PARENT_TO_CHILD = ("AST_CHILD", "HAS_FLOW_BLOCK")


def parent_links(relationships: DataFrame) -> DataFrame:
    """provenance_id, child, parent of the rows that are parent links with both ends; ids as normalised, repeats kept."""
    up, down = F.col("rel_type").isin(*CHILD_TO_PARENT), F.col("rel_type").isin(*PARENT_TO_CHILD)
    rows = relationships.filter((up | down) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    a, b = normalize_id("from_id"), normalize_id("to_id")
    return rows.select("provenance_id", F.when(up, a).otherwise(b).alias("child"), F.when(up, b).otherwise(a).alias("parent"))


def _nodes(entities: DataFrame) -> DataFrame:
    rows = entities.filter(F.col("stable_id").isNotNull())
    return rows.select("provenance_id", normalize_id("stable_id").alias("stable_id"))


class _Pointers:
    """The tables of a doubling: ``done`` (k1, k2, r1, r2, depth[, path]) and ``active`` (k1, k2, a1, a2, dist[, path])."""

    def __init__(self, done: DataFrame, active: DataFrame):
        self.done, self.active = done, active


def _double(nodes: DataFrame, paths: bool) -> _Pointers:
    """``nodes``: k1, k2, p1, p2 (null for roots; every parent is a node) and with ``paths`` the node's id as ``id``.

    Each round every pointer jumps to where its target points, so it doubles its reach; the segments passed are
    concatenated. A round in which no node reaches its root leaves only those whose links lead into a cycle; the rounds
    then go on until the set of targets stays as large as it was: from there on, it is the nodes on cycles.
    """
    own = [F.array("id").alias("path")] if paths else []
    root = F.col("p1").isNull()
    keep = ["path"] if paths else []
    active = WorkTable(nodes.filter(~root).select("k1", "k2", F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.lit(1).alias("dist"), *own), "pointers")
    done = WorkTable(nodes.filter(root).select("k1", "k2", F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.lit(0).alias("depth"), *own), "resolved")
    images = None
    while True:
        target = done.df.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("r1").alias("n1"), F.col("r2").alias("n2"), F.col("depth").alias("far"), F.lit(True).alias("end"), *[F.col(c).alias("above") for c in keep])
        target = target.union(active.df.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("n1"), F.col("a2").alias("n2"), F.col("dist").alias("far"), F.lit(False).alias("end"), *keep))
        step = active.df.join(target, ["a1", "a2"]).select(
            "k1", "k2", F.col("n1").alias("a1"), F.col("n2").alias("a2"), (F.col("dist") + F.col("far")).alias("dist"), "end",
            *[F.concat("above", "path").alias("path") for _ in keep],
        )
        step = WorkTable(step, "pointers")
        seen = step.df.groupBy("end").agg(F.count(F.lit(1)).alias("n")).collect()
        resolved = sum(r["n"] for r in seen if r["end"])
        left = sum(r["n"] for r in seen if not r["end"])
        rest = step.df.filter(~F.col("end")).drop("end")
        if resolved:
            more = step.df.filter("end").select("k1", "k2", F.col("a1").alias("r1"), F.col("a2").alias("r2"), F.col("dist").alias("depth"), *keep)
            grown = WorkTable(done.df.unionByName(more), "resolved")
            done.drop()
            done = grown
        if not left:
            active.drop()
            return _Pointers(done.df, rest)
        if not resolved:
            now = rest.select("a1", "a2").distinct().count()
            if now == images:
                active.drop()
                return _Pointers(done.df, rest)
            images = now
        active.drop()
        step.df = rest  # the resolved rows stay in its files; later rounds don't read them
        active = step


class Hierarchy:
    """The parent links of every run, as 16-byte keys of (run, id).

    ``links`` (k1, k2, p1, p2) has one parent a child: of several, the one with the least key (``several`` tells
    whether there are any; cycles follow all links). A child or parent that is no entity of the run has no part in it.
    """

    def __init__(self, entities: DataFrame, relationships: DataFrame):
        self.entities, self.relationships = entities, relationships
        self.known = _nodes(entities).select(*key128("provenance_id", "stable_id")).distinct()
        ends = parent_links(relationships).select(*key128("provenance_id", "child"), *[k.alias(n) for k, n in zip(key128("provenance_id", "parent"), ("p1", "p2"))])
        each = ends.groupBy("k1", "k2").agg(*[f(c).alias(f"{n}_{c}") for c in ("p1", "p2") for n, f in (("min", F.min), ("max", F.max))])
        self.several = (F.col("min_p1") != F.col("max_p1")) | (F.col("min_p2") != F.col("max_p2"))
        self.each = WorkTable(each, "links").df
        self.all_ends = ends
        self.has_several = not self.each.filter(self.several).isEmpty()
        single = self.each.filter(~self.several).select("k1", "k2", F.col("min_p1").alias("p1"), F.col("min_p2").alias("p2"))
        if self.has_several:
            which = self.each.filter(self.several).select("k1", "k2", F.col("min_p1").alias("p1"))
            chosen = ends.join(which, ["k1", "k2", "p1"]).groupBy("k1", "k2", "p1").agg(F.min("p2").alias("p2"))
            single = single.unionByName(chosen)
        self.links = single

    def inner(self) -> DataFrame:
        """The entities that are parents, with their own parent where that is an entity too: k1, k2, p1, p2.

        Most nodes are leaves; a leaf is on no cycle and takes its path from its parent, so only the others double.
        """
        above = self.each if not self.has_several else self.all_ends.select(F.col("p1").alias("min_p1"), F.col("p2").alias("min_p2"))
        parents = above.select(F.col("min_p1").alias("k1"), F.col("min_p2").alias("k2")).distinct()
        base = WorkTable(parents.join(self.known, ["k1", "k2"], "left_semi"), "inner").df
        up = self.links.join(base, ["k1", "k2"], "left_semi")
        up = up.join(base.select(F.col("k1").alias("p1"), F.col("k2").alias("p2")), ["p1", "p2"], "left_semi")
        return base.join(up, ["k1", "k2"], "left").select("k1", "k2", "p1", "p2")

    def on_cycles(self, pointers: _Pointers) -> DataFrame:
        """Keys of the nodes whose parent links lead back to themselves."""
        if not self.has_several:
            return pointers.active.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).distinct()
        base = self.inner().select("k1", "k2")
        ends = self.all_ends.join(base, ["k1", "k2"], "left_semi")
        ends = ends.join(base.select(F.col("k1").alias("p1"), F.col("k2").alias("p2")), ["p1", "p2"], "left_semi").distinct()
        name = lambda a, b: F.concat_ws(":", a, b)
        found = cyclic_nodes(ends.select(name("k1", "k2").alias("src"), name("p1", "p2").alias("dst")))
        part = lambda i: F.split("node", ":")[i].cast("long")
        return found.select(part(0).alias("k1"), part(1).alias("k2"))


def parent_cycles(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """The entities on a cycle of parent links within one run, self-parents too: provenance_id, stable_id.

    Ids as normalised. Null endpoints, other types, and links from or to what is no entity of the run make no cycle.
    Repeated links count once; of a child with several parents every link counts.
    """
    h = Hierarchy(entities, relationships)
    found = h.on_cycles(_double(h.inner(), paths=False))
    found = materialize(found, "cycles")
    named = _nodes(entities).withColumns(dict(zip(("k1", "k2"), key128("provenance_id", "stable_id"))))
    return named.join(found, ["k1", "k2"], "left_semi").select("provenance_id", "stable_id").distinct()


def _resolved(h: Hierarchy) -> tuple[DataFrame, DataFrame]:
    """The entities of all runs (provenance_id, stable_id, k1, k2), and of the parents among them k1, k2, depth, path, status."""
    named = WorkTable(_nodes(h.entities).distinct().withColumns(dict(zip(("k1", "k2"), key128("provenance_id", "stable_id")))), "nodes").df
    ids = named.select("k1", "k2", F.col("stable_id").alias("id"))
    pointers = _double(h.inner().join(ids, ["k1", "k2"]), paths=True)
    done = pointers.done.select("k1", "k2", "depth", "path", F.lit("tree").alias("status"))
    cycle = materialize(h.on_cycles(pointers), "cycles").withColumn("on", F.lit(True))
    stuck = pointers.active.select("k1", "k2").join(cycle, ["k1", "k2"], "left")
    stuck = stuck.select("k1", "k2", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<string>").alias("path"), F.when(F.col("on"), "cycle").otherwise("to_cycle").alias("status"))
    return named, materialize(done.unionByName(stuck), "inner-paths")


def _with_leaves(h: Hierarchy, named: DataFrame, inner: DataFrame) -> DataFrame:
    """The rows of ``hierarchy`` from what ``_resolved`` gave."""
    above = inner.select(*[F.col(c).alias(f"up_{c}" if c not in ("k1", "k2") else c.replace("k", "p")) for c in inner.columns])
    rest = named.join(inner.select("k1", "k2"), ["k1", "k2"], "left_anti")
    leaves = rest.join(h.links, ["k1", "k2"], "left").join(above, ["p1", "p2"], "left")
    own = F.array("stable_id")
    leaves = leaves.select(
        "provenance_id", "stable_id",
        F.when(F.col("up_status").isNull(), 0).otherwise(F.col("up_depth") + 1).alias("depth"),
        F.when(F.col("up_status").isNull(), own).otherwise(F.concat("up_path", own)).alias("path"),
        F.when(F.col("up_status").isin("cycle", "to_cycle"), "to_cycle").otherwise("tree").alias("status"),
    )
    both = named.join(inner, ["k1", "k2"]).select("provenance_id", "stable_id", "depth", "path", "status").unionByName(leaves)
    return both.select("provenance_id", "stable_id", F.element_at("path", 1).alias("root"), "depth", "path", "status")


def hierarchy(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """For each entity of a run: provenance_id, stable_id, root, depth, path (ids from the root to it) and status
    (``tree``, ``cycle``: on a cycle, ``to_cycle``: its links lead into one; these have a null root, depth and path).

    An entity without a parent link, or whose parent is no entity of the run, is a root of depth 0. A child with
    several parents takes the one with the least key.
    """
    h = Hierarchy(entities, relationships)
    return _with_leaves(h, *_resolved(h))


def descendants(tree: DataFrame) -> DataFrame:
    """provenance_id, ancestor, descendant, distance along the paths of ``hierarchy`` alone; ``all_descendants`` follows
    cycles and further parents too."""
    steps = tree.filter(F.col("depth") > 0).select("provenance_id", F.col("stable_id").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return steps.filter(F.col("at") < F.col("depth")).select("provenance_id", "ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def all_descendants(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row for each entity of a run and each of its descendants: provenance_id, ancestor, descendant, distance (least
    number of links).

    All parents of a child count. The nodes of a cycle descend from each other, and what hangs below from all of them;
    no node descends from itself. Paths hold the ancestors of most nodes; those on or below a cycle, and those with
    several parents or below such, get theirs by doubling over all links.
    """
    h = Hierarchy(entities, relationships)
    named, inner = _resolved(h)
    tree = _with_leaves(h, named, inner)
    key = lambda a, b: F.struct(F.col(a).alias("k1"), F.col(b).alias("k2"))
    odd = inner.filter("status <> 'tree'").select("k1", "k2")
    ends = h.all_ends if h.has_several else h.links
    if h.has_several:
        known = h.known.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"))
        ends = materialize(ends.join(h.known, ["k1", "k2"], "left_semi").join(known, ["p1", "p2"], "left_semi").distinct(), "all-links")
        seeds = odd.union(h.each.filter(h.several).select("k1", "k2").join(h.known, ["k1", "k2"], "left_semi"))
        below = reachable(ends.select(key("p1", "p2").alias("src"), key("k1", "k2").alias("dst")), seeds.select(key("k1", "k2").alias("node")), keep_origin=False)
        odd = materialize(below.select("node.k1", "node.k2"), "odd")
        links = ends.join(odd, ["k1", "k2"], "left_semi")
    else:
        # every parent of such a node is one itself, and its children are known as the children of its key
        links = ends.join(odd.select(F.col("k1").alias("p1"), F.col("k2").alias("p2")), ["p1", "p2"], "left_semi").join(h.known, ["k1", "k2"], "left_semi")
    links = materialize(links.select("k1", "k2", "p1", "p2"), "odd-links")
    inside = links.join(odd.select(F.col("k1").alias("p1"), F.col("k2").alias("p2")), ["p1", "p2"], "left_semi")
    pairs = least_distances(inside.select(key("k1", "k2").alias("src"), key("p1", "p2").alias("dst")))
    ids = named.select(key("k1", "k2").alias("dst"), F.col("stable_id").alias("ancestor"))
    found = pairs.join(ids, "dst").select("src", "ancestor", "distance")
    regular = tree
    if h.has_several:
        keyed = tree.withColumns(dict(zip(("k1", "k2"), key128("provenance_id", "stable_id"))))
        regular = keyed.join(odd, ["k1", "k2"], "left_anti")
        # from the last such node of a walk upwards, the path of its parent goes on
        out = links.join(odd.select(F.col("k1").alias("p1"), F.col("k2").alias("p2")), ["p1", "p2"], "left_anti")
        above = regular.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), "depth", "path")
        out = out.join(above, ["p1", "p2"]).select(key("k1", "k2").alias("dst"), "depth", F.posexplode("path").alias("at", "ancestor"))
        own = odd.select(key("k1", "k2").alias("src"), key("k1", "k2").alias("dst"), F.lit(0).alias("distance"))
        further = pairs.unionByName(own).join(out, "dst").select("src", "ancestor", (F.col("distance") + 1 + F.col("depth") - F.col("at")).alias("distance"))
        found = found.unionByName(further.groupBy("src", "ancestor").agg(F.min("distance").alias("distance")))
    whose = named.select(key("k1", "k2").alias("src"), "provenance_id", F.col("stable_id").alias("descendant"))
    found = found.join(whose, "src").select("provenance_id", "ancestor", "descendant", "distance")
    return descendants(regular).unionByName(found)
