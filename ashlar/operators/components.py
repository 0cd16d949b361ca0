"""Strongly connected components by trimming and colouring."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.runtime import WorkTable

#: What is left of a graph is finished in one task once it was counted to have at most so many edges; the results are
#: the same either way, this only saves the many short rounds of a long tail.
SMALL_CORE = 100_000


def _tarjan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and component (its least node) of a small graph, without recursion."""
    out_of: dict = {}
    kind = pa.string()
    for b in batches:
        kind = b.column("src").type
        for s, t in zip(b.column("src").to_pylist(), b.column("dst").to_pylist()):
            out_of.setdefault(s, []).append(t)
            out_of.setdefault(t, [])
    index: dict = {}
    low: dict = {}
    stack, on, found = [], set(), {}
    for root in out_of:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        work = [(root, iter(out_of[root]))]
        while work:
            v, rest = work[-1]
            w = next(rest, None)
            if w is not None:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out_of[w])))
                elif w in on:
                    low[v] = min(low[v], index[w])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[v])
            if low[v] == index[v]:
                part = [stack.pop()]
                while part[-1] != v:
                    part.append(stack.pop())
                on.difference_update(part)
                found |= dict.fromkeys(part, min(part))
    yield pa.RecordBatch.from_arrays([pa.array(list(found), kind), pa.array(list(found.values()), kind)], ["node", "component"])


def _spread(labels: DataFrame, edges: DataFrame, name: str) -> WorkTable:
    """The least label that reaches each node along the edges (node -> label); edges: src, dst."""
    now = WorkTable(labels, name)
    while True:
        came = edges.join(now.df.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("offer"))
        step = now.df.join(came, "node", "left")
        step = step.select("node", F.least("label", F.coalesce("offer", "label")).alias("label"), (F.col("offer") < F.col("label")).alias("moved"))
        step = WorkTable(step, name)
        moved = not step.df.filter("moved").isEmpty()
        now.drop()
        now = step
        now.df = step.df.drop("moved")
        if not moved:
            return now


def strongly_connected(edges: DataFrame, nodes: DataFrame | None = None, small_core: int = SMALL_CORE) -> DataFrame:
    """node, component (the least node of it) and size-one components too; edges: src, dst, of any one orderable type.

    Nodes without an edge in or out are components of their own and are trimmed first, again and again. In what is
    left, every node takes the least node that reaches it as colour; those that reach their colour's node inside the
    colour are its component; the rest goes round again. Null ends are no edges; repeated ones count once.
    """
    edges = edges.select("src", "dst").na.drop()
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    edges = WorkTable(edges.filter("src <> dst").distinct(), "scc-edges")
    everything = (ends if nodes is None else ends.union(nodes.select("node").na.drop())).distinct()
    everything = WorkTable(everything, "scc-nodes")
    found: list[DataFrame] = []
    live = edges
    size = live.df.count()
    while size:
        while size > small_core:  # trim
            src, dst = live.df.select("src").distinct(), live.df.select("dst").distinct()
            core = src.join(dst.withColumnRenamed("dst", "src"), "src", "left_semi")
            rest = live.df.join(core, "src", "left_semi").join(core.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")
            rest = WorkTable(rest, "scc-edges")
            left = rest.df.count()
            same = left == size
            live, size = rest, left
            if same or size <= small_core:
                break
        if size <= small_core:
            kind = live.df.schema["src"].dataType.simpleString()
            found.append(live.df.repartition(1).mapInArrow(_tarjan, f"node {kind}, component {kind}"))
            break
        start = live.df.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
        colour = _spread(start, live.df, "scc-colour")
        back = live.df.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        of = lambda end: colour.df.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        inside = WorkTable(back.join(of("src"), "src").join(of("dst"), "dst").filter("src_label = dst_label").select("src", "dst"), "scc-inside")
        reach = _reach(colour.df, inside.df)
        part = WorkTable(reach.select("node", F.col("label").alias("component")), "scc-part")
        found.append(part.df)
        gone = part.df.select(F.col("node").alias("src"))
        rest = live.df.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst")
        live = WorkTable(rest, "scc-edges")
        size = live.df.count()
    out = None
    for part in found:
        out = part if out is None else out.unionByName(part)
    if out is None:
        return everything.df.withColumn("component", F.col("node"))
    out = everything.df.join(out, "node", "left")
    return out.select("node", F.coalesce("component", "node").alias("component"))


def _reach(colour: DataFrame, back: DataFrame) -> DataFrame:
    """The nodes from which their colour's own node can be reached, along reversed edges inside the colour."""
    newest = WorkTable(colour.filter(F.col("node") == F.col("label")), "scc-reach")
    seen = newest
    while True:
        step = back.join(newest.df.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "label").distinct()
        newest = WorkTable(step.join(seen.df.select("node"), "node", "left_anti"), "scc-reach")
        if newest.df.isEmpty():
            return seen.df
        seen = WorkTable(seen.df.unionByName(newest.df), "scc-reach")


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """The nodes on a cycle: in a component of several nodes, or with an edge to themselves."""
    parts = strongly_connected(edges)
    large = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    loops = edges.filter("src = dst").select(F.col("src").alias("node"))
    return parts.join(large, "component", "left_semi").select("node").union(loops).distinct()
