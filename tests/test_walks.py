"""Walks and relational building blocks against plain Python on random rows."""

import random
from collections import defaultdict

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ashlar.functions.ids import coordinate, normalize_id, normalized_sql
from ashlar.functions.json_values import facts, spelled
from ashlar.operators import classification as cl
from ashlar.operators import levels, relational, traversal
from ashlar.operators import runtime_events as rt
from ashlar.plans import context_queries, graph_queries
from tests import brute

EDGE = "src string, dst string"


def edges(spark, pairs):
    return spark.createDataFrame(pairs, EDGE)


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node string")


def random_pairs(seed, n=25, m=35):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)]


def shortest(pairs, start):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    best, todo = {start: [start]}, [start]
    while todo:
        step = {}
        for x in todo:
            for y in out[x]:
                if y not in best:
                    path = best[x] + [y]
                    if y not in step or path < step[y]:
                        step[y] = path
        best |= step
        todo = list(step)
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_reach_closure_and_paths(spark, seed):
    pairs = random_pairs(seed)
    e = edges(spark, [*pairs, (None, "n00"), ("n00", None), pairs[0]])
    starts = ["n00", "n05", "lonely"]
    found = {(r["origin"], r["node"]): r["depth"] for r in traversal.reachable(e, nodes(spark, [*starts, None])).collect()}
    want = {(s, n): len(p) - 1 for s in starts for n, p in shortest(pairs, s).items()}
    assert found == want
    targets = [f"n{i:02}" for i in range(0, 25, 4)]
    paths = {(r["origin"], r["target"]): r["path"] for r in traversal.shortest_paths(e, nodes(spark, starts), nodes(spark, targets), 30).collect()}
    assert paths == {(s, t): p for s in starts for t, p in shortest(pairs, s).items() if t in targets and t != s}
    nearest = {r["origin"]: (r["hops"], r["target"]) for r in traversal.shortest_paths(e, nodes(spark, starts), nodes(spark, targets), 30, nearest_only=True).collect()}
    assert nearest == {s: min((len(p) - 1, t) for (o, t), p in paths.items() if o == s) for s in {o for o, _ in paths}}
    closure = {(r["src"], r["dst"]) for r in traversal.transitive_closure(e).collect()}
    sources = {a for a, _ in pairs}
    assert closure == {(a, n) for a in sources for b in {y for x, y in pairs if x == a} for n in shortest(pairs, b)}


def test_depth_limits_and_interiors(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(6)]
    e = edges(spark, chain)
    assert traversal.reachable(e, nodes(spark, ["n0"]), 3).count() == 4
    found = traversal.shortest_paths(e, nodes(spark, ["n0"]), nodes(spark, ["n2", "n3"]), 9, interior=nodes(spark, ["n1"])).collect()
    assert [r["target"] for r in found] == ["n2"]


def test_simple_paths_and_truncation(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")])
    got = {tuple(r["path"]): (r["ended"], r["truncated"]) for r in traversal.simple_paths(e, nodes(spark, ["a", "z"]), 9, 9).collect()}
    assert got == {("a", "b", "d"): (True, False), ("a", "c", "d"): (True, False), ("z",): (True, False)}
    cut = traversal.simple_paths(e, nodes(spark, ["a"]), 1, 1).collect()
    assert [(r["path"], r["truncated"]) for r in cut] == [(["a", "b"], True)]


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_connected_components(spark, seed):
    pairs = random_pairs(seed, 40, 30) + [("hub", f"h{i}") for i in range(200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(parent)}
    got = {r["node"]: r["component"] for r in traversal.components(edges(spark, pairs), nodes(spark, ["single"])).collect()}
    assert got == want | {"single": "single"}


def test_inherited_values(spark):
    parents = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("e", "d"), ("r", None)], "node string, parent string")
    values = spark.createDataFrame([("a", "A"), ("d", "D"), ("c", None)], "node string, value string")
    got = {r["node"]: (r["value"], r["distance"]) for r in traversal.inherited(parents, values).collect()}
    assert got == {"a": ("A", 0), "b": ("A", 1), "c": ("A", 2), "d": ("D", 0), "e": ("D", 1), "x": (None, None), "y": (None, None), "r": (None, None)}


def test_contraction(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("d", "f"), ("f", "g"), ("p", "q"), ("q", "p")]
    got = {(r["src"], r["dst"], r["through"]) for r in traversal.contract_chains(edges(spark, pairs), nodes(spark, ["f"])).collect()}
    assert got == {("a", "d", 2), ("d", "e", 0), ("d", "f", 0), ("f", "g", 0)}


def test_witnesses_and_chains(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("x", "y"), ("s", "s")])
    got = {r["origin"]: r["path"] for r in traversal.cycle_witness(e, nodes(spark, ["a", "c", "x", "s"]), 5).collect()}
    assert got == {"a": ["a", "b", "a"], "c": ["c", "a", "b", "c"], "s": ["s", "s"]}
    walked = {r["origin"]: (r["path"], r["state"]) for r in traversal.chain_walk(e, nodes(spark, ["a", "x", "c"]), nodes(spark, ["y"])).collect()}
    assert walked == {"a": (["a", "b"], "cycle"), "x": (["x", "y"], "found"), "c": (["c", "a", "b"], "cycle")}


def test_levels_with_a_cycle_and_taint(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("z", "c"), ("l", "l")])
    found = {r["node"]: r for r in levels.dependency_levels(e, nodes(spark, ["lone"]), nodes(spark, ["b"])).collect()}
    assert [found[n]["structural_level"] for n in "abcxzl"] == [2, 1, 0, -1, -1, -1]
    assert [found[n]["dependency_status"] for n in ("x", "z", "lone", "l")] == ["cyclic-dependency", "depends-on-cycle", "acyclic", "cyclic-dependency"]
    assert found["z"]["component_level"] == 1 and {n for n in found if found[n]["unknown_dependency_semantics"]} == {"a", "b"}
    assert levels.level_violations(e, levels.dependency_levels(e, nodes(spark, []))).isEmpty()


def test_owners_by_property(spark):
    rows = [("f", ["Fn"], "{}"), ("s", ["Step"], '{"parentFnStableId":"f","parentStepStableId":"x"}'), ("b", ["Flow", "Block"], '{"parentFlowBlockStableId":"b","parentFnStableId":"f"}'), ("v", ["Value"], '{"parentStepStableId":"s"}'), ("w", None, '{"parentStepStableId":"gone"}')]
    n = spark.createDataFrame(rows, "stable_id string, labels array<string>, props_json string")
    assert {tuple(r) for r in levels.ownership_edges(n).collect()} == {("f", "s"), ("s", "v")}
    assert [r[0] for r in n.orderBy("stable_id").select(levels.owner_id()).collect()] == ["b", None, "x", "s", "gone"]


def test_published_levels_are_reconciled(spark):
    found = levels.dependency_levels(edges(spark, [("a", "b"), ("c", "d"), ("d", "c")]), nodes(spark, []))
    published = spark.createDataFrame([("a", "a", 1), ("b", "b", 7), ("c", "c", 0), ("z", "c", 2)], "node string, component string, level int")
    assert {(r["problem"], r["n"]) for r in levels.reconciled(found, published).collect()} == {("other level", 1), ("unknown node", 1), ("missing node", 1), ("mixed component", 1)}
    right = found.select("node", "component", F.col("component_level").alias("level"))
    assert levels.reconciled(found, right).isEmpty()


def test_join_points(spark):
    e = edges(spark, [("t", "m"), ("f", "g"), ("g", "m"), ("m", "end")])
    branches = spark.createDataFrame([("if", "t"), ("if", "f")], "branch string, node string")
    assert [tuple(r) for r in traversal.common_reach(e, branches).collect()] == [("if", "m", 2)]


def test_windows_and_top(spark):
    rng = random.Random(8)
    rows = [(f"k{rng.randrange(4)}", i, rng.choice(["a", "b", None]), rng.randrange(9)) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, i int, v string, x int")
    staged = {(r["k"], r["i"]): r["stage"] for r in relational.runs_of_equal(df, ["k"], ["i"], "v").collect()}
    last = {}
    for k, i, v, _ in rows:
        stage, before = last.get(k, (0, object()))
        last[k] = (stage + (v != before), v)
        assert staged[k, i] == last[k][0]
    got = {r["k"]: r["x"] for r in relational.rank_percentile(df, ["k"], "x", 0.9).collect()}
    by = defaultdict(list)
    for k, _, _, x in rows:
        by[k].append(x)
    assert got == {k: sorted(v)[min(len(v) - 1, int(len(v) * 0.9))] for k, v in by.items()}
    prior = {r["i"]: r["p"] for r in relational.prior_value(df, ["k"], ["i"], "v", "p").collect()}
    seen = {}
    for k, i, v, _ in rows:
        assert prior[i] == seen.get(k)
        seen[k] = v or seen.get(k)
    assert relational.top_per_group(df, ["k"], ["i"], 2).count() == 8
    with pytest.raises(ValueError):
        relational.page(df, ["i"], 0)
    assert [r["more"] for r in relational.with_overflow(df, ["i"], 119).limit(1).collect()] == [True]


def test_as_of_join(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), (None, 1)], "k string, at int")
    events = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y"), ("a", 5, "z"), ("c", 1, "q")], "k string, at int, v string")
    got = {(r["k"], r["at"]): r["latest_v"] for r in relational.latest_before(rows, events, ["k"], "at", ["v"]).collect()}
    assert got == {("a", 5): "y", ("a", 1): None, ("b", 9): None, (None, 1): None}


def test_jaccard_loses_no_pair(spark):
    rng = random.Random(9)
    sets = {f"s{i}": {f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 7))} for i in range(60)}
    df = spark.createDataFrame([(k, w) for k, ws in sets.items() for w in ws], "k string, w string")
    got = {(r["a"], r["b"]): round(r["jaccard"], 6) for r in relational.jaccard_pairs(df, "k", "w", 0.5).collect()}
    want = {(a, b): round(len(x & y) / len(x | y), 6) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) / len(x | y) >= 0.5}
    assert got == want


def test_sets_and_keys(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "x int") for xs in ([1, 1, 2], [1, 3]))
    assert sorted(map(tuple, relational.bag_difference(a, b).collect())) == [(1, "left"), (2, "left"), (3, "right")]
    assert sorted(r[0] for r in relational.insert_new(a, b, ["x"]).collect()) == [1, 1, 2, 3]
    assert [r[0] for r in relational.delete_where(a, b, ["x"]).collect()] == [2]
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", None, "y")], "k string, o int, v string")
    assert {tuple(r) for r in relational.last_wins(df, ["k"], "o").collect()} == {("a", 2, None), ("b", None, "y")}


SPECIFIERS = {"react": "react", "@a/b/c": "@a/b", "@a": None, "./x": None, "/x": None, "fs": None, "fs/promises": None, "node:fs": None, " lodash/get ": "lodash", "": None, None: None}


def test_names_paths_and_lists(spark):
    df = spark.createDataFrame([(s,) for s in SPECIFIERS], "s string")
    assert {r["s"]: r["p"] for r in df.select("s", cl.package_name("s").alias("p")).collect()} == SPECIFIERS
    lists = {'["a","b"]': ["a", "b"], "a, b\tc": ["a", "b", "c"], "": [], None: [], "[broken": ["[broken"]}
    df = spark.createDataFrame([(s,) for s in lists], "s string")
    assert {r["s"]: r["l"] for r in df.select("s", cl.string_list("s").alias("l")).collect()} == lists
    df = spark.createDataFrame([("src/a/b/c/d.ts",), ("x.ts",), ("a/x.ts",)], "p string")
    assert [r[0] for r in df.select(cl.folder_surface("p")).collect()] == ["src/a/b", "x.ts", "a"]
    df = spark.createDataFrame([(120, 1, 1), (1, 60, 2), (1, 1, 1)], "l int, s int, g int")
    assert [r["size_class"] for r in df.select(*cl.size_class("l", "s", "g")).collect()] == ["large", "large", "small"]


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.recursive(st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=6), st.integers(0, 1))
def test_json_spelling_keeps_equality(value, other):
    import json

    text = json.dumps({"k": value}, indent=other or None)
    same = facts(text).get("k")
    assert spelled(same) == spelled(facts(json.dumps({"k": value}))["k"])
    assert (spelled(same) == spelled(facts('{"k": 1}')["k"])) == (brute.canon(value) == brute.canon(1))


#: Written by hand from the rules of the id format.
IDS = {
    "p.ts:1:2:3:4": "p.ts:1:2:3:4",
    "p.ts:1:2:3:4:slot": "p.ts:1:2:3:4",
    "p.ts:1:2:3:4:slot:more": "p.ts:1:2:3:4",
    "p.ts:1:2:3:4:": "p.ts:1:2:3:4",
    "p.ts:1:2:3:4:0": "p.ts:1:2:3:4:0",  # path p.ts:1, lines 2 to 4
    "p.ts:1:2:3:4:5:6": "p.ts:1:2:3:4:5:6",  # path p.ts:1:2
    "p.ts:1:2:3:4:slot:5": "p.ts:1:2:3:4",
    "p.ts:1:2:3:4:x:5:6:7:8": "p.ts:1:2:3:4:x:5:6:7:8",  # the last four numbers are the coordinates
    "p.ts:5:0:7:1:0": "p.ts:5:0:7:1:0",  # path p.ts:5, line 0: not of the form
    "p.ts:0:0:0:0": "p.ts:0:0:0:0",
    "p.ts:0:0:0:0:slot": "p.ts:0:0:0:0:slot",
    "p.ts:1:2:0:4:slot": "p.ts:1:2:0:4:slot",
    "p.ts:007:00:8:010:slot": "p.ts:7:0:8:10",
    "p.ts:01:2:3:4": "p.ts:1:2:3:4",
    r"a\b.ts:1:2:3:4": "a/b.ts:1:2:3:4",
    r"a\b.ts:1:2:3:4:slot": "a/b.ts:1:2:3:4",
    r"C:\x\y.ts:1:2:3:4": "C:/x/y.ts:1:2:3:4",
    ":1:2:3:4": ":1:2:3:4",
    "1:2:3:4": "1:2:3:4",
    "a:1:2:3": "a:1:2:3",
    "package:@x/y": "package:@x/y",
    r"file:a\b": "file:a/b",
    "": "",
    None: None,
}


def test_ids(spark):
    df = spark.createDataFrame([(i,) for i in IDS], "i string")
    assert {r["i"]: r["n"] for r in df.select("i", normalize_id("i").alias("n")).collect()} == IDS
    assert {i: None if i is None else brute.norm(i) for i in IDS} == IDS
    c = duckdb.connect()
    c.execute("CREATE TABLE t (i VARCHAR)")
    c.executemany("INSERT INTO t VALUES (?)", [(i,) for i in IDS])
    assert dict(c.execute(f"SELECT i, {normalized_sql('i')} FROM t").fetchall()) == IDS


def test_ids_of_a_known_file(spark):
    """Prefixes before the path that the record tells go."""
    rows = [("flow:call:a/b.ts:3:1:3:9:arg0:call0", "a/b.ts", "a/b.ts:3:1:3:9"), ("a/b.ts:3:1:3:9:x", "", "a/b.ts:3:1:3:9"), ("a/b.ts:3:1:3:9", None, "a/b.ts:3:1:3:9"), ("c.ts:3:1:3:9", "a/b.ts", "c.ts:3:1:3:9")]
    df = spark.createDataFrame(rows, "i string, f string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", normalize_id("i", "f").alias("got")).collect())


def test_coordinates(spark):
    df = spark.createDataFrame([("p.ts:1:2:3:4:0",), ("p.ts:1:2:3:4:s",), ("nothing",)], "i string")
    got = [r["c"] for r in df.select(coordinate("i").alias("c")).collect()]
    assert (got[0]["path"], got[0]["start_line"], got[0]["suffix"]) == ("p.ts:1", 2, None)
    assert (got[1]["path"], got[1]["end_col"], got[1]["suffix"]) == ("p.ts", 4, "s")
    assert got[2] is None


def test_empty_runtime(spark):
    from ashlar.streaming.runtime_stream import RECORD

    none = spark.createDataFrame([], RECORD)
    e = spark.createDataFrame([], "stable_id string, labels array<string>")
    r = spark.createDataFrame([], "rel_type string, from_id string, to_id string")
    for df in (rt.merged_nodes(none), rt.causal_links(rt.merged_nodes(none)), rt.causal_candidates(none), rt.session_coverage(none, e), rt.iterations(none), rt.branch_segments(rt.iterations(none)), rt.transitions(none, r), rt.guard_cases(none), rt.completeness(none), rt.trace_buckets(none), rt.uncovered(e, none, "Fn"), rt.recent_window(none)):
        assert df.isEmpty()
    assert F is not None


def graph_folder(spark, path, labelled, links):
    """A folder of the graph's two tables: labels by id, and (from, type, to)."""
    spark.createDataFrame([("r", i, x) for i, x in labelled.items()], "provenance_id string, stable_id string, labels array<string>").write.parquet(f"{path}/raw_entities.parquet")
    spark.createDataFrame([("r", a, b, t) for a, t, b in links], "provenance_id string, from_id string, to_id string, rel_type string").write.parquet(f"{path}/raw_relationships.parquet")
    return str(path)


def test_dependency_closure_has_eight_steps(spark, tmp_path):
    chain = [(f"a{i}", "CALLS", f"a{i + 1}") for i in range(12)]
    fan = [("b0", "CALLS", "b1"), ("b1", "CALLS", "b2"), ("b2", "CALLS", "b3"), ("b3", "CALLS", "b4")] + [("b4", "CALLS", f"c{i}") for i in range(2000)]
    d = graph_folder(spark, tmp_path, {"a0": ["UiAffordance"], "b0": ["UiAffordance"]}, chain + fan)
    got = {(x["origin"], x["nodes"], x["depth"], x["overflow"]) for x in graph_queries.bounded_dependency_closure(spark, d).collect()}
    assert got == {("r a0", 9, 8, False), ("r b0", 2005, 5, True)}


def test_walks_end_where_nothing_new_comes(spark, tmp_path):
    """Far beyond the few steps that the queries once had, over cycles too."""
    flow = [(f"a{i:02}", "NEXT", f"a{i + 1:02}") for i in range(11)]
    ring = [(f"r{i}", "CALLS", f"r{(i + 1) % 8}") for i in range(8)]
    fork = [("f", "TRUE", "x00"), ("f", "FALSE", "y00"), ("x11", "NEXT", "z"), ("y11", "NEXT", "z")] + [(f"{k}{i:02}", "NEXT", f"{k}{i + 1:02}") for k in "xy" for i in range(11)]
    d = graph_folder(spark, tmp_path, {"a00": ["UiAffordance"], "r0": ["UiAffordance"], "a11": ["StorageCell"]}, flow + ring + fork)
    rows = lambda q: {tuple(x) for x in q(spark, d).collect()}
    assert rows(graph_queries.depth_from_roots) == {(f"r a{i:02}", i) for i in range(12)} | {(f"r r{i}", i) for i in range(8)}
    assert rows(graph_queries.shortest_path_lengths) == rows(graph_queries.nearest_target) == {("r a00", "r a11", 11)}
    assert rows(graph_queries.call_cycle_lengths) == {(f"r r{i}", 8) for i in range(8)}
    assert rows(graph_queries.branch_join_points) == {("r f", "r z", 12)}


def test_property_paths_of_ten_keys(spark, tmp_path):
    links = [("s", "ASSIGNS_VALUE", "p0:1:")] + [(f"p{i}:1:", "HAS_FLOW_BLOCK", f"p{i + 1}:1:") for i in range(10)]
    d = graph_folder(spark, tmp_path, {"s": ["Step"]}, links)
    got = {x["hops"]: len([k for k in x["keys"].split(".") if k]) for x in context_queries.property_paths(spark, d).collect()}
    assert got == {0: 0} | {i + 1: i for i in range(11)}


def test_owners_are_found_in_their_run(spark):
    rows = [(1, "s", ["Step"], '{"parentFnStableId": "f"}', "r1"), (2, "f", ["Fn"], "{}", "r1"), (3, "v", ["Value"], '{"parentStepStableId": "s"}', "r1"), (4, "w", ["Value"], '{"parentStepStableId": "gone"}', "r1"), (5, "x", None, None, "r1"), (6, "s", ["Step"], '{"parentFnStableId": "f"}', "r2"), (7, None, None, '{"parentStepStableId": "s"}', "r1")]
    e = spark.createDataFrame(rows, "ordinal long, stable_id string, labels array<string>, props_json string, provenance_id string")
    some = levels.named_owners(e)
    assert {(r["provenance_id"], r["stable_id"]) for r in some.collect()} == {("r1", "s"), ("r1", "f"), ("r1", "v"), ("r1", "w"), ("r2", "s")}
    assert {tuple(r) for r in levels.ownership_edges(some, "provenance_id").collect()} == {("r1 f", "r1 s"), ("r1 s", "r1 v")}


@pytest.mark.parametrize("small", [0, 100_000])
def test_dependency_levels_by_either_way(spark, small):
    """In rounds to the end, and finished in one task; against plain Python."""
    pairs = [*random_pairs(8, 40, 45), ("z1", "z1"), ("z2", "z1"), ("z3", "z2"), ("c1", "c2"), ("c2", "c3")]
    ids = sorted({x for p in pairs for x in p if x is not None} | {"alone"})
    unknown = ["z3", "c3", ids[3]]
    out = defaultdict(set)
    for a, b in pairs:
        if a is not None and b is not None:
            out[a].add(b)

    def reach(x):
        seen, todo = set(), list(out[x])
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += out[y]
        return seen

    r = {x: reach(x) for x in ids}
    part = {x: min({x} | {y for y in r[x] if x in r[y]}) for x in ids}

    def height(c):
        below = {part[b] for a in ids if part[a] == c for b in out[a]} - {c}
        return max((height(b) + 1 for b in below), default=0)

    want = {}
    for x in ids:
        cyclic, stuck = x in r[x], x in r[x] or any(y in r[y] for y in r[x])
        status = "cyclic-dependency" if cyclic else "depends-on-cycle" if stuck else "acyclic"
        want[x] = (part[x], height(part[x]), -1 if stuck else height(part[x]), cyclic, bool({x, *r[x]} & set(unknown)), status)
    e, n = edges(spark, pairs), nodes(spark, ids)
    found = levels.dependency_levels(e, n, nodes(spark, unknown), small_core=small)
    assert {row[0]: tuple(row[1:]) for row in found.collect()} == want
    plain = {row["node"]: row["level"] for row in levels.waves(e, n, small).collect()}
    assert plain == {x: w[2] for x, w in want.items()}


def test_level_violations_are_found(spark):
    """Planted: an edge that isn't upwards, a node too high, and a node whose component has another level."""
    e = edges(spark, [("b", "a"), ("c", "b"), ("d", "c")])
    right = [("a", 0, 0), ("b", 1, 1), ("c", 2, 2), ("d", 3, 3)]
    make = lambda rows: spark.createDataFrame(rows, "node string, component_level int, structural_level int")
    assert levels.level_violations(e, make(right)).isEmpty()
    wrong = [("a", 0, 0), ("b", 0, 0), ("c", 2, 2), ("d", 4, 3)]
    assert {(r["violation"], r["n"]) for r in levels.level_violations(e, make(wrong)).collect()} == {("order", 1), ("recurrence", 2), ("component", 1)}


def test_walks_without_limits_reach_their_ends(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(70)]
    walked = traversal.chain_walk(edges(spark, chain), nodes(spark, ["n000"]), nodes(spark, [])).collect()
    assert [(len(r["path"]), r["state"]) for r in walked] == [(71, "open")]
    limited = traversal.chain_walk(edges(spark, chain), nodes(spark, ["n000"]), nodes(spark, []), 5).collect()
    assert [(len(r["path"]), r["state"]) for r in limited] == [(6, "limit")]
    diamonds = [(a, b) for i in range(4) for a, b in ((f"j{i}", f"l{i}"), (f"j{i}", f"r{i}"), (f"l{i}", f"j{i + 1}"), (f"r{i}", f"j{i + 1}"))]
    every = traversal.simple_paths(edges(spark, diamonds), nodes(spark, ["j0"])).collect()
    assert len(every) == 16 and all(r["ended"] and not r["truncated"] and len(r["path"]) == 9 for r in every)


KINDS = [
    (["Fn", "VisualProxy"], None, None), (["Fn"], "Projection", "Projection"), (["TypeReference"], "Binding", None), (["TypeMember", "ValueSlot"], None, "Binding"), (["Fn", "Call"], "Step", "Callable"),
    (["DeveloperDefined", "Parameter"], "Binding", "FunctionalEntity"), (["DeveloperDefined", "Step"], None, "Step"), (["DeveloperDefined", "Fn", "Component"], None, "Callable"), (["FnDeclaration"], "Binding", "Callable"),
    (["Op"], "Binding", "CallSite"), (["Step"], "Loop", "Loop"), (["Step"], "", "Step"), (["Flow", "Block"], None, "FlowBlock"), (["Flow"], None, None), (["Block", "Step"], None, "Step"), (["AwaitedAsyncCall"], None, "AsyncFlow"),
    (None, "Loop", "Loop"), ([], None, None), (["Package", "External"], None, "Module"),
]


def test_kinds(spark):
    df = spark.createDataFrame(KINDS, "labels array<string>, own string, want string")
    for r in df.withColumn("got", cl.kind_of("labels", "own")).collect():
        assert r["got"] == r["want"], r
