"""The general problems: against plain Python on the smallest tables and on hand-made rows with every kind of dirt."""

import json
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ashlar.functions import json_projection as jp
from ashlar.functions import tree_edit as te
from ashlar.functions.merge_patch import composed, patched
from ashlar.operators import canonical, hierarchy, references, schema_drift, skew, snapshots
from ashlar.operators.components import cyclic_nodes, strongly_connected
from ashlar.plans import data_queries
from ashlar.runtime import checked_broadcast, is_small
from tests import brute

ENTITY = "ordinal long, stable_id string, labels array<string>, props_json string, source_kind string, provenance_id string, workspace string, seq int, k1 string, path string, side int"
REL = "ordinal long, signature string, from_id string, to_id string, rel_type string, props_json string, source_kind string, provenance_id string, salt int, endpoint string, child string"
PROV = "id string, metadata_json string, provenance_id string, seq int"


def prov_rows(runs):
    return [(i, json.dumps({"workspace": w, "extracted_at": t, "id": i}), "x", 9) for i, w, t in runs]


RUNS = [("r1", "w", "2025-01-01T00:00:00Z"), ("r2", "w", "2025-01-01T01:30:00+01:00"), ("r3", "w", "2025-01-02T00:00:00.5Z"), ("s1", "v", "2025-01-01T00:00:00Z")]
BIG = json.dumps({"text": "x" * 300_000})


def entities(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "k", "p", 0) for r in rows], ENTITY)


def rels(spark, rows):
    return spark.createDataFrame([(o, None, f, t, k, p, None, r, 0, "e", "c") for o, f, t, k, p, r in rows], REL)


def provenance(spark, runs=RUNS):
    return spark.createDataFrame(prov_rows(runs), PROV)


def dirty_entities():
    rng = random.Random(3)
    rows, n = [], 0
    texts = [None, "{}", '{"a":1}', '{"a":1.0}', '{"a": "1"}', '{"a":null}', '{"a":true}', '{"b":[1,2],"a":1}', '{"b":[2,1]}', '{"c":{"x":1,"y":null}}', '{"c":{"x":1}}', BIG, '{"a":1e2}', '{"a":100}']
    for run, _, _ in RUNS:
        for i in range(14):
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                n += 1
                labels = rng.choice([None, [], ["A"], ["A", "B"], ["B", "A", "A"], ["A", None]])
                rows.append((n, f"id{i}", labels, rng.choice(texts), rng.choice(["k1", "k2"]) if i % 2 else "k1", run))
    rows += [(n + 1, None, ["A"], "{}", "k1", "r1"), (n + 2, "", ["A"], "{}", "k1", "r1"), (n + 3, "id0", ["A"], "{}", "k1", "unknown")]
    rows.append((n + 1, "id1", ["A"], "{}", "k1", "r2"))  # an ordinal that comes twice
    rng.shuffle(rows)
    return rows


def as_dicts(rows, names):
    return [dict(zip(names, r)) for r in rows]


E_NAMES = ["ordinal", "stable_id", "labels", "props_json", "source_kind", "provenance_id"]
P_DICTS = [{"id": i, "metadata_json": m} for i, m, *_ in prov_rows(RUNS)]


def got(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("name,columns", [("p1_found", 5), ("p2_found", 3), ("p3_found", 3), ("p4_found", 3), ("p5_found", 2)])
def test_found_equals_plain_python(spark, data, name, columns):
    load = lambda n: pq.read_table(f"{data}/{n}.parquet").to_pylist()
    e, r, p = load("raw_entities"), load("raw_relationships"), load("extraction_provenance")
    want = {"p1_found": lambda: brute.p1(e, p), "p2_found": lambda: brute.p2(r), "p3_found": lambda: brute.p3(e, r, p), "p4_found": lambda: brute.p4(e, p), "p5_found": lambda: brute.p5(e, r)}[name]()
    df = data_queries.QUERIES[name](spark, data)
    assert len(df.columns) == columns
    assert Counter(map(tuple, df.collect())) == Counter(want)


@pytest.mark.parametrize("size, together", [(1 << 30, 2), (400_000, 2), (10_000, 2), (10_000, 3), (10_000, 1000)])
def test_snapshot_changes_on_dirt(spark, size, together):
    """One range, a few, and hundreds, whose edges are merged in several steps or in one."""
    rows = dirty_entities()
    found = got(snapshots.snapshot_changes(entities(spark, rows), provenance(spark), size, together), "provenance_id", "stable_id", "change")
    clean = [r for r in as_dicts(rows, E_NAMES) if r["provenance_id"] != "unknown"]
    assert found == Counter(brute.p4(clean, P_DICTS))


def test_one_key_with_a_third_of_all_rows(spark):
    """Groups that span many ranges, of one entity whose rows add up differently in each run."""
    rows = [(n, f"id{n % 50}", ["A"], json.dumps({"v": n % 50}), "k", ("r1", "r2", "r3")[n // 200]) for n in range(600)]
    rows += [(1000 + n, "hot", [f"L{n % 7}"], json.dumps({f"k{n % 5}": n if run == "r3" else n % 5}), "k", run) for n, run in enumerate(["r1"] * 100 + ["r2"] * 100 + ["r3"] * 100)]
    found = got(snapshots.snapshot_changes(entities(spark, rows), provenance(spark), 1000, 4), "provenance_id", "stable_id", "change")
    assert found == Counter(brute.p4(as_dicts(rows, E_NAMES), P_DICTS)) == Counter({("r3", "hot", "changed"): 1})


def test_snapshot_store_takes_run_after_run(spark, tmp_path):
    """Each delivery is compared with the kept snapshot only; together they give what all runs at once give."""
    rows = [r for r in dirty_entities() if r[5] != "unknown"]
    store = snapshots.SnapshotStore(spark, f"file://{tmp_path}/kept")
    assert store.rows() is None
    found = Counter()
    for some in (RUNS[:1] + RUNS[3:], RUNS[1:2], [("empty", "w", "2025-01-01T12:00:00Z")], RUNS[2:3]):
        mine = [r for r in rows if r[5] in {i for i, *_ in some}]
        found += got(store.add(entities(spark, mine), provenance(spark, some)), "provenance_id", "stable_id", "change")
        assert {r["provenance_id"] for r in store.rows().select("provenance_id").distinct().collect()} <= {i for i, *_ in RUNS}
    runs = [*RUNS, ("empty", "w", "2025-01-01T12:00:00Z")]
    assert found == got(snapshots.snapshot_changes(entities(spark, rows), provenance(spark, runs)), "provenance_id", "stable_id", "change")
    assert store.state() == 4 and len([x for x in (tmp_path / "kept").iterdir() if not x.name.startswith(".")]) == 6
    with pytest.raises(ValueError):
        store.add(entities(spark, []), provenance(spark, RUNS[1:2]))


def test_drift_on_dirt(spark):
    rows = dirty_entities()
    found = got(schema_drift.drift(entities(spark, rows), provenance(spark)), "provenance_id", "source_kind", "change", "old_name", "new_name")
    # the plain version knows one kind for an id of a run
    clean = [r for r in as_dicts(rows, E_NAMES) if r["provenance_id"] != "unknown"]
    wanted = {c for c in brute.p1(clean, P_DICTS) if not c[2].endswith("renamed")}
    assert {c for c in found if c[2].endswith("retyped")} == {c for c in wanted if c[2].endswith("retyped")}


def test_drift_finds_renames(spark):
    rows, n = [], 0
    for run in ("r1", "r2", "r3"):
        for i in range(9):
            n += 1
            value = {"r1": {"old": i, "keep": 1, "a/b": 1}, "r2": {"new": i if i > 2 else -1, "keep": "1", "a/b": 1}, "r3": {"last~": i if i > 2 else -1, "keep": "1"}}[run]
            rows.append((n, f"e{i}", ["Gone", "Stay"] if run == "r1" else ["Came", "Stay"], json.dumps(value), None, run))
    e, p = entities(spark, rows), provenance(spark)
    found = got(schema_drift.drift(e, p), "provenance_id", "source_kind", "change", "old_name", "new_name")
    assert found == Counter([("r2", "", "field_renamed", "old", "new"), ("r2", "", "field_retyped", "keep", "keep"), ("r2", "", "label_renamed", "Gone", "Came"), ("r3", "", "field_renamed", "new", "last~"), ("r3", "", "field_removed", "a/b", "")])
    table = schema_drift.consistent_table(e, p).orderBy("ordinal").collect()
    assert len(table) == len(rows)
    assert all("last~" in r["props"] and "old" not in r["props"] for r in table) and all("Came" in r["labels"] for r in table)


def test_plans_move_and_cast():
    plan = jp.Plan({("a",): ("b",), ("b",): ("c",), ("s", "f"): ("s", "from"), ("s", "t"): ("t",), ("m",): ("s", "m"), ("l", "[]", "x"): ("l", "[]", "y")}, {("n",): ("number", ""), ("w",): ("object", "value")})
    assert plan.apply('{"a":1,"b":2}') == {"b": "1", "c": "2"}
    assert plan.apply('{"s":{"f":1.50,"t":2},"m":9}') == {"s": '{"from":1.50,"m":9}', "t": "2"}
    assert plan.apply('{"l":[{"x":1},{"x":2,"y":3},4]}') == {"l": '[{"y":1},{"x":2,"y":3},4]'}
    assert plan.apply('{"n":"12.50","w":"x"}') == {"n": "12.50", "w": '{"value":"x"}'}
    assert plan.apply('{"n":"no","s":1,"m":2}') == {"n": '"no"', "s": "1", "m": "2"}  # what can't be done leaves the value
    assert plan.apply("[]") is None and plan.apply("{") is None
    again = jp.Plan.load(plan.dump())
    assert (again.moves, again.casts) == (plan.moves, plan.casts)


@pytest.mark.parametrize("value, want, found", [("1", "string", '"1"'), ("true", "number", "1"), ("0", "boolean", "false"), ("2", "boolean", "2"), ('"1e5"', "number", "1e5"), ('"x"', "list", '["x"]'), ('["x"]', "string", '"x"'), ('["x","y"]', "string", '["x","y"]'), ('{"value":3}', "number", "3"), ("null", "string", "null")])
def test_casts_lose_nothing(value, want, found):
    assert jp.Plan({}, {("k",): (want, "")}).apply('{"k":%s}' % value) == {"k": found}


def test_members_keep_number_texts():
    assert jp.members(' {"a": 1.50000000000000000001 , "b":"x\\u00fc","c":{"x": [1, 2.0,null]},"a":2e5} ') == {"a": "2e5", "b": '"xü"', "c": '{"x":[1,2.0,null]}'}
    assert jp.members('{"k\\ud800":"\\ud800","e":""}') == {"k\\ud800": '"\\ud800"', "e": '""'} and jp.members("{ }") == {}
    assert [jp.members(t) for t in ("", "{", "[1]", "null", '{"a":1} x', '{"a":}', '{"a" 1}', '{"a":1,}', "{1:2}")] == [None] * 9


@given(st.dictionaries(st.text(), st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x)), max_size=6))
def test_members_of_any_object(value):
    for source in (json.dumps(value), json.dumps(value, ensure_ascii=False, indent=1)):
        assert {k: json.loads(v) for k, v in jp.members(source).items()} == value
        assert jp.Plan({}, {}).apply(source) == jp.members(source)


def test_one_table_for_all_workspaces(spark):
    """Names with signs of paths, drift inside objects and of types, and a workspace that ends under another spelling."""
    shapes = {
        "r1": lambda i: {"a, b": i, "s/t": {"from": i, "unit": "x"}, "n": str(i)},
        "r2": lambda i: {"c, d": i, "s/t": {"start": i, "unit": "x"}, "n": i},
        "s1": lambda i: {"C_D": i, "s/t": {"start": i, "unit": "x"}, "n": {"value": i}},
    }
    rows = [(10 * k + i, f"e{i}", ["Old" if run == "r1" else "New", "Stay"], json.dumps(shape(i)), "k", run) for k, (run, shape) in enumerate(shapes.items()) for i in range(1, 6)]
    rows += [(90 + i, f"f{i}", ["New"], json.dumps({"c, d": i, "n": i}), "k", "q1") for i in range(3)]
    table = schema_drift.consistent_table(entities(spark, rows), provenance(spark, [*RUNS, ("q1", "u", "2025-01-01T00:00:00Z")])).collect()
    assert len(table) == len(rows)
    for r in table:
        want = {"c, d": str(r["ordinal"] % 10), "n": str(r["ordinal"] % 10)}
        if r["provenance_id"] != "q1":
            want["s/t"] = '{"start":%d,"unit":"x"}' % (r["ordinal"] % 10)
        assert r["props"] == want and r["labels"][0] == "New", r


def test_fields_that_some_run_has_both_stay_apart(spark):
    rows = [(n, f"e{n}", None, json.dumps({"max-size": n} if n < 3 else {"maxSize": n}), "k", "r1" if n < 6 else "s1") for n in range(9)]
    got = {r["ordinal"]: r["props"] for r in schema_drift.consistent_table(entities(spark, rows), provenance(spark)).collect()}
    assert got == {n: {"max-size": str(n)} if n < 3 else {"maxSize": str(n)} for n in range(9)}


def test_consistent_table_keeps_values(spark):
    texts = ['{"a":1.50,"b":"x\\u00e9","c":[1,{"d":null}],"e":null}', None, "[1]", "no json", "null", "{}", '{"old":1,"new":2}']
    rows = [(n, f"e{n}", None, t, "k", "r1") for n, t in enumerate(texts)] + [(50 + n, f"v{n}", ["A"], json.dumps({"old": n}), "k", "r1") for n in range(3)] + [(90 + n, f"v{n}", ["A"], json.dumps({"new": n}), "k", "r2") for n in range(3)]
    got = {r["ordinal"]: r["props"] for r in schema_drift.consistent_table(entities(spark, rows), provenance(spark)).collect()}
    assert got[0] == {"a": "1.50", "b": '"xé"', "c": '[1,{"d":null}]', "e": "null"} and [got[i] for i in (1, 2, 3, 4, 5)] == [None, None, None, None, {}]
    assert got[6] == {"old": "1", "new": "2"} and len(got) == len(rows)


def test_empty_tables(spark):
    e, r, p = entities(spark, []), rels(spark, []), provenance(spark, [])
    assert snapshots.snapshot_changes(e, p).isEmpty()
    assert schema_drift.drift(e, p).isEmpty()
    assert schema_drift.consistent_table(e, p).isEmpty()
    assert skew.dominant_keys(r, {"from_id": 0.05, "rel_type": 0.15}).isEmpty()
    assert references.Orphans(r, e, p).references.isEmpty()
    assert references.Orphans(r, e, p).records().isEmpty()
    assert hierarchy.parent_cycles(e, r).isEmpty()
    assert hierarchy.hierarchy(e, r).isEmpty()
    assert canonical.merge_entities(e).isEmpty()


LINKS = [
    ("NESTED_IN", "b", "a"), ("NESTED_IN", "c", "b"), ("AST_CHILD", "c", "d"), ("NESTED_IN", "x", "y"), ("NESTED_IN", "y", "z"), ("NESTED_IN", "z", "x"), ("NESTED_IN", "t1", "x"), ("NESTED_IN", "t2", "t1"),
    ("DECLARED_IN", "s", "s"), ("NESTED_IN", "q", "nobody"), ("CALLS", "a", "c"), ("NESTED_IN", None, "a"), ("NESTED_IN", "a", None), ("NESTED_IN", "b", "a"), (None, "b", "c"),
    ("NESTED_IN", "p.ts:1:2:3:4:slot", "p.ts:9:2:9:4"), ("NESTED_IN", "p.ts:9:2:9:4:arg0", "p.ts:1:2:3:4"), ("NESTED_IN", "m", "a"), ("NESTED_IN", "m", "n"), ("NESTED_IN", "n", "m"),
]
IDS = ["a", "b", "c", "d", "x", "y", "z", "t1", "t2", "s", "q", "p.ts:1:2:3:4", "p.ts:9:2:9:4", "m", "n", "alone", ""]


def graph(spark):
    e = entities(spark, [(i, x, None, None, None, "r1") for i, x in enumerate([*IDS, "a", None])])
    return e, rels(spark, [(i, f, t, k, None, "r1") for i, (k, f, t) in enumerate(LINKS)])


def test_cycles_with_several_parents(spark):
    e, r = graph(spark)
    want = {"x", "y", "z", "s", "p.ts:1:2:3:4", "p.ts:9:2:9:4", "m", "n"}
    assert {x["stable_id"] for x in hierarchy.parent_cycles(e, r).collect()} == want


def test_long_tail_into_a_cycle(spark):
    """The tail is far longer than the trees that resolve first."""
    ids = [f"n{i:03}" for i in range(90)]
    links = [("NESTED_IN", a, b) for a, b in zip(ids, ids[1:])] + [("NESTED_IN", ids[-1], ids[-3]), ("NESTED_IN", "k", "root")]
    e = entities(spark, [(i, x, None, None, None, "r1") for i, x in enumerate([*ids, "k", "root"])])
    r = rels(spark, [(i, f, t, k, None, "r1") for i, (k, f, t) in enumerate(links)])
    assert {x["stable_id"] for x in hierarchy.parent_cycles(e, r).collect()} == set(ids[-3:])
    status = {x["stable_id"]: x["status"] for x in hierarchy.hierarchy(e, r).collect()}
    assert status["n000"] == "to_cycle" and status["n088"] == "cycle" and status["k"] == "tree"


def test_paths_and_descendants(spark):
    e, r = graph(spark)
    tree = hierarchy.hierarchy(e, r)
    rows = {x["stable_id"]: x for x in tree.collect()}
    assert len(rows) == len(IDS)
    assert rows["d"]["path"] == ["a", "b", "c", "d"] and rows["d"]["depth"] == 3 and rows["d"]["root"] == "a"
    assert rows["t2"]["status"] == "to_cycle" and rows["q"]["path"] == ["q"] and rows["alone"]["depth"] == 0
    pairs = {(x["ancestor"], x["descendant"], x["distance"]) for x in hierarchy.descendants(tree).collect()}
    assert {("a", "d", 3), ("c", "d", 1)} <= pairs


def _distances(links, ids):
    """All pairs of two different nodes with the least number of links from the descendant up, by plain walks."""
    up = {}
    for child, parent in links:
        if child in ids and parent in ids:
            up.setdefault(child, set()).add(parent)
    found = set()
    for x in ids:
        dist, front = {x: 0}, [x]
        for y in front:
            for p in up.get(y, set()) - set(dist):
                dist[p] = dist[y] + 1
                front.append(p)
        found |= {(a, x, n) for a, n in dist.items() if n}
    return found


def _pairs(df):
    rows = [(x["ancestor"], x["descendant"], x["distance"]) for x in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_descendants_below_cycles_and_of_all_parents(spark):
    e, r = graph(spark)
    found = _pairs(hierarchy.all_descendants(e, r))
    norm = {"p.ts:1:2:3:4:slot": "p.ts:1:2:3:4", "p.ts:9:2:9:4:arg0": "p.ts:9:2:9:4"}
    links = [(norm.get(c, c), norm.get(p, p)) for k, a, b in LINKS if k in hierarchy.CHILD_TO_PARENT + hierarchy.PARENT_TO_CHILD for c, p in [(a, b) if k in hierarchy.CHILD_TO_PARENT else (b, a)]]
    assert found == _distances(links, set(IDS))
    assert {("x", "t2", 2), ("z", "t2", 4), ("y", "x", 1), ("x", "y", 2), ("a", "m", 1), ("n", "m", 1), ("a", "n", 2)} <= found


@pytest.mark.parametrize("several", [False, True])
def test_descendants_equal_plain_walks(spark, several):
    rng = random.Random(5)
    ids = [f"n{i:02}" for i in range(60)]
    links = [(c, rng.choice(ids)) for c in ids[:50]] + ([(c, rng.choice(ids)) for c in ids[:50:3]] + [("n00", "nobody")] if several else [])
    e = entities(spark, [(i, x, None, None, None, "r1") for i, x in enumerate(ids)])
    r = rels(spark, [(i, c, p, "NESTED_IN", None, "r1") for i, (c, p) in enumerate(links)])
    assert _pairs(hierarchy.all_descendants(e, r)) == _distances(links, set(ids))


def test_orphans_on_dirt(spark):
    e = entities(spark, [(1, "a", None, None, None, "r1"), (2, "late", None, None, None, "r3"), (3, "p.ts:1:0:2:0", None, None, None, "r2"), (4, None, None, None, None, "r2"), (5, "a", None, None, None, "r1")])
    r = rels(spark, [(10, "a", "late", "CALLS", None, "r2"), (11, "a", None, "CALLS", None, "r1"), (12, r"p.ts:1:0:2:0:arg0", "gone", None, None, "r2"), (12, r"p.ts:1:0:2:0:arg0", "gone", None, None, "r2"), (13, "", "a", "CALLS", None, "s1"), (14, "a", "a", "CALLS", None, "nowhere")])
    found = got(references.Orphans(r, e, provenance(spark)).references.filter("level = 1"), "ordinal", "endpoint", "state")
    want = Counter({(10, "from_id", "deleted"): 1, (10, "to_id", "late"): 1, (12, "to_id", "missing"): 2, (13, "from_id", "missing"): 1, (13, "to_id", "missing"): 1, (14, "from_id", "missing"): 1, (14, "to_id", "missing"): 1})
    assert found == want


def test_cascade(spark):
    e = entities(spark, [(i, x, None, None, None, "r1") for i, x in enumerate(["b", "c", "d", "ok", "x", "y"])])
    r = rels(spark, [(i, f, t, "NESTED_IN", None, "r1") for i, (f, t) in enumerate([("b", "missing"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x"), ("x", "d"), ("c", "b")])])
    found = {(x["stable_id"], x["kind"], x["level"]) for x in references.Orphans(r, e, provenance(spark)).records().collect()}
    assert found == {("b", "direct", 1), ("c", "inherited", 2), ("d", "inherited", 3), ("x", "inherited", 4), ("y", "inherited", 5)}


def test_cascade_has_no_deepest_level(spark):
    """A chain far deeper than the tables that are kept apart, below one missing record; its links count as references."""
    ids = [f"n{i:02}" for i in range(30)]
    e = entities(spark, [(i, x, None, None, None, "r1") for i, x in enumerate(ids)])
    r = rels(spark, [(i, x, ids[i - 1] if i else "missing", "NESTED_IN", None, "r1") for i, x in enumerate(ids)])
    o = references.Orphans(r, e, provenance(spark))
    assert {x["stable_id"]: x["level"] for x in o.records().collect()} == {x: i + 1 for i, x in enumerate(ids)}
    assert {x["ordinal"]: (x["level"], x["state"]) for x in o.references.collect()} == {i: (i + 1, "inherited" if i else "missing") for i in range(30)}


def test_salted_semi_join(spark, monkeypatch):
    """A set too large for a broadcast: the heavy key's rows are split, none is lost or doubled."""
    rows = [(n, "hot" if n % 2 else f"k{n % 9}", "t", "CALLS", None, "r1") for n in range(400)]
    kept = skew.Salted(rels(spark, rows).select("ordinal", "from_id"), ["from_id"], "ordinal", share=0.1, rows_per_salt=10)
    wanted = spark.createDataFrame([("hot",), ("k2",), ("nobody",)], "from_id string")
    want = sorted(n for n, f, *_ in rows if f in ("hot", "k2"))
    assert sorted(x["ordinal"] for x in kept.semi(wanted).collect()) == want
    monkeypatch.setattr(skew, "checked_broadcast", lambda df: df)
    assert sorted(x["ordinal"] for x in kept.semi(wanted).collect()) == want
    assert skew.lookup_join(rels(spark, rows).select("ordinal", "from_id"), wanted.withColumn("v", F.lit(1)), ["from_id"], "ordinal").filter("v = 1").count() == len(want)


def test_small_by_bytes(spark):
    wide = spark.createDataFrame([("x" * 5000,)] * 3, "t string")
    assert is_small(wide) and not is_small(wide, rows=2) and not is_small(wide, size=10_000)
    assert is_small(wide.limit(0)) and checked_broadcast(wide, size=10_000) is wide


def test_salted_summary_with_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(n, "hot" if n % 3 == 0 else f"k{rng.randrange(40)}", f"t{rng.randrange(60)}" if n % 7 else None, "CALLS" if n % 2 else None, None, "r1") for n in range(900)]
    df = skew.salted_summary(rels(spark, rows), ["provenance_id", "from_id"], "to_id", "ordinal", carry=("to_id",), share=0.02, rows_per_salt=10)
    found = {r["from_id"]: (r["row_count"], r["distinct_neighbours"], r["latest"]["ordinal"], r["latest"]["to_id"]) for r in df.collect()}
    want = {}
    for n, f, t, *_ in rows:
        want.setdefault(f, []).append((n, t))
    assert found == {f: (len(v), len({t for _, t in v} - {None}), *max(v)) for f, v in want.items()}
    heavy = skew.heavy_keys(rels(spark, rows).select("from_id"), ["from_id"], 0.02, 10).collect()
    assert {r["from_id"] for r in heavy} >= {"hot"} and len(heavy) <= 50


def test_salted_join_keeps_every_row(spark):
    rows = spark.createDataFrame([(n, "hot" if n % 3 else f"k{n % 11}" if n % 5 else None) for n in range(500)], "o int, k string")
    other = spark.createDataFrame([("hot", 1), ("k1", 2), ("unused", 3)], "k string, v int")
    got = skew.salted_left_join(rows, other, ["k"], "o", share=0.05, rows_per_salt=20)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(other, ["k"], "left").select(got.columns).collect()))


def test_dominant_keys_at_the_border(spark):
    rows = [(n, "a" if n < 5 else None if n < 10 else f"x{n}", "t", "A" if n < 15 else "B", None, "r1") for n in range(100)]
    found = got(skew.dominant_keys(rels(spark, rows), {"from_id": 0.05, "rel_type": 0.15}), "provenance_id", "key_field", "key_value")
    assert found == Counter([("r1", "from_id", "a"), ("r1", "rel_type", "A"), ("r1", "rel_type", "B")])


def test_merge_patch_composes():
    rng = random.Random(5)

    def value(depth):
        if depth == 0 or rng.random() < 0.4:
            return rng.choice([None, 1, "x", [1], {}])
        return {k: value(depth - 1) for k in rng.sample("abc", rng.randrange(4))}

    for _ in range(500):
        doc, p, q = value(3), value(3), value(3)
        assert patched(patched(doc, p), q) == patched(doc, composed(p, q))


def test_canonical_rows(spark):
    rows = [(1, "left", ["Value"], '{"first":1}', "k", "r"), (2, "left", ["Read"], '{"second":2}', "k", "r"), (3, "right", ["X", "X"], '{"a": null}', "k", "r"), (70_000, "left", None, '{"first":null,"third":{"x":1}}', "k", "r"), (140_000, "left", ["Value", None], '{"third":{"x":null,"y":2}}', "k", "r"), (5, None, None, None, "k", "r")]
    found = {r["stable_id"]: r for r in canonical.merge_entities(entities(spark, rows)).collect()}
    assert found["left"]["labels"] == ["Value", "Read"] and json.loads(found["left"]["props_json"]) == {"second": 2, "third": {"y": 2}}
    assert found["right"]["props_json"] == '{"a": null}' and found["right"]["labels"] == ["X", "X"] and len(found) == 2


def test_signatures_keep_outcomes_apart(spark):
    r = rels(spark, [(1, "a", "b", "ASSIGNS_VALUE", '{"producer_outcome":true}', "r"), (2, "a", "b", "ASSIGNS_VALUE", '{"producer_outcome":"false"}', "r"), (3, "a", "b", "ASSIGNS_VALUE", '{"producer_outcome":"x"}', "r"), (4, "a", None, "NEXT", None, "r")])
    signed = canonical.relationship_signature(r)
    assert [x["signature"] for x in signed.orderBy("ordinal").collect()] == ["a\0ASSIGNS_VALUE\0b\0producer_outcome=true", "a\0ASSIGNS_VALUE\0b\0producer_outcome=false", "a\0ASSIGNS_VALUE\0b", None]
    assert canonical.merge_relationships(signed).count() == 3


def test_tree_edit_scripts():
    a = te.build([("name", "string"), ("span", "object"), ("span/from", "number"), ("span/to", "number"), ("old", "number")])
    b = te.build([("name", "string"), ("new", "number"), ("box", "object"), ("box/span", "object"), ("box/span/from", "number"), ("box/span/to", "number")])
    cost, edits = te.script(a, b, lambda at, old, new, x, y: 0.5 if (old, new) == ("old", "new") else te.NEVER)
    ops = {(e[0], e[1], e[2]) for e in edits}
    assert ("rename", ("old",), ("new",)) in ops and cost < 8
    assert te.assign([[4, 1, 3], [2, 0, 5], [3, 2, 2]]) == [1, 0, 2]
    moved = te.script(te.build([("x", ""), ("x/s", "object"), ("x/s/a", "number"), ("y", "")]), te.build([("x", ""), ("y", ""), ("y/s", "object"), ("y/s/a", "number")]), lambda *_: te.NEVER)
    assert [e[0] for e in moved[1]] == ["move"] and moved[0] == te.MOVE


@pytest.mark.parametrize("small", [0, 10**6])
def test_components_of_random_graphs(spark, small):
    rng = random.Random(small)
    pairs = [(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}") for _ in range(40)] + [(None, "n00"), ("n01", "n01")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    up = {}
    for a, b in pairs:
        if a:
            up.setdefault(a, set()).add(b)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in up.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    nodes = {x for p in pairs for x in p if x}
    r = {x: reach(x) for x in nodes}
    want = {x: min([y for y in r[x] if x in r[y]] + [x]) for x in nodes}
    clean = e.na.drop()
    assert {x["node"]: x["component"] for x in strongly_connected(clean, small_core=small).collect()} == want | {}
    assert {x["node"] for x in cyclic_nodes(clean).collect()} == {x for x in nodes if x in r[x]}


def test_no_operator_makes_local_checkpoints():
    import pathlib

    root = pathlib.Path(__file__).parents[1] / "ashlar"
    for p in root.rglob("*.py"):
        assert "localCheckpoint" not in p.read_text() and "crossJoin" not in p.read_text(), p


def test_hot_references_stay_whole(spark):
    rows = [(n, "hot", f"t{n % 5}", "CALLS", None, "r1") for n in range(300)]
    found = references.Orphans(rels(spark, rows), entities(spark, [(1, "t0", None, None, None, "r1")]), provenance(spark)).references
    assert found.count() == 300 + 240
    assert found.agg(F.count_distinct("ordinal")).first()[0] == 300
