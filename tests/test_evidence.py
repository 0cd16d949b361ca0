"""Evidence, interval joins, similarity, readiness and stack walks against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from ashlar.operators import evidence as ev
from ashlar.operators import traversal
from ashlar.runtime import WorkTable


def test_interval_join_finds_every_pair(spark):
    rng = random.Random(4)
    points = [(rng.choice("ab"), i, rng.randrange(300)) for i in range(200)]
    ranges = [(rng.choice("ab"), i, lo := rng.randrange(300), lo + rng.choice([-1, 0, 5, 70, 250])) for i in range(60)]
    p = spark.createDataFrame(points, "k string, p int, at int")
    r = spark.createDataFrame(ranges, "k string, r int, lo int, hi int")
    got = sorted((x["p"], x["r"]) for x in ev.interval_join(p, r, ["k"], "at", "lo", "hi", 16).collect())
    assert got == sorted((i, j) for k, i, at in points for kk, j, lo, hi in ranges if k == kk and lo <= at <= hi)


def test_weighted_similarity_misses_no_pair(spark):
    rng = random.Random(5)
    weights = {"x": 0.6, "y": 0.4}
    sets = {f"s{i:02}": {k: {f"{k}{rng.randrange(8)}" for _ in range(rng.randrange(0, 5))} for k in weights} for i in range(40)}
    df = spark.createDataFrame([(s, k, w) for s, m in sets.items() for k, ws in m.items() for w in ws], "key string, kind string, item string")
    got = {(r["a"], r["b"]): round(r["score"], 6) for r in ev.weighted_similarity(df, weights, 0.35).collect()}
    score = lambda a, b: sum(w * (len(a[k] & b[k]) / len(a[k] | b[k]) if a[k] | b[k] else 0) for k, w in weights.items())
    want = {(a, b): round(score(x, y), 6) for a, x in sets.items() for b, y in sets.items() if a < b and score(x, y) >= 0.35 - 1e-12}
    assert got == want
    groups = ev.similarity_components(df, weights, 0.35)
    assert groups.count() == len({s for s, m in sets.items() if m["x"] | m["y"]})
    with pytest.raises(ValueError):
        ev.weighted_similarity(df, {"x": 0.5}, 0.5)


def _score(a: dict, b: dict, weights: dict) -> float:
    return sum(w * len(x & y) / len(x | y) for k, w in weights.items() if (x := a.get(k, set())) | (y := b.get(k, set())))


def _written(monkeypatch) -> list[int]:
    """The rows of each work table that is written from now on."""
    rows: list[int] = []

    class Counted(WorkTable):
        def __init__(self, df, name):
            super().__init__(df, name)
            rows.append(self.df.count())

    for module in (ev, traversal):
        monkeypatch.setattr(module, "WorkTable", Counted)
    return rows


def _crowd() -> dict[str, dict]:
    """Keys of one profile, and keys that have one frequent item of a kind that isn't enough to make them similar."""
    one = {f"o{i:02}": {"x": {"hot"}} for i in range(50)}
    return one | {f"p{i:02}": {"x": {f"own{i}"}, "y": {"hot"}} for i in range(50)} | {f"q{i:02}": {"x": {"few", f"r{i}"}, "y": {f"s{i // 2}"}, "z": {f"t{i // 3}"}} for i in range(12)}


def _rows(spark, sets: dict[str, dict]):
    return spark.createDataFrame([(s, k, i) for s, m in sets.items() for k, items in m.items() for i in items], "key string, kind string, item string")


@pytest.mark.parametrize("block, spread", [(1000, 10_000), (7, 30)])
def test_weighted_similarity_pairs_keys_in_the_output_only(spark, monkeypatch, block, spread):
    monkeypatch.setattr(ev, "BLOCK", block, raising=False)
    monkeypatch.setattr(ev, "SPREAD", spread, raising=False)
    rows, sets, weights = _written(monkeypatch), _crowd(), {"x": 0.5, "y": 0.3, "z": 0.2}
    features = _rows(spark, sets)
    got = ev.weighted_similarity(features.union(features), weights, 0.45).collect()
    want = {(a, b): round(s, 6) for a, x in sets.items() for b, y in sets.items() if a < b and (s := _score(x, y, weights)) >= 0.45 - 1e-12}
    assert len(got) == len(want) and {(r["a"], r["b"]): round(r["score"], 6) for r in got} == want and len(want) > 50 * 49 / 2
    assert max(rows) <= features.count()  # there were 2464 candidates


def _groups(sets: dict[str, dict], weights: dict, least: float) -> dict[str, str]:
    """The least key of each key's group, by sets that are merged pair by pair."""
    of = {s: {s} for s in sets}
    for a, x in sets.items():
        for b, y in sets.items():
            if of[a] is not of[b] and _score(x, y, weights) >= least - 1e-12:
                both = of[a] | of[b]
                of |= dict.fromkeys(both, both)
    return {s: min(g) for s, g in of.items()}


def test_similarity_components_make_no_pairs(spark, monkeypatch):
    rows, weights = _written(monkeypatch), {"x": 0.5, "y": 0.3, "z": 0.2}
    sets = _crowd() | {f"u{i:02}": {"x": {"hot"}, "y": {f"w{i}"}} for i in range(50)} | {f"v{i}": {"y": {"hot"}, "z": {"hot"}, "x": {f"own{i}"}} for i in range(9)}
    features = _rows(spark, sets)
    got = {r["node"]: r["component"] for r in ev.similarity_components(features, weights, 0.45).collect()}
    assert got == _groups(sets, weights, 0.45) and len(set(got.values())) == 49
    assert max(rows) <= features.count()  # there were 4950 pairs


@pytest.mark.parametrize("least", [0.22, 0.45, 0.8])
def test_similarity_components_of_random_sets(spark, least):
    rng, weights = random.Random(11), {"x": 0.5, "y": 0.3, "z": 0.2}
    sets = {f"s{i:02}": {k: {f"{rng.randrange(9)}" for _ in range(rng.randrange(0, 4))} for k in (*weights, "other")} for i in range(45)}
    sets = {s: m for s, m in sets.items() if any(m.values())}
    features = _rows(spark, sets).union(spark.createDataFrame([("none", "x", None), (None, "x", "1")], "key string, kind string, item string"))
    got = [(r["node"], r["component"]) for r in ev.similarity_components(features, weights, least).collect()]
    assert sorted(got) == sorted((_groups(sets, weights, least) | {"none": "none"}).items())


def test_readiness(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("e", "d"), ("f", "e"), ("g", "h")], "src string, dst string")
    n = lambda *x: spark.createDataFrame([(i,) for i in x], "node string")
    got = {r["node"]: r["state"] for r in ev.readiness(e, n("lone"), n("c"), n("h")).collect()}
    assert got == {"a": "blocked", "b": "blocked", "c": "blocked", "d": "cyclic", "e": "cyclic", "f": "waits-on-cycle", "g": "doubtful", "h": "doubtful", "lone": "ready"}


def test_stack_walk(spark):
    rows = [("v", "obj", "push", "name"), ("obj", "arg", "pass", None), ("arg", "field", "pop", "name"), ("arg", "other", "pop", "age"), ("field", "v", "pass", None), ("obj", "obj", "push", "deep")]
    e = spark.createDataFrame(rows, "src string, dst string, op string, key string")
    got = {(r["node"], tuple(r["keys"])): r["hops"] for r in ev.stack_walk(e, spark.createDataFrame([("v",)], "node string"), 20, 2).collect()}
    assert got[("field", ())] == 3 and got[("arg", ("name",))] == 2 and ("other", ()) not in got and got[("obj", ("name", "deep"))] == 2
    assert max(len(k) for _, k in got) == 2


def test_stack_walk_tells_where_it_was_cut(spark):
    e = spark.createDataFrame([("a", "b", "push", "k"), ("b", "a", "push", "k"), ("b", "c", "pass", None), ("c", "d", "pass", None)], "src string, dst string, op string, key string")
    start = spark.createDataFrame([("a",)], "node string")
    cut = {(r["node"], len(r["keys"])) for r in ev.stack_walk(e, start, 20, 2).filter("cut").collect()}
    assert cut == {("a", 2)}  # a third key
    short = {(r["node"], len(r["keys"])) for r in ev.stack_walk(e, start, 2, 8).filter("cut").collect()}
    assert short == {("a", 2), ("c", 1)}


def test_stage_merge(spark):
    rows = [("f", i, n, out) for i, (n, out) in enumerate([(10, False), (20, False), (40, False), (5, True), (1, False), (100, False), (None, None)])]
    df = spark.createDataFrame(rows, "k string, i int, n int, out boolean")
    got = {r["i"]: r["stage"] for r in ev.stage_merge(df, ["k"], "i", "n", "out", 60).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3, 5: 4, 6: 5}


def test_closure_report_and_tiers(spark):
    e = spark.createDataFrame([("a", f"n{i}") for i in range(5)], "src string, dst string")
    got = ev.bounded_closure(e, spark.createDataFrame([("a",), ("z",)], "node string"), 3, 4).collect()
    assert sum(r["origin"] == "a" for r in got) == 4 and all(r["truncated"] == (r["origin"] == "a") for r in got)
    c = spark.createDataFrame([("k", 1, False), ("k", 2, True), ("k", 3, True), ("m", 9, False)], "k string, v int, exact boolean")
    best = ev.best_tier(c, ["k"], [F.col("exact"), F.lit(True)]).collect()
    assert {(r["v"], r["tier"], r["ambiguous"]) for r in best} == {(2, 1, True), (3, 1, True), (9, 2, False)}


def test_only_queries_are_read(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("numbers")
    assert ev.read_only(spark, "WITH x AS (SELECT id FROM numbers) SELECT count(*) AS drop_table FROM x").first()[0] == 3
    for text in ("DROP VIEW numbers", "CREATE TABLE t AS SELECT 1", "INSERT INTO numbers SELECT 1", "SET a=b", f"INSERT OVERWRITE DIRECTORY '{tmp_path}' USING parquet SELECT 1", "DELETE FROM numbers WHERE id = 1"):
        with pytest.raises(PermissionError):
            ev.read_only(spark, text)


def test_selectors(spark):
    rows = spark.createDataFrame([("s1", "c1", "n1"), ("s1", None, "n2"), ("s2", "c1", "n3"), (None, "c1", "n4"), ("s3", None, "n5")], "session_id string, correlation_id string, node_id string")
    ids = lambda df: {r["node_id"] for r in df.collect()}
    assert ids(ev.select_events(rows, session="s3")) == {"n5"}
    assert ids(ev.select_events(rows, correlation="c1")) == {"n1", "n2", "n3", "n4"}
    assert ids(ev.select_events(rows, node="n2")) == {"n1", "n2"}
    with pytest.raises(ValueError):
        ev.select_events(rows)


def test_relation_evidence_needs_every_value(spark):
    r = spark.createDataFrame([("r", "a", "x", "T", '{"role":"receiver"}'), ("r", "a", "y", "T", '{"role":"index"}'), ("r", "b", "x", "T", '{"role":"index"}'), ("r", "c", "c", "T", '{"role":"index"}')], "provenance_id string, from_id string, to_id string, rel_type string, props_json string")
    e = spark.createDataFrame([("r", "a", ["L"]), ("r", "b", None)], "provenance_id string, stable_id string, labels array<string>")
    props = {"role": ["receiver", "index"]}
    assert {x["stable_id"] for x in ev.relation_evidence(r, e, ["T"], None, props, every="role").collect()} == {"a"}
    assert {x["stable_id"] for x in ev.relation_evidence(r, e, ["T"], ["L"]).collect()} == {"a"}


def test_innermost_owner(spark):
    df = spark.createDataFrame([("s", "block"), ("s", "fn"), ("block", "fn"), ("s", "other")], "node string, owner string")
    got = {(r["node"], r["owner"]) for r in ev.innermost(df).collect()}
    assert got == {("s", "block"), ("s", "other"), ("block", "fn")}
