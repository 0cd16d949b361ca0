"""Readers, writers, upserts and streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ashlar.sources import graph_io as io
from ashlar.streaming import runtime_stream as rs

NODE = "stable_id string, labels array<string>, props_json string"
REL = "from_id string, to_id string, rel_type string, props_json string"


def test_write_is_exclusive_and_counted(spark, tmp_path):
    df = spark.range(250)
    assert io.write_table(df, f"{tmp_path}/t", rows_per_file=100) == 250
    with pytest.raises(Exception, match="already exists"):
        io.write_table(df, f"{tmp_path}/t")
    with pytest.raises(ValueError):
        io.write_verified(df, f"{tmp_path}/u", 251)
    io.write_report({"n": 1}, f"{tmp_path}/r.json")
    with pytest.raises(FileExistsError):
        io.write_report({"n": 1}, f"{tmp_path}/r.json")
    assert sum(len(b) for b in io.batches(spark.read.parquet(f"{tmp_path}/t"), 60)) == 250


def test_appender_flushes(spark, tmp_path):
    with io.Appender(spark, f"{tmp_path}/a", "x int", threshold=4) as a:
        for i in range(10):
            a.add((i,))
        assert a.written == 8
    assert spark.read.parquet(f"{tmp_path}/a").count() == 10


def test_catalog_is_swapped_and_validated(spark, tmp_path):
    folder = f"{tmp_path}/catalog"
    prov = spark.createDataFrame([("r", "{}")], "id string, metadata_json string")
    rels = spark.createDataFrame([], "from_id string, provenance_id string")
    for n in (1, 2):
        nodes = spark.createDataFrame([(f"n{i}", "r") for i in range(n)], "stable_id string, provenance_id string")
        io.publish(spark, {"nodes": nodes, "relationships": rels, "provenance": prov}, folder)
        assert io.read_catalog(spark, folder)["nodes"].count() == n
    bad = spark.createDataFrame([("x", "other")], "stable_id string, provenance_id string")
    io.publish(spark, {"nodes": bad, "relationships": rels, "provenance": prov}, folder)
    with pytest.raises(ValueError, match="other"):
        io.read_catalog(spark, folder)
    assert [p.name for p in tmp_path.iterdir()] == ["catalog"]


def test_upserts(spark):
    old = spark.createDataFrame([("a", ["X"], '{"k":1,"gone":2}'), ("b", ["Y"], "{}")], NODE)
    new = spark.createDataFrame([("a", ["Z"], '{"gone":null,"n":3}'), ("c", ["Q"], None)], NODE)
    got = {r["stable_id"]: r for r in io.upsert_entities(old, new).collect()}
    assert got["a"]["labels"] == ["X", "Z"] and json.loads(got["a"]["props_json"]) == {"k": 1, "n": 3} and got.keys() == {"a", "b", "c"}
    rel = lambda *rows: spark.createDataFrame(rows, REL)
    both = io.upsert_relationships(rel(("a", "b", "T", '{"x":1}')), rel(("a", "b", "T", '{"y":2}'), ("a", "b", "T", '{"producer_outcome":true}'))).collect()
    assert sorted(json.loads(r["props_json"]).keys() for r in both) == [["producer_outcome"], ["x", "y"]] or len(both) == 2


def test_endpoints_and_replacement(spark):
    nodes = spark.createDataFrame([("a", [], "{}"), ("b", [], "{}")], NODE)
    rel = lambda *rows: spark.createDataFrame(rows, REL)
    kept = io.resolve_endpoints(rel(("a", "b", "T", None), ("a", "zz", "CAPTURES_VALUE", '{"context_only":true}')), nodes)
    assert kept.count() == 1
    with pytest.raises(ValueError, match="zz"):
        io.resolve_endpoints(rel(("a", "zz", "T", None)), nodes)
    old = spark.createDataFrame([("a", True), ("c", True), ("d", False)], "stable_id string, note boolean")
    new = spark.createDataFrame([("a", False)], "stable_id string, note boolean")
    assert {(r[0], r[1]) for r in io.replace_keeping(old, new, F.col("note")).collect()} == {("a", False), ("c", True)}
    replaced = io.replace_types(rel(("a", "b", "T", None), ("a", "c", "T", None), ("a", "c", "U", None)), rel(("a", "d", "T", None)))
    assert {(r["to_id"], r["rel_type"]) for r in replaced.collect()} == {("d", "T"), ("c", "U")}
    with pytest.raises(ValueError):
        io.require_unique(rel(("a", "b", "T", None), ("a", "c", "T", None)), ["from_id"])


def test_scoped_replacement_keeps_the_border(spark):
    n = lambda *ids: spark.createDataFrame([(i,) for i in ids], "stable_id string")
    r = lambda *rows: spark.createDataFrame(rows, "signature string, from_id string, to_id string")
    nodes, rels = io.scoped_replacement(n("in1", "in2", "out"), r(("s1", "in1", "in2"), ("s2", "out", "in1"), ("s3", "out", "in2")), n("in1", "in2"), n("in1", "in3"), r(("s4", "in1", "in3")))
    assert {x[0] for x in nodes.collect()} == {"in1", "in3", "out"} and {x["signature"] for x in rels.collect()} == {"s2", "s4"}


def test_typed_rows_to_graph(spark):
    rows = spark.createDataFrame([("f", "cell", "GET"), ("f", "cell", "set"), (None, "cell", "get")], "fn string, store string, access string")
    e, r = io.to_graph(rows, "fn", "store", io.access_type("access"), ["Fn"], ["Store"], "stores", "run", F.struct("access"))
    assert {x["stable_id"] for x in e.collect()} == {"f", "cell"} and {x["rel_type"] for x in r.collect()} == {"GETS", "SETS"}
    assert e.select("ordinal").distinct().count() == 2


def test_file_and_package_rows(spark):
    rows = io.file_edges(spark.createDataFrame([("src\\a\\x.ts", "./src/b/y.ts"), ("z.ts", None)], "from_path string, to_path string")).collect()
    assert len(rows) == 1 and rows[0]["from_folder"] == "src/a" and rows[0]["to_name"] == "y.ts" and not rows[0]["same_folder"]
    packages = spark.createDataFrame([("left", "dependencies")], "package string, scope string")
    got = {r["package"]: r["scope"] for r in io.package_edges(spark.createDataFrame([("left",), ("right",)], "package string"), packages).collect()}
    assert got == {"left": "dependencies", "right": "transitiveOrUnlisted"}


def test_numbers_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert sorted((r["k"], r["idx"]) for r in io.numbered(df, ["k"]).collect()) == [(i, i) for i in range(1000)]


def test_resume_and_import_record(spark, tmp_path):
    rows = spark.createDataFrame([("r",)], "provenance_id string")
    assert io.resumable(rows, "r") and not io.resumable(rows.limit(0), "r")
    with pytest.raises(ValueError):
        io.resumable(rows, "other")
    for _ in range(2):
        io.import_run(spark, f"{tmp_path}/runs", "r", "full", 1, 2)
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 2


T0 = datetime(2025, 1, 1)
COLUMNS = [c.strip().split(" ")[0] for c in rs.RECORD.split(",")]


def record(n, **more):
    base = dict.fromkeys(COLUMNS) | {"event_id": f"e{n}", "node_id": f"n{n % 3}", "session_id": "s", "function_stable_id": "a.ts:1:0:2:0", "kind": "call", "update_only": False, "score": 1735689600000 + n * 1000, "ingested_at": T0 + timedelta(seconds=n), "raw_json": "{}"}
    return tuple((base | more)[c] for c in COLUMNS)


def write(spark, path, *files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, rs.RECORD).coalesce(1).write.mode("append").parquet(str(path))


def test_ingest_skips_and_counts(spark, tmp_path):
    write(spark, tmp_path / "in", [record(0), record(1, node_id=None)], [record(2)])
    rs.ingest(rs.source(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    counts = spark.read.parquet(f"{tmp_path}/out/counts").agg(F.sum("stored"), F.sum("skipped"), F.count_distinct("batch")).first()
    assert tuple(counts) == (2, 1, 2)
    assert spark.read.parquet(f"{tmp_path}/out/records").count() == 2
    rs.ingest(rs.source(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/records").count() == 2
    rs.clear(spark, f"{tmp_path}/out")
    assert not (tmp_path / "out").exists()


def test_running_views_equal_batch(spark, tmp_path):
    rows = [record(n, kind="error" if n % 4 == 0 else "call", update_only=n % 5 == 0) for n in range(40)]
    write(spark, tmp_path / "in", rows[20:], rows[:20])  # out of order
    batch = spark.createDataFrame(rows, rs.RECORD)
    for i, view in enumerate((rs.latest_values, rs.session_totals, rs.merged_nodes)):
        got = rs.run_to_end(view(rs.source(spark, f"{tmp_path}/in", 1)), f"{tmp_path}/{i}", "complete")
        assert sorted(map(str, got.collect())) == sorted(map(str, view(batch).collect()))


def test_late_rows_fall_behind_the_watermark(spark, tmp_path):
    write(spark, tmp_path / "in", [record(0), record(2000)])
    write(spark, tmp_path / "in", [record(4000), record(4001)])
    write(spark, tmp_path / "in", [record(1), record(4002)])  # more than ten minutes late
    df = rs.windowed_counts(rs.timed(rs.source(spark, f"{tmp_path}/in", 1)))
    got = rs.run_to_end(df, f"{tmp_path}/q", "append")
    assert got.agg(F.sum("events")).first()[0] <= 5 and got.filter("events > 1").count() <= 1


def test_deduplication_and_anchors(spark, tmp_path):
    write(spark, tmp_path / "in", [record(0), record(0), record(1, function_stable_id=r"b.ts:1:0:2:0:x")])
    df = rs.deduplicated(rs.timed(rs.source(spark, f"{tmp_path}/in")))
    assert rs.run_to_end(df, f"{tmp_path}/d", "append").count() == 2
    known = spark.createDataFrame([("b.ts:1:0:2:0",), (None,)], "stable_id string")
    got = rs.run_to_end(rs.anchored(rs.source(spark, f"{tmp_path}/in"), known), f"{tmp_path}/a", "append")
    assert sorted(r["known"] for r in got.collect()) == [False, False, True]


def test_payload_shapes(spark):
    texts = ['{"nodeid":"a","nodeProps":{"kind":"call","sessionId":"s","tsMs":5}}', '{"nodeId":"b","props":{"kind":"loop"},"updateOnly":true}', '{"event":{"nodeId":"c"},"kind":"x"}', "{}", "no json", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(rs.normalized(F.col("t")).alias("p")).select("p.*").collect()
    assert [r["node_id"] for r in rows] == ["a", "b", "c", None, None, None]
    assert rows[0]["score"] == 5 and rows[1]["update_only"] and rows[1]["kind"] == "loop" and not rows[0]["update_only"]
