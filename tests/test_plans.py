"""What the physical plans must and must not have."""

import pytest

import __spark_entry__ as entry
from ashlar.operators import classification as cl
from ashlar.operators import levels
from ashlar.runtime import BROADCAST_ROWS, WorkTable, checked_broadcast, clear_work, work_folder
from ashlar.sources.tables import table

#: Queries of one plan, without loops.
PLAIN = [
    "promoted_nodes", "label_membership", "edge_role_inventory", "relationship_policies", "relation_inventory_policy", "dependency_edges", "reciprocal_pairs", "nearest_owner_tier", "fact_flags_case", "label_cooccurrence",
    "jaccard_pairs", "preceding_artifact", "later_siblings", "catalog_bag_diff", "added_by_rel_type", "label_changes", "merged_runtime_nodes", "causal_links", "runtime_static_transitions", "steps_in_function_ranges",
    "coverage_transitions", "cohort_ledger", "reference_categories", "affordance_contexts", "downstream_calls", "crossing_scope_edges", "first_by_prefix", "same_name_links", "unpivot_properties",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_products_and_no_python(spark, data, name):
    text = plan(entry.queries()[name](spark, data))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInArrow", "FlatMapGroupsInPandas"):
        assert bad not in text


def test_filters_and_columns_reach_the_scan(spark, data):
    r = table(spark, data, "raw_relationships")
    text = plan(r.filter("rel_type = 'CALLS'").groupBy("from_id").count())
    assert "PushedFilters: [IsNotNull(rel_type), EqualTo(rel_type,CALLS)]" in text and "ReadSchema: struct<from_id:string,rel_type:string>" in text
    scans = plan(entry.queries()["label_populations"](spark, data))
    assert "ReadSchema: struct<labels:array<string>>" in scans
    only = plan(entry.queries()["binding_history"](spark, data))
    assert "props_json" not in only and "In(rel_type" in only


def test_policies_are_broadcast(spark, data):
    r = table(spark, data, "raw_relationships")
    assert "BroadcastHashJoin" in plan(levels.inventory(r)) and "BroadcastHashJoin" in plan(cl.with_policy(r.select("rel_type")))


def test_broadcasts_are_checked(spark):
    assert "rightHint=(strategy=broadcast)" in str(spark.range(9).join(checked_broadcast(spark.range(BROADCAST_ROWS)), "id")._jdf.queryExecution().optimizedPlan().toString())
    assert "broadcast" not in spark.range(9).join(checked_broadcast(spark.range(BROADCAST_ROWS + 1)), "id")._jdf.queryExecution().optimizedPlan().toString()


def test_range_partitioned_snapshots_shuffle_once(spark, data):
    from ashlar.operators import snapshots

    kept = []
    original = snapshots.materialize
    snapshots.materialize = lambda df, name: (kept.append(plan(df)), original(df, name))[1]
    try:
        # of so small a table one range is made in production, so a smaller size of a range is asked for here
        snapshots.snapshot_changes(*[spark.read.parquet(f"{data}/{t}.parquet") for t in ("raw_entities", "extraction_provenance")], size=10_000)
    finally:
        snapshots.materialize = original
    assert kept[0].count("rangepartitioning") == 1 and kept[0].count("Exchange hashpartitioning(stable_id") == 0


def test_work_tables(spark):
    t = WorkTable(spark.range(5), "t")
    assert t.path.startswith(work_folder(spark)) and t.df.count() == 5
    t.drop()
    lasting = WorkTable(spark.range(3), "t")
    assert clear_work(spark) >= 1 and clear_work(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        spark.read.parquet(lasting.path).count()
    empty = WorkTable(spark.range(5).filter("id > 9"), "t")
    assert empty.df.isEmpty() and empty.df.columns == ["id"]
