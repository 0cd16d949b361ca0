"""Runtime records: merging of updates, causal links, coverage, iterations, and comparison with the static graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ashlar.functions.ids import coordinate, normalize_id
from ashlar.operators.relational import consecutive_pairs, nonnull_first

CARRIED = ("parent_node_id", "session_id", "correlation_id", "function_stable_id", "kind")
#: Outcomes of an iteration from strong to weak, by event kind or flag.
OUTCOMES = ("error", "accumulated", "accepted", "rejected")


def event_time(score: str = "score", ingested: str = "ingested_at") -> Column:
    """Epoch milliseconds of an event; a missing or non-positive score falls back to the ingestion."""
    return F.when(F.col(score) > 0, F.col(score)).otherwise(F.unix_millis(F.col(ingested).cast("timestamp")))


def node_prop(name: str, raw: str = "raw_json") -> Column:
    return F.get_json_object(raw, f"$.nodeProps.{name}")


def merged_nodes(records: DataFrame) -> DataFrame:
    """One row for each node: the first non-null of every carried column in order of time and event, kinds (sorted set),
    events, update_merged and has_response_update. Rows without a node are left out."""
    rows = records.filter("node_id is not null").withColumn("_at", F.struct(event_time().alias("t"), "event_id"))
    first = [nonnull_first(c, "_at").alias(c) for c in CARRIED]
    answered = F.col("update_only") & F.col("kind").isin("response", "error")
    return rows.groupBy("node_id").agg(
        *first, F.min(F.col("_at.t")).alias("first_ms"), F.max(F.col("_at.t")).alias("last_ms"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.count(F.lit(1)).alias("events"),
        F.coalesce(F.bool_or("update_only"), F.lit(False)).alias("update_merged"), F.coalesce(F.bool_or(answered), F.lit(False)).alias("has_response_update"),
    )


def parent_links(nodes: DataFrame) -> DataFrame:
    """Strong links from each node's parent, where that is a node too."""
    known = nodes.select(F.col("node_id").alias("parent_node_id"))
    rows = nodes.join(known, "parent_node_id", "left_semi")
    return _link(rows, "parent_node_id", "node_id", "PARENT", "strong")


def _link(rows: DataFrame, source: str, target: str, kind: str, strength: str) -> DataFrame:
    key = F.concat_ws(":", F.lit(kind), source, target, F.coalesce("correlation_id", F.lit("")))
    return rows.select(key.alias("id"), F.col(source).alias("source"), F.col(target).alias("target"), F.lit(kind).alias("kind"), F.lit(strength).alias("strength"))


def correlation_links(nodes: DataFrame) -> DataFrame:
    """Medium links between nodes that follow one another in time in the same correlation."""
    pairs = consecutive_pairs(nodes.filter("correlation_id is not null"), ["correlation_id"], ["first_ms", "node_id"], ["node_id"])
    return _link(pairs, "previous_node_id", "node_id", "ASYNC", "medium")


def causal_links(nodes: DataFrame) -> DataFrame:
    """All links, each id once."""
    return parent_links(nodes).unionByName(correlation_links(nodes)).dropDuplicates(["id"])


def causal_candidates(records: DataFrame) -> DataFrame:
    """Correlations and sessions with at least two nodes: by, key, nodes, rows."""
    parts = []
    for by, column in (("correlation", "correlation_id"), ("session", "session_id")):
        g = records.filter(F.col(column).isNotNull() & F.col("node_id").isNotNull()).groupBy(F.col(column).alias("key"))
        parts.append(g.agg(F.count_distinct("node_id").alias("nodes"), F.count(F.lit(1)).alias("rows")).withColumn("by", F.lit(by)))
    return parts[0].unionByName(parts[1]).filter("nodes >= 2")


def session_coverage(records: DataFrame, entities: DataFrame) -> DataFrame:
    """session_id, events, nodes, functions (distinct, as normalised) and anchored (those that are known entities)."""
    known = entities.select(normalize_id("stable_id").alias("function")).filter("function is not null").distinct().withColumn("known", F.lit(1))
    rows = records.filter("session_id is not null").withColumn("function", normalize_id("function_stable_id"))
    functions = rows.select("session_id", "function").filter("function is not null").distinct().join(known, "function", "left")
    functions = functions.groupBy("session_id").agg(F.count(F.lit(1)).alias("functions"), F.count("known").alias("anchored"))
    base = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("node_id").alias("nodes"))
    zero = F.lit(0).cast("long")
    return base.join(functions, "session_id", "left").select("session_id", "events", "nodes", F.coalesce("functions", zero).alias("functions"), F.coalesce("anchored", zero).alias("anchored"))


def latest_by_function(records: DataFrame) -> DataFrame:
    """function_stable_id with the session, kind and time of its latest event; of equal times the greater event id."""
    last = F.max(F.struct(event_time().alias("t"), "event_id", "session_id", "kind")).alias("l")
    rows = records.filter("function_stable_id is not null").groupBy("function_stable_id").agg(last, F.count(F.lit(1)).alias("events"))
    return rows.select("function_stable_id", "l.session_id", "l.kind", F.col("l.t").alias("last_ms"), "events")


def recent_window(records: DataFrame, window_ms: int = 30_000) -> DataFrame:
    """session_id and how many of its events lie within ``window_ms`` of its last one."""
    rows = records.filter("session_id is not null").select("session_id", event_time().alias("t"))
    last = rows.groupBy("session_id").agg(F.max("t").alias("last_ms"))
    return rows.join(last, "session_id").filter(F.col("t") >= F.col("last_ms") - window_ms).groupBy("session_id", "last_ms").agg(F.count(F.lit(1)).alias("recent"))


def iterations(records: DataFrame) -> DataFrame:
    """For each session, function and iteration: events, outcome, path (kinds in order) and signature of the path.

    The strongest outcome counts: an error, then a stored result, then a match, else rejected.
    """
    rows = records.withColumn("iteration", F.try_to_number(node_prop("iterationIndex"), F.lit("999999999")).cast("long"))
    rows = rows.filter("iteration is not null and function_stable_id is not null").withColumn("t", event_time())
    rank = F.when(F.col("kind") == "error", 1).when(F.col("kind") == "store.set", 2).when(node_prop("matched") == "true", 3).otherwise(4)
    path = F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id", F.coalesce("kind", F.lit("?")).alias("kind")))), lambda x: x.kind)
    g = rows.groupBy("session_id", "function_stable_id", "iteration").agg(F.count(F.lit(1)).alias("events"), F.min(rank).alias("rank"), path.alias("path"))
    outcome = F.element_at(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("rank"))
    text = F.array_join("path", ">")
    return g.select("session_id", "function_stable_id", "iteration", "events", outcome.alias("outcome"), text.alias("path"), F.md5(text).alias("signature"))


def branch_segments(iterated: DataFrame, samples: int = 5) -> DataFrame:
    """Iterations by signature: path, n, functions and up to ``samples`` of their functions in order."""
    g = iterated.groupBy("signature", "path").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("function_stable_id").alias("functions"))
    w = W.partitionBy("signature").orderBy("function_stable_id")
    some = iterated.select("signature", "function_stable_id").distinct().withColumn("at", F.row_number().over(w)).filter(F.col("at") <= samples)
    some = some.groupBy("signature").agg(F.array_join(F.array_sort(F.collect_list("function_stable_id")), ",").alias("samples"))
    return g.join(some, "signature")


def edge_pairs(records: DataFrame) -> DataFrame:
    """Distinct steps between different functions that follow one another in a session: source, target, n."""
    rows = records.filter("function_stable_id is not null and session_id is not null").withColumn("t", event_time())
    pairs = consecutive_pairs(rows, ["session_id"], ["t", "event_id"], ["function_stable_id"])
    pairs = pairs.filter("previous_function_stable_id <> function_stable_id")
    return pairs.groupBy(F.col("previous_function_stable_id").alias("source"), F.col("function_stable_id").alias("target")).agg(F.count(F.lit(1)).alias("n"))


def guard_cases(records: DataFrame) -> DataFrame:
    """Events numbered by case: each guard of a session and function opens one; with the last iteration seen before."""
    rows = records.filter("function_stable_id is not null and session_id is not null").withColumn("t", event_time())
    w = W.partitionBy("session_id", "function_stable_id").orderBy("t", "event_id")
    case = F.count_if(F.col("kind") == "guard").over(w.rowsBetween(W.unboundedPreceding, 0))
    before = F.last(node_prop("iterationIndex"), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return rows.select("event_id", case.alias("case_no"), before.alias("prior_iteration"))


def transitions(records: DataFrame, relationships: DataFrame) -> DataFrame:
    """source, target, status: calls that the static graph has and that were observed (``matched``), only one of them
    (``runtime-only``, ``static-only``). Ids as normalised."""
    seen = edge_pairs(records).select(normalize_id("source").alias("source"), normalize_id("target").alias("target")).filter("source <> target").distinct().withColumn("r", F.lit(1))
    calls = relationships.filter("rel_type = 'CALLS' and from_id is not null and to_id is not null")
    calls = calls.select(normalize_id("from_id").alias("source"), normalize_id("to_id").alias("target")).distinct().withColumn("s", F.lit(1))
    status = F.when(F.col("r").isNull(), "static-only").when(F.col("s").isNull(), "runtime-only").otherwise("matched")
    return seen.join(calls, ["source", "target"], "full").select("source", "target", status.alias("status"))


def coordinate_key(c: str) -> Column:
    """``coord:path:line`` of a coordinate id, else the id."""
    at = coordinate(c)
    return F.coalesce(F.concat(F.lit("coord:"), at.path, F.lit(":"), at.start_line.cast("string")), F.col(c))


def completeness(records: DataFrame) -> DataFrame:
    """Counts of what a session's records lack."""
    known = records.select(F.col("node_id").alias("parent_node_id"), F.lit(1).alias("has")).distinct()
    rows = records.join(known, "parent_node_id", "left")
    return rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("parent_node_id").isNull()).alias("roots"),
        F.count_if(F.col("parent_node_id").isNotNull() & F.col("has").isNull()).alias("lost_parents"), F.count_if(F.col("correlation_id").isNull()).alias("uncorrelated"),
        F.count_if(F.col("function_stable_id").isNull()).alias("unanchored"), F.count_if(~(F.coalesce("score", F.lit(0)) > 0)).alias("untimed"),
    )


def branch_outcomes(records: DataFrame) -> DataFrame:
    """session_id, function_stable_id, outcome: the strongest observation of each guard (then, else, evaluated)."""
    rows = records.filter("kind = 'guard' and function_stable_id is not null")
    rank = F.when(node_prop("matched") == "true", 1).when(node_prop("matched") == "false", 2).otherwise(3)
    g = rows.groupBy("session_id", "function_stable_id").agg(F.min(rank).alias("rank"), F.count(F.lit(1)).alias("evaluations"))
    return g.select("session_id", "function_stable_id", F.element_at(F.array(F.lit("then"), F.lit("else"), F.lit("evaluated")), F.col("rank")).alias("outcome"), "evaluations")


def trace_buckets(records: DataFrame) -> DataFrame:
    """Events by correlation, else by parent, else by node: bucket, events, functions, fingerprint of the sorted kinds."""
    key = F.coalesce(F.concat(F.lit("corr:"), "correlation_id"), F.concat(F.lit("parent:"), "parent_node_id"), F.concat(F.lit("node:"), "node_id"))
    g = records.withColumn("bucket", key).groupBy("bucket").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("function_stable_id").alias("functions"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return g.select("bucket", "events", "functions", F.sha2("kinds", 256).alias("fingerprint"))


def uncovered(entities: DataFrame, records: DataFrame, label: str) -> DataFrame:
    """stable_id of the entities with ``label`` that no record is anchored to."""
    units = entities.filter(F.array_contains("labels", label)).select(normalize_id("stable_id").alias("stable_id")).na.drop().distinct()
    return units.join(records.select(normalize_id("function_stable_id").alias("stable_id")), "stable_id", "left_anti")


def interval_comparison(baseline: DataFrame, candidate: DataFrame, key: str, value: str) -> DataFrame:
    """key, before, after, delta, percent, state (``slower``, ``faster``, ``same``, ``missing``, ``new``)."""
    both = baseline.select(key, F.col(value).alias("before")).join(candidate.select(key, F.col(value).alias("after")), key, "full")
    delta = F.col("after") - F.col("before")
    state = F.when(F.col("after").isNull(), "missing").when(F.col("before").isNull(), "new").when(delta > 0, "slower").when(delta < 0, "faster").otherwise("same")
    return both.select(key, "before", "after", delta.alias("delta"), F.try_divide(delta * 100, F.col("before")).alias("percent"), state.alias("state"))
