"""Schemas that drift between the runs of a workspace: edit scripts per source kind and run, and one consistent table.

The schema of a run and kind is a tree of the fields in ``props_json`` with the JSON types of their values, beside the
set of its labels. Between consecutive runs a cheapest script of add, delete, rename, retype and move turns one tree
into the other; a rename of a top-level field or label is allowed where the values of the entities speak for it. The
scripts of a workspace, and one more from its last schema to the target that all workspaces share, compile into one plan
of renames, moves and casts per run and kind, which is applied to every row.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.functions import tree_edit as te
from ashlar.functions.json_projection import Plan, members
from ashlar.functions.json_values import TYPES, facts, spelled
from ashlar.runtime import checked_broadcast, materialize
from ashlar.sources.tables import runs

#: A rename needs at least NUM / DEN of the entities that had the old name.
NUM, DEN = 2, 3
_RENAME = 0.5
#: Distinct schema entries that a task gathers before it hands them on.
_HELD = 200_000

_ENTRIES = "provenance_id string, source_kind string, item string, path string, type string"
_VALUES = "g1 long, g2 long, side int, stable_id string, ordinal long, item string, name string, value string"
_EDITS = "workspace string, seq int, source_kind string, op string, item string, old_path string, new_path string, old_types string, new_types string, cost double"


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema)], [n for n, _ in schema])


_S, _L, _I = pa.string(), pa.int64(), pa.int32()
_ENTRY_FIELDS = [(n, _S) for n in ("provenance_id", "source_kind", "item", "path", "type")]
_VALUE_FIELDS = [("g1", _L), ("g2", _L), ("side", _I), ("stable_id", _S), ("ordinal", _L), ("item", _S), ("name", _S), ("value", _S)]
_EDIT_FIELDS = [("workspace", _S), ("seq", _I), *[(n, _S) for n in ("source_kind", "op", "item", "old_path", "new_path", "old_types", "new_types")], ("cost", pa.float64())]


def _walk(value, at: str, seen: set) -> None:
    for name, inner in value.items() if isinstance(value, dict) else (("[]", x) for x in value):
        path = f"{at}/{te.escaped(name)}"
        seen.add((path, inner.__class__))
        if isinstance(inner, (dict, list)) and inner:
            _walk(inner, path, seen)


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct schema entries of a task's rows; type '' for nulls."""
    held: dict[tuple, tuple[set, set]] = defaultdict(lambda: (set(), set()))
    name_of = {**TYPES, type(None): ""}

    def emit() -> pa.RecordBatch:
        rows = []
        for (run, kind), (fields, labels) in held.items():
            rows += [(run, kind, "field", p, name_of.get(t, "number")) for p, t in fields]
            rows += [(run, kind, "label", te.escaped(x), "") for x in labels]
        held.clear()
        return _batch(rows, _ENTRY_FIELDS)

    loads = json.loads
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("provenance_id", "source_kind", "props_json", "labels")]
        for run, kind, props, labels in zip(*columns):
            fields, known = held[run, kind]
            if labels:
                known.update(labels)
            if props is None:
                continue
            try:
                value = loads(props)
            except (ValueError, RecursionError):
                continue
            if value.__class__ is dict:
                for k, v in value.items():
                    c = v.__class__
                    fields.add((te.escaped(k), c))
                    if (c is dict or c is list) and v:
                        _walk(v, te.escaped(k), fields)
        for _, known in held.values():
            known.discard(None)
        if sum(len(f) + len(k) for f, k in held.values()) > _HELD:
            yield emit()
    yield emit()


def _values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row and request: that the entity is there (item ''), and its values of the asked names."""
    for batch in batches:
        rows = []
        names = ("g1", "g2", "side", "stable_id", "ordinal", "fields", "wanted", "labels", "props_json")
        for g1, g2, side, stable_id, ordinal, fields, wanted, labels, props in zip(*[batch.column(n).to_pylist() for n in names]):
            if side:
                rows.append((g1, g2, side, stable_id, ordinal, "", "", ""))
            if fields:
                have = facts(props)
                rows += [(g1, g2, side, stable_id, ordinal, "field", k, None if have[k] is None else spelled(have[k])) for k in fields if k in have]
            if wanted and labels:
                rows += [(g1, g2, side, stable_id, ordinal, "label", x, "") for x in wanted if x in labels]
        yield _batch(rows, _VALUE_FIELDS)


def _price(evidence: dict, item: str):
    def price(at: tuple, old: str, new: str, x: te.Node, y: te.Node) -> float:
        if not at:  # by the values of the entities; a larger share is cheaper
            same, had = evidence.get((item, old, new), (0, 0))
            return _RENAME * (2 - same / had) if had and DEN * same >= NUM * had else te.NEVER
        return 1.9 if x.shape() == y.shape() else te.NEVER  # inside, only the shape can speak for it

    return price


def _candidates(evidence: Iterable[tuple[str, str, str]], item: str):
    """At the top level the pairs with evidence; inside, names of one shape in their order, as these cost the same."""
    known = [(old, new) for i, old, new in evidence if i == item]

    def candidates(at: tuple, gone: dict, came: dict) -> Iterator[tuple[str, str]]:
        if not at:
            yield from ((old, new) for old, new in known if old in gone and new in came)
            return
        by = defaultdict(list)
        for new, y in came.items():
            by[y.shape()].append(new)
        for old, x in gone.items():
            if by.get(x.shape()):
                yield old, by[x.shape()].pop(0)

    return candidates


def _scripts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        names = ("workspace", "seq", "source_kind", "before", "after", "evidence")
        for workspace, seq, kind, before, after, evidence in zip(*[batch.column(n).to_pylist() for n in names]):
            known = {(e["item"], e["old"], e["new"]): (e["same"], e["had"]) for e in evidence or ()}
            for item in ("field", "label"):
                a, b = (te.build([(e["path"], e["type"]) for e in side or () if e["item"] == item]) for side in (before, after))
                cost, edits = te.script(a, b, _price(known, item), _candidates(known, item))
                for op, old, new, x, y in edits:
                    types = [",".join(sorted(n.types)) if n else "" for n in (x, y)]
                    rows.append((workspace, seq, kind, op, item, json.dumps(old), json.dumps(new), *types, cost))
        yield _batch(rows, _EDIT_FIELDS)


def _kinds(entities: DataFrame) -> DataFrame:
    return entities.select("provenance_id", F.coalesce("source_kind", F.lit("")).alias("source_kind"), "stable_id", "ordinal", "labels", "props_json")


def schemas(entities: DataFrame, provenance: DataFrame) -> DataFrame:
    """The entries (item, path, type) of each workspace, source kind and run (seq), gathered in one pass: a work table."""
    entries = _kinds(entities).select("provenance_id", "source_kind", "props_json", "labels").mapInArrow(_entries, _ENTRIES).distinct()
    schema = entries.join(checked_broadcast(runs(provenance)), "provenance_id").groupBy("workspace", "source_kind", "seq")
    return materialize(schema.agg(F.array_sort(F.collect_list(F.struct("item", "path", "type"))).alias("schema")), "schemas")


def edit_scripts(entities: DataFrame, provenance: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """The edits of each workspace, source kind and run but the first, against the run before: workspace, seq,
    source_kind, op (``add``, ``delete``, ``rename``, ``retype``, ``move``), item (``field``, ``label``), old_path,
    new_path (JSON lists of names), old_types, new_types, cost (of the whole script).

    A field is there if any row of the run and kind has the key, a null value suffices; null is no type. A kind that
    one of the two runs lacks is added or removed as a whole. Null props and labels have no entries, nor have texts
    that are no JSON object; a null source_kind is the kind ''. Rows of a run that provenance doesn't know, and
    repeated rows, add nothing. ``schema``: what ``schemas`` gave, if it is there already.
    """
    kinds = _kinds(entities)
    here = checked_broadcast(runs(provenance))
    schema = schemas(entities, provenance) if schema is None else schema
    after = schema.withColumn("side", F.lit(1))
    before = schema.withColumn("seq", F.col("seq") + 1).withColumn("side", F.lit(0))
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("schema")))
    pairs = before.unionByName(after).filter("seq > 1").groupBy("workspace", "source_kind", "seq").agg(pick(0).alias("before"), pick(1).alias("after"))
    pairs = pairs.filter(~F.col("before").eqNullSafe(F.col("after"))).join(here, ["workspace", "seq"])  # runs that exist
    pairs = materialize(pairs, "schema-pairs")

    names = lambda side, item: F.array_distinct(F.transform(F.filter(F.coalesce(side, F.array()), lambda e: (e.item == item) & ~F.contains(e.path, F.lit("/"))), lambda e: e.path))
    plain = lambda xs: F.transform(xs, lambda x: F.replace(F.replace(x, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    gone = lambda item: plain(F.array_except(names("before", item), names("after", item)))
    came = lambda item: plain(F.array_except(names("after", item), names("before", item)))
    nothing = F.array().cast("array<string>")
    asked = pairs.select(
        "workspace", "source_kind", "seq",
        *[F.when((F.size(gone(i)) > 0) & (F.size(came(i)) > 0), side(i)).otherwise(nothing).alias(f"{n}_{i}") for i in ("field", "label") for n, side in (("gone", gone), ("came", came))],
    ).filter("size(gone_field) + size(gone_label) > 0")
    group = [F.xxhash64("workspace", "source_kind", "seq").alias("g1"), F.xxhash64(F.lit(7), "seq", "source_kind", "workspace").alias("g2")]
    asked = materialize(asked.select("*", *group), "rename-candidates")
    wanted = asked.select("g1", "g2", "workspace", "source_kind", (F.col("seq") - 1).alias("seq"), F.lit(0).alias("side"), F.col("gone_field").alias("fields"), F.col("gone_label").alias("wanted"))
    wanted = wanted.union(asked.select("g1", "g2", "workspace", "source_kind", "seq", F.lit(1), "came_field", "came_label"))
    wanted = wanted.join(here, ["workspace", "seq"]).drop("workspace", "seq")
    rows = kinds.filter(F.col("stable_id").isNotNull()).join(checked_broadcast(wanted), ["provenance_id", "source_kind"])
    values = rows.select("g1", "g2", "side", "stable_id", "ordinal", "fields", "wanted", "labels", "props_json").mapInArrow(_values, _VALUES)
    values = values.select("g1", "g2", "side", "item", "name", "ordinal", *[c.alias(n) for c, n in ((F.xxhash64("stable_id"), "k1"), (F.xxhash64(F.lit(3), "stable_id"), "k2"))], F.when(F.col("value").isNotNull(), F.struct(F.xxhash64("value").alias("v1"), F.xxhash64(F.lit(5), "value").alias("v2"))).alias("value"))
    last = F.max(F.struct("ordinal", "value"))["value"].alias("value")
    merged = materialize(values.groupBy("g1", "g2", "k1", "k2", "side", "item", "name").agg(last), "rename-values")
    entity = ["g1", "g2", "k1", "k2"]
    had = merged.filter("side = 0 and value is not null").select(*entity, "item", F.col("name").alias("old"), "value")
    had = had.join(merged.filter("side = 1 and item = ''").select(*entity), entity, "left_semi")
    new = merged.filter("side = 1 and item <> '' and value is not null").select(*entity, "item", F.col("name").alias("new"), "value")
    total = had.groupBy("g1", "g2", "item", "old").agg(F.count(F.lit(1)).alias("had"))
    same = had.join(new, [*entity, "item", "value"]).groupBy("g1", "g2", "item", "old", "new").agg(F.count(F.lit(1)).alias("same"))
    evidence = same.join(total, ["g1", "g2", "item", "old"]).groupBy("g1", "g2").agg(F.collect_list(F.struct("item", "old", "new", "same", "had")).alias("evidence"))
    ready = pairs.select("workspace", "seq", "source_kind", "before", "after", *group).join(evidence, ["g1", "g2"], "left").drop("g1", "g2")
    return ready.mapInArrow(_scripts, _EDITS)


def drift(entities: DataFrame, provenance: DataFrame) -> DataFrame:
    """The changes at the top level, under the run in which they happened: provenance_id, source_kind, change,
    old_name, new_name. Edits below the top level are in ``edit_scripts`` only; a move to or from the top level is a
    removal or an addition there."""
    edits = edit_scripts(entities, provenance)
    name = lambda c: F.from_json(c, "array<string>")
    edits = edits.select("*", name("old_path").alias("old"), name("new_path").alias("new"))
    is_old, is_new = F.size("old") == 1, F.size("new") == 1
    change = (
        F.when((F.col("op") == "rename") & is_old, "renamed")
        .when((F.col("op") == "retype") & is_old & (F.col("item") == "field"), "retyped")
        .when(F.col("op").isin("delete", "move") & is_old, "removed")
        .when(F.col("op").isin("add", "move") & is_new, "added")
    )
    first = lambda c, of: F.when(F.col("change").isin(*of), F.element_at(c, 1)).otherwise("")
    at_top = edits.withColumn("change", change).filter("change is not null")
    at_top = at_top.filter("change <> 'retyped' or old_types <> new_types").join(checked_broadcast(runs(provenance)), ["workspace", "seq"])
    return at_top.select(
        "provenance_id", "source_kind", F.concat_ws("_", "item", "change").alias("change"),
        first("old", ("renamed", "removed", "retyped")).alias("old_name"), first("new", ("renamed", "added", "retyped")).alias("new_name"),
    )


def _one_name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The target of each kind: one name for each group of linked names, and the fields of all workspaces under it."""
    for batch in batches:
        rows = []
        for kind, entries, links in zip(*[batch.column(n).to_pylist() for n in ("source_kind", "entries", "links")]):
            weight: dict[tuple, int] = defaultdict(int)
            for e in entries:
                if "/" not in e["path"]:
                    weight[e["item"], te.unescaped(e["path"])] = max(weight[e["item"], te.unescaped(e["path"])], e["n"])
            names: dict[tuple, tuple] = {}
            for item in ("field", "label"):
                for olds, news in te.groups((x["old"], x["new"]) for x in links or () if x["item"] == item):
                    every = sorted({*olds, *news})
                    best = min(every, key=lambda x: (-weight.get((item, x), 0), x))  # noqa: B023
                    names |= {(item, x): best for x in every}
            count: dict[tuple, int] = defaultdict(int)
            for e in entries:
                top, _, rest = e["path"].partition("/")
                to = te.escaped(names.get((e["item"], te.unescaped(top)), te.unescaped(top)))
                count[e["item"], f"{to}/{rest}" if rest else to, e["type"]] += e["n"]
            # of several types of a field the most frequent one
            best: dict[tuple, tuple] = {}
            for (item, path, kind_of), n in sorted(count.items()):
                if (item, path) not in best or (kind_of and (not best[item, path][1] or n > best[item, path][0])):
                    best[item, path] = (n, kind_of)
            rows += [(kind, "entry", item, path, k) for (item, path), (_, k) in best.items()]
            rows += [(kind, "name", item, old, new) for (item, old), new in names.items() if old != new]
        yield _batch(rows, [(n, _S) for n in ("source_kind", "what", "item", "a", "b")])


def targets(schema: DataFrame, edits: DataFrame) -> DataFrame:
    """The target schema of each source kind: source_kind, target (structs of what, item, a, b: an ``entry`` has path and
    type, a ``name`` a top-level name and the one that stands for it).

    Names are one field if a script of any workspace renames one to the other, or if they differ in case and signs only,
    unless some run has both. The name that most workspaces end with stands for all.
    """
    last = schema.groupBy("workspace", "source_kind").agg(F.max_by("schema", "seq").alias("schema"))
    each = last.select("source_kind", F.explode("schema").alias("e")).select("source_kind", "e.item", "e.path", "e.type")
    entries = each.groupBy("source_kind", "item", "path", "type").agg(F.count(F.lit(1)).alias("n"))
    plain = F.replace(F.replace("name", F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    tops = schema.select("workspace", "source_kind", "seq", F.explode("schema").alias("e")).filter(~F.contains("e.path", F.lit("/")))
    tops = tops.select("workspace", "source_kind", "seq", "e.item", F.col("e.path").alias("name")).withColumn("name", plain).distinct()
    tops = materialize(tops, "top-names")
    head = lambda c: F.element_at(F.from_json(c, "array<string>"), 1)
    renamed = edits.filter("op = 'rename' and size(from_json(old_path, 'array<string>')) = 1")
    renamed = renamed.select("source_kind", "item", head("old_path").alias("old"), head("new_path").alias("new"))
    fold = F.lower(F.regexp_replace("name", r"[^\p{L}\p{N}]", ""))
    folded = tops.select("source_kind", "item", "name", fold.alias("fold")).filter("fold <> ''").distinct()
    spelled_alike = folded.join(folded.groupBy("source_kind", "item", "fold").agg(F.min("name").alias("old")), ["source_kind", "item", "fold"])
    links = renamed.union(spelled_alike.filter("name <> old").select("source_kind", "item", "old", F.col("name").alias("new"))).distinct()
    links = materialize(links, "name-links")
    by = ["source_kind", "item"]
    both = links.join(tops.withColumnRenamed("name", "old"), [*by, "old"]).join(tops.withColumnRenamed("name", "new"), [*by, "new", "workspace", "seq"], "left_semi")
    links = links.join(both.select(*by, "old", "new").distinct(), [*by, "old", "new"], "left_anti")
    links = links.groupBy("source_kind").agg(F.collect_list(F.struct("item", "old", "new")).alias("links"))
    whole = entries.groupBy("source_kind").agg(F.collect_list(F.struct("item", "path", "type", "n")).alias("entries")).join(links, "source_kind", "left")
    found = whole.mapInArrow(_one_name, "source_kind string, what string, item string, a string, b string")
    return found.groupBy("source_kind").agg(F.collect_list(F.struct("what", "item", "a", "b")).alias("target"))


def _steps(edits: list[dict], item: str) -> dict[int, dict[tuple, tuple]]:
    """By run, where its script takes fields."""
    out: dict[int, dict[tuple, tuple]] = defaultdict(dict)
    for e in edits or ():
        if e["item"] == item and e["op"] in ("rename", "move"):
            out[e["seq"]][tuple(json.loads(e["old_path"]))] = tuple(json.loads(e["new_path"]))
    return out


def _plans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scripts of a workspace and kind, and the one from its last schema to the target, compiled for each run."""
    for batch in batches:
        rows = []
        for workspace, kind, runs_, edits, target in zip(*[batch.column(n).to_pylist() for n in ("workspace", "source_kind", "runs", "edits", "target")]):
            plans: dict[int, dict[str, tuple]] = {r["seq"]: {} for r in runs_}
            last = max(plans)
            for item in ("field", "label"):
                goal = te.build([(t["a"], t["b"]) for t in target if t["what"] == "entry" and t["item"] == item])
                name_of = {t["a"]: t["b"] for t in target if t["what"] == "name" and t["item"] == item}
                trees = {r["seq"]: te.build([(e["path"], e["type"]) for e in r["schema"] if e["item"] == item]) for r in runs_}
                final = trees[last].children
                alike = [(item, old, name_of[old]) for old in final if old in name_of]
                script = te.script(trees[last], goal, _price(dict.fromkeys(alike, (1, 1)), item), _candidates(alike, item))[1]
                to_goal = {old: new for op, old, new, *_ in script if op == "rename"}
                steps, types = _steps(edits, item), dict(te.typed(goal))
                for seq, tree in trees.items():
                    moves, casts, ends = {}, {}, {(): ()}
                    later = [steps[k] for k in range(seq + 1, last + 1) if k in steps]
                    for path, node in te.walked(tree):
                        at = path
                        for step in later:
                            at = te.followed(at, step)
                        if at[0] in final:
                            at = te.followed(at, to_goal)
                        else:  # a field that ended before the last run
                            at = (name_of.get(at[0], at[0]), *at[1:])
                        ends[path] = at
                        if at != ends[path[:-1]] + path[-1:]:
                            moves[path] = at
                        if at in types and node.types - {types[at][0]}:
                            casts[path] = types[at]
                    plans[seq][item] = moves, casts
            for seq, found in plans.items():
                (moves, casts), (names, _) = found["field"], found["label"]
                if moves or casts or names:
                    plan = Plan(moves, casts).dump() if moves or casts else None
                    rows.append((workspace, seq, kind, plan, [(a[0], b[0]) for a, b in names.items()]))
        yield _batch(rows, [("workspace", _S), ("seq", _I), ("source_kind", _S), ("plan", _S), ("labels_map", pa.map_(_S, _S))])


def projections(schema: DataFrame, edits: DataFrame, provenance: DataFrame) -> DataFrame:
    """The scripts compiled: for each run and kind that needs one, what to do to reach the target schema of the kind:
    provenance_id, source_kind, plan (of ``json_projection``: renames, moves and casts at any depth) and labels_map (old
    to new name)."""
    edits = materialize(edits, "edits")
    by = ["workspace", "source_kind"]
    steps = edits.filter("op in ('rename', 'move')").groupBy(*by).agg(F.collect_list(F.struct("seq", "op", "item", "old_path", "new_path")).alias("edits"))
    whole = schema.groupBy(*by).agg(F.collect_list(F.struct("seq", "schema")).alias("runs")).join(steps, by, "left")
    whole = whole.join(checked_broadcast(materialize(targets(schema, edits), "targets")), "source_kind")
    found = whole.mapInArrow(_plans, "workspace string, seq int, source_kind string, plan string, labels_map map<string,string>")
    return found.join(checked_broadcast(runs(provenance)), ["workspace", "seq"]).select("provenance_id", "source_kind", "plan", "labels_map")


def _projected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Applies the plan of each row's run and kind to its props."""
    plans: dict[str, Plan] = {}
    for b in batches:
        sizes, missing, keys, values = [0], [], [], []
        for props, plan in zip(b.column("props_json").to_pylist(), b.column("plan").to_pylist()):
            have = None
            if props is not None:
                if plan is None:
                    have = members(props)
                else:
                    if plan not in plans:
                        if len(plans) >= 1000:
                            plans.clear()
                        plans[plan] = Plan.load(plan)
                    have = plans[plan].apply(props)
            if have is not None:
                keys += have
                values += have.values()
            missing.append(have is None)
            sizes.append(len(keys))
        offsets = pa.array([None if m else n for m, n in zip(missing, sizes)] + [sizes[-1]], pa.int32())
        props = pa.MapArray.from_arrays(offsets, pa.array(keys, pa.string()), pa.array(values, pa.string()))
        kept = ["ordinal", "provenance_id", "source_kind", "stable_id", "labels"]
        yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], props], [*kept, "props"])


def consistent_table(entities: DataFrame, provenance: DataFrame) -> DataFrame:
    """Every row of every run in one schema for each source kind, that of ``targets``: ordinal, provenance_id,
    source_kind, stable_id, labels, props (map of field name to the JSON text of its value).

    Fields and labels of all workspaces and runs come under one name, fields inside objects too, and where a value can
    be cast without loss it has the field's most frequent type. A field keeps its own name where a row already has
    another one of the new name; a value that can't be cast stays. Numbers keep their text. Null labels or props stay
    null; props that are no JSON object are null. Rows of a run that provenance doesn't know stay as they are.
    """
    schema = schemas(entities, provenance)
    maps = materialize(projections(schema, edit_scripts(entities, provenance, schema), provenance), "projections")
    rows = entities.select("ordinal", "provenance_id", F.coalesce("source_kind", F.lit("")).alias("source_kind"), "stable_id", "labels", "props_json")
    rows = rows.join(checked_broadcast(maps), ["provenance_id", "source_kind"], "left")
    labels = F.array_distinct(F.transform("labels", lambda x: F.coalesce(F.element_at("labels_map", x), x)))
    rows = rows.select("ordinal", "provenance_id", "source_kind", "stable_id", labels.alias("labels"), "props_json", "plan")
    return rows.mapInArrow(_projected, "ordinal long, provenance_id string, source_kind string, stable_id string, labels array<string>, props map<string,string>")
