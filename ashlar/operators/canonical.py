"""Canonical entities and relationships: duplicates found, merged in order, single rows passed through untouched."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.functions.merge_patch import composed, patched
from ashlar.runtime import materialize

#: Rows of one key are merged in parts of at most so many consecutive ordinals, then the parts.
PART = 65_536


def relationship_signature(relationships: DataFrame) -> DataFrame:
    """With ``signature``: from, type and to joined by NUL, and the outcome where the props hold true or false.

    Rows without both endpoints and a type have a null signature.
    """
    outcome = F.get_json_object("props_json", "$.producer_outcome")
    base = F.concat("from_id", F.lit("\0"), "rel_type", F.lit("\0"), "to_id")  # null if any part is
    tail = F.when(outcome.isin("true", "false"), F.concat(F.lit("\0producer_outcome="), outcome)).otherwise("")
    return relationships.withColumn("signature", F.concat(base, tail))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that several rows bear, with their number ``n``; null keys are none."""
    return rows.na.drop(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_endpoints(relationships: DataFrame, entities: DataFrame, within: list[str] = ["provenance_id"], top: int | None = 20) -> DataFrame:  # noqa: B006
    """References to ids that no entity has: ``within``, stable_id, endpoint (``from``, ``to``), reference_count.

    Counted before the join, so a frequent id is one row in it. ``top`` keeps the most referred ones, as a report.
    """
    known = entities.select(*within, "stable_id").distinct()
    sides = [relationships.select(*within, F.col(f"{s}_id").alias("stable_id"), F.lit(s).alias("endpoint")) for s in ("from", "to")]
    refs = sides[0].unionAll(sides[1]).na.drop(subset=["stable_id"])
    counts = refs.groupBy(*within, "stable_id", "endpoint").agg(F.count(F.lit(1)).alias("reference_count"))
    missing = counts.join(known, [*within, "stable_id"], "left_anti")
    order = [F.desc("reference_count"), "stable_id", "endpoint", *within]
    return missing if top is None else missing.orderBy(*order).limit(top)


def _loads(text: str | None):
    if text is None:
        return {}
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return text


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's first document, and the one patch that its later (all its) rows make."""
    for b in batches:
        firsts, later, everything = [], [], []
        for rows in b.column("rows").to_pylist():
            texts = [r["props_json"] for r in rows]
            firsts.append(texts[0])
            rest: object = {}
            for t in texts[1:]:
                if t is not None:
                    rest = composed(rest, _loads(t))
            later.append(json.dumps(rest))
            everything.append(json.dumps(composed(_loads(texts[0]), rest)))
        kept = [b.column(n) for n in b.schema.names if n != "rows"]
        names = [n for n in b.schema.names if n != "rows"] + ["first", "later", "everything"]
        yield pa.RecordBatch.from_arrays(kept + [pa.array(x, pa.string()) for x in (firsts, later, everything)], names)


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for parts in b.column("parts").to_pylist():
            value = patched(_loads(parts[0]["first"]), json.loads(parts[0]["later"]))
            for p in parts[1:]:
                value = patched(value, json.loads(p["everything"]))
            out.append(json.dumps(value, separators=(",", ":"), ensure_ascii=True))
        kept = [n for n in b.schema.names if n != "parts"]
        yield pa.RecordBatch.from_arrays([b.column(n) for n in kept] + [pa.array(out, pa.string())], kept + ["props_json"])


def merged_props(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and props_json: the documents of each key patched into one another in order of ``ordinal``.

    Done in two steps, parts of consecutive ordinals and then the parts, so that no task gets all rows of a large key.
    A null document changes nothing; the first one's own nulls stay.
    """
    part = F.floor(F.col("ordinal") / PART).alias("part")
    parts = rows.groupBy(*keys, part).agg(F.array_sort(F.collect_list(F.struct("ordinal", "props_json"))).alias("rows"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    parts = parts.mapInArrow(_parts, f"{fields}, part long, first string, later string, everything string")
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "first", "later", "everything"))).alias("parts"))
    return whole.mapInArrow(_whole, f"{fields}, props_json string")


def merge_entities(entities: DataFrame, within: list[str] = ["provenance_id"]) -> DataFrame:  # noqa: B006
    """One row for each id (in each run): ``within``, stable_id, labels, props_json.

    Single rows, which are most, pass through unchanged. Of the others, labels are united in order of ``ordinal``
    without nulls, and props patched in that order. Rows with a null id are left out.
    """
    keys = [*within, "stable_id"]
    rows = entities.select(*keys, "ordinal", "labels", "props_json").na.drop(subset=["stable_id"])
    double = materialize(duplicates(rows, keys).select(*keys), "duplicate-ids")
    single = rows.join(double, keys, "left_anti").select(*keys, "labels", "props_json")
    several = rows.join(double, keys, "left_semi")
    each = several.select(*keys, "ordinal", F.posexplode("labels").alias("at", "label")).filter("label is not null")
    first = each.groupBy(*keys, "label").agg(F.min(F.struct("ordinal", "at")).alias("place"))
    labels = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x.label).alias("labels"))
    merged = merged_props(several, keys).join(labels, keys, "left")
    return single.unionByName(merged.select(*keys, F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), "props_json"))


def merge_relationships(relationships: DataFrame, within: list[str] = ["provenance_id"]) -> DataFrame:  # noqa: B006
    """One row for each signature (in each run): ``within``, signature, from_id, to_id, rel_type, props_json; ends and
    type of the first row. Rows without a signature are left out."""
    keys = [*within, "signature"]
    rows = relationships.select(*keys, "ordinal", "from_id", "to_id", "rel_type", "props_json").na.drop(subset=["signature"])
    double = materialize(duplicates(rows, keys).select(*keys), "duplicate-signatures")
    single = rows.join(double, keys, "left_anti").drop("ordinal")
    several = rows.join(double, keys, "left_semi")
    ends = several.groupBy(*keys).agg(*[F.min_by(c, "ordinal").alias(c) for c in ("from_id", "to_id", "rel_type")])
    return single.unionByName(ends.join(merged_props(several, keys), keys))


def staging_stats(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """name and value of the four counts of a staging: raw and canonical rows of both tables."""
    count = F.count(F.lit(1)).alias("value")
    parts = []
    for name, df, key in (("Entities", entities, "stable_id"), ("Relationships", relationships, "signature")):
        parts.append(df.agg(count).select(F.lit(f"raw{name}").alias("name"), "value"))
        distinct = df.na.drop(subset=[key]).select("provenance_id", key).distinct()
        parts.append(distinct.agg(count).select(F.lit(f"canonical{name}").alias("name"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
