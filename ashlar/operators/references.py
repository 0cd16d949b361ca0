"""References to records that do not exist, by a fixpoint: direct orphans first, then what hangs below them."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.functions.ids import key128, normalize_id
from ashlar.operators.hierarchy import CHILD_TO_PARENT, PARENT_TO_CHILD
from ashlar.operators.skew import Salted, lookup_join, salted_left_join
from ashlar.runtime import WorkTable, materialize, together
from ashlar.sources.tables import runs

ENDPOINTS = ("from_id", "to_id")
_REFERENCE = ["ordinal", "provenance_id", "rel_type", "endpoint", "state", "level"]


def _placed(df: DataFrame, known: DataFrame, spread: str) -> DataFrame:
    """With workspace and seq; a run that provenance doesn't know is the only one of a workspace of its own."""
    own = F.concat(F.lit("?"), F.coalesce("provenance_id", F.lit("")))
    return (
        lookup_join(df, known, ["provenance_id"], spread)
        .withColumn("workspace", F.coalesce("workspace", own))
        .withColumn("seq", F.coalesce("seq", F.lit(1)))
    )


def _child_end() -> Column:
    """The column that names the child of a parent link; null for other types."""
    return F.when(F.col("rel_type").isin(*CHILD_TO_PARENT), "from_id").when(F.col("rel_type").isin(*PARENT_TO_CHILD), "to_id")


def _direct(relationships: DataFrame, entities: DataFrame, provenance: DataFrame) -> DataFrame:
    """The first round: ``_REFERENCE`` of each endpoint that is no entity of its row's run, and the other end's key.

    Both sides are shuffled once, by a 16-byte key of workspace and id; the references of a heavy key are salted, so
    that no task gets them all. Heavy keys are looked for among the ids as written first, which costs no normalisation.
    """
    known = runs(provenance)
    key = lambda c: key128("workspace", normalize_id(c))
    present = (
        _placed(entities.select("provenance_id", "stable_id").filter(F.col("stable_id").isNotNull()), known, "stable_id")
        .select(*key("stable_id"), "seq")
        .groupBy("k1", "k2")
        .agg(F.collect_set("seq").alias("at"))
    )
    rows = _placed(relationships.select("ordinal", "provenance_id", "rel_type", *ENDPOINTS), known, "ordinal")
    refs = None
    for end, other in (ENDPOINTS, ENDPOINTS[::-1]):
        # the child of the link, where the parent is what is referred to
        child = [F.when(_child_end() == other, k).alias(n) for k, n in zip(key128("provenance_id", normalize_id(other)), ("c1", "c2"))]
        side = rows.filter(F.col(end).isNotNull()).select("ordinal", "provenance_id", "rel_type", F.lit(end).alias("endpoint"), "seq", F.col(end).alias("written"), *key(end), *child)
        refs = side if refs is None else refs.union(side)
    at: Column = F.col("at")
    state = F.when(F.array_min(at) < F.col("seq"), "deleted").when(F.array_max(at) > F.col("seq"), "late").otherwise("missing")
    orphans = salted_left_join(refs, present, ["k1", "k2"], "ordinal", by="written").filter(at.isNull() | ~F.array_contains(at, F.col("seq")))
    return orphans.withColumn("state", state).withColumn("level", F.lit(1)).select(*_REFERENCE, "c1", "c2")


class Orphans:
    """The fixpoint over the references of all runs.

    ``direct`` (level 1) and ``references`` (all levels): ordinal, provenance_id, rel_type, endpoint, state and level. Level 1 are the direct orphans: the
    endpoint is no entity of its row's run, and ``state`` is ``deleted`` if an earlier run of the workspace has the
    entity, else ``late`` if a later one has, else ``missing``. Level n + 1 are parent links whose parent is a record
    orphaned at level n; their state is ``inherited``. A parent link makes its child a record orphaned at its level
    (the least one counts), if the child is an entity of the run; ``records`` gives these.

    Each round joins the newest orphaned records with the links by a semi-join and takes those seen before out by an
    anti-join, so cycles end; it goes on until a round brings nothing new, however deep that is. The links of a heavy
    parent are salted, so no task gets them all.

    Ids are compared as ``normalize_id`` spells them. Null endpoints refer to nothing; an empty id is an id. Repeated
    rows come out once each. Entities with a null id are none. Empty entities leave every reference missing.
    """

    def __init__(self, relationships: DataFrame, entities: DataFrame, provenance: DataFrame):
        self.relationships, self.entities = relationships, entities
        self.direct = WorkTable(_direct(relationships, entities, provenance), "orphans").df
        self.named = entities.filter(F.col("stable_id").isNotNull()).select(*key128("provenance_id", normalize_id("stable_id")))
        child = self.direct.filter("c1 is not null").select(F.col("c1").alias("k1"), F.col("c2").alias("k2")).distinct()
        newest = WorkTable(child.join(self.named, ["k1", "k2"], "left_semi").withColumn("level", F.lit(1)), "orphaned")
        records = [newest]
        if not newest.df.isEmpty():
            inner = self._inner()
            for level in count(2):
                reached = inner.semi(_as_parents(newest.df)).select("k1", "k2").distinct()
                reached = reached.join(together(records).select("k1", "k2"), ["k1", "k2"], "left_anti")
                newest = WorkTable(reached.withColumn("level", F.lit(level)), "orphaned")
                if newest.df.isEmpty():
                    break
                records.append(newest)
        #: Keys and levels of the orphaned records, of those that are nobody's parent only the direct ones.
        self.parents = together(records)
        self._below = None

    def _ends(self) -> DataFrame:
        """The parent links: keys of child and parent, and what ``references`` needs."""
        up = _child_end() == "from_id"
        rows = self.relationships.filter(_child_end().isNotNull() & F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
        end = lambda a, b, names: [k.alias(n) for k, n in zip(key128("provenance_id", F.when(up, normalize_id(a)).otherwise(normalize_id(b))), names)]
        return rows.select(
            "ordinal", "provenance_id", "rel_type", F.when(up, "to_id").otherwise("from_id").alias("endpoint"),
            *end("from_id", "to_id", ("k1", "k2")), *end("to_id", "from_id", ("p1", "p2")),
        )

    def _inner(self) -> Salted:
        """The distinct links whose child is an entity and a parent itself: most children are nobody's parent and take
        their level from their parents in the end, so only these are gone over in each round."""
        ends = materialize(self._ends().select("k1", "k2", "p1", "p2").distinct(), "links")
        parents = ends.select(F.col("p1").alias("k1"), F.col("p2").alias("k2")).distinct()
        return Salted(ends.join(parents, ["k1", "k2"], "left_semi").join(self.named, ["k1", "k2"], "left_semi"), ["p1", "p2"], "k1")

    @property
    def below(self) -> DataFrame:
        """The parent links of inherited orphans, with the keys of their children: one more join over all links."""
        if self._below is None:
            links = Salted(self._ends().join(self.named, ["k1", "k2"], "left_semi"), ["p1", "p2"], "ordinal")
            found = links.inner(_as_parents(self.parents, "level")).withColumn("level", F.col("level") + 1)
            self._below = materialize(found.withColumn("state", F.lit("inherited")), "inherited")
        return self._below

    @property
    def references(self) -> DataFrame:
        return self.direct.select(*_REFERENCE).unionByName(self.below.select(*_REFERENCE))

    def records(self) -> DataFrame:
        """The entities that hang below a record that does not exist: provenance_id, stable_id, kind (``direct``: a
        parent is no entity of the run; ``inherited``: a parent is itself orphaned) and level (1 for direct ones)."""
        keys = self.parents.unionByName(self.below.select("k1", "k2", "level")).groupBy("k1", "k2").agg(F.min("level").alias("level"))
        named = self.entities.filter(F.col("stable_id").isNotNull()).select("provenance_id", normalize_id("stable_id").alias("stable_id"))
        named = named.withColumns(dict(zip(("k1", "k2"), key128("provenance_id", "stable_id")))).join(keys, ["k1", "k2"])
        kind = F.when(F.col("level") == 1, "direct").otherwise("inherited")
        return named.select("provenance_id", "stable_id", kind.alias("kind"), "level").distinct()

    def report(self) -> DataFrame:
        """Counts by run: references by rel_type, endpoint and state (kind ``reference``), and orphaned records by kind."""
        refs = self.direct.groupBy("provenance_id", "rel_type", "endpoint", "state")
        refs = refs.agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("reference"))
        below = self.records().groupBy("provenance_id", "kind").agg(F.count(F.lit(1)).alias("n"))
        return refs.unionByName(below, allowMissingColumns=True)


def _as_parents(keys: DataFrame, *more: str) -> DataFrame:
    return keys.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), *more)
