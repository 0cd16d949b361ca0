"""Per-key results over keys of very uneven size: salted two-stage aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.functions.ids import key128
from ashlar.runtime import checked_broadcast, materialize

#: A key is heavy from this share of all rows on, so at most its inverse are heavy: the size bound of their broadcast.
HEAVY_SHARE = 1 / 1000
#: Rows of a heavy key that share a salt, about.
ROWS_PER_SALT = 100_000
MOST_SALTS = 4096
CELLS = 65_536


def heavy_keys(rows: DataFrame, keys: list[str], share: float = HEAVY_SHARE, rows_per_salt: int = ROWS_PER_SALT, by: str | None = None) -> DataFrame:
    """The keys that hold at least ``share`` of the rows, with their number of salts; at most ``1 / share`` rows.

    Exact counts, in two passes: rows by ``CELLS`` hash cells first, which shuffles next to nothing; a heavy key lies in
    a heavy cell, and only keys of such cells, of which there are few too, are counted themselves. Partial counts per
    task come before the shuffle, so no task gets a heavy key's rows.

    ``by``: a column to take the cells from where the keys are dear to compute; a key whose rows have several values of
    it (spellings) is sure to be found if it holds the share with one of them.
    """
    cell = F.pmod(F.xxhash64(*([by] if by else keys)), F.lit(CELLS))
    cells = materialize(rows.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("n")), "cells")
    least = max(2, int((cells.agg(F.sum("n")).first()[0] or 0) * share))
    heavy = [r["_cell"] for r in cells.filter(F.col("n") >= least).select("_cell").collect()]  # 1 / share at most
    salts = F.least(F.lit(MOST_SALTS), F.greatest(F.lit(2), F.ceil(F.col("n") / rows_per_salt))).cast("int")
    # literals, so that the filter goes below whatever computes the keys
    inside = rows.filter(cell.isin(heavy))
    return inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(*keys, salts.alias("salts"))


def salted_summary(
    rows: DataFrame,
    keys: list[str],
    neighbour: str,
    ordinal: str,
    results: tuple[str, ...] = ("row_count", "distinct_neighbours", "latest"),
    carry: tuple[str, ...] = (),
    share: float = HEAVY_SHARE,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """For every combination of ``keys``: row_count, distinct_neighbours and latest (a struct of ``ordinal`` and the
    ``carry`` columns of the row with the greatest ordinal), as far as named in ``results``.

    Rows of heavy keys get a salt, partial results are made per key and salt, then merged by key. The salt is drawn
    from the neighbour's hash instead of at random: partial distinct counts of the salts then add up, and a task that
    runs again draws the same salts. Light keys have salt 0, so nothing else is split.

    Rows with a null in any key column have no key and are left out; a null neighbour counts as a row but as no
    neighbour; a null ordinal is before all others. Repeated rows all count. Of equal ordinals the greatest carried
    values win.
    """
    rows = rows.select(*dict.fromkeys([*keys, neighbour, ordinal, *carry])).na.drop(subset=keys)
    heavy = heavy_keys(rows.select(*keys), keys, share, rows_per_salt)
    salt = F.coalesce(F.pmod(F.xxhash64(F.col(neighbour)), F.col("salts")).cast("int"), F.lit(0))
    salted = rows.join(F.broadcast(heavy), keys, "left").withColumn("salt", salt)
    partial: dict[str, Column] = {"row_count": F.count(F.lit(1)), "latest": F.max(F.struct(ordinal, *carry))}
    final: dict[str, Column] = {"row_count": F.sum("row_count"), "latest": F.max("latest")}
    plain = [r for r in results if r in partial]
    out = salted.groupBy(*keys, "salt").agg(*[partial[r].alias(r) for r in plain or ["row_count"]])
    out = out.groupBy(*keys).agg(*[final[r].alias(r) for r in plain or ["row_count"]])
    if "distinct_neighbours" in results:
        # pairs of key and neighbour are nearly as many as rows, so they are shuffled as hashes
        n1, n2 = (k.alias(n) for k, n in zip(key128(neighbour), ("n1", "n2")))
        pairs = salted.filter(F.col(neighbour).isNotNull()).select(*key128(*keys), "salt", n1, n2)
        distinct = pairs.groupBy("k1", "k2", "salt").agg(F.count_distinct("n1", "n2").alias("n")).groupBy("k1", "k2").agg(F.sum("n").alias("distinct_neighbours"))
        out = out.withColumns(dict(zip(("k1", "k2"), key128(*keys)))).join(distinct, ["k1", "k2"], "left")
        out = out.withColumn("distinct_neighbours", F.coalesce("distinct_neighbours", F.lit(0)))
    return out.select(*keys, *results)


def salted_left_join(rows: DataFrame, other: DataFrame, keys: list[str], spread: str, share: float = HEAVY_SHARE, rows_per_salt: int = ROWS_PER_SALT, by: str | None = None) -> DataFrame:
    """``rows`` left-joined with ``other`` (unique keys), with the rows of heavy keys spread over salts.

    The salt of a row is drawn from the hash of ``spread``; ``other``'s rows of heavy keys, at most ``1 / share``, come
    once for each of their salts. No row is lost or doubled. Null keys match nothing. ``by``: see ``heavy_keys``; the
    column isn't kept.
    """
    some = rows.select(*keys, *([by] if by else []))
    for k in keys:
        some = some.filter(F.col(k).isNotNull()) if rows.schema[k].nullable else some
    heavy = materialize(heavy_keys(some, keys, share, rows_per_salt, by), "heavy-keys")
    rows = rows.drop(by) if by else rows
    salt = F.coalesce(F.pmod(F.xxhash64(F.col(spread)), F.col("salts")).cast("int"), F.lit(0)).alias("salt")
    mine = rows.join(F.broadcast(heavy), keys, "left").select(*rows.columns, salt)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    theirs = other.join(F.broadcast(heavy), keys, "left").select(*other.columns, copies)
    return mine.join(theirs, [*keys, "salt"], "left").drop("salt")


def lookup_join(rows: DataFrame, known: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """``rows`` left-joined with a lookup table of unique keys: broadcast where it is counted to be small, else shuffled,
    with the rows of heavy keys spread over salts drawn from ``spread``. Null keys match nothing."""
    small = checked_broadcast(known)
    return rows.join(small, keys, "left") if small is not known else salted_left_join(rows, known, keys, spread)


class Salted:
    """Rows kept with a salt by their heavy keys, for many semi-joins with small or large sets of keys."""

    def __init__(self, rows: DataFrame, keys: list[str], spread: str, share: float = HEAVY_SHARE, rows_per_salt: int = ROWS_PER_SALT):
        self.keys = keys
        self.rows = materialize(rows, "salted")
        self.heavy = materialize(heavy_keys(self.rows.select(*keys).na.drop(), keys, share, rows_per_salt), "heavy-keys")
        self.salt = F.coalesce(F.pmod(F.xxhash64(F.col(spread)), F.col("salts")).cast("int"), F.lit(0)).alias("salt")

    def _join(self, other: DataFrame, how: str) -> DataFrame:
        small = checked_broadcast(other)
        if small is not other:
            return self.rows.join(small, self.keys, how)
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
        other = other.join(F.broadcast(self.heavy), self.keys, "left").select(*other.columns, copies)
        mine = self.rows.join(F.broadcast(self.heavy), self.keys, "left").select(*self.rows.columns, self.salt)
        return mine.join(other, [*self.keys, "salt"], how).drop("salt")

    def semi(self, wanted: DataFrame) -> DataFrame:
        """The rows whose key is among ``wanted`` (distinct keys). A set counted to be small is broadcast; of a large one
        the heavy keys come once for each of their salts."""
        return self._join(wanted, "left_semi")

    def inner(self, other: DataFrame) -> DataFrame:
        """The rows with the columns of ``other`` (unique keys), where it has their key; joined like ``semi``."""
        return self._join(other, "inner")


def relationship_keys(relationships: DataFrame, results: tuple[str, ...] = ("row_count", "distinct_neighbours", "latest")) -> DataFrame:
    """``salted_summary`` of the ``from_id`` and ``rel_type`` values of each run; ids as written. Neighbours are ``to_id``."""
    both = None
    for field in ("from_id", "rel_type"):
        side = relationships.select("provenance_id", F.lit(field).alias("key_field"), F.col(field).alias("key_value"), "to_id", "ordinal")
        both = side if both is None else both.unionByName(side)
    return salted_summary(both, ["provenance_id", "key_field", "key_value"], "to_id", "ordinal", results, ("to_id",))


def dominant_keys(relationships: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The keys that hold at least their field's share of a run's rows, null keys and repeated rows counting as rows."""
    keys = relationship_keys(relationships, ("row_count",))
    totals = relationships.groupBy("provenance_id").agg(F.count(F.lit(1)).alias("run_rows"))
    share = F.coalesce(*[F.when(F.col("key_field") == f, F.lit(s)) for f, s in shares.items()])
    # compared in whole per mille, so that no rounding moves a key over the border
    reached = F.col("row_count") * 1000 >= F.col("run_rows") * (share * 1000).cast("long")
    return keys.join(checked_broadcast(totals), "provenance_id").filter(reached).select("provenance_id", "key_field", "key_value")
