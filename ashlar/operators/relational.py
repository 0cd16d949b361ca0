"""Relational building blocks over any DataFrame: windows, joins, sets, top-k and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_tier(rows: DataFrame, keys: list[str], tier: str) -> DataFrame:
    """The rows of each key's least tier, all of them; a null tier is never the least."""
    least = rows.groupBy(*keys).agg(F.min(tier).alias("_least"))
    return rows.join(least, keys).filter(F.col(tier) == F.col("_least")).drop("_least")


def runs_of_equal(rows: DataFrame, keys: list[str], order: list, value: str, name: str = "stage") -> DataFrame:
    """With ``name``: the number, from 1, of the row's run of neighbouring equal values in its key's order."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def consecutive_pairs(rows: DataFrame, keys: list[str], order: list, carry: list[str]) -> DataFrame:
    """Each row but a key's first with the ``carry`` columns of the row before it, as ``previous_...``."""
    w = W.partitionBy(*keys).orderBy(*order)
    before = F.lag(F.struct(*carry)).over(w)
    out = rows.withColumn("_before", before).filter("_before is not null")
    return out.select("*", *[F.col(f"_before.{c}").alias(f"previous_{c}") for c in carry]).drop("_before")


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """The ``carry`` columns of each key's greatest row by ``order``; partial maxima are made before the shuffle."""
    last = F.max(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in carry])).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last._{c}").alias(c) for c in carry])


def prior_value(rows: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    """With ``name``: the last non-null ``value`` of the key's rows before this one."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def running_list(rows: DataFrame, keys: list[str], order: list, value: str, name: str) -> DataFrame:
    """With ``name``: the list of the key's non-null values up to this row; grows with the key, so for short sequences."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.collect_list(value).over(w))


def top_per_group(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """Each key's first ``n`` rows, as a report. Spark limits each task's rows of a key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def rank_percentile(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The element at ``floor(n * share)`` (from 0, the last at most) of each key's sorted non-null values: never an
    interpolated one. Counts by value stand for the values, so a long group is not one list."""
    counts = rows.na.drop(subset=[value]).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    all_ = F.sum("_n").over(W.partitionBy(*keys))
    at = F.least(F.floor(all_ * share), all_ - 1)
    ranked = counts.withColumn("_upto", upto).withColumn("_at", at).filter("_upto > _at")
    return ranked.groupBy(*keys).agg(F.min(value).alias(value))


def page(rows: DataFrame, order: list, limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """One page of ordered rows; ``limit`` must lie between 1 and ``most``, ``offset`` at 0 or above."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"a page has 1 to {most} rows from an offset of at least 0")
    return rows.orderBy(*order).offset(offset).limit(limit)


def with_overflow(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows, with ``more``: whether there are others. One row more than shown is read."""
    w = W.orderBy(*order)
    some = rows.orderBy(*order).limit(limit + 1)
    return some.withColumn("_at", F.row_number().over(w)).withColumn("more", F.count(F.lit(1)).over(W.partitionBy()) > limit).filter(F.col("_at") <= limit).drop("_at")


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows, with repeats, of one side only; ``side`` is ``left`` or ``right``."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionAll(right.exceptAll(left).withColumn("side", F.lit("right")))


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with those of ``rows`` whose key it lacks."""
    return target.unionByName(rows.join(target, keys, "left_anti"))


def delete_where(rows: DataFrame, condemned: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without those whose key is among ``condemned``."""
    return rows.join(condemned.select(*keys), keys, "left_anti")


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the one with the greatest ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return latest_by_key(rows, keys, [order], rest).select(*rows.columns)


def unpivot(rows: DataFrame, keep: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """One row for each non-null cell of ``columns``."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in columns])
    return rows.select(*keep, F.inline(pairs)).filter(F.col(value).isNotNull())


def latest_before(rows: DataFrame, events: DataFrame, keys: list[str], at: str, carry: list[str]) -> DataFrame:
    """Each of ``rows`` with the ``carry`` columns of the latest of ``events`` that is before it in its key (an as-of
    join); both are merged in one ordered pass over the key, so nothing is paired. Equal places don't precede."""
    both = events.select(*keys, at, F.lit(1).alias("_side"), F.struct(*carry).alias("_event"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in (*keys, at)])
    mine = rows.select(*keys, at, F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_event"].dataType).alias("_event"), *[c for c in rows.columns if c not in (*keys, at)])
    w = W.partitionBy(*keys).orderBy(at, "_side").rowsBetween(W.unboundedPreceding, -1)
    joined = mine.unionByName(both).withColumn("_last", F.last("_event", ignorenulls=True).over(w)).filter("_side = 0")
    return joined.select(*rows.columns, *[F.col(f"_last.{c}").alias(f"latest_{c}") for c in carry])


def prefix_join(rows: DataFrame, column: str, targets: DataFrame, target: str, separator: str = ":") -> DataFrame:
    """Each row with the least ``target`` that is ``column``'s value followed by ``separator`` and more (null if none).

    The prefixes of the targets are made, so that it is an equi-join.
    """
    parts = F.split(target, separator)
    cuts = F.sequence(F.lit(1), F.size(parts) - 1)
    prefixes = targets.filter(F.size(parts) > 1).select(target, F.explode(F.transform(cuts, lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))).alias(column))
    return rows.join(prefixes.groupBy(column).agg(F.min(target).alias(target)), column, "left")


def changes_between(left: DataFrame, right: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """keys and change (``added``, ``removed``, ``changed``): by key, columns compared null-safely; keys are unique."""
    a = left.select(*keys, F.struct(*compare).alias("_a"))
    b = right.select(*keys, F.struct(*compare).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, keys, "full").select(*keys, change.alias("change")).filter("change is not null")


def co_occurrence(rows: DataFrame, labels: str) -> DataFrame:
    """Pairs of labels (a < b) borne together: a, b, together, of_a, of_b, coverage_a, coverage_b, identical.

    Label lists are short; repeated labels of a row count once. The totals are joined by label.
    """
    sets = rows.select(F.array_sort(F.array_distinct(F.filter(labels, lambda x: x.isNotNull()))).alias("s"))
    totals = sets.select(F.explode("s").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda a, i: F.transform(F.slice(F.col("s"), i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    both = pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("together"))
    of = lambda x: totals.select(F.col("label").alias(x), F.col("n").alias(f"of_{x}"))
    out = both.join(of("a"), "a").join(of("b"), "b")
    share = lambda x: F.col("together") / F.col(f"of_{x}")
    same = (F.col("together") == F.col("of_a")) & (F.col("together") == F.col("of_b"))
    return out.select("a", "b", "together", "of_a", "of_b", share("a").alias("coverage_a"), share("b").alias("coverage_b"), same.alias("identical"))


def jaccard_pairs(items: DataFrame, key: str, item: str, least: float) -> DataFrame:
    """Pairs of keys (a < b) whose item sets overlap by ``least`` or more: a, b, jaccard.

    Prefix filtering: items are ordered from rare to frequent, and only keys that share one of the first
    ``n - ceil(least * n) + 1`` items of each are compared; so frequent items join nothing.
    """
    items = items.select(key, item).na.drop().distinct()
    counts = items.groupBy(item).agg(F.count(F.lit(1)).alias("_f"))
    ranked = items.join(counts, item)
    w = W.partitionBy(key).orderBy("_f", item)
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    ranked = ranked.withColumn("_at", F.row_number().over(w)).withColumn("_n", n)
    prefix = ranked.filter(F.col("_at") <= F.col("_n") - F.ceil(F.col("_n") * least - 1e-9) + 1)
    side = lambda x: prefix.select(F.col(item), F.col(key).alias(x), F.col("_n").alias(f"_n{x}"))
    fits = (F.col("_na") >= F.col("_nb") * least - 1e-9) & (F.col("_nb") >= F.col("_na") * least - 1e-9)
    candidates = side("a").join(side("b"), item).filter((F.col("a") < F.col("b")) & fits).select("a", "b", "_na", "_nb").distinct()
    of = lambda x: items.select(F.col(key).alias(x), F.col(item))
    shared = candidates.join(of("a"), "a").join(of("b"), ["b", item]).groupBy("a", "b", "_na", "_nb").agg(F.count(F.lit(1)).alias("_k"))
    score = F.col("_k") / (F.col("_na") + F.col("_nb") - F.col("_k"))
    return shared.select("a", "b", score.alias("jaccard")).filter(F.col("jaccard") >= least)


def nonnull_first(column: str, order: str) -> Column:
    """Aggregate: the first non-null value by ``order``."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order)))


def nonnull_last(column: str, order: str) -> Column:
    """Aggregate: the last non-null value by ``order``."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order)))
