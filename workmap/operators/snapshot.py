"""Statements over keyed snapshots: look-ups, keyset pages, conditional updates, upserts, retention.

A relation is a DataFrame; a statement that changes it gives the snapshot after the change. Lists of keys are DataFrames,
so a statement of one key and one of a billion have the same plan: a filter that reaches the scan, or one semi, anti or
left join on the key. Nothing is collected.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workmap.operators.cochange import numbered


def point(rows: DataFrame, **keys: Any) -> DataFrame:
    """Rows with these key values; a null key matches nothing."""
    return rows.where(reduce(Column.__and__, [F.col(k) == v for k, v in keys.items()]))


def keyed(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is in a list of keys, each once however often the list has it."""
    return rows.join(keys, keys.columns, "left_semi")


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """A delete by a list of keys."""
    return rows.join(keys, keys.columns, "left_anti")


def kept(rows: DataFrame, gone: Column) -> DataFrame:
    """A delete by a condition; rows for which it is null stay."""
    return rows.where(~F.coalesce(gone, F.lit(False)))


def page(rows: DataFrame, keys: list[str], after: tuple, n: int) -> DataFrame:
    """The first n rows whose key tuple comes after another: one range on the first key reaches the scan, the rest refines it."""
    later = F.lit(False)
    for k in range(len(keys) - 1, -1, -1):
        later = (F.col(keys[k]) > after[k]) | ((F.col(keys[k]) == after[k]) & later)
    return rows.where((F.col(keys[0]) >= after[0]) & later).orderBy(*keys).limit(n)


def newest(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The last n rows in the order of `by`: a bounded heap in each task."""
    return rows.orderBy(*[F.desc(c) for c in by]).limit(n)


def changed(rows: DataFrame, where: Column, **values: Any) -> DataFrame:
    """An update where a condition holds (null counts as no)."""
    hit = F.coalesce(where, F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def updated(rows: DataFrame, given: DataFrame, keys: list[str], only: Column | None = None) -> DataFrame:
    """An update by key: given's other columns replace the stored ones where `only` holds."""
    values = [c for c in given.columns if c not in keys]
    marked = given.withColumnsRenamed({c: f"_{c}" for c in values}).withColumn("_hit", F.lit(True))
    joined = rows.join(marked, keys, "left")
    hit = F.coalesce(F.col("_hit") if only is None else F.col("_hit") & only, F.lit(False))
    return joined.withColumns({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in values}).select(*rows.columns)


def replaced(rows: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """An upsert of whole rows: those given replace the stored ones with their keys."""
    return without(rows, given.select(*keys)).unionByName(given)


def inserted(rows: DataFrame, given: DataFrame) -> DataFrame:
    """A plain insert; `is_new` tells the given rows from those that were there, whatever their keys are."""
    return rows.withColumn("is_new", F.lit(False)).unionByName(given.withColumn("is_new", F.lit(True)))


def once(rows: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """An insert of what isn't there yet."""
    return rows.unionByName(without(given.dropDuplicates(keys), rows.select(*keys)))


def summed(rows: DataFrame, given: DataFrame, keys: list[str], sums: list[str], greatest: tuple[str, ...] = ()) -> DataFrame:
    """An additive upsert."""
    return rows.unionByName(given).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in greatest])


def appended(rows: DataFrame, given: DataFrame, number: str, bucket: Column, order: list) -> DataFrame:
    """Rows given, numbered on from the greatest number stored."""
    last = rows.agg(F.coalesce(F.max(number), F.lit(0)).alias("_last"))
    return numbered(given, bucket, order, "_n").crossJoin(F.broadcast(last)).withColumn(number, F.col("_n") + F.col("_last")).drop("_n", "_last")


def guarded(rows: DataFrame, nodes: DataFrame, *ends: str) -> DataFrame:
    """Rows given whose ends all exist."""
    return reduce(lambda df, end: df.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi"), ends, rows)


def over_cap(rows: DataFrame, key: str, order: list[Column], cap: int) -> DataFrame:
    """A cap on a table: the first `cap` rows in the order stay. The cap is a configured number, so the kept rows are bounded."""
    return keyed(rows, rows.orderBy(*order, key).limit(cap).select(key))


def as_of(rows: DataFrame, states: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """rows with `value` of the key's latest state that began at or before them: one union and one window over each key, no range join."""
    from pyspark.sql import Window

    a = rows.withColumn("_row", F.lit(1)).withColumn("_at", F.col(at)).withColumn(value, F.lit(None).cast(dict(states.dtypes)[value]))
    b = states.select(key, F.col(since).alias("_at"), value, F.lit(0).alias("_row"))
    by = Window.partitionBy(key).orderBy("_at", "_row", value).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last(value, ignorenulls=True).over(by)).where("_row = 1").drop("_row", "_at")
