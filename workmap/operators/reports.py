"""Texts and exports: notices, work orders, primers, recaps, the map's answers, facts as JSON; and the retention that runs beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most landmarks and rules of a primer, characters of a keep-list and of a work order, tokens of one.
MOST_LANDMARKS, MOST_RULES, KEEP_CHARS, ORDER_CHARS, ORDER_TOKENS = 8, 6, 600, 8000, 900
#: How long positions hold, in milliseconds.
HOLDS = {"read": 600_000, "edit": 1_800_000, "claim": 7_200_000}


def fitted(text: Column, most: int) -> Column:
    """A text cut to so many characters, with three dots where some are gone."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def lines_within(rows: DataFrame, keys: list[str], order: list, line: str, most: int) -> DataFrame:
    """(keys, text): the first lines of each key that fit into `most` characters together, in order; a key's lines are few by their own caps."""
    by = Window.partitionBy(*keys).orderBy(*order)
    so_far = F.sum(F.length(line) + 1).over(by.rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("_n", so_far).withColumn("_k", F.row_number().over(by)).where(F.col("_n") <= most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", line))), lambda x: x[line]), "\n")
    return kept.groupBy(*keys).agg(joined.alias("text"))


# ---------------------------------------------------------------- coordination
def held_longest(positions: DataFrame) -> DataFrame:
    """(session, node, mode, until): of a session's reads, edits and claims of a node the one that holds longest; of equal ones the later."""
    until = F.col("ts") + F.coalesce(*[F.when(F.col("mode") == k, F.lit(v)) for k, v in HOLDS.items()])
    best = positions.withColumn("until", until).groupBy("session", "node").agg(F.max(F.struct("until", "ts", "mode")).alias("b"))
    return best.select("session", "node", "b.mode", "b.until")


def editor_notice(path: Column, holders: Column) -> Column:
    """To the one who edits: who else is at the file."""
    who = F.when(holders == 1, "another session is").otherwise(F.concat(holders.cast("string"), F.lit(" other sessions are")))
    return F.concat(F.lit("Note: "), who, F.lit(" working on "), path, F.lit("."))


def holder_notice(path: Column, via: Column, lines: Column) -> Column:
    """To the one who holds: what was changed and why it matters to them."""
    where = F.when(lines.isNull(), "").otherwise(F.concat(F.lit(" (line "), lines.cast("string"), F.lit(")")))
    why = F.when(via == "same", "which you have open").otherwise("which what you have open depends on")
    return F.concat(F.lit("Another session changed "), path, where, F.lit(", "), why, F.lit("."))


def contract_notice(name: Column, before: Column, after: Column, sites: Column) -> Column:
    """A signature before and after, and the lines that call it."""
    return F.concat(F.lit("The signature of "), name, F.lit(" changed from "), before, F.lit(" to "), after, F.lit("; called at "), F.array_join(F.slice(sites, 1, 5), ", "), F.lit("."))


def handoff_text(edited: Column, open_: Column) -> Column:
    return F.concat(F.lit("Unfinished work: edited "), F.coalesce(edited, F.lit("nothing")), F.lit("; still to look at "), F.coalesce(open_, F.lit("nothing")), F.lit("."))


# ---------------------------------------------------------------- sinks
def replaced_rows(stored: DataFrame, parsed: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """A file's rows after it was parsed anew: a definition that is still there, k-th to k-th of its keys, keeps its id; new ones get none yet."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    old = stored.withColumn("_k", k).select(*keys, "_k", F.col(ident))
    return parsed.withColumn("_k", k).join(old, [*keys, "_k"], "left").select(*keys, "pos", ident)


def facts_json(facts: DataFrame) -> DataFrame:
    """One JSON object for each fact, keys in a fixed order, facts in the order of their ids: equal facts give equal files."""
    return facts.orderBy("fact_id").select(F.to_json(F.struct("fact_id", "claim", "status")).alias("json"))


def rounded_two(n: Column) -> Column:
    """A number to two significant digits."""
    digits = F.pow(F.lit(10), F.greatest(F.length(n.cast("string")) - 2, F.lit(0))).cast("long")
    return (F.round(n / digits) * digits).cast("long")


# ---------------------------------------------------------------- retention
def upkeep(tables: dict[str, tuple[DataFrame, str, Column]], batch: int) -> DataFrame:
    """(step, looked_at, gone, resume): each step looks at the first `batch` rows by key and says how many of them are due and where the next run goes on."""
    steps = []
    for name, (rows, key, due) in tables.items():
        first = rows.orderBy(key).limit(batch)
        steps.append(first.agg(F.count("*").alias("looked_at"), F.count_if(due).alias("gone"), F.max(key).alias("resume")).select(F.lit(name).alias("step"), "looked_at", "gone", F.col("resume").cast("long").alias("resume")))
    return reduce(DataFrame.unionByName, steps)
