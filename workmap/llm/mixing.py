"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are summed to cells of (source, language, topic); each round scales the cells' weights to one
margin after another. A margin's sums are partial aggregates, so a source with a third of all documents
is a few rows before any shuffle. The cells' factors are joined back to the documents, which are drawn by
a fixed hash of their id with calibrated probabilities.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workmap.llm.common import discard, table, written

MARGINS = ("source", "lang", "topic")
#: Most rounds of scaling, and how many are one plan; how little cells move once they have settled; a share of the corpus' weight to draw; the power that flattens the corpus' own margins.
ROUNDS, ROUNDS_A_PLAN, CLOSE, SHARE, FLATTEN = 200, 3, 1e-9, 0.8, 0.8


def topic_of(text: Column) -> Column:
    """A coarse topic from the layout of a text; null and empty texts are 'empty'."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.length(F.trim(t)) == 0, "empty")
        .when(t.contains(" | "), "table")
        .when(t.contains("http") | t.contains("www."), "web")
        .when(t.contains("@"), "contact")
        .when(t.contains("License"), "legal")
        .when(F.length(t) >= 4000, "long prose")
        .otherwise("prose")
    )


def tokens_of(text: Column) -> Column:
    """The usual estimate of tokens: a quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def draw_of(ident: Column) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _targets(cells: DataFrame, name: str, given: Mapping[str, float] | None, flatten: float) -> DataFrame:
    """(name, target): the share each value should have; values not given keep their own shares among what is left."""
    own = cells.groupBy(name).agg(F.sum("weight").alias("w"))
    if given is None:
        raised = own.withColumn("p", F.pow("w", F.lit(flatten)))
    else:
        wanted = F.create_map(*[F.lit(x) for pair in given.items() for x in pair]) if given else F.lit(None).cast("map<string,double>")
        raised = own.withColumn("g", wanted[F.col(name)].cast("double"))
        free = max(0.0, 1.0 - sum(given.values()))
        rest = raised.where("g is null").agg(F.sum("w").alias("rest"))
        raised = raised.crossJoin(F.broadcast(rest)).withColumn("p", F.coalesce("g", F.try_divide("w", "rest") * F.lit(free), F.lit(0.0)))
    total = raised.agg(F.sum("p").alias("total"))  # one row
    return raised.crossJoin(F.broadcast(total)).select(name, F.when(F.col("total") > 0, F.col("p") / F.col("total")).otherwise(0.0).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS, flatten: float = FLATTEN, close: float = CLOSE) -> DataFrame:
    """cells(*MARGINS, weight) with `factor`: what each cell's weight is multiplied by so that its margins come to the targets, and `residual`.

    targets has shares by value for a margin; a margin without has the corpus' own shares raised to the power `flatten`.
    Cells of weight 0 have factor 1. The scaled weights sum to the input's. A round scales the cells to one margin after
    another, all in one plan; ROUNDS_A_PLAN of them are a written table, so no plan grows with the rounds. Rounds end when no
    cell moves by more than `close` of itself in one, or after `rounds`; the residual, one for all cells, is by what part of
    its goal the sum of a margin's value misses it at most, so that targets which contradict each other show.
    """
    targets = targets or {}
    cells = written(cells)
    total = cells.agg(F.sum("weight").alias("all"))  # one row
    goals = {m: written(_targets(cells, m, targets.get(m), flatten).crossJoin(F.broadcast(total)).select(F.col(m).alias(f"_{m}"), (F.col("target") * F.col("all")).alias("goal"))) for m in MARGINS}
    now = cells.withColumn("scaled", F.col("weight").cast("double"))
    for m in MARGINS:  # each cell with its goals: rows of a margin's values meet cells once, before the rounds
        now = now.join(goals[m], F.col(m).eqNullSafe(F.col(f"_{m}"))).withColumnRenamed("goal", f"goal_{m}").drop(f"_{m}")
    now = written(now)
    residual = 0.0
    for done in range(0, rounds, ROUNDS_A_PLAN):
        scaled = now
        for _ in range(min(ROUNDS_A_PLAN, rounds - done)):
            scaled = scaled.withColumn("was", F.col("scaled"))
            for m in MARGINS:
                whole = F.sum("scaled").over(Window.partitionBy(m))
                scaled = scaled.withColumn("scaled", F.when(whole > 0, F.col("scaled") * F.col(f"goal_{m}") / whole).otherwise(F.col("scaled")))
        gaps = [F.coalesce(F.abs(F.try_divide(F.sum("scaled").over(Window.partitionBy(m)), F.col(f"goal_{m}")) - 1), F.lit(0.0)) for m in MARGINS]
        before, now = now, written(scaled.select(*MARGINS, "weight", "scaled", *[f"goal_{m}" for m in MARGINS], F.abs(F.try_divide("scaled", "was") - 1).alias("moved"), F.greatest(*gaps).alias("gap")))
        discard(before)
        moved, residual = (x or 0.0 for x in now.agg(F.max("moved"), F.max("gap")).first())
        if moved <= close:
            break
    for df in (cells, *goals.values()):
        discard(df)
    out = now.select(*MARGINS, "weight", F.when(F.col("weight") > 0, F.col("scaled") / F.col("weight")).otherwise(1.0).alias("factor"), F.lit(float(residual)).alias("residual"))
    out.written_at = now.written_at  # its reader may discard it
    return out


def described(docs: DataFrame) -> DataFrame:
    """docs with cell columns, in which null is a value of its own, and token weights; other columns are kept aside by the caller."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        topic_of(F.col("text")).alias("topic"),
        tokens_of(F.col("text")).alias("n_tokens"),
    )


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, share: float = SHARE, rounds: int = ROUNDS, flatten: float = FLATTEN) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, factor, probability, kept of each row of docs(doc_id, text, lang, source).

    Documents are kept with probability least(1, share * factor), so the expected token weights of what is kept stand to
    each other as the targets, but for cells that the limit of 1 holds down. A draw depends on the id alone: rows with equal
    ids stay or go together, and all null ids do. A null source or language is a value of its own, apart from ''. An empty table
    gives an empty one. Columns with other names, 'topic' and 'weight' included, aren't read. `residual` is that of `rake`.
    """
    d = described(docs)
    cells = d.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("weight"))
    factors = _by_cell(rake(cells, targets, rounds, flatten))
    probability = F.least(F.lit(1.0), F.lit(float(share)) * F.col("factor"))
    return d.join(factors, _same_cell(MARGINS)).select("doc_id", *MARGINS, "n_tokens", "factor", probability.alias("probability"), (draw_of(F.col("doc_id")) < probability).alias("kept"), "residual")


def _by_cell(raked: DataFrame) -> DataFrame:
    """The cells' factors as a written table with names of its own, whose size Spark knows when it joins them."""
    out = written(raked.select(*(F.col(m).alias(f"c_{m}") for m in MARGINS), "factor", "residual"))
    discard(raked)
    return out


def _same_cell(names: tuple[str, ...]) -> Column:
    return reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"c_{m}")) for n, m in zip(names, MARGINS, strict=True)])


def mix_rows(docs: DataFrame, columns: list[str], targets: Mapping[str, Mapping[str, float]] | None = None, share: float = SHARE, rounds: int = ROUNDS, flatten: float = FLATTEN) -> DataFrame:
    """The columns of docs with topic, n_tokens, factor, probability and kept."""
    cells = described(docs).groupBy(*MARGINS).agg(F.sum("n_tokens").alias("weight"))
    factors = _by_cell(rake(cells, targets, rounds, flatten))
    d = docs.select(*columns).withColumns({"_source": F.col("source").cast("string"), "_lang": F.col("lang").cast("string"), "_topic": topic_of(F.col("text")), "n_tokens": tokens_of(F.col("text"))})
    probability = F.least(F.lit(1.0), F.lit(float(share)) * F.col("factor"))
    joined = d.join(factors, _same_cell(("_source", "_lang", "_topic")))
    return joined.select(*columns, F.col("_topic").alias("topic"), "n_tokens", "factor", probability.alias("probability"), (draw_of(F.col("doc_id")) < probability).alias("kept"))


def _oracle(rounds: int, share: float = SHARE, flatten: float = FLATTEN) -> str:
    steps = []
    now = "c0"
    k = 0
    for _ in range(rounds):
        for m in MARGINS:
            k += 1
            steps.append(f"c{k} as (select {now}.* replace ({now}.scaled * case when s.s > 0 then g.target * (select sum(weight) from c0) / s.s else 1 end as scaled) from {now} join (select {m}, sum(scaled) s from {now} group by 1) s on s.{m} is not distinct from {now}.{m} join t_{m} g on g.{m} is not distinct from {now}.{m})")
            now = f"c{k}"
    goals = ", ".join(f"t_{m} as (select {m}, pow(sum(weight), {flatten}) / sum(pow(sum(weight), {flatten})) over () target from c0 group by 1)" for m in MARGINS)
    return f"""
with d as (select doc_id, source, lang,
  case when length(trim(coalesce(text, ''))) = 0 then 'empty' when contains(text, ' | ') then 'table' when contains(text, 'http') or contains(text, 'www.') then 'web'
    when contains(text, '@') then 'contact' when contains(text, 'License') then 'legal' when length(text) >= 4000 then 'long prose' else 'prose' end topic,
  ceil(strlen(coalesce(text, '')) / 4)::bigint n_tokens,
  ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 8))::bigint / 4294967296.0 u from documents),
c0 as materialized (select source, lang, topic, sum(n_tokens)::double weight, sum(n_tokens)::double scaled from d group by 1, 2, 3),
{goals},
{', '.join(s.replace(' as (', ' as materialized (', 1) for s in steps)},
f as (select source, lang, topic, case when weight > 0 then scaled / weight else 1 end factor from {now})
select doc_id, d.source, d.lang, d.topic, n_tokens, round(factor, 6) factor, round(least(1, {share} * factor), 6) probability, u < least(1, {share} * factor) kept
from d join f on f.source is not distinct from d.source and f.lang is not distinct from d.lang and f.topic = d.topic
"""


#: So many rounds that factors have settled to more places than are compared.
ORACLE = _oracle(20)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).withColumns({"factor": F.round("factor", 6), "probability": F.round("probability", 6)}).drop("residual")
