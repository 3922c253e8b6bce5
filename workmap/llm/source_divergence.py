"""Audit of how sources diverge inside a language: count columns are de-duplicated before pairs of sources are evaluated.

Terms are counted by Spark for each (language, term, source); a term's counts by source are its sparse vector. Terms with one
vector are one row with a multiplicity, so every pair of sources is evaluated once for each distinct vector. Terms
themselves come back only for the vectors that can be among the highest of a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workmap.llm.common import blocks, runs, table, utf8, written
from workmap.llm.terms import Terms, gaps

#: Everything but ASCII letters and bytes of other characters separates terms.
GAPS = gaps((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
COUNTED = "lang string, source string, term string, n long, docs long"
SCALE = 1_000_000_000


def _count(block_bytes: int):
    """Counts of a block: times and documents of each (lang, source, term), once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
            group = np.asarray(lang.indices, dtype=np.int64) * len(source.dictionary) + np.asarray(source.indices, dtype=np.int64)
            data, offsets = utf8(batch.column(2))
            for a, b in blocks(offsets, block_bytes):
                terms = Terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], GAPS)
                row, code, times = terms.by_text()
                key = group[a:b][row] * max(len(terms.names), 1) + code
                order = np.argsort(key, kind="stable")
                key, times = key[order], times[order]
                at = runs(key)
                key = key[at[:-1]]
                g, code = key // max(len(terms.names), 1), key % max(len(terms.names), 1)
                n = np.add.reduceat(times, at[:-1]) if len(key) else times
                columns = [lang.dictionary.take(pa.array(g // len(source.dictionary))), source.dictionary.take(pa.array(g % len(source.dictionary))), terms.names.take(pa.array(code)).cast(pa.string()), pa.array(n, pa.int64()), pa.array(np.diff(at), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    return run


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exactly: three steps of a thousand each, so that nothing passes 64 bits."""
    out, rest = np.divmod(counts + 1, totals)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + digit
    return out + 1


def _evaluate(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Every ordered pair of a language's sources over each distinct vector, times its multiplicity; a task's sums leave once."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        code = np.asarray(langs.indices)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = batch.filter(pa.array(code == k))
            totals = np.asarray(own.column(1)[0].values, dtype=np.int64)
            size = len(totals)
            into = sums.setdefault(lang, np.zeros((size, size), np.int64))
            for at in range(0, own.num_rows, max(1, most // size)):
                part = own.slice(at, max(1, most // size))
                vec = part.column(2)
                entries = vec.flatten()
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(vec).to_numpy(zero_copy_only=False))
                counts = np.zeros((part.num_rows, size), np.int64)
                counts[row, np.asarray(entries.field("sid"))] = np.asarray(entries.field("n"))
                p = shares(counts, totals)
                m = np.asarray(part.column(3), dtype=np.int64)
                for s in range(size):
                    gap = p[:, s : s + 1] - p
                    into[s] += m @ (gap * gap // p)
    for lang, into in sums.items():
        s, t = (x.ravel() for x in np.indices(into.shape))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(s), pa.string()), pa.array(s, pa.int32()), pa.array(t, pa.int32()), pa.array(into.ravel(), pa.int64())], names=["lang", "sid", "tid", "value"])


def _share(count: Column, total: Column) -> Column:
    """As `shares`, as a column: decimals hold the product."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + 1), total.cast("decimal(20,0)"))


def audit(docs: DataFrame, top: int = 200, least_docs: int = 3, block_bytes: int = 8 << 20) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) of docs(lang, source, text).

    Part `pair`: each other source of the language, by the divergence from it over all kept terms; part `term`: the `top` terms
    whose share in the source is over that in the language. A language keeps the terms in at least `least_docs` of its rows;
    each row is a document, so rows that repeat count again. Null lang, source and text are ''. A group without
    terms has counts of 0; a language of one source has no pairs; without kept terms pairs are 0. Ties go by the item's
    bytes. A table without rows gives none; other columns aren't read. A vector is as long as the language's sources that have
    the term, and a task's sums are as many as the language's pairs, which are rows of the result.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    by_lang = Window.partitionBy("lang").orderBy("source")
    groups = written(rows.groupBy("lang", "source").agg(F.count("*").alias("documents")).select("lang", "source", (F.row_number().over(by_lang) - 1).alias("sid")))

    counts = rows.mapInArrow(_count(block_bytes), COUNTED).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = counts.join(groups, ["lang", "source"]).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("sid", "n"))).alias("vec"))
    kept = written(vectors.where(F.col("docs") >= least_docs).select("lang", "term", "vec"))
    distinct = written(kept.groupBy("lang", "vec").agg(F.count("*").alias("m")))

    # what each language's shares are divided by, as an array in the order of sid
    sums = distinct.select("lang", "m", F.explode("vec").alias("e")).groupBy("lang", F.col("e.sid").alias("sid")).agg(F.sum(F.col("e.n") * F.col("m")).alias("n"))
    sizes = distinct.groupBy("lang").agg(F.sum("m").alias("v"))
    by_sid = F.sort_array(F.collect_list(F.struct("sid", F.coalesce("n", F.lit(0)).alias("n"))))
    langs = groups.join(sums, ["lang", "sid"], "left").groupBy("lang").agg(by_sid.alias("by_sid")).join(sizes, "lang")
    totals = F.transform("by_sid", lambda x: x["n"] + F.col("v"))
    whole = F.aggregate("by_sid", F.col("v"), lambda a, x: a + x["n"])
    langs = written(langs.select("lang", totals.alias("totals"), whole.alias("whole")))

    given = distinct.join(langs, "lang")
    found = given.select("lang", "totals", "vec", "m").mapInArrow(_evaluate, "lang string, sid int, tid int, value long").groupBy("lang", "sid", "tid").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("sid").alias("tid"))
    pairs = groups.join(other, "lang").where("sid <> tid").join(found, ["lang", "sid", "tid"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    # once for each distinct vector and source that has it; then the terms of the vectors that can be among the highest
    q = _share(F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.col("whole"))
    each = given.withColumn("q", q).select("lang", "vec", "q", "totals", F.explode("vec").alias("e"))
    each = each.select("lang", "vec", "q", F.col("e.sid").alias("sid"), _share(F.col("e.n"), F.col("totals")[F.col("e.sid")]).alias("p")).where("p > q")
    each = each.select("lang", "vec", "sid", F.expr("(p - q) * (p - q) div q").alias("value"))
    best = each.withColumn("r", F.rank().over(Window.partitionBy("lang", "sid").orderBy(F.col("value").desc()))).where(F.col("r") <= top)
    terms = kept.join(written(best.drop("r")), ["lang", "vec"]).select("lang", "sid", F.col("term").alias("item"), "value")
    terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "sid").orderBy(F.col("value").desc(), "item"))).where(F.col("rank") <= top)
    terms = terms.join(groups, ["lang", "sid"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


ORACLE = """
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') w from documents),
g as (select distinct lang, source from d),
t as (select r, lang, source, unnest(w) term from d),
k as (select lang, term from t group by all having count(distinct r) >= 3),
c as (select lang, source, term, count(*) n from t join k using (lang, term) group by all),
v as (select lang, count(*) v from k group by 1),
n as (select g.lang, g.source, coalesce(sum(c.n), 0) n from g left join c using (lang, source) group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)::hugeint) // (n.n + v.v)::hugeint p
  from g join k using (lang) join n on n.lang = g.lang and n.source = g.source join v on v.lang = g.lang
  left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (select p.lang, term, 1 + (1000000000::hugeint * (sum(p.n) + 1)::hugeint) // (any_value(l.n) + any_value(v.v))::hugeint q
  from p join (select lang, sum(n) n from n group by 1) l using (lang) join v using (lang) group by all),
pairs as (select a.lang, a.source, b.source item, coalesce(sum(x.f), 0) f from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (select a.lang, a.source s, b.source t, sum((a.p - b.p) * (a.p - b.p) // b.p) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) x
  on x.lang = a.lang and x.s = a.source and x.t = b.source group by all),
terms as (select p.lang, p.source, p.term item, (p - q) * (p - q) // q f from p join q using (lang, term) where n > 0 and p > q)
select lang, source, 'pair' part, item, f::bigint as value, (row_number() over (partition by lang, source order by f desc, item))::int as rank from pairs
union all
select lang, source, 'term', item, f::bigint, r::int from (select *, row_number() over (partition by lang, source order by f desc, item) r from terms) where r <= 200
"""


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
