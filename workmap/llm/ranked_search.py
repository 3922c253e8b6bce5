"""Ranked lexical search by Fagin's threshold algorithm over an index in shards of whole documents.

A shard holds lists of its terms in the order of impact and a forward index of its documents. A query reads its terms' lists in
turn, a stretch at a time; each document met for the first time is looked up in the forward index for all of the
query's terms; reading ends when what any document not yet met can reach falls strictly below the k-th score. A task
carries its k best from shard to shard, so that later shards end sooner. Each task gives k documents a query at most, and
the k best of all are taken by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from workmap.llm.common import Words, blocks, pack, runs, table, utf8, written
from workmap.llm.terms import Terms, gaps

#: Everything but ASCII letters, digits and bytes of other characters separates terms.
GAPS = gaps((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: doc_ids and known: of the shard's documents; names and sizes: its terms, sorted, and the lengths of their lists; starts, terms,
#: impacts: the forward index, a document's postings by term; order: postings by term, then impact, the highest first.
SHARD = "doc_ids binary, known binary, names array<string>, sizes binary, starts binary, terms binary, impacts binary, order binary"
FIELDS = [x.split()[0] for x in SHARD.split(", ")]
#: The greatest impact is below 2**20.
IMPACT_BITS = 20


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with terms, and terms, of a task."""
    documents = terms = 0
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for a, b in blocks(offsets, 4 << 20):
            first = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], GAPS).first
            documents += int((np.diff(first) > 0).sum())
            terms += int(first[-1])
    yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([terms], pa.int64())], names=["documents", "terms"])


def norms(lengths: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """10 + (90 * length * documents) div terms."""
    if len(lengths) and 90 * int(lengths.max()) * documents >= 1 << 63:
        return np.array([10 + 90 * int(n) * documents // terms for n in lengths], np.int64)
    return 10 + 90 * lengths * documents // max(terms, 1)


def _build(documents: int, terms_: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            known = np.asarray(pc.is_valid(batch.column(0)))
            ids = np.asarray(pc.fill_null(batch.column(0), 0), dtype=np.int64)
            for a, b in blocks(offsets, shard_bytes):
                terms = Terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], GAPS)
                row, code, times = terms.by_text()
                m = norms(np.diff(terms.first), documents, terms_)
                impact = 1_000_000_000 * times // (1000 * times + 8 * m[row])
                order = np.argsort((code << IMPACT_BITS) + ((1 << IMPACT_BITS) - 1 - impact), kind="stable")
                values = [pack(ids[a:b]), pack(known[a:b]), terms.names, pack(np.bincount(code, minlength=len(terms.names)).astype(np.uint32)), pack(np.searchsorted(row, np.arange(b - a + 1)).astype(np.uint32)), pack(code.astype(np.uint32)), pack(impact.astype(np.uint32)), pack(order.astype(np.uint32))]
                columns = [pa.array([v], pa.binary()) if isinstance(v, bytes) else pa.ListArray.from_arrays([0, len(v)], v.cast(pa.string())) for v in values]
                yield pa.RecordBatch.from_arrays(columns, names=FIELDS)

    return run


def build_index(docs: DataFrame, shard_bytes: int = 8 << 20) -> tuple[DataFrame, int, int]:
    """(shards, documents with terms, terms) of docs(doc_id, text), each row a document.

    Shards are a written table: any number of searches can read it. A document is never cut; one longer than shard_bytes is a shard.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = source.select("text").mapInArrow(_lengths, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, terms = (int(x or 0) for x in n)
    # a shard is a row of some 10 MB: each is a row group of its own, so that writers and readers hold one, not all of a file
    return written(source.mapInArrow(_build(documents, terms, shard_bytes), SHARD), compression="zstd", **{"parquet.block.row.count.limit": "1"}), documents, terms


def _holding(wanted: list[str]):
    """How many of a task's documents hold each wanted term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(wanted), np.int64)
        asked = pa.array(wanted, pa.string())
        for batch in batches:
            for k in range(batch.num_rows):
                at = np.asarray(pc.fill_null(pc.index_in(asked, value_set=batch.column(0)[k].values), -1))
                size = np.frombuffer(batch.column(1)[k].as_py(), np.uint32)
                n[at >= 0] += size[at[at >= 0]]
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n), pa.int32()), pa.array(n[n > 0], pa.int64())], names=["term", "df"])

    return run


class Shard:
    """One shard, opened for queries whose terms are numbers into `asked`."""

    def __init__(self, row: dict, asked: pa.Array):
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        self.local = np.asarray(pc.fill_null(pc.index_in(asked, value_set=row["names"]), -1))
        self.size = max(len(row["names"]), 1)
        self.lists = np.r_[0, np.cumsum(np.frombuffer(row["sizes"], np.uint32), dtype=np.int64)]
        starts = np.frombuffer(row["starts"], np.uint32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(starts))
        self.key = self.doc * self.size + np.frombuffer(row["terms"], np.uint32)
        self.impact = np.frombuffer(row["impacts"], np.uint32).astype(np.int64)
        self.order = np.frombuffer(row["order"], np.uint32)
        self.met = np.zeros(len(self.ids), bool)

    def looked_up(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of documents, from the forward index; docs and terms in ascending order."""
        wanted = (docs[:, None] * self.size + terms).ravel()
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, self.impact[at], 0).reshape(len(docs), -1) @ weights

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple, k: int, stretch: int = 8) -> tuple:
        """The k best of `best` and of this shard: (scores, known ids?, ids), highest first, then by id."""
        terms, weights = self.local[terms], weights[self.local[terms] >= 0]
        terms = terms[terms >= 0]
        by_term = np.argsort(terms)
        terms, weights = terms[by_term], weights[by_term]
        at, end = self.lists[terms], self.lists[terms + 1]
        next_impact = self.impact[self.order[at]] if len(at) else at
        met: list[np.ndarray] = []
        while len(at):
            # what a document that no list has shown yet can reach
            if len(best[0]) == k and int(weights @ next_impact) < best[0][-1]:
                break
            to = np.minimum(at + stretch, end)
            length = to - at
            place = np.repeat(at - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(length.sum())
            docs = np.unique(self.doc[self.order[place]])
            docs = docs[~self.met[docs]]
            self.met[docs] = True
            met.append(docs)
            if len(docs):
                best = _best(best, self.looked_up(docs, terms, weights), self.known[docs], self.ids[docs], k)
            next_impact = np.where(to > at, self.impact[self.order[np.maximum(to, 1) - 1]], 0)  # of the last that was read
            next_impact[to == end] = 0
            if (to == end).all():
                break
            at = to
            stretch *= 2
        for docs in met:
            self.met[docs] = False
        return best


def _best(best: tuple, scores: np.ndarray, known: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    keep = scores > 0 if len(best[0]) < k else scores >= best[0][-1]
    s, v, i = (np.concatenate([x, y[keep]]) for x, y in zip(best, (scores, known, ids), strict=True))
    order = np.lexsort((i, ~v, -s))[:k]
    return s[order], v[order], i[order]


def _find(asked: list[str], weights: np.ndarray, starts: np.ndarray, numbers: np.ndarray, k: int):
    """The k best of a task's shards for each query; query q has the terms numbers[starts[q]:starts[q + 1]]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        best = [none] * (len(starts) - 1)
        wanted = pa.array(asked, pa.string())
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(c)[r].values if name == "names" else batch.column(c)[r].as_py() for c, name in enumerate(FIELDS)}
                shard = Shard(row, wanted)
                for q in range(len(best)):
                    terms = numbers[starts[q] : starts[q + 1]]
                    best[q] = shard.search(terms, weights[terms], best[q], k)
        lengths = [len(x[0]) for x in best]
        scores, known, ids = (np.concatenate([x[c] for x in best]) if best else none[c] for c in range(3))
        columns = [pa.array(np.repeat(np.arange(len(best)), lengths), pa.int32()), pa.array(ids, pa.int64(), mask=~known), pa.array(scores, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["query", "doc_id", "score"])

    return run


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, term) of a batch's items."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        terms = Terms(data, offsets, GAPS)
        row, code, _ = terms.by_text()
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), terms.names.take(pa.array(code)).cast(pa.string())], names=["item_id", "term"])


def queries_of(items: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """(item_id, terms, block) and the number of blocks: about block_bytes of terms each, an item in one."""
    kind = items.schema["item_id"].dataType.simpleString()
    terms = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(_distinct_terms, f"item_id {kind}, term string")
    asked = written(terms.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")))
    size = asked.agg(F.sum(F.octet_length(F.array_join("terms", " ")))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    return asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n))), n


def search(docs: DataFrame, items: DataFrame, k: int = 10, shard_bytes: int = 8 << 20, block_bytes: int = 1 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring rows of docs(doc_id, text) for each item of items(item_id, text).

    Scores above 0 only, equal ones by ascending doc_id, without id last. Each row of docs is a document, so rows that repeat come
    back as often. Rows of items with one id are one query of all their terms, null ids, too; items without terms have no rows,
    and null or empty texts no terms. Other columns aren't read. Queries go to the shards in blocks of block_bytes of
    terms, one pass over the index each, so the driver and a task hold one block at a time.
    """
    spark: SparkSession = docs.sparkSession
    shards, documents, _ = build_index(docs, shard_bytes)
    asked, n_blocks = queries_of(items, block_bytes)
    found = None
    for block in range(n_blocks):
        own = asked.where(F.col("block") == block).select("item_id", "terms").collect()  # a block's bytes bound it
        names = sorted({t for r in own for t in r["terms"]})
        place = {t: i for i, t in enumerate(names)}
        numbers = np.array([place[t] for r in own for t in r["terms"]], np.int64)
        starts = np.r_[0, np.cumsum([len(r["terms"]) for r in own])].astype(np.int64)
        held = {r["term"]: r["df"] for r in shards.select("names", "sizes").mapInArrow(_holding(names), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held[t] + 1))) if t in held else 0 for t in range(len(names))], np.int64)
        # terms that no document holds, and those that weigh nothing, add nothing
        useful = weights[numbers] > 0
        starts = np.r_[0, np.cumsum(useful)][starts]
        of = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(own)], f"query int, item_id {items.schema['item_id'].dataType.simpleString()}")
        hits = shards.mapInArrow(_find(names, weights, starts, numbers[useful], k), "query int, doc_id long, score long")
        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))).where(F.col("rank") <= k)
        ranked = ranked.join(of, "query").select("item_id", "rank", "doc_id", "score")
        ranked = ranked if n_blocks == 1 else written(ranked)
        found = ranked if found is None else found.unionByName(ranked)
    return found


ORACLE = """
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') w from documents where text is not null),
s as (select count(*) n, sum(len(w)) l from d where len(w) > 0),
m as (select r, doc_id, w, (10 + (90::hugeint * len(w) * n) // l)::bigint m from d cross join s where len(w) > 0),
t as (select r, term, count(*) tf from (select r, unnest(w) term from m) group by all),
f as (select term, floor(1000 * ln((2 * any_value(n) + 2)::double / (2 * count(*) + 1)))::bigint w from t cross join s group by 1),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term from benchmark),
x as (select q.item_id, t.r, sum(f.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * m.m)))::bigint score from q join f using (term) join t using (term) join m on m.r = t.r group by all),
o as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) k from x join m using (r) where score > 0)
select item_id, k::int as rank, doc_id, score from o where k <= 10
"""


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
