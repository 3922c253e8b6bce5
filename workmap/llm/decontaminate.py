"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a bounded block of documents. Its words become symbols of the benchmark's vocabulary;
runs of such words, long enough to hold a test phrase, are its text (a word that no test item has
ends a run, so no occurrence is lost). The Burrows-Wheeler transform of that text sits in a wavelet
matrix; all phrases are searched backward at once through its ranks, and occurrences are located by
walking to sampled suffix positions. Documents are only mapped, never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workmap.llm.common import blocks, discard, table, utf8, written

#: Bytes that end a word: ASCII other than digits and letters.
_GAPS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_TABLE = bytes(32 if b in _GAPS else b + 32 if 65 <= b <= 90 else b for b in range(256))

SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("words", T.IntegerType())]))
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", SPANS),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)

#: Between passes, rows keep their text.
CARRIED = T.StructType([SCHEMA["doc_id"], T.StructField("text", T.StringType()), SCHEMA["spans"], SCHEMA["items"]])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class FMIndex:
    """Counts and locates symbol sequences in a text of symbols 1..sigma; 0 separates its runs and is never searched."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 16):
        n = len(text)
        self.n, self.sample = n, sample
        order = self._suffixes(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        before = np.where(order > 0, text[order - 1], 0)
        # positions that a walk can stop at: every sample-th one, and those after a separator
        stop = (order % sample == 0) | (before == 0)
        self.stops = np.concatenate([[0], np.cumsum(stop)])
        self.is_stop, self.kept = stop, order[stop]
        self._wavelet(before, max(1, int(sigma).bit_length()))

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling; separators differ from each other by their places, so no comparison crosses one. Later rounds sort what is still tied."""
        n = len(text)
        rank = text.astype(np.int64)
        gaps = np.flatnonzero(text == 0)
        rank[text > 0] += len(gaps)
        rank[gaps] = np.arange(len(gaps))
        order = np.argsort(rank, kind="stable")
        r = rank[order]
        begin = np.r_[True, r[1:] != r[:-1]]
        start = np.flatnonzero(begin)
        place = np.empty(n, np.int64)
        place[order] = np.repeat(start, np.diff(np.r_[start, n]))
        h = 1
        while True:
            size = np.diff(np.r_[start, n])
            tied = np.repeat(size > 1, size)
            at = np.flatnonzero(tied)
            if not len(at):
                return order
            suffix = order[at]
            key = place[np.minimum(suffix + h, n - 1)]
            again = np.lexsort((key, place[suffix]))
            suffix, key = suffix[again], key[again]
            own = place[suffix]
            order[at] = suffix
            cut = np.r_[True, (own[1:] != own[:-1]) | (key[1:] != key[:-1])]
            begin[at] = cut
            start = np.flatnonzero(begin)
            place[order] = np.repeat(start, np.diff(np.r_[start, n]))
            h *= 2

    def _wavelet(self, symbols: np.ndarray, bits: int) -> None:
        self.ones, self.zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.bits = bits

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` symbols of the transform are `symbol`."""
        lo = np.zeros_like(at)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, its rank) at places of the transform."""
        symbol, lo, i = np.zeros_like(at), np.zeros_like(at), at
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ones[i + 1] > ones[i]
            symbol = symbol * 2 + one
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            i = np.where(one, zeros + ones[i], i - ones[i])
        return symbol, i - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases, all of one length, one in a row."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, column]
            lo[live], hi[live] = self.first[c] + self.rank(c, lo[live]), self.first[c] + self.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        return lo, np.maximum(hi, lo)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walks to sampled ones."""
        out, at, which, steps = np.empty(len(at), np.int64), at.copy(), np.arange(len(at)), 0
        while len(which):
            done = self.is_stop[at]
            out[which[done]] = self.kept[self.stops[at[done]]] + steps
            which, at = which[~done], at[~done]
            symbol, rank = self.access(at)
            at, steps = self.first[symbol] + rank, steps + 1
        return out


class Phrases:
    """The windows of some test items as symbols, and the items of each."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words_of(text)]
            for i in range(max(1, len(w) - width + 1) if w else 0):
                found.setdefault(tuple(w[i : i + width]), set()).add(item)
        self.by_length: list[tuple[np.ndarray, list[list[str]]]] = []
        for n in sorted({len(k) for k in found}):
            own = [k for k in found if len(k) == n]
            self.by_length.append((np.array(own, np.int64), [sorted(found[k]) for k in own]))
        self.shortest = min((p.shape[1] for p, _ in self.by_length), default=0)


def _search(phrases: Phrases, texts: list[bytes]) -> Iterator[tuple[int, list, list[str]]]:
    """(number of words, merged spans, items) of each text."""
    get = phrases.vocabulary.get
    counts, symbols = [], []
    for t in texts:
        w = words_of(t)
        counts.append(len(w))
        symbols.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    # one gap after each document, then only runs that can hold the shortest phrase
    n_docs = len(texts)
    spaced = np.zeros(first[-1] + n_docs + 1, np.int64)
    where = np.arange(first[-1]) + np.repeat(np.arange(n_docs), counts)
    if n_docs:
        spaced[where] = np.concatenate(symbols)
    known = np.r_[False, spaced > 0, False]
    begin, end = np.flatnonzero(~known[:-1] & known[1:]), np.flatnonzero(known[:-1] & ~known[1:])
    long = (end - begin >= phrases.shortest) if phrases.shortest else np.zeros(len(begin), bool)
    begin, end = begin[long], end[long]
    hits_at, hits_doc, hits_len, hits_items = [], [], [], []
    if len(begin):
        size = end - begin
        at = np.concatenate([[0], np.cumsum(size + 1)])
        source = np.repeat(begin - at[:-1], size + 1) + np.arange(at[-1])
        text = spaced[source]
        text[at[1:] - 1] = 0
        doc_of = np.searchsorted(first + np.arange(n_docs + 1), source, side="right") - 1
        index = FMIndex(text, len(phrases.vocabulary))
        for own, items in phrases.by_length:
            lo, hi = index.search(own)
            found = np.flatnonzero(hi > lo)
            if not len(found):
                continue
            n = (hi - lo)[found]
            which = np.repeat(found, n)
            place = index.locate(np.repeat(lo[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            hits_doc.append(doc_of[place])
            hits_at.append(source[place] - doc_of[place])
            hits_len.append(np.full(len(place), own.shape[1]))
            hits_items.append([items[k] for k in which])
    by_doc: dict[int, tuple[list, list, set]] = {}
    for d, a, n, items in zip(hits_doc, hits_at, hits_len, hits_items, strict=True):
        for dd, aa, nn, ii in zip(d.tolist(), a.tolist(), n.tolist(), items, strict=True):
            starts, lengths, known_items = by_doc.setdefault(dd, ([], [], set()))
            starts.append(aa - int(first[dd]))
            lengths.append(nn)
            known_items.update(ii)
    for d in range(n_docs):
        spans, items = [], []
        if d in by_doc:
            starts, lengths, known_items = by_doc[d]
            for s, n in sorted(zip(starts, lengths, strict=True)):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], s + n)
                else:
                    spans.append([s, s + n])
            items = sorted(known_items)
        yield counts[d], [{"first": s, "words": e - s} for s, e in spans], items


def _mapper(phrases: Phrases, shard_bytes: int, first: bool, last: bool):
    """One pass over rows of (doc_id, text), or of (doc_id, text, spans, items) with what earlier passes found; the last one leaves the text out."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(SCHEMA if last else CARRIED)
    spans_type, items_type = schema.field("spans").type, schema.field("items").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        texts: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = list(_search(phrases, texts))
            spans = [_union(old[1] or [], new[1]) if not first else new[1] for old, new in zip(rows, found, strict=True)]
            items = [sorted({*(old[2] or []), *new[2]}) if not first else new[2] for old, new in zip(rows, found, strict=True)]
            ids = pa.array([r[0] for r in rows], pa.int64())
            between = pa.array([x[0] for x in found], pa.int64()) if last else pa.array(texts, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([ids, between, pa.array(spans, spans_type), pa.array(items, items_type)], schema=schema)

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            data = data.tobytes()
            columns = [batch.column(0).to_pylist(), *([[None] * batch.num_rows] * 2 if first else [batch.column(k).to_pylist() for k in (2, 3)])]
            for i, row in enumerate(zip(*columns, strict=True)):
                rows.append(row)
                texts.append(data[offsets[i] : offsets[i + 1]])
                size += len(texts[-1])
                if size >= shard_bytes:
                    yield flush()
                    rows, texts, size = [], [], 0
        if rows:
            yield flush()

    return run


def judge_rows(docs: DataFrame, benchmark: DataFrame, columns: list[str], width: int = 13, shard_bytes: int = 6 << 20, block_bytes: int = 2 << 20) -> DataFrame:
    """The columns of docs, text among them, with `contaminated`: each row judged where it is, without a join.

    A benchmark of several blocks is judged on the hits of all of them; the rows then carry their spans from pass to pass.
    """
    source = docs.select(*columns).withColumn("_spans", F.array().cast(SPANS))
    source = _passes(source, benchmark, block_bytes, lambda rows, block, _, __: rows.mapInArrow(_row_mapper(Phrases(block, width), shard_bytes, rows.columns), rows.schema))
    n_words = F.size(F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), _GAPS.decode("latin-1"), " " * len(_GAPS)), " "), lambda x: F.length(x) > 0))
    n_hit = F.coalesce(F.aggregate("_spans", F.lit(0).cast("long"), lambda a, x: a + x["words"]), F.lit(0).cast("long"))
    return source.withColumn("contaminated", F.when(n_hit == 0, False).otherwise(20 * n_hit >= n_words)).drop("_spans")


def _row_mapper(phrases: Phrases, shard_bytes: int, names: list[str]):
    text, spans = names.index("text"), names.index("_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            data = data.tobytes()
            for a, b in blocks(offsets, shard_bytes):
                piece = batch.slice(a, b - a)
                found = _search(phrases, [data[offsets[k] : offsets[k + 1]] for k in range(a, b)])
                merged = [_union(old or [], new) for old, (_, new, _) in zip(piece.column(spans).to_pylist(), found, strict=True)]
                columns = [pa.array(merged, piece.schema.field(spans).type) if k == spans else piece.column(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _union(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for x in sorted(a + b, key=lambda x: x["first"]):
        if out and x["first"] <= out[-1]["first"] + out[-1]["words"]:
            out[-1] = {"first": out[-1]["first"], "words": max(out[-1]["words"], x["first"] + x["words"] - out[-1]["first"])}
        else:
            out.append(dict(x))
    return out


def _item_blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of at most `most` bytes (one item at least), sorted by Spark and streamed, a partition at a time."""
    block, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text")).where("text is not null").orderBy("item_id", "text").toLocalIterator():
        text = text.encode()
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((item if item is not None else "null", text))
        size += len(text)
    yield block


def _passes(rows: DataFrame, benchmark: DataFrame, block_bytes: int, one: Callable[[DataFrame, list, bool, bool], DataFrame]) -> DataFrame:
    """rows after one(rows, block, first, last) for each block of the benchmark. All passes but the last are written tables, so that the driver and a plan hold one block's phrases at a time."""
    blocks_ = _item_blocks(benchmark, block_bytes)
    block, first, before = next(blocks_), True, None
    while True:
        then = next(blocks_, None)
        rows = one(rows, block, first, then is None)
        if then is None:
            return rows
        rows = written(rows)
        if before is not None:
            discard(before)
        block, first, before = then, False, rows


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, shard_bytes: int = 6 << 20, block_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_words, spans (of words, merged, to remove), items: what test items occur in each row of docs(doc_id, text).

    The benchmark goes to executors in blocks of block_bytes, whatever its size (a block's phrases take some 19 times its text);
    each block is one pass over the rows, which carry what earlier passes found, so rows are never matched up again. Null or
    empty texts have no words, spans or items. An item without words is in nothing; one with a null id is called "null".
    Rows that repeat are judged each on their own; columns other than doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _passes(rows, benchmark, block_bytes, lambda rows, block, first, last: rows.mapInArrow(_mapper(Phrases(block, width), shard_bytes, first, last), SCHEMA if last else CARRIED))


def judged(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more) from spans and items."""
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["words"]), F.lit(0).cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


ORACLE = """
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark where text is not null),
i as (select item_id, least(len(w), 13) n, unnest([array_to_string(w[k:k + 12], ' ') for k in range(1, greatest(1, len(w) - 12) + 1)]) g from b where len(w) > 0),
lens as (select distinct n from i),
d as (select doc_id, n, unnest(range(1, len(w) - n + 2)) k, w from w cross join lens where len(w) >= n),
g as (select doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') g from d),
hit as (select distinct g.doc_id, g.k, g.n, i.item_id from g join i on g.g = i.g and g.n = i.n),
cover as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(k, k + n)) p from hit) group by 1),
items as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, coalesce(item_id::varchar, 'null') item_id from hit) group by 1)
select w.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from w left join cover using (doc_id) left join items using (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:

    return judged(find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
