"""Stupid-backoff language-model scores of documents against the rest of the corpus.

The corpus is dealt into parts by document. A part counts its n-grams and sends each distinct one once to the table of
counts, which is partitioned by hash; a bucket of that table adds the counts of all parts and joins them back to the parts
that asked. A part then explodes its documents' n-grams again, looks their counts up, and sums log scores for each document.
Words and pairs are asked for at once, longer n-grams order by order: only those of which both shorter n-grams occur in other
documents, as no others can.

Keys are so many top bits of a 64-bit hash that 48 of them tell the n-grams of a bucket apart; buckets grow with the corpus,
so an n-gram shares its key with another one in about 4 of 10**9 cases at every size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workmap.llm.common import Slices, U, Words, ascii_lower, blocks, part_of, parts_for, runs, table, text_bytes, utf8

SENT = "part int, bucket int, n int, grams binary, counts binary"
TOLD = "part int, bucket int, n int, others binary"
OUT = "doc_id long, n_words long, log_score double, mean_log_score double"
#: Bits of a key inside its bucket.
KEY_BITS = 48


def planes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of values, all first bytes before all second ones: bytes of one place are alike and compress."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view(U).ravel()


class Buckets:
    """Ranges of keys: hashes cut to as many top bits as the number of buckets asks for."""

    def __init__(self, n: int):
        self.n = n
        self.bits = min(64, KEY_BITS + (n.bit_length() - 1))
        self.low = np.array([-(-(k << 32) // n) << (self.bits - 32) for k in range(n)], U)

    def key(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> U(64 - self.bits)

    def split(self, keys: np.ndarray) -> list[tuple[int, int, int]]:
        """(bucket, from, to) of sorted keys."""
        at = np.r_[np.searchsorted(keys, self.low), len(keys)]
        return [(k, int(at[k]), int(at[k + 1])) for k in np.flatnonzero(np.diff(at)).tolist()]


class _Part:
    """The words of the texts of a part, and the key of the n-gram that ends at each place."""

    def __init__(self, texts: pa.Table, buckets: Buckets, block_bytes: int):
        data, offsets = utf8(texts.column("text"))
        self.n_docs = len(offsets) - 1
        words, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for a, b in blocks(offsets, block_bytes):
            w = Words(ascii_lower(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a])
            words.append(w.hashes())
            counts.append(np.diff(w.first))
        self.counts = np.concatenate(counts)
        self.n_words = int(self.counts.sum())
        self.doc = np.repeat(np.arange(self.n_docs, dtype=np.int32), self.counts)
        self.place = np.arange(self.n_words) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        self.sums, self.buckets = Slices(np.concatenate(words)), buckets

    def grams(self, n: int) -> np.ndarray:
        out = np.zeros(self.n_words, U)
        found = self.sums.windows(n)
        out[n - 1 :][: len(found)] = found
        return self.buckets.key(out)

    def asked(self, n: int, others: dict[int, np.ndarray]) -> np.ndarray:
        """Places whose n-gram may occur in another document."""
        if n <= 2:
            return self.place >= n - 1
        below = others[n - 1] > 0
        return (self.place >= n - 1) & below & np.r_[False, below[:-1]]

    def others(self, n: int, asked: np.ndarray, told: np.ndarray) -> np.ndarray:
        """At each place how often its n-gram occurs in other documents; told has the occurrences in other parts, in the order of the distinct n-grams."""
        there = np.flatnonzero(asked)
        g = self.grams(n)[there]
        order = np.argsort(g, kind="stable")  # places of one n-gram stay in the order of their documents
        g, doc = g[order], self.doc[there[order]]
        new = np.r_[True, g[1:] != g[:-1]][: len(g)]
        pair = new | np.r_[True, doc[1:] != doc[:-1]][: len(g)]
        in_part, in_doc = (np.diff(np.r_[np.flatnonzero(x), len(g)]) for x in (new, pair))
        gram, own = np.cumsum(new) - 1, in_doc[np.cumsum(pair) - 1] if len(g) else np.zeros(0, np.int64)
        out = np.zeros(self.n_words, np.int64)
        out[there[order]] = (told + in_part)[gram] - own
        return out

    def messages(self, part: int, n: int, asked: np.ndarray) -> list[tuple]:
        g, c = np.unique(self.grams(n)[asked], return_counts=True)
        return [(part, b, n, planes(g[lo:hi] - self.buckets.low[b], KEY_BITS // 8), planes(c[lo:hi], 4)) for b, lo, hi in self.buckets.split(g)]


def _answers(told: pa.Table) -> dict[int, np.ndarray]:
    """For each order what was told, in the order of buckets, which is that of keys."""
    t = told.sort_by([("n", "ascending"), ("bucket", "ascending")])
    n, raw = np.asarray(t.column("n")), t.column("others").to_pylist()
    at = runs(n)
    return {int(n[a]): from_planes_each(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)}


def from_planes_each(raw: list[bytes], width: int = 8) -> np.ndarray:
    return np.concatenate([from_planes(x, width) for x in raw]).astype(np.int64)


def _known(p: _Part, told: pa.Table, upto: int) -> dict[int, np.ndarray]:
    answers = _answers(told)
    others: dict[int, np.ndarray] = {}
    for n in range(1, upto + 1):
        others[n] = p.others(n, p.asked(n, others), answers.get(n, np.zeros(0, np.int64)))
    return others


def _rows(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "bucket", "n", "grams", "counts"])


def _count_short(order: int, buckets: Buckets, block_bytes: int):
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table) -> pa.Table:
        p = _Part(texts, buckets, block_bytes)
        return _rows([m for n in range(1, min(order, 2) + 1) for m in p.messages(key[0].as_py(), n, p.asked(n, {}))])

    return run


def _count_long(n: int, buckets: Buckets, block_bytes: int):
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _rows([])
        p = _Part(texts, buckets, block_bytes)
        return _rows(p.messages(key[0].as_py(), n, p.asked(n, _known(p, told, n - 1))))

    return run


def _add(t: pa.Table) -> pa.Table:
    """A bucket of the table of counts: how often each n-gram occurs in the parts other than the one that asks."""
    raw = t.column("grams").to_pylist()
    g = np.concatenate([from_planes(x, KEY_BITS // 8) for x in raw])
    c = np.concatenate([from_planes(x, 4) for x in t.column("counts").to_pylist()]).astype(np.int64)
    order = np.argsort(g)
    starts = np.flatnonzero(np.r_[True, g[order][1:] != g[order][:-1]])
    total = np.empty(len(g), np.int64)
    total[order] = np.repeat(np.add.reduceat(c[order], starts), np.diff(np.r_[starts, len(g)]))
    ends = np.cumsum([len(x) // (KEY_BITS // 8) for x in raw])
    return pa.table([t.column("part"), t.column("bucket"), t.column("n"), pa.array([planes(x, 8) for x in np.split(total - c, ends[:-1])], pa.binary())], names=["part", "bucket", "n", "others"])


def _score(order: int, buckets: Buckets, n_words: int, backoff: float, block_bytes: int):
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, told: pa.Table) -> pa.Table:
        names = ["doc_id", "n_words", "log_score", "mean_log_score"]
        if not texts.num_rows:
            return pa.table([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        p = _Part(texts, buckets, block_bytes)
        others = _known(p, told, order)
        rest = n_words - p.counts[p.doc]  # words of the other documents
        value, known, penalty = np.empty(p.n_words), np.zeros(p.n_words, bool), np.zeros(p.n_words)
        for n in range(order, 0, -1):
            open_ = ~known & (p.place >= n - 1)
            hit = np.flatnonzero(open_ & (others[n] > 0))
            below = others[n - 1][hit - 1] if n > 1 else rest[hit]
            value[hit] = np.log(others[n][hit]) - np.log(below) + penalty[hit]
            known[hit] = True
            penalty[open_ & ~known] += np.log(backoff)
        unseen = np.flatnonzero(~known)
        value[unseen] = penalty[unseen] - np.log(rest[unseen] + 1.0)
        sums = np.bincount(p.doc, value, p.n_docs).astype(float)  # whole numbers where there are no words
        empty = p.counts == 0
        mean = np.divide(sums, p.counts, out=np.zeros(p.n_docs), where=~empty)
        return pa.table([texts.column("doc_id"), pa.array(p.counts.astype(np.int64)), pa.array(sums), pa.array(mean, mask=empty)], names=names)

    return run


def score_documents(docs: DataFrame, order: int = 3, backoff: float = 0.4, part_bytes: int = 8 << 20, block_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score of each row of docs(doc_id, text).

    Words are runs of other than ASCII white space, A-Z lower-cased. A word with its order-1 words before it scores its
    n-gram's count over its context's count, both in all rows but this one; where the n-gram is in no other row, the shorter
    one's score times `backoff`. A single word's context count is the number of words in the other rows; an unknown word's
    share is `backoff` over that number plus one. log_score sums natural logarithms, 0 for null and empty texts, whose mean is
    null. Equal rows score each other: each leaves out only itself. Other columns aren't read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bytes = text_bytes(source)
    n_parts = parts_for(docs.sparkSession, n_bytes, part_bytes)
    buckets = Buckets(parts_for(docs.sparkSession, 2 * n_bytes, part_bytes))
    parts = source.withColumn("part", part_of(F.col("doc_id"), F.col("text"), n_parts))
    short = parts.groupBy("part").applyInArrow(_count_short(order, buckets, block_bytes), SENT)
    told = [short.groupBy("bucket").applyInArrow(_add, TOLD)]
    for n in range(3, order + 1):
        so_far = reduce(DataFrame.unionByName, told)
        longer = parts.groupBy("part").cogroup(so_far.groupBy("part")).applyInArrow(_count_long(n, buckets, block_bytes), SENT)
        told.append(longer.groupBy("bucket").applyInArrow(_add, TOLD))
    score = _score(order, buckets, word_count(docs), backoff, block_bytes)
    return parts.groupBy("part").cogroup(reduce(DataFrame.unionByName, told).groupBy("part")).applyInArrow(score, OUT)


def word_count(docs: DataFrame) -> int:
    """Words of all texts."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(t.split()) for t in _plain(batch.column(0)))], pa.int64())], names=["n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def _plain(column: pa.Array):
    data, offsets = utf8(column)
    data = data.tobytes()
    return (data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))


ORACLE_BIGRAMS = """
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
t as (select doc_id, len(w) n_words, unnest(w) x, unnest(range(1, len(w) + 1)) i from w),
p as (select *, lag(x) over (partition by doc_id order by i) y from t),
total as (select sum(len(w)) n from w),
one as (select x, count(*) c from t group by 1),
one_own as (select doc_id, x, count(*) c from t group by 1, 2),
two as (select y, x, count(*) c from p where y is not null group by 1, 2),
two_own as (select doc_id, y, x, count(*) c from p where y is not null group by 1, 2, 3),
s as (
  select p.doc_id, n - n_words rest, p.y is not null has, coalesce(two.c - two_own.c, 0) c2, yo.c - yw.c cy, xo.c - xw.c cx
  from p cross join total
  left join two on two.y = p.y and two.x = p.x left join two_own on two_own.doc_id = p.doc_id and two_own.y = p.y and two_own.x = p.x
  left join one yo on yo.x = p.y left join one_own yw on yw.doc_id = p.doc_id and yw.x = p.y
  join one xo on xo.x = p.x join one_own xw on xw.doc_id = p.doc_id and xw.x = p.x),
v as (select doc_id, sum(case when has and c2 > 0 then ln(c2) - ln(cy)
  else (case when has then ln(0.4::double) else 0 end) + case when cx > 0 then ln(cx) - ln(rest) else (ln(0.4::double)) - ln(rest + 1.0) end end) v from s group by 1)
select w.doc_id, len(w)::bigint n_words, round(coalesce(v, 0), 4) log_score, round(v / len(w), 6) mean_log_score from w left join v using (doc_id)
"""


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


ORACLE = """
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
t as (select doc_id, len(w) n_words, unnest(w) x, unnest(range(1, len(w) + 1)) i from w),
p as (select *, lag(x) over (partition by doc_id order by i) y, lag(x, 2) over (partition by doc_id order by i) z from t),
total as (select sum(len(w)) n from w),
one as (select x, count(*) c from t group by 1),
one_own as (select doc_id, x, count(*) c from t group by 1, 2),
two as (select y, x, count(*) c from p where y is not null group by 1, 2),
two_own as (select doc_id, y, x, count(*) c from p where y is not null group by 1, 2, 3),
three as (select z, y, x, count(*) c from p where z is not null group by 1, 2, 3),
three_own as (select doc_id, z, y, x, count(*) c from p where z is not null group by 1, 2, 3, 4),
s as (
  select p.doc_id, n - n_words rest, p.y is not null has, p.z is not null has3, coalesce(three.c - three_own.c, 0) c3, zo.c - zw.c czy, coalesce(two.c - two_own.c, 0) c2, yo.c - yw.c cy, xo.c - xw.c cx
  from p cross join total
  left join three on three.z = p.z and three.y = p.y and three.x = p.x left join three_own on three_own.doc_id = p.doc_id and three_own.z = p.z and three_own.y = p.y and three_own.x = p.x
  left join two zo on zo.y = p.z and zo.x = p.y left join two_own zw on zw.doc_id = p.doc_id and zw.y = p.z and zw.x = p.y
  left join two on two.y = p.y and two.x = p.x left join two_own on two_own.doc_id = p.doc_id and two_own.y = p.y and two_own.x = p.x
  left join one yo on yo.x = p.y left join one_own yw on yw.doc_id = p.doc_id and yw.x = p.y
  join one xo on xo.x = p.x join one_own xw on xw.doc_id = p.doc_id and xw.x = p.x),
v as (select doc_id, sum(case when has3 and c3 > 0 then ln(c3) - ln(czy)
  else (case when has3 then ln(0.4::double) else 0 end) + case when has and c2 > 0 then ln(c2) - ln(cy)
  else (case when has then ln(0.4::double) else 0 end) + case when cx > 0 then ln(cx) - ln(rest) else (ln(0.4::double)) - ln(rest + 1.0) end end end) v from s group by 1)
select w.doc_id, len(w)::bigint n_words, round(coalesce(v, 0), 4) log_score, round(v / len(w), 6) mean_log_score from w left join v using (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return _rounded(score_documents(table(spark, sf_dir, "documents")))


def query_bigrams(spark, sf_dir: str) -> DataFrame:
    return _rounded(score_documents(table(spark, sf_dir, "documents"), order=2))
