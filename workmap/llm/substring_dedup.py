"""Substring de-duplication: Rabin-Karp hashes of every window of words, counted over the corpus.

Each block of documents sends every distinct window hash once, packed by hash bucket, with the
smallest document of the block that has it. A bucket's task finds the smallest document of each hash
and tells the others, packed by the part of the corpus they are in; a part then hashes its texts again,
marks the windows told of, and merges them into maximal removal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workmap.llm.common import Words, blocks, covered, grouped, pack, part_of, parts_for, runs, table, text_bytes, unpack, utf8

ENTRY = "bucket int, known boolean, doc_ids binary, counts binary, hashes binary"
TOLD = "part int, doc_ids binary, counts binary, hashes binary"
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<first:int,words:int>>"


def narrow(hashes: np.ndarray, width: int) -> bytes:
    """The low bytes of hashes."""
    return pack(hashes) if width == 8 else np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widened(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(-1, width)
    return out.view(np.uint64).ravel()


def entries(key: np.ndarray, n: int, doc_ids: np.ndarray, hashes: np.ndarray, name: str, known: bool | None = None, width: int = 8) -> pa.RecordBatch:
    """Rows (key, the documents, how many hashes of each, the hashes by their low `width` bytes) for hashes in the order of their documents."""
    rows: list[list] = [[], [], [], []]
    for k, d, h in grouped(key, n, doc_ids, hashes):
        at = runs(d)
        for column, value in zip(rows, (k, pack(d[at[:-1]]), pack(np.diff(at).astype(np.int32)), narrow(h, width)), strict=True):
            column.append(value)
    packed = [pa.array(x, pa.binary()) for x in rows[1:]]
    if known is None:
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *packed], names=[name, "doc_ids", "counts", "hashes"])
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array([known] * len(rows[0]), pa.bool_()), *packed], names=[name, "known", "doc_ids", "counts", "hashes"])


def opened(t: pa.Table, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    docs = unpack(t.column("doc_ids"), np.int64)
    return np.repeat(docs, unpack(t.column("counts"), np.int32)), widened(unpack(t.column("hashes"), np.uint8), width)


def by_hash(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in the order of hash, then document: (documents, hashes, is the smallest of its hash, has its hash in common)."""
    order = np.lexsort((docs, hashes))
    d, h = docs[order], hashes[order]
    if not len(h):
        return d, h, np.zeros(0, bool), np.zeros(0, bool)
    once = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
    d, h = d[once], h[once]
    first = np.r_[True, h[1:] != h[:-1]]
    size = np.diff(np.r_[np.flatnonzero(first), len(h)])
    return d, h, first, np.repeat(size > 1, size)


def by_document(d: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(d, kind="stable")
    return d[order], h[order]


def messages(docs: np.ndarray, hashes: np.ndarray, n_buckets: int, with_first: bool, width: int = 8) -> Iterator[pa.RecordBatch]:
    """A block's messages to the buckets: each hash once, with its smallest document; and what the block knows itself, that other documents of it share the hash, spread by document and only passed on. A hash that a third of all documents have is thus one entry for each block.

    with_first: the smallest document of a hash is told of the others, too.
    """
    d, h, first, shared = by_hash(docs, hashes)
    ask_d, ask_h = by_document(d[first], h[first])
    yield entries((ask_h % np.uint64(n_buckets)).astype(np.int64), n_buckets, ask_d, ask_h, "bucket", False, width)
    own = shared if with_first else shared & ~first
    if own.any():
        known_d, known_h = by_document(d[own], h[own])
        yield entries(known_d % n_buckets, n_buckets, known_d, known_h, "bucket", True, width)


def _send(width: int, n_buckets: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            data, offsets = utf8(batch.column(1))
            ids = np.asarray(batch.column(0), dtype=np.int64)
            for a, b in blocks(offsets, block_bytes):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                h, at = words.windows(width)
                yield from messages(ids[a:b][np.searchsorted(words.first, at, side="right") - 1], h, n_buckets, with_first=False)

    return run


def answer(n_parts: int, with_first: bool, width: int = 8):
    """A bucket's answers: which documents share which hashes with a smaller one (with_first: with any other)."""

    def run(t: pa.Table) -> pa.Table:
        known = t.column("known").combine_chunks()
        ready_d, ready_h = opened(t.filter(known), width)
        d, h, first, shared = by_hash(*opened(t.filter(pc.invert(known)), width))
        own = shared if with_first else shared & ~first
        d, h = by_document(np.concatenate([ready_d, d[own]]), np.concatenate([ready_h, h[own]]))
        return pa.Table.from_batches([entries(d % n_parts, n_parts, d, h, "part", width=width)])

    return run


def _cut(width: int, keep_text: bool, block_bytes: int):
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, told: pa.Table) -> pa.Table:
        doc, h = opened(told)
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
        out: list[list] = [[], [], [], [], [], []]
        if not texts.num_rows:
            return pa.table([[]] * 6, names=[x.split()[0] for x in OUT.split(", ")])
        data, offsets = utf8(texts.column("text"))
        ids = texts.column("doc_id").to_pylist()
        for a, b in blocks(offsets, block_bytes):
            words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            raw = words.data.tobytes()
            starts, ends = words.starts.tolist(), words.ends.tolist()
            window, at = words.windows(width)
            for k in range(b - a):
                w0, w1 = int(words.first[k]), int(words.first[k + 1])
                n = w1 - w0
                lo, hi = (np.searchsorted(doc, ids[a + k], side) for side in ("left", "right")) if ids[a + k] is not None else (0, 0)
                spans = []
                gone = None
                if hi > lo:
                    i, j = np.searchsorted(at, [w0, w1])
                    found = at[i:j][np.isin(window[i:j], h[lo:hi])] - w0
                    gone = covered(found, width, n)
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                    spans = [{"first": int(s), "words": int(e - s)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                kept = b" ".join([raw[starts[x] : ends[x]] for x in (range(w0, w1) if gone is None else (np.flatnonzero(~gone) + w0).tolist())])
                row = (ids[a + k], n, int(gone.sum()) if gone is not None else 0, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None, spans)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))]
        return pa.table([pa.array(x, ty) for x, ty in zip(out, types, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return run


def remove_repeated_windows(docs: DataFrame, width: int = 13, keep_text: bool = True, block_bytes: int = 3 << 20, part_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (null without keep_text), spans for each row of docs(doc_id, text).

    A word goes if a window of `width` words that covers it also starts in a document with a smaller doc_id; windows are
    judged on the input. A null text has no words; a row with a null doc_id is smaller and larger than nothing, so it loses
    nothing and takes nothing. Rows with equal ids don't take from each other. Texts shorter than a window stay whole.
    Windows are compared by 64-bit hashes of 64-bit word hashes. Other columns aren't read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bytes = text_bytes(source)
    n_parts = parts_for(spark, n_bytes, part_bytes)
    n_buckets = parts_for(spark, 2 * n_bytes, part_bytes)
    sent = source.mapInArrow(_send(width, n_buckets, block_bytes), ENTRY)
    told = sent.groupBy("bucket").applyInArrow(answer(n_parts, with_first=False), TOLD)
    parts = source.withColumn("part", part_of(F.col("doc_id"), F.col("text"), n_parts))
    return parts.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_cut(width, keep_text, 1 << 20), OUT)


ORACLE = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
g as (select doc_id, k, array_to_string(w[k:k + 12], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 11)) k from w)),
m as (select g, min(doc_id) d from g group by 1),
c as (select distinct doc_id, unnest(range(k, k + 13)) p from g join m using (g) where d < doc_id),
r as (select doc_id, count(*) n, list(p) ps from c group by 1),
p as (select doc_id, string_agg(x, ' ' order by i) kept from (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) i from w) t
  anti join c on c.doc_id = t.doc_id and c.p = t.i group by 1)
select w.doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256
from w left join r using (doc_id) left join p using (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    found = remove_repeated_windows(table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
