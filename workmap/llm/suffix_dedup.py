"""Suffix-array de-duplication of byte strings across documents.

Every window of `width` bytes belongs to an anchor inside it that its own bytes choose (the least hash of
its grams), so equal windows of any documents have equal anchors. Documents tell the buckets of their
anchors' hashes which anchors they have; for anchors that several documents have they then send the bytes
around them, each distinct stretch once. A bucket sorts the suffixes of the stretches that share an anchor
but differ, and reads equal windows off the suffix order; the smallest document of each window keeps it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workmap.llm.common import U, Slices, blocks, grouped, mix, pack, part_of, parts_for, runs, slice_hashes, table, text_bytes, unpack, utf8
from workmap.llm.substring_dedup import ENTRY, TOLD, answer, messages, opened
from workmap.llm.suffix_sort import sorted_windows

#: Bytes of a repeated string, bytes of an anchor.
WIDTH, GRAM = 50, 20
#: Bytes of an anchor's hash in messages: what agrees by chance is told apart where the strings are sorted.
HASH_BYTES = 6
_LOW = U((1 << 8 * HASH_BYTES) - 1)
SENT = "bucket int, known boolean, part int, docs binary, keys binary, counts binary, starts binary, sizes binary, steps binary, anchors binary, bytes binary"
FOUND = "part int, docs binary, keys binary, counts binary, starts binary, sizes binary"
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<first:long,bytes:long>>"


class Anchors:
    """The stretches of window starts that one anchor owns, in the order of places: first start, number of starts, anchor's hash, document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, gram: int):
        n = len(data) - width + 1
        empty = np.zeros(0, np.int64)
        self.first = self.size = self.doc = empty
        self.anchor = np.zeros(0, U)
        if n <= 0:
            return
        sums = Slices(data)
        h = sums.windows(gram)
        least = (h & ~U(0xFFFFFFFF)) | np.arange(len(h), dtype=U)  # of equal high halves the leftmost
        span, wide = width - gram + 1, 1
        while 2 * wide <= span:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        if span > wide:
            least = np.minimum(least[: len(least) - (span - wide)], least[span - wide :])
        owner = (least[:n] & U(0xFFFFFFFF)).astype(np.int64)
        inner = offsets[1:-1]
        step = np.zeros(len(data) + 1, np.int64)  # of a border b exactly the starts from b - width + 1 to b - 1 cross it
        np.add.at(step, np.maximum(inner - width + 1, 0), 1)
        np.add.at(step, inner, -1)
        inside = np.cumsum(step[:n]) == 0
        v = np.flatnonzero(inside)
        if not len(v):
            return
        own = owner[v]
        cut = np.r_[True, (own[1:] != own[:-1]) | (v[1:] != v[:-1] + 1)]
        at = np.flatnonzero(cut)
        self.first, self.size = v[at], np.diff(np.r_[at, len(v)])
        self.anchor = h[own[at]] & _LOW
        self.doc = np.searchsorted(offsets, self.first, side="right") - 1
        # the stretch with its place around the anchor: what must agree for all its windows to
        self.stretch = mix(sums.of(self.first, self.first + self.size + width - 1) ^ ((own[at] - self.first).astype(U) << U(32)))


def _send(width: int, gram: int, n_buckets: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            data, offsets = utf8(batch.column(1))
            ids = np.asarray(batch.column(0), dtype=np.int64)
            for a, b in blocks(offsets, block_bytes):
                found = Anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width, gram)
                yield from messages(ids[a:b][found.doc], found.anchor, n_buckets, with_first=True, width=HASH_BYTES)

    return run


class _Rows:
    """Rows of packed columns for entries that are in the order of documents."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in range(11)]

    def add(self, bucket: int, known: bool, part: int, docs, keys, starts, sizes, member, anchors, data: bytes) -> None:
        """member: which of the row's distinct stretches an entry is; anchors and data are of those."""
        at = runs(keys)
        step = np.diff(member, prepend=0).astype(np.int32)
        row = (bucket, known, part, pack(docs[at[:-1]]), pack(keys[at[:-1]]), pack(np.diff(at).astype(np.int32)), pack(starts.astype(np.int32)), pack(sizes.astype(np.uint8)), pack(step), pack(anchors), zlib.compress(data, 1))
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)

    def table(self) -> pa.Table:
        types = [pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * 8]
        return pa.table([pa.array(c, t) for c, t in zip(self.columns, types, strict=True)], names=[x.split()[0] for x in SENT.split(", ")])


def _doc_keys(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Tells rows with one id but different texts apart."""
    return mix(slice_hashes(data, offsets[:-1], offsets[1:]) + ids.astype(U))


def _isin(docs: np.ndarray, values: np.ndarray, told_docs: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Whether each pair is among the told pairs."""
    pair = mix(mix(docs.astype(U)) ^ values)
    return np.isin(pair, mix(mix(told_docs.astype(U)) ^ told)) if len(told) else np.zeros(len(pair), bool)


def _stretches(width: int, gram: int, n_buckets: int, block_bytes: int):
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, told: pa.Table) -> pa.Table:
        out = _Rows()
        if not texts.num_rows or not told.num_rows:
            return out.table()
        part = key[0].as_py()
        texts = texts.filter(texts.column("doc_id").is_valid())
        told_docs, told_hashes = opened(told, HASH_BYTES)
        ids = np.asarray(texts.column("doc_id"), dtype=np.int64)
        data, offsets = utf8(texts.column("text"))
        chosen = np.flatnonzero(np.isin(ids, told_docs))
        lists: list[list] = [[] for _ in range(7)]
        pieces: list[np.ndarray] = []
        for a, b in blocks(offsets, block_bytes):
            rows = chosen[(chosen >= a) & (chosen < b)]
            if not len(rows):
                continue
            block, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            found = Anchors(block, o, width, gram)
            if not len(found.first):
                continue
            docs = ids[a:b][found.doc]
            keep = np.flatnonzero(_isin(docs, found.anchor, told_docs, told_hashes))
            keys = _doc_keys(block, o, ids[a:b])[found.doc[keep]]
            begin, size = found.first[keep], found.size[keep]
            for column, x in zip(lists, (docs[keep], keys, found.anchor[keep], found.stretch[keep], begin - o[found.doc[keep]], size), strict=False):
                column.append(x)
            # each distinct stretch of the block once, with its bytes
            _, once = np.unique(found.anchor[keep] ^ mix(found.stretch[keep]), return_index=True)
            once.sort()
            n = size[once] + width - 1
            place = np.repeat(begin[once] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            lists[6].append(once + sum(len(x) for x in lists[0][:-1]))
            pieces.append(block[place])
        if not lists[0]:
            return out.table()
        docs, keys, anchors, stretches, starts, sizes, once = (np.concatenate(x) for x in lists)
        data = np.concatenate(pieces)
        at = np.concatenate([[0], np.cumsum(sizes[once] + width - 1)])
        # of the part's equal stretches the smallest document's asks; the others need no answer
        same = anchors ^ mix(stretches)
        order = np.lexsort((docs, same))
        s, d = same[order], docs[order]
        new = np.r_[True, s[1:] != s[:-1]]
        least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        asks = np.empty(len(docs), bool)
        asks[order] = d == least
        u, back = np.unique(same, return_inverse=True)
        of = np.full(len(u), -1, np.int64)
        of[back[once]] = np.arange(len(once))
        bucket = (anchors % U(n_buckets)).astype(np.int64)
        none = np.zeros(0, np.int64)
        doc_order = np.lexsort((starts, keys, docs))
        ask = doc_order[asks[doc_order]]
        for k, i in grouped(bucket[ask], n_buckets, ask):
            u, one, member = np.unique(back[i], return_index=True, return_inverse=True)
            held = of[u]
            place = np.concatenate([np.arange(at[x], at[x + 1]) for x in held.tolist()])
            out.add(k, False, part, docs[i], keys[i], starts[i], sizes[i], member, anchors[i[one]], data[place].tobytes())
        rest = doc_order[~asks[doc_order]]
        if len(rest):
            out.add(int(part) % n_buckets, True, part, docs[rest], keys[rest], starts[rest], sizes[rest], none, np.zeros(0, U), b"")
        return out.table()

    return run


def _equal_windows(data: np.ndarray, offsets: np.ndarray, anchor: np.ndarray, least: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest document of each window of some stretches: (first window of each stretch in the list, documents)."""
    n_windows = np.diff(offsets) - width + 1
    base = np.concatenate([[0], np.cumsum(n_windows)])
    out = np.empty(base[-1], np.int64)
    edge = runs(anchor)  # equal windows have equal anchors: sort some anchors' stretches at a time
    lo = 0
    while lo < len(edge) - 1:
        hi = int(np.searchsorted(edge, edge[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), len(edge) - 1)
        a, b = int(edge[lo]), int(edge[hi])
        text, at, same = sorted_windows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
        start = np.flatnonzero(~same)
        smallest = np.minimum.reduceat(least[a:b][text], start)
        out[base[a + text] + at] = np.repeat(smallest, np.diff(np.r_[start, len(text)]))
        lo = hi
    return base, out


def told_apart(anchors: np.ndarray, hashes: np.ndarray, data: np.ndarray, at: np.ndarray, chunk: int = 1 << 22) -> np.ndarray:
    """Hashes of stretches, changed until those of one anchor are equal only where all bytes are: each is compared with the first of its class."""
    hashes = hashes.copy()
    live = np.arange(len(hashes))
    while len(live):
        order = live[np.lexsort((live, hashes[live], anchors[live]))]
        new = np.r_[True, (anchors[order][1:] != anchors[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])]
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        other = np.flatnonzero(first != order)
        x, y = order[other], first[other]
        size = at[x + 1] - at[x]
        same = size == at[y + 1] - at[y]
        lo = 0
        while lo < len(x):
            hi = max(int(np.searchsorted(np.cumsum(size[lo:]), chunk, side="right")) + lo, lo + 1)
            n = np.where(same[lo:hi], size[lo:hi], 1)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            equal = data[np.repeat(at[x[lo:hi]], n) + step] == data[np.repeat(at[y[lo:hi]], n) + step]
            same[lo:hi] &= np.logical_and.reduceat(equal, np.cumsum(n) - n)
            lo = hi
        live = x[~same]
        hashes[live] = mix(hashes[live] + U(1))
    return hashes


def _answer(width: int, most: int):
    def run(t: pa.Table) -> pa.Table:
        known = t.column("known").combine_chunks()
        ready, t = t.filter(known), t.filter(pc.invert(known))
        rows: list[list] = [[] for _ in range(6)]

        def add(part, docs, keys, starts, sizes):
            at = runs(keys)
            for column, value in zip(rows, (part, pack(docs[at[:-1]]), pack(keys[at[:-1]]), pack(np.diff(at).astype(np.int32)), pack(starts.astype(np.int32)), pack(sizes.astype(np.uint8))), strict=True):
                column.append(value)

        for column, name in zip(rows, ("part", "docs", "keys", "counts", "starts", "sizes"), strict=True):
            column.extend(ready.column(name).to_pylist())
        if t.num_rows:
            counts = unpack(t.column("counts"), np.int32)
            docs, keys = np.repeat(unpack(t.column("docs"), np.int64), counts), np.repeat(unpack(t.column("keys"), U), counts)
            starts, sizes = unpack(t.column("starts"), np.int32).astype(np.int64), unpack(t.column("sizes"), np.uint8).astype(np.int64)
            per_row = np.array([len(x) for x in t.column("sizes").to_pylist()])
            part = np.repeat(np.asarray(t.column("part")), per_row)
            # the stretches of all rows, one after another, and which of them each entry is
            anchors = unpack(t.column("anchors"), U)
            n_own = np.array([len(x) // 8 for x in t.column("anchors").to_pylist()])
            member = np.concatenate([np.cumsum(np.frombuffer(x, np.int32)) + b for x, b in zip(t.column("steps").to_pylist(), (np.cumsum(n_own) - n_own).tolist(), strict=True)])
            data = np.frombuffer(b"".join(map(zlib.decompress, t.column("bytes").to_pylist())), np.uint8)
            length = np.empty(len(anchors), np.int64)
            length[member] = sizes + width - 1
            at = np.concatenate([[0], np.cumsum(length)])
            stretches = told_apart(anchors, slice_hashes(data, at[:-1], at[1:]), data, at)[member]
            anchors = anchors[member]
            # classes of equal stretches
            order = np.lexsort((docs, stretches, anchors))
            a, s, d = anchors[order], stretches[order], docs[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])]
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            anchor_of, least, held = a[first], d[first], member[order][first]
            edge = runs(anchor_of)
            alone = np.repeat(np.diff(edge) == 1, np.diff(edge))
            # a window's smallest document; where all stretches of an anchor are equal it is the class's
            n_windows = sizes[order][first]
            window = np.concatenate([[0], np.cumsum(n_windows)])
            smallest = np.repeat(least, n_windows)
            differ = np.flatnonzero(~alone)
            if len(differ):
                h = held[differ]
                n = at[h + 1] - at[h]
                offsets = np.concatenate([[0], np.cumsum(n)])
                place = np.repeat(at[h] - offsets[:-1], n) + np.arange(offsets[-1])
                b, found = _equal_windows(data[place], offsets, anchor_of[differ], least[differ], width, most)
                smallest[np.repeat(window[differ] - b[:-1], n_windows[differ]) + np.arange(b[-1])] = found
            # stretches of starts whose windows a smaller document has
            entry = np.repeat(np.arange(len(docs)), sizes)
            off = np.arange(len(entry)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            gone = smallest[window[number[entry]] + off] < docs[entry]
            e, o = entry[gone], off[gone]
            if len(e):
                cut = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (o[1:] != o[:-1] + 1)])
                e, o, n = e[cut], o[cut], np.diff(np.r_[cut, len(e)])
                for p, i in grouped(part[e].astype(np.int64), int(part.max()) + 1, np.arange(len(e))):
                    add(p, docs[e[i]], keys[e[i]], starts[e[i]] + o[i], n[i])
        types = [pa.int32(), *[pa.binary()] * 5]
        return pa.table([pa.array(c, ty) for c, ty in zip(rows, types, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def _whole(text: bytes, gone: np.ndarray) -> np.ndarray:
    """gone without the bytes of characters that go only in part."""
    n = len(text)
    begin = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    if not len(begin):
        return gone
    all_gone = np.logical_and.reduceat(gone, begin)
    return np.repeat(all_gone, np.diff(np.r_[begin, n]))


def _gone(texts: pa.Table, told: pa.Table, width: int) -> Iterator[tuple[int | None, bytes, np.ndarray | None]]:
    """(id, text, bytes that go) of each row."""
    data, offsets = utf8(texts.column("text"))
    ids = texts.column("doc_id").to_pylist()
    keys = _doc_keys(data, offsets, np.array([i or 0 for i in ids], np.int64))
    counts = unpack(told.column("counts"), np.int32)
    told_keys = np.repeat(unpack(told.column("keys"), U), counts)
    starts, sizes = unpack(told.column("starts"), np.int32), unpack(told.column("sizes"), np.uint8)
    order = np.argsort(told_keys, kind="stable")
    told_keys, starts, sizes = told_keys[order], starts[order].astype(np.int64), sizes[order].astype(np.int64)
    lo, hi = np.searchsorted(told_keys, keys), np.searchsorted(told_keys, keys, side="right")
    for k, doc in enumerate(ids):
        text, gone = data[offsets[k] : offsets[k + 1]], None
        if doc is not None and hi[k] > lo[k]:
            step = np.zeros(len(text) + 1, np.int64)
            own = slice(lo[k], hi[k])
            np.add.at(step, starts[own], 1)
            np.add.at(step, starts[own] + sizes[own] + width - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
        yield doc, text.tobytes(), gone


def _cut(width: int, keep_text: bool):
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, told: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(7)]
        for doc, text, gone in _gone(texts, told, width) if texts.num_rows else ():
            spans, kept = [], text
            if gone is not None:
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                spans = [{"first": int(s), "bytes": int(e - s)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            for column, value in zip(out, (doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if keep_text else None, spans), strict=True):
                column.append(value)
        types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.struct([("first", pa.int64()), ("bytes", pa.int64())]))]
        return pa.table([pa.array(c, ty) for c, ty in zip(out, types, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return run


def _cut_text(width: int, names: list[str]):
    """Rows with the rest of their text; characters that would go only in part stay."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, told: pa.Table) -> pa.Table:
        kept: list[str | None] = []
        if texts.num_rows:
            for was, (_, text, gone) in zip(texts.column("text").is_null().to_pylist(), _gone(texts, told, width), strict=True):
                if gone is not None:
                    text = np.frombuffer(text, np.uint8)[~_whole(text, gone)].tobytes()
                kept.append(None if was else text.decode())
        text = pa.array(kept, pa.string())
        return pa.table([text if c == "text" else texts.column(c) for c in names], names=names)

    return run


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, keep_text: bool = True, block_bytes: int = 1 << 20, part_bytes: int = 8 << 20, sort_rows: int = 8_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes, null without keep_text), spans of each row of docs(doc_id, text).

    A byte goes if a string of `width` bytes that covers it also starts in a document with a smaller doc_id; strings are
    judged on the input. A null text is empty; a row with a null doc_id neither loses nor takes; rows with equal ids don't take from each other, and those with equal ids and texts
    get equal results. width is at most 255 + gram. Other columns aren't read.
    """
    parts, found = _found(docs, [], width, gram, block_bytes, part_bytes, sort_rows)
    return parts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_cut(width, keep_text), OUT)


def cut_rows(docs: DataFrame, columns: list[str], width: int = WIDTH, gram: int = GRAM, block_bytes: int = 1 << 20, part_bytes: int = 8 << 20, sort_rows: int = 8_000) -> DataFrame:
    """The columns of docs, doc_id and text among them, the text without repeated strings of whole characters and n_chars, if there, its length."""
    extra = [c for c in columns if c not in ("doc_id", "text")]
    parts, found = _found(docs, extra, width, gram, block_bytes, part_bytes, sort_rows)
    schema = T.StructType([parts.schema[c] for c in columns])
    out = parts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_cut_text(width, columns), schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else out


def _found(docs: DataFrame, extra: list[str], width: int, gram: int, block_bytes: int, part_bytes: int, sort_rows: int) -> tuple[DataFrame, DataFrame]:
    """The documents with their parts, and the repeated window starts of each part."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    n_bytes = text_bytes(source)
    n_parts, n_buckets = parts_for(spark, n_bytes, part_bytes), parts_for(spark, n_bytes, part_bytes)
    have = source.select("doc_id", "text").mapInArrow(_send(width, gram, n_buckets, block_bytes), ENTRY)
    told = have.groupBy("bucket").applyInArrow(answer(n_parts, with_first=True, width=HASH_BYTES), TOLD)
    parts = source.withColumn("part", part_of(F.col("doc_id"), F.col("text"), n_parts))
    sent = parts.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_stretches(width, gram, n_buckets, block_bytes), SENT)
    return parts, sent.groupBy("bucket").applyInArrow(_answer(width, sort_rows), FOUND)


ORACLE = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
g as (select doc_id, k, substr(x, 2 * k + 1, 100) s from (select doc_id, x, unnest(range(0, strlen(x) // 2 - 49)) k from d)),
m as (select hash(s) h, s, min(doc_id) f from g group by 1, 2),
c as (select g.doc_id, k from g join m using (s) where f < g.doc_id),
e as (select doc_id, k, k - lag(k, 1, -100) over (partition by doc_id order by k) step from c),
r as (select doc_id, k, sum((step > 50)::int) over (partition by doc_id order by k) run from e),
s as (select doc_id, run, min(k) a, max(k) + 50 b from r group by 1, 2),
t as (select doc_id, sum(b - a) n_removed, count(*) n_spans, list(a order by a) aa, list(b order by a) bb from s group by 1)
select d.doc_id, (strlen(x) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans,
  sha256(unhex(case when aa is null then x else array_to_string(list_transform(range(1, len(aa) + 2),
    lambda i: substr(x, 2 * (case when i = 1 then 0 else bb[i - 1] end) + 1, 2 * ((case when i > len(aa) then strlen(x) // 2 else aa[i] end) - (case when i = 1 then 0 else bb[i - 1] end)))), '') end)) kept_sha256
from d left join t using (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    found = remove_repeated_bytes(table(spark, sf_dir, "documents"), keep_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
