"""Shared pieces of the corpus operators: scratch tables, Arrow text blocks, 64-bit hashes.

Hashes are polynomials modulo 2**64 with odd bases, taken from prefix sums so that any slice
costs two look-ups; each is finished by a bijective mixer. Every hashed string here is short
(a word, a window of words, some dozens of bytes) except single very long words.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- scratch tables
def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Without that setting a local master gets a temporary one; on a cluster there is none to guess."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="workmap-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, **options: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and lost executors cost nothing already done."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/workmap/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a written table that nothing reads any more."""
    path = getattr(df, "written_at", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def parts_for(spark: SparkSession, n_bytes: int, target: int = 12 << 20) -> int:
    """How many parts n_bytes of data make at target bytes each; at least as many as shuffles have.

    Parts and buckets that all write to each other make parts * buckets messages; from where they would be shorter than half a
    kilobyte on average, parts grow with the root of the data: 23 MB at 1 TB, 230 MB at 100 TB.
    """
    target = max(target, math.isqrt(512 * int(n_bytes or 0)))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes or 0) // target), 1)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def part_of(ident: Column, text: Column, n: int) -> Column:
    """The part of a document: by its id, or by its text if it has none, so that rows without ids spread too."""
    return F.pmod(F.coalesce(ident.cast("long"), F.crc32(text.cast("binary"))), F.lit(n)).cast("int")


# ---------------------------------------------------------------- Arrow text
def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes each; a row is never cut."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


# ---------------------------------------------------------------- hashing
_tables: dict[tuple[int, bool], np.ndarray] = {}


def _powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    got = _tables.get((base, inverse))
    if got is None or len(got) < n:
        size = max(n, 1 << 16, 2 * len(got) if got is not None else 0)
        step = np.full(size, pow(base, -1, 1 << 64) if inverse else base, U)
        step[0] = 1
        got = _tables[base, inverse] = np.multiply.accumulate(step)
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads differences over all bits (the finisher of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(_BYTE_BASE))


_LETTER = _letters()


class Slices:
    """Hashes of any slices of a sequence of 64-bit values or of bytes."""

    def __init__(self, values: np.ndarray):
        self.base = _BYTE_BASE if values.dtype == np.uint8 else _WORD_BASE
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum((_LETTER[values] if values.dtype == np.uint8 else values) * _powers(self.base, len(values)), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        back = _powers(self.base, len(self.sums), inverse=True)
        return mix((self.sums[ends] - self.sums[starts]) * back[starts] + (ends - starts).astype(U))

    def windows(self, width: int) -> np.ndarray:
        """Of every window of the width, by its start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, U)
        return mix((self.sums[width:] - self.sums[:n]) * _powers(self.base, n, inverse=True) + U(width))


def slice_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 18) -> np.ndarray:
    """Hashes of slices that don't overlap, in the order of places; some hundred kB are worked on at a time."""
    out = np.empty(len(starts), U)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(int(np.searchsorted(ends, lo + chunk, side="right")), at + 1)
        out[at:to] = Slices(data[lo : int(ends[to - 1])]).of(starts[at:to] - lo, ends[at:to] - lo)
        at = to
    return out


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; all other bytes stay."""
    out = data.copy()
    out[(out >= 65) & (out <= 90)] += 32
    return out


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True


class Words:
    """The words of some texts: where they start and end, their hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray = _IS_SPACE):
        n = len(data)
        gap = np.ones(n + 2, bool)
        gap[1:-1] = is_gap[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        inside = ~gap[1:-1]
        self.starts = np.flatnonzero(inside & (gap[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(inside & (gap[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.data = data

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return slice_hashes(self.data, self.starts, self.ends)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of every run of `width` words of one text."""
        counts = np.diff(self.first)
        hashed = Slices(self.hashes()).windows(width)
        last = self.first[1:] - width
        at = np.arange(len(hashed))
        keep = at <= np.repeat(last, counts)[: len(hashed)] if len(hashed) else np.zeros(0, bool)
        return hashed[keep], at[keep]


# ---------------------------------------------------------------- packed columns
def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def unpack(column: pa.Array, dtype) -> np.ndarray:
    """All the values of a column of packed arrays, one after another."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def grouped(keys: np.ndarray, n: int, *values: np.ndarray) -> Iterator[tuple]:
    """(key, values...) for each key below n that occurs; values keep their order."""
    order = np.argsort(keys, kind="stable")
    bounds = np.searchsorted(keys[order], np.arange(n + 1))
    values = [v[order] for v in values]
    for k in np.flatnonzero(np.diff(bounds)):
        yield (int(k), *(v[bounds[k] : bounds[k + 1]] for v in values))


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.r_[0, np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, len(sorted_values)]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of the width that begins at one of the starts."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:-1]) > 0


# ---------------------------------------------------------------- components
def stars(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars around the smallest node that they reach there; written out after every `most` nodes."""
    parent: dict[int, int] = {}

    def top(i: int) -> int:
        while (p := parent.setdefault(i, i)) != i:
            parent[i] = i = parent.setdefault(p, p)
        return i

    def emit() -> pa.RecordBatch:
        pairs = [(i, top(i)) for i in list(parent)]
        pairs = [(i, p) for i, p in pairs if i != p]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= most:
            yield emit()
            parent = {}
    yield emit()


#: Links of a task that makes stars of them.
STAR_ROWS = 1 << 16


def _starred(links: DataFrame, rows: int) -> DataFrame:
    """The links as stars: each task's share of them, which is bounded, is joined up before any shuffle."""
    return written(links.coalesce(max(1, -(-rows // STAR_ROWS))).mapInArrow(stars, "a long, b long"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in links(a, b): the smallest id that it can reach.

    Each task's share of the links is made stars first, which is all there is to do where one task's share holds them all. Then
    large-star and small-star steps alternate; each round's links are a written table, and no step gathers a component anywhere.
    Links are pre-aggregated and de-duplicated, so a hot node has one row per neighbour that remains, and stars shrink every round.
    """
    once = written(links.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
    rows = once.count()
    now = _starred(once, rows)
    seen = None
    for _ in range(most_rounds if rows > STAR_ROWS else 0):
        both = now.unionByName(now.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: a's larger neighbours go to a's least
        large = both.join(least, "a").where("b > a").selectExpr("b a", "m b").distinct()
        # small star: a's smaller neighbours and a itself go to the least of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").selectExpr("b a", "m b").where("a <> b").unionByName(small_least.selectExpr("a", "m b")).distinct()
        before, now = now, _starred(small, rows)
        discard(before)
        mark = (rows := now.count(), now.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0])
        if mark == seen:
            break
        seen = mark
    else:
        if rows > STAR_ROWS:
            raise RuntimeError("components did not settle")
    ends = now.selectExpr("b id", "b component").distinct()
    return now.selectExpr("a id", "b component").unionByName(ends)
