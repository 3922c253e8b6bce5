"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected at random to eight dimensions in several tables and decoded to points of the E8
lattice. A vector is at home in its point's cell and probes the cells of the next nearest points. What meets in cells
are ids with a sketch of 128 signs, never vectors; pairs of which the sketches are near enough fetch their two vectors once
and are compared by cosine in double precision. Cells with many such pairs, as a large group of near copies makes, are dealt
out in pairs of blocks instead; there links are counted where they are found, each pair in the first cell that it shares, and
only a spanning forest of them is given out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workmap.llm.common import U, components, mix, parts_for, runs, table, written

#: Tables, cells probed besides the home cell, width of the projection in units of the lattice.
TABLES, PROBES, WIDTH = 10, 3, 1.3
#: Signs in which sketches of a pair may differ: 18 of 128 do at cosine 0.9 and over 38 in one pair of two million; of unrelated vectors 64 do.
APART = 38
#: Rows of a cell that are compared in its task, pairs a row above which a cell counts as dense, rows of a block of a dense cell.
CELL_ROWS, DENSE, BLOCK = 1 << 15, 16, 1024


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: (±1, ±1, 0^6) in any order, and (±1/2)^8 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        signs = np.array([1 - 2 * (bits >> k & 1) for k in range(8)])
        if signs.prod() == 1:
            out.append(signs / 2)
    return np.array(out)


ROOTS = roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points of D8 (integers with an even sum): round, then turn the worst place if the sum is odd."""
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    k = np.abs(off[odd]).argmax(1)
    r[odd, k] += np.where(off[odd, k] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 + 1/2."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Cells:
    """Cell keys of unit vectors."""

    def __init__(self, dims: int, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, seed: int = 8):
        self.tables, self.probes = tables, probes
        self.planes = np.random.default_rng(seed).standard_normal((dims, tables * 8)) / width

    @staticmethod
    def _key(points: np.ndarray, t: int) -> np.ndarray:
        h = np.full(points.shape[:-1], t + 1, U)
        for k in range(8):
            h = mix(h * U(0x9E3779B97F4A7C15) + np.rint(2 * points[..., k]).astype(np.int64).astype(U))
        return h

    def keys(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(home key, probed keys) in table t: the probed cells are those of the neighbouring lattice points nearest to the projection."""
        y = x @ self.planes[:, 8 * t : 8 * t + 8]
        home = decode(y)
        # |y - home - root|^2 = |y - home|^2 - 2 (y - home) root + 2 for every root
        near = np.argpartition(-((y - home) @ ROOTS.T), self.probes, axis=1)[:, : self.probes] if self.probes else np.zeros((len(x), 0), int)
        return self._key(home, t), self._key(home[:, None, :] + ROOTS[near], t)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def _spread(cells: Cells, dims: int):
    """(cell, slot, id, s0, s1): slot says in which table a vector has the cell, and whether as its home (the first of the table's slots)."""
    each = 1 + cells.probes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(3), dims)
            for t in range(cells.tables):
                home, probed = cells.keys(x, t)
                key = np.concatenate([home[:, None], probed], 1).ravel().view(np.int64)
                at = pa.array(np.repeat(np.arange(batch.num_rows), each))
                slot = np.tile(np.arange(t * each, (t + 1) * each, dtype=np.int32), batch.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(slot), *(batch.column(k).take(at) for k in (0, 1, 2))], names=["cell", "slot", "id", "s0", "s1"])

    return run


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many signs each sketch of a (two numbers each) differs from each of b."""
    return np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.int16) + np.bitwise_count(a[:, None, 1] ^ b[None, :, 1])


def _sweep(each: int, apart: int, cell_rows: int, dense: int, chunk: int = 512):
    """Cells one after another, in partitions sorted by cell: pairs (a, b) whose sketches are near, or the rows (a, cell, slot) of a dense cell.

    A cell of more rows than cell_rows is dense; its rows go on as they come, so no task holds more.
    """

    def near(home: np.ndarray, ids: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        order = np.argsort(~home, kind="stable")
        n_home, ids, sketch = int(home.sum()), ids[order], sketch[order]
        found_a, found_b, many = [], [], 0
        for i in range(0, n_home, chunk):
            for j in range(i, len(ids), 8 * chunk):
                p, q = np.nonzero(_apart(sketch[i : min(i + chunk, n_home)], sketch[j : j + 8 * chunk]) <= apart)
                p, q = p + i, q + j
                keep = (p < q) & (ids[p] != ids[q])
                found_a.append(ids[p[keep]])
                found_b.append(ids[q[keep]])
                many += len(found_a[-1])
            if many > dense * len(ids):
                return None
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        return np.minimum(a, b), np.maximum(a, b)

    def rows(a, b, cell, slot) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(cell, pa.int64()), pa.array(slot, pa.int32())], names=["a", "b", "cell", "slot"])

    def dense_rows(t: pa.Table) -> pa.RecordBatch:
        return rows(t.column("id").combine_chunks(), [None] * t.num_rows, t.column("cell").combine_chunks(), t.column("slot").combine_chunks())

    def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, slot, ids = (np.asarray(t.column(c)) for c in ("cell", "slot", "id"))
        sketch = np.stack([np.asarray(t.column(c)).view(U) for c in ("s0", "s1")], 1)
        at = runs(cell)
        homes = np.add.reduceat((slot % each == 0).astype(np.int64), at[:-1])
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.flatnonzero((np.diff(at) > 1) & (homes > 0)).tolist():
            s = slice(at[k], at[k + 1])
            pairs = near(slot[s] % each == 0, ids[s], sketch[s])
            if pairs is None:
                yield dense_rows(t.slice(at[k], at[k + 1] - at[k]))
            else:
                out_a.append(pairs[0])
                out_b.append(pairs[1])
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        yield rows(a, b, [None] * len(a), [None] * len(a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n_held, open_cell = 0, None  # the cell whose rows go on as they come
        for batch in batches:
            cell = np.asarray(batch.column(0))
            if open_cell is not None and len(cell):
                go = int(np.searchsorted(cell != open_cell, True))
                if go:
                    yield dense_rows(pa.Table.from_batches([batch.slice(0, go)]))
                if go < len(cell):
                    open_cell = None
                batch = batch.slice(go)
            if not batch.num_rows:
                continue
            held.append(batch)
            n_held += batch.num_rows
            if n_held < cell_rows:
                continue
            t = pa.Table.from_batches(held)
            at = runs(np.asarray(t.column("cell")))
            if len(at) > 2:  # all cells but the last are whole
                yield from whole(t.slice(0, at[-2]))
            last = t.slice(at[-2])
            if last.num_rows >= cell_rows:
                yield dense_rows(last)
                open_cell, held, n_held = int(last.column("cell")[0].as_py()), [], 0
            else:
                held, n_held = last.combine_chunks().to_batches(), last.num_rows
        if n_held:
            yield from whole(pa.Table.from_batches(held))

    return run


def _verify(dims: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch.column(2), dims), _matrix(batch.column(3), dims)
            near = np.flatnonzero(np.einsum("ij,ij->i", x, y) >= least) if batch.num_rows else []
            yield batch.select([0, 1]).take(pa.array(near, pa.int64()))

    return run


def _compare(cells: Cells, dims: int, least: float):
    """Links of a pair of blocks of a dense cell, counted where they are found: rows (id, links, other), of which `other` belongs to a spanning forest.

    A pair counts in the first dense cell that it shares with either at home: lowest table, then lowest key.
    """
    each = 1 + cells.probes

    def keys(x: np.ndarray, mask: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of a table's slots, and which of them are of dense cells."""
        home, probed = cells.keys(x, t)
        own = np.concatenate([home[:, None], probed], 1)
        return own, (mask[:, None] >> np.arange(t * each, (t + 1) * each)) & 1 == 1

    def first(x: np.ndarray, mask: np.ndarray, a: np.ndarray, b: np.ndarray, t: int, cell: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for s in range(t + 1):
            own, dense = keys(x, mask, s)
            lowest, met = np.full(len(a), ~U(0)), np.zeros(len(a), bool)
            for i in range(each):
                for j in range(each):
                    if i and j:
                        continue  # neither is at home
                    both = dense[a, i] & dense[b, j] & (own[a, i] == own[b, j])
                    met |= both
                    lowest = np.where(both, np.minimum(lowest, own[a, i]), lowest)
            out &= ~met if s < t else lowest == cell
        return out

    def run(t: pa.Table) -> pa.Table:
        block, side, slot, ids, copies, mask = (np.asarray(t.column(c)) for c in ("i", "block", "slot", "id", "copies", "mask"))
        x, cell, same = _matrix(t.column("unit"), dims), np.asarray(t.column("cell")).view(U), np.asarray(t.column("j")) == block
        order = np.lexsort((side, np.asarray(t.column("j")), block, cell))
        key = np.stack([cell, block.astype(U), np.asarray(t.column("j")).astype(U)], 1)[order]
        at = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)]
        out: list[list] = [[], [], []]
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = order[lo:hi]
            if same[own[0]]:
                left = right = own
            else:
                left, right = own[side[own] == block[own]], own[side[own] != block[own]]
            if not len(left) or not len(right):
                continue
            p, q = np.nonzero(x[left] @ x[right].T >= least)
            a, b = left[p], right[q]
            keep = ((slot[a] % each == 0) | (slot[b] % each == 0)) & (ids[a] != ids[b]) & (~same[own[0]] | (ids[a] < ids[b]))
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            ia, ib = back[: len(a)], back[len(a) :]
            keep = first(x[used], mask[used], ia, ib, int(slot[own[0]]) // each, cell[a])
            ia, ib = ia[keep], ib[keep]
            links = np.bincount(ia, copies[used][ib], len(used)) + np.bincount(ib, copies[used][ia], len(used))
            some = np.flatnonzero(links)
            out[0] += ids[used][some].tolist()
            out[1] += links[some].astype(np.int64).tolist()
            out[2] += [None] * len(some)
            parent = np.arange(len(used))

            def top(k, parent=parent):
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            # one link a row suffices for most of the forest; the rest are looked through in order
            for u, v in zip(ia.tolist(), ib.tolist(), strict=True):
                u, v = top(u), top(v)
                if u != v:
                    parent[u] = v
                    out[0].append(int(ids[used][u]))
                    out[1].append(0)
                    out[2].append(int(ids[used][v]))
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["id", "links", "other"])

    return run


def _of_length(clean: DataFrame, dims: int, least: float, tables: int, probes: int, width: float, apart: int, cell_rows: int, dense: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unit vectors, classes of equal ones, and links found (id, links, other) of vectors that all have one length."""
    signs = np.random.default_rng(64).standard_normal((dims, 128))

    def unit(batches):
        for batch in batches:
            v = batch.column(1)
            x = np.asarray(v.flatten(), float).reshape(-1, dims)
            x = x / np.abs(x).max(1, keepdims=True)
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "unit"])

    def sketch(batches):
        for batch in batches:
            bits = np.packbits(_matrix(batch.column(2), dims) @ signs > 0, axis=1).view(np.int64).reshape(-1, 2) if batch.num_rows else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(bits[:, k].copy()) for k in (0, 1)), batch.column(2), batch.column(1), batch.column(3)], names=["id", "s0", "s1", "unit", "copies", "key"])

    spark = clean.sparkSession
    units = clean.mapInArrow(unit, "vec_id long, unit binary").withColumn("key", F.md5("unit"))
    grouped = units.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("unit").alias("unit"))
    classes = written(grouped.select("id", "copies", "unit", "key").mapInArrow(sketch, "id long, s0 long, s1 long, unit binary, copies long, key string"))
    cells = Cells(dims, tables, probes, width)
    each = 1 + probes
    n_parts = parts_for(spark, classes.count() * tables * each * 32, 16 << 20)
    spread = classes.select("id", "s0", "s1", "unit").mapInArrow(_spread(cells, dims), "cell long, slot int, id long, s0 long, s1 long")
    swept = written(spread.repartition(n_parts, "cell").sortWithinPartitions("cell").mapInArrow(_sweep(each, apart, cell_rows, dense), "a long, b long, cell long, slot int"))
    vectors = classes.select("id", "unit", "copies")
    # pairs of sketches that are near: each fetches its vectors once
    pairs = swept.where("cell is null").select("a", "b").distinct()
    fetched = pairs.join(vectors.select(F.col("id").alias("a"), F.col("unit").alias("u")), "a").join(vectors.select(F.col("id").alias("b"), F.col("unit").alias("v")), "b").select("a", "b", "u", "v")
    links = written(fetched.mapInArrow(_verify(dims, least), "a long, b long"))
    # dense cells in pairs of blocks
    rows = swept.where("cell is not null").select(F.col("a").alias("id"), "cell", "slot")
    masks = rows.groupBy("id").agg(F.expr("bit_or(shiftleft(1L, slot))").alias("mask"), F.collect_list(F.struct("cell", "slot")).alias("cells"))
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    dealt = rows.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("cell", "slot", "id", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j")).join(masks.select("id", "mask"), "id").join(vectors, "id")
    room = F.pmod(F.xxhash64("cell", "i", "j"), F.lit(1 << 20)).cast("int")
    counted = dealt.withColumn("room", room).groupBy("room").applyInArrow(_compare(cells, dims, least), "id long, links long, other long")
    # a pair that shares a dense cell is counted there
    held = masks.select("id", "cells")
    both = links.join(held.select(F.col("id").alias("a"), F.col("cells").alias("x")), "a").join(held.select(F.col("id").alias("b"), F.col("cells").alias("y")), "b")
    shared = both.where(F.exists("x", lambda p: F.exists("y", lambda q: (p["cell"] == q["cell"]) & ((p["slot"] % each == 0) | (q["slot"] % each == 0))))).select("a", "b")
    single = written(links.join(shared, ["a", "b"], "left_anti"))
    copies = classes.select("id", "copies")
    ways = single.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(single.select(F.col("b").alias("id"), F.col("a").alias("other")))
    of_pairs = ways.join(copies.select(F.col("id").alias("other"), "copies"), "other").select("id", F.col("copies").alias("links"), "other")
    return units.select("vec_id", "key"), classes.select("id", "copies", "key"), counted.unionByName(of_pairs)


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.9,
    tables: int = TABLES,
    probes: int = PROBES,
    width: float = WIDTH,
    apart: int = APART,
    cell_rows: int = CELL_ROWS,
    dense: int = DENSE,
    block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links, component_id of each row of vectors(vec_id, embedding): links are pairs found with cosine of `least` or more.

    Equal vectors are one class and count as linked with each other. Vectors that are null, zero, or hold null or non-finite
    components link with nothing, vectors of one length only with each other. Rows with equal ids are one vector each
    but one node of a component. A row without an id takes no part. Other columns aren't read. cell_rows, dense and block
    steer costs and never results; tables * (1 + probes) is at most 64.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))) & F.exists("v", lambda c: c != 0)
    clean = rows.where(F.coalesce(good, F.lit(False)))
    lengths = clean.groupBy(F.size("v").alias("n")).count().where("count > 1").orderBy("n").collect()
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    each = [_of_length(clean.where(F.size("v") == x.n), x.n, least, tables, probes, width, apart, cell_rows, dense, block) for x in lengths]
    units, classes, found = (reduce(DataFrame.unionByName, x) for x in zip(*each, strict=True))
    found = written(found)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.where("other is not null").selectExpr("id a", "other b"))
    of_class = classes.join(links, "id", "left").join(comps, "id", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    of_row = units.join(of_class, "key").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return rows.select("vec_id").join(of_row, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


ORACLE = """
with recursive v as (select vec_id, embedding::double[] e from embeddings where embedding is not null),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) s from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
l as (select a.vec_id a, b.vec_id b from n a join n b on a.vec_id <> b.vec_id where a.s > 0 and b.s > 0 and list_dot_product(a.e, b.e) / (a.s * b.s) >= 0.9),
r as (select vec_id, vec_id c from embeddings union select l.a, r.c from r join l on l.b = r.vec_id)
select e.vec_id, (select count(*) from l where l.a = e.vec_id)::bigint n_links, min(r.c) component_id, e.vec_id = min(r.c) kept
from embeddings e join r using (vec_id) group by 1
"""
