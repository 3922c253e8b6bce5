"""Jaccard join of documents on word shingles with a token-group matrix.

Documents with equal shingle sets are one class. Classes are first put into groups of likely similar ones
(by the minima of hashed shingles), in which links join them into components. Blocks of a component's
classes, and of classes by themselves that have a widely shared shingle in common, are then the groups of the matrix: a
query class goes to the groups that enough of its rarest shingles occur in, each group's union of shingles
bounds the overlap that the query can have with any member, and only groups whose bound reaches the threshold
are opened and their members compared. Pairs inside a component need no comparing, so nothing is emitted for
the pairs of a large group of copies, and a passage that many documents share costs one row a query and group.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workmap.llm.common import Slices, U, Words, ascii_lower, blocks, components, mix, pack, parts_for, runs, table, text_bytes, utf8, written

#: Words of a shingle; the threshold as a fraction.
WIDTH, LEAST = 5, (4, 5)
#: Minima that a class may be grouped by; classes of a first group, of a group of the matrix and of its queries at a time; counters of the frequency sketch.
HOMES, HOME_ROWS, GROUP_ROWS, QUERY_ROWS, COUNTERS = 3, 1000, 256, 128, 1 << 20
#: Leaders that a first group tries before it leaves what is apart to the matrix.
LEADERS = 48
_SEEDS = [U(0x243F6A8885A308D3), U(0x13198A2E03707344), U(0xA4093822299F31D0)]

#: The filter that says which classes a pass over the texts may leave out: bits a key, least and most bits; past the most it leaves out less and never too much.
BITS_A_KEY, LEAST_BITS, MOST_BITS, PIECES = 16, 1 << 16, 1 << 28, 64

SKETCH = "doc_id long, n long, class long, homes array<long>"
SEAT = "bucket int, home long, sub int, class long, shingles binary"


def needed(n, least: tuple[int, int] = LEAST):
    """The smallest overlap that a set of n shingles can have with a linked one."""
    return -(-n * least[0] // least[1])


def common(n):
    """How many of its prefix's shingles a set of n shares with the prefix of a linked set of the same size, at least."""
    return 1 + n // 10


def prefix_size(n: int, least: tuple[int, int] = LEAST) -> int:
    return min(n, n - needed(n, least) + common(n))


def size_step(least: tuple[int, int] = LEAST) -> float:
    """The logarithm of the width of a size range, so wide that linked sets are at most two ranges apart: a little over half of the greatest ratio of their sizes."""
    return 0.55 * math.log(least[1] / least[0])


def linked(both, a, b, least: tuple[int, int] = LEAST):
    return least[1] * both >= least[0] * (a + b - both)


class Sets:
    """The shingle sets of some texts: sorted distinct hashes, one text after another."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        words = Words(ascii_lower(data), offsets)
        counts = np.diff(words.first)
        h, at = words.windows(width)
        doc = np.searchsorted(words.first, at, side="right") - 1
        bounds = np.searchsorted(doc, np.arange(len(counts) + 1))
        short = np.flatnonzero((counts > 0) & (counts < width))
        whole = dict(zip(short.tolist(), Slices(words.hashes()).of(words.first[short], words.first[short + 1]), strict=True)) if len(short) else {}
        parts = []
        for k in range(len(counts)):
            if k in whole:
                parts.append(np.array([whole[k]], U))
                continue
            s = np.sort(h[bounds[k] : bounds[k + 1]])
            parts.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s)
        self.size = np.array([len(p) for p in parts], np.int64)
        self.hashes = np.concatenate(parts) if parts else np.zeros(0, U)
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def of(self, k: int) -> np.ndarray:
        return self.hashes[self.first[k] : self.first[k + 1]]


def _counter(width: int, block_bytes: int):
    """Counts shingles (by document) in hashed counters: one compressed array for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in blocks(offsets, block_bytes):
                s = Sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                total += np.bincount((s.hashes & U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.int32)
        yield from _pieces(total)

    return run


def _pieces(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = COUNTERS // PIECES
    for k in range(PIECES):
        piece = total[k * step : (k + 1) * step]
        if piece.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(pack(piece), 1)], pa.binary())], names=["piece", "counts"])


def counters(pieces: DataFrame) -> np.ndarray:
    """Sums of the tasks' counters: COUNTERS numbers, whatever the corpus."""
    total = np.zeros(COUNTERS, np.int64)
    step = COUNTERS // PIECES
    for r in pieces.groupBy("piece").applyInArrow(_add, "piece int, counts binary").collect():
        total[r.piece * step : (r.piece + 1) * step] = np.frombuffer(r.counts, np.int64)
    return total


def _add(t: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // PIECES, np.int64)
    for x in t.column("counts"):
        total += np.frombuffer(zlib.decompress(x.as_py()), np.int32)
    return pa.table([t.column("piece")[:1], pa.array([pack(total)], pa.binary())], names=["piece", "counts"])


def heaviness(docs: DataFrame, width: int, block_bytes: int) -> np.ndarray:
    """For each of COUNTERS hashed counters, how many doublings its load is above what chance gives around the mean."""
    total = counters(docs.mapInArrow(_counter(width, block_bytes), "piece int, counts binary"))
    bar = max(16.0, total.mean() + 6.0 * np.sqrt(total.mean()))
    return np.clip(np.ceil(np.log2(np.maximum(total, 1) / bar)), 0, 60).astype(np.uint8)


class _Classes:
    """The class of each text of a block (a digest of its set) and the minima that it may be grouped by."""

    def __init__(self, s: Sets):
        n = s.size
        self.some = np.flatnonzero(n)
        at = s.first[self.some]
        self.digest = np.zeros(len(n), U)
        self.homes = np.zeros((len(n), HOMES), U)
        if len(self.some):
            h = s.hashes
            self.digest[self.some] = mix(np.add.reduceat(mix(h ^ _SEEDS[0]), at) ^ mix(np.bitwise_xor.reduceat(mix(h ^ _SEEDS[1]), at)) ^ n[self.some].astype(U))
            for j in range(HOMES):
                self.homes[self.some, j] = np.minimum.reduceat(h if j == 0 else mix(h ^ _SEEDS[j]), at) ^ U(j)


def _sets(batch: pa.RecordBatch, width: int, block_bytes: int) -> Iterator[tuple[int, int, Sets, _Classes]]:
    data, offsets = utf8(batch.column(1))
    for a, b in blocks(offsets, block_bytes):
        s = Sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
        yield a, b, s, _Classes(s)


def _sketcher(width: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s, c in _sets(batch, width, block_bytes):
                homes = pa.array(list(c.homes.view(np.int64)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(s.size), pa.array(c.digest.view(np.int64)), homes], names=["doc_id", "n", "class", "homes"])

    return run


def _prefixer(width: int, least: tuple[int, int], heavy: np.ndarray, chosen: np.ndarray, block_bytes: int):
    """(token, class): the rarest shingles of each class of a block, so many that linked sets have `common` of them in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            for a, b, s, c in _sets(batch, width, block_bytes):
                rank = (heavy[(s.hashes & U(COUNTERS - 1)).astype(np.int64)].astype(U) << U(57)) | (s.hashes >> U(7))
                prefixes, classes = [np.zeros(0, U)], [np.zeros(0, U)]
                for k in _passed(c, _ids(batch, a, b), chosen).tolist():
                    own, n = s.of(k), int(s.size[k])
                    p = prefix_size(n, least)
                    prefixes.append(own[np.argpartition(rank[s.first[k] : s.first[k + 1]], p - 1)[:p]] if p < n else own)
                    classes.append(np.full(len(prefixes[-1]), c.digest[k]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (prefixes, classes)], names=["token", "class"])

    return run


def _bits(n_bits: int):
    step = n_bits // PIECES

    def run(t: pa.Table) -> pa.Table:
        bits = np.zeros(step, bool)
        bits[np.asarray(t.column("bit")) % step] = True
        return pa.table([t.column("piece")[:1], pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["piece", "bits"])

    return run


def class_filter(classes: DataFrame, key: str = "class") -> np.ndarray:
    """A bit for each hashed key: BITS_A_KEY for each of the rows, between LEAST_BITS and MOST_BITS."""
    n_bits = min(max(LEAST_BITS, 1 << (BITS_A_KEY * max(1, classes.count()) - 1).bit_length()), MOST_BITS)
    step = n_bits // PIECES
    bit = classes.select(F.pmod(F.expr(key), F.lit(n_bits)).cast("long").alias("bit")).distinct()
    pieces = bit.withColumn("piece", F.floor(F.col("bit") / step).cast("int")).groupBy("piece").applyInArrow(_bits(n_bits), "piece int, bits binary")
    out = np.zeros(n_bits // 8, np.uint8)
    for r in pieces.collect():
        out[r.piece * step // 8 : (r.piece + 1) * step // 8] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return out


def _may_be(filter_: np.ndarray, digest: np.ndarray) -> np.ndarray:
    at = digest.view(np.int64) % (8 * len(filter_))
    return (filter_[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _ids(batch: pa.RecordBatch, a: int, b: int) -> np.ndarray:
    return np.asarray(batch.column(0)[a:b]).astype(np.int64)


def _passed(c: _Classes, ids: np.ndarray, chosen: np.ndarray, filter_: np.ndarray | None = None) -> np.ndarray:
    """Of the texts of a block that represent their classes, by the filter of pairs of class and id, one for each class that the other filter lets through."""
    rows = c.some[_may_be(chosen, c.digest[c.some] ^ ids[c.some].view(U))]
    if filter_ is not None:
        rows = rows[_may_be(filter_, c.digest[rows])]
    _, once = np.unique(c.digest[rows], return_index=True)
    return rows[once]


def _set_maker(width: int, filter_: np.ndarray, chosen: np.ndarray, block_bytes: int):
    """(class, shingles) of the classes that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            for a, b, s, c in _sets(batch, width, block_bytes):
                rows = _passed(c, _ids(batch, a, b), chosen, filter_)
                yield pa.RecordBatch.from_arrays([pa.array(c.digest[rows].view(np.int64)), pa.array([pack(s.of(k)) for k in rows.tolist()], pa.binary())], names=["class", "shingles"])

    return run


def _seater(width: int, filter_: np.ndarray, chosen: np.ndarray, popular: np.ndarray, buckets: int, home_rows: int, block_bytes: int):
    """Seats of the classes that the filter lets through: in the most popular of their homes, a large home in several rooms, some of its classes in all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            for a, b, s, c in _sets(batch, width, block_bytes):
                rows = _passed(c, _ids(batch, a, b), chosen, filter_)
                load = popular[(c.homes[rows] & U(COUNTERS - 1)).astype(np.int64)]
                best = load.argmax(1)
                home, load = c.homes[rows, best], load[np.arange(len(rows)), best]
                out: list[list] = [[], [], [], [], []]
                for k, h, n in zip(rows.tolist(), home.tolist(), load.tolist(), strict=True):
                    if n < 2:
                        continue
                    rooms = -(-n // home_rows)
                    mine = int(mix(c.digest[k : k + 1])[0])
                    for room in range(rooms) if rooms > 1 and mine % max(1, n // 4) == 0 else (mine % rooms,):
                        spread = int(mix(np.array([h ^ room * 0x9E3779B9], U))[0])
                        for column, value in zip(out, (spread % buckets, h, room, int(c.digest[k]), pack(s.of(k))), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), pa.array(np.array(out[1], U).view(np.int64)), pa.array(out[2], pa.int32()), pa.array(np.array(out[3], U).view(np.int64)), pa.array(out[4], pa.binary())],
                    names=["bucket", "home", "sub", "class", "shingles"],
                )

    return run


def _home_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int32)
    for batch in batches:
        home = np.asarray(batch.column(0).flatten()).view(U)
        total += np.bincount((home & U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.int32)
    yield from _pieces(total)


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))
        self.parts = n

    def top(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parts -= 1
        return True


def _joined_homes(least: tuple[int, int]):
    """Links inside first groups: leaders are compared with all members that are not joined to them yet."""

    def of_group(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        n = len(ids)
        size = np.array([len(s) for s in sets], np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        everything = np.concatenate(sets)
        u, links = _Union(n), []
        order = np.argsort(size, kind="stable")[::-1].tolist()
        for leader in order[: LEADERS if n > LEADERS else n]:
            if u.parts == 1:
                break
            own = sets[leader]
            place = np.searchsorted(own, everything)
            both = np.add.reduceat((own[np.minimum(place, len(own) - 1)] == everything).astype(np.int64), at[:-1])
            for k in np.flatnonzero(linked(both, size, size[leader], least)).tolist():
                if k != leader and u.join(leader, k):
                    links.append((int(ids[leader]), int(ids[k])))
        return links

    def run(t: pa.Table) -> pa.Table:
        key = np.asarray(t.column("home")).astype(U) ^ mix(np.asarray(t.column("sub")).astype(U))
        ids, raw = np.asarray(t.column("class")), t.column("shingles").to_pylist()
        order = np.argsort(key, kind="stable")
        at = runs(key[order])
        links: list[tuple[int, int]] = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a > 1:
                own = order[a:b]
                links += of_group(ids[own], [np.frombuffer(raw[k], U) for k in own.tolist()])
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return run


def _opened_groups(least: tuple[int, int]):
    """Links between queries and the members of the groups that they are sent to; rows (bucket, grp, is_query, class, shingles).

    Of a group's links a spanning forest is given, so there are fewer than its members and queries.
    """

    def run(t: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        group, ids, ask = np.asarray(t.column("grp")), np.asarray(t.column("class")), np.asarray(t.column("is_query"))
        sets = t.column("shingles").to_pylist()
        order = np.lexsort((ask, group))
        at = runs(group[order])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = order[a:b]
            members, queries = own[~ask[own]], own[ask[own]]
            if not len(members) or not len(queries):
                continue
            shingles = [np.frombuffer(sets[k], U) for k in members.tolist()]
            size = np.array([len(s) for s in shingles], np.int64)
            everything = np.concatenate(shingles)
            starts = np.concatenate([[0], np.cumsum(size)])[:-1]
            union = np.unique(everything)
            place_of = {x: k for k, x in enumerate(np.unique(ids[own]).tolist())}
            forest = _Union(len(place_of))
            for q in queries.tolist():
                query = np.frombuffer(sets[q], U)
                place = np.minimum(np.searchsorted(union, query), len(union) - 1)
                if (union[place] == query).sum() < needed(len(query), least):
                    continue  # no member can be linked: the group stays closed
                place = np.minimum(np.searchsorted(query, everything), len(query) - 1)
                both = np.add.reduceat((query[place] == everything).astype(np.int64), starts)
                mine = int(ids[q])
                for k in np.flatnonzero(linked(both, size, len(query), least)).tolist():
                    other = int(ids[members[k]])
                    if forest.join(place_of[mine], place_of[other]):
                        links.append((mine, other))
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return run


def _shared(t: pa.Table) -> pa.Table:
    """(token, class, weight, holders, lead) where several classes have a token, with their number and the first of them; tokens that the same classes have are one, with their number as its weight."""
    tokens, classes = np.asarray(t.column("token")), np.asarray(t.column("class"))
    order = np.lexsort((classes, tokens))
    tokens, classes = tokens[order], classes[order]
    once = np.r_[True, (tokens[1:] != tokens[:-1]) | (classes[1:] != classes[:-1])] if len(tokens) else np.zeros(0, bool)
    tokens, classes = tokens[once], classes[once]
    at = runs(tokens)
    n = np.diff(at)
    if not len(tokens):
        return pa.table([pa.array([], pa.int64())] * 5, names=["token", "class", "weight", "holders", "lead"])
    lists = mix(np.add.reduceat(mix(classes.astype(U) ^ _SEEDS[0]), at[:-1]) ^ n.astype(U))
    _, first, weight = np.unique(lists, return_index=True, return_counts=True)
    keep, weights = np.zeros(len(n), bool), np.zeros(len(n), np.int64)
    keep[first], weights[first] = True, weight
    keep &= n > 1
    some = np.repeat(keep, n)
    of_token = (lists.view(np.int64), weights, n.astype(np.int64), classes[at[:-1]])
    token, weight, holders, lead = (np.repeat(x, n)[some] for x in of_token)
    return pa.table([pa.array(c) for c in (token, classes[some], weight, holders, lead)], names=["token", "class", "weight", "holders", "lead"])


def _asked(query_rows: int):
    def run(t: pa.Table) -> pa.Table:
        return _sent(t, query_rows)

    return run


def _sent(t: pa.Table, query_rows: int) -> pa.Table:
    """Which classes ask which groups, by the tokens of a bucket: rows (token, is_query, class, weight, comp, rows, grp, span).

    Of two components the smaller one's classes ask (of equal ones the first): a class asks a group if one of the group's
    classes with the token has a larger component than its own, and sizes are near enough.
    """
    columns = [np.asarray(t.column(c)) for c in ("token", "is_query", "class", "weight", "comp", "rows", "grp", "span")]
    order = np.lexsort((columns[1], columns[0]))
    token, ask, cls, weight, comp, rows, grp, span = (x[order] for x in columns)
    at = runs(token)
    n_groups = np.add.reduceat((~ask).astype(np.int64), at[:-1]) if len(token) else np.zeros(0, np.int64)
    queries, groups, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b, k in zip(at[:-1].tolist(), at[1:].tolist(), n_groups.tolist(), strict=True):
        theirs = slice(a, a + k)
        for x in range(a + k, b, query_rows):
            mine = slice(x, min(x + query_rows, b))
            c, n = comp[mine, None], rows[mine, None]
            larger = (rows[theirs] > n) | ((rows[theirs] == n) & (comp[theirs] > c))
            q, g = np.nonzero(larger & (comp[theirs] != c) & (np.abs(span[theirs] - span[mine, None]) <= 2))
            queries.append(cls[mine][q])
            groups.append(grp[theirs][g])
            weights.append(np.full(len(q), weight[a]))
    q, g, w = np.concatenate(queries), np.concatenate(groups), np.concatenate(weights)
    order = np.lexsort((g, q))
    q, g, w = q[order], g[order], w[order]
    at = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (g[1:] != g[:-1])]) if len(q) else np.zeros(0, np.int64)
    return pa.table([pa.array(q[at]), pa.array(g[at]), pa.array(np.add.reduceat(w, at) if len(at) else w)], names=["class", "grp", "tokens"])



def join(
    docs: DataFrame,
    width: int = WIDTH,
    least: tuple[int, int] = LEAST,
    block_bytes: int = 2 << 20,
    part_bytes: int = 12 << 20,
    home_rows: int = HOME_ROWS,
    group_rows: int = GROUP_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs(doc_id, text): documents linked directly or through others.

    Words are runs of other than ASCII white space, A-Z lower-cased; a set holds the distinct runs of `width` words, or the
    whole text's words where it has fewer. Two documents link when the shared share of their union is `least` or more. Null
    texts and those without words have empty sets and link with nothing. Rows with one id are one node; a row without an id
    links with nothing and has no component. Sets are compared by 64-bit hashes. Other columns aren't read. The numbers of
    rows (of a home's room, a group, a room of queries) steer costs and never results.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_bytes = text_bytes(source)
    buckets = parts_for(spark, n_bytes, part_bytes)
    heavy = heaviness(source, width, block_bytes)
    sketch = written(source.mapInArrow(_sketcher(width, block_bytes), SKETCH))
    full = sketch.where("n > 0 and doc_id is not null")
    # the text with the smallest id represents its class, so that copies aren't sent again from every block
    classes = written(full.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("homes").alias("homes")))
    chosen = class_filter(classes, "class ^ doc_id")
    # shingles that several classes have among their rarest ones
    rare = source.mapInArrow(_prefixer(width, least, heavy, chosen, block_bytes), "token long, class long")
    rare = rare.groupBy(F.pmod("token", F.lit(buckets)).cast("int").alias("bucket")).applyInArrow(_shared, "token long, class long, weight long, holders long, lead long")
    found = written(rare.groupBy("token", "class").agg(F.sum("weight").alias("weight"), F.max("holders").alias("holders"), F.max("lead").alias("lead")))
    # a class that is linked has as much of its prefix in common with one other class, so at least as much with all others together
    enough = 1 + F.floor(F.ceil(F.col("n") * least[0] / least[1]) / 10)
    open_ = found.groupBy("class").agg(F.sum("weight").alias("tokens")).join(classes, "class").where(F.col("tokens") >= enough)
    sizes_of = written(open_.select("class", "n", "homes"))
    shared = written(found.join(sizes_of.select("class"), "class", "left_semi"))
    # first groups: the most popular of a class's minima, by counters of a fixed size
    popular = counters(sizes_of.select("homes").mapInArrow(_home_counter, "piece int, counts binary")).astype(np.int32)
    seated = source.mapInArrow(_seater(width, class_filter(sizes_of), chosen, popular, buckets, home_rows, block_bytes), SEAT)
    links = written(seated.groupBy("bucket").applyInArrow(_joined_homes(least), "a long, b long"))
    joined = components(links).withColumnsRenamed({"id": "class", "component": "comp"})
    placed = sizes_of.select("class", "n").join(joined, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    # the shingle that most classes share with a class: what a common passage brings together
    passage = shared.groupBy("class").agg(F.max(F.struct("holders", "token")).alias("top")).select("class", F.col("top.token").alias("passage"))
    placed = placed.join(passage, "class")
    # groups of the matrix: blocks of a component, or of what has a passage in common but no component, of one range of sizes
    placed = placed.withColumn("span", F.floor(F.log(F.col("n").cast("double")) / size_step(least)).cast("int"))
    sizes = placed.groupBy("comp").agg(F.count("*").alias("rows"))
    placed = written(placed.join(sizes, "comp").withColumn("place", F.when(F.col("rows") > 1, F.xxhash64("comp", "span")).otherwise(F.xxhash64("passage", "span", F.lit(0)))))
    many = placed.groupBy("place").agg(F.count("*").alias("mates"))
    placed = written(placed.join(many, "place").withColumn("grp", F.xxhash64("place", F.pmod(F.xxhash64("class"), F.ceil(F.col("mates") / group_rows)))).select("class", "n", "comp", "rows", "grp", "span"))
    postings = shared.join(placed.drop("n"), "class")
    # the token-group matrix holds the union of each group's rarest shingles; queries of a common token are dealt to rooms, and tokens of one passage (with one first class) meet in the same rooms
    rooms = F.pow(F.lit(2.0), F.ceil(F.log2(F.ceil(F.col("holders") / query_rows).cast("double")))).cast("int")
    matrix = written(postings.groupBy("token", "grp").agg(F.max(F.struct("rows", "comp", "span", "weight", "holders", "lead")).alias("best")).select("token", "grp", "best.*"))
    offers = matrix.withColumn("room", F.explode(F.sequence(F.lit(0), rooms - 1))).withColumn("class", F.lit(0).cast("long")).withColumn("is_query", F.lit(False))
    asks = postings.withColumn("room", F.pmod(F.xxhash64("class"), rooms).cast("int")).withColumn("is_query", F.lit(True))
    bucket = F.pmod(F.xxhash64("lead", "room"), F.lit(buckets)).cast("int")
    met = asks.unionByName(offers).select(bucket.alias("bucket"), "token", "is_query", "class", "weight", "comp", "rows", "grp", "span")
    # a query goes to a group whose union has enough of its prefix: what it must share with the smallest set that it can be linked with
    hits = met.groupBy("bucket").applyInArrow(_asked(query_rows), "class long, grp long, tokens long")
    bound = hits.groupBy("class", "grp").agg(F.sum("tokens").alias("tokens")).join(placed.select("class", "n"), "class")
    sent = written(bound.where(F.col("tokens") >= enough).select("class", "grp"))
    # only now, sets are sent: those of qualifying groups' members and of the queries that go to them
    members = placed.join(sent.select("grp").distinct(), "grp", "left_semi").select("class", "grp", F.lit(False).alias("is_query"))
    calls = written(members.unionByName(sent.select("class", "grp", F.lit(True).alias("is_query"))))
    sets = source.mapInArrow(_set_maker(width, class_filter(calls.select("class").distinct()), chosen, block_bytes), "class long, shingles binary")
    opened = calls.join(sets, "class").withColumn("bucket", F.pmod("grp", F.lit(buckets)).cast("int"))
    more = opened.groupBy("bucket").applyInArrow(_opened_groups(least), "a long, b long")
    # rows with one id in several classes are one node
    ids = full.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z")
    twice = ids.join(full.select("doc_id", F.col("class").alias("b")), "doc_id").select("a", "b")
    linked_ = components(links.unionByName(more).unionByName(twice)).withColumnsRenamed({"id": "class", "component": "comp"})
    of_class = classes.select("class", F.col("doc_id").alias("least")).join(linked_, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    smallest = of_class.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = of_class.join(smallest, "comp").select("class", "component_id")
    has_set = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    with_set = sketch.where(has_set).select("doc_id", "n", "class").join(named, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return with_set.unionByName(sketch.where(~F.coalesce(has_set, F.lit(False))).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


ORACLE = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else [array_to_string(w[k:k + 4], ' ') for k in range(1, len(w) - 3)] end) g from w),
n as (select doc_id, count(*) n from s group by 1),
o as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id, doc_id c from documents union select l.b, r.c from r join l on l.a = r.doc_id)
select w.doc_id, coalesce(n, 0)::bigint n_shingles, m.c component_id from w left join n using (doc_id) join (select doc_id, min(c) c from r group by 1) m using (doc_id)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
