"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon that is learnt from the labelled rows (words told apart from the
clean rows by more than chance), plain and after undoing usual obfuscations, their nearness to second-person
words, capitals, punctuation, obfuscation rates. The trees are fitted on a bounded sample of labelled rows;
scoring maps every row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workmap.llm.common import blocks, table, utf8

#: Most labelled rows that the lexicon and the trees are fitted on, and most terms of the lexicon.
SAMPLE_ROWS, LEXICON_WORDS = 20_000, 200
BLOCK_BYTES, SAMPLE_PARTS = 4 << 20, 12
THRESHOLD = 0.7

#: Words of the second person in the corpus' languages; characters that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine sie ihr euch tu te toi ton ta tes vous votre vos tú ti tu tus usted ustedes vosotros".split())
LOOKALIKES = str.maketrans("013457@$!|+", "oieastasiit")

_LETTERS = re.compile(r"[^\W\d_]+")
_INNER = re.compile(r"(?<=\w)[^\w\s]+(?=\w)")
_LOOKALIKE = re.compile(r"[013457@$!|+]")
_REPEAT = re.compile(r"(.)\1{2,}")
#: Lengths of the word beginnings that may stand in the lexicon, as stems of inflected forms.
STEMS = (4, 5, 6)
#: Strengths (log of 1 + the likelihood ratio statistic) above which hits are counted apart.
TIERS = (0.0, 4.5, 5.5)
NEAR = 5


def plain_words(token: str) -> list[str]:
    return _LETTERS.findall(token.lower())


def terms_of(word: str) -> list[str]:
    """A word, and its beginnings marked as such."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def undone(token: str) -> str:
    """A token with look-alikes put back, marks inside it dropped and long repeats shortened."""
    t = token.lower().strip(".,;:!?\"'()[]{}<>#%&*-_~=")
    return _REPEAT.sub(r"\1", _INNER.sub("", t.translate(LOOKALIKES)))


class Featurer(dict):
    """Features of texts for one lexicon. Maps tokens to rows of a table of what a token gives, made when it is first met."""

    def __init__(self, lexicon: dict[str, float], most_remembered: int = 300_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most_remembered
        self.rows: list[tuple] = []

    def strength(self, word: str) -> float:
        get = self.lexicon.get
        found = get(word, 0.0)
        for k in STEMS:
            if len(word) > k:
                found = max(found, get(word[:k] + "*", 0.0))
        return found

    def __missing__(self, token: str) -> int:
        """(strength, strength only once obfuscation is undone, second person, obfuscated look, capitals, letters, other characters, exclamation)."""
        core = token.strip(".,;:!?\"'()[]{}<>")
        words = [core.lower()] if core.isalpha() else plain_words(token)
        strength = max(map(self.strength, words), default=0.0)
        letters = sum(map(len, words))
        odd = letters > 0 and (bool(_REPEAT.search(core)) or not core.isalpha() and (bool(_LOOKALIKE.search(core, 1)) or bool(_INNER.search(core))))
        hidden = self.strength(undone(token)) if odd and not strength else 0.0
        self.rows.append((strength, hidden, any(w in SECOND_PERSON for w in words), odd, len(token) > 1 and token.isupper(), letters, len(token) - letters, "!" in token))
        self[token] = len(self.rows) - 1
        return len(self.rows) - 1

    def features(self, texts: list[str | None]) -> np.ndarray:
        """FEATURES numbers for each text; a null or empty text has zeros."""
        if len(self.rows) > self.most:
            self.clear()
            self.rows.clear()
        tokens = [(t or "").split() for t in texts]
        size = np.array([len(t) for t in tokens], np.int64)
        ids = np.fromiter((i for t in tokens for i in map(self.__getitem__, t)), np.int64, int(size.sum()))
        table = np.array(self.rows, np.float32).reshape(-1, 8)
        doc = np.repeat(np.arange(len(texts)), size)
        n = np.maximum(size, 1).astype(float)

        def per_doc(x: np.ndarray) -> np.ndarray:
            return np.bincount(doc, x, len(texts))

        plain, hidden = table[ids, 0], table[ids, 1]
        strength = np.maximum(plain, hidden)
        hit = np.flatnonzero(strength > 0)
        out = []
        for tier in TIERS:
            h = hit[strength[hit] > tier]
            pairs = np.unique(doc[h] * max(1, len(table)) + ids[h]) // max(1, len(table))
            out += [np.bincount(doc[h], minlength=len(texts)) / n, np.minimum(np.bincount(pairs.astype(np.int64), minlength=len(texts)), 30)]
        top = np.zeros(len(texts))
        np.maximum.at(top, doc[hit], strength[hit])
        you = np.flatnonzero(table[ids, 2] > 0)
        near = np.zeros(len(hit), bool)
        if len(you) and len(hit):
            for side in (np.searchsorted(you, hit) - 1, np.searchsorted(you, hit)):
                at = you[np.clip(side, 0, len(you) - 1)]
                near |= (np.abs(at - hit) <= NEAR) & (doc[at] == doc[hit])
        letters = per_doc(table[ids, 5])
        out += [top, per_doc(strength) / n, np.minimum(per_doc(hidden > 0), 30), np.bincount(doc[hit], near, len(texts)) / n, per_doc(table[ids, 2]) / n]
        out += [per_doc(table[ids, 3]) / n, per_doc(table[ids, 4]) / n, per_doc(table[ids, 6]) / np.maximum(letters, 1), per_doc(table[ids, 7]) / n, np.log1p(size)]
        x = np.stack(out, 1)
        x[size == 0] = 0.0
        return x


FEATURES = 2 * len(TIERS) + 10


# ---------------------------------------------------------------- trees
@dataclass
class Forest:
    """Trees of a fixed depth on cut features: feature and threshold of each inner node, value of each leaf; then a step function from margin to probability."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    knots: np.ndarray
    levels: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1])) if self.value.size else 0
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - len(f)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.margin(x), self.knots, self.levels) if len(self.knots) else np.full(len(x), 0.0)


def isotonic(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of label on margin; equal margins share a level."""
    if not len(margin):
        return np.zeros(0), np.zeros(0)
    x, at = np.unique(margin, return_inverse=True)
    w = np.bincount(at).astype(float)
    y = np.bincount(at, label) / w
    blocks: list[list[float]] = []  # level, weight, number of knots
    for level, weight in zip(y, w, strict=True):
        blocks.append([level, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return x, np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, cuts: int = 32, least_weight: float = 1.0, ridge: float = 1.0) -> Forest:
    """Second-order boosting of the logistic loss over features cut at quantiles."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, cuts + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    for j, c in enumerate(x.T):  # a rare feature's quantiles may all be zero
        positive = c[c > 0]
        if len(positive):
            edges[j] = np.unique(np.r_[edges[j], 0.0, np.quantile(positive, np.linspace(0, 1, 9)[:-1]) * (1 - 1e-9)])
    cut = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1) if len(x) else np.zeros((0, x.shape[1]), int)
    width = max((len(e) for e in edges), default=0) + 1
    p0 = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(p0 / (1 - p0)))
    margin = np.full(len(y), base)
    features, thresholds, values = [], [], []
    inner = 2**depth - 1
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            if len(own) >= 2:
                gg, hh = g[own].sum(), h[own].sum()
                best = 1e-6
                for j in range(x.shape[1]):
                    gl = np.cumsum(np.bincount(cut[own, j], g[own], width))[: len(edges[j])]
                    hl = np.cumsum(np.bincount(cut[own, j], h[own], width))[: len(edges[j])]
                    gain = gl**2 / (hl + ridge) + (gg - gl) ** 2 / (hh - hl + ridge) - gg**2 / (hh + ridge)
                    gain[(hl < least_weight) | (hh - hl < least_weight)] = -1
                    if len(gain) and gain.max() > best:
                        best, f[k], t[k] = gain.max(), j, edges[j][gain.argmax()]
            node[own] = 2 * k + 1 + (x[own, f[k]] > t[k])
        leaf = node - inner
        v = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += v[leaf]
        features.append(f)
        thresholds.append(t)
        values.append(v)
    shape = (len(features), inner)
    return Forest(np.array(features, np.int64).reshape(shape), np.array(thresholds).reshape(shape), np.array(values).reshape(len(features), inner + 1), base, np.zeros(0), np.zeros(0))


# ---------------------------------------------------------------- Spark
def fold_of(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows without an id are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)), F.lit(0)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, toxic) of at most `most` labelled rows outside fold 1, by a hash of the id; a document labelled more than once is toxic if any label says so."""
    y = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = y.where(fold(F.col("doc_id")) != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    # one row for each id, however often documents have it: the sample stays bounded
    return own.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def lexicon_of(sample: DataFrame, most: int = LEXICON_WORDS) -> dict[str, float]:
    """Words and word beginnings that mark toxic rows, with their strengths.

    Rows with equal texts count once. A term stays if more toxic than clean rows have it, with a likelihood ratio statistic
    of 25 or more and odds 8 times those among clean rows; at most `most` terms, the strongest.
    """

    def count(batches):
        for batch in batches:
            a, b = Counter(), Counter()
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (a if y else b).update({x for w in set(plain_words(t or "")) for x in terms_of(w)})
            both = list(a | b)
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([a[x] for x in both], pa.int64()), pa.array([b[x] for x in both], pa.int64())], names=["term", "a", "b"])

    once = sample.groupBy("text").agg(F.max("toxic").alias("toxic"))
    n = once.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    toxic, clean = float(n.t), float(n.n - n.t)
    if not toxic or not clean:
        return {}
    counts = once.mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 3")
    a, b, everything = F.col("a"), F.col("b"), toxic + clean

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    both = a + b
    ratio = 2 * (part(a, both * (toxic / everything)) + part(b, both * (clean / everything)) + part(toxic - a, (everything - both) * (toxic / everything)) + part(clean - b, (everything - both) * (clean / everything)))
    odds = (a + 0.5) / (toxic - a + 0.5) / ((b + 0.5) / (clean - b + 0.5))
    top = counts.select("term", ratio.alias("ratio"), odds.alias("odds")).where("ratio >= 25 and odds >= 8").orderBy(F.desc("ratio"), "term").limit(most)
    return {r.term: float(np.log1p(r.ratio)) for r in top.collect()}


@dataclass
class Model:
    lexicon: dict[str, float]
    forest: Forest


def _featured(df: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    def run(batches):
        f = Featurer(lexicon)
        for batch in batches:
            x = list(f.features(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    return df.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """A model of labels(doc_id, toxic) on docs(doc_id, text), from at most `most` labelled rows outside fold 1.

    A quarter of those rows calibrates the trees that the rest grows. Without rows of both labels every score is 0.
    """
    sample = labelled_sample(docs, labels, most).repartition(SAMPLE_PARTS, "doc_id").persist()
    try:
        lexicon = lexicon_of(sample)
        rows = _featured(sample, lexicon).orderBy("doc_id", "x").collect()  # `most` rows of FEATURES numbers at most
    finally:
        sample.unpersist()
    ids = [r.doc_id for r in rows]
    x, y = np.array([r.x for r in rows], float).reshape(-1, FEATURES), np.array([r.toxic for r in rows], float)
    aside = np.array([zlib.crc32(f"calibrate {i}".encode()) % 4 == 0 for i in ids], bool)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, boost(x[:0], y[:0]))
    forest = boost(x[~aside], y[~aside])
    if not aside.any() or y[aside].min() == y[aside].max():
        aside = np.ones(len(y), bool)
    forest.knots, forest.levels = isotonic(forest.margin(x[aside]), y[aside])
    return Model(lexicon, forest)


def _scorer(model: Model, threshold: float, names: list[str]):
    """Adds score and predicted to batches whose last column is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Featurer(model.lexicon)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            _, offsets = utf8(text)
            x = [f.features(text[a:b].to_pylist()) for a, b in blocks(offsets, BLOCK_BYTES)]
            p = np.clip(model.forest.probability(np.concatenate(x)), 0.0, 1.0) if x else np.zeros(0)
            columns = batch.columns if "text" in names else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out (fold 1), score in [0, 1], predicted (1 from the threshold on) of each row of docs(doc_id, text).

    Null and empty texts get the score of a text without words; rows that repeat get equal scores. Only doc_id and text are
    read, and the id only for the fold.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = source.mapInArrow(_scorer(model, threshold, ["doc_id"]), "doc_id long, score double, predicted int")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")


def score_rows(docs: DataFrame, model: Model, threshold: float = THRESHOLD, columns: tuple[str, ...] = ("doc_id", "lang", "source", "n_chars")) -> DataFrame:
    """The columns and text of docs with score and predicted, in one pass and without a join."""
    source = docs.select(*columns, "text")
    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return source.mapInArrow(_scorer(model, threshold, [*columns, "text"]), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
