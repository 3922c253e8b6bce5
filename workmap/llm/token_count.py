"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton over the vocabulary lists all pieces in a stretch of text; one pass keeps, for
each place, only the best score of a segmentation that ends there and its number of pieces. No piece of
the usual vocabularies has the word mark after another letter, so text falls apart at word marks into
stretches that are segmented once each and remembered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workmap.llm.common import table

MARK = "▁"
#: What an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0
DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores; byte pieces, if any, stand for unknown characters one byte each."""

    pieces: tuple[tuple[str, float], ...]
    has_bytes: bool

    @classmethod
    def of_model(cls, path: str) -> Vocabulary:
        """The normal pieces of a sentencepiece model file."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        return cls(tuple((m.id_to_piece(i), m.get_score(i)) for i in plain), any(m.is_byte(i) for i in range(n)))

    def __post_init__(self):
        if len(self.pieces) > 2_000_000:
            raise ValueError("the vocabulary is sent to every executor; 2,000,000 pieces at most")


class Counter:
    """Counts the pieces of texts."""

    def __init__(self, vocabulary: Vocabulary, most_remembered: int = 400_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.has_bytes = vocabulary.has_bytes
        self.splits = not any(MARK in p.lstrip(MARK) for p, _ in vocabulary.pieces)
        self.known: dict[str, tuple[float, int]] = {}
        self.most = most_remembered

    def stretch(self, text: str) -> tuple[float, int]:
        """Best score and its number of pieces.

        Ties go as in the tokenizers' own search: from left to right by a piece's start, and a later candidate for an end
        replaces an earlier one only if its score is greater, so of equals the one whose last piece is longest stays. A
        character that is no piece by itself may be unknown; with bytes it counts one for each, without them a run of
        unknown characters counts one.
        """
        n = len(text)
        begins: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.automaton):
            for end, (size, score) in self.automaton.iter(text):
                begins[end - size + 1].append((size, score))
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        was_unknown = [False] * (n + 1)
        for i in range(n):
            here = best[i]
            single = False
            for size, score in begins[i]:
                single |= size == 1
                j = i + size
                if best[j] is None or here + score > best[j]:
                    best[j], count[j], was_unknown[j] = here + score, count[i] + 1, False
            if not single:
                j = i + 1
                if best[j] is None or here + self.unknown > best[j]:
                    more = len(text[i].encode()) if self.has_bytes else 0 if was_unknown[i] else 1
                    best[j], count[j], was_unknown[j] = here + self.unknown, count[i] + more, True
        return best[n], count[n]

    def text(self, text: str) -> tuple[float, int]:
        """Of a whole text: a mark goes before it and in place of each space; empty texts have nothing."""
        if not text:
            return 0.0, 0
        if not self.splits or not self.has_bytes:
            return self.stretch(MARK + text.replace(" ", MARK))
        score, count, known = 0.0, 0, self.known
        pieces = (MARK + text.replace(" ", MARK)).split(MARK)
        ahead = 0
        for x in pieces[1:]:
            ahead += 1
            if not x:
                continue  # another mark follows: marks in a row belong to the word behind them
            word = MARK * ahead + x
            ahead = 0
            got = known.get(word)
            if got is None:
                got = self.stretch(word)
                if len(known) >= self.most:
                    known.clear()
                if len(word) <= 64:
                    known[word] = got
            score += got[0]
            count += got[1]
        if ahead:
            s, c = self.stretch(MARK * ahead)
            score, count = score + s, count + c
        return score, count


@lru_cache(1)
def _counter(vocabulary: Vocabulary) -> Counter:
    """One for all tasks of a worker, so that stretches stay remembered."""
    return Counter(vocabulary)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])


def count_tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, score (of the best segmentation) of each row of docs(doc_id, text).

    Null and empty texts have 0 tokens and score 0. Each row stands by itself, whatever its id; other columns aren't read.
    The vocabulary travels with the task; its size is checked when it is made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            got = [counter.text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for _, c in got], pa.int64()), pa.array([s for s, _ in got], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), Vocabulary.of_model(vocabulary))
