"""The kept index against the plain scores over the documents that are live, as documents come, change and go."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from workmap.operators.search_index import SearchIndex


def words(text):
    return F.filter(F.split(F.lower(text), " "), lambda w: w != "")


def documents(r, ids):
    vocabulary = [f"w{k}" for k in range(40)]
    weights = [1 / (k + 1) for k in range(40)]
    return {i: r.choice(["", " ".join(r.choices(vocabulary, weights, k=r.choice([1, 5, 30, 90])))]) if i % 11 == 0 else " ".join(r.choices(vocabulary, weights, k=r.choice([1, 5, 30, 90]))) for i in ids}


def plain(docs, queries, k):
    """BM25 and coverage, document by document."""
    n = len(docs)
    bags = {i: (t or "").split() for i, t in docs.items()}
    mean = sum(map(len, bags.values())) / n
    df = {}
    for b in bags.values():
        for w in set(b):
            df[w] = df.get(w, 0) + 1
    top, covered = {}, {}
    for q, terms in queries.items():
        rank = {w: max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) for w in terms if w in df}
        share = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in terms if w in df}
        f = max(math.ceil(n * 0.01), 1)
        whole = max(sum(share.values()), 2 * math.log(1 + (n - f + 0.5) / (f + 0.5)))
        scores = {}
        for i, b in bags.items():
            s = sum(v * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / mean)) for w, v in rank.items() if w in b)
            if any(w in b for w in rank):
                scores[i] = s
                covered[q, i] = min(sum(v for w, v in share.items() if w in b) / whole, 1.0)
        for s in sorted(scores.values(), reverse=True)[:k]:
            top.setdefault(q, []).append(s)
    return top, covered


def check(spark, index, docs, queries, k, least):
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query int, term string")
    top, covered = plain(docs, queries, k)
    got: dict = {}
    for x in sorted(index.top(asked, k).collect(), key=lambda x: x.place):
        assert x.doc in docs
        got.setdefault(x.query, []).append(x.score)
    assert got.keys() == top.keys()
    for q in top:
        assert got[q] == pytest.approx(top[q], abs=2e-6)
    pairs = {(x.query, x.doc): x.coverage for x in index.coverage(asked, least).collect()}
    assert pairs == pytest.approx({p: v for p, v in covered.items() if v >= least + 1e-6} | {p: v for p, v in pairs.items() if abs(covered.get(p, 0) - least) < 1e-6}, abs=2e-6)
    stats = index.stats().first()
    assert stats.rows == len(docs) and stats.mean_length == pytest.approx(sum(len((t or "").split()) for t in docs.values()) / len(docs))


def test_the_index_follows_its_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("workmap.operators.search_index.BLOCK", 16)  # several blocks a term
    r = random.Random(4)
    docs = documents(r, range(300)) | {1000: None, 1001: "W1 w1  w2"}
    docs[1001] = "w1 w1 w2"
    queries = {q: r.sample([f"w{k}" for k in range(40)] + ["unheard"], r.choice([1, 2, 6])) for q in range(8)}

    def frame(d):
        return spark.createDataFrame(list(d.items()), "number int, body string")

    index = SearchIndex(spark, str(tmp_path / "index"), words)
    index.insert(frame(docs), "number", "body")
    check(spark, index, docs, queries, 5, 0.3)
    index.delete(spark.createDataFrame([(i,) for i in [*range(0, 300, 3), 77_777]], "number int"), "number")
    docs = {i: t for i, t in docs.items() if i % 3 or i >= 300}
    new = documents(r, range(200, 340))  # some come again, some are replaced, some are new
    index.insert(frame(new), "number", "body")
    docs |= new
    index.delete(spark.createDataFrame([(1, ), (205,), (205,)], "number int"), "number")
    docs = {i: t for i, t in docs.items() if i not in (1, 205)}
    check(spark, index, docs, queries, 5, 0.3)
    check(spark, index.compacted(str(tmp_path / "new")), docs, queries, 400, 0.6)


def test_blocks_that_cannot_matter_stay_shut(spark, tmp_path, monkeypatch):
    """Six documents decide; the common word finds none by itself, and of its own blocks only the best are opened where it is asked alone."""
    monkeypatch.setattr("workmap.operators.search_index.BLOCK", 8)
    docs = [(i, "rare " * 3 if i < 6 else "some " * (1 + 5 * (i % 20 == 1)) + "filler " * (i % 40) if i % 3 == 1 else "filler") for i in range(600)]
    index = SearchIndex(spark, str(tmp_path / "index"), words)
    index.insert(spark.createDataFrame(docs, "number int, body string"), "number", "body")
    opened = []
    whole = index.opened
    index.opened = lambda blocks: (opened.append(blocks), whole(blocks))[1]
    got = index.top(spark.createDataFrame([(1, "rare"), (1, "some")], "query int, term string"), 4).collect()
    assert {x.doc for x in got} <= set(range(6))
    finding = opened[-2].groupBy("term").count().collect()
    assert [x.term for x in finding] == ["rare"]
    opened.clear()
    index.top(spark.createDataFrame([(1, "some")], "query int, term string"), 4).collect()
    assert opened[-2].count() < index.blocks(spark.createDataFrame([("some",)], "term string")).count()
