"""Findings of round 4: the graph of files is packed from lines moved once, and read again for each round of spreading."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_packed_links_add_up_as_they_are(monkeypatch):
    from workmap.operators import spreading

    monkeypatch.setattr(spreading, "CHUNK", 200)
    monkeypatch.setattr(spreading, "FEW_ENDS", 4)
    rng = np.random.default_rng(4)
    src, dst = rng.integers(0, 90, 3000), np.where(rng.random(3000) < 0.3, 7, rng.integers(0, 90, 3000))  # 7 is a hub
    w = rng.integers(1, 9, 3000) / 8
    batches = [pa.RecordBatch.from_arrays([pa.array(a[k : k + 700]) for a in (src, dst, w)], names=["src", "dst", "w"]) for k in range(0, 3000, 700)]
    whole = np.bincount(src, w, 90)
    vectors = spreading._Vectors([(np.arange(90), np.ones(90), whole)], (np.array([5, 5, 8]), np.array([1, 2, 7]), np.array([0.5, 0.5, 1.0])), 0.5)
    vectors.begin()
    out = np.zeros(90)
    for row in spreading._packed_links(iter(batches)):
        ids, x, y, ends = (row.column(n)[0].values.to_numpy() for n in ("ids", "x", "y", "ends"))
        np.add.at(out, ids, y)
        vectors.add(ids, x, ends, *(np.frombuffer(row.column(n)[0].as_buffer(), t) for n, t in (("src", np.uint16), ("w", np.uint16), ("cuts", np.int32))))
    vectors.end()
    assert np.allclose(out, whole, rtol=0, atol=1e-12)
    for k, start in enumerate(({1: 0.5, 2: 0.5}, {7: 1.0})):
        expected = np.zeros(90)
        for n, m in start.items():
            expected += np.bincount(dst[src == n], w[src == n] * m / whole[n] / 2, 90)
            expected[n] += m
        assert np.allclose(vectors.mass[:, k], expected, rtol=0, atol=1e-12)


def test_links_of_files_are_those_of_the_whole_graph(spark):
    from workmap.operators import graph
    from workmap.plans import retrieval
    from workmap.plans.relations import Relations

    s = retrieval.Stages(Relations(spark, SMALL))
    summed = lambda e: {(r.src, r.dst): r.w for r in e.groupBy("src", "dst").agg(F.sum("w").alias("w")).where("w > 0").collect()}
    whole = summed(graph.by_files(graph.weighed(s.raw, F.lit(200)).where("type <> 'containment'"), s.file_of))
    got = summed(s.file_links)
    assert whole and got.keys() == whole.keys() and all(abs(got[x] - whole[x]) < 1e-12 for x in got)
    plan = s.file_links._jdf.queryExecution().optimizedPlan().toString()
    # lines are dealt once for links, by their file, and once for references; nothing is dealt again in both directions
    assert plan.count("RepartitionByExpression") == 3 and "RepartitionByExpression [l_partkey" in plan


def test_links_next_to_ranked_files_are_all_that_is_written(spark):
    from workmap.plans import retrieval
    from workmap.plans.relations import Relations

    s = retrieval.Stages(Relations(spark, SMALL))
    s.ranked = spark.createDataFrame([(1, 3), (1, 12)], "query long, file long")
    s.lexical = s.similar = spark.createDataFrame([(1, 12), (1, 7)], "query long, node long")
    s.session = spark.createDataFrame([(1, 5)], "query long, node long")
    nodes = {r.node: r.file for r in s.file_of.collect() if r.file in (3, 12, 7, 5)}
    expected = sorted(tuple(r) for r in s.raw.collect() if r.src in nodes and r.dst in nodes)
    assert expected and sorted(map(tuple, s.near.collect())) == expected
