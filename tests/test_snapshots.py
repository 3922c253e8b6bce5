"""Snapshot statements, as-of attribution and retention on hand-made rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from workmap.operators import snapshot as S


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_page_is_after_a_tuple(spark):
    df = spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "a int, b int")
    assert [tuple(r) for r in S.page(df, ["a", "b"], (0, 1), 3).collect()] == [(0, 2), (1, 0), (1, 1)]
    assert S.page(df, ["a", "b"], (2, 2), 3).count() == 0


def test_updates_hit_only_where_asked(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5), (3, None, 7)], "id int, v string, n int")
    assert rows(S.changed(df, F.col("n") > 5, v=F.lit("x"))) == [(1, "a", None), (2, "b", 5), (3, "x", 7)]
    given = spark.createDataFrame([(1, 9), (2, 9), (8, 9)], "id int, n int")
    assert rows(S.updated(df.select("id", "n"), given, ["id"], F.col("n").isNull())) == [(1, 9), (2, 5), (3, 7)]
    assert rows(S.kept(df.select("id"), F.col("id") > 2)) == [(1,), (2,)]


def test_upserts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    given = spark.createDataFrame([(2, "x"), (3, "y"), (3, "y")], "id int, v string")
    assert rows(S.replaced(df, given.distinct(), ["id"])) == [(1, "a"), (2, "x"), (3, "y")]
    assert rows(S.once(df, given, ["id"])) == [(1, "a"), (2, "b"), (3, "y")]
    n = spark.createDataFrame([(1, 2, 5), (1, 3, 4)], "id int, n int, last int")
    assert rows(S.summed(n.limit(1), n.where("n = 3"), ["id"], ["n"], ("last",))) == [(1, 5, 5)]


def test_lists_of_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    keys = spark.createDataFrame([(2,), (2,), (None,)], "id int")
    assert rows(S.keyed(df, keys)) == [(2,)]
    assert S.without(df, keys).count() == 2 and S.without(df, keys.limit(0)).count() == 3
    assert S.over_cap(df.where("id is not null"), "id", [F.desc("id")], 1).collect()[0].id == 2


def test_numbers_go_on(spark):
    stored = spark.createDataFrame([(4,), (7,)], "seq int")
    new = spark.createDataFrame([("b", 20), ("a", 10), ("c", 20)], "k string, at int")
    got = S.appended(stored, new, "seq", F.col("at"), ["at", "k"])
    assert sorted((r.k, r.seq) for r in got.collect()) == [("a", 8), ("b", 9), ("c", 10)]
    assert S.appended(stored.limit(0), new, "seq", F.col("at"), ["at", "k"]).agg(F.min("seq")).first()[0] == 1


def test_as_of_takes_the_last_state(spark):
    states = spark.createDataFrame([(1, 10, 100), (1, 20, 200), (1, 20, 201)], "k int, since int, v int")
    asked = spark.createDataFrame([(1, 9), (1, 10), (1, 25), (2, 25)], "k int, at int")
    got = {(r.k, r.at): r.v for r in S.as_of(asked, states, "k", "at", "since", "v").collect()}
    assert got == {(1, 9): None, (1, 10): 100, (1, 25): 201, (2, 25): None}
