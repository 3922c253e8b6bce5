"""Outlines, ties and edges of a small repository, ignore rules, heads, and what to index anew."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from workmap.sources import index, readers

FILES = [
    (1, "app/orders.py", "python", "import app.prices\n\nclass Order:\n    def total(self):\n        return price_of(self)\n\ndef main():\n    Order().total()\n    helper()\n"),
    (2, "app/prices.py", "python", "def price_of(order):\n    return 1\n"),
    (3, "src/lib.rs", "rust", "pub struct A;\n\nimpl A {\n    pub fn run(&self) {\n        helper();\n    }\n}\n\nfn helper() {}\n"),
    (4, "web/x.ts", "typescript", "export function go() {\n  return 1\n}\n"),
    (5, "notes.txt", None, "go()"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "file long, path string, language string, text string")


def test_outline():
    got = [(k, n, a, b, p) for k, n, a, b, p, _ in index.outline(FILES[0][3], "python")]
    assert got == [("class", "Order", 3, 5, -1), ("function", "total", 4, 5, 0), ("function", "main", 7, 9, -1)]
    assert [n for _, n, *_ in index.outline(FILES[2][3], "rust")] == ["A", "run", "helper"] and index.outline("x", "cobol") == []


def test_ties_and_edges(spark, files):
    built = index.built(files)
    assert {r.name for r in built["symbols"].collect()} == {"Order", "total", "main", "price_of", "A", "run", "helper", "go"}
    ties = {(r.file, r.target, r.resolution) for r in built["ties"].collect()}
    name = {r.symbol: r["name"] for r in built["symbols"].collect()}
    assert {(f, name[t], how) for f, t, how in ties} == {(1, "price_of", "import_path"), (1, "Order", "same_file"), (1, "total", "same_file"), (3, "helper", "same_file")}
    assert {(r.src, r.dst): (r.w, r.n) for r in built["file_edges"].collect()} == {(1, 2): (0.8, 2)}
    inner = {(name[r.src], name[r.dst]) for r in built["symbol_edges"].collect()}
    assert inner == {("total", "price_of"), ("main", "Order"), ("main", "total"), ("run", "helper")}


def test_only_what_is_around_a_change_is_indexed_anew(spark, files):
    built = index.built(files)
    near = index.changed_and_around(files, spark.createDataFrame([(2,)], "file long"), built["file_edges"])
    assert {r.file for r in near.collect()} == {1, 2}
    again = index.replaced(built, index.built(near), near)
    for k in ("symbols", "file_edges"):
        assert sorted(map(str, again[k].collect())) == sorted(map(str, built[k].collect()))


@pytest.mark.parametrize(
    ("path", "out"),
    [("target/a.rs", True), ("x/target/a.rs", True), ("src/target.rs", False), ("a.log", True), ("keep.log", False), ("docs/a/b.md", True), ("b/docs/a.md", False), ("x/y.tmp", True)],
)
def test_ignore_rules(spark, path, out):
    rules = ["# a comment", "target/", "*.log", "!keep.log", "/docs/**", "*.tmp"]
    assert spark.range(1).select(readers.ignored(F.lit(path), rules)).first()[0] is out


def test_heads(spark):
    df = spark.createDataFrame([("a\x00b",), ("// Code generated by x. DO NOT EDIT.",), ("plain",)], "head string")
    assert [r[0] for r in df.select(readers.head_kind(F.col("head"))).collect()] == ["binary", "generated", "text"]
    named = spark.createDataFrame([("a/Makefile", ""), ("x.h", "namespace a {"), ("x.h", "int f(void);"), ("run", "#!/usr/bin/env python3\n")], "p string, head string")
    assert [r[0] for r in named.select(readers.language(F.col("p"), F.col("head"))).collect()] == ["make", "cpp", "c", "python"]
