"""Names tied to definitions, edges made of the ties, spans and lines, tests by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workmap.operators.scratch import checkpointed

#: Languages that see each other's names; marks of a test's file name; how deep re-exports are followed.
FAMILIES = {"typescript": "script", "tsx": "script", "javascript": "script", "c": "c", "cpp": "c", "java": "jvm", "kotlin": "jvm", "scala": "jvm"}
TEST_PREFIXES, TEST_SUFFIXES = ("test_", "test-", "Test"), ("_test", "-test", "_spec", "-spec", "Tests", "Test", "Spec")
DEPTH = 4


def family(language: Column) -> Column:
    """What a language shares names with: a group of languages, or itself."""
    out = language
    for name, group in FAMILIES.items():
        out = F.when(language == name, group).otherwise(out)
    return out


def single(names: DataFrame, keys: list[str], symbol: str = "symbol") -> DataFrame:
    """(keys, n, symbol): how many definitions a key has, and the one where it is one."""
    return names.groupBy(*keys).agg(F.count_distinct(symbol).alias("n"), F.min(symbol).alias("one")).withColumn("one", F.when(F.col("n") == 1, F.col("one")))


def resolved(refs: DataFrame, names: DataFrame, precise: DataFrame, imports: DataFrame) -> DataFrame:
    """refs(ref, file, family, name) with `symbol` and `resolution`, by the first tier that finds exactly one definition.

    Tiers: a precise tie (ref, symbol) from an index; a file that the reference's file imports (file, imported) holding one
    definition of the name; the file itself; the language family. A name that is ambiguous in its own file is never looked
    for in the family.
    """
    exact = precise.groupBy("ref").agg(F.min("symbol").alias("t0"))
    of_import = imports.join(names.select(F.col("file").alias("imported"), "name", "symbol"), "imported")
    t1 = single(of_import, ["file", "name"]).select("file", "name", F.col("one").alias("t1"))
    here = single(names, ["file", "name"]).select("file", "name", F.col("n").alias("n_here"), F.col("one").alias("t2"))
    wide = single(names, ["family", "name"]).select("family", "name", F.col("one").alias("t3"))
    j = refs.join(exact, "ref", "left").join(t1, ["file", "name"], "left").join(here, ["file", "name"], "left").join(wide, ["family", "name"], "left")
    last = F.when(F.col("n_here").isNull(), F.col("t3"))
    how = F.when(F.col("t0").isNotNull(), "scip").when(F.col("t1").isNotNull(), "import_path").when(F.col("t2").isNotNull(), "same_file").when(last.isNotNull(), "name_only")
    return j.select("ref", F.coalesce("t0", "t1", "t2", last).alias("symbol"), how.alias("resolution"))


def agreed(alternatives: DataFrame) -> DataFrame:
    """(ref, symbol) of alternatives(ref, symbol): the definition that every alternative finds; none if one finds nothing or another."""
    by = alternatives.groupBy("ref").agg(F.count_distinct("symbol").alias("n"), F.count_if(F.col("symbol").isNull()).alias("none"), F.min("symbol").alias("symbol"))
    return by.where("n = 1 and none = 0").select("ref", "symbol")


def reachable(start: DataFrame, passes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(root, file, depth): files that a root(file) passes on, and theirs in turn, at their least depth up to `depth`."""
    seen = start.select(F.col("file").alias("root"), "file", F.lit(0).alias("depth"))
    frontier = seen
    for k in range(1, depth + 1):
        step = frontier.select("root", "file").join(passes.select("file", "next").distinct(), "file").select("root", F.col("next").alias("file")).distinct()
        # cut from its lineage: each step reads the frontier twice, and the plan would double
        frontier = checkpointed(step.join(seen.select("root", "file"), ["root", "file"], "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(frontier)
    return seen


def searched(asked: DataFrame, passes: DataFrame, names: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(file, name, symbol, depth): asked(file, name) followed through files that pass the name on, passes(file, name, next, taken), until some file defines it.

    The first depth at which anything is found decides; several definitions there are none.
    """
    frontier = asked.select("file", "name", F.col("file").alias("at"), F.col("name").alias("called")).distinct()
    defined = names.select(F.col("file").alias("at"), F.col("name").alias("called"), "symbol")
    step = passes.select(F.col("file").alias("at"), F.col("name").alias("called"), "next", "taken")
    every = []
    for k in range(depth + 1):
        every.append(frontier.join(defined, ["at", "called"]).select("file", "name", "symbol", F.lit(k).alias("depth")))
        if k < depth:
            frontier = frontier.join(step, ["at", "called"]).select("file", "name", F.col("next").alias("at"), F.col("taken").alias("called")).distinct()
    by = reduce(DataFrame.unionByName, every).groupBy("file", "name", "depth").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("symbol"))
    first = by.groupBy("file", "name").agg(F.min(F.struct("depth", "n", "symbol")).alias("f"))
    return first.where("f.n = 1").select("file", "name", "f.symbol", "f.depth")


def edges_of(ties: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst, w, n): ties between two files or definitions as one edge of the surest tie; ties of a thing with itself drop."""
    return ties.where(F.col(src) != F.col(dst)).groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.max("confidence").alias("w"), F.count("*").alias("n"))


def test_base(path: Column) -> Column:
    """A test's file name up to the first dot, without one mark of a test in front or else at the end."""
    name = F.split(F.element_at(F.split(path, "/"), -1), r"\.")[0]
    front = F.regexp_extract(name, rf"^(?:{'|'.join(TEST_PREFIXES)})(.+)$", 1)
    back = F.regexp_extract(name, rf"^(.+?)(?:{'|'.join(TEST_SUFFIXES)})$", 1)
    return F.when(front != "", front).when(back != "", back).otherwise(name)


def is_own_test(test: Column, edited: Column) -> Column:
    """Whether a test's name, bare of its mark, is that of an edited file, whatever the case."""
    base = F.split(F.element_at(F.split(edited, "/"), -1), r"\.")[0]
    bare = test_base(test)
    return (F.length(bare) > 0) & (F.length(base) > 0) & (F.lower(bare) == F.lower(base))


def test_targets(tests: DataFrame, files: DataFrame) -> DataFrame:
    """(test, file): the file that a test(test, folder, base) is named for: the only one in its folder, else the only one there is; files(file, folder, base)."""
    near = single(files, ["folder", "base"], "file").select("folder", "base", F.col("n").alias("n_near"), F.col("one").alias("near"))
    wide = single(files, ["base"], "file").select("base", F.col("one").alias("wide"))
    j = tests.join(near, ["folder", "base"], "left").join(wide, "base", "left")
    return j.select("test", F.when(F.col("n_near").isNotNull(), F.col("near")).otherwise(F.col("wide")).alias("file")).where("file is not null")


def innermost(lines: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """(file, line, symbol): the smallest of spans(file, symbol, first, last) that holds a line, of equal ones the later, then the greater id."""
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    hit = lines.withColumn("_b", F.floor(F.col("line") / width)).join(s, ["file", "_b"]).where("first <= line and line <= last")
    return hit.groupBy("file", "line").agg(F.min_by("symbol", F.struct(F.col("last") - F.col("first"), -F.col("first"), -F.col("symbol"))).alias("symbol"))


def one_target(targets: DataFrame, files: DataFrame, symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """(target, node, kind): a target names a path, path:line, path:name or a name; what names several things or none is refused.

    lines(file, line, symbol) has the innermost definitions of the lines asked for.
    """
    parts = targets.select("target", F.regexp_extract("target", r"^(.*?):([^:]+)$", 1).alias("path"), F.regexp_extract("target", r"^(.*?):([^:]+)$", 2).alias("rest"))
    whole = targets.join(files.select(F.col("path").alias("target"), "file"), "target").select("target", F.col("file").alias("node"), F.lit("file").alias("kind"))
    at = parts.where("path <> ''").join(files.select("path", "file"), "path")
    by_line = at.where(F.col("rest").rlike("^[0-9]+$")).withColumn("line", F.col("rest").try_cast("long")).join(lines, ["file", "line"]).select("target", F.col("symbol").alias("node"), F.lit("symbol").alias("kind"))
    by_name = at.where(~F.col("rest").rlike("^[0-9]+$")).join(symbols.select("file", F.col("name").alias("rest"), "symbol"), ["file", "rest"]).select("target", F.col("symbol").alias("node"), F.lit("symbol").alias("kind"))
    bare = targets.join(symbols.select(F.col("name").alias("target"), "symbol"), "target").select("target", F.col("symbol").alias("node"), F.lit("symbol").alias("kind"))
    found = whole.unionByName(by_line).unionByName(by_name).unionByName(bare)
    counted = found.groupBy("target").agg(F.count_distinct("node", "kind").alias("n"), F.min(F.struct("node", "kind")).alias("f"))
    return counted.where("n = 1").select("target", "f.node", "f.kind")


def signature_changes(pairs: DataFrame) -> DataFrame:
    """Matched definitions whose signatures differ."""
    return pairs.where(F.col("old").isNotNull() & F.col("new").isNotNull() & ~F.col("old_sig").eqNullSafe(F.col("new_sig")))


def kth(keys: list[str], order: str):
    return F.row_number().over(Window.partitionBy(*keys).orderBy(order))
