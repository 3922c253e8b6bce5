"""An index of a repository: files, outlines of their definitions, references, ties and edges; whole, or around what changed.

Outlines come from patterns of a line's beginning and its indentation, enough for names, kinds and spans in the languages that
have a row in the table; a language without one has files and no definitions. The rest is relational: ties by the tiers of
`operators.resolution`, edges from the ties.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workmap.operators import resolution as N
from workmap.operators.scratch import checkpointed
from workmap.sources import readers

#: How a definition's line begins, by language: (kind, pattern with the name as its group).
OUTLINES = {
    "python": [("class", r"\s*class\s+(\w+)"), ("function", r"\s*(?:async\s+)?def\s+(\w+)")],
    "rust": [("struct", r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)"), ("function", r"\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)")],
    "go": [("type", r"type\s+(\w+)\s+(?:struct|interface)"), ("function", r"func\s+(?:\([^)]*\)\s*)?(\w+)")],
    "typescript": [("class", r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("function", r"\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)")],
    "java": [("class", r"\s*(?:public\s+|private\s+|final\s+|abstract\s+|static\s+)*(?:class|interface|enum)\s+(\w+)"), ("function", r"\s+(?:public\s+|private\s+|protected\s+|static\s+|final\s+)+[\w<>\[\], ]+\s(\w+)\s*\([^;]*$")],
}
_SAME = {"javascript": "typescript", "tsx": "typescript", "kotlin": "java", "scala": "java"}
_CALL = re.compile(r"\b([A-Za-z_]\w+)\s*\(")
_IMPORTS = [re.compile(p, re.M) for p in (r"^\s*from\s+([\w.]+)\s+import", r"^\s*import\s+([\w.]+)", r"^\s*use\s+(?:crate::)?([\w:]+)", r"from\s+['\"]([./\w-]+)['\"]")]
SYMBOLS = "file long, symbol long, parent long, kind string, name string, first long, last long, signature string"
REFS = "file long, ref long, symbol long, name string, line long"


def outline(text: str, language: str) -> list[tuple[str, str, int, int, int, str]]:
    """(kind, name, first, last, parent, signature) of a text's definitions in order; a definition ends before the next line that is indented no more than it, parents are those that hold it."""
    rules = [(k, re.compile(p)) for k, p in OUTLINES.get(_SAME.get(language, language), ())]
    lines = text.split("\n")
    depth = [len(x) - len(x.lstrip()) if x.strip() else None for x in lines]
    out: list[tuple[str, str, int, int, int, str]] = []
    held: list[int] = []
    for i, line in enumerate(lines):
        hit = next(((k, m[1]) for k, p in rules if (m := p.match(line))), None)
        if not hit:
            continue
        end = i
        for j in range(i + 1, len(lines)):
            if depth[j] is not None and depth[j] <= depth[i] and lines[j].lstrip()[:1] not in ")}]":
                break
            if depth[j] is not None:
                end = j
        while held and out[held[-1]][3] < i + 1:
            held.pop()
        out.append((hit[0], hit[1], i + 1, end + 1, held[-1] if held else -1, re.sub(r"\s+", " ", line.strip())))
        held.append(len(out) - 1)
    return out


def symbols(files: DataFrame) -> DataFrame:
    """The definitions of files(file, language, text); ids are the file's times 100,000 plus their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, language, text in zip(b["file"], b["language"], b["text"], strict=True):
                for k, (kind, name, first, last, parent, sig) in enumerate(outline(text or "", language or "")):
                    rows.append((file, file * 100_000 + k, file * 100_000 + parent if parent >= 0 else None, kind, name, first, last, sig))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SYMBOLS.split(", ")]).astype({"parent": "Int64"})

    return files.select("file", "language", "text").mapInPandas(run, SYMBOLS)


def references(files: DataFrame) -> DataFrame:
    """(file, ref, name, line): calls by name in files(file, text); the name in a definition's own line is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, language, text in zip(b["file"], b["language"], b["text"], strict=True):
                own = {(first, name) for _, name, first, *_ in outline(text or "", language or "")}
                k = 0
                for i, line in enumerate((text or "").split("\n"), 1):
                    for name in _CALL.findall(line):
                        if (i, name) not in own:
                            rows.append((file, file * 1_000_000 + k, name, i))
                            k += 1
            yield pd.DataFrame(rows, columns=["file", "ref", "name", "line"])

    return files.select("file", "language", "text").mapInPandas(run, "file long, ref long, name string, line long")


def imports(files: DataFrame) -> DataFrame:
    """(file, imported): files that a file names in its imports, by the end of their paths without the extension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = {(f, re.sub(r"^[./]+", "", re.sub(r"::|\.", "/", m.lstrip("./")))) for f, t in zip(b["file"], b["text"], strict=True) for p in _IMPORTS for m in p.findall(t or "")}
            yield pd.DataFrame(sorted(rows), columns=["file", "tail"])

    named = files.select("file", "text").mapInPandas(run, "file long, tail string").where("tail <> ''")
    bare = F.regexp_replace("path", r"\.[^./]+$", "")
    parts = F.split(bare, "/")
    tails = files.select(F.col("file").alias("imported"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("tail"))
    only = tails.groupBy("tail").agg(F.count_distinct("imported").alias("n"), F.min("imported").alias("imported")).where("n = 1")
    return named.join(only, "tail").where("file <> imported").select("file", "imported").distinct()


def built(files: DataFrame) -> dict[str, DataFrame]:
    """symbols, refs (with the definition each is in), ties and edges of files(file, path, language, text)."""
    s = checkpointed(symbols(files))
    r = checkpointed(references(files))
    spans = s.select("file", "symbol", "first", "last")
    inner = N.innermost(r.select("file", "line").distinct(), spans)
    r = checkpointed(r.join(inner, ["file", "line"], "left"))
    family = files.select("file", N.family(F.col("language")).alias("family"))
    names = s.join(family, "file").select("symbol", "file", "family", "name")
    imported = checkpointed(imports(files))
    none = s.sparkSession.createDataFrame([], "ref long, symbol long")
    ties = N.resolved(r.join(family, "file").select("ref", "file", "family", "name"), names, none, imported).where("symbol is not null").withColumnRenamed("symbol", "target")
    sure = F.when(F.col("resolution") == "import_path", 0.8).when(F.col("resolution") == "same_file", 0.6).otherwise(0.3)
    full = checkpointed(ties.join(r.select("ref", "symbol", "file"), "ref").join(s.select(F.col("symbol").alias("target"), F.col("file").alias("to_file")), "target").withColumn("confidence", sure))
    return {
        "symbols": s,
        "refs": r,
        "ties": full,
        "file_edges": N.edges_of(full.unionByName(imported.select(F.lit(None).cast("long").alias("target"), F.lit(None).cast("long").alias("ref"), F.lit("import_path").alias("resolution"), F.lit(None).cast("long").alias("symbol"), "file", F.col("imported").alias("to_file"), F.lit(0.8).alias("confidence"))), "file", "to_file"),
        "symbol_edges": N.edges_of(full.where("symbol is not null"), "symbol", "target"),
    }


def repository(spark: SparkSession, root: str) -> DataFrame:
    """(file, path, language, text) of the readable source files under a folder; ids follow the order of paths by a hash."""
    listed = readers.repository(spark, root).where("language is not null and loc is not null").select("path", "language")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.substr(F.regexp_replace(F.col("path"), r"^file:/*", "/"), F.lit(len(root.rstrip("/")) + 2))
    texts = content.select(at.alias("path"), F.decode("content", "UTF-8").alias("text"))
    return listed.join(texts, "path").select((F.abs(F.xxhash64("path")) % 1_000_000_000).alias("file"), "path", "language", "text")


def changed_and_around(files: DataFrame, changed: DataFrame, edges: DataFrame, depth: int = N.DEPTH) -> DataFrame:
    """The files to index anew when some changed: these, and those that import them, directly or through up to `depth` others; edges(src, dst)."""
    back = checkpointed(edges.select(F.col("dst").alias("file"), F.col("src").alias("next")))
    near = N.reachable(changed.select("file"), back, depth).select("file").distinct()
    return files.join(near, "file", "left_semi")


def replaced(old: dict[str, DataFrame], new: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """An index after some files were indexed anew: their rows come from the new one."""
    keys = {"symbols": "file", "refs": "file", "ties": "file", "file_edges": "src"}
    out = {}
    for name, key in keys.items():
        kept = old[name].join(files.select(F.col("file").alias(key)), key, "left_anti").select(*old[name].columns)
        out[name] = reduce(DataFrame.unionByName, (kept, new[name].select(*old[name].columns)))
    return out
