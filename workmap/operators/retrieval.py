"""Retrieval for many questions at once: seeds, spreading in two stages, evidence, the gate, the listing.

Every relation here is keyed by `query`; a question is never a loop. Nodes are files, and symbols of files; `file_of(node, file)`
says which file a node belongs to (a file to itself).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workmap.operators.scratch import discard, written
from workmap.operators.spreading import TELEPORT, TOLERANCE, Adjacency, power, push

#: Weights of seeds by source; how many edits, reads and changes count; bars of similarity.
EDITED, READ, UNCOMMITTED, SIMILAR, NAMED_CHANGE, FAILURE_AGREED, FAILURE_ALONE, EXPLORED = 1.0, 0.4, 0.8, 0.6, 0.8, 1.0, 0.4, 0.05
MOST_EDITS, SEEDED_READS, SIMILAR_BAR, LEAST_TERMS, CHANGE_BAR, MOST_CHANGES, EXPLORED_FROM, MOST_EXPLORED = 200, 10, 0.3, 5, 0.6, 3, 10, 20
#: Priors of tiers; files of the second stage; files that the gate looks at, and whose mass it takes; floors of evidence by a link.
LANDMARK_PRIOR, INTERESTING_PRIOR, STAGED, GATED, MASSED, STRUCTURAL_FLOOR, COACCESS_FLOOR = 1.5, 1.25, 30, 3, 5, 0.8, 0.05
#: The gate's bars, the model's bar in small repositories and when raised.
AGREEING, LEXICAL_BAR, STRONGLY_AGREEING, STRONG_BAR, SMALL_CONFIDENCE, MOST_CONFIDENCE = 2, 0.5, 3, 0.1, 0.85, 0.9
#: Reasons of a listed file, the first that holds.
REASONS = ("named", "edited_here", "matches", "uncommitted", "changes_with", "refers_to", "referred_to_by", "like_earlier_work", "worked_on_with", "read_here")
#: Places that scores are compared to, so that sums in another order rank alike.
PLACES = 9


def top(rows: DataFrame, order: list[Column], n: int, name: str = "place") -> DataFrame:
    """The first n rows of each question, numbered."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col(name) <= n)


# ---------------------------------------------------------------- seeds
def over_best(scored: DataFrame) -> DataFrame:
    """(query, node, w): scores over the question's best."""
    best = F.max("score").over(Window.partitionBy("query"))
    return scored.select("query", "node", (F.col("score") / best).alias("w"))


def named_file(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """(query, file) of mentions(query, mention) that name one file: its whole path, else an end of one path, else a path that ends the mention.

    Ends are compared by equality on each suffix of a path, so the join is on a key: a path of k parts has k of them.
    """

    def suffixes(path: str) -> Column:
        parts = F.split(path, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))

    def only(found: DataFrame) -> DataFrame:
        return found.groupBy("query", "mention").agg(F.count_distinct("file").alias("n"), F.min("file").alias("file")).where("n = 1").select("query", "mention", "file")

    whole = only(mentions.join(files.select("file", F.col("path").alias("mention")), "mention"))
    left = mentions.join(whole.select("query", "mention"), ["query", "mention"], "left_anti")
    ends = only(left.join(files.select("file", F.explode(suffixes("path")).alias("mention")), "mention"))
    left = left.join(ends.select("query", "mention"), ["query", "mention"], "left_anti")
    longer = left.select("query", "mention", F.explode(suffixes("mention")).alias("path")).join(files.select("file", "path"), "path")
    return whole.unionByName(ends).unionByName(only(longer)).select("query", "file").distinct()


def session_seeds(events: DataFrame) -> DataFrame:
    """(query, node, w) from events(query, seq, ts, kind, node, done): 1 for what was edited, 0.4 for the newest reads, both added; what failed doesn't count."""
    newest = [F.desc("ts"), F.desc("seq")]
    edits = top(events.where("kind = 'edit'"), newest, MOST_EDITS).where("done and node is not null").groupBy("query", "node").agg(F.lit(EDITED).alias("w"))
    reads = top(events.where("kind = 'read' and done"), newest, SEEDED_READS).where("node is not null").groupBy("query", "node").agg(F.lit(READ).alias("w"))
    return summed(edits, reads)


def similar_seeds(words: DataFrame, clusters: DataFrame, bar: float = SIMILAR_BAR) -> DataFrame:
    """(query, node, w) of files of clusters whose first terms, as many as the question has words and 5 at least, are like its words(query, words)."""
    n = F.greatest(F.size("words"), F.lit(LEAST_TERMS))
    # only clusters with a word in common can be like it: met by word, not by every pair
    met = words.select("query", F.explode("words").alias("word")).join(clusters.select("cluster", F.explode("terms").alias("word")), "word").select("query", "cluster").distinct()
    both = met.join(words, "query").join(clusters, "cluster").withColumn("theirs", F.array_distinct(F.slice("terms", 1, n)))
    common, union = F.size(F.array_intersect("words", "theirs")), F.size(F.array_union("words", "theirs"))
    like = both.withColumn("score", common / union).where(F.col("score") >= bar)
    return like.select("query", F.explode("files").alias("node"), (F.lit(SIMILAR) * F.col("score")).alias("w")).groupBy("query", "node").agg(F.max("w").alias("w"))


def change_seeds(changes: DataFrame, files: DataFrame, weight: float = NAMED_CHANGE) -> DataFrame:
    """(query, node, w): each change(query, card, score) spreads weight * score evenly over its files(card, node); the most for each file.

    Changes are few, and written, so that Spark knows it: files of all others drop where they are read.
    """
    changes = written(changes)
    own = written(files.join(changes.select("card").distinct(), "card", "left_semi"))
    size = own.groupBy("card").agg(F.count("*").alias("n"))
    each = changes.join(size, "card").join(own, "card").select("query", "node", (F.lit(weight) * F.col("score") / F.col("n")).alias("w"))
    return each.groupBy("query", "node").agg(F.max("w").alias("w"))


def failure_seeds(grounded: DataFrame, others: DataFrame) -> DataFrame:
    """(query, node, w) of grounded(query, node): 1 where another source agrees, else 0.4."""
    agreed = others.select("query", "node").distinct().withColumn("agreed", F.lit(True))
    w = F.when(F.col("agreed"), FAILURE_AGREED).otherwise(FAILURE_ALONE)
    return grounded.distinct().join(agreed, ["query", "node"], "left").select("query", "node", w.alias("w"))


def strongest_seeds(found: DataFrame) -> DataFrame:
    """(query, src): the few seeds of a question that it is explored from."""
    return written(top(found, [F.desc(F.round("w", PLACES)), "node"], EXPLORED_FROM).select("query", F.col("node").alias("src")))


def links_at(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges(src, dst, ...) with an end in nodes(node), each once."""
    a, b = nodes.select(F.col("node").alias("src")).distinct(), nodes.select(F.col("node").alias("dst")).distinct()
    return edges.join(a, "src", "left_semi").unionByName(edges.join(b, "dst", "left_semi").join(a, "src", "left_anti").select(*edges.columns))


def explored_seeds(found: DataFrame, edges: DataFrame, dark: DataFrame, strongest: DataFrame | None = None) -> DataFrame:
    """(query, node, w): the heaviest dark structural neighbours of the strongest seeds that aren't seeds themselves; edges need hold those of the strongest only."""
    strongest = strongest_seeds(found) if strongest is None else strongest
    near = strongest.join(edges.select("src", F.col("dst").alias("node"), F.col("w").alias("link")), "src").groupBy("query", "node").agg(F.max("link").alias("link"))
    new = near.join(dark, "node", "left_semi").join(found.select("query", "node"), ["query", "node"], "left_anti")
    return top(new, [F.desc(F.round("link", PLACES)), "node"], MOST_EXPLORED).select("query", "node", F.lit(EXPLORED).alias("w"))


def summed(*parts: DataFrame) -> DataFrame:
    """Seeds of several sources, added up."""
    return reduce(DataFrame.unionByName, [p.select("query", "node", "w") for p in parts]).groupBy("query", "node").agg(F.sum("w").alias("w"))


def shares(weights: DataFrame) -> DataFrame:
    """Positive weights over their question's sum."""
    positive = weights.where("w > 0")
    total = positive.groupBy("query").agg(F.sum("w").alias("total"))
    return positive.join(total, "query").select("query", "node", (F.col("w") / F.col("total")).alias("w"))


# ---------------------------------------------------------------- spreading
def spread(links: Adjacency, seeds: DataFrame, inside: DataFrame | None = None, tolerance: float = TOLERANCE, teleport: float = TELEPORT) -> DataFrame:
    """(query, node, kept): personalised page rank of all questions at once; of each at most `tolerance` of its mass is left to spread.

    inside(query, node) keeps a question's seeds to its own nodes; links of (query, src) then lead to no others.
    """
    if inside is not None:
        seeds = seeds.join(inside, ["query", "node"], "left_semi")
    return push(links, seeds, tolerance, teleport).where("kept > 0").select("query", "node", "kept")


def prior() -> Column:
    """What a node's activation counts for, by its tier."""
    return F.when(F.col("tier") == "landmark", LANDMARK_PRIOR).when(F.col("tier") == "interesting", INTERESTING_PRIOR).otherwise(1.0)


def scored(activation: DataFrame, standing: DataFrame, file_of: DataFrame) -> DataFrame:
    """(query, file, score, activation, place): activation times the node's prior, summed for each listed file; standing(node, tier, is_listed)."""
    listed = standing.where("is_listed").select(F.col("node").alias("file"))
    rows = activation.join(file_of, "node").join(standing.select("node", prior().alias("prior")), "node", "left").join(listed, "file", "left_semi")
    by_file = rows.groupBy("query", "file").agg(F.sum(F.col("kept") * F.coalesce("prior", F.lit(1.0))).alias("score"), F.sum("kept").alias("activation"))
    return by_file.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", PLACES)), "file")))


def named_first(ranked: DataFrame, named: DataFrame) -> DataFrame:
    """The ranking with the named files before all others, either in its own order."""
    marked = ranked.join(named.select("query", "file").distinct().withColumn("is_named", F.lit(True)), ["query", "file"], "left").withColumn("is_named", F.coalesce("is_named", F.lit(False)))
    return marked.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("is_named"), "place")))


def second_stage(ranked: DataFrame, edges: DataFrame, seeds: DataFrame, file_of: DataFrame, symbols: DataFrame, standing: DataFrame, staged: int = STAGED) -> DataFrame:
    """(query, file, symbol, score): spreading inside the best files and their symbols only; edges(src, dst, w) of nodes."""
    best = ranked.where(F.col("place") <= staged).select("query", "file")
    members = written(best.join(file_of, "file").select("query", "node"))
    own = edges.withColumnRenamed("src", "node").join(members, "node").withColumnRenamed("node", "src")
    own = own.join(members.withColumnRenamed("node", "dst"), ["query", "dst"])
    within = power(own, seeds.join(members, ["query", "node"], "left_semi"), on=["query", "src"]).where("kept > 0")
    discard(members)
    held = within.join(symbols, "node").join(standing.select("node", prior().alias("prior")), "node", "left")
    return held.select("query", "file", F.col("node").alias("symbol"), (F.col("kept") * F.coalesce("prior", F.lit(1.0))).alias("score")).where("score > 0")


# ---------------------------------------------------------------- evidence
def partners(ranked: DataFrame, peaks: DataFrame, seed_files: DataFrame) -> DataFrame:
    """(query, file, kind, other, peak): seed files that a ranked file is linked with above the kind's floor, by the heaviest single link; peaks(file, other, kind, peak)."""
    floor = F.when(F.col("kind") == "structural", STRUCTURAL_FLOOR).when(F.col("kind") == "coaccess", COACCESS_FLOOR / 5 * 0.8).otherwise(1e-300)
    both = peaks.unionByName(peaks.where("kind = 'cochange'").select(F.col("other").alias("file"), F.col("file").alias("other"), "kind", "peak")).where((F.col("file") != F.col("other")) & (F.col("peak") >= floor))
    strongest = both.groupBy("file", "other", "kind").agg(F.max("peak").alias("peak"))
    # from the few seed files, not from all that is ranked: a ranked file's links are many
    near = seed_files.select("query", F.col("node").alias("other")).distinct().join(strongest, "other")
    return near.join(ranked.select("query", "file"), ["query", "file"]).select("query", "other", "file", "kind", "peak")


def support(ranked: DataFrame, lexical: DataFrame, similar: DataFrame, history: DataFrame, linked: DataFrame) -> DataFrame:
    """(query, file, kinds): which independent kinds of evidence stand behind a file."""
    plain = [(lexical, "lexical"), (similar, "similar"), (history, "history")]
    own = [ranked.select("query", "file").join(s.select("query", F.col("node").alias("file")).distinct(), ["query", "file"]).withColumn("kind", F.lit(k)) for s, k in plain]
    every = reduce(DataFrame.unionByName, own).unionByName(linked.select("query", "file", "kind").distinct())
    kinds = every.groupBy("query", "file").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return ranked.select("query", "file", "place").join(kinds, ["query", "file"], "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))


def gate_features(supported: DataFrame, ranked: DataFrame, activation: DataFrame, top_lexical: DataFrame, under_way: DataFrame) -> DataFrame:
    """One row for each question: top_lexical, top_mass, agreeing and supporting kinds of its first three files, is_continuing, history_alone."""
    first = supported.where(F.col("place") <= GATED)
    working = under_way.select("query", "file").distinct().withColumn("working", F.lit(True))
    marked = first.join(working, ["query", "file"], "left")
    kinds = marked.groupBy("query").agg(
        F.max(F.size("kinds")).alias("agreeing_kinds"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("_kinds"),
        F.bool_or(F.coalesce("working", F.lit(False)) & F.array_contains("kinds", "lexical")).alias("is_continuing"),
    )
    whole = activation.groupBy("query").agg(F.sum("kept").alias("whole"))
    heavy = ranked.where(F.col("place") <= MASSED).groupBy("query").agg(F.sum("activation").alias("heavy"))
    mass = whole.join(heavy, "query").select("query", F.least(F.greatest(F.col("heavy") / F.col("whole"), F.lit(0.0)), F.lit(1.0)).alias("top_mass"))
    out = kinds.join(mass, "query", "left").join(top_lexical, "query", "left")
    return out.select("query", F.coalesce("top_lexical", F.lit(0.0)).alias("top_lexical"), F.coalesce("top_mass", F.lit(0.0)).alias("top_mass"), "agreeing_kinds", F.size("_kinds").alias("supporting_kinds"), "is_continuing", (F.col("_kinds") == F.array(F.lit("history"))).alias("history_alone"))


def confidence_bar(least: Column, mode: Column, raised: Column) -> Column:
    """The bar a model's probability must reach: higher in small repositories, raised by poor precision, but not over 0.9."""
    base = F.when(mode == "small", F.greatest(least, F.lit(SMALL_CONFIDENCE))).otherwise(least)
    return F.greatest(F.least(base + F.greatest(raised, F.lit(0.0)), F.lit(MOST_CONFIDENCE)), base)


def decided(features: DataFrame, raised: float | Column = 0.0) -> DataFrame:
    """features with `verdict`: a model's probability against its bar where there is one, else agreement or continuity, else silence and why."""
    raise_ = F.greatest(F.lit(raised) if isinstance(raised, float) else raised, F.lit(0.0))
    agreed = F.col("agreeing_kinds") >= AGREEING
    strong = (agreed & (F.col("top_lexical") >= LEXICAL_BAR + raise_)) | ((F.col("agreeing_kinds") >= STRONGLY_AGREEING) & (F.col("top_lexical") >= STRONG_BAR + raise_))
    model = F.col("probability") if "probability" in features.columns else F.lit(None).cast("double")
    bar = F.col("bar") if "bar" in features.columns else F.lit(None).cast("double")
    verdict = (
        F.when(F.col("history_alone"), "too_few_kinds")
        .when(model.isNotNull() & (model >= bar), "calibrated")
        .when(model.isNotNull(), "unlikely")
        .when(strong, "agreement")
        .when(F.col("is_continuing") & (F.col("top_lexical") >= raise_), "continuity")
        .when(agreed, "weak_match")
        .otherwise("too_few_kinds")
    )
    return features.withColumn("verdict", verdict)


def reason(flags: dict[str, Column]) -> Column:
    """The first reason of the list that holds; null if none does."""
    return F.coalesce(*[F.when(F.coalesce(flags[k], F.lit(False)), k) for k in REASONS if k in flags], F.lit(None).cast("string"))


def listed(ranked: DataFrame, reasons: DataFrame, hidden: DataFrame, most: int = 5, looked_at: int = 4) -> DataFrame:
    """(query, file, reason, place): the ranking walked down, without files that are in context already or have no reason, at most `most` of the first most * looked_at."""
    walk = ranked.where(F.col("place") <= most * looked_at).select("query", "file", "place")
    open_ = walk.join(hidden, ["query", "file"], "left_anti").join(reasons.where("reason is not null"), ["query", "file"])
    return open_.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("place"))).where(F.col("place") <= most)


# ---------------------------------------------------------------- spans
def spans(outline: DataFrame, cap: int = 60, most: int = 2) -> DataFrame:
    """(query, file, first, last) to show of a file's outline(query, file, symbol, body_first, body_last, centre, strength).

    Bodies are taken strongest first; one that is longer than the cap is cut to it around its centre; one that touches or overlaps
    a span already held is joined to it if both together keep the cap, else it is dropped. That order decides, so a file's
    bodies, of which the strongest 16 are looked at, are folded in one array.
    """
    half = F.lit(cap // 2)
    long = (F.col("body_last") - F.col("body_first") + 1) > cap
    first = F.when(long, F.greatest(F.least(F.col("centre") - half, F.col("body_last") - cap + 1), F.col("body_first"))).otherwise(F.col("body_first"))
    cut = outline.where("strength > 0").withColumn("first", first.cast("long")).withColumn("last", F.when(long, F.col("first") + cap - 1).otherwise(F.col("body_last")).cast("long"))
    order = Window.partitionBy("query", "file").orderBy(F.desc(F.round("strength", PLACES)), "first", "symbol")
    best = cut.withColumn("k", F.row_number().over(order)).where("k <= 16")
    rows = best.groupBy("query", "file").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "first", "last"))), lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"))).alias("b"))
    beside = "x.first <= {0}.last + 1 and {0}.first <= x.last + 1"
    held_at = f"array_position(transform(held, g -> {beside.format('g')}), true) - 1"  # the first span that x touches
    fits = f"greatest(h.last, x.last) - least(h.first, x.first) + 1 <= {cap}"
    fold = f"""aggregate(b, cast(array() as array<struct<first:bigint,last:bigint>>), (held, x) -> case
      when exists(held, h -> {beside.format('h')}) then transform(held, (h, i) -> case when i = {held_at} and {fits} then named_struct('first', least(h.first, x.first), 'last', greatest(h.last, x.last)) else h end)
      when size(held) < {most} then concat(held, array(x)) else held end)"""
    return rows.select("query", "file", F.explode(F.expr(fold)).alias("s")).select("query", "file", "s.first", "s.last")


def in_context(shown: DataFrame, reads: DataFrame) -> DataFrame:
    """Spans that a read of the same, unchanged content covers: shown(query, file, content, first, last), reads(query, file, content, lo, hi); a read without a range covers all."""
    r = reads.select("query", "file", "content", "lo", "hi")
    hit = shown.join(r, ["query", "file", "content"]).where("lo is null or (lo <= first and last <= hi)")
    return hit.select(*shown.columns).distinct()
