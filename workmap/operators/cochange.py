"""Files that change together: counts, weights and the strongest partners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workmap.functions.scalar import HALF_LIFE, MAX_PARTNERS, MIN_COCHANGES, MIN_CONFIDENCE, commit_weight, partner_rank
from workmap.operators.scratch import discard, parts_for, written

#: Pairs that a task holds at once.
PART_PAIRS = 2_000_000


def numbered(df: DataFrame, bucket, order: list, name: str = "seq") -> DataFrame:
    """Rows numbered 1.. in a total order that agrees with `bucket`.

    Numbers inside a bucket come from a window over it, and buckets start where the ones before end; the table of buckets
    is an aggregate, one row each. No task sees all rows.
    """
    b = df.withColumn("_b", bucket)
    starts = b.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return b.join(starts, "_b").withColumn(name, (F.col("_start") + F.row_number().over(Window.partitionBy("_b").orderBy(*order))).cast("long")).drop("_b", "_start")


def commit_lists(changes: DataFrame, commits: DataFrame, max_files: int, parts: int | None = None) -> DataFrame:
    """(seq, files) of commits(commit, seq) with at most max_files files, sorted: mass commits say nothing about pairs.

    Changes are dealt by commit once; distinct files, their number and the list are then made where they are, and the list
    only of commits that count, so that it is bounded. With `parts`, changes are dealt over so many, as `parts_for` gives them.
    """
    dealt = changes.select("commit", "file")
    once = (dealt.repartition("commit") if parts is None else dealt.repartition(parts, "commit")).distinct()
    sizes = once.groupBy("commit").count().where(F.col("count") <= max_files).select("commit")
    return once.join(sizes, "commit").groupBy("commit").agg(F.array_sort(F.collect_list("file")).alias("files")).join(commits, "commit").select("seq", "files")


def commit_files(changes: DataFrame, commits: DataFrame, max_files: int) -> DataFrame:
    """(seq, file) of commits(commit, seq) with at most max_files files."""
    return commit_lists(changes, commits, max_files).select("seq", F.explode("files").alias("file"))


def renames_followed(changes: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(path, since, until, name) of changes(seq, path, renamed_from): what a path of commits since <= seq < until is called now.

    A path that a commit renames is, in older commits, the file of that commit's new path; from the commit on it is another file,
    if it is used again. So each renaming of a path ends a stretch of it, and leads to the stretch of the new path that the
    commit itself lies in. Where stretches lead to is found by doubling: each round a stretch takes over the name, and the
    next stretch, of the one it leads to, so a chain of n renames takes log2(n) rounds. Stretches lead to later commits
    only, so there are no circles, even where a commit swaps two paths. Commits that aren't to count must be left out.
    """
    renamed = changes.where("renamed_from is not null").groupBy(F.col("renamed_from").alias("path"), F.col("seq").alias("until")).agg(F.max("path").alias("name"))
    before = Window.partitionBy("path").orderBy("until")
    stretches = written(renamed.withColumn("since", F.coalesce(F.lag("until").over(before), F.lit(-1).cast("long"))))
    onto = stretches.select(F.col("path").alias("name"), F.col("since").alias("s"), F.col("until").alias("next"))
    # the stretch that a renaming leads to holds the renaming's own commit
    led = stretches.join(onto, "name", "left").withColumn("next", F.when((F.col("s") <= F.col("until")) & (F.col("until") < F.col("next")), F.col("next")))
    now = written(led.groupBy("path", "since", "until", "name").agg(F.max("next").alias("next")))
    discard(stretches)
    for _ in range(most_rounds):
        if now.where("next is not null").isEmpty():
            return now.drop("next")
        then = now.select(F.col("path").alias("name"), F.col("until").alias("next"), F.col("name").alias("n"), F.col("next").alias("x"))
        joined = now.join(then, ["name", "next"], "left")
        before_, now = now, written(joined.select("path", "since", "until", F.when(F.col("next").isNotNull(), F.col("n")).otherwise(F.col("name")).alias("name"), F.col("x").alias("next")))
        discard(before_)
    raise RuntimeError("renames did not settle")


def under_todays_names(changes: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """(seq, file) of changes(seq, path, renamed_from) under the names that files have now; with current(file), those that exist only.

    Paths that were never renamed are joined to nothing; of one that was, a change meets at most the stretches of its own path.
    """
    names = renames_followed(changes).select(F.col("path").alias("p"), "since", "until", "name")
    inside = (F.col("path") == F.col("p")) & (F.col("since") <= F.col("seq")) & (F.col("seq") < F.col("until"))
    files = changes.select("seq", "path").distinct().join(names, inside, "left").select("seq", F.coalesce("name", "path").alias("file")).distinct()
    return files if current is None else files.join(current.select("file"), "file", "left_semi").select("seq", "file")


def file_commits(files: DataFrame, anchor, half_life: float = HALF_LIFE) -> DataFrame:
    return files.groupBy("file").agg(F.count("*").alias("commits"), F.sum(commit_weight(anchor, F.col("seq"), half_life)).alias("weighted"))


def pair_parts(lists: DataFrame) -> int:
    """How many parts the pairs of (seq, files) make, PART_PAIRS each at most; at least as many as shuffles have."""
    pairs = lists.agg(F.sum((F.size("files") * (F.size("files") - 1) / 2).cast("long"))).first()[0] or 0
    return parts_for(lists.sparkSession, int(pairs), PART_PAIRS)


def pair_commits(files: DataFrame, anchor, half_life: float = HALF_LIFE) -> DataFrame:
    """Pairs a < b of one commit, from (seq, files) or (seq, file): made from a commit's list, whose length is bounded, by its places, then one aggregate: no self-join.

    A list is short and its pairs are many, most of them met once: lists are dealt over tasks, and pairs over parts, by how many
    pairs there are, so that what a task holds does not grow with the history.
    """
    lists = files
    if "files" not in files.columns:
        lists = written(files.groupBy("seq").agg(F.array_sort(F.collect_list("file")).alias("files"), *([F.first("anchor").alias("anchor")] if "anchor" in files.columns else [])))
    parts = pair_parts(lists)
    first = lists.where(F.size("files") > 1).repartition(parts, "seq").select("seq", commit_weight(anchor, F.col("seq"), half_life).alias("w"), "files", F.posexplode("files").alias("place", "a"))
    pairs = first.select("seq", "w", "a", F.explode(F.slice("files", F.col("place") + 2, F.size("files"))).alias("b"))
    return pairs.select(F.col("a").alias("file_a"), F.col("b").alias("file_b"), "seq", "w").repartition(parts, "file_a", "file_b").groupBy("file_a", "file_b").agg(F.count("*").alias("commits"), F.sum("w").alias("weighted"), F.max("seq").alias("last_seq"))


def merged(parts: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """Additive upsert: counts and weights of several minings add up; the latest sequence stays. With n, keys are dealt over n parts."""
    parts = parts if n is None else parts.repartition(n, *keys)
    last = [F.max("last_seq").alias("last_seq")] if "last_seq" in parts.columns else []
    return parts.groupBy(*keys).agg(F.sum("commits").alias("commits"), F.sum("weighted").alias("weighted"), *last)


def partners(pairs: DataFrame, files: DataFrame, least: int = MIN_COCHANGES, confidence: float = MIN_CONFIDENCE, most: int = MAX_PARTNERS) -> DataFrame:
    """Directed links: at least `least` co-changes, the share of the source's weighted commits, the `most` best ranked of each source."""
    often = pairs.where(F.col("commits") >= least)
    both = often.select(F.col("file_a").alias("src"), F.col("file_b").alias("dst"), "commits", "weighted").unionByName(often.select(F.col("file_b").alias("src"), F.col("file_a").alias("dst"), "commits", "weighted"))
    own = files.where("weighted > 0").select(F.col("file").alias("src"), F.col("weighted").alias("whole"))
    links = both.join(own, "src").withColumn("confidence", F.least(F.col("weighted") / F.col("whole"), F.lit(1.0))).where(F.col("confidence") >= confidence)
    # ranks are compared to nine places, so that sums in another order rank alike
    rank = Window.partitionBy("src").orderBy(F.desc(F.round(partner_rank(F.col("confidence"), F.col("commits")), 9)), "dst")
    return links.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= most).select("src", "dst", "confidence", "commits", "place")


def partners_of(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs with a wanted file on either side, each once."""
    a = pairs.join(wanted.select(F.col("file").alias("file_a")), "file_a", "left_semi")
    b = pairs.join(wanted.select(F.col("file").alias("file_b")), "file_b", "left_semi")
    return a.unionByName(b).distinct()
