"""Git's own texts as relations: blame, commit messages, the state of a work tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Subjects that say a change is trivial, ends of bots' names, most files of a normal change, most issues of a card, characters of a subject.
TRIVIAL = r"(?i)^(fix(ed)? )?(typos?|whitespace|formatting|format|lint|style|cosmetic|bump|merge)\b"
BOT, MOST_FILES, MOST_ISSUES, SUBJECT = r"(?i)(\[bot\]|-bot)$", 30, 3, 120
PULL_REQUEST, ISSUE = r"(?:\(#|[Pp]ull [Rr]equest #|\(!)([0-9]+)", r"(?:^|[\s(:])((?:[A-Z][A-Z0-9]+-[0-9]+)|(?:(?:[Ff]ixes|[Cc]loses|[Rr]esolves|[Rr]efs?) #[0-9]+))"


def blame_runs(texts: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, oid, first, last, source) of blame listings with a head for each line, `oid source final [count]`: lines in a row that one commit has in a row are one run.

    Gaps and islands: where a commit goes on, final and source lines grow together, so their difference names the island.
    """
    lines = texts.select(file, F.explode(F.split(text, "\n")).alias("l"))
    head = r"^([0-9a-f]{40,64}) ([0-9]+) ([0-9]+)(?: [0-9]+)?$"
    rows = lines.where(F.col("l").rlike(head)).select(file, F.regexp_extract("l", head, 1).alias("oid"), F.regexp_extract("l", head, 2).cast("long").alias("s"), F.regexp_extract("l", head, 3).cast("long").alias("f"))
    k = F.row_number().over(Window.partitionBy(file, "oid", F.col("f") - F.col("s")).orderBy("f"))
    return rows.withColumn("i", F.col("f") - k).groupBy(file, "oid", F.col("f") - F.col("s"), "i").agg(F.min("f").alias("first"), F.max("f").alias("last"), F.min("s").alias("source")).select(file, "oid", "first", "last", "source")


def cards(commits: DataFrame) -> DataFrame:
    """commits(oid, author, subject, body, n_files) as cards: kind (mass, bot, trivial, normal: the first that holds), pull request, at most three issues, a line of reason."""
    message = F.concat_ws("\n", "subject", "body")
    kind = F.when(F.col("n_files") > MOST_FILES, "mass").when(F.trim("author").rlike(BOT), "bot").when(F.col("subject").rlike(TRIVIAL), "trivial").otherwise("normal")
    number = F.regexp_extract(message, PULL_REQUEST, 1)
    issues = F.slice(F.array_distinct(F.transform(F.regexp_extract_all(message, F.lit(ISSUE)), lambda x: F.regexp_replace(x, r"^[A-Za-z]+ ", ""))), 1, MOST_ISSUES)
    body = F.filter(F.split(F.coalesce("body", F.lit("")), "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^[A-Za-z-]+: ") & ~x.startswith("#"))
    return commits.select("oid", F.substring(F.trim("subject"), 1, SUBJECT).alias("subject"), kind.alias("kind"), F.when(number != "", number.try_cast("long")).alias("pull_request"), issues.alias("issues"), F.get(body, F.lit(0)).alias("reason"))


def uncommitted(status: DataFrame, text: str = "text", most: int = 1000) -> DataFrame:
    """(path, state) of a work tree's short status: two letters, a space, a path, renames with an arrow; the first `most` by path."""
    line = status.select(F.explode(F.split(text, "\n")).alias("l")).where(F.length("l") > 3)
    target: Column = F.element_at(F.split(F.substr("l", F.lit(4)), " -> "), -1)
    return line.select(target.alias("path"), F.trim(F.substring("l", 1, 2)).alias("state")).where("state <> '!!'").orderBy("path").limit(most)
