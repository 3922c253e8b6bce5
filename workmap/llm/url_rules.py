"""URL filtering: hand-written rules by host and path, and mined association rules for what they leave open.

FP-growth finds combinations of URL tokens that go with a bad label; rules of enough support, confidence and
lift stay. An inverted index from tokens to rules judges URLs: a rule matches when all of its tokens do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workmap.llm.common import table, written


@dataclass(frozen=True)
class Rule:
    """Fits a host, its subdomains, and paths that start with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
#: Mining: share of labelled pages with a combination and a bad label, share of bad ones among those with the combination,
#: how much more often bad than all pages, most tokens of a rule, most labelled pages that it is fitted on.
SUPPORT, CONFIDENCE, LIFT, MOST_TOKENS, SAMPLE_ROWS = 0.002, 0.3, 1.5, 3, 50_000
_BAD = "\u0000bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What is between the first :// and the next /, ?, # or the end, A-Z lower-cased; '' without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; '' without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: its host and the domains above it, the words of its host, its folders, whether it ends in a file."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.split(host, r"[.\-_]+"), lambda w: F.concat(F.lit("h:"), w))
    folders = F.transform(F.filter(F.split(path, "/"), lambda p: (F.length(p) > 0) & ~p.rlike("[0-9]")), lambda p: F.concat(F.lit("p:"), p))
    kind = F.when(path.rlike(r"\.[A-Za-z]+$"), F.array(F.concat(F.lit("x:"), F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)))).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(host) > 0, F.array_distinct(F.concat(domains, words, folders, kind))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, most_tokens: int = MOST_TOKENS, most_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(rule_id, tokens, rarest, confidence, support) of combinations that go with bad pages, from labelled(id, tokens, bad).

    Fitted on at most `most_rows` rows, taken by a hash of the id, with all of their tokens. Tokens that the same rows have (the
    folders of one long path, say) are mined as one, so that what always stands together doesn't multiply combinations, and come
    apart again in the rules. Every rule of enough support, confidence and lift stays but those of which a part is as sure.
    `rarest` is the token of a rule that the fewest rows have. A rule's id is a hash of its tokens.
    """
    spark = labelled.sparkSession
    sample = written(labelled.where("size(tokens) > 0 and bad is not null").orderBy(F.xxhash64("id"), "id").limit(most_rows).select(F.monotonically_increasing_id().alias("row"), F.array_distinct("tokens").alias("tokens"), "bad"))
    if sample.isEmpty():
        return spark.createDataFrame([], "rule_id long, tokens array<string>, rarest string, confidence double, support double")
    # a token's rows, as a count and two sums of hashes; the smallest token stands for all with the same rows
    each = sample.select("row", F.explode("tokens").alias("token"))
    held = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(38,0)")).alias("b"))
    least = F.min("token").over(Window.partitionBy("n", "a", "b"))
    held = written(held.where(F.col("n") >= 1).select("token", "n", least.alias("stands")))
    bad = F.when(F.first("bad"), F.array(F.lit(_BAD))).otherwise(F.array().cast("array<string>"))
    rows = each.join(held.where("token = stands").select("token"), "token").join(sample.select("row", "bad"), "row").groupBy("row").agg(F.concat(F.collect_list("token"), bad).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(rows).associationRules
    rules = written(found.where(F.array_contains("consequent", _BAD) & (F.size("antecedent") <= most_tokens) & (F.col("lift") >= lift)).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"))
    # every smaller combination of a rule's tokens, and whether it is a rule that is as sure
    bits = F.sequence(F.lit(1), F.pow(F.lit(2), F.size("tokens")).cast("int") - 2)
    part = F.expr("filter(tokens, (x, i) -> shiftright(bits, i) & 1 = 1)")
    smaller = rules.where(F.size("tokens") > 1).withColumn("bits", F.explode(bits)).select("tokens", "confidence", part.alias("part"))
    surer = smaller.join(rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("c")), "part").where("c >= confidence").select("tokens").distinct()
    open_ = rules.join(surer, "tokens", "left_anti").select(F.array().cast("array<struct<n:bigint,token:string>>").alias("own"), "tokens", "confidence", "support")
    for _ in range(most_tokens):  # what each token stands for, one after another
        member = held.select(F.col("stands").alias("next"), F.struct("n", "token").alias("member"))
        ready, more = open_.where("size(tokens) = 0"), open_.where("size(tokens) > 0")
        more = more.withColumn("next", F.col("tokens")[0]).join(member, "next").select(F.concat("own", F.array("member")).alias("own"), F.expr("slice(tokens, 2, size(tokens))").alias("tokens"), "confidence", "support")
        open_ = ready.unionByName(more)
    tokens = F.array_sort(F.transform("own", lambda x: x["token"]))
    return written(open_.select(F.xxhash64(F.array_join(tokens, "\n")).alias("rule_id"), tokens.alias("tokens"), F.array_min("own")["token"].alias("rarest"), "confidence", "support"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, rule_id, confidence) of the surest rule that each row of urls(key, tokens) matches, by the inverted index of rules.

    A rule stands in the index under its rarest token, so only URLs with that one meet it, and show there whether they have the
    others. The index goes to where the URLs are if Spark finds it small enough to broadcast, else both meet by token.
    """
    index = rules.select("rule_id", "confidence", F.col("tokens").alias("need"), F.col("rarest").alias("token"))
    hits = urls.select("key", "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("need", "tokens")) == 0)
    best = F.max_by(F.struct("rule_id", "confidence"), F.struct("confidence", -F.col("rule_id")))
    return hits.groupBy("key").agg(best.alias("m")).select("key", "m.rule_id", "m.confidence")


def fitting(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, nulls without; of rules of one length the last."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[Rule, ...] = RULES, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the mined rule's id, or null) of each row of pages(page_id, url).

    labelled(page_id, bad) gives labels for some pages; a page labelled more than once is bad if any label says so. A URL that
    no hand-written rule fits is blocked if a mined rule matches, else allowed. Null URLs and those without :// have empty
    host and path, no tokens, and are allowed. Rows that repeat are judged alike; other columns aren't read.
    """
    url = F.col("url").cast("string")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    y = labelled.where("page_id is not null and bad is not null").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max(F.col("bad").cast("boolean")).alias("bad"))
    known = p.join(y, "page_id").select(F.col("page_id").alias("id"), tokens_of(F.col("host"), F.col("path")).alias("tokens"), "bad")
    mined = mine(known, **mining)
    # the key is what decides: equal URLs are matched once
    places = p.groupBy("host", "path").agg(F.lit(1).alias("one")).select(F.struct("host", "path").alias("key"), tokens_of(F.col("host"), F.col("path")).alias("tokens"))
    found = matched(places, mined).select(F.col("key.host").alias("host"), F.col("key.path").alias("path"), F.col("rule_id").alias("mined"))
    name, verdict = fitting(F.col("host"), F.col("path"), rules)
    return p.join(found, ["host", "path"], "left").select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined")


def query(spark, sf_dir: str) -> DataFrame:
    """Pages whose label (that of the document with the same number) says low quality are the bad ones."""
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), labelled)
