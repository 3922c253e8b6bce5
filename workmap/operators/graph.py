"""The graph of files and symbols: weighing, contraction, ranking, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workmap.functions.scalar import LINK_DECAY, decayed, link_share
from workmap.operators.spreading import TELEPORT, TOLERANCE, Adjacency, push

#: Weight of each type of edge.
TYPE_WEIGHT = {"structural": 1.0, "cochange": 0.6, "coaccess": 0.8, "about": 1.0, "containment": 0.1}


def weights(edges: DataFrame, now, factor: float = LINK_DECAY) -> DataFrame:
    """(src, dst, type, w) of edges(src, dst, type, w, last_seq): clamped strengths times their type's weight, each link as it is given."""
    strength = F.when(F.col("type") == "coaccess", link_share(decayed(F.col("w"), F.col("last_seq"), now, factor))).otherwise(F.col("w"))
    strength = F.when(F.isnan(strength), 0.0).otherwise(F.least(F.greatest(strength, F.lit(0.0)), F.lit(1.0)))
    by_type = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in TYPE_WEIGHT.items()], F.lit(0.0))
    return edges.select("src", "dst", "type", (by_type * strength).alias("w"))


def both_directions(links: DataFrame) -> DataFrame:
    """(src, dst, w) of links(src, dst, type, w): all but co-change in both directions, equal ones not summed."""
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    ways = F.explode(F.when(F.col("type") == "cochange", F.slice(ends, 1, 1)).otherwise(ends)).alias("way")
    return links.select("w", ways).select("way.src", "way.dst", "w")


def weighed(edges: DataFrame, now, factor: float = LINK_DECAY, parts: int | None = None) -> DataFrame:
    """edges(src, dst, type, w, last_seq) with clamped strengths times their type's weight, all but co-change in both directions; equal links sum, their peak is kept. With `parts`, links are dealt over so many by their ends."""
    one = weights(edges, now, factor)
    back = one.where("type <> 'cochange'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "w")
    both = one.unionByName(back)
    both = both if parts is None else both.repartition(parts, "src", "dst")
    return both.groupBy("src", "dst", "type").agg(F.sum("w").alias("w"), F.max("w").alias("peak"))


def by_files(edges: DataFrame, file_of: DataFrame, parts: int | None = None) -> DataFrame:
    """Edges lifted to the files of their ends; those inside a file drop, equal ones sum. With `parts`, they are dealt over so many by their dst, and in its order there."""
    a, b = file_of.select(F.col("node").alias("src"), F.col("file").alias("f")), file_of.select(F.col("node").alias("dst"), F.col("file").alias("t"))
    met = edges.join(a, "src").join(b, "dst").where("f <> t")
    met = met if parts is None else met.repartition(parts, "t")
    out = met.groupBy(F.col("f").alias("src"), F.col("t").alias("dst")).agg(F.sum("w").alias("w"))
    return out if parts is None else out.sortWithinPartitions("dst")


def spread(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, teleport: float = TELEPORT) -> DataFrame:
    """Personalised page rank of seeds(node, weight): (node, score), short of the exact ranks by at most `tolerance` in all; mass at nodes without ways out is dropped."""
    total = seeds.agg(F.sum("weight").alias("all"))
    start = seeds.crossJoin(total).select(F.lit(0).alias("query"), "node", (F.col("weight") / F.col("all")).alias("w"))
    links = Adjacency(edges)
    ranks = push(links, start, tolerance, teleport)
    links.discard()
    return ranks.where("kept > 0").select("node", F.col("kept").alias("score"))


def strongest(links: DataFrame, most: int = 8) -> DataFrame:
    """links(a, b, weight) that are among the `most` strongest of either end."""
    ends = links.select("a", "b", "weight", F.explode(F.array("a", "b")).alias("end"))
    rank = Window.partitionBy("end").orderBy(F.desc("weight"), "a", "b")
    return ends.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= most).select("a", "b", "weight").distinct()


def among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends in nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def exploration(edges: DataFrame, seeds: DataFrame, lit_: DataFrame, strongest_seeds: int = 10, most: int = 20) -> DataFrame:
    """Unlit neighbours of the strongest seeds, the heaviest `most`."""
    top = seeds.orderBy(F.desc("weight"), "node").limit(strongest_seeds).select(F.col("node").alias("src"))
    near = edges.join(F.broadcast(top), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.max("w").alias("w"))
    return near.join(lit_.select("node"), "node", "left_anti").orderBy(F.desc("w"), "node").limit(most)


def both_ways(edges: DataFrame, path: str) -> DataFrame:
    """Links of one end: out and in, itself excluded, the heaviest of each other end and type."""
    out = edges.where(F.col("src") == path).select(F.col("dst").alias("other"), "type", "w")
    into = edges.where(F.col("dst") == path).select(F.col("src").alias("other"), "type", "w")
    return out.unionByName(into).where(F.col("other") != path).groupBy("other", "type").agg(F.max("w").alias("w"))
