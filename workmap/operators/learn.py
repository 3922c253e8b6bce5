"""What tasks teach: interest, links, transitions, labels, statistics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workmap.functions.scalar import INTEREST_DECAY, LANDMARK, LINK_CAP, LINK_DECAY, decayed, tier

#: Interest by kind of event; roles in a task and their weights; gain by outcome; learning rate.
EARNED = {"edit": 1.0, "read": 0.3}
ROLE_WEIGHT = {"edited": 1.0, "read_and_used": 0.6, "given_and_used": 0.4, "read_only": 0.2}
GAIN = {"success": 1.0, "unknown": 0.3}
ETA = 0.1


def interest(events: DataFrame, now, factor: float = INTEREST_DECAY) -> DataFrame:
    """(node, score): earned interest, each task's share decayed to now. No clamp binds, so the fold is a sum."""
    earned = F.when(F.col("kind") == "edit", EARNED["edit"]).when(F.col("kind") == "read", EARNED["read"]).otherwise(0.0)
    return events.where("node is not null").groupBy("node").agg(F.sum(decayed(earned, F.col("task_seq"), now, factor)).alias("score"))


def landmarks(scores: DataFrame, files: int, least: float = LANDMARK) -> DataFrame:
    """Nodes of score `least` or more, at most a hundredth of the files but 5 to 50, with their tiers."""
    most = min(50, max(5, -(-files // 100)))
    top = scores.where(F.col("score") >= least).orderBy(F.desc("score"), "node").limit(most).select("node", F.lit(True).alias("top"))
    flag = F.coalesce("top", F.lit(False))
    return scores.join(F.broadcast(top), "node", "left").select("node", "score", tier(F.col("score"), flag).alias("tier"))


def file_roles(tasked: DataFrame) -> DataFrame:
    """The best role of each node in a task: edited, else read; a read node whose task edits it later counts as edited."""
    role = F.max(F.when(F.col("kind") == "edit", F.struct(F.lit(3).alias("r"), F.lit("edited").alias("role"))).when(F.col("kind") == "read", F.struct(F.lit(0).alias("r"), F.lit("read_only").alias("role"))))
    return tasked.where("node is not null and kind in ('read', 'edit')").groupBy("session", "task", "node").agg(role.alias("x")).select("session", "task", "node", "x.role")


def role_weight(role) -> F.Column:
    return F.coalesce(*[F.when(role == k, v) for k, v in ROLE_WEIGHT.items()], F.lit(0.0))


def coaccess(roles: DataFrame, outcomes: DataFrame, most: int = 40, eta: float = ETA) -> DataFrame:
    """(a, b, task_seq, add): for each pair of a task's nodes the product of their roles, the outcome's gain and eta; tasks with over `most` nodes keep those of the best roles."""
    best = Window.partitionBy("session", "task").orderBy(F.desc(role_weight(F.col("role"))), "node")
    own = roles.withColumn("k", F.row_number().over(best)).where(F.col("k") <= most).drop("k").join(outcomes, ["session", "task"])
    gain = F.when(F.col("outcome") == "success", GAIN["success"]).when(F.col("outcome") == "unknown", GAIN["unknown"]).otherwise(0.0)
    own = own.withColumn("gain", gain).where("gain > 0").withColumn("w", role_weight(F.col("role")))
    a = own.select("session", "task", "task_seq", "gain", F.col("node").alias("a"), F.col("w").alias("wa"))
    b = own.select("session", "task", F.col("node").alias("b"), F.col("w").alias("wb"))
    return a.join(b, ["session", "task"]).where("a < b").select("a", "b", "task_seq", (F.lit(eta) * F.col("wa") * F.col("wb") * F.col("gain")).alias("add"))


def link_sums(adds: DataFrame, now, factor: float = LINK_DECAY) -> DataFrame:
    return adds.groupBy("a", "b").agg(F.sum(decayed(F.col("add"), F.col("task_seq"), now, factor)).alias("weight"), F.count("*").alias("n"), F.max("task_seq").alias("last_seq"))


def link_folds(adds: DataFrame, factor: float = LINK_DECAY, cap: float = LINK_CAP) -> DataFrame:
    """Links where the cap may bind: decay, add and clamp in the order of tasks, one fold over each link's adds."""
    per_task = adds.groupBy("a", "b", "task_seq").agg(F.sum("add").alias("add"))
    ordered = per_task.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("task_seq", "add"))).alias("steps"))
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("at"))

    def step(acc, x):
        faded = acc["w"] * F.pow(F.lit(factor), (x["task_seq"] - acc["at"]).cast("double"))
        return F.struct(F.least(F.greatest(faded + x["add"], F.lit(0.0)), F.lit(cap)).alias("w"), x["task_seq"].alias("at"))

    end = F.aggregate("steps", start, step)
    return ordered.select("a", "b", end["w"].alias("weight"), F.size("steps").cast("long").alias("n"), end["at"].alias("last_seq"))


def walks(tasked: DataFrame, most: int = 20) -> DataFrame:
    """(session, task, src, dst): consecutive different nodes in the order of first reads before the first edit, then that edit's node."""
    touched = tasked.where("node is not null and task > 0 and kind in ('read', 'edit')")
    edit = touched.where("kind = 'edit'").groupBy("session", "task").agg(F.min(F.struct("ts", "seq", "node")).alias("e"))
    reads = touched.where("kind = 'read'").join(edit, ["session", "task"], "left").where("e is null or struct(ts, seq) < struct(e.ts, e.seq)")
    first = reads.groupBy("session", "task", "node").agg(F.min(F.struct("ts", "seq")).alias("at"))
    order = Window.partitionBy("session", "task").orderBy("at")
    ranked = first.withColumn("k", F.row_number().over(order))
    capped = ranked.groupBy("session", "task").agg((F.max("k") > most).alias("capped"))
    last = edit.join(capped, ["session", "task"], "left").where("not coalesce(capped, false)").select("session", "task", F.col("e.node").alias("node"), F.lit(most + 1).alias("k"))
    walk = ranked.where(F.col("k") <= most).select("session", "task", "node", "k").unionByName(last)
    step = walk.withColumn("dst", F.lead("node").over(Window.partitionBy("session", "task").orderBy("k")))
    return step.where("dst is not null and dst <> node").select("session", "task", F.col("node").alias("src"), "dst").distinct()


def transitions(steps: DataFrame, now, factor: float = LINK_DECAY) -> DataFrame:
    return steps.groupBy("src", "dst").agg(F.sum(decayed(F.col("gain"), F.col("task_seq"), now, factor)).alias("weight"), F.count("*").alias("n"))


def next_file(ways: DataFrame, least: float = 2.0, majority: float = 0.5) -> DataFrame:
    """The one way on from a node that is strong enough and holds more than the majority of its outgoing weight."""
    total = ways.groupBy("src").agg(F.sum("weight").alias("total"), F.max(F.struct("weight", (-F.col("dst")).alias("d"))).alias("m"))
    return total.where((F.col("m.weight") >= least) & (F.col("m.weight") > majority * F.col("total"))).select("src", (-F.col("m.d")).alias("dst"), F.col("m.weight").alias("weight"))


def labelled(injections: DataFrame, first: int = 3) -> DataFrame:
    """used_count over all files of an injection, and whether one of its first ones was used; injections(injection, pos, used)."""
    return injections.groupBy("injection").agg(F.count_if("used").alias("used_count"), F.coalesce(F.bool_or(F.col("used") & (F.col("pos") < first)), F.lit(False)).alias("label"))


def recent_precision(labels: DataFrame, window: int = 100) -> DataFrame:
    recent = labels.orderBy(F.desc("at"), F.desc("id")).limit(window)
    return recent.agg(F.count("*").alias("labelled"), F.count_if("label").alias("used"), F.round(F.avg(F.col("label").cast("double")), 6).alias("precision"))


def auc(scored: DataFrame) -> DataFrame:
    """Mann-Whitney with average ranks: counts of each distinct score, summed over buckets of scores first, so that a window holds no more than the buckets or one bucket's scores.

    Buckets end at approximate quantiles of the distinct scores, so skewed scores fill them alike.
    """
    by = scored.groupBy("score").agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    # equal scores share a bucket; buckets are ranges, so what is below a score is in buckets below or in its own
    ends = by.agg(F.percentile_approx("score", [k / 128 for k in range(1, 128)], 1000).alias("ends"))
    placed = by.crossJoin(F.broadcast(ends)).withColumn("b", F.size(F.filter("ends", lambda e: e < F.col("score")))).drop("ends")
    sums = placed.groupBy("b").agg(F.sum("neg").alias("n_b"))
    below_b = sums.withColumn("below_b", F.coalesce(F.sum("n_b").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_b")
    inside = Window.partitionBy("b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = placed.withColumn("own", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(F.broadcast(below_b), "b").withColumn("below", F.col("own") + F.col("below_b"))
    total = below.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return total.select(F.round(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("u") / (F.col("p") * F.col("n"))), 6).alias("auc"), F.col("p").alias("positives"), F.col("n").alias("negatives"))


def logistic_fit(samples: DataFrame, inputs: list[str], label: str, penalty: float = 1.0, steps: int = 40, settled: float = 1e-8) -> list[float]:
    """Intercept and weights of the least summed loss plus penalty/2 of the squared weights (the intercept is free).

    Each step is one aggregate over the samples: loss, gradient and curvature at the weights it was asked for. Steps are damped:
    where the loss grew, the curvature is raised and the step is made again from the last good weights. It ends when the
    gradient is as good as flat.
    """
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in inputs)]
    y, n = F.col(label).cast("double"), len(inputs) + 1
    ridge = np.array([0.0] + [penalty] * (n - 1))
    at = [(i, j) for i in range(n) for j in range(i + 1)]

    def asked(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = reduce(Column.__add__, [F.lit(float(v)) * c for v, c in zip(w, x, strict=True)])
        p = 1 / (1 + F.exp(-z))
        loss = F.sum(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z)
        row = [v or 0.0 for v in samples.agg(loss, *[F.sum((p - y) * c) for c in x], *[F.sum(p * (1 - p) * x[i] * x[j]) for i, j in at]).first()]
        h = np.zeros((n, n))
        for (i, j), v in zip(at, row[1 + n :], strict=True):
            h[i, j] = h[j, i] = v
        return row[0] + float(ridge @ (w * w)) / 2, np.array(row[1 : 1 + n]) + ridge * w, h + np.diag(ridge)

    w, damping = np.zeros(n), 1e-9
    loss, gradient, curvature = asked(w)
    for _ in range(steps):
        if np.linalg.norm(gradient) <= settled * (1 + abs(loss)):
            break
        tried = w - np.linalg.solve(curvature + damping * np.eye(n), gradient)
        new = asked(tried)
        if new[0] <= loss:
            w, damping, (loss, gradient, curvature) = tried, max(damping / 10, 1e-12), new
        else:
            damping = max(damping * 100, 1e-3)
    return [float(v) for v in w]


def archetypes(episodes: DataFrame, bar: float = 0.5, most: int = 256) -> DataFrame:
    """Greedy clusters of tasks by their files: a task joins the oldest cluster whose first task shares `bar` of its files' union.

    The order of tasks decides, so it is one fold; it reads at most the records that the caller passes (a budget of the newest).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        seeds: list[set] = []
        members: list[list[int]] = []
        by_file: dict[int, list[int]] = {}
        for seq, files in zip(pdf["seq"], pdf["files"], strict=True):
            own = set(files)
            if not own:
                continue
            best, like = -1, bar
            for c in sorted({c for f in own for c in by_file.get(f, ())}):
                j = len(own & seeds[c]) / len(own | seeds[c])
                if j > like or j == like and best < 0:
                    best, like = c, j
            if best < 0:
                for f in own:
                    by_file.setdefault(f, []).append(len(seeds))
                seeds.append(own)
                members.append([seq])
            else:
                members[best].append(seq)
        order = sorted(range(len(seeds)), key=lambda c: (-len(members[c]), -max(members[c])))[:most]
        return pd.DataFrame({"cluster": range(len(order)), "tasks": [len(members[c]) for c in order], "newest": [max(members[c]) for c in order], "seed_files": [sorted(seeds[c]) for c in order]})

    return episodes.withColumn("_all", F.lit(True)).groupBy("_all").applyInPandas(run, "cluster long, tasks long, newest long, seed_files array<long>")


def bootstrap_mean(values: DataFrame, replicates: int = 200, seed: int = 9) -> DataFrame:
    """Percentile interval of a mean: each row has a Poisson count in each replicate, drawn by a hash of its id, so replicates are sums in one pass."""
    u = F.pmod(F.xxhash64(F.col("id"), F.col("r"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    times = F.when(u < 0.367879, 0).when(u < 0.735759, 1).when(u < 0.919699, 2).when(u < 0.981012, 3).when(u < 0.99634, 4).otherwise(5)
    each = values.select("id", "value", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("r")).withColumn("t", times)
    means = each.groupBy("r").agg((F.sum(F.col("t") * F.col("value")) / F.sum("t")).alias("m"))
    return means.agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))
