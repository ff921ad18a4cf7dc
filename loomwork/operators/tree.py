"""Decision trees: impurity, best splits by windows, a tree grown level by level, a threshold stump."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered import neighbour, running


def impurity(counts: list[Column], criterion: str = "gini") -> Column:
    """gini, entropy (base 2) or misclass of class counts; 0 for none."""
    total = sum(counts[1:], counts[0])
    share = [F.when(total > 0, c / total).otherwise(0.0) for c in counts]
    if criterion == "gini":
        return 1 - sum((p * p for p in share[1:]), share[0] * share[0])
    if criterion == "entropy":
        terms = [F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in share]
        return sum(terms[1:], terms[0])
    if criterion == "misclass":
        return 1 - (F.greatest(*share) if len(share) > 1 else share[0])
    raise ValueError(f"criterion {criterion!r}")


def split_scores(df: DataFrame, x: str, y: str, classes: list, criterion: str = "gini", min_samples: int = 1, group: str | None = None) -> DataFrame:
    """group?, threshold, impurity (weighted) of each border between different values where both sides have min_samples.

    Rows are first counted by value; sums over values in order are worked out in ranges, so that no task has them all.
    """
    keys = [group] if group else []
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("x")).agg(*(F.sum(F.when(F.col(y) == c, 1).otherwise(0)).alias(f"c{i}") for i, c in enumerate(classes)))
    ids = range(len(classes))
    rows = neighbour(running(counts, ["x"], {f"l{i}": f"c{i}" for i in ids}, keys), ["x"], F.col("x"), "_next", keys, ahead=True)
    # One row for each group.
    totals = counts.groupBy(*[F.col(k).alias("_g") for k in keys]).agg(*(F.sum(f"c{i}").alias(f"t{i}") for i in ids))
    rows = rows.join(F.broadcast(totals), F.col(group).eqNullSafe(F.col("_g"))) if group else rows.crossJoin(F.broadcast(totals))
    left = [F.col(f"l{i}") for i in ids]
    right = [F.col(f"t{i}") - F.col(f"l{i}") for i in ids]
    nl, nr = sum(left[1:], left[0]), sum(right[1:], right[0])
    out = rows.where(F.col("_next").isNotNull()).withColumn("_nl", nl).withColumn("_nr", nr).where((F.col("_nl") >= min_samples) & (F.col("_nr") >= min_samples))
    score = (impurity(left, criterion) * F.col("_nl") + impurity(right, criterion) * F.col("_nr")) / (F.col("_nl") + F.col("_nr"))
    return out.select(*keys, ((F.col("x") + F.col("_next")) / 2).alias("threshold"), score.alias("impurity"))


def best_split(df: DataFrame, x: str, y: str, classes: list, criterion: str = "gini", min_samples: int = 1, group: str | None = None) -> DataFrame:
    """The split of least impurity (of each group), the smallest threshold on ties."""
    best = F.min(F.struct(F.round("impurity", 12).alias("r"), "threshold", "impurity")).alias("b")
    scores = split_scores(df, x, y, classes, criterion, min_samples, group)
    return (scores.groupBy(group).agg(best) if group else scores.agg(best)).select(*([group] if group else []), "b.threshold", "b.impurity")


def features_tried(features: list[str], how: str | int | None, node: int, seed: int = 1) -> list[str]:
    """The features that a node may split on: all, or sqrt, log2 or a number of them, drawn for each node."""
    n = len(features)
    k = {None: n, "sqrt": max(1, int(n**0.5)), "log2": max(1, int(math.log2(n)))}.get(how, how)
    return sorted(random.Random(seed * 1_000_003 + node).sample(features, min(n, k)))


def grow_tree(df: DataFrame, features: list[str], y: str, classes: list, max_depth: int = 3, min_samples: int = 2, criterion: str = "gini", max_features: str | int | None = None, heuristic: bool = False, seed: int = 1) -> list[dict]:
    """Nodes (id, feature, threshold, counts); children of i are 2i+1 (at or below the threshold) and 2i+2.

    max_features: features_tried() at each node. heuristic: the only threshold tried is half way between the means of a feature
    over the first class and over the others, which takes one aggregate and no order.

    A level is one pass over all rows and features; the driver holds one row a node.
    """
    nodes: list[dict] = []
    where: dict[int, Column] = {0: F.lit(True)}
    for depth in range(max_depth + 1):
        at = F.lit(None).cast("int")
        for i, c in where.items():
            at = F.when(c, i).otherwise(at)
        rows = df.withColumn("_node", at).where("_node is not null")
        sums = {r["_node"]: [r[f"c{i}"] for i in range(len(classes))] for r in rows.groupBy("_node").agg(*(F.sum(F.when(F.col(y) == c, 1).otherwise(0)).alias(f"c{i}") for i, c in enumerate(classes))).collect()}
        best: dict[int, tuple] = {}
        if depth < max_depth:
            tried = {i: features_tried(features, max_features, i, seed) for i in where}
            for f in features:
                open_ = rows.where(F.col("_node").isin([i for i in where if f in tried[i]]))
                split = _mean_split if heuristic else best_split
                for r in split(open_, f, y, classes, criterion, min_samples, "_node").collect() if any(f in t for t in tried.values()) else ():
                    best[r["_node"]] = min(best.get(r["_node"], (9.0,)), (round(r["impurity"], 12), f, r["threshold"]))
        below: dict[int, Column] = {}
        for i, counts in sorted(sums.items()):
            split = best.get(i) if max(counts) < sum(counts) else None
            nodes.append({"id": i, "feature": split[1] if split else None, "threshold": split[2] if split else None, "counts": counts})
            if split:
                below[2 * i + 1] = where[i] & (F.col(split[1]) <= split[2])
                below[2 * i + 2] = where[i] & (F.col(split[1]) > split[2])
        if not below:
            break
        where = below
    return nodes


def _mean_split(df: DataFrame, x: str, y: str, classes: list, criterion: str, min_samples: int, group: str) -> DataFrame:
    """group, threshold, impurity of the threshold between two classes' means."""
    rows = df.where(F.col(x).isNotNull()).select(F.col(group), F.col(x).cast("double").alias("x"), F.col(y).alias("y"))
    first = F.col("y") == classes[0]
    cut = rows.groupBy(group).agg(((F.avg(F.when(first, F.col("x"))) + F.avg(F.when(~first, F.col("x")))) / 2).alias("threshold")).where("threshold is not null")
    ids = range(len(classes))
    side = lambda name, holds: [F.sum(F.when(holds & (F.col("y") == classes[i]), 1).otherwise(0)).alias(f"{name}{i}") for i in ids]
    above = F.col("x") > F.col("threshold")
    sums = rows.join(F.broadcast(cut), group).groupBy(group, "threshold").agg(*side("l", ~above), *side("r", above))
    left, right = ([F.col(f"{n}{i}") for i in ids] for n in "lr")
    nl, nr = sum(left[1:], left[0]), sum(right[1:], right[0])
    score = (impurity(left, criterion) * nl + impurity(right, criterion) * nr) / (nl + nr)
    return sums.where((nl >= min_samples) & (nr >= min_samples)).select(group, "threshold", score.alias("impurity"))


def tree_column(nodes: list[dict], classes: list) -> Column:
    """The class that a tree gives, as one conditional."""
    by_id = {n["id"]: n for n in nodes}

    def at(i: int) -> Column:
        n = by_id[i]
        if n["feature"] is None or 2 * i + 1 not in by_id or 2 * i + 2 not in by_id:
            return F.lit(classes[max(range(len(classes)), key=lambda k: (n["counts"][k], -k))])
        return F.when(F.col(n["feature"]) <= n["threshold"], at(2 * i + 1)).otherwise(at(2 * i + 2))

    return at(0)


def stump(df: DataFrame, x: str, y: str, step: float = 0.1, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """threshold, error of the grid's best rule y = (x > threshold), the smallest on ties.

    Each row adds to its grid cell only; errors of all thresholds follow from sums over cells.
    """
    n = round((high - low) / step) + 1
    cell = F.least(F.greatest(F.ceil((F.col(x) - low) / step - 1e-9), F.lit(0)), F.lit(n)).cast("int")
    cells = df.where(F.col(x).isNotNull()).groupBy(cell.alias("c")).agg(F.sum(F.when(F.col(y) > 0, 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    grid = df.sparkSession.range(n + 1).select(F.col("id").cast("int").alias("c")).join(F.broadcast(cells), "c", "left").na.fill(0)
    w = Window.orderBy("c")
    every = Window.partitionBy()
    neg = F.col("n") - F.col("p")
    scored = grid.select("c", ((F.sum("p").over(w) + F.sum(neg).over(every) - F.sum(neg).over(w)) / F.sum("n").over(every)).alias("error")).where(F.col("c") < n)
    return scored.agg(F.min(F.struct(F.round("error", 12).alias("r"), "c", "error")).alias("b")).select((F.lit(low) + F.col("b.c") * step).alias("threshold"), "b.error")


def save_tree(spark: SparkSession, nodes: list[dict], path: str) -> None:
    """Writes the nodes of grow_tree() as JSON lines below path."""
    spark.createDataFrame([(json.dumps(n),) for n in nodes], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_tree(spark: SparkSession, path: str) -> list[dict]:
    return sorted((json.loads(r["value"]) for r in spark.read.text(path).collect()), key=lambda n: n["id"])
