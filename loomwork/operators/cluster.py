"""k-means steps, distances and agglomerative clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest_centroid(points: DataFrame, centroids: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector, cluster, distance: the nearest of centroids(cluster, center), ties to the smaller number.

    The centres are few by definition (k) and go to each task as one array.
    """
    centers = centroids.agg(F.sort_array(F.collect_list(F.struct("cluster", "center"))).alias("_c"))
    best = F.array_min(F.transform("_c", lambda c: F.struct(squared_distance(F.col(vector), c["center"]).alias("d"), c["cluster"].alias("cluster"))))
    found = points.select(key, vector).crossJoin(F.broadcast(centers)).withColumn("_b", best)
    return found.select(key, vector, "_b.cluster", F.sqrt("_b.d").alias("distance"))


def kmeans_step(points: DataFrame, centroids: DataFrame, key: str, vector: str) -> DataFrame:
    """cluster, center after one assignment and mean; a cluster without points keeps its centre."""
    near = nearest_centroid(points, centroids, key, vector)
    means = near.select("cluster", F.posexplode(vector).alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m"))
    moved = means.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("_new"))
    old = centroids.select("cluster", F.transform("center", lambda x: x.cast("double")).alias("center"))
    return old.join(moved, "cluster", "left").select("cluster", F.coalesce("_new", "center").alias("center"))


def kmeans(points: DataFrame, k: int, key: str, vector: str, iterations: int = 20, tol: float = 1e-6, init: str = "++", seed: int = 1, power: int = 1) -> DataFrame:
    """cluster, center by Lloyd steps from ++ or random starts, or random places in the points' box (init: ++, random or box; power: of the distance that weighs ++ draws).

    Each step brings k centres to the driver, never the points.
    """
    spark = points.sparkSession
    if init == "box":
        sides = points.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("i").collect()
        rng = np.random.default_rng(seed)
        centers = [[float(rng.uniform(s["low"], s["high"])) for s in sides] for _ in range(k)]
    else:
        first = points.orderBy(F.xxhash64(F.lit(seed), F.col(key))).select(vector).limit(k if init == "random" else 1).collect()
        centers = [list(map(float, r[0])) for r in first]
    frame = lambda: spark.createDataFrame([(i, c) for i, c in enumerate(centers)], "cluster int, center array<double>")
    rank = 0
    while init == "++" and 0 < len(centers) < k:
        rank += 1
        near = nearest_centroid(points, frame(), key, vector).where("distance > 0")
        # Weighted sampling: the least -ln(u) / weight is drawn in proportion to the weights.
        u = (F.pmod(F.xxhash64(F.lit(seed * 1009 + rank), F.col(key)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
        drawn = near.orderBy(-F.ln(u) / F.pow("distance", power), key).select(vector).limit(1).collect()
        if not drawn:
            break
        centers.append(list(map(float, drawn[0][0])))
    for _ in range(iterations):
        new = {r["cluster"]: list(r["center"]) for r in kmeans_step(points, frame(), key, vector).collect()}
        shift = max((sum((a - b) ** 2 for a, b in zip(centers[i], c, strict=True)) ** 0.5 for i, c in new.items()), default=0.0)
        centers = [new[i] for i in range(len(centers))]
        if shift < tol:
            break
    return frame()


def mini_batch_kmeans(points: DataFrame, centroids: DataFrame, key: str, vector: str, batches: int = 10, share: float = 0.1, seed: int = 1) -> DataFrame:
    """Centres moved by seeded batches, each to the running mean of what it was given."""
    spark = points.sparkSession
    state = {r["cluster"]: (np.array(r["center"], float), 0) for r in centroids.collect()}
    for b in range(batches):
        part = points.where(F.pmod(F.xxhash64(F.lit(seed + b), F.col(key)), F.lit(10_000)) < int(share * 10_000))
        frame = spark.createDataFrame([(c, m.tolist()) for c, (m, _) in state.items()], "cluster int, center array<double>")
        near = nearest_centroid(part, frame, key, vector)
        counts = {r["cluster"]: r["count"] for r in near.groupBy("cluster").count().collect()}
        for r in kmeans_step(part, frame, key, vector).collect():
            n = counts.get(r["cluster"], 0)
            m, seen = state[r["cluster"]]
            if n:
                state[r["cluster"]] = ((m * seen + np.array(r["center"]) * n) / (seen + n), seen + n)
    return spark.createDataFrame([(c, m.tolist()) for c, (m, _) in sorted(state.items())], "cluster int, center array<double>")


def distances(queries: DataFrame, points: DataFrame, key: str, vector: str) -> DataFrame:
    """a, b, distance of each of queries to each other of points; queries should be a stated, small set."""
    left = queries.select(F.col(key).alias("a"), F.col(vector).alias("_a"))
    right = points.select(F.col(key).alias("b"), F.col(vector).alias("_b"))
    return right.join(left, F.col("a") != F.col("b")).select("a", "b", F.sqrt(squared_distance("_a", "_b")).alias("distance"))


def distance_matrix(points: DataFrame, key: str, vector: str) -> DataFrame:
    """a, b, distance of all pairs a < b of a small set of points."""
    return distances(points, points, key, vector).where("a < b")


#: Points that _linkage() takes, which holds a matrix of all distances.
MOST_POINTS = 8000
#: Distances that a task of agglomerative() holds at once.
HELD = 16_000_000


def _linkage(x: np.ndarray, k: int, method: str) -> np.ndarray:
    """Labels of k clusters by single, complete or average linkage, the plain way: tests hold _chains() against it."""
    n = len(x)
    if n > MOST_POINTS:
        raise ValueError(f"a group of {n} points; at most {MOST_POINTS} can be clustered in one task")
    d = np.sqrt(np.stack([((x - row) ** 2).sum(axis=1) for row in x]))
    np.fill_diagonal(d, np.inf)
    label, size = np.arange(n), np.ones(n)
    alive = np.ones(n, bool)
    for _ in range(max(0, n - k)):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        row = {"single": np.minimum(d[i], d[j]), "complete": np.maximum(d[i], d[j]), "average": (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])}[method]
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
        inf = ~alive
        d[i, inf], d[inf, i] = np.inf, np.inf
    return np.unique(label, return_inverse=True)[1]


class _Rows:
    """Linkage of a cluster to all others, worked out from the points when asked for; of the clusters of most points it is kept."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, method: str, held: int):
        n = len(x)
        self.x, self.weight, self.norm = x, weight, (x * x).sum(axis=1)
        self.join, self.none = {"single": (np.minimum, np.inf), "complete": (np.maximum, -np.inf), "average": (np.add, 0.0)}[method]
        self.sums = method == "average"
        self.label, self.members, self.alive = np.arange(n), [[i] for i in range(n)], np.ones(n, bool)
        self.kept = np.empty((min(n, max(2, held // max(1, n))), n))
        self.place: dict[int, int] = {}
        self.free = list(range(len(self.kept)))
        self.block = max(1, held // 8 // max(1, n))

    def _distances(self, some: np.ndarray) -> np.ndarray:
        square = self.norm[some, None] + self.norm - 2 * (self.x[some] @ self.x.T)
        # Small differences of large numbers are worked out from the coordinates.
        for i, j in np.argwhere(square <= 1e-6 * (self.norm[some, None] + self.norm)):
            square[i, j] = ((self.x[some[i]] - self.x[j]) ** 2).sum()
        return np.sqrt(square)

    def row(self, c: int) -> np.ndarray:
        """Sum (average linkage), least or largest of the distances to each cluster."""
        if c in self.place:
            return self.kept[self.place[c]]
        own, points = np.array(self.members[c]), np.full(len(self.x), self.none)
        for at in range(0, len(own), self.block):
            some = own[at : at + self.block]
            d = self._distances(some)
            points = self.join(points, self.weight[some] @ d if self.sums else self.join.reduce(d, axis=0))
        if self.sums:
            out = np.bincount(self.label, points * self.weight, len(points))
        else:
            out = np.full(len(points), self.none)
            self.join.at(out, self.label, points)
        return self._keep(c, out)

    def _keep(self, c: int, row: np.ndarray) -> np.ndarray:
        if not self.free:
            least = min(self.place, key=lambda x: len(self.members[x]))
            if len(self.members[least]) > len(self.members[c]):
                return row
            self.free.append(self.place.pop(least))
        self.place[c] = self.free.pop()
        self.kept[self.place[c]] = row
        return self.kept[self.place[c]]

    def merge(self, a: int, b: int) -> None:
        """b becomes part of a."""
        one = self.row(a).copy()
        row = self.join(one, self.row(b))
        for c in (a, b):
            if c in self.place:
                self.free.append(self.place.pop(c))
        self.label[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []
        self.alive[b] = False
        self.kept[:, a] = self.join(self.kept[:, a], self.kept[:, b])
        row[a] = self.join(row[a], row[b])
        self._keep(a, row)


def _chains(x: np.ndarray, k: int, method: str, held: int = HELD) -> np.ndarray:
    """Labels of k clusters as of _linkage(), ties apart, in memory that is bounded but for the points: by chains of nearest neighbours.

    A cluster that is the nearest of its nearest is merged with it at once, as no other merge can come between; all merges in order
    of their distances are those that the nearest pair at each time makes. Equal points are merged first.
    """
    n = len(x)
    values, first, same = np.unique(x, axis=0, return_index=True, return_inverse=True)
    same = same.reshape(-1)
    parent = np.arange(n)

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    joins = sorted((0.0, int(first[u]), i) for i, u in enumerate(same) if first[u] != i)
    if n - k > len(joins):
        weight = np.bincount(same).astype(float)
        rows, size, height = _Rows(values - values.mean(axis=0), weight, method, held), weight.copy(), np.zeros(len(values))
        chain: list[tuple[int, float]] = []
        merges, next_start = [], 0
        while len(merges) < len(values) - 1:
            if not chain:
                while not rows.alive[next_start]:
                    next_start += 1
                chain.append((next_start, np.inf))
            c, last = chain[-1]
            d = np.where(rows.alive, rows.row(c) / (size * size[c]) if rows.sums else rows.row(c), np.inf)
            d[c] = np.inf
            near = int(np.argmin(d))
            if len(chain) == 1 or (d[near] < last and all(near != x for x, _ in chain)):
                chain.append((near, float(d[near])))
                continue
            a, b = sorted((chain[-2][0], c))
            del chain[-2:]
            rows.merge(a, b)
            size[a] += size[b]
            height[a] = max(last, height[a], height[b])
            merges.append((height[a], int(first[a]), int(first[b])))
        # A merge comes after those within it: equal distances stay in the order in which they were made.
        joins += sorted(merges, key=lambda m: m[0])
    for _, a, b in joins[: max(0, n - k)]:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    return np.unique([top(i) for i in range(n)], return_inverse=True)[1]


def agglomerative(points: DataFrame, group: str, key: str, vector: str, k: int = 3, method: str = "average") -> DataFrame:
    """group, key, cluster: each group, of any size, is clustered by itself in one task, groups in parallel.

    The time is quadratic in a group; memory holds a group's points and HELD distances.
    """
    kinds = dict(points.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        return pd.DataFrame({group: rows[group], key: rows[key], "cluster": _chains(np.stack(rows[vector].to_numpy()).astype(float), k, method)})

    return points.select(group, key, vector).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, cluster long")
