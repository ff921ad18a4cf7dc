"""Statistics and quality metrics as one-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import neighbour, numbered, running


def zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with z_<col>: less the mean, by the population deviation (0 where that is 0)."""
    stats = df.agg(*(f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.crossJoin(F.broadcast(stats))
    for c in cols:
        out = out.withColumn(f"z_{c}", F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0))
    return out.drop(*(f"_{n}_{c}" for c in cols for n in "ms"))


def group_profile(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """by, n and the mean of each column."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in cols))


def vector_statistics(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, mean, std (population), max, min of the vector, and mean and std of its neighbours' differences."""
    v = F.transform(vector, lambda x: x.cast("double"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    rows = df.select(key, v.alias("_v")).withColumn("_d", F.zip_with(F.slice("_v", F.lit(2), F.greatest(F.size("_v") - 1, F.lit(0))), F.slice("_v", F.lit(1), F.greatest(F.size("_v") - 1, F.lit(0))), lambda a, b: a - b))
    rows = rows.withColumn("mean", mean("_v")).withColumn("diff_mean", mean("_d"))
    spread = lambda c, m: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + (x - F.col(m)) * (x - F.col(m))) / F.size(c))
    return rows.select(key, "mean", spread("_v", "mean").alias("std"), F.array_max("_v").alias("max"), F.array_min("_v").alias("min"), "diff_mean", spread("_d", "diff_mean").alias("diff_std"))


def group_vector_profile(df: DataFrame, by: str, vector: str) -> DataFrame:
    """by, i, mean, std of each place of the group's vectors."""
    long = df.select(by, F.posexplode(vector).alias("i", "x"))
    return long.groupBy(by, "i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def row_mean_pivot(df: DataFrame, row: str, name: str, cols: list[str], names: list[str]) -> DataFrame:
    """row and a column for each name: the mean over cols, 0 where there is none."""
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    known = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    return df.withColumn("_m", total / F.nullif(known, F.lit(0))).groupBy(row).pivot(name, names).agg(F.avg("_m")).na.fill(0.0)


def confusion(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """y, yhat, n and share, the part of the row's class."""
    counts = df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))


def accuracy(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.agg(F.avg(F.when(F.col(y) == F.col(yhat), 1.0).otherwise(0.0)).alias("accuracy"))


def top_classes(probabilities: str | Column, names: list[str], k: int = 3) -> Column:
    """The k likeliest classes of an array, as a > b > c; ties by place."""
    p = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    ranked = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))
    labels = F.array(*map(F.lit, names))
    return F.array_join(F.transform(F.slice(ranked, 1, k), lambda s: F.get(labels, s["i"])), " > ")


def topk_hit_rate(df: DataFrame, true_index: str, probabilities: str, k: int = 3) -> DataFrame:
    """One row: the share of rows whose true class has fewer than k likelier ones."""
    own = F.get(F.col(probabilities), F.col(true_index).cast("int"))
    above = F.size(F.filter(F.transform(probabilities, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: (s["x"] > own) | ((s["x"] == own) & (s["i"] < F.col(true_index)))))
    return df.agg(F.avg(F.when(above < k, 1.0).otherwise(0.0)).alias("hit_rate"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: auc by the rank sum, ties at their mean rank.

    Rows are first counted by score, so that ranks are worked out over distinct scores, in ranges.
    """
    by_score = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    ranked = running(by_score, ["s"], {"_until": "n"}).withColumn("r", F.col("_until") - F.col("n") + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("r") * F.col("p")).alias("rp"), F.sum("p").cast("double").alias("p"), F.sum("n").cast("double").alias("n"))
    return sums.select(((F.col("rp") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * (F.col("n") - F.col("p")), F.lit(0.0))).alias("auc"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ari of two labelings, from their contingency table."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    two = lambda c: c * (c - 1) / 2
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("ra"))
    cols = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("rb"))
    both = cells.agg(F.sum(two(F.col("n"))).alias("rc"), two(F.sum("n")).alias("all"))
    one = both.crossJoin(rows).crossJoin(cols).withColumn("e", F.col("ra") * F.col("rb") / F.col("all"))
    return one.select(((F.col("rc") - F.col("e")) / ((F.col("ra") + F.col("rb")) / 2 - F.col("e"))).alias("ari"))


def silhouette(queries: DataFrame, points: DataFrame, key: str, vector: str, cluster: str) -> DataFrame:
    """One row: the mean silhouette of queries, by euclidean distance to all points, a point's own cluster counted with itself.

    Distances to each cluster are summed on the map side, so that a query leaves a task with one row for each cluster. Both
    sides are read whole: queries should be few (a stated set of points, or all of a small table).
    """
    side = lambda df, p: df.select(F.col(key).alias(f"{p}k"), F.col(vector).alias(f"{p}v"), F.col(cluster).alias(f"{p}c"))
    d = F.sqrt(F.aggregate(F.zip_with("av", "bv", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x))
    mean = side(points, "b").join(side(queries, "a")).groupBy("ak", "ac", "bc").agg(F.avg(d).alias("d"))
    own = mean.groupBy("ak").agg(F.max(F.when(F.col("ac") == F.col("bc"), F.col("d"))).alias("a"), F.min(F.when(F.col("ac") != F.col("bc"), F.col("d"))).alias("b"))
    s = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return own.agg(F.avg(s).alias("silhouette"))


def logloss(df: DataFrame, label: str, p: str) -> DataFrame:
    """One row: the mean of -ln of the probability given to the label, cut at 1e-15."""
    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-15)), F.lit(1e-15))
    return df.agg(F.avg(-F.ln(F.when(F.col(label) > 0, q).otherwise(1 - q))).alias("logloss"))


def mae(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(y) - F.col(yhat))).alias("mae"))


def telemetry_trailing_mean(df: DataFrame, order: str, value: str, n: int = 100, chunk: int = 10_000) -> DataFrame:
    """order, mean over the last n rows, at each n-th row.

    Rows are numbered and cut to chunks, each with the last rows of the one before, so that no window runs over all rows.
    """
    size = max(n, chunk)
    rows = numbered(df.select(order, F.col(value).alias("_x")), order, name="_r")
    own = F.floor(F.col("_r") / size)
    copies = F.when(F.col("_r") % size >= size - n + 1, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.withColumn("_own", own).withColumn("_chunk", F.explode(copies))
    w = Window.partitionBy("_chunk").orderBy("_r").rowsBetween(1 - n, 0)
    return dealt.withColumn("trailing_mean", F.avg("_x").over(w)).where((F.col("_chunk") == F.col("_own")) & ((F.col("_r") + 1) % n == 0)).select(order, "trailing_mean")


def best_so_far(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """df with best, the least value up to each row; a group's rows may be in several ranges."""
    return running(df, [order], keys=[group], least={"best": value}).select(*df.columns, "best")


def adjacent_differences(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """df with diff, the value less the one before."""
    return neighbour(df, [order], F.col(value), "_before", [group]).withColumn("diff", F.col(value) - F.col("_before")).select(*df.columns, "diff")


def step_decay(epoch: str | Column, factor: float, period: int) -> Column:
    """factor to the power of full periods."""
    e = F.col(epoch) if isinstance(epoch, str) else epoch
    return F.pow(F.lit(factor), F.floor(e / period))


def label_encode(df: DataFrame, col: str) -> DataFrame:
    """df with code, the value's place in alphabetical order from 0; null has none."""
    codes = numbered(df.where(F.col(col).isNotNull()).select(F.col(col).alias("_v")).distinct(), "_v", name="code")
    return df.join(codes, F.col(col) == F.col("_v"), "left").select(*df.columns, "code")


def one_hot(df: DataFrame, key: str, col: str, values: list[str]) -> DataFrame:
    """key and a 0/1 column for each value."""
    return df.select(key, *(F.when(F.col(col) == v, 1).otherwise(0).cast("long").alias(f"{col}_{v}") for v in values))


def class_borders(df: DataFrame, x: str, y: str) -> DataFrame:
    """threshold between neighbours in order of x (then y) whose classes differ, half way between their values."""
    pairs = df.select(F.col(x).cast("double").alias("x"), F.col(y).alias("y")).distinct()
    beside = neighbour(pairs, ["x", "y"], F.struct("x", "y"), "_b")
    return beside.where(F.col("y") != F.col("_b.y")).select(((F.col("x") + F.col("_b.x")) / 2).alias("threshold"))


def sample_rows(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """About share of the rows, the same ones each time."""
    bound = int(min(1.0, share) * 2**64) - 2**63
    return df.where(F.xxhash64(F.lit(seed), F.col(key)) < F.lit(bound)) if share < 1 else df


def elite(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The n best rows, ties by key."""
    return df.orderBy(F.desc(score), key).limit(n)


def crop_windows(vector: str | Column, skip: int, size: int, seed: int = 0) -> Column:
    """Of a long array without skip values at both ends, fragments of size: one of each four by a seeded choice, and one of the rest."""
    v = F.col(vector) if isinstance(vector, str) else vector
    inner = F.slice(v, F.lit(skip + 1), F.greatest(F.size(v) - 2 * skip, F.lit(0)))
    count = F.floor(F.size(inner) / size).cast("int")
    groups = F.sequence(F.lit(0), F.greatest(F.ceil(count / 4) - 1, F.lit(0)).cast("int"))
    pick = F.transform(groups, lambda g: (g * 4 + F.pmod(F.xxhash64(F.lit(seed), g), F.greatest(F.least(F.lit(4), count - g * 4), F.lit(1)))).cast("int"))
    return F.when(count > 0, F.transform(pick, lambda i: F.slice(inner, i * size + 1, F.lit(size)))).otherwise(F.array(v))


def es_update(df: DataFrame, reward: str, noise: str, sigma: float = 0.1, rate: float = 0.01) -> DataFrame:
    """i, step: an evolution-strategy step, the noise vectors weighted by their standardized rewards; one pass after the rewards' mean."""
    scale = df.agg(F.avg(reward).alias("_m"), F.stddev_pop(reward).alias("_s"), F.count("*").alias("_n"))
    weighed = df.crossJoin(F.broadcast(scale)).withColumn("_w", F.when(F.col("_s") > 0, (F.col(reward) - F.col("_m")) / F.col("_s")).otherwise(0.0))
    long = weighed.select("_w", "_n", F.posexplode(noise).alias("i", "x"))
    return long.groupBy("i").agg((F.lit(rate / sigma) * F.sum(F.col("_w") * F.col("x")) / F.max("_n")).alias("step"))
