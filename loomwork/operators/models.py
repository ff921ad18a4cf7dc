"""Models over MLlib, and those that it lacks over grouped or batched pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, FeatureHasher, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..storage import cut_lineage
from .ctr import ffm_score
from .stats import logloss
from .text import bag_of_words


def gbt_model(df: DataFrame, features: list[str], label: str, trees: int = 30, depth: int = 7, seed: int = 1) -> PipelineModel:
    """Gradient-boosted trees on features; labels are 0 and 1."""
    assembler = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    model = GBTClassifier(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed, leafCol="_leaf").fit(assembler.transform(df))
    return PipelineModel([assembler, model])


def gbt_leaves(df: DataFrame, features: list[str], label: str, trees: int = 30, depth: int = 7, seed: int = 1) -> DataFrame:
    """df with leaves, the node that each tree ends in, and p."""
    return with_leaves(df, gbt_model(df, features, label, trees, depth, seed))


def with_leaves(df: DataFrame, model: PipelineModel) -> DataFrame:
    out = model.transform(df).withColumn("leaves", vector_to_array("_leaf")).withColumn("p", F.get(vector_to_array("probability"), F.lit(1)))
    return out.select(*df.columns, "leaves", "p")


def save_pipeline(model: PipelineModel, path: str) -> None:
    """Writes any fitted pipeline below path, replacing what is there."""
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def hashed_logistic(df: DataFrame, cols: list[str], label: str, bits: int = 18, l2: float = 2e-8, passes: int = 6) -> DataFrame:
    """df with p of a logistic regression on hashed values of cols."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_h_{c}") for c in cols]
    wide = FeatureHasher(inputCols=[f"_h_{c}" for c in cols], outputCol="_x", numFeatures=1 << bits).transform(df.select("*", *text))
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=l2, elasticNetParam=0.0, maxIter=passes).fit(wide)
    return model.transform(wide).withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).select(*df.columns, "p")


def l1_logistic(df: DataFrame, features: list[str], label: str, penalty: float = 0.001, epochs: int = 50) -> DataFrame:
    """df with p of a scaled, L1-penalised logistic regression."""
    ready = VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip").transform(df)
    scaled = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(ready).transform(ready)
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=penalty, elasticNetParam=1.0, maxIter=epochs).fit(scaled)
    return model.transform(scaled).withColumn("p", F.get(vector_to_array("probability"), F.lit(1))).select(*df.columns, "p")


def svm_grid(df: DataFrame, vector: str, label: str, c_values: tuple[float, ...] = (0.1, 1.0, 10.0), folds: int = 3, seed: int = 1) -> DataFrame:
    """c, auc: cross-validated area of linear support vector machines."""
    ready = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_x"), F.col(label).cast("double").alias("_y"))
    svm = LinearSVC(featuresCol="_x", labelCol="_y", maxIter=20)
    grid = ParamGridBuilder().addGrid(svm.regParam, [1 / c for c in c_values]).build()
    fitted = CrossValidator(estimator=svm, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol="_y"), numFolds=folds, seed=seed).fit(ready)
    return df.sparkSession.createDataFrame([(float(c), float(a)) for c, a in zip(c_values, fitted.avgMetrics, strict=True)], "c double, auc double")


def principal_components(df: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """key and pc, the first k components."""
    ready = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_x"))
    return PCA(k=k, inputCol="_x", outputCol="_p").fit(ready).transform(ready).select(key, vector_to_array("_p").alias("pc"))


def lda_predict(df: DataFrame, key: str, vector: str, label: str, ridge: float = 1e-3) -> DataFrame:
    """key, label, pred of a linear discriminant with class means and one covariance, all from two aggregates."""
    long = df.select(label, F.posexplode(vector).alias("i", "x"))
    means = long.groupBy(label, "i").agg(F.avg("x").alias("m"), F.count("*").alias("n")).toPandas()
    classes = sorted(means[label].unique())
    mu = np.stack([means[means[label] == c].sort_values("i")["m"].to_numpy() for c in classes])
    n = np.array([means[means[label] == c]["n"].iloc[0] for c in classes], float)
    size = mu.shape[1]

    def products(batches):
        total, count = np.zeros((size, size)), 0
        for b in batches:
            x = np.stack(b[vector].to_numpy()).astype(float) - mu[np.searchsorted(classes, b[label].to_numpy())]
            total, count = total + x.T @ x, count + len(b)
        yield pd.DataFrame({"s": [total.ravel().tolist()], "n": [count]})

    parts = df.select(vector, label).mapInPandas(products, "s array<double>, n long").collect()
    cov = sum(np.array(p["s"]).reshape(size, size) for p in parts) / max(sum(p["n"] for p in parts) - len(classes), 1) + ridge * np.eye(size)
    w = np.linalg.solve(cov, mu.T)
    b = -0.5 * np.einsum("ij,ji->i", mu, w) + np.log(n / n.sum())
    scores = F.array(*(F.struct((F.aggregate(F.zip_with(vector, F.array(*map(F.lit, map(float, w[:, k]))), lambda x, y: x * y), F.lit(float(b[k])), lambda s, x: s + x)).alias("s"), F.lit(int(c)).alias("c")) for k, c in enumerate(classes)))
    return df.select(key, label, F.array_max(scores)["c"].alias("pred"))


#: Rows that a task trains a factorization machine on at once, and rows in a step.
PART_ROWS, STEP_ROWS = 20_000, 32


def _ffm_pass(rows: pd.DataFrame, known: pd.DataFrame, label: str, nodes: str, k: int, eta: float, l2: float, seed: int) -> pd.DataFrame:
    """One AdaGrad pass over rows in steps of STEP_ROWS from the known weights of their features."""
    start = dict(zip(zip(known["j"], known["f"], strict=True), known["w"], strict=True))
    keys: dict[tuple[int, int], int] = {}
    at, one, two, value, labels = [], [], [], [], np.where(rows[label].to_numpy() > 0, 1.0, -1.0)
    for i, xs in enumerate(rows[nodes]):
        r = 1.0 / max(sum(x["v"] ** 2 for x in xs), 1e-12)
        for n, p in enumerate(xs):
            for q in xs[n + 1 :]:
                at.append(i)
                one.append(keys.setdefault((p["j"], q["f"]), len(keys)))
                two.append(keys.setdefault((q["j"], p["f"]), len(keys)))
                value.append(p["v"] * q["v"] * r)
    at, one, two, value = np.array(at, np.int64), np.array(one, np.int64), np.array(two, np.int64), np.array(value)
    w = np.stack([np.array(start[key]) if key in start else np.random.default_rng([seed, *key]).random(k) / np.sqrt(k) for key in keys]) if keys else np.zeros((0, k))
    g = np.ones_like(w)
    for first in range(0, len(labels), STEP_ROWS):
        a, b = np.searchsorted(at, [first, first + STEP_ROWS])
        row, u, v, x = at[a:b] - first, one[a:b], two[a:b], value[a:b, None]
        y = labels[first : first + STEP_ROWS]
        t = np.bincount(row, weights=(w[u] * w[v]).sum(axis=1) * x[:, 0], minlength=len(y))
        kappa = (-y / (1 + np.exp(np.clip(y * t, -50, 50))))[row][:, None] * x
        used, where = np.unique(np.concatenate((u, v)), return_inverse=True)
        step = np.zeros((len(used), k))
        np.add.at(step, where, np.concatenate((l2 * w[u] + kappa * w[v], l2 * w[v] + kappa * w[u])))
        g[used] += step**2
        w[used] -= eta * step / np.sqrt(g[used])
    return pd.DataFrame([(j, f, x.tolist()) for (j, f), x in zip(keys, w, strict=True)], columns=["j", "f", "w"])


def train_ffm(rows: DataFrame, label: str, nodes: str, k: int = 4, epochs: int = 5, eta: float = 0.2, l2: float = 2e-5, seed: int = 1, validation: DataFrame | None = None) -> DataFrame:
    """Weights (j, f, w) of a field-aware factorization machine by averaged passes.

    Rows are dealt to parts of about PART_ROWS by hash. In each epoch a part gets its rows and, by a join on feature and field,
    the weights that they use, runs AdaGrad over them, and the parts' weights are averaged; no task and not the driver ever
    holds the whole model. With validation rows (label, nodes), training ends after the first epoch whose log loss there is
    above the least so far, and gives the weights of that least loss.
    """
    parts = max(1, -(-rows.count() // PART_ROWS))
    dealt = cut_lineage(rows.select(F.col(label).alias("_y"), F.col(nodes).alias("_x"), F.pmod(F.xxhash64(nodes, label, F.monotonically_increasing_id()), F.lit(parts)).alias("_part")))
    pairs = F.flatten(F.transform("_x", lambda a, i: F.transform(F.filter("_x", lambda b, n: n != i), lambda b: F.struct(a["j"].alias("j"), b["f"].alias("f")))))
    needs = cut_lineage(dealt.select(F.col("_part").alias("_p"), F.explode(pairs).alias("q")).select("_p", "q.j", "q.f").distinct())
    kind = "j int, f int, w array<double>"
    weights = best = rows.sparkSession.createDataFrame([], kind)
    least = np.inf
    for _ in range(epochs):
        own = needs.join(weights, ["j", "f"])
        moved = dealt.groupBy("_part").cogroup(own.groupBy("_p")).applyInPandas(lambda x, w: _ffm_pass(x, w, "_y", "_x", k, eta, l2, seed), kind)
        mean = F.array(*(F.avg(F.get("w", F.lit(i))) for i in range(k)))
        weights = cut_lineage(moved.groupBy("j", "f").agg(mean.alias("w")))
        if validation is None:
            best = weights
            continue
        loss = ffm_loss(validation, weights, label, nodes)
        if loss > least:
            break
        least, best = loss, weights
    return best


def ffm_loss(rows: DataFrame, weights: DataFrame, label: str, nodes: str) -> float:
    """The mean log loss of rows under weights."""
    numbered = cut_lineage(rows.select(F.monotonically_increasing_id().alias("id"), F.col(label).alias("_y"), F.col(nodes).alias("nodes")))
    scored = ffm_score(numbered, weights).join(numbered.select("id", "_y"), "id")
    return logloss(scored, "_y", "p").first()["logloss"]


def ffm_folds(rows: DataFrame, label: str, nodes: str, folds: int = 5, **how) -> list[float]:
    """The log loss of each fold under weights trained on the others; rows are dealt to folds by hash."""
    dealt = cut_lineage(rows.select(label, nodes, F.pmod(F.xxhash64(F.lit("fold"), nodes, label, F.monotonically_increasing_id()), F.lit(folds)).alias("_fold")))
    return [ffm_loss(dealt.where(f"_fold = {i}"), train_ffm(dealt.where(f"_fold <> {i}"), label, nodes, **how), label, nodes) for i in range(folds)]


def save_ffm(weights: DataFrame, path: str) -> None:
    """Writes weights below path."""
    weights.write.mode("overwrite").parquet(path)


def load_ffm(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("j int, f int, w array<double>").parquet(path)


def vocabulary(docs: DataFrame, size: int, text: str = "text", least: int = 1) -> DataFrame:
    """word, n: the size most frequent words of the texts that occur least times, ties in their order; a top-k, not a sort of all."""
    words = docs.select(F.explode(tokenize(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size)


def learned_bag(docs: DataFrame, size: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and a count column for each word of the learned vocabulary."""
    return bag_of_words(docs, [r["word"] for r in vocabulary(docs, size, text).collect()], doc_id, text)
