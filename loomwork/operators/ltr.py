"""Learning to rank: NDCG and the gradients of its pairwise loss."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut_lineage


def _placed(df: DataFrame, qid: str, rel: str, score: str, doc: str) -> DataFrame:
    base = df.select(F.col(qid).alias("qid"), F.col(doc).alias("doc"), F.col(rel).cast("double").alias("rel"), F.col(score).cast("double").alias("score"))
    gained = base.withColumn("gain", F.pow(F.lit(2.0), "rel") - 1)
    return gained.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc"))).withColumn("best", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "doc")))


def ndcg(df: DataFrame, qid: str = "qid", rel: str = "rel", score: str = "score", doc: str = "doc") -> DataFrame:
    """qid, ndcg: gains 2^rel - 1 over ln(place + 1); 0 for queries without gain."""
    rows = _placed(df, qid, rel, score, doc)
    dcg, ideal = F.sum(F.col("gain") / F.ln(F.col("pos") + 1.0)), F.sum(F.col("gain") / F.ln(F.col("best") + 1.0))
    return rows.groupBy("qid").agg(dcg.alias("d"), ideal.alias("i")).select("qid", F.when(F.col("i") > 0, F.col("d") / F.col("i")).otherwise(F.col("d")).alias("ndcg"))


def mean_ndcg(df: DataFrame, **cols: str) -> DataFrame:
    """One row: the mean over queries with a gain."""
    return ndcg(df, **cols).where("ndcg > 0").agg(F.avg("ndcg").alias("mean_ndcg"))


def lambda_gradients(df: DataFrame, qid: str = "qid", rel: str = "rel", score: str = "score", doc: str = "doc") -> DataFrame:
    """qid, doc, gradient, hessian over the pairs of a query with different labels.

    Pairs of one query meet by an equi-join on qid, whose lists are short by nature (candidates of a query).
    """
    rows = _placed(df, qid, rel, score, doc)
    ideal = rows.groupBy("qid").agg(F.sum(F.col("gain") / F.ln(F.col("best") + 1.0)).alias("idcg"))
    rows = rows.join(ideal, "qid").withColumn("idcg", F.when(F.col("idcg") > 0, F.col("idcg")).otherwise(1.0))
    other = rows.select("qid", *(F.col(c).alias(f"o_{c}") for c in ("doc", "rel", "score", "gain", "pos")))
    pairs = rows.join(other, "qid").where("rel <> o_rel")
    delta = F.abs((1 / F.ln(F.col("o_pos") + 1.0) - 1 / F.ln(F.col("pos") + 1.0)) * (F.col("gain") - F.col("o_gain"))) / F.col("idcg")
    rho = 1 / (1 + F.exp(F.least(F.abs(F.col("score") - F.col("o_score")), F.lit(50.0))))
    pairs = pairs.withColumn("_d", delta).withColumn("_r", rho)
    sign = F.when(F.col("rel") > F.col("o_rel"), -1.0).otherwise(1.0)
    sums = pairs.groupBy("qid", "doc").agg(F.sum(sign * F.col("_d") * F.col("_r")).alias("g"), F.sum(F.col("_d") * F.col("_r") * (1 - F.col("_r"))).alias("h"))
    out = rows.select("qid", "doc").join(sums, ["qid", "doc"], "left")
    return out.select("qid", "doc", F.coalesce("g", F.lit(0.0)).alias("gradient"), F.when(F.coalesce("h", F.lit(0.0)) == 0, 1.0).otherwise(F.col("h")).alias("hessian"))


def boost(df: DataFrame, features: list[str], rounds: int = 10, depth: int = 4, rate: float = 0.3, qid: str = "qid", rel: str = "rel", doc: str = "doc", seed: int = 1) -> tuple[DataFrame, list[PipelineModel]]:
    """df with score, and the trees that made it: each round fits a regression tree to the pairwise gradients over hessians
    (weighted by hessian) at the scores so far, and adds its prediction times rate. All scores are 0 at first."""
    assembler = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep")
    rows, trees = cut_lineage(assembler.transform(df).withColumn("score", F.lit(0.0))), []
    for r in range(rounds):
        pulled = lambda_gradients(rows, qid, rel, "score", doc).select(F.col("qid").alias("_q"), F.col("doc").alias("_d"), (-F.col("gradient") / F.col("hessian")).alias("_t"), F.col("hessian").alias("_w"))
        train = rows.join(pulled, (F.col(qid) == F.col("_q")) & (F.col(doc) == F.col("_d")))
        tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_t", weightCol="_w", predictionCol="_p", maxDepth=depth, seed=seed + r).fit(train)
        rows = cut_lineage(tree.transform(rows).withColumn("score", F.col("score") + rate * F.col("_p")).drop("_p"))
        trees.append(PipelineModel([assembler, tree]))
    return rows.drop("_x"), trees


def boosted_scores(df: DataFrame, trees: list[PipelineModel], rate: float = 0.3) -> DataFrame:
    """df with score under the trees of boost()."""
    out = df.withColumn("score", F.lit(0.0))
    for tree in trees:
        out = tree.transform(out).withColumn("score", F.col("score") + rate * F.col("_p")).drop("_p", "_x")
    return out
