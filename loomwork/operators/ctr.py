"""Click-prediction features: value counts, popularity bands, text formats, factorization scores, blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import soft_log_bins
from .ordered import numbered


def unpivot(df: DataFrame, fields: list[str], *keep: str) -> DataFrame:
    """keep..., field, value (text; null as empty): one row for each field, made by one expand of the scan."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in fields))
    return df.select(*keep, F.inline(pairs))


def value_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, n."""
    return unpivot(df, fields).groupBy("field", "value").agg(F.count("*").alias("n"))


def value_counts_by_label(df: DataFrame, fields: list[str], label: str, min_total: int = 10) -> DataFrame:
    """field, value, neg, pos, total, ratio (pos/total, 5 digits) of values seen min_total times or more."""
    rows = unpivot(df, fields, label)
    out = rows.groupBy("field", "value").agg(F.sum(F.when(F.col(label) > 0, 0).otherwise(1)).alias("neg"), F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("pos"), F.count("*").alias("total"))
    return out.where(F.col("total") >= min_total).withColumn("ratio", F.round(F.col("pos") / F.col("total"), 5))


def popularity_bands(counts: DataFrame, low: int = 7, high: int = 60, most: int = 1_000_000_000, excluded: tuple[str, ...] = ()) -> DataFrame:
    """field, value, n, band: popular from high on, basic from low on, rare below; excluded field=value texts don't count."""
    name = F.concat_ws("=", "field", "value")
    kept = counts.where(~name.isin(*excluded)) if excluded else counts
    return kept.withColumn("band", F.when(F.col("n").between(high, most), "popular").when(F.col("n").between(low, most), "basic").otherwise("rare"))


def missing_counts(df: DataFrame, key: str, fields: list[str], bands: DataFrame) -> DataFrame:
    """key, missing: fields whose value is in no band but rare."""
    rows = unpivot(df, fields, key)
    known = bands.where("band <> 'rare'").select("field", "value", F.lit(1).alias("_k"))
    return rows.join(known, ["field", "value"], "left").groupBy(key).agg(F.sum(1 - F.coalesce("_k", F.lit(0))).alias("missing"))


def vw_line(label: str, spaces: dict[str, list[str]]) -> Column:
    """label, then |space and its values for each namespace."""
    parts = [F.concat_ws(" ", F.lit(f"|{s}"), *(F.concat_ws("-", F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("NA"))) for c in cols)) for s, cols in spaces.items()]
    return F.concat_ws(" ", F.when(F.col(label) > 0, "1").otherwise("-1"), *parts)


def numeric_space(name: str, cols: dict[str, int]) -> Column:
    """|name and the soft bins of each counter (column: shift)."""
    return F.concat_ws(" ", F.lit(f"|{name}"), *(F.concat_ws("_", F.lit(c), soft_log_bins(c, s)) for c, s in cols.items()))


def dense_gbdt_line(label: str, cols: list[str]) -> Column:
    """label and values, empty as -10."""
    return F.concat_ws(" ", F.when(F.col(label) > 0, "1").otherwise("-1"), *(F.coalesce(F.col(c).cast("string"), F.lit("-10")) for c in cols))


def sparse_gbdt_line(label: str, tests: list[tuple[str, str]]) -> Column:
    """label and the places (from 1) of the column-value tests that hold."""
    hits = F.array_compact(F.array(*(F.when(F.col(c).cast("string") == v, str(i + 1)) for i, (c, v) in enumerate(tests))))
    return F.concat_ws(" ", F.when(F.col(label) > 0, "1").otherwise("-1"), F.array_join(hits, " "))


def blend(a: DataFrame, b: DataFrame, w: float = 0.7, key: str = "id", score: str = "click") -> DataFrame:
    """key, click: w a + (1 - w) b, rows matched by key; a key that only one side has raises an error when the query runs."""
    both = a.select(key, F.col(score).alias("_a")).join(b.select(key, F.col(score).alias("_b")), key, "full")
    whole = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("ids differ"))).otherwise(w * F.col("_a") + (1 - w) * F.col("_b"))
    return both.select(key, whole.cast("double").alias(score))


def ffm_score(rows: DataFrame, weights: DataFrame, key: str = "id", nodes: str = "nodes") -> DataFrame:
    """key, p of rows(key, nodes array<struct<f, j, v>>) under weights(j, f, w array<double>), instance-normalized.

    Pairs are formed within a row and meet the weights by joins on (feature, field), so the weights may be of any size.
    """
    norm = F.aggregate(nodes, F.lit(0.0), lambda a, x: a + x["v"] * x["v"])
    numbered = rows.select(key, norm.alias("_n"), F.transform(nodes, lambda x, i: F.struct(i.alias("i"), x["f"].alias("f"), x["j"].alias("j"), x["v"].alias("v"))).alias("_x"))
    pairs = F.flatten(F.transform("_x", lambda a: F.transform(F.filter("_x", lambda b: b["i"] > a["i"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    wide = numbered.select(key, "_n", F.explode_outer(pairs).alias("q")).select(key, "_n", "q.a.f", "q.a.j", F.col("q.b.f").alias("f2"), F.col("q.b.j").alias("j2"), (F.col("q.a.v") * F.col("q.b.v")).alias("v"))
    one = weights.select("j", F.col("f").alias("f2"), F.col("w").alias("w1"))
    two = weights.select(F.col("j").alias("j2"), "f", F.col("w").alias("w2"))
    met = wide.join(one, ["j", "f2"], "left").join(two, ["j2", "f"], "left")
    dot = F.aggregate(F.zip_with("w1", "w2", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    total = met.groupBy(key).agg(F.sum(F.coalesce(dot, F.lit(0.0)) * F.col("v")).alias("t"), F.max("_n").alias("_n"))
    margin = F.when(F.col("_n") > 0, F.coalesce("t", F.lit(0.0)) / F.col("_n")).otherwise(0.0)
    return total.select(key, (1 / (1 + F.exp(-margin))).alias("p"))


def shuffle_by_hash(df: DataFrame, *cols: str, seed: int = 0) -> DataFrame:
    """Rows in the order of a seeded hash: a shuffle that repeats."""
    return df.orderBy(F.xxhash64(F.lit(seed), *cols), *cols)


def train_test_split_at(df: DataFrame, time: str, cut) -> DataFrame:
    """df with part: train before cut, test from it on."""
    return df.withColumn("part", F.when(F.col(time) < F.lit(cut), "train").otherwise("test"))


def row_numbers(df: DataFrame, *order: str) -> DataFrame:
    """df with row from 0 in order, for joins of tables by position."""
    return numbered(df, *order, name="row")
