"""Ranks, running values and neighbours in one order over all rows, without bringing all rows into one task.

Rows are dealt to ranges of the order and stored. Windows run within a range; what a range needs of those before or behind it is
one row for each range (and key), which is added by a broadcast join. Rows of equal order are always in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut_lineage


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut_lineage(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def _joined(rows: DataFrame, ends_: DataFrame, keys: list[str]) -> DataFrame:
    on = [rows[k].eqNullSafe(ends_[f"_k{i}"]) for i, k in enumerate(["_part", *keys])]
    return rows.join(F.broadcast(ends_), on, "left").drop(*(f"_k{i}" for i in range(len(keys) + 1)))


def _named(df: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(["_part", *keys])), *more)


def running(df: DataFrame, order: list[str], sums: dict[str, str] | None = None, keys: list[str] | None = None, least: dict[str, str] | None = None) -> DataFrame:
    """df with running sums (name: column) and running minima, both with the row itself; keys: columns within which they run."""
    keys, sums, least = keys or [], sums or {}, least or {}
    rows = _ranged(df, *keys, *order)
    here = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part", *keys).agg(*(F.sum(c).alias(f"_s_{n}") for n, c in sums.items()), *(F.min(c).alias(f"_l_{n}") for n, c in least.items()))
    earlier = _named(parts, keys, *(F.sum(f"_s_{n}").over(before).alias(f"_b_{n}") for n in sums), *(F.min(f"_l_{n}").over(before).alias(f"_b_{n}") for n in least))
    out = _joined(rows, earlier, keys)
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(here) + F.coalesce(f"_b_{n}", F.lit(0)))
    for n, c in least.items():
        out = out.withColumn(n, F.least(F.min(c).over(here), f"_b_{n}"))
    return out.drop("_part", *(f"_b_{n}" for n in [*sums, *least]))


def neighbour(df: DataFrame, order: list[str], value: Column, name: str, keys: list[str] | None = None, ahead: bool = False) -> DataFrame:
    """df with name: value of the row before, or ahead, in order (within keys); null at the end."""
    keys = keys or []
    rows = _ranged(df.withColumn("_v", value), *keys, *order)
    here = Window.partitionBy("_part", *keys).orderBy(*order)
    place = F.struct(*order)
    edge = (F.min_by if ahead else F.max_by)(F.struct("_v"), place)
    ends = rows.groupBy("_part", *keys).agg(edge.alias("_e"))
    over = Window.partitionBy(*keys).orderBy("_part")
    beside = _named(ends, keys, (F.lead if ahead else F.lag)("_e").over(over).alias("_e"))
    inner = (F.lead if ahead else F.lag)(F.struct("_v")).over(here)
    out = _joined(rows.withColumn("_i", inner), beside, keys)
    return out.withColumn(name, F.coalesce("_i", "_e")["_v"]).drop("_part", "_v", "_i", "_e")


def numbered(df: DataFrame, *order: str, name: str = "row") -> DataFrame:
    """df with name, the row's number in order from 0; rows of equal order are numbered in any way."""
    rows = _ranged(df, *order)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = _named(sizes, [], F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return _joined(rows.withColumn("_at", place), before, []).withColumn(name, (F.col("_b") + F.col("_at")).cast("long")).drop("_part", "_at", "_b")
