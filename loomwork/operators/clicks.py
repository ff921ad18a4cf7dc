"""Clicks by host and query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.url import url_host


def parse_clicks(lines: DataFrame, line: str = "value") -> DataFrame:
    """query, url of tab-separated lines with two fields; trailing empty fields don't count, a leading one is an empty query."""
    parts = F.split(F.regexp_replace(line, "\t+$", ""), "\t")
    return lines.where(F.size(parts) == 2).select(parts[0].alias("query"), parts[1].alias("url"))


def host_query_counts(clicks: DataFrame) -> DataFrame:
    """host, query, cnt; rows whose URL has no host are dropped."""
    return clicks.select(url_host("url").alias("host"), "query").where("host is not null and host <> ''").groupBy("host", "query").agg(F.count("*").alias("cnt"))


def best_query_per_host(clicks: DataFrame, min_clicks: int = 100) -> DataFrame:
    """host, query, cnt of each host's most clicked query, the first in order on ties; hosts below min_clicks don't appear.

    min_by keeps one row a host in the partial aggregation, so that a host with many queries needs no window.
    """
    counts = host_query_counts(clicks).where(F.col("cnt") >= min_clicks)
    return counts.groupBy("host").agg(F.min(F.struct((-F.col("cnt")).alias("n"), "query")).alias("b")).select("host", "b.query", (-F.col("b.n")).alias("cnt"))


def queries_in_order(clicks: DataFrame) -> DataFrame:
    """host, query, cnt, place: all queries of each host in order of their text (secondary sort)."""
    return host_query_counts(clicks).withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy("query")).cast("long"))


def partition_by_letter(df: DataFrame, col: str, parts: int) -> DataFrame:
    """df dealt to parts by the first letter of col: a to z spread evenly in order, what sorts before them first, behind them last."""
    letter = F.ascii(F.substring(F.lower(F.coalesce(F.col(col), F.lit(""))), 1, 1)) - ord("a")
    return df.repartitionById(parts, F.least(F.greatest(F.floor(letter * parts / 26), F.lit(0)), F.lit(parts - 1)).cast("int"))
