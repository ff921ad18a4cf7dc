"""The click counts as a structured stream: for logs that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.url import url_host


def windowed_host_query_counts(clicks: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, host, query, cnt by event-time window; state of windows older than late is dropped. clicks: time, query, url."""
    rows = clicks.withWatermark(time, late).select(F.window(time, window).alias("w"), url_host("url").alias("host"), "query").where("host is not null and host <> ''")
    return rows.groupBy("w", "host", "query").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), "host", "query", "cnt")


def running_document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, df over all documents that have arrived (complete or update output)."""
    from ..operators.text import document_frequency

    return document_frequency(docs, text)
