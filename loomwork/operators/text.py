"""Words across documents: frequency, postings, positions, corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LETTERS, WORDS, title, tokenize, visible_text


def document_frequency(docs: DataFrame, text: str = "text", pattern: str = LETTERS) -> DataFrame:
    """word, df: how many rows have it. Distinct words leave each row, so the shuffle carries partial counts."""
    return docs.select(F.explode(F.array_distinct(tokenize(text, pattern))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def build_postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pattern: str = WORDS) -> DataFrame:
    """term, docs: the sorted ids of the documents that have it."""
    pairs = docs.select(F.col(doc_id).alias("d"), F.explode(F.array_distinct(tokenize(text, pattern))).alias("term"))
    return pairs.groupBy("term").agg(F.sort_array(F.collect_set("d")).alias("docs"))


def positional_tf(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", heading: str | None = None, pattern: str = WORDS) -> DataFrame:
    """doc_id, word, positions: places in the text from 1 on, 0 for each time in the heading."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(tokenize(text, pattern)).alias("p", "word")).select("doc_id", "word", (F.col("p") + 1).alias("p"))
    if heading:
        rows = rows.union(docs.select(F.col(doc_id).alias("doc_id"), F.explode(tokenize(heading, pattern)).alias("word"), F.lit(0).alias("p")))
    return rows.groupBy("doc_id", "word").agg(F.sort_array(F.collect_list("p")).alias("positions"))


def corpus_stats(tf: DataFrame) -> DataFrame:
    """word, count_documents, count_in_corpus from positional_tf()."""
    return tf.groupBy("word").agg(F.count("*").alias("count_documents"), F.sum(F.size("positions")).alias("count_in_corpus"))


def corpus_length(stats: DataFrame) -> DataFrame:
    """One row: corpus_len, all occurrences."""
    return stats.agg(F.coalesce(F.sum("count_in_corpus"), F.lit(0)).cast("long").alias("corpus_len"))


def collection_idf(stats: DataFrame) -> DataFrame:
    """word, idf: -ln of the word's share of all occurrences."""
    return stats.crossJoin(F.broadcast(corpus_length(stats))).select("word", (-F.ln(F.col("count_in_corpus") / F.col("corpus_len"))).alias("idf"))


def median_idf(stats: DataFrame) -> DataFrame:
    """One row: the median idf over the vocabulary."""
    return collection_idf(stats).agg(F.percentile("idf", 0.5).alias("median_idf"))


def bag_of_words(docs: DataFrame, vocabulary: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and a count column for each word of the vocabulary."""
    words = docs.select(F.col(doc_id).alias("doc_id"), tokenize(text).alias("_w"))
    return words.select("doc_id", *(_count(v).alias(v) for v in vocabulary))


def _count(word: str):
    return F.size(F.filter("_w", lambda x: x == word)).cast("long")


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with title and body, the visible text in lower case."""
    return pages.withColumn("title", title(html)).withColumn("body", F.lower(visible_text(html)))
