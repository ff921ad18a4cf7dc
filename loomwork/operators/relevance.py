"""Ranking documents for queries by word, word-pair and whole-query scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORDS, tokenize
from .text import collection_idf, median_idf

#: Weights of the parts of the score, and of the three kinds of neighbouring words.
PARTS = {"words": 1.0, "ext_words": 0.3, "pairs": 0.3, "ext_pairs": 0.09, "all": 0.2}
ROW, INVERSE, SKIP = 1.5, 0.7, 0.5
MISSING = 0.03


def word_score(idf: Column, positions: Column, length: Column) -> Column:
    """idf times the damped frequency, plus idf if the word is in the heading (position 0)."""
    tf = F.size(positions).cast("double")
    return idf * (tf / (tf + 1 + length / 1000) + F.when(F.array_contains(positions, 0), 1.0).otherwise(0.0))


def pair_count(a: Column, b: Column, step: int) -> Column:
    """Places of a with b step words on."""
    return F.size(F.filter(a, lambda x: F.array_contains(b, x + step)))


def query_words(queries: DataFrame) -> DataFrame:
    """query_id, kind (base or ext), i, word of queries(query_id, base, ext)."""
    part = lambda kind: queries.select("query_id", F.posexplode(kind).alias("i", "word"), F.lit(kind).alias("kind"))
    return part("base").union(part("ext"))


def rank_texts(queries: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """query_id, doc_id, score, rank of every query against every document.

    Words are counted over all documents (summed on the map side), lengths stay in their row, and positions are only collected
    for words of queries. Documents with a word of the query are scored by joins; the others have the same score within a
    query, which is worked out once, so that they cost one row each and no join on words.
    """
    tokens = query_words(queries)
    wanted = tokens.select("word").distinct()
    words = docs.select(F.col(doc_id).alias("doc_id"), tokenize(text, WORDS).alias("_w"))
    every = words.select(F.explode("_w").alias("word")).groupBy("word").agg(F.count("*").alias("count_in_corpus"))
    length = words.select("doc_id", F.size("_w").alias("len"))
    found = words.select("doc_id", F.posexplode("_w").alias("p", "word")).join(wanted, "word", "left_semi")
    known = found.groupBy("doc_id", "word").agg(F.sort_array(F.collect_list(F.col("p") + 1)).alias("positions"))
    idf = collection_idf(every)
    middle = idf.agg(F.percentile("idf", 0.5).alias("median_idf"))
    weighed = tokens.join(idf, "word", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    hits = weighed.select("query_id", "word").distinct().join(known.select("word", "doc_id"), "word").select("query_id", "doc_id").distinct()
    scored = _scored(hits, weighed, known, length, middle)
    # What a document without any word of the query gets.
    base = F.col("kind") == "base"
    absent = F.sum(F.when(base & (F.col("idf") > F.col("median_idf")), 1).otherwise(0))
    nothing = weighed.crossJoin(F.broadcast(middle)).groupBy("query_id").agg((PARTS["all"] * F.sum(F.when(base, F.col("idf")).otherwise(0.0)) * F.pow(F.lit(MISSING), absent)).alias("_none"))
    pairs = length.select("doc_id").join(queries.select("query_id")).join(scored, ["query_id", "doc_id"], "left").join(nothing, "query_id", "left")
    whole = pairs.select("query_id", "doc_id", F.coalesce("score", "_none", F.lit(0.0)).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return whole.withColumn("rank", place.cast("long"))


def rank_documents(queries: DataFrame, pairs: DataFrame, tf: DataFrame, stats: DataFrame) -> DataFrame:
    """query_id, doc_id, score, rank of stated candidates.

    queries: query_id, base and ext (lists of words); pairs: candidates (query_id, doc_id); tf and stats as
    positional_tf() and corpus_stats() give. Only rows of query words are joined, so position lists of others never move.
    """
    tokens = query_words(queries)
    weighed = tokens.join(collection_idf(stats), "word", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    known = tf.join(tokens.select("word").distinct(), "word", "left_semi")
    length = tf.groupBy("doc_id").agg(F.sum(F.size(F.filter("positions", lambda p: p > 0))).alias("len"))
    scored = _scored(pairs, weighed, known, length, median_idf(stats))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return scored.withColumn("rank", place.cast("long"))


def _scored(pairs: DataFrame, weighed: DataFrame, known: DataFrame, length: DataFrame, middle: DataFrame) -> DataFrame:
    """query_id, doc_id, score of pairs; weighed: query_words() with idf; known: doc_id, word, positions; middle: one row."""
    none = F.array().cast("array<int>")
    rows = pairs.join(weighed, "query_id").join(known, ["doc_id", "word"], "left").withColumn("positions", F.coalesce("positions", none))
    rows = rows.join(length, "doc_id", "left").withColumn("len", F.coalesce("len", F.lit(0)))
    rows = rows.crossJoin(F.broadcast(middle))
    rows = rows.withColumn("w", F.when(F.size("positions") > 0, word_score(F.col("idf"), F.col("positions"), F.col("len"))).otherwise(0.0))
    in_query = Window.partitionBy("query_id", "doc_id", "kind").orderBy("i")
    rows = rows.withColumn("_next", F.lead("positions").over(in_query)).withColumn("_idf2", F.lead("idf").over(in_query))
    here, after = F.col("positions"), F.col("_next")
    t = ROW * pair_count(here, after, 1) + INVERSE * pair_count(here, after, -1) + SKIP * pair_count(here, after, 2)
    rows = rows.withColumn("p", F.when(after.isNull(), 0.0).otherwise((F.col("idf") + F.col("_idf2")) * t / (1 + t)))
    absent = (F.size("positions") == 0) & (F.col("idf") > F.col("median_idf"))
    base, ext = F.col("kind") == "base", F.col("kind") == "ext"
    total = lambda where, c: F.sum(F.when(where, F.col(c)).otherwise(0.0))
    every = F.sum(F.when(base, F.col("idf")).otherwise(0.0)) * F.pow(F.lit(MISSING), F.sum(F.when(base & absent, 1).otherwise(0)))
    score = PARTS["words"] * total(base, "w") + PARTS["ext_words"] * total(ext, "w") + PARTS["pairs"] * total(base, "p") + PARTS["ext_pairs"] * total(ext, "p") + PARTS["all"] * every
    return rows.groupBy("query_id", "doc_id").agg(score.alias("score"))
