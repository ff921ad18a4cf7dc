"""A stored inverted index: packed posting blocks in buckets of terms, looked up without reading the other buckets.

Layout below a folder: ``postings/bucket=.../`` holds term, block, codec, n and the packed documents of a term whose ids lie in
one range of ``BLOCK`` ids, so that no list, however frequent its term, is built or read in one piece; ``documents`` holds the ids
of all documents, which negations need; ``settings`` the number of buckets. Ids are integers from 0 on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.text import WORDS, tokenize
from .search import Not, Term, parse_boolean

#: Ids in a block of postings.
BLOCK = 1 << 16
#: Buckets of terms: a look-up reads that of its term.
BUCKETS = 64


def posting_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pattern: str = WORDS, block: int = BLOCK) -> DataFrame:
    """term, block, docs: the sorted ids of a range of documents that have the term."""
    pairs = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("d"), F.explode(F.array_distinct(tokenize(text, pattern))).alias("term"))
    return pairs.groupBy("term", F.floor(F.col("d") / block).alias("block")).agg(F.sort_array(F.collect_set("d")).alias("docs"))


def _bucket(term: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(term) if isinstance(term, str) else term), F.lit(buckets)).cast("int")


def write_index(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", codec: str = "varbyte", buckets: int = BUCKETS, block: int = BLOCK) -> None:
    """Writes the index of docs below path, replacing what is there."""
    spark = docs.sparkSession
    # Within its block an id is small, which the codecs reward.
    inner = F.transform("docs", lambda d: d - F.col("block") * block)
    rows = posting_blocks(docs, doc_id, text, block=block).select("term", "block", F.lit(codec).alias("codec"), F.size("docs").alias("n"), inner.alias("_docs"))
    packed = rows.withColumn("postings", codecs.pack("_docs", codec)).drop("_docs").withColumn("bucket", _bucket("term", buckets))
    packed.repartition("bucket", "block").sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id")).distinct().write.mode("overwrite").parquet(f"{path}/documents")
    spark.createDataFrame([(buckets, block)], "buckets int, block long").write.mode("overwrite").json(f"{path}/settings")


def read_postings(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """term, doc_id of the index below path, or of these terms only: a filter on buckets prunes folders, one on terms row groups."""
    settings = spark.read.schema("buckets int, block long").json(f"{path}/settings").first()
    rows = spark.read.parquet(f"{path}/postings")
    if terms is not None:
        own = spark.createDataFrame([(t,) for t in sorted(set(terms))], "term string").select(_bucket("term", settings["buckets"]).alias("b")).distinct().collect()
        rows = rows.where(F.col("bucket").isin([r["b"] for r in own]) & F.col("term").isin(sorted(set(terms))))
    return rows.select("term", "block", F.explode(codecs.unpack_by("codec", "postings")).alias("_d")).select("term", (F.col("_d") + F.col("block") * settings["block"]).alias("doc_id"))


def terms_of(tree) -> list[str]:
    """The words of a parsed query."""
    if isinstance(tree, Term):
        return [tree.word]
    return terms_of(tree.of) if isinstance(tree, Not) else sorted({*terms_of(tree.left), *terms_of(tree.right)})


def search_index(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The ids of the documents that fit a Boolean query, from the postings of its words alone."""
    tree = parse_boolean(query)
    found = read_postings(spark, path, terms_of(tree)).groupBy("doc_id").agg(F.collect_set("term").alias("_t"))
    every = spark.read.parquet(f"{path}/documents").join(found, "doc_id", "left").withColumn("_t", F.coalesce("_t", F.array().cast("array<string>")))
    return every.where(tree.column(F.col("_t"))).select("doc_id")
