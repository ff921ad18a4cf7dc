"""Training-data pipeline: quality rules, near duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return the
columns of documents. ``run`` applies them to the documents table, writing and rereading each stage's result.

Defined results: an empty table stays empty in every stage; columns that are not of documents, whatever their names, pass through
all stages; repeated rows are judged alike by the first stage, and the second keeps one row of each id. A null text has no
words and is rejected by the first stage; of a stage by itself, null texts are no copies, hold no passage and have size 0. A
null id keeps a row from the removal of copies, a null source is a source like any other and the last. Very long texts go
through every stage whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import common, decontaminate, jaccard_join, mixing, quality_rules, sharding


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject; learned from the labels of docs."""
    return quality_rules.clean_documents(docs, quality_rules.learn(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at 0.75."""
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: a row for each pass over a document."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with slot and shard."""
    return sharding.place(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixture),
    ("sharding", shards),
]

#: Learned rules and hash-ordered blocks can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = common.table(spark, sf_dir, "documents")
    folder = common.work_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
