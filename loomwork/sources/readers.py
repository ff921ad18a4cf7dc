"""Readers and writers of the text formats, all on Spark's own file sources."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_clicks(spark: SparkSession, path: str) -> DataFrame:
    """query, url of a tab-separated click log."""
    from ..operators.clicks import parse_clicks

    return parse_clicks(spark.read.text(path))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """id, url of a tab-separated dictionary."""
    return spark.read.csv(path, sep="\t", schema="id long, url string")


def page_html(column: str | Column) -> Column:
    """HTML of a base64, zlib-compressed column; null where it is damaged."""
    import pyarrow as pa

    def one(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else zlib.decompress(raw).decode("utf-8", "replace")
        except zlib.error:
            return None

    c = F.col(column) if isinstance(column, str) else column
    return F.arrow_udf(lambda a: pa.array([one(x) for x in a.to_pylist()], pa.string()), "string")(F.unbase64(c))


def packed_html(column: str | Column) -> Column:
    """HTML as base64 of its zlib compression."""
    import pyarrow as pa

    pack = F.arrow_udf(lambda a: pa.array([None if x is None else zlib.compress(x.encode()) for x in a.to_pylist()], pa.binary()), "binary")
    return F.base64(pack(F.col(column) if isinstance(column, str) else column))


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """page_id, html of lines with an id, a tab and the packed page."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).select(parts[0].cast("long").alias("page_id"), page_html(parts[1]).alias("html"))


def read_document_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, url (first line) and html (the rest, lower-cased) of a file a document."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\r?\n", 2).alias("p"))
    return whole.select("path", F.col("p")[0].alias("url"), F.lower(F.coalesce(F.get("p", F.lit(1)), F.lit(""))).alias("html"))


def read_word_lists(spark: SparkSession, paths: dict[str, int]) -> DataFrame:
    """word, label of files with a word a line."""
    out: DataFrame | None = None
    for path, label in paths.items():
        one = spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").alias("word"), F.lit(label).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


def read_semicolon_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """A ;-separated file with a header row, under an explicit schema."""
    return spark.read.csv(path, sep=";", header=True, schema=schema)


def read_chunks(spark: SparkSession, paths: list[str], schema: str, **options) -> DataFrame:
    """The rows of several CSV files."""
    return spark.read.csv(paths, schema=schema, **options)


def read_svmlight(spark: SparkSession, path: str) -> DataFrame:
    """label, qid, features (map of number to value) of svmlight lines with a query id."""
    parts = F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> ''").select(parts.alias("p"))
    pairs = F.transform(F.filter("p", lambda x: x.contains(":") & ~x.startswith("qid:")), lambda x: F.split(x, ":"))
    entries = F.transform(pairs, lambda x: F.struct(x[0].cast("int").alias("k"), x[1].cast("double").alias("v")))
    qid = F.substring_index(F.get(F.filter("p", lambda x: x.startswith("qid:")), F.lit(0)), ":", -1)
    return rows.select(F.col("p")[0].cast("double").alias("label"), qid.cast("long").alias("qid"), F.map_from_entries(entries).alias("features"))


def read_ffm(spark: SparkSession, path: str) -> DataFrame:
    """label, nodes (array of f, j, v) of field:index:value lines."""
    parts = F.split(F.trim("value"), r"\s+")
    triples = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.split(x, ":"))
    nodes = F.transform(triples, lambda x: F.struct(x[0].cast("int").alias("f"), x[1].cast("int").alias("j"), x[2].cast("double").alias("v")))
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].cast("double").alias("label"), nodes.alias("nodes"))


def read_gbdt(spark: SparkSession, path: str, dense: bool = True) -> DataFrame:
    """label and values (dense) or indices (sparse) of blank-separated lines."""
    parts = F.split(F.trim("value"), r"\s+")
    rest = F.slice(parts, F.lit(2), F.size(parts)).cast("array<double>" if dense else "array<int>")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].cast("int").alias("label"), rest.alias("values" if dense else "indices"))


def read_corpus_stats(spark: SparkSession, path: str) -> DataFrame:
    """word, count_documents, count_in_corpus of tab-separated lines; the line with the total alone is left out."""
    return spark.read.csv(path, sep="\t", schema="word string, count_documents long, count_in_corpus long").where("count_in_corpus is not null")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text, reformulations; a byte order mark is skipped."""
    rows = spark.read.text(path).select(F.split(F.regexp_replace("value", "^﻿", ""), "\t", -1).alias("p"))
    return rows.where(F.size("p") >= 2).select(F.col("p")[0].cast("long").alias("query_id"), F.col("p")[1].alias("text"), F.coalesce(F.get("p", F.lit(2)), F.lit("")).alias("reformulations"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """query_id, docs of a QueryId,DocumentId file."""
    rows = spark.read.csv(path, header=True, schema="query_id long, doc_id long")
    return rows.groupBy("query_id").agg(F.collect_list("doc_id").alias("docs"))


def write_ranking(ranked: DataFrame, path: str) -> None:
    """QueryId,DocumentId in order of query and rank, as part files whose order is that of the rows."""
    ranked.orderBy("query_id", "rank").select(F.col("query_id").alias("QueryId"), F.col("doc_id").alias("DocumentId")).write.mode("overwrite").csv(path, header=True)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """epoch, seconds, mean_reward, test_reward of tab-separated lines; marks between epochs are left out."""
    return spark.read.csv(path, sep="\t", schema="epoch long, seconds double, mean_reward double, test_reward double").where("epoch is not null and seconds is not null")


def read_training_state(spark: SparkSession, path: str) -> DataFrame:
    """epoch, elapsed, avg_reward, test_reward of a JSON state with parallel arrays."""
    state = spark.read.json(path, schema="elapsed_times array<double>, avg_rewards array<double>, test_rewards array<double>")
    zipped = F.arrays_zip("elapsed_times", "avg_rewards", "test_rewards")
    return state.select(F.posexplode(zipped).alias("epoch", "x")).select(F.col("epoch").cast("long").alias("epoch"), F.col("x.elapsed_times").alias("elapsed"), F.col("x.avg_rewards").alias("avg_reward"), F.col("x.test_rewards").alias("test_reward"))


def read_vector_csv(spark: SparkSession, path: str, vectors: list[str]) -> DataFrame:
    """A CSV file whose cells hold bracketed number lists over several lines."""
    from ..functions.text import float_list

    rows = spark.read.csv(path, header=True, multiLine=True)
    return rows.select(*(float_list(c).alias(c) if c in vectors else F.col(c) for c in rows.columns))


def path_label(path: str | Column) -> Column:
    """The name of a file's folder: the label that a path encodes."""
    return F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -2)


def rename_columns(df: DataFrame, old: str = ".", new: str = "_") -> DataFrame:
    return df.toDF(*(c.replace(old, new) for c in df.columns))


def _fields(message: bytes) -> dict[int, str]:
    """Length-delimited fields of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = message[at]
            value, at, shift = value | (b & 127) << shift, at + 1, shift + 7
            if b < 128:
                return value, at

    out, at = {}, 0
    while at < len(message):
        tag, at = varint(at)
        if tag & 7 != 2:
            raise ValueError(f"wire type {tag & 7} in a message of strings")
        size, at = varint(at)
        out[tag >> 3] = message[at : at + size].decode("utf-8", "replace")
        at += size
    return out


def read_document_stream(spark: SparkSession, path: str) -> DataFrame:
    """url, body, text of files of length-prefixed messages, gzipped or plain; a file is read by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                rows, at = [], 0
                while at + 4 <= len(raw):
                    (size,) = struct.unpack_from("<i", raw, at)
                    found = _fields(raw[at + 4 : at + 4 + size])
                    rows.append((found.get(1), found.get(2), found.get(3)))
                    at += 4 + size
                yield pd.DataFrame(rows, columns=["url", "body", "text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "url string, body string, text string")


def write_positional_tf(tf: DataFrame, path: str) -> None:
    """doc_id, word, positions as text: a folder for each document, a line for each word (word, count, places), its length last."""
    lines = tf.select("doc_id", F.lit(0).alias("_o"), "word", F.concat_ws("\t", "word", F.size("positions").cast("string"), F.array_join(F.transform("positions", lambda x: x.cast("string")), " ")).alias("value"))
    length = tf.groupBy("doc_id").agg(F.sum(F.size(F.filter("positions", lambda p: p > 0))).cast("string").alias("value")).select("doc_id", F.lit(1).alias("_o"), F.lit("").alias("word"), "value")
    rows = lines.union(length).repartition("doc_id").sortWithinPartitions("doc_id", "_o", "word")
    rows.select("doc_id", "value").write.mode("overwrite").partitionBy("doc_id").text(path)


def read_positional_tf(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, word, positions of what write_positional_tf() wrote; lines that hold a length alone are left out."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(parts) == 3)
    return rows.select("doc_id", parts[0].alias("word"), F.transform(F.split(parts[2], " "), lambda x: x.cast("int")).alias("positions"))


def write_corpus_stats(stats: DataFrame, path: str) -> None:
    """word, count_documents, count_in_corpus as tab-separated lines, the total last in a file of its own."""
    stats.select("word", "count_documents", "count_in_corpus").write.mode("overwrite").csv(path, sep="\t")
    stats.agg(F.sum("count_in_corpus").cast("string").alias("value")).coalesce(1).write.mode("append").text(path)


def read_wave(spark: SparkSession, path: str) -> DataFrame:
    """path, label (its folder), samplerate, duration in seconds and samples (mono, as doubles from -1 to 1) of 16-bit wave files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import wave

        import numpy as np

        for batch in batches:
            rows = []
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                with wave.open(io.BytesIO(raw)) as w:
                    if w.getsampwidth() != 2:
                        raise ValueError(f"{name}: {8 * w.getsampwidth()} bits a sample, not 16")
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(axis=1) / 32768
                    rows.append((name, w.getframerate(), w.getnframes() / w.getframerate(), x.tolist()))
            yield pd.DataFrame(rows, columns=["path", "samplerate", "duration", "samples"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, samplerate int, duration double, samples array<double>")
    return found.select("path", path_label("path").alias("label"), "samplerate", "duration", "samples")
