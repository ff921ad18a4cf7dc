"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over every training window.

Words are runs of ASCII letters, digits and non-ASCII characters, A to Z in lower case. The windows of an item are its
runs of ``n`` words; an item of fewer words, but not none, is one window. Each task hashes its words and windows with
numpy from the text's bytes, looks them up in the broadcast set and compares the words of every hit with the item's.

Benchmarks are broadcast in blocks of at most ``block_words`` words, as arrays (about 60 bytes of memory a word: hash, place,
bytes and look-up table): a larger benchmark is scanned for in several passes, with the found spans kept on the rows between
them.

Defined results: null or wordless texts have no words and no hits; wordless items have no windows; items that share a
window are all named; repeated item ids count once, and so do all items without an id together, which items_sha256 leaves
out; rows of documents are judged one by one, so repeated rows repeat; very long texts are scanned whole; an empty benchmark
leaves all clean, an empty table gives no rows. Other columns are kept, whatever their names; only find_hits() replaces those
named like what it adds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

SPAN = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
#: Words that one broadcast block of benchmark items holds; one item of more words is a block of its own.
BLOCK_WORDS = 1_000_000


class NgramSet:
    """The windows of some items by hash, with their words for verification, all in arrays."""

    def __init__(self, items: list[tuple[str | None, str]], n: int):
        self.n, self.items = n, [item for item, _ in items]
        raw = [(text or "").encode() for _, text in items]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        w = tokens.Words(self.data, np.cumsum([0, *map(len, raw)]), tokens.alnum_table())
        kind = np.int32 if len(self.data) < 1 << 31 else np.int64
        self.start, self.end, self.row = w.start.astype(kind), w.end.astype(kind), w.row.astype(np.int32)
        bounds = w.bounds()
        count = np.diff(bounds)
        #: By number of words in a window: its hashes in order, the first word of each, and a look-up table.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({int(min(n, c)) for c in count if c}):
            # Items of fewer than n words have one window, others one at each word but the last.
            many = (count >= n) if length == n else count == length
            at = np.flatnonzero(np.repeat(many, count))
            at = at[at + length <= bounds[self.row[at] + 1]]
            hashes = w.grams(length)[at]
            order = np.argsort(hashes, kind="stable")
            self.windows[length] = hashes[order], at[order].astype(kind), self._seen(hashes)

    @staticmethod
    def _seen(hashes: np.ndarray) -> np.ndarray:
        """Whether any hash begins with these bits; 8 to 16 cells a hash."""
        bits = max(16, int(len(hashes) * 8).bit_length())
        seen = np.zeros(1 << bits, bool)
        seen[hashes >> np.uint64(64 - bits)] = True
        return seen

    def words(self, i: int, j: int) -> list[bytes]:
        return [self.data[self.start[k] : self.end[k]].tobytes().lower() for k in range(i, j)]

    def find(self, w: tokens.Words) -> Iterator[tuple[int, int, int, set[str]]]:
        """Row, first word, end word and items of each verified window; words count within the row."""
        bounds = w.bounds()
        for length, (known, places, seen) in self.windows.items():
            hashes = w.grams(length)
            if not len(hashes):
                continue
            at = np.flatnonzero(seen[hashes >> np.uint64(65 - len(seen).bit_length())])
            at = at[w.row[at] == w.row[at + length - 1]]
            low, high = np.searchsorted(known, hashes[at], "left"), np.searchsorted(known, hashes[at], "right")
            for i, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                words = w.text(i, i + length)
                items = {self.items[self.row[p]] for p in places[a:b].tolist() if self.words(p, p + length) == words}
                if items:
                    row = int(w.row[i])
                    yield row, i - int(bounds[row]), i - int(bounds[row]) + length, items


def _scan(text_at: int, earlier: tuple[int, int] | None, block, schema: pa.Schema):
    """A function for mapInArrow that appends n_words, spans and items to its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, values = block.value, tokens.alnum_table()
        for batch in batches:
            counts, spans, items = np.zeros(batch.num_rows, np.int64), {}, {}
            if earlier:
                spans = {i: [(s["begin"], s["end"]) for s in v] for i, v in enumerate(batch.column(earlier[0]).to_pylist()) if v}
                items = {i: set(v) for i, v in enumerate(batch.column(earlier[1]).to_pylist()) if v}
            for first, end, data, offsets in tokens.slices(batch.column(text_at)):
                w = tokens.Words(data, offsets, values)
                counts[first:end] = np.diff(w.bounds())
                for row, i, j, found in grams.find(w):
                    own = spans.setdefault(first + row, [])
                    items.setdefault(first + row, set()).update(found)
                    own.append((i, j))
            rows = range(batch.num_rows)
            merged = [_merged(spans.get(i)) for i in rows]
            columns = [c for k, c in enumerate(batch.columns) if not earlier or k < len(batch.columns) - 3]
            columns += [pa.array(counts), pa.array(merged, schema.field("_spans").type), pa.array([sorted(items.get(i, ()), key=lambda x: (x is None, x or "")) for i in rows], schema.field("_items").type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _merged(spans: list[tuple[int, int]] | None) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for i, j in sorted(spans or ()):
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
        else:
            out.append([i, j])
    return [{"begin": i, "end": j} for i, j in out]


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with _n_words, _spans (merged word ranges that are hit) and _items (ids as strings, sorted)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    # Half the characters is a bound on the words of a text.
    size = items.agg(F.coalesce(F.sum((F.length("text") + 1) / 2), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_words))
    base = docs.drop("_n_words", "_spans", "_items")
    fields = [T.StructField("_n_words", T.LongType()), T.StructField("_spans", SPAN), T.StructField("_items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*base.schema.fields, *fields])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    arrow = to_arrow_schema(schema)
    out = base
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()
        block = spark.sparkContext.broadcast(NgramSet([(r[0], r[1]) for r in rows], n))
        earlier = None if b == 0 else (len(base.columns) + 1, len(base.columns) + 2)
        out = out.mapInArrow(_scan(base.columns.index(text), earlier, block, arrow), schema)
        if b < blocks - 1:
            out = common.stored(out, f"{common.work_folder(spark, 'decontamination')}/{b}")
    return out


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_hits(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), n=n, block_words=block_words)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that no window hits, with their columns."""
    base, back = common.inner_names(docs, "text")
    return find_hits(base, benchmark, n=n, block_words=block_words).where(F.size("_spans") == 0).select(*back)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the hit words cut from text; what lies between two hit words of a span goes too."""

    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out, values = [], tokens.alnum_table()
        for text, ranges in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if text and ranges:
                raw = text.encode()
                w = tokens.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), values)
                kept, at = [], 0
                for r in ranges:
                    kept.append(raw[at : w.start[r["begin"]]])
                    at = int(w.end[r["end"] - 1])
                text = b"".join([*kept, raw[at:]]).decode()
            out.append(text)
        return pa.array(out, pa.string())

    cutter = F.arrow_udf(cut, T.StringType())
    base, back = common.inner_names(docs, "text")
    found = find_hits(base, benchmark, n=n, block_words=block_words)
    kept = F.when(F.size("_spans") > 0, cutter(F.col("text"), F.col("_spans"))).otherwise(F.col("text"))
    return found.withColumn("text", kept).select(*back)


def items_digest(items: list[str]) -> str:
    """The digest that report() gives for these items."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
hits AS (
  SELECT x.k, x.i, g.n, g.item
  FROM (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
        FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
              FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)) x
  JOIN g ON g.n = x.n AND g.gram = x.gram),
covered AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY k),
named AS (
  SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (k) LEFT JOIN named m USING (k)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
