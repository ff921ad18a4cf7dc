"""Queries over the words of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs
from ..functions import text as tx
from ..functions.stemmers import snowball
from ..operators import index
from ..operators import text as ops
from ..storage import work_path
from .book import Book

TOKENS = r"SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS w FROM documents"
TF = f"""
t AS ({TOKENS}),
o AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM t),
tf AS (SELECT doc_id, word, list(p ORDER BY p) AS positions FROM o GROUP BY ALL),
st AS (SELECT word, count(*) AS count_documents, CAST(sum(len(positions)) AS BIGINT) AS count_in_corpus FROM tf GROUP BY word)"""


def register(book: Book) -> None:
    book.add(
        "a1_document_frequency",
        lambda t: ops.document_frequency(t.documents),
        r"SELECT word, count(*) AS df FROM (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '\p{L}+'))) AS word FROM documents) GROUP BY word",
    )
    book.add(
        "a9_postings",
        lambda t: ops.build_postings(t.documents).select("term", F.size("docs").cast("long").alias("n"), F.array_join(F.transform("docs", lambda x: x.cast("string")), " ").alias("docs")),
        f"WITH t AS ({TOKENS}), o AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM t) SELECT term, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY doc_id) AS docs FROM o GROUP BY term",
    )
    book.add(
        "a10_positional_tf",
        lambda t: ops.positional_tf(t.documents).select("doc_id", "word", F.size("positions").cast("long").alias("n"), F.array_join(F.transform("positions", lambda x: x.cast("string")), " ").alias("positions")),
        f"WITH {TF} SELECT doc_id, word, CAST(len(positions) AS BIGINT) AS n, array_to_string(positions, ' ') AS positions FROM tf",
    )
    book.add("a11_corpus_stats", lambda t: ops.corpus_stats(ops.positional_tf(t.documents)), f"WITH {TF} SELECT * FROM st")
    book.add(
        "a12_median_idf",
        lambda t: ops.median_idf(ops.corpus_stats(ops.positional_tf(t.documents))).select(F.round("median_idf", 6).alias("median_idf")),
        f"WITH {TF} SELECT round(median(-ln(count_in_corpus / (SELECT sum(count_in_corpus) FROM st))), 6) AS median_idf FROM st",
    )
    book.add(
        "e16_collection_idf",
        lambda t: ops.collection_idf(ops.corpus_stats(ops.positional_tf(t.documents))).select("word", F.round("idf", 6).alias("idf")),
        f"WITH {TF} SELECT word, round(-ln(count_in_corpus / (SELECT sum(count_in_corpus) FROM st)), 6) AS idf FROM st",
    )
    book.add(
        "e17_candidate_idf",
        lambda t: ops.document_frequency(t.documents).crossJoin(F.broadcast(t.documents.agg(F.count("*").alias("n")))).select("word", F.round(-F.ln(F.col("df") / F.col("n")), 6).alias("idf")),
        r"SELECT word, round(-ln(count(*) / (SELECT count(*) FROM documents)), 6) AS idf FROM (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '\p{L}+'))) AS word FROM documents) GROUP BY word",
    )
    book.add(
        "e8_tokenize_words",
        lambda t: t.documents.select("doc_id", F.explode(tx.tokenize("text", tx.WORDS)).alias("word")).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("word").alias("n_distinct")),
        f"WITH t AS ({TOKENS}) SELECT doc_id, count(*) AS n, count(DISTINCT word) AS n_distinct FROM (SELECT doc_id, unnest(w) AS word FROM t) GROUP BY doc_id",
    )
    book.add(
        "e11_normalize_text",
        lambda t: t.documents.select("doc_id", F.md5(tx.normalize("text")).alias("normal")),
        r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(text, '-' || chr(10), ''), '[^\p{L}\p{N}_]+', ' ', 'g'), '([0-9]+)', ' \1 ', 'g'), ' +', ' ', 'g'))) AS normal FROM documents""",
    )
    book.add(
        "e12_fold_letters",
        lambda t: t.pages.select("page_id", F.md5(tx.fold_letters("url")).alias("folded")),
        "SELECT page_id, md5(trim(replace(replace(url, 'ё', 'е'), '_', ''))) AS folded FROM pages",
    )
    book.add(
        "e14_title",
        lambda t: t.pages.select("page_id", tx.title("html").alias("title")),
        r"SELECT page_id, trim(regexp_extract(lower(html), '(?s)<title>(.*?)</title>', 1)) AS title FROM pages",
    )
    book.add(
        "e15_visible_text",
        lambda t: t.pages.select("page_id", F.md5(tx.visible_text("html")).alias("visible")),
        r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<head.*?</head>|<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS visible FROM pages""",
    )
    book.add("e13_stemmed_frequency", lambda t: t.documents.select("doc_id", F.explode(F.array_distinct(tx.stem(tx.tokenize("text"), snowball))).alias("word")).groupBy("word").agg(F.count("*").alias("df")))
    book.add(
        "e27_bag_of_words",
        lambda t: ops.bag_of_words(t.documents, ["the", "and", "der", "les", "que"]),
        r"WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\p{L}+'), lambda x: lower(x)) AS w FROM documents) SELECT doc_id, "
        + ", ".join(f"CAST(len(list_filter(w, lambda x: x = '{v}')) AS BIGINT) AS \"{v}\"" for v in ["the", "and", "der", "les", "que"])
        + " FROM t",
    )
    book.add(
        "e29_float_list",
        lambda t: t.embeddings.select("vec_id", F.concat(F.lit("[ "), F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 3).cast("string")), "\n "), F.lit("]")).alias("s")).select("vec_id", F.round(F.aggregate(tx.float_list("s"), F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size(tx.float_list("s")).cast("long").alias("n")),
        "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 3))), 5) + 0.0 AS total, CAST(len(embedding) AS BIGINT) AS n FROM embeddings",
    )
    for codec in codecs.CODECS:
        # How long the packed bytes are follows from the format, and the values have to come back.
        book.add(
            f"e10_{codec}_postings",
            lambda t, codec=codec: ops.build_postings(t.documents).select("term", "docs", codecs.pack("docs", codec).alias("b")).select("term", F.length("b").cast("long").alias("bytes"), F.array_join(F.transform(codecs.unpack("b", codec), lambda x: x.cast("string")), " ").alias("docs")),
            f"WITH t AS ({TOKENS}), o AS (SELECT DISTINCT doc_id, unnest(w) AS term FROM t), p AS (SELECT term, list(doc_id ORDER BY doc_id) AS d FROM o GROUP BY term) SELECT term, {CODEC_BYTES[codec]} AS bytes, array_to_string(d, ' ') AS docs FROM p" if codec in CODEC_BYTES else None,
        )
    book.add("s12_stored_index", _stored_index, f"WITH t AS ({TOKENS}) SELECT doc_id FROM t WHERE (list_contains(w, 'the') OR list_contains(w, 'der')) AND NOT (list_contains(w, 'and') AND list_contains(w, 'of'))")
    book.add("s12_stored_postings", _stored_postings, f"WITH t AS ({TOKENS}) SELECT DISTINCT term, doc_id FROM (SELECT doc_id, unnest(w) AS term FROM t) WHERE term IN ('the', 'der', 'que')")


#: Bytes of a packed list d by the format of its codec.
CODEC_BYTES = {
    "varbyte": "CAST(list_sum(list_transform(d, lambda x: 1 + (x >= 128)::INT + (x >= 16384)::INT + (x >= 2097152)::INT + (x >= 268435456)::INT)) AS BIGINT)",
    "raw": "CAST(4 * len(d) AS BIGINT)",
}


def _stored_index(t):
    path = work_path(t.spark, "index")
    index.write_index(t.documents, path, codec="simple9")
    return index.search_index(t.spark, path, "(the | der) & !(and & of)")


def _stored_postings(t):
    path = work_path(t.spark, "index")
    index.write_index(t.documents, path, block=64)
    return index.read_postings(t.spark, path, ["the", "der", "que"])
