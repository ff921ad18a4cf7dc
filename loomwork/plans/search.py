"""Queries of retrieval, ranking and learning to rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORDS, tokenize
from ..operators import ltr, relevance, search
from ..operators import text as ops
from .book import Book, Tables
from .words import TF, TOKENS

BOOLEAN = {
    "and": ("the & and", "{the} AND {and}"),
    "or_not": ("der | les & !que", "{der} OR ({les} AND NOT {que})"),
    "nested": ("(the | der) & !(and & of)", "({the} OR {der}) AND NOT ({and} AND {of})"),
}
#: Queries made of the benchmark items whose id is divisible by 50: the first three words, then the next three; against every document.
QUERIES_SQL = r"""
q AS (SELECT item_id AS query_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS w FROM benchmark WHERE item_id % 50 = 0),
tok AS (SELECT query_id, unnest(w[1:3]) AS word, unnest(generate_series(1, least(3, len(w)))) AS i, 'base' AS kind FROM q WHERE len(w) > 0
        UNION ALL SELECT query_id, unnest(w[4:6]), unnest(generate_series(1, len(w[4:6]))), 'ext' FROM q WHERE len(w) > 3),
pairs AS (SELECT query_id, doc_id FROM q, documents)"""
SCORE_SQL = f"""WITH {TF}, {QUERIES_SQL},
n AS (SELECT sum(count_in_corpus) AS n FROM st),
med AS (SELECT median(-ln(count_in_corpus / n)) AS m FROM st, n),
len AS (SELECT doc_id, sum(len(positions)) AS len FROM tf GROUP BY doc_id),
rows AS (
  SELECT p.query_id, p.doc_id, tok.kind, tok.i, coalesce(-ln(st.count_in_corpus / n.n), 0) AS idf, coalesce(tf.positions, []) AS pos, coalesce(len.len, 0) AS len
  FROM pairs p JOIN tok USING (query_id) CROSS JOIN n LEFT JOIN st USING (word) LEFT JOIN tf ON tf.doc_id = p.doc_id AND tf.word = tok.word LEFT JOIN len ON len.doc_id = p.doc_id),
two AS (SELECT *, lead(pos) OVER w AS nx, lead(idf) OVER w AS idf2 FROM rows WINDOW w AS (PARTITION BY query_id, doc_id, kind ORDER BY i)),
three AS (
  SELECT *, CASE WHEN len(pos) > 0 THEN idf * (len(pos) / (len(pos) + 1 + len / 1000.0)) ELSE 0 END AS w,
    CASE WHEN nx IS NULL THEN 0 ELSE 1.5 * len(list_filter(pos, lambda x: list_contains(nx, x + 1))) + 0.7 * len(list_filter(pos, lambda x: list_contains(nx, x - 1))) + 0.5 * len(list_filter(pos, lambda x: list_contains(nx, x + 2))) END AS t
  FROM two),
score AS (
  SELECT query_id, doc_id,
    sum(CASE kind WHEN 'base' THEN w ELSE 0.3 * w END)
    + sum(CASE WHEN nx IS NULL THEN 0 ELSE (CASE kind WHEN 'base' THEN 0.3 ELSE 0.09 END) * (idf + idf2) * t / (1 + t) END)
    + 0.2 * sum(CASE kind WHEN 'base' THEN idf ELSE 0 END) * pow(0.03, sum(CASE WHEN kind = 'base' AND len(pos) = 0 AND idf > (SELECT m FROM med) THEN 1 ELSE 0 END)) AS score
  FROM three GROUP BY ALL)"""
LTR_SQL = """b AS (SELECT d.source AS qid, d.doc_id AS doc, CAST(l.quality + l.toxic AS DOUBLE) AS rel, d.n_chars / 1000.0 AS score FROM documents d JOIN labels l USING (doc_id)),
p AS (SELECT *, pow(2, rel) - 1 AS gain, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS pos, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc) AS best FROM b),
g AS (SELECT qid, sum(gain / ln(pos + 1)) AS dcg, sum(gain / ln(best + 1)) AS idcg FROM p GROUP BY qid)"""


def _has(word: str) -> str:
    return f"list_contains(w, '{word}')"


def query_table(t: Tables) -> DataFrame:
    words = tokenize("text", WORDS)
    return t.benchmark.where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.slice(words, 1, 3).alias("base"), F.slice(words, 4, 3).alias("ext"))


def ranked(t: Tables) -> DataFrame:
    """The stated queries against every document: documents without a query word have a score too, and a rank."""
    return relevance.rank_texts(query_table(t), t.documents)


def judged(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").select(F.col("source").alias("qid"), F.col("doc_id").alias("doc"), (F.col("quality") + F.col("toxic")).alias("rel"), (F.col("n_chars") / 1000).alias("score"))


def register(book: Book) -> None:
    for name, (query, where) in BOOLEAN.items():
        sql = where.format(**{"the": _has("the"), "and": _has("and"), "der": _has("der"), "les": _has("les"), "que": _has("que"), "of": _has("of")})
        book.add(f"g4_boolean_{name}", lambda t, query=query: search.boolean_search(t.documents, query), f"WITH t AS ({TOKENS}) SELECT doc_id FROM t WHERE {sql}")
    book.add("j6_postings_and", lambda t: search.search_postings(ops.build_postings(t.documents), ["the", "of"]), f"WITH t AS ({TOKENS}) SELECT doc_id FROM t WHERE {_has('the')} AND {_has('of')}")
    book.add("j7_postings_or", lambda t: search.search_postings(ops.build_postings(t.documents), ["der", "que"], every=False), f"WITH t AS ({TOKENS}) SELECT doc_id FROM t WHERE {_has('der')} OR {_has('que')}")
    book.add("j8_postings_not", lambda t: t.documents.select("doc_id").join(search.search_postings(ops.build_postings(t.documents), ["the"]), "doc_id", "left_anti"), f"WITH t AS ({TOKENS}) SELECT doc_id FROM t WHERE NOT {_has('the')}")
    book.add("j10_adjacent_words", _adjacent,
             f"WITH {TF}, x AS (SELECT a.doc_id, a.positions AS p, b.positions AS q FROM tf a JOIN tf b ON a.doc_id = b.doc_id AND a.word = 'of' AND b.word = 'the') SELECT doc_id, " + ", ".join(f"CAST(len(list_filter(p, lambda x: list_contains(q, x + {k}))) AS BIGINT) AS {n}" for n, k in (("forward", 1), ("inverse", -1), ("skip", 2))) + " FROM x")
    book.add("g5_relevance_score", lambda t: ranked(t).select("query_id", "doc_id", F.round("score", 5).alias("score")), SCORE_SQL + " SELECT query_id, doc_id, round(score, 5) AS score FROM score")
    book.add("t3_ranked_documents", lambda t: ranked(t).select("query_id", "doc_id", "rank"), SCORE_SQL + " SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM score")
    book.add("g6_ndcg", lambda t: ltr.ndcg(judged(t)).select("qid", F.round("ndcg", 6).alias("ndcg")), f"WITH {LTR_SQL} SELECT qid, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE dcg END, 6) AS ndcg FROM g")
    book.add("a29_mean_ndcg", lambda t: ltr.mean_ndcg(judged(t)).select(F.round("mean_ndcg", 6).alias("mean_ndcg")), f"WITH {LTR_SQL} SELECT round(avg(dcg / idcg), 6) AS mean_ndcg FROM g WHERE dcg > 0")
    book.add("g6_lambda_gradients", lambda t: ltr.lambda_gradients(judged(t)).select("qid", "doc", (F.round("gradient", 6) + 0.0).alias("gradient"), F.round("hessian", 6).alias("hessian")),
             f"""WITH {LTR_SQL}, x AS (SELECT a.qid, a.doc, a.rel > b.rel AS above, abs((1 / ln(b.pos + 1) - 1 / ln(a.pos + 1)) * (a.gain - b.gain)) / CASE WHEN g.idcg > 0 THEN g.idcg ELSE 1 END AS d,
             1 / (1 + exp(least(abs(a.score - b.score), 50))) AS r FROM p a JOIN p b USING (qid) JOIN g USING (qid) WHERE a.rel <> b.rel),
             s AS (SELECT qid, doc, sum(CASE WHEN above THEN -d * r ELSE d * r END) AS gr, sum(d * r * (1 - r)) AS h FROM x GROUP BY ALL)
             SELECT p.qid, p.doc, round(coalesce(s.gr, 0), 6) + 0.0 AS gradient, round(CASE WHEN coalesce(s.h, 0) = 0 THEN 1 ELSE s.h END, 6) AS hessian FROM p LEFT JOIN s USING (qid, doc)""")  # fmt: skip


def _adjacent(t: Tables) -> DataFrame:
    tf = ops.positional_tf(t.documents)
    a = tf.where("word = 'of'").select("doc_id", F.col("positions").alias("p"))
    b = tf.where("word = 'the'").select("doc_id", F.col("positions").alias("q"))
    return a.join(b, "doc_id").select("doc_id", *(relevance.pair_count(F.col("p"), F.col("q"), k).cast("long").alias(n) for n, k in (("forward", 1), ("inverse", -1), ("skip", 2))))
