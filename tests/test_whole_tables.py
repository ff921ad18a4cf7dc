"""Queries over whole tables, against plain Python on small tables."""

import math
from collections import Counter
from statistics import median

import numpy as np
import pytest

from loomwork.operators import cluster, stats
from loomwork.plans.registry import QUERIES

from .conftest import SF

ITEMS = [(0, "apple banana cherry date elder fig"), (50, "banana apple"), (250, "grape banana date apple zebra cherry fig")]
DOCS = [(i, " ".join("apple banana cherry date elder fig grape"[k:].split()[0] if (i + k) % 3 else f"w{i % 4}" for k in (0, 6, 13, 20, 25, 31))) for i in range(14)] + [(40, "nothing here"), (41, "banana apple banana apple")]


def python_scores(items, docs):
    words = {d: t.split() for d, t in docs}
    count = Counter(w for ws in words.values() for w in ws)
    idf = {w: -math.log(c / count.total()) for w, c in count.items()}
    middle, out = median(idf.values()), {}
    for q, text in items:
        for d, ws in words.items():
            score = 0.0
            for own, one, two in ((text.split()[:3], 1.0, 0.3), (text.split()[3:6], 0.3, 0.09)):
                at = [[i for i, w in enumerate(ws) if w == x] for x in own]
                score += sum(one * idf[x] * len(p) / (len(p) + 1 + len(ws) / 1000) for x, p in zip(own, at, strict=True) if p)
                for x, y, p, n in zip(own, own[1:], at, at[1:], strict=False):
                    t = sum(1.5 * (i + 1 in n) + 0.7 * (i - 1 in n) + 0.5 * (i + 2 in n) for i in p)
                    score += two * (idf.get(x, 0) + idf.get(y, 0)) * t / (1 + t)
            base = text.split()[:3]
            score += 0.2 * sum(idf.get(x, 0) for x in base) * 0.03 ** sum(x not in ws and idf.get(x, 0) > middle for x in base)
            out[q, d] = score
    return out


def test_every_item_is_ranked_against_every_document(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = python_scores(ITEMS, DOCS)
    got = {(r.query_id, r.doc_id): r.score for r in QUERIES["g5_relevance_score"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=2e-5) and len(got) == len(ITEMS) * len(DOCS)
    rank = {(r.query_id, r.doc_id): r["rank"] for r in QUERIES["t3_ranked_documents"](spark, str(tmp_path)).collect()}
    for q, _ in ITEMS:
        order = sorted((d for d, _ in DOCS), key=lambda d: (-round(want[q, d], 9), d))
        assert [rank[q, d] for d in order] == list(range(1, len(DOCS) + 1))


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", ["g7_gbt_leaves", "g9_hashed_logistic", "g13_l1_logistic"])
def test_every_line_is_scored(spark, name):
    assert QUERIES[name](spark, SF).count() == table(spark, "lineitem").count()


def test_training_reads_every_line(spark):
    made = {r.j for r in QUERIES["g8_train_ffm"](spark, SF).collect()}
    want = {x for r in table(spark, "lineitem").collect() for x in (r.l_linenumber, 100 + r.l_suppkey % 10, 200 + int(r.l_quantity) % 10)}
    assert made == want


def test_every_vector_is_compared(spark):
    rows = {r.vec_id: (r.label, np.array(r.embedding, float)) for r in table(spark, "embeddings").collect()}
    assert {r.vec_id for r in QUERIES["g11_agglomerative"](spark, SF).collect()} == set(rows)
    ids = sorted(rows)
    x, y = np.stack([rows[i][1] for i in ids]), np.array([rows[i][0] for i in ids])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {(r.a, r.b): r.distance for r in cluster.distance_matrix(table(spark, "embeddings"), "vec_id", "embedding").collect()}
    assert len(got) == len(ids) * (len(ids) - 1) // 2
    assert all(abs(got[ids[i], ids[j]] - d[i, j]) < 2e-5 for i in range(len(ids)) for j in range(i + 1, len(ids)))
    mean = np.stack([d[:, y == c].mean(axis=1) for c in np.unique(y)], axis=1)
    own = np.searchsorted(np.unique(y), y)
    a = mean[np.arange(len(ids)), own]
    mean[np.arange(len(ids)), own] = np.inf
    b = mean.min(axis=1)
    every = table(spark, "embeddings")
    assert stats.silhouette(every, every, "vec_id", "embedding", "label").first().silhouette == pytest.approx(np.mean((b - a) / np.maximum(a, b)), abs=2e-5)
    with pytest.raises(ValueError):
        cluster._linkage(np.zeros((cluster.MOST_POINTS + 1, 1)), 2, "single")
