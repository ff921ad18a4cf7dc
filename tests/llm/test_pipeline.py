"""The pipeline against a plain Python version of its stages."""

import hashlib
from collections import Counter

import corpus_pipeline
from loomwork.llm import decontaminate, quality_rules, sharding

from ..conftest import SF
from .test_free_operators import python_components, python_hits
from .test_native_operators import WORD, fill, python_statistics


def test_pipeline_matches_plain_python(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality_rules.learn(table, spark.read.parquet(f"{SF}/labels.parquet"))
    judged = {r.doc_id for r in quality_rules.judge(table, rules).where("kept").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in table.collect()]
    passed = [r for r in rows if (lambda s: s[0] >= 20 and 100 * s[4] <= 30 * s[0])(python_statistics(r[1])) and r[0] in judged]
    component = {d: c for d, _, c in python_components([(d, t) for d, t, _ in passed])}
    single = [r for r in passed if component[r[0]] == r[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r for r in single if not python_hits(r[1], items)[4]]
    sizes = Counter()
    for _, t, s in clean:
        sizes[s] += len(WORD.findall(t))
    order = sorted(sizes)
    target = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    texts, taken = {r[0]: r for r in clean}, Counter()
    table_of = sharding.lookup_table(sharding.shard_names(sharding.SHARDS))
    for r in out:
        assert r.doc_id in texts
        taken[r.source] += len(WORD.findall(r.text))
        at = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert r.shard == f"shard-{table_of[at]:05d}"
    assert all(abs(taken[s] - target[s]) <= 128 for s in sizes)
    assert max(Counter(r.doc_id for r in out).values()) <= 2


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), SF).columns == docs.columns
    assert decontaminate.clean_documents(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() < docs.count()
