"""Saved models judge as before."""

import numpy as np

from loomwork.llm import language_id, license_scan, models, quality_rules, url_filter

from ..conftest import SF


def test_models_come_back_as_they_were(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    texts = [r.text or "" for r in docs.limit(50).collect()]
    made = {"language": language_id.learn(docs), "rules": quality_rules.learn(docs, labels), "urls": url_filter.fit(url_filter.labelled_urls(spark, 600)), "licences": license_scan.fit(spark)}
    for name, model in made.items():
        models.save(spark, model, f"{tmp_path}/{name}")
    back = {name: models.load(spark, f"{tmp_path}/{name}") for name in made}
    assert back["language"].decide(texts)[0] == made["language"].decide(texts)[0] and np.array_equal(back["language"].cells, made["language"].cells)
    assert back["rules"] == made["rules"] and back["urls"] == made["urls"]
    x = np.eye(len(made["licences"].grams))[:40]
    assert np.array_equal(back["licences"].probabilities(x), made["licences"].probabilities(x)) and back["licences"].templates == made["licences"].templates
