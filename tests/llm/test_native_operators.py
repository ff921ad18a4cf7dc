"""Quality rules, sharding, URL filter, licence scan, line templates and mixing on small tables, against plain Python."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import license_scan, line_dedup, mixing, quality_rules, queries, sharding, url_filter

from ..conftest import SF
from ..oracle import assert_same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(12_000))
ROWS = [
    (1, "one two three\n\none two three\n#*|", "en", "a", 5), (2, "", "en", "a", 0), (3, None, None, None, None), (4, " \t\n\x0b\f\r ", "de", "b", 7),
    (5, "a b c d e f g h " * 3, "en", "a", 1), (6, LONG, "en", "a", 1), (6, LONG, "en", "a", 1), (None, "x y\u00a0z ê", "fr", None, 2), (8, "same same " * 40, "en", "b", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    extra = {c: F.lit("x") for c in ("size", "pass", "slot", "_h", "_k1", "kept", "n_words", "target", "n_lines")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(extra)


def python_statistics(text):
    text = text or ""
    words, seen, repeated_lines = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated_lines += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated_lines, len(hit)


def test_statistics_match_plain_python(spark, docs):
    got = quality_rules.text_statistics(docs).select("text", *quality_rules.BASE).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert tuple(r[1:]) == python_statistics(r.text)


def test_statistics_of_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = quality_rules.query(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        stats = python_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats
        assert r.base_failed == (stats[0] < 20 or 100 * stats[4] > 30 * stats[0])
        assert not (r.base_failed and r.kept)


def test_learned_rules_keep_clean_documents(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality_rules.learn(docs.where("doc_id % 2 = 0"), labels)
    judged = quality_rules.judge(docs.where("doc_id % 2 = 1"), rules).join(labels, "doc_id").where(~F.col("base_failed")).select("kept", "quality").toPandas()
    assert (judged["kept"] == (judged["quality"] == 1)).mean() > 0.95
    assert judged["kept"][judged["quality"] == 1].mean() > 0.98


def test_covering_finds_a_conjunction():
    rng = np.random.default_rng(0)
    x = {"n_words": rng.random(4000), "mean_word": rng.random(4000)}
    bad = (x["n_words"] > 0.7) & (x["mean_word"] <= 0.4)
    rules = quality_rules.grow_rules(x, bad)
    assert (rules.predict(x) == bad).mean() > 0.99 and "IF " in str(rules)
    assert quality_rules.grow_rules(x, np.zeros(4000, bool)).rules == []


def test_clean_documents_keep_their_columns(docs):
    out = quality_rules.clean_documents(docs, quality_rules.DecisionList())
    assert out.columns == docs.columns and out.where("doc_id = 6").count() == 2
    assert quality_rules.clean_documents(docs.where("false"), quality_rules.DecisionList()).count() == 0


def test_no_labels_gives_an_empty_list(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.learn(spark.createDataFrame(ROWS, SCHEMA), labels).rules == []


def test_lookup_table_is_full_even_and_moves_little():
    names = sharding.shard_names(10)
    table = sharding.lookup_table(names, 1009)
    counts = np.bincount(table)
    assert len(table) == 1009 and counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9) / 1009
    assert moved < 0.25
    weighted = np.bincount(sharding.lookup_table({"a": 1, "b": 3}, 1009))
    assert weighted[1] / weighted[0] == pytest.approx(3, rel=0.02)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_placement_matches_plain_python(spark, docs):
    import hashlib

    table, names = sharding.lookup_table(sharding.shard_names(sharding.SHARDS)), sharding.shard_names(sharding.SHARDS)
    out = sharding.place(docs)
    assert out.columns == [*[c for c in docs.columns if c != "slot"], "slot", "shard"] and out.count() == len(ROWS)
    for r in out.collect():
        at = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert (r.slot, r.shard) == (at, names[table[at]])
    assert sharding.place(docs.where("false")).count() == 0


URLS = {
    "http://A.example.NET/en/x": ("a.example.net", "/en/x", "example.net/en/", "allow"), "https://example.net/de/": ("example.net", "/de/", "net/", "block"),
    "http://x.example.com/de/1?q": ("x.example.com", "/de/1", "example.com/de/", "block"), "http://b.org/fr/#t": ("b.org", "/fr/", "org/fr/", "allow"),
    "http://net": ("net", "", None, None), "http://notnet.internet/": ("notnet.internet", "/", None, None), "nothing here": ("", "", None, None), None: ("", "", None, None),
    "http://h.net?x/y": ("h.net", "", None, None), "a://b.net:80/": ("b.net:80", "/", None, None), "": ("", "", None, None),
}


def test_url_rules(spark):
    model = url_filter.UrlModel(0.0, [], {}, 0.0)
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*URLS, *URLS])], "page_id int, url string, rule string")
    got = url_filter.judge(df, model).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path, rule, verdict = URLS[r.url]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "block")


ENGLISH = "house river stone garden winter market music history science travel kitchen mountain coffee letter window summer bridge story island paper".split()


def other_urls(n, seed):
    """URLs of another making than labelled_urls(): English words, other hosts and patterns."""
    rng = np.random.default_rng(seed)
    w = lambda: ENGLISH[rng.integers(len(ENGLISH))]
    hexes = lambda k: "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, k))
    rows = []
    for i in range(n):
        if i % 2:
            rows.append([
                f"http://{hexes(12)}.{['info', 'top', 'com'][rng.integers(3)]}/{hexes(16)}/{hexes(8)}", f"https://{w()}{rng.integers(100, 9999)}.{['top', 'xyz', 'club'][rng.integers(3)]}/{w()[:1]}/?a={rng.integers(99)}&b={rng.integers(99)}&c={rng.integers(99)}",
                f"http://click.{w()}.{['com', 'info'][rng.integers(2)]}/r?u={hexes(20)}&s={hexes(12)}&t={hexes(9)}&k={hexes(6)}&z={hexes(10)}", f"http://{w()}-{w()}-{w()}-{w()}.{['info', 'xyz', 'top'][rng.integers(3)]}/{w()}-{w()}-{w()}-{w()}-{w()}-{w()}-{rng.integers(1000, 99999)}.html",
            ][rng.integers(4)])
        else:
            rows.append([
                f"https://www.{w()}-{w()}.com/{w()}/{w()}", f"https://news.{w()}.org/{rng.integers(2001, 2025)}/{rng.integers(10, 13)}/{rng.integers(10, 29)}/{w()}-{w()}-{w()}-{w()}", f"https://{w()}{w()}.de/", f"http://{w()}.edu/{w()}/{w()}/{w()}/{w()}.html",
                f"https://{w()}shop.com/item/{rng.integers(1, 99999)}?ref={w()}", f"https://en.{w()}.org/wiki/{w().title()}_{w()}",
            ][rng.integers(6)])
    return [(u, i % 2) for i, u in enumerate(rows)]


@pytest.fixture(scope="module")
def url_model(spark):
    return url_filter.fit(url_filter.labelled_urls(spark))


def test_url_model_on_urls_of_other_making(spark, url_model):
    for rows, least in ((url_filter.labelled_urls(spark, 1000, seed=77).collect(), 0.93), (other_urls(1000, 3), 0.9)):
        judged = url_filter.judge(spark.createDataFrame(rows, "url string, blocked int"), url_model, {}).collect()
        share = np.mean([(r.verdict == "block") == (r.blocked == 1) for r in judged])
        print("share right:", share)
        assert share > least
    probes = {"https://www.merriam-webster.com/dictionary/tree": "allow", "https://news.example.com/2024/05/12/local-school-wins-award": "allow", "http://pills123.top/x/y?z=1&q=2&w=3": "block", "https://docs.some-site.org/guide/getting-started": "allow"}
    got = url_filter.judge(spark.createDataFrame([(u,) for u in probes], "url string"), url_model).collect()
    assert {r.url: r.verdict for r in got} == probes


def python_url(url, suffixes, prior):
    """Host, path and features of a URL."""
    import math

    u = url or ""
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u)
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    digits = lambda x: sum(c in "0123456789" for c in x) / len(x) if x else 0.0
    entropy = lambda x: -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values()) if x else 0.0
    query = u.split("#")[0].split("?", 1)[1] if "?" in u.split("#")[0] else ""
    f = [len(u), len(host), len(path), path.count("/"), digits(u), digits(host), entropy(u), entropy(host), len([p for p in query.split("&") if p]), suffixes.get(host.split(".")[-1], prior)]
    return host, path, f


def test_urls_of_the_whole_table_match_plain_python(spark, url_model):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = url_filter.query(spark, SF).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, f = python_url(urls[r.page_id], url_model.suffixes, url_model.prior)
        score = url_model.predict(np.array([f]))[0]
        fits = [x for x in url_filter.RULES if ("." + host).endswith("." + x.split("/")[0]) and path.startswith("/" + x.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.score == pytest.approx(score)
        assert r.verdict == (url_filter.RULES[rule] if rule else "block" if score >= url_filter.CUT else "allow")


def test_url_features_match_plain_python(spark):
    urls = ["http://a-b.example.com/x1/y22.html?p=1&q=2#f?g&h", "x?y?z&w", "", "http://ÄÖ.de/ß/€#a?b=1&c", "a://" + "b1" * 40_000 + ".org/" + "c/" * 9000, "://n?&&a"]
    df = spark.createDataFrame([(u,) for u in [*urls, None]], "url string").withColumn("host", url_filter.host_of("url")).withColumn("path", url_filter.path_of("url"))
    for r in url_filter.with_features(df, {"com": 0.25}, 0.5).collect():
        assert [r[f] for f in url_filter.FEATURES] == pytest.approx(python_url(r.url, {"com": 0.25}, 0.5)[2])
    odd = spark.createDataFrame([("http://a.com/", 1, 2)], "url string, `a.b` int, f_path int")
    assert url_filter.judge(odd, url_filter.UrlModel(0.0, [], {}, 0.0)).columns == ["url", "a.b", "f_path", "host", "path", "rule", "verdict", "score"]


@pytest.fixture(scope="module")
def licences(spark):
    return license_scan.fit(spark)


def test_licence_paragraphs(spark, licences):
    texts = ["Some prose here.\nReleased under the MIT License.\n\nLicensed under CC BY-NC 4.0.", None, "", "the and of to in is it that on", LONG,
             "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY 4.0.\nLicensed under CC BY 4.0."]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, family string")
    got = {(r.doc_id, r.paragraph): r.family for r in license_scan.scan(df, licences).collect()}
    assert got == {(0, 1): "MIT", (0, 3): "CC-BY-NC", (5, 0): "GPL", (6, 0): "CC-BY", (6, 1): "CC-BY"}
    assert license_scan.scan(df.where("false"), licences).count() == 0


def test_licences_of_the_whole_table(spark, licences):
    notices = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL"}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {(r.doc_id, i): notices[x] for r in docs.collect() for i, x in enumerate((r.text or "").split("\n")) if x in notices}
    got = {(r.doc_id, r.paragraph): r.family for r in license_scan.scan(docs, licences).collect()}
    assert got == want


def python_paragraphs(text):
    """First line's number and joined lines."""
    lines = [x.strip(" \t\n\x0b\x0c\r") for x in (text or "").split("\n")] if text is not None else []
    out, open_ = [], False
    for i, x in enumerate(lines):
        if x and open_:
            out[-1][1].append(x)
        elif x:
            out.append((i, [x]))
        open_ = bool(x) and len(x) <= 120 and x[-1] not in ".!?:;"
    return [(i, " ".join(x)) for i, x in out]


def python_grams(paragraph):
    import struct

    import xxhash

    words = [w for w in re.split(r"[^\w]+|_", paragraph.lower()) if w]
    pair = lambda a, b: xxhash.xxh64_intdigest(struct.pack("<Q", b), seed=xxhash.xxh64_intdigest(struct.pack("<Q", a), seed=42))
    h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]
    two = [pair(a, b) for a, b in zip(h, h[1:], strict=False)]
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    return {signed(v) for v in [*two, *(pair(a, b) for a, b in zip(two, h[2:], strict=False))]}


def python_scan(model, doc_id, text):
    at = {g: i for i, g in enumerate(model.grams)}
    for i, notice in python_paragraphs(text):
        grams = python_grams(notice)
        hits = [at[g] for g in grams if g in at]
        if hits:
            p = model.probabilities(np.bincount(hits, minlength=len(at))[None].astype(float))[0]
            best = int(p[1:].argmax()) + 1
            if p[best] > p[0]:
                name = model.families[best]
                held = max([len(grams & set(g)) / len(g) for f, g, d in model.templates if f == name and d and len(grams & set(d)) / len(d) >= license_scan.DISTINCT], default=0.0)
                yield doc_id, i, name if p[best] >= model.cut and held >= license_scan.CONTAINED else "unknown", name, p[best], held


def test_scan_of_the_whole_table_matches_plain_python(spark, licences):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {x[:2]: x[2:] for d, t in texts for x in python_scan(licences, d, t)}
    rows = license_scan.query(spark, SF).collect()
    assert {(r.doc_id, r.paragraph) for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        family, name, p, held = want[r.doc_id, r.paragraph]
        assert (r.family, r.predicted) == (family, name) and r.probability == pytest.approx(p, abs=1e-5) and r.contained == pytest.approx(held, abs=1e-8)


NOTICES = {
    "MIT": license_scan.TEMPLATES["MIT"][3], "AGPL": license_scan.TEMPLATES["AGPL"][1], "LGPL": license_scan.TEMPLATES["LGPL"][1], "GPL": license_scan.TEMPLATES["GPL"][1], "CC-BY-ND": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA": "Licensed under CC BY-SA 4.0.", "CC-BY-NC-SA": "Licensed under CC BY-NC-SA 4.0.", "CC-BY": "Licensed under CC BY 4.0.", "BSD": license_scan.TEMPLATES["BSD"][0], "ISC": license_scan.TEMPLATES["ISC"][0], "MPL-2.0": license_scan.TEMPLATES["MPL-2.0"][0], "BSD-3-Clause": license_scan.TEMPLATES["BSD-3-Clause"][0],
    "Apache-2.0": " ".join(license_scan.TEMPLATES["Apache-2.0"][1:4]),
}


@pytest.mark.parametrize("width", [40, 72, 10_000])
def test_wrapped_notices_and_like_families(spark, licences, width):
    import textwrap

    rows = [(i, "Some words of prose stand here.\n" + "\n".join(f"{mark}{x}" for x in textwrap.wrap(n, width)) + "\n\nMore prose.", f) for i, (f, n) in enumerate(NOTICES.items()) for mark in ([" * ", "// ", ""][i % 3],)]
    got = {}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id int, text string, want string"), licences).collect():
        if r.family != "unknown":
            got.setdefault(r.want, set()).add(r.family)
    assert got == {f: {f} for f in NOTICES}


def test_other_licences_are_unknown(spark, licences):
    texts = [*license_scan.UNSEEN, "Licensed under the European Union Public Licence, version 1.2.", "This font software is licensed under the SIL Open Font License, Version 1.1."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    assert {r.family for r in license_scan.scan(df, licences).collect()} <= {"unknown"}
    odd = spark.createDataFrame([(None, 1, 2), ("x", 3, 4), ("Released under the MIT License.", 5, 6)], "text string, `a.b` int, _h int")
    got = license_scan.scan(odd, licences)
    assert got.columns[:2] == ["a.b", "_h"] and [(r["a.b"], r.family) for r in got.collect()] == [(5, "MIT")]


def test_unknown_class_for_unconfirmed(spark, licences):
    df = spark.createDataFrame([("according to the MIT license someone wrote",), ("version 2 0 the license you may not",)], "text string")
    assert {r.family for r in license_scan.scan(df, licences).collect()} <= {"unknown"}


@pytest.mark.parametrize("name", ["op8_line_dedup"])
def test_native_queries_match_their_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF.replace("0.001", "0.01"))


def test_recurring_templates(spark):
    rows = [(i, f"unique{'abcdefghij'[i]} words {'xyz' * (i + 1)} here\nPosted on 2020-0{i} by user{i}\n\nShare this page with {'klmnopqrst'[i]}friend today now", "en", "s", 0) for i in range(10)]
    df = spark.createDataFrame(rows + [rows[0], (99, None, "en", "s", 0), (98, "", "en", "s", 0)], SCHEMA).withColumn("_k1", F.lit(1)).withColumn("_gone", F.lit(2))
    out = line_dedup.drop_recurring(df, min_docs=5, similarity=0.6)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    got = {r.doc_id: r for r in out.collect()}
    assert out.where("doc_id = 0").count() == 2
    assert got[3].text == "uniqued words xyzxyzxyzxyz here\n" and (got[3].n_lines, got[3].n_dropped) == (4, 2)
    assert got[99].text is None and got[99].n_lines == 0 and got[98].text == "" and got[98].n_dropped == 0
    assert line_dedup.drop_recurring(df.where("false")).count() == 0


def test_lines_of_one_document_are_no_recurrence(spark):
    names = "alpha beta gamma delta epsilon zeta eta theta".split()
    lines = [f"Add the chopped {x} into the bowl now" for x in names]
    rows = [(1, "\n".join(lines)), (2, "other words"), (3, "\n".join(lines[:2]))]
    rows += [(10 + i, f"Read more about {x} on our page today\nRead more about {x}{x} on our page today") for i, x in enumerate(names[:5])]
    out = line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id int, text string"), min_docs=5, similarity=0.6)
    assert {r.doc_id: r.n_dropped for r in out.collect()} == {1: 0, 2: 0, 3: 0} | {10 + i: 2 for i in range(5)}
    again = spark.createDataFrame(rows[:1] * 5, "doc_id int, text string")
    assert [r.n_dropped for r in line_dedup.drop_recurring(again, min_docs=5).collect()] == [8] * 5


def fill(sizes, weights, epochs=1.5, cap=2):
    target, free = dict.fromkeys(sizes, 0.0), set(sizes)
    left = epochs * sum(sizes.values())
    while free:
        rate = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * rate > cap * sizes[s]}
        if not over:
            return target | {s: weights[s] * rate for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def check_mix(rows, texts):
    sizes = Counter()
    for r in rows:
        assert r.size == len(WORD.findall(texts[r.doc_id][0] or ""))
        assert 0 <= r.taken <= 2 * r.size
        sizes[texts[r.doc_id][1]] += r.size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    taken = Counter()
    for r in rows:
        s = texts[r.doc_id][1]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= mixing.BLOCK_TOKENS


def test_mix_of_the_whole_table(spark):
    texts = {r.doc_id: (r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first = mixing.query(spark, SF).collect()
    check_mix(first, texts)
    assert sorted(map(tuple, first)) == sorted(map(tuple, mixing.query(spark, SF).collect()))


def test_mix_with_nulls_hot_source_and_repeats(spark):
    rows = [(i, " ".join(["w"] * (i % 90)), None, [None, "a", "a", "a", "ä", "b"][i % 6], 0) for i in range(300)] + [(500, None, None, "z", 0), (501, "", None, "z", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    check_mix(mixing.report(df).collect(), {r[0]: (r[1], r[3]) for r in rows})
    assert mixing.report(df.union(df)).count() == 2 * len(rows)
    assert mixing.report(df.where("false")).count() == 0 and mixing.mixed_documents(df.where("false")).count() == 0


def test_mixed_rows_hold_what_is_taken(spark):
    rows = [(i, f"a{i}  b{i}\n" + "w " * (i % 150), "en", "abc"[i % 3], 9) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pass", F.lit("x")).withColumn("size", F.lit("y"))
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert (r["pass"], r["size"]) == ("x", "y")
        assert r.text == rows[r.doc_id][1] or r.n_chars == len(r.text)
    assert {k: v for k, v in got.items() if v} == {r.doc_id: r.taken for r in mixing.report(df).collect() if r.taken}


def test_schedule_spreads_sources_evenly(spark):
    docs = spark.createDataFrame([(i, "w " * 100, "en", "ab"[i % 2], 0) for i in range(400)], SCHEMA)
    _, planned, _ = mixing.mix(docs)
    slots = mixing.schedule(planned).orderBy("slot").toPandas()
    share = (slots["_sid"] == 0).mean()
    running = np.abs(np.cumsum(slots["_sid"] == 0) - share * (np.arange(len(slots)) + 1))
    assert running.max() < 5


def test_long_passages_recur_from_two_documents_on(spark):
    words = lambda tag, n: [f"{tag}{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}" for i in range(n)]
    passage = words("p", 51)
    other = passage[:20] + ["changed"] + passage[21:]
    rows = [(1, "own one\n" + " ".join(passage)), (2, " ".join(other) + "\nown two"), (3, " ".join(words("q", 60))), (4, " ".join(words("r", 50))), (5, " ".join(words("r", 50))), (6, "\t ".join(passage) + "\n" + "lonely " * 20_000)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert {k: v[:2] for k, v in got.items()} == {1: (2, 1), 2: (2, 1), 3: (1, 0), 4: (1, 0), 5: (1, 0), 6: (2, 1)}
    assert got[1][2] == "own one" and got[2][2] == "own two" and got[3][2] == rows[2][1] and got[6][2] == "lonely " * 20_000


def test_learned_list_does_not_depend_on_order(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    first = quality_rules.learn(docs, labels)
    assert first.rules and str(quality_rules.learn(docs.repartition(7, "text").orderBy(F.desc("doc_id")), labels.repartition(5, F.rand(3)))) == str(first)
    # kept is the list applied in Python.
    frame = quality_rules.judge(docs, first).select(*(F.expr(e).cast("double").alias(f) for f, e in quality_rules.FEATURES.items()), "base_failed", "kept").toPandas()
    drops = first.predict({f: frame[f].to_numpy() for f in quality_rules.FEATURES})
    assert (frame["kept"] == ~(frame["base_failed"] | drops)).all()
    assert len(quality_rules.learn(docs, labels, train_rows=1).rules) == 0


def test_statistics_keep_columns_with_odd_names(spark):
    df = spark.createDataFrame([("a b", 1, 2)], "text string, `a.b` int, _w int")
    assert quality_rules.text_statistics(df).columns == ["text", "a.b", "_w", *quality_rules.BASE, "n_upper"]


def plain_fill(names, size):
    """The table by whole preference orders: shards in turn take the first slot of theirs that is free."""
    import hashlib

    number = lambda name, seed: int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:16], 16)
    orders = [[(number(n, "offset") + k * (number(n, "stride") % (size - 1) + 1)) % size for k in range(size)] for n in names]
    table = {}
    while len(table) < size:
        for i, order in enumerate(orders):
            free = next((s for s in order if s not in table), None)
            if free is not None:
                table[free] = i
    return [table[s] for s in range(size)]


@pytest.mark.parametrize(("shards", "size"), [(1, 2), (3, 7), (7, 101), (16, 499)])
def test_table_is_filled_by_turns(shards, size):
    names = sharding.shard_names(shards)
    assert sharding.lookup_table(names, size) == plain_fill(names, size)


def test_operators_keep_columns_with_odd_names(spark):
    df = spark.createDataFrame([(1, "a b", "s", 2, "x" * 400_000), (None, "c " * 70_000, None, 3, "y")], "doc_id long, text string, source string, `a.b` int, slot string")
    placed = sharding.place(df)
    assert placed.columns == ["doc_id", "text", "source", "a.b", "slot", "shard"] and placed.count() == 2
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and {r["a.b"] for r in mixed.collect()} == {2, 3}
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == pytest.approx(1.5 * 70_002, abs=300)
    dropped = line_dedup.drop_recurring(df)
    assert dropped.columns == [*df.columns, "n_lines", "n_dropped"]
