"""Language identification, WARC archives, decontamination and the Jaccard join on small tables, against plain Python."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from loomwork.llm import components, decontaminate, jaccard_join, language_id, queries, tokens, warc

from ..conftest import SF
from ..oracle import assert_same

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", ["op2_warc", "op7_benchmark_decontamination", "op9_ngram_jaccard_join"])
def test_queries_match_their_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def test_words_match_a_regular_expression():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "B", " ", "\n", "é", "Ж", "1", "-", "\x0b", "\u00a0"]) for _ in range(rng.randrange(60))) for _ in range(300)] + ["", "x" * (tokens.SEGMENT + 5), ("ab " * tokens.SEGMENT)[: tokens.SEGMENT + 999]]
    for table, pattern in ((tokens.space_table(), r"[^\x20\x09-\x0D]+"), (tokens.alnum_table(), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = {}
        for first, end, data, offsets in tokens.slices(pa.array(texts)):
            w = tokens.Words(data, offsets, table)
            bounds = w.bounds()
            for row in range(end - first):
                lower = re.sub("[A-Z]+", lambda m: m[0].lower(), texts[first + row])
                assert [x.decode() for x in w.text(bounds[row], bounds[row + 1])] == re.findall(pattern, lower)
                for x, h in zip(re.findall(pattern, lower), w.hash[bounds[row] : bounds[row + 1]].tolist(), strict=True):
                    assert seen.setdefault(x, h) == h
        assert len(set(seen.values())) == len(seen)


def test_language_of_held_out_documents(spark):
    sf = SF.replace("0.001", "0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = language_id.query(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    train = spark.createDataFrame([(i, ["the cat and the dog sat", "der hund und die katze"][i % 2], ["en", "de"][i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    model = language_id.learn(train.union(spark.createDataFrame([(90, None, "en"), (91, "xx", None)], train.schema)))
    rows = [(1, None, "z"), (2, "", "z"), (3, "123 !?", "z"), (4, "THE cat", "z"), (5, "und die", "z"), (6, "жжж", "z"), (None, "the dog " * 50_000, "z")]
    got = language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert [(r.lang_pred, r.score == 0) for r in got] == [("und", True)] * 3 + [("en", False), ("de", False), ("en", True), ("en", False)]
    assert language_id.predict(train.where("false"), model).count() == 0
    assert language_id.report(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first().lang_pred == "und"


def test_filter_masks_hold_every_learned_language():
    rng = np.random.default_rng(1)
    grams = [rng.integers(0, 1 << 63, 500).astype(np.uint64) for _ in range(12)]
    f = language_id.LanguageFilter.build([f"l{i}" for i in range(12)], grams, 0)
    for i, g in enumerate(grams):
        assert ((f.masks(g) >> np.uint16(i)) & np.uint16(1)).all()
    other = f.masks(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    rate = np.array([((other >> np.uint16(i)) & np.uint16(1)).mean() for i in range(12)])
    assert np.allclose(rate, f.false_positive, atol=0.01)


PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark):
    big = "é<p>" * 400
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "u", "s"), (4, "u", "s"), (5, "u", None), (6, "u", ""), (7, "u", "x" * 1000), (8, "u", "x" * 999), (9, "u", "x" * 999), (10, "u", big), (10, "u", big), (11, "u", "r" * 300_000)]
    rows += [(100 + i, "u", f"<html>{i} {'body ' * i}</html>") for i in range(80)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("key", F.lit(1)).withColumn("digest", F.lit("x"))
    manifest = warc.archive_pages(pages)
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows) and all(r.error is None for r in got)
    want = sorted((k, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h == big and k != 10 else "response", 10 if h == big and k != 10 else None) for k, _, h in rows)
    assert sorted((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    html = {k: (h or "").encode() for k, _, h in rows}
    assert all(bytes(r.payload) == html[r.record_id] for r in got if r.record_type == "response")
    folder = manifest.first().archive.rsplit("/", 1)[0]
    assert warc.list_archives(spark, folder).count() == warc.find_archives(spark, folder).count() == manifest.count()
    assert warc.report(pages.where("false")).count() == 0


def archive(*records, dictionary=b""):
    made = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor()
    return struct.pack("<II", warc.SKIPPABLE_MAGIC, len(dictionary)) + dictionary + b"".join(map(made.compress, records))


def read(raw, strict=False):
    import io

    return list(warc.read_archive(io.BytesIO(raw), strict))


def test_archive_validation():
    digest = hashlib.sha1(b"hello").digest()
    good = warc.record_bytes(5, "http://u", b"hello", digest)
    assert read(archive(good))[0]["payload"] == b"hello"
    faults = {b"WARC/1.1": b"WARX/1.1", b"WARC-Date": b"WARC-Dat", b"Content-Length: 5": b"Content-Length: 6", b"hello": b"jello", b"urn:record:5": b"urn:other:5"}
    for old, new in faults.items():
        bad = good.replace(old, new)
        assert [r["error"] is None for r in read(archive(good, bad, good))] == [True, False, True], (old, new)
        with pytest.raises(ValueError):
            read(archive(bad), strict=True)
    cut = archive(good, good)[:-7]
    assert [r["error"] is None for r in read(cut)] == [True, False]
    assert read(b"")[0]["error"] and read(zstandard.compress(good))[0]["error"]


def test_archive_dictionaries():
    samples = [warc.record_bytes(i, "http://u", b"<p>common words of pages</p>" * 3 + str(i).encode(), hashlib.sha1(b"<p>common words of pages</p>" * 3 + str(i).encode()).digest()) for i in range(200)]
    d = warc.train_dictionary(samples, 4096)
    assert d and len(archive(*samples, dictionary=d)) < len(archive(*samples)) + len(d)
    assert all(r["error"] is None for r in read(archive(*samples, dictionary=d)))
    packed = zstandard.compress(d)
    body = archive(*samples, dictionary=d)[8 + len(d) :]
    assert all(r["error"] is None for r in read(struct.pack("<II", warc.SKIPPABLE_MAGIC, len(packed)) + packed + body))


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (3, None), (4, "..."), (10, "alpha BETA gamma delta epsilon zeta eta theta iota kappa"), (2, "short item")]


def python_hits(text, items, n=10):
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, named = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - n + 1)) if v else []:
            g = v[i : i + n]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    hit |= set(range(j, j + len(g)))
                    named.add(str(item))
    return len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 20])
def test_decontamination_matches_plain_python(spark, block_words):
    rows = [(1, "x " + ITEMS[0][1].upper() + ", y"), (2, "a short-item, and Short\nITEM."), (3, None), (4, ""), (5, "!!"), (6, "clean text only " * 20_000), (6, "again short item"), (None, "beta " + ITEMS[0][1]), (8, "shortitem")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("_spans", F.lit(1))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.report(docs, bench, block_words=block_words).collect()), key=repr)
    assert got == sorted(((d, *python_hits(t, ITEMS)) for d, t in rows), key=repr)
    assert decontaminate.report(docs.where("false"), bench).count() == 0
    assert decontaminate.report(docs, bench.where("false")).where("contaminated").count() == 0


def test_decontamination_removes_spans_or_documents(spark):
    rows = [(1, "Keep this, " + ITEMS[0][1] + "! And this."), (2, "clean"), (3, None)]
    docs, bench = spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("x")), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()} == {1: "Keep this, ! And this.", 2: "clean", 3: None}
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {2, 3}


def python_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows))


def near_copies(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(rng.choice([5, 7, 8, 12, 30, 80, 200, 500]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        kind = rng.random()
        if kind < 0.5:
            for _ in range(rng.randrange(1 + max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word()
        elif kind < 0.65:
            w = [word() for _ in range(rng.randrange(1, 60))] + passage
        elif kind < 0.75:
            w = w[: rng.randrange(1, len(w) + 1)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_all_pairs(spark, seed):
    rows = near_copies(seed, 220) + [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one TWO"), (905, "one two three")]
    got = sorted(map(tuple, jaccard_join.components(spark.createDataFrame(rows, DOCS)).collect()))
    assert got == python_components(rows)


def test_components_with_long_texts_repeats_and_clashing_columns(spark):
    long = " ".join(f"w{i * i}" for i in range(30_000))
    rows = [(5, long), (3, long + " end"), (3, long + " end"), (7, "other " + long[:60_000]), (8, "a b c d e f")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("k1", "cells", "component_id", "count", "a.b", "_row")})
    assert sorted(map(tuple, jaccard_join.components(docs).select("doc_id", "component_id").collect())) == [(3, 3), (3, 3), (5, 3), (7, 7), (8, 8)]
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]
    assert jaccard_join.components(docs.where("false")).count() == 0


def shared_rarest(a, b, rare):
    """Whether two sets keep a common cell where counts order cells in any way."""
    sides = [jaccard_join.cells_of(x) for x in (a, b)]
    every = np.unique(np.concatenate([cells for cells, _ in sides]))
    count = dict(zip(every.tolist(), rare(len(every)).tolist(), strict=True))
    kept = []
    for cells, allow in sides:
        own = set()
        for bit in (0, 1):
            mine = sorted((c for c in cells.tolist() if c & 1 == bit), key=lambda c: (count[c], c))
            own |= set(mine[: max(0, len(mine) + allow[bit])] if mine else ())
        kept.append(own)
    return bool(kept[0] & kept[1])


def test_linked_sets_share_a_cell_and_pass_the_sketch():
    rng = np.random.default_rng(5)
    for size in [3, 4, 5, 7, 11, 15, 16, 17, 40, 63, 64, 200, 255, 256, 900, 1023, 1024, 1500, 4095, 5000]:
        for _ in range(15):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            gone = int(rng.integers(0, len(a) // 4 + 1))
            most_new = (len(a) - gone) * 4 // 3 - len(a)
            b = np.unique(np.concatenate((a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, most_new + 1)))).astype(np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (len(a) + len(b) - both):
                continue
            for rare in (np.arange, rng.permutation):
                assert shared_rarest(a, b, rare)
            distance = int(np.bitwise_count((jaccard_join.sketch_of(a) ^ jaccard_join.sketch_of(b)).view(np.uint64)).sum())
            assert distance <= len(a) + len(b) - 2 * both <= (len(a) + len(b)) / 7
            wide = [jaccard_join.wide_sketch_of(x) for x in (a, b)]
            if all(x is not None for x in wide):
                m = min(map(len, wide))
                one, two = (np.bitwise_xor.reduce(x.reshape(-1, m), axis=0) for x in wide)
                assert int(np.bitwise_count((one ^ two).view(np.uint64)).sum()) <= len(a) + len(b) - 2 * both


def test_connected_components(spark, tmp_path):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7)] + [(500, 500 + k) for k in range(1, 60)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), f"{tmp_path}/cc").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[300] == got[200] == 100 and got[559] == 500


def test_more_than_64_languages_are_told_apart(spark):
    words = [f"{a}{b}{a}{c}" for a in "bcdfg" for b in "aeiou" for c in "klm"][:70]
    rows = [(10 * i + k, " ".join([w] * (6 + k)), f"x{i:02}") for i, w in enumerate(words) for k in range(2)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 70
    names, scores = model.decide([f"{w} {w} {w}" for w in words])
    assert names == [f"x{i:02}" for i in range(70)] and scores.min() > 0.5


@pytest.mark.parametrize("block_words", [1_000_000, 8])
def test_items_without_an_id_are_found(spark, block_words):
    passage, other, named = (" ".join(f"{x}{i}" for i in range(12)) for x in ("no", "un", "id"))
    items = spark.createDataFrame([(None, passage), (None, other), (7, named)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {passage} it"), (2, f"{passage} and {other} and {named}"), (3, named), (4, "clean")], DOCS)
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(docs, items, block_words=block_words).collect()}
    none, seven = decontaminate.items_digest([]), decontaminate.items_digest(["7"])
    assert got == {1: (12, 1, none, True), 2: (36, 2, seven, True), 3: (12, 1, seven, True), 4: (0, 0, none, False)}
    assert [r.doc_id for r in decontaminate.clean_documents(docs, items, block_words=block_words).collect()] == [4]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_rows_without_an_id_link_others(spark, order):
    text, other = (" ".join(f"{x}{i}" for i in range(40)) for x in "wv")
    rows, bridge = [(None, text), (1, text), (2, text + " more")], [(None, other), (4, "x y z " + other), (5, other + " a b c")]
    every = [x[i] for x in (rows, bridge) for i in order] + [(None, "alone and without an id")]
    got = sorted(map(tuple, jaccard_join.components(spark.createDataFrame(every, DOCS).repartition(1)).collect()), key=repr)
    assert got == sorted(python_components_with_nulls(every), key=repr)


def python_components_with_nulls(rows):
    numbered = python_components([(i, t) for i, (_, t) in enumerate(rows)])
    groups = {}
    for i, _, c in numbered:
        if rows[i][0] is not None:
            groups[c] = min(groups.get(c, rows[i][0]), rows[i][0])
    return [(rows[i][0], n, groups.get(c)) for i, n, c in numbered]


def test_documents_that_share_a_passage_make_no_pairs(spark):
    import time

    passage = " ".join(f"c{i}" for i in range(40))
    took = []
    for n in (2_000, 20_000):
        rows = [(i, passage + " " + " ".join(f"w{i}x{k}" for k in range(40))) for i in range(n)] + [(n, passage + " " + " ".join(f"w7x{k}" for k in range(38)))]
        began = time.time()
        got = {r.doc_id: r.component_id for r in jaccard_join.components(spark.createDataFrame(rows, DOCS)).collect()}
        took.append(time.time() - began)
        assert got[n] == 7 and sum(d == c for d, c in got.items()) == n
    assert took[1] < 4 * took[0] + 10


def exact_decision(text, sets, rates, usual):
    """The decision by plain sets of n-grams: as the filter without false positives, and how far the second is behind."""
    grams = [g for g in (lambda s: [s[i : i + 3] for i in range(len(s) - 2)])("".join(c if c.isalpha() else " " for c in f" {text.lower()} ")) if g[1] != " "]
    hits = sorted(((sum(g in s for g in grams) / max(1, len(grams)), x) for x, s in sets.items()), key=lambda t: (-t[0], t[1]))
    if not grams:
        return "und", 1.0
    return (hits[0][1] if hits[0][0] else usual), (hits[0][0] - hits[1][0] if hits[0][0] else 1.0)


def test_decisions_match_exact_sets(spark):
    sf = SF.replace("0.001", "0.01")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = table.withColumn("held", language_id.held_out()).collect()
    model = language_id.learn(table.where(~language_id.held_out()))
    counts = {}
    for r in rows:
        if not r.held and r.lang and r.text:
            s = "".join(c if c.isalpha() else " " for c in f" {r.text.lower()} ")
            counts.setdefault(r.lang, {})
            for i in range(len(s) - 2):
                if s[i + 1] != " ":
                    counts[r.lang][s[i : i + 3]] = counts[r.lang].get(s[i : i + 3], 0) + 1
    total = {x: sum(c.values()) for x, c in counts.items()}
    share = {x: {g: n / total[x] for g, n in c.items() if n >= max(2.0, total[x] * language_id.MIN_SHARE)} for x, c in counts.items()}
    best = {}
    for c in share.values():
        for g, v in c.items():
            best[g] = max(best.get(g, 0), v)
    sets = {x: {g for g, v in c.items() if v >= language_id.MIN_RATIO * best[g]} for x, c in share.items()}
    assert sorted(sets) == model.languages
    names, _ = model.decide([r.text or "" for r in rows])
    for r, got in zip(rows, names, strict=True):
        want, margin = exact_decision(r.text or "", sets, model.false_positive, model.languages[model.usual])
        assert got == want or margin < 0.02, (r.doc_id, got, want, margin)


def test_slices_of_a_text_are_its_grams():
    rng = random.Random(2)
    text = "".join(rng.choice("abcÄßжİ漢 \t.1") for _ in range(3000))
    for size in (1, 2, 7, 100, 5000):
        assert np.array_equal(np.concatenate(list(language_id.slices(text, size))), language_id.text_grams([text])[0])
    assert list(language_id.slices("")) == []


def test_prediction_keeps_columns_with_odd_names(spark):
    model = language_id.learn(spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(9)], "doc_id long, text string, lang string"))
    df = spark.createDataFrame([("漢" * 3_000_000, 1, 2), ("the cat", 3, 4), ("the cat", 3, 4)], "text string, _found int, `a.b` int")
    out = language_id.predict(df, model)
    assert out.columns == ["text", "_found", "a.b", "lang_pred", "score"] and sorted(r._found for r in out.collect()) == [1, 3, 3]


def test_a_block_of_items_takes_about_60_bytes_a_word():
    rng = np.random.default_rng(0)
    items = [(str(i), " ".join(f"w{x}ord" for x in rng.integers(0, 50_000, 500))) for i in range(100)]
    s = decontaminate.NgramSet(items, 10)
    held = s.data.nbytes + s.start.nbytes + s.end.nbytes + s.row.nbytes + sum(x.nbytes for w in s.windows.values() for x in w)
    assert held < 60 * 50_000


def test_clean_documents_keep_columns_with_odd_names(spark):
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta y", ["mine"], 5), (2, "z", ["mine"], 6)], "doc_id long, text string, _items array<string>, `a.b` int")
    clean = decontaminate.clean_documents(docs, items)
    assert clean.columns == docs.columns and [tuple(r) for r in clean.collect()] == [(2, "z", ["mine"], 6)]
    assert sorted(r.text for r in decontaminate.remove_spans(docs, items).collect()) == ["x  y", "z"]


def test_a_pair_of_many_buckets_is_made_once(spark):
    """Two classes of 50 common buckets make one row, and lists with nothing in common still let a pair meet."""
    words = [0] * jaccard_join.SKETCH_WORDS
    own = {1: list(range(60)), 2: list(range(10, 70)), 3: [5, 69]}
    lists = {1: list(range(10, 18)), 2: list(range(10, 18)), 3: [5, 69]}
    rows = [(c, k, k, 100, *words, lists[k]) for k, cells in own.items() for c in cells]
    kinds = ", ".join(f"s{i} long" for i in range(len(words)))
    rest = spark.createDataFrame(rows, f"cell long, k1 long, c long, n long, {kinds}, list array<long>")
    assert sorted(map(tuple, jaccard_join._across(rest).collect())) == [(1, 2), (1, 3), (2, 3)]


def test_few_texts_without_a_class_are_dealt_out(spark, tmp_path):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("tag"), "id")
    for n in (0, 1, 300):
        kept = {r.id for r in jaccard_join._may_be_among(rows, rows.where(f"id < {n}").select("tag"), "tag", f"file://{tmp_path}/{n}").collect()}
        assert kept >= set(range(n)) and len(kept) <= n + 0.15 * 20_000


def test_buckets_of_the_same_classes_are_kept_once(spark, tmp_path, monkeypatch):
    """Two classes that share all their cells are in one bucket, and the link is found."""
    stored = {}
    keep = jaccard_join.common.stored
    monkeypatch.setattr(jaccard_join.common, "stored", lambda df, path: stored.setdefault(path.rsplit("/", 1)[-1], keep(df, path)))
    text = [f"w{i}" for i in range(600)]
    docs = [(1, " ".join(text)), (2, " ".join([*text[:-3], "a", "b", "c"])), (3, "nothing like the others at all here")]
    _, linked = jaccard_join.linked_classes(spark.createDataFrame(docs, DOCS))
    assert linked.count() == 2 and linked.select("component").distinct().count() == 1
    assert stored["live"].count() == 2 and stored["buckets"].first().cells > 50
