"""Queries of click features, statistics, clustering, trees and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features as fx
from ..operators import cluster, ctr, kernels, ltr, models, stats, tree
from ..sources.readers import rename_columns
from ..storage import work_path
from .book import Book, Tables

FIELDS = ["l_returnflag", "l_linestatus", "l_quantity", "l_suppkey"]
UNPIVOT = " UNION ALL ".join(f"SELECT l_orderkey AS k, '{f}' AS field, coalesce(CAST({f} AS VARCHAR), '') AS value, CAST(l_discount > 0.05 AS INT) AS y FROM lineitem" for f in ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"])
CLICK_FIELDS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]
HASH_SQL = "CAST(((((CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT) % 999999 * (4294967296 % 999999) + CAST(('0x' || substr(md5({0}), 9, 8)) AS BIGINT)) % 999999 * (4294967296 % 999999) + CAST(('0x' || substr(md5({0}), 17, 8)) AS BIGINT)) % 999999 * (4294967296 % 999999) + CAST(('0x' || substr(md5({0}), 25, 8)) AS BIGINT)) % 999999) + 1 AS BIGINT)"
CENTERS = "c AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INT) AS cluster, embedding AS center FROM embeddings WHERE vec_id < 5)"
DIST = "list_sum(list_transform(list_zip({0}, {1}), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"
NEAR = f"near AS (SELECT vec_id, embedding, label, arg_min(cluster, (d, cluster)) AS cluster, sqrt(min(d)) AS distance FROM (SELECT e.*, c.cluster, {DIST.format('e.embedding', 'c.center')} AS d FROM embeddings e, c) GROUP BY ALL)"


def clicks(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("y", F.when(F.col("l_discount") > 0.05, 1).otherwise(0))


def centers(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id < 5").select(F.col("vec_id").cast("int").alias("cluster"), F.transform("embedding", lambda x: x.cast("double")).alias("center"))


def near(t: Tables) -> DataFrame:
    found = cluster.nearest_centroid(t.embeddings, centers(t), "vec_id", "embedding")
    return found.join(t.embeddings.select("vec_id", "label"), "vec_id")


def judged(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").withColumn("p", F.lit(0.05) + 0.9 * (F.col("n_chars") % 97) / 97)


JUDGED = "j AS (SELECT *, 0.05 + 0.9 * (n_chars % 97) / 97 AS p FROM documents JOIN labels USING (doc_id))"


def judged_lists(t: Tables) -> DataFrame:
    """Documents of a source and tens of ids as candidates of one query."""
    upper = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    lists = F.concat_ws("-", "source", F.floor(F.col("doc_id") / 10).cast("string"))
    return t.documents.join(t.labels, "doc_id").select(lists.alias("qid"), F.col("doc_id").alias("doc"), (F.col("quality") + F.col("toxic")).cast("double").alias("rel"), F.col("n_chars").cast("double").alias("score0"), (upper / F.greatest("n_chars", F.lit(1))).alias("upper"))


def ffm_rows(lineitem: DataFrame, *twin: str) -> DataFrame:
    node = lambda f, j: F.struct(F.lit(f).cast("int").alias("f"), j.cast("int").alias("j"), F.lit(1.0).alias("v"))
    return lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber", *twin).alias("id"), F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("y"),
        F.array(node(0, F.col("l_linenumber")), node(1, 100 + F.col("l_suppkey") % 10), node(2, 200 + F.col("l_quantity").cast("int") % 10)).alias("nodes"))


def numbered_lines(t: Tables) -> DataFrame:
    """lineitem with numbers of lines that tell apart rows of the same order and line."""
    twins = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*t.lineitem.columns)
    return t.lineitem.withColumn("_twin", F.row_number().over(twins))


def ffm_weights(t: Tables) -> DataFrame:
    ids = t.spark.range(300).select(F.col("id").cast("int").alias("j"))
    return ids.crossJoin(t.spark.range(3).select(F.col("id").cast("int").alias("f"))).select("j", "f", F.array(*((F.pmod(F.col("j") * 7 + F.col("f") * 3 + k, F.lit(11)) / 10.0) for k in range(4))).alias("w"))


def register(book: Book) -> None:
    _clicks(book)
    _stats(book)
    _clusters(book)
    _trees(book)
    _models(book)


def _clicks(book: Book) -> None:
    book.add("a14_value_counts", lambda t: ctr.value_counts(t.lineitem, CLICK_FIELDS), f"SELECT field, value, count(*) AS n FROM ({UNPIVOT}) GROUP BY ALL")
    book.add("a13_value_counts_by_label", lambda t: ctr.value_counts_by_label(clicks(t), CLICK_FIELDS, "y"),
             f"SELECT field, value, CAST(sum(1 - y) AS BIGINT) AS neg, CAST(sum(y) AS BIGINT) AS pos, count(*) AS total, round(sum(y) / count(*), 5) AS ratio FROM ({UNPIVOT}) GROUP BY field, value HAVING count(*) >= 10")
    book.add("f9_popularity_bands", lambda t: ctr.popularity_bands(ctr.value_counts(t.events, ["user_id", "event_type"]), 40, 100),
             "SELECT field, value, n, CASE WHEN n >= 100 THEN 'popular' WHEN n >= 40 THEN 'basic' ELSE 'rare' END AS band FROM (SELECT 'user_id' AS field, CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'event_type', event_type, count(*) FROM events GROUP BY ALL)")
    book.add("f10_excluded_values", lambda t: ctr.popularity_bands(ctr.value_counts(t.events, ["event_type"]), excluded=("event_type=click",)),
             "SELECT 'event_type' AS field, event_type AS value, count(*) AS n, CASE WHEN count(*) >= 60 THEN 'popular' WHEN count(*) >= 7 THEN 'basic' ELSE 'rare' END AS band FROM events WHERE event_type <> 'click' GROUP BY event_type")
    book.add("a15_missing_counts", lambda t: ctr.missing_counts(t.events, "event_id", ["user_id", "event_type"], ctr.popularity_bands(ctr.value_counts(t.events, ["user_id", "event_type"]), 60, 100)),
             "SELECT event_id, CAST((count(*) OVER (PARTITION BY user_id) < 60)::INT + (count(*) OVER (PARTITION BY event_type) < 60)::INT AS BIGINT) AS missing FROM events")
    book.add("e18_log_bin", lambda t: t.part.select("p_partkey", fx.log_bin("p_size").alias("bin")), "SELECT p_partkey, CASE WHEN p_size > 2 THEN CAST(CAST(floor(pow(ln(p_size), 2)) AS BIGINT) AS VARCHAR) ELSE 'SP' || p_size END AS bin FROM part")
    book.add("e19_hash_bucket", lambda t: t.part.select("p_partkey", fx.hash_bucket("p_name").alias("bucket")), f"SELECT p_partkey, {HASH_SQL.format('p_name')} AS bucket FROM part")
    book.add("e20_group_buckets", lambda t: t.orders.select("o_orderkey", F.array(*((F.col("o_orderkey") * k + k) % 60 for k in (1, 3, 7, 11))).alias("v")).select("o_orderkey", *(c.alias(f"b{i}") for i, c in enumerate(fx.bucket_groups("v", [list(range(s, s + 10)) for s in range(0, 50, 10)])))),
             "WITH v AS (SELECT o_orderkey, list_transform([1, 3, 7, 11], lambda k: (o_orderkey * k + k) % 60) AS v FROM orders) SELECT o_orderkey, " + ", ".join(f"array_to_string(list_sort(list_transform(list_filter(v, lambda x: x BETWEEN {s} AND {s + 9}), lambda x: CAST(x AS VARCHAR))), ',') AS b{i}" for i, s in enumerate(range(0, 60, 10))) + " FROM v")
    book.add("e20_crc32", lambda t: t.orders.select("o_orderkey", fx.crc32_text("o_orderpriority").alias("crc")))
    book.add("e21_soft_log_bins", lambda t: _soft_bins(t),
             "WITH x AS (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) % 100 AS v, s FROM customer, (VALUES (0), (3)) z(s)), y AS (SELECT *, v + s AS x, 1.4 * ln(1 + greatest(v + s, 0)) AS y FROM x) SELECT c_custkey, s AS shift, CASE WHEN x < 0 THEN 'NA' WHEN x = 0 THEN '0' ELSE CAST(CAST(floor(y) AS BIGINT) AS VARCHAR) END AS low, CASE WHEN x > 0 THEN round(1 - (y - floor(y)), 4) END AS low_weight, CASE WHEN x > 0 THEN CAST(floor(y) AS BIGINT) + 1 END AS up, CASE WHEN x > 0 THEN round(y - floor(y), 4) END AS up_weight FROM y")
    book.add("e22_rare_replace", lambda t: t.orders.join(t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey").select("o_orderkey", fx.rare_replace("o_custkey", "n", "C1", 12).alias("v")),
             "SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey) >= 12 THEN CAST(o_custkey AS VARCHAR) ELSE 'C1less' END AS v FROM orders")
    book.add("e23_ffm_features", lambda t: t.orders.select("o_orderkey", fx.ffm_features({"0": "o_orderstatus", "1": "o_orderpriority"}).alias("line")),
             f"SELECT o_orderkey, '0:' || {HASH_SQL.format(chr(39) + '0-' + chr(39) + ' || o_orderstatus')} || ':1 1:' || {HASH_SQL.format(chr(39) + '1-' + chr(39) + ' || o_orderpriority')} || ':1' AS line FROM orders")
    book.add("e24_request_key", lambda t: t.orders.select("o_orderkey", fx.request_key("o_orderstatus", "o_custkey").alias("k")), "SELECT o_orderkey, coalesce(o_orderstatus, '') || '-' || coalesce(CAST(o_custkey AS VARCHAR), '') AS k FROM orders")
    book.add("a15_vw_lines", lambda t: clicks(t).select("l_orderkey", "l_linenumber", ctr.vw_line("y", {"a": ["l_returnflag", "l_linestatus"], "b": ["l_suppkey"]}).alias("line")),
             "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN '1' ELSE '-1' END || ' |a l_returnflag-' || l_returnflag || ' l_linestatus-' || l_linestatus || ' |b l_suppkey-' || l_suppkey AS line FROM lineitem")
    book.add("s20_gbdt_lines", lambda t: clicks(t).select("l_orderkey", "l_linenumber", ctr.dense_gbdt_line("y", ["l_linenumber", "l_suppkey"]).alias("dense"), ctr.sparse_gbdt_line("y", [("l_returnflag", "A"), ("l_returnflag", "N"), ("l_linestatus", "O")]).alias("sparse")),
             "SELECT l_orderkey, l_linenumber, s || ' ' || l_linenumber || ' ' || l_suppkey AS dense, s || ' ' || array_to_string(list_filter([CASE WHEN l_returnflag = 'A' THEN '1' END, CASE WHEN l_returnflag = 'N' THEN '2' END, CASE WHEN l_linestatus = 'O' THEN '3' END], lambda x: x IS NOT NULL), ' ') AS sparse FROM (SELECT *, CASE WHEN l_discount > 0.05 THEN '1' ELSE '-1' END AS s FROM lineitem)")
    book.add("j12_blend", lambda t: ctr.blend(t.customer.select(F.col("c_custkey").alias("id"), fx.sigmoid(F.col("c_acctbal") / 1e4).alias("click")), t.customer.select(F.col("c_custkey").alias("id"), fx.sigmoid(-F.col("c_acctbal") / 1e4).alias("click"))).select("id", F.round("click", 6).alias("click")),
             "SELECT c_custkey AS id, round(0.7 / (1 + exp(-c_acctbal / 1e4)) + 0.3 / (1 + exp(c_acctbal / 1e4)), 6) AS click FROM customer")
    book.add("g8_ffm_score", lambda t: ctr.ffm_score(ffm_rows(numbered_lines(t), "_twin"), ffm_weights(t)).select("id", F.round("p", 6).alias("p")),
             """WITH r AS (SELECT l_orderkey || '-' || l_linenumber || '-' || row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS id,
               [CAST(l_linenumber AS BIGINT), 100 + l_suppkey % 10, 200 + CAST(l_quantity AS BIGINT) % 10] AS j FROM lineitem),
             s AS (SELECT id, sum(list_sum([((j[a] * 7 + (b - 1) * 3 + k) % 11) / 10.0 * (((j[b] * 7 + (a - 1) * 3 + k) % 11) / 10.0) for k in [0, 1, 2, 3]])) / 3 AS t FROM r, (VALUES (1, 2), (1, 3), (2, 3)) x(a, b) GROUP BY id)
             SELECT id, round(1 / (1 + exp(-t)), 6) AS p FROM s""")  # fmt: skip
    book.add("e31_quadratic_pairs", lambda t: t.nation.select("n_nationkey", F.array_join(fx.quadratic_pairs(F.filter(F.split("n_name", ""), lambda x: x != "")), " ").alias("pairs")).select("n_nationkey", F.md5("pairs").alias("pairs")),
             "WITH s AS (SELECT n_nationkey, string_split(n_name, '') AS v FROM nation) SELECT n_nationkey, md5(array_to_string(flatten(list_transform(range(1, len(v) + 1), lambda i: list_transform(range(i + 1, len(v) + 1), lambda j: v[i] || '*' || v[j]))), ' ')) AS pairs FROM s")
    book.add("e28_levenshtein_kernel", lambda t: t.nation.select(F.col("n_name").alias("a")).crossJoin(t.nation.select(F.col("n_name").alias("b"))).select("a", "b", F.round(fx.rbf_levenshtein("a", "b"), 6).alias("k")),
             "SELECT a.n_name AS a, b.n_name AS b, round(exp(-0.1 * pow(levenshtein(a.n_name, b.n_name), 2)), 6) AS k FROM nation a, nation b")
    book.add("q16_split_by_time", lambda t: ctr.train_test_split_at(t.orders, "o_orderkey", 500).groupBy("part").agg(F.count("*").alias("n")), "SELECT CASE WHEN o_orderkey < 500 THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM orders GROUP BY 1")
    book.add("t6_hash_shuffle", lambda t: ctr.shuffle_by_hash(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey"), "SELECT o_orderkey, o_custkey FROM orders")
    book.add("j12_row_numbers", lambda t: ctr.row_numbers(t.nation.select("n_name"), "n_name"), "SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS row FROM nation")


def _soft_bins(t: Tables) -> DataFrame:
    value = F.floor(F.col("c_acctbal")) % 100
    rows = t.customer.select("c_custkey", F.explode(F.array(*(F.struct(F.lit(s).alias("shift"), fx.soft_log_bins(value, s).alias("b")) for s in (0, 3)))).alias("x")).select("c_custkey", "x.shift", F.split("x.b", "[ :]").alias("p"))
    number = lambda i, kind: F.get("p", F.lit(i)).cast(kind)
    return rows.select("c_custkey", "shift", F.get("p", F.lit(0)).alias("low"), number(1, "double").alias("low_weight"), number(2, "long").alias("up"), number(3, "double").alias("up_weight"))


def _stats(book: Book) -> None:
    book.add("a17_zscore", lambda t: stats.zscore(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", F.round("z_c_acctbal", 6).alias("z")), "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) + 0.0 AS z FROM customer")
    book.add("a18_group_profile", lambda t: stats.group_profile(t.customer, "c_mktsegment", ["c_acctbal", "c_nationkey"]).select("c_mktsegment", "n", F.round("mean_c_acctbal", 6).alias("b"), F.round("mean_c_nationkey", 6).alias("k")),
             "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS b, round(avg(c_nationkey), 6) AS k FROM customer GROUP BY 1")
    book.add("a16_value_counts_nunique", lambda t: t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("nunique"), F.round(F.avg("o_totalprice"), 4).alias("mean")),
             "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS nunique, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
    book.add("a19_vector_statistics", lambda t: stats.vector_statistics(t.embeddings, "vec_id", "embedding").select("vec_id", *(F.round(c, 5).alias(f"v_{c}") for c in ("mean", "std", "max", "min", "diff_mean", "diff_std"))),
             "WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings), d AS (SELECT *, x - lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM v) SELECT vec_id, round(avg(x), 5) + 0.0 AS v_mean, round(stddev_pop(x), 5) AS v_std, round(max(x), 5) AS v_max, round(min(x), 5) AS v_min, round(avg(d), 5) + 0.0 AS v_diff_mean, round(stddev_pop(d), 5) AS v_diff_std FROM d GROUP BY vec_id")
    book.add("a20_group_vector_profile", lambda t: stats.group_vector_profile(t.embeddings, "label", "embedding").select("label", F.col("i").cast("long").alias("i"), F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std")),
             "SELECT label, i - 1 AS i, round(avg(x), 5) + 0.0 AS mean, round(stddev_pop(x), 5) AS std FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) GROUP BY ALL")
    book.add("a21_row_mean_pivot", lambda t: stats.row_mean_pivot(t.lineitem, "l_suppkey", "l_returnflag", ["l_quantity", "l_linenumber"], ["A", "N", "R"]).select("l_suppkey", *(F.round(c, 5).alias(c) for c in "ANR")),
             "SELECT l_suppkey, " + ", ".join(f"round(coalesce(avg(CASE WHEN l_returnflag = '{c}' THEN (l_quantity + l_linenumber) / 2 END), 0), 5) AS \"{c}\"" for c in "ANR") + " FROM lineitem GROUP BY 1")
    book.add("a23_logloss", lambda t: stats.logloss(judged(t), "quality", "p").select(F.round("logloss", 6).alias("logloss")), f"WITH {JUDGED} SELECT round(avg(-ln(CASE WHEN quality > 0 THEN p ELSE 1 - p END)), 6) AS logloss FROM j")
    book.add("a24_confusion", lambda t: stats.confusion(near(t), "label", "cluster").select("y", "yhat", "n", F.round("share", 6).alias("share")),
             f"WITH {CENTERS}, {NEAR} SELECT label AS y, cluster AS yhat, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM near GROUP BY label, cluster")
    book.add("a24_accuracy", lambda t: stats.accuracy(t.labels, "quality", "toxic").select(F.round("accuracy", 6).alias("accuracy")), "SELECT round(avg((quality = toxic)::INT), 6) AS accuracy FROM labels")
    probs = lambda t: t.embeddings.select("vec_id", "label", F.slice("embedding", 1, 10).alias("p"))
    book.add("a25_topk_hit_rate", lambda t: stats.topk_hit_rate(probs(t), "label", "p").select(F.round("hit_rate", 6).alias("hit_rate")),
             "SELECT round(avg((len(list_filter(generate_series(1, 10), lambda i: embedding[i] > embedding[label + 1] OR (embedding[i] = embedding[label + 1] AND i < label + 1))) < 3)::INT), 6) AS hit_rate FROM embeddings")
    book.add("t8_top_classes", lambda t: probs(t).select("vec_id", stats.top_classes("p", [f"g{i}" for i in range(10)]).alias("top")),
             "SELECT vec_id, string_agg('g' || (i - 1), ' > ' ORDER BY x DESC, i) AS top FROM (SELECT vec_id, unnest(embedding[1:10]) AS x, unnest(generate_series(1, 10)) AS i FROM embeddings QUALIFY true) WHERE true GROUP BY vec_id".replace(" QUALIFY true", "").replace("FROM (SELECT", "FROM (SELECT * FROM (SELECT").replace("FROM embeddings) WHERE true", "FROM embeddings) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) <= 3)"))
    book.add("a26_roc_auc", lambda t: stats.roc_auc(judged(t), "quality", "n_chars").select(F.round("auc", 6).alias("auc")),
             f"WITH {JUDGED}, r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM j) SELECT round((sum(r) FILTER (WHERE quality = 1) - sum(quality) * (sum(quality) + 1) / 2) / (sum(quality) * (count(*) - sum(quality))), 6) AS auc FROM r")
    book.add("a27_adjusted_rand", lambda t: stats.adjusted_rand(near(t), "label", "cluster").select(F.round("ari", 6).alias("ari")),
             f"WITH {CENTERS}, {NEAR}, k AS (SELECT label, cluster, count(*)::DOUBLE AS n FROM near GROUP BY ALL), x AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM k) AS rc, (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM k GROUP BY label)) AS ra, (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM k GROUP BY cluster)) AS rb, (SELECT sum(n) * (sum(n) - 1) / 2 FROM k) AS a) SELECT round((rc - ra * rb / a) / ((ra + rb) / 2 - ra * rb / a), 6) AS ari FROM x")
    book.add("a28_silhouette", lambda t: stats.silhouette(t.embeddings.where("vec_id % 50 = 0"), t.embeddings, "vec_id", "embedding", "label").select(F.round("silhouette", 5).alias("silhouette")),
             f"WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), m AS (SELECT a.vec_id, a.label AS la, b.label AS lb, avg(sqrt({DIST.format('a.embedding', 'b.embedding')})) AS d FROM q a, embeddings b GROUP BY ALL), s AS (SELECT vec_id, max(CASE WHEN la = lb THEN d END) AS a, min(CASE WHEN la <> lb THEN d END) AS b FROM m GROUP BY vec_id) SELECT round(avg((b - a) / greatest(a, b)), 5) AS silhouette FROM s")
    book.add("a30_mae", lambda t: stats.mae(judged(t), "quality", "p").select(F.round("mae", 6).alias("mae")), f"WITH {JUDGED} SELECT round(avg(abs(quality - p)), 6) AS mae FROM j")
    book.add("a31_trailing_mean", lambda t: stats.telemetry_trailing_mean(t.events, "event_id", "value").select("event_id", F.round("trailing_mean", 5).alias("trailing_mean")),
             "SELECT event_id, round(m, 5) AS trailing_mean FROM (SELECT event_id, avg(value) OVER w AS m, row_number() OVER (ORDER BY event_id) AS r FROM events WINDOW w AS (ORDER BY event_id ROWS 99 PRECEDING)) WHERE r % 100 = 0")
    book.add("w1_adjacent_differences", lambda t: stats.adjacent_differences(t.events, "user_id", "event_id", "value").select("event_id", F.round("diff", 6).alias("diff")), "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) + 0.0 AS diff FROM events")
    book.add("w4_step_decay", lambda t: t.part.select("p_partkey", F.round(stats.step_decay("p_size", 0.5, 10), 6).alias("rate")), "SELECT p_partkey, round(pow(0.5, floor(p_size / 10)), 6) AS rate FROM part")
    book.add("w5_best_so_far", lambda t: stats.best_so_far(t.events, "user_id", "event_id", "value").select("event_id", "best"), "SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM events")
    book.add("e30_label_encode", lambda t: stats.label_encode(t.part.select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "code"), "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
    book.add("e26_one_hot", lambda t: stats.one_hot(t.lineitem, "l_orderkey", "l_returnflag", ["A", "N", "R"]).groupBy("l_orderkey").agg(*(F.sum(f"l_returnflag_{c}").alias(c) for c in "ANR")),
             "SELECT l_orderkey, " + ", ".join(f"CAST(sum((l_returnflag = '{c}')::INT) AS BIGINT) AS \"{c}\"" for c in "ANR") + " FROM lineitem GROUP BY 1")
    book.add("f11_dropna_filter", lambda t: t.orders.na.drop().drop("o_totalprice").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O'")
    book.add("f13_binarize", lambda t: t.part.select("p_partkey", F.when(F.col("p_size") > 5, 1).otherwise(-1).alias("y")), "SELECT p_partkey, CASE WHEN p_size > 5 THEN 1 ELSE -1 END AS y FROM part")
    book.add("f12_drop_leading_rows", lambda t: ctr.row_numbers(t.customer.select("c_custkey"), "c_custkey").where("row >= 100"), "SELECT * FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS row FROM customer) WHERE row >= 100")


    book.add("w2_class_borders", lambda t: stats.class_borders(t.documents.join(t.labels, "doc_id"), "n_chars", "quality"),
             "SELECT (x + px) / 2 AS threshold FROM (SELECT n_chars::DOUBLE AS x, quality AS y, lag(n_chars) OVER w AS px, lag(quality) OVER w AS py FROM documents JOIN labels USING (doc_id) WINDOW w AS (ORDER BY n_chars, quality)) WHERE y <> py")
    book.add("t5_count_listing", lambda t: ctr.value_counts(t.events, ["event_type"]).orderBy(F.desc("n"), "value"), "SELECT 'event_type' AS field, event_type AS value, count(*) AS n FROM events GROUP BY event_type")
    book.add("t7_sample", lambda t: stats.sample_rows(t.orders.select("o_orderkey"), "o_orderkey", 0.2))
    book.add("t9_elite", lambda t: stats.elite(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 10), "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
    book.add("e32_crop_windows", lambda t: t.embeddings.select("vec_id", F.size(stats.crop_windows("embedding", 4, 8)).cast("long").alias("n")), "SELECT vec_id, CAST(2 AS BIGINT) AS n FROM embeddings")
    book.add("f14_renamed_columns", lambda t: rename_columns(t.nation.select(F.col("n_nationkey").alias("n.key"), F.col("n_name").alias("n.name"))), "SELECT n_nationkey AS n_key, n_name FROM nation")


def _clusters(book: Book) -> None:
    book.add("j14_nearest_centroid", lambda t: near(t).select("vec_id", "cluster", F.round("distance", 5).alias("distance")), f"WITH {CENTERS}, {NEAR} SELECT vec_id, cluster, round(distance, 5) AS distance FROM near")
    book.add("g10_kmeans_step", lambda t: cluster.kmeans_step(t.embeddings, centers(t), "vec_id", "embedding").select("cluster", F.posexplode("center").alias("i", "x")).select("cluster", F.col("i").cast("long").alias("i"), F.round("x", 5).alias("x")),
             f"WITH {CENTERS}, {NEAR} SELECT cluster, i - 1 AS i, round(avg(x), 5) + 0.0 AS x FROM (SELECT cluster, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS i FROM near) GROUP BY ALL")
    book.add("j15_distance_matrix", lambda t: cluster.distances(t.embeddings.where("vec_id % 50 = 0"), t.embeddings, "vec_id", "embedding").select("a", "b", F.round("distance", 5).alias("distance")),
             f"SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt({DIST.format('a.embedding', 'b.embedding')}), 5) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id")
    book.add("g10_kmeans", lambda t: cluster.kmeans(t.embeddings, 5, "vec_id", "embedding", iterations=5))
    book.add("g10_mini_batch_kmeans", lambda t: cluster.mini_batch_kmeans(t.embeddings, centers(t), "vec_id", "embedding", batches=2))
    book.add("g11_agglomerative", lambda t: cluster.agglomerative(t.embeddings, "label", "vec_id", "embedding"))


def _trees(book: Book) -> None:
    for criterion in ("gini", "entropy", "misclass"):
        f = {"gini": "1 - {a}*{a} - {b}*{b}", "entropy": "-(CASE WHEN {a} > 0 THEN {a} * log2({a}) ELSE 0 END) - (CASE WHEN {b} > 0 THEN {b} * log2({b}) ELSE 0 END)", "misclass": "1 - greatest({a}, {b})"}[criterion]
        left, right = (f.format(a=f"({s}1 / ({s}0 + {s}1))", b=f"({s}0 / ({s}0 + {s}1))") for s in "lr")
        book.add(
            f"a22_split_{criterion}",
            lambda t, criterion=criterion: tree.split_scores(t.documents.join(t.labels, "doc_id"), "n_chars", "quality", [0, 1], criterion, 5).select("threshold", F.round("impurity", 6).alias("impurity")),
            f"""WITH v AS (SELECT n_chars::DOUBLE AS x, sum(1 - quality)::DOUBLE AS c0, sum(quality)::DOUBLE AS c1 FROM documents JOIN labels USING (doc_id) GROUP BY 1),
            s AS (SELECT x, lead(x) OVER w AS nx, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1, sum(c0) OVER () - sum(c0) OVER w AS r0, sum(c1) OVER () - sum(c1) OVER w AS r1 FROM v WINDOW w AS (ORDER BY x))
            SELECT (x + nx) / 2 AS threshold, round((({left}) * (l0 + l1) + ({right}) * (r0 + r1)) / (l0 + l1 + r0 + r1), 6) AS impurity FROM s WHERE nx IS NOT NULL AND l0 + l1 >= 5 AND r0 + r1 >= 5""",
        )
    book.add("g12_best_split", lambda t: tree.best_split(t.documents.join(t.labels, "doc_id"), "n_chars", "quality", [0, 1], "gini", 5).select("threshold", F.round("impurity", 6).alias("impurity")),
             """WITH v AS (SELECT n_chars::DOUBLE AS x, sum(1 - quality)::DOUBLE AS c0, sum(quality)::DOUBLE AS c1 FROM documents JOIN labels USING (doc_id) GROUP BY 1),
             s AS (SELECT x, lead(x) OVER w AS nx, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1, sum(c0) OVER () - sum(c0) OVER w AS r0, sum(c1) OVER () - sum(c1) OVER w AS r1 FROM v WINDOW w AS (ORDER BY x)),
             i AS (SELECT (x + nx) / 2 AS threshold, ((1 - (l0 * l0 + l1 * l1) / ((l0 + l1) * (l0 + l1))) * (l0 + l1) + (1 - (r0 * r0 + r1 * r1) / ((r0 + r1) * (r0 + r1))) * (r0 + r1)) / (l0 + l1 + r0 + r1) AS impurity FROM s WHERE nx IS NOT NULL AND l0 + l1 >= 5 AND r0 + r1 >= 5)
             SELECT threshold, round(impurity, 6) AS impurity FROM i ORDER BY round(impurity, 12), threshold LIMIT 1""")  # fmt: skip
    book.add("g12_decision_tree", lambda t: _tree_rows(t))
    book.add("g16_stump", lambda t: tree.stump(t.lineitem.select((F.col("l_quantity") / 50).alias("x"), F.when(F.col("l_extendedprice") > 40000, 1).otherwise(0).alias("y")), "x", "y").select(F.round("threshold", 6).alias("threshold"), F.round("error", 6).alias("error")),
             "WITH e AS (SELECT i, avg(((l_quantity / 50 > i / 10.0 + 1e-9) <> (l_extendedprice > 40000))::INT) AS e FROM lineitem, generate_series(0, 10) g(i) GROUP BY i) SELECT round(i / 10.0, 6) AS threshold, round(e, 6) AS error FROM e ORDER BY round(e, 12), i LIMIT 1")


def _tree_rows(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id").withColumn("upper", F.size(F.split("text", "[A-Z]")) / F.greatest("n_chars", F.lit(1)))
    nodes = tree.grow_tree(rows, ["n_chars", "upper"], "quality", [0, 1], max_depth=2, min_samples=5)
    return rows.select("doc_id", "quality", tree.tree_column(nodes, [0, 1]).alias("pred"))


def _models(book: Book) -> None:
    book.add("g7_gbt_leaves", lambda t: models.gbt_leaves(clicks(t).select("l_orderkey", "l_quantity", "l_extendedprice", "y"), ["l_quantity", "l_extendedprice"], "y", trees=5, depth=3))
    book.add("g8_train_ffm", lambda t: models.train_ffm(ffm_rows(t.lineitem), "y", "nodes", epochs=1))
    book.add("s22_saved_trees", _saved_trees, "SELECT count(*) AS n, count(*) AS same FROM lineitem")
    book.add("s22_saved_weights", _saved_weights, "SELECT count(*) AS n, count(*) AS same FROM lineitem")
    book.add("s22_saved_tree", _saved_tree, "SELECT count(*) AS n, count(*) AS same FROM documents JOIN labels USING (doc_id)")
    book.add("g9_hashed_logistic", lambda t: models.hashed_logistic(clicks(t).select("l_orderkey", "l_returnflag", "l_suppkey", "y"), ["l_returnflag", "l_suppkey"], "y", bits=12))
    book.add("g13_l1_logistic", lambda t: models.l1_logistic(clicks(t).select("l_orderkey", "l_quantity", "l_extendedprice", "y"), ["l_quantity", "l_extendedprice"], "y"))
    book.add("g14_svm_grid", lambda t: models.svm_grid(t.embeddings.select("embedding", F.when(F.col("label") < 5, 1).otherwise(0).alias("y")), "embedding", "y", (0.1, 1.0), folds=2))
    book.add("g14_kernel_grid", lambda t: kernels.grid(t.embeddings.select("embedding", F.when(F.col("label") < 5, 1).otherwise(0).alias("y")), "embedding", "y", c_values=(1.0,), folds=2, most=300))
    book.add("g6_boosted_ranking", lambda t: ltr.boost(judged_lists(t), ["score0", "upper"], rounds=2, depth=2)[0].select("qid", "doc", F.round("score", 6).alias("score")))
    book.add("g17_es_step", lambda t: stats.es_update(t.embeddings, "label", "embedding").select(F.col("i").cast("long").alias("i"), F.round("step", 6).alias("step")),
             "WITH m AS (SELECT avg(label) AS m, stddev_pop(label) AS s, count(*) AS n FROM embeddings), l AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings) SELECT i - 1 AS i, round(0.1 * sum((label - m) / s * x) / max(n), 6) + 0.0 AS step FROM l, m GROUP BY i")
    book.add("e27_learned_vocabulary", lambda t: models.vocabulary(t.documents, 50), r"""SELECT word, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(text, '\p{L}+'))) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 50""")
    book.add("g15_pca", lambda t: models.principal_components(t.embeddings, "vec_id", "embedding"))
    book.add("g15_lda", lambda t: models.lda_predict(t.embeddings, "vec_id", "embedding", "label"))


def _saved_trees(t: Tables) -> DataFrame:
    """How many rows a model and its saved copy judge, and how many alike."""
    rows, path = clicks(t).select("l_quantity", "l_extendedprice", "y"), work_path(t.spark, "trees")
    model = models.gbt_model(rows, ["l_quantity", "l_extendedprice"], "y", trees=3, depth=3)
    models.save_pipeline(model, path)
    both = models.with_leaves(models.with_leaves(rows, model).withColumnsRenamed({"leaves": "l", "p": "q"}), models.load_pipeline(path))
    return both.agg(F.count("*").alias("n"), F.count_if((F.col("l") == F.col("leaves")) & (F.col("p") == F.col("q"))).alias("same"))


def _saved_weights(t: Tables) -> DataFrame:
    rows, path = ffm_rows(numbered_lines(t), "_twin"), work_path(t.spark, "weights")
    weights = models.train_ffm(rows, "y", "nodes", epochs=1)
    models.save_ffm(weights, path)
    one, two = (ctr.ffm_score(rows, w) for w in (weights, models.load_ffm(t.spark, path)))
    return one.join(two.withColumnRenamed("p", "q"), "id").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("p") - F.col("q")) < 1e-12).alias("same"))


def _saved_tree(t: Tables) -> DataFrame:
    rows, path = t.documents.join(t.labels, "doc_id"), work_path(t.spark, "tree")
    nodes = tree.grow_tree(rows, ["n_chars"], "quality", [0, 1], max_depth=2, min_samples=5)
    tree.save_tree(t.spark, nodes, path)
    one, two = (tree.tree_column(x, [0, 1]) for x in (nodes, tree.load_tree(t.spark, path)))
    return rows.agg(F.count("*").alias("n"), F.count_if(one.eqNullSafe(two)).alias("same"))
