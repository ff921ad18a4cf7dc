import base64
import gzip
import struct
import zlib

from pyspark.sql import functions as F

from loomwork.sources import indexed_deflate, readers

# The documents of two sample files.
F1 = ["abc", "xqwerty\nabc\ndef\ndef", "dfsdf", "2389\nsdfjfffk"]
F2 = ["mnbvpoi\nabc\ndef", "asdf", "dsdf", "wefo\ndfj"]


def test_indexed_deflate(spark, tmp_path):
    indexed_deflate.register(spark)
    indexed_deflate.write_indexed_deflate(f"{tmp_path}/f1.pkz", F1)
    indexed_deflate.write_indexed_deflate(f"{tmp_path}/f2.pkz", F2)
    df = spark.read.format("indexed_deflate").option("bytespermap", 25).load(str(tmp_path))
    assert sorted(r.document for r in df.collect()) == sorted(F1 + F2)
    assert df.rdd.getNumPartitions() > 2 and df.where("offset = 0").count() == 2


def test_splits_and_damaged_blocks():
    splits = indexed_deflate.plan_splits("x", [10, 20, 5, 40], 30)
    assert [(s.start, s.sizes) for s in splits] == [(0, [10, 20]), (30, [5, 40])]
    raw = zlib.compress(b"hello " * 500 + bytes(range(256)), 0)
    assert indexed_deflate.inflate(raw[:1000]).startswith("hello hello") and indexed_deflate.inflate(b"junk") == ""


def test_crawl_pages(spark, tmp_path):
    packed = base64.b64encode(zlib.compress(b"<html>x</html>")).decode()
    (tmp_path / "c").write_text(f"5\t{packed}\n6\t{base64.b64encode(b'broken').decode()}\n")
    assert {r.page_id: r.html for r in readers.read_crawl(spark, str(tmp_path / "c")).collect()} == {5: "<html>x</html>", 6: None}


def test_document_stream(spark, tmp_path):
    field = lambda n, s: bytes([n << 3 | 2, len(s)]) + s
    one, two = field(1, b"http://a") + field(3, b"text"), field(1, b"http://b") + field(2, b"body")
    raw = b"".join(struct.pack("<i", len(m)) + m for m in (one, two))
    (tmp_path / "plain").write_bytes(raw)
    (tmp_path / "packed").write_bytes(gzip.compress(raw))
    got = sorted(map(tuple, readers.read_document_stream(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([("http://a", None, "text"), ("http://b", "body", None)] * 2, key=repr)


def test_text_formats(spark, tmp_path):
    put = lambda name, s: (tmp_path / name).write_text(s) and str(tmp_path / name)
    svm = readers.read_svmlight(spark, put("svm", "2 qid:10 1:0.5 3:1 # note\n")).first()
    assert (svm.label, svm.qid, svm.features) == (2.0, 10, {1: 0.5, 3: 1.0})
    assert readers.read_ffm(spark, put("ffm", "1 0:5:1 1:7:0.5\n")).first().nodes[1].j == 7
    assert readers.read_gbdt(spark, put("d", "1 32 91 -10\n")).first()["values"] == [32.0, 91.0, -10.0]
    assert readers.read_gbdt(spark, put("s", "-1 2 9 5\n"), dense=False).first()["indices"] == [2, 9, 5]
    assert readers.read_word_lists(spark, {put("a", "x\ny\n"): 0, put("b", "z\n"): 1}).groupBy("label").count().count() == 2
    tele = readers.read_telemetry(spark, put("t", "1\t94\t3.5\t4\n2\t188\t5\t6\n=== NEXT EPOCH ===\n"))
    assert [r.epoch for r in tele.orderBy("epoch").collect()] == [1, 2]
    state = readers.read_training_state(spark, put("j", '{"elapsed_times":[1,2],"avg_rewards":[3,4],"test_rewards":[5,6]}\n'))
    assert state.where("epoch = 1").first().test_reward == 6.0
    folder = tmp_path / "docs" / "rock"
    folder.mkdir(parents=True)
    (folder / "p").write_text("http://u\n<HTML>B\nC")
    doc = readers.read_document_folder(spark, str(folder)).withColumn("label", readers.path_label("path")).first()
    assert (doc.url, doc.html, doc.label) == ("http://u", "<html>b\nc", "rock")
    vec = readers.read_vector_csv(spark, put("v", 'name,mean\na,"[1.0 2.0\n 3.0]"\n'), ["mean"]).first()
    assert vec["mean"] == [1.0, 2.0, 3.0]
    assert readers.read_queries(spark, put("q", "﻿1\tfoo bar\tbaz\n")).first().query_id == 1
    assert readers.read_candidates(spark, put("cand", "QueryId,DocumentId\n1,5\n1,6\n")).first().docs == [5, 6]
    assert readers.rename_columns(spark.range(1).select(F.col("id").alias("a.b"))).columns == ["a_b"]
    assert readers.read_clicks(spark, put("log", "q\thttp://h/\nbad\n")).count() == 1


def test_streamed_counts(spark, tmp_path):
    from loomwork.streaming.clicks import windowed_host_query_counts

    spark.sql("SELECT timestamp'2020-01-01 00:10:00' AS ts, 'q' AS query, 'http://h/' AS url FROM range(3)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, query string, url string").parquet(f"{tmp_path}/in")
    q = windowed_host_query_counts(stream).writeStream.format("memory").queryName("streamed_counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.host, r["query"], r.cnt) for r in spark.table("streamed_counts").collect()] == [("h", "q", 3)]


def test_positional_tf_files(spark, tmp_path):
    from loomwork.operators.text import corpus_stats, positional_tf
    from loomwork.sources import readers

    docs = spark.createDataFrame([(1, "a b a"), (2, "c")], "doc_id int, text string")
    tf = positional_tf(docs)
    readers.write_positional_tf(tf, f"{tmp_path}/tf")
    assert sorted(map(tuple, readers.read_positional_tf(spark, f"{tmp_path}/tf").collect())) == sorted(map(tuple, tf.collect()))
    assert [r.value.split("\t")[0] for r in spark.read.text(f"{tmp_path}/tf/doc_id=1").collect()] == ["a", "b", "3"]
    readers.write_corpus_stats(corpus_stats(tf), f"{tmp_path}/stats")
    assert sorted(map(tuple, readers.read_corpus_stats(spark, f"{tmp_path}/stats").collect())) == [("a", 1, 2), ("b", 1, 1), ("c", 1, 1)]


def test_wave_files(spark, tmp_path):
    import struct
    import wave

    from loomwork.sources import readers

    (tmp_path / "jazz").mkdir()
    with wave.open(str(tmp_path / "jazz/x.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(4)
        w.writeframes(struct.pack("<12h", *([16384, 0] * 6)))
    r = readers.read_wave(spark, f"{tmp_path}/jazz").first()
    assert (r.label, r.samplerate, r.duration, r.samples) == ("jazz", 4, 1.5, [0.25] * 6)


def test_side_files(spark, tmp_path):
    (tmp_path / "ids").write_text("1\thttp://a\n2\thttp://b\n")
    assert [tuple(r) for r in readers.read_dictionary(spark, str(tmp_path / "ids")).collect()] == [(1, "http://a"), (2, "http://b")]
    ranked = spark.createDataFrame([(2, 7, 1), (1, 9, 2), (1, 8, 1)], "query_id int, doc_id int, rank int")
    readers.write_ranking(ranked, f"{tmp_path}/ranking")
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/ranking", header=True).collect()] == [("1", "8"), ("1", "9"), ("2", "7")]
    pairs = readers.read_candidates(spark, f"{tmp_path}/ranking")
    assert {r.query_id: sorted(r.docs) for r in pairs.collect()} == {1: [8, 9], 2: [7]}
