import json
import sqlite3
import zipfile

from biblioflow.sources import files, services
from biblioflow.sources.library import aliases, deep_merge, snapshot
from biblioflow.sources.sqlite import intact, read_table
from biblioflow.streaming import deliveries
from pyspark.sql import functions as F


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "m.db")
    with sqlite3.connect(path) as db:
        db.execute("create table books (id integer primary key, title text, series_index real)")
        db.executemany("insert into books values (?, ?, ?)", [(1, "A", 1.0), (2, None, None), (5, "C", 2.5)])
    df = read_table(spark, path, "books")
    assert sorted(map(tuple, df.collect()), key=lambda r: r[0]) == [(1, "A", 1.0), (2, None, None), (5, "C", 2.5)]
    assert intact(path) and intact(snapshot(path, str(tmp_path / "s"), keep=1))


def test_files(spark, tmp_path):
    good, bad, pdf = tmp_path / "a.epub", tmp_path / "b.epub", tmp_path / "c.pdf"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("META-INF/container.xml", "x")
        z.writestr("t.xhtml", "y" * 500)
        z.writestr("p.jpg", "z")
    bad.write_bytes(b"no zip")
    pdf.write_bytes(b"%PDF-1.4 cut")
    assert files.probe(str(good))[:4] == (True, 1, 1, 500)
    rows = [(1, str(good), "EPUB"), (2, str(bad), "EPUB"), (3, str(pdf), "PDF"), (4, str(tmp_path / "no"), "PDF")]
    df = spark.createDataFrame(rows, "book_id long, path string, fmt string")
    assert {r["book_id"]: r["problem"] for r in files.checked(df, deep=True).collect()} == {2: "no archive", 3: "cut off", 4: "missing"}
    assert files.probed(df.where("book_id = 1")).first()["text_bytes"] == 500


def test_services(spark):
    xml = '<package xmlns:dc="d" xmlns:opf="o"><dc:title>T</dc:title><dc:creator opf:role="aut">A</dc:creator><dc:creator opf:role="ill">B</dc:creator><dc:identifier opf:scheme="ISBN">1</dc:identifier><dc:identifier opf:scheme="uuid">2</dc:identifier><meta name="x:series" content="S"/><meta name="x:series_index" content="2"/></package>'
    got = services.read_package(xml)
    assert (got["title"], got["authors"], got["identifiers"], got["series"], got["series_index"]) == ("T", ["A"], {"isbn": "1"}, "S", 2.0)
    assert services.read_package("<broken")["title"] is None
    inner = json.dumps({"hits": [{"document": {"id": "1", "title": "T", "isbns": ["123", "9780000000000"], "author_names": ["A"], "series_names": ["S"]}}]})
    df = spark.createDataFrame([("q", json.dumps({"data": {"search": {"results": inner}}}))], "query string, body string")
    r = services.book_hits(df).first()
    assert (r["title"], r["isbn"], r["series"], r["position"]) == ("T", "9780000000000", "S", None)
    s = spark.createDataFrame([("q", json.dumps({"results": [{"hit_title": "T", "record": {"series_id": 3, "title": "T", "type": "Manhwa"}}]}))], "query string, body string")
    assert services.series_hits(s).first()["medium"] == "comic"
    o = spark.createDataFrame([("x", ""), ("", "HTTP 429"), ("", "nothing")], "a string, b string").select(services.outcome(F.col("a"), F.col("b")))
    assert [x[0] for x in o.collect()] == ["MATCH", "ERROR", "NO_MATCH"]


def test_settings():
    assert deep_merge({"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}, "d": 2}
    assert aliases({"authors": {"x": "Y"}})["authors"] == {"x": "Y"}


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 10:00:00' as received_at, 'web' as channel").write.parquet(src)
    stream = spark.readStream.schema("received_at timestamp, channel string").parquet(src)
    q = deliveries(stream).writeStream.outputMode("complete").format("memory").queryName("d").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("d").first()["records"] == 1
