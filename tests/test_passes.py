from biblioflow.operators.changes import changes, compare_and_set, merged_identifiers, not_reached, operations, undo_operations
from biblioflow.operators.linkage import author_suggestions
from biblioflow.plans.cleaning import authors_pass, consensus_tags, publishers_pass, tags_pass
from biblioflow.plans.run import chosen, offline, verified
from biblioflow.plans.series import first_come, gap_report, series_pass
from pyspark.sql import functions as F

SCHEMA = "id long, path string, has_cover boolean, title string, authors array<string>, author_sorts map<string,string>, author_sort string, tags array<string>, series string, series_index double, publisher string, identifiers map<string,string>, languages array<string>, comments string, pubdate string, formats array<struct<fmt:string,name:string,size:bigint>>, booktype string, metadata_status string"


def books(spark, rows):
    base = dict.fromkeys([f.split(" ")[0] for f in SCHEMA.split(", ")])
    full = [{**base, "id": i, "authors": [], "tags": [], "series_index": 1.0, "languages": [], "identifiers": {}, "title": "", "author_sort": "", "author_sorts": {}, **r} for i, r in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(r[k] for k in base) for r in full], SCHEMA)


LIBRARY = [
    {"title": "Sea Song, Vol. 1", "authors": ["Ada Moor"], "publisher": "Moor House", "tags": ["Fiction / Sea"], "author_sorts": {"Ada Moor": "Moor, Ada"}},
    {"title": "Sea Song Volume 2: Dawn", "authors": ["Moor, Ada"], "publisher": "Moor House, LLC", "tags": ["sea", "Fiction"]},
    {"title": "Sea Song 4 [Scans][0EDF6669]", "authors": ["ADA MOOR"], "publisher": "Moor House", "tags": ["ebook", "Sea"]},
    {"title": "Level 99", "authors": ["Ben Lark; Cy Fen"], "tags": ["sci-fi"]},
    {"title": "Stone Tale, Vol. 5", "authors": ["Di Holm"]},
    {"title": "Stone Tale, vol 5", "authors": ["Di Holm"]},
]


def test_gaps(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 2.1), ("A", 5.0), ("B", None), ("B", 3.0), ("C", 1.0), ("C", 2.0), (None, 9.0)], "series string, series_index double")
    got = {r["series"]: r["missing"] for r in gap_report(df).collect()}
    assert got == {"A": [3, 4], "B": [2]}


def test_passes(spark):
    b = books(spark, LIBRARY)
    t = {r["id"]: r["tags"] for r in tags_pass(b).books.collect()}
    assert t[1] == ["Fiction", "Sea"] and t[3] == ["Sea"] and t[4] == ["Science Fiction"]
    assert {r["publisher"] for r in publishers_pass(b).books.where("publisher is not null").collect()} == {"Moor House"}
    a = {r["id"]: r["authors"] for r in authors_pass(b).books.collect()}
    assert a[2] == ["Ada Moor"] and a[3] == ["Ada Moor"] and a[4] == ["Ben Lark", "Cy Fen"]
    result = series_pass(b)
    s = {r["id"]: (r["series"], r["series_index"]) for r in result.books.collect()}
    assert s[1] == ("Sea Song", 1.0) and s[2] == ("Sea Song", 2.0) and s[3] == ("Sea Song", 4.0) and s[5][0] is None and s[6][0] is None
    review = {(r[0], r[1]) for r in result.review.collect()}
    assert {("collision-duplicate", 5), ("collision-duplicate", 6)} <= review


def test_offline_is_idempotent(spark):
    b = books(spark, LIBRARY)
    once, log = offline(b)
    assert log.count() > 0 and verified(b, once)
    twice, more = offline(once)
    assert more.collect() == [] and verified(once, twice)


def test_write_and_undo(spark):
    b = books(spark, LIBRARY)
    after = b.withColumn("publisher", F.lit("New"))
    ops = operations(changes(b, after, ["publisher"], "p"))
    live = b.where("id != 2").select(F.col("id").alias("book_id"), F.create_map(F.lit("publisher"), F.when(F.col("id") == 3, "Else").otherwise(F.coalesce("publisher", F.lit("")))).alias("state"))
    j = compare_and_set(ops, live)
    status = {r["book_id"]: r["status"] for r in j.collect()}
    assert status[2] == "missing" and status[3] == "skipped" and status[1] == "applied"
    journal = j.select(F.col("book_id").alias("seq"), "book_id", "status", F.col("expect").alias("before"), F.col("fields").alias("after"))
    undo = undo_operations(journal)
    now = live.select("book_id", F.create_map(F.lit("publisher"), F.lit("New")).alias("state"))
    assert {r["status"] for r in compare_and_set(undo.select("book_id", "fields", "expect", "strict"), now).collect()} == {"applied"}
    assert {r["fields"]["publisher"] for r in undo.where("book_id = 1").collect()} == {"Moor House"}
    assert [r["book_id"] for r in not_reached(ops, j.where("status != 'missing'")).collect()] == [2]
    assert chosen(["titles", "tags"]) == ["tags", "titles"] and chosen(["offline"], ["tags"])[0] == "publishers"


def test_consensus_identifiers_slots(spark):
    b = books(spark, [{"series": "S", "tags": ["Sea", "x"]}, {"series": "S", "tags": ["sea"]}, {"series": "S", "tags": []}])
    assert [(r["folded"], r["tag"]) for r in consensus_tags(b).collect()] == [("sea", "Sea")]
    df = spark.createDataFrame([({"ISBN": "1"}, {"isbn": "2", "x": "3"})], "a map<string,string>, b map<string,string>")
    assert df.select(merged_identifiers(F.col("a"), F.col("b"))).first()[0] == {"ISBN": "1", "x": "3"}
    hits = spark.createDataFrame([(1, "S", "s", 2.0), (2, "S", "s", 2.0), (3, "S", "s", 1.0)], "book_id long, series string, key string, index double")
    taken = spark.createDataFrame([("s", 1.0)], "key string, index double")
    assert {r["book_id"]: r["outcome"] for r in first_come(hits, taken).collect()} == {1: "assigned", 2: "lost", 3: "taken"}


def test_suggestions(spark):
    n = spark.createDataFrame([("Ao Jyuumonji",), ("Ao Jumonji",), ("Moor Ada",), ("Ada Moor",), ("Hajime Tanaka",), ("Hajime Kanzaka",), ("Rosalind Fenwick",), ("Rosalind Fenwyck",)], "name string")
    got = {(r["name_a"], r["name_b"]): r["reason"] for r in author_suggestions(n).collect()}
    assert got[("Ada Moor", "Moor Ada")] == "order of words" and got[("Ao Jumonji", "Ao Jyuumonji")] == "romanisation" and got[("Rosalind Fenwick", "Rosalind Fenwyck")] == "spelling"
    assert ("Hajime Kanzaka", "Hajime Tanaka") not in got


def test_empty(spark):
    b = books(spark, [])
    assert tags_pass(b).books.count() == 0 and authors_pass(b).books.count() == 0


def test_guard_partial_retry_journal(spark, tmp_path):
    from biblioflow.operators.changes import guarded, kept, with_retries
    from biblioflow.sources import journal

    b = books(spark, [{"title": "Sea", "authors": ["Ada Moor"], "path": "ADA MOOR/Sea (1)"}, {"title": "Loom", "authors": ["Ben Lark"], "path": "Ben Lark/Loom (2)"}, {"title": "Dawn", "authors": ["Cy Fen"], "path": "x"}])
    op = lambda i, f: (i, f, {k: "" for k in f}, False)
    ops = spark.createDataFrame([op(1, {"title": "Sea", "publisher": "P"}), op(2, {"authors": '["ADA MOOR"]'}), op(3, {"title": "Dusk"})], "book_id long, fields map<string,string>, expect map<string,string>, strict boolean")
    folders = spark.createDataFrame([("Cy Fen/Dusk (3)",)], "path string")
    g = {r["book_id"]: r for r in guarded(ops, b, folders).collect()}
    assert g[1]["fields"] == {"publisher": "P"} and "folder" in g[1]["withheld"]["title"] and "author" in g[2]["withheld"]["authors"] and "holds files" in g[3]["withheld"]["title"]
    live = spark.createDataFrame([(i, {"title": "", "authors": "", "publisher": ""}) for i in (1, 2, 3)], "book_id long, state map<string,string>")
    j = compare_and_set(ops, live, spark.createDataFrame([(1, "title"), (3, "title")], "book_id long, field string"))
    assert {r["book_id"]: (r["status"], sorted(r["written"])) for r in j.collect()} == {1: ("partial", ["publisher"]), 2: ("applied", ["authors"]), 3: ("failed", [])}
    # a writer that ends early is asked again for the rest
    calls = []

    def write(rest):
        calls.append(rest.count())
        return spark.createDataFrame([(r["book_id"], "applied") for r in rest.orderBy("book_id").limit(1).collect()], "book_id long, status string")

    assert with_retries(ops, write).count() == 3 and calls == [3, 2, 1]
    journal.append(j.select("book_id", "status"), f"{tmp_path}/j")
    (tmp_path / "j" / "bad.json").write_text('{"book_id": 9, "status"\n')
    assert journal.read(spark, f"{tmp_path}/j").count() == 3
    try:
        journal.read(spark, f"{tmp_path}/j", strict=True).collect()
        raise AssertionError
    except Exception as e:
        assert "AssertionError" not in repr(e)
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "meta.json").write_text('{"run_id": "r1", "dry_run": true, "status": "ok", "passes": ["tags"], "writes": {"applied": 3}}')
    assert [tuple(r) for r in journal.runs(spark, str(tmp_path)).collect()] == [("r1", "dry run", "ok", "tags", 3)]
    undone = spark.createDataFrame([(1, "skipped", {"title": "now"}, {"title": "then"}), (2, "applied", {}, {})], "book_id long, status string, actual map<string,string>, expect map<string,string>")
    assert [r["fields_that_differ"] for r in kept(undone).collect()] == ["title"]


def test_existing_spelling_and_covers(spark):
    from biblioflow.plans.cleaning import existing_spelling
    from biblioflow.plans.online import covers_pass

    b = books(spark, [{"authors": ["Ada MOOR"], "has_cover": True, "path": "a"}, {"authors": ["Ada Moor"], "has_cover": True, "path": "b"}, {"authors": [], "has_cover": False, "path": "c"}])
    names = spark.createDataFrame([("Ada Moor",), ("Ben",)], "name string")
    assert [tuple(r) for r in existing_spelling(b, names).collect()] == [("Ada Moor", "Ada MOOR")]
    pictures = spark.createDataFrame([(3, "service", "s.jpg", 5000), (3, "file", "f.jpg", 900), (2, "file", "g.jpg", 2000)], "id long, source string, path string, bytes long")
    r = covers_pass(b, spark.createDataFrame([("a",)], "path string"), pictures)
    assert {(x["book_id"], x["after"]) for x in r.changes.collect()} == {(2, "g.jpg"), (3, "s.jpg")} and r.review.count() == 0
