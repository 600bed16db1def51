from biblioflow.plans.online import classify_pass, fetch_pass, junk_authors_pass, series_lookup_pass
from tests.test_passes import books

CANDIDATE = "book_id long, rank long, title string, authors array<string>, tags array<string>, publisher string, pubdate string, comments string, languages array<string>, identifiers map<string,string>, series string, series_index double"


def test_fetch(spark):
    b = books(spark, [{"title": "Sea Song, Vol. 2", "authors": ["Ada Moor"], "tags": ["Sea"], "identifiers": {"ISBN": "1"}}, {"title": "Stone", "authors": ["Di Holm"]}, {"title": "Full", "comments": "c", "publisher": "p", "pubdate": "2001"}])
    rows = [
        (1, 1, "Sea Song, Vol. 3", ["Ada Moor"], [], "X", "2001", "c", ["eng"], {}, None, None), (1, 2, "Sea Song, Vol. 2", ["Moor Ada"], ["sea", "Tide"], "Moor House", "2011-05", "text", ["en"], {"isbn": "9", "x": "2"}, None, None),
        (1, 3, "Sea Song, Vol. 2", ["Ada Moor"], [], "Late", "2012", "d", ["eng"], {}, None, None), (2, 1, "Stone", ["Di Holm"], [], "Y", "2001", "c", ["fra"], {}, None, None), (3, 1, "Full", ["Z"], [], "Y", "2001", "c", ["eng"], {}, None, None),
    ]
    result = fetch_pass(b, spark.createDataFrame(rows, CANDIDATE))
    got = {r["id"]: r for r in result.books.collect()}
    assert (got[1]["publisher"], got[1]["comments"], got[1]["pubdate"], got[1]["languages"]) == ("Moor House", "text", "2011-05-01T12:00:00+00:00", ["eng"])
    assert got[1]["tags"] == ["Sea", "Tide", "Metadata-Fetched"] and got[1]["identifiers"] == {"ISBN": "1", "x": "2"} and got[1]["metadata_status"] == "fetched"
    assert got[2]["metadata_status"] == "failed" and got[2]["publisher"] is None and got[3]["metadata_status"] is None
    reasons = {(r["book_id"], r["candidate_id"]): r["reject_reason"] for r in result.review.collect()}
    assert reasons == {(1, 1): "volume", (1, 2): None, (1, 3): None, (2, 1): "language"}


def test_junk_authors_and_types(spark):
    b = books(spark, [{"title": "Sea Song", "authors": ["Vol 02 [June][Scans][4FF7E520]", "Ben Lark"]}, {"title": "Stone (Manga)", "authors": ["Di Holm"], "tags": ["Manga", "x"]}])
    votes = spark.createDataFrame([(1, "a", "Ada Moor", False), (1, "b", "Moor, Ada", False), (1, "a", "Cy Fen", False)], "book_id long, source string, name string, exact boolean")
    got = junk_authors_pass(b, votes).books.where("id = 1").first()
    assert len(got["authors"]) == 2 and got["authors"][1] == "Ben Lark" and "Ada" in got["authors"][0] and got["publisher"] == "June"
    hits = spark.createDataFrame([("Sea Song", "Sea Song (Novel)", "", "novel")], "query string, title string, main_title string, medium string")
    types = {r["id"]: (r["booktype"], r["tags"]) for r in classify_pass(b, hits, {}).books.collect()}
    assert types == {1: ("novel", ["Light Novel"]), 2: ("manga", ["x", "Manga"])}


def test_series_lookup(spark):
    b = books(spark, [{"title": "The Dawn", "authors": ["Ada Moor"]}, {"title": "The Dusk", "authors": ["Ada Moor"]}, {"title": "Other", "series": "Sea Song", "series_index": 2.0}])
    hits = spark.createDataFrame([(1, 1, "The Dawn", "", ["Moor Else"], "Wrong", 1.0), (1, 2, "The Dawn", "", ["Ada Moor"], "The Sea Song", 1.0), (2, 1, "The Dusk", "", ["Ada Moor"], "Sea Song", 2.0)], "book_id long, rank long, title string, subtitle string, authors array<string>, series string, position double")
    r = series_lookup_pass(b, hits)
    got = {x["id"]: (x["series"], x["series_index"]) for x in r.books.collect()}
    assert got[1] == ("Sea Song", 1.0) and got[2][0] is None and [x["book_id"] for x in r.review.collect()] == [2]


def test_accepted_bare_titles(spark):
    from biblioflow.plans.online import fetch_pass
    from biblioflow.plans.run import Answers, full_run
    from tests.test_passes import books

    b = books(spark, [
        {"title": "Sea Song, Vol. 1", "authors": ["Ada Moor"], "comments": "x", "publisher": "P", "pubdate": "2001"},
        {"title": "Sea Song 4", "authors": ["Ada Moor"]}, {"title": "Fahrenheit 451", "authors": ["Ray B"]},
    ])
    schema = "book_id long, rank int, title string, authors array<string>, tags array<string>, publisher string, pubdate string, comments string, languages array<string>, identifiers map<string,string>, series string, series_index double"
    rows = [(2, 1, "Sea Song, Vol. 5", ["Ada Moor"], [], "P", "2002", "no", ["eng"], {}, None, None), (2, 2, "Sea Song, Vol. 4: Dawn", ["Moor Ada"], ["sci-fi"], "P", "2002-03", "four", ["eng"], {}, "Sea Song", 4.0)]
    answers = Answers(candidates=spark.createDataFrame(rows, schema))
    after, log, _ = full_run(b, ["series", "titles", "fetch"], answers=answers)
    got = {r["id"]: r for r in after.collect()}
    assert (got[2]["series"], got[2]["series_index"], got[2]["title"], got[2]["comments"], got[2]["metadata_status"]) == ("Sea Song", 4.0, "Sea Song, Vol. 4: Dawn", "four", "fetched")
    assert "Science Fiction" in got[2]["tags"] and got[3]["title"] == "Fahrenheit 451" and got[3]["metadata_status"] is None
    # the last source: something to add, and no status while a field is missing
    last = spark.createDataFrame([(3, 1, "Fahrenheit 451", ["Ray B"], [], None, None, "burns", [], {}, None, None)], schema)
    got = {r["id"]: r for r in fetch_pass(b, answers.candidates.limit(0), fallback=last).books.collect()}
    assert got[3]["comments"] == "burns" and got[3]["metadata_status"] is None


def test_limits_and_preview(spark):
    from biblioflow.plans.run import chosen, full_run
    from tests.test_passes import LIBRARY, books

    b = books(spark, LIBRARY)
    after, log, review = full_run(b, ["tags", "duplicates"], limit=1)
    assert log.select("book_id").distinct().count() == 1 and after.count() == b.count()
    assert len(chosen(["all"])) == 14 and chosen(["all"], ["fetch"])[-1] == "duplicates"
