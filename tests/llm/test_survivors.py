import datetime

import pytest
from biblioflow.llm import survivors as sv
from pyspark.sql import functions as F

AT = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "f,cases",
    [
        (sv.pubdate_fullness, {"2011-05-09T00:00:00+00:00": 3, "9 Mar 1999": 3, "March 9, 1999": 3, "05/1999": 2, "1999-05": 2, "c1999": 1, "[1999]": 1, "1999?": 1, "2001-02-30": 0, "2000-02-29": 3, "1899-01-01": 0, "0101-01-01": 0, "n.d.": 0, "": 0, None: 0, "2031": 0}),
        (sv.comments_fullness, {"<p>A  b</p><p>c</p>": 5, "<p>&nbsp;</p>": 0, "No description available.": 0, "<p>Description to follow.</p>": 0, "Summary not yet provided": 0, "TBA": 0, "a&amp;b": 3, None: 0, "<b>x</b>y": 2}),
    ],
)
def test_fullness(spark, f, cases):
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert [r[0] for r in df.select(f(F.col("x"))).collect()] == list(cases.values())


def test_isbn(spark):
    df = spark.createDataFrame([("9780306406157",), ("978-0-306-40615-7",), ("9780306406158",), ("080442957X",), ("0000000000000",), (None,)], "x string")
    assert [r[0] for r in df.select(sv.isbn_ok(F.col("x"))).collect()] == [True, True, False, True, False, False]


def test_survivors(spark):
    rows = [
        (1, AT, "n/a", {"isbn": "1"}, "2011", "<p></p>", "x"), (2, AT, "Moor", {"a": "1", "A": "2"}, "2011-05", "short", "x"),
        (3, AT + datetime.timedelta(1), "Lark", {"a": "1", "b": "2"}, "2011-05", "longer text", "x"), (4, AT, None, None, None, None, "x"),
    ]
    books = spark.createDataFrame(rows, "id long, last_modified timestamp, publisher string, identifiers map<string,string>, pubdate string, comments string, group_id string")
    review = spark.createDataFrame([(1, "duplicates", [3, 2, 1]), (2, "duplicates", [1, 2, 3]), (3, "duplicates", [4, 9]), (4, "other", [1]), (5, "duplicates", None), (6, "duplicates", [])], "review_id long, category string, book_ids array<long>")
    out = sv.survivors(books.drop("group_id"), sv.groups_of(review), ["publisher", "identifiers", "pubdate", "comments"]).collect()
    got = {r["group_id"]: {f: r[f]["id"] if r[f] else None for f in ("publisher", "identifiers", "pubdate", "comments")} for r in out}
    assert got == {1: {"publisher": 3, "identifiers": 3, "pubdate": 3, "comments": 3}, 4: dict.fromkeys(("publisher", "identifiers", "pubdate", "comments"))}
    trusted = sv.survivors(books.drop("group_id"), sv.groups_of(review), ["publisher"], priority=F.when(F.col("id") == 2, 1).otherwise(0)).where("group_id = 1").first()
    assert trusted["publisher"]["id"] == 2
