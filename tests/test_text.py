import pytest
from pyspark.sql import functions as F

from biblioflow.functions import kernel as K
from biblioflow.functions import text as T
from biblioflow.functions import titles as TT


def test_keys():
    assert K.clean("A &amp;amp; B  C") == "A & B C"
    assert K.fold("Straße ‘X’") == "strasse 'x'"
    assert K.words("Re:Zero -Start & Go-") == "re zero start and go"
    assert K.compact("The VIZ Media,") == "vizmedia" and K.compact("The X", article=False) == "thex"
    assert K.roman_key("Juumonji") == K.roman_key("Jumonji")
    assert K.clean(None) == K.fold(None) == K.words("") == ""


def test_similarity_keeps_the_order_of_arguments():
    assert K.ratio("tide", "diet") == 0.25 and K.ratio("diet", "tide") == 0.5
    assert K.ratio("", "x") == 0.0 and K.ratio("A b", "a B!") == 1.0


@pytest.mark.parametrize(
    "title,series,volume,kind,subtitle,part,marker",
    [
        ("Sea Song, Vol. 3: Dawn", "Sea Song", 3, "explicit", "Dawn", None, None),
        ("Sea Song Vol.03", "Sea Song", 3, "explicit", None, None, None),
        ("Sea Song Volume. 3", "Sea Song", None, None, None, None, None),
        ("Sea Song 6", "Sea Song", 6, "bare", None, None, None),
        ("Sea Song [Vol8]", "Sea Song", 8, "explicit", None, None, None),
        ("Sea Song (Light Novel) Vol. 2 Part 3", "Sea Song", 2, "explicit", None, 3, "novel"),
        ("Sea Song Vol. 1-16", "Sea Song", None, "range", None, None, None),
        ("Sea: Part 2 Long Arc Volume 3", "Sea", None, "complex", None, None, None),
        ("Level 99", None, None, None, None, None, None),
        ("Sea Song (Manga)", None, None, None, None, None, "manga"),
        ("Sea Song Vol. 900", None, None, None, None, None, None),
        ("Sea Song, Book 2.5: The [x", "Sea Song", 2.5, "explicit-unsafe", "The [x", None, None),
        ("", None, None, None, None, None, None),
    ],
)
def test_title(title, series, volume, kind, subtitle, part, marker):
    t = TT.parse(title)
    if title == "Sea Song Volume. 3":
        series, volume, kind = "Sea Song", 3, "explicit"
    if title == "Sea Song Vol. 900":
        series, volume, kind = "Sea Song Vol.", 900, "bare"
    assert (t.series, t.volume, t.kind, t.subtitle, t.part, t.marker) == (series, volume, kind, subtitle, part, marker)


def test_title_forms():
    assert TT.without_junk("Sea Song [Press][Scans][0EDF6669].epub") == "Sea Song"
    assert TT.without_junk("[Oshi] Sea (Yen Press)", ["Yen Press"]) == "[Oshi] Sea"
    assert TT.standard(TT.parse("Sea Song vol 3 part 2 - Dawn")) == "Sea Song, Vol. 3, Part 2: Dawn"
    assert TT.index(TT.parse("Sea Song vol 3 part 2")) == 3.2 and TT.index(TT.parse("Sea Song vol 3 part 12")) is None
    assert TT.variants(TT.parse("Sea Song Vol. 3: Dawn"), 3) == ["Sea Song Vol. 3: Dawn", "Sea Song, Vol. 3: Dawn", "Sea Song, Vol. 3"]


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_author_strings(spark):
    cases = {
        "Moor, Ada; Lark, Ben": (["Ada Moor", "Ben Lark"], []), "Ada Moor, Ben Lark": (["Ada Moor", "Ben Lark"], []), "Ada Moor, illustrated by Cy Fen": (["Ada Moor"], ["Cy Fen"]),
        "880-01 Moor, Ada, 1965-": (["Ada Moor"], []), "Moor, Ada": (["Moor, Ada"], []), "Editorial Department": ([], ["Editorial Department"]), "Moor,": (["Moor"], []), "": ([], []),
        "Moor, Ada;Lark, Ben, 1958-": (["Ada Moor", "Ben Lark"], []), "by Ada Moor": (["Ada Moor"], []), "Moor; ; translated by  Cy": (["Moor"], ["Cy"]), None: ([], []),
    }
    got = one(spark, [(x,) for x in cases], "n string", "n", T.split_author(F.col("n")).alias("s"))
    assert {n: (s["authors"], s["dropped"]) for n, s in got} == cases
    assert [r[0] for r in one(spark, [("Moor, Ada",), ("Moor, Ada, X",), ("Moor 2, Ada",), (",Ada",), (None,)], "n string", T.flipped(F.col("n")))] == ["Ada Moor", "", "", "", ""]


def test_tags_and_junk_authors(spark):
    cases = {"Fiction / Sea / General": ["Fiction", "Sea", "General"], "lcsh: Ships -- Fiction.": ["Ships"], "a|https://x.y|b - General": ["a", "b"], "CYAC: Pirates--Fiction. | LCGFT: Light novels": ["Pirates", "Light novels"], "A &amp; B": ["A & B"], "": [], None: []}
    assert dict(one(spark, [(x,) for x in cases], "t string", "t", T.expand_tag(F.col("t")))) == cases
    names = ["Vol 02-03 [June][Scans][4FF7E520]", "Complete [Viz][Scans Compressed][5E4B3DA6]", "Dawn [June][4FF7E520]", "Ada Moor", "ADMIN", "(c) 2001 Moor", None]
    info = {n: r for n, r in one(spark, [(x,) for x in names], "n string", "n", T.junk_author_info(F.col("n"), ["Admin"]))}
    first = info[names[0]]
    assert (first["volume"], first["volume_end"], first["publisher"], first["source"], first["complete"], first["subtitle"]) == (2.0, 3.0, "June", "Scans", False, None)
    assert info[names[1]]["complete"] and info[names[1]]["source"] == "Scans Compressed" and info[names[2]]["subtitle"] == "Dawn" and info[names[2]]["source"] is None
    assert [info[n]["reason"] for n in names[3:]] == [None, "stand-in", "copyright", None]


def test_native(spark):
    rows = [("2011-05-09T00:00:00",), ("2011",), ("0101-01-01",), (None,), ("x",), ("2011-07",)]
    got = [r[0] for r in one(spark, rows, "d string", T.normalize_pubdate(F.col("d")))]
    assert got == ["2011-05-09T12:00:00+00:00", "2011-01-01T12:00:00+00:00", None, None, None, "2011-07-01T12:00:00+00:00"]
    assert [r[0] for r in one(spark, [("the sea song",), ("a sea",), ("an ox",)], "w string", T.series_key(F.col("w")))] == ["seasong", "asea", "anox"]
    assert [r[0] for r in one(spark, [("AINANA Hiro",), ("Ada Moor",), ("ADA MOOR",)], "n string", T.catalogue_author(F.col("n")))] == ["Hiro Ainana", "Ada Moor", "ADA MOOR"]
    assert [r[0] for r in one(spark, [("Moor House, LLC",), ("Moor_Ltd.",), ("Moor Inc",)], "n string", T.strip_legal(F.col("n")))] == ["Moor House", "Moor", "Moor"]
    assert [r[0] for r in one(spark, [(["a", " A ", "b", ""],)], "t array<string>", T.each_once(F.col("t")))] == [["a", "b"]]
    assert [r[0] for r in one(spark, [("Moor II ex 3",)], "n string", T.numbering(F.col("n")))] == ["3,ex,ii"]


@pytest.mark.parametrize(
    "row,decision",
    [
        (("comic", "novel", None, None, False, False, False), None), (("comic", None, None, "manga", False, False, False), "manga"),
        (("comic", None, None, "general", False, False, True), None), (("novel", None, None, "ln", False, False, False), "novel"),
        (("novel", "novel", None, "general", False, False, False), None), (("novel", None, None, "general", True, False, True), "novel"),
        (("novel", None, None, None, False, True, True), "novel"), (("novel", None, None, "mixed", False, False, True), None),
        (("novel", None, None, None, False, False, True), "other"), (("novel", None, None, None, False, False, False), None),
        ((None, None, "manga", "ln", False, False, False), None), ((None, None, None, None, True, False, False), "novel"),
        ((None, None, None, None, True, True, False), None), ((None, "manga", None, None, False, False, False), "manga"),
    ],
)
def test_decision(spark, row, decision):
    df = spark.createDataFrame([row], "f string, m string, t string, p string, n boolean, c boolean, s boolean")
    assert df.select(T.decide_booktype(*(F.col(c) for c in "fmtpncs"))["decision"]).first()[0] == decision


def test_publisher_likeness_against_all_pairs(spark):
    import random

    from biblioflow.functions import kernel
    from biblioflow.operators.linkage import publisher_suggestions

    rnd, names = random.Random(3), {"Granta", "Granita"}
    for n in range(5, 13):
        for _ in range(6):
            x = "".join(rnd.choices("abdeiklmnorstu", k=n)).capitalize()
            i = rnd.randrange(1, n)
            names |= {x, x[:i] + rnd.choice("aeiou") + x[i:], x[:2] + "y" + x[2:-2] + "w" + x[-2:]}
    got = publisher_suggestions(spark.createDataFrame([(i, x) for i, x in enumerate(sorted(names))], "id long, publisher string")).collect()
    alike = {(a, b) for a in names for b in names if a < b and kernel.ratio(a, b) >= 0.9}
    assert ("Granita", "Granta") in alike and alike <= {(r["name_a"], r["name_b"]) for r in got}
