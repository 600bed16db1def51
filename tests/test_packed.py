import pytest

from biblioflow.operators.packed import unpack

NAMES = {
    "Ada Moor; Ben Lark": ["Ada Moor", "Ben Lark"],
    "Moor, Ada": ["Moor, Ada"],
    "Ada Moor, Ben Lark": ["Ada Moor", "Ben Lark"],
    "Moor, Ada and Lark, Ben": ["Moor, Ada", "Lark, Ben"],
    "Ada Moor, Jr.": ["Ada Moor, Jr."],
    r"Moor\, Ada, Lark\, Ben": ["Moor, Ada", "Lark, Ben"],
    '["Ada Moor", "Ben Lark"]': ["Ada Moor", "Ben Lark"],
    "['Ada Moor','Ben Lark']": ["Ada Moor", "Ben Lark"],
    '"Moor & Lark, Partners"; Cy Fen': ["Moor & Lark, Partners", "Cy Fen"],
    '"Moor, Ada" "Lark, Ben"': ["Moor, Ada", "Lark, Ben"],
    "by Ada Moor with Ben Lark": ["Ada Moor", "Ben Lark"],
    ";Ada Moor;;Ada Moor ;": ["Ada Moor", "Ada Moor"],
    'William "Bill" Moor': ['William "Bill" Moor'],
    "Ada Moor, and Ben Lark": ["Ada Moor", "Ben Lark"],
    "Moor, Ada, Lark, Ben": ["Moor, Ada", "Lark, Ben"],
}
TERMS = {
    "a, b;c | d": ["a", "b", "c", "d"],
    "#folkTales #sea": ["folkTales", "sea"],
    "Arts & Crafts": ["Arts & Crafts"],
    'x,"the ""bell"" years, old"': ["x", 'the "bell" years, old'],
    "one / two // three": ["one", "two", "three"],
    "a\r\nb\tc": ["a", "b", "c"],
    "  ": [],
    "": [],
    "C#": ["C#"],
}


@pytest.mark.parametrize("kind,cases", [("names", NAMES), ("terms", TERMS)])
def test_values(spark, kind, cases):
    df = spark.createDataFrame([(i, s, "extra") for i, s in enumerate(cases)] + [(99, None, "extra")], "id long, f string, pos string")
    got: dict[int, list] = {}
    for r in unpack(df, "id", {"f": kind}).collect():
        got.setdefault(r["id"], []).append((r["pos"], r["item"]))
    for i, (text, items) in enumerate(cases.items()):
        assert [x for _, x in sorted(got.get(i, []))] == items, text
        assert [p for p, _ in sorted(got.get(i, []))] == list(range(1, len(items) + 1))
    assert 99 not in got


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "id long, f string")
    assert unpack(empty, "id", {"f": "terms"}).count() == 0
    long = spark.createDataFrame([(1, "; ".join(f"tag {i}" for i in range(20_000)))], "id long, f string")
    assert unpack(long, "id", {"f": "terms"}).count() == 20_000
    assert unpack(long, "id", {"f": "terms"}, at_least=20_001).count() == 0
