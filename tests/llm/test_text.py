import unicodedata

from biblioflow.llm import canon as cn
from biblioflow.llm import lookalikes as lk
from hypothesis import given, settings
from hypothesis import strategies as st


def test_forms(spark):
    same = [("Ｓｅａ　Ｓｏｎｇ", "Sea Song"), ("Sе​а Sоng", "Sea Song"), ("Sea Song", "Sea Song"), ("éa", "éa"), ("Song Ⅷ", "Song VIII"), ("ﬁn", "fin"), ("ạ̇", "ạ̇"), ("​", ""), ("각", unicodedata.normalize("NFD", "각"))]
    apart = [("Sea", "sea"), ("Séa", "Sea"), ("Sea  Song", "Sea Song"), ("x²", "x2"), ("rn", "m")]
    texts = sorted({t for p in same + apart for t in p} | {"x" * 30_000 + "é"})
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("Sea",)], "text string")
    form = {r["text"]: r["form"] for r in lk.forms(df).collect()}
    assert set(form) == set(texts)
    assert all(form[a] == form[b] for a, b in same) and all(form[a] != form[b] for a, b in apart)
    assert form["éa"] == "éa" and form["Sea"] == "Sea"
    again = spark.createDataFrame([(t,) for t in set(form.values())], "text string")
    assert all(r["text"] == r["form"] for r in lk.forms(again).collect())


def test_pairs(spark):
    rows = [("title", 1, "Sea"), ("title", 2, "Sеa"), ("title", 3, "Sea"), ("title", 3, "Sea"), ("title", 4, "SEA"), ("series", 5, "Sеa"), ("title", 6, None), ("title", 7, "")]
    df = spark.createDataFrame(rows, "field_name string, id long, text string")
    assert {tuple(r) for r in lk.same_look_pairs(df).collect()} == {("title", 1, 2), ("title", 2, 3)}
    assert lk.same_look_pairs(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=5, unique=True), st.text("abcd", max_size=7), st.integers(0, 3))
def test_automaton_finds_all_within(words, query, k):
    trie = cn.Trie()
    for i, w in enumerate(words, 1):
        trie.add(w, i)
    assert trie.within(query, k) == {i: cn.osa(w, query) for i, w in enumerate(words, 1) if cn.osa(w, query) <= k}


def test_canon(spark):
    terms = spark.createDataFrame([(1, "publisher", "Harrow Vault Books"), (2, "publisher", "Yarrow Quay Press"), (3, "tag", "Historical Romance"), (4, "tag", "Poetry")], "term_id long, kind string, term string")
    cases = {
        ("publisher", "HARROW_Vault_Books, Ltd."): 1, ("publisher", "The Harrow Valut Bks (Somewhere)"): 1, ("publisher", "Elsewhere: Harrow Vault"): 1, ("publisher", "Yarrow Vault Books"): 0, ("publisher", "Harrow Quay Press"): 0,
        ("publisher", "Unknown"): 0, ("publisher", ""): 0, ("tag", "Romance, Historical"): 3, ("tag", "#historicalromance"): 3, ("tag", "Hist. romance"): 3, ("tag", "genre:Poetrys"): 4, ("tag", "read 2019"): 0, ("tag", "  "): 0,
    }
    df = spark.createDataFrame(list(cases), "kind string, name string")
    assert {(r["kind"], r["name"]): r["term_id"] for r in cn.map_to_terms(df, terms).collect()} == cases
    assert {r["term_id"] for r in cn.map_to_terms(df, terms.limit(0)).collect()} == {0}
