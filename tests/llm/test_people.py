import numpy as np

from biblioflow.llm import matching as ma
from biblioflow.llm import people as pe
from biblioflow.llm.queries import QUERIES


def test_linked(spark):
    names = [
        (1, "Harriet Fovofogok", "Fovofogok, Harriet"), (2, "Fovofogok, Hattie", None), (3, "H. Fovofogok", ""), (4, "Harriet Fovofgok", None), (5, "Ｈａｒｒｉｅｔ Fovofogok", None), (6, "FOVOFOGOK Harriet", None),
        (7, "Leonard Odette Bikribouvak", "Bikribouvak, Leonard Odette"), (8, "Leonard Ingrid Bikribouvak", None), (9, "Len O. Bikribouvak", None), (10, "L. Bikribouvak", None), (11, "Bikribouvak, Leonard Odette, 1902-1940", None),
        (12, "Tolafell Institute of Letters", None), (13, "Letters, Tolafell Inst. of", None), (14, "Tolafell Museum Foundation", None), (15, None, None), (16, "", None), (17, "123", None), (18, "Harriet Fovofogok", None), (19, "Hifi Romokan, Wilma", None), (20, "Wilma Hifiromokan", None), (21, "Wilma Hifiromokan PhD", None),
    ]
    df = spark.createDataFrame(names, "id long, name string, author_sort string")
    e = {r["id"]: r["entity"] for r in pe.linked(df).collect()}
    assert len({e[i] for i in (1, 2, 3, 4, 5, 6, 18)}) == 1
    assert e[7] == e[9] == e[11] != e[8] and 10 not in e
    assert e[12] == e[13] != e[14] and not {15, 16, 17} & set(e)
    assert e[19] == e[20] == e[21]


def test_names():
    assert pe.fits("bob", "robert") and pe.fits("r", "robert") and not pe.fits("bob", "richard")
    assert pe.assigned(("l", "o"), ("leonard", "odette")) == 0 and pe.assigned(("l", "x"), ("leonard", "odette")) is None
    assert pe.spellings("abcd") == {"abcd", "bcd", "acd", "abd", "abc"}


def test_titles():
    assert ma.title_parts("The Sea Song (Large Print)") == (["seasong", "the sea song"], -1, False, False)
    assert ma.title_parts("Sea Song VIII - Revised Edition")[:2] == (["seasong", "sea song"], 8)
    assert ma.title_parts("Saga: The Loom", "The Saga")[0][0] == "loom"
    assert ma.title_parts("Study Guide: The Loom")[3] and ma.title_parts("The Loom…")[2] and ma.title_parts(None) == ([], -1, False, False)
    assert ma.same_author(ma.author_key("Moor, Ada"), ma.author_key("A. Moor")) and not ma.same_author(ma.author_key("Ada Moor"), ma.author_key("Ben Moor"))


def test_matches_against_all_pairs(spark, tmp_path):
    titles = ["The Harbor under Zikova", "Letters to a Silent Diplomat", "Fegrunal Saga, Vol. 1", "Fegrunal Saga, Vol. 2", "A Thimble for the Navigator", "Return to Maplekord"]
    people = ["Ada Brekilun", "Benjamin Tofazur", "Clara Vimedok", "Clara Vimedok", "Dora Hulegat", "Edwin Pasorim"]
    books = [(i, t, [a], None, None, "P", "2001") for i, (t, a) in enumerate(zip(titles, people), 1)]
    metas = [
        (1, "Harbor under Zikova, The [ebook]", ["Brekilun, Ada"], None, None, "P", "2001"), (2, "letters to a silent diplomta", ["B. Tofazur"], None, None, None, None), (3, "Fegrunal Saga #2", ["Clara Vimedok"], None, None, None, None),
        (4, "Study Guide: Return to Maplekord", ["Edwin Pasorim"], None, None, None, None), (8, "Two Rivers", [], None, None, None, None), (9, "The Making of Maplekord", ["Edwin Pasorim"], None, None, None, None), (5, "Return to Maplekord", ["Someone Elsewhere"], None, None, None, None), (6, None, None, None, None, None, None), (7, "", [], None, None, None, None),
    ]
    books += [(7, "Two Rivers", ["Ada Brekilun"], None, None, None, None), (8, "Two Rivers", ["Clara Vimedok"], None, None, None, None), (9, "The Making of Maplekord", ["Edwin Pasorim"], None, None, None, None)]
    schema = "{} long, title string, authors array<string>, series string, series_index double, publisher string, pubdate string"
    spark.createDataFrame(books, schema.format("id")).write.parquet(f"{tmp_path}/books.parquet")
    spark.createDataFrame(metas, schema.format("meta_id")).write.parquet(f"{tmp_path}/fetched_meta.parquet")
    assert {tuple(r) for r in QUERIES["p6_found"](spark, str(tmp_path)).collect()} == {(1, 1), (2, 2), (4, 3), (9, 9)}


def test_tables_grow_with_planes():
    tables = [ma.tables_for(planes) for planes in (11, 14, 17, 20)]
    assert tables == sorted(tables) and tables[0] < tables[-1]
    for planes, n in zip((11, 14, 17, 20), tables):
        rng = np.random.default_rng(1)
        x = rng.standard_normal((4000, n, planes)).astype(np.float32)
        y = np.cos(np.radians(ma.HIT_ANGLE)) * x + np.sin(np.radians(ma.HIT_ANGLE)) * rng.standard_normal(x.shape)
        assert (ma.probed(x, ma.PROBES) == ma._bits(y)[..., None]).any(axis=(1, 2)).mean() > ma.HIT_RATE - 0.015


def test_probes_are_the_likeliest_buckets():
    x = np.array([[0.9, -0.1, 0.5, -0.2, 0.7]], np.float32)
    assert ma.probed(x, 1).tolist() == [[0b10101]]
    assert ma.probed(x, 4).tolist() == [[0b10101, 0b10111, 0b11101, 0b11111]]
    assert len(set(ma.probed(x, 32)[0].tolist())) == min(32, len(ma.probed(x, 32)[0]))


def test_authors_by_assignment():
    same = lambda a, b: ma.same_author(ma.author_key(a), ma.author_key(b))
    assert same("Ada Anna Brekilun", "A. A. Brekilun") and same("Brekilun, Anna Ada", "Ada Brekilun") and not same("Ada Anna Brekilun", "Ada Beth Brekilun")
    assert same("Jo Joan Joanna Brekilun", "J. Jo Joan Brekilun")  # a greedy choice of the first fit leaves one over
    long = " ".join(["nadia"] * 300) + " Brekilun"
    assert same(long, long + "x") and not same(long, "Ada " + long[6:])


def test_confidence_follows_independent_labels():
    rng = np.random.default_rng(2)
    match = rng.random(4000) < 0.5
    cosine = np.where(match, rng.normal(0.9, 0.05, 4000), rng.normal(0.6, 0.1, 4000))
    agree = np.stack([np.where(match, rng.random(4000) < 0.6, rng.random(4000) < 0.02)] * 2, axis=1).astype(float)
    agree[rng.random(agree.shape) < 0.3] = np.nan
    x = np.stack([cosine, *np.ones((2, 4000)), *np.zeros((3, 4000))], axis=1)
    w = ma.calibrated(x, agree, [0.02, 0.02])
    sure = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert ((sure > 0.5) == match).mean() > 0.9 and abs(sure.mean() - 0.5) < 0.1
    assert (ma.calibrated(x, np.full(agree.shape, np.nan), [0.0, 0.0]) == np.array(ma.BELIEVED)).all()


def test_shared_keys_meet_whatever_the_vectors():
    keys = lambda t, a: {k for k, _ in ma.shared_keys(ma.title_parts(t)[0][:-1], [ma.author_key(a)])}
    assert keys("The Harbor under Zikova", "Ada Brekilun") & keys("Harbro undr Zikova: a Tale of Two Ports", "Brekilun, A.")
    assert keys("Poems", "Li Po") & keys("Poems", "Po, Li")
    assert not keys("The Harbor under Zikova", "Ada Brekilun") & keys("A Thimble for the Navigator", "Ada Brekilun")


def test_recurrent_slips_of_a_family(spark):
    times = lambda n, name: [(name, None)] * n
    for k in (1, 10):  # whatever the size
        rows = times(3 * k, "Odette Gunnar Stezolomus") + times(2 * k, "Odette Gunnar Stezolmous") + times(3 * k, "Ada Hanseniu") + times(2 * k, "Clara Hansenia") + times(k, "Ingrid Stezolomus")
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, name string, author_sort string")
        e = {rows[r["id"]][0]: r["entity"] for r in pe.linked(df).collect()}
        assert e["Odette Gunnar Stezolomus"] == e["Odette Gunnar Stezolmous"] != e["Ingrid Stezolomus"]
        assert e["Ada Hanseniu"] != e["Clara Hansenia"]


def test_records_without_authors_and_joined_parts(spark):
    words = ["Harbor", "Thimble", "Diplomat", "Navigator", "Maple", "Zikova", "Lantern", "Orchard"]
    books = [(i, f"{a} and {b} of {c}", [f"Ada {c}lun"], None, None, None, None) for i, (a, b, c) in enumerate((a, b, c) for a in words for b in words for c in words)]
    books += [(900, "The Quiet Loom: A Tale of Two Weavers and a River", ["Clara Vimedok"], None, None, None, None)]
    metas = [(i, t, [], None, None, None, None) for i, t, *_ in books if i % 5 == 0 and i < 900] + [(900, "The Quiet Loom A Tale of Two Weavers and a River", ["C. Vimedok"], None, None, None, None)]
    schema = "{} long, title string, authors array<string>, series string, series_index double, publisher string, pubdate string"
    found = ma.matches(spark.createDataFrame(books, schema.format("id")), spark.createDataFrame(metas, schema.format("meta_id")))
    assert {(r["book_id"], r["meta_id"]) for r in found.collect()} == {(m[0], m[0]) for m in metas}


def test_assigned_beyond_three_names():
    whole = ("leonard", "odette", "gunnar", "ivo")
    assert pe.assigned(("leonard", "gunnar", "o", "i"), whole) == 2 and pe.assigned(("ivo", "leonard", "odette", "g"), whole) == 4
    assert pe.assigned(("leonard", "gunnar", "odette", "x"), whole) is None and pe.assigned(whole, whole) == 0


def test_assigned_against_all_orders():
    import random
    from itertools import permutations

    def brute(parts, whole):
        if len(parts) > len(whole):
            return brute(whole, parts)
        if not parts:
            return None if whole else 0
        orders = [o for o in permutations(range(len(whole)), len(parts)) if 0 in o and all(pe.fits(p, whole[j]) or pe.fits(whole[j], p) for p, j in zip(parts, o))]
        return min((sum(i != j for i, j in enumerate(o)) for o in orders), default=None)

    rnd, names = random.Random(1), ["anna", "ada", "a", "b", "bob", "robert", "ben", "benjamin", "beth", "elizabeth", "e"]
    for _ in range(3000):
        x, y = tuple(rnd.choices(names, k=rnd.randint(0, 4))), tuple(rnd.choices(names, k=rnd.randint(0, 5)))
        assert pe.assigned(x, y) == brute(x, y)
    assert pe.assigned(("anna",) * 200, ("anna",) * 200 + ("b",)) == 0


def test_training_and_calibration_use_every_row(spark):
    from pyspark.sql import functions as F

    n = 12_000  # more than any sample there was
    rows = spark.range(n).select(F.array(F.concat(F.lit("tale "), F.col("id").cast("string"))).alias("words"), F.array(F.lit("p1 brekilun ada")).alias("authors"), F.lit("").alias("series"))
    model = spark.sparkContext.broadcast(ma.Model(np.zeros((ma.GRAM_BUCKETS, ma.DIMS), np.float32), *np.zeros((2, ma.COUNT_BUCKETS), np.int64), n))
    seen, share = ma.walked(rows, model)
    pairs = 2 * (2 * ma.STEPS - 3)  # ordered pairs within two steps of a walk
    assert abs(seen.sum() - n * pairs) < 0.001 * n * pairs and share.shape == (2, ma.GRAM_BUCKETS) and (share.sum(axis=1) > 0).all()
    # pairs beyond the 5,000 first decide as well: a rare kind of evidence whose publishers agree
    ids = spark.range(n).select("id", F.col("id").alias("b"), F.concat(F.lit("p"), F.col("id") % 100).alias("publisher"), F.lit("").alias("year"))
    kinds = spark.range(n).select(F.lit(0.9).alias("cosine"), F.lit(3).alias("title_level"), F.lit(1.0).alias("author_level"), F.lit(0).alias("agree"), (F.col("id") % 3 > 0).cast("int").alias("publisher_same"), F.lit(-1).alias("year_same"))
    told = np.concatenate([[0.9, 1, 1, 0.6, 1, 0]] * n).reshape(n, 6)
    expected = ma.calibrated(told, np.stack([np.arange(n) % 3 > 0, np.full(n, np.nan)], axis=1).astype(float), [0.01, 0.0])
    assert np.allclose(ma._curve(kinds, ids, ids.withColumnRenamed("b", "m")), expected, atol=1e-3)


def test_what_the_filter_leaves_out_is_not_near():
    import random

    r = random.Random(3)

    def edited(s, k):
        s = list(s)
        for _ in range(k):
            i, o = r.randrange(len(s) - 1), r.random()
            s[i : i + 2] = [s[i + 1], s[i]] if o < 0.3 else [r.choice("abcde"), s[i + 1]] if o < 0.6 else [s[i + 1]] if o < 0.8 and len(s) > 3 else [s[i], "x", s[i + 1]]
        return "".join(s)

    texts = ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 40))) for _ in range(20_000)]
    cut = np.array([r.random() < 0.3 and len(x) >= 8 for x in texts])
    others = [edited(x, r.randint(0, 4)) if not c else edited(x, r.randint(0, 2)) + "".join(r.choices("abcde", k=r.randint(0, 9))) for x, c in zip(texts, cut)]
    near = np.array([ma.within(x, y, ma.edits(min(len(x), len(y)))) or bool(c) and ma.within(x, y[: len(x)], 2) for x, y, c in zip(texts, others, cut)])
    every, none = np.arange(len(texts)), np.zeros(len(texts), bool)
    assert near.sum() > 5000 and ma.alike(*ma.halves(texts, cut), *ma.halves(others, none), every, every)[near].all() and ma.alike(*ma.halves(others, none), *ma.halves(texts, cut), every, every)[near].all()
    assert ma.alike(*ma.halves(texts, none), *ma.halves(texts, none), every, every[::-1]).mean() < 0.05


def test_settled_records_get_what_a_full_search_gives(spark):
    words = ["Harbor", "Thimble", "Diplomat", "Navigator", "Maple", "Zikova"]
    titles = [f"{a} and {b}" for a in words for b in words]
    books = [(2 * i + k, t, [f"Ada {t.split()[0]}lun"], None, None, p, y) for i, t in enumerate(titles) for k, (p, y) in enumerate((("Old Press", "1990"), ("New Press", "2001")))]
    metas = [(i, t, [f"A. {t.split()[0]}lun"] if i % 2 else [f"Ada {t.split()[0]}lun"], None, None, "New Press", "2001") for i, t in enumerate(titles)]
    metas += [(100 + i, t[:-1] + "x", [f"Ada {t.split()[0]}lun"], None, None, "Old Press", "1990") for i, t in enumerate(titles)]
    schema = "{} long, title string, authors array<string>, series string, series_index double, publisher string, pubdate string"
    found = ma.matches(spark.createDataFrame(books, schema.format("id")), spark.createDataFrame(metas, schema.format("meta_id")))
    assert {(r["book_id"], r["meta_id"]) for r in found.collect()} == {(2 * i + 1, i) for i in range(len(titles))} | {(2 * i, 100 + i) for i in range(len(titles))}


def test_letter_groups_and_sums_of_many_at_once():
    import zlib

    tokens = ["a", "harbor", "zikova", "straße", "漢字", ""]
    pairs = lambda s: [*map("".join, zip(s, s[1:])), *map("".join, zip(s, s[2:]))]
    grams, sizes = ma.grams_of(tokens)
    expected = [[zlib.crc32("".join(sorted(g)).encode()) % ma.GRAM_BUCKETS for g in (*pairs(f"<{w}>"), *w)] for w in tokens]
    assert sizes.tolist() == list(map(len, expected)) and grams.tolist() == [g for e in expected for g in e]
    rows, weight = np.arange(12, dtype=np.float32).reshape(6, 2), np.array([1, 2, 1, 1], np.float32)
    assert ma._segments(rows, np.array([5, 0, 1, 2]), np.array([1, 0, 3]), weight).tolist() == [[10, 11], [0, 0], [0 + 2 + 4, 2 + 3 + 5]]


def test_keys_move_in_packets(spark):
    from pyspark.sql import functions as F

    parts, n = 7, 300
    rows = spark.range(n, numPartitions=2).select(F.col("id").alias("sid"), F.concat(F.lit("harborunder"), F.col("id")).alias("parts"), F.concat(F.lit("harbor under "), F.col("id")).alias("words"), F.lit(-1).alias("volume"), F.lit(-1).alias("series_no"), F.lit(False).alias("cut"), F.lit(False).alias("about"), F.lit("p1 brekilun ada").alias("authors"), F.lit("").alias("series"))
    model = ma.Model(np.zeros((ma.GRAM_BUCKETS, ma.DIMS), np.float32), *np.zeros((2, ma.COUNT_BUCKETS), np.int64), n)
    model = spark.sparkContext.broadcast(model.learned(np.random.default_rng(1).standard_normal((ma.GRAM_BUCKETS, ma.DIMS)).astype(np.float32), np.zeros((2, ma.GRAM_BUCKETS), np.float32)))
    sides = [ma._hashed(rows, model, 6, 2, probe, parts) for probe in (False, True)]
    told = [r for side in sides for r in side.collect()]
    assert len(told) <= 2 * 2 * parts  # not a row for every key
    assert {s for r in told for s in np.frombuffer(r["told"], np.int64).reshape(4, -1)[1].tolist()} == set(range(n))
    met = {(r["b"], r["m"]) for r in ma.meetings(sides[0].unionByName(sides[1]), parts).collect()}
    assert {(i, i) for i in range(n)} <= met
