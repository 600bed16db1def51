import itertools
import random

import numpy as np
from biblioflow.llm import mixing as mx
from biblioflow.llm import packing as pk
from biblioflow.llm import spans as sp
from biblioflow.llm import tokens as tk


def _shared(texts):
    at, cover = {}, {}
    for i, t in texts:
        for k in range(len(t or "") - sp.SPAN + 1):
            at.setdefault(t[k : k + sp.SPAN], set()).add(i)
    for i, t in texts:
        c = bytearray(len(t or ""))
        for k in range(len(t or "") - sp.SPAN + 1):
            if len(at[t[k : k + sp.SPAN]]) > 1:
                c[k : k + sp.SPAN] = b"\1" * sp.SPAN
        cover[i] = sum(c)
    return {p for s in at.values() for p in itertools.combinations(sorted(s), 2)}, cover


def test_spans_against_brute_force(spark):
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("abcdé 𝄞") for _ in range(n))
    exact, near, long = text(200), text(199), text(900)
    texts = [(1, text(300) + exact + text(50)), (2, exact), (3, text(40) + exact + text(400)), (4, near + text(300)), (5, text(10) + near), (6, long), (7, text(5) + long[100:700]), (8, long), (9, None), (10, ""), (11, "a" * 700), (12, "b" + "a" * 300), (13, exact[:199]), (14, text(5000) + long[300:550])]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, pos string")
    found = sp.repeated(df, 12)  # a small sketch lets more through and loses nothing
    pairs, cover = _shared(texts)
    assert {tuple(r) for r in sp.shared_pairs(found).collect()} == pairs
    assert {r["doc_id"]: r["shared_chars"] for r in sp.shared_lengths(df, found).collect()} == cover
    assert sp.shared_pairs(sp.repeated(df.limit(0), 12)).count() == 0


def test_hot_span_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sp, "BLOCK", 4)
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    core = text(260)
    texts = [(i, text(rnd.randint(0, 60)) + core + text(20)) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = sp.repeated(df, 12)
    assert found.where("i != j").count() > 0
    assert {tuple(r) for r in sp.shared_pairs(found).collect()} == _shared(texts)[0]


def test_tokens(spark):
    texts = ["Hello  world, it's 3²!", "", None, "naïve Ⅷ x​y", "a\n\n b   "]
    enc = tk.encoding()
    count = tk.counter()
    assert [count(t) for t in texts] == [len(enc.encode_ordinary(t or "")) for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tk.token_count(df["t"])).collect()] == [count(t) for t in texts]


def _plain_ffd(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        k = next((i for i, r in enumerate(room) if r >= s), None)
        if k is None:
            room.append(capacity)
            k = len(room) - 1
        room[k] -= s
    return len(room)


def test_packing(spark):
    rnd = random.Random(1)
    sizes = [rnd.randint(1, 90) for _ in range(300)]
    item, piece, size, container = pk.first_fit_decreasing(np.array(sizes), 100)
    assert len(set(container)) == _plain_ffd(sizes, 100) and sorted(item) == list(range(300))
    items = spark.createDataFrame([(1, 250), (2, 60), (3, 40), (4, 0), (5, None), (6, 100), (7, 50)], "doc_id long, tokens long")
    caps = spark.createDataFrame([("a", 100), ("b", 1000)], "pack_name string, capacity_tokens int")
    out = pk.packed(items, caps)
    rows = out.where("pack_name = 'a'").collect()
    total = {}
    for r in rows:
        total[r["container"]] = total.get(r["container"], 0) + r["tokens"]
    assert max(total.values()) <= 100 and sum(total.values()) == 500 and len(total) == 5
    assert sorted(r["tokens"] for r in rows if r["doc_id"] == 1) == [50, 100, 100] and {r["doc_id"] for r in rows} == set(range(1, 8))
    assert {r["pack_name"]: r["containers"] for r in pk.fill_report(out, caps).collect()} == {"a": 5, "b": 1}
    assert pk.packed(items.limit(0), caps).count() == 0


def test_mixing(spark):
    docs = [(i, "a", 10) for i in range(400)] + [(1000 + i, "B b ", 10) for i in range(100)] + [(2000 + i, "c", 10) for i in range(5)] + [(3000, None, 10), (3001, "z", 10), (3002, "a", 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    t = spark.createDataFrame([("a", 0.5, 1), ("b_b", 0.4, 3), ("c", 0.05, 2), ("none", 0.05, 2)], "source string, target_share double, max_repeats int")
    sel = mx.mixed(df, t, budget=3000)
    rows = sel.collect()
    assert 2990 <= sum(r["tokens"] for r in rows) <= 3000
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows) and max(r["copy"] for r in rows if r["source"] == "b_b") <= 2
    share = {r["source"]: r for r in mx.share_report(sel, t).collect()}
    assert share["c"]["copies"] == 10 and share["none"]["tokens"] == 0
    rest = 3000 - 100
    assert abs(share["a"]["tokens"] - rest * 5 / 9) <= 20 and abs(share["b_b"]["tokens"] - rest * 4 / 9) <= 20
    assert mx.mixed(df.limit(0), t).count() == 0


def test_a_full_sketch_copies_nothing_and_hot_spans_are_split(spark):
    import random

    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    hot = text(260)
    texts = [(i, text(150) + (hot if i % 2 else text(260)) + text(80)) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = sp.repeated(df, 8).collect()  # 256 cells: every anchor is let through
    assert found and {(r["i"], r["j"]) for r in found} == {(0, 0)} and all(r["doc_id"] % 2 for r in found)
    split = sp.repeated(df, 8, block=10)
    assert len({(r["i"], r["j"]) for r in split.collect()}) > 3
    want = {(a, b) for a in range(1, 60, 2) for b in range(a + 2, 60, 2)}
    assert {tuple(r) for r in sp.shared_pairs(split).collect()} == want
    copies = spark.createDataFrame([*texts, (100, texts[1][1]), (101, texts[0][1]), (102, None), (103, "")], "doc_id long, text string")
    links = {r["doc_id"]: (r["class_id"], r["copies"], r["links"]) for r in sp.link_counts(copies).collect()}
    assert links[1] == links[100] == (1, 2, 30) and links[3] == (3, 1, 30) and links[0] == links[101] == (0, 2, 1) and len(links) == 33


def test_mixing_cut_in_fine_bins(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], 1 + i % 7) for i in range(5000)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.75, 3), ("b", 0.25, 1), ("c", 0.1, 1)], "source string, target_share double, max_repeats int")
    want = mx.copies(mx.queued(docs, targets)).orderBy("finish", "source", "doc_id", "copy").toPandas()
    want = want[want["tokens"].cumsum() <= 9000]
    for edge in (100_000, 3):
        got = mx.mixed(docs, targets, budget=9000, edge=edge).orderBy("finish", "source", "doc_id", "copy").toPandas()
        assert len(got) == len(want) and got["tokens"].sum() == want["tokens"].sum()
    assert mx.mixed(docs, targets, budget=10**9).count() == 2500 * 4


def test_look_classes(spark):
    from biblioflow.llm import lookalikes as lk

    rows = [("title", 1, "Sea"), ("title", 2, "Ｓea"), ("title", 3, "Sea"), ("title", 4, "Loom"), ("title", 5, "Sea\n"), ("title", 2, "Sea")]
    got = {(r["id"], r["text"]): r["links"] for r in lk.look_classes(spark.createDataFrame(rows, "field_name string, id long, text string")).collect()}
    assert got[(1, "Sea")] == 1 and got[(2, "Ｓea")] == 2 and (4, "Loom") not in got and (2, "Sea") not in got
