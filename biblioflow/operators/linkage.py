"""Suggestions of names that may mean one: blocked comparison, never all pairs of names.

Names are distinct strings. Every reason is an equi-join on a block key; similarity of
matching blocks is only computed for pairs that share one. A fuzzy block of more than
block_cap names is left out, as the rule asks; exact reasons have no such limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biblioflow.functions import text as T
from biblioflow.plans.cleaning import mapped, publisher_groups
from biblioflow.session import written

# Least similarities.
AUTHORS_ALIKE, PUBLISHERS_ALIKE, SERIES_ALIKE = 0.88, 0.9, 0.93


def _pairs(rows: DataFrame, block: str, cols: list[str], reason: str) -> DataFrame:
    a = rows.select(block, *(F.col(c).alias(f"{c}_a") for c in cols))
    b = rows.select(block, *(F.col(c).alias(f"{c}_b") for c in cols))
    return a.join(b, block).where("name_a < name_b").withColumn("reason", F.lit(reason)).drop(block)


def _first_reason(pairs: list[DataFrame]) -> DataFrame:
    out = pairs[0].select("name_a", "name_b", F.lit(0).alias("rank"), "reason")
    for i, p in enumerate(pairs[1:], 1):
        out = out.union(p.select("name_a", "name_b", F.lit(i).alias("rank"), "reason"))
    return out.groupBy("name_a", "name_b").agg(F.min(F.struct("rank", "reason"))["reason"].alias("reason"))


def author_suggestions(names: DataFrame, least: float = AUTHORS_ALIKE, block_cap: int = 300) -> DataFrame:
    """(name_a, name_b, reason): romanisation, order of words, or spelling; names of one identity key aside."""
    n = mapped(names.select("name").where("name is not null").distinct(), "name", key=T.name_key, roman=T.romaji_key, folded=T.fold)
    n = n.withColumn("tokens", T.sorted_tokens(F.col("folded"))).withColumn("start", F.left("roman", F.lit(3)))
    cols = ["name", "key", "roman"]
    distinct_keys = "key_a != key_b"
    roman = _pairs(n.withColumn("block", F.col("roman")), "block", cols, "romanisation").where(distinct_keys)
    order = _pairs(n.where("tokens != ''").withColumn("block", F.col("tokens")), "block", cols, "order of words").where(distinct_keys)
    small = n.where(F.length("roman") >= 5).join(n.where(F.length("roman") >= 5).groupBy("start").count().where(F.col("count") <= block_cap).select("start"), "start")
    fuzzy = _pairs(small, "start", cols, "spelling").where(distinct_keys)
    fuzzy = fuzzy.where(T.tokens_align(F.col("name_a"), F.col("name_b")))
    fuzzy = fuzzy.where((T.similarity(F.col("roman_a"), F.col("roman_b")) >= least) | (T.similarity(F.col("name_a"), F.col("name_b")) >= least))
    return _first_reason([roman, order, fuzzy])


def _unmatched(total: Column, least: float) -> Column:
    """Letters of two names without a partner, at most, of this many letters together."""
    u = F.floor((1 - least) * total + 1e-9)
    return F.greatest(u - (total - u) % 2, F.lit(0))


def _rare_letters(names: DataFrame, least: float) -> DataFrame:
    """(token, name, key, words): every name under its rarest letter pairs, as many as names alike cannot all differ in.

    names: name, key, words. Names with m letters in matching blocks and u without a partner share m - u - 1
    letter pairs (m letters, where that leaves none), the second "an" of a name being another pair than the first.
    Of t tokens, c of them shared, one of the t - c + 1 first in any order of tokens is shared; that of rarity
    keeps blocks small.
    """
    n, count = F.length("words"), F.col("count")
    totals = F.sequence(F.floor(n * 2 / (2 - least)), F.ceil(n * 2 / least))

    def first(size: int) -> Column:
        def of(total: Column) -> Column:
            u = _unmatched(total, least)
            m = (total - u) / 2
            by_pairs = m - u - 1 >= 1
            return F.when(by_pairs if size == 2 else ~by_pairs, n - size + 2 - (m - (u + 1) * (size - 1)))

        return F.array_max(F.transform(totals, of)).cast("int")

    kinds = F.explode(F.array(*(F.struct(F.lit(size).alias("size"), first(size).alias("first")) for size in (1, 2))))
    rows = names.select("name", "key", "words", "one", "two", kinds.alias("k")).select("*", "k.*").drop("k").where((F.col("first") > 0) & (n >= F.col("size")))
    at = rows.select("name", "words", "size", F.explode(F.sequence(F.lit(1), n - F.col("size") + 1)).alias("i"))
    tokens = at.groupBy("name", "size", F.substr("words", F.col("i"), F.col("size")).alias("letters")).count()
    tokens = written(tokens.select("name", "size", F.explode(F.transform(F.sequence(F.lit(1), count), lambda k: F.concat(k.cast("string"), F.lit("|"), F.col("letters")))).alias("token")), "tokens")
    order = Window.partitionBy("name", "size").orderBy("count", "token")
    ranked = tokens.join(tokens.groupBy("size", "token").count(), ["size", "token"]).withColumn("rank", F.row_number().over(order))
    return written(ranked.join(rows, ["name", "size"]).where("rank <= first").select(F.concat_ws("|", "size", "token").alias("token"), "name", "key", "words", "one", "two"), "rare")


def publisher_suggestions(books: DataFrame, least: float = PUBLISHERS_ALIKE) -> DataFrame:
    """(name_a, name_b, reason) of winners of different keys: one key begins the other, or the names are alike.

    Every key is looked up among the beginnings of longer ones. Names alike meet by a rare letter pair,
    and are compared if their letters, in any order, differ by no more than the likeness allows.
    """
    g = publisher_groups(books).where("name = winner").select("name", "key")
    shorter = g.where(F.length("key") >= 5).select("key", F.col("name").alias("short"))
    longer = g.where(F.length("key") > 5).select(F.col("name").alias("long"), F.explode(F.transform(F.sequence(F.lit(5), F.length("key") - 1), lambda i: F.left("key", i))).alias("key"))
    prefix = longer.join(shorter, "key").select(F.least("short", "long").alias("name_a"), F.greatest("short", "long").alias("name_b"), F.lit("beginning").alias("reason"))
    named = mapped(g, "name", words=T.words_key).withColumn("bits", T.letter_bits(F.col("words"))).select("name", "key", "words", "bits.*").where("words != ''")
    unmatched = _unmatched(F.length("words_a") + F.length("words_b"), least)
    near = _pairs(_rare_letters(named, least), "token", ["name", "key", "words", "one", "two"], "likeness").where("key_a != key_b")
    near = near.where(F.bit_count(F.col("one_a").bitwiseXOR(F.col("one_b"))) + F.bit_count(F.col("two_a").bitwiseXOR(F.col("two_b"))) <= unmatched)
    near = near.where(F.levenshtein("words_a", "words_b") <= unmatched).select("name_a", "name_b", "reason").distinct()
    near = near.where(T.similarity(F.col("name_a"), F.col("name_b")) >= least)
    return _first_reason([prefix, near])


def series_suggestions(books: DataFrame, least: float = SERIES_ALIKE) -> DataFrame:
    """(name_a, name_b, reason) of series of the same numbering: romanisation, or likeness within the first four letters."""
    from biblioflow.plans.series import series_key

    n = mapped(books.where("series is not null and series != ''").select(F.col("series").alias("name")).distinct(), "name", roman=T.romaji_key, key=series_key, numbers=T.numbering)
    roman = _pairs(n.withColumn("block", F.concat_ws("|", "roman", "numbers")), "block", ["name", "key"], "romanisation")
    near = _pairs(n.withColumn("block", F.concat_ws("|", F.left("key", F.lit(4)), "numbers")), "block", ["name", "key"], "likeness").where("key_a != key_b")
    near = near.where(T.similarity(F.col("name_a"), F.col("name_b")) >= least)
    return _first_reason([roman, near])


def person_votes(votes: DataFrame) -> DataFrame:
    """(book_id, person): the one person with two sources, or the only person named with an exact title.

    votes: book_id, source, name, exact.
    """
    v = mapped(votes, "name", words=T.words_key).withColumn("key", T.person_key(F.col("words"))).where("key != ''")
    k = v.groupBy("book_id", "key").agg(F.count_distinct("source").alias("sources"), F.max(F.col("exact").cast("int")).alias("exact"), F.min("name").alias("name"))
    b = k.groupBy("book_id").agg(F.count("*").alias("keys"), F.sum((F.col("sources") >= 2).cast("int")).alias("strong"), F.max_by("name", F.struct("sources", "name")).alias("best"), F.max("exact").alias("exact"))
    return b.select("book_id", F.when(F.col("strong") == 1, F.col("best")).when((F.col("keys") == 1) & (F.col("exact") == 1), F.col("best")).alias("person")).where("person is not null")


def best_hits(hits: DataFrame, least: Column | float) -> DataFrame:
    """Catalogue hits whose title or main title, without the edition, is alike enough. hits: query, title, main_title."""
    s = F.greatest(T.similarity(F.col("query"), T.without_edition(F.col("title"))), T.similarity(F.col("query"), T.without_edition(F.coalesce("main_title", F.lit("")))))
    return hits.withColumn("score", s).where(F.col("score") >= least)
