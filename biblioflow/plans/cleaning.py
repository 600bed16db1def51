"""Passes over spellings: tags, publishers, authors, sort forms, and tags of a series.

Text rules run once per distinct string; results come back by a join on the string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biblioflow.functions import kernel as K
from biblioflow.functions import text as T
from biblioflow.operators.changes import changes
from biblioflow.plans.model import Result
from biblioflow.session import written

# Tags removed everywhere; variants and the tag they stand for; tags not copied across a series.
JUNK_TAGS = ["-", "new subject", "general", "ebook", "e-book", "story", "fiction / general"]
SYNONYMS = {
    "light novel": "Light Novel", "light novels": "Light Novel", "ln": "Light Novel", "manga": "Manga", "ficion": "Fiction", "sci-fi": "Science Fiction", "scifi": "Science Fiction",
    "science-fiction": "Science Fiction", "soft sci-fi": "Soft Science Fiction", "young adult fiction": "Young Adult", "ya": "Young Adult", "lgbtq+": "LGBTQ+",
    "international crime & mystery": "International Mystery & Crime", "thrillers": "Thriller", "humour": "Humor", "comics & graphic novels": "Comics & Graphic Novels", "action & adventure - general": "Action & Adventure",
}
NEVER_COPIED = [
    "manga", "light novel", "other books", "graphic novel", "comics & graphic novels", "comic strips & cartoons", "east asian style", "general", "to-read", "read", "reading", "favorite", "favourite",
    "premium", "premium edition", "official translation", "metadata-fetched", "metadata-fetch-failed",
]


def mapped(df: DataFrame, col: str, **functions: Callable[[Column], Column]) -> DataFrame:
    """Columns computed once per distinct value of a column."""
    d = df.select(col).distinct()
    d = d.select(col, *(f(F.col(col)).alias(name) for name, f in functions.items()))
    return df.join(d, col, "left")


def lookup(spark, pairs: dict[str, str], key: str, value: str) -> DataFrame:
    """A small table of configured pairs, broadcast; its size is that of the configuration."""
    return F.broadcast(spark.createDataFrame([(K.fold(k), K.clean(v)) for k, v in pairs.items()] or [("", "")], f"{key} string, {value} string"))


def capitals(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"\P{Lu}", ""))


def preferred_casing(books: DataFrame) -> DataFrame:
    """(folded, preferred): the spelling in use most often of tags that fold alike; of equals the one with more capitals, then by name."""
    used = books.select(F.explode("tags").alias("raw")).where("raw is not null").groupBy("raw").count().select("raw", "count", T.clean_text(F.col("raw")).alias("tag"), T.fold(F.col("raw")).alias("folded"))
    counted = used.where("tag != ''").groupBy("folded", "tag").agg(F.sum("count").alias("n"))
    return counted.groupBy("folded").agg(F.min(F.struct((-F.col("n")).alias("n"), (-capitals(F.col("tag"))).alias("c"), "tag"))["tag"].alias("preferred"))


def expanded_tags(books: DataFrame) -> DataFrame:
    """(id, pos, sub, tag, folded): the tags that the stored ones stand for."""
    raw = books.select("id", F.posexplode("tags").alias("pos", "raw")).where("raw is not null")
    d = raw.select("raw").distinct().select("raw", F.posexplode(T.expand_tag(F.col("raw"))).alias("sub", "tag"))
    d = d.withColumn("folded", T.fold(F.col("tag")))
    return raw.join(d, "raw").select("id", "pos", "sub", "tag", "folded")


def normal_tags(books: DataFrame, library: DataFrame, junk: list[str] = JUNK_TAGS, synonyms: dict[str, str] = SYNONYMS, drop_authors: bool = True) -> DataFrame:
    """(id, new_tags): tags split, mapped to synonyms and the library's preferred casing, junk and own authors' names dropped, each once.

    books: id, tags, authors; a book of which no tag is left has no row.
    """
    spark = books.sparkSession
    tags = expanded_tags(books)
    junk_rows = lookup(spark, {j: j for j in junk}, "folded", "junk")
    names = mapped(books.select("id", F.explode("authors").alias("name")).where("name is not null").distinct(), "name", folded=T.fold).select("id", "folded").distinct()
    tags = tags.join(junk_rows, "folded", "left_anti")
    tags = tags.join(names, ["id", "folded"], "left_anti") if drop_authors else tags
    canon = tags.join(lookup(spark, synonyms, "folded", "synonym"), "folded", "left").join(preferred_casing(library), "folded", "left")
    canon = canon.select("id", "pos", "sub", F.coalesce("synonym", "preferred", "tag").alias("tag"))
    canon = mapped(canon, "tag", folded=T.fold).join(junk_rows, "folded", "left_anti")
    first = canon.groupBy("id", "folded").agg(F.min(F.struct("pos", "sub", "tag")).alias("x"))
    return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["tag"]).alias("new_tags"))


def tags_pass(books: DataFrame, junk: list[str] = JUNK_TAGS, synonyms: dict[str, str] = SYNONYMS, drop_authors: bool = True) -> Result:
    """Every book's tags in their normal form."""
    lists = normal_tags(books, books, junk, synonyms, drop_authors)
    after = books.join(lists, "id", "left").withColumn("tags", F.coalesce("new_tags", F.array().cast("array<string>"))).drop("new_tags")
    return Result(after, changes(books, after, ["tags"], "tags"))


def publisher_groups(books: DataFrame) -> DataFrame:
    """(name, n, key, winner): publishers' names by key; most books, then without a legal form, then the shorter, then by name."""
    counted = books.where("publisher is not null and publisher != ''").groupBy(F.col("publisher").alias("raw")).count().withColumn("name", T.clean_text(F.col("raw")))
    counted = written(counted.groupBy("name").agg(F.sum("count").alias("n")).withColumn("key", T.publisher_key(F.col("name"))).where("key != ''"), "publishers")
    rank = F.struct((-F.col("n")).alias("n"), F.col("name").rlike(T.LEGAL_END).alias("legal"), F.length("name").alias("len"), "name")
    return counted.join(counted.groupBy("key").agg(F.min(rank)["name"].alias("winner")), "key").select("name", "n", "key", "winner")


def canonical_publishers(books: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(name, canonical): alias, else the winner of the key, that by alias again."""
    spark = books.sparkSession
    alias = lookup(spark, aliases or {}, "folded", "alias")
    groups = publisher_groups(books).withColumn("folded", T.fold(F.col("name"))).join(alias, "folded", "left")
    target = groups.where("alias is not null").groupBy("key").agg(F.min("alias").alias("target"))
    return groups.join(target, "key", "left").select("name", F.coalesce("alias", "target", "winner").alias("canonical"))


def publishers_pass(books: DataFrame, aliases: dict[str, str] | None = None) -> Result:
    """Every book's publisher in its canonical form."""
    groups = canonical_publishers(books, aliases)
    # whole books meet only the few raw names that change
    raw = books.where("publisher is not null and publisher != ''").select("publisher").distinct().withColumn("name", T.clean_text(F.col("publisher")))
    target = raw.join(groups, "name").where("canonical != publisher").select("publisher", "canonical")
    after = books.join(target, "publisher", "left").withColumn("publisher", F.coalesce("canonical", "publisher")).select(books.columns)
    log = changes(books, after, ["publisher"], "publishers")
    return Result(after, log, log.groupBy("before", "after").agg(F.count("*").alias("books")))


def credited(books: DataFrame) -> DataFrame:
    """(id, pos, sub, raw, name): authors after splitting; dropped credits leave no row."""
    raw = books.select("id", F.posexplode("authors").alias("pos", "raw")).where("raw is not null")
    d = raw.select("raw").distinct().withColumn("s", T.split_author(F.col("raw"))).select("raw", F.posexplode("s.authors").alias("sub", "name"))
    return raw.join(d, "raw").select("id", "pos", "sub", "raw", "name")


def author_canon(names: DataFrame) -> DataFrame:
    """(name, n, key, winner): counted names by key; most books, with blanks, in mixed case, without a comma, by name."""
    counted = names.groupBy("name").agg(F.count("*").alias("n")).withColumn("key", T.name_key(F.col("name")))
    mixed = ~((F.upper("name") == F.col("name")) & (F.lower("name") != F.col("name"))) & ~((F.lower("name") == F.col("name")) & (F.upper("name") != F.col("name")))
    rank = F.struct((-F.col("n")).alias("n"), (~F.col("name").contains(" ")).alias("one"), (~mixed).alias("case"), F.col("name").contains(",").alias("comma"), "name")
    return counted.join(counted.groupBy("key").agg(F.min(rank)["name"].alias("winner")), "key").select("name", "n", "key", "winner")


def canonical_names(names: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(name, canonical, why): alias; else the existing name that "Last, First" turns into; else the winner of the key, that by alias again."""
    spark = names.sparkSession
    # one row a name: each rule runs once per distinct name without a join
    canon = author_canon(names).withColumn("clean", T.clean_text(F.col("name"))).withColumn("folded", T.fold(F.col("name"))).withColumn("turned", T.turned(F.col("clean")))
    canon = written(canon.withColumn("turned_key", T.name_key(F.col("turned"))), "names")
    by_key = canon.select(F.col("key").alias("turned_key"), F.col("winner").alias("existing")).distinct()
    alias = lookup(spark, aliases or {}, "folded", "alias")
    out = canon.join(by_key, "turned_key", "left").join(alias, "folded", "left")
    other = (F.col("turned") != "") & F.col("existing").isNotNull() & (F.col("turned_key") != F.col("key"))
    out = out.withColumn("chosen", F.coalesce("alias", F.when(other, F.col("existing")), "winner"))
    out = out.drop("folded", "alias").withColumn("folded", T.fold(F.col("chosen"))).join(alias, "folded", "left")
    why = F.when(F.col("alias").isNotNull(), "alias").when(other, "turned").when(F.col("chosen") != F.col("name"), "spelling")
    return out.select("name", "n", F.coalesce("alias", "chosen").alias("canonical"), why.alias("why"), F.when((F.col("turned") != "") & ~F.coalesce(other, F.lit(False)), F.col("turned")).alias("suggested"))


def existing_spelling(books: DataFrame, names: DataFrame) -> DataFrame:
    """(name, existing): the capitalisation in which a name stands in the library already, the first one by book and place."""
    first = books.select("id", F.posexplode("authors").alias("pos", "have")).where("have is not null").groupBy("have").agg(F.min(F.struct("id", "pos")).alias("at"))
    first = first.withColumn("folded", T.fold(F.col("have"))).groupBy("folded").agg(F.min_by("have", "at").alias("existing"))
    return names.withColumn("folded", T.fold(F.col("name"))).join(first, "folded").where("existing != name").select("name", "existing")


def authors_pass(books: DataFrame, aliases: dict[str, str] | None = None) -> Result:
    """Authors split, canonical, each key once per book; a book keeps its authors if none is left."""
    split = credited(books)
    canon = canonical_names(split.select("name"), aliases)
    kept = existing_spelling(books, canon.select(F.col("canonical").alias("name")).distinct())
    canon = canon.join(kept.withColumnRenamed("name", "canonical"), "canonical", "left").withColumn("canonical", F.coalesce("existing", "canonical")).drop("existing")
    canon = canon.withColumn("key", T.name_key(F.col("canonical")))
    rows = split.join(canon.select("name", "canonical", "key"), "name").select("id", "pos", "sub", F.col("canonical").alias("name"), "key")
    once = rows.groupBy("id", "key").agg(F.min(F.struct("pos", "sub", "name")).alias("x"))
    lists = once.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["name"]).alias("new"))
    after = books.join(lists, "id", "left").withColumn("authors", F.coalesce("new", "authors")).drop("new")
    return Result(after, changes(books, after, ["authors"], "authors"), canon.where("suggested is not null").select("name", "suggested"))


def wanted_sort(authors: Column, sorts: Column) -> Column:
    """The sort forms of all authors joined; NULL if one is not known."""
    forms = F.transform(authors, lambda a: F.nullif(F.regexp_replace(sorts[a], r"(?U)^\s+|\s+$", ""), F.lit("")))
    return F.when((F.size(authors) > 0) & ~F.exists(forms, lambda f: f.isNull()), F.array_join(forms, " & "))


def author_sort_pass(books: DataFrame) -> Result:
    after = books.withColumn("author_sort", F.coalesce(wanted_sort(F.col("authors"), F.col("author_sorts")), "author_sort"))
    return Result(after, changes(books, after, ["author_sort"], "author_sort"))


def consensus_tags(books: DataFrame, never: list[str] = NEVER_COPIED) -> DataFrame:
    """(series, folded, tag): tags that all tagged volumes of a series have, of at least two, in the first one's spelling."""
    spark = books.sparkSession
    rows = mapped(books.where("series is not null and series != '' and size(tags) > 0").select("series", "id", F.posexplode("tags").alias("pos", "tag")).where("tag is not null"), "tag", folded=T.fold)
    voters = rows.groupBy("series").agg(F.count_distinct("id").alias("voters"))
    tags = rows.groupBy("series", "folded").agg(F.count_distinct("id").alias("n"), F.min_by("tag", F.struct("id", "pos")).alias("tag"))
    kept = tags.join(voters, "series").where("n = voters and voters >= 2")
    return kept.join(lookup(spark, {n: n for n in never}, "folded", "x"), "folded", "left_anti").select("series", "folded", "tag")


def tag_backfill_pass(books: DataFrame) -> Result:
    """Tags that a series agrees on, added to its volumes that lack them."""
    wanted = consensus_tags(books)
    have = mapped(books.select("id", "series", F.explode("tags").alias("tag")).where("tag is not null"), "tag", folded=T.fold).select("id", "folded").distinct()
    add = books.select("id", "series").join(wanted, "series").join(have, ["id", "folded"], "left_anti")
    lists = add.groupBy("id").agg(F.array_sort(F.collect_list("tag")).alias("more"))
    after = books.join(lists, "id", "left").withColumn("tags", F.concat(F.col("tags"), F.coalesce("more", F.array().cast("array<string>")))).drop("more")
    return Result(after, changes(books, after, ["tags"], "tag_backfill"))


def limited(log: DataFrame, most: int) -> DataFrame:
    """The changes of the first books of every pass, in the order of ids."""
    first = log.select("made_by", "book_id").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("made_by").orderBy("book_id"))).where(F.col("rn") <= most)
    return log.join(first.drop("rn"), ["made_by", "book_id"], "left_semi")
