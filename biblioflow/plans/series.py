"""Series and volumes: candidates from titles, acceptance, names, collisions, gaps, titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biblioflow.functions import kernel as K
from biblioflow.functions import text as T
from biblioflow.operators.changes import changes
from biblioflow.plans.cleaning import capitals, lookup, mapped
from biblioflow.plans.model import Result
from biblioflow.session import written

# Names never taken from titles; the least length of a key; the least number of sibling numbers.
BLOCKED = ["another", "untitled", "complete"]
LEAST_KEY = 4
LEAST_SIBLINGS = 2
GAPS_SHOWN = 30


def series_key(x):
    return T.series_key(T.words_key(x))


def parsed(books: DataFrame, publishers: list[str] = (), junk_words=T.TT.JUNK_WORDS) -> DataFrame:
    """Books with the struct column parsed; each distinct title is read once.

    publishers: names of configured lists. They and the library's own names are known: of
    every title only what stands in brackets is looked up among them, by a join.
    """
    spark, b = books.sparkSession, books.withColumn("title", F.coalesce("title", F.lit("")))
    titles = b.select("title").distinct()
    inside = titles.where(F.col("title").rlike(r"[(\[]")).select("title", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit(r"[(\[]([^()\[\]]*)"), F.lit(1)))).alias("name"))
    inside = inside.withColumn("folded", T.fold(F.col("name"))).where("folded != ''")
    known = spark.createDataFrame([(p,) for p in publishers], "name string")
    if "publisher" in books.columns:
        known = known.union(books.select("publisher").where("publisher is not null").distinct())
    known = known.select(T.fold(F.col("name")).alias("folded")).distinct()
    found = inside.join(known, "folded", "left_semi").groupBy("title").agg(F.collect_set("name").alias("known"))
    read = titles.join(found, "title", "left").select("title", T.parse_title(F.col("title"), F.col("known"), junk_words).alias("parsed"))
    read = written(read, "titles")  # read many times by later steps
    return b.join(read, "title", "left")


def gap_report(books: DataFrame, shown: int | None = None) -> DataFrame:
    """(series, volumes, last_volume, n_missing, missing): series of two or more volumes that lack some below the last one.

    shown: of the missing volumes the first so many only; n_missing counts them all.

    Volumes are whole numbers of 1 and above, cut off; series go by their exact name.
    """
    have = gap_ranges(books)
    last = lambda g: F.least(g["last"], g["first"] + (shown - 1)) if shown else g["last"]
    missing = F.flatten(F.transform("gaps", lambda g: F.sequence(g["first"], last(g))))
    missing = F.slice(missing, 1, shown) if shown else missing
    counted = F.aggregate("gaps", F.lit(0).cast("bigint"), lambda n, g: n + g["last"] - g["first"] + 1)
    return have.where(F.size("gaps") > 0).select("series", "volumes", "last_volume", counted.alias("n_missing"), missing.alias("missing"))


def gap_ranges(books: DataFrame) -> DataFrame:
    """(series, volumes, last_volume, gaps): gaps as ranges (first, last), so that one absurd index costs one row."""
    index = F.when(F.col("series_index").isNull() | (F.col("series_index") == 0), 1.0).otherwise(F.col("series_index"))
    have = books.where("series is not null and series != ''").select("series", F.floor(index).cast("bigint").alias("v")).where("v >= 1").distinct()
    before = F.coalesce(F.lag("v").over(Window.partitionBy("series").orderBy("v")), F.lit(0).cast("bigint"))
    gap = F.when(F.col("v") > before + 1, F.struct((before + 1).alias("first"), (F.col("v") - 1).alias("last")))
    rows = have.select("series", "v", gap.alias("gap"))
    return rows.groupBy("series").agg(F.count("*").alias("volumes"), F.max("v").alias("last_volume"), F.array_sort(F.collect_list("gap")).alias("gaps")).where("volumes >= 2")


def conflict_pairs(books: DataFrame) -> DataFrame:
    """(series, title_says, books): how often a series and the one that titles tell differ, most often first."""
    b = books if "parsed" in books.columns else parsed(books)
    cands = accepted(candidates(b), b)
    named = names(cands, b)
    plan = planned(b, cands, named).where("review = 'series-conflict'").select("id", "old_series")
    told = plan.join(cands.select("id", "name"), "id").groupBy(F.col("old_series").alias("series"), F.col("name").alias("title_says"))
    return told.agg(F.count("*").alias("books")).orderBy(F.desc("books"), "series", "title_says")


def candidates(books: DataFrame, blocked: list[str] = BLOCKED, least: int = LEAST_KEY) -> DataFrame:
    """(id, name, key, index, kind): series and volume that a parsed title puts forward."""
    c = books.where(F.col("parsed.kind").isin("explicit", "bare") & F.col("parsed.index").isNotNull() & F.col("parsed.series").isNotNull())
    c = c.select("id", F.col("parsed.series").alias("name"), F.col("parsed.index").alias("index"), F.col("parsed.kind").alias("kind"))
    c = mapped(c, "name", key=series_key)
    return c.where((F.length("key") >= least) & ~F.col("key").isin([K.compact(b) for b in blocked]))


def numbering_review(books: DataFrame) -> DataFrame:
    """(category, book_id): titles whose numbering gives no single index."""
    p = F.col("parsed")
    category = F.when(p["kind"] == "range", "omnibus").when(p["kind"].isin("complex", "explicit-unsafe"), "unusual-numbering").when(p["kind"].isin("explicit", "bare") & p["part"].isNotNull() & p["index"].isNull(), "part-volume")
    return books.select(category.alias("category"), F.col("id").alias("book_id")).where("category is not null")


def accepted(cands: DataFrame, books: DataFrame, siblings: int = LEAST_SIBLINGS) -> DataFrame:
    """Candidates whose numbers are volumes: explicit ones, and bare ones of a key with an explicit one, an existing series, or enough different numbers."""
    existing = mapped(books.where("series is not null").select("series").distinct(), "series", key=series_key).select("key").distinct()
    evidence = cands.groupBy("key").agg(F.max((F.col("kind") != "bare").cast("int")).alias("sure"), F.count_distinct(T.slot(F.col("index"))).alias("numbers"))
    by_key = evidence.join(existing.withColumn("existing", F.lit(True)), "key", "left").where((F.col("sure") == 1) | (F.col("numbers") >= siblings) | F.col("existing"))
    return cands.join(by_key.select("key"), "key", "left_semi")


def names(cands: DataFrame, books: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(key, name, weight): the name of each key by vote; a title counts two, a book of the series one. Aliases come first."""
    spark = books.sparkSession
    old = mapped(books.where("series is not null").select(F.col("series").alias("name")), "name", key=series_key).select("key", "name", F.lit(1).alias("w"))
    votes = cands.select("key", "name", F.lit(2).alias("w")).union(old).groupBy("key", "name").agg(F.sum("w").alias("weight"))
    votes = mapped(votes, "name", folded=T.fold).join(lookup(spark, aliases or {}, "folded", "alias"), "folded", "left")
    best = votes.groupBy("key").agg(F.min(F.struct(F.col("alias").isNull().alias("plain"), (-F.col("weight")).alias("w"), (-capitals(F.col("name"))).alias("c"), F.coalesce("alias", "name").alias("name"))).alias("x"))
    return best.select("key", "x.name", (-F.col("x.w")).alias("weight"))


def planned(books: DataFrame, cands: DataFrame, named: DataFrame, fix_index: bool = False) -> DataFrame:
    """(id, old_series, old_index, series, index, kind, review): what every book's series becomes.

    An existing series is never moved: a different key of an explicit title is reported, a
    different index is reported or, if wanted, corrected; a different spelling is merged.
    """
    b = mapped(books.select("id", F.col("series").alias("old_series"), F.col("series_index").alias("old_index")), "old_series", old_key=series_key)
    c = cands.join(named.select("key", F.col("name").alias("canonical")), "key").select("id", F.col("key").alias("new_key"), "canonical", F.col("index").alias("new_index"), "kind")
    own = named.select(F.col("key").alias("old_key"), F.col("name").alias("own_name"))
    j = b.join(c, "id", "left").join(own, "old_key", "left")
    has = F.col("old_series").isNotNull()
    agrees = F.col("new_key") == F.col("old_key")
    differs = has & agrees & (F.abs(F.col("new_index") - F.col("old_index")) > 1e-9)
    review = F.when(has & F.col("new_key").isNotNull() & ~agrees & (F.col("kind") != "bare"), "series-conflict").when(differs & F.lit(not fix_index), "index-mismatch")
    series = F.when(has, F.coalesce("own_name", "old_series")).otherwise(F.col("canonical"))
    index = F.when(has & ~(differs & F.lit(fix_index)), F.col("old_index")).otherwise(F.col("new_index"))
    return j.select("id", "old_series", "old_index", series.alias("series"), index.alias("index"), "kind", F.coalesce("old_key", "new_key").alias("key"), review.alias("review"))


def collisions(plan: DataFrame, books: DataFrame) -> DataFrame:
    """(id, key, slot, members, withheld, category): books that share a volume of a series after planning.

    duplicate: equal titles, or titles of the series with at most one subtitle; else ambiguous.
    New assignments among them are withheld; existing ones stay.
    """
    p = plan.where("series is not null and index is not null").withColumn("slot", T.slot(F.col("index")))
    t = mapped(books.select("id", "title", F.col("parsed.series").alias("says"), F.col("parsed.subtitle").alias("subtitle")), "title", title_words=T.words_key)
    t = mapped(mapped(t, "says", says_key=series_key), "subtitle", sub_words=T.words_key)
    j = p.join(t.select("id", "title_words", "says", "says_key", "sub_words"), "id")
    g = j.groupBy("key", "slot").agg(
        F.count("*").alias("members"), F.count_distinct("title_words").alias("titles"), F.count_distinct(F.nullif("sub_words", F.lit(""))).alias("subs"),
        F.min(F.coalesce(F.col("says_key") == F.col("key"), F.lit(False)).cast("int")).alias("all_say"),
    ).where("members > 1")
    kind = F.when((F.col("titles") == 1) | ((F.col("all_say") == 1) & (F.col("subs") <= 1)), "duplicate").otherwise("ambiguous")
    return j.join(g, ["key", "slot"]).select("id", "key", "slot", "members", F.col("old_series").isNull().alias("withheld"), kind.alias("category"))


def series_pass(books: DataFrame, fix_index: bool = False, aliases: dict[str, str] | None = None) -> Result:
    """Series and indexes from titles, where nothing else holds the volume."""
    b = books if "parsed" in books.columns else parsed(books)
    cands = written(accepted(candidates(b), b), "candidates")
    plan = written(planned(b, cands, names(cands, b, aliases), fix_index), "plan")
    clash = written(collisions(plan, b), "collisions")
    free = plan.join(clash.where("withheld").select("id"), "id", "left_anti").where("series is not null")
    after = b.join(free.select("id", F.col("series").alias("s"), F.col("index").alias("i")), "id", "left").withColumn("series", F.coalesce("s", "series")).withColumn("series_index", F.coalesce("i", "series_index")).drop("s", "i")
    review = numbering_review(b).union(plan.where("review is not null").select(F.col("review"), "id")).union(clash.select(F.concat(F.lit("collision-"), "category"), "id"))
    # whose bare numbers are volumes: candidates that nothing keeps from their volume
    held = clash.groupBy("id").agg(F.max("withheld").alias("kept_out"))
    flags = plan.join(held, "id", "left").select("id", (F.col("kind").isNotNull() & ~F.coalesce("kept_out", F.lit(False))).alias("accepted"), F.col("kept_out").isNotNull().alias("withheld"))
    return Result(after, changes(b, after, ["series", "series_index"], "series"), review, flags)


def titles_pass(books: DataFrame, flags: DataFrame | None = None) -> Result:
    """Titles cleaned, and in one style where the volume is sure. A change of letter case only is not made.

    flags: of the series pass; a bare number is sure if it was accepted and names the book's series.
    """
    b = books if "parsed" in books.columns else parsed(books)
    p = F.col("parsed")
    sure = p["kind"] == "explicit"
    if flags is not None:
        b = mapped(mapped(b.withColumn("says", p["series"]), "says", says_key=series_key), "series", own_key=series_key)
        b = b.join(flags.select("id", "accepted"), "id", "left")
        sure = sure | ((p["kind"] == "bare") & F.coalesce("accepted", F.lit(False)) & F.col("series").isNotNull() & (F.col("says_key") == F.col("own_key")))
    new = F.when(F.coalesce(sure, F.lit(False)) & p["standard"].isNotNull(), p["standard"]).otherwise(p["cleaned"])
    n = mapped(mapped(b.withColumn("new", new), "new", new_fold=T.fold), "title", old_fold=T.fold)
    after = n.withColumn("title", F.when((F.col("new") != "") & (F.col("new_fold") != F.col("old_fold")), F.col("new")).otherwise(F.col("title"))).select(books.columns)
    return Result(after, changes(books, after, ["title"], "titles"))


def first_come(hits: DataFrame, taken: DataFrame) -> DataFrame:
    """(book_id, series, index, outcome): wanted volumes against the taken ones; of several books the lowest id gets a free one.

    hits: book_id, series, key, index. taken: key, index.
    """
    t = taken.select("key", T.slot(F.col("index")).alias("slot")).distinct().withColumn("held", F.lit(True))
    h = hits.withColumn("slot", T.slot(F.col("index"))).join(t, ["key", "slot"], "left")
    rank = F.row_number().over(Window.partitionBy("key", "slot").orderBy("book_id"))
    return h.withColumn("rn", rank).select("book_id", "series", "index", F.when(F.col("held"), "taken").when(F.col("rn") > 1, "lost").otherwise("assigned").alias("outcome"))
