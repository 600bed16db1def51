"""Passes over answers of services: junk authors, book types, series, candidate metadata, covers.

Answers come as tables (live sources fill them); nothing here calls a service.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflow.functions import text as T
from biblioflow.operators.changes import changes
from biblioflow.operators.linkage import best_hits, person_votes
from biblioflow.plans.candidates import adds_anything, filled, first_acceptable, gained, incomplete, judged, lacks_required, marked
from biblioflow.plans.cleaning import canonical_publishers, mapped, normal_tags
from biblioflow.plans.model import Result
from biblioflow.plans.series import first_come, parsed, series_key
from biblioflow.session import written
from biblioflow.sources.files import book_medium, without_cover

# Names that are no authors; least likeness of catalogue titles and of titles of series looked up.
JUNK_NAMES = ["admin", "unknown", "unknown author", "verypdf", "jpg to pdf converter", "calibre", "adobe acrobat", "microsoft word", "seven seas", "quantum ln", "various"]
CATALOGUE_ALIKE, SERIES_ALIKE, AUTHORS_ALIKE = 0.93, 0.92, 0.75
# Bytes of the smallest picture that counts as a cover; type tags.
LEAST_COVER = 1024
TYPE_LABELS = {"novel": "Light Novel", "manga": "Manga", "other": "Other Books"}


def junk_author_books(books: DataFrame, junk_names: list[str] = JUNK_NAMES) -> DataFrame:
    """(book_id, name, info): authors that are no persons and what their names tell."""
    n = books.select(F.col("id").alias("book_id"), F.explode("authors").alias("name")).where("name is not null")
    return mapped(n, "name", info=lambda x: T.junk_author_info(x, junk_names)).where("info.reason is not null")


def junk_authors_pass(books: DataFrame, votes: DataFrame, junk_names: list[str] = JUNK_NAMES) -> Result:
    """The first junk author replaced by the person that the votes settle on, other junk removed; a missing publisher taken from the file's name.

    votes: book_id, source, name, exact.
    """
    junk = junk_author_books(books, junk_names)
    per_book = junk.groupBy("book_id").agg(F.collect_set("name").alias("junk"), F.max("info.publisher").alias("hint"))
    b = books.join(per_book, books["id"] == per_book["book_id"], "left").drop("book_id")
    who = person_votes(votes.join(junk.select("book_id").distinct(), "book_id", "left_semi"))
    b = b.join(who, b["id"] == who["book_id"], "left").drop("book_id")
    first = F.array_min(F.transform("junk", lambda j: F.array_position("authors", j)))
    new = F.concat(F.slice("authors", F.lit(1), (first - 1).cast("int")), F.array("person"), F.filter(F.slice("authors", (first + 1).cast("int"), F.size("authors")), lambda a: ~F.array_contains("junk", a)))
    authors = F.when(F.col("person").isNotNull() & F.col("junk").isNotNull(), new).otherwise(F.col("authors"))
    after = b.withColumn("authors", F.array_distinct(authors)).withColumn("publisher", F.coalesce("publisher", "hint")).select(books.columns)
    return Result(after, changes(books, after, ["authors", "publisher"], "junk_authors"))


def catalogue_media(books: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, novel, comic, searched): media of confident catalogue hits. hits: query, title, main_title, medium; asked once per query."""
    q = books.select("id", F.coalesce("series", F.col("parsed.series"), F.col("parsed.cleaned"), "title").alias("query"))
    q = mapped(q, "query", asked_as=T.fold).select("id", F.col("asked_as").alias("query"))
    hits = mapped(hits, "query", asked_as=T.fold).drop("query").withColumnRenamed("asked_as", "query")
    best = best_hits(hits, CATALOGUE_ALIKE).groupBy("query").agg(F.max((F.col("medium") == "novel").cast("int")).alias("n"), F.max((F.col("medium") == "comic").cast("int")).alias("c"))
    asked = hits.select("query").distinct().withColumn("asked", F.lit(True))
    j = q.join(asked, "query", "left").join(best, "query", "left")
    flag = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return j.select("id", flag("n").alias("novel"), flag("c").alias("comic"), F.coalesce("asked", F.lit(False)).alias("searched"))


def classify_pass(books: DataFrame, hits: DataFrame, publishers: dict[str, list[str]], probes: DataFrame | None = None, again: bool = False) -> Result:
    """Book types from files, marker, tags, publisher and catalogue, and one type tag to mirror them.

    An existing type stays unless wanted again; a different decision is reported.
    """
    b = books if "parsed" in books.columns else parsed(books)
    b = mapped(b, "publisher", words=T.words_key).join(catalogue_media(b, hits), "id")
    b = b.join(probes.select("id", "medium"), "id", "left") if probes is not None else b.withColumn("medium", F.lit(None).cast("string"))
    d = T.decide_booktype(book_medium(F.col("formats"), F.col("medium")), F.col("parsed.marker"), T.tag_medium(F.col("tags")), T.publisher_class(F.col("words"), publishers), F.col("novel"), F.col("comic"), F.col("searched"))
    b = b.withColumn("d", d)
    old, new = F.nullif(F.col("booktype"), F.lit("")), F.col("d.decision")
    kind = F.when(old.isNotNull() & F.lit(not again), old).otherwise(F.coalesce(new, old))
    labels = F.create_map(*(F.lit(x) for kv in TYPE_LABELS.items() for x in kv))
    rest = F.filter("tags", lambda t: ~F.lower(t).isin([v.lower() for v in TYPE_LABELS.values()]))
    after = b.withColumn("booktype", kind).withColumn("tags", F.when(labels[F.col("booktype")].isNotNull(), F.concat(rest, F.array(labels[F.col("booktype")]))).otherwise(F.col("tags")))
    category = F.when(new.isNull(), "unclassified").when(old.isNotNull() & (old != new) & F.lit(not again), "classification-conflict")
    return Result(after.select(books.columns), changes(books, after, ["booktype", "tags"], "classify"), b.select(category.alias("category"), F.col("id").alias("book_id"), F.col("d.rule").alias("detail")).where("category is not null"))


def series_lookup_pass(books: DataFrame, hits: DataFrame, flags: DataFrame | None = None) -> Result:
    """Series of books that have none from the first hit with a like title, a series and a like author; taken volumes are reported.

    hits: book_id, rank, title, subtitle, authors, series, position. Books whose author is
    no person, and those the series pass withheld (flags), are not looked up.
    """
    b = books if "parsed" in books.columns else parsed(books)
    no_person = junk_author_books(b).select(F.col("book_id").alias("id"))
    free = b.join(no_person, "id", "left_anti")
    free = free.join(flags.where("withheld").select("id"), "id", "left_anti") if flags is not None else free
    todo = free.where("series is null").where(~F.coalesce(F.col("parsed.kind").isNotNull(), F.lit(False))).select(F.col("id").alias("book_id"), "title", F.col("authors").alias("own"))
    h = todo.join(hits.withColumnRenamed("title", "hit"), "book_id").where("series is not null and position is not null")
    whole = F.concat_ws(": ", "hit", F.nullif("subtitle", F.lit("")))
    h = h.where(F.greatest(T.similarity(F.col("title"), F.col("hit")), T.similarity(F.col("title"), whole)) >= SERIES_ALIKE)
    pairs = h.select("book_id", "rank", F.explode("own").alias("x"), "authors").select("book_id", "rank", "x", F.explode("authors").alias("y")).where(T.similarity(F.col("x"), F.col("y")) >= AUTHORS_ALIKE).select("book_id", "rank").distinct()
    first = h.join(pairs, ["book_id", "rank"]).groupBy("book_id").agg(F.min_by(F.struct("series", F.col("position").alias("index")), "rank").alias("s")).select("book_id", "s.*")
    taken = mapped(b.where("series is not null").select("series", F.col("series_index").alias("index")), "series", key=series_key)
    spelt = taken.groupBy("key").agg(F.min("series").alias("spelling"))
    got = first_come(mapped(first, "series", key=series_key), taken.select("key", "index"))
    named = mapped(got.where("outcome = 'assigned'"), "series", key=series_key).join(spelt, "key", "left").select(F.col("book_id").alias("id"), F.coalesce("spelling", "series").alias("s"), F.col("index").alias("i"))
    after = b.join(named, "id", "left").withColumn("series", F.coalesce("s", "series")).withColumn("series_index", F.coalesce("i", "series_index")).drop("s", "i")
    return Result(after.select(books.columns), changes(books, after, ["series", "series_index"], "series_lookup"), got.where("outcome != 'assigned'").select(F.lit("series-lookup-collision").alias("category"), "book_id"))


CANDIDATE_FIELDS = ["title", "authors", "tags", "publisher", "pubdate", "comments", "languages", "identifiers", "series", "series_index"]


def known_medium(booktype: Column, by_files: Column, marker: Column) -> Column:
    """comic or novel: by the type a book has already, else by its files, else by the marker of its title."""
    told = F.lower(booktype)
    typed = F.when(told == TYPE_LABELS["manga"].lower(), "comic").when(told.isin(TYPE_LABELS["novel"].lower(), TYPE_LABELS["other"].lower()), "novel")
    return F.coalesce(typed, by_files, F.when(marker == "manga", "comic").when(marker == "novel", "novel"))


def asked_pairs(books: DataFrame, candidates: DataFrame, flags: DataFrame | None = None, probes: DataFrame | None = None) -> DataFrame:
    """Books beside their candidates, as the gates want them. candidates: book_id, rank and the candidate's fields."""
    c = candidates.select("book_id", F.col("rank").alias("candidate_id"), "rank", *(F.col(f).alias(f"c_{f}") for f in CANDIDATE_FIELDS))
    b = books if "parsed" in books.columns else parsed(books)
    if flags is not None:
        b = b.join(flags.select("id", "accepted", "withheld"), "id", "left")
    else:
        b = b.withColumn("accepted", F.lit(False)).withColumn("withheld", F.lit(False))
    b = b.join(probes.select("id", "medium"), "id", "left") if probes is not None else b.withColumn("medium", F.lit(None).cast("string"))
    junk = junk_author_books(books).select(F.col("book_id").alias("id")).distinct().withColumn("junk", F.lit(True))
    b = b.join(junk, "id", "left")
    medium = known_medium(F.col("booktype"), book_medium(F.col("formats"), F.col("medium")), F.col("parsed.marker"))
    own = b.select(
        F.col("id").alias("book_id"), F.col("title").alias("b_title"), F.col("authors").alias("b_authors"), F.col("series").alias("b_series"), F.col("comments").alias("b_comments"), F.col("identifiers").alias("b_identifiers"),
        medium.alias("b_medium"), F.coalesce("accepted", F.lit(False)).alias("b_accepted"), F.coalesce("withheld", F.lit(False)).alias("b_withheld"), F.coalesce("junk", F.lit(False)).alias("b_junk"),
    )
    return written(own.join(c, "book_id"), "asked")


def fetch_pass(books: DataFrame, candidates: DataFrame, force: bool = False, flags: DataFrame | None = None, fallback: DataFrame | None = None, errors: DataFrame | None = None, probes: DataFrame | None = None, aliases: dict[str, str] | None = None) -> Result:
    """Incomplete books filled from their first acceptable candidate, with status and its tag.

    candidates: book_id, rank, and the candidate's fields. fallback: the same of a source
    asked last; its titles must be Latin instead of English, it must add something, and a
    book that still lacks a required field keeps no status, to be asked again. errors:
    book_id of books for which a source failed; without any answer they stay unmarked.
    """
    todo = incomplete(books, force)
    pairs = asked_pairs(todo, candidates, flags, probes)
    judgements = judged(pairs)
    chosen = first_acceptable(judgements).join(pairs, ["book_id", "candidate_id"]).withColumn("last_resort", F.lit(False))
    if fallback is not None:
        left = adds_anything(asked_pairs(todo.join(chosen.select(F.col("book_id").alias("id")), "id", "left_anti"), fallback, flags, probes)).where(T.latin(F.col("c_title")))
        more = judged(left, assume_english=True)
        chosen = chosen.unionByName(first_acceptable(more).join(left, ["book_id", "candidate_id"]).withColumn("last_resort", F.lit(True)))
        judgements = judgements.union(more)
    chosen, judgements = written(chosen, "chosen"), written(judgements, "judgements")
    # tags and publishers come in the library's own form
    tags = normal_tags(chosen.select(F.col("book_id").alias("id"), F.col("c_tags").alias("tags"), F.col("b_authors").alias("authors")), books)
    names = canonical_publishers(books, aliases).select(F.col("name").alias("c_publisher"), "canonical")
    c = chosen.withColumnRenamed("book_id", "id").join(tags, "id", "left").drop("c_tags").withColumn("c_tags", F.coalesce("new_tags", F.array().cast("array<string>")))
    c = c.join(names, "c_publisher", "left").withColumn("c_publisher", F.coalesce("canonical", "c_publisher"))
    new = filled(todo.join(c.select("id", *(f"c_{f}" for f in CANDIDATE_FIELDS)), "id"))
    gain = gained(chosen, books)
    fields = [x for x in new.columns if x != "id"]
    asked = judgements.select(F.col("book_id").alias("id")).distinct().withColumn("asked", F.lit(True))
    b = books.join(new.select("id", *(F.col(x).alias(f"n_{x}") for x in fields)), "id", "left").join(gain, "id", "left").join(asked, "id", "left")
    b = b.join(chosen.select(F.col("book_id").alias("id"), "last_resort"), "id", "left")
    if errors is not None:
        b = b.join(errors.select(F.col("book_id").alias("id")).distinct().withColumn("failed", F.lit(True)), "id", "left")
    found = F.col("last_resort").isNotNull()
    for x in fields:
        b = b.withColumn(x, F.when(found, F.col(f"n_{x}")).otherwise(F.col(x)))
    b = b.withColumn("title", F.coalesce("new_title", "title")).withColumn("series_index", F.coalesce("new_index", "series_index")).withColumn("series", F.coalesce("new_series", "series"))
    status = F.when(found & F.col("last_resort") & lacks_required(), None).when(found, "fetched").when(F.col("asked"), "failed")
    b = b.withColumn("status", status).withColumn("metadata_status", F.coalesce("status", "metadata_status")).withColumn("tags", F.when(F.col("status").isNotNull(), marked(F.col("tags"), F.col("status"))).otherwise(F.col("tags")))
    after = b.select(books.columns)
    return Result(after, changes(books, after, [*fields, "title", "series", "series_index", "metadata_status"], "fetch"), judgements)


def covers_pass(books: DataFrame, covers: DataFrame, pictures: DataFrame) -> Result:
    """Covers for books whose flag or file is missing: the first source by kind that has one; the rest are reported.

    covers: path of the files there are. pictures: id, source, path of pictures taken from
    the book's files or delivered by a source, with bytes; small ones do not count.
    """
    missing = without_cover(books, covers).select("id")
    rank = F.when(F.col("source") == "file", 0).otherwise(1)
    best = pictures.where(F.col("bytes") > LEAST_COVER).join(missing, "id", "left_semi").groupBy("id").agg(F.min_by(F.struct("source", "path"), F.struct(rank, "source", "path")).alias("x"))
    after = books.join(best, "id", "left").withColumn("has_cover", F.coalesce("has_cover", F.lit(False)) | F.col("x").isNotNull()).select(books.columns)
    log = best.select(F.col("id").alias("book_id"), F.lit("cover").alias("field"), F.lit("").alias("before"), F.col("x.path").alias("after"), F.lit("covers").alias("made_by"))
    return Result(after, log, missing.join(best, "id", "left_anti").select(F.lit("missing-cover").alias("category"), F.col("id").alias("book_id")))
