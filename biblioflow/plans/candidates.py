"""Candidate metadata: gates in order, the first acceptable one, and what it fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflow.functions import text as T
from biblioflow.operators.changes import merged_identifiers
from biblioflow.plans.cleaning import mapped
from biblioflow.plans.series import first_come, series_key
from biblioflow.session import written

# Languages taken as English, least similarities, fields that a complete record has.
ENGLISH = ["eng", "en", "en-us", "en-gb"]
TITLES_ALIKE, AUTHORS_ALIKE, SERIES_ALIKE = 0.80, 0.75, 0.9
REQUIRED = ["comments", "publisher", "pubdate"]
TYPE_TAGS = ["light novel", "manga", "other books"]


def _blank(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) == ""


def lacks_required() -> Column:
    return _blank(F.col("comments")) | (F.coalesce("publisher", F.lit("")) == "") | T.undefined_date(F.col("pubdate"))


def incomplete(books: DataFrame, force: bool = False) -> DataFrame:
    """Books without a status (all if forced) that lack a required field."""
    return books.where(lacks_required() if force else lacks_required() & (F.coalesce("metadata_status", F.lit("")) == ""))


def author_likeness(pairs: DataFrame) -> DataFrame:
    """Pairs with author_sim, the best likeness of any two authors; the own ones also with their words reversed."""
    each = pairs.select("book_id", "candidate_id", F.explode("b_authors").alias("ours"), "c_authors").select("book_id", "candidate_id", "ours", F.explode("c_authors").alias("theirs"))
    d = each.select("ours", "theirs").distinct()
    back = F.array_join(F.reverse(F.split("ours", r"\s+")), " ")
    d = d.withColumn("s", F.greatest(T.similarity(F.col("ours"), F.col("theirs")), T.similarity(back, F.col("theirs"))))
    best = each.join(d, ["ours", "theirs"]).groupBy("book_id", "candidate_id").agg(F.max("s").alias("author_sim"))
    return pairs.join(best, ["book_id", "candidate_id"], "left").withColumn("author_sim", F.coalesce("author_sim", F.lit(0.0)))


def read_titles(pairs: DataFrame) -> DataFrame:
    """Pairs with both titles read (ours, theirs), keys of the series they tell, and our trusted volume.

    Trusted is an explicit volume, and a bare one that the series pass accepted (b_accepted)
    or that stands behind the name of the book's own series.
    """
    for c in ("b_accepted", "b_junk"):
        if c not in pairs.columns:
            pairs = pairs.withColumn(c, F.lit(False))
    p = written(pairs, "pairs")
    titles = p.select(F.col("c_title").alias("title")).union(p.select("b_title")).distinct()
    read = titles.select("title", T.parse_title(F.col("title")).alias("parsed"), T.words_key(F.col("title")).alias("words"))
    read = written(read.withColumn("series", F.col("parsed.series")).withColumn("key", series_key(F.col("parsed.series"))), "titles")
    side = lambda title, *names: read.select(F.col("title").alias(title), *(F.col(c).alias(n) for c, n in zip(("parsed", "words", "series", "key"), names)))
    keys = p.select("b_series").where("b_series is not null").distinct().withColumn("b_key", series_key(F.col("b_series")))
    p = p.join(side("c_title", "theirs", "their_words", "their_series", "their_key"), "c_title").join(side("b_title", "ours", "our_words", "our_series", "our_key"), "b_title").join(keys, "b_series", "left")
    o = F.col("ours")
    sure = (o["kind"] == "explicit") | ((o["kind"] == "bare") & (F.coalesce("b_accepted", F.lit(False)) | F.coalesce(F.col("b_series").isNotNull() & (F.col("b_key") == F.col("our_key")), F.lit(False))))
    return p.withColumn("our_volume", F.when(sure, o["volume"]))


def judged(pairs: DataFrame, assume_english: bool = False) -> DataFrame:
    """Pairs with reject_reason, NULL if acceptable: the first gate that fails.

    pairs: book_id, candidate_id, rank, b_title, b_authors, b_series, b_medium, c_title,
    c_authors, c_tags, c_languages, c_series_index; b_accepted and b_junk if known (a book
    whose author is no person skips the gate of authors). Cheap gates are settled before
    the likeness of texts is computed.
    """
    if "b_junk" not in pairs.columns:
        pairs = pairs.withColumn("b_junk", F.lit(False))
    lang = F.lower(F.get("c_languages", F.lit(0)))
    quick = F.when(~F.lit(assume_english) & ~F.coalesce(lang.isin(ENGLISH), F.lit(False)), "language").when(F.size(F.coalesce("c_authors", F.array().cast("array<string>"))) == 0, "no author")
    p = pairs.withColumn("quick", quick)
    out = p.where("quick is not null").select("book_id", "candidate_id", "rank", F.col("quick").alias("reject_reason"))
    rest = author_likeness(p.where("quick is null"))
    alike = (F.col("author_sim") >= AUTHORS_ALIKE) | F.coalesce("b_junk", F.lit(False))
    failed = rest.where(~alike).select("book_id", "candidate_id", "rank", F.lit("author").alias("reject_reason"))
    rest = read_titles(rest.where(alike).drop("author_sim"))
    o, t, medium = F.col("ours"), F.col("theirs"), F.coalesce("b_medium", F.lit(""))
    word = lambda c, w: F.concat(F.lit(" "), c, F.lit(" ")).contains(f" {w} ")
    tagged = F.exists("c_tags", lambda x: F.lower(x).isin("manga", "comics & graphic novels / manga")) & ~F.exists("c_tags", lambda x: F.lower(x).contains("light novel"))
    edition = (
        (F.coalesce(t["marker"] == "manga", F.lit(False)) & (medium != "comic")) | (F.coalesce(t["marker"] == "novel", F.lit(False)) & (medium == "comic"))
        | (word(F.col("their_words"), "manga") & ~word(F.col("our_words"), "manga") & (medium != "comic"))
        | (word(F.col("their_words"), "ranobe") & ~word(F.col("their_words"), "manga") & (medium == "comic"))
        | (F.coalesce(tagged, F.lit(False)) & (medium == "novel"))
    )
    title_sim = F.greatest(T.similarity(F.coalesce(o["series"], o["cleaned"]), F.coalesce(t["series"], t["cleaned"])), T.similarity(o["cleaned"], t["cleaned"]))
    ours_vol, their_vol = F.col("our_volume"), F.coalesce(t["volume"], F.col("c_series_index"))
    reason = (
        F.when(edition, "edition").when(F.col("title_sim") < TITLES_ALIKE, "title")
        .when(ours_vol.isNotNull() & their_vol.isNull(), "no volume").when(ours_vol.isNotNull() & (F.abs(their_vol - ours_vol) > 1e-9), "volume")
        .when(ours_vol.isNotNull() & ~t["part"].eqNullSafe(o["part"]), "part").when(ours_vol.isNull() & (t["kind"] == "explicit") & t["volume"].isNotNull(), "numbered")
    )
    settled = rest.withColumn("title_sim", title_sim).select("book_id", "candidate_id", "rank", reason.alias("reject_reason"))
    return out.union(failed).union(settled)


def first_acceptable(judgements: DataFrame) -> DataFrame:
    """(book_id, candidate_id): of each book's candidates the first in rank that no gate rejects."""
    return judgements.where("reject_reason is null").groupBy("book_id").agg(F.min_by("candidate_id", F.struct("rank", "candidate_id")).alias("candidate_id"))


def adds_anything(pairs: DataFrame) -> DataFrame:
    """Pairs whose candidate has comments, an identifier of another type or a series that the book lacks. pairs: b_ and c_ fields."""
    have = F.transform(F.map_keys(F.coalesce("b_identifiers", F.create_map().cast("map<string,string>"))), F.lower)
    more = F.exists(F.map_keys(F.coalesce("c_identifiers", F.create_map().cast("map<string,string>"))), lambda k: ~F.array_contains(have, F.lower(k)))
    series = ~_blank(F.col("c_series")) & F.col("c_series_index").isNotNull() & _blank(F.col("b_series"))
    return pairs.where((~_blank(F.col("c_comments")) & _blank(F.col("b_comments"))) | more | series)


def filled(pairs: DataFrame) -> DataFrame:
    """What a chosen candidate fills: empty publisher, comments, date and languages; tags and identifiers are added only.

    pairs: id and the book's fields, the candidate's with the prefix c_.
    """
    date = T.normalize_pubdate(F.col("c_pubdate"))
    none = F.array().cast("array<string>")
    more = T.lacking(F.concat(F.coalesce("tags", none), F.array(*map(F.lit, TYPE_TAGS))), T.each_once(F.coalesce("c_tags", none)))
    return pairs.select(
        "id",
        F.concat(F.coalesce("tags", none), more).alias("tags"),
        F.when(_blank(F.col("publisher")), F.coalesce("c_publisher", "publisher")).otherwise(F.col("publisher")).alias("publisher"),
        F.when(_blank(F.col("comments")), F.coalesce("c_comments", "comments")).otherwise(F.col("comments")).alias("comments"),
        F.when(T.undefined_date(F.col("pubdate")) & date.isNotNull(), date).otherwise(F.col("pubdate")).alias("pubdate"),
        F.when((F.size(F.coalesce("languages", none)) == 0) & (F.size(F.coalesce("c_languages", none)) > 0), F.array(F.lit("eng"))).otherwise(F.col("languages")).alias("languages"),
        merged_identifiers(F.col("identifiers"), F.col("c_identifiers")).alias("identifiers"),
    )


def gained(pairs: DataFrame, books: DataFrame) -> DataFrame:
    """(id, new_title, new_series, new_index): a title that gains a subtitle, a series for a book without one; NULL where nothing is gained.

    Both only where our trusted volume is the candidate's. pairs: as for judged(), with
    b_withheld and c_series; books: id, series, series_index, for the volumes taken. Of
    several books that want one free volume the lowest id gets it.
    """
    p = read_titles(pairs)
    o, t, volume = F.col("ours"), F.col("theirs"), F.col("our_volume")
    one_series = (F.col("our_key") == F.col("their_key")) | (T.similarity(F.col("their_series"), F.col("our_series")) >= SERIES_ALIKE)
    title = T.standard_title(F.coalesce("b_series", "our_series"), t["keyword"], t["volume"], t["part"], t["part_label"], t["subtitle"])
    p = p.withColumn("one_series", one_series).withColumn("proposed", F.when(t["kind"].isin("explicit", "bare"), title))
    p = mapped(p, "proposed", proposed_words=T.words_key).withColumn("series_sim", T.similarity(F.col("c_series"), F.col("our_series")))
    more = F.col("one_series") & (F.abs(t["volume"] - volume) < 1e-9) & t["subtitle"].isNotNull() & o["subtitle"].isNull() & (F.col("proposed_words") != F.col("our_words"))
    wants = F.col("b_series").isNull() & ~F.coalesce("b_withheld", F.lit(False)) & ~_blank(F.col("c_series")) & (F.abs(F.col("c_series_index") - volume) < 1e-9) & (F.col("series_sim") >= SERIES_ALIKE)
    p = p.select("book_id", F.when(more, F.col("proposed")).alias("new_title"), F.when(wants, F.col("c_series")).alias("new_series"), F.when(wants, F.col("c_series_index")).alias("new_index"))
    taken = mapped(books.where("series is not null").select("series", F.col("series_index").alias("index")), "series", key=series_key).select("key", "index")
    hits = mapped(p.where("new_series is not null").select("book_id", F.col("new_series").alias("series"), F.col("new_index").alias("index")), "series", key=series_key)
    free = first_come(hits, taken).where("outcome = 'assigned'").select("book_id", F.lit(True).alias("free"))
    p = p.join(free, "book_id", "left")
    return p.select(F.col("book_id").alias("id"), "new_title", F.when(F.col("free"), F.col("new_series")).alias("new_series"), F.when(F.col("free"), F.col("new_index")).alias("new_index"))


def marked(tags: Column, status: Column, fetched: str = "Metadata-Fetched", failed: str = "Metadata-Fetch-Failed") -> Column:
    """Tags with exactly one mark of the status."""
    rest = F.filter(tags, lambda t: ~F.lower(t).isin(fetched.lower(), failed.lower()))
    return F.concat(rest, F.array(F.when(status == "fetched", fetched).otherwise(failed)))
