"""Records that may be duplicates, by ISBN or by title and author, and equal texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioflow.functions import text as T
from biblioflow.plans.cleaning import mapped

ISBN_TYPES = ["isbn", "isbn10", "isbn13"]


def isbn_groups(books: DataFrame) -> DataFrame:
    """(isbn, ids): ISBNs on more than one book."""
    e = books.select("id", F.explode("identifiers").alias("type", "value")).where(F.lower("type").isin(ISBN_TYPES))
    d = F.regexp_replace("value", "[^0-9Xx]", "")
    return e.select(d.alias("isbn"), "id").where(F.length("isbn").isin(10, 13)).groupBy("isbn").agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)


def title_groups(books: DataFrame) -> DataFrame:
    """(title_key, author_key, kind, ids): books of equal title and first author, comics and texts apart."""
    kinds = F.transform("formats", lambda f: F.upper(f["fmt"]))
    comic = (F.size(kinds) > 0) & (F.size(F.array_except(kinds, F.array(F.lit("CBZ"), F.lit("CBR")))) == 0)
    b = books.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.get("authors", F.lit(0)), F.lit("")).alias("author"), F.when(comic, "comic").otherwise("text").alias("kind"))
    b = mapped(mapped(b, "title", title_key=T.words_key), "author", author_key=T.name_key)
    return b.groupBy("title_key", "author_key", "kind").agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)


def duplicate_review(books: DataFrame) -> DataFrame:
    """(category, key, ids): each set of books once, by ISBN before by title."""
    isbn = isbn_groups(books).select(F.lit(0).alias("rank"), F.lit("duplicate-isbn").alias("category"), F.col("isbn").alias("key"), "ids")
    title = title_groups(books).select(F.lit(1).alias("rank"), F.lit("duplicate-title").alias("category"), F.concat_ws("/", "title_key", "author_key", "kind").alias("key"), "ids")
    return isbn.union(title).groupBy("ids").agg(F.min(F.struct("rank", "category", "key")).alias("x")).select("x.category", "x.key", "ids")


def equal_texts(docs: DataFrame) -> DataFrame:
    """(text_hash, copies, first_id): texts that occur more than once; hashed before the shuffle."""
    return docs.where("text is not null").select(F.md5("text").alias("text_hash"), "doc_id").groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")
