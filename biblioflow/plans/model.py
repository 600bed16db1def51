"""The loaded form of a library, from its normalised tables or from the loaded table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Result:
    """What a pass gives: the books after it, its changes, and items for review."""

    books: DataFrame
    changes: DataFrame | None = None
    review: DataFrame | None = None
    flags: DataFrame | None = None  # of the series pass: id, accepted, withheld


def author_lists(links: DataFrame, authors: DataFrame) -> DataFrame:
    """(id, authors): names in the order of their links, repeated links once, a stored pipe as a comma."""
    once = links.groupBy("book", "author").agg(F.min("id").alias("at"))
    named = once.join(authors.select(F.col("id").alias("author"), F.replace("name", F.lit("|"), F.lit(",")).alias("name")), "author")
    return named.groupBy(F.col("book").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("authors"))


def sort_maps(links: DataFrame, authors: DataFrame) -> DataFrame:
    """(id, author_sorts): name to sort form of every book's authors; of equal names the last link counts."""
    named = links.select("book", "author", F.col("id").alias("at")).join(authors.select(F.col("id").alias("author"), F.replace("name", F.lit("|"), F.lit(",")).alias("name"), "author_sort", "id"), "author")
    last = named.groupBy("book", "name").agg(F.max_by("author_sort", F.struct("at", "id")).alias("author_sort"))
    return last.groupBy(F.col("book").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("name", "author_sort"))).alias("author_sorts"))


def valued_map(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(id, map) of rows of a book; the last row of a key wins."""
    last = rows.groupBy("book", key).agg(F.max_by(value, order).alias("v"))
    return last.groupBy(F.col("book").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "v")))).alias("entries"))


def loaded(books: DataFrame) -> DataFrame:
    """Books with the defaults of loading: "" for missing texts, index 1 for a missing or zero one, empty lists and maps."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    index = F.when(F.col("series_index").isNull() | (F.col("series_index") == 0), 1.0).otherwise(F.col("series_index"))
    return books.select(
        "id", "path", F.coalesce("has_cover", F.lit(False)).alias("has_cover"), text("title"), _array("authors"), "author_sorts", text("author_sort"), _array("tags"),
        F.nullif("series", F.lit("")).alias("series"), index.alias("series_index"), F.nullif("publisher", F.lit("")).alias("publisher"),
        F.coalesce("identifiers", F.create_map().cast("map<string,string>")).alias("identifiers"), _array("languages"), text("comments"), text("pubdate"), "formats", "booktype", "metadata_status",
    )


def _array(c: str) -> Column:
    return F.coalesce(c, F.array().cast("array<string>")).alias(c)


def custom_columns(books: DataFrame, columns: list[str]) -> DataFrame:
    """(id, label, value): the custom columns as rows."""
    each = F.array(*(F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in columns))
    return books.select("id", F.explode(each).alias("x")).select("id", "x.label", "x.value").where("value is not null and value != ''")


def pivoted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of custom columns as one column each; missing ones are NULL, of several values the greatest counts."""
    return rows.groupBy("id").pivot("label", columns).agg(F.max("value"))
