"""The loaded form of a library from its normalised tables."""

from __future__ import annotations

import json
import shutil
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioflow.plans.model import author_lists, sort_maps, valued_map


def ordered(links: DataFrame, dim: DataFrame, key: str, value: str, order: str, out: str) -> DataFrame:
    """(id, list) of a dimension's values in the order of their links."""
    named = links.select("book", F.col(key).alias("k"), F.col(order).alias("at")).join(dim.select(F.col("id").alias("k"), F.col(value).alias("v")), "k")
    return named.groupBy(F.col("book").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(out))


def single(links: DataFrame, dim: DataFrame, key: str, out: str) -> DataFrame:
    """(id, value) of a dimension with one value per book; of several the last link counts."""
    named = links.select("book", F.col(key).alias("k")).join(dim.select(F.col("id").alias("k"), F.col("name").alias("v")), "k")
    return named.groupBy(F.col("book").alias("id")).agg(F.max_by("v", "k").alias(out))


def load(read: Callable[[str], DataFrame], custom: list[str] = ("booktype", "metadata_status")) -> DataFrame:
    """Books as one nested row each. read: table name to frame."""
    b = read("books").select("id", "path", (F.coalesce("has_cover", F.lit(0)) != 0).alias("has_cover"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("series_index", F.lit(0.0)).cast("double").alias("series_index"), F.coalesce("pubdate", F.lit("")).alias("pubdate"), F.coalesce("author_sort", F.lit("")).alias("author_sort"))
    b = b.withColumn("series_index", F.when(F.col("series_index") == 0, 1.0).otherwise(F.col("series_index")))
    authors = read("authors").withColumnRenamed("sort", "author_sort")
    formats = read("data").groupBy(F.col("book").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("format").alias("fmt"), "name", F.coalesce("uncompressed_size", F.lit(0)).cast("bigint").alias("size")))).alias("formats"))
    parts = [
        author_lists(read("books_authors_link"), authors), sort_maps(read("books_authors_link"), authors),
        ordered(read("books_tags_link"), read("tags"), "tag", "name", "id", "tags"), single(read("books_series_link"), read("series"), "series", "series"), single(read("books_publishers_link"), read("publishers"), "publisher", "publisher"),
        valued_map(read("identifiers"), "type", "val", "id").withColumnRenamed("entries", "identifiers"),
        ordered(read("books_languages_link"), read("languages"), "lang_code", "lang_code", "item_order", "languages"),
        read("comments").groupBy(F.col("book").alias("id")).agg(F.max("text").alias("comments")), formats,
    ]
    for p in parts:
        b = b.join(p, "id", "left")
    for label in custom:
        b = custom_column(b, read, label)
    for c in ("authors", "tags", "languages"):
        b = b.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return b.withColumn("comments", F.coalesce("comments", F.lit("")))


def catalog(columns: DataFrame) -> DataFrame:
    """Custom columns with the settings of their display; malformed settings are empty."""
    return columns.withColumn("display", F.from_json(F.coalesce("display", F.lit("{}")), "description string, enum_values array<string>"))


def custom_column(books: DataFrame, read: Callable[[str], DataFrame], label: str) -> DataFrame:
    """Books with the single-valued custom column of a label; NULL where there is none."""
    found = read("custom_columns").where((F.col("label") == label) & (F.coalesce("is_multiple", F.lit(0)) == 0)).select("id").limit(1).collect()
    if not found:
        return books.withColumn(label, F.lit(None).cast("string"))
    n = found[0]["id"]
    values = read(f"books_custom_column_{n}_link").join(read(f"custom_column_{n}").select(F.col("id").alias("value"), F.col("value").alias("v")), "value")
    return books.join(values.groupBy(F.col("book").alias("id")).agg(F.max("v").alias(label)), "id", "left")


def snapshot(path: str, folder: str, keep: int = 20) -> str:
    """A verified copy of a database file in a folder; only the newest copies stay (0: all)."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    number = max((int(p.stem.split("-")[-1]) for p in target.glob("snapshot-*.db")), default=0) + 1
    copy = target / f"snapshot-{number:06d}.db"
    shutil.copyfile(path, part := copy.with_suffix(".part"))
    if part.stat().st_size != Path(path).stat().st_size:
        raise OSError("the copy is not complete")
    part.rename(copy)
    if keep:
        for old in sorted(target.glob("snapshot-*.db"))[:-keep]:
            old.unlink()
    return str(copy)


def deep_merge(base: dict, over: dict) -> dict:
    """Settings with those of over on top: tables merge, other values replace."""
    return {**base, **{k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


def aliases(config: dict) -> dict[str, dict[str, str]]:
    """The alias maps of authors, publishers and series; all names have to be texts that are not empty."""
    out = {}
    for kind in ("authors", "publishers", "series"):
        pairs = config.get(kind, {})
        if not all(isinstance(x, str) and x.strip() for kv in pairs.items() for x in kv):
            raise ValueError(f"aliases of {kind}: {json.dumps(pairs)[:80]}")
        out[kind] = dict(pairs)
    return out
