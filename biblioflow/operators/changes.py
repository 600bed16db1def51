"""Equality of fields, change logs, sparse write operations, guarded writes and their undo.

All of it is joins on the id and native expressions; a table of operations is as long as
what changed. NULL and "" are equal where a field is text; a missing map or array is an
empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflow.functions.text import fold, one_blank, undefined_date

# Fields that may be written, in the order in which they are written.
WRITE_ORDER = ["tags", "series", "series_index", "publisher", "identifiers", "languages", "comments", "pubdate", "author_sort", "booktype", "metadata_status", "title", "authors"]
LISTS = {"tags", "authors", "languages"}


def _list(x: Column) -> Column:
    return F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), one_blank), lambda v: v != "")


def _index(x: Column) -> Column:
    return F.when(x.isNull() | (x == 0), F.lit(1.0)).otherwise(x)


def comparable(field: str, x: Column) -> Column:
    """A value as text that is equal exactly where the field's values count as equal."""
    if field == "tags":
        return F.to_json(F.array_sort(_list(x)))
    if field in LISTS:
        return F.to_json(_list(x))
    if field == "series_index":
        return F.format_string("%.9f", _index(x))
    if field == "identifiers":
        entries = F.transform(F.map_entries(F.coalesce(x, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("k"), F.coalesce(e["value"], F.lit("")).alias("v")))
        return F.to_json(F.array_sort(entries))
    if field == "pubdate":
        return F.when(undefined_date(x), "").otherwise(F.left(x, F.lit(10)))
    return F.coalesce(x.cast("string"), F.lit(""))


def same(field: str, a: Column, b: Column) -> Column:
    return comparable(field, a) == comparable(field, b)


def as_text(field: str, x: Column) -> Column:
    """A value as the text in which it is logged."""
    if field in LISTS or field == "identifiers":
        return F.to_json(x)
    return x.cast("string")


def changes(before: DataFrame, after: DataFrame, fields: list[str], made_by: str) -> DataFrame:
    """(book_id, field, before, after, made_by): one row per field that differs."""
    b, a = before.select("id", *(F.col(f).alias(f"b_{f}") for f in fields)), after.select("id", *(F.col(f).alias(f"a_{f}") for f in fields))
    each = F.array(*(F.when(~same(f, F.col(f"b_{f}"), F.col(f"a_{f}")), F.struct(F.lit(f).alias("field"), as_text(f, F.col(f"b_{f}")).alias("before"), as_text(f, F.col(f"a_{f}")).alias("after"))) for f in fields))
    return b.join(a, "id").select(F.col("id").alias("book_id"), F.explode(F.filter(each, lambda x: x.isNotNull())).alias("c")).select("book_id", "c.*", F.lit(made_by).alias("made_by"))


def operations(changed: DataFrame, strict: bool = False) -> DataFrame:
    """(book_id, fields, expect, strict): the changes of a book as one sparse write."""
    pair = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.coalesce(v, F.lit("")).alias("v")))))
    return changed.groupBy("book_id").agg(pair(F.col("after")).alias("fields"), pair(F.col("before")).alias("expect")).withColumn("strict", F.lit(strict))


def in_order(fields: Column) -> Column:
    """The fields of an operation in the order in which they are written."""
    last = len(WRITE_ORDER)
    place = F.create_map(*(F.lit(x) for i, f in enumerate(WRITE_ORDER) for x in (f, i)))
    entries = F.transform(F.map_entries(fields), lambda e: F.struct(F.coalesce(place[e["key"]], F.lit(last)).alias("at"), e["key"].alias("field"), e["value"].alias("value")))
    return F.transform(F.array_sort(entries), lambda e: F.struct(e["field"].alias("field"), e["value"].alias("value")))


def compare_and_set(ops: DataFrame, live: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """(book_id, status, actual, fields, expect, written): operations against the live state.

    live: book_id, state map<string,string>. missing: no such book; skipped: a field to be
    written holds something else than expected (compared when folded, exactly if strict);
    failed: an empty title or author list, or nothing could be written; partial: writing
    broke off after a field; applied otherwise. broken: book_id, field where writing broke
    off; fields are written in the order of WRITE_ORDER. written: what was written.
    """
    j = ops.join(live, "book_id", "left")
    at = lambda m, k: F.coalesce(m[k], F.lit(""))
    # values are folded once per pair, outside of the conditions
    pair = j.where("not strict").select("book_id", F.explode(F.map_keys("expect")).alias("k"), "expect", "state").select("book_id", at(F.col("expect"), F.col("k")).alias("e"), at(F.col("state"), F.col("k")).alias("s"))
    unlike = pair.where("e != s").where(fold(F.col("e")) != fold(F.col("s"))).select("book_id").distinct().withColumn("unlike", F.lit(True))
    exact = F.exists(F.map_keys("expect"), lambda k: at(F.col("expect"), k) != at(F.col("state"), k))
    j = j.join(unlike, "book_id", "left")
    differs = F.when(F.col("strict"), exact).otherwise(F.coalesce("unlike", F.lit(False)))
    empty = F.exists(F.map_entries("fields"), lambda e: e["key"].isin("title", "authors") & (F.coalesce(e["value"], F.lit("")).isin("", "[]")))
    j = j.join(broken.select("book_id", F.col("field").alias("stop")), "book_id", "left") if broken is not None else j.withColumn("stop", F.lit(None).cast("string"))
    names = F.transform(in_order(F.col("fields")), lambda e: e["field"])
    done = F.when(F.col("stop").isNull() | ~F.array_contains(names, F.col("stop")), names).otherwise(F.slice(names, F.lit(1), F.greatest(F.array_position(names, F.col("stop")) - 1, F.lit(0)).cast("int")))
    j = j.withColumn("done", done)
    status = (
        F.when(F.col("state").isNull(), "missing").when(differs, "skipped").when(empty, "failed")
        .when(F.size("done") == 0, "failed").when(F.size("done") < F.size("fields"), "partial").otherwise("applied")
    )
    j = j.withColumn("status", status)
    wrote = F.map_filter("fields", lambda k, _: F.col("status").isin("applied", "partial") & F.array_contains(F.col("done"), k))
    return j.select("book_id", "status", F.map_filter("state", lambda k, _: F.map_contains_key(F.col("expect"), k)).alias("actual"), "fields", "expect", wrote.alias("written"))


def folder_of(author: Column, title: Column, book_id: Column) -> Column:
    """The folder of a book: its first author, and its title with its id."""
    safe = lambda x: F.trim(F.regexp_replace(x, r'[\\/:*?"<>|]', "_"))
    return F.concat(safe(author), F.lit("/"), safe(title), F.lit(" ("), book_id.cast("string"), F.lit(")"))


def guarded(ops: DataFrame, books: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Operations with withheld (field to reason), title and authors taken out where writing them could lose files.

    Reasons: an author would change the capitalisation of one that stands in the library;
    the folder would change its capitalisation only; the new folder holds files already.
    books: id, title, authors, path. folders: path of folders that hold files.
    """
    renames = ops.where(F.map_contains_key("fields", F.lit("title")) | F.map_contains_key("fields", F.lit("authors"))).select("book_id", "fields")
    b = renames.join(books.select(F.col("id").alias("book_id"), "title", "authors", F.col("path").alias("old")), "book_id")
    b = b.withColumn("new_authors", F.from_json(F.col("fields")["authors"], "array<string>")).withColumn("names", F.coalesce("new_authors", "authors"))
    here = books.select(F.explode("authors").alias("have")).where("have is not null").distinct().withColumn("folded", fold(F.col("have"))).groupBy("folded").agg(F.collect_set("have").alias("spellings"))
    each = b.select("book_id", F.explode("new_authors").alias("name")).withColumn("folded", fold(F.col("name")))
    recased = each.join(here, "folded").where(~F.array_contains("spellings", F.col("name"))).groupBy("book_id").agg(F.min("name").alias("recased"))
    b = b.join(recased, "book_id", "left").withColumn("new", folder_of(F.get("names", F.lit(0)), F.coalesce(F.col("fields")["title"], F.col("title")), F.col("book_id")))
    if folders is not None:
        b = b.join(folders.select(F.col("path").alias("new")).distinct().withColumn("filled", F.lit(True)), "new", "left")
    else:
        b = b.withColumn("filled", F.lit(False))
    moves = (F.size("names") > 0) & (F.coalesce("old", F.lit("")) != "") & (F.col("new") != F.col("old"))
    reason = (
        F.when(F.col("recased").isNotNull(), "changes the capitalisation of an author")
        .when(moves & (F.lower("new") == F.lower("old")), "changes the capitalisation of a folder").when(moves & F.coalesce("filled", F.lit(False)), "the new folder holds files")
    )
    why = b.select("book_id", reason.alias("reason")).where("reason is not null")
    j = ops.join(why, "book_id", "left")
    held = lambda k: F.col("reason").isNotNull() & k.isin("title", "authors")
    rest = lambda m: F.map_filter(m, lambda k, _: ~held(k)).alias(m)
    withheld = F.transform_values(F.map_filter("fields", lambda k, _: held(k)), lambda k, _: F.col("reason"))
    return j.select("book_id", rest("fields"), rest("expect"), "strict", withheld.alias("withheld"))


def with_retries(ops: DataFrame, write: Callable[[DataFrame], DataFrame], most: int = 2) -> DataFrame:
    """The journal of a writer that may end early: operations without a record are given to it again, twice at most.

    write: from operations to records (book_id, status, ...) of those it reached; records
    have to be stored, since each round reads those of the one before.
    """
    journal = write(ops)
    for _ in range(most):
        rest = not_reached(ops, journal)
        if rest.isEmpty():
            break
        journal = journal.unionByName(write(rest))
    return journal


def kept(undone: DataFrame) -> DataFrame:
    """(book_id, fields_that_differ, value_now, value_that_run_left) of books that an undo left alone, as they were edited since."""
    j = undone.where("status = 'skipped'")
    differing = F.map_filter("expect", lambda k, v: F.coalesce(v, F.lit("")) != F.coalesce(F.col("actual")[k], F.lit("")))
    j = j.withColumn("differing", differing).withColumn("names", F.array_sort(F.map_keys("differing")))
    now = F.map_filter("actual", lambda k, _: F.array_contains(F.col("names"), k))
    return j.select("book_id", F.array_join("names", ", ").alias("fields_that_differ"), F.left(F.to_json(now), F.lit(2000)).alias("value_now"), F.left(F.to_json("differing"), F.lit(2000)).alias("value_that_run_left"))


def undo_operations(journal: DataFrame) -> DataFrame:
    """The strict operations that take a journal back, newest first.

    journal: seq, book_id, status, before and after as maps. Only applied and partial
    records that wrote something count.
    """
    j = journal.where(F.col("status").isin("applied", "partial") & (F.size("after") > 0))
    return j.select("seq", "book_id", F.col("before").alias("fields"), F.col("after").alias("expect"), F.lit(True).alias("strict")).orderBy(F.desc("seq"))


def not_reached(ops: DataFrame, journal: DataFrame) -> DataFrame:
    """Operations that no journal record answers, to be tried again."""
    return ops.join(journal.select("book_id"), "book_id", "left_anti")


def rolled_back(planned: DataFrame, journal: DataFrame) -> DataFrame:
    """Planned field values, those of writes that were not applied replaced by the actual ones."""
    j = journal.select("book_id", "status", "actual")
    return planned.join(j, "book_id", "left").select("book_id", F.when(F.col("status").isin("applied", "partial") | F.col("status").isNull(), F.col("fields")).otherwise(F.col("actual")).alias("fields"))


def merged_identifiers(old: Column, new: Column) -> Column:
    """Identifiers with those of types that are not there yet; letter case of types does not count."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    have = F.transform(F.map_keys(old), F.lower)
    return F.map_concat(old, F.map_filter(new, lambda k, _: ~F.array_contains(have, F.lower(k))))


def applied(books: DataFrame, writes: DataFrame) -> DataFrame:
    """Books after writes. writes: book_id and fields, a map from field to its value as it is logged."""
    kinds = dict(books.dtypes)

    def value(f: str) -> Column:
        x = F.col("fields")[f]
        if kinds[f].startswith(("array", "map")):
            return F.from_json(x, kinds[f])
        return F.nullif(x, F.lit("")).cast(kinds[f]) if kinds[f] != "string" or f in ("series", "publisher", "booktype", "metadata_status") else x

    j = books.join(writes.select(F.col("book_id").alias("id"), "fields"), "id", "left")
    here = lambda f: F.coalesce(F.map_contains_key("fields", F.lit(f)), F.lit(False))
    return j.select(*(F.when(here(c), value(c)).otherwise(F.col(c)).alias(c) if c in WRITE_ORDER else F.col(c) for c in books.columns))


def state_of(books: DataFrame) -> DataFrame:
    """(book_id, state): the writable fields of every book as they are logged."""
    fields = [f for f in WRITE_ORDER if f in books.columns]
    pairs = F.array(*(F.struct(F.lit(f).alias("k"), F.coalesce(as_text(f, F.col(f)), F.lit("")).alias("v")) for f in fields))
    return books.select(F.col("id").alias("book_id"), F.map_from_entries(pairs).alias("state"))
