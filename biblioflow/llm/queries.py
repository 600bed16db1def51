"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.llm import canon as cn
from biblioflow.llm import lookalikes as lk
from biblioflow.llm import matching as ma
from biblioflow.llm import mixing as mx
from biblioflow.llm import packing as pk
from biblioflow.llm import people as pe
from biblioflow.llm import spans as sp
from biblioflow.llm import survivors as sv
from biblioflow.llm import tokens as tk
from biblioflow.session import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


P1_FIELDS = ["comments", "identifiers", "pubdate", "publisher"]


def _p1_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sv.survivors(table(spark, sf_dir, "books"), sv.groups_of(table(spark, sf_dir, "review")), P1_FIELDS)


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member of each duplicate group whose value of each field survives."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.id").alias("book_id")) for f in P1_FIELDS)))
    return _p1_best(spark, sf_dir).select("group_id", each.alias("x")).select("group_id", "x.*").where("book_id is not null").distinct()


@query("p1_golden_records")
def p1_golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record per group: each field's value and the record it came from."""
    return _p1_best(spark, sf_dir).select("group_key", "group_id", *(c for f in P1_FIELDS for c in (F.col(f"{f}.value").alias(f), F.col(f"{f}.id").alias(f"{f}_from"))))


def _p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "books")
    fields = F.array(F.struct(F.lit("title").alias("field_name"), F.array("title").alias("texts")), F.struct(F.lit("series").alias("field_name"), F.array("series").alias("texts")), F.struct(F.lit("authors").alias("field_name"), F.col("authors").alias("texts")))
    return books.select("id", F.explode(fields).alias("f")).select(F.col("f.field_name"), "id", F.explode("f.texts").alias("text")).where("text is not null")


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of books with titles, series or author names that look the same but differ in code points."""
    return lk.same_look_pairs(_p3_values(spark, sf_dir)).select("field_name", F.col("id_1").alias("book_id_1"), F.col("id_2").alias("book_id_2"))


@query("p3_forms")
def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every title, series and author name."""
    return lk.forms(_p3_values(spark, sf_dir))


@query("p3_classes")
def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that look like differently spelt ones: their common form, and how many values of other books do."""
    return lk.look_classes(_p3_values(spark, sf_dir))


def _p2_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"publisher": "publishers", "tag": "tags"}
    one = [table(spark, sf_dir, t).select(F.lit(kind).alias("kind"), F.col("id").alias("row_id"), "name") for kind, t in kinds.items()]
    return one[0].union(one[1])


def _p2_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _p2_names(spark, sf_dir)
    found = cn.map_to_terms(names, table(spark, sf_dir, "canon_terms"))
    return names.join(found, ["kind", "name"], "left").select(F.col("kind").alias("field_name"), "row_id", "name", F.coalesce("term_id", F.lit(0)).alias("term_id"))


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of the reference list that each publisher name and tag means, or 0."""
    return _p2_mapped(spark, sf_dir).select("field_name", "row_id", "term_id")


@query("p2_unmatched")
def p2_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that mean no entry, with the number of rows that hold them."""
    return _p2_mapped(spark, sf_dir).where("term_id = 0").groupBy("field_name", "name").agg(F.count("*").alias("row_count"))


@query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that share an unbroken run of 200 code points."""
    return sp.shared_pairs(sp.repeated(table(spark, sf_dir, "documents")))


@query("p9_shared_parts")
def p9_shared_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document's text stands word for word in other documents."""
    docs = table(spark, sf_dir, "documents")
    return sp.shared_lengths(docs, sp.repeated(docs))


@query("p9_links")
def p9_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that shares a run: the class of its text, and how many documents share one with it."""
    return sp.link_counts(table(spark, sf_dir, "documents"))


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of author rows that mean the same person or body."""
    return pe.linked_pairs(table(spark, sf_dir, "authors")).select(F.col("id_1").alias("author_id_1"), F.col("id_2").alias("author_id_2"))


@query("p5_entities")
def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person or body that each author row means."""
    return pe.linked(table(spark, sf_dir, "authors"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their size in tokens, written once."""
    return written(table(spark, sf_dir, "documents").select("doc_id", "source", tk.token_count(F.col("text")).alias("tokens")), "sized")


@query("p7_containers")
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container of every capacity."""
    return pk.packed(_sized(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


@query("p7_fill")
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return pk.fill_report(p7_containers(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


@query("p8_selection")
def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of documents in the order of their virtual finish times, up to the budget."""
    return mx.mixed(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")).select("doc_id", "source", "copy", "tokens", "finish").orderBy("finish", "source", "doc_id", "copy")


@query("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return mx.share_report(mx.mixed(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")), table(spark, sf_dir, "mix_targets"))


@query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book that each fetched record describes."""
    return p6_matches(spark, sf_dir).select("book_id", "meta_id")


@query("p6_matches")
def p6_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book that each fetched record describes, with cosine and confidence."""
    return ma.matches(table(spark, sf_dir, "books"), table(spark, sf_dir, "fetched_meta"))
