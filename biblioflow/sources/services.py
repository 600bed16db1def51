"""Answers of metadata services, from caches of their JSON and XML; no network is used.

A live source is a mapInPandas over the requests that the cache does not answer.
"""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biblioflow.functions import text as T

CANDIDATE = "title string, authors array<string>, tags array<string>, publisher string, pubdate string, comments string, languages array<string>, identifiers map<string,string>, series string, series_index double"
# Schemes of identifiers that only mean the program itself; errors that are no "no result".
OWN_SCHEMES = {"calibre", "uuid"}
SOURCE_ERRORS = r"(?i)\b(?:429|50[0234]|timed? ?out|connection (?:reset|refused|aborted)|rate.?limit|too many requests|temporary failure)\b"


def read_package(xml: str | None) -> dict:
    """A candidate from the XML of an OPF package; empty fields where something is missing or broken."""
    out = {"title": None, "authors": [], "tags": [], "publisher": None, "pubdate": None, "comments": None, "languages": [], "identifiers": {}, "series": None, "series_index": None}
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return out
    single = {"title": "title", "publisher": "publisher", "date": "pubdate", "description": "comments"}
    for e in root.iter():
        name, text = e.tag.rpartition("}")[2], (e.text or "").strip()
        at = {k.rpartition("}")[2]: v for k, v in e.attrib.items()}
        if name in single and text and out[single[name]] is None:
            out[single[name]] = text
        elif name == "creator" and text and at.get("role", "aut") == "aut":
            out["authors"].append(text)
        elif name == "subject" and text:
            out["tags"].append(text)
        elif name == "language" and text:
            out["languages"].append(text)
        elif name == "identifier" and text and at.get("scheme", "").lower() not in OWN_SCHEMES | {""}:
            out["identifiers"][at["scheme"].lower()] = text
        elif name == "meta" and at.get("name", "").endswith(":series"):
            out["series"] = at.get("content") or None
        elif name == "meta" and at.get("name", "").endswith(":series_index"):
            try:
                out["series_index"] = float(at.get("content", ""))
            except ValueError:
                pass
    return out


def parse_package(xml: Column) -> Column:
    @F.pandas_udf(T.T.StructType.fromDDL(CANDIDATE))
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_package(x) for x in s], index=s.index)

    return run(F.coalesce(xml, F.lit("")))


def outcome(stdout: Column, stderr: Column) -> Column:
    """MATCH, NO_MATCH or ERROR of a fetch: nothing found but a source failed is an error, to be tried again."""
    found = F.coalesce(F.length(F.trim(stdout)) > 0, F.lit(False))
    return F.when(found, "MATCH").when(F.coalesce(stderr.rlike(SOURCE_ERRORS), F.lit(False)), "ERROR").otherwise("NO_MATCH")


def request_key(method: Column, url: Column, extra: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws("\n", method, url, F.coalesce(extra, F.lit("")), F.coalesce(body, F.lit(""))), 256)


def cached(cache: DataFrame, now: Column, days: int, key: list[str], at: str, tie: str) -> DataFrame:
    """The latest entry of every key that is not older than so many days."""
    fresh = cache.where(F.col(at) >= now - F.expr(f"interval {days} days"))
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(at), F.desc(tie)))
    return fresh.withColumn("rn", rn).where("rn = 1").drop("rn")


def not_cached(requests: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    return requests.join(cache.select(*key), key, "left_anti")


SERIES_ANSWER = "results array<struct<hit_title:string, record:struct<series_id:bigint, title:string, type:string, year:string>>>"
BOOKS_ANSWER = "data struct<search:struct<results:string>>"
HITS = "hits array<struct<document:struct<id:string, title:string, subtitle:string, author_names:array<string>, isbns:array<string>, description:string, featured_series:struct<position:string, series:struct<name:string>>, series_names:array<string>>>>"


def series_hits(answers: DataFrame, most: int = 25) -> DataFrame:
    """(query, rank, series_id, hit_title, title, medium) of cached searches for series. answers: query, body."""
    r = F.slice(F.from_json("body", SERIES_ANSWER)["results"], 1, most)
    e = answers.select("query", F.posexplode(r).alias("rank", "x"))
    return e.select("query", "rank", F.col("x.record.series_id").alias("series_id"), "x.hit_title", F.col("x.record.title").alias("title"), T.medium_of(F.col("x.record.type")).alias("medium"))


def series_authors(body: Column) -> Column:
    """Names of the persons whose part is author."""
    a = F.from_json(body, "authors array<struct<name:string, type:string>>")["authors"]
    return F.transform(F.filter(F.coalesce(a, F.array().cast("array<struct<name:string,type:string>>")), lambda x: F.lower(x["type"]) == "author"), lambda x: T.catalogue_author(x["name"]))


def book_hits(answers: DataFrame, most: int = 8) -> DataFrame:
    """(query, rank, id, title, subtitle, authors, isbn, series, position): the results may be JSON within JSON."""
    inner = F.from_json(F.coalesce(F.from_json("body", BOOKS_ANSWER)["data"]["search"]["results"], F.get_json_object("body", "$.data.search.results")), HITS)["hits"]
    e = answers.select("query", F.posexplode(F.slice(inner, 1, most)).alias("rank", "h")).select("query", "rank", "h.document.*")
    return e.select(
        "query", "rank", "id", "title", "subtitle", F.col("author_names").alias("authors"), F.get(F.filter("isbns", lambda x: F.length(x) == 13), F.lit(0)).alias("isbn"),
        F.coalesce(F.col("featured_series.series.name"), F.get("series_names", F.lit(0))).alias("series"), F.col("featured_series.position").try_cast("double").alias("position"),
    )
