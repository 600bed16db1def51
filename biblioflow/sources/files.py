"""Probes of book files: contents of archives, damage, and covers. Paths are read where they are mounted."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflow.functions import text as T

# Endings of pictures and pages; the tail of a PDF that holds its end mark.
PICTURES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".avif")
PAGES = (".xhtml", ".html", ".htm")
PDF_HEAD, PDF_TAIL = 1024, 2048


def probe(path: str) -> tuple[bool, int, int, int, str | None]:
    """(ok, pictures, pages, bytes of pages, error) from an archive's directory alone."""
    try:
        with zipfile.ZipFile(path) as z:
            names = [(i.filename.lower(), i.file_size) for i in z.infolist()]
    except (OSError, zipfile.BadZipFile, ValueError) as e:
        return False, 0, 0, 0, type(e).__name__
    pages = [n for name, n in names if name.endswith(PAGES)]
    return True, sum(name.endswith(PICTURES) for name, _ in names), len(pages), sum(pages), None


def damage(path: str, kind: str, deep: bool = False) -> str | None:
    """What is wrong with a file, or None."""
    p, kind = Path(path), kind.upper()
    if not p.exists():
        return "missing"
    size = p.stat().st_size
    if size == 0:
        return "empty"
    try:
        if kind in ("EPUB", "KEPUB", "CBZ"):
            if not zipfile.is_zipfile(p):
                return "no archive"
            with zipfile.ZipFile(p) as z:
                names = z.namelist()
                if kind == "CBZ" and not any(n.lower().endswith(PICTURES[:5]) for n in names):
                    return "no pictures"
                if kind != "CBZ" and "META-INF/container.xml" not in names:
                    return "no container"
                if deep and (bad := z.testzip()):
                    return f"damaged member {bad}"
        elif kind == "PDF":
            with p.open("rb") as f:
                if b"%PDF-" not in f.read(PDF_HEAD):
                    return "no PDF"
                f.seek(max(0, size - PDF_TAIL))
                if deep and b"%%EOF" not in f.read():
                    return "cut off"
    except (OSError, zipfile.BadZipFile, ValueError, RuntimeError) as e:
        return f"unreadable {type(e).__name__}"
    return None


def probed(files: DataFrame) -> DataFrame:
    """(path, ok, images, html_files, text_bytes, error) of archives. files: path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *probe(p)) for p in b["path"]]
            yield pd.DataFrame(rows, columns=["path", "ok", "images", "html_files", "text_bytes", "error"])

    return files.select("path").mapInPandas(run, "path string, ok boolean, images int, html_files int, text_bytes bigint, error string")


def checked(files: DataFrame, deep: bool = False) -> DataFrame:
    """(book_id, path, fmt, problem) of damaged files. files: book_id, path, fmt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(problem=[damage(p, f or "", deep) for p, f in zip(b["path"], b["fmt"])])

    return files.select("book_id", "path", "fmt").mapInPandas(run, "book_id bigint, path string, fmt string, problem string").where("problem is not null")


def to_probe(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose path, size and time of change the cache does not hold."""
    return files.join(cache.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def entries_probe(entries: DataFrame) -> DataFrame:
    """(path, images, html_files, text_bytes) from a table of archive entries: path, name, size."""
    n = F.lower("name")
    any_of = lambda ends: F.greatest(*(n.endswith(e).cast("int") for e in ends)) == 1
    return entries.groupBy("path").agg(F.count_if(any_of(PICTURES)).alias("images"), F.count_if(any_of(PAGES)).alias("html_files"), F.sum(F.when(any_of(PAGES), F.col("size")).otherwise(0)).alias("text_bytes"))


def book_medium(formats: Column, probed_medium: Column) -> Column:
    """comic if all files are comics; else the first EPUB decides; else novel if there is any text format."""
    kinds = F.transform(formats, lambda f: F.upper(f["fmt"]))
    comic = (F.size(kinds) > 0) & (F.size(F.array_except(kinds, F.array(*map(F.lit, T.COMIC_FORMATS)))) == 0)
    epub = F.exists(kinds, lambda k: k.isin("EPUB", "KEPUB"))
    prose = F.arrays_overlap(kinds, F.array(*map(F.lit, T.TEXT_FORMATS)))
    return F.when(comic, "comic").when(epub, probed_medium).when(prose, "novel")


def without_cover(books: DataFrame, covers: DataFrame) -> DataFrame:
    """Books whose flag says so or whose file is not there. covers: path."""
    flagged = books.where(~F.coalesce("has_cover", F.lit(False)))
    return flagged.unionByName(books.where("has_cover").join(covers.select("path").distinct(), "path", "left_anti"))
