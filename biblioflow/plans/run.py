"""A run: the chosen passes in their one order, each on the books of the one before."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioflow.operators.duplicates import duplicate_review
from biblioflow.plans.cleaning import author_sort_pass, authors_pass, publishers_pass, tag_backfill_pass, tags_pass
from biblioflow.plans.model import Result
from biblioflow.plans.online import classify_pass, covers_pass, fetch_pass, junk_authors_pass, series_lookup_pass
from biblioflow.plans.series import series_pass, titles_pass
from biblioflow.session import written
from biblioflow.sources.files import checked


@dataclass
class Answers:
    """What services and files say, as tables; a pass whose answers are missing leaves the books as they are."""

    votes: DataFrame | None = None
    catalogue: DataFrame | None = None
    series_hits: DataFrame | None = None
    candidates: DataFrame | None = None
    fallback: DataFrame | None = None
    errors: DataFrame | None = None
    probes: DataFrame | None = None
    covers: DataFrame | None = None
    pictures: DataFrame | None = None
    files: DataFrame | None = None
    publisher_lists: dict[str, list[str]] = field(default_factory=dict)
    aliases: dict[str, dict[str, str]] = field(default_factory=dict)


@dataclass
class State:
    """What a pass leaves for later ones beside the books."""

    answers: Answers
    flags: DataFrame | None = None


def _series(books: DataFrame, s: State) -> Result:
    result = series_pass(books, aliases=s.answers.aliases.get("series"))
    s.flags = written(result.flags, "flags")
    return result


def _files(books: DataFrame, s: State) -> Result:
    none = books.where("formats is null or size(formats) = 0").select(F.lit("no-files").alias("category"), F.col("id").alias("book_id"))
    bad = checked(s.answers.files).select(F.concat(F.lit("file-"), "problem").alias("category"), "book_id") if s.answers.files is not None else none.limit(0)
    return Result(books, None, none.union(bad))


def _duplicates(books: DataFrame, s: State) -> Result:
    return Result(books, None, duplicate_review(books).select("category", F.explode("ids").alias("book_id")))


def _given(name: str, run: Callable[[DataFrame, State], Result]) -> Callable[[DataFrame, State], Result]:
    return lambda b, s: run(b, s) if getattr(s.answers, name) is not None else Result(b)


PASSES: dict[str, Callable[[DataFrame, State], Result]] = {
    "tags": lambda b, s: tags_pass(b),
    "publishers": lambda b, s: publishers_pass(b, s.answers.aliases.get("publishers")),
    "junk_authors": _given("votes", lambda b, s: junk_authors_pass(b, s.answers.votes)),
    "authors": lambda b, s: authors_pass(b, s.answers.aliases.get("authors")),
    "author_sort": lambda b, s: author_sort_pass(b),
    "series": _series,
    "titles": lambda b, s: titles_pass(b, s.flags),
    "classify": _given("catalogue", lambda b, s: classify_pass(b, s.answers.catalogue, s.answers.publisher_lists, s.answers.probes)),
    "series_lookup": _given("series_hits", lambda b, s: series_lookup_pass(b, s.answers.series_hits, s.flags)),
    "fetch": _given("candidates", lambda b, s: fetch_pass(b, s.answers.candidates, flags=s.flags, fallback=s.answers.fallback, errors=s.answers.errors, probes=s.answers.probes, aliases=s.answers.aliases.get("publishers"))),
    "covers": _given("covers", lambda b, s: covers_pass(b, s.answers.covers, s.answers.pictures)),
    "tag_backfill": lambda b, s: tag_backfill_pass(b),
    "files": _files,
    "duplicates": _duplicates,
}
# Passes of the presets; passes whose dry runs show a few books only, and how many.
PRESETS = {"all": list(PASSES), "offline": ["tags", "publishers", "authors", "author_sort", "series", "titles", "tag_backfill", "files", "duplicates"]}
PREVIEWED, PREVIEW = ["junk_authors", "classify", "series_lookup", "fetch", "covers"], 10


def chosen(names: list[str], skip: list[str] = ()) -> list[str]:
    """Passes by name or preset, always in the order of PASSES."""
    wanted = {p for n in names for p in PRESETS.get(n, [n])}
    if unknown := wanted - set(PASSES):
        raise ValueError(f"no such pass: {sorted(unknown)}")
    return [p for p in PASSES if p in wanted and p not in skip]


def only_first(before: DataFrame, result: Result, most: int) -> Result:
    """A result of which only the first books by id that change are kept; the rest stay as before."""
    first = result.changes.select("book_id").distinct().orderBy("book_id").limit(most)
    ids = first.select(F.col("book_id").alias("id"))
    books = result.books.select(before.columns).join(ids, "id", "left_semi").unionByName(before.join(ids, "id", "left_anti"))
    return Result(books.select(before.columns), result.changes.join(first, "book_id", "left_semi"), result.review, result.flags)


def full_run(books: DataFrame, names: list[str], skip: list[str] = (), answers: Answers | None = None, limit: int | None = None, dry: bool = False, full_preview: bool = False) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(books, changes, review) after the passes. Books are written between passes: each reads the state of the one before many times.

    limit: books changed by each pass at most. dry: passes that ask services change PREVIEW
    books at most, unless full_preview.
    """
    columns, logs, reviews, state = books.columns, [], [], State(answers or Answers())
    for name in chosen(names, skip):
        result = PASSES[name](books, state)
        most = min([n for n in (limit, PREVIEW if dry and not full_preview and name in PREVIEWED else None) if n is not None], default=None)
        if result.changes is not None:
            result = only_first(books, result, most) if most is not None else result
            logs.append(written(result.changes, f"changes-{name}"))
            books = written(result.books.select(columns), f"books-{name}")
        if result.review is not None and {"category", "book_id"} <= set(result.review.columns):
            reviews.append(written(result.review.select("category", "book_id"), f"review-{name}"))
    union = lambda frames: reduce(DataFrame.union, frames) if frames else None
    return books, union(logs), union(reviews)


def run(books: DataFrame, names: list[str], skip: list[str] = (), answers: Answers | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(books, changes) after the passes."""
    return full_run(books, names, skip, answers)[:2]


def offline(books: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    return run(books, ["offline"])


def verified(before: DataFrame, after: DataFrame) -> bool:
    """Whether a run kept every book: as many rows, the same ids, the same columns."""
    return before.columns == after.columns and before.count() == after.count() and before.select("id").exceptAll(after.select("id")).isEmpty()
