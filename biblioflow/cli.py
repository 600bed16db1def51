"""The control surface: run passes over a library, undo a run, list runs, check a library, write settings.

A library is a folder with books.parquet; a run writes its new books, changes, review and
journal into runs/<id> beside it and replaces nothing: the newest run's books are the
library's state.
"""

from __future__ import annotations

import argparse
import json
import sys
import tomllib
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblioflow.operators.changes import applied, compare_and_set, kept, operations, state_of, undo_operations
from biblioflow.operators.report import summary
from biblioflow.plans.model import loaded
from biblioflow.plans.run import PRESETS, Answers, chosen, full_run, verified
from biblioflow.session import get_spark
from biblioflow.sources import journal

# What a command ends with.
OK, NOTHING, REFUSED, BROKEN, WRITER, PARTLY, STOPPED = 0, 1, 2, 3, 4, 5, 130
SETTINGS = """# aliases by kind: a variant and the name it stands for
[aliases.authors]
[aliases.publishers]
[aliases.series]

# publishers by the kind of books they publish
[publishers]
ln = []
manga = []
mixed = []
general = []
"""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="biblioflow")
    p.add_argument("--library", type=Path, default=Path("."))
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("passes", nargs="*", default=["offline"])
    run.add_argument("--skip", nargs="*", default=[])
    run.add_argument("--limit", type=int)
    run.add_argument("--dry-run", action="store_true")
    run.add_argument("--full-preview", action="store_true")
    undo = sub.add_parser("undo")
    undo.add_argument("run_id")
    undo.add_argument("--dry-run", action="store_true")
    for name in ("runs", "check", "init"):
        sub.add_parser(name)
    return p


def current(spark: SparkSession, library: Path) -> DataFrame:
    """The books of the newest run that wrote, else the library's own."""
    done = sorted(d for d in (library / "runs").glob("*") if (d / "books.parquet").exists() and (d / "meta.json").exists())
    return spark.read.parquet(str(done[-1] / "books.parquet")) if done else loaded(spark.read.parquet(str(library / "books.parquet")))


def settings(library: Path) -> Answers:
    path = library / "settings.toml"
    found = tomllib.loads(path.read_text()) if path.exists() else {}
    return Answers(publisher_lists=found.get("publishers", {}), aliases=found.get("aliases", {}))


def _write(spark: SparkSession, library: Path, kind: str, books: DataFrame, ops: DataFrame, dry: bool, passes: list[str]) -> tuple[Path, DataFrame, dict[str, int]]:
    """The folder of a run with its journal and, unless dry, the books after it."""
    folder = library / "runs" / datetime.now(UTC).strftime("%Y%m%dT%H%M%S%f")
    folder.mkdir(parents=True)
    records = compare_and_set(ops, state_of(books)).select(F.monotonically_increasing_id().alias("seq"), "book_id", "status", F.col("expect").alias("before"), F.col("written").alias("after"), "actual", F.col("expect").alias("expected"))
    journal.append(records, str(folder / "journal"))
    done = journal.read(spark, str(folder / "journal"), strict=True)
    counts = {r["status"]: r["count"] for r in done.groupBy("status").count().collect()}
    if not dry:
        applied(books, done.where(F.size("after") > 0).select("book_id", F.col("after").alias("fields"))).write.parquet(str(folder / "books.parquet"))
    meta = {"run_id": folder.name, "dry_run": dry, "status": kind, "passes": passes, "writes": counts}
    (folder / "meta.json").write_text(json.dumps(meta))
    return folder, done, counts


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return OK if e.code in (0, None) else REFUSED
    library = args.library
    if args.command == "init":
        path = library / "settings.toml"
        if path.exists():
            return REFUSED
        path.write_text(SETTINGS)
        return OK
    if args.command != "runs" and not (library / "books.parquet").exists():
        print("no books.parquet here", file=sys.stderr)
        return REFUSED
    spark = spark or get_spark("biblioflow")
    try:
        if args.command == "runs":
            rows = journal.runs(spark, str(library / "runs")).collect() if list(library.glob("runs/*/meta.json")) else []
            print("\n".join(f"{r['run_id']} {r['kind']} {r['status']} passes={r['passes']} written={r['written']}" for r in rows) or "no runs yet")
            return OK
        books = current(spark, library)
        if args.command == "check":
            same_ids = books.count() == books.select("id").distinct().count()
            print(f"{books.count()} books")
            return OK if same_ids else BROKEN
        if args.command == "run":
            try:
                passes, answers = chosen(args.passes, args.skip), settings(library)
            except (ValueError, tomllib.TOMLDecodeError) as e:
                print(f"{e}; presets: {', '.join(PRESETS)}", file=sys.stderr)
                return REFUSED
            after, log, review = full_run(books, passes, answers=answers, limit=args.limit, dry=args.dry_run, full_preview=args.full_preview)
            if not verified(books, after):
                return BROKEN
            # a field that several passes changed is written once: from its first value to its last
            net = log.groupBy("book_id", "field").agg(F.count("*").alias("n")).select("book_id", "field") if log is not None else spark.createDataFrame([], "book_id long, field string")
            pair = lambda df, name: df.select("book_id", F.explode("state").alias("field", name))
            net = net.join(pair(state_of(books), "before"), ["book_id", "field"]).join(pair(state_of(after), "after"), ["book_id", "field"]).where("before != after")
            folder, _, counts = _write(spark, library, "run", books, operations(net), args.dry_run, passes)
            if log is not None:
                summary(log).coalesce(1).write.json(str(folder / "summary"))
            if review is not None:
                review.write.json(str(folder / "review"))
            print(folder.name, counts)
            return WRITER if counts.get("failed") or counts.get("partial") else OK
        old = library / "runs" / args.run_id / "journal"
        if not old.exists():
            return NOTHING
        ops = undo_operations(journal.read(spark, str(old), strict=True)).select("book_id", "fields", "expect", "strict")
        folder, done, counts = _write(spark, library, "undo", books, ops, args.dry_run, [])
        kept(done.withColumnRenamed("expected", "expect")).write.option("header", True).csv(str(folder / "kept"))
        print(folder.name, counts)
        return PARTLY if counts.get("failed") or counts.get("partial") else OK
    except KeyboardInterrupt:
        return STOPPED


if __name__ == "__main__":
    sys.exit(main())
