"""Reports of a run: files of changes and reviews, summaries, and suggested aliases."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL = 500
ROWS_SHOWN = 3000


def cell(x: Column) -> Column:
    """A logged value as it is shown: lists joined, cut to the width of a cell."""
    text = F.coalesce(x, F.lit(""))
    listed = F.array_join(F.from_json(text, "array<string>"), ", ")
    return F.left(F.when(text.startswith("["), F.coalesce(listed, text)).otherwise(text), F.lit(CELL))


def change_rows(log: DataFrame, books: DataFrame) -> DataFrame:
    """Changes with the final title of their book."""
    return log.join(books.select(F.col("id").alias("book_id"), "title"), "book_id", "left").select("made_by", "book_id", "title", "field", cell(F.col("before")).alias("before"), cell(F.col("after")).alias("after"))


def review_rows(review: DataFrame) -> DataFrame:
    return review.select("category", F.array_join(F.transform("book_ids", lambda i: i.cast("string")), " ").alias("book_ids"), "detail")


def summary(log: DataFrame) -> DataFrame:
    """(made_by, changes, books) of every pass."""
    return log.groupBy("made_by").agg(F.count("*").alias("changes"), F.count_distinct("book_id").alias("books"))


def review_summary(review: DataFrame) -> DataFrame:
    """(category, items, books) of every review category."""
    items = review.groupBy("category").agg(F.count("*").alias("items"))
    books = review.select("category", F.explode_outer("book_ids").alias("id")).groupBy("category").agg(F.count_distinct("id").alias("books"))
    return items.join(books, "category")


def first_rows(rows: DataFrame, group: str, order: list[str], most: int = ROWS_SHOWN) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rn") <= most).drop("rn")


def page(rows: DataFrame, group: str, title: str = "Changes") -> str:
    """An HTML page of rows by group; bounded by first_rows()."""
    shown = rows.collect()
    sizes: dict[str, int] = {}
    for r in shown:
        sizes[r[group]] = sizes.get(r[group], 0) + 1
    names = [c for c in rows.columns if c != group]
    out = [f"<h1>{html.escape(title)}</h1>"]
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        out.append(f"<h2>{html.escape(str(g))} ({sizes[g]})</h2><table><tr>{''.join(f'<th>{n}</th>' for n in names)}</tr>")
        out += [f"<tr>{''.join(f'<td>{html.escape(str(r[n]))}</td>' for n in names)}</tr>" for r in shown if r[group] == g]
        out.append("</table>")
    return "\n".join(out)


def suggested_aliases(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(variant, keep, total): the name of more books is kept, the first of equals; most books first."""
    n = counts.select("name", "n")
    j = pairs.join(n.withColumnRenamed("name", "name_a").withColumnRenamed("n", "n_a"), "name_a", "left").join(n.withColumnRenamed("name", "name_b").withColumnRenamed("n", "n_b"), "name_b", "left").na.fill(0, ["n_a", "n_b"])
    left = F.col("n_a") >= F.col("n_b")
    return j.select(F.when(left, F.col("name_b")).otherwise(F.col("name_a")).alias("variant"), F.when(left, F.col("name_a")).otherwise(F.col("name_b")).alias("keep"), (F.col("n_a") + F.col("n_b")).alias("total")).orderBy(F.desc("total"), "keep", "variant")


def toml_lines(suggestions: DataFrame) -> DataFrame:
    """(at, line): every suggestion as a line of a settings file, all commented out; at: its place."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'([\\"])', r"\\$1"), F.lit('"'))
    line = F.concat(F.lit("# "), quote(F.col("variant")), F.lit(" = "), quote(F.col("keep")))
    return suggestions.select(F.struct((-F.col("total")).alias("n"), "keep", "variant").alias("at"), line.alias("line")).orderBy("at")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
