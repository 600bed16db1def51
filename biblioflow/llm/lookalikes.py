"""Text that looks the same but differs in its characters, brought to one form.

Each distinct text is exploded to positioned code points. One broadcast join brings the
decomposition (canonical, and of compatibility kinds that look the same), the combining
class and the look-alike of every code point; marks are ordered by class behind their
base, the pairs are composed again by a second broadcast join, and the text is rebuilt.
Both tables are derived from the Unicode data of Python; their size is fixed by it.

The form keeps what one can see: letter case, accents, spelling, width of a run of
blanks. Look-alike letters of other scripts come out as the Latin letter, so the form
is for comparison. Texts of plain ASCII are their own form and skip the explosion.

Defined results: NULL stays NULL and "" stays ""; a text of invisible characters only
comes out as "". A mark that cannot be composed stays behind its base in class order.
"""

from __future__ import annotations

import sys
import unicodedata as ud
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from biblioflow.session import written

# Letters of other scripts, and the Latin letters or marks that look the same.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "h", "Ӏ": "I", "Ԍ": "G", "а": "a", "е": "e", "о": "o",
    "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ү": "y", "ѵ": "v", "Ѵ": "V", "ԍ": "G",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϳ": "j", "Ϳ": "J", "ϲ": "c", "Ϲ": "C", "ɑ": "a",
    # Armenian, Latin letters of other alphabets
    "օ": "o", "Օ": "O", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "Տ": "S", "Լ": "L", "ɡ": "g", "ı": "i", "ꓲ": "I", "ǀ": "l",
    # marks
    "‐": "-", "‑": "-", "−": "-", "⁃": "-", "﹣": "-", "˗": "-", "՚": "'", "＇": "'", "ʼ": "'", "ʹ": "'", "’": "'", "‘": "'",
    "“": '"', "”": '"', "„": '"', "‚": ",", "٫": ",", "։": ":", "׃": ":", "ː": ":", "∶": ":", "꞉": ":", ";": ";", "·": "·", "∙": "·", "⋅": "·", "․": ".", "⁄": "/", "∕": "/",
}
# Compatibility kinds whose members look like what they decompose to.
SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
DIFFERENT_LOOK = "ſŀĿŉǄǅǆ¨¯´¸˘˙˚˛˜˝…‗‼⁇⁈⁉ϐϑϒϓϔϕϖϰϱϴϵ"
# Characters without a mark of their own beside those of category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ"
VISIBLE_FORMATS = "؀؁؂؃؄؅؜۝܏࢐࢑࣢"


def _invisible(c: str) -> bool:
    n = ord(c)
    return (ud.category(c) == "Cf" and c not in VISIBLE_FORMATS) or c in INVISIBLE or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF


def _decomposed(c: str) -> str:
    if _invisible(c):
        return ""
    if ud.category(c) == "Zs" or c in "\t\u0085":
        return " "
    d = ud.decomposition(c)
    if not d and not ("가" <= c <= "힣"):
        return LOOK_ALIKES.get(c, c)
    if "가" <= c <= "힣":
        return ud.normalize("NFD", c)
    kind, *rest = d.split() if d.startswith("<") else ("", *d.split())
    if kind and (kind not in SAME_LOOK or c in DIFFERENT_LOOK):
        return LOOK_ALIKES.get(c, c)
    return LOOK_ALIKES.get(c) or "".join(_decomposed(chr(int(x, 16))) for x in rest)


@lru_cache(1)
def code_point_rows() -> list[tuple[str, list[str], list[int]]]:
    """(code point, what it becomes, combining classes) of every code point that changes or combines."""
    rows = []
    for n in range(sys.maxunicode + 1):
        if 0xD800 <= n < 0xE000:
            continue
        c = chr(n)
        out = _decomposed(c)
        if out != c or ud.combining(c):
            rows.append((c, list(out), [ud.combining(x) for x in out]))
    return rows


@lru_cache(1)
def composition_rows() -> list[tuple[str, str]]:
    """(decomposed cluster, composed character) of every canonical composition, as they are after the look-alikes."""
    rows = {}
    for n in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= n < 0xE000:
            continue
        c = chr(n)
        full = ud.normalize("NFD", c)
        if full != c and ud.normalize("NFC", c) == c and c not in LOOK_ALIKES and _decomposed(full[0]) == full[0]:
            rows[full] = c
    return sorted(rows.items())


def code_points(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField("cp", T.StringType()), T.StructField("outs", T.ArrayType(T.StringType())), T.StructField("classes", T.ArrayType(T.IntegerType()))])
    return spark.createDataFrame(code_point_rows(), schema)


def compositions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(composition_rows(), "decomposed string, composed string")


def plain(x: Column) -> Column:
    """Whether a text is its own form: ASCII without control characters."""
    return x.rlike(r"\A[ -~]*\z")


def forms(texts: DataFrame, col: str = "text") -> DataFrame:
    """(text, form) of every distinct text of a column that is not NULL."""
    spark = texts.sparkSession
    distinct = texts.select(F.col(col).alias("text")).where("text is not null").distinct()
    cps = distinct.where(~plain(F.col("text"))).select("text", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)."), F.lit(0))).alias("pos", "cp"))
    mapped = cps.join(F.broadcast(code_points(spark)), "cp", "left").select(
        "text", "pos", F.posexplode(F.coalesce(F.arrays_zip(F.col("outs").alias("c"), F.col("classes").alias("k")), F.array(F.struct(F.col("cp").alias("c"), F.lit(0).alias("k"))))).alias("sub", "x")
    )
    order = Window.partitionBy("text").orderBy("pos", "sub")
    # a cluster is a base and the marks behind it; conjoining vowels and finals of Hangul go with their lead
    starts = (F.col("x.k") == 0) & ~F.col("x.c").rlike("[ᅡ-ᅵᆨ-ᇂ]")
    clusters = (
        mapped.withColumn("cluster", F.sum(starts.cast("int")).over(order))
        .groupBy("text", "cluster")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("x.k").alias("k"), "pos", "sub", F.col("x.c").alias("c")))).alias("cs"))
        .withColumn("whole", F.array_join(F.transform("cs", lambda e: e["c"]), ""))
        .withColumn("head", F.when(F.size("cs") > 2, F.array_join(F.transform(F.slice("cs", 1, 2), lambda e: e["c"]), "")))
    )
    pairs = F.broadcast(compositions(spark))
    done = (
        clusters.join(pairs.select(F.col("decomposed").alias("whole"), F.col("composed").alias("c1")), "whole", "left")
        .join(pairs.select(F.col("decomposed").alias("head"), F.col("composed").alias("c2")), "head", "left")
        .withColumn("out", F.coalesce("c1", F.concat("c2", F.expr("substring(whole, length(head) + 1)")), "whole"))
    )
    rebuilt = done.groupBy("text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "out"))), lambda e: e["out"]), "").alias("form"))
    # texts whose every code point is dropped have no row left
    odd = distinct.where(~plain(F.col("text"))).join(rebuilt, "text", "left").select("text", F.coalesce("form", F.lit("")).alias("form"))
    return distinct.where(plain(F.col("text"))).select("text", F.col("text").alias("form")).union(odd)


def same_look_pairs(values: DataFrame) -> DataFrame:
    """Pairs of ids whose texts of one field look the same but differ.

    values: field_name, id, text. Pairs are made between the few spellings of a form
    first and reach the ids by equi-joins; pairs of equal texts are never made.
    """
    v = values.where("text is not null and text != ''").distinct()
    form = written(forms(v), "forms")
    spelt = form.where("text != form").select("form").distinct()
    variants = written(form.join(spelt.hint("merge"), "form", "left_semi"), "variants")
    pairs = variants.select("form", F.col("text").alias("text_1")).join(variants.select("form", F.col("text").alias("text_2")).hint("merge"), "form").where("text_1 < text_2").drop("form")
    one = v.select("field_name", F.col("id").alias("a"), F.col("text").alias("text_1"))
    two = v.select("field_name", F.col("id").alias("b"), F.col("text").alias("text_2"))
    return (
        pairs.join(one.hint("merge"), "text_1").join(two.hint("merge"), ["field_name", "text_2"]).where("a != b")
        .select("field_name", F.least("a", "b").alias("id_1"), F.greatest("a", "b").alias("id_2"))
        .distinct()
    )


def look_classes(values: DataFrame) -> DataFrame:
    """(field_name, id, text, form, links) of values whose class has several spellings: how many values of other ids look the same but differ.

    One row per value; copies are counted, not made into pairs.
    """
    v = values.where("text is not null and text != ''").distinct()
    form = written(forms(v), "forms")
    spelt = form.groupBy("form").agg(F.count("*").alias("spellings")).where("spellings > 1").select("form")
    v = written(v.join(form.join(spelt.hint("merge"), "form", "left_semi").hint("merge"), "text"), "values")
    count = lambda *by: v.groupBy("field_name", *by).agg(F.count("*").alias("n_" + by[-1])).hint("merge")
    own = v.groupBy("field_name", "form", "id").agg(F.count("*").alias("n_own")).hint("merge")
    j = v.join(count("form"), ["field_name", "form"]).join(count("text"), ["field_name", "text"]).join(own, ["field_name", "form", "id"])
    return j.select("field_name", "id", "text", "form", (F.col("n_form") - F.col("n_text") - (F.col("n_own") - 1)).alias("links")).where("links > 0")
