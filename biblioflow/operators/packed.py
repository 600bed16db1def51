"""Several values packed in one field: one row per value, position kept.

The text is split at its double quotes. Odd pieces are literals: every character
in them that could separate is mapped to a private-use stand-in. Even pieces keep
their delimiters. The pieces are joined again, the delimiters split the whole, and
the stand-ins are mapped back. All of it is built-in array expressions, so a row
never leaves the JVM and nothing is shuffled.

Defined results: NULL, empty and blank text give no values; empty values between
delimiters are dropped and not counted; repeated values keep their positions; an
unbalanced quote is ordinary text. Other columns of the input pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Delimiters of every kind of field, and stand-ins for protected marks.
MARKS = ",;|/&+\t\n\r·•、 #'\\"
STAND_INS = "".join(chr(0xE000 + i) for i in range(len(MARKS)))
COMMA = STAND_INS[MARKS.index(",")]
QUOTE = chr(0xE0F0)
EDGE = chr(0xE0F1)

# Words that join two names, additions to a name, words that announce values.
JOINING_WORDS = ["and", "et", "und", "with"]
ADDITIONS = ["Jr", "Sr", "II", "III", "IV", "PhD", "Ph.D", "MD", "M.D", "DPhil", "MBA", "Esq", "Ltd", "LLC", "Inc", "GmbH"]
ANNOUNCEMENTS = ["authors", "author", "written by", "by", "tags", "tag", "keywords", "keyword", "subjects", "subject", "genres", "genre"]

BLANKS = r"[\s\p{Z}]"


def _alternatives(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.").replace(" ", r"\s+") for w in words)


def protect(text: Column) -> Column:
    """The text with everything that quotes or backslashes protect behind stand-ins."""
    s = F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    # list notation: brackets around quoted values; its single quotes count as double ones
    s = F.when(s.rlike(r"^\[\s*'.*'\s*\]$"), F.regexp_replace(s, r"(?<=^\[|,)(\s*)'|'(?=\s*(?:,\s*'|\]$))", '$1"')).otherwise(s)
    s = F.when(s.rlike(r'^\[\s*".*"\s*\]$'), F.regexp_replace(s, r"^\[|\]$", "")).otherwise(s)
    for mark, stand_in in (*zip(MARKS, STAND_INS), ('"', QUOTE)):
        if mark in ',;|/&+"\\':
            s = F.regexp_replace(s, r"\\" + ("\\" + mark), stand_in)
    s = F.regexp_replace(s, r'(?<=[^\s,;|/\[])""|""(?=[^\s,;|/\]])', QUOTE)
    pieces = F.split(s, '"')
    n = F.size(pieces)

    def piece(x: Column, i: Column) -> Column:
        left, right = F.get(pieces, i - 1), F.get(pieces, i + 1)
        encloses = (
            (left.rlike(r"(?i)(^|[,;|/&+·•、\s\[]|\b(" + "|".join(JOINING_WORDS) + r"))\s*$"))
            & right.rlike(r"(?i)^\s*($|[,;|/&+·•、\]]|(" + "|".join(JOINING_WORDS) + r")\b)|^\s+$|^\s*$")
        )
        literal = F.concat(F.lit(EDGE), F.translate(x, MARKS, STAND_INS), F.lit(EDGE))
        return F.when(i % 2 == 0, x).when(i == n - 1, F.concat(F.lit(QUOTE), x)).when(encloses, literal).otherwise(F.concat(F.lit(QUOTE), x, F.lit(QUOTE)))

    return F.when(n == 1, s).otherwise(F.array_join(F.transform(pieces, piece), ""))


def _restore(x: Column) -> Column:
    x = F.translate(x, STAND_INS + QUOTE, MARKS + '"')
    return F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _values(parts: Column) -> Column:
    return F.filter(F.transform(parts, _restore), lambda x: x != "")


def _announced(s: Column) -> Column:
    return F.regexp_replace(s, r"(?i)^\s*(?:(?:" + _alternatives(ANNOUNCEMENTS) + r")\s*:|(?:written\s+)?by\s)\s*", "")


def split_names(text: Column) -> Column:
    """Array of the names packed in one text.

    A comma separates names only where every part around it has two words; else it
    stands inside "Surname, Forename", of which several may follow one another.
    """
    s = _announced(protect(text))
    s = F.regexp_replace(s, r",(\s*)((?:" + _alternatives(ADDITIONS) + r")\.?)(?=\s*(?:[,;|/&+\t\n\r·•、]|$|\s(?:and|et|und|with)\s))", COMMA + "$1$2")
    s = F.regexp_replace(s, r"&(\s*)((?:Sons?|Co|Company|Partners|Brothers|Bros)\b)", STAND_INS[MARKS.index("&")] + "$1$2")
    segments = F.split(s, r"(?i)[;|\t\n\r/&+·•、" + EDGE + r"]|\s(?:" + "|".join(JOINING_WORDS) + r")(?=\s)")

    def segment(x: Column) -> Column:
        x = F.regexp_replace(x, r"^[\s,]+|[\s,]+$", "")
        parts = F.filter(F.split(x, ","), lambda p: p.rlike(r"\S"))
        inverted = F.split(F.regexp_replace(x, r"([^,]+),([^,]+)(?=,|$)", "$1" + COMMA + "$2"), ",")
        return (
            F.when(F.forall(parts, lambda p: p.rlike(r"\S\s+\S")), parts)
            .when(F.size(parts) <= 2, F.array(x))
            .when((F.size(parts) % 2 == 0) & ~F.get(parts, F.lit(0)).rlike(r"\S\s+\S"), inverted)
            .otherwise(parts)
        )

    return _values(F.flatten(F.transform(segments, segment)))


def split_terms(text: Column) -> Column:
    """Array of the tags packed in one text: a run of hashtags, or values between
    commas, semicolons, bars, spaced slashes, bullets, tabs or line ends."""
    s = _announced(protect(text))
    s = F.when(s.rlike(r"^\s*#[^\s,;|]+(\s+#[^\s,;|]+)*\s*$"), F.regexp_replace(s, r"\s+#", ";#")).otherwise(s)
    parts = F.split(s, r"[,;|\t\n\r·•、" + EDGE + r"]|\s//?(?=\s)|//")
    return _values(F.transform(parts, lambda x: F.regexp_replace(x, r"^\s*#(?=\S)", "")))


def unpack(df: DataFrame, id_col: str, fields: dict[str, str], at_least: int = 1) -> DataFrame:
    """(id, field_name, pos, item) of every value of the given fields.

    fields: column to kind, "names" or "terms". at_least: leave out texts of fewer values.
    """
    kinds = {"names": split_names, "terms": split_terms}
    packed = F.array(*(F.struct(F.lit(c).alias("field_name"), kinds[kind](F.col(c)).alias("items")) for c, kind in fields.items()))
    return (
        df.select(F.col(id_col), F.explode(packed).alias("f"))
        .where(F.size("f.items") >= at_least)
        .select(id_col, F.col("f.field_name"), F.posexplode("f.items").alias("pos", "item"))
        .withColumn("pos", (F.col("pos") + 1).cast("bigint"))
    )
