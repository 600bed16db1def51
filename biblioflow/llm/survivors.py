"""Best representative of each duplicate group, field by field.

One aggregation per run: every member of a group brings, for each field, the struct
(fullness, source priority, timestamp, tie break, value); the maximum of the structs
survives. max() combines on the map side, so a group that holds a third of all rows
costs one small row per task.

Defined results: a field in which no member has a usable value yields NULL; members
that are missing from the records are ignored; groups listed again in another order
count once; equal fullness, priority and time are settled for the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands for a missing value, in any letter case, brackets around it ignored.
STAND_INS = [
    "", "-", "--", "?", "??", "???", ".", "n/a", "na", "n.a.", "none", "null", "nil", "unknown", "tba", "tbd", "tbc",
    "s.n.", "s. n.", "s.l.", "n.d.", "nd", "no date", "undated", "not available", "not known", "forthcoming",
    "unknown publisher", "publisher unknown", "no publisher", "publisher not identified",
]
# Nouns and endings of notes that a text is missing.
MISSING_NOUNS = r"(?:description|summary|synopsis|blurb|abstract|comments?|annotation|text|review|information|details?)"
MISSING_ENDS = r"(?:to follow|to come|coming soon|pending|missing|unavailable|not (?:yet )?(?:provided|available|supplied|written|given)|(?:will|to) be (?:added|provided|announced)|tba|tbd)"
MISSING_NOTE = (
    rf"(?:(?:the |a )?(?:\w+ )?{MISSING_NOUNS}(?: is)? {MISSING_ENDS}"
    rf"|(?:there is |sorry,? )?no (?:\w+ )?{MISSING_NOUNS}(?: (?:is|was|has been))?(?: (?:yet|currently))?(?: (?:available|provided|given|supplied|found))?(?: yet| at this time| for this (?:book|title))?)"
)
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# Elements that begin a line or block of their own.
BLOCK_TAGS = "p|div|br|hr|li|ul|ol|dl|dt|dd|table|tr|td|th|thead|tbody|h[1-6]|blockquote|pre|section|article|header|footer|figure|figcaption|body|html|head"


def is_stand_in(x: Column) -> Column:
    """Whether a value only stands for a missing one; NULL does."""
    bare = F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^[\s\[\](){}<>*\"']+|[\s\[\](){}<>*\"']+$", ""))
    return bare.isin(STAND_INS) | F.lower(F.trim(F.coalesce(x, F.lit("")))).isin(STAND_INS) | ~bare.rlike(r"[\p{L}\p{N}]")


def visible_text(html: Column) -> Column:
    """The text without markup; runs of blanks are one; an entity is one character."""
    s = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    s = F.regexp_replace(s, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", " ")
    s = F.regexp_replace(s, r"</?[A-Za-z][^>]*>|<[!?][^>]*>", "")
    s = F.regexp_replace(s, r"(?i)&(?:nbsp|ensp|emsp|thinsp|#0*160|#x0*a0|#0*32|#0*9|#0*10|#0*13);", " ")
    s = F.regexp_replace(s, r"(?i)&(?:shy|zwnj|zwj|lrm|rlm|#0*173|#0*8203|#x0*200b|#x0*ad);", "")
    s = F.regexp_replace(s, r"(?i)&amp;", "&")
    s = F.regexp_replace(s, r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);", "x")
    s = F.regexp_replace(s, r"\p{Cf}", "")
    return F.regexp_replace(F.regexp_replace(s, r"(?U)[\s\p{Z}]+", " "), r"^ | $", "")


def comments_fullness(x: Column) -> Column:
    """Visible characters; 0 for empty markup, stand-ins and notes that a text is missing."""
    s = visible_text(F.coalesce(x, F.lit("")))
    note = F.lower(F.regexp_replace(s, r"^[\s\[(*]+|[\s\])*.!]+$", "")).rlike(f"^{MISSING_NOTE}$")
    return F.when((s == "") | is_stand_in(s) | note, 0).otherwise(F.length(s)).cast("bigint")


def pubdate_fullness(x: Column) -> Column:
    """3 for a full date, 2 for year and month, 1 for a year; 0 if it does not exist or lies outside 1900-2030."""
    s = F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)[\s\p{Z}]+", " ")))
    s = F.regexp_replace(s, r"^(?:\[|\(|©|c(?:a|irca)?\.? ?(?=[\[\d])|copyright |published |publ?\.? ?)+|[\])?.]+$", "")
    name = "(" + "|".join(MONTHS) + r")[a-z]*\.?,?"
    month_no = lambda m: F.array_position(F.array(*map(F.lit, MONTHS)), m)

    def got(pattern: str, y: int, m: int = 0, d: int = 0, named: bool = False) -> Column:
        part = lambda g: F.regexp_extract(s, pattern, g)
        year = part(y).try_cast("int")
        month = (month_no(F.substring(part(m), 1, 3)) if named else part(m).try_cast("int")) if m else F.lit(1)
        day = part(d).try_cast("int") if d else F.lit(1)
        real = F.expr("true") & year.between(1900, 2030) & month.between(1, 12)
        if d:
            leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
            last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
            real = real & (day >= 1) & (day <= last)
        return F.when(F.coalesce(real, F.lit(False)), 1 + bool(m) + bool(d)).otherwise(0)

    tail = r"(?:[t ]\d{1,2}:\d{2}.*)?$"
    forms = [
        (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + tail, (1, 2, 3), False),
        (r"^(\d{4})(\d{2})(\d{2})$", (1, 2, 3), False),
        (rf"^(\d{{1,2}})(?:st|nd|rd|th)?[ -]{name}[ -]?(\d{{4}})$", (3, 2, 1), True),
        (rf"^{name} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})$", (3, 1, 2), True),
        (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", (3, 2, 1), False),
        (r"^(\d{4})[-/.](\d{1,2})$", (1, 2), False),
        (r"^(\d{1,2})[-/.](\d{4})$", (2, 1), False),
        (rf"^{name} ?(\d{{4}})$", (2, 1), True),
        (rf"^(\d{{4}}) {name}$", (1, 2), True),
        (r"^(\d{4})$", (1,), False),
    ]
    out = F.when(F.lit(False), 0)
    for pattern, groups, named in forms:
        value = got(pattern, *groups, named=named)
        if pattern.startswith(r"^(\d{1,2})[/.-](\d{1,2})"):  # day and month in either order
            value = F.greatest(value, got(pattern, 3, 1, 2))
        out = out.when(s.rlike(pattern), value)
    return out.otherwise(0).cast("bigint")


def isbn_ok(x: Column) -> Column:
    """Whether an ISBN of 10 or 13 digits has the right check digit."""
    s = F.upper(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?i)^(?:urn:)?isbn(?:-?1[03])?:? *|(?U)[\s\p{Pd}]", ""))
    at = lambda i: F.when(F.substring(s, i, 1) == "X", 10).otherwise(F.substring(s, i, 1).try_cast("int"))
    ten = sum((at(i) * (11 - i) for i in range(2, 11)), at(1) * 10)
    thirteen = sum((at(i) * (3 if i % 2 == 0 else 1) for i in range(2, 14)), at(1))
    return F.coalesce(F.when(s.rlike(r"^[0-9]{9}[0-9X]$"), ten % 11 == 0).when(s.rlike(r"^97[89][0-9]{10}$"), thirteen % 10 == 0), F.lit(False))


def identifiers_fullness(x: Column) -> Column:
    """Distinct types, letter case ignored, that have a usable value."""
    kind = lambda e: F.lower(F.trim(e["key"]))
    usable = F.filter(F.map_entries(x), lambda e: (kind(e) != "") & ~is_stand_in(e["value"]) & (~kind(e).startswith("isbn") | isbn_ok(e["value"])))
    return F.coalesce(F.size(F.array_distinct(F.transform(usable, kind))), F.lit(0)).cast("bigint")


FULLNESS = {
    "comments": comments_fullness,
    "identifiers": identifiers_fullness,
    "pubdate": pubdate_fullness,
    "publisher": lambda x: F.when(is_stand_in(x), 0).otherwise(1).cast("bigint"),
}


def groups_of(review: DataFrame, category: str = "duplicates") -> DataFrame:
    """(group_key, group_id, id): members of each distinct set of records listed under a category."""
    sets = review.where((F.col("category") == category) & (F.size("book_ids") > 0)).select(
        F.array_sort(F.array_distinct(F.filter("book_ids", lambda x: x.isNotNull()))).alias("ids"), "review_id"
    )
    return (
        sets.where(F.size("ids") > 0).groupBy("ids").agg(F.min("review_id").alias("group_key"))
        .select("group_key", F.get("ids", F.lit(0)).alias("group_id"), F.explode("ids").alias("id"))
    )


def survivors(records: DataFrame, groups: DataFrame, fields: list[str], priority: Column | None = None) -> DataFrame:
    """One row per group: for each field the struct (fullness, priority, at, tie, id, value) that survives, or NULL.

    records: id, last_modified and the fields. groups: group_key, group_id, id.
    priority: a number for the trust in a record's source; all are equal without it.
    """
    level = (priority if priority is not None else F.lit(0)).cast("int")
    members = records.select("id", F.col("last_modified").alias("at"), level.alias("priority"), *fields).join(groups.hint("merge"), "id")
    best = []
    for f in fields:
        plain = members.schema[f].dataType.typeName() != "map"
        value = F.col(f) if plain else F.to_json(f)
        rank = F.struct(FULLNESS[f](F.col(f)).alias("fullness"), "priority", "at", (-F.col("id")).alias("tie"), F.col("id").alias("id"), value.alias("value"))
        best.append(F.max(F.when(rank["fullness"] > 0, rank)).alias(f))
    return members.groupBy("group_key", "group_id").agg(*best)
