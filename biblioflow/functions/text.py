"""Column functions over text: native expressions, and vectorised ones where Spark has none."""

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biblioflow.functions import kernel as K
from biblioflow.functions import titles as TT

# Beginnings of dates that stand for none; media types of catalogue records; words of search noise.
NO_DATES = ("0101-01-01", "0100-12-31", "0000")
NO_YEARS = ("0101", "0100", "0000")
COMIC_TYPES = ["manga", "manhwa", "manhua", "oel", "doujinshi", "filipino", "indonesian", "thai", "vietnamese", "malaysian", "nordic", "french", "spanish"]
COMIC_FORMATS = ["CBZ", "CBR", "CB7", "CBT", "CBC"]
TEXT_FORMATS = ["EPUB", "KEPUB", "AZW3", "AZW", "MOBI", "FB2", "TXT", "DOCX", "RTF", "KFX"]
LEGAL_FORMS = ["llc", r"l\.l\.c\.", r"inc\.?", "incorporated", r"ltd\.?", "limited", r"co\.", r"corp\.?", "corporation", "gmbh", "pty", "plc"]
SEARCH_NOISE = ["LQ", "HQ", "HD", "RAW", "scan", "scans", "scanned", "digital", r"novel\s+yaoi", r"yaoi\s+novel", "yaoi", r"bl\s+novel"]
EDITION_TYPES = ["novel", "light novel", "manga", "manhwa", "manhua", "webtoon", "web novel"]
LEGAL_END = rf"(?i)(?:[\s,]+(?:{'|'.join(LEGAL_FORMS)}))+\.?\s*$"


def _text(f):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action=None).astype(object)

    return lambda x: run(F.coalesce(x, F.lit("")))


decode_entities = _text(lambda s: K.html.unescape(K.html.unescape(K.html.unescape(K.html.unescape(s)))) if s and "&" in s else s or "")
clean_text = _text(K.clean)
fold = _text(K.fold)
words_key = _text(K.words)
identity_key = _text(K.compact)
name_key = _text(partial(K.compact, article=False))
romaji_key = _text(K.roman_key)


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([K.ratio(x, y) for x, y in zip(a, b)], index=a.index, dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """Share of matching blocks, in this order of arguments; 0.0 if either has no letters."""
    return _similarity(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))


@F.pandas_udf(T.StructType([T.StructField("one", T.LongType()), T.StructField("two", T.LongType())]))
def letter_bits(words: pd.Series) -> pd.DataFrame:
    """How often each of 32 groups of letters occurs, up to four times, as bits; a letter more or less changes one bit at most."""
    out = np.zeros((len(words), 2), np.uint64)
    for k, s in enumerate(words):
        halves = [0, 0]
        for c in s or "":
            group = ord(c) % 32
            shift = group % 16 * 4
            level = halves[group // 16] >> shift & 15
            halves[group // 16] |= (level << 1 | 1) << shift & 15 << shift
        out[k] = halves
    return pd.DataFrame(out.view(np.int64), columns=["one", "two"])


@F.pandas_udf(T.BooleanType())
def tokens_align(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([K.tokens_align(x, y) for x, y in zip(a, b)], index=a.index, dtype="bool")


# ---- author strings, tags, junk authors: native steps over the cleaned string ------------

# Phrases before a name that announce a credit to drop, or to keep; words of bodies that are no persons.
DROPPED_ROLES = ["illustrated by", "illustration by", "illustrations by", "illustrator", "cover art by", "translated by", "translator", "translation by", "edited by", "editor", "narrated by"]
KEPT_ROLES = ["author", "written by", "story by", "original story by", "by"]
NO_PERSON_WORDS = ["editorial", "department", "publishing", "publishers", "staff", "bunko"]
# Vocabulary prefixes and genre endings of catalogue headings.
HEADING_PREFIXES = ["cyac", "lcgft", "lcsh", "fast", "bisac"]
HEADING_ENDS = ["fiction", "juvenile fiction", "comic books, strips, etc", "novels", "translations into english"]

_FIELD_TAG = r"^\d{3}-\d{2} +"
_LIFE_DATES = r",? *(?:\d{4} *- *(?:\d{4})?|[bd]\. *\d{4})\.? *$"


def _role(phrases: list[str]) -> str:
    longest_first = sorted(phrases, key=len, reverse=True)
    return rf"(?i)^(?:{'|'.join(p.replace(' ', ' +') for p in longest_first)}) *[:_-]? +"


def _split(x: Column, sign: str) -> Column:
    """The pieces between signs, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(x, sign), lambda p: F.trim(p)), lambda p: p != "")


def tidy(x: Column) -> Column:
    """A cleaned name without catalogue marks, life dates and separators at its ends."""
    bare = F.regexp_replace(F.regexp_replace(x, _FIELD_TAG, ""), _LIFE_DATES, "")
    return F.regexp_replace(bare, r"^[ ,;_]+|[ ,;_]+$", "")


def turned(x: Column) -> Column:
    """A cleaned "Last, First" as "First Last"; "" for anything else."""
    halves = F.transform(F.split(x, ","), lambda p: F.trim(p))
    fits = (F.size(halves) == 2) & F.forall(halves, lambda h: h != "") & ~x.rlike(r"\p{Nd}")
    return F.when(fits, F.concat_ws(" ", F.get(halves, F.lit(1)), F.get(halves, F.lit(0)))).otherwise("")


def flipped(x: Column) -> Column:
    return turned(clean_text(x))


def split_author(x: Column) -> Column:
    """The struct (authors, dropped) of one stored author string: names it credits, and credits of other roles."""
    return _credits(clean_text(x))


def _credits(whole: Column) -> Column:
    catalogued = whole.contains(";") | whole.rlike(_FIELD_TAG) | whole.rlike(_LIFE_DATES)
    dropped_role, kept_role, body = _role(DROPPED_ROLES), _role(KEPT_ROLES), rf"(?i)\b(?:{'|'.join(NO_PERSON_WORDS)})\b"

    def names(piece: Column) -> Column:
        """A piece is a list of names if a role is told in it or every name has a blank."""
        parts = _split(piece, ",")
        told = F.exists(parts, lambda p: p.rlike(dropped_role) | p.rlike(kept_role))
        listed = piece.contains(",") & F.forall(parts, lambda p: p.contains(" "))
        return F.transform(F.when(told | listed, parts).otherwise(F.array(piece)), tidy)

    pieces = F.filter(F.transform(F.split(whole, ";"), lambda p: tidy(F.trim(p))), lambda p: p != "")
    found = F.filter(F.flatten(F.transform(pieces, names)), lambda n: n != "")
    other = lambda n: n.rlike(dropped_role) | n.rlike(body)
    kept = F.filter(F.transform(F.filter(found, lambda n: ~other(n)), lambda n: tidy(F.regexp_replace(n, kept_role, ""))), lambda n: n != "")
    authors = F.when(catalogued, F.transform(kept, lambda n: F.coalesce(F.nullif(turned(n), F.lit("")), n))).otherwise(kept)
    dropped = F.transform(F.filter(found, other), lambda n: tidy(F.regexp_replace(n, dropped_role, "")))
    return F.struct(authors.alias("authors"), dropped.alias("dropped"))


def expand_tag(x: Column, slashes: bool = True) -> Column:
    """The tags that one stored tag stands for, in order."""
    kept = F.filter(_split(clean_text(x), r"\|"), lambda p: ~p.rlike("(?i)^https?://"))
    prefix, end = rf"(?i)^(?:{'|'.join(HEADING_PREFIXES)}) *: *", rf"(?i) *-- *(?:{'|'.join(HEADING_ENDS)})\.? *$"
    heading = lambda p: F.trim(F.substring_index(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, prefix, ""), end, ""), r"\.+$", "")), "--", 1))
    levels = F.flatten(F.transform(kept, lambda p: _split(heading(p), " / ") if slashes else F.array(heading(p))))
    return F.filter(F.transform(levels, lambda p: F.regexp_replace(p, "(?i) +- +general$", "")), lambda p: p != "")


def junk_author_info(name: Column, junk_names: list[str]) -> Column:
    """What a name tells that is no author's: a known stand-in, a copyright line, or a release file's name; NULL fields for others.

    The struct (reason, volume, volume_end, publisher, source, complete, subtitle).
    """
    return _junk_info(clean_text(name), fold(name), sorted({K.fold(j) for j in junk_names}))


def _junk_info(x: Column, folded: Column, junk: list[str]) -> Column:
    groups = F.transform(F.regexp_extract_all(x, F.lit(r"\[([^\]]*)\]"), F.lit(1)), lambda p: F.trim(p))
    release = x.rlike(r"^[^\[\]]*(?:\[[^\]]*\] *){2,}$") & F.element_at(groups, -1).rlike("^[0-9A-Fa-f]{8}$")
    lead = F.trim(F.regexp_extract(x, r"^([^\[]*)", 1))
    numbers = r"(?i)^vol(?:ume)?\.? *(\d{1,3})(?: *- *(\d{1,3}))?(?: +chapter +\d+)?$"
    volume = lambda g: F.when(release & lead.rlike(numbers), F.regexp_extract(lead, numbers, g).try_cast("double"))
    whole = F.lower(lead) == "complete"
    reason = F.when(folded.isin(junk), "stand-in").when(x.rlike(r"(?i)^(?:©|\(c\)|copyright\b)"), "copyright").when(F.coalesce(release, F.lit(False)), "release")
    of_file = lambda v: F.when(reason == "release", v)
    return F.struct(
        reason.alias("reason"), of_file(volume(1)).alias("volume"), of_file(volume(2)).alias("volume_end"),
        of_file(F.nullif(F.get(groups, F.lit(0)), F.lit(""))).alias("publisher"), of_file(F.nullif(F.array_join(F.slice(groups, 2, F.greatest(F.size(groups) - 2, F.lit(0))), ", "), F.lit(""))).alias("source"),
        F.when(reason.isNotNull(), F.coalesce(of_file(whole), F.lit(False))).alias("complete"), of_file(F.when(~whole & (lead != "") & ~lead.rlike(numbers), lead)).alias("subtitle"),
    )


TITLE_SCHEMA = T.StructType([
    T.StructField("original", T.StringType()), T.StructField("cleaned", T.StringType()), T.StructField("series", T.StringType()),
    T.StructField("volume", T.DoubleType()), T.StructField("part", T.IntegerType()), T.StructField("subtitle", T.StringType()),
    T.StructField("kind", T.StringType()), T.StructField("keyword", T.StringType()), T.StructField("part_label", T.StringType()),
    T.StructField("marker", T.StringType()), T.StructField("index", T.DoubleType()), T.StructField("standard", T.StringType()),
    T.StructField("variants", T.ArrayType(T.StringType())), T.StructField("notes", T.ArrayType(T.StringType())),
])


def parse_title(title: Column, publishers: Column | None = None, junk_words: list[str] = TT.JUNK_WORDS, label: str = "Vol.", style: str = "decimal") -> Column:
    """What a title says, as a struct. publishers: an array of the known names that stand in its brackets."""
    junk = list(junk_words)

    @F.pandas_udf(TITLE_SCHEMA)
    def run(s: pd.Series, known: pd.Series) -> pd.DataFrame:
        rows = []
        for x, names in zip(s, known):
            t = TT.parse(x, names if names is not None else (), junk)
            rows.append((t.original, t.cleaned, t.series, t.volume, t.part, t.subtitle, t.kind, t.keyword, t.part_label, t.marker, TT.index(t, style), TT.standard(t, label), TT.variants(t), list(t.notes)))
        out = pd.DataFrame(rows, columns=TITLE_SCHEMA.names, index=s.index)
        return out.astype({"part": "Int32"})

    return run(F.coalesce(title, F.lit("")), publishers if publishers is not None else F.array().cast("array<string>"))


# ---- native expressions ------------------------------------------------------------------


def one_blank(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"^ | $", "")


def series_key(words: Column) -> Column:
    """Key of a series from its words: a leading article does not count if more than three letters stay."""
    rest = F.regexp_replace(words, r"^(?:the|a|an) ", "")
    return F.replace(F.when((rest != words) & (F.length(rest) > 3), rest).otherwise(words), F.lit(" "), F.lit(""))


def strip_legal(name: Column) -> Column:
    """A publisher's name without legal forms at its end, underscores as blanks."""
    x = F.replace(name, F.lit("_"), F.lit(" "))
    shorter = lambda y: F.regexp_replace(F.regexp_replace(y, LEGAL_END, ""), r"^[ ,]+|[ ,]+$", "")
    # a round takes a word at least, so there are no more rounds than words
    return F.aggregate(F.split(x, " "), x, lambda y, _: shorter(y))


def publisher_key(name: Column) -> Column:
    return identity_key(strip_legal(clean_text(name)))


def person_key(words: Column) -> Column:
    return F.array_join(F.array_sort(F.split(words, " ")), "")


def sorted_tokens(folded: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.replace(folded, F.lit(","), F.lit(" ")), r"\s+"), lambda t: t != "")), " ")


def numbering(name: Column) -> Column:
    """Numbers, roman numerals and words of sub-series of a name, sorted."""
    # Roman numerals and words that tell series of one name apart.
    found = F.regexp_extract_all(F.lower(name), F.lit(r"\b(?:\d+|[ivxlc]+|nt|ss|ex|zero|gaiden|side stor(?:y|ies)|short stor(?:y|ies))\b"), F.lit(0))
    return F.array_join(F.array_sort(found), ",")


def slot(index: Column) -> Column:
    return F.format_string("%.4f", index)


def number_text(x: Column) -> Column:
    return F.when(x.isNull(), "").when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.regexp_replace(F.format_string("%.4f", x), r"0+$", ""))


def latin(x: Column) -> Column:
    """Whether four fifths of the letters are ASCII; false without letters."""
    letters, plain = F.length(F.regexp_replace(x, r"\P{L}", "")), F.length(F.regexp_replace(x, r"[^A-Za-z]", ""))
    return F.coalesce((letters > 0) & (plain >= letters * 0.8), F.lit(False))


def undefined_date(x: Column) -> Column:
    out = x.isNull() | (F.trim(x) == "")
    for p in NO_DATES:
        out = out | x.startswith(p)
    return F.coalesce(out, F.lit(True))


def normalize_pubdate(x: Column) -> Column:
    """"YYYY-MM-DDT12:00:00+00:00"; a missing month or day is 01; NULL without a year of four digits."""
    x = one_blank(x)
    y, m, d = F.regexp_extract(x, r"^(\d{4})", 1), F.regexp_extract(x, r"^.{5}(\d{2})", 1), F.regexp_extract(x, r"^.{8}(\d{2})", 1)
    or01 = lambda p: F.when(p == "", "01").otherwise(p)
    return F.when((y != "") & ~y.isin(*NO_YEARS), F.concat(y, F.lit("-"), or01(m), F.lit("-"), or01(d), F.lit("T12:00:00+00:00")))


def catalogue_author(x: Column) -> Column:
    """"FAMILY Given" as "Given Family"; other names as they are."""
    x = one_blank(x)
    family, given = F.regexp_extract(x, r"^(\S+) ", 1), F.regexp_extract(x, r"^\S+ (.+)$", 1)
    loud = lambda w: (F.upper(w) == w) & (F.lower(w) != w)
    turn = (F.length(family) > 1) & loud(family) & F.exists(F.split(given, " "), lambda w: ~loud(w))
    return F.when(turn, F.concat(given, F.lit(" "), F.upper(F.left(family, F.lit(1))), F.lower(F.substr(family, F.lit(2))))).otherwise(x)


def medium_of(kind: Column) -> Column:
    k = F.lower(F.trim(kind))
    return F.when(k == "novel", "novel").when(k.isin(COMIC_TYPES), "comic")


def without_edition(x: Column) -> Column:
    """A catalogue title without the edition in parentheses at its end."""
    return F.regexp_replace(x, rf"(?i)\s*\((?:{'|'.join(EDITION_TYPES)})\)\s*$", "")


def isbn_digits(x: Column) -> Column:
    """The digits of an ISBN of 10 or 13; NULL for other lengths."""
    d = F.regexp_replace(F.upper(x), "[^0-9X]", "")
    return F.when(F.length(d).isin(10, 13), d)


def short(x: Column, n: int = 140) -> Column:
    return F.left(one_blank(x), F.lit(n))


def search_text(x: Column) -> Column:
    return one_blank(F.regexp_replace(x, rf"(?i)\b(?:{'|'.join(SEARCH_NOISE)})\b", " "))


def first_non_empty(*xs: Column) -> Column:
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in xs))


def each_once(items: Column, prefer: dict[str, str] | None = None) -> Column:
    """The items that differ when folded, in their order, in the preferred or the first spelling of each."""
    shown = {K.fold(k): v for k, v in (prefer or {}).items()}

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(lists: pd.Series) -> pd.Series:
        def once(xs) -> list[str]:
            out: dict[str, str] = {}
            for x in map(K.clean, xs if xs is not None else ()):
                if x:
                    out.setdefault(K.fold(x), shown.get(K.fold(x), x))
            return list(out.values())

        return lists.map(once, na_action=None)

    return run(items)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _lacking(have: pd.Series, more: pd.Series) -> pd.Series:
    folded = lambda xs: {K.fold(x) for x in xs} if xs is not None else set()
    return pd.Series([[y for y in (ys if ys is not None else ()) if K.fold(y) not in folded(xs)] for xs, ys in zip(have, more)], index=have.index, dtype=object)


def lacking(have: Column, more: Column) -> Column:
    """The items of more that have lacks, compared when folded."""
    return _lacking(have, more)


def standard_title(series: Column, keyword: Column, volume: Column, part: Column, part_label: Column, subtitle: Column, label: str = "Vol.") -> Column:
    """"Series, Vol. N, Part M: Subtitle" of its parts; NULL without series or volume."""
    word = F.when(keyword == "part", "Part").when(keyword == "book", "Book").otherwise(label)
    numbered = F.concat(series, F.lit(", "), word, F.lit(" "), number_text(volume))
    with_part = F.when(part.isNotNull() & (keyword != "part"), F.concat(numbered, F.lit(", "), part_label, F.lit(" "), part.cast("string"))).otherwise(numbered)
    return F.when(series.isNotNull() & volume.isNotNull(), F.concat_ws(": ", with_part, F.nullif(subtitle, F.lit(""))))


# ---- media and publishers ----------------------------------------------------------------


def medium_from_probe(images: Column, text_bytes: Column, ok: Column) -> Column:
    return (
        F.when(~F.coalesce(ok, F.lit(False)), None)
        .when((images >= 40) & (text_bytes < images * 4000), "comic")
        .when(text_bytes >= 120_000, "novel")
        .when((images <= 30) & (text_bytes >= 40_000), "novel")
    )


def publisher_class(words: Column, lists: dict[str, list[str]]) -> Column:
    """ln, manga, mixed, general or NULL of a publisher's words. lists: class to phrases."""
    padded = F.concat(F.lit(" "), words, F.lit(" "))

    def hit(name: str) -> Column:
        out = F.lit(False)
        for p in lists.get(name, []):
            if K.words(p):
                out = out | padded.contains(f" {K.words(p)} ")
        return out

    ln, manga = hit("ln"), hit("manga")
    return F.when(words.isNull() | (words == ""), None).when(ln & manga, "mixed").when(ln, "ln").when(manga, "manga").when(hit("mixed"), "mixed").when(hit("general"), "general")


def tag_medium(tags: Column) -> Column:
    novel, manga = F.exists(tags, lambda t: F.lower(F.trim(t)) == "light novel"), F.exists(tags, lambda t: F.lower(F.trim(t)) == "manga")
    return F.when(novel & manga, "conflict").when(novel, "novel").when(manga, "manga")


def decide_booktype(file_medium: Column, marker: Column, tags: Column, pub: Column, cat_novel: Column, cat_comic: Column, searched: Column) -> Column:
    """The struct (decision, rule): the kind of book that all evidence says, and the rule that said it."""
    as_medium = lambda x: F.when(x == "manga", "comic").when(x == "novel", "novel")
    marked, tagged = as_medium(marker), as_medium(tags)
    by_pub = F.when(pub == "ln", "novel").when(pub == "manga", "comic")
    clash = file_medium.isNotNull() & marked.isNotNull() & (file_medium != marked)
    weak_clash = file_medium.isNull() & marked.isNull() & tagged.isNotNull() & by_pub.isNotNull() & (tagged != by_pub)
    by_catalogue = F.when(cat_novel & ~cat_comic, "novel").when(cat_comic & ~cat_novel, "comic")
    medium = F.coalesce(file_medium, marked, tagged, by_pub, by_catalogue)
    is_ = lambda x, *v: F.coalesce(x.isin(*v), F.lit(False))
    manga_sign = cat_novel | cat_comic | is_(pub, "manga", "mixed", "ln") | is_(tags, "manga") | is_(marker, "manga")
    novel_sign = cat_novel | is_(pub, "ln") | is_(tags, "novel") | is_(marker, "novel")
    general = is_(pub, "general")
    out = lambda d, r: F.struct(F.lit(d).cast("string").alias("decision"), F.lit(r).alias("rule"))
    return (
        F.when(clash, out(None, "files against marker")).when(weak_clash, out(None, "tags against publisher")).when(medium.isNull(), out(None, "no evidence"))
        .when((medium == "comic") & manga_sign, out("manga", "comic with sign"))
        .when((medium == "comic") & general, out(None, "comic of a general publisher"))
        .when(medium == "comic", F.when(searched, out(None, "comic not in the catalogue")).otherwise(out(None, "comic of unknown origin")))
        .when(novel_sign, F.when(general & ~cat_novel, out(None, "novel sign against publisher")).otherwise(out("novel", "prose with sign")))
        .when(cat_comic, F.when(general, out(None, "prose with a comic's name")).otherwise(out("novel", "novel of a comic")))
        .when(is_(pub, "mixed"), out(None, "prose of a mixed publisher"))
        .when(searched, out("other", "prose not in the catalogue"))
        .otherwise(out(None, "prose of unknown origin"))
    )
