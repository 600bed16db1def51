"""Registered queries of the core and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biblioflow.functions import text as T
from biblioflow.operators.changes import compare_and_set, folder_of, guarded, kept, not_reached, operations, undo_operations
from biblioflow.operators.duplicates import ISBN_TYPES, duplicate_review, equal_texts, isbn_groups
from biblioflow.operators.linkage import author_suggestions, person_votes, publisher_suggestions, series_suggestions
from biblioflow.operators.packed import unpack
from biblioflow.operators.report import first_rows, review_summary, suggested_aliases, summary, toml_lines
from biblioflow.plans.candidates import filled, first_acceptable, gained, incomplete, judged
from biblioflow.plans.cleaning import (
    NEVER_COPIED, author_sort_pass, authors_pass, canonical_names, consensus_tags, credited, existing_spelling, expanded_tags, mapped, preferred_casing, publishers_pass, tag_backfill_pass, tags_pass,
)
from biblioflow.plans.model import author_lists, custom_columns, loaded, pivoted
from biblioflow.plans.online import JUNK_NAMES, asked_pairs, classify_pass, covers_pass, fetch_pass, junk_author_books, series_lookup_pass
from biblioflow.plans.run import offline
from biblioflow.plans.series import accepted, candidates, conflict_pairs, first_come, gap_report, names, parsed, series_pass, titles_pass
from biblioflow.session import shared_dir, table
from biblioflow.sources import journal
from biblioflow.sources.files import book_medium, without_cover
from biblioflow.sources.services import cached, parse_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of intake.authors and intake.tags that hold two or more."""
    return unpack(table(spark, sf_dir, "intake"), "intake_id", {"authors": "names", "tags": "terms"}, at_least=2)


# ---- helpers for the SQL -----------------------------------------------------------------


def _fold(x: str) -> str:
    """SQL of the folded form, for data without characters of other widths."""
    return f"trim(regexp_replace(lower(nfc_normalize({x})), '\\s+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"trim(regexp_replace(replace({_fold(x)}, '&', ' and '), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded(table(spark, sf_dir, "books"))


# ---- scans and loading -------------------------------------------------------------------


@query(
    "author_lists",
    """
    with once as (select book, author, min(id) as pos from books_authors_link group by book, author)
    select book as id, string_agg(replace(a.name, '|', ','), ' & ' order by once.pos) as authors
    from once join authors a on a.id = once.author where a.name is not null group by book
    """,
)
def q_author_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = author_lists(table(spark, sf_dir, "books_authors_link"), table(spark, sf_dir, "authors").where("name is not null"))
    return lists.select("id", F.array_join("authors", " & ").alias("authors"))


@query("orphan_links", "select l.id, l.book, l.author from books_authors_link l where not exists (select 1 from books b where b.id = l.book) or not exists (select 1 from authors a where a.id = l.author)")
def q_orphan_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "books_authors_link")
    books, authors = table(spark, sf_dir, "books").select(F.col("id").alias("book")), table(spark, sf_dir, "authors").select(F.col("id").alias("author"))
    j = links.join(books.withColumn("b", F.lit(1)), "book", "left").join(authors.withColumn("a", F.lit(1)), "author", "left")
    return j.where("b is null or a is null").select("id", "book", "author")


@query(
    "books_loaded",
    """
    select id, coalesce(title, '') as title, case when coalesce(series_index, 0) = 0 then 1.0 else series_index end as series_index,
      nullif(series, '') as series, nullif(publisher, '') as publisher, coalesce(len(authors), 0) as n_authors, coalesce(len(tags), 0) as n_tags from books
    """,
)
def q_books_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _books(spark, sf_dir).select("id", "title", "series_index", "series", "publisher", F.size("authors").cast("bigint").alias("n_authors"), F.size("tags").cast("bigint").alias("n_tags"))


@query("formats_scan", "select b.id, upper(f.fmt) as fmt, coalesce(f.size, 0) as size from books b, unnest(b.formats) as t(f)")
def q_formats_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "books").select("id", F.explode("formats").alias("f")).select("id", F.upper("f.fmt").alias("fmt"), F.coalesce("f.size", F.lit(0)).alias("size"))


@query(
    "custom_column_pivot",
    "select id, nullif(booktype, '') as booktype, nullif(metadata_status, '') as metadata_status from books where coalesce(booktype, '') != '' or coalesce(metadata_status, '') != ''",
)
def q_custom_column_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["booktype", "metadata_status"]
    return pivoted(custom_columns(table(spark, sf_dir, "books"), columns), columns)


@query("schema_counts", "select 'books' as name, count(*) as n from books union all select 'authors', count(*) from authors union all select 'books_authors_link', count(*) from books_authors_link")
def q_schema_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["books", "authors", "books_authors_link"]
    one = [table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names]
    return one[0].union(one[1]).union(one[2])


@query(
    "json_provider_flatten",
    "select event_id, event_type, cast(json_extract_string(props, '$.k') as bigint) as k from events where json_extract_string(props, '$.k') is not null",
)
def q_json_provider_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.where("k is not null")


@query(
    "cache_ttl_lookup",
    """
    with latest as (select *, row_number() over (partition by source, title order by fetched_at desc, meta_id desc) as rn from fetched_meta
      where fetched_at >= (select max(fetched_at) from fetched_meta) - interval 365 days)
    select source, title, meta_id from latest where rn = 1
    """,
)
def q_cache_ttl_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = table(spark, sf_dir, "fetched_meta")
    cache = cache.crossJoin(cache.agg(F.max("fetched_at").alias("now")))  # one row
    return cached(cache, F.col("now"), 365, ["source", "title"], "fetched_at", "meta_id").select("source", "title", "meta_id")


@query("opf_xml_parse", "select meta_id, nullif(trim(title), '') as title, nullif(trim(publisher), '') as publisher, len(authors) as n_authors from fetched_meta")
def q_opf_xml_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record written as a package and read back."""
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda n, x: F.concat(F.lit(f"<dc:{n}>"), esc(F.coalesce(x, F.lit(""))), F.lit(f"</dc:{n}>"))
    creators = F.array_join(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: tag("creator", a)), "")
    xml = F.concat(F.lit('<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>'), tag("title", F.col("title")), creators, tag("publisher", F.col("publisher")), F.lit("</metadata></package>"))
    m = table(spark, sf_dir, "fetched_meta").select("meta_id", parse_package(xml).alias("p"))
    return m.select("meta_id", "p.title", "p.publisher", F.size("p.authors").cast("bigint").alias("n_authors"))


# ---- text functions ----------------------------------------------------------------------


@query("entity_decode", "select doc_id, md5(replace(text, '&amp;', '&')) as h from documents where text is not null")
def q_entity_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(T.decode_entities(F.col("text"))).alias("h"))


@query("words_key", f"select distinct name, {_words('name')} as words, replace({_words('name')}, ' ', '') as k from tags where name is not null")
def q_words_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "tags").select("name").where("name is not null").distinct()
    return names.select("name", T.words_key(F.col("name")).alias("words"), T.name_key(F.col("name")).alias("k"))


@query(
    "pubdate_normalize",
    """
    select id, substr(p, 1, 4) || '-' || coalesce(nullif(regexp_extract(p, '^.{5}(\\d{2})', 1), ''), '01') || '-' || coalesce(nullif(regexp_extract(p, '^.{8}(\\d{2})', 1), ''), '01')
      || 'T12:00:00+00:00' as pubdate
    from (select id, trim(regexp_replace(pubdate, '\\s+', ' ', 'g')) as p from books) where regexp_matches(p, '^\\d{4}') and substr(p, 1, 4) not in ('0101', '0100', '0000')
    """,
)
def q_pubdate_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "books").select("id", T.normalize_pubdate(F.col("pubdate")).alias("pubdate")).where("pubdate is not null")


@query(
    "isbn_digits",
    "select b.id, regexp_replace(upper(e.value), '[^0-9X]', '', 'g') as isbn from books b, unnest(map_entries(b.identifiers)) as t(e) where lower(e.key) = 'isbn' and length(regexp_replace(upper(e.value), '[^0-9X]', '', 'g')) in (10, 13)",
)
def q_isbn_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "books").select("id", F.explode("identifiers").alias("k", "v")).where("lower(k) = 'isbn'")
    return e.select("id", T.isbn_digits(F.col("v")).alias("isbn")).where("isbn is not null")


# ---- titles ------------------------------------------------------------------------------


def _part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles built from parts, in five forms."""
    p = table(spark, sf_dir, "part")
    n, s, k = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey") % 5
    title = (
        F.when(k == 0, F.concat(n, F.lit(", Vol. "), s)).when(k == 1, F.concat(n, F.lit(" Book "), s)).when(k == 2, F.concat(n, F.lit(" "), s))
        .when(k == 3, F.concat(n, F.lit(" [Press][Scans][0EDF6669]"))).otherwise(F.concat(n, F.lit(" (Light Novel), Volume "), s, F.lit(": "), F.col("p_type")))
    )
    return p.select(F.col("p_partkey").alias("id"), title.alias("title"), F.lit(None).cast("string").alias("series"), F.lit(1.0).alias("series_index"))


@query(
    "title_parse",
    """
    select p_partkey as id, case p_partkey % 5 when 3 then null else p_name end as series, case p_partkey % 5 when 3 then null else cast(p_size as double) end as volume,
      case p_partkey % 5 when 4 then p_type end as subtitle, case p_partkey % 5 when 2 then 'bare' when 3 then null else 'explicit' end as kind, case p_partkey % 5 when 4 then 'novel' end as marker,
      case p_partkey % 5 when 0 then p_name || ', Vol. ' || p_size when 1 then p_name || ', Book ' || p_size when 2 then p_name || ', Vol. ' || p_size
        when 4 then p_name || ', Vol. ' || p_size || ': ' || p_type end as standard
    from part
    """,
)
def q_title_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parsed(_part_titles(spark, sf_dir))
    return p.select("id", "parsed.series", "parsed.volume", "parsed.subtitle", "parsed.kind", "parsed.marker", "parsed.standard")


@query("title_parse_books")
def q_title_parse_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(_books(spark, sf_dir)).select("id", "parsed.cleaned", "parsed.series", "parsed.volume", "parsed.part", "parsed.subtitle", "parsed.kind", "parsed.marker")


@query("title_standardize")
def q_title_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles_pass(_books(spark, sf_dir)).changes


@query("title_variants")
def q_title_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(_books(spark, sf_dir)).select("id", F.posexplode("parsed.variants").alias("pos", "variant"))


# ---- series ------------------------------------------------------------------------------


@query(
    "gap_report",
    """
    with have as (select series, list_sort(list(distinct cast(floor(case when coalesce(series_index, 0) = 0 then 1 else series_index end) as bigint))) as have from books
      where coalesce(series, '') != '' and floor(case when coalesce(series_index, 0) = 0 then 1 else series_index end) >= 1 group by series),
    gaps as (select series, len(have) as volumes, have[-1] as last_volume, list_filter(range(1, have[-1] + 1), lambda v: not list_contains(have, v)) as missing from have where len(have) >= 2)
    select series, volumes, last_volume, len(missing) as n_missing, array_to_string(missing, ',') as missing from gaps where len(missing) > 0
    """,
)
def q_gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gap_report(table(spark, sf_dir, "books"))
    return g.select("series", "volumes", "last_volume", "n_missing", F.array_join(F.transform("missing", lambda v: v.cast("string")), ",").alias("missing"))


@query("series_candidates")
def q_series_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(parsed(_books(spark, sf_dir)))


@query(
    "series_bare_acceptance",
    """
    with c as (select p_partkey as id, p_name as name, cast(p_size as double) as idx, case p_partkey % 5 when 2 then 'bare' else 'explicit' end as kind,
        replace(regexp_replace(p_name, '^(the|a|an) ', ''), ' ', '') as k from part where p_partkey % 5 != 3),
    ok as (select k from c group by k having max(case kind when 'explicit' then 1 else 0 end) = 1 or count(distinct idx) >= 2)
    select id, name, k as key, idx as index, kind from c where k in (select k from ok) and length(k) >= 4
    """,
)
def q_series_bare_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = parsed(_part_titles(spark, sf_dir))
    return accepted(candidates(b), b).select("id", "name", "key", "index", "kind")


@query("series_name_vote")
def q_series_name_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = parsed(_books(spark, sf_dir))
    return names(accepted(candidates(b), b), b)


@query("series_plan_review")
def q_series_plan_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collisions, conflicts, mismatches and unusual numberings of the series plan."""
    return series_pass(_books(spark, sf_dir)).review


@query("series_plan_changes")
def q_series_plan_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_pass(_books(spark, sf_dir)).changes


@query("series_merge_suggestions")
def q_series_merge_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series_suggestions(_books(spark, sf_dir))


@query(
    "slot_anti_join",
    """
    with taken as (select distinct series, round(case when coalesce(series_index, 0) = 0 then 1 else series_index end, 4) as slot from books where coalesce(series, '') != '')
    select meta_id, series, series_index from fetched_meta m where coalesce(series, '') != '' and series_index is not null
      and not exists (select 1 from taken t where t.series = m.series and t.slot = round(m.series_index, 4))
    """,
)
def q_slot_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched volumes of series that no book holds."""
    taken = _books(spark, sf_dir).where("series is not null").select("series", T.slot(F.col("series_index")).alias("slot")).distinct()
    m = table(spark, sf_dir, "fetched_meta").where("series is not null and series != '' and series_index is not null").withColumn("slot", T.slot(F.col("series_index")))
    return m.join(taken, ["series", "slot"], "left_anti").select("meta_id", "series", "series_index")


@query(
    "series_first_come",
    """
    with taken as (select distinct series, round(case when coalesce(series_index, 0) = 0 then 1 else series_index end, 4) as slot from books where coalesce(series, '') != ''),
    m as (select meta_id, series, series_index, round(series_index, 4) as slot from fetched_meta where coalesce(series, '') != '' and series_index is not null)
    select m.meta_id as book_id, m.series, m.series_index as index, case when t.series is not null then 'taken' when row_number() over (partition by m.series, m.slot order by m.meta_id) > 1 then 'lost' else 'assigned' end as outcome
    from m left join taken t on t.series = m.series and t.slot = m.slot
    """,
)
def q_series_first_come(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fetched record gets a volume that several want."""
    m = table(spark, sf_dir, "fetched_meta").where("series is not null and series != '' and series_index is not null").select(F.col("meta_id").alias("book_id"), "series", F.col("series").alias("key"), F.col("series_index").alias("index"))
    taken = _books(spark, sf_dir).where("series is not null").select(F.col("series").alias("key"), F.col("series_index").alias("index"))
    return first_come(m, taken)


# ---- tags --------------------------------------------------------------------------------


_CLEAN = "trim(regexp_replace(nfc_normalize({}), '\\s+', ' ', 'g'))"
_HEADING = (
    "trim(split_part(trim(regexp_replace(regexp_replace(regexp_replace(p, '^(?:" + "|".join(T.HEADING_PREFIXES) + ") *: *', '', 'i'), ' *-- *(?:" + "|".join(T.HEADING_ENDS) + ")\\.? *$', '', 'i'), '\\.+$', '')), '--', 1))"
)


@query(
    "tag_expand",
    f"""
    with r as (select id, unnest(tags) as raw, generate_subscripts(tags, 1) - 1 as pos from books),
    k as (select id, pos, list_filter(list_transform(string_split({_CLEAN.format("raw")}, '|'), lambda p: trim(p)), lambda p: p != '' and not regexp_matches(lower(p), '^https?://')) as parts from r where raw is not null),
    l as (select id, pos, flatten(list_transform(parts, lambda p: list_filter(list_transform(string_split({_HEADING}, ' / '), lambda q: trim(q)), lambda q: q != ''))) as levels from k),
    g as (select id, pos, list_filter(list_transform(levels, lambda q: regexp_replace(q, ' +- +general$', '', 'i')), lambda q: q != '') as tags from l),
    e as (select id, pos, unnest(tags) as tag, generate_subscripts(tags, 1) - 1 as sub from g)
    select id, pos, sub, tag, {_fold("tag")} as folded from e
    """,
)
def q_tag_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded_tags(_books(spark, sf_dir))


@query(
    "tag_preferred_casing",
    f"""
    with t as (select trim(regexp_replace(nfc_normalize(x), '\\s+', ' ', 'g')) as tag, {_fold('x')} as folded from (select unnest(tags) as x from books) where x is not null),
    n as (select folded, tag, count(*) as n from t where tag != '' group by folded, tag),
    r as (select folded, tag, row_number() over (partition by folded order by n desc, length(regexp_replace(tag, '\\P{{Lu}}', '', 'g')) desc, tag) as rn from n)
    select folded, tag as preferred from r where rn = 1
    """,
)
def q_tag_preferred_casing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferred_casing(_books(spark, sf_dir))


@query("tag_normalize")
def q_tag_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags_pass(_books(spark, sf_dir)).changes


# books whose series agree on tags: parts of one name, every fifth of which has no tags yet; and the library's own
_SQL_SERIES = (
    "select id, series, tags from books union all select p_partkey + 1000000000, p_name, case when p_partkey % 5 = 0 then [] when p_partkey % 3 = 0 then [p_name || ' Set', p_type, 'Extra'] else [p_name || ' set', p_type] end from part"
)
_NEVER = ", ".join("'" + n + "'" for n in NEVER_COPIED)


def _series_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n, k = F.col("p_name"), F.col("p_partkey")
    tags = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 3 == 0, F.array(F.concat(n, F.lit(" Set")), "p_type", F.lit("Extra"))).otherwise(F.array(F.concat(n, F.lit(" set")), "p_type"))
    return _books(spark, sf_dir).select("id", "series", "tags").union(p.select((k + 1_000_000_000).alias("id"), n, tags))


@query(
    "tag_consensus_backfill",
    f"""
    with t as (select series, id, {_fold('x')} as folded from (select series, id, unnest(tags) as x from ({_SQL_SERIES}) where coalesce(series, '') != '') where x is not null),
    v as (select series, count(distinct id) as voters from t group by series),
    c as (select series, folded, count(distinct id) as n from t group by series, folded)
    select c.series, c.folded from c join v on v.series = c.series where n = voters and voters >= 2 and folded not in ({_NEVER})
    """,
)
def q_tag_consensus_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus_tags(_series_of_parts(spark, sf_dir)).select("series", "folded")


@query(
    "tag_backfill_changes",
    f"""
    with b as ({_SQL_SERIES}), t as (select series, id, lower(x) as folded, x from (select series, id, unnest(tags) as x from b where coalesce(series, '') != '') where x is not null),
    v as (select series, count(distinct id) as voters from t group by series),
    c as (select t.series, folded, arg_min(x, id) as tag from t join v on v.series = t.series group by t.series, folded, voters having count(distinct id) = voters and voters >= 2),
    a as (select b.id, b.tags, c.tag from b join c on c.series = b.series where c.folded not in ({_NEVER}) and not exists (select 1 from t where t.id = b.id and t.folded = c.folded))
    select id as book_id, array_to_string(list_concat(any_value(coalesce(tags, [])), list_sort(list(tag))), ' & ') as after from a group by id
    """,
)
def q_tag_backfill_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tag_backfill_pass(_series_of_parts(spark, sf_dir)).changes
    return c.select("book_id", F.array_join(F.from_json("after", "array<string>"), " & ").alias("after"))


# ---- publishers and authors --------------------------------------------------------------


_KEY = "replace(regexp_replace(" + _words("regexp_replace(replace(name, '_', ' '), '" + T.LEGAL_END.replace("(?i)", "") + "', '', 'i')") + ", '^the ', ''), ' ', '')"


@query(
    "publisher_key_merge",
    f"""
    with n as (select {_CLEAN.format("publisher")} as name, count(*) as n from books where coalesce(publisher, '') != '' group by 1),
    k as (select name, n, {_KEY} as k from n),
    w as (select name, first_value(name) over (partition by k order by n desc, regexp_matches(name, '{T.LEGAL_END.replace("(?i)", "")}', 'i'), length(name), name) as winner from k where k != '')
    select b.publisher as before, w.winner as after, count(*) as books from books b join w on w.name = {_CLEAN.format("b.publisher")} where w.winner != b.publisher and coalesce(b.publisher, '') != '' group by 1, 2
    """,
)
def q_publisher_key_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publishers_pass(_books(spark, sf_dir)).review


@query("publisher_near_pairs")
def q_publisher_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publisher_suggestions(_books(spark, sf_dir))


@query("publisher_class", "select distinct publisher, case when regexp_matches(' ' || " + _words("publisher") + " || ' ', ' (granite|umber) ') then 'general' end as class from books where coalesce(publisher, '') != ''")
def q_publisher_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _books(spark, sf_dir).select("publisher").where("publisher is not null").distinct()
    p = mapped(p, "publisher", words=T.words_key)
    return p.select("publisher", T.publisher_class(F.col("words"), {"general": ["Granite", "Umber"]}).alias("class"))


@query("author_split")
def q_author_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credited(_books(spark, sf_dir)).select("id", "pos", "sub", "name")


@query("author_canonical")
def q_author_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_names(credited(_books(spark, sf_dir)).select("name"))


@query("author_changes")
def q_author_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authors_pass(_books(spark, sf_dir)).changes


_WANTED_SORT = "list_transform(authors, lambda a: nullif(trim(author_sorts[a]), ''))"


@query(
    "author_sort_rebuild",
    f"""
    select id as book_id, coalesce(author_sort, '') as before, array_to_string({_WANTED_SORT}, ' & ') as after from books
    where len(authors) > 0 and len(list_filter({_WANTED_SORT}, lambda x: x is null)) = 0 and array_to_string({_WANTED_SORT}, ' & ') != coalesce(author_sort, '')
    """,
)
def q_author_sort_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return author_sort_pass(_books(spark, sf_dir)).changes.select("book_id", "before", "after")


@query("author_variant_pairs")
def q_author_variant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return author_suggestions(table(spark, sf_dir, "authors"))


@query("junk_authors")
def q_junk_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author names that are no authors' and what they tell."""
    n = table(spark, sf_dir, "authors").select("name").where("name is not null").distinct()
    return n.withColumn("info", T.junk_author_info(F.col("name"), JUNK_NAMES)).where("info.reason is not null").select("name", "info.reason")


@query(
    "person_votes",
    """
    with v as (select s_suppkey // 4 as book_id, s_suppkey % 2 as source, case s_suppkey % 3 when 0 then 'Ada Moor' when 1 then 'Moor Ada' else 'Ben Lark' end as name,
        case s_suppkey % 3 when 2 then 'benlark' else 'adamoor' end as k, s_suppkey % 8 = 0 as exact from supplier),
    g as (select book_id, k, count(distinct source) as sources, max(cast(exact as int)) as exact, min(name) as name from v group by book_id, k),
    b as (select book_id, count(*) as ks, sum(cast(sources >= 2 as int)) as strong, arg_max(name, sources) as best, max(exact) as exact from g group by book_id)
    select book_id, best as person from b where strong = 1 or (ks = 1 and exact = 1)
    """,
)
def q_person_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person that sources agree on: votes made of suppliers, four to a book."""
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    name = F.when(k % 3 == 0, "Ada Moor").when(k % 3 == 1, "Moor Ada").otherwise("Ben Lark")
    return person_votes(s.select(F.floor(k / 4).alias("book_id"), (k % 2).alias("source"), name.alias("name"), (k % 8 == 0).alias("exact")))


@query("existing_spelling")
def q_existing_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capitalisation in which names in upper case stand in the library."""
    b = _books(spark, sf_dir)
    return existing_spelling(b, b.select(F.explode("authors").alias("have")).where("have is not null").select(F.upper("have").alias("name")).distinct())


# ---- classification and files ------------------------------------------------------------


@query(
    "medium_from_formats",
    f"""
    with f as (select id, list_transform(formats, lambda x: upper(x.fmt)) as k from books)
    select id, case when len(k) > 0 and len(list_filter(k, lambda x: x not in ({', '.join("'" + x + "'" for x in T.COMIC_FORMATS)}))) = 0 then 'comic'
      when list_contains(k, 'EPUB') or list_contains(k, 'KEPUB') then null
      when len(list_filter(k, lambda x: x in ({', '.join("'" + x + "'" for x in T.TEXT_FORMATS)}))) > 0 then 'novel' end as medium from f
    """,
)
def q_medium_from_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "books").select("id", book_medium(F.col("formats"), F.lit(None).cast("string")).alias("medium"))


@query(
    "medium_from_probe",
    """
    select p_partkey as id, case when p_size >= 40 and p_retailprice * 100 < p_size * 4000 then 'comic' when p_retailprice * 100 >= 120000 then 'novel'
      when p_size <= 30 and p_retailprice * 100 >= 40000 then 'novel' end as medium from part
    """,
)
def q_medium_from_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), T.medium_from_probe(F.col("p_size"), F.col("p_retailprice") * 100, F.lit(True)).alias("medium"))


@query("classify_decide")
def q_classify_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision for every book, and the rule that made it."""
    b = parsed(_books(spark, sf_dir))
    b = mapped(b, "publisher", words=T.words_key)
    no = F.lit(False)
    d = T.decide_booktype(book_medium(F.col("formats"), F.lit(None).cast("string")), F.col("parsed.marker"), T.tag_medium(F.col("tags")), T.publisher_class(F.col("words"), {"general": ["Granite", "Umber"]}), no, no, no)
    return b.select("id", d.alias("d")).select("id", "d.decision", "d.rule")


@query("no_files", "select id from books where formats is null or len(formats) = 0")
def q_no_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "books").where("formats is null or size(formats) = 0").select("id")


def _covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of cover files in which every ninth is not there."""
    return table(spark, sf_dir, "books").where("id % 9 != 0").select("path")


@query("missing_covers", "select id from books where not coalesce(has_cover, false) or (id % 9 = 0 and path not in (select path from books where id % 9 != 0 and path is not null))")
def q_missing_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_cover(table(spark, sf_dir, "books"), _covers(spark, sf_dir)).select("id")


@query(
    "cover_changes",
    """
    with m as (select id, formats from books where not coalesce(has_cover, false) or (id % 9 = 0 and path not in (select path from books where id % 9 != 0 and path is not null))),
    p as (select id, min(upper(f.fmt)) as path from m, unnest(m.formats) as t(f) where coalesce(f.size, 0) > 1024 group by id)
    select m.id as book_id, p.path as after, case when p.id is null then 'missing-cover' end as category from m left join p on p.id = m.id
    """,
)
def q_cover_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covers found in the books' files, and the books for which none is."""
    b = table(spark, sf_dir, "books")
    pictures = b.select("id", F.explode("formats").alias("f")).select("id", F.lit("file").alias("source"), F.upper("f.fmt").alias("path"), F.coalesce("f.size", F.lit(0)).alias("bytes"))
    r = covers_pass(_books(spark, sf_dir), _covers(spark, sf_dir), pictures)
    return r.changes.select("book_id", "after", F.lit(None).cast("string").alias("category")).union(r.review.select("book_id", F.lit(None).cast("string"), "category"))


# ---- duplicates --------------------------------------------------------------------------


@query(
    "duplicate_isbn",
    f"""
    with e as (select distinct b.id, regexp_replace(e.value, '[^0-9Xx]', '', 'g') as isbn from books b, unnest(map_entries(b.identifiers)) as t(e) where lower(e.key) in ({', '.join("'" + t + "'" for t in ISBN_TYPES)}))
    select isbn, count(*) as n, string_agg(id, ' ' order by id) as ids from e where length(isbn) in (10, 13) group by isbn having count(*) > 1
    """,
)
def q_duplicate_isbn(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = isbn_groups(_books(spark, sf_dir))
    return g.select("isbn", F.size("ids").cast("bigint").alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@query("duplicate_title_author")
def q_duplicate_title_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_review(_books(spark, sf_dir)).select("category", "key", F.size("ids").alias("n"), F.array_min("ids").alias("first_id"))


@query("exact_text_duplicates", "select md5(text) as text_hash, count(*) as copies, min(doc_id) as first_id from documents where text is not null group by text having count(*) > 1")
def q_exact_text_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_texts(table(spark, sf_dir, "documents"))


# ---- candidates --------------------------------------------------------------------------


@query("needs_fetch", "select id from books where coalesce(metadata_status, '') = '' and (trim(coalesce(comments, '')) = '' or coalesce(publisher, '') = '' or trim(coalesce(pubdate, '')) = '' or pubdate like '0101-01-01%' or pubdate like '0100-12-31%' or pubdate like '0000%')")
def q_needs_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incomplete(_books(spark, sf_dir)).select("id")


def _candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with the fetched records that share the folded name of an author: what a service asked by author may answer."""
    b = _books(spark, sf_dir)
    return asked_pairs(b, _answers(spark, sf_dir), series_pass(b).flags)


def _title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with the fetched records of the same title."""
    b = _books(spark, sf_dir).where("title != ''")
    m = table(spark, sf_dir, "fetched_meta").where("title is not null and title != ''")
    return b.join(m.select("title", "meta_id", *(F.col(c).alias(f"c_{c}") for c in ("authors", "tags", "publisher", "pubdate", "comments", "languages", "identifiers", "series", "series_index"))), "title")


def _first_of_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _title_pairs(spark, sf_dir)
    return p.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("meta_id"))).where("rn = 1")


@query("candidate_gates")
def q_candidate_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate at which each candidate of a book fails, NULL for acceptable ones."""
    return judged(_candidate_pairs(spark, sf_dir))


@query("candidate_titles_gained")
def q_candidate_titles_gained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitles and series that the first acceptable candidates bring."""
    pairs = _candidate_pairs(spark, sf_dir)
    return gained(first_acceptable(judged(pairs)).join(pairs, ["book_id", "candidate_id"]), _books(spark, sf_dir)).where("new_title is not null or new_series is not null")


@query("candidate_first_acceptable")
def q_candidate_first_acceptable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_acceptable(q_candidate_gates(spark, sf_dir))


_SQL_FIRST = "(select b.id, b.publisher, b.comments, b.identifiers, m.publisher as mp, m.comments as mc, m.identifiers as mi, row_number() over (partition by b.id order by m.meta_id) as rn from books b join fetched_meta m on m.title = b.title where b.title != '')"


@query(
    "merge_fill_empty",
    f"""
    select id, case when trim(coalesce(publisher, '')) = '' then coalesce(mp, nullif(publisher, '')) else publisher end as publisher,
      md5(case when trim(coalesce(comments, '')) = '' then coalesce(mc, comments, '') else comments end) as comments from {_SQL_FIRST} where rn = 1
    """,
)
def q_merge_fill_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled(_first_of_title(spark, sf_dir)).select("id", "publisher", F.md5("comments").alias("comments"))


@query(
    "identifiers_add_only",
    f"""
    with f as (select id, map_entries(identifiers) as o, map_entries(mi) as n from {_SQL_FIRST} where rn = 1),
    u as (select id, unnest(o) as e from f union all
      select id, unnest(list_filter(n, lambda x: not list_contains(list_transform(coalesce(o, []), lambda y: lower(y.key)), lower(x.key)))) from f)
    select id, string_agg(e.key || '=' || coalesce(e.value, ''), ' ' order by e.key) as identifiers from u group by id
    """,
)
def q_identifiers_add_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = filled(_first_of_title(spark, sf_dir)).where(F.size("identifiers") > 0)
    e = F.array_sort(F.transform(F.map_entries("identifiers"), lambda x: F.concat(x["key"], F.lit("="), F.coalesce(x["value"], F.lit("")))))
    return m.select("id", F.array_join(e, " ").alias("identifiers"))


# ---- changes, writes, undo ---------------------------------------------------------------


def _sort_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations(author_sort_pass(_books(spark, sf_dir)).changes)


_SQL_OPS = f"(select id as book_id, coalesce(author_sort, '') as before, array_to_string({_WANTED_SORT}, ' & ') as after, title from books where len(authors) > 0 and len(list_filter({_WANTED_SORT}, lambda x: x is null)) = 0 and array_to_string({_WANTED_SORT}, ' & ') != coalesce(author_sort, ''))"
# the live state: titles of books changed since by a review are in upper case
_SQL_LIVE = "(select b.id, case when b.id % 7 = 0 then 'changed since' else coalesce(author_sort, '') end as author_sort from books b where b.id % 11 != 0)"


@query("row_diff_ops", f"select book_id, after as new_value, before as expected from {_SQL_OPS}")
def q_row_diff_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sort_ops(spark, sf_dir).select("book_id", F.col("fields")["author_sort"].alias("new_value"), F.col("expect")["author_sort"].alias("expected"))


def _journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations against a live state in which some books are gone and some were edited."""
    live = _books(spark, sf_dir).where("id % 11 != 0").select(F.col("id").alias("book_id"), F.create_map(F.lit("author_sort"), F.when(F.col("id") % 7 == 0, "changed since").otherwise(F.col("author_sort"))).alias("state"))
    return compare_and_set(_sort_ops(spark, sf_dir), live)


@query(
    "compare_and_set",
    f"select o.book_id, case when l.id is null then 'missing' when l.author_sort = 'changed since' and o.before != 'changed since' then 'skipped' else 'applied' end as status from {_SQL_OPS} o left join {_SQL_LIVE} l on l.id = o.book_id",
)
def q_compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _journal(spark, sf_dir).select("book_id", "status")


@query(
    "write_status_counts",
    f"select case when l.id is null then 'missing' when l.author_sort = 'changed since' and o.before != 'changed since' then 'skipped' else 'applied' end as status, count(*) as n from {_SQL_OPS} o left join {_SQL_LIVE} l on l.id = o.book_id group by 1",
)
def q_write_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _journal(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "undo_ops",
    f"select o.book_id, o.before as new_value, o.after as expected from {_SQL_OPS} o join {_SQL_LIVE} l on l.id = o.book_id where l.author_sort != 'changed since' or o.before = 'changed since'",
)
def q_undo_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _journal(spark, sf_dir).select(F.col("book_id").alias("seq"), "book_id", "status", F.col("expect").alias("before"), F.col("fields").alias("after"))
    return undo_operations(j).select("book_id", F.col("fields")["author_sort"].alias("new_value"), F.col("expect")["author_sort"].alias("expected"))


@query("retry_anti_join", f"select o.book_id from {_SQL_OPS} o where not exists (select 1 from {_SQL_LIVE} l where l.id = o.book_id)")
def q_retry_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _journal(spark, sf_dir).where("status != 'missing'")
    return not_reached(_sort_ops(spark, sf_dir), j).select("book_id")


@query(
    "partial_writes",
    f"select o.book_id, case when o.book_id % 2 = 0 then 'partial' else 'applied' end as status, case when o.book_id % 2 = 0 then 'publisher' else 'author_sort,publisher' end as written from {_SQL_OPS} o",
)
def q_partial_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of two fields, of which every second breaks off at the later one."""
    ops = _sort_ops(spark, sf_dir).withColumn("fields", F.map_concat("fields", F.create_map(F.lit("publisher"), F.lit("New"))))
    live = _books(spark, sf_dir).select(F.col("id").alias("book_id"), F.create_map(F.lit("author_sort"), "author_sort").alias("state"))
    broken = ops.where("book_id % 2 = 0").select("book_id", F.lit("author_sort").alias("field"))
    return compare_and_set(ops, live, broken).select("book_id", "status", F.array_join(F.array_sort(F.map_keys("written")), ",").alias("written"))


@query(
    "path_guard",
    """
    with b as (select id, title, authors[1] as author, case id % 4 when 0 then upper(authors[1]) || '/' || title || ' (' || id || ')' else 'old/' || id end as path from books where len(authors) > 0 and authors[1] is not null and not regexp_matches(authors[1] || coalesce(title, ''), '[\\\\/:*?"<>|]') and trim(coalesce(title, '')) = title and trim(authors[1]) = authors[1] and title != ''),
    n as (select *, case when id % 3 = 0 then title || ' II' else title end as new_title from b)
    select id as book_id, case when path != author || '/' || new_title || ' (' || id || ')' and lower(path) = lower(author || '/' || new_title || ' (' || id || ')') then 'changes the capitalisation of a folder'
      when id % 5 = 0 then 'the new folder holds files' end as reason from n
    """,
)
def q_path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames of books, and why some are withheld: a folder that differs in letter case only, or one that is taken."""
    first = F.get("authors", F.lit(0))
    b = table(spark, sf_dir, "books").where(first.isNotNull() & ~F.concat(first, F.coalesce("title", F.lit(""))).rlike(r'[\\/:*?"<>|]') & (F.trim("title") == F.col("title")) & (F.trim(first) == first) & (F.col("title") != ""))
    path = F.when(F.col("id") % 4 == 0, F.concat(F.upper(first), F.lit("/"), "title", F.lit(" ("), F.col("id").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("old/"), F.col("id").cast("string")))
    b = b.withColumn("path", path).select("id", "title", "authors", "path")
    new = F.when(F.col("id") % 3 == 0, F.concat("title", F.lit(" II"))).otherwise(F.col("title"))
    ops = b.select(F.col("id").alias("book_id"), F.create_map(F.lit("title"), new).alias("fields"), F.create_map(F.lit("title"), "title").alias("expect"), F.lit(False).alias("strict"))
    folders = b.where("id % 5 = 0").select(folder_of(first, new, F.col("id")).alias("path"))
    return guarded(ops, b, folders).select("book_id", F.col("withheld")["title"].alias("reason"))


@query(
    "journal_counts",
    f"select case when l.id is null then 'missing' when l.author_sort = 'changed since' and o.before != 'changed since' then 'skipped' else 'applied' end as status, count(*) as n from {_SQL_OPS} o left join {_SQL_LIVE} l on l.id = o.book_id group by 1",
)
def q_journal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal written as JSON lines and read back."""
    folder = f"{shared_dir(spark)}/journal-{uuid.uuid4().hex}"
    j = _journal(spark, sf_dir)
    journal.append(j.select("book_id", "status", F.col("expect").alias("before"), F.col("written").alias("after"), "actual"), folder)
    return journal.read(spark, folder, strict=True).groupBy("status").agg(F.count("*").alias("n"))


@query(
    "undo_kept",
    f"select o.book_id, 'author_sort' as fields_that_differ from {_SQL_OPS} o join {_SQL_LIVE} l on l.id = o.book_id where (l.author_sort != 'changed since' or o.before = 'changed since') and o.book_id % 13 = 0",
)
def q_undo_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books that an undo leaves alone, as they were edited since."""
    j = _journal(spark, sf_dir)
    undo = undo_operations(j.select(F.col("book_id").alias("seq"), "book_id", "status", F.col("expect").alias("before"), F.col("written").alias("after")))
    now = undo.select("book_id", F.when(F.col("book_id") % 13 == 0, F.create_map(F.lit("author_sort"), F.lit("edited"))).otherwise(F.col("expect")).alias("state"))
    return kept(compare_and_set(undo.select("book_id", "fields", "expect", "strict"), now)).select("book_id", "fields_that_differ")


@query("series_conflict_pairs")
def q_series_conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the series of books and the one that their titles tell differ."""
    return conflict_pairs(_books(spark, sf_dir))


@query("alias_suggestions")
def q_alias_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested aliases of authors as lines of a settings file, for all suggestions."""
    authors = table(spark, sf_dir, "authors").where("name is not null")
    return toml_lines(suggested_aliases(author_suggestions(authors), authors.groupBy("name").agg(F.count("*").alias("n")))).select("line")


@query("changes_by_pass")
def q_changes_by_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes and books of every offline pass, each on the books of the one before."""
    return summary(offline(_books(spark, sf_dir))[1])


@query(
    "review_counts",
    """
    with i as (select category, count(*) as items from review group by category), b as (select category, count(distinct id) as books from (select category, unnest(book_ids) as id from review) group by category)
    select i.category, i.items, coalesce(b.books, 0) as books from i left join b on b.category = i.category
    """,
)
def q_review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_summary(table(spark, sf_dir, "review"))


@query("review_report", "select review_id, category, array_to_string(book_ids, ' ') as book_ids, detail from review")
def q_review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "review")
    return r.select("review_id", "category", F.array_join(F.transform("book_ids", lambda i: i.cast("string")), " ").alias("book_ids"), "detail")


@query("limit_per_pass", "select category, review_id from (select category, review_id, row_number() over (partition by category order by review_id) as rn from review) where rn <= 10")
def q_limit_per_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten findings of every category."""
    return first_rows(table(spark, sf_dir, "review"), "category", ["review_id"], 10).select("category", "review_id")


@query(
    "intake_deliveries",
    "select date_trunc('day', received_at) as start, channel, count(*) as records from intake where received_at is not null group by 1, 2",
)
def q_intake_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streamed count of deliveries."""
    i = table(spark, sf_dir, "intake").where("received_at is not null")
    return i.groupBy(F.window("received_at", "1 day"), "channel").agg(F.count("*").alias("records")).select(F.col("window.start").alias("start"), "channel", "records")


# ---- passes over answers of services, the fetched records as the answers --------------------


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched records that share an author with a book as answers for it, in the order of their ids."""
    b, m = _books(spark, sf_dir), table(spark, sf_dir, "fetched_meta").where("title is not null")
    names = lambda df, i: df.select(i, F.explode("authors").alias("name")).where("name is not null").withColumn("folded", T.fold(F.col("name"))).where(~F.col("folded").isin(JUNK_NAMES)).select(i, "folded").distinct()
    met = names(b, "id").join(names(m, "meta_id"), "folded").select(F.col("id").alias("book_id"), "meta_id").distinct()
    return met.join(m, "meta_id").withColumnRenamed("meta_id", "rank")


@query("fetch_changes")
def q_fetch_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _books(spark, sf_dir)
    return fetch_pass(b, _answers(spark, sf_dir), flags=series_pass(b).flags).changes


@query(
    "series_lookup_changes",
    """
    with h as (select p_partkey, p_type, p_size, row_number() over (partition by p_type, p_size order by p_partkey) as rn from part where p_partkey % 3 = 0)
    select p_partkey as book_id, 'series' as field, p_type as after from h where rn = 1
    union all select p_partkey, 'series_index', cast(cast(p_size as double) as varchar) from h where rn = 1 and p_size != 1
    """,
)
def q_series_lookup_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as books without a series; every third is found in a catalogue, and the lowest id gets a volume that several want."""
    p = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    books = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array(F.concat(F.lit("A "), "p_brand")).alias("authors"), none.alias("series"), F.lit(1.0).alias("series_index"))
    hits = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("book_id"), F.lit(1).alias("rank"), F.col("p_name").alias("title"), F.lit("").alias("subtitle"), F.array(F.concat(F.lit("A "), "p_brand")).alias("authors"), F.col("p_type").alias("series"), F.col("p_size").cast("double").alias("position"))
    return series_lookup_pass(books, hits).changes.select("book_id", "field", "after")


@query("classify_changes")
def q_classify_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "fetched_meta").where("series is not null and series != ''").select(F.col("series").alias("query"), F.col("series").alias("title"), F.lit("").alias("main_title"), F.lit("novel").alias("medium")).distinct()
    return classify_pass(_books(spark, sf_dir), hits, {"general": ["Granite", "Umber"]}).changes


@query("junk_author_books")
def q_junk_author_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return junk_author_books(_books(spark, sf_dir)).select("book_id", "name", "info.reason")
