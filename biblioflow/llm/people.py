"""Variant spellings of the names of persons and bodies, linked where they mean one.

1. Names and sort forms are cut into tokens; look-alike letters, accents, titles, life
   dates and additions go. Tokens are counted.
2. A symmetric-delete index finds near tokens: every token of four letters or more
   brings its spellings with one or two letters left out, and tokens that meet in a
   spelling are compared by edit distance with swaps. A rare token leads to the nearest
   token that is clearly more frequent, its root. A pair of neighbouring rare tokens is
   tried as one token as well, for names broken in two.
3. Each name becomes a signature: family root and given names (full, short form or
   initial), taken from name and sort form, whichever says more; for bodies the set of
   their roots.
   A family near a more frequent one, however frequent both are, is read as its slip if
   ALIGNED of its written-out given names or more mean persons of that one.
4. Within a family, signatures are aligned with the full given names: each given name
   must be assigned its equal, a short form of it or its initial. Differing first or
   middle names keep people apart; a signature that fits more than one person is linked
   to none.

All steps are joins on tokens, spellings or families. What is grouped per family are
its distinct signatures, not its rows; pairs are made last, by an equi-join on the
entity.

Defined results: names without letters (NULL, "", digits) are linked to nothing; rows
whose names are equal are linked unless they fit more than one person.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflow.llm.canon import letters, osa, within
from biblioflow.llm.lookalikes import _decomposed
from biblioflow.session import spread, written

# Short forms of given names in use in English.
SHORT_NAMES = {
    "abby": "abigail", "gail": "abigail", "abbie": "abigail", "al": "albert alan alexander", "alec": "alexander", "alex": "alexander alexandra", "sandy": "alexander sandra", "sasha": "alexander", "xander": "alexander", "lex": "alexander",
    "andy": "andrew", "drew": "andrew", "annie": "anne anna", "tony": "anthony antonia", "art": "arthur", "babs": "barbara", "barb": "barbara",
    "ben": "benjamin", "benny": "benjamin", "benji": "benjamin", "bert": "albert robert herbert", "beth": "elizabeth bethany", "betty": "elizabeth", "betsy": "elizabeth", "bess": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "lizzy": "elizabeth", "eliza": "elizabeth", "libby": "elizabeth", "lisa": "elizabeth",
    "bill": "william", "billy": "william", "will": "william", "willy": "william", "willie": "william", "liam": "william", "bob": "robert", "bobby": "robert", "rob": "robert", "robbie": "robert", "robby": "robert",
    "cathy": "catherine", "kate": "katherine catherine", "katie": "katherine", "kathy": "katherine", "kit": "katherine christopher", "kitty": "katherine", "kat": "katherine", "kay": "katherine",
    "charlie": "charles charlotte", "chuck": "charles", "chas": "charles", "chris": "christopher christine christina", "topher": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david", "davy": "david",
    "deb": "deborah", "debbie": "deborah", "debby": "deborah", "dick": "richard", "rick": "richard", "ricky": "richard", "rich": "richard", "richie": "richard", "dolly": "dorothy", "dot": "dorothy", "dottie": "dorothy", "dora": "theodora dorothy isadora", "thea": "theodora dorothea", "teddy": "edward theodore theodora", "ted": "edward theodore",
    "ed": "edward edmund edwin", "eddie": "edward edmund", "ned": "edward", "ellie": "eleanor", "nell": "eleanor helen", "nelly": "eleanor", "nora": "eleanor", "ella": "eleanor",
    "fran": "francesca frances", "frankie": "francesca francis frank", "fanny": "frances francesca", "franny": "francesca frances", "chess": "francesca", "frank": "francis", "fred": "frederick", "freddie": "frederick", "freddy": "frederick",
    "gabe": "gabriel", "gabby": "gabriella gabrielle", "gene": "eugene", "geoff": "geoffrey", "jeff": "jeffrey", "gerry": "gerald", "jerry": "gerald jerome jeremy", "greg": "gregory", "greta": "margaret", "maggie": "margaret", "meg": "margaret", "peg": "margaret", "peggy": "margaret", "marge": "margaret", "madge": "margaret", "daisy": "margaret", "rita": "margaret", "mags": "margaret",
    "hal": "henry harold", "harry": "henry harold", "hank": "henry", "hattie": "harriet", "harri": "harriet", "hetty": "harriet henrietta", "izzy": "isabella isabel isadora", "bella": "isabella", "belle": "isabella", "isa": "isabella", "jack": "john", "johnny": "john", "jake": "jacob", "jim": "james", "jimmy": "james", "jamie": "james", "jem": "james", "jay": "jason james",
    "jo": "josephine joanna joseph", "josie": "josephine", "josey": "josephine", "posy": "josephine", "joe": "joseph", "joey": "joseph", "jos": "joseph", "ken": "kenneth kenjiro", "larry": "lawrence laurence", "laurie": "lawrence laura", "lenny": "leonard", "len": "leonard", "leo": "leonard leopold", "lou": "louis louise", "matt": "matthew", "matty": "matthew",
    "mick": "michael", "mickey": "michael", "mike": "michael", "micky": "michael", "mikey": "michael", "mitch": "mitchell", "nat": "nathaniel", "nate": "nathaniel", "nick": "nicholas", "nicky": "nicholas", "nico": "nicholas", "colin": "nicholas",
    "pat": "patricia patrick", "patty": "patricia", "trish": "patricia", "tricia": "patricia", "patsy": "patricia", "penny": "penelope", "nell'": "penelope", "pen": "penelope", "pete": "peter", "phil": "philip", "ray": "raymond", "becky": "rebecca", "becca": "rebecca", "reba": "rebecca", "ron": "ronald", "rosie": "rosalind rosemary", "roz": "rosalind", "ros": "rosalind", "rose": "rosalind", "lindy": "rosalind", "sally": "sarah", "sam": "samuel samantha", "sammy": "samuel", "steve": "stephen", "stevie": "stephen", "steph": "stephanie stephen", "sue": "susannah susan", "susie": "susannah susan", "suzy": "susannah susan", "susy": "susannah", "sukey": "susannah", "sanna": "susannah",
    "tim": "timothy", "timmy": "timothy", "toby": "tobias", "tom": "thomas", "tommy": "thomas", "tori": "victoria", "vicky": "victoria", "vicki": "victoria", "vic": "victor victoria", "vikki": "victoria", "tor": "victoria", "vince": "vincent", "walt": "walter", "wally": "walter", "zach": "zachary", "zack": "zachary", "zac": "zachary", "zak": "zachary",
}
# Words of bodies' names with their short forms; words without weight; titles and additions.
BODY_WORDS = {
    "institute": "inst instit", "society": "soc", "museum": "mus", "foundation": "fdn found fnd", "department": "dept dep", "association": "assoc assn ass", "committee": "cttee comm ctte", "collective": "coll", "university": "univ uni",
    "international": "intl internat int", "historical": "hist", "circle": "circ cir", "writers": "writ", "printers": "print", "letters": "lett", "folklore": "folk", "reading": "read", "map": "", "college": "", "academy": "acad", "council": "", "library": "lib", "press": "", "group": "grp", "club": "", "bureau": "", "office": "off", "company": "co", "school": "sch", "center": "ctr", "centre": "ctr", "league": "", "union": "", "guild": "",
}
LIGHT_WORDS = {"of", "the", "for", "and", "a", "an", "de", "der", "des", "la", "le", "et", "und"}
TITLES = {"dr", "prof", "professor", "sir", "dame", "lord", "lady", "rev", "mr", "mrs", "ms", "miss", "hon", "st", "author", "editor", "ed", "eds", "translator", "illustrator", "by"}
ADDED = {"phd", "md", "ma", "ba", "msc", "bsc", "esq", "llb", "obe", "mbe", "frs", "dphil"}
GENERATIONS = {"jr", "sr", "ii", "iii", "iv", "junior", "senior"}

# Fixed value: least share of a family's written-out signatures that mean persons of the family it is a slip of.
ALIGNED = 0.8
# Fixed value: how many times as frequent as its slip a token is at least, however large the data; in small data its square is enough.
SLIP_RATE = 20

_BODY_SHORT = {s: w for w, ss in BODY_WORDS.items() for s in ss.split()}
_FULL = {s: tuple(v.split()) for s, v in SHORT_NAMES.items()}
_MAPPED: dict[str, str] = {}


def plain(s: str) -> str:
    """Lower-case letters of one form, for comparison."""
    if not s.isascii():
        for c in set(s):
            if not c.isascii() and c not in _MAPPED:
                _MAPPED[c] = _decomposed(c)
        s = "".join(c if c.isascii() else _MAPPED[c] for c in s)
    return s


_AUTHOR_OR_DATES = re.compile(r"\([^)]*\bauthor[^)]*\)|\b\d{3,4}\s*-\s*(?:\d{3,4})?")
_DEGREES = re.compile(r"\b(?:Ph\.\s?D|M\.\s?A|B\.\s?A|M\.\s?D|D\.\s?Phil)\b\.?")
_WITHIN_WORDS, _UPPER, _TOKEN = re.compile(r"(?<=\w)[-'’](?=\w)"), re.compile(r"[^\W\d_a-z]{3,}"), re.compile(r"[^\W\d_]+")


def parse(name: str | None) -> tuple[list[str], int, str]:
    """(tokens, how many of the first make the family name or -1 if unknown, kind) of a name."""
    if not name:
        return [], -1, "none"
    s = plain(name).replace("|", ",")
    # each pattern is tried where it has what it cannot match without
    if "(" in s or "-" in s:
        s = _AUTHOR_OR_DATES.sub(" ", s)
    if "." in s:
        s = _DEGREES.sub(" ", s)
    if "-" in s or "'" in s or "’" in s:
        s = _WITHIN_WORDS.sub("", s)
    upper = [len(t) > 2 and _UPPER.fullmatch(t) is not None for t in _TOKEN.findall(s)]
    groups = [[t for t in _TOKEN.findall(letters(p)) if t not in TITLES and t not in ADDED] for p in s.split(",")]
    flat = [t for g in groups for t in g]
    if not BODY_WORDS.keys().isdisjoint(flat):
        return [_BODY_SHORT.get(t, t) for t in flat if t not in LIGHT_WORDS], -1, "body"
    groups = [g for g in groups if g]
    if len(groups) >= 2 and not all(t in GENERATIONS for t in groups[1]):
        return [t for g in groups for t in g], len(groups[0]), "person"
    lead = next((n for n, u in enumerate(upper) if not u), len(upper))
    if 0 < lead < len(upper) and not any(upper[lead:]) and lead < len(flat) and len(upper) == len(flat):
        return flat, lead, "person"
    return flat, -1, "person" if flat else "none"


def spellings(token: str) -> set[str]:
    """The token and what is left of it without one letter, from seven letters on without two."""
    out = {token}
    for _ in range(1 if len(token) < 7 else 2):
        out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
    return out


def near_pairs(tokens: DataFrame, condition: str) -> DataFrame:
    """(token, n, other, m, d) of tokens within the edits allowed of an other at least as frequent. tokens: token, n."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(v, t, n) for t, n in zip(b["token"], b["n"]) for v in spellings(t)]
            if rows:
                yield pd.DataFrame(rows, columns=["v", "token", "n"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            most = [1 if len(t) < 7 else 2 for t in b["token"]]
            ds = [osa(x, y) if within(x, y, k) else 9 for x, y, k in zip(b["token"], b["other"], most)]
            b = b.assign(d=pd.Series(ds, index=b.index, dtype="int32"))
            yield b[b["d"] < 9]

    idx = spread(tokens.where(F.length("token") >= 4), "token").mapInPandas(index, "v string, token string, n bigint")
    a, b = idx, idx.select("v", F.col("token").alias("other"), F.col("n").alias("m")).where("m > 0")
    pairs = a.join(b.hint("merge"), "v").where(f"{condition} and m >= n and (m > n or other < token) and token != other").select("token", "n", "other", "m")
    pairs = spread(pairs, "token", "other").distinct()
    return pairs.mapInPandas(compare, "token string, n bigint, other string, m bigint, d int")


def near_tokens(tokens: DataFrame) -> DataFrame:
    """(token, root) for tokens that are a slip of a clearly more frequent token. tokens: token, n."""
    best = near_pairs(tokens, f"(m >= n * n or m >= {SLIP_RATE} * n)").groupBy("token").agg(F.min(F.struct("d", (-F.col("m")).alias("m"), "other"))["other"].alias("root"))
    best = written(best, "roots")
    on = best.select(F.col("token").alias("root"), F.col("root").alias("further"))
    return best.join(on.hint("merge"), "root", "left").select("token", F.coalesce("further", "root").alias("root"))


def fits(short: str, full: str) -> bool:
    """Whether a given name may be written so: equal, its short form, or its initial."""
    return short == full or full in _FULL.get(short, ()) or (len(short) == 1 and full.startswith(short)) or (short in _FULL and full in _FULL and bool(set(_FULL[short]) & set(_FULL[full])))


def is_full(given: str) -> bool:
    return len(given) > 1 and given not in _FULL


def cheapest(costs: list[list[float]]) -> tuple[float, list[int]]:
    """Least sum of one cost a row, all in different columns, and the columns (the Hungarian method). No more rows than columns."""
    n, m = len(costs), len(costs[0]) if costs else 0
    of_row, of_col, row_at, came = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_at[0], j = i, 0
        least, done = [float("inf")] * (m + 1), [False] * (m + 1)
        while row_at[j]:
            done[j], r, step, nxt = True, row_at[j], float("inf"), 0
            for k in range(1, m + 1):
                if not done[k]:
                    c = costs[r - 1][k - 1] - of_row[r] - of_col[k]
                    if c < least[k]:
                        least[k], came[k] = c, j
                    if least[k] < step:
                        step, nxt = least[k], k
            for k in range(m + 1):
                if done[k]:
                    of_row[row_at[k]] += step
                    of_col[k] -= step
                else:
                    least[k] -= step
            j = nxt
        while j:
            row_at[j], j = row_at[came[j]], came[j]
    columns = [0] * n
    for k in range(1, m + 1):
        if row_at[k]:
            columns[row_at[k] - 1] = k - 1
    return sum(costs[i][c] for i, c in enumerate(columns)), columns


def assigned(parts: tuple[str, ...], whole: tuple[str, ...]) -> int | None:
    """Least number of places changed when each part is assigned a name of the whole, one of them its first; None if it can't be.

    A part more than the whole has must be an initial, a name less a middle name.
    """
    if len(parts) > len(whole):
        return assigned(whole, parts)
    if not parts:
        return None if whole else 0
    if parts == whole:
        return 0
    never, first = 1e9, 1e4  # a forbidden pair; what taking the first place is worth
    costs = [[(i != j) - first * (j == 0) if fits(p, w) or fits(w, p) else never for j, w in enumerate(whole)] for i, p in enumerate(parts)]
    if any(min(row) == never for row in costs):
        return None
    total, columns = cheapest(costs)
    return int(total + first) if total < never / 2 and 0 in columns else None


def resolve(signatures: list[tuple[str, ...]]) -> dict[tuple[str, ...], str]:
    """The person that each signature of one family means; those that fit several are left out."""
    sigs = sorted(set(signatures))
    known = {g for s in sigs for g in s if is_full(g)}

    @lru_cache(None)
    def told(g: str) -> str:
        """A short form's one full name: the only one known in the family, or the only one there is."""
        if g in _FULL:
            have = [f for f in _FULL[g] if f in known] or list(_FULL[g])
            return have[0] if len(have) == 1 else g
        return g

    clear = {s: tuple(told(g) for g in s) for s in sigs}
    firsts = sorted({c[0] for c in clear.values() if c and is_full(c[0])})
    said, middles = set(clear.values()), {f: set() for f in firsts}
    for c in said:
        if len(c) > 1 and c[0] in middles and all(is_full(g) for g in c[1:]):
            middles[c[0]].add(c[1:])
    persons: list[tuple[str, ...]] = []
    for f in firsts:
        persons += [(f, *m) for m in sorted(middles[f])] or [(f,)]
        if len(middles[f]) > 1 and (f,) in said:
            persons.append((f,))
    # persons by every name of theirs and by its first letter: a signature meets only those that may fit
    by_name: dict[str, list[tuple[str, ...]]] = {}
    for p in persons:
        for k in {*p, *(g[0] for g in p)}:
            by_name.setdefault(k, []).append(p)
    meet = lambda g: {p for k in (g, *_FULL.get(g, ())) for p in by_name.get(k, ())}
    out: dict[tuple[str, ...], str] = {}
    for s, c in clear.items():
        if not c:
            out[s] = ""
            continue
        # a person of as many names or more has one for each of the signature's; a shorter one has one for some
        near = min((meet(g) for g in c), key=len)
        exact = [p for p in near if p == c]
        fit = exact or [p for p in near if len(p) == len(c) and assigned(c, p) == 0] or [p for p in near if len(p) > len(c) and assigned(c, p) == 0]
        if not fit and len(c) > 1 and all(len(g) == 1 for g in c[1:]):  # an initial more than the name has
            fit = [p for p in {p for g in c for p in meet(g)} if len(p) == 1 and assigned(c, p) is not None]
        if not fit:
            fit = [p for p in near if len(p) == len(c) and assigned(c, p) is not None]
        if len(fit) == 1:
            out[s] = " ".join(fit[0])
        elif not fit:  # nobody is written out: equal initials mean one
            out[s] = "?" + " ".join(c)
    return out


def aligned(slip: list[tuple[str, ...]], root: list[tuple[str, ...]]) -> float:
    """Share of the signatures with a full first name in one family that mean persons of the other."""
    found = resolve([*slip, *root])
    persons = {found[s] for s in root if s in found and s and is_full(s[0])}
    full = {s for s in slip if s and is_full(s[0])}
    return sum(found.get(s) in persons for s in full) / len(full) if full else 0.0


def near_families(signed: DataFrame) -> DataFrame:
    """(family, root) for families that are a slip of a near one by their given names. signed: family, givens of every row."""
    people = signed.where("not startswith(family, 'body ')")
    sigs = people.groupBy("family").agg(F.collect_set("givens").alias("sigs"))
    pairs = near_pairs(people.groupBy(F.col("family").alias("token")).agg(F.count("*").alias("n")), "true").select("token", "other", "m", "d")
    pairs = pairs.join(sigs.select(F.col("family").alias("token"), F.col("sigs").alias("slip")).hint("merge"), "token").join(sigs.select(F.col("family").alias("other"), F.col("sigs").alias("whole")).hint("merge"), "other")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = lambda xs: [tuple(x.split()) for x in xs]
        for b in batches:
            yield b[["token", "other", "m", "d"]].assign(share=[aligned(cut(x), cut(y)) for x, y in zip(b["slip"], b["whole"])])

    fit = spread(pairs, "token", "other").mapInPandas(compare, "token string, other string, m bigint, d int, share double").where(F.col("share") >= ALIGNED)
    best = written(fit.groupBy("token").agg(F.min(F.struct("d", (-F.col("share")).alias("share"), (-F.col("m")).alias("m"), "other"))["other"].alias("root")), "families")
    on = best.select(F.col("token").alias("root"), F.col("root").alias("further"))
    return best.join(on.hint("merge"), "root", "left").select(F.col("token").alias("family"), F.coalesce("further", "root").alias("root"))


def signature(name: list[str], lead: int, given_like: list[bool], sort: list[str], sort_lead: int, counts: dict[str, int], joined: dict[tuple[str, str], str]) -> tuple[str, tuple[str, ...]]:
    """(family, given names) from the roots of a name and of its sort form."""

    def halves(tokens: list[str], lead: int, like: dict[str, bool]) -> tuple[str, tuple[str, ...]]:
        toks, n = [], 0
        while n < len(tokens):
            pair = tuple(tokens[n : n + 2])
            if len(pair) == 2 and pair in joined and not (0 <= lead == n + 1):
                toks.append(joined[pair])
                if lead > n:
                    lead -= 1
                n += 2
            else:
                toks.append(tokens[n])
                n += 1
        gen = tuple(t for t in toks if t in GENERATIONS)
        core = [t for t in toks if t not in GENERATIONS]
        if not core:
            return "", ()
        if 0 < lead < len(core):
            return "".join(core[:lead]), (*core[lead:], *gen)
        if len(core) == 1:
            return core[0], gen
        given = [len(t) == 1 or t in _FULL or like.get(t, False) for t in core]
        if given[-1] and (not given[0] or len(core[-1]) == 1):
            return core[0], (*core[1:], *gen)
        return core[-1], (*core[:-1], *gen)

    like = dict(zip(name, given_like))
    family, givens = halves(name, lead, like)
    if not sort or sort_lead <= 0:
        return family, givens
    family2, givens2 = halves(sort, sort_lead, like)
    if family2 != family and not (osa(family, family2) <= 3 and min(len(family), len(family2)) >= 6):
        return family, givens
    if counts.get(family2, 0) > counts.get(family, 0):
        family = family2
    n = max(len(givens), len(givens2))
    merged = []
    for i in range(n):
        x, y = (givens[i] if i < len(givens) else ""), (givens2[i] if i < len(givens2) else "")
        if x and y and not (fits(x, y) or fits(y, x)):
            return family, givens
        merged.append(max((x, y), key=lambda g: (is_full(g) if g else False, len(g))))
    return family, tuple(merged)


def _neighbours() -> Column:
    """Array of (a, b): tokens next to each other in the name or in the sort form."""

    def of(c: str) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1)))
        return F.transform(at, lambda i: F.struct(F.get(F.col(c), i - 1).alias("a"), F.get(F.col(c), i).alias("b")))

    return F.array_union(of("toks"), of("stoks"))


def linked(authors: DataFrame) -> DataFrame:
    """(id, entity) of every row that means a person or body; equal entities mean one.

    authors: id, name, author_sort.
    """

    def cut_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, name, sort in zip(b["id"], b["name"], b["author_sort"]):
                toks, lead, kind = parse(name)
                stoks, slead, skind = parse(sort) if kind == "person" else ([], -1, "none")
                if skind != "person":
                    stoks, slead = [], -1
                rows.append((i, kind, toks, lead, stoks, slead))
            yield pd.DataFrame(rows, columns=["id", "kind", "toks", "lead", "stoks", "slead"])

    parsed = written(
        spread(authors.select("id", "name", "author_sort"), "id").mapInPandas(cut_names, "id bigint, kind string, toks array<string>, lead int, stoks array<string>, slead int").where("kind != 'none'"), "names"
    )
    # counts of tokens, and how often they stand where given names stand
    occ = parsed.select("id", "kind", "lead", "slead", F.size("toks").alias("n"), F.size("stoks").alias("sn"), F.array_union("toks", "stoks").alias("all"), "toks").select(
        "id", F.explode("all").alias("token"), "kind", "lead", "n", "toks"
    )
    at = F.array_position("toks", F.col("token"))
    given = F.when((F.col("kind") == "person") & (at > 0) & (F.col("n") > 1), F.when(F.col("lead") > 0, at > F.col("lead")).otherwise(at < F.col("n")))
    stats = occ.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.when(given, 1).otherwise(0)).alias("g"), F.sum(F.when(~given, 1).otherwise(0)).alias("s"))
    stats = written(stats, "tokens")
    # neighbouring rare tokens, tried as one
    pair = parsed.where("kind = 'person'").select(
        F.explode(_neighbours()).alias("p")
    ).select("p.a", "p.b").where("a is not null and b is not null and length(a) > 1 and length(b) > 1").distinct()
    rare = stats.where("not (g > s and n >= 3)").select("token", "n")
    whole = pair.join(rare.select(F.col("token").alias("a")).hint("merge"), "a").join(rare.select(F.col("token").alias("b")).hint("merge"), "b").select("a", "b", F.concat("a", "b").alias("token")).where("length(token) >= 6")
    whole = written(whole, "pairs")
    virtual = whole.select("token").distinct().join(stats.select("token").hint("merge"), "token", "left_anti").select("token", F.lit(0).cast("bigint").alias("n"))
    fixed = [*SHORT_NAMES, *BODY_WORDS, *GENERATIONS]
    roots = written(near_tokens(stats.select("token", "n").union(virtual)).where(~F.col("token").isin(fixed)), "near")
    root_of = stats.select("token").union(virtual.select("token")).join(roots.hint("merge"), "token", "left").select("token", F.coalesce("root", "token").alias("root"))
    real = stats.join(roots.hint("merge"), "token", "left").groupBy(F.coalesce("root", "token").alias("root")).agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("s").alias("s"))
    known = root_of.join(real.hint("merge"), "root").select("token", "root", "n", (F.expr("g > s and n >= 3")).alias("given_like"))
    known = written(known, "known")
    joins = whole.join(known.where("n > 0").hint("merge"), "token").select("a", "b", F.col("root").alias("whole"), "n")

    # roots of every name's tokens, in order
    def rooted(col: str) -> DataFrame:
        e = parsed.select("id", F.posexplode(col).alias("pos", "token")).join(known.hint("merge"), "token", "left")
        return e.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("root", "token").alias("root"), F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("given_like", F.lit(False)).alias("g")))).alias(f"r_{col}"))

    broken = parsed.where("kind = 'person'").select("id", F.explode(_neighbours()).alias("p")).select("id", "p.a", "p.b").join(joins.hint("merge"), ["a", "b"]).groupBy("id").agg(F.collect_set(F.struct("a", "b", "whole", "n")).alias("broken"))
    rows = parsed.join(rooted("toks").hint("merge"), "id", "left").join(rooted("stoks").hint("merge"), "id", "left").join(broken.hint("merge"), "id", "left")

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                toks, stoks = list(r.r_toks if r.r_toks is not None else []), list(r.r_stoks if r.r_stoks is not None else [])
                name = [t["root"] for t in toks]
                if r.kind == "body":
                    out.append((r.id, "body " + " ".join(sorted(set(name))), ""))
                    continue
                counts = {t["root"]: t["n"] for t in (*toks, *stoks)}
                raw = dict(zip(r.toks, name)) | dict(zip(r.stoks, [t["root"] for t in stoks]))
                joined = {}
                for x in r.broken if r.broken is not None else []:
                    joined[raw.get(x["a"], x["a"]), raw.get(x["b"], x["b"])] = x["whole"]
                    counts[x["whole"]] = max(counts.get(x["whole"], 0), x["n"])
                like = {t["root"]: t["g"] for t in (*toks, *stoks)}
                family, givens = signature(name, r.lead, [like[t] for t in name], [t["root"] for t in stoks], r.slead, counts, joined)
                if family:
                    out.append((r.id, family, " ".join(givens)))
            yield pd.DataFrame(out, columns=["id", "family", "givens"])

    signed = written(spread(rows.select("id", "kind", "lead", "slead", "toks", "stoks", "r_toks", "r_stoks", "broken"), "id").mapInPandas(sign, "id bigint, family string, givens string"), "signed")

    signed = written(signed.join(near_families(signed).hint("merge"), "family", "left").select("id", F.coalesce("root", "family").alias("family"), "givens"), "joined")

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = resolve([tuple(g.split()) for g in pdf["givens"]])
        rows = [(key[0], g, f"{key[0]}/{found[tuple(g.split())]}") for g in pdf["givens"] if tuple(g.split()) in found]
        return pd.DataFrame(rows, columns=["family", "givens", "entity"])

    settled = spread(signed.select("family", "givens").distinct(), "family").groupBy("family").applyInPandas(settle, "family string, givens string, entity string")
    return signed.join(settled.hint("merge"), ["family", "givens"]).select("id", "entity")


def linked_pairs(authors: DataFrame) -> DataFrame:
    """(id_1, id_2) of all rows that mean one person or body."""
    one = linked(authors)
    one = written(one, "linked")
    return one.select(F.col("id").alias("id_1"), "entity").join(one.select(F.col("id").alias("id_2"), "entity").hint("merge"), "entity").where("id_1 < id_2").select("id_1", "id_2")
