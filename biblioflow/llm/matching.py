"""Records of two tables matched without a shared key.

1. Each record becomes attributes of tokens: title parts, author names, series, volume.
2. Random walks over the graph record - attribute - token, one from every record of
   either side, give sequences of tokens. Their pairs within two steps are counted, and
   skip-gram vectors are trained on all counts. A token's vector is the mean of the vectors
   of its letters and of its pairs of letters next to each other or one apart, in either
   order, so the model has a fixed size and a misspelt token stays near the right one.
3. A record has a vector for its title with each of its authors: sums of token vectors by
   their rarity over all rows, rare tokens of a name (the family) counting most. Tables of
   random hyperplanes hash every row's vectors; rows of the other side also look into the
   PROBES likeliest neighbouring buckets, those whose planes the vector lies nearest to.
   There are as many tables as keep the share of pairs HIT_ANGLE degrees apart that meet
   at HIT_RATE when planes are added. One more table hashes the title alone, for records
   whose lists of authors differ. Buckets are kept apart by volume, so that a long series
   does not fill one. Rows also meet, whatever their vectors, by an equal word of an author
   with an equal beginning or end of a title; without authors by an equal title or first
   part. Pairs that meet are kept if the letters and letter pairs of the titles by which
   they met may be near. Rows of equal letters are joined first, by those: a record whose
   best such book reaches the highest rank there is looks into no bucket, as nothing it
   would find there could come before.
4. The pairs are compared exactly: title parts within a small edit distance, volume,
   authors by assignment of names. Exact cosines, together with the levels of that
   comparison, are calibrated to a confidence by a logistic curve on all pairs. Its labels
   are not those of the comparison but the agreement of publisher and year, which no vector
   and no level holds: matches agree in them at one rate, rows put together at random at
   another.
   A pair counts if the exact comparison allows it and its confidence reaches SURE.

Rows with equal attributes are hashed once. The number of planes grows with the
logarithm of the rows, so buckets keep their size.

Defined results: records without a title are matched to nothing; without authors only by
an equal title that no other work has; of records equally near the one with more equal
attributes, then the smallest id is chosen; writings about a book match only records that
are writings about it as well. The curve starts at BELIEVED, which holds where no publisher
or year can be compared, and moves away from it as far as the labels say.
"""

from __future__ import annotations

import gc
import math
import re
import time
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioflow.llm.canon import letters, within
from biblioflow.llm.people import fits, parse, plain
from biblioflow.session import discard, written

DIMS = 64
GRAM_BUCKETS = 1 << 12
COUNT_BUCKETS = 1 << 16
CONTEXTS, STEPS, ROUNDS, RATE = 1 << 8, 4, 20, 0.25
SLICES = 16
PROBES, MORE_PROBES = 8, 32
WEAKEST = 6
HIT_ANGLE, HIT_RATE = 25, 0.9
BUCKET = 32
NAMES_WEIGH = 0.7
HOT_SHARE, HOT_LEAST, HOT_PLANES = 1024, 1000, 8
EDIT_BITS, NEAR_BEGINNING = 6, 6
GROUP_ROWS, AT_ONCE = 1_000_000, 100_000
SURE = 0.5
# weights of the curve before any label: 1, cosine, title allowed, author allowed, title level, share of authors, agreement
BELIEVED = (-9.0, 4.0, 4.0, 5.0, 0.0, 0.0, 0.0)

# Words for volumes and their numbers; words of editions; frames of writings about a book.
VOLUME_WORDS = r"volume|vol|book|bk|tome|part|band|bd|number|no|nr|teil"
NUMBER_WORDS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split(), 1)}
EDITION = r"edition|\bed\b|print|reissue|abridged|unabridged|ebook|e-book|paperback|hardcover|hardback|kindle|audio(?:book)?|annotated|illustrated|revised|anniversary|reprint|deluxe|boxed set"
ABOUT = r"^(?:a |the )?(?:study guide|reading guide|readers guide|reader s guide|teachers guide|guide|summary|analysis|companion|introduction|notes|making|story|history behind|essays|workbook|review|critical essays|conversation starters|unofficial companion|sparknotes|cliffsnotes)\b\s*(?::|of\b|to\b|on\b|for\b)|\b(?:summary|analysis|text|study|questions|guide|commentary|essays)(?: and| &) (?:notes|analysis|summary|review|commentary|discussion)\b|\band notes$|\b(?:study|reading|readers) guide$"
ROMAN = r"(?=[ivxl])(?:xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
ROLES = r"\((?:narrator|illustrator|translator|editor|introduction|foreword|afterword|cover|photographer|reader)[^)]*\)"
_ABOUT = re.compile(ABOUT)
_EDITION = re.compile(rf"\s*[(\[][^)\]]*(?:{EDITION})[^)\]]*[)\]]|\s+[-–]\s+[^-–:]*(?:{EDITION})\s*$|,?\s+(?:revised|2nd|second|third|3rd|\d+th) edition$")
_ROLE = re.compile(ROLES, re.I)
_VOLUME = re.compile(rf"[\s,:;\-–(\[]*(?:(?<![a-z0-9])(?:(?:{VOLUME_WORDS})[\s.]+(?P<n>\d{{1,3}}|{'|'.join(NUMBER_WORDS)}|{ROMAN})|(?:{VOLUME_WORDS}|v|#)[\s.]*(?P<d>\d{{1,3}})))(?:\.0)?\b[\s)\]]*(?=$|[:,\-–])")
# cheap signs without which the patterns cannot match
_VOLUME_HINT = re.compile(rf"\d|\b(?:{VOLUME_WORDS})\b")
_BARE_ENDS = frozenset("0123456789ivxl)]")
_ABOUT_HINT = re.compile(r"guide|summary|analysis|companion|introduction|notes|making|story|history behind|essays|workbook|review|conversation|study|text|questions|commentary")
_BLANKS, _ARTICLE, _ARTICLE_LAST = re.compile(r"\s+"), re.compile(r"^(?:the|an?)\s+"), re.compile(r",\s*(?:the|an?)$")
_PARTS = re.compile(r"\s*:\s+|\s+/\s+|\s+[-–]\s+|\s*;\s+|(?<=\w{3})\.\s+|\s+\((?=[^)]*\)$)")
_BARE = re.compile(rf"[\s,(\[]+(0*\d{{1,3}}|{ROMAN})[)\]]?$")


def roman(s: str) -> int:
    values = {"i": 1, "v": 5, "x": 10, "l": 50}
    return sum(-values[a] if b and values[a] < values[b] else values[a] for a, b in pairwise(s + " ") for b in [b.strip()])


def number(s: str) -> int:
    return int(s) if s.isdigit() else NUMBER_WORDS.get(s) or roman(s)


def title_read(title: str | None, series: str | None = None) -> tuple[list[str], list[str], int, bool, bool]:
    """(keys of the parts, words of the parts, volume or -1, cut short, about another book)."""
    s = letters(plain(title or "")).strip()
    if "  " in s or not s.isprintable():  # no other blank is printable
        s = _BLANKS.sub(" ", re.sub(r"\s{2,}(?=\S)", " : ", s)).strip()
    if not s:
        return [], [], -1, False, False
    about = _ABOUT_HINT.search(s) is not None and _ABOUT.search(s.replace("'", " ")) is not None
    s = _EDITION.sub("", s).strip() if "(" in s or "[" in s or "-" in s or "–" in s or s.endswith("edition") else s
    cut = s.endswith(("…", "..."))
    s = s.rstrip("…. ")
    volume = -1
    if _VOLUME_HINT.search(s) and (m := _VOLUME.search(s)):
        volume, s = number(m["n"] or m["d"]), (s[: m.start()] + s[m.end() :])
    elif s[-1:] in _BARE_ENDS and (m := _BARE.search(s)) and m.start() > 3:
        volume, s = number(m[1]), s[: m.start()]
    parts = []
    for p in [s] if s.replace(" ", "").isalnum() else _PARTS.split(s):
        p = p.strip(" ,.:-()")
        p = _ARTICLE_LAST.sub("", p) if "," in p else p
        bare = _ARTICLE.sub("", p) if p.startswith(("the", "a")) else p
        joined, simple = bare.replace(" ", ""), p.replace(" ", "").isalnum()
        k = joined if simple else re.sub(r"[^a-z0-9]", "", joined.replace("&", "and")) if p.isascii() else re.sub(r"[\W_]", "", joined)
        if k:
            parts.append((k, p if simple else re.sub(r"[^\w]+", " ", p)))
    own = re.sub(r"[\W_]", "", _ARTICLE.sub("", letters(plain(series.replace("&", " and "))))) if series and len(parts) > 1 else ""
    if len(parts) > 1 and own and within(parts[0][0], own, 2):  # the series put before the title
        parts = parts[1:]
    return [k for k, _ in parts], [p for _, p in parts], volume, cut, about


def title_parts(title: str | None, series: str | None = None) -> tuple[list[str], int, bool, bool]:
    """(keys of the parts and words of the first, volume or -1, cut short, about another book)."""
    keys, words, *rest = title_read(title, series)
    return keys + words[:1], *rest


def author_key(name: str) -> str:
    """Tokens of a name, the family name first where that is known."""
    toks, lead, kind = parse(_ROLE.sub(" ", name) if "(" in name else name)
    return f"{kind[0]}{max(lead, 0)} " + " ".join(toks) if toks else ""


def all_placed(allowed: list[list[int]], taken: tuple[int, ...] = ()) -> bool:
    """Whether every row can be given a place of its own among those allowed (augmenting paths)."""
    holder: dict[int, int] = {}
    place_of: dict[int, int] = {}

    def place(i: int) -> bool:
        seen, stack, came = set(taken), [i], {}
        while stack:
            r = stack.pop()
            for j in allowed[r]:
                if j in seen:
                    continue
                seen.add(j)
                came[j] = r
                if j in holder:
                    stack.append(holder[j])
                    continue
                while True:  # a free place: everyone on the way moves on by one
                    r = came[j]
                    last = place_of.get(r)
                    holder[j], place_of[r] = r, j
                    if r == i:
                        return True
                    j = last
        return False

    return all(place(i) for i in range(len(allowed)))


@lru_cache(100_000)
def letter_set(s: str) -> int:
    out = 0
    for c in s:
        out |= 1 << (ord(c) & 31)
    return out


def slip(s: str, t: str) -> bool:
    """Whether two words of four letters or more are near; each edit changes two letters of the set at most."""
    if len(s) < 4 or len(t) < 4:
        return False
    k = 1 if min(len(s), len(t)) < 7 else 2
    return abs(len(s) - len(t)) <= k and (letter_set(s) ^ letter_set(t)).bit_count() <= 2 * k and within(s, t, k)


@lru_cache(100_000)
def same_author(a: str, b: str) -> bool:
    """Whether two author keys may name one author: every token of the shorter one assigned to one of the other."""
    (ka, *x), (kb, *y) = a.split(), b.split()
    if ka[0] != kb[0]:
        return False
    if sorted(x) == sorted(y):
        return True
    if len(x) > len(y):
        x, y = y, x
    if len(x) != len(y) and "".join(sorted("".join(x))) == "".join(sorted("".join(y))):
        return True
    if ka[0] == "b" and len(x) != len(y):
        return False
    meet: dict[str, list[int]] = {}
    for t in x:
        if t not in meet:
            meet[t] = [j for j, u in enumerate(y) if t == u or slip(t, u) or fits(t, u) or fits(u, t)]
            if not meet[t]:
                return False
    allowed = [meet[t] for t in x]
    if ka[0] == "b":
        return all_placed(allowed)
    if len(x) == 1:  # what else the longer name has are initials
        return any(len(y[j]) > 3 < len(x[0]) and all(len(u) == 1 for k, u in enumerate(y) if k != j) for j in allowed[0])
    # some two long tokens meet, and the rest can be placed as well
    tried = {(x[i], y[j]): (i, j) for i in range(len(x)) for j in allowed[i] if len(x[i]) > 3 < len(y[j])}
    return any(all_placed(allowed[:i] + allowed[i + 1 :], (j,)) for i, j in tried.values())


class Model:
    """Vectors of letter groups, and the rarity of tokens and titles."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, titles: np.ndarray, rows: int) -> None:
        self.grams, self.counts, self.titles, self.rows = grams, counts, titles, max(rows, 2)
        self.middle = np.zeros((2, DIMS), np.float32)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table, self.rarity = np.zeros((1024, DIMS), np.float32), np.zeros(1024, np.float32)

    def learned(self, grams: np.ndarray, share: np.ndarray) -> "Model":
        """The model with trained vectors, and what the records have in common taken out. share: of every letter group in the mean title and the mean name."""
        self.grams, self.middle = grams, (share @ grams / np.sqrt((grams * grams).sum(axis=1).mean())).astype(np.float32)
        self.clear()
        return self

    def rare(self, token: str) -> float:
        return min(max(math.log(self.rows / (1 + self.counts[zlib.crc32(token.encode()) % COUNT_BUCKETS])) / math.log(self.rows), 0.1), 0.7)

    def hot(self, title: str) -> bool:
        """Whether so many records have the title that its bucket is divided by their authors."""
        return self.titles[zlib.crc32(title.encode()) % COUNT_BUCKETS] > max(HOT_LEAST, self.rows / HOT_SHARE)

    def _place(self, tokens: list[str]) -> None:
        """Vectors of tokens that have no place yet."""
        for start in range(0, len(tokens), 2000):
            some = tokens[start : start + 2000]
            first, (grams, n) = len(self.at), grams_of(some)
            while first + len(some) > len(self.table):
                self.table, self.rarity = np.concatenate((self.table, np.zeros_like(self.table))), np.concatenate((self.rarity, np.zeros_like(self.rarity)))
            self.table[first : first + len(some)] = _unit(_segments(self.grams, grams, n))
            self.rarity[first : first + len(some)] = [self.rare(w) for w in some]
            self.at.update(zip(some, range(first, first + len(some))))

    def _sums(self, lists: list[list[str]], names: int) -> np.ndarray:
        if len(self.at) > 300_000:
            self.clear()
        at = self.at
        if new := {w: None for ws in lists for w in ws if w not in at}:
            self._place(list(new))
        flat = np.array([at[w] for ws in lists for w in ws], dtype=np.int64)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return _segments(self.table, flat, sizes, self.rarity[flat] ** (3 if names else 1))

    def vectors(self, lists: list[list[str]], names: bool = False) -> np.ndarray:
        """Unit vectors of token lists: of titles, or of names."""
        return _unit(_unit(self._sums(lists, int(names))) - self.middle[int(names)])


def _segments(rows: np.ndarray, at: np.ndarray, sizes: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Sums of rows[at], weighted, over segments of the sizes, one after the other: the k-th row of all segments at once."""
    out = np.zeros((len(sizes), rows.shape[1]), np.float32)
    order, first = np.argsort(-sizes, kind="stable"), np.cumsum(sizes) - sizes
    longer = len(sizes) - np.cumsum(np.bincount(sizes, minlength=1))  # segments of more than k rows
    for k, n in enumerate(longer.tolist()):
        if n:
            some = first[order[:n]] + k
            out[:n] += rows[at[some]] if weight is None else rows[at[some]] * weight[some][:, None]
    back = np.empty_like(out)
    back[order] = out
    return back


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1, n)


def name_tokens(author: str) -> list[str]:
    """Tokens of an author key that say something: initials only where there is nothing else."""
    toks = author.split()[1:]
    return [t for t in toks if len(t) > 1] or toks


def _gram(g: str) -> int:
    return zlib.crc32("".join(sorted(g)).encode()) % GRAM_BUCKETS


@lru_cache(1)
def _ascii_grams() -> tuple[np.ndarray, np.ndarray]:
    """Buckets of ASCII letters and of their pairs."""
    some = list(map(chr, range(128)))
    return np.array([_gram(c) for c in some]), np.array([[_gram(c + d) for d in some] for c in some])


def _bucket(code: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Buckets of letters, or of pairs of letters in either order."""
    one, two = _ascii_grams()
    plain = code < 128 if other is None else (code < 128) & (other < 128)
    out = one[np.where(plain, code, 0)] if other is None else two[np.where(plain, code, 0), np.where(plain, other, 0)]
    if not plain.all():
        on = np.flatnonzero(~plain)
        both, which = np.unique(code[on] if other is None else code[on] << 32 | other[on], return_inverse=True)
        out[on] = np.array([_gram(chr(x) if other is None else chr(x >> 32) + chr(x & 0xFFFFFFFF)) for x in both.tolist()])[which]
    return out


def grams_of(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the tokens' letters and of their pairs of letters at most one apart, in either order, one token after the other; how many each has."""
    n = np.fromiter(map(len, tokens), np.int64, len(tokens))
    code = np.frombuffer("".join(f"<{w}>" for w in tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = 3 * n + 1
    to = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n + 2) - (n + 2)), n + 2) + np.arange(len(code))  # of a token's first letters, its first pairs
    left = np.repeat(np.cumsum(n + 2), n + 2) - np.arange(len(code)) - 1  # letters behind
    length = np.repeat(n, n + 2)
    out = np.empty(int(sizes.sum()), np.int64)
    at = np.flatnonzero(left >= 1)
    out[to[at]] = _bucket(code[at], code[at + 1])
    at = np.flatnonzero(left >= 2)
    out[to[at] + length[at] + 1] = _bucket(code[at], code[at + 2])
    out[to[at] + 2 * length[at] + 1] = _bucket(code[at + 1])
    return out, sizes


class Walks:
    """Counts of what random walks over the graph record - attribute - token see, of a fixed size.

    Every record starts a walk of STEPS tokens; from a token it goes on to a record of the
    same batch that holds it. seen: how often a letter group has a token (by its bucket)
    within two steps. share: how much of each letter group the titles and the names hold.
    """

    def __init__(self, model: "Model", seed: int = 5) -> None:
        self.model, self.rng = model, np.random.default_rng(seed)
        self.seen, self.share, self.records = np.zeros(GRAM_BUCKETS * CONTEXTS), np.zeros((2, GRAM_BUCKETS)), np.zeros(2)

    def add(self, records: list[tuple[list[list[str]], int, list[int]]]) -> None:
        """records: (tokens of every attribute, which of them is the title, which are names)."""
        at: dict[str, int] = {}
        flat, sizes, of_record, kinds = [], [], [], []
        for r, (attributes, title, names) in enumerate(records):
            for k, ws in enumerate(attributes):
                if ws:
                    flat += [at.setdefault(w, len(at)) for w in ws]
                    sizes.append(len(ws)), of_record.append(r), kinds.append(0 if k == title else 1 if k in names else 2)
        if not flat:
            return
        words = list(at)
        gram, n_grams = grams_of(words)
        gram_at = np.cumsum(n_grams) - n_grams
        context = np.array([zlib.crc32(w.encode()) % CONTEXTS for w in words])
        rarity = np.array([self.model.rare(w) for w in words])
        flat, sizes, of_record, kinds = np.array(flat), np.array(sizes), np.array(of_record), np.array(kinds)
        start = np.cumsum(sizes) - sizes
        for k in (0, 1):  # unit vectors of titles and of names, as if the letter groups stood at right angles
            on = np.repeat(kinds == k, sizes)
            if on.any():
                own, weight = np.repeat(np.arange(len(sizes)), sizes)[on], rarity[flat[on]] ** (3 if k else 1)
                length = np.sqrt(np.bincount(own, weight**2, len(sizes)))
                per_word = np.bincount(flat[on], weight / length[own], len(words)) / np.sqrt(n_grams)
                self.share[k] += np.bincount(gram, np.repeat(per_word, n_grams), GRAM_BUCKETS)
                self.records[k] += (kinds == k).sum()
        first = np.searchsorted(of_record, np.arange(len(records) + 1))
        owner = np.repeat(of_record, sizes)
        by_word = np.argsort(flat, kind="stable")
        held = np.bincount(flat, minlength=len(words))
        held_at = np.cumsum(held) - held
        now, line = np.flatnonzero(np.diff(first)), []
        for _ in range(STEPS):
            a, b, c = self.rng.random((3, len(now)))
            attribute = first[now] + (a * (first[now + 1] - first[now])).astype(np.int64)
            w = flat[start[attribute] + (b * sizes[attribute]).astype(np.int64)]
            line.append(w)
            now = owner[by_word[held_at[w] + (c * held[w]).astype(np.int64)]]
        pairs = [x * CONTEXTS + context[y] for i, x in enumerate(line) for y in line[max(0, i - 2) : i] + line[i + 1 : i + 3]]
        pair, times = np.unique(np.concatenate(pairs), return_counts=True)
        x_of, y_of = divmod(pair, CONTEXTS)
        n = n_grams[x_of]
        cell = gram[np.repeat(gram_at[x_of] - np.cumsum(n) + n, n) + np.arange(n.sum())] * CONTEXTS + np.repeat(y_of, n)
        self.seen += np.bincount(cell, np.repeat(times / n, n), GRAM_BUCKETS * CONTEXTS)


def listed(s: str) -> list[str]:
    return s.split(BREAK) if s else []


def texts(df: DataFrame, *columns: str) -> DataFrame:
    """Columns whose lists are joined by BREAK."""
    return df.select(*(F.array_join(c, BREAK).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.select(*columns).dtypes))


def summed(rows: DataFrame, kind: type, total_as: type) -> dict[int, np.ndarray]:
    """Sums of arrays by slice; what the driver gets has a fixed size. rows: (slice, told), compressed arrays of a kind."""

    def total(b: pd.DataFrame) -> pd.DataFrame:
        told = sum(np.frombuffer(zlib.decompress(x), kind).astype(total_as) for x in b["told"])
        return pd.DataFrame({"slice": b["slice"].iloc[:1], "told": [zlib.compress(told.astype(kind).tobytes(), 1)]})

    return {r["slice"]: np.frombuffer(zlib.decompress(r["told"]), kind) for r in rows.groupBy("slice").applyInPandas(total, "slice int, told binary").collect()}


def walked(rows: DataFrame, model) -> tuple[np.ndarray, np.ndarray]:
    """(seen, share) of walks from every row; what the driver gets has a fixed size."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = Walks(model.value)
        for b in batches:
            records = []
            for words, authors, series in zip(b["words"], b["authors"], b["series"]):
                names = [name_tokens(a) for a in listed(authors)]
                records.append(([words.split(), *names, series.split()], 0, range(1, len(names) + 1)))
            w.add(records)
        if w.records.any():
            yield pd.DataFrame([(k, zlib.compress(x.astype(np.float32).tobytes(), 1)) for k, x in enumerate((*np.split(w.seen, SLICES), w.share.ravel(), w.records))], columns=["slice", "told"])

    got = summed(texts(rows, "words", "authors", "series").mapInPandas(walk, "slice int, told binary"), np.float32, np.float64)
    if not got:
        return np.zeros((GRAM_BUCKETS, CONTEXTS)), np.zeros((2, GRAM_BUCKETS))
    return np.concatenate([got[k] for k in range(SLICES)]).reshape(GRAM_BUCKETS, CONTEXTS), got[SLICES].reshape(2, -1) / np.maximum(got[SLICES + 1], 1)[:, None]


def trained(seen: np.ndarray, seed: int = 5, rounds: int = ROUNDS) -> np.ndarray:
    """Vectors of letter groups by skip-grams with negative sampling over all the pairs counted: gradients of the whole, not of pairs drawn."""
    rng = np.random.default_rng(seed)
    grams, out = rng.standard_normal((GRAM_BUCKETS, DIMS)).astype(np.float32), np.zeros((CONTEXTS, DIMS), np.float32)
    if not seen.any():
        return grams
    by_gram, by_context = seen.sum(axis=1, keepdims=True), seen.sum(axis=0, keepdims=True)
    often_gram, often_context = by_gram / by_gram.sum(), by_context / by_context.sum()
    of_gram, of_context = seen / np.maximum(by_gram, 1e-9), seen / np.maximum(by_context, 1e-9)
    for _ in range(rounds):
        near = 1 / (1 + np.exp(-np.clip(grams @ out.T, -9, 9)))
        to_gram, to_context = of_gram * (1 - near) - often_context * near * (by_gram > 0), of_context * (1 - near) - often_gram * near * (by_context > 0)
        grams, out = (grams + RATE * to_gram @ out).astype(np.float32), (out + RATE * to_context.T @ grams).astype(np.float32)
    return grams


def features(df: DataFrame, id_col: str) -> DataFrame:
    """(id, publisher, year, parts, words, volume, series_no, cut, about, authors, series) of every record with a title. Parts, words and authors are joined by BREAK."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[str, str] = {}
        for b in batches:
            out = []
            for i, title, authors, series, index, publisher, year in zip(*(b.column(c).to_pylist() for c in ("id", "title", "authors", "series", "series_index", "publisher", "year"))):
                parts, words, volume, cut, about = title_read(title, series)
                if not parts:
                    continue
                named = []
                for a in authors or ():
                    if a is None or ("(" in a and _ROLE.search(a) and len(authors) > 1):
                        continue
                    if a not in keys:
                        if len(keys) > 300_000:
                            keys.clear()
                        keys[a] = author_key(a)
                    if keys[a] and keys[a] not in named:
                        named.append(keys[a])
                own = re.sub(r"\W+", " ", _ARTICLE.sub("", letters(plain(series)))) if series else ""
                index = int(index) if index is not None and index == index and 0 < index < 1 << 31 and index == int(index) else -1
                out.append((i, publisher, year, BREAK.join(parts), BREAK.join(words), volume, index, cut, about, BREAK.join(sorted(named)), own.strip()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), kinds)], names=["id", "publisher", "year", *ATTRIBUTES])

    kinds = [pa.int64(), *[pa.string()] * 4, *[pa.int32()] * 2, *[pa.bool_()] * 2, *[pa.string()] * 2]
    evidence = [F.lower(F.trim(F.coalesce("publisher", F.lit("")))).alias("publisher"), F.substring(F.coalesce("pubdate", F.lit("")), 1, 4).alias("year")]
    schema = "id bigint, publisher string, year string, parts string, words string, volume int, series_no int, cut boolean, about boolean, authors string, series string"
    return df.select(F.col(id_col).alias("id"), "title", "authors", "series", F.col("series_index").cast("double"), *evidence).where("title is not null").mapInArrow(read, schema)


ATTRIBUTES = ["parts", "words", "volume", "series_no", "cut", "about", "authors", "series"]
BREAK = "\n"  # between parts, words or authors, which have letters, digits and blanks only: one text costs less to move than a list


def _bits(x: np.ndarray) -> np.ndarray:
    return (x > 0).astype(np.int64) @ (np.int64(1) << np.arange(x.shape[-1], dtype=np.int64))


_HALF, _REST, _ODD = (1 << 61) - 1, (1 << 26) - 1, (1 << 32) - 1 << 26


def edits(n: int) -> int:
    """Edits allowed between titles of which the shorter one has so many letters."""
    return 0 if n < 5 else 1 if n < 9 else 2 if n < 16 else 3


def halves(texts: list[str], cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What says whether texts (none is empty) may be near, in two numbers.

    Of letter pairs 61 bits, the edits allowed above them, negative if the text is cut short; of letter pairs
    26 bits, of letters that stand there an odd number of times 32, of the length five.
    """
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    if not len(n):
        return n, n
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum(n)
    bit = ((code * 0x9E3779B1 ^ np.append(code[1:], 0) * 0x85EBCA6B) * 0xC2B2AE35 >> 8 & 0xFFFFFF) % 87
    low, high = (np.where(on, np.int64(1) << np.where(on, at, 0), 0) for on, at in ((bit < 61, bit), (bit >= 61, bit - 61)))
    low[ends - 1] = high[ends - 1] = 0  # the last letter of a text begins no pair
    low, high = (np.bitwise_or.reduceat(x, ends - n) for x in (low, high))
    odd = np.bitwise_xor.reduceat(np.int64(1) << (code & 31), ends - n)
    one = low | (np.searchsorted((5, 9, 16), n, "right") << 61)
    return np.where(cut, one | np.int64(-1 << 63), one), high | odd << 26 | (n & 31) << 58


def alike(one: np.ndarray, two: np.ndarray, one_b: np.ndarray, two_b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of texts may be as near as the comparison asks, by their halves; the others are not.

    An edit changes two odd letters and four pairs at most, or it is a swap: no letter and six pairs. A text within
    two edits of a beginning has NEAR_BEGINNING pairs at most that the other lacks.
    """
    two_i, two_j = two[i], two_b[j]
    odd = (np.bitwise_count((two_i ^ two_j) & _ODD) + 1) >> 1
    longer = ((two_i >> 58) - (two_j >> 58)) & 31
    ok = (odd <= 3) & ((longer <= 3) | (longer >= 29))
    on = np.flatnonzero(ok)
    x, y, rest, odd = one[i[on]], one_b[j[on]], (two_i[on] ^ two_j[on]) & _REST, odd[on]
    allowed, longer = np.minimum(x >> 61 & 3, y >> 61 & 3), longer[on]
    pairs = np.bitwise_count((x ^ y) & _HALF).astype(np.int64) + np.bitwise_count(rest) + 2 * odd
    ok[on] = (odd <= allowed) & ((longer + allowed & 31) <= 2 * allowed) & (pairs <= allowed * EDIT_BITS)
    some, some_b = one < 0, one_b < 0
    for on, way in ((some[i] if some.any() else None, 0), (some_b[j] if some_b.any() else None, 1)):
        if on is not None:
            on = np.flatnonzero(on & ~ok)
            sides = (one[i[on]], two_i[on]), (one_b[j[on]], two_j[on])
            (x, z), (y, w) = sides[way], sides[1 - way]
            ok[on] = np.bitwise_count(x & ~y & _HALF) + np.bitwise_count(z & ~w & _REST) <= NEAR_BEGINNING
    return ok


# which of the weakest planes each probe may turn
_TURNS = [(), *(c for n in (1, 2, 3) for c in combinations(range(WEAKEST), n))]
_TURN_OF = np.array([[i in c for c in _TURNS] for i in range(WEAKEST)], np.float32)


def probed(proj: np.ndarray, probes: int) -> np.ndarray:
    """Bucket numbers, the likeliest first: the own one, and those behind the planes that the vector lies nearest to. proj: (..., planes)."""
    own = _bits(proj)[..., None]
    if probes == 1:
        return own
    weak = np.argsort(np.abs(proj), axis=-1)[..., :WEAKEST]
    margin = np.take_along_axis(np.abs(proj), weak, axis=-1) ** 2
    turn = _TURN_OF[: weak.shape[-1]]
    possible = np.flatnonzero(_TURN_OF[weak.shape[-1] :].sum(axis=0) == 0)
    cost = margin @ turn[:, possible]
    best = np.argsort(cost, axis=-1, kind="stable")[..., :probes]
    flips = (np.int64(1) << weak.astype(np.int64)) @ turn[:, possible].astype(np.int64)
    return own ^ np.take_along_axis(flips, best, axis=-1)


def tables_for(planes: int, angle: float = HIT_ANGLE, rate: float = HIT_RATE) -> int:
    """Least number of tables in which pairs at the angle meet at the rate or more."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((50_000, planes)).astype(np.float32)
    y = math.cos(math.radians(angle)) * x + math.sin(math.radians(angle)) * rng.standard_normal(x.shape).astype(np.float32)
    met = float((probed(x, PROBES) == _bits(y)[:, None]).any(axis=1).mean())
    return max(1, math.ceil(math.log(1 - rate) / math.log(1 - min(max(met, 1e-4), 0.99))))


def shared_keys(parts: list[str], authors: list[str], alone: bool = False, second: bool = True) -> list[tuple[int, str]]:
    """(key, text): every long word of an author, else all its letters, with the beginning and the end of a text: the title, its first and, if asked, its second part.

    alone, or without authors: the whole title and its first part as well.
    """
    joined = "".join(parts)
    ends = []
    for s in {joined, *parts[: 1 + second]}:  # near titles differ by 3 letters at most, so both sides have one length of ends in common
        n = len(s)
        if n < 20:
            ends += [(_crc("<" + s[:4]), s), (_crc(">" + s[-4:]), s)]
        if n >= 13:
            ends += [(_crc("<" + s[:8]), s), (_crc(">" + s[-8:]), s)]
    codes: set[int] = set()
    for a in authors:
        toks = a.split()[1:]
        codes |= {_crc(w) << 31 for w in toks if len(w) > 3} or {_crc(" " + "".join(sorted("".join(toks)))) << 31}
    out = [(w ^ e, s) for e, s in ends for w in codes]
    if alone or not authors:
        out += [(zlib.crc32(f"={s}".encode()), s) for s in {joined, parts[0]}]
    return out


@lru_cache(200_000)
def _crc(s: str) -> int:
    return zlib.crc32(s.encode())


def _mix(key: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    """One 64-bit key of a bucket number and what else has to be equal."""
    x = (key.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(kind).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _hashed(rows: DataFrame, model, planes: int, tables: int, probe: bool, parts: int) -> DataFrame:
    """(part, told): the buckets of every row in all tables, with neighbours if it probes, and its shared keys.

    told: packets of (key, sid, one, two), the keys of one of the parts in each: rows by themselves
    would cost more to move than to make. one, two: the letter pairs of what was hashed (halves); two
    is negative if the row probes.
    """

    def hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        rng = np.random.default_rng(11)
        by_title = rng.standard_normal((DIMS, planes)).astype(np.float32)
        by_both = rng.standard_normal((DIMS, tables * planes)).astype(np.float32)
        by_name = rng.standard_normal((DIMS, HOT_PLANES)).astype(np.float32)
        for whole in batches:
            if len(whole):
                yield packets(np.concatenate([block(m, by_title, by_both, by_name, whole.iloc[start : start + 2000]) for start in range(0, len(whole), 2000)], axis=1))

    def packets(told: np.ndarray) -> pd.DataFrame:
        part = (told[0].view(np.uint64) >> np.uint64(33)).astype(np.int64) % parts
        order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        told, ends = told[:, order], np.cumsum(np.bincount(part, minlength=parts))
        return pd.DataFrame([(k, told[:, low:high].tobytes()) for k, (low, high) in enumerate(pairwise([0, *ends.tolist()])) if high > low], columns=["part", "told"])

    def block(m: Model, by_title: np.ndarray, by_both: np.ndarray, by_name: np.ndarray, b: pd.DataFrame) -> np.ndarray:
        n = len(b)
        (parts, words, authors), cut = ([listed(x) for x in b[c].tolist()] for c in ("parts", "words", "authors")), b["cut"].tolist()
        behind_series = [probe and x != "" for x in b["series"]]
        # texts by which a row may meet: its first part, its whole title, the second part behind a series
        owner, text, toks = list(range(n)), [p[0] for p in parts], [w[0].split() for w in words]
        for i in range(n):
            if len(parts[i]) > 1:
                owner.append(i), text.append("".join(parts[i])), toks.append(" ".join(words[i]).split())
                if behind_series[i]:
                    owner.append(i), text.append(parts[i][1]), toks.append(words[i][1].split())
        owner, cut_short = np.array(owner, np.int64), np.array(cut, bool)
        marks = halves(text, cut_short[owner])
        t = m.vectors(toks)
        of = np.array([i for i in range(n) for _ in authors[i]], np.int64)
        a = m.vectors([name_tokens(x) for xs in authors for x in xs], names=True)
        found: list[tuple[np.ndarray, ...]] = []  # keys, rows, halves

        def add(row: np.ndarray, keys: np.ndarray, table: np.ndarray | int, of_text: np.ndarray, marks: tuple = marks) -> None:
            k = _mix(keys, table)
            if len(k):
                found.append((k.ravel(), *(np.repeat(x, k[0].size) for x in (row, *(m[of_text] for m in marks)))))

        odd = np.array([bool(c or not x) for c, x in zip(cut, authors)])
        hot = np.array([m.hot(" ".join(x)) for x in toks])
        # by the title alone
        proj = t @ by_title
        for some, probes in (((~hot & ~odd[owner]) | (not probe), 1), (odd[owner] & ~hot & probe, MORE_PROBES)):
            some = np.flatnonzero(some & ~hot)
            add(owner[some], probed(proj[some], probes), 0, some)
        if hot.any() and len(of):
            at = {}
            for k, i in enumerate(of):
                at.setdefault(i, []).append(k)
            pairs = np.array([(k, x) for k in np.flatnonzero(hot) for x in at.get(owner[k], [])], np.int64).reshape(-1, 2)
            own = _bits(proj[pairs[:, 0]])[:, None] << HOT_PLANES
            add(owner[pairs[:, 0]], own + probed(a[pairs[:, 1]] @ by_name, PROBES if probe else 1), 1, pairs[:, 0])
        # by the title with each author
        both = (_unit(t[of] + np.float32(NAMES_WEIGH) * a) @ by_both).reshape(-1, tables, planes)
        numbers = 2 + np.arange(tables)[:, None]
        for some, probes in ((np.flatnonzero(~odd[of] | (not probe)), PROBES if probe else 1), (np.flatnonzero(odd[of] & probe), MORE_PROBES)):
            add(of[some], probed(both[some], probes), numbers, of[some])
        # whatever the vectors
        known: dict[str, int] = {}
        shared, which, times = [], [], []
        for i in range(n):
            own = shared_keys(parts[i], authors[i], not probe, behind_series[i])
            shared += [k for k, _ in own]
            which += [known.setdefault(s, len(known)) for _, s in own]
            times.append(len(own))
        by = np.repeat(np.arange(n), times)
        one, two = halves(list(known), np.zeros(len(known), bool))
        one = np.where(cut_short[by], one[which] | np.int64(-1 << 63), one[which])
        add(by, np.array(shared, np.int64)[:, None], 1 << 20, np.arange(len(by)), (one, two[which]))
        if not found:
            return np.zeros((4, 0), np.int64)
        key, row, *marks = (np.concatenate(x) for x in zip(*found))
        # volumes: rows without a number in the title may meet each other, rows of one number may meet
        volume, number_in_series, about = (b[c].to_numpy().astype(np.int64) for c in ("volume", "series_no", "about"))
        some = np.where(volume >= 0, volume, number_in_series)
        out = []
        for keep, kind in ((volume < 0, np.full(n, -1, np.int64)), (some >= 0, some)):
            on = np.flatnonzero(keep[row])
            out.append((_mix(key[on], 2 * (kind[row[on]] + 1) + about[row[on]]), b["sid"].to_numpy()[row[on]], *(m[on] for m in marks)))
        out = np.concatenate([np.stack(x) for x in out], axis=1)
        if probe:
            out[3] |= np.int64(-1 << 63)
        return out

    return rows.select("sid", *ATTRIBUTES).mapInPandas(hash_rows, "part int, told binary")


def meetings(keys: DataFrame, parts: int) -> DataFrame:
    """(b, m): rows of the two sides that meet in a bucket and may be alike. keys: the packets of both sides for so many parts (_hashed)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = [np.frombuffer(x.as_buffer(), np.int64).reshape(4, -1) for b in batches for x in b.column("told")]
        if not told:
            return
        key, sid, one, two = np.concatenate(told, axis=1)
        probe, two = two < 0, two & np.int64((1 << 63) - 1)
        b, m = np.flatnonzero(~probe), np.flatnonzero(probe)
        b, m = b[np.argsort(key[b], kind="stable")], m[np.argsort(key[m], kind="stable")]
        b_key, b_one, b_two, m_key = key[b], one[b], two[b], key[m]
        low = np.searchsorted(b_key, m_key, "left")
        n = np.searchsorted(b_key, m_key, "right") - low
        m, low, n = m[n > 0], low[n > 0], n[n > 0]
        letters_m, letters_b, cut_m, cut_b = (two[m] >> 26).astype(np.uint32), (b_two >> 26).astype(np.uint32), one[m] < 0, b_one < 0
        some_m, some_b = bool(cut_m.any()), bool(cut_b.any())
        met = []
        ends, at = np.cumsum(n), 0
        while at < len(m):  # so many bucket mates at once, or those of one row
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
            times = n[at:to]
            j = np.arange(ends[to - 1] - before) + np.repeat(low[at:to] - (ends[at:to] - times - before), times)
            near = np.bitwise_count(np.repeat(letters_m[at:to], times) ^ letters_b[j]) <= 6  # what no other test can save is left out first
            if some_m:
                near |= np.repeat(cut_m[at:to], times)
            if some_b:
                near |= cut_b[j]
            near = np.flatnonzero(near)
            i, j = m[at + np.searchsorted(ends[at:to], before + near, "right")], j[near]
            ok = alike(one, two, b_one, b_two, i, j)
            met.append((b[j[ok]], i[ok]))
            at = to
        if met:
            x, y = (sid[np.concatenate(k)] for k in zip(*met))
            names, code = np.unique(np.concatenate((x, y)), return_inverse=True)
            x, y = divmod(np.unique(code[: len(x)] * len(names) + code[len(x) :]), len(names))
            yield pa.RecordBatch.from_pydict({"b": names[x], "m": names[y]})

    return keys.repartitionById(parts, "part").mapInArrow(meet, "b bigint, m bigint").distinct()


def counted(df: DataFrame) -> np.ndarray:
    """How many rows hold a token, how many a title, and how many all letters of one, by buckets of their hash."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, known = np.zeros(3 * COUNT_BUCKETS, np.int64), {}
        for b in batches:
            found: list[int] = []
            for words, authors, whole in zip(b["words"], b["authors"], b["parts"].str.replace(BREAK, "", regex=False)):
                toks = words.replace(BREAK, " ").split(" ")
                for a in listed(authors):
                    toks += a.split(" ")[1:]
                own = set()
                for w in toks:
                    k = known.get(w)
                    if k is None:
                        if len(known) > 300_000:
                            known.clear()
                        k = known[w] = zlib.crc32(w.encode()) % COUNT_BUCKETS
                    own.add(k)
                found += own
                found += {zlib.crc32(w.encode()) % COUNT_BUCKETS + COUNT_BUCKETS for w in {words.partition(BREAK)[0], words.replace(BREAK, " ")}}
                found.append(zlib.crc32(whole.encode()) % COUNT_BUCKETS + 2 * COUNT_BUCKETS)
            out += np.bincount(np.array(found, np.int64), minlength=len(out))
        if out.any():
            yield pd.DataFrame([(k, zlib.compress(x.tobytes(), 1)) for k, x in enumerate(np.split(out, SLICES))], columns=["slice", "told"])

    got = summed(texts(df, "words", "authors", "parts").mapInPandas(count, "slice int, told binary"), np.int64, np.int64)
    return (np.concatenate([got[k] for k in range(SLICES)]) if got else np.zeros(3 * COUNT_BUCKETS, np.int64)).reshape(3, COUNT_BUCKETS)


def cosines(m: Model, b: pd.DataFrame) -> np.ndarray:
    """Cosine of title and author of every pair: of the likest two authors, by the first parts or the whole titles. b: words and authors of both sides, joined by BREAK."""
    titles: dict[str, int] = {}
    names: dict[str, int] = {}
    sides = []
    for p in "mb":
        words = b[f"{p}_words"].tolist()
        first = np.array([titles.setdefault(w.partition(BREAK)[0], len(titles)) for w in words], np.int64)
        whole = np.array([titles.setdefault(w.replace(BREAK, " "), len(titles)) for w in words], np.int64)
        sides.append((first, whole, [[names.setdefault(x, len(names)) for x in listed(a)] for a in b[f"{p}_authors"].tolist()]))
    t, a = m.vectors([x.split() for x in titles]), m.vectors([name_tokens(x) for x in names], names=True)
    (f1, w1, a1), (f2, w2, a2) = sides
    title = np.maximum((t[f1] * t[f2]).sum(axis=1), (t[w1] * t[w2]).sum(axis=1))
    likest = np.full(len(b), -1.0, np.float32)
    cross = [(k, i, j) for k, (x, y) in enumerate(zip(a1, a2)) for i in x for j in y]
    if cross:
        k, i, j = np.array(cross).T
        np.maximum.at(likest, k, (a[i] * a[j]).sum(axis=1))
    return np.where(np.array([bool(x and y) for x, y in zip(a1, a2)]), (title + NAMES_WEIGH**2 * likest) / (1 + NAMES_WEIGH**2), title)


def matches(books: DataFrame, metas: DataFrame) -> DataFrame:
    """(book_id, meta_id, cosine, confidence) of every fetched record that describes a book.

    books: id, title, authors, series, series_index, publisher, pubdate. metas: the same with meta_id.
    """
    spark = books.sparkSession
    sides = []
    told = lambda c: F.when(F.col(c) != "", F.xxhash64(c)).alias(c)
    for df, i, p in ((books, "id", "b"), (metas, "meta_id", "m")):
        read = written(features(df, i).withColumn("sid", F.xxhash64(*ATTRIBUTES)), f"{p}_read")
        rows = read.groupBy("sid").agg(*(F.first(c).alias(c) for c in ATTRIBUTES), F.min(F.struct("id", told("publisher"), told("year"))).alias("x"))  # equal by sid
        rows = written(rows.select("sid", *ATTRIBUTES, "x.publisher", "x.year"), f"{p}_rows")
        ids = written(read.select("id", F.col("sid").alias(p), told("publisher"), told("year")), f"{p}_ids")
        discard(read)
        sides.append((rows, ids))
    (b_rows, b_ids), (m_rows, m_ids) = sides

    (counts, titles, letters_of), n_books, n_metas = counted(b_rows.unionByName(m_rows)), b_rows.select(F.sum(F.length("authors") - F.length(F.replace("authors", F.lit(BREAK), F.lit(""))) + 1)).first()[0] or 0, m_rows.count()
    model = Model(np.zeros((GRAM_BUCKETS, DIMS), np.float32), counts, titles, n_books + n_metas)
    blank = spark.sparkContext.broadcast(model)  # of a fixed size
    seen, share = walked(b_rows.unionByName(m_rows), blank)
    model = spark.sparkContext.broadcast(model.learned(trained(seen), share))
    hot = np.flatnonzero(letters_of > max(HOT_LEAST, model.value.rows / HOT_SHARE)).tolist()  # HOT_SHARE * 2 at most

    def paired(pairs: DataFrame) -> DataFrame:
        """Pairs of rows compared. pairs: the columns of both sides."""
        same = [F.coalesce((F.col(f"m_{c}") == F.col(f"b_{c}")).cast("int"), F.lit(-1)).alias(f"{c}_same") for c in ("publisher", "year")]
        pairs = pairs.select("b", "m", *(f"{p}_{c}" for p in "bm" for c in ATTRIBUTES), *same)

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = model.value
            for b in batches:
                if len(b):
                    told = pd.DataFrame(list(map(compared, *(b[f"{p}_{c}"].tolist() for p in "mb" for c in COMPARED))), columns=["title_level", "author_level", "agree"], index=b.index)
                    told.insert(0, "cosine", cosines(m, b).astype(np.float64))
                    yield pd.concat([b[["b", "m"]], told, b["m_authors"].eq("").rename("lone"), b["b_authors"].str.replace(BREAK, "|", regex=False).rename("work"), b[["publisher_same", "year_same"]]], axis=1)

        return pairs.mapInPandas(compare, "b bigint, m bigint, cosine double, title_level int, author_level double, agree int, lone boolean, work string, publisher_same int, year_same int")

    side = lambda df, p: df.select(F.col("sid").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in (*ATTRIBUTES, "publisher", "year")))
    b_side, m_side = side(b_rows, "b"), side(m_rows, "m")
    all_of = lambda c: F.replace(c, F.lit(BREAK), F.lit(""))

    # records with all letters of a book's title: they need no vectors to meet it
    common = lambda whole: F.pmod(F.crc32(whole.cast("binary")), F.lit(COUNT_BUCKETS)).isin(hot) if hot else F.lit(False)
    titled = lambda df, p: df.select(F.col("sid").alias(p), all_of("parts").alias(f"{p}_whole"), F.substring_index("parts", BREAK, 1).alias(f"{p}_first"), F.get(F.split("parts", BREAK), F.lit(1)).alias(f"{p}_second"), F.col("cut").alias(f"{p}_cut"), common(all_of("parts")).alias(f"{p}_common"))
    volumes = F.when((F.col("m_volume") >= 0) | (F.col("b_volume") >= 0), _volume("m") == _volume("b")).otherwise(F.lit(True))
    m_all, b_all = all_of("m_parts"), all_of("b_parts")
    keyed = lambda df, whole, p: df.withColumn("letters", F.xxhash64(whole, f"{p}_about"))
    equal = keyed(m_side, m_all, "m").where(~common(m_all)).join(keyed(b_side, b_all, "b").hint("merge"), "letters").where((m_all == b_all) & volumes)
    exact = written(paired(equal), "exact")
    # no other book can rank above the best of those, and all that rank as high have the same letters: such records need not be looked up further
    most = (_volume("m") >= 0).cast("int") + (F.col("m_series") != "").cast("int")
    best = exact.where((F.col("title_level") == 4) & (F.col("author_level") == 1)).groupBy("m").agg(F.max("agree").alias("agree"))
    settled = written(best.join(m_side.select("m", most.alias("most")).hint("merge"), "m").where("agree = most").select("m"), "settled")

    planes = max(4, math.ceil(math.log2(max(2, n_books / BUCKET))))
    tables = tables_for(planes)

    def collected() -> None:
        """Shuffles that nothing reads any more are deleted; what the first collection lets go is found by the second."""
        for _ in range(2):
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)  # files are deleted in the background

    def searched(rows: DataFrame) -> DataFrame:
        """Pairs of rows that meet in a bucket, compared, but for those of equal letters."""
        collected()  # else the shuffles of the rows stay on the disks
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((16 * n_books + 60 * n_metas) / GROUP_ROWS))
        keys = _hashed(b_rows, model, planes, tables, False, parts).unionByName(_hashed(rows, model, planes, tables, True, parts))
        met = written(meetings(keys, parts), "met")
        collected()  # else the shuffled buckets stay on the disks
        pairs = met.join(titled(m_rows, "m").hint("merge"), "m").join(titled(b_rows, "b").hint("merge"), "b").where(_near() & ~((F.col("m_whole") == F.col("b_whole")) & ~F.col("m_common"))).select("b", "m")
        out = written(paired(pairs.join(m_side.hint("merge"), "m").join(b_side.hint("merge"), "b")), "scored")
        discard(met)
        del keys, pairs, met
        collected()  # and those of the pairs
        return out

    scored = exact.unionByName(searched(m_rows.join(settled.select(F.col("m").alias("sid")).hint("merge"), "sid", "left_anti")))
    weights = _curve(scored, b_ids, m_ids)
    signs = evidence(F.col("cosine"), F.col("title_level"), F.col("author_level"), F.col("agree"), lambda ok: ok.cast("double"))
    confidence = 1 / (1 + F.exp(-sum((F.lit(float(w)) * x for w, x in zip(weights[1:], signs)), F.lit(float(weights[0])))))
    allowed = lambda df: df.where((F.col("title_level") > 0) & (F.col("author_level") > 0) & (F.col("agree") >= 0)).withColumn("confidence", confidence).where(F.col("confidence") >= SURE)
    good = allowed(scored)
    unsure = settled.join(good.select("m").hint("merge"), "m", "left_anti")
    if not unsure.isEmpty():  # their best pairs do not count after all
        good = allowed(scored.unionByName(searched(m_rows.join(unsure.select(F.col("m").alias("sid")).hint("merge"), "sid", "left_semi"))))
    # without authors only a title that no other work has
    works = good.where("lone").groupBy("m").agg(F.count_distinct("work").alias("works")).where("works > 1")
    good = good.join(works.select("m").hint("merge"), "m", "left_anti")
    good = good.select("b", "m", "cosine", "confidence", (F.col("title_level") * 10 + F.col("author_level") * 10 + F.col("agree")).alias("score"))

    # equal publishers and years count before the smallest id: each record looks its book up by both, one and none of them
    def ways(df: DataFrame) -> DataFrame:
        p, y, none = F.col("publisher"), F.col("year"), F.lit(None).cast("bigint")
        one = F.array(*(F.struct(x.alias("p"), z.alias("y"), F.lit(n).alias("same")) for x, z, n in ((p, y, 2), (p, none, 1), (none, y, 1), (none, none, 0))))
        some = F.col("p").isNotNull().cast("int") + F.col("y").isNotNull().cast("int")
        return df.withColumn("way", F.explode(one)).drop("publisher", "year").select("*", "way.*").drop("way").where(some == F.col("same")).withColumns({c: F.coalesce(c, F.lit(0)) for c in "py"})

    first = ways(b_ids.join(good.select("b").distinct().hint("merge"), "b", "left_semi")).groupBy("b", "p", "y").agg(F.min("id").alias("book_id"))
    m_kinds = m_ids.select("m", "id", "publisher", "year", *(F.coalesce(c, F.lit(0)).alias(k) for k, c in (("mp", "publisher"), ("my", "year"))))
    asked = ways(m_kinds.drop("id").distinct().join(good.hint("merge"), "m"))
    best = asked.join(first.hint("merge"), ["b", "p", "y"]).groupBy("m", "mp", "my").agg(F.max(F.struct("score", "same", "cosine", (-F.col("book_id")).alias("low"), "book_id", "confidence")).alias("x"))
    on = m_kinds.select("m", "mp", "my", F.col("id").alias("meta_id"))
    return on.join(best.hint("merge"), ["m", "mp", "my"]).select("x.book_id", "meta_id", F.col("x.cosine").alias("cosine"), F.col("x.confidence").alias("confidence"))


def evidence(cosine, title, author, agree, flag) -> list:
    """What the confidence rests on, of columns or of arrays."""
    return [cosine, flag(title > 0), flag(author > 0), title / 5.0, author * 1.0, agree * 1.0]


def _volume(p: str) -> Column:
    """A row's volume: that of its title, else its number in the series; -1 if it has neither."""
    return F.when(F.col(f"{p}_volume") >= 0, F.col(f"{p}_volume")).otherwise(F.col(f"{p}_series_no"))


def _near() -> Column:
    """Whether the comparison may allow the titles of a pair; a swap counts as two edits here."""
    m, b = ((F.col(f"{p}_whole"), F.col(f"{p}_first")) for p in "mb")
    n = lambda x, y: F.least(F.length(x), F.length(y))
    edited = lambda x, y: F.when(n(x, y) < 5, x == y).when(n(x, y) < 9, F.levenshtein(x, y, 2) >= 0).when(n(x, y) < 16, F.levenshtein(x, y, 4) >= 0).otherwise(F.levenshtein(x, y, 6) >= 0)
    begins = lambda p, x, y: F.col(f"{p}_cut") & (F.levenshtein(x, F.substr(y, F.lit(1), F.length(x)), 4) >= 0)
    return edited(m[0], b[0]) | (~((m[0] == m[1]) & (b[0] == b[1])) & edited(m[1], b[1])) | F.coalesce(edited(F.col("m_second"), b[1]), F.lit(False)) | begins("m", m[0], b[0]) | begins("b", b[0], m[0])


def _curve(scored: DataFrame, b_ids: DataFrame, m_ids: DataFrame) -> np.ndarray:
    """Weights of the confidence, from the publishers and years of all pairs of one volume.

    Pairs of equal evidence are counted together, the cosine to hundredths, so that what the driver gets has a bound.
    """
    on = [F.round("cosine", 2).alias("cosine"), F.round("author_level", 2).alias("author_level"), "title_level", "agree", "publisher_same", "year_same"]
    cells = scored.where("agree >= 0").groupBy(*on).agg(F.count("*").alias("n")).toPandas().sort_values(["cosine", "author_level", "title_level", "agree", "publisher_same", "year_same"])
    if not len(cells):
        return np.array(BELIEVED)
    # how often a book and a record drawn together agree: exactly, from how often each publisher and year occurs
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in enumerate(("publisher", "year")))))
    often = [ids.select(kinds.alias("x")).select("x.*").where(F.col("value").cast("string") != "").groupBy("kind", "value").agg(F.count("*").cast("double").alias(p)) for ids, p in ((b_ids, "nb"), (m_ids, "nm"))]
    both = often[0].join(often[1].hint("merge"), ["kind", "value"], "full").groupBy("kind").agg((F.sum(F.col("nb") * F.col("nm")) / (F.sum("nb") * F.sum("nm"))).alias("rate"))
    rates = {r["kind"]: r["rate"] or 0.0 for r in both.collect()}
    x = np.stack(evidence(*(cells[c].to_numpy(float) for c in ("cosine", "title_level", "author_level", "agree")), lambda ok: ok.astype(float)), axis=1)
    agree = cells[["publisher_same", "year_same"]].to_numpy(float)
    return calibrated(x, np.where(agree < 0, np.nan, agree), [rates.get(0, 0.0), rates.get(1, 0.0)], times=cells["n"].to_numpy(float))


# what of either side is compared
COMPARED = ["parts", "volume", "series_no", "cut", "about", "authors", "series"]


def compared(m_parts: str, m_volume: int, m_no: int, m_cut: bool, m_about: bool, m_authors: str, m_series: str, b_parts: str, b_volume: int, b_no: int, b_cut: bool, b_about: bool, b_authors: str, b_series: str) -> tuple[int, float, int]:
    """(title level, share of authors that meet, agreement) of a pair; 0 or less means no match. Parts and authors are joined by BREAK."""
    mp, bp = m_parts.split(BREAK), b_parts.split(BREAK)
    fm, fb = "".join(mp), "".join(bp)

    def near(x: str, y: str) -> int:
        if x == y:
            return 3
        n = min(len(x), len(y))
        return 2 if within(x, y, edits(n)) else 0

    def cut(x: str, y: str) -> bool:
        return len(x) >= 8 and (y.startswith(x) or within(x, y[: len(x)], 2))

    level = near(fm, fb)
    level = level + 1 if level else near(mp[0], bp[0])
    if not level and len(mp) > 1 and m_series != "" and near(mp[1], bp[0]):
        level = 1
    if not level and m_cut and cut(fm, fb) or not level and b_cut and cut(fb, fm):
        level = 2
    if m_about != b_about:
        level = 0
    ma, ba = listed(m_authors), listed(b_authors)
    met = sum(x in ba or any(same_author(x, y) for y in ba) for x in ma)
    authors = met / max(1, len(ma)) if ma and ba else (0.01 if not ma and level >= 3 else 0.0)
    agree = 0
    mv, bv = (m_volume if m_volume >= 0 else m_no), (b_volume if b_volume >= 0 else b_no)
    numbered = m_volume >= 0 or b_volume >= 0
    if mv >= 0 and bv >= 0:
        agree = 1 if mv == bv else (-1 if numbered else 0)
    elif numbered:
        agree = -1
    if agree >= 0 and m_series and b_series and within(m_series, b_series, 2):
        agree += 1
    return level, authors, agree


def calibrated(x: np.ndarray, agree: np.ndarray, chance: list[float], rounds: int = 30, pull: float = 1.0, times: np.ndarray | None = None) -> np.ndarray:
    """Weights of the logistic curve from evidence to the probability of a match, by expectation and maximisation.

    x: evidence, the cosine first. agree: per pair and attribute 1, 0 or nan. A match agrees
    at the rate of the pairs of highest cosine, another pair at the rate of chance. pull: how
    strongly the weights are held at BELIEVED. times: how many pairs each row stands for.
    """
    believed = np.array(BELIEVED)
    x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
    times = np.ones(len(x)) if times is None else times
    order = np.argsort(x[:, 1])
    top = x[:, 1] >= x[order[np.searchsorted(np.cumsum(times[order]), 0.8 * times.sum())], 1]
    ratio = np.zeros(len(x))
    for k, rate in enumerate(chance):
        known = np.isfinite(agree[:, k])
        hit, miss = float(np.clip(np.average(agree[known & top, k], weights=times[known & top]), 0.02, 0.98)) if (known & top).any() else 0.0, min(max(rate, 0.002), 0.9)
        if hit > miss:
            ratio += np.where(known, np.where(agree[:, k] == 1, math.log(hit / miss), math.log((1 - hit) / (1 - miss))), 0)
    told = np.isfinite(agree).any(axis=1)
    x, ratio, times, w = x[told], ratio[told], times[told], believed
    for _ in range(rounds):
        label = 1 / (1 + np.exp(-np.clip(x @ w + ratio, -30, 30)))
        was = w
        for _ in range(5):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (times * (label - p)) - pull * (w - believed)
            w = w + np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), grad)
        if np.abs(w - was).max() < 1e-4:
            break
    return w
