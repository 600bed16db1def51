"""Freely entered names mapped to the entries of a reference list.

The entries and their alias paths (abbreviated words, dropped trailing words, turned
order, prefixes of words) go into one trie of letters. A name, stripped of what tells
nothing, is searched in it with a Levenshtein automaton: one bit set of pattern
positions per number of errors, moved along the trie's edges; a swap of neighbours is
one error. All entries within a distance that depends on the name's length come back;
the nearest is meant. Rival paths, in which one word of an entry is replaced by another
word of the list, lie in the trie too: a name nearest to a rival differs in a telling
word and means none.

The trie is broadcast. It holds the reference list only, whose size is checked
against max_terms; names of any number are searched where they lie, once per distinct
spelling.

Defined results: NULL, empty and blank names mean none (0). Of entries equally near,
the smallest term_id is meant.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from biblioflow.session import spread

# Abbreviations in use for words of publishers' names and for genres.
SHORT_FORMS = {
    "publishing": ["pub", "publ", "pubg"], "publishers": ["publ", "pub", "publs", "pubs", "publisher"], "house": ["hse"], "books": ["bks", "book", "bk"], "library": ["lib"],
    "press": ["pr", "prs"], "university": ["univ", "uni", "u"], "editions": ["eds", "ed", "edns", "edn"], "verlag": ["vlg", "verl"], "group": ["grp", "gp"], "media": ["med"],
    "mathematics": ["maths", "math"], "biography": ["bio", "biog"], "fiction": ["fic"], "photography": ["photo"], "fantasy": ["fant"], "mystery": ["myst"], "economics": ["econ"],
    "philosophy": ["phil", "philos"], "architecture": ["arch"], "history": ["hist"], "sociology": ["soc", "sociol"], "historical": ["hist"], "contemporary": ["contemp"],
    "experimental": ["exp"], "speculative": ["spec"], "juvenile": ["juv"], "medieval": ["med"], "illustrated": ["ill", "illus"], "political": ["pol"],
}
SHORT_PHRASES = {("university", "press"): ["up"], ("publishing", "house"): ["pubhse", "ph"], ("media", "group"): ["mg"]}
# Words that do not tell one entry from another, by kind.
LEGAL = r"ltd|limited|inc|incorporated|gmbh|llc|plc|pty|s\.? ?a|ag|kg|co|corp|company|cie|bv|srl|sarl"
TAIL_WORDS = {"publishers", "publishing", "house", "books", "library", "press", "university", "editions", "verlag", "group", "media"}
TAG_FRAMES = r"^(?:genre|subject|category|tag|topic|keyword)\s*[:=]\s*|^(?:best|good|great|new|top|my)\s+|\s+(?:books?|titles?|stories|novels?)$|[\s\-–]+general$|\(\s*(?:genre|general)\s*\)|\(genre\)"
PLAIN_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i"})


def letters(s: str) -> str:
    """Lower case without accents; separators as they are."""
    if s.isascii():
        return s.lower()
    s = ud.normalize("NFKD", s.casefold())
    return "".join(c for c in s if not ud.combining(c) and ud.category(c) != "Cf").translate(PLAIN_LETTERS)


def squeeze(s: str) -> str:
    return re.sub(r"[^a-z]", "", s) if s.isascii() else re.sub(r"[\W\d_]", "", s)


def publisher_candidates(name: str) -> list[str]:
    """Keys to look for: the name, and the parts of it that are set off from a place."""
    s = letters(name).replace("_", " ")
    s = re.sub(r"\[[^\]]*\]", " ", s)
    parts = [s, re.sub(r"\([^)]*\)", " ", s), *re.split(r"\s[-–—]+\s|[:,;()/]", s)]
    keys = []
    for p in parts:
        p = re.sub(r"[^\w\s&]", " ", re.sub(r"\bs\.\s?a\.?(?=\W|$)", " ", p))
        p = re.sub(r"\bc?\d{2,}\b", " ", p)
        for _ in range(4):
            p = re.sub(rf"(?:^|\s)(?:&|and)?\s*(?:{LEGAL})\s*$", " ", p.strip())
        p = re.sub(r"^(?:the\s+)+", "", p.strip())
        k = squeeze(p.replace("&", " "))
        if len(k) > 3 and k not in keys:
            keys.append(k)
    return keys


def tag_candidates(name: str) -> list[str]:
    if re.match(r"\s*(?:https?:|www\.)", name):
        return []
    s = re.sub(r"\s+", " ", letters(name).replace("_", " ")).strip(" *#!.;-[]()")
    s = re.sub(r"\s+", " ", s.replace(".", " ") if re.search(r"\w\.\w", s) else s)
    for _ in range(3):
        s = re.sub(TAG_FRAMES, " ", s.strip(" *#!.;-[]")).strip(" *#!.;-[]")
    s = re.sub(r"\(\s*genre\s*\)?|\bgenre$", " ", s)
    if re.search(r"\d", s):
        return []
    keys = [squeeze(s)]
    # frames glued to the name or misspelt themselves
    for head in ("good", "best", "genre", "subject"):
        if keys[0].startswith(head):
            keys.append(keys[0][len(head) :])
    tail = re.fullmatch(r"(.*\w)\W*\s\W*([a-z]+)", s.strip())
    if tail and any(osa(tail[2], f) <= 2 for f in ("general", "titles", "genre", "books")):
        keys.append(squeeze(tail[1]))
    return [k for k in dict.fromkeys(keys) if k]


CANDIDATES = {"publisher": publisher_candidates, "tag": tag_candidates}


def allowed(n: int) -> int:
    """Edits allowed in a name of n letters."""
    return 0 if n < 4 else 1 if n < 9 else 2 if n < 15 else 3


def osa(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours."""
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, prev2[j - 2] + 1)
            row.append(v)
        prev2, prev = prev, row
    return prev[-1]


def within(a: str, b: str, k: int) -> bool:
    """Whether osa(a, b) <= k, looking at the diagonals within k only."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > k or not k:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = -1
    while j >= i - n and a[j] == b[j]:
        j -= 1
    a, b = a[i : len(a) + j + 1], b[i : len(b) + j + 1]
    if not a or not b:
        return len(a) + len(b) <= k
    if k == 1:  # nothing else is left than one letter for another, or a swap
        return len(a) == len(b) and (len(a) == 1 or len(a) == 2 and a == b[::-1])
    if len(set(a) ^ set(b)) > 2 * k:
        return False
    far = k + 1
    before, prev = {}, {j: j for j in range(min(len(b), k) + 1)}
    for i, x in enumerate(a, 1):
        row = {0: i} if i <= k else {}
        for j in range(max(1, i - k), min(len(b), i + k) + 1):
            y = b[j - 1]
            v = min(prev.get(j, far) + 1, row.get(j - 1, far) + 1, prev.get(j - 1, far) + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before.get(j - 2, far) + 1)
            if v <= k:
                row[j] = v
        if not row:
            return False
        before, prev = prev, row
    return prev.get(len(b), far) <= k


class Trie:
    """Keys to labels: (term_id or 0 for a rival, edits allowed at most)."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: str, label: int, most: int = 9) -> None:
        node = self.root
        for c in key:
            node = node.setdefault(c, {})
        labels = node.setdefault("", {})
        labels[label] = max(most, labels.get(label, 0))

    def within(self, word: str, k: int) -> dict[int, int]:
        """Least distance of every label within k edits, by an automaton over the trie."""
        n, full = len(word), (1 << (len(word) + 1)) - 1
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | (1 << i)
        end = 1 << n
        levels = range(1, k + 1)
        out: dict[int, int] = {}
        # state: positions reached with d errors; half: positions i where the trie gave word[i + 1] and owes word[i]
        stack = [(self.root, [(1 << (d + 1)) - 1 & full for d in range(k + 1)], [0] * (k + 1))]
        while stack:
            node, state, half = stack.pop()
            for c, child in node.items():
                if c == "":
                    for d, bits in enumerate(state):
                        if bits & end:
                            for label, most in child.items():
                                if d <= most and out.get(label, 99) > d:
                                    out[label] = d
                            break
                    continue
                m = masks.get(c, 0)
                new, owed = [(state[0] & m) << 1], [0]
                for d in levels:
                    less = state[d - 1]
                    # match; letter too many in the trie; another letter; letter missing in the trie; end of a swap
                    new.append((((state[d] & m) << 1) | less | (less << 1) | (new[d - 1] << 1) | ((half[d] & m) << 2)) & full)
                    owed.append(less & (m >> 1))
                if any(new) or any(owed):
                    stack.append((child, new, owed))
        return out


def build(terms: list[tuple[int, str]]) -> Trie:
    """The trie of a kind's entries with its alias and rival paths."""
    trie = Trie()
    words_of = {t: re.findall(r"[^\W\d_]+", letters(name)) for t, name in terms}
    position: dict[int, set[str]] = {}
    for ws in words_of.values():
        for i, w in enumerate(ws):
            position.setdefault(i if len(ws) > 1 else -1, set()).add(w)
    vocabulary = set().union(*words_of.values()) if words_of else set()
    unique = {w: [w[:n] for n in range(3, len(w)) if sum(v.startswith(w[:n]) for v in vocabulary) == 1] for w in vocabulary}

    def stem(ws: list[str]) -> list[str]:
        ws = list(ws)
        while len(ws) > 1 and ws[-1] in TAIL_WORDS:
            ws.pop()
        return ws

    stems: dict[tuple[str, ...], set[int]] = {}
    for t, ws in words_of.items():
        stems.setdefault(tuple(stem(ws)), set()).add(t)

    def spellings(ws: list[str], prefixes: bool) -> set[str]:
        out = {""}
        i = 0
        while i < len(ws):
            here = [ws[i], *SHORT_FORMS.get(ws[i], []), *(unique[ws[i]] if prefixes else [])]
            pair = SHORT_PHRASES.get(tuple(ws[i : i + 2]))
            out = {a + b for a in out for b in here} | ({a + b + "\0" for a in out for b in pair} if pair else set())
            if pair:  # the phrase stands for both words
                done = {a[:-1] for a in out if a.endswith("\0")}
                rest = spellings(ws[i + 2 :], prefixes)
                return {a + b for a in done for b in rest} | {a + b for a in out if not a.endswith("\0") for b in spellings(ws[i + 1 :], prefixes)}
            i += 1
        return out

    real: set[str] = set()
    for t, ws in words_of.items():
        ways = [ws]
        short = stem(ws)
        if short != ws and len(stems[tuple(short)]) == 1 and len(short) > 1:
            ways.append(short)
        if len(ws) == 2 and short == ws:
            ways.append(ws[::-1])
        for way in ways:
            whole = "".join(way)
            real.add(whole)
            trie.add(whole, t)
            tails = [w for w in way if w in TAIL_WORDS]
            for s in spellings(way, prefixes=not tails):
                if s != whole:
                    real.add(s)
                    trie.add(s, t, 3 if tails else 1 if len(s) >= 8 else 0)
    # rivals: one telling word replaced by another word of the same place, unless that is an entry itself
    for ws in words_of.values():
        short = stem(ws)
        for i, w in enumerate(short):
            for v in position.get(i if len(ws) > 1 else -1, ()):
                if v != w and osa(v, w) <= 3:
                    for way in (short, ws, *([short[::-1]] if len(short) == 2 and short == ws else [])):
                        key = "".join(v if x == w else x for x in way)
                        if key not in real:
                            trie.add(key, 0)
    return trie


def meant(trie: Trie, keys: list[str]) -> int:
    """The label nearest to any of the keys; 0 if none is near enough or a rival is nearest."""
    for k in range(4):
        best: dict[int, int] = {}
        for key in keys:
            if k <= allowed(len(key)):
                for label, d in trie.within(key, k).items():
                    if d < best.get(label, 99):
                        best[label] = d
        if best:
            least = min(best.values())
            at = [x for x, d in best.items() if d == least]
            return min((x for x in at if x), default=0)
    return 0


def map_to_terms(names: DataFrame, terms: DataFrame, max_terms: int = 100_000) -> DataFrame:
    """(kind, name, term_id) of every distinct name: the entry of its kind that it means, or 0.

    names: kind, name. terms: term_id, kind, term; at most max_terms rows.
    """
    spark = names.sparkSession
    rows = terms.select("kind", "term_id", "term").where("term is not null").limit(max_terms + 1).collect()
    if len(rows) > max_terms:
        raise ValueError(f"the reference list has more than {max_terms} entries")
    tries = {kind: build([(r.term_id, r.term) for r in rows if r.kind == kind]) for kind in {r.kind for r in rows}}
    shared = spark.sparkContext.broadcast(tries)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries, seen = shared.value, {}
        for b in batches:
            out = []
            for kind, name in zip(b["kind"], b["name"]):
                keys = tuple(CANDIDATES.get(kind, lambda x: [squeeze(letters(x))])(name)) if name else ()
                if (kind, keys) not in seen:
                    if len(seen) >= 300_000:
                        seen.clear()
                    seen[kind, keys] = meant(tries[kind], list(keys)) if keys and kind in tries else 0
                out.append(seen[kind, keys])
            yield pd.DataFrame({"kind": b["kind"], "name": b["name"], "term_id": pd.Series(out, dtype="int64")})

    return spread(names.select("kind", "name").where("name is not null"), "kind", "name").distinct().mapInPandas(search, "kind string, name string, term_id bigint")
