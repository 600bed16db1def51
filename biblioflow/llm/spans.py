"""Long exact spans that occur in more than one record.

A shared run of SPAN code points holds SPAN - GRAM + 1 windows of GRAM code points, and
the one of least hash among them is an anchor in both records (winnowing: every stretch
of SPAN characters has an anchor, chosen by its content alone). So anchors stand for
all windows, one in about fifty.

First pass: each partition counts its anchors in a count-min sketch; the sketches are
merged block by block. They overestimate only. Second pass: anchors whose estimate is
two or more are grouped exactly, as numbers; those that really stand in two records or
more bring the text around them, and the texts are compared: a run counts if it reaches
SPAN. Nothing is lost, and hash collisions cannot add anything.

The sketch has as many cells as the length of all texts asks for, SKETCH_BITS at most,
since it is broadcast; beyond that (some 3 GB of text) it lets more unique anchors through
to the exact grouping, at 24 bytes each. An anchor in more than BLOCK records, by exact
count, is spread over pairs of blocks, so no task holds all of it; others are not copied.

Defined results: NULL, empty and shorter texts share nothing; a record does not share
with itself; ids that occur twice with different texts are one record.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblioflow.session import written

SPAN = 200
GRAM = 100
LEAST_BITS, SKETCH_BITS = 16, 25
SKETCH_ROWS = 2
CHUNK_BITS = 16
BLOCK = 400

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible structure."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of the hash's base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)
        self.inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.concatenate(([np.uint64(1)], np.full(2 * n, _BASE))).cumprod(dtype=np.uint64)
            self.down = np.concatenate(([np.uint64(1)], np.full(2 * n, self.inverse))).cumprod(dtype=np.uint64)
        return self.up[:n], self.down[:n]


def _slide(a: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over every window of the width, by doubling."""
    n, have = len(a) - width + 1, 1
    while have * 2 <= width:
        a = f(a[: len(a) - have], a[have:])
        have *= 2
    return f(a[:n], a[width - have : width - have + n])


def anchors(text: str, powers: Powers, gram: int = GRAM, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the windows of least hash in any stretch of span characters."""
    if len(text) < span:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up, down = powers.to(len(cps) + 1)
    sums = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(_mixed(cps + np.uint64(0x1234567)) * up[:-1], out=sums[1:])
    h = _mixed((sums[gram:] - sums[:-gram]) * down[: len(cps) - gram + 1])
    w = span - gram + 1
    least = _slide(h, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    chosen = _slide(np.concatenate((edge, least, edge)), w, np.maximum) == h
    at = np.flatnonzero(chosen)
    return h[at], at


def _cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((h >> np.uint64(r * 29)) & np.uint64((1 << bits) - 1)).astype(np.int64) for r in range(SKETCH_ROWS)]


def sketch_bits(docs: DataFrame) -> int:
    """Bits of a sketch with four cells or more for every anchor, within LEAST_BITS and SKETCH_BITS."""
    chars = docs.where(F.length("text") >= SPAN).agg(F.sum(F.length("text"))).first()[0] or 0
    return min(SKETCH_BITS, max(LEAST_BITS, int(chars * 8 // SPAN).bit_length() + 1))


def sketch(docs: DataFrame, bits: int) -> DataFrame:
    """(row, chunk, counts): the merged count-min sketch of all anchors, counters that stop at 2."""
    chunk = min(CHUNK_BITS, bits)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, counts = Powers(), np.zeros((SKETCH_ROWS, 1 << bits), np.uint8)
        for b in batches:
            for text in b["text"]:
                h, _ = anchors(text, powers)
                # within one record a window counts once
                for r, cells in enumerate(_cells(np.unique(h), bits)):
                    cells = np.unique(cells)
                    counts[r, cells] += counts[r, cells] < 2
        for r in range(SKETCH_ROWS):
            for k, part in enumerate(counts[r].reshape(-1, 1 << chunk)):
                if part.any():
                    yield pd.DataFrame({"row": [r], "chunk": [k], "counts": [zlib.compress(part.tobytes(), 1)]})

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << chunk, np.uint8)
        for x in pdf["counts"]:
            total = np.minimum(total + np.frombuffer(zlib.decompress(x), np.uint8), 2)
        return pd.DataFrame({"row": [key[0]], "chunk": [key[1]], "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "row int, chunk int, counts binary"
    return docs.select("text").where(F.length("text") >= SPAN).mapInPandas(count, schema).groupBy("row", "chunk").applyInPandas(merge, schema)


def estimated(docs: DataFrame, merged: DataFrame, bits: int) -> DataFrame:
    """(doc_id, text_hash, h, pos) of anchors that the sketch estimates to stand in two records or more."""
    chunk = min(CHUNK_BITS, bits)
    seen = np.zeros((SKETCH_ROWS, 1 << bits), bool)
    for row in merged.toLocalIterator():
        seen[row["row"], row["chunk"] << chunk : (row["chunk"] + 1) << chunk] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8) > 1
    shared = docs.sparkSession.sparkContext.broadcast([zlib.compress(np.packbits(e).tobytes(), 1) for e in seen])  # of SKETCH_ROWS * 2 ** (SKETCH_BITS - 3) bytes at most
    del seen

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, packed = Powers(), [np.frombuffer(zlib.decompress(x), np.uint8) for x in shared.value]
        for b in batches:
            ids, keys, hs, ats = [], [], [], []
            for doc_id, key, text in zip(b["doc_id"], b["text_hash"], b["text"]):
                h, at = anchors(text, powers)
                if len(h):
                    keep = np.logical_and.reduce([e[c >> 3] >> (7 - (c & 7)) & 1 for e, c in zip(packed, _cells(h, bits))]).astype(bool)
                    n = int(keep.sum())
                    ids.append(np.full(n, doc_id, np.int64)), keys.append(np.full(n, key, np.int64)), hs.append(h[keep].view(np.int64)), ats.append(at[keep])
            if ids:
                yield pd.DataFrame({"doc_id": np.concatenate(ids), "text_hash": np.concatenate(keys), "h": np.concatenate(hs), "pos": np.concatenate(ats)})

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where(F.length("text") >= SPAN).mapInPandas(look, "doc_id bigint, text_hash bigint, h bigint, pos bigint")


def repeated(docs: DataFrame, bits: int | None = None, block: int | None = None) -> DataFrame:
    """(h, i, j, side, doc_id, pos, off, around, last) of anchors that stand in two records or more, with the text around them."""
    bits, block = bits or sketch_bits(docs), block or BLOCK
    found = written(estimated(docs, sketch(docs, bits), bits), "anchors")
    # exact counts; pairs are combined before the shuffle, so a hot anchor costs one row per task
    count = found.select("h", "doc_id").distinct().groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    real = found.join(count.select("h", (1 + F.floor(F.col("n") / block)).cast("int").alias("blocks")).hint("merge"), "h")
    per_doc = real.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("pos", "h", "blocks")).alias("at"))
    whole = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where(F.length("text") >= SPAN)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, text, at in zip(b["doc_id"], b["text"], b["at"]):
                mixed_id = int(_mixed(np.array([doc_id], np.int64).view(np.uint64))[0])
                runs: dict[tuple[int, str], list[list[int]]] = {}
                for p, x, n in sorted((a["pos"], a["h"], a["blocks"]) for a in at):
                    start = max(0, p - (SPAN - GRAM) - 1)
                    same = runs.setdefault((x, text[start : p + SPAN]), [])
                    if same and p - same[-1][1] <= GRAM:  # a repeating text: one row from the first to the last
                        same[-1][1] = p
                    else:
                        same.append([p, p, p - start, n])
                for (x, around), same in runs.items():
                    for first, last, off, n in same:
                        own = mixed_id % n
                        for other in range(n):
                            out.append((x, min(own, other), max(own, other), own, doc_id, first, off, around, last))
            if out:
                yield pd.DataFrame(out, columns=["h", "i", "j", "side", "doc_id", "pos", "off", "around", "last"])

    schema = "h bigint, i int, j int, side int, doc_id bigint, pos bigint, off int, around string, last bigint"
    return whole.join(per_doc.hint("merge"), ["doc_id", "text_hash"]).select("doc_id", "text", "at").mapInPandas(cut, schema)


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Rows of one cell after another, from batches in the order of cells."""
    held: list[tuple] = []
    key = None
    for b in batches:
        for row in zip(*(b[c].tolist() for c in ("h", "i", "j", "side", "doc_id", "pos", "off", "around", "last"))):
            if row[:3] != key:
                if len(held) > 1:
                    yield held
                held, key = [], row[:3]
            held.append(row)
    if len(held) > 1:
        yield held


def _runs(rows: list[tuple]) -> Iterator[tuple[list[tuple], list[tuple], int, int]]:
    """(rows of one context, rows of another or the same, left, right reach) of contexts whose run reaches SPAN."""
    classes: dict[tuple, list[tuple]] = {}
    for r in rows:
        classes.setdefault((r[7], r[6]), []).append(r)
    cs = [(around[:off][::-1], around[off : off + GRAM], around[off + GRAM :], rs) for (around, off), rs in classes.items()]
    for n, (left, mid, right, rs) in enumerate(cs):
        if len(rs) > 1 and len(left) + GRAM + len(right) >= SPAN:
            yield rs, rs, len(left), len(right)
        for left2, mid2, right2, rs2 in cs[n + 1 :]:
            if mid == mid2:
                x, y = _common(left, left2), _common(right, right2)
                if x + GRAM + y >= SPAN:
                    yield rs, rs2, x, y


def _by_cell(found: DataFrame) -> DataFrame:
    return found.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")


def shared_pairs(found: DataFrame) -> DataFrame:
    """(doc_id_1, doc_id_2) of every two records that share a run of SPAN code points."""

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: set[tuple[int, int]] = set()
        for rows in _groups(batches):
            i, j = rows[0][1:3]
            for one, two, left, _ in _runs(rows):
                if left > SPAN - GRAM:  # an anchor further left stands for this run too
                    continue
                for a in one:
                    for b in two:
                        if a[4] != b[4] and (i == j or a[3] != b[3]):
                            out.add((a[4], b[4]) if a[4] < b[4] else (b[4], a[4]))
            if len(out) > 100_000:
                yield pd.DataFrame(list(out), columns=["doc_id_1", "doc_id_2"])
                out = set()
        if out:
            yield pd.DataFrame(list(out), columns=["doc_id_1", "doc_id_2"])

    return _by_cell(found).mapInPandas(pair, "doc_id_1 bigint, doc_id_2 bigint").distinct()


def shared_lengths(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, shared_chars, total_chars, shared_part) of every record: how much of it stands in others."""

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches):
            out: set[tuple[int, int, int]] = set()
            for one, two, left, right in _runs(rows):
                ids = {r[4] for r in one} | {r[4] for r in two}
                if len(ids) > 1:
                    out.update((r[4], r[5] - left, r[8] + GRAM + right) for r in (*one, *two))
            if out:
                yield pd.DataFrame(list(out), columns=["doc_id", "start", "stop"])

    spans = _by_cell(found).mapInPandas(reach, "doc_id bigint, start bigint, stop bigint").distinct()
    # spans in order, folded to the number of positions that any of them covers
    covered = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("s")).select(
        "doc_id",
        F.aggregate(
            "s",
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")),
            lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["stop"]).alias("end")),
        )["n"].alias("shared_chars"),
    )
    total = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    return docs.select("doc_id", total.alias("total_chars")).join(covered, "doc_id", "left").select(
        "doc_id", F.coalesce("shared_chars", F.lit(0)).cast("bigint").alias("shared_chars"), "total_chars",
        F.when(F.col("total_chars") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("total_chars")).otherwise(0.0).alias("shared_part"),
    )


def link_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copies, links) of every record that shares a run of SPAN code points with another.

    class_id: the least id of the records of that very text, copies: how many there are,
    links: records that share a run with it, its own copies among them. Compared are
    representatives of the classes only; copies are counted, not made into pairs.
    """
    d = docs.where(F.length("text") >= SPAN).select("doc_id", F.sha2("text", 256).alias("key"))
    classes = written(d.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count_distinct("doc_id").alias("copies")), "classes")
    heads = docs.join(classes.select(F.col("class_id").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    pairs = written(shared_pairs(repeated(heads)), "pairs")
    both = pairs.select(F.col("doc_id_1").alias("class_id"), F.col("doc_id_2").alias("other")).union(pairs.select("doc_id_2", "doc_id_1"))
    more = both.join(classes.select(F.col("class_id").alias("other"), "copies").hint("merge"), "other").groupBy("class_id").agg(F.sum("copies").alias("others"))
    c = classes.join(more.hint("merge"), "class_id", "left").select("key", "class_id", "copies", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links")).where("links > 0")
    return d.join(c.hint("merge"), "key").select("doc_id", "class_id", "copies", "links")
