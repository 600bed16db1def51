"""Items of varying length put into containers of fixed capacity.

First-fit decreasing, run independently in randomised groups: items are dealt to groups
by a hash, so every group has a fair sample of sizes and a bounded number of items, and
one container per group at most is left far from full. A tournament tree over the
containers' free room finds the first one with enough of it in logarithmic time.

An item larger than the capacity is cut into full containers and a rest, which is
placed like any item; no other item is cut.

Defined results: items of size 0 or NULL are placed whole into the group's first
container; a capacity that is NULL or below 1 is an error; an empty table gives no
containers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ITEMS = 10_000


class Tournament:
    """Free room of containers 0, 1, ... in a tree whose nodes hold the most of their leaves."""

    def __init__(self, leaves: int, capacity: int) -> None:
        self.width = 1 << max(0, leaves - 1).bit_length()
        self.most = [capacity] * (2 * self.width)

    def take(self, size: int) -> int:
        """The first container with room for the size, which is taken from it."""
        most, width, at = self.most, self.width, 1
        while at < width:
            at *= 2
            if most[at] < size:
                at += 1
        found = at - width
        most[at] -= size
        while at > 1:
            at >>= 1
            left, right = most[2 * at], most[2 * at + 1]
            new = left if left >= right else right
            if most[at] == new:
                break
            most[at] = new
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, piece, size, container) of every piece."""
    full, rest = sizes // capacity, sizes % capacity
    full = np.where(sizes <= capacity, 0, full)
    rest = np.where(sizes <= capacity, sizes, rest)
    # full containers first, then rests and whole items by size
    item = np.repeat(np.arange(len(sizes)), full)
    piece = np.concatenate([np.arange(n) for n in full if n] or [np.empty(0, np.int64)])
    keep = np.flatnonzero((rest > 0) | (sizes == 0))
    order = keep[np.argsort(-rest[keep], kind="stable")]
    tree = Tournament(max(1, len(order)), capacity)
    placed = np.fromiter((tree.take(s) for s in rest[order].tolist()), np.int64, len(order))
    used = int(placed.max()) + 1 if len(placed) else 0
    return (
        np.concatenate([item, order]), np.concatenate([piece, full[order]]),
        np.concatenate([np.full(len(item), capacity, np.int64), rest[order]]), np.concatenate([used + np.arange(len(item)), placed]),
    )


def packed(items: DataFrame, capacities: DataFrame, group_items: int = GROUP_ITEMS, seed: int = 17, max_capacities: int = 1000) -> DataFrame:
    """(pack_name, group_no, container, doc_id, piece, tokens): every item in a container of every capacity.

    items: doc_id, tokens. capacities: pack_name, capacity_tokens; at most max_capacities rows.
    """
    packs = [(r[0], r[1]) for r in capacities.select("pack_name", "capacity_tokens").limit(max_capacities + 1).collect()]
    if len(packs) > max_capacities or any(c is None or c < 1 for _, c in packs):
        raise ValueError(f"capacities: at most {max_capacities}, each of 1 or more")
    groups = max(1, math.ceil(items.count() / group_items))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        ids, sizes = pdf["doc_id"].to_numpy(), pdf["tokens"].fillna(0).to_numpy(np.int64)
        out = []
        for name, capacity in packs:
            item, piece, size, container = first_fit_decreasing(sizes, capacity)
            out.append(pd.DataFrame({"pack_name": name, "group_no": key[0], "container": container, "doc_id": ids[item], "piece": piece, "tokens": size}))
        return pd.concat(out) if out else pd.DataFrame(columns=["pack_name", "group_no", "container", "doc_id", "piece", "tokens"])

    dealt = items.select("doc_id", "tokens", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)).alias("group_no"))
    return dealt.groupBy("group_no").applyInPandas(pack, "pack_name string, group_no bigint, container bigint, doc_id bigint, piece bigint, tokens bigint")


def fill_report(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_name, capacity_tokens, containers, tokens, fill) of every capacity."""
    each = placed.groupBy("pack_name", "group_no", "container").agg(F.sum("tokens").alias("tokens"))
    total = each.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return total.join(F.broadcast(capacities.select("pack_name", "capacity_tokens")), "pack_name").select(
        "pack_name", "capacity_tokens", "containers", "tokens", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill")
    )
