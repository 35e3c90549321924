"""Packing texts into containers of fixed token capacity (problem 8).

Documents are spread over buckets of bounded size by a hash of their id; each bucket is packed by itself. Within a bucket,
documents come in descending size, and each goes to the container with the lowest estimated cost (linear plus quadratic
attention cost) among those with room, so that containers end up equally costly. Where that leaves too much unused space, the
large documents are set tightly and only the others go by cost.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.runtime import cut, ship

#: Documents a bucket; more documents make more buckets.
BUCKET_DOCUMENTS = 20_000
#: Cost of a document of n tokens: n + QUADRATIC * n * n.
QUADRATIC = 1.0 / 4096
#: Documents above this share of the capacity go to the container with the least room that suffices: spread by cost, they
#: would leave gaps in many containers that no later document fits into.
TIGHT = 1.0 / 8
#: That is done where packing all by cost takes so many more containers than the tokens need.
SLACK = 0.005


class _Room:
    """Containers by free tokens; finds the cheapest with at least some room in O(log capacity)."""

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.heaps: list[list | None] = [None] * self.width
        self.best: list = [(np.inf, -1)] * (2 * self.width)

    def _refresh(self, free: int) -> None:
        heap, best, at = self.heaps[free], self.best, free + self.width
        best[at] = heap[0] if heap else (np.inf, -1)
        while at > 1:
            at >>= 1
            low, high = best[2 * at], best[2 * at + 1]
            top = low if low <= high else high
            if best[at] == top:
                break
            best[at] = top

    def put(self, free: int, cost: float, container: int) -> None:
        if self.heaps[free] is None:
            self.heaps[free] = []
        heapq.heappush(self.heaps[free], (cost, container))
        self._refresh(free)

    def take(self, need: int) -> tuple[float, int, int] | None:
        """Remove and return (cost, container, free) of the cheapest container with room, or None."""
        best, low, high = self.best, need + self.width, 2 * self.width - 1
        top, where = (np.inf, -1), 0
        while low <= high:
            if low & 1:
                if best[low] < top:
                    top, where = best[low], low
                low += 1
            if not high & 1:
                if best[high] < top:
                    top, where = best[high], high
                high -= 1
            low, high = low >> 1, high >> 1
        if where == 0:
            return None
        while where < self.width:
            where = 2 * where if best[2 * where] == top else 2 * where + 1
        return self._pop(where - self.width)

    def take_tight(self, need: int) -> tuple[float, int, int] | None:
        """Remove and return (cost, container, free) of the container with the least room that suffices, or None."""
        best, at = self.best, need + self.width
        while best[at][1] < 0:
            while at & 1:
                at >>= 1
            if at == 0:
                return None
            at += 1
        while at < self.width:
            at = 2 * at if best[2 * at][1] >= 0 else 2 * at + 1
        return self._pop(at - self.width)

    def _pop(self, free: int) -> tuple[float, int, int]:
        cost, container = heapq.heappop(self.heaps[free])
        self._refresh(free)
        return cost, container, free


def pack(sizes: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The packing by cost; where that takes over SLACK more containers than the tokens need, the one with large items tight."""
    needed = max(1, -(-int(sizes.sum()) // capacity))
    by_cost = _pack(sizes, capacity, np.inf)
    if max((r[3] for r in by_cost), default=0) + 1 <= needed * (1 + SLACK):
        return by_cost
    tight = _pack(sizes, capacity, TIGHT * capacity)
    return min((by_cost, tight), key=lambda rows: max((r[3] for r in rows), default=0))


def _pack(sizes: np.ndarray, capacity: int, tight_above: float) -> list[tuple[int, int, int, int, int]]:
    """(item, part, tokens, container, offset) for every item; only items beyond the capacity have more than one part.

    Such an item fills containers of its own; what is left of it is packed like any other. Items without tokens go to
    container 0. Ties in size go by item number, so the result is the same on every run.
    """
    out: list[tuple[int, int, int, int, int]] = []
    made, rest = 0, []
    for item, size in enumerate(sizes.tolist()):
        part = 0
        while size > capacity:
            out.append((item, part, capacity, made, 0))
            made, part, size = made + 1, part + 1, size - capacity
        rest.append((size, item, part))
    rest.sort(key=lambda x: (-x[0], x[1]))
    room = _Room(capacity)
    for _ in range(-(-sum(x[0] for x in rest) // capacity)):
        room.put(capacity, 0.0, made)
        made += 1
    for size, item, part in rest:
        if size == 0:
            out.append((item, part, 0, 0, 0))
            continue
        taken = room.take_tight(size) if size > tight_above else room.take(size)
        if taken is None:
            taken, made = (0.0, made, capacity), made + 1
        cost, container, free = taken
        out.append((item, part, size, container, capacity - free))
        room.put(free - size, cost + size + QUADRATIC * size * size, container)
    return out


def pack_corpus(counts: DataFrame, profiles: list[tuple[str, int]]) -> DataFrame:
    """(profile, doc_id, part_no, n_tokens, container_id, offset) for every document and profile.

    ``counts`` has doc_id and n_tokens (null counts as 0); a document is divided only if it alone exceeds the capacity. One
    shuffle of two numbers a document, and no bucket depends on the size of the corpus.
    """
    spark = ship(counts.sparkSession)
    counts = cut(counts)
    buckets = max(1, -(-counts.count() // BUCKET_DOCUMENTS))
    schema = "profile string, doc_id long, part_no int, n_tokens long, container_id string, offset int"

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc_id", kind="stable")
        ids, sizes = frame["doc_id"].to_numpy(), frame["n_tokens"].to_numpy()
        done = []
        for profile, capacity in profiles:
            items, parts, tokens, containers, offsets = zip(*pack(sizes, capacity), strict=True)
            names = [f"{profile}-{key[0]}-{c}" for c in containers]
            done.append(pd.DataFrame({"profile": profile, "doc_id": ids[list(items)], "part_no": parts, "n_tokens": tokens, "container_id": names, "offset": offsets}))
        return pd.concat(done) if done else pd.DataFrame(columns=[x.split()[0] for x in schema.split(", ")])

    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    spread = counts.select(bucket.alias("bucket"), "doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    return spread.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(run, schema)


def container_fill(packed: DataFrame) -> DataFrame:
    """Containers, tokens and items of each profile."""
    filled = packed.groupBy("profile", "container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return filled.groupBy("profile").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum("items").alias("items"), F.max("used").alias("fullest"))
