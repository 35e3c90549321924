"""The models behind the answer checks, counted over all answers.

Terminal contexts: for every place in the answers, whether a unit ends there; the characters before a place are the context.
Only contexts that some answer ends with are counted: a bitmap of a fixed size keeps most others from being moved, and the
counts meet the answers by their hash, so nothing that grows with the answers is sent to the driver or to every task.
Phrases: in how many answers that decline, and in how many others, each word or pair of wide characters stands; these counts,
a vocabulary, are sent to every task. Both are classifiers whose labels come from the texts themselves (a unit ends or not; the
dictionaries say that an answer declines or not).
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm import answers as A
from folioforge.llm.visual import visual_form
from folioforge.runtime import ship, spread

#: Other occurrences a context needs; that of the largest order is anchored at the start of short answers and needs one.
LEAST_SEEN = 3
#: Texts whose contexts are hashed at once, and contexts that a task holds before it adds them up.
SLICE, HELD_CONTEXTS = 2000, 4_000_000
#: Slots of the bitmap of contexts that answers end with; a full one lets more contexts be moved, the counts stay the same.
_SLOTS = 1 << 27


@dataclass
class Counts:
    """Sorted hashes with two counts each."""

    keys: np.ndarray
    first: np.ndarray
    second: np.ndarray

    def of(self, hashes: list[int]) -> list[tuple[int, int]]:
        if not len(self.keys):
            return [(0, 0)] * len(hashes)
        at = np.minimum(np.searchsorted(self.keys, np.array(hashes, dtype=np.int64)), len(self.keys) - 1)
        return [(int(self.first[k]), int(self.second[k])) if self.keys[k] == h else (0, 0) for k, h in zip(at, hashes, strict=True)]


@dataclass
class Endings:
    """The fitted models that every task needs."""

    phrases: A.Phrases


#: Bounds of the counts of contexts that only ended or only went on, and of the log ratio of those that did both.
_COUNT_BOUNDS, _RATIO_BOUNDS = (3, 5, 10, 30), (-2.0, -1.0, -0.3, 0.3, 1.0, 2.0)
#: Cells and how much oftener, in logarithms, a text goes on there: only ended, both, only went on, unknown in short and longer answers.
CELLS = (-1.5, -2.2, -2.8, -3.6, -5.0, -2.5, -1.5, -0.65, 0.0, 0.65, 1.5, 2.5, 1.5, 2.2, 2.8, 3.6, 5.0, -0.5, 0.5)


def cell_of(ended: int, went_on: int) -> int:
    """The cell of a context by its counts."""
    if not went_on:
        return bisect_right(_COUNT_BOUNDS, ended)
    if not ended:
        return 12 + bisect_right(_COUNT_BOUNDS, went_on)
    return 5 + bisect_right(_RATIO_BOUNDS, math.log((went_on + 0.5) / (ended + 0.5)))


def cell_column(ended: Column, went_on: Column) -> Column:
    """``cell_of`` as an expression."""
    above = lambda bounds, x: sum((F.when(x >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    both = 5 + above(_RATIO_BOUNDS, F.log((went_on + 0.5) / (ended + 0.5)))
    return F.when(went_on == 0, above(_COUNT_BOUNDS, ended)).when(ended == 0, 12 + above(_COUNT_BOUNDS, went_on)).otherwise(both).cast("int")


def _added(held: list[np.ndarray]) -> pa.RecordBatch:
    """(h, ended, went_on) of codes that hold a hash and, in the last bit, whether a unit ended."""
    code = np.concatenate(held)
    code.sort()
    ends = (code & np.uint64(1)).astype(np.int64)
    code >>= np.uint64(1)
    begin = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    ended = np.add.reduceat(ends, begin)
    return pa.RecordBatch.from_arrays([pa.array(code[begin].view(np.int64)), pa.array(ended), pa.array(np.diff(np.append(begin, len(code))) - ended)], ["h", "ended", "went_on"])


def _context_counts(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How often a unit ended and the text went on after each context of the answers that the bitmap has."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        texts = [t for t in batch["answer"].to_pylist() if not A.carries_nothing(t)]
        for start in range(0, len(texts), SLICE):
            hashes, ends = A.all_contexts(texts[start : start + SLICE])
            for h in hashes:
                slot = h & np.uint64(_SLOTS - 1)
                wanted = (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
                held.append((h[wanted] << np.uint64(1)) | ends[wanted])  # a hash has 63 bits
                size += len(held[-1])
            if size > HELD_CONTEXTS:
                yield _added(held)
                held, size = [], 0
    if size:
        yield _added(held)


def counted_contexts(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, ended, went_on) of the contexts in ``wanted``, a column h, over all answers; those that occur once are left out."""
    spark = ship(results.sparkSession)
    slot = F.col("h").bitwiseAND(_SLOTS - 1)
    words = wanted.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(_SLOTS // 64, np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(bitmap)
    found = given_answers(results).select("answer").mapInArrow(lambda batches: _context_counts(batches, sent.value), "h long, ended long, went_on long")
    return found.groupBy("h").agg(F.sum("ended").alias("ended"), F.sum("went_on").alias("went_on")).where("ended + went_on > 1")


def given_answers(results: DataFrame) -> DataFrame:
    """(result_id, answer) of the answers that aren't null; repeated rows count once."""
    return spread(results.select("result_id", "answer").where(F.col("answer").isNotNull()).dropDuplicates(["result_id"]))


def with_cells(evidence: DataFrame, results: DataFrame) -> DataFrame:
    """The evidence with the cell (see CELLS) of what all answers tell of its context; the longest known one decides.

    An answer doesn't count as its own example.
    """
    asked = evidence.where("hashes is not null").select("result_id", F.posexplode("hashes").alias("k", "h"))
    counts = counted_contexts(results, asked.select("h"))
    others = F.greatest(F.col("ended") - 1, F.lit(0))
    known = asked.join(counts, "h").select("result_id", "k", others.alias("ended"), "went_on")
    known = known.where(F.col("ended") + F.col("went_on") >= F.when(F.col("k") == len(A.ORDERS) - 1, 1).otherwise(LEAST_SEEN))
    cells = known.groupBy("result_id").agg(F.max_by(cell_column(F.col("ended"), F.col("went_on")), "k").alias("cell"))
    unknown = F.when(F.col("hashes").isNotNull(), F.when(F.col("n_chars") > 24, len(CELLS) - 1).otherwise(len(CELLS) - 2))
    return evidence.join(cells, "result_id", "left").withColumn("cell", F.coalesce("cell", unknown)).drop("hashes")


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, first, second): in how many declining and other answers each phrase stands; hash -1 has the numbers of answers."""
    for batch in batches:
        forms = [visual_form(t) for t in batch["answer"].to_pylist() if not A.carries_nothing(t)]
        declines = np.array([A.refuses(t) for t in forms], dtype=np.int64)
        held = [[-1, *A.phrase_hashes(t)] for t in forms]
        owner = np.repeat(np.arange(len(forms)), [len(p) for p in held]).astype(np.int64)
        values, place = np.unique(np.array([x for p in held for x in p], dtype=np.int64), return_inverse=True)
        first = np.bincount(place, weights=declines[owner], minlength=len(values)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(first), pa.array(np.bincount(place, minlength=len(values)) - first)], ["h", "first", "second"])


def learned(results: DataFrame, phrases: bool = True) -> Endings:
    """Count the phrases, only if they are wanted, over all answers; repeated rows count once."""
    ship(results.sparkSession)
    h, first, second = (np.zeros(0, dtype=np.int64) for _ in range(3))
    if phrases:
        counted = given_answers(results).mapInArrow(_phrases, "h long, first long, second long")
        rows = counted.groupBy("h").agg(F.sum("first").alias("first"), F.sum("second").alias("second")).where("first + second > 1 or h = -1").toArrow()
        h, first, second = (rows[c].to_numpy() for c in ("h", "first", "second"))
        order = np.argsort(h)
        h, first, second = h[order], first[order], second[order]
    known = h >= 0
    return Endings(A.Phrases(Counts(h[known], first[known], second[known]), int(first[~known].sum()), int(second[~known].sum())))
