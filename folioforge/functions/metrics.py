"""Retrieval metrics as array expressions: no join, no UDF. Null lists count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _list(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def _top(values: Column, k: int) -> Column:
    return F.slice(_list(values), 1, k)


def hit_rate(retrieved: Column, expected: Column, k: int = 5) -> Column:
    """1 if an expected item is among the first k, else 0; 0 without expected items."""
    return F.coalesce(F.arrays_overlap(_top(retrieved, k), _list(expected)), F.lit(False)).cast("double")


def recall(retrieved: Column, expected: Column, k: int) -> Column:
    """Share of the distinct expected items among the first k; 0 without expected items."""
    wanted = F.array_distinct(_list(expected))
    return F.when(F.size(wanted) == 0, 0.0).otherwise(F.size(F.array_intersect(_top(retrieved, k), wanted)) / F.greatest(F.size(wanted), F.lit(1)))


def reciprocal_rank(retrieved: Column, expected: Column) -> Column:
    """1 / rank of the first expected item in the whole list, else 0."""
    ranks = F.filter(F.sequence(F.lit(1), F.greatest(F.size(_list(retrieved)), F.lit(1))), lambda k: F.coalesce(F.array_contains(_list(expected), F.get(_list(retrieved), k - 1)), F.lit(False)))
    return F.coalesce(1.0 / F.get(ranks, 0), F.lit(0.0))


def _gain(relevance: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank + 1.0)


def ndcg(retrieved: Column, expected: Column, k: int = 5) -> Column:
    """Discounted gain of the first k, repeats dropped after the cut, over the gain of min(k, expected) relevant items.

    Repeats in the expected list count in the ideal. Within [0, 1]; 0 without expected items.
    """
    kept = F.array_distinct(_top(retrieved, k))
    ranks = F.filter(F.sequence(F.lit(1), F.greatest(F.size(kept), F.lit(1))), lambda r: F.coalesce(F.array_contains(_list(expected), F.get(kept, r - 1)), F.lit(False)))
    got = F.aggregate(ranks, F.lit(0.0), lambda total, r: total + 1 / F.log2(r + 1.0))
    ideal_size = F.least(F.size(_list(expected)), F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(ideal_size, F.lit(1))), F.lit(0.0), lambda total, r: total + 1 / F.log2(r + 1.0))
    return F.when(ideal_size == 0, 0.0).otherwise(F.least(F.lit(1.0), got / ideal))


def diversity(retrieved: Column, k: int = 5) -> Column:
    """Distinct documents over results among the first k; 0 without results."""
    top = _top(retrieved, k)
    return F.when(F.size(top) == 0, 0.0).otherwise(F.size(F.array_distinct(top)) / F.greatest(F.size(top), F.lit(1)))


def false_positive_rate(retrieved: Column, k: int = 5) -> Column:
    """Share of the k places that hold a result although none is wanted."""
    return F.least(F.size(_list(retrieved)), F.lit(k)) / F.lit(float(k))


def chunk_relevance(stem: Column, number: Column, chunk_id: Column, expected: Column, tolerance: int = 1) -> Column:
    """2 for an expected chunk, 1 for one of the same document at most ``tolerance`` away, else 0.

    ``expected`` is an array of (id, stem, number).
    """
    exact = F.exists(expected, lambda e: e["id"] == chunk_id)
    near = F.exists(expected, lambda e: (e["stem"] == stem) & (number >= 0) & (e["number"] >= 0) & (F.abs(e["number"] - number) <= tolerance))
    return F.when(exact, 2).when(near, 1).otherwise(0)


def chunk_hit(relevances: Column, k: int = 5) -> Column:
    """1 if one of the first k has any relevance."""
    return F.exists(F.slice(relevances, 1, k), lambda r: r > 0).cast("double")


def chunk_reciprocal_rank(relevances: Column) -> Column:
    """1 / rank of the first with any relevance."""
    ranks = F.filter(F.sequence(F.lit(1), F.greatest(F.size(relevances), F.lit(1))), lambda r: F.coalesce(F.get(relevances, r - 1) > 0, F.lit(False)))
    return F.coalesce(1.0 / F.get(ranks, 0), F.lit(0.0))


def chunk_ndcg(relevances: Column, n_expected: Column, k: int = 5) -> Column:
    """Graded gain of the first k over that of min(k, expected) exact chunks."""
    top = F.slice(relevances, 1, k)
    places = F.sequence(F.lit(1), F.greatest(F.size(top), F.lit(1)))
    got = F.aggregate(places, F.lit(0.0), lambda total, r: total + _gain(F.coalesce(F.get(top, r - 1), F.lit(0)), r))
    size = F.least(n_expected, F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), F.lit(0.0), lambda total, r: total + _gain(F.lit(2.0), r))
    return F.when(size == 0, 0.0).otherwise(F.least(F.lit(1.0), got / ideal))
