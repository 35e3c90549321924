import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.functions import metrics as M

ROWS = [
    (["a", "b", "c"], ["b"]), (["a", "a", "b"], ["a", "b"]), ([], ["a"]), (["a"], []), (["x", "y", "z", "w", "v", "a"], ["a"]),
    (["a", "b"], ["a", "a", "b"]), (None, ["a"]), (["a"], None),
]


def ndcg(got, want, k=5):
    kept = list(dict.fromkeys(got[:k]))
    ideal = sum(1 / math.log2(i + 2) for i in range(min(len(want), k)))
    return min(1.0, sum(1 / math.log2(i + 2) for i, g in enumerate(kept) if g in want) / ideal) if ideal else 0.0


def test_against_plain_python(spark):
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)], "k int, g array<string>, e array<string>")
    g, e = F.col("g"), F.col("e")
    out = frame.select("k", M.hit_rate(g, e).alias("hit"), M.recall(g, e, 3).alias("recall"), M.reciprocal_rank(g, e).alias("mrr"), M.ndcg(g, e).alias("ndcg"), M.diversity(g).alias("div"), M.false_positive_rate(g).alias("fpr"))
    for row in out.collect():
        got, want = (x or [] for x in ROWS[row["k"]])
        assert row["hit"] == float(bool(set(got[:5]) & set(want)))
        assert row["recall"] == (len(set(got[:3]) & set(want)) / len(set(want)) if want else 0.0)
        assert row["mrr"] == next((1 / (i + 1) for i, x in enumerate(got) if x in want), 0.0)
        assert abs(row["ndcg"] - ndcg(got, want)) < 1e-12
        assert row["div"] == (len(set(got[:5])) / len(got[:5]) if got else 0.0)
        assert row["fpr"] == min(len(got), 5) / 5


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcdef"), max_size=8), st.lists(st.sampled_from("abcdef"), max_size=4)), min_size=1, max_size=20))
def test_within_bounds(spark, rows):
    frame = spark.createDataFrame(rows, "g array<string>, e array<string>")
    for row in frame.select(M.ndcg(F.col("g"), F.col("e")).alias("n"), M.recall(F.col("g"), F.col("e"), 5).alias("r"), M.reciprocal_rank(F.col("g"), F.col("e")).alias("m")).collect():
        assert all(0 <= x <= 1 for x in row)


def test_chunk_relevance(spark):
    frame = spark.createDataFrame([("d", 4, "d::chunk::004"), ("d", 5, "d::chunk::005"), ("d", 6, "d::chunk::006"), ("e", 5, "e::chunk::005"), ("d", -1, "d")], "stem string, number int, id string")
    expected = F.array(F.struct(F.lit("d::chunk::005").alias("id"), F.lit("d").alias("stem"), F.lit(5).alias("number")))
    found = [r[0] for r in frame.select(M.chunk_relevance(F.col("stem"), F.col("number"), F.col("id"), expected)).collect()]
    assert found == [1, 2, 1, 0, 0]
