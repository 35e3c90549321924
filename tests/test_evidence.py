"""Numbers, signs and quotes against their evidence; aggregates; ways of chunking and rewriting."""

import pytest
from pyspark.sql import functions as F

from folioforge.operators import evaluation, evidence, testsets, validation
from folioforge.plans import pipeline


def column(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_unsupported_numbers(spark):
    rows = [
        ("收入为12.5亿元", "收入1,250,000,000元"), ("收入为12.5亿元", "收入130,000,000元"), ("增长35%", "增长 35.6 %"), ("增长35%", "增长 40 %"), ("5 units", "none"),
        ("", "1"), (None, "1"), ("100", None), ("100", ""),
    ]
    got = column(spark, rows, "a string, e string", evidence.unsupported_numbers(F.col("a"), F.col("e")))
    assert got[0] == ["12.5"] and "12.5亿" in got[1] and got[2] == [] and set(got[3]) == {"35%", "35"} and got[4:] == [[]] * 5


def test_sign_contradictions(spark):
    rows = [("净利润为负，15亿", ""), ("净利润为负，-15", ""), ("净利润为负 5.5", "净利润 -5.5"), ("净利润为负 5.5", "净利润 5.5"), ("净利润 15", "-15"), (None, "-15"), ("为负 5.5", None)]
    assert column(spark, rows, "a string, e string", evidence.sign_contradiction(F.col("a"), F.col("e"))) == [True, False, True, False, False, False, False]


def test_evidence_in_three_tiers(spark):
    long = "The board approved a plan to build a second plant near the harbour"
    other = "Management expects orders from the northern region to recover slowly"
    segments = spark.createDataFrame([("d", 0, [1], f"{long}."), ("d", 1, [1, 2], f"{other}."), ("d", 2, [3], "Nothing here.")], "path string, segment_index int, pages array<int>, text string")
    documents = spark.createDataFrame([("d", f"{long}. {other}. A sentence that no segment of this document has at all."), ("e", None)], "path string, content string")
    rows = [
        ("exact", "d", 0, long), ("fuzzy", "d", 0, long.replace("harbour", "harbor.")), ("sibling", "d", 0, other), ("document", "d", 2, "A sentence that no segment of this document has"),
        ("far", "d", 2, long), ("wrong segment", "d", 9, long), ("invented", "d", 0, "A completely different statement about something else"), ("no index", "d", None, long),
        ("short", "d", 0, "The board"), ("null", "d", 0, None), ("no document", "x", 0, long), ("null content", "e", 0, long),
    ]
    quotes = spark.createDataFrame(rows, "id string, path string, segment_index int, quote string")
    got = {r["id"]: (r["match_type"], r["reason"]) for r in evidence.checked_evidence(quotes, segments, documents, ["id"], "path").collect()}
    assert got == {
        "exact": ("exact", None), "fuzzy": ("fuzzy", None), "sibling": ("exact", None), "document": ("document_fuzzy", None), "far": ("document_fuzzy", None), "wrong segment": ("document_fuzzy", None),
        "invented": (None, "not in the document"), "no index": (None, "missing segment"), "short": (None, "shorter than 30"), "null": (None, "shorter than 30"),
        "no document": (None, "no such segment"), "null content": (None, "no such segment"),
    }
    assert evidence.checked_evidence(quotes.limit(0), segments, documents, ["id"], "path").count() == 0


def test_gate(spark):
    schema = "id string, question string, question_type string, answer string, ground_truth_excerpt string, content string, quotes string"
    rows = [
        ("1", "a", "single_fact", "收入11.65亿元", "收入116,500,000元", "收入116,500,000元", "收入116,500,000元"), ("2", "a", "single_fact", "same", None, None, None),
        ("3", "b", "single_fact", "31 42 53", "none", "x", "1"), ("4", "c", "irrelevant", "31 42 53", "none", "x", "1"), ("5", None, None, None, None, None, None),
    ]
    got = {r["id"]: r for r in evidence.gated(spark.createDataFrame(rows, schema), "id", "content", "quotes").collect()}
    assert got["1"]["corrected"] and got["1"]["answer"] == "收入1.17亿元" and got["1"]["excerpt_verified"] and got["1"]["kept"]
    assert [got[k]["kept"] for k in "2345"] == [False, False, True, True] and len(got["3"]["unsupported"]) == 3


def test_aggregate_counts_what_applies(spark):
    schema = "variant string, question_type string, retrieval map<string,double>, chunk map<string,double>, dedup map<string,double>, generation map<string,double>, false_positive_rate double"
    rows = [
        ("v", "a", {"hit_rate": 1.0, "mrr": 0.5, "retrieval_diversity": 0.4}, {"mrr": 0.5}, {"hit_rate": 1.0}, {"ragas_faithfulness": 0.2, "faithfulness": 0.9}, None),
        ("v", "a", {"mrr": 1.0, "retrieval_diversity": 1.0}, {}, None, None, 0.6), ("v", None, {"hit_rate": 0.0, "mrr": None}, {"hit_rate": 1.0}, {}, {"faithfulness": 0.1}, 0.2),
    ]
    frame = spark.createDataFrame(rows, schema)
    row = evaluation.experiment_aggregate(frame, ["variant"]).first()
    assert (row["total_questions"], row["applicable_questions"], row["avg_hit_rate"], row["avg_mrr"], row["avg_ndcg"]) == (3, 2, 0.5, 0.5, 0.0)
    assert (row["avg_chunk_hit_rate"], row["avg_chunk_mrr"], row["avg_dedup_hit_rate"], row["avg_diversity"]) == (0.5, 0.25, 1.0, 0.4)
    assert row["avg_false_positive_rate"] == pytest.approx(0.4) and row["hallucination_rate"] == 0.5
    by_type = {r["question_type"]: r for r in evaluation.aggregate_by_type(frame, ["variant"]).collect()}
    assert by_type["a"]["avg_faithfulness"] == 0.2 and by_type["unknown"]["avg_faithfulness"] == 0.1 and by_type["a"]["n"] == 2


def test_patterns_and_tiers(spark):
    rows = [("青山集团2020年收入12.5亿",), ("白河股份2019年收入3亿",), ("黑水公司2018年收入1,000亿",), (None,)]
    assert len(set(column(spark, rows[:3], "q string", testsets.question_pattern(F.col("q"))))) == 1
    assert column(spark, [(4.0, None), (3.99, None), (1.0, "A"), (None, None)], "s double, t string", testsets.tier(F.col("s"), F.col("t"))) == ["A", "B", "A", "C"]


def test_pairs_some_chunks_apart(spark):
    frame = spark.createDataFrame([("a", k, f"a{k}") for k in range(6)] + [("b", k, f"b{k}") for k in range(2)], "d string, n int, c string")
    got = {tuple(r) for r in validation.neighbours(frame, "d", "n", "c", 4, 2, 3).collect()}
    assert got == {(f"a{i}", f"a{j}") for i in range(6) for j in range(6) if 2 <= j - i <= 4}


def test_ways_of_chunking_and_rewriting(spark):
    documents = spark.createDataFrame([("d", "one two three four\n\nfive six seven eight. nine ten eleven.")], "doc_id string, text string")
    ids = {way: [r[0] for r in pipeline.chunked(documents, pipeline.Settings(chunking=way, chunk_size=4), "doc_id", "text", lambda s: [[1.0]] * len(s)).select("chunk_id").collect()] for way in ("fixed", "page_aware", "semantic")}
    assert all(ids.values()) and len({pipeline.Settings(chunking=way).chunk_fingerprint() for way in ids}) == 3
    with pytest.raises(ValueError):
        pipeline.Settings(chunking="other")
    with pytest.raises(ValueError):
        pipeline.chunked(documents, pipeline.Settings(chunking="semantic"), "doc_id", "text")
    asked = spark.createDataFrame([("1", "why?"), ("2", "none")], "id string, question string")
    answers = lambda c: F.when(c == "why?", F.lit("1. first\n\n2) second\n- third\n4 fourth")).otherwise("")
    got = {way: sorted(tuple(r) for r in pipeline.rewritten(asked, pipeline.Settings(rewriting=way), answers).collect()) for way in ("none", "hyde", "multi_query")}
    assert got["none"] == [("1", 0, "why?"), ("2", 0, "none")] and got["hyde"][1] == ("2", 0, "none")
    assert got["multi_query"] == [("1", 0, "first"), ("1", 1, "second"), ("1", 2, "third"), ("2", 0, "none")]
    scores = spark.createDataFrame([(0.5, 0.9), (0.4, None)], "s double, r double")
    assert [r[0] for r in scores.select(pipeline.chosen_score(F.col("s"), F.col("r"), True)).collect()] == [0.9, 0.4]
