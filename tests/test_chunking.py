import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import chunking, parsing


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t中文。", max_size=60), min_size=1, max_size=8), st.integers(2, 6), st.integers(0, 1))
def test_windows_cover_the_text(spark, texts, size, overlap):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    chunks = chunking.fixed_chunks(frame, "doc_id", "text", size, overlap).orderBy("doc_id", "chunk_index").collect()
    tokens = {r["doc_id"]: r["t"] for r in frame.select("doc_id", T.covering_tokens(F.col("text")).alias("t")).collect()}
    for doc, text in enumerate(texts):
        own = [c for c in chunks if c["doc_id"] == doc]
        assert "".join(tokens[doc]) == text
        if not text.strip(" "):
            assert not own
            continue
        assert own[0]["start_token"] == 0 and own[-1]["end_token"] == len(tokens[doc])
        assert all(c["text"] in text and c["token_count"] <= size for c in own)
        assert all(b["start_token"] == a["end_token"] - overlap for a, b in zip(own, own[1:]))


def test_overlap_must_be_smaller(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    with pytest.raises(ValueError):
        chunking.fixed_chunks(frame, "doc_id", "text", 4, 4)


def test_cross_page_overlap_skips_blank_pages(spark):
    pages = spark.createDataFrame([("d", 1, "a b c"), ("d", 2, "  \n"), ("d", 3, "x y"), ("e", 1, None)], "doc string, page int, text string")
    found = chunking.page_chunks(pages, "doc", "page", "text", 10, 0, 2).orderBy("page").collect()
    assert [(c["page"], c["text"], c["cross_page"], c["overlap_from_page"]) for c in found] == [(1, "a b c", False, None), (3, "b c\nx y", True, 1)]


def test_page_segments(spark):
    pages = spark.createDataFrame([("d", 1, "aaaa"), ("d", 2, "bbbb"), ("d", 3, "cc")], "doc string, page int, text string")
    found = chunking.page_segments(pages, "doc", "page", "text", 8).orderBy("segment_index").collect()
    assert [(s["pages"], s["text"], s["start_char"]) for s in found] == [([1, 2], "aaaa\n\nbbbb", 0), ([3], "cc", 12)]


def test_semantic_chunks(spark):
    frame = spark.createDataFrame([(1, "aaaaaaaaaaaa. aaaaaaaaaaaab. zzzzzzzzzzzzz."), (2, None), (3, "")], "doc_id int, text string")

    def embed(sentences):
        return [[s.count("a"), s.count("z")] for s in sentences]

    found = chunking.semantic_chunks(frame, "doc_id", "text", embed, 100, 0, 0.5).orderBy("chunk_index").collect()
    assert [c["text"] for c in found] == ["aaaaaaaaaaaa.aaaaaaaaaaaab.", "zzzzzzzzzzzzz."]


def test_short_sentences_are_buffered(spark):
    frame = spark.createDataFrame([("Hi. This one is longer. No.",), ("Hi.",), (None,)], "t string")
    assert [r[0] for r in frame.select(chunking.buffered_sentences(F.col("t"))).collect()] == [["Hi.This one is longer.No."], ["Hi."], []]


def test_degenerate_tables(spark):
    text = "x\n| - | |\n|---|:-:|\ny\n| a | |\n|---|---|"
    frame = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, text string")
    assert {r["k"]: r["cleaned"] for r in parsing.without_degenerate_tables(frame, "k", "text").collect()} == {1: "x\ny\n| a | |\n|---|---|", 2: None, 3: ""}


def test_table_quality(spark):
    frame = spark.createDataFrame([(1, "| a | b | c |\n| --- | --- | --- |\n| 1 |  | 3<br>4 |\n\ntext\n| no | table |")], "k int, text string")
    row = parsing.table_quality(frame, "k", "text").withColumn("reason", parsing.quality_reason()).collect()
    assert [(r["n_rows"], r["n_cols"], r["data_rows"], r["reason"]) for r in row] == [(2, 3, 1, "data_rows_too_few")]
    assert (row[0]["empty_ratio"], row[0]["merged_ratio"]) == (round(1 / 6, 6), round(1 / 6, 6))
