"""The queries of the core operators over the test tables; their SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import metrics as M
from folioforge.functions import text as T
from folioforge.operators import accounting, chunking, evaluation, evidence, layout, parsing, search, snapshots, testsets, traces, validation
from folioforge.oracle import oracle_sql  # noqa: F401
from folioforge.plans import pipeline, seams
from folioforge.runtime import cut, read_table
from folioforge.streaming import accounting as streams

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(function):
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> callable of (spark, folder)."""
    return dict(_QUERIES)


def _number(column: str):
    return F.regexp_extract(column, r"(\d+)$", 1).cast("long")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set of a search: golden questions whose number is divisible by 20."""
    return read_table(spark, folder, "golden_qa").where((_number("id") % 20 == 0) & F.col("question").isNotNull())


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.once(read_table(spark, folder, "questions"), "id")


def _results(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return evaluation.once(read_table(spark, folder, "evaluation_results").select("result_id", *columns), "result_id")


def _loaded(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.once(read_table(spark, folder, "loaded_documents"), "load_id")


# ---------------------------------------------------------------- retrieval


@_query
def bm25_search(spark, folder):
    return search.bm25(read_table(spark, folder, "documents"), "doc_id", "text", _asked(spark, folder), "id", "question")


@_query
def bm25_terms(spark, folder):
    documents = read_table(spark, folder, "documents")
    stats = search.term_stats(search.postings(documents, "doc_id", "text"), search.corpus_stats(documents, "text"))
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


@_query
def vector_search(spark, folder):
    vectors = read_table(spark, folder, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return search.vector_search(vectors, "vec_id", "embedding", asked, "query_id", "query_vector", 10)


@_query
def vector_search_euclid(spark, folder):
    vectors = read_table(spark, folder, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return search.vector_search(vectors, "vec_id", "embedding", asked, "query_id", "query_vector", 5, "euclid")


def _legs(spark, folder, k):
    documents, asked = read_table(spark, folder, "documents"), _asked(spark, folder)
    vector = search.vector_search(
        search.hashed_vectors(documents, "doc_id", "text"), "doc_id", "vector", search.hashed_vectors(asked, "id", "question"), "id", "vector", k
    )
    return vector, search.bm25(documents, "doc_id", "text", asked, "id", "question", k)


@_query
def hybrid_rrf(spark, folder):
    return search.reciprocal_rank_fusion(list(_legs(spark, folder, 15)), "id", "doc_id", 5)


@_query
def hybrid_weighted(spark, folder):
    return search.weighted_fusion(*_legs(spark, folder, 15), "id", "doc_id", 5)


def _hit_texts(spark, folder, k):
    documents, asked = read_table(spark, folder, "documents"), _asked(spark, folder)
    hits = search.bm25(documents, "doc_id", "text", asked, "id", "question", k)
    return search.with_texts(hits, documents.select("doc_id", "text", "source"), "doc_id").join(asked.select("id", "question"), "id")


@_query
def rerank_hits(spark, folder):
    return search.rerank(_hit_texts(spark, folder, 10), "id", "doc_id", "question", "text").select("id", "doc_id", "rank", "rerank_score", "rerank")


@_query
def multi_query_merge(spark, folder):
    documents, asked = read_table(spark, folder, "documents"), _asked(spark, folder)
    rewritten = asked.select("id", F.posexplode(F.array("question", F.array_join("expected_keywords", " "))).alias("sub_no", "query"))
    keyed = rewritten.select(F.concat_ws("#", "id", "sub_no").alias("sub_id"), "id", "sub_no", "query")
    hits = search.bm25(documents, "doc_id", "text", keyed, "sub_id", "query", 5).join(keyed.select("sub_id", "id", "sub_no"), "sub_id").drop("sub_id")
    return search.merge_queries(hits, "id", "sub_no", "doc_id", 5).select("id", "doc_id", "score", "rank")


@_query
def context_budget(spark, folder):
    hits = _hit_texts(spark, folder, 10).withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length("text") / 4)))
    return search.within_budget(hits, "id", "tokens", 1500).select("id", "doc_id", "rank", "tokens", "running_tokens")


@_query
def prompt_assembly(spark, folder):
    return search.prompts(_hit_texts(spark, folder, 3), "id", "source", "text", "question")


@_query
def search_quality(spark, folder):
    documents, asked = _loaded(spark, folder), _asked(spark, folder)
    hits = search.with_texts(search.bm25(documents, "load_id", "content", asked, "id", "question", 10), documents.select("load_id", "source_path"), "load_id")
    return pipeline.quality(hits, asked, "source_path")


@_query
def answer_pipeline(spark, folder):
    """A prompt for every golden question that has a text, not only for the stated query set of the searches."""
    settings = pipeline.Settings(chunk_size=64, overlap=16, rerank=True)
    documents = read_table(spark, folder, "documents")
    # Chunks are cut again wherever they are read: written, they would take more than the documents do.
    chunks = pipeline.chunked(documents, settings, "doc_id", "text").select("chunk_id", "text", F.col("doc_id").cast("string").alias("source"))
    asked = read_table(spark, folder, "golden_qa").where("question is not null")
    return pipeline.assemble(pipeline.retrieve(chunks, asked, settings), chunks, settings)


# ---------------------------------------------------------------- chunks and text


@_query
def fixed_chunks(spark, folder):
    return chunking.fixed_chunks(read_table(spark, folder, "documents"), "doc_id", "text", 64, 16)


@_query
def page_chunks(spark, folder):
    pages = chunking.pages_of(_loaded(spark, folder), "load_id", "content")
    return chunking.page_chunks(pages, "load_id", "page_number", "text", 24, 4, 6)


@_query
def page_segments(spark, folder):
    pages = chunking.pages_of(_loaded(spark, folder), "load_id", "content")
    segments = chunking.page_segments(pages, "load_id", "page_number", "text", 2000)
    return segments.select("load_id", "segment_index", F.size("pages").alias("n_pages"), F.length("text").alias("n_chars"), "start_char")


@_query
def document_segments(spark, folder):
    return chunking.document_segments(read_table(spark, folder, "documents"), "doc_id", "text", 4000)


def _pair_counts(sentences):
    import numpy as np

    matrix = np.zeros((len(sentences), 128))
    for k, sentence in enumerate(sentences):
        for a, b in zip(sentence, sentence[1:], strict=False):
            matrix[k, (ord(a) * 31 + ord(b)) % 128] += 1
    return matrix


@_query
def semantic_chunks(spark, folder):
    return chunking.semantic_chunks(read_table(spark, folder, "documents"), "doc_id", "text", _pair_counts, 64, 8, share=0.3)


@_query
def text_units(spark, folder):
    text = F.coalesce("text", F.lit(""))
    return read_table(spark, folder, "documents").select(
        "doc_id", F.size(T.sentences(text)).alias("n_sentences"), F.size(T.paragraphs(text)).alias("n_paragraphs"), F.size(T.headings(text)).alias("n_headings")
    )


@_query
def heading_list(spark, folder):
    documents = read_table(spark, folder, "documents").where("text is not null")
    return documents.select("doc_id", F.posexplode(T.headings(F.col("text"))).alias("k", "heading")).select("doc_id", (F.col("k") + 1).alias("heading_no"), "heading")


@_query
def page_metrics(spark, folder):
    return parsing.page_metrics(read_table(spark, folder, "documents"), "doc_id", "text")


@_query
def document_metrics(spark, folder):
    documents = read_table(spark, folder, "documents")
    pages = parsing.page_metrics(documents, "doc_id", "text").join(documents.select("doc_id", F.coalesce("source", F.lit("?")).alias("source")), "doc_id")
    return pages.groupBy("source").agg(
        F.count("*").alias("pages"), F.sum("n_chars").alias("n_chars"), F.sum("n_words").alias("n_words"), F.sum("n_headings").alias("n_headings"),
        F.sum("n_table_rows").alias("n_table_rows"), F.round(F.avg(F.col("valid").cast("double")), 6).alias("valid_ratio"),
    )


@_query
def table_quality(spark, folder):
    tables = parsing.table_quality(read_table(spark, folder, "documents"), "doc_id", "text")
    return tables.withColumn("reason", parsing.quality_reason())


@_query
def table_reasons(spark, folder):
    return table_quality(spark, folder).groupBy("reason").agg(F.count("*").alias("n"))


@_query
def better_tables(spark, folder):
    """Each table of a document against the next one, as if that had been extracted anew."""
    tables = parsing.table_quality(read_table(spark, folder, "documents"), "doc_id", "text")
    fields = ["data_rows", "empty_ratio", "merged_ratio"]
    old = tables.select("doc_id", "table_no", *(F.col(c).alias(f"old_{c}") for c in fields))
    new = tables.select("doc_id", (F.col("table_no") - 1).alias("table_no"), *(F.col(c).alias(f"new_{c}") for c in fields))
    return old.join(new, ["doc_id", "table_no"]).select("doc_id", "table_no", parsing.better_table().alias("replaced"))


@_query
def degenerate_tables(spark, folder):
    return parsing.without_degenerate_tables(read_table(spark, folder, "documents"), "doc_id", "text")


@_query
def table_records(spark, folder):
    return parsing.markdown_records(read_table(spark, folder, "documents"), "doc_id", "text")


@_query
def source_names(spark, folder):
    path = F.col("source_path")
    rules = [("annual", "annual_report"), ("research", "research_report")]
    return _loaded(spark, folder).select(
        "load_id", T.file_name(path).alias("file_name"), T.stem(path).alias("stem"), T.parent_stem(path).alias("parent_stem"),
        T.safe_name(F.lit("Set 01-a")).alias("safe_name"), T.category_of(path, rules).alias("category"), T.preview(F.coalesce("content", F.lit("")), 20).alias("preview"),
    )


@_query
def amounts(spark, folder):
    found = _results(spark, folder, "answer").select("result_id", F.posexplode(T.numbers_with_unit(F.col("answer"))).alias("k", "amount"))
    return found.select("result_id", (F.col("k") + 1).alias("amount_no"), "amount")


# ---------------------------------------------------------------- evaluation


@_query
def retrieval_metrics(spark, folder):
    expected = F.transform("source_files", lambda p: T.stem(p))
    retrieved = F.transform("source_chunks", lambda c: T.stem(T.chunk_stem(c)))
    return _questions(spark, folder).select(
        "id", M.hit_rate(retrieved, expected).alias("hit_rate"),
        *(F.round(M.recall(retrieved, expected, k), 6).alias(f"recall_{k}") for k in (3, 5, 10)),
        F.round(M.reciprocal_rank(retrieved, expected), 6).alias("mrr"), F.round(M.ndcg(retrieved, expected), 6).alias("ndcg"),
        F.round(M.diversity(retrieved), 6).alias("diversity"),
    )


@_query
def chunk_metrics(spark, folder):
    """Chunks one further than the expected ones in every other place, in reverse order, against the expected ones."""
    struct = lambda c: F.struct(c.alias("id"), T.chunk_stem(c).alias("stem"), T.chunk_number(c).alias("number"))
    expected = F.transform("source_chunks", struct)
    shifted = F.transform(
        F.reverse("source_chunks"),
        lambda c, k: F.when(k % 2 == 0, F.format_string("%s::chunk::%03d", T.chunk_stem(c), T.chunk_number(c) + 1)).otherwise(c),
    )
    graded = _questions(spark, folder).select("id", expected.alias("expected"), shifted.alias("retrieved"))
    graded = graded.withColumn("rel", F.transform("retrieved", lambda c: M.chunk_relevance(T.chunk_stem(c), T.chunk_number(c), c, F.col("expected"))))
    return graded.select(
        "id", M.chunk_hit(F.col("rel")).alias("chunk_hit"), F.round(M.chunk_reciprocal_rank(F.col("rel")), 6).alias("chunk_mrr"),
        F.round(M.chunk_ndcg(F.col("rel"), F.size("expected")), 6).alias("chunk_ndcg"),
    )


@_query
def dedup_metrics(spark, folder):
    expected = F.transform("source_files", lambda p: T.stem(p))
    retrieved = F.array_distinct(F.transform("source_chunks", lambda c: T.stem(T.chunk_stem(c))))
    return _questions(spark, folder).select("id", M.hit_rate(retrieved, expected).alias("dedup_hit_rate"), F.round(M.ndcg(retrieved, expected), 6).alias("dedup_ndcg"))


@_query
def false_positives(spark, folder):
    refused = _questions(spark, folder).where(F.col("expect_retrieval").eqNullSafe(False))
    rated = refused.select("question_type", M.false_positive_rate(F.col("source_chunks")).alias("r"))
    return rated.groupBy("question_type").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("false_positive_rate"))


def _long(spark, folder, *extra):
    return evaluation.long_metrics(_results(spark, folder, "variant", "question_id", "retrieval_metrics", "generation_metrics", *extra), ["variant", "question_id"], ["retrieval_metrics", "generation_metrics"])


@_query
def variant_means(spark, folder):
    return evaluation.means(_long(spark, folder), ["variant"])


@_query
def type_means(spark, folder):
    types = _questions(spark, folder).select(F.col("id").alias("question_id"), "question_type")
    long = _long(spark, folder).join(types, "question_id")
    return evaluation.means_with_totals(long, "variant", "question_type").select("variant", "question_type", "metric", "mean_value", "n_values", "level")


@_query
def category_means(spark, folder):
    categories = _questions(spark, folder).select(F.col("id").alias("question_id"), F.coalesce("category", F.lit("unknown")).alias("category"))
    results = _results(spark, folder, "variant", "question_id", "retrieval_metrics").join(categories, "question_id")
    return evaluation.means_missing_as_zero(results, ["variant", "category"], "retrieval_metrics", "hit_rate")


@_query
def best_variants(spark, folder):
    return evaluation.best(variant_means(spark, folder)).select("family", "metric", "variant", "mean_value")


@_query
def win_counts(spark, folder):
    return evaluation.win_counts(best_variants(spark, folder))


@_query
def hallucination_rate(spark, folder):
    value = F.try_element_at("generation_metrics", F.lit("faithfulness"))
    return _results(spark, folder, "variant", "generation_metrics").groupBy("variant").agg(evaluation.share_below(value, 0.5).alias("hallucination_rate"))


def _pairs(spark, folder):
    truths = _questions(spark, folder).select(F.col("id").alias("question_id"), F.col("answer").alias("truth"))
    return _results(spark, folder, "question_id", "question", "answer", "contexts").join(truths, "question_id")


@_query
def answer_scores(spark, folder):
    return evaluation.answer_scores(_pairs(spark, folder), "result_id", "question", "answer", "truth", "contexts")


@_query
def context_recall(spark, folder):
    return _pairs(spark, folder).select("result_id", F.round(evaluation.context_recall(F.col("truth"), F.col("contexts")), 6).alias("context_recall"))


@_query
def error_counts(spark, folder):
    errors = _results(spark, folder, "variant", "error").groupBy("variant").agg(F.count("*").alias("n"), F.count("error").alias("errors"))
    return errors.select("variant", "n", "errors", F.round(F.col("errors") / F.col("n"), 6).alias("error_rate"))


# ---------------------------------------------------------------- accounting


@_query
def token_totals(spark, folder):
    return accounting.totals(read_table(spark, folder, "token_records"))


@_query
def token_split(spark, folder):
    parts = ["system_prompt_tokens", "contexts_tokens", "query_tokens"]
    records = evaluation.once(read_table(spark, folder, "token_records").select("record_id", "output_tokens", *parts), "record_id")
    return records.select("record_id", *accounting.proportional_split("output_tokens", parts, "query_tokens"))


@_query
def time_stats(spark, folder):
    return accounting.describe(_results(spark, folder, "variant", "time_seconds"), ["variant"], "time_seconds")


@_query
def stage_profile(spark, folder):
    """Kinds of events as stages, their values as seconds."""
    return accounting.stage_profile(read_table(spark, folder, "events"), "event_type", "value", 100)


@_query
def day_numbers(spark, folder):
    return accounting.day_numbers(_results(spark, folder, "finished_at"), "result_id", "finished_at", "er")


@_query
def token_windows(spark, folder):
    return streams.token_windows(read_table(spark, folder, "token_records"), width="1 day")


@_query
def event_windows(spark, folder):
    return streams.resource_windows(read_table(spark, folder, "events"), "ts", "value", "event_type", "1 day")


@_query
def event_sessions(spark, folder):
    return streams.sessions(read_table(spark, folder, "events"), "ts", "user_id", "2 hours")


# ---------------------------------------------------------------- test sets


@_query
def question_filter(spark, folder):
    kept = testsets.filtered(_questions(spark, folder), ["single_fact", "reasoning"], ["comparison", "summary"], None, ["approved", "auto_approved"])
    return kept.select("id", "test_set", "question_type", "category")


@_query
def merged_testset(spark, folder):
    return testsets.renumbered(testsets.merged(_questions(spark, folder), ["test_set", "id"]), "test_set", ["id"]).select("id", "test_set", "question", "new_id")


@_query
def unknown_sources(spark, folder):
    return testsets.sources_known(_questions(spark, folder), read_table(spark, folder, "loaded_documents"))


@_query
def testset_audit(spark, folder):
    return testsets.audit(_questions(spark, folder))


@_query
def repeated_questions(spark, folder):
    """Questions of test sets and reference questions that are asked more than once."""
    asked = _questions(spark, folder).select("question").unionByName(evaluation.once(read_table(spark, folder, "golden_qa"), "id").select("question"))
    return testsets.repeated(asked.where("question is not null"), ["question"])


@_query
def review_progress(spark, folder):
    return testsets.review_progress(_questions(spark, folder))


@_query
def question_quota(spark, folder):
    weights = _questions(spark, folder).groupBy("test_set", "question_type").agg(F.count("*").alias("weight")).withColumn("total", F.lit(50))
    return testsets.largest_remainder(weights, "test_set", "question_type", "weight", "total")


@_query
def round_robin(spark, folder):
    documents = _loaded(spark, folder).where("content is not null")
    return testsets.round_robin(_questions(spark, folder), "id", ["id"], documents, "load_id")


@_query
def hash_sample(spark, folder):
    return testsets.hash_sample(_questions(spark, folder), "test_set", "id", 5).select("test_set", "id")


@_query
def page_budget(spark, folder):
    sized = _loaded(spark, folder).select(F.col("metadata.format").alias("format"), "load_id", F.coalesce(F.length("content"), F.lit(0)).alias("n_chars")).where("format is not null")
    return testsets.until_target(sized, "format", ["load_id"], "n_chars", 50_000).select("format", "load_id", "n_chars", "running")


@_query
def systematic_sample(spark, folder):
    return testsets.systematic(_questions(spark, folder).select("test_set", "id"), "test_set", ["id"], 7)


@_query
def greedy_unique(spark, folder):
    return testsets.greedy_unique(_questions(spark, folder), "id", "question", "source_files")


@_query
def capped_shares(spark, folder):
    kilobytes = F.coalesce(F.octet_length("content"), F.lit(0)) / 1024
    sized = _loaded(spark, folder).select(F.coalesce("metadata.format", F.lit("?")).alias("format"), "load_id", kilobytes.alias("kilobytes"))
    return testsets.capped_shares(sized, "format", "load_id", "kilobytes", 40, ((8.0, 5), (3.0, 3), (0.0, 1)))


@_query
def share_types(spark, folder):
    return testsets.with_types(capped_shares(spark, folder), "allotted", {"single_fact": 0.45, "reasoning": 0.35, "comparison": 0.2}, 41)


@_query
def excerpt_found(spark, folder):
    source = F.translate(F.get("source_files", 0), "\\", "/")
    asked = _questions(spark, folder).where("ground_truth_excerpt is not null").select("id", source.alias("path"), "ground_truth_excerpt")
    documents = _loaded(spark, folder).select(F.translate("source_path", "\\", "/").alias("path"), "content").where("content is not null")
    return asked.join(documents, "path").select("id", testsets.excerpt_found(F.col("ground_truth_excerpt"), F.col("content")).alias("found"))


# ---------------------------------------------------------------- snapshots and traces


def _files(spark, folder):
    path = F.translate("source_path", "\\", "/")
    return _loaded(spark, folder).select(path.alias("path"), snapshots.content_hash(F.col("content")).alias("sha"), (_number("load_id") % 3).alias("snapshot"), "load_id")


@_query
def snapshot_ids(spark, folder):
    return snapshots.data_ids(_files(spark, folder), "snapshot", "sha")


def _overlapping(spark, folder):
    """Two snapshots that share every third file, which the second has changed."""
    files = _files(spark, folder)
    first = files.where("snapshot <= 1").withColumn("snapshot", F.lit(0))
    return first.unionByName(files.where("snapshot >= 1").withColumn("sha", F.sha2("sha", 256)).withColumn("snapshot", F.lit(1)))


@_query
def snapshot_merge(spark, folder):
    return snapshots.merged(_overlapping(spark, folder), "path", ["snapshot", "load_id"]).select("path", "sha", "snapshot", "load_id")


@_query
def merge_counts(spark, folder):
    return snapshots.merge_counts(_overlapping(spark, folder), "path", "snapshot", ["snapshot", "load_id"])


@_query
def snapshot_extend(spark, folder):
    files = _files(spark, folder)
    return snapshots.extended(files.where("snapshot = 0"), files.where("snapshot <= 1"), "path").select("path", "snapshot", "load_id")


@_query
def snapshot_status(spark, folder):
    files = _files(spark, folder)
    present = files.where(_number("load_id") % 10 != 0).withColumn("sha", F.when(_number("load_id") % 7 == 0, "changed").otherwise(F.col("sha")))
    return snapshots.status(files, present, "snapshot", "path", "sha")


@_query
def unparsed_files(spark, folder):
    files = _files(spark, folder)
    return snapshots.unparsed(files, files.where("snapshot = 1"), "path", "sha").select("path", "sha")


@_query
def equivalence_groups(spark, folder):
    """Files and editions of every other one: a summary, a translation or a revision beside the original."""
    path, n = F.translate("source_path", "\\", "/"), _number("load_id")
    mark = F.when(n % 3 == 0, "_摘要").when(n % 3 == 1, "_英文版_").otherwise("_修订版_")
    edition = F.when(n % 2 == 0, F.regexp_replace(path, r"\.([^./]*)$", F.concat(mark, F.lit(".$1"))))
    paths = _loaded(spark, folder).select(F.explode(F.array_compact(F.array(path, edition))).alias("path"))
    groups = snapshots.equivalence_groups(paths, "path")
    return groups.select("group_key", F.array_join("members", "|").alias("members"))


@_query
def variant_plan(spark, folder):
    variants = _results(spark, folder, "variant", "error").groupBy("variant").agg(F.count("*").alias("n"), F.count("error").alias("errors"))
    wanted = variants.select("variant", F.sha2(F.concat_ws(":", "variant", F.lit("v2")), 256).alias("hash"))
    done = variants.select("variant", F.sha2(F.concat_ws(":", "variant", F.when(F.col("n") % 2 == 0, "v2").otherwise("v1")), 256).alias("hash"), (F.col("errors") % 3 != 0).alias("completed"))
    return snapshots.plan(wanted, done, "variant", "hash")


@_query
def fingerprint_differences(spark, folder):
    fields = ["difficulty", "category", "question_type"]
    left = _questions(spark, folder).select("id", *fields)
    right = left.withColumn("difficulty", F.when(_number("id") % 5 == 0, "hard").otherwise(F.col("difficulty"))).withColumn("category", F.when(_number("id") % 7 == 0, None).otherwise(F.col("category")))
    return snapshots.differences(left, right, "id", fields)


@_query
def newest_results(spark, folder):
    return traces.newest(_results(spark, folder, "variant", "finished_at"), "variant", "finished_at", "result_id", 10)


@_query
def chat_turns(spark, folder):
    results = _results(spark, folder, "variant", "question", "answer")
    both = results.select("variant", F.explode(F.array(
        F.struct(F.concat("result_id", F.lit("a")).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text")),
        F.struct(F.concat("result_id", F.lit("b")).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text")),
    )).alias("t"), F.concat_ws("-", "variant", (F.floor(_number("result_id") / 40)).cast("string")).alias("conversation"))
    return traces.chat_turns(both.select("conversation", "t.*"), "conversation", "turn", "role", "text")


@_query
def root_causes(spark, folder):
    """Traces made up of the chunks of each question: some stages lose or move them, or don't run, by the number of the question."""
    n = _number("id")
    filler = F.slice(F.array(*(F.concat(F.lit("other::chunk::00"), F.lit(str(k))) for k in range(6))), F.lit(1), (n % 6).cast("int"))
    kept = F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.coalesce("source_chunks", F.array().cast("array<string>")))
    retrieved = F.concat(filler, kept)
    question = F.coalesce("question", F.lit(""))
    made = _questions(spark, folder).select(
        "id", question.alias("question"), F.col("source_chunks").alias("truth"), F.col("ground_truth_excerpt").alias("truth_answer"), retrieved.alias("retrieved"),
        F.when(n % 3 != 0, F.reverse(retrieved)).alias("reranked"), F.when(n % 7 != 0, retrieved).alias("context_input"), F.when(n % 7 != 0, n % 4).alias("context_count"),
        F.when(n % 2 == 0, F.array(F.concat(question, F.lit("?")))).otherwise(F.array(question)).alias("rewritten"),
        F.when(n % 8 != 0, F.concat(F.lit("So: "), F.coalesce("ground_truth_excerpt", F.lit("")))).alias("answer"),
    )
    return traces.root_causes(made, "id")


@_query
def truth_in_stages(spark, folder):
    """The expected document of each asked question in a wide and a narrow stage of retrieval."""
    asked, documents = _asked(spark, folder), _loaded(spark, folder)
    hits = search.with_texts(search.bm25(documents, "load_id", "content", asked, "id", "question", 20), documents.select("load_id", "source_path"), "load_id")
    stages = hits.select("id", F.explode(F.array(F.lit("retrieval"), F.when(F.col("rank") <= 5, "rerank"))).alias("stage"), F.col("source_path").alias("item"), "rank", "score").where("stage is not null")
    truth = asked.select("id", F.explode(F.array_distinct("expected_sources")).alias("item"))
    return traces.truth_in_stages(stages, truth, "id", "stage", "item")


@_query
def case_lookup(spark, folder):
    """Cases of all questions, with previews of 3 to 30 characters."""
    questions = _questions(spark, folder).where("question is not null")
    cases = questions.select(F.col("id").alias("case_id"), F.substring("question", F.lit(1), (3 + _number("id") % 28).cast("int")).alias("preview"))
    return traces.cases_for(cases, questions.select("id", "question"), "preview", "question")


# ---------------------------------------------------------------- checks


@_query
def contained_documents(spark, folder):
    return validation.contained_documents(read_table(spark, folder, "loaded_documents"), "load_id", "content")


@_query
def text_classes(spark, folder):
    return validation.text_classes(read_table(spark, folder, "documents"), "doc_id", "text").where("member <> class")


@_query
def primary_pool(spark, folder):
    documents = read_table(spark, folder, "loaded_documents").select("load_id", "source_path").distinct()
    return validation.primary_pool(documents, contained_documents(spark, folder), "load_id")


@_query
def authenticity(spark, folder):
    issues = validation.authenticity_issues(F.col("question"))
    return _questions(spark, folder).where("question is not null").select("id", F.array_join(issues, "; ").alias("issues"), (F.size(issues) == 0).alias("authentic"))


@_query
def unit_errors(spark, folder):
    """Answers against excerpts whose amounts are written out in full, one in three of them ten times too large."""
    amount = F.regexp_extract("answer", r"(\d+\.\d+)亿", 1)
    told = _questions(spark, folder).where(amount != "").select("id", "answer", (amount.cast("double") * F.when(_number("id") % 3 == 0, 10).otherwise(1) * 100_000_000).cast("long").alias("v"))
    pairs = told.select("id", validation.unit_errors(F.col("answer"), F.concat(F.lit("共 "), F.col("v").cast("string"), F.lit(" 元"))).alias("e"))
    return pairs.select("id", F.explode("e").alias("e")).select("id", "e.answer_value", "e.excerpt_value")


@_query
def short_answers(spark, folder):
    return _results(spark, folder, "answer").where("answer is not null").select("result_id", validation.cut_answer(F.col("answer"), 60).alias("short_answer"))


@_query
def quote_matches(spark, folder):
    """Excerpts with one character in eleven replaced, looked for in the document they are from."""
    source = F.translate(F.get("source_files", 0), "\\", "/")
    asked = _questions(spark, folder).where("ground_truth_excerpt is not null").select("id", source.alias("path"), F.regexp_replace("ground_truth_excerpt", "(.{10}).", "$1_").alias("quote"))
    documents = _loaded(spark, folder).select(F.translate("source_path", "\\", "/").alias("path"), "content").where("content is not null")
    return validation.quote_matches(asked.join(documents, "path"), ["id"], "quote", "content")


@_query
def chunk_neighbours(spark, folder):
    chunks = chunking.fixed_chunks(read_table(spark, folder, "documents"), "doc_id", "text", 64, 16).select("doc_id", "chunk_index", "chunk_id")
    return validation.neighbours(chunks, "doc_id", "chunk_index", "chunk_id")


@_query
def document_keywords(spark, folder):
    return search.keywords(read_table(spark, folder, "documents"), "doc_id", "text")


@_query
def length_stats(spark, folder):
    return accounting.length_stats(read_table(spark, folder, "documents"), "text", "doc_kind")


@_query
def stratified_sample(spark, folder):
    sized = _loaded(spark, folder).select(F.coalesce("metadata.format", F.lit("?")).alias("format"), "load_id", F.coalesce(F.length("content"), F.lit(0)).alias("n_chars"))
    return testsets.stratified(sized, "format", "n_chars", "load_id", 4)


@_query
def testset_quality(spark, folder):
    return testsets.quality(_questions(spark, folder), F.size(validation.authenticity_issues(F.col("question"))) == 0)


@_query
def answer_positions(spark, folder):
    return _pairs(spark, folder).where("answer is not null and truth is not null").select("result_id", F.round(testsets.positional_overlap(F.col("answer"), F.col("truth")), 6).alias("overlap"))


@_query
def equivalent_hits(spark, folder):
    """Hits of questions where files of one folder and year stand for each other."""
    questions = _questions(spark, folder)
    year = F.regexp_extract(F.translate("source_path", "\\", "/"), r"^(.*_\d{4})_", 1)
    groups = _loaded(spark, folder).groupBy(year.alias("group_key")).agg(F.array_sort(F.collect_set(F.translate("source_path", "\\", "/"))).alias("members"))
    posix = lambda c: F.transform(c, lambda p: F.translate(p, "\\", "/"))
    expected = snapshots.canonical(questions.select("id", posix("source_files").alias("e")), "id", "e", groups)
    retrieved = snapshots.canonical(questions.select("id", posix(F.reverse("source_files")).alias("g")), "id", "g", groups)
    return expected.join(retrieved, "id").select("id", F.size("e").alias("n_expected"), F.round(M.ndcg(F.col("g"), F.col("e")), 6).alias("ndcg"), M.hit_rate(F.col("g"), F.col("e"), 1).alias("hit_1"))


@_query
def multi_hop_pairs(spark, folder):
    """Chunks 2 to 4 apart in documents of at least three chunks."""
    chunks = chunking.fixed_chunks(read_table(spark, folder, "documents"), "doc_id", "text", 64, 16).select("doc_id", "chunk_index", "chunk_id")
    return validation.neighbours(chunks, "doc_id", "chunk_index", "chunk_id", 4, 2, 3)


@_query
def unsupported_numbers(spark, folder):
    """Numbers of reference answers that their excerpts lack."""
    missing = evidence.unsupported_numbers(F.col("answer"), F.col("ground_truth_excerpt"))
    return _questions(spark, folder).select("id", F.posexplode(missing).alias("k", "number")).select("id", (F.col("k") + 1).alias("issue_no"), "number")


@_query
def sign_contradictions(spark, folder):
    """Answers, some of which call a value negative, against excerpts that have some of the values with a minus."""
    n = _number("id")
    told = F.concat(F.coalesce("answer", F.lit("")), F.when(n % 2 == 0, F.concat(F.lit("，为负 "), (n % 25).cast("string"), F.lit(".5"))).otherwise(""))
    excerpt = F.concat(F.coalesce("ground_truth_excerpt", F.lit("")), F.when(n % 3 == 0, F.concat(F.lit(" -"), (n % 25).cast("string"), F.lit(".5"))).otherwise(""))
    return _questions(spark, folder).select("id", evidence.sign_contradiction(told, excerpt).alias("contradicts"))


def _quoted(spark, folder):
    """(evidence, segments, documents): excerpts as quotes of one segment of their document, some of a wrong or no segment, some altered."""
    path, n = F.translate(F.get("source_files", 0), "\\", "/"), _number("id")
    documents = _loaded(spark, folder).select(F.translate("source_path", "\\", "/").alias("path"), "content").where("content is not null")
    pages = chunking.pages_of(documents, "path", "content")
    segments = cut(chunking.page_segments(pages, "path", "page_number", "text", 600).select("path", "segment_index", "pages", "text"))
    quote = F.when(n % 6 == 5, F.regexp_replace("ground_truth_excerpt", "^(.{12}).", "$1_")).otherwise(F.col("ground_truth_excerpt"))
    index = F.when(n % 9 != 0, F.when(n % 10 == 3, 10_000).otherwise(n % 4)).cast("int")
    quotes = _questions(spark, folder).where("ground_truth_excerpt is not null").select("id", path.alias("path"), index.alias("segment_index"), quote.alias("quote"))
    return quotes.where("path is not null"), segments, documents


@_query
def checked_evidence(spark, folder):
    return evidence.checked_evidence(*_quoted(spark, folder), ["id"], "path")


@_query
def evidence_rates(spark, folder):
    return evidence.evidence_rates(_questions(spark, folder), checked_evidence(spark, folder), "id", "test_set")


@_query
def gated_questions(spark, folder):
    path = F.translate("source_path", "\\", "/")
    documents = _loaded(spark, folder).select(path.alias("path"), "content")
    asked = _questions(spark, folder).withColumn("path", F.translate(F.get("source_files", 0), "\\", "/")).join(documents, "path", "left")
    checked = evidence.gated(asked.withColumn("quotes", F.col("ground_truth_excerpt")), "id", "content", "quotes")
    return checked.select("id", "answer", "corrected", "contradicts_sign", "excerpt_verified", F.size("unsupported").alias("unsupported"), "kept")


def _graded(spark, folder):
    """Questions with their chunks as expected ones and the same, moved and turned, as retrieved ones."""
    struct = lambda c: F.struct(c.alias("id"), T.chunk_stem(c).alias("stem"), T.chunk_number(c).alias("number"))
    moved = F.transform(F.reverse("source_chunks"), lambda c, k: F.when(k % 2 == 0, F.format_string("%s::chunk::%03d", T.chunk_stem(c), T.chunk_number(c) + 1)).otherwise(c))
    asked = _questions(spark, folder).withColumn("_got", F.coalesce(moved, F.array().cast("array<string>")))
    return asked.select(
        "id", "question_type", "test_set", "expect_retrieval", F.transform("_got", lambda c: T.stem(T.chunk_stem(c))).alias("sources"),
        F.transform(F.coalesce("source_files", F.array().cast("array<string>")), lambda p: T.stem(p)).alias("expected"),
        F.transform("_got", struct).alias("chunks"), F.transform(F.coalesce("source_chunks", F.array().cast("array<string>")), struct).alias("expected_chunks"),
    )


@_query
def applicable_metrics(spark, folder):
    metrics = evaluation.applicable_metrics(_graded(spark, folder), "id")
    shown = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"])))), ";")
    return metrics.select("id", *(shown(c).alias(c) for c in ("retrieval", "chunk", "dedup")), "false_positive_rate")


def _aggregated(spark, folder):
    metrics = evaluation.applicable_metrics(_graded(spark, folder), "id").withColumnRenamed("id", "question_id")
    types = _questions(spark, folder).select(F.col("id").alias("question_id"), "question_type")
    return _results(spark, folder, "variant", "question_id", "generation_metrics").withColumnRenamed("generation_metrics", "generation").join(metrics, "question_id").join(types, "question_id")


@_query
def experiment_aggregate(spark, folder):
    return evaluation.experiment_aggregate(_aggregated(spark, folder), ["variant"])


@_query
def aggregate_by_type(spark, folder):
    return evaluation.aggregate_by_type(_aggregated(spark, folder), ["variant"])


@_query
def question_patterns(spark, folder):
    return testsets.repeated_patterns(_questions(spark, folder), "test_set")


@_query
def concentrated_questions(spark, folder):
    return testsets.concentrated(_questions(spark, folder), "test_set")


@_query
def shared_entities(spark, folder):
    """Questions about one document with the same kind and difficulty, taken as entities."""
    return testsets.shared_entities(_questions(spark, folder), "expect_retrieval", "id", F.array_compact(F.array("question_type", "difficulty")))


@_query
def difficulty_histogram(spark, folder):
    return testsets.difficulty_histogram(_questions(spark, folder), "test_set")


@_query
def common_sources(spark, folder):
    held = _questions(spark, folder).select("test_set", F.explode("source_files").alias("source_path"))
    return testsets.most_common(held, "test_set", F.col("source_path"), "source_path")


@_query
def question_tiers(spark, folder):
    """Tiers by a mean of four marks from 1 to 5, made up from the number of the question."""
    n = _number("id")
    mean = (n % 5 + (n / 5).cast("long") % 5 + (n / 25).cast("long") % 5 + (n / 125).cast("long") % 5) / 4 + 1
    return _questions(spark, folder).select("id", testsets.tier(mean, F.when(n % 50 == 0, "C")).alias("tier"))


@_query
def metric_backends(spark, folder):
    """Which backend computes each metric that results have: the first of those that support it, by priority."""
    wanted = _long(spark, folder).select("metric").distinct()
    return evaluation.resolve_metrics(wanted, _backends(spark))


def _backends(spark):
    rows = [("faithfulness", "external", 2), ("faithfulness", "builtin", 1), ("answer_relevancy", "external", 1), ("hit_rate", "builtin", 1), ("mrr", "builtin", None)]
    return spark.createDataFrame(rows, "metric string, backend string, priority int")


@_query
def metric_columns(spark, folder):
    """Every backend's column for each metric that results have, for comparisons."""
    return evaluation.compared_metrics(_long(spark, folder).select("metric").distinct(), _backends(spark))


def _blocks(spark, folder):
    """Lines of documents as text blocks of a page, in two columns where the document's number is even."""
    lines = read_table(spark, folder, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "text")).where(F.trim("text") != "")
    right = (F.col("doc_id") % 2 == 0) & (F.col("k") % 3 == 1)
    top = (F.col("k") * 12).cast("double")
    return lines.select(
        "doc_id", "k", "text", F.when(right, 320.0).otherwise(40.0).alias("x0"), F.when(right, 560.0).otherwise(280.0).alias("x1"), top.alias("y0"), (top + 10).alias("y1"),
        F.when(F.col("k") == 0, 17.0).when(F.col("k") % 7 == 0, 12.5).otherwise(10.0).alias("font_size"), (F.col("k") % 7 == 0).alias("is_bold"),
        F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"),
    )


@_query
def noise_blocks(spark, folder):
    noise = layout.is_noise(F.col("text"), F.col("y0"), F.col("y1"), F.col("page_height"))
    return _blocks(spark, folder).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(noise).alias("noise"))


@_query
def page_columns(spark, folder):
    return layout.with_columns(_blocks(spark, folder), ["doc_id"]).groupBy("doc_id").agg(F.max("n_columns").alias("n_columns"))


@_query
def block_headings(spark, folder):
    mark = F.trim(layout.heading(F.col("font_size"), F.col("is_bold"), F.col("text")))
    return _blocks(spark, folder).select("doc_id", "k", mark.alias("mark")).where("mark <> ''")


@_query
def page_markdown(spark, folder):
    return layout.page_markdown(_blocks(spark, folder), ["doc_id"])


@_query
def cells_markdown(spark, folder):
    """The cells of each document's lines, cut at blanks, as a table."""
    words = lambda line: F.transform(F.slice(F.split(line, " "), 1, 5), lambda c: F.when(c != "", c))
    tables = read_table(spark, folder, "documents").where("text is not null").select("doc_id", F.transform(F.slice(F.split("text", "\n", -1), 1, 8), words).alias("cells"))
    return tables.select("doc_id", layout.cells_markdown(F.col("cells")).alias("markdown"))


@_query
def issue_transitions(spark, folder):
    """Moves between the states of answers to each question, in the order in which they were finished."""
    state = F.when(F.col("error").isNotNull(), "failed").when(F.col("answer").isNull(), "open").otherwise("done")
    told = _results(spark, folder, "question_id", "finished_at", "error", "answer").select("question_id", "result_id", "finished_at", state.alias("to_state"))
    before = F.lag("to_state").over(Window.partitionBy("question_id").orderBy("finished_at", "result_id"))
    moves = told.withColumn("from_state", before).where("from_state is not null").select("result_id", "from_state", "to_state")
    allowed = spark.createDataFrame([("open", "done"), ("open", "failed"), ("failed", "open"), ("failed", "done")], "from_state string, to_state string")
    return traces.allowed_transitions(moves, allowed)


@_query
def located_chunks(spark, folder):
    """The chunks on a quote's pages that hold it."""
    quotes, segments, _ = _quoted(spark, folder)
    chunks = segments.select("path", F.explode("pages").alias("page_number"), F.concat_ws("::", "path", "segment_index").alias("chunk_id"), "text")
    paged = quotes.where("segment_index is not null").select("id", "path", "quote", F.array(F.col("segment_index") + 1, F.col("segment_index") + 2).alias("pages"))
    return validation.located_chunks(paged, chunks, "id", "path")


@_query
def latest_results(spark, folder):
    """Results of questions computed anew for every other one, with a null here and there."""
    n = _number("id")
    old = _questions(spark, folder).select("id", "difficulty", "category")
    new = old.where(n % 2 == 0).select("id", F.when(n % 4 == 0, "hard").alias("difficulty"), F.lit("checked").alias("category"))
    return snapshots.latest_by_key(old.where(n % 3 != 0), new, "id")


@_query
def case_actions(spark, folder):
    n = _number("id")
    kind = F.when(n % 4 < 2, "bad").otherwise("good")
    wanted = _questions(spark, folder).select("id", kind.alias("kind"))
    return snapshots.case_actions(wanted.where(n % 3 != 0).withColumn("kind", F.when(n % 5 == 0, "good").otherwise(F.col("kind"))), wanted, "id", "kind")


@_query
def snapshot_statistics(spark, folder):
    path = F.translate("source_path", "\\", "/")
    documents = _loaded(spark, folder).select(path.alias("path"), "content").where("content is not null")
    pages = chunking.pages_of(documents, "path", "content")
    return snapshots.statistics(_files(spark, folder), pages, chunking.fixed_chunks(documents, "path", "content", 64, 0), "snapshot", "path")


@_query
def compared_pipelines(spark, folder):
    """Kinds of documents as pipelines; characters as the time to parse."""
    documents = read_table(spark, folder, "documents")
    tables = parsing.table_quality(documents, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("tables"), F.avg("empty_ratio").alias("empty_ratio"))
    pages = parsing.page_metrics(documents, "doc_id", "text").join(tables, "doc_id", "left").join(documents.select("doc_id", "doc_kind"), "doc_id")
    measured = pages.select(
        "doc_kind", F.coalesce("tables", F.lit(0)).alias("tables"), F.col("n_chars").alias("chars"), F.col("n_words").alias("words"), F.col("n_headings").alias("headings"),
        (F.col("n_chars") / 1000).alias("parse_seconds"), F.coalesce("empty_ratio", F.lit(0.0)).alias("empty_ratio"), F.col("valid").cast("double").alias("valid_ratio"),
    )
    return parsing.compared_pipelines(measured, "doc_kind")


@_query
def sample_share(spark, folder):
    return testsets.sample_share(_questions(spark, folder), "test_set", "id", 0.15).select("test_set", "id")


@_query
def first_questions(spark, folder):
    return testsets.first_questions(_questions(spark, folder), ["id"], 25).select("id", "test_set")


@_query
def chosen_segments(spark, folder):
    path = F.translate("source_path", "\\", "/")
    documents = _loaded(spark, folder).select(path.alias("path"), "content").where("content is not null")
    segments = chunking.fixed_chunks(documents, "path", "content", 64, 0).select("path", F.col("chunk_index").alias("segment_index"))
    asked = _questions(spark, folder).select("id", "question_type", F.translate(F.get("source_files", 0), "\\", "/").alias("path"))
    return testsets.chosen_segments(asked, segments, "id", "path")


@_query
def listed_issues(spark, folder):
    """Questions as issues: their review as status, kind and difficulty, with labels."""
    issues = _questions(spark, folder).select(
        "id", F.col("metadata.review_status").alias("status"), F.col("question_type").alias("kind"), F.col("difficulty").alias("priority"),
        F.array_compact(F.array("category", "test_set")).alias("labels"), _number("id").alias("created_at"),
    )
    return testsets.listed_issues(issues, "approved", None, None, ["set_full"]).select("id", "kind", "priority", "created_at")


@_query
def file_kinds(spark, folder):
    name = F.col("name")
    return _loaded(spark, folder).select(
        "load_id", T.pdf_type(F.translate("source_path", "\\", "/")).alias("pdf_type"), T.data_path(F.translate("source_path", "\\", "/"), "/mnt/store/").alias("moved"),
        T.slug(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9_ -]", "")).alias("slug"), T.pdf_name(F.coalesce(name, F.lit(""))).alias("pdf_name"),
    )


@_query
def judged_answers(spark, folder):
    """Judges' answers made up from the number of a result: JSON, fenced or not, with a mark missing here and there."""
    n = _number("result_id")
    body = F.concat(F.lit('{"directness": '), (n % 6).cast("string"), F.when(n % 3 != 0, F.concat(F.lit(', "specificity": '), (n % 5).cast("string"))).otherwise(""), F.when(n % 7 == 0, ', "overall_score": 0.75').otherwise(""), F.lit("}"))
    told = F.when(n % 11 == 0, "no idea").when(n % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), body))
    verdicts = F.transform(F.sequence(F.lit(1), (n % 5).cast("int") + 1), lambda k: ((n + k) % 2).cast("int"))
    return _results(spark, folder).select("result_id", F.round(seams.relevancy(told), 6).alias("relevancy"), F.round(seams.supported_share(verdicts), 6).alias("faithfulness"))
