"""Whole pipelines: ingest to chunks and vectors under their fingerprint, answer many questions, evaluate variants."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import metrics as M
from folioforge.functions import text as T
from folioforge.operators import chunking, search, snapshots


@dataclass(frozen=True)
class Settings:
    """What shapes the answer to a question; overrides of a variant make another one."""

    method: str = "hybrid"
    top_k: int = 5
    score_threshold: float = 0.0
    chunking: str = "fixed"
    page_overlap: int = 0
    rewriting: str = "none"
    chunk_size: int = 512
    overlap: int = 0
    k1: float = 1.5
    b: float = 0.75
    fusion: str = "rrf"
    rrf_k: int = 60
    weights: tuple[float, float] = (0.7, 0.3)
    vector_size: int = 256
    rerank: bool = False
    rerank_top: int = 3
    context_budget: int = 8000 - 1024 - 200
    extra: dict = field(default_factory=dict, hash=False)

    def __post_init__(self) -> None:
        if self.method not in ("vector", "bm25", "hybrid") or self.fusion not in ("rrf", "weighted"):
            raise ValueError("unknown method or fusion")
        if self.chunking not in ("fixed", "page_aware", "semantic") or self.rewriting not in ("none", "hyde", "multi_query"):
            raise ValueError("unknown way of chunking or rewriting")
        if not 0 <= self.overlap < self.chunk_size:
            raise ValueError("overlap must be at least 0 and less than the chunk size")

    def chunk_fingerprint(self) -> str:
        """Name of the chunks: variants that agree in it share them."""
        return snapshots.config_hash({"strategy": self.chunking, "size": self.chunk_size, "overlap": self.overlap, "page_overlap": self.page_overlap})


def retrieve(chunks: DataFrame, questions: DataFrame, settings: Settings, key: str = "chunk_id", text: str = "text", query: str = "id", question: str = "question") -> DataFrame:
    """(query, key, score, rank) for all questions at once; the threshold is applied after the ranking."""
    fetch = settings.top_k * 3 if settings.method == "hybrid" else settings.top_k
    lexical = vector = None
    if settings.method != "vector":
        lexical = search.bm25(chunks, key, text, questions, query, question, fetch, settings.k1, settings.b)
    if settings.method != "bm25":
        vectors = search.hashed_vectors(chunks, key, text, settings.vector_size)
        asked = search.hashed_vectors(questions, query, question, settings.vector_size)
        vector = search.vector_search(vectors, key, "vector", asked, query, "vector", fetch)
    if settings.method == "hybrid":
        if settings.fusion == "rrf":
            hits = search.reciprocal_rank_fusion([vector, lexical], query, key, settings.top_k, settings.rrf_k)
        else:
            hits = search.weighted_fusion(vector, lexical, query, key, settings.top_k, settings.weights)
    else:
        hits = lexical if vector is None else vector
    if settings.score_threshold > 0:
        hits = hits.where(F.col("score") >= settings.score_threshold)
    if settings.rerank:
        # The questions go to the hits before the texts do: texts are read where they lie and only their scores are moved.
        asking = hits.join(questions.select(query, F.col(question).alias("_q")), query)
        texts = search.with_texts(asking, chunks.select(key, F.col(text).alias("_t")), key)
        hits = search.rerank(texts, query, key, "_q", "_t", settings.rerank_top).select(query, key, F.col("rerank_score").alias("score"), F.col("rerank").alias("rank"))
    return hits


def assemble(hits: DataFrame, chunks: DataFrame, settings: Settings, key: str = "chunk_id", text: str = "text", query: str = "id", source: str = "source") -> DataFrame:
    """(query, prompt): texts of the hits in rank order within the token budget; texts are joined only after the ranking."""
    texts = search.with_texts(hits, chunks.select(key, F.col(text).alias("_text"), F.col(source).alias("_source")), key)
    counted = texts.withColumn("_tokens", F.greatest(F.lit(1), F.floor(F.length("_text") / 4)))
    return search.prompts(search.within_budget(counted, query, "_tokens", settings.context_budget), query, "_source", "_text")


def chunked(documents: DataFrame, settings: Settings, key: str, text: str, embed=None) -> DataFrame:
    """(chunk_id, key, text) of the documents under the settings' strategy.

    ``page_aware`` cuts at form feeds first and carries ``page_overlap`` tokens over; ``semantic`` needs ``embed``, which gives
    a vector for each of a list of sentences.
    """
    if settings.chunking == "fixed":
        return chunking.fixed_chunks(documents, key, text, settings.chunk_size, settings.overlap)
    if settings.chunking == "page_aware":
        pages = chunking.pages_of(documents, key, text)
        return chunking.page_chunks(pages, key, "page_number", "text", settings.chunk_size, settings.overlap, settings.page_overlap)
    if embed is None:
        raise ValueError("semantic chunks need a function that embeds sentences")
    cuts = chunking.semantic_chunks(documents, key, text, embed, settings.chunk_size, max(settings.chunk_size // 8, 1))
    return cuts.select(F.format_string("%s::chunk::%03d", F.col(key).cast("string"), "chunk_index").alias("chunk_id"), key, "chunk_index", "text")


def rewritten(questions: DataFrame, settings: Settings, generate=None, query: str = "id", question: str = "question", most: int = 3) -> DataFrame:
    """(query, sub_no, text): the texts that are searched for each question.

    ``none`` the question itself; ``hyde`` the answer that ``generate`` makes up for it; ``multi_query`` the lines of what it
    gives, without numbering, at most ``most``. A question for which nothing comes back is searched as it is.
    """
    asked = questions.select(query, F.col(question).alias("_question"))
    if settings.rewriting == "none":
        return asked.select(query, F.lit(0).alias("sub_no"), F.col("_question").alias("text"))
    if generate is None:
        raise ValueError("rewriting needs a function that generates a text for each of a column of prompts")
    given = asked.withColumn("_given", generate(F.col("_question")))
    if settings.rewriting == "hyde":
        return given.select(query, F.lit(0).alias("sub_no"), F.when(F.trim("_given") != "", F.col("_given")).otherwise(F.col("_question")).alias("text"))
    lines = F.filter(F.transform(F.split(F.trim("_given"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    bare = F.slice(F.transform(lines, lambda x: F.regexp_replace(x, r"^[0-9.\-) ]+", "")), 1, most)
    return given.select(query, F.posexplode(F.when(F.size(bare) > 0, bare).otherwise(F.array("_question"))).alias("sub_no", "text"))


def chosen_score(score: Column, rerank_score: Column, several: bool) -> Column:
    """Score that a hit shows: that of re-ranking, where there is one, if several queries were merged; else its own."""
    return F.coalesce(rerank_score, score) if several else score


def quality(hits: DataFrame, questions: DataFrame, source: str, query: str = "id", expected: str = "expected_sources", k: int = 5) -> DataFrame:
    """Document-level metrics of ranked hits for every question, those without hits too."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", T.stem(F.col(source)).alias("s")))), lambda x: x["s"])
    lists = hits.groupBy(query).agg(ordered.alias("retrieved"))
    both = questions.join(lists, query, "left")
    wanted = F.transform(F.coalesce(expected, F.array().cast("array<string>")), lambda p: T.stem(p))
    got = F.coalesce("retrieved", F.array().cast("array<string>"))
    return both.select(
        query,
        M.hit_rate(got, wanted, k).alias("hit_rate"),
        F.round(M.recall(got, wanted, k), 6).alias("recall"),
        F.round(M.reciprocal_rank(got, wanted), 6).alias("mrr"),
        F.round(M.ndcg(got, wanted, k), 6).alias("ndcg"),
        F.round(M.diversity(got, k), 6).alias("diversity"),
    )
