"""Checks of questions, answers and evidence against their documents."""

from __future__ import annotations

import difflib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.runtime import cut, ship, spread

# Phrasings that give away a made-up question, and openings of templates.
ACADEMIC = ("根据文档", "根据提供的信息", "请分析", "请说明", "请对比", "请总结", "文档中提到", "片段中提到")
TEMPLATE_STARTS = ("请问", "请解释", "请描述")
LONG_QUESTION = 100


def authenticity_issues(question: Column) -> Column:
    """Array of what makes a question look made up; empty for a genuine one."""
    marks = [F.when(question.contains(p), F.lit(f"phrase {p}")) for p in ACADEMIC]
    marks += [F.when(question.startswith(p), F.lit(f"opening {p}")) for p in TEMPLATE_STARTS]
    marks.append(F.when(F.length(question) > LONG_QUESTION, F.lit("too long")))
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def unit_errors(answer: Column, excerpt: Column) -> Column:
    """Array of (answer_value, excerpt_value): amounts in hundred millions that are ten times or a tenth of one in the excerpt.

    Excerpt amounts are plain numbers of at least eight digits or commas, above one hundred million.
    """
    raw = F.transform(F.regexp_extract_all(excerpt, F.lit(r"[\d,]{8,}(?:\.\d+)?"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").try_cast("double") / 1e8)
    large = F.filter(raw, lambda x: x > 1)
    told = F.filter(F.transform(F.regexp_extract_all(answer, F.lit(r"([\d,.]+)\s*亿"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("double")), lambda x: x.isNotNull())
    wrong = lambda a, e: a.between(e * 9.5, e * 10.5) | a.between(e * 0.05, e * 0.15)
    pairs = F.flatten(F.transform(told, lambda a: F.transform(large, lambda e: F.struct(a.alias("answer_value"), F.round(e, 2).alias("excerpt_value"), wrong(a, e).alias("wrong")))))
    return F.transform(F.filter(F.coalesce(pairs, F.array().cast("array<struct<answer_value:double,excerpt_value:double,wrong:boolean>>")), lambda p: p["wrong"]), lambda p: F.struct(p["answer_value"], p["excerpt_value"]))


def cut_answer(answer: Column, limit: int) -> Column:
    """An answer cut to a limit: after its last full stop if that lies past half of the limit, else hard."""
    head = F.substring(answer, 1, limit)
    last = F.length(head) - F.locate("。", F.reverse(head)) + 1
    return F.when(F.length(answer) <= limit, answer).when((F.locate("。", F.reverse(head)) > 0) & (last > limit / 2), F.substring(answer, F.lit(1), last)).otherwise(head)


def _blank(text: str) -> str:
    return " ".join(text.split())


def _likeness_bounds(quote: str, text: str) -> np.ndarray:
    """For every window of the quote's length, the most that its ratio with the quote can be: from the characters they share."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    own = np.frombuffer(quote.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = len(quote)
    blank = np.append(0, np.cumsum([c.isspace() for c in text]))
    spaces = blank[size:] - blank[:-size]
    shared = np.minimum(spaces, sum(c.isspace() for c in quote))
    for code, many in zip(*np.unique(own, return_counts=True), strict=True):
        if not chr(code).isspace():
            seen = np.append(0, np.cumsum(codes == code))
            shared = shared + np.minimum(seen[size:] - seen[:-size], many)
    return 2.0 * shared / np.maximum(len(_blank(quote)) + size - spaces, 1)


def fuzzy_find(quote: str | None, text: str | None, least: float = 0.85) -> tuple[bool, int | None, float]:
    """(found, position, similarity) of the part of a text most like a quote; white space counts as one blank.

    An exact match wins. Else windows of the quote's length are compared, a tenth of it apart, and one by one up to a tenth
    before and after each that is alike enough; the first of the best in that order is taken. Only windows that share
    enough characters to matter are compared in full, so the answer is that of comparing all.
    """
    if not quote or not text:
        return False, None, 0.0
    exact = text.find(quote)
    if exact >= 0:
        return True, exact, 1.0
    size, wanted = len(quote), _blank(quote)
    if len(text) < size:
        return False, None, 0.0
    bounds, step = _likeness_bounds(quote, text) + 1e-9, max(1, size // 10)
    known: dict[int, float] = {}

    def like(start: int) -> float:
        if start not in known:
            known[start] = difflib.SequenceMatcher(None, wanted, _blank(text[start : start + size])).ratio()
        return known[start]

    places: dict[str, int] = {}
    for k, c in enumerate(wanted):
        places[c] = places.get(c, 0) | 1 << k
    whole = (1 << len(wanted)) - 1

    def in_order(start: int) -> float:
        """The most that a window's ratio can be, from the longest common subsequence: matching blocks are one."""
        window, row = _blank(text[start : start + size]), whole
        for c in window:
            met = row & places.get(c, 0)
            row = ((row + met) | (row - met)) & whole
        return 2.0 * (len(wanted) - row.bit_count()) / max(len(wanted) + len(window), 1) + 1e-9

    def best_of(starts: np.ndarray, best: float, first: tuple, order) -> tuple[float, tuple]:
        """The best of these windows and of what is known, the first in order of equal ones; the most promising are compared first."""
        heap = [(-float(bounds[start]), False, int(start)) for start in starts if bounds[start] >= best]
        heapq.heapify(heap)
        while heap and -heap[0][0] >= best:
            bound, exact, start = heapq.heappop(heap)
            if not exact:
                heapq.heappush(heap, (max(bound, -in_order(start)), True, start))
                continue
            score = like(start)
            if score > best or (score == best and order(start) < first):
                best, first = score, order(start)
        return best, first

    coarse = np.arange(0, len(bounds), step)
    best, first = best_of(coarse, 0.0, (len(coarse), -1, 0), lambda start: (start // step, -1, start))
    if best < least:
        return False, None, best
    for k in np.flatnonzero(bounds[coarse] >= least):
        if in_order(int(coarse[k])) >= least and like(int(coarse[k])) >= least:
            around = np.arange(max(coarse[k] - step, 0), min(len(bounds), coarse[k] + step))
            best, first = best_of(around, best, first, lambda start, k=int(k): (k, start, start))
    return True, first[2], best


def quote_matches(pairs: DataFrame, keys: list[str], quote: str, text: str, least: float = 0.85) -> DataFrame:
    """(*keys, found, position, similarity) of each pair of a quote and a text. No shuffle."""
    ship(pairs.sparkSession)
    result = T.StructType([T.StructField("found", T.BooleanType()), T.StructField("position", T.IntegerType()), T.StructField("similarity", T.DoubleType())])

    @F.pandas_udf(result)
    def match(quotes: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fuzzy_find(q, t, least) for q, t in zip(quotes, texts, strict=True)], columns=["found", "position", "similarity"]).astype({"position": "Int32"})

    return pairs.select(*keys, match(quote, text).alias("m")).select(*keys, "m.found", "m.position", F.round("m.similarity", 6).alias("similarity"))


def located_chunks(quotes: DataFrame, chunks: DataFrame, key: str, document: str, least: float = 0.85) -> DataFrame:
    """(key, chunk_id, exact): chunks on a quote's pages that hold it, exactly or nearly; all chunks there if none does.

    ``quotes`` has (key, document, pages, quote), ``chunks`` (document, page_number, chunk_id, text). Both meet on document
    and page; a quote without text takes the whole pages.
    """
    wanted = quotes.select(key, document, "quote", F.explode("pages").alias("page_number"))
    near = wanted.join(chunks.select(document, "page_number", "chunk_id", "text"), [document, "page_number"])
    judged = quote_matches(near, [key, "chunk_id"], "quote", "text", least)
    anywhere = F.max("found").over(Window.partitionBy(key))
    kept = judged.withColumn("_any", anywhere).where(F.col("found") | ~F.col("_any"))
    return kept.select(key, "chunk_id", (F.col("similarity") == 1).alias("exact")).distinct()


def neighbours(chunks: DataFrame, document: str, number: str, chunk_id: str, reach: int = 1, nearest: int | None = None, least_chunks: int = 1) -> DataFrame:
    """(chunk_id, neighbour_id): each chunk with those of its document at most ``reach`` away, itself included.

    With ``nearest`` only later ones from that distance on (pairs for questions over several places), in documents of at least
    ``least_chunks`` chunks.
    """
    steps = range(-reach, reach + 1) if nearest is None else range(-reach, -nearest + 1)
    if least_chunks > 1:
        enough = chunks.groupBy(document).agg(F.count("*").alias("_n")).where(F.col("_n") >= least_chunks).select(document)
        chunks = chunks.join(enough, document, "left_semi")
    shifted = chunks.select(document, number, F.col(chunk_id).alias("neighbour_id"), F.explode(F.array(*map(F.lit, steps))).alias("_shift"))
    other = shifted.select(document, (F.col(number) + F.col("_shift")).alias(number), "neighbour_id")
    return chunks.select(document, number, chunk_id).join(other, [document, number]).select(chunk_id, "neighbour_id")


#: Characters in a sample, in a fingerprint's window, and in a hashed run; samples under WINDOW characters don't count.
SAMPLE, WINDOW, RUN = 500, 50, 16


def _fingerprints(text: str) -> np.ndarray:
    """Distinct hashes such that every WINDOW characters of the text own at least one: the least of each window's runs."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    value = np.zeros(len(codes) - RUN + 1, dtype=np.uint64)
    for k in range(RUN):
        value = value * np.uint64(0x100000001B3) + codes[k : len(codes) - RUN + 1 + k]
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    windows = np.lib.stride_tricks.sliding_window_view(value, WINDOW - RUN + 1)
    return np.unique(windows.min(axis=1)).view(np.int64)


def contained_documents(documents: DataFrame, key: str, text: str, least: int = 100) -> DataFrame:
    """(inner, outer): pairs of classes of equal texts, the start, middle and end of the inner one standing in the outer one.

    White space is taken off first. Samples are at most SAMPLE characters; texts under ``least`` don't count as inner. The
    classes' members are in ``text_classes``. No pair of documents is compared without reason: each sample has fingerprints,
    one of which every text that holds the sample has too; the rarest of them finds the candidates, which are then compared
    exactly.
    """
    ship(documents.sparkSession)
    first = text_classes(documents, key, text).where("member = class").select(F.col("class").alias(key))
    bare = documents.select(key, text).join(first, key, "left_semi").dropDuplicates([key]).select(F.col(key).alias("id"), F.regexp_replace(text, r"\s+", "").alias("bare"))
    bare = cut(bare.where(F.length("bare") > 0))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for own, value in zip(batch["id"].to_pylist(), batch["bare"].to_pylist(), strict=True):
                found = _fingerprints(value)
                ids += [own] * len(found)
                hashes.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch["id"].type), pa.array(np.concatenate(hashes) if hashes else np.zeros(0, np.int64))], ["id", "h"])

    kind = dict(bare.dtypes)["id"]
    every = cut(spread(bare).mapInArrow(marks, f"id {kind}, h long"))
    n = F.length("bare")
    samples = bare.where(n >= least).select("id", n.alias("n"), F.posexplode(F.array(F.substring("bare", 1, SAMPLE), F.expr(f"substring(bare, cast(floor(length(bare) / 2) as int) + 1, {SAMPLE})"), F.expr(f"right(bare, {SAMPLE})"))).alias("k", "sample"))

    def sample_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(own, k, h) for own, k, s in zip(batch["id"].to_pylist(), batch["k"].to_pylist(), batch["sample"].to_pylist(), strict=True) for h in _fingerprints(s).tolist()]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch["id"].type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], ["id", "k", "h"])

    own_marks = samples.mapInArrow(sample_marks, f"id {kind}, k int, h long")
    frequency = every.groupBy("h").agg(F.count("*").alias("df"))
    rarest = own_marks.join(frequency, "h").groupBy("id", "k").agg(F.min_by("h", F.struct("df", "h")).alias("h"))
    met = rarest.join(every.withColumnRenamed("id", "outer"), "h").where("id <> outer").groupBy("id", "outer").agg(F.count("*").alias("hits")).where("hits = 3")
    texts = met.select("id", "outer").join(samples.groupBy("id").agg(F.max("n").alias("n"), F.collect_list("sample").alias("samples")), "id").join(bare.select(F.col("id").alias("outer"), F.col("bare").alias("whole")), "outer")
    held = texts.where((F.length("whole") > F.col("n")) | ((F.length("whole") == F.col("n")) & (F.col("id") < F.col("outer"))))
    return held.where(F.forall("samples", lambda s: F.col("whole").contains(s))).select(F.col("id").alias("inner"), "outer")


def text_classes(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(member, class): documents whose texts without white space are equal share a class, named by its least member.

    Only hashes are shuffled; a text that a third of all documents have is counted by partition first.
    """
    hashed = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("member"), F.sha2(F.regexp_replace(text, r"\s+", ""), 256).alias("_sha")).distinct()
    return hashed.join(hashed.groupBy("_sha").agg(F.min("member").alias("class")), "_sha").select("member", "class")


def primary_pool(documents: DataFrame, contained: DataFrame, key: str) -> DataFrame:
    """Documents that aren't contained in another one."""
    return documents.join(contained.select(F.col("inner").alias(key)).distinct(), key, "left_anti")
