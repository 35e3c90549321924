"""Chunks and segments: fixed windows, page-aware windows with cross-page overlap, semantic merging, segments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions import text as X
from folioforge.runtime import ship, spread


def _windows(tokens: Column, size: int, overlap: int) -> Column:
    """Array of (chunk_index, start_token, end_token, text) over a token array; none for an array without tokens."""
    n = F.size(tokens)
    count = 1 + F.ceil(F.greatest(F.lit(0), n - size) / F.lit(float(size - overlap))).cast("int")
    chunk = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda k: F.struct(
            k.alias("chunk_index"),
            (k * (size - overlap)).alias("start_token"),
            F.least(k * (size - overlap) + size, n).alias("end_token"),
            F.array_join(F.slice(tokens, k * (size - overlap) + 1, F.lit(size)), "").alias("text"),
        ),
    )
    return F.when(n > 0, chunk)


def _check(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the chunk size")


def fixed_chunks(documents: DataFrame, key: str, text: str, size: int = 512, overlap: int = 0) -> DataFrame:
    """Windows of ``size`` tokens, each starting ``overlap`` before the end of the last; blank texts have none.

    A chunk is a substring of its document, since the tokens cover it without gaps. No shuffle.
    """
    _check(size, overlap)
    tokens = documents.where(F.length(F.trim(text)) > 0).select(key, X.covering_tokens(F.col(text)).alias("tokens"))
    chunks = tokens.select(key, F.explode(_windows(F.col("tokens"), size, overlap)).alias("c")).select(key, "c.*")
    chunk_id = F.format_string("%s::chunk::%03d", F.col(key).cast("string"), "chunk_index")
    return chunks.select(chunk_id.alias("chunk_id"), "*", F.length("text").alias("char_count"), (F.col("end_token") - F.col("start_token")).alias("token_count"))


def page_chunks(pages: DataFrame, key: str, page: str, text: str, size: int = 512, overlap: int = 0, cross_page: int = 0) -> DataFrame:
    """Chunks of each page that isn't blank; with ``cross_page`` > 0 the last tokens of the page before are put in front.

    ``cross_page`` chunks start within that prefix and name the page it is from. The only shuffle is by document.
    """
    _check(size, overlap)
    filled = pages.where(F.length(F.regexp_replace(text, r"\s", "")) > 0).select(key, page, X.covering_tokens(F.col(text)).alias("own"))
    before = Window.partitionBy(key).orderBy(page)
    tail = F.lag(F.slice("own", F.greatest(F.size("own") - cross_page, F.lit(0)) + 1, F.lit(max(cross_page, 1)))).over(before)
    if cross_page:
        filled = filled.withColumn("tail", tail).withColumn("from_page", F.lag(page).over(before))
        prefix = F.when(F.col("tail").isNull(), F.array().cast("array<string>")).otherwise(F.concat(F.slice("tail", 1, F.size("tail") - 1), F.array(F.concat(F.element_at("tail", -1), F.lit("\n")))))
    else:
        filled, prefix = filled.withColumn("from_page", F.lit(None).cast("int")), F.array().cast("array<string>")
    joined = filled.withColumn("prefix", prefix).withColumn("tokens", F.concat("prefix", "own"))
    chunks = joined.select(key, page, "from_page", F.size("prefix").alias("n_prefix"), F.explode(_windows(F.col("tokens"), size, overlap)).alias("c"))
    crosses = F.col("c.start_token") < F.col("n_prefix")
    return chunks.select(
        F.format_string("%s_p%d_%03d", F.col(key).cast("string"), F.col(page), F.col("c.chunk_index")).alias("chunk_id"),
        key, page, "c.*", crosses.alias("cross_page"), F.when(crosses, F.col("from_page")).alias("overlap_from_page"),
    )


def pages_of(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page_number, text): parts of a text between blank lines, numbered from 1."""
    parts = documents.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n\n", -1)).alias("_k", "text"))
    return parts.select(key, (F.col("_k") + 1).alias("page_number"), "text")


def buffered_sentences(text: Column, least: int = 10) -> Column:
    """Trimmed sentences; one shorter than ``least`` characters is put before the next, a short last one after the one before."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))
    step = F.aggregate(
        F.transform(X.sentences(text), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")),
        start,
        lambda acc, x: F.when(
            F.length(F.concat(acc["held"], x)) < least, F.struct(acc["done"].alias("done"), F.concat(acc["held"], x).alias("held"))
        ).otherwise(F.struct(F.concat(acc["done"], F.array(F.concat(acc["held"], x))).alias("done"), F.lit("").alias("held"))),
    )
    tail = F.when(F.size(step["done"]) == 0, F.array(step["held"])).otherwise(
        F.concat(F.slice(step["done"], 1, F.size(step["done"]) - 1), F.array(F.concat(F.element_at(step["done"], -1), step["held"])))
    )
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when(step["held"] == "", step["done"]).otherwise(tail)


def semantic_chunks(documents: DataFrame, key: str, text: str, embed, size: int = 512, least: int = 100, threshold: float | None = 0.5, share: float | None = None) -> DataFrame:
    """Runs of sentences that stay on a topic: cut where the cosine of neighbours falls under a threshold or percentile.

    Runs beyond ``size`` tokens are cut into windows, runs under ``least`` tokens are added to the run before if both fit.
    ``embed`` maps a list of sentences to a matrix; each document is one row, so documents are independent tasks.
    """
    import numpy as np

    ship(documents.sparkSession)

    def chunk(sentences: list[str]) -> list[str]:
        if len(sentences) < 2:
            return list(sentences)
        matrix = np.asarray(embed(list(sentences)), dtype=float)
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = matrix / np.where(norm > 0, norm, 1)
        near = (matrix[:-1] * matrix[1:]).sum(axis=1)
        limit = np.quantile(near, share) if share is not None else threshold
        runs, own = [], [sentences[0]]
        for similarity, sentence in zip(near, sentences[1:], strict=True):
            if similarity < limit:
                runs.append("".join(own))
                own = []
            own.append(sentence)
        runs.append("".join(own))
        out: list[str] = []
        for run in runs:
            tokens = tokenise(run)
            if len(tokens) > size:
                out += ["".join(tokens[k : k + size]) for k in range(0, len(tokens), size)]
            elif out and len(tokens) < least and len(tokenise(out[-1])) + len(tokens) <= size:
                out[-1] += run
            else:
                out.append(run)
        return out

    import re

    def tokenise(run: str) -> list[str]:
        return re.findall(r"^\s+|\S+\s*", run)

    def buffered(parts: list[str], least_chars: int = 10) -> list[str]:
        done, held = [], ""
        for part in parts:
            held += part.strip()
            if len(held) >= least_chars:
                done.append(held)
                held = ""
        if held and done:
            done[-1] += held
        return done or ([held] if held else [])

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunks(column: pd.Series) -> pd.Series:
        return column.map(lambda x: chunk(buffered(list(x))))

    runs = spread(documents.where(F.length(F.trim(text)) > 0).select(key, text)).select(key, X.sentences(F.col(text)).alias("s")).where(F.size("s") > 0)
    return runs.select(key, F.posexplode(chunks("s")).alias("chunk_index", "text"))


def page_segments(pages: DataFrame, key: str, page: str, text: str, target: int = 8000) -> DataFrame:
    """Neighbouring pages put together until they reach ``target`` characters: (key, segment_index, pages, text, start_char).

    The greedy sum restarts after each segment, so it is folded over a document's pages within one row.
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    empty = "struct<done:array<struct<pages:array<int>,text:string,start:int>>,pages:array<int>,text:string,start:int>"
    start = F.from_json(F.lit('{"done":[],"pages":[],"text":"","start":0}'), empty)

    def add(acc: Column, x: Column) -> Column:
        body = F.when(F.size(acc["pages"]) == 0, x["t"]).otherwise(F.concat(acc["text"], F.lit("\n\n"), x["t"]))
        numbers = F.concat(acc["pages"], F.array(x["p"].cast("int")))
        full = F.struct(
            F.concat(acc["done"], F.array(F.struct(numbers.alias("pages"), body.alias("text"), acc["start"].alias("start")))).alias("done"),
            F.array().cast("array<int>").alias("pages"), F.lit("").alias("text"), (acc["start"] + F.length(body) + 2).alias("start"),
        )
        more = F.struct(acc["done"].alias("done"), numbers.alias("pages"), body.alias("text"), acc["start"].alias("start"))
        return F.when(F.length(body) >= target, full.cast(empty)).otherwise(more.cast(empty))

    def finish(acc: Column) -> Column:
        last = F.array(F.struct(acc["pages"].alias("pages"), acc["text"].alias("text"), acc["start"].alias("start")))
        return F.when(F.size(acc["pages"]) > 0, F.concat(acc["done"], last)).otherwise(acc["done"])

    folded = pages.groupBy(key).agg(F.aggregate(ordered, start, add, finish).alias("segments"))
    return folded.select(key, F.posexplode("segments").alias("segment_index", "s")).select(key, "segment_index", "s.pages", "s.text", F.col("s.start").alias("start_char"))


def document_segments(documents: DataFrame, key: str, text: str, target: int = 8000) -> DataFrame:
    """(key, segment_index, start_char, end_char): about ``target`` characters, ending at the last sentence mark in the second
    half, else the last blank there, else hard."""
    import re

    ship(documents.sparkSession)
    schema = T.ArrayType(T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())]))

    def cuts(body: str | None) -> list[tuple[int, int]]:
        out, start, body = [], 0, body or ""
        while start < len(body):
            end = min(start + target, len(body))
            if end < len(body):
                half = start + target // 2
                marks = [m.end() for m in re.finditer("[。！？.!?]", body[half:end])]
                blank = body.rfind(" ", half, end)
                end = half + marks[-1] if marks else blank + 1 if blank > 0 else end
            out.append((start, end))
            start = end
        return out

    @F.pandas_udf(schema)
    def segments(column: pd.Series) -> pd.Series:
        return column.map(cuts)

    return documents.select(key, F.posexplode(segments(text)).alias("segment_index", "s")).select(key, "segment_index", "s.*")
