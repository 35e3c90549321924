"""Seams for models: rewriting, embedding, generation and judging, with offline stand-ins and retries."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.runtime import ship

#: Status codes worth another try.
RETRIED = (429, 503, 529)


def with_retry(call: Callable, tries: int = 5, base: float = 1.0, cap: float = 60.0, sleep: Callable = time.sleep):
    """Result of a call that is repeated after overload errors, waiting min(base * 2**n, cap) and up to a tenth more."""
    for attempt in range(tries):
        try:
            return call()
        except Exception as error:  # noqa: BLE001
            status = getattr(error, "status_code", None)
            retried = status in RETRIED or any(str(code) in str(error) for code in RETRIED) or "rate limit" in str(error).lower()
            if attempt == tries - 1 or not retried:
                raise
            sleep(min(base * 2**attempt, cap) * (1 + random.random() / 10))


def map_model(frame: DataFrame, inputs: list[str], load: Callable[[], Callable[[pd.DataFrame], list]], output: str, kind: str) -> DataFrame:
    """Add the output of a model: ``load`` runs once a task and gives a function from a batch to a list.

    A row whose call fails has a null output and its error in ``<output>_error``; the others go on. A batch is tried as a whole
    first, and row by row only where that fails.
    """
    ship(frame.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema) + f", `{output}` {kind}, `{output}_error` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, broken = None, None
        try:
            model = load()
        except Exception as error:  # noqa: BLE001
            broken = f"{type(error).__name__}: {error}"

        def tried(rows: pd.DataFrame) -> tuple[list, list]:
            try:
                return list(with_retry(lambda: model(rows[inputs]))), [None] * len(rows)
            except Exception as error:  # noqa: BLE001
                if len(rows) == 1:
                    return [None], [f"{type(error).__name__}: {error}"]
                parts = [tried(rows.iloc[[k]]) for k in range(len(rows))]
                return [x for part, _ in parts for x in part], [x for _, part in parts for x in part]

        for batch in batches:
            values, errors = ([None] * len(batch), [broken] * len(batch)) if broken else tried(batch)
            yield batch.assign(**{output: pd.Series(values, index=batch.index, dtype=object), f"{output}_error": errors})

    return frame.mapInPandas(run, schema)


def clean_sub_query(text: Column) -> Column:
    """A rewritten query without numbering in front."""
    return F.trim(F.regexp_replace(text, r"^[0-9.\-) ]+", ""))


def sub_queries(rewritten: DataFrame, query_key: str, answer: str, most: int = 3) -> DataFrame:
    """(query_key, sub_no, query): lines of a rewriting answer, cleaned, blank ones dropped, at most ``most``."""
    lines = F.filter(F.transform(F.split(answer, "\n"), clean_sub_query), lambda x: x != "")
    return rewritten.select(query_key, F.posexplode(F.slice(lines, 1, most)).alias("sub_no", "query"))


def extractive_answer(question: Column, contexts: Column) -> Column:
    """Offline stand-in for a generator: the sentence of the contexts that shares most character pairs with the question."""
    pool = F.flatten(F.transform(contexts, T.sentences))
    rated = F.transform(pool, lambda s, k: F.struct(T.overlap(T.bigrams(s), T.bigrams(question)).alias("score"), (-k).alias("k"), s.alias("s")))
    return F.array_max(rated)["s"]


def first_json(text: Column, schema: str) -> Column:
    """The first {...} block of a model's answer, fenced or not, parsed; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def relevancy(answer: Column) -> Column:
    """Score of a judge's JSON answer: the overall score, else the mean of three parts out of five with 3 for a missing one."""
    parsed = first_json(answer, "overall_score double, directness double, specificity double, completeness double")
    parts = sum((F.coalesce(parsed[c], F.lit(3.0)) for c in ("specificity", "completeness")), F.coalesce(parsed["directness"], F.lit(3.0)))
    return F.when(parsed.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(parsed["overall_score"], parts / 15.0))))


def supported_share(verdicts: Column) -> Column:
    """Share of statements a judge calls supported; 0 without statements."""
    return F.when(F.size(verdicts) == 0, 0.0).otherwise(F.size(F.filter(verdicts, lambda v: v == 1)) / F.greatest(F.size(verdicts), F.lit(1)))
