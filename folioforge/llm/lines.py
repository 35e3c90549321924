"""Lines repeated across one source's documents (problem 5)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.visual import visual, visual_form
from folioforge.runtime import cut, ship, spread

#: A line is repeated if it stands in at least so many documents of its source, and in at least this share of them.
LEAST_DOCUMENTS, LEAST_SHARE = 5, 0.2
_NUMBER = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")


def line_form(line: str) -> str | None:
    """The form in which two lines are compared; None for blank lines, headings and table rows.

    Visual form, without white space, then each run of digits as one 0.
    """
    form = _NUMBER.sub("0", _SPACE.sub("", visual_form(line)))
    return None if not form or form[0] in "#|" else form


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[str, bytes | None] = {}
        numbers, digests, offsets = [], [], [0]
        for content in batch["content"].to_pylist():
            for number, line in enumerate((content or "").split("\n"), 1):
                digest = known.get(line, b"")
                if digest == b"":
                    form = line_form(line)
                    digest = known[line] = None if form is None else xxhash.xxh3_128_digest(form)
                if digest is not None:
                    numbers.append(number)
                    digests.append(digest)
            offsets.append(len(numbers))
        # The 128 bits of a line's form as two numbers; no two forms share both.
        halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        fields = [pa.array(numbers, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())]
        lines = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, ["line_no", "hash", "check"]))
        yield pa.RecordBatch.from_arrays([batch["load_id"], batch["source"], lines], ["load_id", "source", "lines"])


def source_of(name: Column | str) -> Column:
    """What stands in a document's name before the first underscore, in its consistent visual form."""
    return F.substring_index(visual(name), "_", 1)


def hashed_lines(documents: DataFrame) -> DataFrame:
    """One row a document: source, line numbers and hashes of its countable lines; texts don't travel further."""
    ship(documents.sparkSession)
    named = spread(documents.select("load_id", "name", "content")).select("load_id", F.coalesce(source_of("name"), F.lit("")).alias("source"), "content")
    hashed = named.mapInArrow(_hashed, "load_id string, source string, lines array<struct<line_no:int,hash:long,check:long>>")
    return cut(hashed.dropDuplicates(["load_id"]))


def repeated_lines(documents: DataFrame) -> DataFrame:
    """(load_id, line_no, source, hash) of every occurrence of a line that is repeated within its source.

    Documents are counted once however often they hold a line, and sources by all their documents, those without content
    too. A null name makes up a source of its own; repeated rows of a document count once.
    """
    hashed = hashed_lines(documents)
    sizes = hashed.groupBy("source").agg(F.count("*").alias("documents"))
    forms = F.array_distinct(F.transform("lines", lambda x: F.struct(x["hash"], x["check"])))
    held = hashed.select("source", F.inline(forms).alias("hash", "check"))
    counts = held.groupBy("source", "hash", "check").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    frequent = counts.join(sizes, "source").where(F.col("n") >= LEAST_SHARE * F.col("documents")).select("source", "hash", "check")
    places = hashed.select("load_id", "source", F.inline("lines"))
    return places.join(frequent, ["source", "hash", "check"]).select("load_id", "line_no", "source", "hash")


def without_repeated_lines(documents: DataFrame) -> DataFrame:
    """Every document with ``cleaned``: its content without the repeated lines; null content stays null."""
    dropped = repeated_lines(documents).groupBy("load_id").agg(F.collect_set("line_no").alias("dropped"))
    kept = F.filter(F.split("content", "\n", -1), lambda line, k: ~F.array_contains("dropped", k + 1))
    return (
        documents.select("load_id", "name", "content")
        .dropDuplicates(["load_id"])
        .join(dropped, "load_id", "left")
        .select("load_id", "name", F.when(F.col("dropped").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")).alias("cleaned"))
    )
