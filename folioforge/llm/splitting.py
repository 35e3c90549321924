"""Cutting oversized texts at natural boundaries, with overlap (problem 3).

Lexical cohesion: the similarity of the terms (words, pairs of wide characters) in the blocks before and after each line and
sentence end is low where the topic changes. Within the window in which a piece may end, the deepest valley of that curve is taken; where there is no
sentence end, the last word end; where there is none, the cut is forced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.ordering import numbered
from folioforge.runtime import ship, spread

#: Units on either side of a boundary that are compared.
BLOCK = 8
#: A piece is filled to at least this share of its size before a valley may end it.
LEAST_FILL = 0.5
_UNIT_END = re.compile(r"[.!?;](?=\s)\s*|[。！？；]+[”’」』）)]*\s*|\s*\n\s*")
_SPACE = re.compile(r"\s")
_BREAK = re.compile(r"[\s.!?;。！？；]")


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """(lower, wide): each code point's lower-case letter, 0 for other characters; and whether it is Han or kana."""
    lower = np.zeros(0x110000, dtype=np.uint64)
    for code in range(0x10000):
        if chr(code).isalpha():
            low = chr(code).lower()
            lower[code] = ord(low) if len(low) == 1 else code
    wide = np.zeros(0x110000, dtype=bool)
    for low, high in ((0x3041, 0x3097), (0x30A1, 0x30FB), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x32000)):
        wide[low:high] = True
    return lower, wide


def _terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the terms of a text: its words but single letters, and its pairs of Han characters or kana."""
    lower, wide = _letters()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter, is_wide = lower[codes], wide[codes]
    narrow = (letter > 0) & ~is_wide
    first = np.flatnonzero(narrow & ~np.append(False, narrow[:-1]))
    hashes = np.zeros(0, dtype=np.uint64)
    if len(first):
        inside = np.flatnonzero(narrow)
        begin = np.searchsorted(inside, first)
        length = np.diff(np.append(begin, len(inside)))
        place = np.arange(len(inside)) - np.repeat(begin, length)
        power = np.uint64(0x9E3779B97F4A7C15) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1))
        hashes = np.add.reduceat(letter[inside] * power ^ (power >> np.uint64(7)), begin)
        first, hashes = first[length > 1], hashes[length > 1]
    both = np.flatnonzero(is_wide[:-1] & is_wide[1:])
    pairs = (codes[both].astype(np.uint64) << np.uint64(32)) | codes[both + 1]
    return np.concatenate([first, both]), np.concatenate([hashes, pairs])


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, depths) of line and sentence ends: how deep the valley of cohesion is there, between 0 and 2.

    Cohesion is the cosine of the terms of the BLOCK units before and after. A term of one unit says nothing, one that returns
    says more, one of nearly all units less again. The depth of a place is how far the curve climbs on its left plus how far
    on its right.
    """
    places = np.array([m.end() for m in _UNIT_END.finditer(text) if 0 < m.end() < len(text)], dtype=np.int64)
    if len(places) < 2:
        return places, np.zeros(len(places))
    at, hashes = _terms(text)
    units = len(places) + 1
    # One number for each unit and term: 40 bits of the term's hash, then the unit; sorted, so that a term's units follow each other.
    entry = np.sort((hashes * np.uint64(0x9E3779B97F4A7C15) & ~np.uint64(0xFFFFFF)) | np.searchsorted(places, at, side="right").astype(np.uint64))
    entry = entry[np.append(True, entry[1:] != entry[:-1])] if len(entry) else entry
    of_term, of_unit = entry >> np.uint64(24), (entry & np.uint64(0xFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.append(True, of_term[1:] != of_term[:-1])) if len(entry) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(entry)))
    again = np.repeat(size > 1, size)
    of_term, of_unit, spread_over = of_term[again], of_unit[again], np.repeat(size, size)[again]
    weight = np.log(1 + spread_over) * (1 - spread_over / (2 * units))
    # product[d][u]: that of unit u and unit u + d.
    reach = 2 * BLOCK
    wide = units + reach
    slots, masses = [of_unit], [weight * weight]
    for step in range(1, min(reach, len(of_term))):
        apart = of_unit[step:] - of_unit[:-step]
        near = np.flatnonzero((of_term[step:] == of_term[:-step]) & (apart < reach))
        if not len(near):
            break
        slots.append(apart[near] * wide + of_unit[near])
        masses.append(weight[near + step] * weight[near])
    product = np.bincount(np.concatenate(slots), weights=np.concatenate(masses), minlength=reach * wide).reshape(reach, wide)
    # sums[d][k]: the products of units u and u + d for u below k - BLOCK, so that sums over a range of u are differences.
    sums = np.zeros((reach, units + 3 * BLOCK + reach))
    np.cumsum(product, axis=1, out=sums[:, BLOCK + 1 : BLOCK + 1 + units + reach])
    sums[:, BLOCK + 1 + units + reach :] = sums[:, [BLOCK + units + reach]]
    at = np.arange(1, len(places) + 1) + BLOCK

    def over(apart: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return sums[apart, high] - sums[apart, low]

    across = sum(over(d, at - min(BLOCK, d), at - max(d - BLOCK, 0)) for d in range(1, reach))
    before, after = (sum((1 if d == 0 else 2) * over(d, at + shift, at + shift + BLOCK - d) for d in range(BLOCK)) for shift in (-BLOCK, 0))
    norm = np.sqrt(before * after)
    curve = across / np.where(norm > 0, norm, 1)
    return places, _climb(curve) + _climb(curve[::-1])[::-1] - 2 * curve


def _climb(curve: np.ndarray) -> np.ndarray:
    """The height reached by going left from each place as long as the curve doesn't fall."""
    top = curve.copy()
    for k in range(1, len(curve)):
        if curve[k - 1] >= curve[k]:
            top[k] = top[k - 1]
    return top


def longest_run(text: str) -> int:
    """Length of the longest run without white space and without a sentence mark."""
    ends = [m.start() for m in _BREAK.finditer(text)]
    return int(np.diff([-1, *ends, len(text)]).max()) - 1


def split(text: str, max_size: int, overlap: int, places: np.ndarray, depths: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut) of the pieces; each is at most max_size long and starts ``overlap`` before the last end."""
    if not 0 <= overlap < max_size:
        raise ValueError("overlap must be at least 0 and less than max_size")
    pieces, start = [], 0
    while len(text) - start > max_size:
        least, most = start + overlap + 1, start + max_size
        low = np.searchsorted(places, max(least, start + int(max_size * LEAST_FILL)))
        high = np.searchsorted(places, most, side="right")
        if low == high:
            low = np.searchsorted(places, least)
        if low < high:
            end = int(places[low + int(np.argmax(depths[low:high]))])
            kind = "line" if "\n" in text[max(end - 3, 0) : end] else "sentence"
        else:
            end = next((k for k in range(most, least - 1, -1) if text[k - 1].isspace()), 0)
            kind = "word" if end else "forced"
            end = end or _whole_character(text, least, most)
        pieces.append((start, end, kind))
        start = end - overlap
    return [*pieces, (start, len(text), "end")]


def _whole_character(text: str, least: int, most: int) -> int:
    """The last place that doesn't part a combining mark or joiner from what it belongs to."""
    import unicodedata

    for end in range(most, max(least, most - 16) - 1, -1):
        if unicodedata.category(text[end]) not in ("Mn", "Me", "Cf") and text[end - 1] != "‍":
            return end
    return most


def split_corpus(documents: DataFrame, profiles: list[tuple[str, int, int]], with_text: bool = True) -> DataFrame:
    """(load_id, profile, piece_no, pieces, start, length, cut, longest_run[, text]) for every content and profile.

    Lengths are in characters as stored. A content within the limit is one piece, a null content has none, an empty one has
    one empty piece. A map over the scan; repeated rows of a document give repeated rows.
    """
    ship(documents.sparkSession)
    fields = [
        ("load_id", pa.string()), ("profile", pa.string()), ("piece_no", pa.int32()), ("pieces", pa.int32()), ("start", pa.int32()),
        ("length", pa.int32()), ("cut", pa.string()), ("longest_run", pa.int32()), *([("text", pa.string())] if with_text else []),
    ]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for load_id, text in zip(batch["load_id"].to_pylist(), batch["content"].to_pylist(), strict=True):
                if text is None:
                    continue
                fits = all(len(text) <= size for _, size, _ in profiles)
                places, depths = (None, None) if fits else boundaries(text)
                longest = longest_run(text)
                for profile, size, overlap in profiles:
                    pieces = [(0, len(text), "end")] if len(text) <= size else split(text, size, overlap, places, depths)
                    rows += [
                        (load_id, profile, k, len(pieces), start, end - start, kind, longest, *([text[start:end]] if with_text else []))
                        for k, (start, end, kind) in enumerate(pieces)
                    ]
                if len(rows) > 20_000:
                    yield _batch(rows, schema)
                    rows = []
            if rows:
                yield _batch(rows, schema)

    ddl = "load_id string, profile string, piece_no int, pieces int, start int, length int, cut string, longest_run int" + (", text string" if with_text else "")
    return spread(documents.select("load_id", "content")).mapInArrow(run, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def oversized(documents: DataFrame, profiles: list[tuple[str, int, int]]) -> DataFrame:
    """(load_id, profile, forced) of each content that had to be cut; forced if a run without any boundary exceeds the limit."""
    limits = F.create_map(*(F.lit(x) for name, size, _ in profiles for x in (name, size)))
    pieces = split_corpus(documents, profiles, with_text=False).where("piece_no = 0 and pieces > 1")
    return pieces.select("load_id", "profile", (F.col("longest_run") > limits[F.col("profile")]).cast("int").alias("forced")).distinct()


def seam_recall(documents: DataFrame, key: str, text: str, by: str, reach: int = 300, least: int = 600) -> DataFrame:
    """(by, pairs, found, by_chance): how often the deepest valley within ``reach`` characters of a planted seam is the seam.

    Documents of at least ``least`` characters are put together two by two within a group, by a hash of their key; the seam
    is where the second begins. ``by_chance`` is what a place chosen blindly would find.
    """
    ship(documents.sparkSession)
    long = documents.where((F.length(text) >= least) & F.col(by).isNotNull()).select(F.col(key).alias("_key"), F.col(by).alias("_by")).distinct()
    placed = numbered(long.withColumn("_hash", F.xxhash64("_key")), ["_hash", "_key"], "_n", ["_by"]).select("_key", "_by", F.floor(F.col("_n") / 2).alias("_pair"), (F.col("_n") % 2).alias("_side"))
    texts = placed.join(documents.select(F.col(key).alias("_key"), F.rtrim(text).alias("_text")).dropDuplicates(["_key"]), "_key")
    sides = [texts.where(F.col("_side") == k).select("_by", "_pair", F.col("_text").alias(name)) for k, name in enumerate(("first", "second"))]
    pairs = sides[0].join(sides[1], ["_by", "_pair"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, chance = [], []
            for first, second in zip(batch["first"].to_pylist(), batch["second"].to_pylist(), strict=True):
                seam = len(first) + 1
                places, depths = boundaries(f"{first}\n{second}")
                near = np.flatnonzero(np.abs(places - seam) <= reach)
                found.append(bool(len(near)) and int(places[near[np.argmax(depths[near])]]) == seam)
                chance.append(1 / max(len(near), 1))
            yield pa.RecordBatch.from_arrays([batch["_by"], pa.array(found, pa.bool_()), pa.array(chance, pa.float64())], ["group", "found", "chance"])

    rated = pairs.select("_by", "first", "second").mapInArrow(run, f"group {dict(pairs.dtypes)['_by']}, found boolean, chance double")
    return rated.groupBy(F.col("group").alias(by)).agg(F.count("*").alias("pairs"), F.count_if("found").alias("found"), F.round(F.avg("chance"), 4).alias("by_chance"))
