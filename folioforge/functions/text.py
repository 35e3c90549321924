"""Text expressions: tokens, names, paths, numbers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces that cover a text without gaps; a slice of them is a substring of the text.
COVERING = r"^[ \t\n\x0B\f\r]+|[^ \t\n\x0B\f\r]+[ \t\n\x0B\f\r]*"
_EMPTY = "array()"


def covering_tokens(text: Column) -> Column:
    """Tokens that put together give the text again; a null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(COVERING), F.lit(0)), F.array().cast("array<string>"))


def search_terms(text: Column) -> Column:
    """Terms of lexical search: words longer than one character, and each pair of neighbouring Han characters.

    Case is kept. A null text has no terms.
    """
    words = F.regexp_extract_all(F.regexp_replace(text, r"\p{IsHan}", " "), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    pairs = F.regexp_extract_all(text, F.lit(r"(?=(\p{IsHan}{2}))"), F.lit(1))
    terms = F.concat(F.filter(words, lambda x: F.length(x) > 1), pairs)
    return F.coalesce(terms, F.array().cast("array<string>"))


def bigrams(text: Column) -> Column:
    """The set of character pairs of the lower-case text without white space; one character stands for itself.

    Characters beyond the basic plane are one character: no pair begins in the middle of them.
    """
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s", "")
    pairs = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(..))"), F.lit(1)))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).when(F.length(bare) == 1, F.array(bare)).otherwise(pairs)


def overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two sets; two empty sets are alike, one empty set has nothing in common."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def file_name(path: Column) -> Column:
    """Last part of a POSIX or Windows path."""
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def parent_stem(path: Column) -> Column:
    """``parent/stem``, or the stem alone where there is no parent."""
    parent = F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]+)/[^/]+$", 1)
    return F.when(parent == "", stem(path)).otherwise(F.concat_ws("/", parent, stem(path)))


def chunk_stem(chunk_id: Column) -> Column:
    """Document part of a chunk id, ``stem::chunk::007`` or ``stem_p3_007``; the whole id if it has no number."""
    marked = F.regexp_extract(chunk_id, r"^(.*)::chunk::\d+$", 1)
    plain = F.regexp_extract(chunk_id, r"^(.*)_\d+$", 1)
    return F.when(marked != "", marked).when(plain != "", plain).otherwise(chunk_id)


def chunk_number(chunk_id: Column) -> Column:
    """Number of a chunk id, -1 if it has none."""
    marked = F.regexp_extract(chunk_id, r"::chunk::(\d+)$", 1)
    plain = F.regexp_extract(chunk_id, r"_(\d+)$", 1)
    return F.when(marked != "", F.try_to_number(marked, F.lit("999999999")).cast("int")).when(plain != "", plain.try_cast("int")).otherwise(-1)


def safe_name(name: Column) -> Column:
    """Lower case, blanks and hyphens as underscores, letters, digits and underscores only."""
    return F.regexp_replace(F.translate(F.lower(name), " -", "__"), r"[^\p{L}\p{N}_]", "")


def preview(text: Column, size: int) -> Column:
    """The first ``size`` characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def category_of(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Category of the first pattern that the path contains, else ``unknown``."""
    chain = None
    for pattern, category in rules:
        chain = F.when(path.contains(pattern), category) if chain is None else chain.when(path.contains(pattern), category)
    return F.lit("unknown") if chain is None else chain.otherwise("unknown")


def numbers_with_unit(text: Column) -> Column:
    """Amounts as text with their unit: hundred millions, ten thousands, yuan, per cent, points, pieces."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?\s*(?:亿元|万元|亿|万|元|%|％|个百分点|个)"), F.lit(0)), F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Sentences with their marks, cut after 。！？；.!?; and without blank parts."""
    return F.filter(F.split(text, "(?<=[。！？；.!?;])"), lambda x: F.length(F.trim(x)) > 0)


def paragraphs(text: Column) -> Column:
    """Paragraphs: parted by blank lines or before headings, trimmed, none empty."""
    parts = F.transform(F.split(text, r"\n\s*\n|\n(?=#)"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def headings(text: Column) -> Column:
    """Trimmed lines that begin with #."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(lines, lambda x: x.startswith("#"))


def pdf_type(name: Column) -> Column:
    """Kind of report that a file name tells: annual, research or generic."""
    low = F.lower(name)
    return F.when(low.contains("年报") | low.contains("annual"), "annual").when(low.contains("研报") | low.contains("research"), "research").otherwise("generic")


def data_path(path: Column, folder: str) -> Column:
    """A path below ``data/`` moved to another folder; others stay."""
    return F.when(path.startswith("data/"), F.concat(F.lit(folder.rstrip("/") + "/"), F.substring(path, F.lit(6), F.length(path)))).otherwise(path)


def slug(text: Column, size: int = 40) -> Column:
    """Lower-case words joined by hyphens, at most ``size`` characters."""
    joined = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-")
    return F.substring(F.regexp_replace(joined, "^-+|-+$", ""), 1, size)


def pdf_name(name: Column) -> Column:
    """A file name that ends in .pdf."""
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))
