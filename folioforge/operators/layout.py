"""From positioned text blocks of a page to Markdown: noise, columns, reading order, headings, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Texts that are noise wherever they stand.
NOISE = (
    r"请务必阅读.{0,20}声明",
    r"^\s*\d+\s*$",
    r"^\s*\d+\s*/\s*\d+\s*$",
    r"(?:内部资料|机密|仅供参考).{0,30}$",
    r"^(?:www\.|http).+$",
)
# Font sizes above which bold text is a heading, from the first level down.
HEADING_SIZES = (16, 14, 12, 11)
#: Share of the page height of header and footer, and the length from which a text there is kept.
ZONE, ZONE_TEXT = 0.1, 80
#: Longest heading of the last level.
LAST_HEADING = 100


def is_noise(text: Column, top: Column, bottom: Column, height: Column) -> Column:
    """Short texts in the header or footer, and texts that match a pattern of noise."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    short = F.length(bare) < ZONE_TEXT
    zone = (top < height * ZONE) | (bottom > height * (1 - ZONE))
    pattern = F.lit(False)
    for p in NOISE:
        pattern = pattern | bare.rlike(p)
    return (zone & short) | pattern


def with_columns(blocks: DataFrame, page: list[str], left: str = "x0", right: str = "x1", width: str = "page_width") -> DataFrame:
    """Add n_columns: 2 where both halves hold more than two block centres and neither is much emptier."""
    by = Window.partitionBy(*page)
    first = F.count_if((F.col(left) + F.col(right)) / 2 < F.col(width) * 0.5).over(by)
    second = F.count("*").over(by) - first
    two = (first > 2) & (second > 2) & (F.least(first, second) / F.greatest(first, second) > 0.3)
    return blocks.withColumn("n_columns", F.when(two, 2).otherwise(1))


def heading(size: Column, bold: Column, text: Column) -> Column:
    """Markdown mark of a heading, empty for body text."""
    h1, h2, h3, h4 = HEADING_SIZES
    return F.when(~bold, "").when(size > h1, "# ").when(size > h2, "## ").when(size > h3, "### ").when((size > h4) & (F.length(text) < LAST_HEADING), "#### ").otherwise("")


def page_markdown(blocks: DataFrame, page: list[str]) -> DataFrame:
    """(*page, text) from blocks (x0, y0, x1, y1, text, font_size, is_bold, page_width, page_height) in reading order."""
    kept = with_columns(blocks.where(~is_noise(F.col("text"), F.col("y0"), F.col("y1"), F.col("page_height"))), page)
    side = F.when((F.col("n_columns") == 2) & (F.col("x0") >= F.col("page_width") / 2), 1).otherwise(0)
    block = F.struct(side.alias("side"), F.col("y0"), F.col("x0"), F.concat(heading(F.col("font_size"), F.coalesce("is_bold", F.lit(False)), F.col("text")), F.col("text")).alias("t"))
    return kept.groupBy(*page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(block)), lambda b: b["t"]), "\n\n").alias("text"))


def cells_markdown(table: Column) -> Column:
    """Markdown of a two-dimensional array of cells: nulls empty, line ends blank, rows padded, empty rows dropped.

    From four columns on, rows filled to half or less are dropped too. An array without rows gives an empty text.
    """
    width = F.array_max(F.transform(table, lambda r: F.size(r)))
    clean = F.transform(table, lambda r: F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), lambda k: F.trim(F.regexp_replace(F.coalesce(F.get(r, k), F.lit("")), r"\s*\n\s*", " "))))
    filled = lambda r: F.size(F.filter(r, lambda c: c != ""))
    rows = F.filter(clean, lambda r: (filled(r) > 0) & ((width < 4) | (filled(r) * 2 > width)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1))), line)
    return F.when(F.coalesce(F.size(rows), F.lit(0)) < 1, "").otherwise(F.array_join(F.concat(F.array(line(F.get(rows, 0)), rule), body), "\n"))


def replaced_tables(lines: DataFrame, old: DataFrame, new: DataFrame, page: str, policy: str = "better_wins") -> DataFrame:
    """(page, text): tables of a page replaced by those of another parser, table by table; tables beyond the old ones follow.

    ``lines`` has (page, line_no, line); ``old`` (page, table_no, first_line, last_line, data_rows, empty_ratio, merged_ratio);
    ``new`` (page, table_no, text, data_rows, empty_ratio, merged_ratio). Policies: better_wins, always_replace, never_replace.
    """
    from folioforge.operators.parsing import better_table

    if policy not in ("better_wins", "always_replace", "never_replace"):
        raise ValueError(f"unknown policy {policy}")
    measures = ("data_rows", "empty_ratio", "merged_ratio")
    a = old.select(page, "table_no", "first_line", "last_line", *(F.col(m).alias(f"old_{m}") for m in measures))
    b = new.select(page, "table_no", F.col("text").alias("new_text"), *(F.col(m).alias(f"new_{m}") for m in measures))
    both = a.join(b, [page, "table_no"], "full")
    wins = better_table() if policy == "better_wins" else F.lit(policy == "always_replace")
    taken = both.where(F.col("new_text").isNotNull() & F.col("first_line").isNotNull() & wins)
    extra = both.where(F.col("first_line").isNull() & F.lit(policy != "never_replace"))
    gone = taken.select(F.col(page).alias("_p"), "first_line", "last_line")
    kept = lines.join(gone, (F.col(page) == F.col("_p")) & F.col("line_no").between(F.col("first_line"), F.col("last_line")), "left_anti")
    parts = (
        kept.select(page, F.col("line_no").cast("double").alias("at"), F.col("line").alias("t"))
        .unionByName(taken.select(page, F.col("first_line").cast("double").alias("at"), F.col("new_text").alias("t")))
        .unionByName(extra.select(page, (F.lit(1e12) + F.col("table_no")).alias("at"), F.concat(F.lit("\n"), "new_text").alias("t")))
    )
    return parts.groupBy(page).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "\n").alias("text"))
