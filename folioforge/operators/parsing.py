"""Page and table structure of Markdown text: table spans, degenerate tables, quality, headings, page metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = r"^\|.*\|$"
SEPARATOR = r"^\|[\s\-:]+\|[\s\-:\|]*$"


def lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) with lines counted from 1."""
    parts = documents.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("_k", "line"))
    return parts.select(key, (F.col("_k") + 1).alias("line_no"), "line")


def table_rows(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, line_no, row) of the rows of Markdown tables: neighbouring lines between bars, one being a separator.

    Blocks of neighbouring rows are islands: a row's line number less its count among the rows stays the same within one.
    """
    rows = lines(documents, key, text).select(key, "line_no", F.trim("line").alias("row")).where(F.col("row").rlike(ROW))
    island = F.col("line_no") - F.row_number().over(Window.partitionBy(key).orderBy("line_no"))
    marked = rows.withColumn("island", island).withColumn("has_separator", F.max(F.col("row").rlike(SEPARATOR)).over(Window.partitionBy(key, "island")))
    number = F.dense_rank().over(Window.partitionBy(key).orderBy("island"))
    return marked.where("has_separator").select(key, number.alias("table_no"), "line_no", "row")


def cells(row: Column) -> Column:
    """Trimmed cells of a table row."""
    return F.transform(F.split(F.regexp_replace(row, r"^\||\|$", ""), r"\|", -1), lambda x: F.trim(x))


def table_quality(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, n_rows, n_cols, data_rows, empty_ratio, merged_ratio): separators don't count as rows."""
    rows = table_rows(documents, key, text).where(~F.col("row").rlike(SEPARATOR)).withColumn("cells", cells(F.col("row")))
    empty = F.sum(F.size(F.filter("cells", lambda x: x == "")))
    merged = F.sum(F.size(F.filter("cells", lambda x: x.contains("<br>"))))
    total = F.sum(F.size("cells"))
    return rows.groupBy(key, "table_no").agg(
        F.count("*").alias("n_rows"), F.max(F.size("cells")).alias("n_cols"), (F.count("*") - 1).alias("data_rows"),
        F.round(empty / total, 6).alias("empty_ratio"), F.round(merged / total, 6).alias("merged_ratio"),
    )


def quality_reason(least_cols: int = 3, most_empty: float = 0.5, least_rows: int = 2) -> Column:
    """First failing reason of a table, or ``kept``."""
    return (
        F.when(F.col("n_cols") < least_cols, "cols_too_few").when(F.col("empty_ratio") > most_empty, "too_many_empty_cells")
        .when(F.col("data_rows") < least_rows, "data_rows_too_few").otherwise("kept")
    )


def better_table(old: str = "old", new: str = "new") -> Column:
    """Whether the new table of a pair is taken: if only one of them has merged cells, the other one; else the one with clearly
    fewer empty cells; else, if both have data rows, the one with clearly more of the greater number; else the new one."""
    a, b = (lambda c: F.col(f"{old}_{c}")), (lambda c: F.col(f"{new}_{c}"))
    most = F.greatest(a("data_rows"), b("data_rows"))
    return (
        F.when((a("merged_ratio") > 0) != (b("merged_ratio") > 0), b("merged_ratio") == 0)
        .when(F.abs(a("empty_ratio") - b("empty_ratio")) > 0.15, b("empty_ratio") < a("empty_ratio"))
        .when((F.least(a("data_rows"), b("data_rows")) > 0) & (F.abs(b("data_rows") - a("data_rows")) > 0.3 * most), b("data_rows") == most)
        .otherwise(True)
    )


def without_degenerate_tables(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cleaned): blocks of bar rows dropped if every cell of every row is empty or of dashes and colons only.

    Done within a row by folding over its lines: nothing is shuffled.
    """
    split = F.split(text, "\n", -1)
    is_row = lambda x: F.trim(x).rlike(ROW)
    blank = lambda x: F.forall(cells(F.trim(x)), lambda c: c.rlike(r"^[-:\s]*$"))
    kind = "struct<done:array<string>,held:array<string>,bare:boolean>"
    empty = F.from_json(F.lit('{"done":[],"held":[],"bare":true}'), kind)

    def flushed(acc: Column) -> Column:
        return F.when(acc["bare"], acc["done"]).otherwise(F.concat(acc["done"], acc["held"]))

    def add(acc: Column, x: Column) -> Column:
        row = F.struct(acc["done"].alias("done"), F.concat(acc["held"], F.array(x)).alias("held"), (acc["bare"] & blank(x)).alias("bare"))
        other = F.struct(F.concat(flushed(acc), F.array(x)).alias("done"), F.array().cast("array<string>").alias("held"), F.lit(True).alias("bare"))
        return F.when(is_row(x), row.cast(kind)).otherwise(other.cast(kind))

    return documents.select(key, F.when(F.col(text).isNotNull(), F.array_join(F.aggregate(split, empty, add, flushed), "\n")).alias("cleaned"))


def page_metrics(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_chars, n_words, n_headings, n_table_rows, valid): valid pages hold something besides white space."""
    split = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return documents.select(
        key,
        F.length(F.coalesce(text, F.lit(""))).alias("n_chars"),
        F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))).alias("n_words"),
        F.size(F.filter(split, lambda x: x.rlike("^#[ #]"))).alias("n_headings"),
        F.size(F.filter(split, lambda x: F.trim(x).rlike(ROW))).alias("n_table_rows"),
        (trimmed != "").alias("valid"),
    )


def markdown_records(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table_no, line_no, record): rows of tables as maps from header to cell."""
    rows = table_rows(documents, key, text).where(~F.col("row").rlike(SEPARATOR)).withColumn("cells", cells(F.col("row")))
    header = F.first("cells").over(Window.partitionBy(key, "table_no").orderBy("line_no"))
    number = F.row_number().over(Window.partitionBy(key, "table_no").orderBy("line_no"))
    tabled = rows.withColumn("header", header).withColumn("_k", number).where("_k > 1")
    entries = F.arrays_zip(F.col("header"), F.slice("cells", F.lit(1), F.size("header")))
    return tabled.select(key, "table_no", "line_no", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["header"], e["1"])), "; ").alias("record"))


def compared_pipelines(documents: DataFrame, by: str) -> DataFrame:
    """(by, pdfs_tested, totals, means): measures of parsed documents by the pipeline that parsed them; means to three places."""
    totals = [F.sum(c).alias(f"total_{c}") for c in ("tables", "chars", "words", "headings")]
    means = [F.round(F.avg(c), 3).alias(f"avg_{c}") for c in ("parse_seconds", "empty_ratio", "valid_ratio")]
    return documents.groupBy(by).agg(F.count("*").alias("pdfs_tested"), *totals, *means)
