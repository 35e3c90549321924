"""Token totals, proportional splits, descriptive statistics and stage profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.ordering import numbered

TOKEN_FIELDS = ("input_tokens", "output_tokens", "system_prompt_tokens", "contexts_tokens", "query_tokens")


def totals(records: DataFrame, record_id: str = "record_id") -> DataFrame:
    """Sums and calls by variant, by variant and category, and overall, in one pass; each record counts once.

    ``level`` is 0 for (variant, category), 1 for variant, 3 for the total. A null variant is ``__none__``.
    """
    once = records.select(record_id, F.coalesce("variant_name", F.lit("__none__")).alias("variant"), F.coalesce("category", F.lit("__none__")).alias("category"), *TOKEN_FIELDS).dropDuplicates([record_id])
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOKEN_FIELDS]
    return once.rollup("variant", "category").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("calls"), *sums)


def proportional_split(total: str, parts: list[str], last: str) -> list[Column]:
    """Estimated parts scaled to a total, rounded half to even; what remains goes to ``last`` and is never negative."""
    whole = sum((F.coalesce(F.col(p), F.lit(0)) for p in parts[1:]), F.coalesce(F.col(parts[0]), F.lit(0)))
    scaled = {p: F.when(whole > 0, F.bround(F.coalesce(F.col(p), F.lit(0)) * F.col(total) / whole, 0)).otherwise(0).cast("long") for p in parts if p != last}
    used = None
    for column in scaled.values():
        used = column if used is None else used + column
    rest = F.greatest(F.coalesce(F.col(total), F.lit(0)) - used, F.lit(0)).cast("long")
    return [c.alias(f"{p}_scaled") for p, c in scaled.items()] + [rest.alias(f"{last}_scaled")]


def describe(frame: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, population deviation, median, 95th percentile (nearest rank), least and greatest of each group, exactly.

    Ranks are running numbers over range partitions, so the values of a group never meet in one task.
    """
    valid = frame.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    sums = valid.groupBy(*by).agg(
        F.count("_v").alias("n"), F.round(F.avg("_v"), 4).alias("mean_value"), F.round(F.stddev_pop("_v"), 4).alias("std_value"),
        F.round(F.min("_v"), 4).alias("min_value"), F.round(F.max("_v"), 4).alias("max_value"),
    )
    sized = sums.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), "n")
    ranked = numbered(valid, ["_v"], "_rank", by)
    same = F.lit(True)
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    at = lambda rank: F.max(F.when(F.col("_rank") == rank, F.col("_v")))
    lower, upper, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2), F.ceil(F.col("n") * 0.95) - 1
    wanted = (F.col("_rank") == lower) | (F.col("_rank") == upper) | (F.col("_rank") == high)
    placed = ranked.join(sized, same).where(wanted).groupBy(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by))).agg(
        F.round((at(lower) + at(upper)) / 2, 4).alias("median_value"), F.round(at(high), 4).alias("p95_value")
    )
    return sums.join(placed, same).select(*by, "n", "mean_value", "std_value", "median_value", "p95_value", "min_value", "max_value")


def stage_profile(records: DataFrame, stage: str, seconds: str, units: int | None = None) -> DataFrame:
    """Time, calls, mean and peak of each stage, its share of the whole, which one is the bottleneck, and which deserve a look (over
    30 %); with ``units`` (pages or questions) also the time of each."""
    summed = records.groupBy(stage).agg(F.sum(seconds).alias("total"), F.count("*").alias("calls"), F.max(seconds).alias("peak"))
    whole = F.sum("total").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("total"), stage))
    each = [] if units is None else [F.round(F.col("total") / units, 6).alias("seconds_a_unit")]
    return summed.select(
        stage, F.round("total", 4).alias("total_seconds"), "calls", F.round(F.col("total") / F.col("calls"), 6).alias("mean_seconds"), F.round("peak", 4).alias("peak_seconds"),
        F.round(F.col("total") / whole, 6).alias("share"), (place == 1).alias("bottleneck"), (F.col("total") > 0.3 * whole).alias("suggested"), *each,
    )


def day_numbers(records: DataFrame, key: str, at: str, prefix: str) -> DataFrame:
    """Ids of the form prefix_yyyymmdd_nnn, numbered within each day by time, then key."""
    dated = numbered(records.select(key, at, F.to_date(at).alias("_day")), [at, key], "_n", ["_day"])
    return dated.select(key, F.format_string(f"{prefix}_%s_%03d", F.date_format(at, "yyyyMMdd"), F.col("_n") + 1).alias("day_id"))


def length_stats(documents: DataFrame, text: str, by: str, limit: int = 512) -> DataFrame:
    """Estimated tokens (a quarter of the characters, at least one) of each group: least, most, mean, and share over a limit."""
    tokens = F.greatest(F.lit(1), F.floor(F.length(text) / 4))
    return documents.where(F.col(text).isNotNull()).groupBy(by).agg(
        F.count("*").alias("n"), F.min(tokens).alias("least"), F.max(tokens).alias("most"), F.round(F.avg(tokens), 4).alias("mean_tokens"),
        F.round(F.avg((tokens > limit).cast("double")), 6).alias("share_over"),
    )
