"""Answer metrics and aggregates over variants, question types and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T

#: Metrics for which less is better.
LOWER_IS_BETTER = ("false_positive_rate", "hallucination_rate", "time_seconds")


def once(frame: DataFrame, key: str) -> DataFrame:
    """Repeated rows of a record reduced to one."""
    return frame.dropDuplicates([key])


def long_metrics(results: DataFrame, keys: list[str], maps: list[str]) -> DataFrame:
    """(*keys, family, metric, value) from columns of metric maps; null values stay as not applicable."""
    parts = None
    for name in maps:
        part = results.select(*keys, F.lit(name).alias("family"), F.explode(name).alias("metric", "value"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def means(long: DataFrame, by: list[str]) -> DataFrame:
    """Mean and count of each metric over the rows where it applies."""
    return long.groupBy(*by, "family", "metric").agg(F.round(F.avg("value"), 9).alias("mean_value"), F.count("value").alias("n_values"))


def means_with_totals(long: DataFrame, outer: str, inner: str) -> DataFrame:
    """Means by (outer), and by (outer, inner), in one pass; ``level`` is 0 for the finer rows, 1 for the totals."""
    grouped = long.groupingSets([[F.col(outer), F.col(inner), F.col("metric")], [F.col(outer), F.col("metric")]], F.col(outer), F.col(inner), F.col("metric"))
    return grouped.agg(F.round(F.avg("value"), 9).alias("mean_value"), F.count("value").alias("n_values"), F.grouping(inner).cast("int").alias("level"))


def means_missing_as_zero(results: DataFrame, by: list[str], column: str, metric: str) -> DataFrame:
    """Mean of one metric per group, rows without it counting as 0."""
    return results.groupBy(*by).agg(F.round(F.avg(F.coalesce(F.try_element_at(F.col(column), F.lit(metric)), F.lit(0.0))), 9).alias("mean_value"), F.count("*").alias("n_rows"))


def best(long_means: DataFrame) -> DataFrame:
    """The best variant of each metric: highest mean, lowest for LOWER_IS_BETTER; ties go to the first name."""
    sign = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("mean_value")).otherwise(-F.col("mean_value"))
    order = Window.partitionBy("family", "metric").orderBy(sign, "variant")
    ranked = long_means.where("mean_value is not null").withColumn("place", F.row_number().over(order))
    return ranked.where("place = 1").drop("place")


def win_counts(winners: DataFrame) -> DataFrame:
    """How many metrics each variant wins."""
    return winners.groupBy("variant").agg(F.count("*").alias("wins"))


def share_below(value: Column, limit: float) -> Column:
    """Share of the non-null values under a limit; null if there are none."""
    return F.round(F.try_divide(F.count_if(value < limit), F.count(value)), 6)


def context_precision(relevant: Column) -> Column:
    """Mean over the relevant places k of the share of relevant ones among the first k; 0 without a relevant one."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(relevant), F.lit(1))), lambda k: F.coalesce(F.get(relevant, k - 1), F.lit(False)))
    total = F.aggregate(F.transform(places, lambda k, i: (i + 1.0) / k), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(places) == 0, 0.0).otherwise(total / F.greatest(F.size(places), F.lit(1)))


def answer_scores(pairs: DataFrame, key: str, question: str, answer: str, truth: str, contexts: str) -> DataFrame:
    """Lexical scores of an answer: overlap with question and truth, of the contexts with the question, and context precision.

    A context is relevant if it shares a tenth of its character pairs with the true answer. Null texts count as empty.
    """
    held = F.coalesce(F.col(contexts), F.array().cast("array<string>"))
    sets = pairs.select(
        key, *(T.bigrams(F.col(c)).alias(name) for c, name in ((question, "_q"), (answer, "_a"), (truth, "_t"))), T.bigrams(F.array_join(held, "")).alias("_joined"), F.transform(held, T.bigrams).alias("_contexts")
    )
    # The sets are columns of their own, so that each is built once a row.
    rated = sets.withColumn("_relevant", F.transform("_contexts", lambda c: T.overlap(c, F.col("_t")) >= 0.1))
    return rated.select(
        key,
        F.round(T.overlap(F.col("_a"), F.col("_q")), 6).alias("answer_relevancy"),
        F.round(T.overlap(F.col("_a"), F.col("_t")), 6).alias("answer_truth_overlap"),
        F.round(T.overlap(F.col("_joined"), F.col("_q")), 6).alias("context_relevance"),
        F.round(context_precision(F.col("_relevant")), 6).alias("context_precision"),
    )


def split_for_recall(text: Column) -> Column:
    """Units of a true answer: the lines of a table but separators, else its sentences."""
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    rows = F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: (x != "") & ~x.rlike(r"^\|[\s\-:|]+\|$"))
    plain = F.filter(F.transform(F.split(text, "[。！？.!?]"), trimmed), lambda x: x != "")
    return F.when(text.rlike(r"\|\s*:?-{2,}"), rows).otherwise(plain)


def context_recall(truth: Column, contexts: Column) -> Column:
    """Share of the units of the true answer that stand in a context, white space aside; 0 without units."""
    bare = lambda x: F.regexp_replace(x, r"\s", "")
    units = split_for_recall(F.coalesce(truth, F.lit("")))
    held = F.filter(units, lambda u: F.exists(F.coalesce(contexts, F.array().cast("array<string>")), lambda c: bare(c).contains(bare(u))))
    return F.when(F.size(units) == 0, 0.0).otherwise(F.size(held) / F.greatest(F.size(units), F.lit(1)))


def resolve_metrics(wanted: DataFrame, backends: DataFrame) -> DataFrame:
    """(metric, backend): the backend of highest priority that supports each wanted metric; null if none does."""
    order = Window.partitionBy("metric").orderBy(F.col("priority").asc_nulls_last(), "backend")
    return wanted.join(backends, "metric", "left").withColumn("_k", F.row_number().over(order)).where("_k = 1").select("metric", "backend")


def experiment_aggregate(results: DataFrame, by: list[str]) -> DataFrame:
    """One row a group of ``by`` over retrieval, chunk, dedup and generation metrics, each a map that may be null.

    Document-level means are over questions with a hit rate; chunk and dedup means take a missing metric of a question that
    has such metrics as 0; false positives over the questions that have a rate; diversity only where there is a hit rate;
    generation means over the values there are. What no question has is null, but the first three, which are 0.
    """

    def value(column: str, metric: str) -> Column:
        return F.try_element_at(F.col(column), F.lit(metric))

    gate = value("retrieval", "hit_rate").isNotNull()
    mean = lambda c: F.round(F.avg(c), 9)
    columns = [F.count("*").alias("total_questions"), F.count_if(gate).alias("applicable_questions")]
    columns += [F.coalesce(mean(F.when(gate, value("retrieval", m))), F.lit(0.0)).alias(f"avg_{m}") for m in ("hit_rate", "mrr", "ndcg")]
    for family in ("chunk", "dedup"):
        held = F.coalesce(F.size(F.map_keys(family)), F.lit(0)) > 0
        columns += [mean(F.when(held, F.coalesce(value(family, m), F.lit(0.0)))).alias(f"avg_{family}_{m}") for m in ("hit_rate", "mrr", "ndcg")]
    columns += [mean("false_positive_rate").alias("avg_false_positive_rate"), F.count("false_positive_rate").alias("irrelevant_questions")]
    columns += [mean(F.when(gate, value("retrieval", "retrieval_diversity"))).alias("avg_diversity")]
    columns += [mean(value("generation", m)).alias(f"avg_{m}") for m in ("faithfulness", "answer_relevancy", "context_precision", "context_recall")]
    columns += [share_below(value("generation", "faithfulness"), 0.5).alias("hallucination_rate")]
    return results.groupBy(*by).agg(*columns)


def first_backend(generation: Column, metric: str, prefixes: tuple[str, ...] = ("builtin_", "ragas_", "")) -> Column:
    """A metric's value from the first backend, by its prefix, that has one."""
    return F.coalesce(*(F.try_element_at(generation, F.lit(p + metric)) for p in prefixes))


def aggregate_by_type(results: DataFrame, by: list[str]) -> DataFrame:
    """(*by, question_type, n, means): retrieval means over questions with a hit rate, generation ones with the fallback of backends."""
    gate = F.try_element_at("retrieval", F.lit("hit_rate")).isNotNull()
    retrieval = [F.round(F.avg(F.when(gate, F.try_element_at("retrieval", F.lit(m)))), 9).alias(f"avg_{m}") for m in ("hit_rate", "mrr", "ndcg", "retrieval_diversity")]
    generation = [F.round(F.avg(first_backend(F.col("generation"), m)), 9).alias(f"avg_{m}") for m in ("faithfulness", "answer_relevancy")]
    return results.groupBy(*by, F.coalesce("question_type", F.lit("unknown")).alias("question_type")).agg(F.count("*").alias("n"), *retrieval, *generation)


def applicable_metrics(graded: DataFrame, key: str) -> DataFrame:
    """(key, retrieval, chunk, dedup, false_positive_rate): metric maps that hold only what applies to a question.

    ``graded`` has arrays ``sources`` and ``expected`` (normalised documents), ``chunks`` and ``expected_chunks`` of (id, stem,
    number), and ``expect_retrieval`` (null counts as true). Document metrics need expected documents, chunk metrics expected and
    retrieved chunks, both a question that expects a retrieval; the false-positive rate one that doesn't; diversity any hit.
    """
    from folioforge.functions import metrics as M

    wants = F.coalesce("expect_retrieval", F.lit(True))
    documents = wants & (F.size("expected") > 0)
    chunks = wants & (F.size("chunks") > 0) & (F.size("expected_chunks") > 0)
    got, wanted = F.col("sources"), F.col("expected")
    once = F.array_distinct(got)
    graded = graded.withColumn("_rel", F.transform("chunks", lambda c: M.chunk_relevance(c["stem"], c["number"], c["id"], F.col("expected_chunks"))))

    def held(pairs: dict[str, Column]) -> Column:
        """A map of the entries whose value is not null."""
        entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.round(v.cast("double"), 6).alias("value")) for k, v in pairs.items())), lambda e: e["value"].isNotNull())
        return F.map_from_entries(entries)

    retrieval = {"hit_rate": M.hit_rate(got, wanted), "mrr": M.reciprocal_rank(got, wanted), "ndcg": M.ndcg(got, wanted), **{f"recall_{k}": M.recall(got, wanted, k) for k in (3, 5, 10)}}
    retrieval = {k: F.when(documents, v) for k, v in retrieval.items()} | {"retrieval_diversity": F.when(F.size(got) > 0, M.diversity(got))}
    chunk = {"hit_rate": M.chunk_hit(F.col("_rel")), "mrr": M.chunk_reciprocal_rank(F.col("_rel")), "ndcg": M.chunk_ndcg(F.col("_rel"), F.size("expected_chunks"))}
    dedup = {"hit_rate": M.hit_rate(once, wanted), "mrr": M.reciprocal_rank(once, wanted), "ndcg": M.ndcg(once, wanted)}
    return graded.select(
        key, held(retrieval).alias("retrieval"), held({k: F.when(chunks, v) for k, v in chunk.items()}).alias("chunk"), held({k: F.when(documents, v) for k, v in dedup.items()}).alias("dedup"),
        F.when(~wants, F.round(M.false_positive_rate(got), 6)).alias("false_positive_rate"),
    )


def compared_metrics(wanted: DataFrame, backends: DataFrame) -> DataFrame:
    """(metric, backend, column): every backend that supports a wanted metric, with the prefixed name its values get."""
    return wanted.join(backends, "metric").select("metric", "backend", F.concat_ws("_", "backend", "metric").alias("column"))
