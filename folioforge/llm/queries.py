"""The queries of the training-data operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import encoding, language, lines, packing, pairs, percentiles, splitting, truncation, visual
from folioforge.runtime import read_table

#: Percentiles that the token report has.
SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]
_TOKENS = ["input_tokens", "output_tokens"]
_GROUPS = ["category", "model_name"]


def size_profiles(spark: SparkSession, folder: str, unit: str) -> list[tuple[str, int, int]]:
    """(profile, max_size, overlap) of one unit; the table has a handful of rows."""
    rows = read_table(spark, folder, "size_profiles").where(F.col("unit") == unit).orderBy("profile").collect()
    return [(r["profile"], r["max_size"], r["overlap"]) for r in rows]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    contents = visual.same_look_pairs(read_table(spark, folder, "loaded_documents"), "load_id", "content")
    questions = visual.same_look_pairs(read_table(spark, folder, "golden_qa"), "id", "question")
    return contents.select(F.lit("loaded_documents.content").alias("field"), "*").unionByName(
        questions.select(F.lit("golden_qa.question").alias("field"), "*")
    )


def _forms(frame: DataFrame, key: str, column: str) -> DataFrame:
    text = F.col(column)
    return frame.select(key, visual.visual(text).alias("visual_form"), visual.readable(text).alias("readable_form"), visual.visual(text, fold_case=True).alias("folded_form"))


def p1_contents(spark: SparkSession, folder: str) -> DataFrame:
    return _forms(read_table(spark, folder, "loaded_documents"), "load_id", "content")


def p1_questions(spark: SparkSession, folder: str) -> DataFrame:
    return _forms(read_table(spark, folder, "golden_qa"), "id", "question")


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    contents = visual.look_classes(read_table(spark, folder, "loaded_documents"), "load_id", "content")
    questions = visual.look_classes(read_table(spark, folder, "golden_qa"), "id", "question")
    return contents.withColumn("field", F.lit("loaded_documents.content")).unionByName(questions.withColumn("field", F.lit("golden_qa.question")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.broken_off(read_table(spark, folder, "evaluation_results"))


def p2_share(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.broken_off_share(read_table(spark, folder, "evaluation_results"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized(read_table(spark, folder, "loaded_documents"), size_profiles(spark, folder, "char"))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_corpus(read_table(spark, folder, "loaded_documents"), size_profiles(spark, folder, "char"))


def _daily_parts(spark: SparkSession, folder: str) -> DataFrame:
    records = read_table(spark, folder, "token_records").withColumn("day", F.to_date("ts"))
    return percentiles.parts(records, [*_GROUPS, "day"], _TOKENS, "record_id", _GROUPS)


def p3_seams(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents").withColumn("named", language.label_language()(F.col("lang")))
    return splitting.seam_recall(documents, "doc_id", "text", "named")


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.quantiles(percentiles.merge(_daily_parts(spark, folder), _GROUPS), _GROUPS, SHARES)


def p4_daily(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.merge(_daily_parts(spark, folder), [*_GROUPS, "day"])


def p4_compact(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.compacted(percentiles.merge(_daily_parts(spark, folder), _GROUPS), _GROUPS)


def p4_totals(spark: SparkSession, folder: str) -> DataFrame:
    return p4_compact(spark, folder).groupBy(*_GROUPS, "metric").agg(F.sum("n").alias("n_values"))


def p4_rank_check(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.rank_check(read_table(spark, folder, "token_records"), p4_percentiles(spark, folder), _GROUPS, _TOKENS, "record_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return lines.repeated_lines(read_table(spark, folder, "loaded_documents")).select("load_id", "line_no")


def p5_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return lines.without_repeated_lines(read_table(spark, folder, "loaded_documents"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.defective_pairs(read_table(spark, folder, "evaluation_results"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode_corpus(read_table(spark, folder, "documents"))


def p7_texts(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.decode_corpus(p7_ids(spark, folder))


def p8_assignment(spark: SparkSession, folder: str) -> DataFrame:
    profiles = [(name, size) for name, size, _ in size_profiles(spark, folder, "token")]
    return packing.pack_corpus(encoding.token_counts(read_table(spark, folder, "documents")), profiles)


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.container_fill(p8_assignment(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.mislabelled(read_table(spark, folder, "documents"))


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    return language.document_languages(read_table(spark, folder, "documents"))


def p9_segments(spark: SparkSession, folder: str) -> DataFrame:
    return language.language_segments(read_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        p1_found, p1_contents, p1_questions, p1_classes, p2_found, p2_share, p3_found, p3_pieces, p3_seams, p4_percentiles, p4_daily, p4_compact, p4_totals, p4_rank_check,
        p5_found, p5_cleaned, p6_found, p7_ids, p7_texts, p8_assignment, p8_fill, p9_found, p9_documents, p9_segments,
    ]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    space = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?;。！？；]"
    return {
        "p3_found": f"""
            WITH sized AS (SELECT DISTINCT load_id, content FROM loaded_documents WHERE content IS NOT NULL),
            runs AS (SELECT load_id, length(content) AS n,
                            list_max([length(x) for x in string_split_regex(content, '{space}')]) AS longest FROM sized)
            SELECT load_id, profile, CAST(longest > max_size AS INTEGER) AS forced
            FROM runs, size_profiles WHERE unit = 'char' AND n > max_size""",
        "p4_totals": """
            WITH once AS (SELECT DISTINCT record_id, category, model_name, input_tokens, output_tokens FROM token_records),
            long AS (SELECT category, model_name, 'input_tokens' AS metric, input_tokens AS v FROM once
                     UNION ALL SELECT category, model_name, 'output_tokens', output_tokens FROM once)
            SELECT category, model_name, metric, CAST(count(v) AS BIGINT) AS n_values FROM long
            WHERE v IS NOT NULL GROUP BY ALL""",
        "p4_rank_check": f"""
            WITH once AS (SELECT DISTINCT record_id, category, model_name, input_tokens, output_tokens FROM token_records),
            long AS (SELECT category, model_name, 'input_tokens' AS metric, input_tokens AS v FROM once
                     UNION ALL SELECT category, model_name, 'output_tokens', output_tokens FROM once),
            sized AS (SELECT category, model_name, metric, CAST(count(v) AS BIGINT) AS n_values FROM long WHERE v IS NOT NULL GROUP BY ALL)
            SELECT category, model_name, metric, CAST(share AS DOUBLE) AS share, n_values, TRUE AS within
            FROM sized, (SELECT unnest({SHARES}) AS share)""",
        "p7_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
