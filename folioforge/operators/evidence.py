"""Whether answers agree with their evidence, and evidence with its document: numbers, signs, quotes, and the gate over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.testsets import excerpt_found
from folioforge.operators.validation import quote_matches, unit_errors

# Number forms with the unit they name, in the order in which they are read; the last one reads any number.
NUMBER_FORMS = (("亿元", "亿"), ("万元", "万"), ("元", "元"), ("%", "%"), ("％", "%"), ("个百分点", "百分点"), ("个", "个"), ("", ""))
# What one unit is in the base unit.
UNIT_FACTORS = {"亿": 1e8, "万": 1e4}
# Words that call a value negative.
NEGATIVE_WORDS = ("负值", "为负", "负数", "均为负", "均为负值")
#: Numbers under this are not looked for in the evidence.
LEAST_NUMBER = 10
#: Least characters of a quote, white space aside: mostly Han, or other.
LEAST_QUOTE_HAN, LEAST_QUOTE = 15, 30
#: Confidence of verified evidence by how it was found.
CONFIDENCE = {"exact": 1.0, "fuzzy": 0.9, "document_fuzzy": 0.8}
# How strictly the gate treats each kind of question; others are moderate.
STRICTNESS = {"irrelevant": "none", "missing": "none"}


def numbers_with_units(text: Column) -> Column:
    """Array of (value, unit, base, shown): every number in every form it can be read in, base in the smallest unit."""

    def read(suffix: str, unit: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"(\d+[\d,]*\.?\d*)\s*{suffix}" if suffix else r"(\d+[\d,]*\.?\d*)"), F.lit(1))
        value = lambda x: F.regexp_replace(x, ",", "").try_cast("double")
        return F.transform(found, lambda x: F.struct(value(x).alias("value"), F.lit(unit).alias("unit"), (value(x) * UNIT_FACTORS.get(unit, 1.0)).alias("base"), F.concat(x, F.lit(unit)).alias("shown")))

    return F.filter(F.flatten(F.array(*(read(*form) for form in NUMBER_FORMS))), lambda x: x["value"].isNotNull())


def unsupported_numbers(answer: Column, evidence: Column) -> Column:
    """Numbers of an answer, as shown, that its evidence lacks: none within 1 % in the base unit, within 0.01 of a large unit, or
    within 5 % as written. Empty without answer or evidence."""

    def same(a: Column, e: Column) -> Column:
        near = F.abs(a["base"] - e["base"]) / F.greatest(e["base"], F.lit(1.0)) < 0.01
        large = (e["unit"] == "元") & (((a["unit"] == "亿") & (F.abs(a["value"] - e["value"] / 1e8) < 0.01)) | ((a["unit"] == "万") & (F.abs(a["value"] - e["value"] / 1e4) < 0.01)))
        return near | large | (F.abs(a["value"] - e["value"]) / F.greatest(e["value"], F.lit(1.0)) < 0.05)

    wanted = F.filter(numbers_with_units(answer), lambda a: a["value"] >= LEAST_NUMBER)
    known = numbers_with_units(evidence)
    missing = F.transform(F.filter(wanted, lambda a: ~F.exists(known, lambda e: same(a, e))), lambda a: a["shown"])
    return F.when((F.coalesce(answer, F.lit("")) == "") | (F.coalesce(evidence, F.lit("")) == ""), F.array().cast("array<string>")).otherwise(missing)


def sign_contradiction(answer: Column, excerpt: Column) -> Column:
    """Whether an answer calls a value negative but gives a positive number: one that its excerpt has with a minus, or any above 10."""
    says = F.lit(False)
    for word in NEGATIVE_WORDS:
        says = says | answer.contains(word)
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"(-?\d+[\d,.]*\d*|-?\d+)"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
    positive = F.filter(numbers, lambda x: x > 0)
    turned = F.exists(positive, lambda x: F.contains(excerpt, F.concat(F.lit("-"), x.cast("string"))) | F.contains(excerpt, F.concat(F.lit("-"), F.format_number(x, 2))))
    return F.coalesce(says & (F.coalesce(turned, F.lit(False)) | F.exists(positive, lambda x: x > 10)), F.lit(False))


def corrected(answer: Column, excerpt: Column) -> Column:
    """The answer with each amount that is ten times or a tenth of one in the excerpt replaced by that, in order."""
    return F.aggregate(unit_errors(answer, excerpt), answer, lambda acc, e: F.replace(acc, e["answer_value"].cast("string"), e["excerpt_value"].cast("string")))


def checked_evidence(evidence: DataFrame, segments: DataFrame, documents: DataFrame, keys: list[str], document: str, least: float = 0.85) -> DataFrame:
    """(*keys, verified, match_type, position, reason) of each quote: looked for in its segment, then in segments that share a page
    with it (the first by number), then in the whole document.

    ``evidence`` has (*keys, document, segment_index, quote), ``segments`` (document, segment_index, pages, text), ``documents``
    (document, content). Quotes without a segment, or too short, are not looked for; one that names no segment of its document
    is looked for in the document only. Each tier gets only what the tiers before it didn't find.
    """
    bare = F.regexp_replace(F.coalesce("quote", F.lit("")), r"\s+", "")
    han = F.length(F.regexp_replace(bare, "[^一-鿿]", ""))
    shortest = F.when(han * 2 > F.length(bare), LEAST_QUOTE_HAN).otherwise(LEAST_QUOTE)
    ruled = evidence.withColumn("_reason", F.when(F.col("segment_index").isNull(), "missing segment").when(F.length(bare) < shortest, F.concat(F.lit("shorter than "), shortest.cast("string"))))
    own = segments.select(document, "segment_index", F.col("pages").alias("_pages"), F.col("text").alias("_text"))
    placed = ruled.where("_reason is null").join(own, [document, "segment_index"], "left")
    kind = F.when(F.contains("_text", "quote"), "exact").otherwise("fuzzy")
    carry = [*keys, document, "segment_index", "quote", "_pages"]

    def looked_up(frame: DataFrame, *more: str) -> DataFrame:
        columns = [*carry, *more]
        return quote_matches(frame.withColumn("_kind", kind), [*columns, "_kind"], "quote", "_text", least)

    first = looked_up(placed.where("_text is not null"))
    lost = first.where(~F.col("found")).select(*carry)
    other = segments.select(document, F.col("segment_index").alias("_other"), F.col("pages").alias("_shared"), F.col("text").alias("_text"))
    beside = lost.join(other, document).where((F.col("_other") != F.col("segment_index")) & F.arrays_overlap("_shared", "_pages"))
    second = looked_up(beside, "_other").where("found").withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_other"))).where("_k = 1")
    rest = lost.join(second.select(*keys), keys, "left_anti").unionByName(placed.where("_text is null").select(*carry))
    whole = rest.join(documents.select(document, F.col("content").alias("_content")), document, "left")
    seen = F.coalesce((F.col("_content") != "") & excerpt_found(F.col("quote"), F.col("_content")), F.lit(False))
    reason = F.when(F.col("_pages").isNull(), "no such segment").otherwise("not in the document")
    third = whole.select(*keys, seen.alias("verified"), F.when(seen, "document_fuzzy").alias("match_type"), F.lit(None).cast("int").alias("position"), F.when(~seen, reason).alias("reason"))
    hit = lambda frame: frame.select(*keys, F.lit(True).alias("verified"), F.col("_kind").alias("match_type"), F.col("position").cast("int"), F.lit(None).cast("string").alias("reason"))
    refused = ruled.where("_reason is not null").select(*keys, F.lit(False).alias("verified"), F.lit(None).cast("string").alias("match_type"), F.lit(None).cast("int").alias("position"), F.col("_reason").alias("reason"))
    return hit(first.where("found")).unionByName(hit(second)).unionByName(third).unionByName(refused)


def evidence_rates(questions: DataFrame, checked: DataFrame, key: str, by: str) -> DataFrame:
    """(by, questions, quote_verification_rate, ground_truth_confidence, excerpt_verified_rate): of each group, to four places.

    Questions that need no evidence (irrelevant, missing) and have none count as verified; an unknown excerpt flag as true.
    """
    weight = F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair))[F.col("match_type")]
    told = checked.groupBy(key).agg(F.count("*").alias("_n"), F.count_if("verified").alias("_verified"), F.sum(F.when(F.col("verified"), F.coalesce(weight, F.lit(0.0)))).alias("_confidence"))
    both = questions.join(told, key, "left")
    good = (F.coalesce("_verified", F.lit(0)) > 0) | (F.col("_n").isNull() & F.col("question_type").isin("irrelevant", "missing"))
    return both.groupBy(by).agg(
        F.count("*").alias("questions"), F.round(F.avg(F.coalesce(good, F.lit(False)).cast("double")), 4).alias("quote_verification_rate"),
        F.round(F.coalesce(F.try_divide(F.sum("_confidence"), F.sum("_verified")), F.lit(0.0)), 4).alias("ground_truth_confidence"),
        F.round(F.avg(F.coalesce("metadata.excerpt_verified", F.lit(True)).cast("double")), 4).alias("excerpt_verified_rate"),
    )


def gated(questions: DataFrame, key: str, content: str, evidence: str) -> DataFrame:
    """(key, answer, corrected, contradicts_sign, excerpt_verified, unsupported, kept): the checks a question passes before it is taken.

    Amounts are corrected first. Evidence of strict questions may leave one number open, of moderate ones two; others are only
    marked. Of equal questions the first that passed is kept, by key. ``content`` is the question's document, ``evidence`` the
    text of its quotes.
    """
    answer, excerpt = F.coalesce("answer", F.lit("")), F.coalesce("ground_truth_excerpt", F.lit(""))
    errors = F.size(unit_errors(answer, excerpt)) > 0
    mended = questions.withColumn("_answer", F.when(errors, corrected(answer, excerpt)).otherwise(F.col("answer"))).withColumn("_corrected", errors)
    strictness = F.coalesce(F.create_map(*(F.lit(x) for pair in STRICTNESS.items() for x in pair))[F.col("question_type")], F.lit("moderate"))
    open_numbers = F.when(strictness != "none", unsupported_numbers(F.col("_answer"), F.col(evidence))).otherwise(F.array().cast("array<string>"))
    checked = mended.select(
        key, "question", F.col("_answer").alias("answer"), F.col("_corrected").alias("corrected"), sign_contradiction(F.coalesce("_answer", F.lit("")), excerpt).alias("contradicts_sign"),
        F.when((excerpt != "") & (F.col("question_type") != "irrelevant"), excerpt_found(excerpt, F.coalesce(content, F.lit("")))).alias("excerpt_verified"),
        open_numbers.alias("unsupported"), F.when(strictness == "strict", 1).when(strictness == "moderate", 2).alias("_most"),
    ).withColumn("_passed", F.coalesce(F.size("unsupported") <= F.col("_most"), F.lit(True)))
    first = checked.where("_passed").groupBy("question").agg(F.min(key).alias("_first"))
    same = checked["question"].eqNullSafe(first["question"])
    return checked.join(first, same, "left").select(
        key, "answer", "corrected", "contradicts_sign", "excerpt_verified", "unsupported", F.coalesce(F.col("_passed") & (F.col(key) == F.col("_first")), F.lit(False)).alias("kept")
    )
