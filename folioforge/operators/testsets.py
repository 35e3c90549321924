"""Composing, merging, auditing and sampling of test sets."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.ordering import numbered, running
from folioforge.runtime import cut, ship


def filtered(questions: DataFrame, types: list[str] | None = None, categories: list[str] | None = None, difficulties: list[str] | None = None, statuses: list[str] | None = None) -> DataFrame:
    """Questions that match every given list; a list that isn't given doesn't restrict."""
    out = questions
    for column, values in (("question_type", types), ("category", categories), ("difficulty", difficulties), ("metadata.review_status", statuses)):
        if values is not None:
            out = out.where(F.col(column).isin(*values))
    return out


def not_rejected(questions: DataFrame) -> DataFrame:
    """Questions but the rejected ones; those without a status stay."""
    return questions.where(~F.col("metadata.review_status").eqNullSafe("rejected"))


def merged(questions: DataFrame, order: list[str]) -> DataFrame:
    """One question of each text, the first in ``order``; rejected ones are dropped first, null texts stay apart from each other."""
    kept = not_rejected(questions)
    text = F.coalesce("question", F.concat(F.lit("\x00"), "id"))
    place = F.row_number().over(Window.partitionBy(text).orderBy(*order))
    return kept.withColumn("_k", place).where("_k = 1").drop("_k")


def renumbered(questions: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Ids q001, q002, ... within each test set."""
    return numbered(questions, order, "_n", [by]).withColumn("new_id", F.format_string("q%03d", F.col("_n") + 1)).drop("_n")


def sources_known(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, missing): how many of a question's sources aren't among the documents; 0 for questions without sources."""
    wanted = questions.select("id", F.explode(F.array_distinct("source_files")).alias("source_path"))
    absent = wanted.join(documents.select("source_path").distinct(), "source_path", "left_anti").groupBy("id").agg(F.count("*").alias("missing"))
    return questions.select("id").distinct().join(absent, "id", "left").select("id", F.coalesce("missing", F.lit(0)).alias("missing"))


def audit(questions: DataFrame) -> DataFrame:
    """Share of each source document in its test set; ``skewed`` above 15 %."""
    held = questions.select("test_set", F.explode("source_files").alias("source_path")).groupBy("test_set", "source_path").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("test_set"))
    return held.select("test_set", "source_path", "n", F.round(share, 6).alias("share"), (share > 0.15).alias("skewed"))


# Endings of company names that a template's pattern takes with the name.
NAME_ENDINGS = "集团|股份|公司|银行|医药|时代|电器|水泥|味业|白药|茅台|老窖"


def question_pattern(question: Column) -> Column:
    """A question with names, years and numbers replaced, so that those from one template are equal."""
    named = F.regexp_replace(question, f"[\u4e00-\u9fff]{{2,6}}({NAME_ENDINGS})?", "X")
    return F.regexp_replace(F.regexp_replace(named, r"\d{4}", "YEAR"), r"[\d,.]+%?", "NUM")


def repeated_patterns(questions: DataFrame, by: str, least: int = 3) -> DataFrame:
    """(by, pattern, n): patterns that at least so many questions of a test set have."""
    return questions.groupBy(by, question_pattern(F.coalesce("question", F.lit(""))).alias("pattern")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _first_source() -> Column:
    return F.coalesce(F.get("source_files", F.lit(0)), F.lit("unknown"))


def concentrated(questions: DataFrame, by: str, most: int = 2) -> DataFrame:
    """(by, source_path, question_type, n): more than ``most`` questions of one type about one document; irrelevant ones aside."""
    asked = questions.where(~F.col("question_type").eqNullSafe("irrelevant"))
    return asked.groupBy(by, _first_source().alias("source_path"), F.coalesce("question_type", F.lit("unknown")).alias("question_type")).agg(F.count("*").alias("n")).where(F.col("n") > most)


def shared_entities(questions: DataFrame, by: str, key: str, entities: Column) -> DataFrame:
    """(by, source_path, entities, n, first_id): questions about one document that name the same two or more entities."""
    asked = questions.where(~F.col("question_type").eqNullSafe("irrelevant")).withColumn("entities", F.array_sort(F.coalesce(entities, F.array().cast("array<string>"))))
    grouped = asked.where(F.size("entities") >= 2).groupBy(by, _first_source().alias("source_path"), F.array_join("entities", "|").alias("entities"))
    return grouped.agg(F.count("*").alias("n"), F.min(key).alias("first_id")).where("n >= 2")


def difficulty_histogram(questions: DataFrame, by: str) -> DataFrame:
    """(by, difficulty, n); questions without one are unknown."""
    return questions.groupBy(by, F.coalesce("difficulty", F.lit("unknown")).alias("difficulty")).agg(F.count("*").alias("n"))


def most_common(questions: DataFrame, by: str, value: Column, name: str, k: int = 10) -> DataFrame:
    """(by, name, n, place): the k commonest values of each group; ties go to the smaller value."""
    counted = questions.groupBy(by, value.alias(name)).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(F.desc("n"), name)
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def tier(score: Column, given: Column | None = None) -> Column:
    """A from a mean of 4, B from 3, else C; a tier that is given wins."""
    scored = F.when(score >= 4, "A").when(score >= 3, "B").otherwise("C")
    return scored if given is None else F.coalesce(given, scored)


def repeated(questions: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of questions that agree in ``keys``, with their size, where there is more than one."""
    return questions.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def review_progress(questions: DataFrame) -> DataFrame:
    """Approved, rejected and pending questions and the quality status of each test set."""
    status = F.col("metadata.review_status")
    counted = questions.groupBy("test_set").agg(
        F.count("*").alias("n"), F.count_if(status.isin("approved", "auto_approved")).alias("approved"), F.count_if(status == "rejected").alias("rejected")
    )
    pending = F.col("n") - F.col("approved") - F.col("rejected")
    state = F.when(pending == 0, "reviewed").when(F.col("approved") + F.col("rejected") > 0, "in_review").otherwise("draft")
    return counted.select("test_set", "n", "approved", "rejected", pending.alias("pending"), state.alias("quality_status"))


def largest_remainder(weights: DataFrame, by: str, name: str, weight: str, total: str) -> DataFrame:
    """Whole numbers that add up to ``total`` in each group: floors, then one more for the largest fractions (ties by name).

    A group whose weights are all 0 shares out floor(total / members) to each.
    """
    whole = Window.partitionBy(by)
    exact = F.col(weight) * F.col(total) / F.sum(weight).over(whole)
    base = weights.withColumn("mass", F.sum(weight).over(whole)).withColumn("exact", F.when(F.col("mass") > 0, exact)).withColumn("floored", F.floor("exact"))
    order = Window.partitionBy(by).orderBy(F.desc(F.round(F.col("exact") - F.col("floored"), 9)), name)
    left = F.col(total) - F.sum("floored").over(whole)
    more = (F.row_number().over(order) <= left).cast("int")
    even = F.floor(F.col(total) / F.count("*").over(whole))
    return base.select(by, name, F.when(F.col("mass") > 0, F.col("floored") + more).otherwise(even).cast("long").alias("allotted"))


def round_robin(items: DataFrame, item: str, order: list[str], holders: DataFrame, holder: str) -> DataFrame:
    """Item i goes to holder i mod n, both in order. Running numbers come from range partitions, not from one task."""
    places = numbered(holders.select(holder).distinct(), [holder], "place")
    n = places.count()
    if n == 0:
        return items.select(item).limit(0).withColumn(holder, F.lit(None))
    return numbered(items, order, "turn").withColumn("place", (F.col("turn") % n)).join(places, "place").select(item, holder)


def hash_sample(frame: DataFrame, by: str, key: str, n: int, seed: str = "0") -> DataFrame:
    """n rows of each group, chosen by a hash of seed and key: the same on every run and engine."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    return frame.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def sample_share(frame: DataFrame, by: str, key: str, share: float, seed: str = "0") -> DataFrame:
    """A share of each group's rows, rounded up, at least one and at most all, chosen by a hash of seed and key."""
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    sized = frame.groupBy(by).agg(F.greatest(F.lit(1), F.least(F.count("*"), F.ceil(F.count("*") * share))).alias("_most")).withColumnRenamed(by, "_by")
    ranked = numbered(frame.withColumn("_hash", order), ["_hash", key], "_k", [by])
    return ranked.join(sized, F.col(by).eqNullSafe(F.col("_by"))).where(F.col("_k") < F.col("_most")).select(*frame.columns)


def first_questions(questions: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first questions in an order, for a partial evaluation."""
    return questions.orderBy(*order).limit(most)


#: Segments that a question of a type is made from, at most; other types take one.
SEGMENTS_OF_TYPE = {"multi_hop": 3, "comparison": 3, "summary": 2, "reasoning": 2}


def chosen_segments(questions: DataFrame, segments: DataFrame, key: str, document: str, seed: str = "0") -> DataFrame:
    """(key, segment_index): segments of a question's document, as many as its type takes, neighbours from a hashed place on."""
    sized = segments.groupBy(document).agg(F.count("*").alias("_n"))
    most = F.coalesce(F.create_map(*(F.lit(x) for pair in SEGMENTS_OF_TYPE.items() for x in pair))[F.col("question_type")], F.lit(1))
    asked = questions.join(sized, document).withColumn("_m", F.least(most, F.col("_n")))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key))), 1, 8), 16, 10).cast("long") % (F.col("_n") - F.col("_m") + 1)
    return asked.select(key, F.explode(F.sequence(start, start + F.col("_m") - 1).cast("array<int>")).alias("segment_index"))


def listed_issues(issues: DataFrame, status: str | None = None, kind: str | None = None, priority: str | None = None, labels: list[str] | None = None) -> DataFrame:
    """Issues that match every given value and have all the labels, newest first."""
    out = issues
    for column, value in (("status", status), ("kind", kind), ("priority", priority)):
        if value is not None:
            out = out.where(F.col(column) == value)
    for label in labels or []:
        out = out.where(F.array_contains("labels", label))
    return out.orderBy(F.desc("created_at"), F.desc("id"))


def until_target(frame: DataFrame, by: str, order: list[str], size: str, target: int) -> DataFrame:
    """Rows of each group in order until their sizes reach the target, the crossing row included."""
    return running(frame, [by], order, F.col(size), "running").where(F.col("running") - F.col(size) < target)


def systematic(frame: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The rows at floor(i * size / n) of each group, i from 0 to n - 1; groups of fewer rows whole."""
    sizes = frame.groupBy(by).agg(F.count("*").alias("size"))
    ranked = numbered(frame, order, "place", [by]).join(sizes, by)
    chosen = F.floor(F.ceil(F.col("place") * n / F.col("size")) * F.col("size") / n) == F.col("place")
    return ranked.where((F.col("size") <= n) | chosen).drop("place", "size")


#: Least kilobytes of a document's tier, and most questions that a document of it gets.
TIERS = ((200.0, 5), (50.0, 3), (0.0, 1))


def capped_shares(sizes: DataFrame, by: str, name: str, kilobytes: str, total: int, tiers: tuple = TIERS) -> DataFrame:
    """(by, name, allotted): ``total`` questions shared out within each group in proportion to size, at most the tier's cap each.

    What the caps leave over goes, at most one at a time, to members with room from the largest on, round after round, for at
    most 3 * total turns. Shares are then rounded half to even, and the largest members mend the difference one by one, caps
    aside. Only the 3 * total + 1 largest members with room and the ``total`` largest of all can be touched after the cap, so
    only they meet in one task; all others are worked out where they are. Groups without any size have no shares.
    """
    ship(sizes.sparkSession)
    kinds = dict(sizes.dtypes)
    cap = F.coalesce(*(F.when(F.col(kilobytes) >= least, float(most)) for least, most in tiers), F.lit(float(tiers[-1][1])))
    mass = sizes.groupBy(by).agg(F.sum(kilobytes).alias("_mass"))
    capped = sizes.join(mass, by).where("_mass > 0").select(by, name, kilobytes, cap.alias("_cap"), F.least(F.col(kilobytes) / F.col("_mass") * total, cap).alias("_share"))
    ranked = cut(numbered(capped.withColumn("_room", F.col("_share") < F.col("_cap")), [F.desc(kilobytes), name], "_place", [by, "_room"]))
    touched = F.col("_place") < F.when(F.col("_room"), 3 * total + 1).otherwise(total)
    sums = ranked.groupBy(by).agg(F.sum("_share").alias("_given"), F.sum(F.when(~touched, F.bround("_share", 0)).otherwise(0.0)).alias("_others"))

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([kilobytes, name], ascending=[False, True], kind="stable")
        share, most = frame["_share"].to_numpy().copy(), frame["_cap"].to_numpy()
        over, turns = total - frame["_given"].iloc[0], itertools.cycle(np.flatnonzero(frame["_room"].to_numpy()))
        for k in itertools.islice(turns, 3 * total + 1):
            if over <= 0.01:
                break
            more = min(over, most[k] - share[k], 1.0)
            if more > 0.01:
                share[k] += more
                over -= more
        whole = np.round(share).astype(int)
        lacking = total - int(whole.sum() + frame["_others"].iloc[0])
        for k in itertools.islice(itertools.cycle(range(len(whole))), abs(lacking)):
            whole[k] = max(whole[k] + (1 if lacking > 0 else -1), 0)
        return pd.DataFrame({by: frame[by], name: frame[name], "allotted": whole})

    schema = f"`{by}` {kinds[by]}, `{name}` {kinds[name]}, allotted int"
    settled = ranked.where(touched).join(sums, by).groupBy(by).applyInPandas(settle, schema)
    rest = ranked.where(~touched).select(by, name, F.bround("_share", 0).cast("int").alias("allotted"))
    return settled.unionByName(rest)


def type_allotments(n: int, shares: dict[str, float]) -> dict[str, int]:
    """n questions divided into types in proportion, each rounded half to even; the largest types mend what is over or missing."""
    given = {kind: round(share * n) for kind, share in shares.items()}
    order = sorted(shares, key=lambda kind: -shares[kind])
    lacking = n - sum(given.values())
    for kind in itertools.islice(itertools.cycle(order), abs(lacking)):
        given[kind] = max(given[kind] + (1 if lacking > 0 else -1), 0)
    return given


def with_types(shares: DataFrame, count: str, types: dict[str, float], most: int) -> DataFrame:
    """(..., question_type, n) of each share's types; counts up to ``most`` are looked up, which bounds the table."""
    table = {n: type_allotments(n, types) for n in range(most + 1)}
    rows = [(n, kind, k) for n, kinds in table.items() for kind, k in kinds.items() if k > 0]
    allotted = shares.sparkSession.createDataFrame(rows, f"`{count}` int, question_type string, n int")
    return shares.join(F.broadcast(allotted), count).drop(count)


def similar(a: Column, b: Column, least: float = 0.85) -> Column:
    """Whether so many characters of the shorter text (of ``b`` if both are as long) stand in the longer one that they reach this
    share of its length."""
    shorter, longer = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
    held = F.size(F.filter(F.split(shorter, ""), lambda c: (c != "") & longer.contains(c)))
    return (a == b) | ((F.length(longer) > 0) & (held >= least * F.length(longer)))


def similar_pairs(questions: DataFrame, key: str, text: str, files: str, least: float = 0.85) -> DataFrame:
    """(first, second): different questions with a file in common whose texts, case and ends aside, are ``similar``; first < second.

    Texts that are alike have lengths within ``least`` of each other, so they meet by file and band of length; within a band
    by one of the rarest characters of the shorter: at most 1 - least of its characters can be missing from the longer one.
    """
    shaped = questions.select(F.col(key).alias("k"), F.lower(F.trim(F.coalesce(text, F.lit("")))).alias("t"), F.coalesce(F.col(files), F.array().cast("array<string>")).alias("f"))
    shaped = shaped.withColumn("_n", F.length("t")).withColumn("_band", F.floor(F.log(F.greatest("_n", F.lit(1)).cast("double")) / -math.log(least)))
    letters = shaped.select("k", F.explode(F.filter(F.split("t", ""), lambda c: c != "")).alias("c")).groupBy("k", "c").agg(F.count("*").alias("m"))
    frequency = letters.groupBy("c").agg(F.count("*").alias("df"))
    rarest = letters.join(frequency, "c").withColumn("_before", F.coalesce(F.sum("m").over(Window.partitionBy("k").orderBy("df", "c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sized = cut(shaped)
    # A text's characters from the rarest on, until more have been taken than may be missing.
    probes = rarest.join(sized.select("k", "_n"), "k").where(F.col("_before") <= (1 - least) * F.col("_n") + 1e-9).select("k", "c")
    probing = sized.join(probes, "k").select("k", "t", "_n", "c", F.explode("f").alias("file"), F.explode(F.array("_band", F.col("_band") + 1)).alias("_band"))
    probed = sized.join(letters.select("k", "c"), "k").select(F.col("k").alias("k2"), F.col("t").alias("t2"), F.col("_n").alias("_n2"), "c", F.explode("f").alias("file"), "_band")
    met = probing.join(probed, ["file", "_band", "c"]).where(((F.col("_n") < F.col("_n2")) | ((F.col("_n") == F.col("_n2")) & (F.col("k") < F.col("k2")))) & (F.col("_n") >= least * F.col("_n2") - 1e-9))
    alike = met.where(similar(F.col("t2"), F.col("t"), least)).select(F.least("k", "k2").alias("first"), F.greatest("k", "k2").alias("second"))
    blank = sized.where("_n = 0").select("k", F.explode("f").alias("file"))
    first = blank.groupBy("file").agg(F.min("k").alias("first"))
    return alike.unionByName(blank.join(first, "file").where("k <> first").select("first", F.col("k").alias("second"))).distinct()


def greedy_unique(questions: DataFrame, key: str, text: str, files: str, least: float = 0.85) -> DataFrame:
    """(key, kept): in key order over all questions, one is dropped if it is like one that was kept before and shares a file with it.

    Equal questions about the same files are reduced to their first. Order decides and likeness isn't transitive: a question
    is kept as soon as no earlier one like it is undecided or kept, and drops those like it; so few rounds decide all, however
    large a group of connected questions is, and none is held in one task.
    """
    own = questions.select(key, text, F.array_sort(F.array_distinct(F.coalesce(F.col(files), F.array().cast("array<string>")))).alias(files))
    same = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    leaders = cut(own.where(F.size(files) > 0).groupBy(same.alias("_t"), files).agg(F.min(key).alias(key)))
    edges = cut(similar_pairs(leaders.withColumnRenamed("_t", text), key, text, files, least))
    dropped = None
    while True:
        waiting = edges.select("second").distinct()
        heads = edges.select("first").distinct().join(waiting, F.col("first") == F.col("second"), "left_anti")
        out = cut(edges.join(heads, "first").select("second").distinct())
        if out.isEmpty():
            break
        dropped = out if dropped is None else dropped.unionByName(out)
        gone = out.withColumnRenamed("second", "_gone")
        edges = edges.join(heads, "first", "left_anti").join(gone, F.col("first") == F.col("_gone"), "left_anti").join(gone, F.col("second") == F.col("_gone"), "left_anti")
        edges = cut(edges)
    kept = leaders.select(F.col(key).alias("_k"))
    if dropped is not None:
        kept = kept.join(dropped, F.col("_k") == F.col("second"), "left_anti")
    flagged = own.join(kept.withColumn("_kept", F.lit(True)), F.col(key) == F.col("_k"), "left")
    return flagged.select(key, (F.coalesce("_kept", F.lit(False)) | (F.size(files) == 0)).alias("kept"))


def excerpt_found(excerpt: Column, document: Column, window: int = 15, step: int = 7) -> Column:
    """Whether the excerpt, white space aside, stands in the document, or else one of its windows does."""
    a, b = F.regexp_replace(excerpt, r"\s", ""), F.regexp_replace(document, r"\s", "")
    starts = F.sequence(F.lit(1), F.greatest(F.length(a) - window + 1, F.lit(1)), F.lit(step))
    part = F.exists(starts, lambda k: b.contains(F.substring(a, k, F.lit(window))))
    return F.when(F.length(a) == 0, False).otherwise(b.contains(a) | ((F.length(a) >= window) & part))


def stratified(frame: DataFrame, by: str, size: str, key: str, n: int) -> DataFrame:
    """n rows of each third of each group by size: the first in the order of a hash of the key."""
    ranked = numbered(frame, [size, key], "_place", [by]).join(frame.groupBy(by).agg(F.count("*").alias("_size")), by)
    each, more = F.floor(F.col("_size") / 3), F.col("_size") % 3
    larger = more * (each + 1)
    third = F.when(F.col("_place") < larger, F.floor(F.col("_place") / (each + 1))).otherwise(more + F.floor((F.col("_place") - larger) / F.greatest(each, F.lit(1)))) + 1
    order = Window.partitionBy(by, "third").orderBy(F.md5(F.col(key).cast("string")), key)
    chosen = ranked.withColumn("third", third.cast("int")).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n)
    return chosen.select(*frame.columns, "third")


def quality(questions: DataFrame, genuine: Column) -> DataFrame:
    """Of each test set: questions, share of genuine ones, of verified excerpts and of answered ones, kinds of questions."""
    share = lambda c: F.round(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), 4)
    return questions.groupBy("test_set").agg(
        F.count("*").alias("n"), share(genuine).alias("authenticity_rate"), share(F.col("metadata.excerpt_verified")).alias("excerpt_rate"),
        share(F.col("answer").isNotNull()).alias("answer_rate"), F.count_distinct("question_type").alias("question_types"),
    )


def positional_overlap(a: Column, b: Column) -> Column:
    """Share of places at which two texts have the same character, over the length of the shorter; 0 if one is empty."""
    shorter = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda k: F.substring(a, k, F.lit(1)) == F.substring(b, k, F.lit(1))))
    return F.when(F.coalesce(shorter, F.lit(0)) == 0, 0.0).otherwise(same / F.greatest(shorter, F.lit(1)))
