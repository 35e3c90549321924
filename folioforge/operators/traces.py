"""Where a query went wrong: ground truth along the stages, root causes, history, chats, cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truth_in_stages(hits: DataFrame, truth: DataFrame, trace: str, stage: str, item: str) -> DataFrame:
    """(trace, stage, best_rank, best_score, in_stage) of the wanted items in each stage of each trace."""
    wanted = hits.join(truth.select(trace, F.col(item), F.lit(True).alias("_true")), [trace, item], "left")
    best = F.min(F.when(F.col("_true"), F.struct("rank", "score")))
    return wanted.groupBy(trace, stage).agg(best["rank"].alias("best_rank"), best["score"].alias("best_score"), F.coalesce(F.bool_or("_true"), F.lit(False)).alias("in_stage"))


def stage_ranks(items: Column, truth: Column) -> Column:
    """Place of the first wanted item in a stage's list, from 1; null if it has none, or the stage didn't run."""
    places = F.transform(truth, lambda x: F.array_position(items, x))
    return F.array_min(F.filter(places, lambda k: k > 0)).cast("int")


def root_causes(traces: DataFrame, key: str) -> DataFrame:
    """(key, root_cause, rank) of each trace, a row with the lists of its stages.

    Columns: ``question``; ``truth`` ids and ``truth_answer``; ``retrieved``, ``reranked``, ``context_input`` ids and
    ``context_count`` (null where a stage didn't run), ``rewritten`` queries and ``answer``. RC-5 the rewritten queries miss
    it, RC-1 nothing retrieved it, RC-3 the context dropped it, RC-2 it ranks below 3 or behind what the context holds, RC-4
    the context has it and the answer doesn't, RC-0 the answer has it.
    """
    retrieved, reranked = stage_ranks(F.col("retrieved"), F.col("truth")), stage_ranks(F.col("reranked"), F.col("truth"))
    ranked = traces.withColumn("_retrieved", retrieved).withColumn("rank", F.coalesce(reranked, retrieved))
    mismatch = (F.size(F.coalesce("rewritten", F.array().cast("array<string>"))) > 0) & ~F.col("rewritten").eqNullSafe(F.array("question"))
    given = F.coalesce(F.arrays_overlap("context_input", "truth"), F.lit(False))
    # Without a step that assembles the context, what was retrieved is in it.
    held = F.coalesce(F.when(F.col("context_count").isNull(), F.col("_retrieved").isNotNull()).otherwise(F.col("rank") <= F.col("context_count")), F.lit(False))
    used = (F.coalesce("truth_answer", F.lit("")) != "") & F.coalesce(F.contains("answer", "truth_answer"), F.lit(False))
    cause = (
        F.when(F.size(F.coalesce("truth", F.array().cast("array<string>"))) == 0, "RC-1")
        .when(F.col("_retrieved").isNull(), F.when(mismatch, "RC-5").otherwise("RC-1"))
        .when(given & ~held & F.col("context_count").isNotNull(), "RC-3").when(F.col("rank") > 3, "RC-2")
        .when(held & used, "RC-0").when(held, "RC-4").otherwise("RC-2")
    )
    return ranked.select(key, cause.alias("root_cause"), "rank")


def newest(records: DataFrame, by: str, at: str, key: str, n: int = 10) -> DataFrame:
    """The n newest records of each group, numbered from the newest: a ring buffer as a window."""
    order = Window.partitionBy(by).orderBy(F.desc(at), F.desc(key))
    return records.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def chat_turns(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conversation, turn_no, role, text): user and assistant turns that aren't blank, neighbours of one role put together.

    Where the first isn't a user's, all user turns come first, then all others, before they are put together.
    """
    kept = turns.where(F.col(role).isin("user", "assistant") & (F.length(F.trim(F.coalesce(text, F.lit("")))) > 0))
    by = Window.partitionBy(conversation)
    first = F.first(role).over(by.orderBy(turn))
    ordered = kept.withColumn("_k", F.when(first == "user", 0).when(F.col(role) == "user", 0).otherwise(1))
    run = by.orderBy("_k", turn)
    change = (~F.col(role).eqNullSafe(F.lag(role).over(run))).cast("int")
    islands = ordered.withColumn("_change", change).withColumn("turn_no", F.sum("_change").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(turn, F.col(text).alias("_text")))), lambda x: x["_text"]), "\n")
    return islands.groupBy(conversation, "turn_no", role).agg(texts.alias("text"))


def cases_for(cases: DataFrame, questions: DataFrame, preview: str, question: str) -> DataFrame:
    """(id, case_id): each question with the first case (by id) whose preview it begins with; empty previews begin none.

    A question meets the previews that equal one of its beginnings, of the lengths that previews have, so no pair is formed
    without a match. Previews are cut to a fixed length when cases are written, so their lengths are few.
    """
    known = cases.where(F.length(preview) > 0).groupBy(preview).agg(F.min("case_id").alias("case_id"))
    lengths = known.agg(F.collect_set(F.length(preview)).alias("_lengths"))
    begun = questions.crossJoin(F.broadcast(lengths)).select("id", F.explode(F.transform(F.filter("_lengths", lambda n: n <= F.length(question)), lambda n: F.substring(question, F.lit(1), n))).alias(preview))
    return begun.join(known, preview).groupBy("id").agg(F.min("case_id").alias("case_id"))


def allowed_transitions(moves: DataFrame, allowed: DataFrame) -> DataFrame:
    """Moves of issues between states, with whether each is allowed."""
    ok = allowed.select("from_state", "to_state", F.lit(True).alias("_ok")).distinct()
    return moves.join(F.broadcast(ok), ["from_state", "to_state"], "left").withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_ok")
