"""Broken question and answer pairs (problem 6).

Copies are found by compressing each answer with its question as a zstandard dictionary, refusals and languages by
dictionaries, truncated answers by the terminal-context model of ``truncation``. Each defective pair has one defect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.truncation import copies_question, judged_endings


def defective_pairs(results: DataFrame) -> DataFrame:
    """(result_id, defect) of each pair unfit for use: empty, copy, refusal, truncated or language, looked for in this order.

    A null or blank answer is ``empty``; a null question can only have an empty, refusing or truncated answer. A message in
    ``error`` neither makes nor excuses a defect. Repeated rows count once.
    """
    judged = judged_endings(results, all_defects=True)
    copy = F.when(copies_question(judged), "copy")
    empty = F.when(F.col("defect") == "empty", "empty")
    defect = F.coalesce(empty, copy, F.col("defect"), F.when(F.col("log_odds") > 0, "truncated"), F.when(F.col("foreign"), "language"))
    return judged.select("result_id", defect.alias("defect")).where("defect is not null")
