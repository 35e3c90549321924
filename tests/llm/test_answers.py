import json
import random

import numpy as np
import pandas as pd
import pytest

from folioforge.llm import answers as A
from folioforge.llm import pairs, truncation
from folioforge.llm.visual import visual_form
from folioforge.llm.endings import CELLS, cell_of, learned

SCHEMA = "result_id string, variant string, question string, answer string, error string"


@pytest.mark.parametrize("text", [None, "", "  \n", "​", "N/A", "null", "[]", "{}", '""', "<p></p>", "```\n```", "——", "答：", "Answer:", "...", "\u3164" * 10, "\u3164" * 40, "答案：" * 20, "\u200b\u2060" * 300, "Question: Answer:"])
def test_nothing(text):
    assert A.carries_nothing(text)


@pytest.mark.parametrize("text", ["3%", "Paris", "0", "答：是", "no data", "答案：" * 20 + "是", "\u3164" * 40 + "x", "a" * 100_000])
def test_something(text):
    assert not A.carries_nothing(text)


@pytest.mark.parametrize(
    ("text", "state"),
    [
        ("Done.", "closed"), ("完成。[1][4]", "closed"), ("Done. ✅", "closed"), ("Done.\n\n---", "closed"), ("Done. (p. 14)", "closed"), ("好。（见附注 2）", "closed"),
        ('{"answer": "x"}', "closed"), ('{"answer": "x', "open"), ("```\ncode", "open"), ("说：“没有", "open"), ("abc�", "open"), ("| a | b |\n| 1 | 2 |", "closed"),
        ("| a | b |\n| 1 |", "open"), ("| a | b |\n| 1 | 2", "open"), ("it di...", "ask-dots"), ("cut in the mid", "ask"), ("rose 20.", "ask"), ("rose 20. Ref381.", "closed"), ("**bold", "open"), ("**bold.**", "closed"),
    ],
)
def test_endings(text, state):
    assert A.ending(text)[0] == state


def is_copy(question, answer, threshold=A.COPY_SHARE):
    given, adds = A.beyond_question(question, A.bare_forms([visual_form(answer)])[0])
    return given <= threshold and not adds


def test_copies():
    question = "What was the revenue of Acme in 2020?"
    for answer in (question, question.upper(), f"**{question}**", f"Question: {question}", f"You asked: {question}", f"{question}\n{question}", question.replace(" ", " "), "What was the revenue of Acme in 2020"):
        assert is_copy(question, answer), answer
    for answer in ("Acme", "in 2020", f"{question} It was 5 million.", "The revenue of Acme in 2020 was 17.2 million.", question.replace("2020", "2021")):
        assert not is_copy(question, answer), answer


def test_edited_and_short_copies():
    long = "Which factors explain the change of the gross margin that Acme Holdings reported for 2020?"
    assert is_copy(long, long.replace("Which", "What")) and is_copy(long, "For 2020, which factors explain the change of the gross margin that Acme Holdings reported?")
    assert is_copy("为何？", "为何") and is_copy("Why", "why?") and not is_copy("Why?", "So.")


def test_copy_threshold_lies_between_both_kinds():
    rng = np.random.default_rng(2)
    for low, high in ((0.12, 0.93), (0.2, 0.8)):
        shares = np.concatenate([rng.normal(low, 0.04, 300), rng.normal(high, 0.07, 20_000)])
        bins, counts = np.unique(np.floor(np.clip(shares, 0, 1.2) * 100).astype(int), return_counts=True)
        assert low + 0.1 < A.copy_threshold(bins, counts) < high - 0.2
    assert abs(A.copy_threshold(np.zeros(0, int), np.zeros(0)) - A.COPY_SHARE) < 0.02


@pytest.mark.parametrize("text", ["很抱歉，我无法回答这个问题。", "I'm sorry, but I can't answer this from the passages I was given.", "I'm sorry, but there is not enough information here for me to respond.", "I'm sorry, but the material at hand does not cover that point, so no answer is possible.", "Leider kann ich anhand der Unterlagen keine Auskunft geben.", "Désolé, aucune information ne porte sur ce point dans les documents.", "No puedo contestar con los fragmentos disponibles.", "申し訳ありませんが、そのご質問には回答を控えさせていただきます。"])
def test_refusals(text):
    assert A.refuses(text)


@pytest.mark.parametrize("text", ["材料未披露更早年度的口径，但可以确认以下数据。收入增长3%。", "由于设备检修，公司一度无法按期交付部分订单。", "Sorry for the earlier mix-up; the corrected figures follow. Revenue rose.", "The board can not sell the unit."])
def test_no_refusals(text):
    assert not A.refuses(text)


def test_refusals_no_list_has(spark):
    """The phrases of declining answers are counted; other wordings of the same words are found, in no dictionary."""
    heads = ["I'm sorry, but", "Sorry,", "Unfortunately,", "As a model,"]
    tails = ["I cannot answer this question.", "I have no information on that topic.", "I do not want to discuss this question here.", "I am not able to respond to that.", "no answer is possible here."]
    facts = ["Revenue rose by {} percent in the third quarter.", "The board approved plan {} for a second plant.", "Net debt of unit {} was broadly flat.", "Orders in the Gulf fell again in year {}."]
    rows = [(f"r{k}", f"{heads[k % 4]} {tails[k % 5]}" if k % 4 == 0 else facts[k % 4].format(k)) for k in range(2000)]
    model = learned(spark.createDataFrame(rows, "result_id string, answer string")).phrases
    for text in ("Sorry, no comment.", "I would not discuss that topic.", "As a model, I have no opinion on this."):
        assert not A.refuses(text) and A.refuses(text, model), text
    for text in ("Acme", "17 percent", "Net debt was broadly flat.", "The board did not approve the plant.", "Sorry, the corrected figure is 17."):
        assert not A.refuses(text, model), text


def test_languages():
    assert A.other_language("公司的收入是多少？", "The revenue of the company was lower than in the year before.")
    assert not A.other_language("公司的收入是多少？（请用英文作答）", "The revenue of the company was lower than in the year before.")
    assert not A.other_language("公司的收入是多少？（请用英文作答）", "公司的收入比上一年有所下降。")
    assert A.other_language("What was the revenue?", "取締役会は欧州で品質管理を見直すことを決めた。")
    assert not A.other_language("2019年に売上高はいくらですか？", "| 項目 | 2020 |\n| --- | --- |\n| 営業利益 | 818.03 |\n| 受注残高 | 170.39 |")
    assert not A.other_language("公司的收入是多少？", "12 million")


def test_contexts_agree():
    texts = ["In 2019 profit rose 20.5% here. Then", "ab", "", "收入增长。利润"]
    hashes, ends = A.all_contexts(texts)
    every = {int(h) for h in hashes[1]}
    for text in texts:
        if text:
            assert A.context_hashes(text)[1] in every
    assert len(ends) == len(hashes[0])


def corpus(seed=3):
    """Complete answers, a source cut at 60 characters, one cut in bytes; the truth is known."""
    rng = random.Random(seed)
    nouns, verbs, truth, rows = ["sales", "orders", "margins", "costs"], ["rose sharply", "fell again", "stayed flat"], set(), []
    for k in range(3000):
        text = " ".join(f"In {rng.randint(2000, 2024)} the {rng.choice(nouns)} of unit {rng.randint(1, 9)} {rng.choice(verbs)}." for _ in range(rng.randint(1, 4)))
        variant = ["free", "chars", "bytes"][k % 3]
        cut = text
        if variant == "chars":
            cut = text[:60]
        elif variant == "bytes":
            cut = text.encode()[:75].decode(errors="replace")
        elif rng.random() < 0.03:
            cut = text[: rng.randint(8, len(text) - 5)]
        if cut != text and not cut.rstrip().endswith(".") :
            truth.add(f"r{k}")
        rows.append((f"r{k}", variant, "What happened?", cut, None))
    return rows, truth


def test_truncation_and_limits(spark):
    rows, truth = corpus()
    frame = spark.createDataFrame(rows + rows[:50], SCHEMA)
    found = {r["result_id"] for r in truncation.broken_off(frame).collect()}
    assert len(found & truth) / len(truth) > 0.97 and len(found & truth) / len(found) > 0.97
    limits = {r["variant"]: (r["unit"], r["limit"]) for r in truncation.field_limits(truncation.answer_evidence(frame, False)).collect()}
    assert limits["chars"] == ("char", 60) and limits["bytes"][1] == 75 and "free" not in limits
    share = {r["variant"]: r for r in truncation.broken_off_share(frame).collect()}
    assert share["chars"]["answers"] == 1000 and share["chars"]["field_limit"] == 60


def of_source(rows):
    """The limits that answers of one source have: (text length, bytes, unclosed) each."""
    frame = pd.DataFrame(rows, columns=["n_chars", "n_bytes", "unclosed"]).groupby(["n_chars", "n_bytes"], as_index=False).agg(n=("unclosed", "size"), unclosed=("unclosed", "sum"))
    return [(r.unit, r.limit) for r in truncation._limits(frame.assign(variant="v")).itertuples()]


def natural(n, seed, wide=False):
    rng = np.random.default_rng(seed)
    lengths = np.maximum(np.round(np.exp(rng.normal(5, 0.5, n))), 2).astype(int)
    return [(k, k + 2 * int(rng.integers(0, k)) if wide else k, bool(rng.random() < 0.05)) for k in lengths.tolist()]


def test_no_limit_without_one():
    assert [of_source(natural(5000, seed, seed % 2 > 0)) for seed in range(6)] == [[]] * 6


def test_short_answers_without_a_mark_are_no_limit():
    amounts = [(k, k, True) for k, n in ((5, 45), (8, 6), (12, 35), (13, 9), (16, 43), (19, 7), (31, 19)) for _ in range(n)]
    assert of_source(natural(800, 4) + amounts) == []


@pytest.mark.parametrize(("rows", "limits"), [
    ([(110, 110, True)] * 300 + [(190, 190, True)] * 250, [("char", 110), ("char", 190)]),  # a limit that changed, longer answers above
    ([(130, 130, True)] * 260, [("char", 130)]),  # more answers above it than at it
    ([(230, 230, True)] * 40, [("char", 230)]),  # not among the commonest lengths
    ([(400, 400 + 2 * k % 300, True) for k in range(200)] + [(150 + k % 80, 450, True) for k in range(200)], [("byte", 450), ("char", 400)]),  # store and transfer
])
def test_every_limit_of_a_source(rows, limits):
    wide = len({b - c for c, b, _ in rows}) > 1
    assert sorted(of_source(natural(6000, 7, wide) + rows)) == sorted(limits)


def test_answers_at_every_limit(spark):
    rows, _ = corpus()
    free = [r for r in rows if r[1] == "free"]
    more = [(f"c{k}{at}", "two", "What happened?", ("In 2020 the sales of unit " + 9 * f"{k} went and saw " + "“")[: at - 1] + "“", None) for at in (70, 110) for k in range(100, 140)]
    frame = spark.createDataFrame([(k, "two", q, a, e) for k, _, q, a, e in free] + more, SCHEMA)
    assert {(r["unit"], r["limit"]) for r in truncation.field_limits(truncation.answer_evidence(frame, False)).collect()} == {("char", 70), ("char", 110)}
    judged = truncation.judged_endings(frame).where("result_id like 'c%'")
    assert judged.count() == len(more) and judged.where("at_limit and log_odds > 0").count() == len(more)
    assert sorted(truncation.broken_off_share(frame).first()["limits"]) == ["char 110", "char 70"]


def test_censored_fit_recovers_parameters():
    lengths = np.round(np.exp(np.random.default_rng(1).normal(4.5, 0.6, 20_000)))
    cut = np.minimum(lengths, 120)
    values, counts = np.unique(cut, return_counts=True)
    mean, dev = truncation._fit(values, counts.astype(float), 120)
    assert abs(mean - 4.5) < 0.03 and abs(dev - 0.6) < 0.03


def test_evidence_comes_from_the_limits():
    """Cells that cut answers fill speak for breaking off, those of whole sentences against it; without limits only what a context says itself."""
    rows = [(False, 0.99, cell_of(0, 50), 400), (False, 0.99, cell_of(3, 3), 40), (True, np.nan, cell_of(50, 0), 5000), (True, np.nan, cell_of(3, 3), 50), (False, np.nan, cell_of(0, 50), 30)]
    table = pd.DataFrame(rows, columns=["closed", "posterior", "cell", "n"])
    ratio = truncation.fit_evidence(table)
    assert ratio[cell_of(0, 50)] > 5 and ratio[cell_of(50, 0)] < -5 and 1 < ratio[cell_of(3, 3)] < 3.5
    alone = truncation.fit_evidence(table.assign(posterior=np.nan))
    assert alone[cell_of(0, 50)] < ratio[cell_of(0, 50)]
    assert len(ratio) == len(CELLS)


def test_rates_of_sources():
    ratio = np.array([-6.0, 6.0])
    assert truncation.fit_rate(np.array([0, 1]), np.array([900.0, 100.0]), ratio) == pytest.approx(0.1, abs=0.01)
    assert truncation.fit_rate(np.array([0]), np.array([100_000.0]), ratio) < 0.001
    assert truncation.fit_rate(np.zeros(0, int), np.zeros(0), ratio) == pytest.approx(truncation.BASE_RATE)


def test_defects(spark):
    question = "What was the revenue of Acme in 2020?"
    full = "The revenue of Acme was 17 million in the year 2020."
    rows = [
        ("empty", "v", question, None, "boom"), ("blank", "v", question, " ", None), ("copy", "v", question, question, None), ("refusal", "v", question, "I'm sorry, but I cannot answer this question.", "x"),
        ("language", "v", question, "Die Einnahmen der Gesellschaft lagen im Jahr 2020 bei 17 Millionen Euro.", None), ("json", "v", question, json.dumps({"a": full})[:30], None),
        ("good", "v", question, full, "judge failed"), ("short", "v", question, "17%", None), ("no question", None, None, full, None), ("long", "v", question, (full + " ") * 3000, None), ("good", "v", question, full, "judge failed"),
    ]
    found = {r["result_id"]: r["defect"] for r in pairs.defective_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {"empty": "empty", "blank": "empty", "copy": "copy", "refusal": "refusal", "language": "language", "json": "truncated"}


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert pairs.defective_pairs(frame).count() == 0 and truncation.broken_off(frame).count() == 0 and truncation.broken_off_share(frame).count() == 0


def test_context_counts_cover_all_answers(spark):
    """Contexts were counted over a sample; here every answer counts, once, and not as its own example."""
    from folioforge.llm import answers as A
    from folioforge.llm.endings import cell_column, counted_contexts, with_cells

    rows = [(f"r{k}", f"The margin rose in year {k % 7}. Costs fell") for k in range(300)] + [("r0", "The margin rose in year 0. Costs fell"), ("n", None)]
    results = spark.createDataFrame(rows, "result_id string, answer string").repartition(5)
    hashes = A.context_hashes("Costs fell")
    short = A.context_hashes("The margin rose")[0]
    wanted = spark.createDataFrame([(h,) for h in [hashes[0], short]], "h long")
    counts = {r["h"]: (r["ended"], r["went_on"]) for r in counted_contexts(results, wanted).collect()}
    assert counts[hashes[0]] == (300, 0) and counts[short] == (0, 300)
    evidence = spark.createDataFrame([("r1", 37, hashes), ("r2", 37, None), ("r3", 37, [1, 2, 3, 4]), ("r4", 9, [1, 2, 3, 4])], "result_id string, n_chars int, hashes array<long>")
    cells = {r["result_id"]: r["cell"] for r in with_cells(evidence, results).collect()}
    assert cells == {"r1": cell_of(299, 0), "r2": None, "r3": len(CELLS) - 1, "r4": len(CELLS) - 2}
    pairs = [(a, b) for a in (0, 1, 2, 3, 5, 30, 99) for b in (0, 1, 3, 9, 10, 31, 400) if a + b]
    frame = spark.createDataFrame(pairs, "a long, b long")
    assert all(r["c"] == cell_of(r["a"], r["b"]) for r in frame.select("a", "b", cell_column(frame["a"], frame["b"]).alias("c")).collect())


def test_contexts_cover_answers_of_16_million_characters(spark):
    """They were counted over some 12 million characters of the answers."""
    long = spark.range(4000).selectExpr("concat('l', id) as result_id", "repeat('Margins rose. ', 286) as answer")
    short = spark.range(31).selectExpr("concat('s', id) as result_id", "concat('Year ', id, ': costs fell') as answer")
    results = long.unionByName(short).selectExpr("result_id", "'v' as variant", "'How did the year go?' as question", "answer").repartition(4)
    cells = truncation.answer_evidence(results, False).where("result_id like 's%'").groupBy("cell").count().collect()
    assert [tuple(r) for r in cells] == [(cell_of(30, 0), 31)]


def test_phrases_cover_all_answers(spark):
    """They were counted over some 2 million characters of the answers."""
    rows = [(f"r{k}", "zebra " + "lorem ipsum dolor " * 120 + str(k)) for k in range(1500)]
    phrases = learned(spark.createDataFrame(rows, "result_id string, answer string")).phrases
    assert phrases.declining + phrases.other == 1500
