import itertools

from folioforge.llm import visual
from folioforge.llm.visual import readable_form, visual_form

SAME = [
    ("Ａｂｃ　１２", "Abc 12"), ("été", "été"), ("a​b­c﻿", "abc"), ("a b c", "a b c"), ("ﬁn", "fin"),
    ("Аррlе", "Apple"), ("⼀⼤", "一大"), ("金", "金"), ("a\r\nb  \n", "a\nb\n"), ("ニ", "二"), ("ｶﾞ", "ガ"), ("한", "한"),
]
OTHER = [("x²", "x2"), ("①", "1"), ("Abc", "abc"), ("a b", "ab"), ("a  b", "a b"), ("10", "11"), ("½", "1/2")]


def test_same_and_other_looks():
    for a, b in SAME:
        assert visual_form(a) == visual_form(b), (a, b)
    for a, b in OTHER:
        assert visual_form(a) != visual_form(b), (a, b)
    assert visual_form(None) is None and visual_form("​ ") == "" and visual_form("STRASSE", True) == visual_form("straße", True)


def test_form_is_stable():
    for text in [x for pair in SAME + OTHER for x in pair]:
        assert visual_form(visual_form(text)) == visual_form(text)


def test_pairs_against_brute_force(spark):
    texts = [x for pair in SAME for x in pair] + ["Abc 12", None, "", " ", "", "x" * 100_000, "x" * 100_000 + "​"]
    rows = [(f"k{i:02d}", t, "clash") for i, t in enumerate(texts)] + [("k00", texts[0], "clash")]
    frame = spark.createDataFrame(rows, "id string, question string, v string")
    found = [tuple(r) for r in visual.same_look_pairs(frame, "id", "question").collect()]
    known = {r[0]: r[1] for r in rows if r[1] is not None}
    wanted = [(a, b) for a, b in itertools.combinations(sorted(known), 2) if known[a] != known[b] and visual_form(known[a]) == visual_form(known[b])]
    assert sorted(found) == wanted


def test_empty_table(spark):
    frame = spark.createDataFrame([], "id string, question string")
    assert visual.same_look_pairs(frame, "id", "question").count() == 0
    assert visual.with_visual_form(frame, "question", "form").columns == ["id", "question", "form"]


def test_readable_form_keeps_scripts():
    assert [readable_form(t) for t in ("カタログ", "Москва", "Аррlе", "Ａｂｃ　é\u200b", None)] == ["カタログ", "Москва", "Apple", "Abc é", None]
    for a, b in SAME:
        assert visual_form(readable_form(a)) == visual_form(a) and visual_form(readable_form(b)) == visual_form(a)


def test_classes_against_brute_force(spark):
    texts = ["Abc", "Ａbc", "Abc", "Аbc", "other", None, "", "\u200b"]
    frame = spark.createDataFrame([(f"k{k}", t) for k, t in enumerate(texts)] + [("k0", "Abc")], "id string, question string")
    found = {r["member"]: (r["class"], r["links"]) for r in visual.look_classes(frame, "id", "question").collect()}
    assert found == {"k0": ("k0", 2), "k1": ("k0", 3), "k2": ("k0", 2), "k3": ("k0", 3), "k4": ("k4", 0), "k6": ("k6", 1), "k7": ("k6", 1)}
    assert visual.look_classes(frame.limit(0), "id", "question").count() == 0
