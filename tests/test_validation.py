import difflib
import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import layout, parsing, validation


def test_contained_against_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefghij klm\n") for _ in range(rng.randint(80, 1500))) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, "head " * 30 + t + " tail" * 20) for k, t in enumerate(base[:5])] + [(200, base[1]), (201, base[1] + "\n"), (202, None), (203, ""), (204, "boiler " * 40), (205, "boiler " * 90)]
    frame = spark.createDataFrame(rows + rows[:2], "k long, t string")
    bare: dict = {}
    for k, t in rows:
        if t and "".join(t.split()):
            bare.setdefault("".join(t.split()), []).append(k)
    reps = {min(v): b for b, v in bare.items()}

    def samples(b):
        return b[:500], b[len(b) // 2 : len(b) // 2 + 500], b[-500:]

    wanted = {(i, o) for i, a in reps.items() for o, b in reps.items() if i != o and len(a) >= 100 and (len(b), ) >= (len(a), ) and (len(b) > len(a) or i < o) and all(s in b for s in samples(a))}
    found = {tuple(r) for r in validation.contained_documents(frame, "k", "t").collect()}
    assert found == wanted and len(wanted) >= 5
    classes = {r["member"]: r["class"] for r in validation.text_classes(frame, "k", "t").collect()}
    assert classes[200] == classes[201] == 1
    assert validation.contained_documents(frame.limit(0), "k", "t").count() == 0


def test_fuzzy_find():
    assert validation.fuzzy_find("abc", "xxabcxx") == (True, 2, 1.0)
    assert validation.fuzzy_find("", "x") == (False, None, 0.0) and validation.fuzzy_find("abc", None)[0] is False
    found, at, score = validation.fuzzy_find("the quick brown fox jumps", "so it is that the quikc brown fox jumps high")
    assert found and at == 14 and score > 0.9
    assert not validation.fuzzy_find("the quick brown fox", "something entirely different here")[0]


def test_fuzzy_find_refines_around_each_window():
    # The first place is on the coarse grid and nearly right; the second, off the grid, is right but for a blank.
    quote = "the quick brown fox jumps over the lazy dog near the river bank"
    near, right = quote.replace("lazy", "lamb"), quote.replace(" ", "\n", 1)
    for shift in range(12):
        text = near + "." * (30 + shift) + right + "." * 40
        assert validation.fuzzy_find(quote, text) == (True, len(near) + 30 + shift, 1.0)


def test_located_chunks(spark):
    chunks = spark.createDataFrame([("d", 1, "c1", "alpha beta gamma delta"), ("d", 1, "c2", "other text altogether"), ("d", 2, "c3", "alpha beta gamma delta")], "doc string, page_number int, chunk_id string, text string")
    quotes = spark.createDataFrame([("exact", "d", [1], "beta gamma"), ("none", "d", [1], "zzzzzzzzzz"), ("blank", "d", [2], None)], "id string, doc string, pages array<int>, quote string")
    found = sorted((r["id"], r["chunk_id"], r["exact"]) for r in validation.located_chunks(quotes, chunks, "id", "doc").collect())
    assert found == [("blank", "c3", False), ("exact", "c1", True), ("none", "c1", False), ("none", "c2", False)]


def test_unit_errors(spark):
    frame = spark.createDataFrame([("收入 12.5 亿元", "共 1,250,000,000 元"), ("收入 125 亿元", "共 1250000000 元"), ("收入 1.25 亿", "共 1250000000 元"), (None, "x"), ("收入 125 亿元", None)], "a string, e string")
    assert [len(r[0] or []) for r in frame.select(validation.unit_errors(F.col("a"), F.col("e"))).collect()] == [0, 1, 1, 0, 0]


def test_cut_answer(spark):
    frame = spark.createDataFrame([("一二三四五六。八九十",), ("一。三四五六七八九十",), ("短",), (None,)], "a string")
    assert [r[0] for r in frame.select(validation.cut_answer(F.col("a"), 9)).collect()] == ["一二三四五六。", "一。三四五六七八九", "短", None]


def test_page_markdown(spark):
    schema = "page int, x0 double, y0 double, x1 double, y1 double, text string, font_size double, is_bold boolean, page_width double, page_height double"
    left = [(1, 50.0, 100.0 + 50 * k, 250.0, 140.0 + 50 * k, f"left {k} " + "x" * 10, 10.0, False, 600.0, 800.0) for k in range(3)]
    right = [(1, 350.0, 110.0 + 50 * k, 550.0, 150.0 + 50 * k, f"right {k}", 10.0, False, 600.0, 800.0) for k in range(3)]
    rows = [*left, *right, (1, 50.0, 90.0, 250.0, 99.0, "Title", 18.0, True, 600.0, 800.0), (1, 50.0, 5.0, 250.0, 20.0, "header", 9.0, False, 600.0, 800.0), (1, 50.0, 400.0, 90.0, 420.0, " 12 / 30 ", 9.0, False, 600.0, 800.0)]
    text = layout.page_markdown(spark.createDataFrame(rows[::-1], schema), ["page"]).first()["text"]
    assert text.split("\n\n") == ["# Title", *(r[5] for r in left), *(r[5] for r in right)]


def test_cells_markdown(spark):
    frame = spark.createDataFrame([([["a", None], ["b\nc", "d"], ["", ""]],), ([["h1", "h2", "h3", "h4"], ["x", "", "", ""], ["1", "2", "3", None]],), ([],)], "t array<array<string>>")
    got = [r[0] for r in frame.select(layout.cells_markdown(F.col("t"))).collect()]
    assert got == ["| a |  |\n| --- | --- |\n| b c | d |", "| h1 | h2 | h3 | h4 |\n| --- | --- | --- | --- |\n| 1 | 2 | 3 |  |", ""]


def test_replaced_tables(spark):
    lines = parsing.lines(spark.createDataFrame([(1, "intro\n| a |\n|---|\n| 1 |\noutro")], "page int, text string"), "page", "text")
    old = spark.createDataFrame([(1, 1, 2, 4, 1, 0.5, 0.0)], "page int, table_no int, first_line int, last_line int, data_rows int, empty_ratio double, merged_ratio double")
    new = spark.createDataFrame([(1, 1, "NEW", 3, 0.0, 0.0), (1, 2, "EXTRA", 2, 0.0, 0.0)], "page int, table_no int, text string, data_rows int, empty_ratio double, merged_ratio double")
    assert layout.replaced_tables(lines, old, new, "page").first()["text"] == "intro\nNEW\noutro\n\nEXTRA"
    assert layout.replaced_tables(lines, old, new, "page", "never_replace").first()["text"] == "intro\n| a |\n|---|\n| 1 |\noutro"


def like_every_window(quote, text, least=0.85):
    """(found, position, similarity) by comparing every window in turn."""
    if not quote or not text:
        return False, None, 0.0
    if quote in text:
        return True, text.index(quote), 1.0
    size, step, best, at = len(quote), max(1, len(quote) // 10), 0.0, None
    ratio = lambda k: difflib.SequenceMatcher(None, " ".join(quote.split()), " ".join(text[k : k + size].split())).ratio()
    for coarse in range(0, len(text) - size + 1, step):
        fine = range(max(0, coarse - step), min(len(text) - size + 1, coarse + step)) if ratio(coarse) >= least else ()
        for k in (coarse, *fine):
            if ratio(k) > best:
                best, at = ratio(k), k
    return best >= least, at if best >= least else None, best


def test_fuzzy_find_against_every_window():
    rng = random.Random(1)
    words = "收入增长 利润下降\n the cost rose in 2020, 12.5% of sales 公司 董事会 fell ".split(" ")
    for _ in range(120):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))
        start = rng.randint(0, max(len(text) - 40, 0))
        share = rng.choice([0.02, 0.1, 0.3])
        quote = "".join(rng.choice("xyz 好\n") if rng.random() < share else c for c in text[start : start + rng.randint(3, 60)])
        assert validation.fuzzy_find(quote, text) == pytest.approx(like_every_window(quote, text))
