"""Splitting, repeated lines, encoding, packing, percentiles and languages."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.llm import encoding, language, lines, packing, percentiles, splitting

PROFILES = [("small", 40, 8), ("large", 200, 20)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 。.\n,中́", max_size=300), st.integers(10, 60), st.integers(0, 8))
def test_pieces_cover_the_text(text, size, overlap):
    places, depths = splitting.boundaries(text)
    pieces = splitting.split(text, size, overlap, places, depths)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(end - start <= size for start, end, _ in pieces)
    assert all(b[0] == a[1] - overlap for a, b in zip(pieces, pieces[1:]))


def test_cuts_at_the_topic_change():
    text = "".join(f"apples and pears are sweet fruit number {k}. " for k in range(6)) + "".join(f"GPUs multiply big matrices with tensor cores {k}. " for k in range(6))
    places, depths = splitting.boundaries(text)
    pieces = splitting.split(text, 360, 0, places, depths)
    assert text[pieces[0][1] :].startswith("GPUs")


def test_split_corpus(spark):
    rows = [("a", "x" * 100, 1), ("b", None, 1), ("c", "", 1), ("d", "short", 1), ("e", "word " * 60, 1), ("e", "word " * 60, 1), ("f", "Eins. " * 20000, 1)]
    frame = spark.createDataFrame(rows, "load_id string, content string, profile int")
    found = {(r["load_id"], r["profile"]): r["forced"] for r in splitting.oversized(frame, PROFILES).collect()}
    assert found == {("a", "small"): 1, ("e", "small"): 0, ("e", "large"): 0, ("f", "small"): 0, ("f", "large"): 0}
    pieces = splitting.split_corpus(frame, PROFILES).where("load_id = 'a' and profile = 'small'").orderBy("piece_no").collect()
    assert {p["cut"] for p in pieces[:-1]} == {"forced"} and all(p["text"] == "x" * p["length"] for p in pieces)
    assert splitting.split_corpus(frame, PROFILES).where("load_id = 'c'").select("length").distinct().count() == 1
    assert splitting.oversized(frame.limit(0), PROFILES).count() == 0
    with pytest.raises(ValueError):
        splitting.split("abc", 2, 2, *splitting.boundaries("abc"))


def test_repeated_lines_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        body = [rng.choice(["Legal notice 2020", "Legal  notice １９", "# Heading", "| row |", "", f"own line {chr(97 + k % 26)}{chr(97 + k // 26)}", "share this"]) for _ in range(6)]
        rows.append((f"d{k}", f"{'Big' if k < 50 else 'Ｂig' if k < 54 else 'Tiny'}_2020_x", "\n".join(body) if k % 9 else None))
    rows += rows[:3] + [("null", None, "Legal notice 1"), ("empty", "Big_1", "")]
    frame = spark.createDataFrame(rows, "load_id string, name string, content string").withColumn("source", F.lit("clash"))
    docs = {r[0]: r for r in rows}
    source = {k: ("" if r[1] is None else "Tiny" if r[1].startswith("Tiny") else "Big") for k, r in docs.items()}
    held: dict = {}
    for key, (_, _, content) in docs.items():
        for line in (content or "").split("\n"):
            if lines.line_form(line):
                held.setdefault((source[key], lines.line_form(line)), set()).add(key)
    sizes = {s: sum(v == s for v in source.values()) for s in set(source.values())}
    often = {k for k, v in held.items() if len(v) >= 5 and len(v) >= 0.2 * sizes[k[0]]}
    wanted = {(key, n) for key, r in docs.items() for n, line in enumerate((r[2] or "").split("\n"), 1) if (source[key], lines.line_form(line)) in often}
    found = [(r["load_id"], r["line_no"]) for r in lines.repeated_lines(frame).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted and wanted
    cleaned = {r["load_id"]: r["cleaned"] for r in lines.without_repeated_lines(frame).collect()}
    for key, r in docs.items():
        kept = None if r[2] is None else "\n".join(x for n, x in enumerate(r[2].split("\n"), 1) if (key, n) not in wanted)
        assert cleaned[key] == kept
    assert lines.repeated_lines(frame.limit(0)).count() == 0


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


TEXTS = ["", "a", "don't stop 'll  now\n\n x", "中文，混合 text 12345 ！！ 🤖👩🏽‍💼", "<|endoftext|> plain", "x" * 5000, " " * 3000, "'" * 700, "\n\t " * 900 + "end", "ﷺ한글 ½ ٣٤ ①"]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sl ltve \n\t1２中。!½é🤖")), max_size=400), st.integers(1, 60))
def test_tree_equals_whole(text, leaf):
    encode = encoding.load("byte_bpe_50k").encode_ordinary
    assert encoding.encode_tree(encode, text, leaf) == encode(text)


def test_encoding_equals_the_public_tokenizer(spark, reference):
    texts = TEXTS + ["".join(random.Random(k).choice(TEXTS[2] + TEXTS[3] + TEXTS[9]) for _ in range(40_000)) for k in range(3)]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] + [(99, None, "clash")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = {r["doc_id"]: r["ids"] for r in encoding.encode_corpus(frame).collect()}
    assert found[99] == [] and len(found) == len(rows)
    for k, text in enumerate(texts):
        assert found[k] == reference(text)
    back = {r["doc_id"]: r["text"] for r in encoding.decode_corpus(encoding.encode_corpus(frame)).collect()}
    assert all(back[k] == t for k, t in enumerate(texts))
    counts = {r["doc_id"]: r["n_tokens"] for r in encoding.token_counts(frame).collect()}
    assert all(counts[k] == len(found[k]) for k in found)
    assert encoding.encode_corpus(frame.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 90), max_size=60), st.integers(5, 40))
def test_packing_keeps_everything(sizes, capacity):
    rows = packing.pack(np.array(sizes, dtype=np.int64), capacity)
    used: dict = {}
    for item, part, tokens, container, offset in rows:
        assert offset == used.get(container, 0) or tokens == 0
        used[container] = used.get(container, 0) + tokens
        assert sizes[item] > capacity or part == 0
    assert all(v <= capacity for v in used.values())
    for item, size in enumerate(sizes):
        assert sum(r[2] for r in rows if r[0] == item) == size


def test_packing_is_full_and_balanced(spark):
    rng = random.Random(1)
    rows = [(k, min(int(rng.lognormvariate(4.5, 1)), 3000)) for k in range(5000)] + [(9998, None), (9999, 0)]
    packed = packing.pack_corpus(spark.createDataFrame(rows, "doc_id long, n_tokens long"), [("a", 1024), ("b", 4096)])
    fill = {r["profile"]: r for r in packing.container_fill(packed).collect()}
    total = sum(n or 0 for _, n in rows)
    for profile, capacity in (("a", 1024), ("b", 4096)):
        assert fill[profile]["tokens"] == total and fill[profile]["fullest"] <= capacity
        assert total / (fill[profile]["containers"] * capacity) > 0.99
    assert packed.where("doc_id in (9998, 9999)").count() == 4
    assert packing.pack_corpus(spark.createDataFrame([], "doc_id long, n_tokens long"), [("a", 10)]).count() == 0


def test_codes_keep_order_and_ranges():
    values = np.unique(np.concatenate([np.arange(9000), 2 ** np.arange(1, 63), 2 ** np.arange(1, 63) - 1, [2**63 - 1]])).astype(np.int64)
    values = np.concatenate([-1 - values[::-1], values])
    codes = percentiles.code_of_array(values)
    assert (np.diff(codes) >= 0).all() and codes.min() >= 0 and codes.max() < 1 << percentiles.LEVELS
    assert (np.diff(codes[(values > -8193) & (values < 8192)]) == 1).all()


def test_negative_values_and_kept_summaries(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(0, 5000, 30_000).astype(int)
    frame = spark.createDataFrame([(k, "a" if k % 3 else None, k % 5, int(v)) for k, v in enumerate(values)] * 2, "record_id long, category string, day int, tokens long")
    merged = percentiles.merge(percentiles.parts(frame, ["category", "day"], ["tokens"], "record_id", ["category"]), ["category"])
    answers = percentiles.quantiles(merged, ["category"], [0.0, 0.05, 0.5, 1.0])
    checked = percentiles.rank_check(frame, answers, ["category"], ["tokens"], "record_id").collect()
    assert len(checked) == 8 and all(r["within"] for r in checked) and {r["n_values"] for r in checked} == {10_000, 20_000}
    least = answers.where("category is null and share = 0").first()
    assert least["low"] <= min(values[::3]) <= least["high"] < 0
    kept = percentiles.compacted(merged, ["category"], 0.05)
    assert kept.groupBy("category").agg(F.sum("n").alias("n")).select("n").distinct().count() == 2
    assert kept.groupBy("category").count().agg(F.max("count")).first()[0] <= 3 * percentiles.LEVELS / 0.05


def test_repeated_lines_of_broken_numbers():
    assert lines.line_form("更新日期:20 23年4月") == lines.line_form("更新日期：2023年 12月") == "更新日期:0年0月"


def test_decoding_up_the_tree():
    encoding_ = encoding.load("byte_bpe_50k")
    for text in ("", "a", "Zürich 中文 🙂 " * 500):
        ids = encoding_.encode_ordinary(text)
        assert encoding.decode_tree(encoding_.decode_bytes, ids, 7) == text.encode()


def test_valley_at_a_planted_seam(spark):
    rng = np.random.default_rng(5)
    topics = [[f"{head}{k}word" for k in "abcdefgh"] for head in ("river", "engine", "garden", "market", "planet", "winter")]
    texts = [(k, " ".join("The " + " ".join(rng.choice(topics[k], 4)) + " was seen again." for _ in range(25)), "en") for k in range(6)]
    texts += [(9, None, "en"), (10, "short", "en"), (11, texts[0][1], None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, named string")
    row = splitting.seam_recall(frame, "doc_id", "text", "named").collect()
    assert [(r["named"], r["pairs"], r["found"]) for r in row] == [("en", 3, 3)] and row[0]["by_chance"] < 0.5
    assert splitting.seam_recall(frame.limit(0), "doc_id", "text", "named").count() == 0


def test_texts_in_no_known_language():
    model = language.train([text for _, text, _ in labelled()], [lang for _, _, lang in labelled()])
    others = [
        "Il consiglio di amministrazione della società ha approvato il bilancio e la direzione ritiene che le vendite torneranno a crescere.",
        "De raad van bestuur van de onderneming heeft het plan goedgekeurd en de directie verwacht dat de omzet weer zal stijgen.",
        "Совет директоров компании одобрил план, и руководство считает, что продажи снова вырастут в следующем году.",
        "회사의 이사회는 계획을 승인했으며 경영진은 내년에 매출이 다시 증가할 것으로 보고 있다.",
        "Hội đồng quản trị của công ty đã thông qua kế hoạch và ban giám đốc cho rằng doanh thu sẽ tăng trở lại vào năm tới.",
    ]
    assert [x for x in language.judge(others, model)[3] if x] == []
    assert [list(x) for x in language.judge([*SENTENCES.values()], model)[3]] == [[k] for k in SENTENCES]


def test_percentiles_within_the_bound(spark):
    rng = np.random.default_rng(2)
    n = 60_000
    values = np.where(rng.random(n) < 0.3, 4096, rng.lognormal(6, 2, n)).astype(int)
    data = [(k, "hot" if k % 3 else ("cold" if k % 2 else None), int(v) if k % 50 else None, 1) for k, v in enumerate(values)]
    frame = spark.createDataFrame(data + data[:500], "record_id long, category string, tokens long, node long")
    shares = [0.0, 0.01, 0.5, 0.9, 0.999, 1.0]
    found = percentiles.quantiles(percentiles.digests(frame, ["category"], ["tokens"], "record_id", 0.01), ["category"], shares, 0.01).collect()
    assert len(found) == 3 * len(shares)
    for row in found:
        own = np.sort([v for _, c, v, _ in data if c == row["category"] and v is not None])
        assert row["values"] == len(own)
        rank = max(1, int(np.ceil(row["share"] * len(own))))
        least, most = np.searchsorted(own, row["low"], "left") + 1, np.searchsorted(own, row["high"], "right")
        assert least - row["rank_error"] <= rank <= most + row["rank_error"]
        assert row["low"] <= row["estimate"] <= row["high"]


def test_digests_of_days_combine(spark):
    frame = spark.createDataFrame([(k, "c", k % 4, k) for k in range(4000)], "record_id long, category string, day int, tokens long")
    daily = percentiles.digests(frame, ["category", "day"], ["tokens"], "record_id", 0.05)
    merged = percentiles.quantiles(percentiles.merge(daily, ["category"]), ["category"], [0.5], 0.05).first()
    assert abs(merged["estimate"] - 2000) <= 0.05 * 4000 + 1 and merged["values"] == 4000
    assert percentiles.digests(frame.limit(0), ["category"], ["tokens"], "record_id").count() == 0


def test_compressed_size_is_bounded():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << percentiles.LEVELS, 200_000) + (1 << percentiles.LEVELS)
    groups = np.zeros(200_000, dtype=np.int64)
    g, nodes, counts = percentiles.compress(groups, codes, np.ones(200_000, dtype=np.int64), 0.01)
    assert counts.sum() == 200_000 and len(nodes) <= 3 * percentiles.LEVELS / 0.01


SENTENCES = {
    "en": "The board of the company approved the plan, and management said that sales would rise again next year.",
    "de": "Der Vorstand der Gesellschaft hat dem Plan zugestimmt, und die Umsätze sollen im nächsten Jahr wieder steigen.",
    "fr": "Le conseil de la société a approuvé le projet et la direction pense que les ventes vont encore progresser.",
    "es": "El consejo de la compañía aprobó la propuesta y la dirección cree que las ventas volverán a crecer este año.",
    "pt": "O conselho da empresa aprovou a proposta e a administração acredita que as vendas não vão cair neste ano.",
    "zh": "公司董事会审议通过了该方案，管理层表示明年的销售收入将继续增长。",
    "ja": "取締役会はその計画を承認し、来年も売上が増えるとの見通しを示しました。",
}


def labelled():
    rows = []
    for n in range(12):
        for lang, text in SENTENCES.items():
            words = text.split(" ") if " " in text else list(text)
            random.Random(n).shuffle(words) if n % 3 == 2 else None
            rows.append((len(rows), text if n % 3 < 2 else (" " if " " in text else "").join(words), lang))
    return rows


def test_languages(spark):
    rows = labelled()
    s = SENTENCES
    cases = [
        (1000, s["de"], "de-AT"), (1001, s["de"], "EN"), (1002, s["fr"], None), (1003, f"{s['en']} {s['en']}\n{s['ja']}{s['ja']}", "en"), (1004, f"{s['en']} {s['en']} {s['en']}\n{s['ja']}", "eng"),
        (1005, None, "zz"), (1006, "", None), (1007, "12.5\t3%", "en"), (1008, s["zh"], "中文"), (1009, s["pt"] + " " + s["pt"], "spa"), (1010, f"{s['zh']}\nl'endettement net / le chiffre", "zh"), (1011, (s["es"] + " ") * 2000, "Spanish"),
    ]
    frame = spark.createDataFrame(rows + cases, "doc_id long, text string, lang string").withColumn("label", F.lit("clash"))
    found = sorted((r["doc_id"], r["lang"]) for r in language.mislabelled(frame).where("doc_id >= 1000").collect())
    assert found == [(1001, "de"), (1002, "fr"), (1003, "en"), (1003, "ja"), (1009, "pt")]
    segments = [(r["lang"], r["start"], r["length"]) for r in language.language_segments(frame).where("doc_id = 1003").orderBy("segment").collect()]
    assert [x[0] for x in segments] == ["en", "ja"] and segments[0][1] == 0 and segments[1][1] == segments[0][2] + 1 and segments[1][1] + segments[1][2] == len(cases[3][1])
    assert language.mislabelled(frame.limit(0)).count() == 0


@pytest.mark.parametrize("gap", ["\t", "\x0b", "\x0c", "\x85", "\xa0", "\u1680", "\u2002", "\u2005", "\u2007", "\u2009", "\u200a", "\u2028", "\u202f", "\u205f", "\u3000"])
def test_sentences_end_before_every_white_space(gap):
    ranks = language.train([text for _, text, _ in labelled()], [lang for _, _, lang in labelled()])
    s = SENTENCES
    plain, spaced = (f"{s['en']}{x}{s['en']}{x}{s['en']}\n{s['de']}{x}{s['de'][:-1]}!{x}{s['ja']}" for x in (" ", gap))
    (a, a_langs, _, a_found), (b, b_langs, _, b_found) = (language.judge([t], ranks) for t in (plain, spaced))
    assert b.start.tolist() == a.start.tolist() and b_langs.tolist() == a_langs.tolist()
    assert list(b_found[0]) == list(a_found[0]) == ["en", "de"]


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = language.document_languages(documents).withColumn("named", language.label_language()(F.col("label")))
    rated = judged.where("named is not null and size(langs) = 1").agg(F.avg((F.col("langs")[0] == F.col("named")).cast("double"))).first()[0]
    assert rated > 0.9
