"""Accounting, test sets, snapshots, traces, sources and streams on small tables."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import accounting, snapshots, testsets, traces
from folioforge.operators.ordering import numbered, running
from folioforge.sources import files
from folioforge.sources.vectors import Collection
from folioforge.streaming import accounting as streams


def test_numbers_run_without_gaps(spark):
    frame = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    assert [r["n"] for r in numbered(frame, ["k"], "n").orderBy("k").collect()] == list(range(1000))


def test_running_sums_within_groups(spark):
    rows = [("a" if k % 3 else None, k, k % 5) for k in range(500)]
    frame = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    sums: dict = {}
    wanted = {}
    for g, k, v in rows:
        sums[g] = sums.get(g, 0) + v
        wanted[k] = sums[g]
    assert {r["k"]: r["s"] for r in running(frame, ["g"], ["k"], F.col("v"), "s").collect()} == wanted
    assert {r["k"]: r["n"] for r in numbered(frame, ["k"], "n", ["g"]).collect()} == {k: sum(1 for h, j, _ in rows if h == g and j < k) for g, k, _ in rows}


def test_largest_remainder_adds_up(spark):
    frame = spark.createDataFrame([("s", "a", 1, 10), ("s", "b", 1, 10), ("s", "c", 1, 10), ("z", "a", 0, 5), ("z", "b", 0, 5)], "s string, t string, w int, total int")
    got = {(r["s"], r["t"]): r["allotted"] for r in testsets.largest_remainder(frame, "s", "t", "w", "total").collect()}
    assert got == {("s", "a"): 4, ("s", "b"): 3, ("s", "c"): 3, ("z", "a"): 2, ("z", "b"): 2}


def shared_out(sizes, total, tiers):
    """Shares of (name, kilobytes) as the survey states them, one member after another."""
    mass = sum(kb for _, kb in sizes)
    ranked = sorted(sizes, key=lambda x: (-x[1], x[0]))
    caps = {name: next(most for least, most in tiers if kb >= least) for name, kb in sizes}
    share = {name: min(kb / mass * total, caps[name]) for name, kb in sizes}
    room = [name for name, _ in ranked if share[name] < caps[name]]
    over = total - sum(share.values())
    for turn in range(3 * total + 1 if room else 0):
        if over <= 0.01:
            break
        name = room[turn % len(room)]
        more = min(over, caps[name] - share[name], 1.0)
        if more > 0.01:
            share[name], over = share[name] + more, over - more
    whole = {name: round(x) for name, x in share.items()}
    lacking = total - sum(whole.values())
    for turn in range(abs(lacking)):
        name = ranked[turn % len(ranked)][0]
        whole[name] = max(whole[name] + (1 if lacking > 0 else -1), 0)
    return whole


def test_capped_shares_against_the_sequence(spark):
    rng = random.Random(5)
    groups = {f"g{k}": [(f"d{i:03d}", rng.choice([0.0, 0.1, 1.3, 2.5, 2.5, 6.0, 9.5, 40.0])) for i in range(n)] for k, n in enumerate((1, 3, 12, 60, 150))}
    tiers = ((8.0, 5), (3.0, 3), (0.0, 1))
    rows = [(g, name, kb) for g, members in groups.items() for name, kb in members] + [("empty", "x", 0.0)]
    frame = spark.createDataFrame(rows, "f string, d string, kb double").repartition(3)
    got = {(r["f"], r["d"]): r["allotted"] for r in testsets.capped_shares(frame, "f", "d", "kb", 20, tiers).collect()}
    assert got == {(g, name): n for g, members in groups.items() if sum(kb for _, kb in members) for name, n in shared_out(members, 20, tiers).items()}


def test_type_allotments():
    assert testsets.type_allotments(3, {"a": 0.45, "b": 0.35, "c": 0.2}) == {"a": 1, "b": 1, "c": 1}
    assert all(sum(testsets.type_allotments(n, {"a": 0.45, "b": 0.35, "c": 0.2}).values()) == n for n in range(40))


def kept_in_order(rows):
    kept = []
    for key, text, files in sorted(rows, key=lambda r: r[0]):
        t, f = (text or "").strip().lower(), set(files or [])

        def like(a, b):
            if a == b:
                return True
            shorter, longer = (a, b) if len(a) < len(b) else (b, a)
            return len(longer) > 0 and sum(c in longer for c in shorter) / len(longer) >= 0.85

        if not any(f & g and like(t, u) for _, u, g in kept):
            kept.append((key, t, f))
    return {k for k, _, _ in kept}


def test_greedy_unique_against_the_sequence(spark):
    rng = random.Random(3)
    words = "what was the revenue margin of acme beta gamma in 2019 2020 and why 公司 收入 利润".split()
    rows = [(f"q{k:03d}", rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 6)))]) if k % 9 == 0 else " ".join(rng.choices(words, k=rng.randint(2, 5))), rng.choice([None, [], ["a"], ["a", "b"], ["b", "c"], ["hot"], ["hot", "d"]])) for k in range(300)]
    frame = spark.createDataFrame(rows, "id string, q string, f array<string>").withColumn("k", F.lit("clash"))
    got = {r["id"] for r in testsets.greedy_unique(frame, "id", "q", "f").where("kept").collect()}
    assert got == kept_in_order(rows)
    assert testsets.greedy_unique(frame.limit(0), "id", "q", "f").count() == 0


def test_excerpt(spark):
    frame = spark.createDataFrame([("a b", "xx ab"), ("abcdefghijklmnopqrst", "0fghijklmnopqrst0hijklmnopqrstuv"), ("", "x"), ("zz", "y")], "e string, d string")
    assert [r[0] for r in frame.select(testsets.excerpt_found(F.col("e"), F.col("d"))).collect()] == [True, False, False, False]


def test_data_id_ignores_order(spark):
    rows = [("s", "b" * 64), ("s", "a" * 64)]
    ids = {snapshots.data_ids(spark.createDataFrame(r, "s string, sha string"), "s", "sha").first()["data_id"] for r in (rows, rows[::-1])}
    assert len(ids) == 1


def test_configs():
    assert snapshots.config_hash({"a": 1, "b": 2}) == snapshots.config_hash({"b": 2, "a": 1})
    assert snapshots.deep_merge({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}}) == {"a": {"x": 1, "y": 3}}
    assert snapshots.masked({"api_key": "s", "n": [{"password": "p"}]}) == {"api_key": "***", "n": [{"password": "***"}]}


def test_equivalence_groups(spark):
    frame = spark.createDataFrame([("a/x.pdf",), ("a/x_摘要.pdf",), ("b/x.pdf",)], "path string")
    assert [tuple(r) for r in snapshots.equivalence_groups(frame, "path").collect()] == [("a/x", ["a/x.pdf", "a/x_摘要.pdf"])]


def test_chat_turns(spark):
    frame = spark.createDataFrame([("c", 1, "assistant", "hi"), ("c", 2, "user", "a"), ("c", 3, "user", "b"), ("c", 4, "system", "s"), ("c", 5, "assistant", " ")], "c string, t int, role string, text string")
    assert [(r["role"], r["text"]) for r in traces.chat_turns(frame, "c", "t", "role", "text").orderBy("turn_no").collect()] == [("user", "a\nb"), ("assistant", "hi")]


def test_root_causes(spark):
    schema = "id string, question string, truth array<string>, truth_answer string, retrieved array<string>, reranked array<string>, context_input array<string>, context_count long, rewritten array<string>, answer string"
    rows = [
        ("no truth", "q", [], "x", ["a"], None, None, None, None, "x", "RC-1"),
        ("missed", "q", ["t"], "x", ["a", "b"], None, None, None, ["q"], "x", "RC-1"),
        ("mismatch", "q", ["t"], "x", ["a", "b"], None, None, None, ["other"], "x", "RC-5"),
        ("dropped", "q", ["t"], "x", ["a", "b", "t"], None, ["a", "t"], 2, None, "x", "RC-3"),
        ("low in rerank", "q", ["t"], "x", ["t"], ["a", "b", "c", "t"], None, None, None, "x", "RC-2"),
        ("low in retrieval", "q", ["t"], "x", ["a", "b", "c", "t"], ["a", "b"], None, None, None, "x", "RC-2"),
        ("used", "q", ["t"], "42", ["t"], None, ["t"], 1, None, "It is 42.", "RC-0"),
        ("not used", "q", ["t"], "42", ["t"], None, ["t"], 1, None, "It is 41.", "RC-4"),
        ("no answer", "q", ["t"], "", ["t"], None, ["t"], 1, None, None, "RC-4"),
        ("behind the context", "q", ["t"], "x", ["a", "t"], None, ["a"], 1, None, "x", "RC-2"),
        ("null lists", "q", None, None, None, None, None, None, None, None, "RC-1"),
    ]
    got = {r["id"]: r["root_cause"] for r in traces.root_causes(spark.createDataFrame([r[:-1] for r in rows], schema), "id").collect()}
    assert got == {r[0]: r[-1] for r in rows}


def test_cases_by_any_preview(spark):
    cases = spark.createDataFrame([("c3", "Wh"), ("c1", "What was"), ("c2", ""), ("c4", None), ("c5", "Who"), ("c0", "What was the revenue of Acme?")], "case_id string, preview string")
    questions = spark.createDataFrame([("1", "What was the revenue?"), ("2", "Who?"), ("3", "W"), ("4", None), ("5", "")], "id string, question string")
    assert {tuple(r) for r in traces.cases_for(cases, questions, "preview", "question").collect()} == {("1", "c1"), ("2", "c3")}


def test_describe_against_sorted_values(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randint(0, 30) / 4])) for _ in range(400)] + [("one", 2.5)]
    got = {r["g"]: r for r in accounting.describe(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v").collect()}
    for g in {g for g, _ in rows}:
        own = sorted(v for h, v in rows if h == g and v is not None)
        assert got[g]["n"] == len(own) and got[g]["median_value"] == round((own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2, 4)
        assert got[g]["p95_value"] == own[math.ceil(0.95 * len(own)) - 1] and (got[g]["min_value"], got[g]["max_value"]) == (own[0], own[-1])
    assert accounting.describe(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


def test_snapshots_merge_by_path(spark):
    files = spark.createDataFrame([(0, "a", "1"), (0, "b", "2"), (1, "b", "9"), (1, "c", "3")], "snapshot int, path string, sha string")
    assert sorted(tuple(r) for r in snapshots.merged(files, "path", ["snapshot"]).collect()) == [(0, "a", "1"), (0, "b", "2"), (1, "c", "3")]
    assert sorted(tuple(r) for r in snapshots.merge_counts(files, "path", "snapshot", ["snapshot"]).collect()) == [(0, 2, 2, 0), (1, 2, 1, 1)]
    with pytest.raises(ValueError):
        snapshots.extended(files, files, "path", refuse_empty=True)
    old = spark.createDataFrame([("1", "x", "y"), ("2", "x", None)], "id string, a string, b string")
    new = spark.createDataFrame([("2", None, "z"), ("3", "n", None)], "id string, a string, b string")
    assert sorted(tuple(r) for r in snapshots.latest_by_key(old, new, "id").collect()) == [("1", "x", "y"), ("2", "x", "z"), ("3", "n", None)]


def test_totals_count_records_once(spark):
    frame = spark.createDataFrame([(1, "v", "c", 5, 1, 1, 2, 2), (1, "v", "c", 5, 1, 1, 2, 2), (2, None, None, None, None, None, None, None)], "record_id long, variant_name string, category string, input_tokens long, output_tokens long, system_prompt_tokens long, contexts_tokens long, query_tokens long")
    total = accounting.totals(frame).where("level = 3").first()
    assert (total["calls"], total["input_tokens"]) == (2, 5)


def test_documents_prefer_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# markdown")
    (tmp_path / "b.md").write_text("only markdown")
    (tmp_path / "sub" / "a.pages.json").write_text(json.dumps([{"page_number": 2, "text": "two"}, {"page_number": 1, "text": "one"}, {"page_number": 3, "text": ""}]))
    assert {r["name"]: r["content"] for r in files.documents(spark, str(tmp_path)).collect()} == {"a": "one\n\ntwo", "b": "only markdown"}
    assert files.loader_for("x.pages.json") == "pages_json"
    assert files.file_hashes(spark, str(tmp_path)).count() == 3


def test_parser_errors_are_rows(spark, tmp_path):
    (tmp_path / "good.bin").write_bytes(b"ok")
    (tmp_path / "bad.bin").write_bytes(b"bad")

    def parser(path, content):
        if content == b"bad":
            raise ValueError("broken")
        return [{"page_number": 1, "text": content.decode()}]

    found = files.parsed(spark, str(tmp_path), "*.bin", parser, "path string, error string, page_number int, text string").collect()
    assert sorted((r["text"] or "", r["error"] or "") for r in found) == [("", "ValueError: broken"), ("ok", "")]


def test_chunk_lines_keep_corrupt_ones(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a::chunk::000", "text": "t", "metadata": {"source": "a"}}\nnot json\n')
    found = files.chunks(spark, str(tmp_path)).collect()
    assert sorted(str(r["chunk_id"]) for r in found) == ["None", "a::chunk::000"]


def test_vector_collection(spark, tmp_path):
    schema = "chunk_id string, source string, text string, embedding array<float>"
    store = Collection(spark, str(tmp_path / "v"))
    assert store.info() is None and store.read() is None
    store.create(spark.createDataFrame([("1", "a", "x", [1.0]), ("2", "b", "y", [2.0])], schema))
    store.upsert(spark.createDataFrame([("2", "b", "new", [2.0]), ("3", "b", "z", [3.0])], schema))
    assert [r["chunk_id"] for r in store.scroll("b", limit=1)] == ["2"] and [r["chunk_id"] for r in store.scroll("b", "2")] == ["3"] and store.scroll("x") == []
    with pytest.raises(ValueError):
        store.index(store.read(), lambda rows: rows.limit(1))
    assert store.count() == 3 and store.count("b") == 2
    assert store.read().where("chunk_id = '2'").first()["text"] == "new"
    store.delete_source("b")
    store.replace_source("a", spark.createDataFrame([("9", "a", "q", [0.0])], schema))
    assert [r["chunk_id"] for r in store.read().collect()] == ["9"] and store.info()["points"] == 1


def test_stream_equals_batch(spark, tmp_path):
    folder = "/root/testdata/sf0.001/token_records.parquet"
    schema = spark.read.parquet(folder).schema
    spark.read.parquet(folder).dropDuplicates(["record_id"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = streams.token_windows(stream, width="1 day", late="400 days").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = streams.token_windows(spark.read.parquet(folder), width="1 day")
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, batch.collect()))


def test_stream_keeps_newest(spark, tmp_path):
    rows = spark.createDataFrame([("a", k, f"r{k}") for k in range(6)], "g string, at int, id string")
    rows.where("at < 4").coalesce(1).write.parquet(str(tmp_path / "in/x"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    start = lambda: streams.keep_newest(stream, str(tmp_path / "out"), "g", "at", "id", 2, str(tmp_path / "cp")).start()
    query = start()
    query.processAllAvailable()
    query.stop()
    rows.where("at >= 4").coalesce(1).write.parquet(str(tmp_path / "in/y"))
    query = start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out/b1")).collect()) == ["r4", "r5"]


def test_keyed_table_and_pointers(spark, tmp_path):
    from folioforge.sources.vectors import KeyedTable, Pointers

    sessions = KeyedTable(spark, str(tmp_path / "s"), "id", "id string, note string")
    assert sessions.get("a") is None
    sessions.put([("a", "one"), ("b", "two")])
    sessions.put([("a", "three")])
    assert sessions.get("a")["note"] == "three" and sessions.read().count() == 2
    sessions.remove("a")
    assert sessions.get("a") is None
    pointers = Pointers(spark, str(tmp_path / "p"))
    pointers.put([("here", str(tmp_path)), ("gone", str(tmp_path / "nowhere"))])
    assert pointers.resolve("here") == str(tmp_path) and pointers.resolve("gone") is None and pointers.resolve("never") is None


def test_positional_overlap(spark):
    frame = spark.createDataFrame([("abc", "abd"), ("", "a"), ("ab", "abcd")], "a string, b string")
    assert [round(r[0], 3) for r in frame.select(testsets.positional_overlap(F.col("a"), F.col("b"))).collect()] == [0.667, 0.0, 1.0]
