import json

import pytest
from pyspark.sql import functions as F

from folioforge.__main__ import main
from folioforge.plans import experiments, pipeline, seams
from folioforge.queries import queries


def tables(spark):
    documents = spark.createDataFrame([("d1", "red fox jumps over the dog " * 5, "data/a.md"), ("d2", "blue whale swims in the sea " * 5, "data/b.md"), ("d3", None, "data/c.md")], "id2 string, content string, source_path string")
    questions = spark.createDataFrame([("q1", "Where does the whale swim? blue sea", ["data\\b.md"]), ("q2", "red fox", ["data/a.md"])], "id string, question string, expected_sources array<string>")
    return documents, questions


def test_experiment_runs_resumes_and_reports(spark, tmp_path):
    path = tmp_path / "e.json"
    path.write_text(json.dumps({"name": "demo", "base": {"chunk_size": 8, "top_k": 3}, "variants": {"bm25": {"method": "bm25"}, "hybrid": {"rerank": True}, "vector": {"method": "vector"}}, "metrics": "extended"}))
    experiment = experiments.Experiment.load(str(path))
    runs = experiments.Runs(spark, str(tmp_path / "runs"))
    documents, questions = tables(spark)
    assert set(experiments.run(experiment, runs, documents, questions, "id2", "content", "source_path").values()) == {"run"}
    assert set(experiments.plan(experiment, runs).values()) == {"reuse"}
    experiment.variants["bm25"]["k1"] = 1.2
    assert experiments.plan(experiment, runs) == {"bm25": "run", "hybrid": "reuse", "vector": "reuse"}
    means = {(r["variant"], r["metric"]): r["mean_value"] for r in experiments.summary(experiment, runs).collect()}
    assert means["vector", "hit_rate"] == 1.0 and means["hybrid", "mrr"] == 1.0
    assert "| hybrid |" in experiments.report(experiment, runs)


def test_every_question_is_answered(spark, tmp_path):
    words = ["red fox", "blue whale", "green frog", "grey wolf"]
    spark.createDataFrame([(f"doc_{n}", f"the {w} lives here") for n, w in enumerate(words)], "doc_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    asked = [(f"golden_{n:09d}", f"where is the {w}") for n, w in zip((1, 20, 33, 41), words)] + [("golden_000000040", None), ("golden_000000007", None)]
    spark.createDataFrame(asked, "id string, question string").write.parquet(str(tmp_path / "golden_qa.parquet"))
    prompts = dict(queries()["answer_pipeline"](spark, str(tmp_path)).collect())
    assert {k: v.split("\n")[1] for k, v in prompts.items()} == {k: f"the {w} lives here" for (k, _), w in zip(asked, words)}


def test_all_golden_questions_have_a_prompt(spark):
    folder = "/root/testdata/sf0.001"
    asked = spark.read.parquet(f"{folder}/golden_qa.parquet").where("question is not null")
    prompts = [r["id"] for r in queries()["answer_pipeline"](spark, folder).collect()]
    assert sorted(prompts) == sorted(r["id"] for r in asked.collect()) and len(prompts) == 30


def test_settings_are_checked():
    with pytest.raises(ValueError):
        pipeline.Settings(method="guess")
    with pytest.raises(ValueError):
        pipeline.Settings(chunk_size=4, overlap=4)
    with pytest.raises(ValueError):
        experiments.Experiment("x", metrics="none")
    with pytest.raises(ValueError):
        experiments.run(experiments.Experiment("x", metrics="full"), None, None, None, "doc_id", "text", "source")


def test_retry_waits_and_gives_up():
    waits, calls = [], []

    class Busy(Exception):
        status_code = 429

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise Busy()
        return "ok"

    assert seams.with_retry(call, sleep=waits.append) == "ok" and len(waits) == 2 and 1 <= waits[0] <= 1.1
    with pytest.raises(KeyError):
        seams.with_retry(lambda: {}["x"], sleep=waits.append)


def test_model_seam(spark):
    frame = spark.createDataFrame([("a", 1), ("bb", 2)], "t string, k int")

    def load():
        return lambda batch: [len(t) for t in batch["t"]]

    def broken():
        raise RuntimeError("no model")

    assert [r["n"] for r in seams.map_model(frame, ["t"], load, "n", "int").orderBy("k").collect()] == [1, 2]
    failed = seams.map_model(frame, ["t"], broken, "n", "int").collect()
    assert all(r["n"] is None and "no model" in r["n_error"] for r in failed)


def test_one_failing_row_leaves_its_batch(spark):
    frame = spark.createDataFrame([("a", 1), (None, 2), ("ccc", 3)], "t string, k int").coalesce(1)
    rows = seams.map_model(frame, ["t"], lambda: lambda batch: [len(t) for t in batch["t"]], "n", "int").orderBy("k").collect()
    assert [r["n"] for r in rows] == [1, None, 3] and "TypeError" in rows[1]["n_error"] and rows[0]["n_error"] is None
    assert seams.map_model(frame.limit(0), ["t"], lambda: lambda batch: [], "n", "int").count() == 0


def test_rewriting_and_judging(spark):
    frame = spark.createDataFrame([("q", "1. first\n\n2) second\n- third\nfourth")], "id string, a string")
    assert [r["query"] for r in seams.sub_queries(frame, "id", "a").orderBy("sub_no").collect()] == ["first", "second", "third"]
    judged = spark.createDataFrame([('x {"overall_score": 1.4}',), ('{"directness": 5, "specificity": 4}',), ("none",)], "a string")
    assert [r[0] for r in judged.select(seams.relevancy(F.col("a"))).collect()] == [1.0, 0.8, None]
    verdicts = spark.createDataFrame([([1, 0, 1],), ([],)], "v array<int>")
    assert [r[0] for r in verdicts.select(F.round(seams.supported_share(F.col("v")), 3)).collect()] == [0.667, 0.0]
    answers = spark.createDataFrame([("red fox?", ["The sea is blue. The red fox jumps."])], "q string, c array<string>")
    assert answers.select(seams.extractive_answer(F.col("q"), F.col("c"))).first()[0].strip() == "The red fox jumps."


def test_command_line(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "bm25_search" in capsys.readouterr().out
    assert main(["query", "nothing", "/tmp"]) == 2
    assert main(["query", "error_counts", "/root/testdata/sf0.001", "--output", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("one two three")
    assert main(["chunks", str(tmp_path / "in"), str(tmp_path / "c"), "--size", "2"]) == 0
    assert spark.read.json(str(tmp_path / "c")).count() == 2
