"""Experiments: variants of one base configuration over test sets, planned, run, resumed and compared."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import evaluation, snapshots
from folioforge.plans import pipeline

# Metrics of the presets.
PRESETS = {
    "core": ("hit_rate", "recall", "mrr", "ndcg"),
    "extended": ("hit_rate", "recall", "mrr", "ndcg", "diversity"),
    "full": ("hit_rate", "recall", "mrr", "ndcg", "diversity", "answer_relevancy", "context_precision", "context_recall"),
}


@dataclass
class Experiment:
    """A name, a base configuration, variants as overrides of it, and the metrics to report."""

    name: str
    base: dict = field(default_factory=dict)
    variants: dict[str, dict] = field(default_factory=lambda: {"baseline": {}})
    metrics: str = "core"
    test_sets: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.name or not self.variants:
            raise ValueError("an experiment needs a name and a variant")
        if self.metrics not in PRESETS:
            raise ValueError(f"unknown metrics {self.metrics}")
        for name in self.variants:
            self.settings(name)

    @classmethod
    def load(cls, path: str) -> Experiment:
        """From a YAML or JSON file; unknown keys are refused."""
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls(**yaml.safe_load(text))
        return cls(**json.loads(text))

    def config(self, variant: str) -> dict:
        """Configuration of a variant."""
        return snapshots.deep_merge(self.base, self.variants[variant])

    def settings(self, variant: str) -> pipeline.Settings:
        """Settings of a variant; configuration keys that they don't have are kept aside."""
        config = self.config(variant)
        known = set(pipeline.Settings.__dataclass_fields__) - {"extra"}
        own = {k: tuple(v) if isinstance(v, list) else v for k, v in config.items() if k in known}
        return pipeline.Settings(**own, extra={k: v for k, v in config.items() if k not in known})

    def fingerprint(self, variant: str) -> str:
        """Hash of everything that shapes a variant's results."""
        return snapshots.config_hash({"config": self.config(variant), "metrics": self.metrics, "test_sets": self.test_sets})


class Runs:
    """Results of variants under a folder, one partition a variant; a manifest row says which hash is complete."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _path(self, variant: str, fingerprint: str) -> str:
        return f"{self.folder}/variant={variant}/{fingerprint}"

    def complete(self, variant: str, fingerprint: str) -> bool:
        """Whether this variant was finished with this fingerprint."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(variant, fingerprint), "_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def save(self, variant: str, fingerprint: str, results: DataFrame) -> None:
        """Write the results of a variant; Spark marks them complete when all tasks are."""
        results.write.mode("overwrite").parquet(self._path(variant, fingerprint))

    def read(self, experiment: Experiment) -> DataFrame | None:
        """Results of all complete variants, with their name."""
        union = None
        for variant in experiment.variants:
            if self.complete(variant, experiment.fingerprint(variant)):
                part = self.spark.read.parquet(self._path(variant, experiment.fingerprint(variant))).withColumn("variant", F.lit(variant))
                union = part if union is None else union.unionByName(part)
        return union


def plan(experiment: Experiment, runs: Runs) -> dict[str, str]:
    """run or reuse for each variant."""
    return {v: "reuse" if runs.complete(v, experiment.fingerprint(v)) else "run" for v in experiment.variants}


#: Metrics that the hits alone give.
_OF_HITS = PRESETS["extended"]


def run(experiment: Experiment, runs: Runs, documents: DataFrame, questions: DataFrame, key: str, text: str, source: str, embed=None, score_answers=None) -> dict[str, str]:
    """Run what isn't complete; variants with the same chunk settings share one table of chunks. Returns the plan.

    ``embed`` is needed for semantic chunks. ``score_answers`` maps hits with their texts, the questions and the settings to
    (id, metrics of answers); a preset with such metrics is refused without it.
    """
    if set(PRESETS[experiment.metrics]) - set(_OF_HITS) and score_answers is None:
        raise ValueError(f"the metrics {experiment.metrics} need a function that scores answers")
    planned = plan(experiment, runs)
    chunks: dict[str, DataFrame] = {}
    for variant, action in planned.items():
        if action == "reuse":
            continue
        settings = experiment.settings(variant)
        shared = settings.chunk_fingerprint()
        if shared not in chunks:
            chunks[shared] = pipeline.chunked(documents, settings, key, text, embed).join(documents.select(key, F.col(source).alias("source")), key).persist()
        hits = pipeline.retrieve(chunks[shared], questions, settings).join(chunks[shared].select("chunk_id", "source", "text"), "chunk_id")
        results = pipeline.quality(hits, questions, "source")
        if score_answers is not None:
            results = results.join(score_answers(hits, questions, settings), "id", "left")
        runs.save(variant, experiment.fingerprint(variant), results)
    for table in chunks.values():
        table.unpersist()
    return planned


def summary(experiment: Experiment, runs: Runs) -> DataFrame:
    """(variant, metric, mean_value, n_values) of the preset's metrics over the complete variants."""
    results = runs.read(experiment)
    if results is None:
        raise ValueError("no variant is complete")
    names = [m for m in PRESETS[experiment.metrics] if m in results.columns]
    long = results.select("variant", F.lit("retrieval").alias("family"), F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(m).cast("double") for m in names)))).alias("metric", "value"))
    return evaluation.means(long, ["variant"])


def report(experiment: Experiment, runs: Runs) -> str:
    """Markdown: metrics by variant, the best variant of each metric, and wins; one row a variant reaches the driver."""
    means = summary(experiment, runs)
    table: dict[str, dict[str, float]] = {}
    for row in means.collect():
        table.setdefault(row["variant"], {})[row["metric"]] = row["mean_value"]
    metrics = sorted({m for values in table.values() for m in values})
    lines = [f"# {experiment.name}", "", "| variant | " + " | ".join(metrics) + " |", "| --- |" + " ---: |" * len(metrics)]
    lines += [f"| {v} | " + " | ".join("-" if table[v].get(m) is None else f"{table[v][m]:.4f}" for m in metrics) + " |" for v in sorted(table)]
    winners = evaluation.best(means).orderBy("metric").collect()
    lines += ["", "## Best variants", "", *(f"- {w['metric']}: {w['variant']} ({w['mean_value']:.4f})" for w in winners)]
    return "\n".join(lines) + "\n"
