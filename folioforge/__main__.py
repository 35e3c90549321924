"""Command line: list and run queries, run experiments, build chunks."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioforge", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    query = commands.add_parser("query", help="run a query over a folder of tables")
    query.add_argument("name")
    query.add_argument("folder")
    query.add_argument("--output", help="folder for the result; shown if not given")
    query.add_argument("--explain", action="store_true")
    chunks = commands.add_parser("chunks", help="cut Markdown and page files into chunks")
    chunks.add_argument("folder")
    chunks.add_argument("output")
    chunks.add_argument("--size", type=int, default=512)
    chunks.add_argument("--overlap", type=int, default=0)
    experiment = commands.add_parser("experiment", help="run an experiment file over a folder of tables")
    experiment.add_argument("file")
    experiment.add_argument("folder")
    experiment.add_argument("runs")
    given = parser.parse_args(arguments)

    from folioforge import queries as core

    known = core.queries()
    if given.command == "list":
        print("\n".join(sorted(known)))
        return 0
    spark = SparkSession.builder.appName("folioforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if given.command == "query":
        if given.name not in known:
            print(f"no query {given.name}", file=sys.stderr)
            return 2
        frame = known[given.name](spark, given.folder)
        if given.explain:
            frame.explain("formatted")
        frame.write.mode("overwrite").parquet(given.output) if given.output else frame.show(20, truncate=60)
    elif given.command == "chunks":
        from folioforge.operators import chunking
        from folioforge.sources import files

        chunking.fixed_chunks(files.documents(spark, given.folder), "name", "content", given.size, given.overlap).write.mode("overwrite").json(given.output)
    else:
        from folioforge.plans import experiments
        from folioforge.runtime import read_table

        loaded = experiments.Experiment.load(given.file)
        runs = experiments.Runs(spark, given.runs)
        questions = read_table(spark, given.folder, "golden_qa").where("question is not null")
        documents = read_table(spark, given.folder, "loaded_documents").dropDuplicates(["load_id"])
        experiments.run(loaded, runs, documents, questions, "load_id", "content", "source_path")
        print(experiments.report(loaded, runs))
    return 0


if __name__ == "__main__":
    sys.exit(main())
