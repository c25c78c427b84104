"""Command line: ``python -m palaver list``, ``run QUERY TABLES OUT`` (Parquet), ``evaluate GOLD HYP OUT`` (timed corpora with one word list; CSV)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="palaver", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    for name in ("query", "tables", "out"):
        run.add_argument(name)
    evaluate = commands.add_parser("evaluate")
    for name in ("gold", "hyp", "out"):
        evaluate.add_argument(name)
    asked = parser.parse_args(args)
    from palaver.queries import QUERIES

    if asked.command == "list":
        print("\n".join(sorted(QUERIES)))
        return
    spark = SparkSession.builder.appName("palaver").getOrCreate()
    if asked.command == "run":
        if asked.query not in QUERIES:
            parser.error(f"no query {asked.query}")
        QUERIES[asked.query](spark, asked.tables).write.mode("errorifexists").parquet(asked.out)
        return
    from palaver.plans.evaluation import evaluate_files

    evaluate_files(spark, asked.gold, asked.hyp).write.mode("errorifexists").csv(asked.out, header=True)


if __name__ == "__main__":
    main()
