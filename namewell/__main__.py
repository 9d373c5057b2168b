"""Command line: ``python -m namewell infer`` runs ``disambiguate``; ``compare`` holds two runs' clusters against each other."""

import argparse
import json
import sys

from pyspark.sql import SparkSession

from namewell import pipeline
from namewell.operators import compare


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="namewell")
    commands = parser.add_subparsers(dest="command", required=True)
    infer = commands.add_parser("infer", help="sources to mirrored sources with author identities")
    infer.add_argument("--publications", required=True)
    infer.add_argument("--references")
    infer.add_argument("--output", required=True)
    infer.add_argument("--uid-scope", default="dataset", choices=["dataset", "registry"])
    infer.add_argument("--namespace")
    infer.add_argument("--registry-in")
    infer.add_argument("--registry-out")
    infer.add_argument("--eps", type=float, default=0.35)
    infer.add_argument("--pair-cap", type=int)
    infer.add_argument("--json", action="store_true", help="print the whole report")
    both = commands.add_parser("compare", help="clusters of a run against a baseline's")
    both.add_argument("baseline")
    both.add_argument("current")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("namewell").getOrCreate()
    if given.command == "compare":
        read = lambda d: spark.read.parquet(f"{d}/mention_clusters").select("mention_id", "block_key", "author_uid_local").withColumnRenamed("author_uid_local", "author_uid")
        print(json.dumps(compare.drift_summary(read(given.baseline), read(given.current)), indent=2))
        return 0
    known = {k: v for k, v in vars(given).items() if k not in ("command", "json")}
    report = pipeline.disambiguate(spark, pipeline.Request(**known), tell=lambda what, more: print(f"{what}: {more}", file=sys.stderr))
    print(json.dumps(report if given.json else {"run_id": report["run_id"], "go": report["gates"]["go"], "blockers": report["gates"]["blockers"], "warnings": report["gates"]["warnings"]}, indent=2, default=str))
    return 0 if report["gates"]["go"] else 1


if __name__ == "__main__":
    sys.exit(main())
