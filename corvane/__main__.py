"""python -m corvane run SOURCE OUT | status SOURCE OUT | scan PATH [--format text|json|sarif] | queries"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corvane", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("run", "status"):
        p = verbs.add_parser(verb)
        p.add_argument("source")
        p.add_argument("out")
        p.add_argument("--from", dest="first")
        p.add_argument("--to", dest="last")
        p.add_argument("--again", action="store_true")
    p = verbs.add_parser("scan")
    p.add_argument("path")
    p.add_argument("--format", choices=("text", "json", "sarif", "annotations"), default="text")
    p.add_argument("--threshold", type=float, default=0.5)
    p.add_argument("--base")
    verbs.add_parser("queries")
    args = parser.parse_args(arguments)
    if args.verb == "queries":
        from .catalog import queries

        print("\n".join(sorted(queries())))
        return 0
    spark = SparkSession.builder.appName("corvane").getOrCreate()
    if args.verb in ("run", "status"):
        from .plans.runner import Run, RunConfig

        run = Run(spark, RunConfig(args.source, args.out))
        if args.verb == "run":
            print("ran:", ", ".join(run.run(args.first, args.last, args.again)) or "nothing")
        run.status().orderBy("position").show(truncate=False)
        return 0
    from .operators.scanner import scan_files
    from .sources import readers, writers

    found = scan_files(readers.read_sources(spark, args.path), args.threshold)
    flagged = writers.findings(found.filter("vulnerable"), args.base)
    made = {"text": lambda: writers.text_report(found).orderBy("path").select("line_text"), "json": lambda: writers.json_report(found), "sarif": lambda: writers.sarif(flagged), "annotations": lambda: writers.annotations(flagged).orderBy("uri", "line")}
    for row in made[args.format]().toLocalIterator():
        print(row[0])
    return int(not flagged.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
