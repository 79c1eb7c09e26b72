"""Command line: list the queries, run one and write its rows, merge shards of predictions, or run all stages of a folder.

    python -m evalweave list
    python -m evalweave run QUERY TABLES [--out FOLDER] [--rows N]
    python -m evalweave merge SHARD... --manifest FILE --protocols FILE --out FOLDER
    python -m evalweave report PREDICTIONS --out FILE
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _session(name: str) -> SparkSession:
    return SparkSession.builder.appName(f"evalweave {name}").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """A folder or file of Parquet or of JSON lines, by its name."""
    return spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)


def _list(args) -> int:
    from evalweave.plans import catalogue

    with_sql = catalogue.oracle_sql()
    for name in sorted(catalogue.queries()):
        print(name if name in with_sql else f"{name} (without SQL)")
    return 0


def _run(args) -> int:
    from evalweave.plans import catalogue

    found = catalogue.queries()
    if args.query not in found:
        print(f"no query {args.query}", file=sys.stderr)
        return 2
    out = found[args.query](_session(args.query), args.tables)
    if args.out:
        out.write.mode("errorifexists").parquet(args.out)
    else:
        out.show(args.rows, truncate=False)
    return 0


def _merge(args) -> int:
    """Shards of a run into one: faults are printed and nothing is written where there are some."""
    from evalweave.operators import answers

    spark = _session("merge")
    classes = sorted(r[0] for r in _rows(spark, args.manifest).select("l3").distinct().collect())  # a taxonomy's leaves
    merged = answers.shard_merge([_rows(spark, p) for p in args.shards], _rows(spark, args.manifest), _rows(spark, args.protocols), classes)
    faults = merged["faults"].groupBy("fault").agg(F.count(F.lit(1)).alias("n")).collect()
    if faults:
        for r in faults:
            print(f"{r['fault']}: {r['n']}", file=sys.stderr)
        return 1
    for name in ("rows", "summary", "classes", "confusion"):
        merged[name].write.mode("errorifexists").parquet(f"{args.out}/{name}")
    return 0


def _report(args) -> int:
    """Predictions (truth, pred, ok1 to ok3) as a Markdown report."""
    from evalweave.operators import metrics
    from evalweave.plans import figures
    from evalweave.sources import sinks

    rows = _rows(_session("report"), args.predictions)
    conf = metrics.confusion(rows)
    text = sinks.report("Evaluation", [("Summary", figures.summary(rows)), ("Classes", metrics.class_metrics(conf).orderBy("label")), ("Confusions", metrics.top_confusions(conf))])
    Path(args.out).write_text(text, encoding="utf-8")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="evalweave", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list").set_defaults(go=_list)
    run = commands.add_parser("run")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("--out")
    run.add_argument("--rows", type=int, default=20)
    run.set_defaults(go=_run)
    merge = commands.add_parser("merge")
    merge.add_argument("shards", nargs="+")
    merge.add_argument("--manifest", required=True)
    merge.add_argument("--protocols", required=True)
    merge.add_argument("--out", required=True)
    merge.set_defaults(go=_merge)
    report = commands.add_parser("report")
    report.add_argument("predictions")
    report.add_argument("--out", required=True)
    report.set_defaults(go=_report)
    args = parser.parse_args(argv)
    return args.go(args)


if __name__ == "__main__":
    sys.exit(main())
