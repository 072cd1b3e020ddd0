"""Command line: ``python -m trailspark analyze INPUT... [-o DIR]`` and ``python -m trailspark collect [-o DIR]``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from trailspark.plans.engine import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trailspark")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("inputs", nargs="+")
    a.add_argument("-o", "--output", default="case")
    a.add_argument("--external-csv", action="append", default=[])
    a.add_argument("--keep-duplicates", action="store_true")
    a.add_argument("--dedupe-window", type=float, default=2.0)
    c = sub.add_parser("collect")
    c.add_argument("-o", "--output", default="collection")
    c.add_argument("--home", default=os.path.expanduser("~"))
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    engine = Engine(SparkSession.builder.appName("trailspark").getOrCreate())
    if args.command == "collect":
        print(f"FILES={engine.collect(args.home, args.output).count()}")
        return 0
    case = engine.analyze(args.inputs, args.external_csv, args.keep_duplicates, args.dedupe_window)
    doc = engine.write(case, args.output)
    if doc is None:
        print("no events were parsed", file=sys.stderr)
        return 2
    print(f"EVENTS={doc['total_events']}\nSESSIONS={doc['sessions']}\nIOCS={doc['ioc_count']}\nOUTPUT={args.output}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
