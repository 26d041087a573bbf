"""``python -m cadenza trim|retime|validate``: datasets from the command line; prints one JSON line, exit code 1 if a validation finds something."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from . import datasets


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cadenza", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("trim", "retime", "validate"):
        own = commands.add_parser(name)
        own.add_argument("source")
        own.add_argument("output")
    commands.choices["trim"].add_argument("--tail-seconds", type=float, default=2.0)
    commands.choices["trim"].add_argument("--analyse", action="store_true", help="only say what would be kept")
    commands.choices["retime"].add_argument("--outputs", type=int, default=2)
    commands.choices["retime"].add_argument("--least-frames", type=int, default=30)
    commands.choices["validate"].add_argument("--of", choices=("trim", "retime"), default="retime")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("cadenza").getOrCreate()
    if a.command == "trim" and a.analyse:
        rows, _, meta = datasets.checked_frames(spark, a.source)
        edges = datasets.still_edges(rows, float(meta["fps"]), tail_seconds=a.tail_seconds)
        said = edges.selectExpr("count(*) as episodes", "sum(n) as frames", "sum(stop - start) as kept", "count_if(all_static) as static").first().asDict()
    elif a.command == "trim":
        said = datasets.trim_dataset(spark, a.source, a.output, tail_seconds=a.tail_seconds)
    elif a.command == "retime":
        said = datasets.retime_dataset(spark, a.source, a.output, a.outputs, a.least_frames)
    else:
        found = (datasets.retime_errors if a.of == "retime" else datasets.trim_errors)(spark, a.source, a.output)
        said = {"errors": found.count()}
    print(json.dumps(said))
    return int(bool(said.get("errors")))


if __name__ == "__main__":
    sys.exit(main())
